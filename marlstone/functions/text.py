"""String functions as column expressions. Patterns use (?U): white space and word characters of all scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, which answer normalisation deletes (fixed values).
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


#: White space of all scripts.
BLANKS = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_line(c: Column) -> Column:
    """Runs of spaces and tabs become one space; ends are trimmed."""
    return strip(F.regexp_replace(c, "[ \t]+", " "))


def dehyphenate(c: Column) -> Column:
    """Joins words broken at line ends, then lines."""
    return clean_line(F.replace(F.regexp_replace(c, r"(?U)(\w)- ?\n ?(\w)", "$1$2"), F.lit("\n"), F.lit(" ")))


def boilerplate_key(c: Column) -> Column:
    """Running heads without their page number; a page number alone has an empty key."""
    return F.lower(collapse(F.regexp_replace(strip(c), r"(?U)\s*\d+\s*$", "")))


def section_id(title: Column) -> Column:
    item = F.regexp_extract(strip(title), r"(?i)^item\s+(\d+[a-z]?)", 1)
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)
    return F.when(item != "", F.concat(F.lit("item_"), F.lower(item))).when(slug != "", slug).otherwise(F.lit("section"))


def clean_definition(c: Column) -> Column:
    return F.regexp_replace(collapse(c), r"\.+$", "")


def words(c: Column) -> Column:
    """White-space words; a blank text has none."""
    bare = strip(c)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"(?U)\s+"))


def count_tokens(c: Column) -> Column:
    return F.size(words(c))


def answer_words(c: Column) -> Column:
    """Lower-cased words without ASCII punctuation."""
    return words(F.translate(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, ""))


def normalise_answer(c: Column) -> Column:
    return F.array_join(answer_words(c), " ")


def shortened(c: Column, n: int) -> Column:
    """The first n characters, with dots where some were cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def chunk_id(doc: Column, page: Column, index: Column) -> Column:
    return F.format_string("%s__p%04d__c%04d", doc, page, index)


def table_id(doc: Column, number: Column) -> Column:
    return F.format_string("%s__table%03d", doc, number)


def unwrap_url(url: Column, host: str, path: str, parameter: str) -> Column:
    """The address that a viewer page's base64 parameter holds; other addresses, and undecodable ones, stay. Line breaks and tabs inside an
    address don't count (encoders break base64 after 76 characters)."""
    bare = F.translate(url, "\r\n\t", "")
    target = F.try_parse_url(bare, F.lit("QUERY"), F.lit(parameter))
    padded = F.rpad(target, (F.ceil(F.length(target) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.try_to_binary(padded, F.lit("base64"))
    plain = F.when(F.is_valid_utf8(decoded.cast("string")), decoded.cast("string"))
    viewer = (F.try_parse_url(bare, F.lit("HOST")) == host) & (F.try_parse_url(bare, F.lit("PATH")) == path)
    return F.when(viewer & (F.length(target) > 0), F.coalesce(plain, url)).otherwise(url)
