"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower-cased, white space collapsed, ends trimmed) and hashed; the distinct
documents (ids) that hold a line are counted per host. A line above the limits
(``documents > max(min_docs, max_share * documents of the host)``) is boilerplate, on hosts of any size;
``quality_filter`` removes it from the texts that it returns. A document is depleted when less than
``min_left`` of its words stay, and is rejected. The rules judge the text as it came. A caller may set ``max_docs``, a number of
documents beyond which a line is boilerplate whatever its share; by default, in the query and the pipeline alike, there
is none.

Up to ``BROADCAST_LINES`` frequent lines in all (8 bytes each) are broadcast, as one
array per host; beyond it the line hashes are joined, and each document gets the array of those that it holds.

Defined results: a null or blank text has no words, fails the base rules and is not kept. Texts are judged whole, however long
they are. A line that is exactly at a limit stays (ties are no excess). A null host is
a host of its own. Rows of one id are judged one by one, and count as one document of their host; rows without an id
count one by one. Empty tables give no rows.
Other columns of the input, whatever their names, pass through ``quality_filter`` unchanged, but for the
length column, which follows a text that lost lines; ``quality_rules`` replaces those that have a measure's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import WS_CHARS, WS_CLASS, materialize, read_table, words

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_SHARE, MIN_DOCS, MIN_LEFT = 0.1, 5, 0.5
#: Frequent lines, and hosts, up to which they are broadcast (8 bytes a line).
BROADCAST_LINES, BROADCAST_HOSTS = 1 << 20, 10_000


def repeated_window_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Where two windows have equal hashes, windows are sorted by hash, words and position, so that equal ones stand
    together whatever else has their hash; the positions found are then merged as intervals of length 3."""
    n, zero = F.size(tokens), F.lit(0).cast("long")
    starts = F.sequence(F.lit(0), n - 3)
    word = lambda i, k: F.get(tokens, i + k)
    hashed = F.transform(starts, lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2)))
    whole = F.transform(
        starts,
        lambda i: F.struct(
            F.xxhash64(word(i, 0), word(i, 1), word(i, 2)).alias("h"), word(i, 0).alias("a"), word(i, 1).alias("b"), word(i, 2).alias("c"), i.alias("at")
        ),
    )

    def covered(x: Column) -> Column:
        def equal(i: Column, j: Column) -> Column:
            p, q = F.get(x, i), F.get(x, j)
            same = p["h"] == q["h"]
            for k in ("a", "b", "c"):
                same = same & (p[k] == q[k])
            return F.coalesce(same, F.lit(False))

        hit = F.transform(F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: equal(i, i + 1) | equal(i, i - 1)), lambda i: F.get(x, i)["at"])
        start = F.struct(zero.alias("sum"), F.lit(-3).alias("at"))
        step = lambda s, p: F.struct((s["sum"] + F.least(F.lit(3), p - s["at"])).alias("sum"), p.alias("at"))
        return F.aggregate(F.sort_array(hit), start, step, lambda s: s["sum"])

    # one-element arrays bind a value once, for the lambdas that read it again and again
    in_order = F.get(F.transform(F.array(F.sort_array(whole)), covered), F.lit(0))
    several = F.get(F.transform(F.array(hashed), lambda x: F.size(F.array_distinct(x)) < F.size(x)), F.lit(0))
    return F.when(n < 4, zero).when(several, in_order).otherwise(zero)


def line_table(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(WS_CHARS)), WS_CLASS + "+", " "))


def line_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(line_table(text), lambda x: F.xxhash64(normal_line(x))))


def frequent_lines(
    docs: DataFrame, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, host: str = "source", text: str = "text", max_docs: int | None = None, id_col: str | None = "doc_id"
) -> DataFrame:
    """``host, h``: hashes of the lines that too many documents of the host hold."""
    key = F.col(id_col) if id_col else F.lit(None).cast("long")
    rows = docs.select(F.col(host).alias("host"), key.alias("id"), line_hashes(F.col(text)).alias("h"))
    # size and lines in one aggregate: a document adds one row with a null hash
    lines = rows.select("host", "id", F.explode(F.array_append("h", F.lit(None).cast("long"))).alias("h"))
    counts = lines.groupBy("host", "h").agg((F.countDistinct("id") + F.count_if(F.col("id").isNull())).alias("n"))
    share = F.col("n") * max_share
    share = share if max_docs is None else F.least(share, F.lit(float(max_docs)))
    total = counts.where(F.col("h").isNull()).select(F.col("host").alias("of"), F.greatest(F.lit(float(min_docs)), share).alias("limit"))
    kept = counts.where(F.col("h").isNotNull() & (F.col("n") > min_docs))
    return kept.join(total, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("limit")).select("host", "h")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
COUNTED = (*MEASURES[:5], MEASURES[7])


def measures(text: Column, frequent: Column, min_left: float) -> Column:
    """All measures of a text as one struct. Words and lines are bound once, inside one expression: as columns of
    their own, a filter on the verdict would put their making into every use of them."""
    none = F.array().cast("array<long>")
    bound = F.array(F.struct(words(text).alias("w"), line_table(text).alias("l"), F.coalesce(frequent, none).alias("f")))

    def counted(x: Column) -> Column:
        often = F.filter(x["l"], lambda y: F.array_contains(x["f"], F.xxhash64(normal_line(y))))
        gone = F.aggregate(F.when(F.size(x["f"]) > 0, often).otherwise(F.array().cast("array<string>")), F.lit(0).cast("long"), lambda s, y: s + F.size(words(y)).cast("long"))
        return F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
            F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
            repeated_window_words(x["w"]).alias("n_repeat_words"),
            gone.alias("removed_words"),
        )

    def judged_(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        depleted = m["n_words"] - m["removed_words"] < min_left * m["n_words"]
        return F.struct(*[m[c].alias(c) for c in COUNTED], failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))

    return F.get(F.transform(F.transform(bound, counted), judged_), F.lit(0))


def with_frequent(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (row, text, host) with ``frequent array<long>``: frequent lines of the host, or of the document."""
    sizes = found.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    hosts, lines = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if lines <= BROADCAST_LINES and hosts <= BROADCAST_HOSTS:
        lists = found.groupBy(F.col("host").alias("_host")).agg(F.sort_array(F.collect_list("h")).alias("frequent"))
        return rows.join(F.broadcast(lists), F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    # written, so that a row's key stays the same
    keyed = materialize(rows.withColumn("_key", F.monotonically_increasing_id()), "keyed-rows")
    held = keyed.select("_key", "host", F.explode(line_hashes(F.col("text"))).alias("_h"))
    hits = held.join(found.select(F.col("host").alias("_host"), "h"), F.col("host").eqNullSafe(F.col("_host")) & (F.col("_h") == F.col("h")))
    return keyed.join(hits.groupBy("_key").agg(F.collect_list("h").alias("frequent")), "_key", "left").drop("_key")


def judged(docs: DataFrame, max_share: float, min_docs: int, min_left: float, host: str, text: str, max_docs: int | None, id_col: str | None) -> DataFrame:
    """``row`` (the input's columns as a struct), ``text``, ``frequent`` and ``m``, the measures."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.col(host).alias("host"))
    found = materialize(frequent_lines(docs, max_share, min_docs, host, text, max_docs, id_col), "frequent-lines")
    wide = with_frequent(rows, found)
    return wide.select("row", "text", "frequent", measures(F.col("text"), F.col("frequent"), min_left).alias("m"))


def without_lines(text: Column, frequent: Column) -> Column:
    """The text without the lines whose hashes are listed; all others stay as they are."""
    stay = F.filter(F.split(text, "\n"), lambda y: ~F.array_contains(frequent, F.xxhash64(normal_line(y))))
    return F.when(F.size(frequent) > 0, F.array_join(stay, "\n")).otherwise(text)


def quality_rules(
    docs: DataFrame,
    max_share: float = MAX_SHARE,
    min_docs: int = MIN_DOCS,
    min_left: float = MIN_LEFT,
    host: str = "source",
    text: str = "text",
    max_docs: int | None = None,
    id_col: str | None = "doc_id",
) -> DataFrame:
    """The input with the measures added; they replace columns of the same names."""
    names = [c for c in docs.columns if c not in MEASURES]
    found = judged(docs, max_share, min_docs, min_left, host, text, max_docs, id_col)
    return found.select(*[F.col(f"row.`{c}`") for c in names], *[F.col(f"m.{c}") for c in MEASURES])


def quality_filter(
    docs: DataFrame,
    max_share: float = MAX_SHARE,
    min_docs: int = MIN_DOCS,
    min_left: float = MIN_LEFT,
    host: str = "source",
    text: str = "text",
    max_docs: int | None = None,
    length_col: str | None = "n_chars",
    id_col: str | None = "doc_id",
) -> DataFrame:
    """The rows that the rules keep, with all columns of the input, their texts without the frequent lines and the
    length column, where there is one, brought up to date."""
    kept = judged(docs, max_share, min_docs, min_left, host, text, max_docs, id_col).where("m.kept")
    kept = kept.select("row", "text", without_lines(F.col("text"), F.col("frequent")).alias("_new"))

    def column(c: str) -> Column:
        old = F.col(f"row.`{c}`")
        if c == text:
            return F.col("_new").alias(c)
        if c == length_col:
            return F.when(F.col("_new") == F.col("text"), old).otherwise(F.length("_new").cast(docs.schema[c].dataType)).alias(c)
        return old.alias(c)

    return kept.select(*[column(c) for c in docs.columns])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs).drop("text", "source")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"

#: Common table expressions over a relation `documents`; `judged` is the result.
JUDGED_SQL = rf"""
w AS (SELECT doc_id, source, {_WORDS} AS ws, {_LINES} AS ls, text FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line FROM w),
nl AS (SELECT doc_id, source, line,
       lower(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
       len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM l),
hosts AS (SELECT source, count(DISTINCT doc_id) + count(*) FILTER (doc_id IS NULL) AS docs FROM documents GROUP BY source),
often AS (SELECT n.source, n.norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS c FROM nl GROUP BY source, norm) n
       JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source WHERE n.c > greatest({MIN_DOCS}, {MAX_SHARE} * h.docs)),
gone AS (SELECT nl.doc_id, sum(nw) AS removed FROM nl JOIN often o ON nl.source IS NOT DISTINCT FROM o.source AND nl.norm = o.norm GROUP BY nl.doc_id),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS covered FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
       len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
       (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
       coalesce(covered, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
       FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
judged AS (SELECT *, base_failed = false AND n_words - removed_words >= {MIN_LEFT} * n_words AS kept FROM
       (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m))
"""
ORACLE_SQL = f"WITH {JUDGED_SQL} SELECT * FROM judged"
