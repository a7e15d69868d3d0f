import pytest
from pyspark.sql import functions as F

from marlstone.functions import numbers, text
from marlstone.functions.stem import stem
from marlstone.operators import tables


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


CELLS = [
    ("$1,234", True, 1234.0), ("(16,048", True, -16048.0), ("(16,048)", True, -16048.0), ("1,", False, 1.0), ("7", False, 7.0), ("12", True, 12.0), ("50%", True, 50.0),
    ("$ 5", True, 5.0), ("-", False, None), ("—", False, None), ("5.0", True, 5.0), (".5", False, 0.5), ("(5)", True, -5.0), ("(-5)", True, 5.0), ("(5)%", True, None),
    ("(5%)", False, -5.0), ("$(5)", False, None), ("-$3", True, -3.0), ("$,", True, None), ("1.2.3", False, None), ("5)", False, 5.0), ("1d", False, None), ("nan", False, None),
]


def test_cells(spark):
    got = values(spark, [c[0] for c in CELLS], F.col("c"), numbers.is_real_value(F.col("c")), numbers.parse_numeric(F.col("c")))
    assert got == CELLS


ROWS = [
    (["Cash", "$", "120"], "Cash", ["$120"]), (["Goodwill", "-", "120"], "Goodwill", ["-120"]), (["Goodwill", "—", "120"], "Goodwill —", ["120"]),
    (["Segments", "4"], "Segments 4", []), (["Cash and cash e", "quivalents", "10", "20"], "Cash and cash e quivalents", ["10", "20"]),
    ([None, "", "2018", "2017"], "", ["2018", "2017"]), ([], "", []), (["$"], "$", []),
]


def test_rows(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROWS)], "i int, cells array<string>")
    got = [(r.label, r["values"]) for r in tables.parsed_rows(df).orderBy("i").collect()]
    assert got == [(r[1], r[2]) for r in ROWS]


def test_section_ids(spark):
    pairs = {
        "Item 7A. Risk": "item_7a", "ITEM 1 — Business": "item_1", "item 15": "item_15", "Item seven": "item_seven", "***": "section", "Cash & Equivalents": "cash_equivalents",
        "Notes to Consolidated Financial Statements of the Group": "notes_to_consolidated_financial_statemen",
    }
    assert values(spark, pairs, text.section_id(F.col("c"))) == list(pairs.values())


def test_boilerplate_keys(spark):
    pairs = {"Acme Corp  Annual Report 12": "acme corp annual report", " 57 ": "", "Page 3 of 9": "page 3 of", "FORM 10-K": "form 10-k"}
    assert values(spark, pairs, text.boilerplate_key(F.col("c"))) == list(pairs.values())


def test_lines_and_answers(spark):
    assert values(spark, ["infor- \nmation  is\nhere", "a-b"], text.dehyphenate(F.col("c"))) == ["information is here", "a-b"]
    assert values(spark, ["The U.S.", "", None, " a  B!"], text.normalise_answer(F.col("c"))) == ["the us", "", "", "a b"]
    assert values(spark, ["x" * 201, "y"], text.shortened(F.col("c"), 200)) == ["x" * 200 + "...", "y"]
    assert values(spark, ['<a href="x">&\'</a>'], text.html_escape(F.col("c"))) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#x27;&lt;/a&gt;"]


def test_unwrap_keeps_bad_input(spark):
    urls = ["https://v.example/p?t=!!!", "https://v.example/p", "https://other.example/p?t=aHR0cHM6Ly9hLmI", "https://v.example/p?t=aHR0cHM6Ly9hLmI", "no url"]
    assert values(spark, urls, text.unwrap_url(F.col("c"), "v.example", "/p", "t")) == [urls[0], urls[1], urls[2], "https://a.b", "no url"]


def test_unwrap_of_long_addresses(spark):
    """Base64 of more than 57 bytes may come with line breaks; the link of every other address stays as it is, with its breaks."""
    import base64

    long = "https://a.example/" + "x" * 100
    urls = ["https://v.example/p?t=" + base64.encodebytes(long.encode()).decode().strip("\n="), "https://v.example/p?t=" + base64.b64encode(long.encode()).decode(), "https://o.example/p?t=a\r\nb"]
    assert values(spark, urls, text.unwrap_url(F.col("c"), "v.example", "/p", "t")) == [long, long, urls[2]]


def test_url_unwrap_query(spark, tmp_path):
    from marlstone.plans.registry import QUERIES

    urls = [(i, "https://a.example/" + "x" * n) for i, n in enumerate(range(30, 70))]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(map(tuple, QUERIES["url_unwrap"](spark, str(tmp_path)).collect())) == urls


@pytest.mark.parametrize(
    "word,root",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
     ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"),
     ("triplicate", "triplic"), ("formative", "form"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("generalizations", "gener")],
)
def test_stems(word, root):
    assert stem(word) == root
