"""Inputs of the registered queries, made from the test tables in Spark and, alike, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import clean_line


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, ord, text``: the lines of documents that are not blank."""
    cleaned = F.transform(F.split("text", "\n"), clean_line)  # inside one expression, so that a line is cleaned once
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(cleaned).alias("ord", "text")).where("text <> ''")


LINES = r"""
raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS ord FROM documents),
ln AS (SELECT doc_id, source, ord, trim(regexp_replace(line, '[ \t]+', ' ', 'g')) AS text FROM raw WHERE trim(regexp_replace(line, '[ \t]+', ' ', 'g')) <> '')
"""

#: A chunk is a run of lines: at most 120 words, 20 of them repeated.
LIMIT, OVERLAP = 120, 20


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, doc_name, chunk_index, page_start, text``: documents packed into chunks."""
    from marlstone.functions.text import chunk_id
    from marlstone.operators.chunking import packed_texts

    docs = table(spark, sf_dir, "documents")
    kept = F.filter(F.transform(F.split("text", "\n"), clean_line), lambda x: x != "")
    made = packed_texts(docs.select("doc_id", kept.alias("lines")), "doc_id", "lines", LIMIT, OVERLAP)
    name = F.col("id").cast("string")
    return made.select(
        chunk_id(name, F.col("first"), F.col("group_no")).alias("chunk_id"), name.alias("doc_name"), F.col("group_no").alias("chunk_index"), F.col("first").alias("page_start"), "text"
    )


PACKED = (
    LINES
    + f""",
p0 AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::INT AS i, text, len(string_split(text, ' ')) AS n FROM ln),
p AS (SELECT *, (sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n)::BIGINT AS c FROM p0),
d AS (SELECT doc_id, list(c ORDER BY i) AS cs, list(text ORDER BY i) AS ts, count(*) AS m FROM p GROUP BY doc_id),
w AS (SELECT doc_id, 0 AS i, 0 AS s, n::BIGINT AS h, NULL::INT AS gs, NULL::INT AS ge FROM p WHERE i = 0
      UNION ALL
      SELECT p.doc_id, p.i, CASE WHEN w.h + p.n > {LIMIT} THEN w.s + len(list_filter(d.cs[w.s + 1 : p.i], lambda x: p.c - x > {OVERLAP})) ELSE w.s END,
        CASE WHEN w.h + p.n > {LIMIT} THEN coalesce(list_max(list_filter(list_transform(d.cs[w.s + 1 : p.i], lambda x: p.c - x), lambda x: x <= {OVERLAP})), 0) ELSE w.h END + p.n,
        CASE WHEN w.h + p.n > {LIMIT} THEN w.s END, CASE WHEN w.h + p.n > {LIMIT} THEN p.i END
      FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1 JOIN d ON d.doc_id = p.doc_id),
g AS (SELECT doc_id, gs AS s, ge AS e FROM w WHERE ge IS NOT NULL UNION ALL SELECT w.doc_id, w.s, w.i + 1 FROM w JOIN d ON d.doc_id = w.doc_id AND w.i = d.m - 1),
gn AS (SELECT doc_id, s::INT AS s, e::INT AS e, (row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1)::INT AS no FROM g),
ch AS (SELECT printf('%s__p%04d__c%04d', gn.doc_id::VARCHAR, s, no) AS chunk_id, gn.doc_id::VARCHAR AS doc_name, no AS chunk_index, s AS page_start,
      array_to_string(ts[s + 1 : e], chr(10) || chr(10)) AS text FROM gn JOIN d ON d.doc_id = gn.doc_id)
"""
)


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qa_id, conv_id, question, answer``: each user turn with the assistant turn after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("_next", F.lead("role").over(w))
    pairs = turns.where("role = 'user' and _next = 'assistant'")
    return pairs.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qa_id"), "conv_id", F.col("text").alias("question"), "answer")


QA = """
qa AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS qa_id, conv_id, text AS question, answer FROM
      (SELECT *, lead(text) OVER t AS answer, lead(role) OVER t AS nxt FROM conversations WINDOW t AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nxt = 'assistant')
"""

_PUNCT = """!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"""


def sql_words(column: str) -> str:
    """Words of an answer: lower-cased, without ASCII punctuation."""
    return f"list_filter(string_split_regex(translate(lower(coalesce({column}, '')), '{_PUNCT}', ''), '\\s+'), lambda x: x <> '')"


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_key, row_no, cells``: each order as a table, a row of years and then one row per item."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate", place.alias("place"))
    text = lambda c: F.col(c).cast("long").cast("string")
    label = F.concat(F.lit("Part "), (F.col("l_partkey") % 7).cast("string"))
    flag = F.col("l_linenumber") % 3
    tail = (
        F.when(flag == 0, F.array(F.concat(F.lit("("), text("l_quantity"), F.lit(".0)"))))
        .when(flag == 1, F.array(F.lit("-"), F.concat(text("l_quantity"), F.lit(".5"))))
        .otherwise(F.array(F.lit("$"), F.concat(text("l_quantity"), F.lit("|5"))))
    )
    rows = items.select(
        F.col("l_orderkey").alias("order_key"), F.col("place").alias("row_no"), F.concat(F.array(label, F.lit(" "), F.lit("$"), text("l_extendedprice")), tail).alias("cells")
    )
    year = F.year(F.min("l_shipdate"))
    heads = items.groupBy("l_orderkey").agg(F.array(F.lit(None).cast("string"), F.lit(""), year.cast("string"), (year - 1).cast("string")).alias("cells"))
    return heads.select(F.col("l_orderkey").alias("order_key"), F.lit(0).alias("row_no"), "cells").unionByName(rows)


#: The same tables, already as records: where the last cell is no figure (it holds a bar) the row has no figures.
RECORDS = """
yr AS (SELECT l_orderkey, year(min(l_shipdate)) AS y FROM lineitem GROUP BY l_orderkey),
pl AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS place FROM lineitem),
it AS (SELECT l_orderkey AS order_key, place::INT AS row_no, 'Part ' || (l_partkey % 7) AS row_label, y, '$' || trunc(l_extendedprice)::BIGINT AS price,
      CASE l_linenumber % 3 WHEN 0 THEN '(' || trunc(l_quantity)::BIGINT || '.0)' WHEN 1 THEN '-' || trunc(l_quantity)::BIGINT || '.5' END AS quantity,
      CASE l_linenumber % 3 WHEN 0 THEN -trunc(l_quantity) WHEN 1 THEN -(trunc(l_quantity) + 0.5) END AS q, trunc(l_extendedprice) AS v
      FROM pl JOIN yr USING (l_orderkey) WHERE l_linenumber % 3 < 2),
rec AS (SELECT order_key, row_no, 0 AS col_no, row_label, y::VARCHAR AS column_header, price AS raw_value, v::DOUBLE AS value FROM it
      UNION ALL SELECT order_key, row_no, 1, row_label, (y - 1)::VARCHAR, quantity, q::DOUBLE FROM it),
gr AS (SELECT order_key, row_label, min(row_no) AS first, arg_max(raw_value, row_no) FILTER (col_no = 0) AS a, arg_max(raw_value, row_no) FILTER (col_no = 1) AS b FROM rec GROUP BY ALL),
mx AS (SELECT order_key, row_label, count(*) AS rows FROM it GROUP BY ALL),
pick AS (SELECT order_key, arg_min(rows, (-c, f)) AS rows FROM (SELECT order_key, rows, count(*) AS c, min(first) AS f FROM mx JOIN gr USING (order_key, row_label) GROUP BY ALL) GROUP BY order_key),
cols AS (SELECT order_key, flatten(list_transform(range(rows), lambda i: [y::VARCHAR, (y - 1)::VARCHAR])) AS cols FROM pick JOIN yr ON l_orderkey = order_key),
gn AS (SELECT gr.*, y, cols, row_number() OVER (PARTITION BY gr.order_key ORDER BY first) - 1 AS label_no FROM gr JOIN cols USING (order_key) JOIN yr ON l_orderkey = gr.order_key),
gt AS (SELECT order_key, (label_no // 5)::INT AS group_no, label_no, row_label, cols, list_transform(cols, lambda c: CASE WHEN c = y::VARCHAR THEN a ELSE b END) AS cells FROM gn)
"""
