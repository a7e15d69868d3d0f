"""Queries over sources and sinks, page layout, stores, answers and whole jobs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone import schema
from marlstone.config import ExtractionConfig, RetrievalConfig
from marlstone.functions.text import count_tokens
from marlstone.operators import ablation, answering, glossary, ivf, layout, metrics, retrieval, tables, vectors
from marlstone.plans import jobs
from marlstone.plans.inputs import LINES, PACKED, QA, RECORDS, chunk_texts, lines, order_tables, qa_pairs, table
from marlstone.plans.query import query
from marlstone.plans.retrieval import _LCS, _N, _ROUGE, _ranked_sql
from marlstone.sources import catalog, files, remote
from marlstone.sources import layout as parsing
from marlstone.sources.tables import shared_folder, written

# sources and sinks


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as JSON lines and read by a schema."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), shared_folder(spark)
    files.write_jsonl(docs, path)
    return files.read_jsonl(spark, path, docs.schema)


@query(f"WITH {QA} SELECT qa_id, run_id, question, answer AS generated_answer FROM qa, (SELECT unnest(['a', 'b']) AS run_id)")
def answers_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of answers appended to one file; the run's id tells them apart."""
    pairs, path = qa_pairs(spark, sf_dir).select("qa_id", "question", F.col("answer").alias("generated_answer")), shared_folder(spark)
    for run in ("a", "b"):
        files.write_jsonl(pairs.withColumn("run_id", F.lit(run)), path, append=True)
    record = T.StructType([*schema.ANSWER, T.StructField("run_id", T.StringType())])
    return files.read_jsonl(spark, path, record).select("qa_id", "run_id", "question", "generated_answer")


@query(f"WITH {QA} SELECT qa_id, question, answer AS generated_answer, NULL::VARCHAR AS company FROM qa")
def answers_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer records read by their schema: keys that a record lacks are null."""
    path = shared_folder(spark)
    files.write_jsonl(qa_pairs(spark, sf_dir).select("qa_id", "question", F.col("answer").alias("generated_answer")), path)
    return files.read_answers(spark, path).select("qa_id", "question", "generated_answer", "company")


@query("SELECT doc_id::VARCHAR AS doc_name, CASE WHEN lang = 'en' THEN 'ok' ELSE 'failed' END AS status, CASE WHEN lang = 'en' THEN n_chars::VARCHAR END AS n_pages, CASE WHEN lang <> 'en' THEN source END AS error FROM documents")
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status report with fixed columns, absent ones empty, as CSV and back."""
    good, path = F.col("lang") == "en", shared_folder(spark)
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_name"), F.when(good, "ok").otherwise("failed").alias("status"), F.when(good, F.col("n_chars")).alias("n_pages"), F.when(~good, F.col("source")).alias("error")
    )
    files.write_report(rows, path, schema.EXTRACTION_REPORT)
    return files.read_report(spark, path).select("doc_name", "status", "n_pages", "error")


@query(f"WITH RECURSIVE {PACKED}, n AS (SELECT DISTINCT doc_name FROM ch ORDER BY doc_name LIMIT 20) SELECT chunk_id, doc_name, page_start, text FROM ch WHERE doc_name IN (SELECT doc_name FROM n)")
def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as JSON lines; the first 20 documents by name, with all their chunks."""
    path = shared_folder(spark)
    files.write_jsonl(chunk_texts(spark, sf_dir), path)
    return catalog.first_documents(files.read_chunks(spark, path), 20).select("chunk_id", "doc_name", "page_start", "text")


@query(f"""
WITH RECURSIVE {PACKED}, l AS (SELECT doc_id::VARCHAR AS doc_name, toxic FROM labels)
SELECT chunk_id, doc_name, page_start, CASE WHEN toxic = 1 THEN 'seen: ' || text ELSE text END AS text FROM ch JOIN l USING (doc_name)
""")
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks put into a store, those of toxic documents once more with another text, and looked up by the names of all labelled documents."""
    store = files.ChunkStore(spark, shared_folder(spark))
    chunks = written(chunk_texts(spark, sf_dir).select("chunk_id", "doc_name", "page_start", "text"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_name"), "toxic")
    store.put(chunks)
    store.put(chunks.join(labels.where("toxic = 1"), "doc_name", "left_semi").select("chunk_id", "doc_name", "page_start", F.concat(F.lit("seen: "), "text").alias("text")))
    return store.of(labels.select("doc_name"))


@query("""
WITH e AS (SELECT 'n' || c_nationkey AS doc_name, c_custkey::INT AS page_num, c_mktsegment AS term FROM customer)
SELECT doc_name, page_num, term, (row_number() OVER (ORDER BY length(term) DESC, doc_name, page_num, term))::INT AS place FROM e WHERE doc_name = 'n3'
""")
def glossary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of one document, longest terms first; their order is written as a place."""
    path = shared_folder(spark)
    files.write_jsonl(table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("doc_name"), F.col("c_custkey").cast("int").alias("page_num"), F.col("c_mktsegment").alias("term")), path)
    rows = written(files.read_glossary(spark, path, "n3").select("doc_name", "page_num", "term"))
    return catalog.with_order(rows.withColumn("_n", -F.length("term")), ["_n", "doc_name", "page_num", "term"], "place").drop("_n")


@query(f"WITH {QA} SELECT qa_id, question FROM qa WHERE conv_id % 3 = 1 ORDER BY qa_id LIMIT 50")
def questions_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of one document, then the first 50 of them."""
    path = shared_folder(spark)
    files.write_jsonl(qa_pairs(spark, sf_dir).select("qa_id", F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string")).alias("doc_name"), "question", "answer"), path)
    return files.read_questions(spark, path, "d1", 50).select("qa_id", "question")


@query("SELECT sum(len(string_split(text, chr(10))))::BIGINT AS n_lines FROM documents")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    table(spark, sf_dir, "documents").where("text is not null").select("text").write.text(path)
    return files.line_count(spark, path)


@query("SELECT o_orderkey AS doc_name, CASE WHEN o_orderkey % 5 = 0 THEN 'source_missing' WHEN o_orderstatus = 'F' THEN 'skipped' ELSE 'ok' END AS status FROM orders")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work left after files that are missing and documents that are done."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_name"), "o_orderstatus")
    todo, rest = catalog.work_list(orders, orders.where("doc_name % 5 <> 0"), orders.where("o_orderstatus = 'F'"))
    return todo.select("doc_name", F.lit("ok").alias("status")).unionByName(rest)


@query("""
SELECT page_id::VARCHAR AS doc_name, CASE page_id % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'downloaded' END AS status,
 CASE page_id % 5 WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 'status 404' ELSE 'status 503' END END AS error FROM pages
""")
def fetch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetching all pages through an injected session: names that exist are skipped, some statuses are tried again,
    and two in five of the others fail at first and are fetched again from the report."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_name"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("doc_link"))

    def session(again: bool):
        def fetch(link: str):
            n = int(link.rsplit("#", 1)[1])
            if n % 5 == 1 and n % 2:
                raise remote.Retry("status 503")
            if n % 5 == 1 or (n % 5 == 2 and not again):
                raise ValueError("status 404")
            return iter([link.encode()])

        return fetch

    def fetched(todo: DataFrame, again: bool) -> DataFrame:
        return remote.fetch_documents(todo, lambda: session(again), lambda _, chunks: [*chunks] and None, lambda name: int(name) % 5 == 0, delay_s=0, attempts=2, backoff_s=0, budget_s=60)

    report = written(fetched(pages, False))
    return remote.retried(report, pages, lambda todo: fetched(todo, True)).select("doc_name", "status", "error")


@query("""
SELECT page_id::VARCHAR AS doc_name, CASE WHEN page_id % 5 = 0 THEN 'skipped' WHEN page_id % 5 = 1 THEN 'failed' ELSE 'downloaded' END AS status,
 CASE page_id % 5 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 1 ELSE 3 END WHEN 2 THEN 2 ELSE 1 END::INT AS attempts FROM pages
""")
def polite_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by host, on a clock that only sleeping moves: some exist, some fail for good, some answer on the second try."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_name"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("doc_link"))

    def session():
        seen: set[int] = set()

        def fetch(link: str):
            n = int(link.rsplit("#", 1)[1])
            if n % 5 == 1:
                raise ValueError("status 404") if n % 2 == 0 else remote.Retry("status 503")
            if n % 5 == 2 and n not in seen:
                seen.add(n)
                raise remote.Retry("status 429", after=30.0)
            yield b"page"

        return fetch

    def timer():
        now = [0.0]
        return lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)

    put = lambda name, chunks: [c for c in chunks] and None
    done = remote.fetch_by_host(pages, session, put, exists=lambda name: int(name) % 5 == 0, partitions=8, timer=timer)
    return done.select("doc_name", "status", "attempts")


# layout


def _parse(content: bytes) -> dict:
    """A plain-text parser: lines as spans, the words of lines with a digit as cells, short lines as contents."""
    text = content.decode()
    if len(text) % 11 == 0:
        raise ValueError("not a document")
    spans, cells, toc = [], [], []
    for i, t in enumerate(text.split("\n")):
        spans.append({"page": i // 20, "page_height": 800.0, "block": i // 5, "line": i, "span": 0, "text": t, "size": 10.0, "bold": len(t) % 3 == 0})
        if "1" in t:
            cells += [{"page": i // 20, "table_no": i, "row_no": 0, "col_no": k, "cell": w} for k, w in enumerate(t.split(" "))]
        if 0 < len(t) < 40:
            toc.append({"level": 1, "title": t, "page": i // 20 + 1})
    return {"spans": spans, "cells": cells, "toc": toc}


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents WHERE length(text) % 11 <> 0),
n AS (SELECT doc_id, count(*) AS n_spans, sum(CASE WHEN contains(t, '1') THEN len(string_split(t, ' ')) ELSE 0 END)::BIGINT AS n_cells, count_if(length(t) BETWEEN 1 AND 39)::BIGINT AS n_toc,
      count_if(length(t) % 3 = 0)::BIGINT AS n_bold FROM l GROUP BY doc_id)
SELECT d.doc_id::VARCHAR AS doc_name, CASE WHEN n.doc_id IS NULL THEN 'failed' ELSE 'ok' END AS status, coalesce(n_spans, 0) AS n_spans, coalesce(n_cells, 0) AS n_cells, coalesce(n_toc, 0) AS n_toc, coalesce(n_bold, 0) AS n_bold
FROM documents d LEFT JOIN n USING (doc_id)
""")
def layout_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a registered parser; one that fails is a row and stops no other."""
    content = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_name"), F.encode("text", "utf-8").alias("content"))
    opened = written(parsing.open_documents(content, _parse))
    count = lambda part, *more: parsing.layout_table(opened, part).groupBy("doc_name").agg(F.count(F.lit(1)).alias(f"n_{part}"), *more)
    out = opened.select("doc_name", "status").join(count("spans", F.count_if("bold").alias("n_bold")), "doc_name", "left").join(count("cells"), "doc_name", "left").join(count("toc"), "doc_name", "left")
    return out.na.fill(0)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as two spans and a blank one; 20 lines a page, 5 a block."""
    ord_, text = F.col("ord"), F.col("text")
    half = F.floor(F.length(text) / 2).cast("int")
    span = lambda k, t, bold: F.struct(F.lit(k).alias("span"), t.alias("text"), (F.lit(9.0) + k).alias("size"), bold.alias("bold"))
    parts = F.array(span(0, F.substring(text, F.lit(1), half), F.length(text) % 3 == 0), span(1, F.lit("  "), F.lit(True)), span(2, F.substring(text, half + 1, F.length(text)), F.lit(False)))
    y = (ord_ % 20 * 40).cast("double")
    rows = lines(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc_name"), F.floor(ord_ / 20).cast("int").alias("page"), F.lit(800.0).alias("page_height"), F.floor(ord_ / 5).cast("int").alias("block"), ord_.alias("line"),
        F.explode(parts).alias("s"), F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 10).alias("y1"),
    )
    return rows.select("doc_name", "page", "page_height", "block", "line", "s.*", "x0", "y0", "x1", "y1")


_SPANNED = f"""{LINES},
sp AS (SELECT doc_id::VARCHAR AS doc_name, (ord // 20)::INT AS page, (ord // 5)::INT AS block, ord AS line, text, trim(substr(text, 1, length(text) // 2)) <> '' AND length(text) % 3 = 0 AS bold,
      (ord % 20 * 40)::DOUBLE AS y0 FROM ln)"""


@query(f"WITH {_SPANNED} SELECT doc_name, page, block, line, text, bold, 11.0::DOUBLE AS size, y0 <= 60 OR y0 >= 740 AS margin FROM sp")
def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put together from spans, and whether they stand in the margins."""
    out = layout.lines_of_spans(_spans(spark, sf_dir))
    return out.select("doc_name", "page", "block", "line", "text", "bold", "size", layout.in_margin(F.col("y0"), F.col("page_height")).alias("margin"))


@query(rf"""
WITH {LINES},
k AS (SELECT doc_id, source, ord, text, lower(trim(regexp_replace(regexp_replace(trim(text), '\s*\d+\s*$', ''), '\s+', ' ', 'g'))) AS key FROM ln),
n AS (SELECT source, key FROM k WHERE ord = 0 AND key <> '' GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, ord, text FROM k WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source = k.source AND n.key = k.key)
""")
def boilerplate_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines that recur in their source are running heads, and go wherever they stand."""
    rows = lines(spark, sf_dir)
    pages = rows.select("source").distinct().withColumn("n_pages", F.lit(2))
    keys = layout.boilerplate_keys(rows.where("ord = 0"), pages, ExtractionConfig(), "source")
    return layout.without_boilerplate(rows, keys, "source").select("doc_id", "ord", "text")


@query("""
WITH i AS (SELECT p_size AS page, p_partkey % 40 AS y0, 0 AS kind, p_partkey AS ord FROM part UNION ALL SELECT s_nationkey, s_suppkey % 40, 1, s_suppkey FROM supplier)
SELECT page, kind, ord, (row_number() OVER (PARTITION BY page ORDER BY y0, kind, ord) - 1)::INT AS item FROM i
""")
def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and tables of a page by height; blocks first where heights are equal."""
    blocks = table(spark, sf_dir, "part").select(F.col("p_size").alias("page"), (F.col("p_partkey") % 40).alias("y0"), F.col("p_partkey").alias("block"))
    found = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast(blocks.schema["page"].dataType).alias("page"), (F.col("s_suppkey") % 40).alias("y0"), F.col("s_suppkey").alias("table_no"))
    return layout.page_items(blocks, found, ["page"]).select("page", "kind", "ord", "item")


@query(f"""
WITH {LINES}, s AS (SELECT doc_id, (ord // 10)::INT AS page, ord, text, length(text) % 4 = 0 AS is_table FROM ln),
f AS (SELECT *, last_value(CASE WHEN NOT is_table THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS UNBOUNDED PRECEDING) AS above FROM s)
SELECT doc_id, page, ord AS table_no, above FROM f WHERE is_table
""")
def table_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last paragraph above each table on its page (lines of 4n characters stand for tables)."""
    rows = lines(spark, sf_dir).select("doc_id", F.floor(F.col("ord") / 10).cast("int").alias("page"), "ord", F.col("ord").alias("item"), "text")
    is_table = F.length("text") % 4 == 0
    return tables.text_above(rows.where(~is_table), rows.where(is_table).withColumnRenamed("ord", "table_no"), ["doc_id", "page"])


def _simple_corpus(spark: SparkSession, sf_dir: str) -> jobs.Corpus:
    """Documents as pages of text in the middle of the page; short lines without an end mark are bold."""
    y = (F.col("ord") % 20 * 30 + 100).cast("double")
    spans = lines(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc_name"), F.floor(F.col("ord") / 20).cast("int").alias("page"), F.lit(800.0).alias("page_height"), F.col("ord").alias("block"), F.lit(0).alias("line"),
        F.lit(0).alias("span"), "text", F.lit(10.0).alias("size"), (~F.rlike("text", F.lit("[.,;]$"))).alias("bold"), F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 10).alias("y1"),
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_name"), F.lit(None).cast("string").alias("doc_link"), F.col("lang").alias("doc_type"), F.col("source").alias("company"), F.lit("2018").alias("doc_period"))
    cells = spark.createDataFrame([], schema.TABLE_CELL)
    toc = spark.createDataFrame([], T.StructType([*schema.TOC, T.StructField("ord", T.LongType())]))
    return jobs.build_corpus(spans, cells, toc, docs, replace(ExtractionConfig(), chunk_size=1 << 30, min_chunk_tokens=1))


_CORPUS = rf"""{LINES},
pg AS (SELECT doc_id, max(ord // 20) + 1 AS n_pages FROM ln GROUP BY doc_id),
sc AS (SELECT doc_id, avg(n) < 20 AS scanned FROM (SELECT doc_id, ord // 20 AS page, length(string_agg(text, chr(10))) AS n FROM ln WHERE ord // 20 < 5 GROUP BY ALL) GROUP BY doc_id),
hd AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)^item\s+\d+[a-z]?') OR (length(text) BETWEEN 3 AND 90 AND NOT regexp_matches(text, '[.,;]$')) THEN text END AS heading FROM ln),
se AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM hd),
si AS (SELECT *, CASE WHEN regexp_extract(lower(trim(section)), '^item\s+(\d+[a-z]?)', 1) <> '' THEN 'item_' || regexp_extract(lower(trim(section)), '^item\s+(\d+[a-z]?)', 1)
      WHEN section IS NOT NULL THEN coalesce(nullif(substr(regexp_replace(regexp_replace(lower(section), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), ''), 'section') END AS section_id FROM se),
tu AS (SELECT *, (heading IS NOT NULL AND section_id IS DISTINCT FROM lag(section_id) OVER (PARTITION BY doc_id ORDER BY ord))::INT AS turn FROM si),
sg AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY ord) AS seg FROM tu),
cc AS (SELECT doc_id, seg, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS chunk_index, sum(len(string_split_regex(text, '\s+')))::INT AS n_tokens, min(ord // 20)::INT AS page_start, max(ord // 20)::INT AS page_end,
      arg_min(section_id, ord) AS section_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM sg GROUP BY doc_id, seg)
"""


@query(f"""
WITH {_CORPUS} SELECT doc_id::VARCHAR AS doc_name, chunk_index::INT AS chunk_index, printf('%s__p%04d__c%04d', doc_id::VARCHAR, page_start, chunk_index::INT) AS chunk_id, page_start, page_end, section_id, n_tokens, text,
 lang AS doc_type, source AS company FROM cc JOIN sc USING (doc_id) JOIN documents USING (doc_id, text) WHERE NOT scanned
""".replace("JOIN documents USING (doc_id, text)", "JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)"))
def build_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: spans to lines, gate, headings, paragraphs, events, chunks."""
    return _simple_corpus(spark, sf_dir).chunks.select("doc_name", "chunk_index", "chunk_id", "page_start", "page_end", "section_id", "n_tokens", "text", "doc_type", "company")


@query(f"""
WITH {_CORPUS}, n AS (SELECT doc_id, count(*) AS n FROM cc GROUP BY doc_id)
SELECT d.doc_id::VARCHAR AS doc_name, CASE WHEN n_pages IS NULL THEN 'source_missing' WHEN scanned THEN 'likely_scanned_or_image' ELSE 'ok' END AS status, n_pages, CASE WHEN NOT scanned THEN n END AS n_chunks_narrative,
 CASE WHEN NOT scanned THEN 0 END AS n_chunks_table FROM documents d LEFT JOIN pg USING (doc_id) LEFT JOIN sc USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and counts of every document of the build."""
    return _simple_corpus(spark, sf_dir).report.select("doc_name", "status", "n_pages", "n_chunks_narrative", "n_chunks_table")


def _orders_corpus(spark: SparkSession, sf_dir: str) -> jobs.Corpus:
    """Each order as a page: a heading set larger, a paragraph, a title with a unit, the items as a table with a line inside its box, and a last
    line. Open orders have a contents entry. A row's label holds a bar."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_name"), "o_orderkey", "o_custkey", "o_orderstatus")
    customer = F.col("o_custkey").cast("string")
    line = lambda block, text, y, size=10.0: F.struct(F.lit(block).alias("block"), text.alias("text"), F.lit(float(y)).alias("y0"), F.lit(size).alias("size"))
    page = F.array(
        line(0, F.concat(F.lit("Order of customer "), customer), 100, 14.0), line(1, F.concat(F.lit("This order was placed by customer "), customer, F.lit(" and holds the items below.")), 130),
        line(2, F.lit("Items of the order (in millions)"), 160), line(3, F.lit("a line inside the table"), 205), line(4, F.lit("All items were shipped."), 300),
    )
    spans = orders.select("doc_name", F.explode(page).alias("l")).select(
        "doc_name", F.lit(0).alias("page"), F.lit(800.0).alias("page_height"), "l.block", F.lit(0).alias("line"), F.lit(0).alias("span"), "l.text", "l.size", F.lit(False).alias("bold"),
        F.lit(50.0).alias("x0"), "l.y0", F.lit(500.0).alias("x1"), (F.col("l.y0") + 10).alias("y1"),
    )
    barred = F.transform("cells", lambda c: F.when(c.startswith("Part "), F.replace(c, F.lit(" "), F.lit("|"))).otherwise(c))
    box = [F.lit(v).alias(n) for n, v in (("x0", 40.0), ("y0", 190.0), ("x1", 510.0), ("y1", 260.0))]
    cells = order_tables(spark, sf_dir).select(F.col("order_key").cast("string").alias("doc_name"), "row_no", F.posexplode(barred).alias("col_no", "cell"))
    cells = cells.select("doc_name", F.lit(0).alias("page"), F.lit(0).alias("table_no"), "row_no", "col_no", "cell", *box)
    toc = orders.where("o_orderstatus = 'O'").select("doc_name", F.lit(1).alias("level"), F.lit("Part O").alias("title"), F.lit(1).alias("page"), F.lit(0).cast("long").alias("ord"))
    company = F.concat(F.lit("Customer "), customer).alias("company")
    catalog_ = orders.select("doc_name", F.lit("order").alias("doc_type"), company, F.lit("2018").alias("doc_period"))
    return jobs.build_corpus(spans, written(cells), toc, catalog_, replace(ExtractionConfig(), min_chunk_tokens=4))


_ORDERS = rf"""{RECORDS},
ct AS (SELECT l_orderkey AS order_key, count(*) AS m, count_if(l_linenumber % 3 < 2) AS f FROM lineitem GROUP BY l_orderkey),
dd AS (SELECT o_orderkey AS order_key, coalesce(1 + f >= 0.2 * (1 + m), false) AS ok, o_orderstatus = 'O' AS listed, 'Customer ' || o_custkey AS company, 'Order of customer ' || o_custkey AS head,
      'Order of customer ' || o_custkey || chr(10) || chr(10) || 'This order was placed by customer ' || o_custkey || ' and holds the items below.' || chr(10) || chr(10) || 'Items of the order (in millions)' AS told
      FROM orders LEFT JOIN ct ON ct.order_key = o_orderkey),
nr AS (SELECT order_key, group_no, count(*) AS n_rows FROM gt JOIN rec USING (order_key, row_label) GROUP BY ALL),
tg AS (SELECT order_key, group_no, min(label_no)::INT AS first_label, max(label_no)::INT AS last_label,
      'Items of the order (in millions) (' || any_value(company) || ', 2018, in millions)' || chr(10) || chr(10) || '| Line Item | ' || array_to_string(any_value(cols), ' | ') || ' |' || chr(10) || '| --- | '
      || array_to_string(list_transform(any_value(cols), lambda c: '---'), ' | ') || ' |' || chr(10) || string_agg('| ' || replace(row_label, ' ', '\|') || ' | ' || array_to_string(cells, ' | ') || ' |', chr(10) ORDER BY label_no) AS text
      FROM gt JOIN dd USING (order_key) WHERE ok GROUP BY order_key, group_no),
oc AS (SELECT order_key, 0 AS i, 'narrative' AS chunk_type, told || CASE WHEN ok THEN '' ELSE chr(10) || chr(10) || 'a line inside the table' || chr(10) || chr(10) || 'All items were shipped.' END AS text,
      NULL::INT AS first_label, NULL::INT AS last_label, NULL::BIGINT AS n_rows FROM dd
      UNION ALL SELECT order_key, 1 + group_no, 'table', text, first_label, last_label, n_rows FROM tg JOIN nr USING (order_key, group_no)
      UNION ALL SELECT order_key, 1 + coalesce(n, 0), 'narrative', 'All items were shipped.', NULL, NULL, NULL FROM dd LEFT JOIN (SELECT order_key, count(*) AS n FROM tg GROUP BY order_key) USING (order_key) WHERE ok)
"""


@query(rf"""
WITH {_ORDERS} SELECT order_key::VARCHAR AS doc_name, i::INT AS chunk_index, printf('%s__p0000__c%04d', order_key::VARCHAR, i::INT) AS chunk_id, chunk_type, CASE WHEN listed THEN 'Part O' ELSE head END AS section,
 CASE WHEN listed THEN 'part_o' ELSE replace(lower(head), ' ', '_') END AS section_id, len(string_split_regex(text, '\s+'))::INT AS n_tokens, text, CASE WHEN chunk_type = 'table' THEN order_key::VARCHAR || '__table001' END AS table_id,
 first_label, last_label, CASE WHEN chunk_type = 'table' THEN 'in millions' END AS unit_hint, n_rows, company FROM oc JOIN dd USING (order_key)
""")
def corpus_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build of documents with tables, contents, headings by size, a line that a table covers, and labels with bars."""
    s = F.col("structured")
    return _orders_corpus(spark, sf_dir).chunks.select(
        "doc_name", "chunk_index", "chunk_id", "chunk_type", "section", "section_id", "n_tokens", "text", s["table_id"].alias("table_id"), F.get(s["row_range"], F.lit(0)).alias("first_label"),
        F.get(s["row_range"], F.lit(1)).alias("last_label"), s["unit_hint"].alias("unit_hint"), F.when(s.isNotNull(), F.size(s["rows"])).cast("long").alias("n_rows"), "company",
    )


@query(f"WITH {_ORDERS} SELECT order_key::VARCHAR AS doc_name, 'ok' AS status, count_if(chunk_type = 'narrative')::BIGINT AS n_chunks_narrative, count_if(chunk_type = 'table')::BIGINT AS n_chunks_table FROM oc GROUP BY order_key")
def tables_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of that build, with chunks of both kinds."""
    return _orders_corpus(spark, sf_dir).report.select("doc_name", "status", "n_chunks_narrative", "n_chunks_table")


# stores


@query("""
WITH n AS (SELECT count(*) AS n FROM embeddings), l AS (SELECT count(*) AS n FROM embeddings WHERE label = 1)
SELECT 'added' AS step, n FROM n UNION ALL SELECT 'added twice', 2 * n FROM n UNION ALL SELECT 'upserted', n FROM n UNION ALL SELECT 'overwritten', n FROM n UNION ALL SELECT 'of label 1', n FROM l UNION ALL SELECT 'own row first', n FROM n
""")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store through its steps: appending repeats ids, an upsert does not, overwriting starts anew, both backends read it."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    rows = written(rows.withColumn("vector", F.transform("vector", lambda x: x / norm)))
    path = shared_folder(spark)
    store = vectors.VectorStore(spark, f"{path}/a")
    store.add(rows)
    counts = [("added", store.count())]
    store.add(rows)
    counts.append(("added twice", store.count()))
    store.add(rows, overwrite=True)
    store.upsert(rows.where("id % 2 = 0"))
    counts.append(("upserted", store.count()))
    store.add(rows, overwrite=True)
    counts.append(("overwritten", store.count()))
    asked = rows.withColumnRenamed("id", "query_id")
    told = spark.createDataFrame(counts, "step string, n long")
    label = store.query(asked.where("label = 1"), 1, where=F.col("label") == 1)
    own = vectors.VectorStore(spark, f"{path}/a", "ivf").query(asked, 1)
    count = lambda df, step: df.agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n"))
    return told.unionByName(count(label, "of label 1")).unionByName(count(own.where("query_id = id"), "own row first"))


@query(f"""
WITH RECURSIVE {PACKED} SELECT chunk_id AS id, doc_name, '' AS doc_type, coalesce(source, '') AS company, '' AS doc_period, 'narrative' AS chunk_type, 256 AS dimensions
FROM ch JOIN (SELECT doc_id::VARCHAR AS doc_name, source FROM documents) USING (doc_name)
""")
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table of all chunks; absent metadata read as empty."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_name"), F.col("source").alias("company"))
    none = F.lit(None).cast("string")
    chunks = chunk_texts(spark, sf_dir).join(docs, "doc_name").withColumns({"doc_type": none, "doc_period": none, "chunk_type": F.lit("narrative")})
    return jobs.build_index(chunks, vectors.EMBEDDERS["hashed-words-256"]()).select("id", "doc_name", "doc_type", "company", "doc_period", "chunk_type", F.size("vector").alias("dimensions"))


@query(r"""
WITH n AS (SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS n FROM documents) SELECT doc_id, round(n / sqrt(n * n + 1), 6) AS x, round(1 / sqrt(n * n + 1), 6) AS y FROM n
""")
def model_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a plugged-in model, made once a worker, brought to unit length."""
    model = vectors.ModelEmbedder("length", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], batch=64)
    coded = model.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return coded.select("doc_id", F.round(F.get("vector", F.lit(0)), 6).alias("x"), F.round(F.get("vector", F.lit(1)), 6).alias("y"))


@query("SELECT count(*) AS n_queries, true AS enough FROM embeddings")
def backend_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate backend finds nine in ten of the exact hits."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    q = v.withColumnRenamed("id", "query_id")
    found = ablation.recall_of(vectors.BACKENDS["ivf"](q, v, 5, scan=0.6), vectors.BACKENDS["exact"](q, v, 5))
    return found.agg(F.count(F.lit(1)).alias("n_queries"), (F.avg("recall") >= 0.9).alias("enough"))


@query()
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept index of all chunks, built by the index job, against exact search for every benchmark text: hits found, and the share of the rows whose
    codes were looked at and whose vectors were read."""
    none = F.lit(None).cast("string")
    chunks = written(chunk_texts(spark, sf_dir).withColumns({"doc_type": none, "company": none, "doc_period": none, "chunk_type": F.lit("narrative")}))
    path, model = shared_folder(spark), vectors.HashedWords()
    jobs.index_driver(spark, chunks, path, model, ("ivf",))
    store = vectors.VectorStore(spark, f"{path}/vectors", "ivf")
    asked = written(model.encode(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text").drop("text"))
    index = store.index()
    found = ablation.recall_of(store.query(asked, 5), vectors.exact_top_k(asked, store.table(), 5))
    looked = index.probes(asked).select("query_id", (F.col("scanned") / index.told["rows"]).alias("scanned_share"))
    read = F.lit(min(1.0, max(64, ivf.RERANK * 5) / max(1, index.told["rows"]))).alias("read_share")
    return found.join(looked, "query_id").select("*", read)


@query(f"""
WITH {QA}, {_N} SELECT 'given' AS config, count(*) AS n_samples, round(avg(exact_match), 4) AS exact_match, round(avg(round(token_f1, 4)), 4) AS token_f1 FROM m
UNION ALL SELECT 'gold', count(*), 1.0, round(avg(CASE WHEN ng > 0 THEN 1.0 ELSE 0.0 END), 4) FROM f
""")
def config_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of several configurations side by side; one that fails while it runs, and one that can't be planned, are left out."""
    pairs = qa_pairs(spark, sf_dir).select("qa_id", "question", "answer")

    def samples(pred: str) -> DataFrame:
        p, g = F.col(pred), F.col("answer")
        return pairs.select("qa_id", metrics.exact_match(p, g).alias("exact_match"), F.round(metrics.token_f1(p, g), 4).alias("token_f1"))

    def dies() -> DataFrame:
        """A model that answers some questions and fails on others, in the tasks."""
        model = answering.ModelGenerator("dies", lambda: lambda system, prompt: prompt if len(prompt) < 10 else str(1 // 0))
        made = model.generate(pairs.withColumn("prompt", F.col("question")))
        return made.select("qa_id", metrics.exact_match(F.col("generated_answer"), F.col("answer")).alias("exact_match"))

    reports, failed = ablation.compare({"given": samples("question"), "dies": dies, "gold": lambda: samples("answer"), "unplanned": lambda: samples("no such column")})
    assert sorted(failed) == ["dies", "unplanned"] and "ZeroDivisionError" in failed["dies"]
    return reports


# answers


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = F.array(F.struct(F.col("text").alias("evidence_text")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("-").alias("doc_name"), F.col("text").alias("question"), F.col("text").alias("answer"), evidence.alias("evidence"))


@query(f"""
WITH RECURSIVE {_ranked_sql(3)},
c AS (SELECT query_id, count(*) AS n, string_agg('[Passage ' || rank || '] (doc=' || doc_name || ', page=' || page_start || ')' || chr(10) || trim(replace(text, chr(10), ' ')), chr(10) || chr(10) ORDER BY rank) AS context,
      arg_min(substr(text, 1, 500), rank) AS best, arg_min(round(score, 4), rank) AS best_score FROM hits GROUP BY query_id)
SELECT query_id, 'answer to ' || (length(context) + length(text) + 70)::VARCHAR AS generated_answer, n AS n_passages, best, best_score, text AS ground_truth, text AS ground_truth_evidence FROM c JOIN benchmark ON item_id = query_id
""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer job with a plugged-in generator, over all chunks: records as they are appended to the file."""
    chunks = written(chunk_texts(spark, sf_dir))
    model = answering.ModelGenerator("counting", lambda: lambda system, prompt: f"answer to {len(prompt)}")
    index = vectors.HashedWords().encode(chunks.select(F.col("chunk_id").alias("id"), "doc_name", "text"), "text").drop("text")
    path = shared_folder(spark)
    done = jobs.answer_driver(_asked(spark, sf_dir), chunks, written(index), path, scoped=False, k=3, generator=model)
    return done.where("total_inference_time_s >= generation_time_s").select(
        "query_id", "generated_answer", F.size("retrieved_passages").cast("long").alias("n_passages"), F.get("retrieved_passages", F.lit(0))["text"].alias("best"),
        F.get("retrieved_passages", F.lit(0))["score"].alias("best_score"), "ground_truth", "ground_truth_evidence",
    )


_TERM = "list_filter(list_transform(string_split_regex(text, '\\s+'), lambda x: regexp_replace(x, '[^A-Za-z]', '', 'g')), lambda x: length(x) >= 5)[1]"


@query(f"""
WITH RECURSIVE {_ranked_sql(3)},
e AS (SELECT doc_id::VARCHAR AS doc_name, {_TERM} AS term FROM documents),
nb AS (SELECT h.query_id, h.rank, o.chunk_index - h.chunk_index AS off, o.chunk_id, o.text FROM hits h JOIN ch o ON o.doc_name = h.doc_name AND abs(o.chunk_index - h.chunk_index) = 1),
na AS (SELECT query_id, rank, string_agg(chunk_id, ',' ORDER BY off) AS neighbors, string_agg(text, chr(10) ORDER BY off) AS texts FROM nb GROUP BY ALL)
SELECT query_id, rank, chunk_id, coalesce(neighbors, '') AS neighbors, CASE WHEN regexp_matches(text || chr(10) || coalesce(texts, ''), '(^|[^\\p{{L}}\\p{{N}}_])' || term || '($|[^\\p{{L}}\\p{{N}}_])') THEN term ELSE '' END AS terms
FROM hits LEFT JOIN na USING (query_id, rank) LEFT JOIN e USING (doc_name)
""")
def full_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval with all of its parts: hits, their neighbours, and the terms of their document in both."""
    plain = F.filter(F.transform(F.split("text", r"\s+"), lambda x: F.regexp_replace(x, "[^A-Za-z]", "")), lambda x: F.length(x) >= 5)
    terms = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_name"), F.lit(1).alias("ord"), F.get(plain, F.lit(0)).alias("term"), F.lit("a word").alias("definition")).where("term is not null")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    hits = retrieval.search(asked, written(chunk_texts(spark, sf_dir)), 3, RetrievalConfig(neighbor_window=1), glossary=terms)
    listed = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), ","), F.lit(""))
    return hits.select("query_id", "rank", "chunk_id", listed("neighbors", "neighbor_id").alias("neighbors"), listed("glossary_matches", "term").alias("terms"))


_TIMES = "round((length(question) % 7) / 10.0, 3)::DOUBLE AS r, round((length(answer) % 5) / 10.0, 3)::DOUBLE AS g"
_FULL = rf"""{QA}, {_N}, {_ROUGE}, dg AS {_LCS.split('dg AS', 1)[1]},
ev AS (SELECT qa_id, {_TIMES}, list_filter(string_split_regex(translate(lower(coalesce(answer, '')), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\s+'), lambda x: x <> '') AS asked,
      list_filter(string_split_regex(translate(lower(coalesce(question, '')), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\s+'), lambda x: x <> '') AS one FROM qa),
cp AS (SELECT qa_id, r, g, CASE WHEN len(asked) > 0 THEN round((list_has_any(one, asked)::INT + 1) / 2.0, 4) ELSE 0.0 END AS context_precision FROM ev),
al AS (SELECT qa_id, exact_match, round(token_f1, 4) AS token_f1, context_precision, rouge1, rouge2, rougeL, r AS retrieval_time_s, g AS generation_time_s, round(r + g, 3) AS total_inference_time_s
      FROM m JOIN rg USING (qa_id) JOIN rl USING (qa_id) JOIN cp USING (qa_id))"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer records of conversations: the question as the answer given, both texts as passages."""
    passage = lambda c: F.struct(F.col(c).alias("text"))
    rows = qa_pairs(spark, sf_dir).select(
        "qa_id", F.col("answer").alias("ground_truth"), F.col("answer").alias("ground_truth_evidence"), F.col("question").alias("generated_answer"), F.array(passage("question"), passage("answer")).alias("retrieved_passages"),
        F.round((F.length("question") % 7) / 10.0, 3).alias("retrieval_time_s"), F.round((F.length("answer") % 5) / 10.0, 3).alias("generation_time_s"),
    )
    return metrics.per_sample(rows, stemmed=False).select("qa_id", *metrics.MEANS)


@query(f'WITH RECURSIVE {_FULL} SELECT qa_id, exact_match, token_f1, context_precision, rouge1, rouge2, rougeL AS "rougeL", retrieval_time_s, generation_time_s, total_inference_time_s FROM al')
def sample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of each answer, times included, written as JSON lines beside their means and read back."""
    samples, path = written(_samples(spark, sf_dir)), shared_folder(spark)
    files.write_eval_report(metrics.aggregate_report(samples), samples, path)
    return files.read_jsonl(spark, f"{path}/per_sample", samples.schema)


_MEANS = ", ".join(f'round(avg({m}), 4) AS "{m}"' for m in metrics.MEANS)


@query(f"WITH RECURSIVE {_FULL} SELECT count(*) AS n_samples, {_MEANS} FROM al")
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all metrics."""
    return metrics.aggregate_report(_samples(spark, sf_dir))


@query(f"WITH {QA} SELECT qa_id, substr(question, 1, 120) AS question, answer AS generated_answer, CASE WHEN length(question) > 150 THEN substr(question, 1, 150) || '...' ELSE question END AS passage FROM qa")
def shown_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut for reading."""
    rows = qa_pairs(spark, sf_dir).select("qa_id", "question", F.col("answer").alias("generated_answer"), F.array(F.struct(F.col("question").alias("text"))).alias("retrieved_passages"))
    return jobs.shown_answers(rows)


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, sum(len(string_split(text, ' ')))::BIGINT AS n_tokens, count_if(length(text) > 100)::BIGINT AS n_long FROM ln GROUP BY doc_id")
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by document."""
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(count_tokens(F.col("text"))).alias("n_tokens"), F.count_if(F.length("text") > 100).alias("n_long"))


@query(r"""
WITH s AS (SELECT c_custkey AS doc_name, c_nationkey AS n, unnest([0, 1]) AS ord, c_mktsegment AS t FROM customer)
SELECT DISTINCT doc_name, 'Net ' || t || ' Value' AS term, 'the worth of goods' AS definition, 'quoted_defines' AS pattern_type FROM s UNION ALL
SELECT DISTINCT doc_name, t[1:4], 'the worth of goods', 'quoted_defines' FROM s
""")
def glossary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's entries of all forms, of which the first of equal ones stays."""
    t = F.col("c_mktsegment")
    text = F.concat(F.lit('x. "Net '), t, F.lit(' Value" means the worth of goods. "'), F.substring(t, 1, 4), F.lit('" means the worth of goods.'))
    paragraphs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_name"), text.alias("text"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), F.lit("Results").alias("section"))
    found = glossary.glossary_entries(paragraphs, ["doc_name", "ord"])
    return glossary.dedupe_entries(found, "doc_name", ["ord", "pattern_ord", "match_ord"]).select("doc_name", "term", "definition", "pattern_type")
