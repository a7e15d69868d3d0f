"""Queries over documents: catalog, layout, chunks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.config import ExtractionConfig
from marlstone.functions.text import count_tokens, dehyphenate, unwrap_url
from marlstone.operators import chunking, layout
from marlstone.plans.inputs import LIMIT, LINES, OVERLAP, PACKED, chunk_texts, lines, table
from marlstone.plans.query import query
from marlstone.sources import catalog


@query("""
SELECT doc_name, doc_link, doc_type, doc_period FROM
 (SELECT source AS doc_name, arg_max(lang, doc_id) AS doc_type, arg_max((2000 + doc_id % 20)::VARCHAR, doc_id) AS doc_period FROM documents GROUP BY 1)
 JOIN (SELECT source AS doc_name, arg_max('https://files.example/' || doc_id, doc_id) AS doc_link FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1) USING (doc_name)
""")
def catalog_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    link = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://files.example/"), F.col("doc_id").cast("string")))
    records = docs.select(F.col("source").alias("doc_name"), link.alias("doc_link"), F.col("lang").alias("doc_type"), (2000 + F.col("doc_id") % 20).cast("string").alias("doc_period"), "doc_id")
    return catalog.last_records(records.drop("doc_link"), "doc_id").join(catalog.download_list(records, "doc_id"), "doc_name").select("doc_name", "doc_link", "doc_type", "doc_period")


@query("SELECT page_id, url AS link FROM pages")
def url_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    wrapped = F.concat(F.lit("https://viewer.example/view.html?target="), F.rtrim(F.base64(F.col("url").cast("binary")), F.lit("=")))
    link = F.when(F.col("page_id") % 2 == 0, wrapped).otherwise(F.col("url"))
    return pages.select("page_id", unwrap_url(link, "viewer.example", "/view.html", "target").alias("link"))


@query("""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'source_missing' WHEN length(trim(text)) < 100 THEN 'likely_scanned_or_image' ELSE 'ok' END AS status
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY status
""")
def work_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_name"), "text")
    files = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc_name"))
    jobs, missing = catalog.work_list(docs, files)
    gate = replace(ExtractionConfig(), min_chars_per_page=100)
    judged = layout.scanned(jobs.withColumn("page", F.lit(0)), jobs.select("doc_name"), gate)
    done = judged.select("doc_name", F.when(F.col("is_scanned"), "likely_scanned_or_image").otherwise("ok").alias("status"))
    return catalog.histogram(done.unionByName(missing))


@query("""
SELECT o_orderkey AS doc_name, CASE WHEN o_orderstatus <> 'P' THEN 'downloaded' WHEN o_orderkey % 2 = 0 THEN 'skipped' ELSE 'failed' END AS status FROM orders
""")
def report_retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_name"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("downloaded").alias("status"))
    again = report.where("status = 'failed' and doc_name % 2 = 0").select("doc_name", F.lit("skipped").alias("status"))
    return catalog.retry_merge(report, again)


@query(f"WITH {LINES} SELECT doc_id, ord, text, len(string_split(text, ' '))::INT AS n_tokens FROM ln")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "ord", "text", count_tokens(F.col("text")).alias("n_tokens"))


@query(r"""
SELECT doc_id, trim(regexp_replace(replace(regexp_replace(replace(text, 'tion', 'ti-' || chr(10) || 'on'), '([\p{L}\p{N}_])- ?\n ?([\p{L}\p{N}_])', '\1\2', 'g'), chr(10), ' '), '[ \t]+', ' ', 'g')) AS text FROM documents
""", "dehyphenate")  # fmt: skip
def dehyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.replace(F.col("text"), F.lit("tion"), F.lit("ti-\non"))
    return table(spark, sf_dir, "documents").select("doc_id", dehyphenate(broken).alias("text"))


@query(rf"""
WITH {LINES},
k AS (SELECT source, lower(trim(regexp_replace(regexp_replace(trim(text), '\s*\d+\s*$', ''), '\s+', ' ', 'g'))) AS key FROM ln),
n AS (SELECT source, key, count(*) AS n FROM k WHERE key <> '' GROUP BY ALL),
d AS (SELECT source, count(*) AS docs FROM documents GROUP BY source)
SELECT source, key, n FROM n JOIN d USING (source) WHERE n >= greatest(2, floor(docs * 0.05 + 1e-9))
""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"))
    return layout.boilerplate_keys(lines(spark, sf_dir), pages, replace(ExtractionConfig(), boilerplate_recurrence_ratio=0.05), "source")


@query(f"WITH {LINES} SELECT source, coalesce(median(length(text)::DOUBLE), 10.0) AS body_size FROM ln WHERE ord < 20 GROUP BY source")
def median_line_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = lines(spark, sf_dir).select("source", F.col("ord").alias("page"), F.length("text").cast("double").alias("size"))
    return layout.body_size(sized, sized, "source")


@query(f"""
WITH {LINES},
y AS (SELECT *, sum(12 + CASE WHEN length(text) % 5 = 0 THEN 20 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS y0 FROM ln),
s AS (SELECT *, CASE WHEN y0 - lag(y0 + 10) OVER (PARTITION BY doc_id ORDER BY ord) > 15 THEN 1 ELSE 0 END AS fresh FROM y)
SELECT doc_id, ord, (sum(fresh) OVER (PARTITION BY doc_id ORDER BY ord))::INT AS paragraph FROM s
""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    step = 12.0 + F.when(F.length("text") % 5 == 0, 20.0).otherwise(0.0)
    placed = lines(spark, sf_dir).withColumn("y0", F.sum(step).over(w)).withColumn("y1", F.col("y0") + 10)
    return layout.paragraphs(placed, ["doc_id"], ["ord"]).select("doc_id", "ord", "paragraph")


_SECTION_ID = r"""CASE WHEN regexp_extract(lower(trim(section)), '^item\s+(\d+[a-z]?)', 1) <> '' THEN 'item_' || regexp_extract(lower(trim(section)), '^item\s+(\d+[a-z]?)', 1)
 ELSE coalesce(nullif(substr(regexp_replace(regexp_replace(lower(section), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), ''), 'section') END"""


@query(rf"""
WITH {LINES},
h AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)^item\s+\d+[a-z]?') OR (length(text) BETWEEN 3 AND 90 AND NOT regexp_matches(text, '[.,;]$')) THEN text END AS heading FROM ln),
s AS (SELECT doc_id, ord, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM h)
SELECT doc_id, ord, section, CASE WHEN section IS NOT NULL THEN {_SECTION_ID} END AS section_id FROM s
""")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    heading = layout.is_heading(F.col("text"), F.lit(10.0), F.lit(True), F.lit(10.0))
    return layout.carry_sections(rows, heading, ["doc_id"], ["ord"]).select("doc_id", "ord", "section", "section_id")


@query(rf"""
WITH pg AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS page FROM documents),
t AS (SELECT source, page, CASE WHEN quality = 1 THEN 'Item ' || page || 'A. Good' ELSE 'Poor & rest ' || page END AS title FROM pg JOIN labels USING (doc_id)),
f AS (SELECT pg.source, pg.page, last_value(title IGNORE NULLS) OVER (PARTITION BY pg.source ORDER BY pg.page ROWS UNBOUNDED PRECEDING) AS section FROM pg LEFT JOIN t ON t.source = pg.source AND t.page = pg.page)
SELECT source, page, section, {_SECTION_ID} AS section_id FROM f WHERE section IS NOT NULL
""")
def toc_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("int")
    pages = table(spark, sf_dir, "documents").select("source", "doc_id", page.alias("page"))
    number = F.col("page").cast("string")
    title = F.when(F.col("quality") == 1, F.concat(F.lit("Item "), number, F.lit("A. Good"))).otherwise(F.concat(F.lit("Poor & rest "), number))
    toc = pages.join(table(spark, sf_dir, "labels"), "doc_id").select("source", F.lit(1).alias("level"), title.alias("title"), (F.col("page") + 1).alias("page"), F.col("doc_id").alias("ord"))
    return layout.toc_sections(toc, pages, "source")


#: Tokens below which a group is joined to another.
LEAST = 15

_BOX = "({k} * 7) % 90 AS x0, ({k} * 11) % 90 AS y0, ({k} * 7) % 90 + 5 + {k} % 13 AS x1, ({k} * 11) % 90 + 5 + {k} % 17 AS y1"


@query(f"""
WITH b AS (SELECT p_partkey AS block, p_size AS page, {_BOX.format(k="p_partkey")} FROM part),
t AS (SELECT s_nationkey AS page, {_BOX.format(k="s_suppkey")} FROM supplier)
SELECT block, page FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page
 AND greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) > 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0))
""")
def bbox_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    def boxes(name: str, key: str, page: str) -> DataFrame:
        k = F.col(key)
        box = [(k * 7) % 90, (k * 11) % 90, (k * 7) % 90 + 5 + k % 13, (k * 11) % 90 + 5 + k % 17]
        return table(spark, sf_dir, name).select(k.alias("block"), F.col(page).alias("page"), *[c.cast("double").alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))])

    return layout.blocks_outside_tables(boxes("part", "p_partkey", "p_size"), boxes("supplier", "s_suppkey", "s_nationkey"), on=("page",)).select("block", "page")


@query(f'WITH RECURSIVE {PACKED} SELECT doc_id, no AS group_no, s AS start, e AS "end" FROM gn')
def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: count_tokens(x)), lambda n: n > 0)
    return chunking.packed_ranges(docs.select("doc_id", kept.alias("sizes")), "doc_id", "sizes", LIMIT, OVERLAP).withColumnRenamed("id", "doc_id")


def _flushed(spark: SparkSession, sf_dir: str, chunk_size: int) -> DataFrame:
    """Lines as paragraphs; short lines without end mark change the section, lines of 7n characters stand for a table."""
    text = F.col("text")
    short = F.length(text).between(3, 90) & ~F.rlike(text, F.lit(r"[.,;]$"))
    kind = F.when(short, "flush").when(F.length(text) % 7 == 0, "table").otherwise("para")
    rows = layout.carry_sections(lines(spark, sf_dir), short, ["doc_id"], ["ord"])
    event = F.struct("ord", kind.alias("kind"), F.col("ord").alias("page"), "section", "section_id", "text", F.lit(1).alias("n"))
    events = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    config = replace(ExtractionConfig(), chunk_size=chunk_size, chunk_overlap=OVERLAP, min_chunk_tokens=LEAST)
    return chunking.flush_chunks(events.withColumn("events", F.transform("events", lambda x: x.dropFields("ord"))), "doc_id", "events", config)


@query()
def flush_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flushed(spark, sf_dir, LIMIT)


@query(rf"""
WITH RECURSIVE {LINES},
ev AS (SELECT *, CASE WHEN length(text) BETWEEN 3 AND 90 AND NOT regexp_matches(text, '[.,;]$') THEN 'flush' WHEN length(text) % 7 = 0 THEN 'table' ELSE 'para' END AS kind, len(string_split(text, ' ')) AS t FROM ln),
se AS (SELECT *, last_value(CASE WHEN kind = 'flush' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section,
      coalesce(sum((kind <> 'para')::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS k FROM ev),
ps AS (SELECT doc_id, k, sum(t)::BIGINT AS t, count(*) AS n FROM se WHERE kind = 'para' GROUP BY ALL),
st AS (SELECT doc_id, k, kind AS e, ord FROM se WHERE kind <> 'para'),
ks AS (SELECT doc_id, k FROM st UNION SELECT doc_id, coalesce(max(k) FILTER (kind <> 'para') + 1, 0)::INT FROM se GROUP BY doc_id),
rn AS (SELECT ks.doc_id, ks.k, coalesce(ps.t, 0) AS t, coalesce(ps.n, 0) AS n, st.e FROM ks LEFT JOIN ps USING (doc_id, k) LEFT JOIN st USING (doc_id, k)),
fold AS (SELECT DISTINCT doc_id, -1 AS k, 0 AS chunks, 'none' AS last, NULL::INT AS hf, 0::BIGINT AS ht, 0::BIGINT AS hn, NULL::INT AS emit, NULL::INT AS efrom, NULL::INT AS tab FROM se
      UNION ALL
      SELECT doc_id, rk, chunks + (act = 'new')::INT + coalesce(e = 'table', false)::INT, CASE WHEN e = 'table' THEN 'table' WHEN act IN ('new', 'join') THEN 'narrative' ELSE last END,
        CASE WHEN act = 'hold' THEN coalesce(hf, rk) END, CASE WHEN act = 'hold' THEN ht + t ELSE 0 END, CASE WHEN act = 'hold' THEN hn + n ELSE 0 END,
        CASE act WHEN 'new' THEN chunks WHEN 'join' THEN chunks - 1 END, CASE WHEN act IN ('new', 'join') THEN coalesce(hf, rk) END, CASE WHEN e = 'table' THEN chunks + (act = 'new')::INT END
      FROM (SELECT f.*, r.k AS rk, r.t, r.n, r.e, CASE WHEN f.hn + r.n = 0 THEN 'none' WHEN f.last = 'narrative' THEN CASE WHEN f.ht + r.t >= {LEAST} THEN 'new' ELSE 'join' END
        WHEN f.ht + r.t >= {LEAST} OR r.e IS NULL THEN 'new' ELSE 'hold' END AS act FROM fold f JOIN rn r ON r.doc_id = f.doc_id AND r.k = f.k + 1)),
nc AS (SELECT f.doc_id, f.emit AS chunk_index, 'narrative' AS chunk_type, min(p.ord)::INT AS page_start, max(p.ord)::INT AS page_end, arg_min(struct_pack(s := p.section), p.ord).s AS section,
      string_agg(p.text, chr(10) || chr(10) ORDER BY p.ord) AS text, sum(p.t)::INT AS n_tokens FROM fold f JOIN se p ON p.doc_id = f.doc_id AND p.kind = 'para' AND p.k BETWEEN f.efrom AND f.k GROUP BY f.doc_id, f.emit),
tc AS (SELECT f.doc_id, f.tab, 'table', p.ord::INT, p.ord::INT, p.section, p.text, p.t::INT FROM fold f JOIN se p ON p.doc_id = f.doc_id AND p.kind = 'table' AND p.k = f.k WHERE f.tab IS NOT NULL),
al AS (SELECT * FROM nc UNION ALL SELECT * FROM tc)
SELECT doc_id, chunk_index, chunk_type, page_start, page_end, section, CASE WHEN section IS NOT NULL THEN {_SECTION_ID} END AS section_id, text, n_tokens, printf('%s__p%04d__c%04d', doc_id::VARCHAR, page_start, chunk_index) AS chunk_id FROM al
""")
def flush_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with runs of any size as one group each, so that SQL can follow what joins, waits and is forced."""
    return _flushed(spark, sf_dir, 1 << 30)


@query(f"""
WITH RECURSIVE {PACKED} SELECT chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM ch WINDOW w AS (PARTITION BY doc_name ORDER BY chunk_index)
""")
def link_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.link_neighbors(chunk_texts(spark, sf_dir).drop("text")).select("chunk_id", "prev_chunk_id", "next_chunk_id")
