"""WARC records and a Merkle fixity audit of replicas.

``warc_records`` serialises pages as WARC response records and places them in archive files: a file holds a
fixed range of page ids, records stand in the order of id and content, and offsets are running sums of their
lengths. A range that holds too many records (repeated or null ids) is cut into parts by content hash.

``merkle_levels`` hashes ranges of records into nodes, level by level, to one root of the archive: first ``FAN``
neighbouring slots of a file (a slot is the id's place in its range, or a hash in a range that is cut), then the parts
of a file, then ``FAN`` neighbouring files. A node carries two hashes: of its records' identities (id and content
hash), and of their places (offset and length as well). So a lost record changes the first hash of one path only,
though all places behind it in its file change.

``audit`` compares two replicas' trees from the root down: at each level only the children of nodes that
differ are compared, so the work follows the damage. In the ranges that differ the records of both replicas meet:

* ``changed``: the id is in both replicas, with other content; * ``missing``: only the left replica holds the record;
* ``surplus``: only the right one does; * ``moved``: the same record at another offset (beside the status ``intact``).

Defined results: a null url or html is an empty one; bodies are hashed whole, however long; an empty table has no records and equal (absent) roots.
Repeated rows are told apart by content, equal ones by their number. In a range cut into parts, a changed record of a
repeated id may read as a missing and a surplus one. Null ids are a range before all others. Only the named columns
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, read_table

FILE_PAGES = 1000
FAN = 16
#: Levels of slots in a file: FAN ** SLOT_LEVELS slots.
SLOT_LEVELS = 3
SLOTS = FAN**SLOT_LEVELS
#: The range of null ids.
NO_ID = -(1 << 60)
#: The damaged replica of the query: one page in so many has its body changed, is lost, or is there with a second one.
CHANGED_EVERY, LOST_EVERY, GAINED_EVERY = 97, 499, 503


def warc_record(url: Column, body: Column) -> Column:
    """One response record; ids come from the content, so that it can be made again."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def _hex(c: Column, start: int, n: int) -> Column:
    """Some hexadecimal digits of a hash as a number."""
    return F.conv(F.substring(c, start, n), 16, 10).cast("long")


def _file(page_id: Column, file_pages: int) -> Column:
    return F.coalesce(F.floor(page_id / file_pages).cast("long"), F.lit(NO_ID))


def file_parts(*replicas: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """``file, parts`` of the ranges with more than twice as many records as a file is to have, in any replica."""
    out = None
    for pages in replicas:
        n = pages.groupBy(_file(F.col("page_id").cast("long"), file_pages).alias("file")).agg(F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    most = out.groupBy("file").agg(F.max("n").alias("n")).where(F.col("n") > 2 * file_pages)
    return most.select("file", F.ceil(F.col("n") / file_pages).cast("long").alias("parts"))


def warc_records(pages: DataFrame, parts: DataFrame | None = None, file_pages: int = FILE_PAGES) -> DataFrame:
    """``page_id, file, part, slot, copy, position, offset, length, record_sha256``; replicas that are compared need the same ``parts``."""
    record = warc_record(F.col("url"), F.col("html"))
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), record.alias("record")).select(
        "page_id", _file(F.col("page_id"), file_pages).alias("file"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("record_sha256")
    )
    parts = file_parts(pages, file_pages=file_pages) if parts is None else parts
    made = made.join(parts, "file", "left") if parts.limit(1).count() else made.withColumn("parts", F.lit(None).cast("long"))
    whole = F.col("parts").isNull()
    made = made.select(
        "page_id", "file", F.when(whole, F.lit(0).cast("long")).otherwise(F.pmod(_hex(F.col("record_sha256"), 1, 8), F.col("parts"))).alias("part"),
        F.when(whole & F.col("page_id").isNotNull(), F.pmod(F.col("page_id"), F.lit(file_pages)) % SLOTS).otherwise(_hex(F.col("record_sha256"), 9, 8) % SLOTS).alias("slot"),
        "length", "record_sha256",
    )
    in_file = Window.partitionBy("file", "part")
    by = in_file.orderBy(F.col("page_id").asc_nulls_first(), "record_sha256")
    numbered = made.withColumn("position", (F.row_number().over(by) - 1).cast("long"))
    return numbered.select(
        "page_id", "file", "part", "slot",
        (F.col("position") - F.min("position").over(in_file.partitionBy("file", "part", "page_id", "record_sha256"))).alias("copy"),
        "position", F.coalesce(F.sum("length").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("offset"), "length", "record_sha256",
    )


NODE = ["file", "part", "slot"]


def _above(level: int) -> list[Column]:
    """The node above, by its columns: first slots are joined, then a file's parts, then files."""
    file, part, slot = (F.col(c) for c in NODE)
    if level < SLOT_LEVELS:
        return [file, part, F.floor(slot / FAN).cast("long").alias("slot")]
    zero = F.lit(0).cast("long")
    return [file, zero.alias("part"), slot] if level == SLOT_LEVELS else [F.floor(file / FAN).cast("long").alias("file"), part, slot]


def leaves(records: DataFrame) -> DataFrame:
    """Level 0: ``file, part, slot, content, place`` of the slots."""
    named = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "record_sha256", F.col("copy").cast("string"))
    put = F.concat_ws(":", named, F.col("offset").cast("string"), F.col("length").cast("string"))
    one = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ","), 256)
    return records.groupBy(*NODE).agg(one(named).alias("content"), one(put).alias("place"))


def merkle_levels(records: DataFrame, height: int) -> list[DataFrame]:
    """The levels of the tree, slots first, each ``file, part, slot, content, place``; the last is the root."""
    levels = [materialize(leaves(records), "merkle")]
    for level in range(height):
        below = F.array_sort(F.collect_list(F.struct(*NODE, "content", "place")))
        spell = lambda c: F.sha2(F.array_join(F.transform(F.col("_all"), lambda x: F.concat_ws(":", *[x[k].cast("string") for k in NODE], x[c])), ","), 256)
        above = [c.alias(f"_{n}") for c, n in zip(_above(level), NODE)]
        up = levels[-1].groupBy(*above).agg(below.alias("_all")).select(*[F.col(f"_{n}").alias(n) for n in NODE], spell("content").alias("content"), spell("place").alias("place"))
        levels.append(materialize(up, "merkle"))
    return levels


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def audit(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """The slots (``file, part, slot``) that differ between two trees of equal height."""
    differ = None
    for level in range(len(left) - 1, -1, -1):
        a, b = left[level], right[level]
        if differ is not None:
            up = differ.select(*[F.col(n).alias(f"_{n}") for n in NODE])
            a, b = (x.select(*x.columns, *[c.alias(f"_{n}") for c, n in zip(_above(level), NODE)]).join(up, [f"_{n}" for n in NODE], "left_semi") for x in (a, b))
        other = b.select(*NODE, F.col("content").alias("_content"), F.col("place").alias("_place"))
        met = a.select(*NODE, "content", "place").join(other, NODE, "full")
        differ = materialize(met.where(~F.col("content").eqNullSafe(F.col("_content")) | ~F.col("place").eqNullSafe(F.col("_place"))).select(*NODE), "differ")
    return differ


RECORD = ["page_id", "file", "part", "position", "offset", "length", "record_sha256"]


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """The left replica's records, then the right one's surplus records, with ``status`` (intact, changed, missing, surplus)
    and ``moved``. Both replicas are cut into the same parts."""
    left, right = materialize(left, "replica"), materialize(right, "replica")
    ends = left.select("file").union(right.select("file")).where(F.col("file") != NO_ID).agg(F.min("file"), F.max("file")).first()
    span = max(abs(ends[0] or 0), abs(ends[1] or 0)) + 1
    height = SLOT_LEVELS + 2
    while FAN ** (height - SLOT_LEVELS - 1) < span:
        height += 1
    differ = audit(merkle_levels(left, height), merkle_levels(right, height))
    a, b = (x.join(differ, NODE, "left_semi") for x in (left, right))
    key = ["file", "part", "slot", "page_id", "record_sha256", "copy"]
    other = b.select(*[F.col(c).alias(f"_{c}") for c in [*key, "position", "offset", "length"]])
    met = a.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "full")
    met = met.withColumn("side", F.when(F.col("_file").isNull(), "left").when(F.col("file").isNull(), "right").otherwise("both"))
    of = lambda c: F.coalesce(c, f"_{c}").alias(c)
    found = met.select(*[of(c) for c in [*key, "position", "offset", "length"]], "side", (F.col("offset") != F.col("_offset")).alias("moved"))
    # the kth of the left records that have no fellow, and the kth of the right ones, of an id are one changed record
    mine = Window.partitionBy("file", "part", "page_id", "side").orderBy("record_sha256", "copy")
    ids = Window.partitionBy("file", "part", "page_id")
    found = found.withColumn("k", F.row_number().over(mine))
    lost, gained = (F.count_if(F.col("side") == x).over(ids) for x in ("left", "right"))
    found = found.withColumn("lost", lost).withColumn("gained", gained).withColumn("paired", F.col("page_id").isNotNull() & (F.col("k") <= F.least("lost", "gained")))
    status = F.when(F.col("side") == "both", "intact").when(F.col("side") == "left", F.when(F.col("paired"), "changed").otherwise("missing")).when(~F.col("paired"), "surplus")
    found = materialize(found.withColumn("status", status).where(F.col("status").isNotNull() & ((F.col("status") != "intact") | F.col("moved"))), "found")
    marks = found.where("side <> 'right'").select(*[F.col(c).alias(f"_{c}") for c in key], "status", F.coalesce("moved", F.lit(False)).alias("moved"))
    own = left.join(marks.hint("merge"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left").select(*RECORD, F.coalesce("status", F.lit("intact")).alias("status"), F.coalesce("moved", F.lit(False)).alias("moved"))
    return own.unionByName(found.where("status = 'surplus'").select(*RECORD, "status", F.lit(False).alias("moved")))


def damaged_replica(pages: DataFrame) -> DataFrame:
    """The pages with some bodies changed, some pages lost and some doubled with other content."""
    hit = lambda every, at: F.coalesce(F.pmod(F.col("page_id"), F.lit(every)) == at, F.lit(False))
    kept = pages.where(~hit(LOST_EVERY, 3)).withColumn("html", F.when(hit(CHANGED_EVERY, 5), F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))
    return kept.unionByName(pages.where(hit(GAINED_EVERY, 7)).withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit("+"))))


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a replica with changed, lost and gained pages against the original."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    other = damaged_replica(pages)
    parts = materialize(file_parts(pages, other), "file-parts")
    return compare(warc_records(pages, parts), warc_records(other, parts))


def _record_sql(relation: str) -> str:
    return f"""SELECT page_id, file, length, sha, row_number() OVER w - 1 AS position,
      (coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM (
      SELECT page_id, floor(page_id / {FILE_PAGES}.0)::BIGINT AS file, strlen(record)::BIGINT AS length, sha256(record) AS sha FROM (SELECT page_id,
      'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'WARC-Block-Digest: sha256:' || sha256(coalesce(html, '')) || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10)
      || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM {relation}))
      WINDOW w AS (PARTITION BY file ORDER BY page_id, sha)"""


#: For tables of unique ids (no part is cut): both replicas' records in full, compared without trees.
ORACLE_SQL = f"""
WITH other AS (SELECT page_id, url, CASE WHEN page_id % {CHANGED_EVERY} = 5 THEN '#' || substr(html, 2) ELSE html END AS html FROM pages WHERE page_id % {LOST_EVERY} <> 3
      UNION ALL SELECT page_id, url, coalesce(html, '') || '+' FROM pages WHERE page_id % {GAINED_EVERY} = 7),
a AS ({_record_sql('pages')}),
b AS ({_record_sql('other')}),
f AS (SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.file, b.file) AS file, coalesce(a.position, b.position) AS position, coalesce(a."offset", b."offset") AS "offset",
      coalesce(a.length, b.length) AS length, coalesce(a.sha, b.sha) AS sha, CASE WHEN b.sha IS NULL THEN 'left' WHEN a.sha IS NULL THEN 'right' ELSE 'both' END AS side,
      coalesce(a."offset" <> b."offset", false) AS moved FROM a FULL JOIN b ON a.page_id = b.page_id AND a.sha = b.sha),
g AS (SELECT *, row_number() OVER (PARTITION BY page_id, side ORDER BY sha) AS k, count(*) FILTER (side = 'left') OVER (PARTITION BY page_id) AS lost,
      count(*) FILTER (side = 'right') OVER (PARTITION BY page_id) AS gained FROM f)
SELECT page_id, file, 0::BIGINT AS part, position, "offset", length, sha AS record_sha256,
      CASE WHEN side = 'both' THEN 'intact' WHEN side = 'right' THEN 'surplus' WHEN k <= least(lost, gained) THEN 'changed' ELSE 'missing' END AS status, moved
FROM g WHERE NOT (side = 'right' AND k <= least(lost, gained))
"""
