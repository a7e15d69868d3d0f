"""Catalogs, work lists and status reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.tables import written

DOWNLOAD_STATUS = ("downloaded", "skipped", "failed")
EXTRACTION_STATUS = ("ok", "skipped", "failed", "source_missing", "likely_scanned_or_image")


def download_list(catalog: DataFrame, order: str) -> DataFrame:
    """``doc_name, doc_link`` of records that have both, by name; of one name the last link wins."""
    named = catalog.where((F.coalesce("doc_name", F.lit("")) != "") & (F.coalesce("doc_link", F.lit("")) != ""))
    return named.groupBy("doc_name").agg(F.max_by("doc_link", order).alias("doc_link")).orderBy("doc_name")


def last_records(catalog: DataFrame, order: str) -> DataFrame:
    """The last whole record of each name; absent fields read as unknown."""
    rest = [c for c in catalog.columns if c not in ("doc_name", order)]
    last = catalog.where(F.coalesce("doc_name", F.lit("")) != "").groupBy("doc_name").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select("doc_name", *[F.coalesce(F.col(f"r.{c}"), F.lit("unknown")).alias(c) if c in ("doc_type", "company", "doc_period") else F.col(f"r.{c}") for c in rest])


def work_list(catalog: DataFrame, files: DataFrame, done: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Jobs (documents with a file that are not done yet, by name, then limited) and the report rows of the rest."""
    missing = catalog.join(files.select("doc_name"), "doc_name", "left_anti").select("doc_name", F.lit("source_missing").alias("status"))
    jobs = catalog.join(files.select("doc_name").distinct(), "doc_name", "left_semi")
    skipped = None
    if done is not None:
        skipped = jobs.join(done.select("doc_name"), "doc_name", "left_semi").select("doc_name", F.lit("skipped").alias("status"))
        jobs = jobs.join(done.select("doc_name"), "doc_name", "left_anti")
    if limit:  # None and 0: no limit
        jobs = jobs.orderBy("doc_name").limit(limit)
    return jobs, missing if skipped is None else missing.unionByName(skipped)


def retry_merge(report: DataFrame, again: DataFrame) -> DataFrame:
    """A report with its failed rows replaced by those of a new attempt; failed rows that were not tried again stay."""
    kept = report.where(~F.col("status").eqNullSafe("failed"))
    untried = report.where("status = 'failed'").join(again.select("doc_name"), "doc_name", "left_anti")
    return kept.unionByName(untried).unionByName(again)


def histogram(report: DataFrame, column: str = "status") -> DataFrame:
    return report.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def first_n(df: DataFrame, order: list[Column | str], n: int | None) -> DataFrame:
    """Filter first, then this: None and 0 mean no limit."""
    return df.orderBy(*order).limit(n) if n else df


def first_documents(chunks: DataFrame, n: int | None, doc: str = "doc_name") -> DataFrame:
    """Rows of the first n documents by name; the limit counts documents and not rows."""
    return chunks.join(chunks.select(doc).distinct().orderBy(doc).limit(n), doc, "left_semi") if n else chunks


def with_order(df: DataFrame, by: list[str], to: str = "ord") -> DataFrame:
    """An explicit ordinal (from 1) within the whole table, by unique columns: rows are sorted in ranges, and a row's place in
    its range is moved by the rows of the ranges before, one number each."""
    placed = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = placed.withColumn("_part", part).join(ranges.select("_part", "_before"), "_part")
    return joined.withColumn(to, (F.col("_before") + place).cast("int")).drop("_id", "_part", "_before")
