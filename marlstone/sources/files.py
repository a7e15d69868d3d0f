"""JSON lines, CSV reports and small JSON files."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone import schema
from marlstone.sources.versions import BUCKETS, VersionedTable


def read_jsonl(spark: SparkSession, path: str | list[str], record: T.StructType) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the read; absent keys and nulls are null."""
    return spark.read.schema(record).option("mode", "FAILFAST").json(path)


def read_chunks(spark: SparkSession, path: str, doc_name: str | None = None) -> DataFrame:
    df = read_jsonl(spark, path, schema.CHUNK)
    return df.where(F.col("doc_name") == doc_name) if doc_name else df


class ChunkStore(VersionedTable):
    """Chunks in buckets of documents, sorted by document and chunk: of rows of one chunk_id the last put stays, and the chunks of some
    documents are read from the files of their buckets only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        super().__init__(spark, path, "chunk_id", "doc_name", buckets)

    def put(self, chunks: DataFrame, order: str | None = None) -> int:
        return self.upsert(chunks, order)

    def of(self, documents: DataFrame) -> DataFrame:
        """All chunks of the documents named in ``doc_name``."""
        return self.lookup(documents)

    def resolve(self, hits: DataFrame) -> DataFrame:
        """hits (``doc_name, chunk_id`` and more) with their chunks' columns; hits without a chunk go."""
        found = self.lookup(hits).drop(*[c for c in hits.columns if c not in ("chunk_id", "doc_name")])
        return hits.join(found, ["doc_name", "chunk_id"])


def read_glossary(spark: SparkSession, path: str, doc_name: str | None = None) -> DataFrame:
    """Longest terms first; equally long ones by document, page and term."""
    df = read_jsonl(spark, path, schema.GLOSSARY_ENTRY)
    return (df.where(F.col("doc_name") == doc_name) if doc_name else df).orderBy(F.length("term").desc(), "doc_name", "page_num", "term")


def read_questions(spark: SparkSession, path: str, doc_name: str | None = None, limit: int | None = None) -> DataFrame:
    """Filtered by document first, then limited (None and 0: not), in the order of ``qa_id``."""
    df = read_jsonl(spark, path, schema.QA)
    df = df.where(F.col("doc_name") == doc_name) if doc_name else df
    return df.orderBy("qa_id").limit(limit) if limit else df


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schema.ANSWER)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """``n_lines`` of all files, blank ones too."""
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line. Appending never truncates: a second run repeats rows, unless they carry a run id."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_report(df: DataFrame, path: str, fields: T.StructType, order: str = "doc_name") -> None:
    """A CSV with fixed columns by document: sorted ranges, one file each, in the order of their names (a small report is one file)."""
    have = set(df.columns)
    row = df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    row.orderBy(order).write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small JSON file through Spark's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False).encode()))
    out.close()


def write_eval_report(aggregate: DataFrame, samples: DataFrame, path: str) -> None:
    """The report of one evaluation: the row of means as a small JSON file, the samples as JSON lines beside it, which Spark writes."""
    write_jsonl(samples, f"{path}/per_sample")
    write_json(aggregate.sparkSession, {"aggregate": aggregate.first().asDict(recursive=True)}, f"{path}/report.json")


def manifest(model: str, backend: str, n_chunks: int, batch_size: int) -> dict:
    return {"embedding_model": model, "backend": backend, "n_chunks": n_chunks, "batch_size": batch_size, "timestamp": time.strftime("%Y-%m-%dT%H:%M:%S")}
