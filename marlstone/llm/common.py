"""Shared helpers: reading tables, written intermediate tables, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java/RE2/Python character class.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local session that sets none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-marlstone-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows, written, as ``row, value`` (their number and all their columns)."""
    value = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), value.alias("value")), "rows")


#: Rows up to which a table of keys is broadcast; beyond it the join is left to Spark.
BROADCAST_ROWS = 20_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast when it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def finite(vector: Column) -> Column:
    """Whether a vector (array<double>) is there and all of its components are, and are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def words(text: Column | str) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; null and blank texts give an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_CLASS + "+"))


def lower_ascii(text: Column | str) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


LONG_MAX = (1 << 63) - 1
LIMB = 32


def limb_rows(sums: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """``item, place, limb, value`` of integers of any size: their 32-bit limbs, the sign in the last one; no rows for zeros."""
    item, place, limb, value = [], [], [], []
    for i, row in enumerate(sums):
        for p, x in enumerate(row):
            k = 0
            while x:
                last = -(1 << LIMB) <= x < 1 << LIMB
                item.append(i), place.append(p), limb.append(k), value.append(x if last else x & ((1 << LIMB) - 1))
                x, k = 0 if last else x >> LIMB, k + 1
    small_ = [pa.array(c, pa.int32()) for c in (item, place, limb)]
    yield pa.RecordBatch.from_arrays([*small_, pa.array(value, pa.int64())], names=["item", "place", "limb", "value"])


def summed_limbs(rows: DataFrame) -> dict[int, dict[int, int]]:
    """The sums of such rows by item and place: as many as a task has, whatever the number of tasks."""
    out: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("item", "place", "limb").agg(F.sum("value").alias("value")).collect():
        row = out.setdefault(r.item, {})
        row[r.place] = row.get(r.place, 0) + (r.value << (LIMB * r.limb))
    return out
