"""Continuous ingestion (an extension): documents that arrive are chunked and appended once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marlstone.config import ExtractionConfig
from marlstone.functions.text import clean_line
from marlstone.operators.chunking import packed_texts


def chunk_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", config: ExtractionConfig = ExtractionConfig()) -> DataFrame:
    """``doc, group_no, first, last, text, n_tokens`` of lines packed into chunks; works on batches and streams."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), clean_line), lambda x: x != "")
    made = packed_texts(docs.select(doc, lines.alias("lines")), doc, "lines", config.chunk_size, config.chunk_overlap)
    return made.withColumnRenamed("id", doc)


def ingest(spark: SparkSession, arrivals: str, record: T.StructType, out: str, checkpoint: str, config: ExtractionConfig = ExtractionConfig(), doc: str = "doc_id") -> StreamingQuery:
    """Follows a folder of Parquet arrivals; the checkpoint remembers files, so each is appended once. Within a day
    a document that arrives again (same id) is dropped."""
    stream = spark.readStream.schema(record).parquet(arrivals).withColumn("_at", F.current_timestamp())
    once = stream.withWatermark("_at", "1 day").dropDuplicatesWithinWatermark([doc]).drop("_at")
    chunks = chunk_documents(once, doc, config=config)
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
