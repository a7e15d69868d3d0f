"""Retrieval: rank, resolve, neighbours, glossary. One plan over a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.config import RetrievalConfig
from marlstone.operators.glossary import match_terms
from marlstone.operators.vectors import Embedder, HashedWords, exact_top_k
from marlstone.sources.tables import written


def resolve_hits(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits with their chunks' columns; hits without a chunk go, after the ranking, so fewer than k can stay."""
    return hits.join(chunks, key)


def neighbours(hits: DataFrame, chunks: DataFrame, window: int, doc: str = "doc_name", index: str = "chunk_index", key: str = "chunk_id") -> DataFrame:
    """Chunks up to ``window`` places from each hit in its document, without the hit: ``query_id, rank, offset, neighbor_id``.

    Each hit lists the places it wants, so the join is on (document, place) and not on a range."""
    around = F.explode(F.array(*[F.lit(i) for i in range(-window, window + 1) if i])) if window else F.explode(F.array().cast("array<int>"))
    wanted = hits.select("query_id", "rank", F.col(doc).alias("_doc"), F.col(index).alias("_at"), around.alias("offset"))
    wanted = wanted.withColumn("_want", F.col("_at") + F.col("offset"))
    other = chunks.select(F.col(doc).alias("_d"), F.col(index).alias("_i"), F.col(key).alias("neighbor_id"), F.col("text").alias("neighbor_text"))
    return wanted.join(other, (F.col("_doc") == F.col("_d")) & (F.col("_want") == F.col("_i"))).select("query_id", "rank", "offset", "neighbor_id", "neighbor_text")


def search(
    queries: DataFrame, chunks: DataFrame, k: int | None = None, config: RetrievalConfig = RetrievalConfig(), embedder: Embedder | None = None,
    vectors: DataFrame | None = None, glossary: DataFrame | None = None, scope: str | None = None, text: str = "question", doc: str = "doc_name",
) -> DataFrame:
    """``query_id, rank, score``, the chunk's columns, ``neighbors`` and ``glossary_matches`` (arrays, for display: neither goes
    into a prompt). Vectors are ranked on ids alone; texts are joined to the few hits."""
    embedder = embedder or HashedWords()
    if vectors is None:
        vectors = embedder.encode(chunks.select("chunk_id", *([scope] if scope else []), "text"), "text").drop("text")
    asked = embedder.encode(queries, text)
    hits = exact_top_k(asked, vectors.withColumnRenamed("chunk_id", "id"), config.k(k), scope).withColumnRenamed("id", "chunk_id")
    found = written(resolve_hits(hits, chunks))  # read three times below
    near = neighbours(found, chunks, config.neighbor_window)
    listed = F.array_sort(F.collect_list(F.struct("offset", "neighbor_id", "neighbor_text")))
    out = found.join(near.groupBy("query_id", "rank").agg(listed.alias("neighbors")), ["query_id", "rank"], "left")
    if glossary is not None:
        texts = out.withColumn("text", F.concat_ws("\n", "text", F.array_join(F.transform("neighbors", lambda x: x["neighbor_text"]), "\n"))).select("query_id", "rank", doc, "text")
        terms = match_terms(texts, glossary, ["query_id", "rank"], doc).groupBy("query_id", "rank").agg(F.array_sort(F.collect_list(F.struct("place", "term", "definition"))).alias("glossary_matches"))
        out = out.join(terms, ["query_id", "rank"], "left")
    if "structured" in out.columns:  # an image of the table goes with a table's hit
        out = out.withColumn("table_image", F.when(F.col("chunk_type") == "table", F.col("structured.table_image")))
    return out
