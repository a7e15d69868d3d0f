"""Embedding and vector search. A vector table is ``id, doc_name, vector array<double>`` and metadata columns."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import answer_words
from marlstone.operators import ivf, ranking
from marlstone.sources import versions
from marlstone.sources.tables import shared_folder, written

DIMENSIONS = 256
#: Bytes of queries up to which exact search broadcasts them; beyond it they are sent in rounds.
BROADCAST_BYTES = 8 << 20


class Embedder(ABC):
    """Turns a text column into unit vectors; ``name`` goes into manifests."""

    name: str

    @abstractmethod
    def encode(self, df: DataFrame, text: str, to: str = "vector") -> DataFrame: ...

    @abstractmethod
    def words_model(self) -> Callable[[], Callable[[list[str]], np.ndarray]]:
        """What a task calls, once, for a function from single words to their unit vectors."""


class HashedWords(Embedder):
    """Bag of words: each word counts in the dimension that its MD5 names; L2-normalised. In built-in functions only, on a text's own row."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.name = dimensions, f"hashed-words-{dimensions}"

    def bucket(self, word: Column) -> Column:
        return F.pmod(F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("long"), F.lit(self.dimensions)).cast("int")

    def weights(self, text: Column) -> Column:
        """The dimensions that a text fills, in order, as ``array<struct<bucket:int,weight:double>>``: runs of its sorted buckets are counted."""
        bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  a value used more than once
        none = F.array().cast("array<struct<bucket:int,n:double>>")

        def runs(b: Column) -> Column:
            last = F.size(b) - 1
            ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(b, i) != F.get(b, i + 1)))
            count = lambda e: F.transform(e, lambda i, j: F.struct(F.get(b, i).alias("bucket"), (i - F.coalesce(F.get(e, j - 1), F.lit(-1))).cast("double").alias("n")))
            return F.when(last >= 0, bound(ends, count)).otherwise(none)

        def scaled(r: Column) -> Column:
            norm = F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x["n"] * x["n"]))
            return bound(norm, lambda z: F.transform(r, lambda x: F.struct(x["bucket"].alias("bucket"), (x["n"] / z).alias("weight"))))

        return bound(bound(F.sort_array(F.transform(answer_words(text), self.bucket)), runs), scaled)

    def encode(self, df: DataFrame, text: str, to: str = "vector") -> DataFrame:
        of = F.map_from_entries(self.weights(F.col(text)))
        filled = lambda m: F.transform(F.sequence(F.lit(0), F.lit(self.dimensions - 1)), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0)))
        return df.withColumn(to, F.get(F.transform(F.array(of), filled), F.lit(0)))

    def words_model(self) -> Callable[[], Callable[[list[str]], np.ndarray]]:
        n = self.dimensions

        def model(words: list[str]) -> np.ndarray:
            import hashlib

            out = np.zeros((len(words), n))
            out[np.arange(len(words)), [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % n for w in words]] = 1.0
            return out

        return lambda: model


class ModelEmbedder(Embedder):
    """Any callable from a list of texts to vectors, made once per worker by ``load``."""

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64):
        self.name, self.load, self.batch = name, load, batch

    def encode(self, df: DataFrame, text: str, to: str = "vector") -> DataFrame:
        load, size = self.load, self.batch

        def run(series):
            import pandas as pd

            model = load()
            for s in series:
                out = []
                for i in range(0, len(s), size):
                    for v in model(s.iloc[i : i + size].fillna("").tolist()):
                        norm = float(np.linalg.norm(v)) or 1.0
                        out.append([float(x) / norm for x in v])
                yield pd.Series(out)

        from collections.abc import Iterator

        import pandas as pd

        run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return df.withColumn(to, F.pandas_udf(run, "array<double>")(F.col(text)))

    def words_model(self) -> Callable[[], Callable[[list[str]], np.ndarray]]:
        load, size = self.load, self.batch

        def make():
            model = load()
            return lambda words: ivf.unit(np.array([v for i in range(0, len(words), size) for v in model(words[i : i + size])], float).reshape(len(words), -1))

        return make


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashed-words-256": HashedWords}


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, scope: str | None = None, query_id: str = "query_id", key: str = "id") -> DataFrame:
    """``query_id, rank, id, score`` of each query's k best vectors, ties to the smaller id.

    ``scope`` names a column of both sides: only vectors of the query's own value are ranked (a filter before the
    ranking), in blocks of each value. Without it each task ranks all queries against its vectors by matrix products and
    emits k rows a query. Queries travel by broadcast: at once behind a check of their size, else in rounds, which run right away."""
    if scope:
        scored = _cells_top_k(queries.select(query_id, "vector", F.col(scope).alias("cell")), vectors.select(key, "vector", F.col(scope).alias("cell")), k, query_id, key)
    else:
        size = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        if size[0] * (16 + 8 * size[1]) <= BROADCAST_BYTES:
            scored = _matrix_top_k(queries, vectors, k, query_id, key)
        else:
            scored = _blocked_top_k(queries, vectors, k, query_id, key, max(1, ranking.ROUND_BYTES // (16 + 8 * size[1])))
    return ranking.top(scored, k, query_id, key)


def _taking(best: ranking.Best, _: tuple) -> Callable[[pa.RecordBatch], None]:
    return lambda b: best.take(ranking.matrix(b.column(1)), np.array(b.column(0).to_pylist()))


def _matrix_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, key: str) -> DataFrame:
    asked = queries.select(query_id, "vector").where("vector is not null").toArrow()
    shared = queries.sparkSession.sparkContext.broadcast((asked.column(0).to_pylist(), ranking.matrix(asked.column(1))))
    types, schema = ranking.kinds(queries, vectors, query_id, key)
    names = [query_id, key, "score"]

    def run(batches):
        q_ids, q = shared.value
        best = ranking.Best(q, k)
        feed = _taking(best, shared.value)
        for b in batches:
            feed(b)
        yield ranking.batch(best, q_ids, types, names)

    return vectors.select(key, "vector").where("vector is not null").mapInArrow(run, schema)


def _blocked_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, key: str, block: int) -> DataFrame:
    """In rounds of ``block`` queries over vectors that are written once, so that each round has all cores' tasks."""
    asked = queries.select(query_id, "vector").where("vector is not null")
    rows = vectors.select(key, "vector").where("vector is not null")
    rows = written(rows.repartition(ranking.TASKS * rows.sparkSession.sparkContext.defaultParallelism))
    return ranking.in_rounds(asked, rows, k, query_id, key, block, lambda told: (ranking.matrix(told.column("vector")),), _taking)


def _cells_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, key: str, block: int = 2048) -> DataFrame:
    """Queries and vectors of one ``cell`` meet, by a matrix product and with k rows a query. Each cell is cut
    into blocks, as many as its size needs, so that no task grows with the table."""

    def blocks(df: DataFrame) -> DataFrame:
        n = df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return n.select("cell", F.ceil(F.col("n") / block).cast("long").alias("n"))

    n_q, n_v = blocks(queries), blocks(vectors.where("vector is not null"))
    sizes = n_q.withColumnRenamed("n", "nq").join(n_v.withColumnRenamed("n", "nv"), "cell")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    q = queries.where("vector is not null").join(sizes, "cell").select(F.col(query_id).alias(query_id), F.col("vector").alias("_q"), "cell", mine(query_id, "nq").alias("qb"), every("nv").alias("vb"))
    v = vectors.where("vector is not null").join(sizes, "cell").select(key, "vector", "cell", every("nq").alias("qb"), mine(key, "nv").alias("vb"))
    types, schema = ranking.kinds(queries, vectors, query_id, key)
    names = [query_id, key, "score"]

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        best = ranking.Best(ranking.matrix(q.column("_q")), k)
        if q.num_rows and v.num_rows:
            best.take(ranking.matrix(v.column("vector")), np.array(v.column(key).to_pylist()))
        return pa.Table.from_batches([ranking.batch(best, q.column(query_id).to_pylist(), types, names)])

    return q.groupBy("cell", "qb", "vb").cogroup(v.groupBy("cell", "qb", "vb")).applyInArrow(run, schema)


def ivf_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", key: str = "id", scan: float = ivf.SCAN, **how) -> DataFrame:
    """Approximate: by an index that is made for this search only. A table that is asked more than once keeps its own (``VectorStore``)."""
    index = ivf.ListIndex.build(vectors.select(key, "vector"), shared_folder(vectors.sparkSession), key, **how)
    return index.search(queries, k, scan, query_id=query_id)


class VectorStore:
    """A versioned table of vectors with metadata: append (repeats ids) or upsert, query, count. The backend ``ivf`` keeps an index of the last
    version beside the table, and builds it when it is first asked after a change."""

    def __init__(self, spark: SparkSession, path: str, backend: str = "exact", key: str = "id", buckets: int = versions.BUCKETS):
        if backend not in BACKENDS:
            raise ValueError(f"backend is one of {sorted(BACKENDS)}")
        self.spark, self.path, self.backend, self.key = spark, path, backend, key
        self.rows = versions.VersionedTable(spark, path, key, buckets=buckets)

    def exists(self) -> bool:
        return bool(self.rows.versions())

    def table(self) -> DataFrame:
        return self.rows.read()

    def add(self, rows: DataFrame, overwrite: bool = False) -> None:
        self.rows.overwrite(rows) if overwrite else self.rows.append(rows)

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows; those of an id that is there already take its place. Only the buckets of these ids are written."""
        self.rows.upsert(rows)

    def count(self) -> int:
        return self.table().count()

    def index(self, **how) -> ivf.ListIndex:
        """The index of the present version, built if there is none."""
        version = self.rows.state()["version"]
        path = f"{self.path}/_index/v{version:08d}"
        try:
            return ivf.ListIndex(self.spark, path)
        except ValueError:
            return ivf.ListIndex.build(self.rows.read(version), path, self.key, version=version, **how)

    def query(self, queries: DataFrame, k: int, where: Column | None = None, scope: str | None = None) -> DataFrame:
        """``where`` filters on any metadata column before the ranking, which is exact then, as it is within a scope: lists near a query
        may hold no row that passes."""
        if self.backend == "ivf" and where is None and not scope:
            return self.index().search(queries, k)
        return exact_top_k(queries, self.table() if where is None else self.table().where(where), k, scope, key=self.key)


BACKENDS: dict[str, Callable[..., DataFrame]] = {"exact": exact_top_k, "ivf": ivf_top_k}
