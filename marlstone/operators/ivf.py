"""An approximate index of vectors that is built once: inverted lists with 8-bit codes.

Centroids come from a sample of bounded size; every row of the table is in the list of its nearest centroid. Lists near each other
are one *part*, a partition of the index table, and rows are sorted by list inside, so that a search opens the parts
of its lists only, and in them the row groups of these lists. A row has its vector as 8-bit integers with one scale
beside the vector itself. A search looks at the codes of the nearest lists, up to ``scan`` of all rows, and reads whole vectors only of the
``rerank`` best a query, which are ranked exactly. So it reads an eighth of a share of the table and a few vectors more. Queries that are
too many to send at once go in rounds; a round of many queries wants most vectors anyhow, so it reads these and ranks all rows of a query's lists exactly.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.operators import ranking
from marlstone.operators.ranking import matrix
from marlstone.sources.tables import written
from marlstone.sources.versions import Folder

LISTS, PARTS, SAMPLE, ROUNDS, SEED = 1024, 64, 16384, 8, 7
#: Share of the rows whose codes a search looks at, and vectors that it reads for each hit wanted.
SCAN, RERANK = 0.25, 16
#: Bytes of queries up to which they are sent to the lists' tasks at once; beyond it they go in rounds.
BROADCAST_BYTES = 8 << 20


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def spherical_centroids(v: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k unit centroids; of an empty list the centroid stays."""
    c = unit(v[np.random.default_rng(seed).choice(len(v), k, replace=False)])
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, v)
        c = np.where((np.bincount(near, minlength=k) > 0)[:, None], unit(sums), c)
    return c


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as 8-bit integers, and the scale of each."""
    scale = np.abs(v).max(axis=1, initial=0.0) / 127
    return np.rint(v / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8), scale.astype(np.float32)


class _Best:
    """The best rows of each query so far."""

    def __init__(self, queries: int, keep: int):
        self.keep, self.score = keep, np.full((queries, 0), -np.inf, np.float32)
        self.ids, self.part = np.zeros((queries, 0), object), np.zeros((queries, 0), np.int32)

    def take(self, score: np.ndarray, ids: np.ndarray, part: int) -> None:
        """(queries, rows) scores of rows; those of lists that a query doesn't look into are infinitely low."""
        if score.shape[1] > self.keep:
            top = np.argpartition(-score, self.keep - 1, axis=1)[:, : self.keep]
        else:
            top = np.broadcast_to(np.arange(score.shape[1]), score.shape)
        score = np.concatenate([self.score, np.take_along_axis(score, top, 1)], axis=1)
        ids = np.concatenate([self.ids, ids[top]], axis=1)
        parts = np.concatenate([self.part, np.full(top.shape, part, np.int32)], axis=1)
        best = np.argsort(-score, axis=1, kind="stable")[:, : self.keep]
        self.score, self.ids, self.part = (np.take_along_axis(x, best, 1) for x in (score, ids, parts))

    def batch(self, q_ids: list, kinds: list, names: list[str]) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.score))
        columns = [[q_ids[k] for k in i], self.ids[i, j].tolist(), self.part[i, j].tolist(), self.score[i, j].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _scan(best: _Best, q: np.ndarray, lists: np.ndarray, batch, key: str) -> None:
    """Scores a batch of ``part, list, key, code, scale`` against queries with their lists (queries, lists)."""
    part, at = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("part", "list"))
    ids = np.array(batch.column(key).to_pylist(), object)
    codes = batch.column("code")
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    code = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(ids), -1)
    scale = batch.column("scale").to_numpy(zero_copy_only=False)
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        asks = np.flatnonzero(lists[:, np.unique(at[rows])].any(axis=1))
        for i in range(0, len(rows), 4096):
            some = rows[i : i + 4096]
            score = np.full((len(q), len(some)), -np.inf, np.float32)
            near = q[asks] @ (code[some].astype(np.float32) * scale[some, None]).T
            score[asks] = np.where(lists[np.ix_(asks, at[some])], near, -np.inf)
            best.take(score, ids[some], int(p))


def nearest(q: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, most: int) -> tuple[list[np.ndarray], list[int]]:
    """The nearest lists of each query, as many as hold ``most`` rows together (one at least), and the rows in them."""
    if not len(q):
        return [], []
    order = np.argsort(-(q @ centroids.T), axis=1, kind="stable").astype(np.int32)
    full = np.cumsum(sizes[order], axis=1)
    n = np.maximum(1, (full <= most).sum(axis=1))
    return [o[:k] for o, k in zip(order, n)], [int(f[k - 1]) for f, k in zip(full, n)]


class ListIndex:
    """An index below a path. ``told`` has ``rows, lists, parts, key`` and what the builder adds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        if not self.folder.exists("index.json"):
            raise ValueError(f"no index at {path}")
        self.told = json.loads(self.folder.read("index.json"))
        self.key = self.told["key"]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "id", lists: int = LISTS, parts: int = PARTS, sample: int = SAMPLE, seed: int = SEED, **more) -> ListIndex:
        """Builds the index of a table with ``key`` and ``vector`` (and other columns, which are kept). Rows without a vector are left out.
        ``index.json`` is written last: without it there is no index."""
        spark = vectors.sparkSession
        folder = Folder(spark, path)
        rows = vectors.where("vector is not null").withColumn("vector", F.col("vector").cast("array<double>"))
        picked = rows.orderBy(F.xxhash64(key), key).limit(sample).select("vector").toArrow().column(0)  # a bounded sample
        v = matrix(picked).astype(np.float32)
        centroids = spherical_centroids(v, max(1, min(lists, len(v) // 4)), seed=seed) if len(v) else np.zeros((0, 0), np.float32)
        groups = spherical_centroids(centroids, max(1, min(parts, len(centroids) // 4)), seed=seed) if len(v) else centroids
        part_of = (centroids @ groups.T).argmax(axis=1) if len(v) else np.zeros(0, int)
        kept = [c for c in vectors.columns if c not in ("vector", "list", "part", "code", "scale")]

        def place(batches):
            for b in batches:
                x = matrix(b.column("vector"))
                near = (x.astype(np.float32) @ centroids.T).argmax(axis=1) if b.num_rows else np.zeros(0, int)
                code, scale = coded(x)
                made = [pa.array(near, pa.int32()), pa.array(part_of[near], pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale, pa.float32())]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "list", "part", "code", "scale"])

        given = rows.select(*kept, "vector")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
        placed = given.mapInArrow(place, f"{schema}, list int, part int, code binary, scale float") if len(v) else given.selectExpr("*", "0 list", "0 part", "binary('') code", "float(0) scale")
        placed.hint("rebalance", "part").sortWithinPartitions("part", "list").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
        sizes = {r.list: r.n for r in spark.read.parquet(f"{path}/rows").groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()} if len(v) else {}
        table = pa.table({"list": pa.array(range(len(centroids)), pa.int32()), "part": pa.array(part_of, pa.int32()), "size": [sizes.get(i, 0) for i in range(len(centroids))], "centroid": pa.array(centroids.tolist(), pa.list_(pa.float32()))})
        spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")  # one row a list
        told = {"rows": sum(sizes.values()), "lists": len(centroids), "parts": len(groups), "key": key, "schema": json.loads(placed.schema.json()), **more}
        folder.delete("index.json")
        folder.create("index.json", json.dumps(told))
        return cls(spark, path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(self.told["schema"])).parquet(f"{self.folder.path}/rows")

    def _lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroids, parts and sizes of the lists, which are as many as the builder was told."""
        t = self.spark.read.parquet(f"{self.folder.path}/centroids").orderBy("list").toArrow()
        return matrix(t.column("centroid")), t.column("part").to_numpy(), t.column("size").to_numpy()

    def probes(self, queries: DataFrame, scan: float = SCAN, query_id: str = "query_id") -> DataFrame:
        """``query_id, vector, lists, scanned`` of every query: its nearest lists, as many as hold ``scan`` of the rows together (the nearest at
        least), and the rows in them."""
        centroids, _, sizes = self._lists()
        most = max(1, int(scan * self.told["rows"]))

        def run(batches):
            for b in batches:
                lists, seen = nearest(matrix(b.column(1)).astype(np.float32), centroids, sizes, most)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(seen, pa.int64())], names=[query_id, "vector", "lists", "scanned"])

        kind = queries.schema[query_id].dataType.simpleString()
        asked = queries.where("vector is not null").select(query_id, F.col("vector").cast("array<double>").alias("vector"))
        return asked.mapInArrow(run, f"`{query_id}` {kind}, vector array<double>, lists array<int>, scanned long")

    def candidates(self, probed: DataFrame, keep: int, query_id: str = "query_id") -> DataFrame:
        """``query_id, key, part, near``: the rows with the best codes in each query's lists, ``keep`` a query. The queries are sent at once."""
        _, part_of, sizes = self._lists()
        wanted = [r.l for r in probed.select(F.explode("lists").alias("l")).distinct().collect()]  # as many as there are lists
        parts = sorted({int(part_of[i]) for i in wanted})
        rows = self.table().where(F.col("part").isin(parts) & F.col("list").isin(wanted) if len(wanted) < len(sizes) else F.col("part").isin(parts))
        rows = rows.select("part", "list", self.key, "code", "scale")
        to = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        q_kind, kind = probed.schema[query_id].dataType.simpleString(), rows.schema[self.key].dataType.simpleString()
        kinds, names, key, n_lists = [to[q_kind], to[kind], pa.int32(), pa.float32()], [query_id, self.key, "part", "near"], self.key, len(sizes)
        schema = f"`{query_id}` {q_kind}, `{self.key}` {kind}, part int, near float"

        def looked_into(lists) -> np.ndarray:
            out = np.zeros((len(lists), n_lists), bool)
            for i, some in enumerate(lists):
                out[i, some] = True
            return out

        asked = probed.toArrow()
        shared = self.spark.sparkContext.broadcast((asked.column(0).to_pylist(), matrix(asked.column(1)).astype(np.float32), looked_into(asked.column(2).to_pylist())))

        def scan_rows(batches):
            q_ids, q, lists = shared.value
            best = _Best(len(q_ids), keep)
            for b in batches:
                if b.num_rows and len(q_ids):
                    _scan(best, q, lists, b, key)
            yield best.batch(q_ids, kinds, names)

        found = rows.mapInArrow(scan_rows, schema)
        place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("near").desc(), self.key))
        return found.withColumn("_p", place).where(F.col("_p") <= keep).drop("_p")

    def in_rounds(self, queries: DataFrame, k: int, scan: float, query_id: str, a_round: int) -> DataFrame:
        """``query_id, key, score``: the k best rows of each query's lists by exact scores, ``a_round`` queries at a time. The lists of a query travel as bits."""
        centroids, _, sizes = self._lists()
        most, n_lists = max(1, int(scan * self.told["rows"])), len(sizes)

        def mark(batches):
            for b in batches:
                bits = np.zeros((b.num_rows, n_lists), bool)
                for row, lists in zip(bits, nearest(matrix(b.column(1)).astype(np.float32), centroids, sizes, most)[0]):
                    row[lists] = True
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=[query_id, "vector", "bits"])

        def share(told: pa.Table) -> tuple:
            return matrix(told.column("vector")), told.column("bits").to_pylist()

        def start(best: ranking.Best, shared: tuple):
            packed = np.frombuffer(b"".join(shared[1]), np.uint8).reshape(len(shared[1]), -1)
            of = np.ascontiguousarray(np.unpackbits(packed, axis=1, count=n_lists).T.astype(bool)) if len(packed) else np.zeros((n_lists, 0), bool)  # (lists, queries)

            def feed(b: pa.RecordBatch) -> None:
                v, ids, at = matrix(b.column("vector")), np.array(b.column(key).to_pylist()), b.column("list").to_numpy(zero_copy_only=False)
                for i in np.unique(at):
                    rows = np.flatnonzero(at == i)
                    best.take(v[rows], ids[rows], np.flatnonzero(of[i]))

            return feed

        kind, key = queries.schema[query_id].dataType.simpleString(), self.key
        asked = queries.where("vector is not null").select(query_id, F.col("vector").cast("array<double>").alias("vector"))
        marked = asked.mapInArrow(mark, f"`{query_id}` {kind}, vector array<double>, bits binary")
        return ranking.in_rounds(written(marked), self.table().select(key, "list", "vector"), k, query_id, key, a_round, share, start)

    def search(self, queries: DataFrame, k: int, scan: float = SCAN, rerank: int = RERANK, query_id: str = "query_id") -> DataFrame:
        """``query_id, rank, key, score`` of the k best rows found, by exact scores, ties to the smaller key."""
        if not self.told["lists"]:
            kind = self.table().schema[self.key].dataType.simpleString()
            return queries.limit(0).select(query_id, F.lit(0).alias("rank"), F.lit(None).cast(kind).alias(self.key), F.lit(0.0).alias("score"))
        size = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        if size[0] * (16 + 8 * size[1] + self.told["lists"]) > BROADCAST_BYTES:
            return ranking.top(self.in_rounds(queries, k, scan, query_id, max(1, ranking.ROUND_BYTES // (16 + 8 * size[1] + self.told["lists"] // 8))), k, query_id, self.key)
        probed = written(self.probes(queries, scan, query_id))
        found = written(self.candidates(probed, max(64, rerank * k), query_id))
        near = found.select(query_id, F.col(self.key).alias("_key"), F.col("part").alias("_part")).distinct()
        on = (F.col("part") == F.col("_part")) & (F.col(self.key) == F.col("_key"))
        met = self.table().select("part", self.key, F.col("vector").alias("_v")).join(near, on).join(probed.select(query_id, "vector"), query_id)
        dot = F.aggregate(F.zip_with("vector", "_v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        scored = met.select(query_id, self.key, F.round(dot, 6).alias("score"))
        w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), self.key)
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, "rank", self.key, "score")
