"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt to blocks. In a block every dimension has its list of vectors in the order of their
values. A query reads its lists from the end that its sign favours, all to the same depth; vectors seen for
the first time are scored in full (random access). The sum over dimensions of query value times the value
at the present depth bounds every vector not yet seen; when it is below the kth score so far, the block is
done. A tie with the kth score can still win by its smaller id, so the bound must be strictly below.
Depths double, so that the reads beyond the stopping point stay within a factor of two.

The longest vectors are a block of their own, which all queries search first: the kth score there is where they start in
every other block, and a block whose bound at the top of its lists is below that is left at once.

Queries and candidates meet in cells (query block, candidate block), each a task-sized piece of the work;
a query's best of all cells are ranked at the end, k rows from each cell.

Defined results: rows with a null id, and vectors that are null, or hold null, NaN or infinite components, take no part, neither as
queries nor as candidates. Vectors of different lengths are compared as if the shorter ended in zeros; an
empty vector is a zero vector. A query's own row is no candidate of it; other rows with its id are, and are ranked as the
rows they are; queries of one id are ranked each by itself. A score beyond the range of long reads as its end. Columns beyond the two
named are not read. No queries, or no candidates, give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import finite, materialize, read_table

K = 5
QUERY_EVERY = 50
CANDIDATE_BLOCK, QUERY_BLOCK = 2048, 512
FIRST_DEPTH, DEEPER = 8, 2
LONG = (-(1 << 63), (1 << 63) - 1)


def whole_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: float = 256.0) -> DataFrame:
    """``row, key, v``, written: vectors of finite components as floor(scale * x), each with a number of its own."""
    kept = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("key").isNotNull() & finite(F.col("v")))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    return materialize(kept.select(F.monotonically_increasing_id().alias("row"), "key", whole.alias("v")), "vectors")


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


class SortedLists:
    """A block of vectors with one sorted list per dimension."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        self.keys, self.vectors, self.rows = keys, vectors, keys if rows is None else rows
        self.order = np.argsort(vectors, axis=0, kind="stable")  # ascending
        self.values = np.take_along_axis(vectors, self.order, axis=0)
        # floats hold every partial sum exactly when this is small; BLAS is then exact
        self.top = max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))
        self.fast = vectors.astype(np.float64) if self.top**2 * vectors.shape[1] < 2**52 else None
        self.scored = 0  # rows scored in full, over all queries

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        most = max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0))))
        self.scored += len(rows)
        if self.fast is not None and most < 2**20:
            return (self.fast[rows] @ q.astype(np.float64)).astype(np.int64)
        if most * self.top * len(q) < 2**63:
            return self.vectors[rows] @ q
        exact = [sum(int(a) * int(b) for a, b in zip(v, q)) for v in self.vectors[rows]]
        return np.array([min(max(x, LONG[0]), LONG[1]) for x in exact], np.int64)

    def bound(self, q: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int) -> int:
        """Of any vector that no list shows above this depth (the first is 0)."""
        high, low = self.values[len(self.keys) - 1 - depth, up], self.values[depth, down]
        return sum(int(a) * int(b) for a, b in zip(q[up], high)) + sum(int(a) * int(b) for a, b in zip(q[down], low))

    def best(self, row: int, q: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """Up to k (score, key) of other rows by score, then smaller key; scores below ``least`` are of no interest."""
        n = len(self.keys)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        if least is not None and self.bound(q, up, down, 0) < least:
            return []
        unseen = self.rows != row
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, done = min(FIRST_DEPTH, n), 0
        while True:
            if depth == n:
                new = np.flatnonzero(unseen)
            else:
                met = np.zeros(n, bool)
                met[self.order[n - depth : n - done][:, up]] = True
                met[self.order[done:depth][:, down]] = True
                met &= unseen
                unseen &= ~met
                new = np.flatnonzero(met)
            found = self.scores(new, q)
            floor = scores[-1] if len(rows) == k else least
            if floor is not None:  # only these can enter
                new, found = new[found >= floor], found[found >= floor]
            if len(found) > k:
                good = found >= np.partition(found, -k)[-k]
                new, found = new[good], found[good]
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, found])
            top = np.lexsort((self.keys[rows], -scores))[:k]
            rows, scores = rows[top], scores[top]
            floor = int(scores[-1]) if len(rows) == k else least
            if depth == n or not unseen.any() or (floor is not None and self.bound(q, up, down, depth - 1) < floor):
                break
            done, depth = depth, min(n, depth * DEEPER)
        return [(int(s), int(self.keys[r])) for r, s in zip(rows, scores)]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` from two tables of ``row, key, v array<long>``; the score is the inner product. A row of both tables
    is no candidate of itself."""
    n_c, n_q = candidates.count(), queries.count()
    c_blocks, q_blocks = -(-n_c // candidate_block) or 1, -(-n_q // query_block) or 1
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    heads = candidates.select(length.alias("length")).orderBy(F.desc("length")).limit(candidate_block)  # one block
    least = heads.agg(F.min("length")).first()[0]
    hashed = lambda n: F.pmod(F.xxhash64("key", "v"), F.lit(n)).cast("long")
    c_of = F.when(length > F.lit(least), F.lit(0).cast("long")).otherwise(1 + hashed(c_blocks))

    def cells(candidates: DataFrame, queries: DataFrame, first: int, last: int) -> DataFrame:
        every = lambda a, b: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long")))
        left = candidates.select(F.col("cb"), every(0, q_blocks - 1).alias("qb"), F.lit(False).alias("query"), F.lit(None).cast("long").alias("least"), "row", "key", "v")
        right = queries.select(every(first, last).alias("cb"), hashed(q_blocks).alias("qb"), F.lit(True).alias("query"), "least", "row", "key", "v")
        return left.union(right)

    def run(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("query").to_pylist(), bool)
        lists, least = table.column("v").to_pylist(), table.column("least").to_pylist()
        rows, keys = (np.array(table.column(c).to_pylist(), np.int64) for c in ("row", "key"))
        data = _matrix(lists, max(map(len, lists), default=0))
        out: dict[str, list[int]] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if (~asks).any() and data.shape[1]:
            block = SortedLists(keys[~asks], data[~asks], rows[~asks])
            for i in np.flatnonzero(asks):
                for score, key in block.best(int(rows[i]), data[i], k, least[i]):
                    out["query_row"].append(int(rows[i]))
                    out["query_id"].append(int(keys[i]))
                    out["vec_id"].append(key)
                    out["score"].append(score)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})

    def search(cells: DataFrame) -> DataFrame:
        return cells.groupBy("cb", "qb").applyInArrow(run, "query_row long, query_id long, vec_id long, score long")

    placed = candidates.select(c_of.alias("cb"), "row", "key", "v")
    first = materialize(search(cells(placed.where("cb = 0"), queries.withColumn("least", F.lit(None).cast("long")), 0, 0)), "first-block")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc()))
    kth = first.withColumn("_p", place).where(F.col("_p") == k).select(F.col("query_row").alias("row"), F.col("score").alias("least"))
    rest = search(cells(placed.where("cb > 0"), queries.join(kth, "row", "left").select("row", "key", "v", "least"), 1, c_blocks))
    found = first.union(rest)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("key") % QUERY_EVERY == 0), vectors)


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) <= {K}
"""
