"""The best vectors of many queries by exact scores, in memory that neither side's length decides.

A task holds k rows a query. Scores of a block are first taken in single precision; only pairs that may reach the query's kth best score,
by the bound of the rounding error, are scored in double precision. Queries that are too many to send at once go in rounds:
each is sent to all tasks, and its best rows are written before the next. So nothing is copied for each pair of blocks; what is shuffled is
k rows a query and task, and there are at most ``TASKS`` tasks a core, whatever the length of the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.tables import shared_folder

#: Bytes of queries in one round, and tasks a core in it.
ROUND_BYTES, TASKS = 16 << 20, 2
#: Scores of a block, and numbers multiplied at once where pairs are scored exactly.
CELLS, PRODUCTS = 4 << 20, 4 << 20
#: Components up to which single precision has room for all products.
LARGEST = 1e15


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Halves go away from zero, as SQL rounds."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    return (whole + np.sign(y) * (np.abs(y - whole) >= 0.5)) / 10.0**digits


class Best:
    """The k best rows so far of each query (rows of ``q``), ties to the smaller id."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = np.asarray(q, float), k
        with np.errstate(all="ignore"):
            self.small, self.norm = self.q.astype(np.float32), np.linalg.norm(self.q, axis=1)
        self.fits = bool((np.abs(self.q) < LARGEST).all())
        self.least = np.full(len(q), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.fresh = 0

    def take(self, v: np.ndarray, ids: np.ndarray, asks: np.ndarray | None = None) -> None:
        """Rows ``v`` with their ids, for all queries or those numbered ``asks``."""
        if not len(v) or not (n := len(self.q) if asks is None else len(asks)):
            return
        of = slice(None) if asks is None else asks
        fits = self.fits and bool((np.abs(v) < LARGEST).all())
        q, b, unit = (self.small[of], v.astype(np.float32), 2.0**-24) if fits else (self.q[of], v, 2.0**-53)
        norm, rows = self.norm[of], max(1, CELLS // n)
        for i in range(0, len(v), rows):
            near = q @ b[i : i + rows].T
            with np.errstate(all="ignore"):
                off = 1.01 * (v.shape[1] + 8) * unit * norm * np.linalg.norm(v[i : i + rows], axis=1).max()
                least = self.least[of]
                low = least - off - 1.1e-6
                if near.shape[1] > self.k and len(none := np.flatnonzero(np.isneginf(least))):  # only a block's own k best can count
                    kth = np.partition(near[none], near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k]
                    low[none] = kth - 2 * off[none] - 1.1e-6
            under = near < np.nextafter(low.astype(near.dtype), near.dtype.type(-np.inf))[:, None]
            at, row = np.nonzero(~under)
            if len(at):
                self._score(at if asks is None else asks[at], row + i, v, ids)

    def _score(self, at: np.ndarray, row: np.ndarray, v: np.ndarray, ids: np.ndarray) -> None:
        step = max(1, PRODUCTS // v.shape[1])
        for i in range(0, len(at), step):
            a, r = at[i : i + step], row[i : i + step]
            score = rounded(np.cumsum(self.q[a] * v[r], axis=1)[:, -1])  # added one by one, as SQL does
            good = ~(score < self.least[a])
            self.held.append((a[good], score[good], ids[r[good]]))
            self.fresh += int(good.sum())
            if self.fresh > max(1 << 16, self.k * len(self.q)):
                self._settle()

    def _settle(self) -> None:
        if not self.held:
            return
        at, score, ids = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, np.where(np.isnan(score), -np.inf, -score), at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        last = place == self.k - 1
        self.least[at[last]] = score[last]
        kept = place < self.k
        self.held, self.fresh = [(at[kept], score[kept], ids[kept])], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, scores and ids."""
        self._settle()
        return self.held[0] if self.held else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))


def kinds(queries: DataFrame, rows: DataFrame, query_id: str, key: str) -> tuple[list[pa.DataType], str]:
    """Arrow types and schema of ``query_id, key, score``."""
    to = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    q, i = queries.schema[query_id].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    return [to[q], to[i], pa.float64()], f"`{query_id}` {q}, `{key}` {i}, score double"


def batch(best: Best, q_ids: list, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    at, score, ids = best.rows()
    columns = [[q_ids[i] for i in at.tolist()], ids.tolist(), score]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def top(scored: DataFrame, k: int, query_id: str, key: str) -> DataFrame:
    """``query_id, rank, key, score`` of each query's k best rows."""
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, "rank", key, "score")


def in_rounds(asked: DataFrame, rows: DataFrame, k: int, query_id: str, key: str, a_round: int, share: Callable[[pa.Table], tuple], start: Callable) -> DataFrame:
    """``query_id, key, score`` of each query's k best rows. ``asked`` has ``query_id, vector`` and what ``share`` wants of it: that makes of the
    queries of a round (``a_round``, about) what each task gets, first their matrix. ``start(best, shared)`` gives a task what it calls with each batch of ``rows``."""
    spark = asked.sparkSession
    n, path, out = max(1, -(-asked.count() // a_round)), shared_folder(spark), shared_folder(spark)
    dealt = asked.withColumn("_round", F.pmod(F.xxhash64(query_id, "vector"), F.lit(n)).cast("int")).repartition("_round")
    dealt.write.partitionBy("_round").parquet(path)
    parts, (types, schema) = spark.read.schema(dealt.schema).parquet(path), kinds(asked, rows, query_id, key)
    names, rows = [query_id, key, "score"], rows.coalesce(TASKS * spark.sparkContext.defaultParallelism)
    for i in range(n):
        told = parts.where(F.col("_round") == i).toArrow()
        shared = spark.sparkContext.broadcast((told.column(query_id).to_pylist(), share(told)))

        def run(batches, shared=shared):
            q_ids, given = shared.value
            best = Best(given[0], k)
            feed = start(best, given)
            for b in batches:
                feed(b)
            yield batch(best, q_ids, types, names)

        top(rows.mapInArrow(run, schema), k, query_id, key).drop("rank").write.parquet(f"{out}/{i}")
        shared.destroy()
    return spark.read.schema(schema).parquet(*[f"{out}/{i}" for i in range(n)])
