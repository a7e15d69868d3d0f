"""Centroid clustering with bit planes: dot products by AND and popcount.

A vector of 64 integers is kept as its bit planes in two's complement: plane i is one 64-bit word holding bit i of every component. The dot
product of two vectors is then the sum over pairs of planes of ``2^(i + j) * popcount(a_i & b_j)``, the topmost plane of each
counting negative; squared distances are ``a.a - 2 a.c + c.c``, exact integers. Vectors are packed once (eight planes
for unit vectors, 64 bytes) and written; every round reads planes only, in the tasks where they lie. A task adds up its own
counts and sums a cluster (also from planes: how often each bit is set), and these few rows are added in Spark as
32-bit limbs, so that sums are exact at any size and no cluster, however large, meets in one task. Centroids, k times 64
integers, are all that the driver sees.

Defined results: vectors that are null, don't have 64 components, or hold null, NaN or infinite ones take no part. A null id stands
in the hash as the empty text, and is kept. Repeated rows are vectors of their own; of equal hashes the smaller vector (component by
component) is the earlier start. With fewer vectors than centroids there are as many centroids as vectors. Equal
distances go to the smaller number. Components that need more than 27 bits take Python's integers in place of 64-bit
ones; a distance or sum beyond the range of long reads as its end. Columns beyond the two named are not read. Empty tables
give no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import LONG_MAX, finite, limb_rows, materialize, read_table, summed_limbs

DIMENSIONS, SCALE = 64, 64
CLUSTERS, ROUNDS, SEED = 16, 3, 1
#: Bits of a component up to which 64-bit arithmetic is exact: 64 * (2 * 2^27)^2 is below 2^63.
NARROW_BITS = 28


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where it is small, else Python integers (dtype object)."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.abs(y).max(initial=0.0) < 1 << (NARROW_BITS - 1):
        return y.astype(np.int64)
    exact = [math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def bits_of(v: np.ndarray) -> int:
    """Planes that all these integers need in two's complement."""
    return 1 + max((int(v.max(initial=0))).bit_length(), (~int(v.min(initial=0))).bit_length())


def pack(v: np.ndarray) -> np.ndarray:
    """(n, planes) words of (n, 64) integers."""
    planes = bits_of(v)
    bits = np.stack([((v >> i) & 1).astype(np.uint8) for i in range(planes)], axis=1)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(planes: int, kind) -> np.ndarray:
    return np.array([1 << i for i in range(planes - 1)] + [-(1 << (planes - 1))], kind)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, m) dot products of vectors given as planes."""
    kind = np.int64 if max(a.shape[1], b.shape[1]) <= NARROW_BITS else object
    wa, wb = weights(a.shape[1], kind), weights(b.shape[1], kind)
    out = np.zeros((len(a), len(b)), kind)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            out += np.bitwise_count(a[:, i, None] & b[None, :, j]).astype(kind) * (wa[i] * wb[j])
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """(n,) dot products of vectors with themselves."""
    kind = np.int64 if a.shape[1] <= NARROW_BITS else object
    w = weights(a.shape[1], kind)
    out = np.zeros(len(a), kind)
    for i in range(a.shape[1]):
        for j in range(i + 1):
            out += np.bitwise_count(a[:, i] & a[:, j]).astype(kind) * (w[i] * w[j] * (1 if i == j else 2))
    return out


def nearest(a: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, both given as planes."""
    rest = squares(centroids)[None, :] - 2 * dots(a, centroids)
    best = rest.argmin(axis=1)
    return best, squares(a) + rest[np.arange(len(a)), best]


def plane_sums(a: np.ndarray) -> list[int]:
    """Componentwise sums of vectors given as planes."""
    set_ = np.unpackbits(np.ascontiguousarray(a).view(np.uint8).reshape(*a.shape, 8), axis=2, bitorder="little").sum(axis=0, dtype=np.int64)
    return (set_.astype(object) * weights(a.shape[1], object)[:, None]).sum(axis=0).tolist()


def packed(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, planes`` of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    kept = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(finite(F.col("v")) & (F.size("v") == DIMENSIONS))

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
            large = (np.abs(x) * SCALE).max(axis=1, initial=0.0) >= (1 << (NARROW_BITS - 1)) - 1
            for of in (~large, large):  # a few large vectors don't slow the others
                if of.any():
                    words = pack(floors(x[of], SCALE))
                    offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1])
                    planes = pa.ListArray.from_arrays(offsets, pa.array(words.ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(of)), planes], names=["vec_id", "planes"])

    return kept.mapInArrow(run, "vec_id long, planes array<long>")


def _planes(batch: pa.RecordBatch):
    """(rows, planes) of a batch's vectors, those of one number of planes together."""
    column = batch.column(1)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, n)


def cluster_sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Of each non-empty cluster its count and componentwise sums."""
    planes, k = pack(np.array(centroids, object)), len(centroids)

    def run(batches):
        sums = [[0] * (DIMENSIONS + 1) for _ in range(k)]
        for b in batches:
            for _, a in _planes(b):
                best, _ = nearest(a, planes)
                for c in np.unique(best):
                    mine = a[best == c]
                    sums[c] = [x + y for x, y in zip(sums[c], [*plane_sums(mine), len(mine)])]
        yield from limb_rows(sums)

    found = summed_limbs(vectors.mapInArrow(run, "item int, place int, limb int, value long"))
    return {c: (row[DIMENSIONS], [row.get(d, 0) for d in range(DIMENSIONS)]) for c, row in found.items()}


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    planes = pack(np.array(centroids, object))

    def run(batches):
        for b in batches:
            for rows, a in _planes(b):
                best, far = nearest(a, planes)
                far = [min(int(x), LONG_MAX) for x in far] if far.dtype == object else far
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(best, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"]
                )

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(df: DataFrame, k: int = CLUSTERS, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> list[list[int]]:
    """The k vectors that come first by the hash of seed and id."""
    v = F.col(vector).cast("array<double>")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("long").cast("string"), F.lit(""))), 256)
    kept = df.select(mark.alias("mark"), v.alias("v")).where(finite(F.col("v")) & (F.size("v") == DIMENSIONS))
    return [floors(np.array(r.v), SCALE).tolist() for r in kept.orderBy("mark", "v").limit(k).collect()]


def centroid_clusters(vectors: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` (written) and the final centroids, from packed vectors and the first centroids."""
    for _ in range(rounds):
        centroids = list(centroids)
        for c, (n, sums) in cluster_sums(vectors, centroids).items():
            centroids[c] = [s // n for s in sums]
    return materialize(assigned(vectors, centroids), "clusters"), centroids


def _total(c: str) -> Column:
    return F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def op12_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    first = first_centroids(table)
    if not first:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    found, centroids = centroid_clusters(materialize(packed(table), "planes"), first)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("far")).collect()  # one row a centroid
    far = {r.cluster: int(r.far) for r in sums}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    said = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    long_ = lambda x: F.lit(min(x, LONG_MAX)).cast("long")
    return found.select(
        "vec_id", "cluster", "distance",
        said([long_(far.get(c, 0)) for c in range(len(centroids))]).alias("cluster_inertia"), long_(sum(far.values())).alias("inertia"),
        said(digests).alias("centroid_sha256"),
    )


def _sql() -> str:
    """Rounds written one after the other, over rows of one component."""
    assign = """
a{n} AS MATERIALIZED (SELECT vec_id, c AS cluster, d FROM (SELECT vec_id, c, sum((x - y) * (x - y))::BIGINT AS d FROM v JOIN c{n} USING (i) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1),"""
    update = """
c{m} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{n} LEFT JOIN
      (SELECT cluster AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{n} USING (vec_id) GROUP BY ALL) USING (c, i)),"""
    rounds = "".join((assign + update).format(n=n, m=n + 1) for n in range(ROUNDS)) + assign.format(n=ROUNDS)
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {DIMENSIONS}
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, unnest(range(1, {DIMENSIONS} + 1)) AS i, floor({SCALE} * unnest(e))::BIGINT AS x FROM k),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM k QUALIFY c < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT c, i, x AS y FROM f JOIN v USING (vec_id)),{rounds}
h AS (SELECT c AS cluster, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, cluster::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
      centroid_sha256 FROM a{ROUNDS} JOIN h USING (cluster)
"""


ORACLE_SQL = _sql()
