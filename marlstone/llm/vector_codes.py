"""Vector code compression: product codes from Hilbert-sorted blocks of vector parts.

Vectors of integers are cut into parts; every part position has a codebook, and a part's code is its nearest entry. A *chunk* is up to
``CHUNK_VALUES`` components of a task's vectors. In a chunk the parts of each position are sorted along a Hilbert curve and cut into flat blocks of
``BLOCK`` parts, and a block keeps its box (least and greatest value in each dimension) and its sum. Chunks are
written once, so that a round reads them without sorting or shuffling anything.

In a round, an entry can be nearest to some part of a block only if its least distance to the box is no more than the smallest
greatest distance that any entry has from it. Those entries are the block's shortlist. A block with one is assigned as a whole, and adds its
stored sum; the others are evaluated part by part against their shortlist by exact integer kernels. A task's sums
and counts by entry are added in Spark as 32-bit limbs, so that no entry, however common, meets in one task.
Codebooks (positions times entries times components) are all that the driver sees.

Defined results: vectors that are null or hold null, NaN or infinite components take no part. Shorter vectors read as if they ended in
zeros, up to the longest's length and to a multiple of the number of parts; so an empty vector is a zero vector. Null ids
are kept and come last; repeated rows are vectors of their own, of equal ids the smaller vector (component by component)
stands first. With fewer vectors than entries there are as many entries as vectors. Ties go to the smaller index. Values too
large for 64-bit distances are computed with Python's integers; an error beyond the range of long reads as its end. A null label is
a label of its own. Columns beyond the three named are not read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import LONG_MAX, finite, limb_rows, materialize, read_table, small, summed_limbs
from marlstone.llm.popcount import floors

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Components of a chunk (16,384 vectors of 64), and parts of a block.
CHUNK_VALUES, BLOCK = 1 << 20, 32
#: Bits of a Hilbert index, and dimensions that it looks at.
CURVE_BITS, CURVE_DIMENSIONS = 60, 12


def hilbert_order(parts: np.ndarray) -> np.ndarray:
    """Order of (n, d) integers along a Hilbert curve through their box."""
    low = parts.min(axis=0)
    spread = max(1, int((parts.max(axis=0) - low).max(initial=0)))
    d = min(parts.shape[1], CURVE_DIMENSIONS)
    bits = min(spread.bit_length(), CURVE_BITS // d)
    shift = max(0, spread.bit_length() - bits)
    x = ((parts[:, :d] - low[:d]) >> shift).astype(np.int64)
    # from axes to the transposed index: undo the excess work of each bit, from the highest, then the Gray code
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        for i in range(d):
            high = (x[:, i] & q) != 0
            t = (x[:, 0] ^ x[:, i]) & (q - 1)
            x[:, 0] ^= np.where(high, q - 1, t)
            x[:, i] ^= np.where(high, 0, t)
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        flip ^= np.where(x[:, d - 1] & q, q - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for k in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> k) & 1)
    return np.argsort(key, kind="stable")


def exact_kind(top: int, dimensions: int):
    """The type in which squared distances of integers up to this size are exact, and sums of a few of them."""
    return np.int64 if dimensions * (2 * top) ** 2 < 1 << 56 else object


def _top(v: np.ndarray) -> int:
    return max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))


class Blocks:
    """The sorted parts of one position of a chunk, and their blocks' boxes and sums."""

    def __init__(self, parts: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.parts, self.low, self.high, self.sums = parts, low, high, sums
        self.of = np.arange(len(parts)) // BLOCK

    @classmethod
    def cut(cls, parts: np.ndarray) -> Blocks:
        """Of parts in their order."""
        at = np.arange(0, len(parts), BLOCK)
        return cls(parts, *(f.reduceat(parts, at, axis=0) for f in (np.minimum, np.maximum, np.add)))

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """(blocks, entries): whether an entry can be nearest to a part of the block."""
        kind = exact_kind(max(_top(self.low), _top(self.high), _top(entries)), entries.shape[1])
        low, high, e = self.low.astype(kind)[:, None], self.high.astype(kind)[:, None], entries.astype(kind)[None]
        out, far = np.maximum(np.maximum(low - e, e - high), 0), np.maximum(e - low, high - e)
        return (out * out).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1)[:, None]

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each part, and the lengths of the blocks' shortlists."""
        kind = exact_kind(max(_top(self.low), _top(self.high), _top(entries)), entries.shape[1])
        short = self.shortlists(entries)
        length, lists = short.sum(axis=1), np.argsort(~short, axis=1, kind="stable")  # ascending indexes first
        code = lists[self.of, 0]
        parts, entries = self.parts.astype(kind), entries.astype(kind)
        for m in np.unique(length[length > 1]):  # blocks with lists of one length together
            mine = np.flatnonzero(length[self.of] == m)
            for some in np.array_split(mine, -(-len(mine) * m // (1 << 17))):
                listed = lists[self.of[some], :m]
                far = reduce(np.add, ((parts[some, k, None] - entries[listed, k]) ** 2 for k in range(parts.shape[1])))
                code[some] = listed[np.arange(len(some)), far.argmin(axis=1)]
        return code, length

    def entry_sums(self, entries: np.ndarray) -> list[list[int]]:
        """Of each entry the sums of its parts and their number; blocks with one entry count as a whole."""
        code, length = self.nearest(entries)
        whole = length == 1
        sums = np.zeros(entries.shape, self.sums.dtype)
        np.add.at(sums, code[::BLOCK][whole], self.sums[whole])
        loose = ~whole[self.of]
        np.add.at(sums, code[loose], self.parts[loose])
        return [[*row, n] for row, n in zip(sums.tolist(), np.bincount(code, minlength=len(entries)).tolist())]

    def errors(self, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared distances from the parts to their entries."""
        kind = exact_kind(max(_top(self.low), _top(self.high), _top(entries)), entries.shape[1])
        return ((self.parts.astype(kind) - entries.astype(kind)[code]) ** 2).sum(axis=1)


def _dump(v: np.ndarray, kind: str) -> bytes:
    """Integers of a numpy type, or, without one, of any size."""
    return v.astype(kind).tobytes() if kind else ",".join(map(str, v.ravel().tolist())).encode()


def _load(data: bytes, kind: str, width: int) -> np.ndarray:
    flat = np.frombuffer(data, kind).astype(np.int64) if kind else np.array([int(x) for x in data.split(b",")], object)
    return flat.reshape(-1, width)


_LISTS = ("orders", "parts", "low", "high", "sums")
_CHUNKS = "ids array<long>, labels array<string>, kind string, " + ", ".join(f"{c} array<binary>" for c in _LISTS)


def _chunk(ids: list, labels: list, x: np.ndarray) -> pa.RecordBatch:
    v = floors(x, SCALE)
    kind = "" if v.dtype == object else "<i2" if _top(v) < 1 << 15 else "<i4"
    row = {c: [] for c in _LISTS}
    for part in np.split(v, PARTS, axis=1):
        order = hilbert_order(part)
        b = Blocks.cut(part[order])
        row["orders"].append(order.astype("<i4").tobytes())
        for c, how in (("parts", kind), ("low", kind), ("high", kind), ("sums", kind and "<i8")):
            row[c].append(_dump(getattr(b, c), how))
    arrays = [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([kind])]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array([row[c]], pa.list_(pa.binary())) for c in _LISTS)], names=["ids", "labels", "kind", *_LISTS])


def chunks(vectors: DataFrame, length: int) -> DataFrame:
    """``vec_id, label, v`` as sorted chunks; large values stand in chunks of their own."""
    most = max(BLOCK, CHUNK_VALUES // length)

    def run(batches):
        held: dict[bool, tuple[list, list, list]] = {k: ([], [], []) for k in (False, True)}
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                b = batch.slice(i, most)
                x = np.zeros((b.num_rows, length))
                sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
                x[np.arange(length) < sizes[:, None]] = b.column(2).flatten().to_numpy(zero_copy_only=False)
                ids, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
                large = (np.abs(x) * SCALE).max(axis=1) >= 1 << 26
                for kind, h in held.items():
                    some = np.flatnonzero(large == kind)
                    if len(h[0]) + len(some) > most:
                        yield _chunk(h[0], h[1], np.concatenate(h[2]))
                        h = held[kind] = ([], [], [])
                    if len(some):
                        h[0].extend(ids[k] for k in some), h[1].extend(labels[k] for k in some), h[2].append(x[some])
        for h in held.values():
            if h[0]:
                yield _chunk(h[0], h[1], np.concatenate(h[2]))

    return vectors.mapInArrow(run, _CHUNKS)


def _positions(batches, width: int, columns: list[str]):
    """The rows of chunks as (row, blocks of each position)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in columns}
            blocks = [[_load(batch.column(c)[i][p].as_py(), row["kind"] and ("<i8" if c == "sums" else row["kind"]), width) for c in _LISTS[1:]] for p in range(PARTS)]
            yield row, [Blocks(*b) for b in blocks]


def next_codebooks(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """(parts, entries, components) after one round: the floors of the mean parts; unused entries stay."""

    def run(batches):
        sums = [[0] * (books.shape[2] + 1) for _ in range(books.shape[0] * books.shape[1])]
        for _, blocks in _positions(batches, books.shape[2], ["kind"]):
            for p, b in enumerate(blocks):
                for e, found in enumerate(b.entry_sums(books[p]), p * books.shape[1]):
                    sums[e] = [x + y for x, y in zip(sums[e], found)]
        yield from limb_rows(sums)

    out, width = books.copy(), books.shape[2]
    for item, row in summed_limbs(table.mapInArrow(run, "item int, place int, limb int, value long")).items():
        out[item // books.shape[1], item % books.shape[1]] = [row.get(k, 0) // row[width] for k in range(width)]
    return out


def encoded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector of the chunks."""

    def run(batches):
        for row, blocks in _positions(batches, books.shape[2], ["ids", "labels", "kind", "orders"]):
            n = len(row["ids"])
            codes, errors = np.zeros((n, PARTS), np.uint8), 0
            for p, b in enumerate(blocks):
                order = np.frombuffer(row["orders"][p], "<i4")
                code, _ = b.nearest(books[p])
                far = b.errors(books[p], code)
                back = np.empty(n, np.int64)
                back[order] = np.arange(n)
                codes[:, p], errors = code[back], errors + far[back]
            if errors.dtype == object:
                errors = [min(int(x), LONG_MAX) for x in errors]
            text = codes.tobytes().hex()
            text = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(text), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return table.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(df: DataFrame, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every vector that takes part (written), and the codebooks."""
    v = F.col(vector).cast("array<double>")
    kept = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v")).where(finite(F.col("v")))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 1
    length = -(-max(longest, 1) // PARTS) * PARTS
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    books = np.array([floors(np.array([*r.v, *[0.0] * (length - len(r.v))]), SCALE).tolist() for r in first], object)
    if not first:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((PARTS, 0, length // PARTS), object)
    books = books.reshape(len(first), PARTS, length // PARTS).transpose(1, 0, 2)
    table = materialize(chunks(kept, length), "chunks")
    for _ in range(rounds):
        books = next_codebooks(table, books)
    return materialize(encoded(table, books), "codes"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(read_table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    sums = found.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    out = found.join(small(materialize(sums, "label-errors")), F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds written one after the other, over rows of one component."""
    assign = """
a{n} AS MATERIALIZED (SELECT vec_id, p, e, d FROM (SELECT vec_id, p, e, sum((x - y) * (x - y))::BIGINT AS d FROM v JOIN c{n} USING (p, j) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1),"""
    update = """
c{m} AS MATERIALIZED (SELECT p, e, j, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{n} LEFT JOIN
      (SELECT p, e, j, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{n} USING (vec_id, p) GROUP BY ALL) USING (p, e, j)),"""
    rounds = "".join((assign + update).format(n=n, m=n + 1) for n in range(ROUNDS)) + assign.format(n=ROUNDS)
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS emb FROM embeddings WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, len(emb) // {PARTS} AS w, unnest(range(0, len(emb))) AS i, floor({SCALE} * unnest(emb))::BIGINT AS x FROM k),
v AS MATERIALIZED (SELECT vec_id, i // w AS p, i % w AS j, x FROM u),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {ENTRIES}),
c0 AS MATERIALIZED (SELECT p, e, j, x AS y FROM f JOIN v USING (vec_id)),{rounds}
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM c{ROUNDS}),
o AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN k USING (vec_id) CROSS JOIN h
"""


ORACLE_SQL = _sql()
