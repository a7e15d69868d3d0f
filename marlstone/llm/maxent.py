"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

    P(w | h) = P(class | h) * P(cell | class, h) * P0(w) / P0(cell),    P0(w) = (count(w) + 1) / (N + V + 1).

*Outcomes.* The ``FREQUENT`` most frequent words are cells of their own, in classes by frequency. Every other word is in a
class by its last two letters and in one of ``WAYS`` cells of it by a hash; words of one cell share its probability by their
counts. The end of a text is a class of its own. Both factors are softmaxes over ``WAYS`` outcomes.

*Features* are of the words before, whichever they are: the word before, the two words before together (bigram history),
the word before that alone (skip), and the last letters of both, for words that are rare. Each is hashed into ``buckets`` weights for each class, and, together with the class,
for each cell; the buckets grow with the number of distinct words, from 2^10 to 2^17 (17 MB of weights, which the driver and a broadcast hold at
most; beyond two million distinct words more of them share a bucket). The biases are the
classes' and cells' own probabilities, so a model without weights is the base.

A word never seen keeps P0 = 1/(N + V + 1) and the others share the rest: a distribution over the training words and one unknown.

*Training.* Each of ``UPDATES`` jobs goes over its share of the training documents, all of which are used once, and
sums for every weight the gradient (observed less expected) and the observed count; the sums of all tasks meet by
bucket, where each weight's step is its gradient by its expected count (a damped diagonal Newton step). Only the steps,
of bounded size, come to the driver and go out as the next job's model.

*Counts* of tokens are exact: blocks of about ``BLOCK_BYTES`` of text, dealt by a hash of their rows, count their words, the
counts are summed over blocks, and each block gets back the part of the vocabulary that it uses. Nothing that grows with the
corpus is broadcast or collected. *Scoring* turns a block's texts into index arrays; numpy does the rest in slices.

Defined results: null and empty texts are one end token. A null id counts as an empty text for the fold. Repeated rows
count as often as they occur; texts are scored whole, however long. Of equally frequent words the smaller is ranked first. Without training
tokens every token is unknown. Only the id and text columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, read_table
from marlstone.llm.hashing import constants, word_hashes, word_places

FOLDS, HELD_OUT = 7, 2
#: Outcomes of each softmax: classes, and cells of a class.
WAYS = 16
#: Words that are cells of their own, in the first classes; the last class is the end of a text.
FREQUENT = 8 * WAYS
SPELT = WAYS - 1 - FREQUENT // WAYS
#: Features of a token.
FEATURES = 4
#: Bounds of the number of buckets (powers of two), and distinct words a bucket between them.
LEAST_BITS, MOST_BITS, WORDS_A_BUCKET = 10, 17, 16
UPDATES = 3
#: Observations of no information that damp each step, and the longest step.
DAMPING, LONGEST = 8.0, 1.5
#: Bytes of text of a block, and of a training task at most; smaller tasks, down to the last, where there are machines for them.
BLOCK_BYTES, TASK_BYTES, SMALL_TASK_BYTES = 8 << 20, 96 << 20, 2 << 20
#: Tokens that numpy takes at once, and buckets that a task sends at once.
SLICE = 1 << 15
SENT = 1 << 13
#: The end token; no word holds white space.
END = b"\n"
NONE = -1e30
_U = np.uint64
_U32 = np.uint32


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    out.append(END)
    return out


def _held(key) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % FOLDS == HELD_OUT


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


@dataclass
class Model:
    """Weights of both softmaxes, their biases, and the hashes of the frequent words."""

    bits: int
    top: np.ndarray
    class_bias: np.ndarray
    cell_bias: np.ndarray
    class_weights: np.ndarray
    cell_weights: np.ndarray
    mass: np.ndarray
    total: int
    distinct: int

    def cells(self, h: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Cells (class * WAYS + number) of words from their hashes and last letters."""
        spelt = FREQUENT // WAYS + ((tails.astype(_U32) * _U32(0x9E3779B1)) >> _U32(16)).astype(np.int64) % SPELT
        out = spelt * WAYS + ((h >> _U(20)) % _U(WAYS)).astype(np.int64)
        if len(self.top):
            order = np.argsort(self.top)
            ranked = self.top[order]
            may = np.zeros(1 << 16, bool)  # by the leading 16 bits
            may[(ranked >> _U(48)).astype(np.int64)] = True
            some = np.flatnonzero(may[(h >> _U(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(ranked, h[some]), len(ranked) - 1)
            hit = ranked[at] == h[some]
            out[some[hit]] = order[at[hit]]
        return out


END_CELL = (WAYS - 1) * WAYS
_START = (_U(0x51ED270B35A17C4D), _U(0xC2B2AE3D27D4EB4F))


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and last letters of a list of words."""
    low, starts, lens, _ = word_places(words)
    return (word_hashes(low, starts, lens, constants(0)), _tails(low, starts, lens)) if len(starts) else (np.zeros(0, _U), np.zeros(0, np.int64))


def _tails(low: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    last = starts + lens - 1
    return low[last].astype(np.int64) + np.where(lens > 1, low[np.maximum(last - 1, 0)].astype(np.int64) << 8, 0)


def _before(x: np.ndarray, first: np.ndarray, start: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, what the token before and the one before that have."""
    one, two = np.empty_like(x), np.empty_like(x)
    one[1:], two[2:] = x[:-1], x[:-2]
    second = first + 1
    two[second[second < len(x)]] = start[0]
    one[first], two[first] = start
    return one, two


def histories(h: np.ndarray, tails: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashed features, (FEATURES, tokens), of each token of texts in a row; ``first`` are the places where texts begin."""
    one, two = _before(h, first, _START)
    ends = _before(tails, first, (1, 2))
    spelt = (ends[0].astype(_U) << _U(16)) + ends[1].astype(_U) + _U(1)
    pair = one * _U(0x9E3779B97F4A7C15) + (two ^ (two >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    named = [one * _U(0x94D049BB133111EB), two * _U(0xD6E8FEB86659FD93), pair ^ (pair >> _U(31)), spelt * _U(0x9FB21C651E98DF25)]
    return np.stack([(x * _U(0x2545F4914F6CDD1D) >> _U(32)).astype(_U32) for x in named])


def buckets(features: np.ndarray, bits: int, classes: np.ndarray | None = None) -> np.ndarray:
    """Weights that the features use: of the classes, or of the cells of the given classes."""
    if classes is not None:
        features = (features ^ ((classes.astype(_U32) + _U32(1)) * _U32(0x85EBCA6B))) * _U32(0xC2B2AE35)
    return (features >> _U32(32 - bits)).astype(np.int64)


def _sums(bias: np.ndarray, weights: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Bias and weights of each outcome, (tokens, WAYS). Steps are bounded, so no exponent is too large."""
    z = weights.take(used[0], axis=0)
    for f in used[1:]:
        z += weights.take(f, axis=0)
    z += bias
    return z


def _log_share(bias: np.ndarray, weights: np.ndarray, used: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log P of the outcome y of each token."""
    z = _sums(bias, weights, used)
    own = z[np.arange(len(y)), y].astype(np.float64)
    np.exp(z, out=z)
    return own - np.log(np.maximum(z.sum(axis=1, dtype=np.float64), 1e-300))


def _shares(bias: np.ndarray, weights: np.ndarray, used: np.ndarray) -> np.ndarray:
    """P of each outcome, (tokens, WAYS), where some outcome has a bias."""
    z = _sums(bias, weights, used)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def log_cells(model: Model, features: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """log P(cell | history) of each token."""
    out = np.empty(len(cells))
    for i in range(0, len(cells), SLICE):
        f, (c, k) = features[:, i : i + SLICE], np.divmod(cells[i : i + SLICE], WAYS)
        out[i : i + SLICE] = _log_share(model.class_bias, model.class_weights, buckets(f, model.bits), c)
        out[i : i + SLICE] += _log_share(model.cell_bias[c], model.cell_weights, buckets(f, model.bits, c), k)
    return out


def count_blocks(blocks: DataFrame) -> DataFrame:
    """``block, word, n_train`` of every word of a block."""

    def run(table: pa.Table) -> pa.Table:
        train, others = Counter(), set()
        for key, text in zip(table.column("doc_id").to_pylist(), table.column("text")):
            (others if _held(key) else train).update(tokens(text.as_py()))
        others -= train.keys()
        counts = np.concatenate([np.fromiter(train.values(), np.int64, len(train)), np.zeros(len(others), np.int64)])
        names = pa.concat_arrays([pa.array(list(x), pa.binary()) for x in (train, others)])
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(names), block, np.int64)), "word": names, "n_train": pa.array(counts)})

    return blocks.groupBy("block").applyInArrow(run, "block long, word binary, n_train long")


def untrained(counts: DataFrame, total: int, distinct: int) -> Model:
    """The model of no weights, from ``word, n`` of all training words."""
    best = counts.where(F.col("word") != F.lit(END)).orderBy(F.col("n").desc(), "word").limit(FREQUENT).collect()
    top, _ = hashed([bytes(r["word"]) for r in best])
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, distinct / WORDS_A_BUCKET)))))
    zeros = np.zeros((1 << bits, WAYS), np.float32)
    model = Model(bits, top, np.zeros(WAYS), np.zeros((WAYS, WAYS)), zeros, zeros, np.zeros(WAYS * WAYS), total, distinct)

    def run(batches):
        n, words = np.zeros(WAYS * WAYS, np.int64), np.zeros(WAYS * WAYS, np.int64)
        for b in batches:
            cells = cells_of(model, b.column(0).to_pylist())
            n += np.bincount(cells, weights=b.column(1).to_numpy(), minlength=WAYS * WAYS).astype(np.int64)
            words += np.bincount(cells, minlength=WAYS * WAYS)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(WAYS * WAYS)), "n": pa.array(n), "words": pa.array(words)})

    mass = np.zeros(WAYS * WAYS)
    for r in counts.select("word", "n").mapInArrow(run, "cell long, n long, words long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        mass[r["cell"]] = (r["n"] + r["words"]) / (total + distinct + 1)
    classes = mass.reshape(WAYS, WAYS).sum(axis=1)
    log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-300)), NONE)
    shares = np.divide(mass.reshape(WAYS, WAYS), classes[:, None], out=np.zeros((WAYS, WAYS)), where=classes[:, None] > 0)
    return replace(model, mass=mass, class_bias=log(classes).astype(np.float32), cell_bias=log(shares).astype(np.float32))


def cells_of(model: Model, words: list[bytes]) -> np.ndarray:
    """Cells of a list of tokens."""
    plain = [w if w != END else b"." for w in words]
    h, tails = hashed(plain)
    return np.where(np.fromiter((w == END for w in words), bool, len(words)), END_CELL, model.cells(h, tails)) if words else np.zeros(0, np.int64)


def text_tokens(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, last letters and cells of the tokens of texts in a row, ends included, and where each text begins."""
    low, starts, lens, at = word_places(texts)
    first = at[:-1] + np.arange(len(texts))
    ends = at[1:] + np.arange(len(texts))
    n = len(starts) + len(texts)
    word = np.ones(n, bool)
    word[ends] = False
    h, tails, cells = np.full(n, _START[0]), np.zeros(n, np.int64), np.full(n, END_CELL)
    if len(starts):
        h[word], tails[word] = word_hashes(low, starts, lens, constants(0)), _tails(low, starts, lens)
        cells[word] = model.cells(h[word], tails[word])
    return h, tails, cells, first


def gradients(model: Model, batches):
    """Of a partition's texts: by softmax and bucket, the gradient and the observed count of each outcome."""
    size = 1 << model.bits
    g, seen = np.zeros((2, WAYS, size)), np.zeros((2, size * WAYS), np.uint32)

    def add(t: int, bias: np.ndarray, weights: np.ndarray, used: np.ndarray, y: np.ndarray) -> None:
        error = _shares(bias, weights, used)
        np.negative(error, out=error)
        error[np.arange(len(y)), y] += 1
        for k in range(WAYS):
            own = error[:, k].astype(np.float64)
            for f in used:
                g[t, k] += np.bincount(f, weights=own, minlength=size)
        for f in used:
            np.add.at(seen[t], f * WAYS + y, np.uint32(1))

    step = max(SLICE, size)  # tokens at once: sums are made for all buckets, so these should not be the most
    for b in batches:
        lens = pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False)
        i = 0
        while i < len(lens):  # about a step of tokens at a time; only its texts are Python's
            j, held = i, 0
            while j < len(lens) and (j == i or held + lens[j] < 6 * step):
                held += int(lens[j])
                j += 1
            texts = [x or b"" for x in b.column(0).slice(i, j - i).cast(pa.binary()).to_pylist()]
            h, tails, cells, first = text_tokens(model, texts)
            features = histories(h, tails, first)
            for s in range(0, len(cells), step):
                f, (c, k) = features[:, s : s + step], np.divmod(cells[s : s + step], WAYS)
                add(0, model.class_bias, model.class_weights, buckets(f, model.bits), c)
                add(1, model.cell_bias[c], model.cell_weights, buckets(f, model.bits, c), k)
            i = j
    for t in range(2):
        counts = seen[t].reshape(size, WAYS)
        every = np.flatnonzero(counts.any(axis=1))
        for i in range(0, len(every), SENT):
            used = every[i : i + SENT]
            rows = np.concatenate([g[t][:, used].T.astype(np.float32), counts[used].astype(np.float32)], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * 2 * WAYS, pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(t * size + used), flat], names=["part", "s"])


def train(docs: DataFrame, model: Model, n_bytes: int, updates: int = UPDATES) -> Model:
    """The model after ``updates`` jobs over as many shares of the training documents of ``doc_id, text``."""
    spark, size = docs.sparkSession, 1 << model.bits
    kept = docs.where(~held_out(F.col("doc_id")))
    share_bytes = n_bytes / max(1, updates)
    tasks = max(1, math.ceil(share_bytes / TASK_BYTES), min(spark.sparkContext.defaultParallelism, math.ceil(share_bytes / SMALL_TASK_BYTES)))
    for u in range(updates):
        shared = spark.sparkContext.broadcast(model)  # of bounded size: 2 ** MOST_BITS buckets
        share = kept.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(updates)) == u).select("text").coalesce(tasks)
        parts = share.mapInArrow(lambda batches, shared=shared: gradients(shared.value, batches), "part long, s array<float>")
        summed = parts.groupBy("part").agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(2 * WAYS)])
        step = [F.col(f"s{i}") / (FEATURES * F.greatest(F.col(f"s{WAYS + i}") - F.col(f"s{i}"), F.lit(0.0)) + DAMPING) for i in range(WAYS)]
        steps = summed.select("part", F.array(*[F.greatest(F.lit(-LONGEST), F.least(F.lit(LONGEST), x)).cast("float") for x in step]).alias("step")).toArrow()
        if not steps.num_rows:
            continue
        delta = np.zeros((2 * size, WAYS), np.float32)
        delta[steps.column("part").to_numpy()] = steps.column("step").combine_chunks().flatten().to_numpy().reshape(-1, WAYS)
        model = replace(model, class_weights=model.class_weights + delta[:size], cell_weights=model.cell_weights + delta[size:])
        shared.destroy()
    return model


def score(blocks: DataFrame, vocabulary: DataFrame, model: Model) -> DataFrame:
    """Base and model scores of every document, from blocks and each block's ``block, word, n``."""
    total, distinct = model.total, model.distinct
    unknown = 1.0 / (total + distinct + 1)
    shared = blocks.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        model = shared.value
        names = words.column("word").to_pylist()
        n = words.column("n").to_numpy()
        base = np.log10((n + 1) / (total + distinct + 1))
        cell = cells_of(model, names)
        own = np.log1p(-unknown) - np.where(model.mass > 0, np.log(np.maximum(model.mass, 1e-300)), 0.0)
        share = own[cell]
        hashes, tails = hashed([w if w != END else b"." for w in names])
        of = dict(zip(names, range(len(names))))
        del names
        known = n > 0
        keys = docs.column("doc_id").to_pylist()
        texts = docs.column("text")
        n_tokens, n_known, bases, scores = (np.zeros(len(keys), t) for t in (np.int64, np.int64, float, float))
        i = 0
        while i < len(keys):  # texts of about a few slices of tokens at a time
            j, held, lists = i, 0, []
            while j < len(keys) and held < 4 * SLICE:
                ws = tokens(texts[j].as_py())
                lists.append(np.fromiter(map(of.__getitem__, ws), np.int64, len(ws)))
                held += len(ws)
                j += 1
            at = np.concatenate(lists)
            lens = np.array([len(x) for x in lists])
            first = np.concatenate([[0], np.cumsum(lens)[:-1]])
            gain = (log_cells(model, histories(hashes[at], tails[at], first), cell[at]) + share[at]) / math.log(10)
            n_tokens[i:j], n_known[i:j] = lens, np.add.reduceat(known[at].astype(np.int64), first)
            bases[i:j] = np.add.reduceat(base[at], first)
            scores[i:j] = bases[i:j] + np.add.reduceat(np.where(known[at], gain, 0.0), first)
            i = j
        return pa.table(
            {
                "doc_id": pa.array(keys, pa.int64()), "held_out": pa.array([_held(k) for k in keys], pa.bool_()), "n_tokens": pa.array(n_tokens), "n_known": pa.array(n_known),
                "train_tokens": pa.array(np.full(len(keys), total, np.int64)), "base_score": pa.array(bases), "score": pa.array(scores),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(vocabulary.groupBy("block")).applyInArrow(run, schema)


def dealt(docs: DataFrame, n_blocks: int) -> DataFrame:
    """Rows by block; each block is one of as many partitions, so a task's input doesn't grow with the table."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block")
    return docs.select(block, "doc_id", "text").repartition(n_blocks, "block")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", updates: int = UPDATES) -> DataFrame:
    """Scores of all documents by the model trained on those that are not held out."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(n_bytes / BLOCK_BYTES))
    counted = materialize(count_blocks(dealt(docs, n_blocks)), "block-counts")
    counts = materialize(counted.where("n_train > 0").groupBy("word").agg(F.sum("n_train").alias("n")), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    model = train(docs, untrained(counts, totals["total"], totals["distinct"]), n_bytes, updates)
    found = counted.select("block", "word").join(counts, "word", "left").select("block", "word", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return score(dealt(docs, n_blocks), found.repartition(n_blocks, "block"), model)


def op8_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
