"""N-gram Jaccard join with count-vector R-trees.

Texts become sets of hashed 4-word shingles. All pairs of sets with 100 * |A n B| >= 85 * |A u B| link, and
documents that links connect form a component. The join never lists the pairs of a group of copies:

1. *Rows* are written once with a number of their own, so that ids may be null or repeated. *Equal sets* are one
   node, known by a digest of the set.
2. *Groups.* A size class c allows at most R differing shingles, so shingles are hashed into m > R groups:
   two similar sets agree in the whole content of at least m - R groups. m is such that a set's filled groups
   outnumber R by six deviations, so some group that agrees is filled (a set for which chance has it otherwise sends
   its empty groups too). A node sends one key per filled group (its content's hash) for its class, and for the next
   one when it is large enough to have partners there. Nodes with an equal key share a *cell*. Passages that many
   documents share don't make hot cells, as a key is equal only when a whole group of shingles is.
3. *Stars.* A cell's hub is its member with the most cells and fellows (the original of a group of edited
   copies); cells with one hub form a family, which a node joins once. Each node is held against the hub
   that it meets most often; linked ones are in one component and need no further look. One more such
   round goes from component to component of a family.
4. *R-trees.* Families that still hold several components get a tree over their members' points, the numbers
   of shingles in each of the m groups. A box, or a point, is left out when the summed minima of the
   coordinates, an upper bound of the overlap, are too small. For what survives across components the
   shared shingles are counted. Families of more than ``FAMILY`` members are dealt to pairs of parts.

Candidates and decisions use hashes of different seeds: a pair is linked by shingles counted under a second, independent
64-bit hash of the whole texts, and sets are equal only when their digests under both are. Word hashes mix
whole blocks of eight bytes (words over 64 bytes are digested by BLAKE2), so no two words collide under every seed.

Defined results: null, empty and blank texts have no shingles and link with nothing; repeated rows of one
id, and rows without an id, are documents of their own; ``component_id`` is the smallest id of a component's rows, null
where none has one. Texts are hashed whole, in pieces of ``CHUNK`` bytes; two sets exactly at the threshold link. Of equal ids
the row with the smaller number stands for the component. Empty tables give no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, numbered, read_table
from marlstone.llm.hashing import constants, mix, word_hashes, word_places

WIDTH = 4
#: Least similarity, in hundredths.
PERCENT = 85
#: Members, and shingles, of a family that one tree holds.
FAMILY, FAMILY_SHINGLES = 1024, 1 << 20
#: Bytes of text hashed at once.
CHUNK = 4 << 20
CLASS_RATIO = 1.6
#: Between the seed of candidates and that of decisions.
SECOND = 1_000_003
#: Ways in which the members of a family are dealt where they meet facts about their family.
SALTS = 16
_U = np.uint64


def shingle_sets(texts: list[bytes], seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        out += _shingle_sets(texts[i:j], seed)
        i = j
    return out


def _shingle_sets(texts: list[bytes], seed: int) -> list[np.ndarray]:
    c = constants(seed)
    low, starts, lens, at = word_places(texts)
    none = np.zeros(0, _U)
    if not len(starts):
        return [none] * len(texts)
    word = word_hashes(low, starts, lens, c)
    padded = np.concatenate([word, np.zeros(WIDTH - 1, _U)])
    runs = mix(reduce(np.add, (padded[k : k + len(word)] * c[k] for k in range(WIDTH))))
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= WIDTH:
            out.append(np.unique(runs[a : b - WIDTH + 1]))
        elif b > a:
            out.append(mix((word[a:b] * c[: b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            out.append(none)
    return out


def least_overlap(n1, n2):
    """Shingles that sets of these sizes must share."""
    return -(-PERCENT * (n1 + n2) // (100 + PERCENT))


def _enough(n: int, most: int, m: int) -> bool:
    """Whether m groups of n shingles or more leave more filled groups than ``most`` differences reach: by six deviations, or but
    for one set in 10^9."""
    empty = math.exp(-n / m)
    deviation = math.sqrt(max(0.0, m * empty * (1 - (1 + n / m) * empty)))
    few = math.lgamma(m + 1) - math.lgamma(most + 1) - math.lgamma(m - most + 1) + n * math.log(most / m)
    return few < math.log(1e-9) or m * (1 - empty) - 6 * deviation >= most + 1


def _groups(n: int, most: int) -> int:
    """The fewest groups that are enough, found by halving, as more groups are enough too (small sets: as nearly as two groups a
    difference allow)."""
    low, high = most + 1, 2 * most + 2
    while low < high:
        m = (low + high) // 2
        low, high = (low, m) if _enough(n, most, m) else (m + 1, high)
    return low


@lru_cache(maxsize=1)
def size_classes() -> list[tuple[int, int, int]]:
    """Of each class: its least size, R (differences allowed) and m (groups). Smaller sets link only when equal."""
    low = next(n for n in range(1, 1000) if 100 * n >= PERCENT * (n + 1))
    out = []
    while low < 1 << 31:
        after = max(low + 1, math.ceil(low * CLASS_RATIO))
        most = 2 * (100 - PERCENT) * (after - 1) // (100 + PERCENT)
        out.append((low, most, _groups(low, most)))
        low = after
    return out


@lru_cache(maxsize=64)
def _edges(m: int) -> np.ndarray:
    return np.array([(k << 64) // m for k in range(1, m)], dtype=_U)


def classes_of(n: int) -> list[int]:
    """The classes in which a set of this size can have partners: its own, and the next if that is near."""
    all_ = size_classes()
    if n < all_[0][0]:
        return []
    c = next(i for i in range(len(all_) - 1, -1, -1) if all_[i][0] <= n)
    return [c, c + 1] if c + 1 < len(all_) and 100 * n >= PERCENT * all_[c + 1][0] else [c]


def group_counts(u: np.ndarray, c: int) -> np.ndarray:
    """The point of a set in class c: shingles in each group. Groups are ranges of the hash."""
    m = size_classes()[c][2]
    return np.diff(np.concatenate([[0], np.searchsorted(u, _edges(m)), [len(u)]]))


def group_keys(u: np.ndarray, c: int, seed: int) -> np.ndarray:
    """Hashes of the contents of the groups; of empty ones only when they are so many that they could be all that agree."""
    _, most, m = size_classes()[c]
    counts = group_counts(u, c)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(u + constants(seed)[4]), dtype=_U)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    content = sums[bounds[1:]] - sums[bounds[:-1]]
    keys = mix(content + mix(np.arange(m, dtype=_U) + _U(c << 40)))
    empty = counts == 0
    return keys if empty.sum() >= m - most else keys[~empty]


def digest(u: np.ndarray, seed: int) -> int:
    c = constants(seed)
    return int(mix(mix(u + c[5]).sum(keepdims=True) + _U(len(u)))[0].astype(np.int64))


def _texts(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _slices(batches, rows: int = 512):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def document_nodes(rows: DataFrame, seed: int) -> DataFrame:
    """``row, doc_id, n, node, check``: set size and digests of every text."""

    def run(batches):
        for b in _slices(batches):
            texts = _texts(b.column(2))
            sets, others = shingle_sets(texts, seed), shingle_sets(texts, seed + SECOND)
            marks = [pa.array(x, pa.int64()) for x in ([len(u) for u in sets], [digest(u, seed) for u in sets], [digest(u, seed + SECOND) for u in others])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *marks], names=["row", "doc_id", "n", "node", "check"])

    return rows.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n long, node long, check long")


def node_keys(rows: DataFrame, seed: int) -> DataFrame:
    """``node, c, keys``: the cells of every set. A task sends a set that it meets again only once."""

    def run(batches):
        seen: set[int] = set()
        for b in _slices(batches):
            nodes, cs, keys = [], [], []
            for u in shingle_sets(_texts(b.column(1)), seed):
                if not (cls := classes_of(len(u))) or (node := digest(u, seed)) in seen:
                    continue
                seen.add(node)
                for c in cls:
                    nodes.append(node)
                    cs.append(c)
                    keys.append(group_keys(u, c, seed).view(np.int64))
            if len(seen) > 1 << 20:
                seen.clear()
            if nodes:
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(cs, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys)))],
                    names=["node", "c", "keys"],
                )

    return rows.select("row", "text").mapInArrow(run, "node long, c int, keys array<long>")


def shared_cells(rows: DataFrame, seed: int) -> DataFrame:
    """``cell, c, members, node, keys``: cells of two nodes or more; ``keys`` cells with the same members are one row."""
    rows = node_keys(rows, seed).select(F.explode("keys").alias("key"), "node", "c")
    by = Window.partitionBy("key")
    once = rows.withColumn("_last", F.lag("node").over(by.orderBy("node"))).where("_last is null or _last <> node")
    kept = once.select(
        "node", "c", F.count(F.lit(1)).over(by).cast("int").alias("members"), F.bit_xor(F.xxhash64("node", F.lit(1))).over(by).alias("cell")
    ).where("members > 1")
    return kept.groupBy("cell", "c", "members", "node").agg(F.count(F.lit(1)).alias("keys"))


def node_texts(rows: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """``node, n, text, points``: of each node (with its row ``rep``), its points by class."""

    def run(batches):
        for b in _slices(batches):
            sets = shingle_sets(_texts(b.column(1)), seed)
            points = [[{"c": c, "point": group_counts(u, c).astype(np.uint16).tobytes()} for c in classes_of(len(u))] for u in sets]
            kind = pa.list_(pa.struct([("c", pa.int32()), ("point", pa.binary())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(u) for u in sets], pa.int64()), b.column(1), pa.array(points, kind)], names=["node", "n", "text", "points"]
            )

    found = nodes.join(rows, nodes["rep"] == rows["row"]).select("node", "text")
    return found.mapInArrow(run, "node long, n long, text string, points array<struct<c:int,point:binary>>")


def linked(u: np.ndarray, v: np.ndarray) -> bool:
    shared = len(np.intersect1d(u, v, assume_unique=True))
    return 100 * shared >= PERCENT * (len(u) + len(v) - shared)


def verify(pairs: DataFrame, texts: DataFrame, seed: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose texts link, by the seed of decisions."""
    seed += SECOND

    def run(batches):
        known: OrderedDict[int, np.ndarray] = OrderedDict()  # a star's centre comes again and again

        def of(node, text):
            if node in known:
                return known[node]
            u = known[node] = shingle_sets([text.encode()], seed)[0]
            if len(known) > 256:
                known.popitem(last=False)
            return u

        for b in _slices(batches, 256):
            a_, b_, ta, tb = (b.column(i).to_pylist() for i in range(4))
            sets = shingle_sets([t.encode() for t in tb], seed)
            keep = [linked(of(x, t), v) for x, t, v in zip(a_, ta, sets)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _points(texts: DataFrame) -> DataFrame:
    return texts.select("node", "n", F.explode("points").alias("p")).select("node", "n", "p.c", "p.point")


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Of pairs ``a, b, c, ...`` those whose points allow the least overlap."""

    def run(batches):
        for b in batches:
            names = b.schema.names
            na, nb, pa_, pb = (b.column(names.index(k)).to_pylist() for k in ("na", "nb", "pa", "pb"))
            keep = [
                int(np.minimum(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)).sum()) >= least_overlap(i, j) for i, j, x, y in zip(na, nb, pa_, pb)
            ]
            yield b.select([k for k in names if k not in ("na", "nb", "pa", "pb")]).filter(pa.array(keep, pa.bool_()))

    left = points.select(F.col("node").alias("a"), "c", F.col("n").alias("na"), F.col("point").alias("pa"))
    right = points.select(F.col("node").alias("b"), "c", F.col("n").alias("nb"), F.col("point").alias("pb"))
    joined = pairs.join(right, ["b", "c"]).join(left, ["a", "c"])
    return joined.select(*pairs.columns, "na", "nb", "pa", "pb").mapInArrow(run, pairs.schema)


class RTree:
    """A packed R-tree over points; boxes keep only their upper corners, which the overlap bound needs."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        spread = np.argsort(-points.var(axis=0))[:2]
        self.order = np.lexsort((points[:, spread[-1]], points[:, spread[0]], sizes))
        self.points, self.sizes, self.labels = points[self.order], sizes[self.order], labels[self.order]
        self.levels = [(self.points, self.sizes, self.labels, self.labels)]
        while len(self.levels[-1][0]) > self.FAN:
            p, n, low, high = self.levels[-1]
            at = np.arange(0, len(p), self.FAN)
            self.levels.append((np.maximum.reduceat(p, at), np.minimum.reduceat(n, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, point: np.ndarray, size: int, label: int) -> np.ndarray:
        """Places (of the input) of points that may link and have another label."""
        some = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            p, n, low, high = (x[some] for x in self.levels[k])
            ok = (low != label) | (high != label)
            ok &= np.minimum(p, point).sum(axis=1, dtype=np.int64) >= least_overlap(size, n)
            some = some[ok]
            if k and len(some):
                some = (some[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                some = some[some < len(self.levels[k - 1][0])]
        return self.order[some]


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """Sets as rows of bits over the shingles that two of them or more hold."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(u) for u in sets])
    _, place, often = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1
    shared = often[place] > 1
    owner, column = owner[shared], column[place[shared]]
    bits = np.zeros((len(sets), int(column.max(initial=-1)) // 8 + 1), np.uint8)
    np.bitwise_or.at(bits, (owner, column >> 3), (1 << (column & 7)).astype(np.uint8))
    return bits


def family_links(nodes: np.ndarray, labels: np.ndarray, texts: list[bytes], c: int, parts: list[int | None], seed: int) -> list[tuple[int, int]]:
    """Links between components of a family: a tree over its points finds candidates, shared shingles are counted (at last
    by the seed of decisions).
    With parts (0 and 1) only pairs across them are looked at. What a link joins is not looked at again."""
    out: list[tuple[int, int]] = []
    split = None not in parts
    inner = np.array([p == 1 for p in parts]) if split else np.ones(len(nodes), bool)
    if not inner.any() or inner.all() and split or (labels == labels[0]).all():
        return out
    sets = shingle_sets(texts, seed)
    sizes = np.array([len(u) for u in sets], np.int64)
    points = np.stack([group_counts(u, c) for u in sets])
    bits, now, of = _bits(sets), labels.copy(), np.flatnonzero(inner)
    tree = RTree(points[of], sizes[of], labels[of])
    for i in np.flatnonzero(~inner) if split else range(len(nodes)):
        near = of[tree.search(points[i], sizes[i], labels[i])]
        near = near[now[near] != now[i]]
        if not split:
            near = near[near > i]
        if len(near):
            shared = np.bitwise_count(bits[near] & bits[i]).sum(axis=1, dtype=np.int64)
            for j in near[100 * shared >= PERCENT * (sizes[i] + sizes[near] - shared)]:
                if now[i] != now[j] and linked(*shingle_sets([texts[i], texts[j]], seed + SECOND)):
                    now[now == now[j]] = now[i]
                    out.append((int(nodes[i]), int(nodes[j])))
    return out


def search_families(rows: DataFrame, seed: int) -> DataFrame:
    """Links ``a, b`` from rows ``family, c, part, node, label, text`` (sorted by family within partitions)."""

    def run(batches):
        key, group = None, []

        def flush():
            found = []
            if len(group) > 1:
                texts = [g[2].encode() for g in group]
                found = family_links(np.array([g[0] for g in group], np.int64), np.array([g[1] for g in group], np.int64), texts, key[1], [g[3] for g in group], seed)
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in _slices(batches, 1024):
            for family, c, part, node, label, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (family, c) != key:
                    if len(group) > 1:
                        yield flush()
                    key, group = (family, c), []
                group.append((node, label, text, part))
        yield flush()

    return rows.mapInArrow(run, "a long, b long")


def roots(parents: DataFrame) -> DataFrame:
    """``node, label`` from rows ``node, parent`` of a forest, one a child: the root above each child, and of each root itself. Pointers are
    followed two more steps a round, so the rounds grow with the logarithm of the depth."""
    now = first = materialize(parents.select("node", F.col("parent").alias("to")), "parents")
    tops = first.select(F.col("to").alias("node")).distinct().join(first.select("node"), "node", "left_anti")
    while True:
        by = lambda a, b: now.select(F.col("node").alias(a), F.col("to").alias(b))
        far = now.join(by("to", "_next"), "to", "left").join(by("_next", "_far"), "_next", "left")
        to = F.coalesce("_far", "_next", "to")
        jumped = materialize(far.select("node", to.alias("to"), (to != F.col("to")).alias("moved")), "jumps")
        now = jumped.select("node", "to")
        if not jumped.where("moved").limit(1).count():
            return materialize(now.union(tops.select("node", "node")).toDF("node", "label"), "labels")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node with a link; label is one of the component's nodes.

    Each round every node hooks to its smallest neighbour if that is smaller, which makes a forest; the links are renamed by its roots,
    and those inside a component go. All of it is joins and aggregates."""
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("parent")).where("parent < a").select(F.col("a").alias("node"), "parent")
        found = roots(hooks)
        labels = found if labels is None else relabelled(labels, found)
        edges = materialize(renamed(edges, found).distinct(), "edges")
    return links.sparkSession.createDataFrame([], "node long, label long") if labels is None else labels


def renamed(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links ``a, b`` between components: the ends by their labels, without links inside one."""
    for end in ("a", "b"):
        to = labels.select(F.col("node").alias(end), F.col("label").alias("_to"))
        links = links.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return links.where("a <> b").select("a", "b")


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels whose components are joined further by ``more`` (``node, label`` of labels, or of nodes that had no link)."""
    to = more.select(F.col("node").alias("label"), F.col("label").alias("_to"))
    moved = labels.join(to, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    new = more.join(labels.select("node"), "node", "left_anti")
    return materialize(moved.union(new.select("node", "label")), "labels")


def joined_by(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links between nodes: only what these join is looked at again."""
    more = components(renamed(materialize(links, "links"), labels))
    return relabelled(labels, more) if more.limit(1).count() else labels


def meet(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Members joined to their family's one row of facts; facts stand in ``SALTS`` copies, so a large family is dealt to as many tasks."""
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["family", "c", "_salt"]).drop("_salt")


def labelled(families: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the families that hold several components, with the members' ``label`` and the family's ``members`` and
    ``shingles``."""
    named = families.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = named.groupBy("family", "c").agg(
        F.min("label").alias("first"), F.max("label").alias("_last"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")
    )
    return meet(named, open_.where("first <> _last").drop("_last"))


def row_components(rows: DataFrame, seed: int = 0) -> DataFrame:
    """``row, doc_id, n, first`` of every row of ``row, doc_id, text``; ``first`` (``no_id, doc_id, row``) is its component's
    row with the smallest id."""
    found = materialize(document_nodes(rows, seed), "nodes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    filled = found.where("n > 0").groupBy("node")
    own = materialize(filled.agg(first.alias("first"), F.min("row").alias("rep"), F.min("n").alias("n"), F.min("check").alias("_x"), F.max("check").alias("_y")), "own")
    if own.where("_x <> _y").limit(1).count():  # two sets with one digest: other hashes tell them apart
        return row_components(rows, seed + 1)

    cells = materialize(shared_cells(rows, seed), "cells")
    texts = materialize(node_texts(rows, cells.select("node").distinct().join(own.select("node", "rep"), "node"), seed), "texts")
    points = _points(texts)

    # families: cells with one hub are one, so that a node comes once to each hub that it meets
    fame = cells.groupBy("node").agg(F.sum(F.col("members") * F.col("keys")).alias("fame"))
    cells = materialize(cells.join(fame, "node"), "famed")
    most = F.max_by("node", F.struct("fame", "node"))
    hubs = cells.groupBy("cell", "c").agg(most.alias("family"))
    met = cells.join(hubs, ["cell", "c"]).groupBy("family", "c", "node").agg(F.sum("keys").alias("often"), F.first("fame").alias("fame"))
    families = materialize(met.join(own.select("node", "n"), "node"), "families")

    # first stars: each node against the hub that it meets most often
    stars = families.where("node <> family").select(F.col("family").alias("a"), F.col("node").alias("b"), "c", "often")
    near = bounded(stars, points).groupBy("b").agg(F.max_by("a", F.struct("often", "a")).alias("a"))
    # a hub is more met than its members, so these links are a forest
    labels = roots(verify(near, texts, seed).select(F.col("b").alias("node"), F.col("a").alias("parent")))

    # second stars: the components of a family against the first of them, by their own hubs
    reps = labelled(families, labels).groupBy("family", "c", "label").agg(most.alias("node"), F.max("fame").alias("fame"))
    heads = reps.groupBy("family", "c").agg(most.alias("head"))
    pairs = meet(reps, heads).where("node <> head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"), "c").distinct()
    more = bounded(pairs, points).select("a", "b").distinct()
    labels = joined_by(labels, verify(more, texts, seed))

    # the rest, exactly: trees over the members of families that still hold several components
    rest = labelled(families, labels)
    parts = F.ceil(F.greatest(F.col("members") / FAMILY, F.col("shingles") / FAMILY_SHINGLES)).cast("int")
    dealt = rest.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        F.when(F.col("parts") == 1, F.col("family")).otherwise(F.xxhash64("family", F.least("mine", "other"), F.greatest("mine", "other"))).alias("family"),
        "c",
        F.when(F.col("mine") == F.col("other"), F.lit(None).cast("int")).otherwise((F.col("mine") > F.col("other")).cast("int")).alias("part"),
        "node",
        "label",
    )
    dealt = dealt.join(texts.select("node", "text"), "node").select("family", "c", "part", "node", "label", "text")
    labels = joined_by(labels, search_families(dealt.repartition("family", "c").sortWithinPartitions("family", "c"), seed))

    named = own.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = named.groupBy("label").agg(F.min("first").alias("first"))
    of_node = named.select("node", "label").join(by_label, "label").select(F.col("node").alias("_node"), "first")
    alone = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    all_ = found.join(of_node, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    return all_.select("row", "doc_id", "n", F.coalesce("first", alone).alias("first"))


def similar_components(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("row", "value.*")
    return row_components(rows, seed).select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest id (of equal ids, one of them); all columns stay."""
    rows = numbered(docs)
    read = rows.select("row", F.col(f"value.`{id_col}`").cast("long").alias("doc_id"), F.col(f"value.`{text_col}`").cast("string").alias("text"))
    dropped = row_components(read).where("row <> first.row").select("row")
    return rows.join(dropped, "row", "left_anti").select("value.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read_table(spark, sf_dir, "documents"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Over a relation `documents`; pairs by joining on every shingle, components by recursion; `joined` is the result.
JOINED_SQL = rf"""
tok AS (SELECT doc_id, {_W} AS ws FROM documents),
sg AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM tok WHERE len(ws) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sg GROUP BY doc_id),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS s FROM sg x JOIN sg y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
lk AS (SELECT a, b FROM pr JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b WHERE 100 * s >= {PERCENT} * (p.n + q.n - s)),
reach AS (SELECT doc_id, doc_id AS other FROM tok UNION SELECT r.doc_id, lk.b FROM reach r JOIN lk ON lk.a = r.other),
joined AS (SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM tok t LEFT JOIN sz USING (doc_id)
      JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id))
"""
ORACLE_SQL = f"WITH RECURSIVE {JOINED_SQL} SELECT * FROM joined"
