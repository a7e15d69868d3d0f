import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, fixity, licenses, maxent, mixing, ngram_join, quality, secrets, sharding, topk
from marlstone.llm.registry import ORACLE, QUERIES
from tests.llm.cases import EXTRA, documents, empty
from tests.oracle import connect, spark_rows, sql_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf_dir, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    assert rows and (names, rows) == sql_rows(connect(sf_dir), ORACLE[name])


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def doc_dir(docs, tmp_path_factory):
    """A table folder with these documents, extra columns included."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs.withColumn("key", F.lit(3)).withColumn("block", F.lit("b")).write.parquet(f"{path}/documents.parquet")
    return path


# 1


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PIECES = ["a", "e", "the", " ", "  ", "\n", "\t", "'s", "'ll", "'", "é", "ñ", "1", "23", "½", "²", "　", "\x1c", "\x85", "日本", "🙂", "!", "...", "́", "ʼ", "ǅ", "​",
          "<|endoftext|>", "'re", "'LL", "Ⅷ", "٣", "\xad", "�", "\x00", " ", " ", "᠎"]


@pytest.mark.parametrize("block,run", [(1 << 16, 1 << 12), (7, 20), (1, 4)])
def test_bpe_equals_library(monkeypatch, library, block, run):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
    monkeypatch.setattr(bpe, "LONG_RUN", run)
    table = bpe.MergeTable(bpe.tokenizer_spec())
    memo, rng = bpe.Memo(table, 50), random.Random(block)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) * rng.choice([1, 1, 1, 40]) for _ in range(rng.randint(0, 30)))
        ids = bpe.encode_text(table, memo, text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert "".join(bpe.decode_blocks(table, ids, 3)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_digests_in_pieces(monkeypatch, library):
    """Digests of the stream equal those of whole ids and texts, also where a piece ends inside a character."""
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 5)
    monkeypatch.setattr(bpe, "LONG_RUN", 8)
    table = bpe.MergeTable(bpe.tokenizer_spec())
    memo, rng = bpe.Memo(table, 50), random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) * rng.choice([1, 1, 20]) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.digest_text(table, memo, text) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_long_runs_and_lookahead(library):
    table = bpe.MergeTable(bpe.tokenizer_spec())
    assert 16 <= table.lookahead <= 4096
    rng = random.Random(2)
    for text in ["a" * 30000, "".join(rng.choice("ing") for _ in range(30000)), " " * 20000 + "x", "=" * 9000]:
        stream, out, most = bpe.Encoder(table), [], 0
        for i in range(0, len(text), 1000):
            out += stream.feed(text[i : i + 1000])
            most = max(most, len(stream.text) + len(stream.bytes))
        assert out + stream.finish() == library.encode(text, add_special_tokens=False).ids
        assert most <= 4 * table.lookahead + bpe.LONG_RUN + 2000


def test_bpe_operator(spark, docs, rows, library, doc_dir):
    got = bpe.digests(bpe.bpe_round_trip(docs)).collect()
    want = Counter()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(tuple(g) for g in got) == want
    assert Counter(tuple(g) for g in bpe.op1_bpe(spark, doc_dir).collect()) == want
    coded = bpe.bpe_encode(docs)
    assert {(r.doc_id, r.decoded) for r in bpe.bpe_decode(coded).collect()} == {(r.doc_id, r.text or "") for r in rows}
    assert bpe.bpe_round_trip(empty(spark)).count() == 0
    bad = spark.createDataFrame([(1, [220, 99999, -1, None, 20543, 246]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.bpe_decode(bad).collect()} == {1: library.decode([220, 20543, 246], skip_special_tokens=False), 2: ""}


# 2


def test_sharding(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan_in=3)
    assert store.read() is None and store.compact()["version"] == 0
    wide = documents(spark, n=12, extra=True).coalesce(1)
    parts = [wide.where((F.col("doc_id") % 7 == i) | (F.col("doc_id").isNull() & (F.lit(i) == 0))) for i in range(7)]
    for p in parts:
        store.append(p)
    before = store.manifest()
    assert store.append(wide.limit(0))["version"] == before["version"] == 7
    after = store.compact()
    assert sum(s["rows"] for s in after["shards"]) == wide.count() and not store.runs(after)
    back = store.read()
    assert back.drop("shard").exceptAll(wide.drop("shard")).count() == 0 and back.count() == wide.count()
    assert store.read(7).count() == wide.count()  # older versions stay readable
    with pytest.raises(sharding.Conflict):
        store._commit(store.manifest(3), [], 1)
    assert store.manifest(4)["version"] == 4 and store.vacuum() == 0 and store.read(7).count() == wide.count()
    assert store.vacuum(-1) > 0 and store.read().count() == wide.count()


def test_vacuum_spares_what_is_being_written(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    rows = spark.range(5).withColumn("text", F.lit("x"))
    commit, spared = store._commit, []

    def slow(*a):  # another process cleans up between the write and the commit
        spared.append(sharding.ShardStore(spark, str(tmp_path / "s")).vacuum(60))
        return commit(*a)

    store._commit = slow
    store.append(rows)
    assert spared == [0] and store.read().count() == 5
    name = store._mark()
    rows.write.parquet(f"{store.path}/shards/{name}")  # a writer that died
    assert store.vacuum(60) == 0 and store.vacuum(-1) == 1 and store.read().count() == 5


def plain_compaction(shards, target, fan_in):
    """Tiers and runs over (shard, rows, bytes, files), each merged shard with one file a target size."""
    shards, after = list(shards), max((s[0] for s in shards), default=0) + 1
    while True:
        tiers = defaultdict(list)
        for s in shards:
            mean = max(s[2] / s[3], sharding.LEAST_BYTES)
            if s[2] / s[3] < sharding.SEALED * target:
                t = 0
                while sharding.LEAST_BYTES * sharding.TIER_RATIO ** (t + 1) <= mean:
                    t += 1
                tiers[t].append(s)
        due = [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan_in]
        if not due:
            return sorted(shards)
        size = sum(s[2] for s in due[0])
        shards = [s for s in shards if s not in due[0]] + [(after, sum(s[1] for s in due[0]), size, max(1, math.ceil(size / target)))]
        after += 1


def test_sharding_equals_plain_tiers(spark, tmp_path):
    rng = random.Random(4)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=150_000, fan_in=3)
    want = []
    for i in range(14):
        rows = [(k, "x" * rng.randint(0, 400)) for k in range(rng.choice([3, 10, 60, 200, 900]))]
        store.append(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), f"a{i}")
        want.append((i + 1, len(rows), sum(len(t) + 64 for _, t in rows), 1))
    listed = lambda m: sorted((s["shard"], s["rows"], s["bytes"], s["files"]) for s in m["shards"])
    assert listed(store.manifest()) == want
    after = store.compact()
    assert listed(after) == plain_compaction(want, 150_000, 3) and len(after["shards"]) < 14
    assert sorted(x for s in after["shards"] for x in s["from"]) == sorted(f"a{i}" for i in range(14))
    sizes = {r["shard"]: r["count"] for r in store.read().groupBy("shard").count().collect()}
    assert sizes == {s["shard"]: s["rows"] for s in after["shards"]}


def test_op2_query(spark, doc_dir, rows):
    got = sharding.op2_sharding(spark, doc_dir).collect()
    assert Counter((r.doc_id, r.arrival) for r in got) == Counter((r.doc_id, (r.doc_id or 0) % sharding.ARRIVALS) for r in rows)
    size = defaultdict(lambda: [0, 0])
    text = {}
    for r in rows:
        text.setdefault((r.doc_id, (r.doc_id or 0) % sharding.ARRIVALS), len((r.text or "").encode()) + 64)
    for r in got:
        size[r.shard][0] += 1
        size[r.shard][1] += text[r.doc_id, r.arrival]
    assert all((r.shard_rows, r.shard_bytes) == tuple(size[r.shard]) for r in got)


# 3


def brute_groups(rows):
    """Sets of shingles, and the rows (by place) of each component."""
    sets = []
    for r in rows:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))} if ws else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            s = len(a & sets[j])
            if s and 100 * s >= 85 * (len(a) + len(sets[j]) - s):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sets, list(groups.values())


def least_id(rows, group):
    return min((rows[i].doc_id for i in group if rows[i].doc_id is not None), default=None)


def brute_components(rows):
    sets, groups = brute_groups(rows)
    return Counter((rows[i].doc_id, len(sets[i]), least_id(rows, g)) for g in groups for i in g)


def brute_kept(rows):
    """Ids of the rows that stay when each component keeps its first."""
    return Counter(least_id(rows, g) for g in brute_groups(rows)[1])


def test_components(spark, docs, rows):
    got = ngram_join.similar_components(docs).collect()
    assert Counter(tuple(g) for g in got) == brute_components(rows)
    assert ngram_join.similar_components(empty(spark)).count() == 0


@pytest.mark.parametrize("seed,family", [(11, 2048), (12, 4)])
def test_chains_and_hubs(spark, monkeypatch, seed, family):
    """Copies of copies: links that form chains, and groups whose members link only to their original."""
    monkeypatch.setattr(ngram_join, "FAMILY", family)
    rng, texts = random.Random(seed), []
    for _ in range(4):
        ws = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(12):  # a chain
            ws = list(ws)
            ws[rng.randrange(len(ws))] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(ws))
        first = [f"v{rng.randint(0, 10**6)}" for _ in range(120)]
        texts.append(" ".join(first))
        for _ in range(10):  # a star
            ws = list(first)
            for _ in range(2):
                ws[rng.randrange(len(ws))] = f"y{rng.randint(0, 10**6)}"
            texts.append(" ".join(ws))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(tuple(g) for g in ngram_join.similar_components(df).collect()) == brute_components(df.collect())


def test_groups_keep_similar_sets():
    """Any two sets within the threshold share a key, at all sizes."""
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(6, 400))
        u = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(len(u) * rng.random() * 0.16)
        v = np.unique(np.concatenate([u[rng.permutation(len(u))[drop:]], rng.integers(0, 1 << 63, int(drop * rng.random())).astype(np.uint64)]))
        s = len(np.intersect1d(u, v))
        if 100 * s >= 85 * (len(u) + len(v) - s) and len(u) != s:
            keys = [{(c, k) for c in ngram_join.classes_of(len(x)) for k in ngram_join.group_keys(x, c, 0).tolist()} for x in (u, v)]
            assert keys[0] & keys[1]


def test_classes_are_made_at_once():
    began = time.time()
    classes = ngram_join.size_classes.__wrapped__()
    assert time.time() - began < 0.05 and classes[-1][0] > 1 << 30
    for n, most, m in classes:
        if n < 50_000:  # the first number of groups that is enough, counted up
            assert m == next((x for x in range(most + 1, 2 * most + 2) if ngram_join._enough(n, most, x)), 2 * most + 2)


def test_tree_bound_is_safe():
    import numpy as np

    rng = np.random.default_rng(6)
    points = rng.integers(0, 6, (300, 12)).astype(np.uint16)
    sizes, labels = points.sum(axis=1).astype(np.int64), rng.integers(0, 9, 300)
    tree = ngram_join.RTree(points, sizes, labels)
    for i in range(300):
        allowed = np.minimum(points, points[i]).sum(axis=1) >= ngram_join.least_overlap(sizes[i], sizes)
        assert set(tree.search(points[i], sizes[i], labels[i])) == set(np.flatnonzero(allowed & (labels != labels[i])))


def test_one_per_component_keeps_columns(spark):
    wide = documents(spark, extra=True)
    kept = ngram_join.one_per_component(wide)
    assert kept.columns == wide.columns and Counter(r.doc_id for r in kept.collect()) == brute_kept(wide.collect())


def test_components_of_repeated_and_missing_ids(spark):
    """Texts are told apart by rows: ids may stand for several texts, or be null."""
    rng = random.Random(3)
    text = lambda n=90: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    near = lambda ws: " ".join([*ws[:40], "other", *ws[41:]])
    rows = []
    for i in range(20):
        a, b = text(), text()
        rows += [(i, " ".join(a)), (i, " ".join(b)), (1000 + i, near(a)), (2000 + i, near(b))]
    for _ in range(6):
        a = text()
        rows += [(None, " ".join(a)), (None, near(a)), (None, near(a))]
    a, b = text(), text()
    rows += [(3000, near(a)), (3005, " ".join(a)), (3005, " ".join(b)), (3006, " ".join(b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = df.collect()
    assert Counter(tuple(g) for g in ngram_join.similar_components(df).collect()) == brute_components(own)
    kept = ngram_join.one_per_component(df).collect()
    assert Counter(r.doc_id for r in kept) == brute_kept(own) and Counter(r.doc_id for r in kept)[None] == 6
    assert {r.text for r in kept if r.doc_id in (3000, 3005)} == {near(a), " ".join(b)}


def test_word_hashes_differ():
    """Words that a polynomial takes for one, and words about the block and the long-word sizes."""
    import numpy as np

    tm = "a"
    while len(tm) < 1024:
        tm += tm.translate(str.maketrans("ab", "ba"))
    for seed in range(3):
        words = [x[:n] for n in (1, 7, 8, 9, 16, 17, 63, 64, 65, 66, 512, 1024) for x in (tm, tm.translate(str.maketrans("ab", "ba")))]
        words += ["a" * n for n in range(2, 90)]
        found = ngram_join.shingle_sets([w.encode() for w in words], seed)
        assert len({int(u[0]) for u in found}) == len(set(words)) == len(words)
    rng = random.Random(1)
    for _ in range(100):
        texts = [" ".join("".join(rng.choice("aAbcé") for _ in range(rng.choice([1, 3, 8, 9, 16, 64, 65]))) for _ in range(rng.randint(0, 9))) for _ in range(5)]
        ws = [t.replace("A", "a").split(" ") if t else [] for t in texts]
        sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set() for w in ws]
        hashed = ngram_join.shingle_sets([t.encode() for t in texts], 7)
        assert [[len(np.intersect1d(u, v)) for v in hashed] for u in hashed] == [[len(x & y) for y in sets] for x in sets]


@pytest.mark.parametrize("n", [93, 150, 238])
def test_unrelated_sets_share_no_cells(n):
    """10^5 sets: no set sends its empty groups, so no cell gathers sets that have nothing in common."""
    import numpy as np

    rng = np.random.default_rng(n)
    c = ngram_join.classes_of(n)[0]
    drawn = np.sort(rng.integers(0, 1 << 64, (100_000 if n == 150 else 20_000, n), dtype=np.uint64), axis=1)
    keys = np.concatenate([ngram_join.group_keys(u, c, 0) for u in drawn])
    assert np.unique(keys, return_counts=True)[1].max() <= 50


# 4


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = defaultdict(lambda: [0, 0, 0, 0])
    for r in got:
        by[r.source] = [by[r.source][0] + r.taken, r.target, by[r.source][2] + r.size, r.source_size]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: by[s][2] for s in by}
    want, full = {}, set()
    while True:  # share, stop at three times the size, share the rest again
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order) if s not in full}
        want = {s: 3 * size[s] if s in full else rest * weight[s] / sum(weight.values()) for s in order}
        over = {s for s in weight if want[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        full |= over
    for s, (taken, target, total, source_size) in by.items():
        assert total == source_size and abs(target - want[s]) < 1e-6
        assert abs(taken - target) <= max(8, 0.01 * target)
    one_id = spark.createDataFrame([(None, f"a b {i}", "s") for i in range(3000)], "doc_id long, text string, source string")
    assert max(r["count"] for r in mixing.mix(one_id, shard_docs=100).groupBy("shard").count().collect()) < 300
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix(docs.where("text is null or text = ''")).where("taken > 0").count() == 0


def test_seats_are_the_highest_quotients(spark):
    rng = random.Random(9)
    parties = [(g, i, rng.choice([0.0, rng.random() * 100, 40.0])) for g in range(4) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(parties, "g int, i int, v double")
    for seats in (0, 1, 7, 100):
        got = {(r.g, r.i): r.seats for r in mixing.sainte_lague(df, "v", ["g"], "i", F.lit(seats).cast("long")).collect()}
        for g in range(4):
            own = [(i, v) for h, i, v in parties if h == g]
            top = sorted(((-v / (2 * k - 1), i, k) for i, v in own if v > 0 for k in range(1, seats + 1)))[:seats]
            assert {i: got[(g, i)] for i, _ in own} == {i: sum(t[1] == i for t in top) for i, _ in own}


@pytest.mark.parametrize("ids", ["own", "null", "repeated", "some"])
def test_mixed_documents(spark, ids):
    """Every source's emitted words come within one document a shard of its target, whatever the ids."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        doc_id = {"own": i, "null": None, "repeated": i % 3, "some": None if i % 3 else i % 7}[ids]
        text = " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 30))) if i % 5 else rng.choice(["same text of it", None, ""])
        rows.append((doc_id, text, rng.choice(["a", "b", "b", "b", None]), i))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row int").repartition(3)
    mixed = mixing.mixed_documents(df, shard_docs=64)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
    of = {r.source: r for r in mixing.mix(df, shard_docs=64).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.countDistinct("shard").alias("shards")).collect()}
    for source, r in of.items():
        assert abs(words[source] - r.target) <= 30 * r.shards + mixing.BLOCK_WORDS, (source, words[source], r)
    times = Counter(r.row for r in mixed.collect())
    assert max(times.values()) <= mixing.MAX_REPEATS


# 5


def brute_top(rows, k):
    out = set()
    for q, a in rows:
        if q % 50 == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [4, 64])
def test_topk(spark, block):
    rng = random.Random(block)
    vectors = [(i, [rng.randint(-3, 3) / 4 for _ in range(5)]) for i in range(230)]
    for same in (7, 50, 120):
        vectors[same] = (same, vectors[3][1])
    raw = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    bad = spark.createDataFrame([(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 5), (1150, [float("inf")] * 5), (None, [1.0] * 5)], "vec_id long, embedding array<float>")
    v = topk.whole_vectors(raw.union(bad))
    got = topk.top_k(v.where("key % 50 = 0"), v, 5, block, 2 * block).collect()
    whole = [(i, [math.floor(256 * x) for x in a]) for i, a in vectors]
    assert {tuple(r) for r in got} == brute_top(whole, 5) and len(got) == 25
    few = topk.top_k(v.where("key = 0"), v.where("key < 3"), 5)
    assert few.count() == 2 and topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0


def test_topk_large_numbers_and_lengths(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40]), (2, []), (3, [1.0, 1.0, 1.0]), (4, [-1.0, 0.5])]
    v = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1.0)
    got = {(r.vec_id, r.score) for r in topk.top_k(v.where("key = 3"), v).collect()}
    assert got == {(0, 2**40 + 1), (1, 2**40), (2, 0), (4, -1)}


def test_topk_beyond_long_and_repeated_rows(spark):
    rows = [(0, [2.0**40, 1.0]), (50, [2.0**40, 3.0]), (1, [-(2.0**40), 0.0]), (2, [0.0, 5.0]), (2, [0.0, 5.0]), (3, [0.0, 7.0])]
    v = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1.0)
    got = sorted(tuple(r) for r in topk.top_k(v.where("key = 50"), v).collect())
    assert got == [(50, 1, 0, (1 << 63) - 1), (50, 2, 3, 21), (50, 3, 2, 15), (50, 4, 2, 15), (50, 5, 1, -(1 << 63))]


def test_topk_takes_other_rows_of_the_querys_id(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0, 1.0]), (7, [3.0, 1.0])]
    v = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1.0)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v.where("key = 0"), v).collect())
    assert got == [(0, 1, 0, 5), (0, 1, 7, 10), (0, 2, 0, 5), (0, 2, 7, 5)]


def test_topk_stops_early_on_skewed_vectors():
    """Where few dimensions decide, most vectors are never scored; a good start leaves whole blocks."""
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = np.floor(256 * rng.gamma(0.3, size=(2048, 1)) * rng.dirichlet([0.05] * 16, 2048)).astype(np.int64)
    block = topk.SortedLists(np.arange(2048), vectors)
    queries = vectors[rng.choice(2048, 40, replace=False)]
    want = [sorted(((-int(v @ q), i) for i, v in enumerate(vectors)))[:5] for q in queries]
    assert [[(-s, i) for s, i in block.best(-1, q, 5)] for q in queries] == want
    assert block.scored < 0.4 * 40 * 2048
    block.scored = 0
    assert [[(-s, i) for s, i in block.best(-1, q, 5, -w[4][0])] for q, w in zip(queries, want)] == want and block.best(-1, queries[0], 5, 1 << 60) == []
    assert block.scored < 0.4 * 40 * 2048


# 6


def fixity_status(spark, left, right, file_pages=300):
    parts = fixity.file_parts(left, right, file_pages=file_pages)
    records = [fixity.warc_records(x, parts, file_pages) for x in (left, right)]
    return fixity.compare(*records)


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "y" * (i % 50)) for i in range(2500)] + [(7, None, None), (7, None, None), (None, "u", "h")], "page_id long, url string, html string")
    good = fixity.warc_records(pages, None, 300)
    hurt = {5, 299, 300, 2499}
    got = fixity_status(spark, pages, pages.withColumn("html", F.when(F.col("page_id").isin(*hurt), F.regexp_replace("html", "^<", "#")).otherwise(F.col("html"))))
    assert {r.page_id for r in got.where("status <> 'intact'").collect()} == hurt and got.count() == 2503 and got.where("moved").count() == 0
    assert fixity_status(spark, pages, pages).where("status <> 'intact' or moved").count() == 0
    files = good.groupBy("file", "part").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert files.where("n <> end").count() == 0
    assert fixity_status(spark, pages.limit(0), pages.limit(0)).count() == 0 and fixity_status(spark, pages, pages.limit(0)).where("status = 'missing'").count() == 2503
    assert fixity_status(spark, pages.limit(0), pages).where("status = 'surplus'").count() == 2503


def test_fixity_locates_losses_and_gains(spark):
    """One lost page is one row, whatever moves behind it; so is a gained, a longer and a doubled one."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "y" * (i % 50)) for i in range(2000)], "page_id long, url string, html string")
    more = spark.createDataFrame([(5000, "u", "new"), (700, "http://x/700", "second")], "page_id long, url string, html string")
    other = pages.where("page_id <> 10").withColumn("html", F.when(F.col("page_id") == 950, F.lit("much longer than before")).otherwise(F.col("html"))).union(more)
    got = fixity_status(spark, pages, other)
    assert sorted((r.page_id, r.status) for r in got.where("status <> 'intact'").collect()) == [(10, "missing"), (700, "surplus"), (950, "changed"), (5000, "surplus")]
    moved = {r.page_id for r in got.where("moved").collect()}
    assert set(range(11, 300)) <= moved and not moved & set(range(10)) and not moved & set(range(300, 600))


def test_fixity_cuts_files_of_repeated_ids(spark):
    pages = spark.createDataFrame([(7, "u", f"body {i % 900}") for i in range(1500)] + [(None, "u", f"n{i}") for i in range(700)] + [(i, "u", "x") for i in range(100, 400)], "page_id long, url string, html string")
    sizes = fixity.warc_records(pages, None, 100).groupBy("file", "part").count().collect()
    assert max(r["count"] for r in sizes) <= 250 and sum(r["count"] for r in sizes) == 2500
    got = fixity_status(spark, pages, pages.where("html <> 'n3' and html <> 'body 5'").union(pages.where("html = 'n9'")), 100)
    assert Counter((r.page_id, r.status) for r in got.where("status <> 'intact'").collect()) == Counter({(7, "missing"): 2, (None, "missing"): 1, (None, "surplus"): 1})


# 7


def test_quality(spark, docs, rows):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows)
    hosts = Counter(r.source for r in rows)
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    lines = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    often = Counter((r.source, x) for r in rows for x in {norm(y) for y in lines(r.text)})
    for r in got:
        ws = WORD.findall(r.text or "")
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        covered = {j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        own = lines(r.text)
        gone = sum(len(WORD.findall(x)) for x in own if often[(r.source, norm(x))] > max(quality.MIN_DOCS, quality.MAX_SHARE * hosts[r.source]))
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.removed_words, r.base_failed, r.kept) == (
            len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", r.text or "")), len(own) - len(set(own)), len(covered), gone, failed, not failed and len(ws) - gone >= 0.5 * len(ws),
        )
    assert quality.quality_rules(empty(spark)).count() == 0


def test_quality_removes_frequent_lines(spark):
    body = lambda i: "\n".join(" ".join(f"o{i}x{j}x{k}" for k in range(7)) for j in range(12))
    menu = "\n".join(f"Menu  item{j} of{j} the{j} shop{j} X{j}" for j in range(20))
    rows = [(i, "s", (menu + "\n" + body(i)) if i < 8 else body(i)) for i in range(40)] + [(99, "s", menu.upper())]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in quality.quality_rules(df, max_share=0.1).collect()}
    assert got[0].removed_words == 120 and not got[0].kept and not got[99].kept and got[20].kept and got[20].removed_words == 0
    assert all(r.kept for r in quality.quality_rules(df, max_share=0.5).collect() if r.doc_id != 99)


def test_quality_filter_keeps_columns(spark):
    wide = documents(spark, extra=True)
    kept = quality.quality_filter(wide)
    assert kept.columns == wide.columns and kept.first()["kept"] == EXTRA["kept"] and 0 < kept.count() < wide.count()


@pytest.mark.parametrize("lines", [quality.BROADCAST_LINES, 0])
def test_quality_filter_returns_texts_without_frequent_lines(monkeypatch, spark, lines):
    """By one array per host and by joined line hashes; on a large host the count limit holds beside the share."""
    monkeypatch.setattr(quality, "BROADCAST_LINES", lines)
    body = lambda i: "\n".join(" ".join(f"o{i}x{j}x{k}" for k in range(7)) for j in range(12))
    text = lambda i, n: f"Menu  of\tthe SHOP\n\n {body(i)}\nmenu of the shop" if i % 400 < n else body(i)
    rows = [(i, host, text(i, n), len(text(i, n))) for host, at, n in (("big", 0, 30), (None, 400, 30), ("few", 800, 15)) for i in range(at, at + 400)]
    df = spark.createDataFrame(rows + [(1, "big", None, None)], "doc_id long, source string, text string, n_chars int")
    out = lambda **k: Counter(map(tuple, quality.quality_filter(df, max_share=0.1, **k).collect()))
    assert out(max_docs=None) == Counter(rows)
    left = [(d, h, t if h == "few" or "SHOP" not in t else "\n " + t.split("\n\n ")[1].rpartition("\n")[0]) for d, h, t, _ in rows]
    assert out(max_docs=20) == Counter((d, h, t, len(t)) for d, h, t in left)
    assert quality.quality_filter(df, max_docs=20).schema == df.schema


def test_quality_counts_documents_and_not_rows(spark, tmp_path):
    """Eight rows of one id are one document; rows without an id count one by one. As the SQL does."""
    body = lambda i: "\n".join(" ".join(f"o{i}x{j}x{k}" for k in range(7)) for j in range(12))
    rows = [(1, "s", "one line of it\n" + body(i)) for i in range(8)] + [(None, "s", "no id at all\n" + body(i)) for i in range(10, 18)] + [(i, "s", body(i)) for i in range(20, 50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r.h for r in quality.frequent_lines(df).collect()}
    hashes = {t: df.select(F.xxhash64(F.lit(t))).first()[0] for t in ("one line of it", "no id at all")}
    assert found == {hashes["no id at all"]}
    df.where("doc_id >= 20").union(df.where("doc_id = 1").limit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    names, got = spark_rows(quality.op7_quality(spark, str(tmp_path)))
    con = __import__("duckdb").connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert (names, got) == sql_rows(con, quality.ORACLE_SQL)
    assert quality.op7_quality(spark, str(tmp_path)).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


@pytest.mark.parametrize("collide", [False, True])
def test_repeated_windows_with_colliding_hashes(monkeypatch, spark, collide):
    if collide:
        monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.pmod(F.ascii(c[0]), F.lit(2)).cast("long"))
    rng = random.Random(5)
    texts = [[rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 40))] for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, w array<string>")
    for r in df.select("i", quality.repeated_window_words(F.col("w")).alias("n")).collect():
        ws = texts[r.i]
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        assert r.n == len({j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


# 8


def test_maxent(spark, docs, rows, doc_dir):
    got = maxent.score_documents(docs).collect()
    tok = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    count = Counter(w for r in rows if not held(r.doc_id) for w in tok(r.text))
    total = sum(count.values())
    want = Counter()
    for r in rows:
        ws = tok(r.text)
        base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in ws)
        want[(r.doc_id, held(r.doc_id), len(ws), sum(w in count for w in ws), total, round(base, 6))] += 1
    base_of = lambda got: Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert base_of(got) == want and all(r.score < 0 for r in got)
    again = maxent.op8_maxent(spark, doc_dir).collect()
    assert base_of(again) == want and Counter(round(r.score, 4) for r in again) == Counter(round(r.score, 4) for r in got)
    assert docs.where(maxent.held_out(F.col("doc_id"))).count() == sum(held(r.doc_id) for r in rows)
    assert maxent.score_documents(empty(spark)).count() == 0
    assert {r.n_known for r in maxent.score_documents(docs.where("doc_id is not null").where(maxent.held_out(F.col("doc_id")))).collect()} == {0}


def _trained(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counted = maxent.count_blocks(maxent.dealt(df, 2)).cache()
    counts = counted.where("n_train > 0").groupBy("word").agg(F.sum("n_train").alias("n")).cache()
    t = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    model = maxent.train(df, maxent.untrained(counts, t[0], t[1]), 1000)
    return df, counted, counts, {bytes(r.word): r.n for r in counts.collect()}, model


def plain_log_p(model, counts, history, word):
    """log10 P(word | history) by the formula, for one word: no slices, no tables of a block."""
    if word not in counts:
        return math.log10(1 / (model.total + model.distinct + 1))
    end = maxent.END
    texts = b" ".join([*history, *([word] if word != end else [])])
    h, tails, cells, first = maxent.text_tokens(model, [texts])
    i = len(history)
    f = maxent.histories(h, tails, first)[:, i]
    mask = (1 << 32) - 1
    top = lambda x: (x & mask) >> (32 - model.bits)
    c, k = divmod(int(cells[i]), maxent.WAYS)
    def share(bias, weights, used, y):
        z = [float(bias[j]) + sum(float(weights[u][j]) for u in used) for j in range(maxent.WAYS)]
        return z[y] - max(z) - math.log(sum(math.exp(x - max(z)) for x in z))
    log_p = share(model.class_bias, model.class_weights, [top(int(x)) for x in f], c)
    log_p += share(model.cell_bias[c], model.cell_weights, [top(((int(x) ^ (((c + 1) * 0x85EBCA6B) & mask)) * 0xC2B2AE35)) for x in f], k)
    unknown = 1 / (model.total + model.distinct + 1)
    return (log_p + math.log(1 - unknown) + math.log((counts[word] + 1) * unknown) - math.log(model.mass[cells[i]])) / math.log(10)


def test_maxent_is_a_distribution_that_learns(spark):
    """Scores equal the formula, the probabilities of all words after a history sum to one, and words that follow each
    other are learnt: by the word before, by the pair, and over a gap."""
    rng = random.Random(3)
    after = {f"w{i}": [f"w{rng.randint(0, 99)}" for _ in range(3)] for i in range(100)}
    def text(n=40):
        ws = [f"w{rng.randint(0, 99)}"]
        while len(ws) < n:
            ws.append(rng.choice(after[ws[-1]]) if rng.random() < 0.9 else f"w{rng.randint(0, 99)}")
        return " ".join(ws)
    df, counted, counts, count, model = _trained(spark, [(i, text()) for i in range(600)] + [(9000, None), (9001, "new W1 words \t w2")])
    vocabulary = counted.join(counts, "word", "left").select("block", "word", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    got = {r.doc_id: r for r in maxent.score(maxent.dealt(df, 2), vocabulary, model).collect()}
    for r in df.where("doc_id < 20 or doc_id >= 9000").collect():
        ws = maxent.tokens(r.text)
        assert abs(got[r.doc_id].score - sum(plain_log_p(model, count, ws[:i], w) for i, w in enumerate(ws))) < 1e-3
    for history in ([], [b"w5"], [b"w7", b"w9"], [b"unheard", b"w3"]):
        assert abs(sum(10 ** plain_log_p(model, count, history, w) for w in [*count, b"never seen"]) - 1) < 1e-4
    held = [r for r in got.values() if r.held_out and r.doc_id < 9000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_maxent_training_task_is_small():
    """With the most buckets and a large batch of texts: the sums of a plain loop, few buckets sent at once, and little memory beside the model's."""
    rng = np.random.default_rng(5)
    weights = lambda: rng.normal(0, 0.1, (1 << maxent.MOST_BITS, maxent.WAYS)).astype(np.float32)
    zeros = np.zeros((maxent.WAYS, maxent.WAYS), np.float32)
    model = maxent.Model(maxent.MOST_BITS, np.zeros(0, np.uint64), zeros[0], zeros, weights(), weights(), np.zeros(maxent.WAYS**2), 10, 10)
    texts = [None, "", *(" ".join(f"w{x}" for x in rng.integers(0, 10**6, 400)) for _ in range(2000)), None]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([*texts, *["x" * 20_000] * 2000])})
    tracemalloc.start()
    sums, seen, rows = np.zeros(maxent.WAYS), Counter(), []
    for sent in maxent.gradients(model, [batch]):
        s = sent.column(1).flatten().to_numpy().reshape(-1, 2 * maxent.WAYS)
        part = sent.column(0).to_numpy() >> maxent.MOST_BITS
        sums += s[:, : maxent.WAYS].sum(axis=0, dtype=np.float64)
        for t in (0, 1):
            seen[t] += s[part == t, maxent.WAYS :].sum(dtype=np.float64)
        rows.append(sent.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == dict.fromkeys((0, 1), maxent.FEATURES * sum(len(maxent.tokens(t)) for t in [*texts, *["x"] * 2000]))
    assert abs(sums.sum()) < 1  # of each token, what is observed less what is expected
    assert max(rows) <= 1 << 13 and peak < 120e6, (max(rows), peak)


# 9


def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [x[2] for x in sorted(out)]


SECRET_PIECES = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", '"', "'", " ", "hunter2hunter2", "abc", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "é", "\n", "x-1", "+", "K", "ſ"]


def test_secrets_base(spark, docs):
    rng = random.Random(8)
    texts = ["".join(rng.choice(SECRET_PIECES) for _ in range(rng.randint(0, 25))) for _ in range(800)] + [None, "", "a" * 100_000 + "token=abcdefgh1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan_secrets(df).collect():
        base = [f"{f.kind}:{f.start}:{f.end}" for f in r.findings if f.kind != "literal"]
        assert base == brute_base(texts[r.doc_id] or "")
    assert secrets.scan_secrets(docs).count() == docs.count() and secrets.scan_secrets(empty(spark)).count() == 0


def test_secrets_follow_constants():
    found = lambda t: [t[a:b] for k, a, b, _ in secrets.find_secrets(t) if k == "literal"]
    assert found('k = "Zx81kQ0vTr55"\ndb_password = k') == ["Zx81kQ0vTr55"]
    assert found('a = "Zx81kQ0v"\nb = a + "Tr55LmQ2"\nclientSecret := b') == ["Zx81kQ0v", "Tr55LmQ2"]
    assert found('{"privateKey": "Zx81kQ0vTr55"}') == ["Zx81kQ0vTr55"]
    assert found("export AUTH_TOKEN=Zx81kQ0vTr55Lm") == ["Zx81kQ0vTr55Lm"]
    assert found('title = "Zx81kQ0vTr55"') == [] and found('password = "changeme now"') == [] and found("time: 10:30, note: see below") == []


def test_secrets_lex_whole_literals():
    found = lambda t: [t[a:b] for k, a, b, _ in secrets.find_secrets(t) if k == "literal"]
    assert found("""db_password = "aB3'x9Kq!7" """) == ["aB3'x9Kq!7"] and found("db_password = 'aB3`x\"9Kq!7'") == ["aB3`x\"9Kq!7"]
    assert found(r'db_password = "ab\"cd9Kq!7\\" + x') == [r"ab\"cd9Kq!7\\"]
    assert found('db_password = b"aB3x9Kq!7"') == ["aB3x9Kq!7"] and found('db_password = """aB3x"9Kq!7"""') == ['aB3x"9Kq!7']
    assert found('db_password = "aB3x9Kq!7\n') == ["aB3x9Kq!7"]
    for bare in ("P@ssw0rd!2024", "a#B3$x%9&K*q", "pg://u1:Pw9@h"):
        for after in ("", " ", "\n", ", x", ";", ")", '"'):
            assert found(f"DB_PASSWORD={bare}{after}") == [bare]
    assert found("DB_PASSWORD=$k") == [] and found("k=P@ss,\nDB_PASSWORD=k") == [] and found("k=P@ssw0rd!2024\nDB_PASSWORD=$k") == ["P@ssw0rd!2024"]
    assert found("x?auth_token=aB3x9Kq!7&user=1") == ["aB3x9Kq!7"] and found('k="aB3x9Kq!7"\ndb_password=k+"Tr55LmQ2"') == ["aB3x9Kq!7", "Tr55LmQ2"]
    assert secrets.masked("DB_PASSWORD=P@ssw0rd!2024 x") == "DB_PASSWORD=[SECRET] x"


SECRET = "Zx81kQ0vTr55"


@pytest.mark.parametrize(
    "text",
    [
        f"<db><password>{SECRET}</password></db>", f'<c:apiKey enc="no"> {SECRET} </c:apiKey>', f"key:\n  client_secret: |\n    {SECRET}\n\n    other line\nnext: 1", f"- token: >-\n    {SECRET}",
        f"set password {SECRET}", f'setenv DB_PASSWORD "{SECRET}"', f"machine h login me password {SECRET}", f"run --api-key {SECRET} -v", f'conn.setPassword("{SECRET}")', f"conn.set_password( '{SECRET}' )",
        f'p.setProperty("db.password", "{SECRET}")', f"put('apiKey', '{SECRET}')", f'token := fmt.Sprintf("{SECRET}")', f'secret = decode("x", "{SECRET}")', f'k = "{SECRET}"\nclient.setToken(k)', f'# old: password = "{SECRET}"',
    ],
)
def test_secrets_of_other_syntaxes(text):
    assert SECRET in [text[a:b] for k, a, b, _ in secrets.find_secrets(text) if k == "literal"]


def test_secret_syntaxes_take_linear_time():
    began = time.time()
    for piece in ("a", " ", "<a", "<a>", "(", "set ", "-", "'", "a(", "a:\n ", '"', "x.", "a, "):
        secrets.find_secrets("password " + piece * 200_000)
    assert time.time() - began < 40


@pytest.mark.parametrize(
    "text",
    [
        "DB_PASSWORD=$OTHER_VAR1", "password: ${VAULT_PATH_12}", "set PASSWORD %OTHER_VAR1%", f"<colour>{SECRET}</colour>", f"print('{SECRET}')", f'put("colour", "{SECRET}")', f"note: |\n  {SECRET}", f"set colour {SECRET}",
        "the secret of the token is a key to it", "password := read(stdin)", "<password></password>", "set password", "token(",
    ],
)
def test_references_and_other_names_are_no_secrets(text):
    assert [x for x in secrets.find_secrets(text) if x[0] == "literal"] == []


def test_secrets_propagate_all_literals():
    found = lambda t: [t[a:b] for k, a, b, _ in secrets.find_secrets(t) if k == "literal"]
    many = [f"Zx81kQ0v{i:05}" for i in range(3000)]
    assert found("k = " + " + ".join(f'"{x}"' for x in many) + "\ndb_password = k") == many
    assert found('k = "a"\n' + "\n".join(f'k = k + "{x}"' for x in many) + "\nauth = k\ndb_password = k") == many
    assert found('k = "Zx81kQ0vTr55"\n' + "k = k + k\n" * 200 + "db_password = k") == ["Zx81kQ0vTr55"]


def test_secret_heads_equal_the_pattern():
    """Names found backwards from separators are those of one pattern read forwards, in time that follows the text."""
    import time

    head = re.compile(r"""(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_.-]*)(["']?)[ \t]*(?::=|=>|=(?![=])|:)[ \t]*""")
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice(["a", "Z", "9", "_", ".", "-", "=", ":", "=>", ":=", " ", "\t", '"', "'", "\n", "+", "é", "=="]) for _ in range(rng.randint(0, 24)))
        assert list(secrets.heads(t)) == [(m[1], m.end()) for m in head.finditer(t)]
    for unit in ("a.", "a-", "a=", "token=", "a b=", "= a.", "password: "):
        took = []
        for n in (100_000, 400_000):
            start = time.process_time()
            secrets.find_secrets(unit * (n // len(unit)))
            took.append(time.process_time() - start)
        assert took[1] < 5 and (took[1] < 0.3 or took[1] < 12 * took[0]), (unit, took)


def plain_lexer(text):
    """Literals that reach a sensitive name, by scanning for every name anew: slow and simple."""
    quoted = re.compile(r"""(?:[rRbBuUfFL@$]{1,2}(?=["'`]))?(?:"([^"\\\n]*)"|'([^'\\\n]*)')""")
    known, found = {}, set()
    for m in re.finditer(r"""(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_.-]*)["']?[ \t]*(?::=|=>|=(?!=)|:)[ \t]*""", text):
        at, spans = m.end(), set()
        while True:
            q = quoted.match(text, at)
            if q:
                spans.add(q.span(q.lastindex))
                at = q.end()
            else:
                b = re.compile(r"[A-Za-z0-9_]+").match(text, at)
                if not b:
                    break
                if b[0] in known:
                    spans |= known[b[0]]
                elif re.search(r"[0-9]", b[0]):
                    spans.add(b.span())
                at = b.end()
            plus = re.compile(r"""[ \t]*\+[ \t]*(?=["'A-Za-z0-9_])""").match(text, at)
            if not plus:
                break
            at = plus.end()
        if spans:
            known[m[1]] = spans
            if w := secrets.sensitivity(m[1]):
                found |= {s for s in spans if w * secrets.credential_score(text[slice(*s)]) >= secrets.THRESHOLD}
    return sorted(found)


def test_secrets_equal_a_plain_lexer():
    rng = random.Random(12)
    literals = ['"Zx81kQ0vTr55"', "'aB3x9Kq7Lm'", "Tr55LmQ2xx", '"plain words"', "short1", '"aaaaaaaaaa"']
    names = ["k", "a1", "db_password", "authToken", "note", "cfg.secret_key"]
    for _ in range(3000):
        lines = []
        for _ in range(rng.randint(1, 8)):
            terms = [rng.choice([*literals, *["k", "a1", "note"]]) for _ in range(rng.randint(1, 3))]
            lines.append(f"{rng.choice(names)}{rng.choice(['=', ' = ', ': ', ' := ', '=> '])}{' + '.join(terms)}")
        text = rng.choice(["\n", " \n", "\n\n"]).join(lines)
        assert sorted((a, b) for k, a, b, _ in secrets.find_secrets(text) if k == "literal") == plain_lexer(text)


def test_op9_query(spark, doc_dir, rows):
    got = Counter(tuple(r) for r in secrets.op9_secrets(spark, doc_dir).collect())
    want = Counter()
    for r in rows:
        base = brute_base(r.text or "")
        found = [f"{k}:{a}:{b}" for k, a, b, _ in secrets.find_secrets(r.text or "")]
        want[(r.doc_id, *[sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")], sha(",".join(base)), ",".join(found))] += 1
        assert [x for x in found if not x.startswith("literal")] == base
    assert got == want


def test_redaction(spark):
    wide = documents(spark, extra=True).union(documents(spark, n=1, extra=True).limit(1).withColumn("text", F.lit("x password=hunter2hunter2 AKIAABCDEFGHIJKLMN y")).withColumn("doc_id", F.lit(777).cast("long")))
    out = secrets.redact(wide)
    assert out.columns == wide.columns and out.count() == wide.count()
    r = out.where("doc_id = 777").first()
    assert r.text == "x [SECRET] [SECRET] y" and r.n_chars == len(r.text)
    assert out.where("doc_id <> 777 or doc_id is null").exceptAll(wide.where("doc_id <> 777 or doc_id is null")).count() == 0


# 10


def test_licenses(spark, docs):
    apache = "Licensed under the Apache License, Version 2.0"
    texts = [
        "The MIT License; GNU General Public License. mit-license", None, "", "mit license é mit\x01license mitlicense", "nothing here", "filler " * 300 + apache + " filler" * 50,
        "Licensed under the Apache License Version 2.0", "released under the apache license", "Permission is hereby granted free of charge to any person obtaining a copy of this program and associated documentation files", "APACHE LICENSE",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
        assert got[i].n_words == len(ws) and sorted((p.word, p.label) for p in got[i].places) == places
    labels = {i: {b.label for b in r.blocks} for i, r in got.items()}
    assert "apache" in labels[5] and "apache" in labels[6] and labels[7] == set() and labels[8] == set() and labels[4] == set()
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(empty(spark)).count() == 0
    assert licenses.scan_licenses(df, templates=[]).where("size(blocks) > 0").count() == 0


def test_license_bodies_with_changed_words(spark, doc_dir, rows):
    """Any paragraph of a license names it, without its opening, inside other text, with words put in or left out."""
    rng, texts, want = random.Random(2), [], []
    for label, t in licenses.default_templates():
        ws = t.split()
        if len(ws) < 25:
            continue
        edited = [w for i, w in enumerate(ws) if i % 23 != 7]
        for i in range(len(ws) // 20):
            edited.insert(rng.randrange(len(edited)), f"inserted{i}")
        texts.append(" ".join([*["river"] * rng.randint(0, 90), *edited, *["stone"] * rng.randint(0, 90)]))
        want.append(label)
    texts += ["river stone " * 200, " ".join(rng.sample(max(licenses.default_templates(), key=lambda t: len(t[1]))[1].split(), 12))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {b.label for b in r.blocks} for r in licenses.scan_licenses(df).collect()}
    assert all(label in got[i] for i, label in enumerate(want)) and not got[len(want)] and not got[len(want) + 1]


def test_op10_query(spark, doc_dir, rows):
    got = Counter(tuple(r)[:6] for r in licenses.op10_licenses(spark, doc_dir).collect())
    want = Counter()
    for r in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want[(r.doc_id, len(ws), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))] += 1
    assert got == want


def test_license_blocks_are_all_found():
    """Of any length: every run of words that holds enough of the template lies in, or holds, a block that is found; none else is."""
    rng = random.Random(5)
    words = [f"t{i}" for i in range(14)]
    for _ in range(300):
        counts = {w.encode(): rng.randint(0, 50) for w in words}
        template = licenses.TemplateIndex([("x", " ".join(words + words[:3]))], counts, 0.8).templates[0]
        ws = [rng.choice(words if rng.random() < 0.5 else ["o"]).encode() for _ in range(rng.randint(0, 80))]
        enough = lambda i, j: len(set(ws[i:j]) - {b"o"}) >= template.need
        least = [(i, j) for i in range(len(ws)) for j in range(i + 1, len(ws) + 1) if enough(i, j) and not enough(i + 1, j) and not enough(i, j - 1)]
        known = [i for i, w in enumerate(ws) if w != b"o"]
        assert template.least_blocks(licenses.np.array(known, int), licenses.np.array([template.place[ws[i]] for i in known], int)) == least
        found = template.matches(ws, set(ws))
        assert sorted({w for a, b, _, _ in found for w in range(a, b)}) == sorted({w for a, b in least for w in range(a, b)})
        for a, b, share, near in found:
            inner = [j - i for i, j in least if a <= i and j <= b]
            assert share == len(set(ws[a:b]) - {b"o"}) / 14 and near == pytest.approx(min(share, template.need / 14 * 17 / max(17, min(inner))))


def test_license_blocks_with_many_words_put_in(spark):
    """A whole template with a word after each of its own, and one spread over a long text."""
    label, text = max(licenses.default_templates(), key=lambda t: len(t[1]))
    ws = text.split()
    texts = [" ".join(x for w in ws for x in (w, "river")), " ".join(x for w in ws for x in (w, *["stone"] * 50)), " ".join(ws[: len(ws) // 2])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [b for b in r.blocks if b.label == label and b.containment > 0.99] for r in licenses.scan_licenses(df, [(label, text)]).collect()}
    assert len(got[0]) == 1 and 0.4 < got[0][0].closeness < 0.6 and len(got[1]) == 1 and got[1][0].closeness < 0.03 and got[2] == []
    dense = {r.doc_id: len(r.blocks) for r in licenses.scan_licenses(df, [(label, text)], stretch=3.0).collect()}
    assert dense == {0: 1, 1: 0, 2: 0}


# all


def test_very_long_text(spark, library):
    """A text of 200,000 words beside a null and an empty one."""
    ws = [f"w{i % 5000}" for i in range(200_000)]
    ws[1000:1003] = ["Released", "under", "the"]
    text = " ".join(ws[:100_000]) + "\n" + " ".join(ws[100_000:]) + "\ndb_password = 'aB3x9Kq!7zz'"
    df = spark.createDataFrame([(1, text, "s"), (2, None, "s"), (3, "", None)], "doc_id long, text string, source string")
    n = len(text.split())
    assert {r.doc_id: r.size for r in mixing.mix(df).collect()} == {1: n, 2: 0, 3: 0}
    grams = Counter(zip(text.split(), text.split()[1:], text.split()[2:]))
    covered = {j for i in range(n - 2) if grams[tuple(text.split()[i : i + 3])] > 1 for j in (i, i + 1, i + 2)} if n < 10 else None
    q = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert q[1].n_words == n and 195_000 < q[1].n_repeat_words < n and covered is None and not q[1].kept and q[2].n_words == 0
    assert {r.doc_id: r.n_shingles for r in ngram_join.similar_components(df).collect()} == {1: len(set(zip(text.split(), text.split()[1:], text.split()[2:], text.split()[3:]))), 2: 0, 3: 0}
    scored = {r.doc_id: r for r in maxent.score_documents(df).collect()}
    assert scored[1].n_tokens == n + 1 and scored[1].score < 0 and math.isfinite(scored[1].score)
    assert {r.doc_id: r.n_words for r in licenses.scan_licenses(df).collect()} == {1: len(licenses.license_words(text)), 2: 0, 3: 0}
    assert [text[f.start : f.end] for r in secrets.scan_secrets(df).collect() for f in r.findings] == ["aB3x9Kq!7zz"]
    assert {r.doc_id: r.n_tokens for r in bpe.bpe_digests(df).collect()} == {1: len(library.encode(text, add_special_tokens=False).ids), 2: 0, 3: 0}


def test_empty_tables_and_clashing_names(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    clash = {"key": 1, "v": 2, "cb": 3, "qb": 4, "least": 5, "file": 6, "part": 7, "slot": 8, "position": 9, "record": 10, "score": 11}
    named = lambda df: df.withColumns({k: F.lit(x) for k, x in clash.items()})
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0])], "vec_id long, embedding array<double>")
    named(vectors).write.parquet(str(tmp_path / "embeddings.parquet"))
    pages = spark.createDataFrame([(i, f"u{i}", "<p>") for i in range(600)], "page_id long, url string, html string")
    named(pages).write.parquet(str(tmp_path / "pages.parquet"))
    for name in ("op1_bpe", "op2_sharding", "op3_ngram_join", "op4_mixing", "op7_quality", "op8_maxent", "op9_secrets", "op10_licenses"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0, name
    assert [(r.query_id, r.rank, r.vec_id) for r in topk.op5_topk(spark, str(tmp_path)).orderBy("rank").collect()] == [(0, 1, 7), (0, 2, 7)]
    status = Counter(r.status for r in fixity.op6_fixity(spark, str(tmp_path)).collect())
    assert status["missing"] == 2 and status["surplus"] == 2 and status["changed"] == 7
