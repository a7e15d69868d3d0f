"""Chat formatting, centroid clustering and vector codes against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat, popcount, vector_codes
from marlstone.llm.common import LONG_MAX

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\/s>", "[\\INST]", "<\\\\/s>", "<", "\\", "[", "s>", "/", "ok", "\n", " ", "é", "🙂", "$1", "%"]
CHAT = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chatter(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", None, "", "<</SYS>>\n"])
            rows.append((c, t, role, "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 12)))))
    rows += [(c, t, "assistant", None) for c, t in ((0, 20), (0, 20), (0, None), (None, 1), (None, None))]
    rows += [(n, t, "user" if t % 2 else "assistant", f"turn {t} </s>") for t in range(100)] + [(n + 1, 0, "user", "x" * 300_000), (n + 1, 1, "assistant", "[INST]" * 50_000)]
    return rows


def plain_escape(text):
    return re.sub(r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)", lambda m: m[1] + "\\" + m[2] + m[3] if (m[1] == "[") == m[3].endswith("]") else m[0], text)


def plain_chat(rows):
    of = {}
    for c, t, role, text in rows:
        of.setdefault(c, []).append((t is None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    out = Counter()
    for c, turns in of.items():
        turns.sort()
        whole, examples = "", []
        for i, (_, _, role, _, text) in enumerate(turns):
            whole += "<s>" + {"user": "[INST]", "assistant": "[/INST]", "system": "<<SYS>>"}.get(role, f"<<SYS>>{plain_escape(role)}<</SYS>>") + "\n" + plain_escape(text) + "</s>"
            if role == "assistant" or i == len(turns) - 1:
                examples.append((whole, role == "assistant"))
        loss = "".join(t[4] for t in turns if t[2] == "assistant")
        out[(c, len(turns), sha("".join(f"{t[2]}\n{t[4]}\n" for t in turns)), len(loss), sha(loss), sum(len(w) for w, _ in examples), sum(t for _, t in examples))] += 1
    return out


def plain_examples(rows):
    of, out = {}, Counter()
    for c, t, role, text in rows:
        of.setdefault(c, []).append((t is None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    for c, turns in of.items():
        text = ""
        for i, (_, _, role, _, said) in enumerate(sorted(turns)):
            text += "<s>" + {"user": "[INST]", "assistant": "[/INST]", "system": "<<SYS>>"}.get(role, f"<<SYS>>{plain_escape(role)}<</SYS>>") + "\n"
            if role == "assistant":
                out[(c, text, plain_escape(said) + "</s>", plain_escape(said), True)] += 1
            text += plain_escape(said) + "</s>"
            if role != "assistant" and i == len(turns) - 1:
                out[(c, text, None, False, True)] += 1
    return out


@pytest.mark.parametrize("block", [chat.BLOCK_TURNS, 7, 1])
def test_chat(spark, block):
    rows = chatter(random.Random(4), 40)
    df = spark.createDataFrame(rows, CHAT).repartition(3).withColumns({"place": F.lit(1), "no": F.lit("x"), "segment": F.lit(2), "block": F.lit(3)})
    assert Counter(tuple(r) for r in chat.conversation_digests(df, block).collect()) == plain_chat(rows)


def test_chat_escapes_are_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).select("*", chat.unescaped(F.col("e")).alias("u")).collect()
    for r in rows:
        assert r.e == plain_escape(r.t) and r.u == r.t and not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", r.e)


def test_chat_hot_conversation_is_cut(spark):
    """One conversation of 6,000 turns, all of one number: blocks stay small, and equal rows too."""
    df = spark.range(6000).select(F.lit(5).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    whole, cut = chat.formatted_blocks(chat.segments(df), 500)
    sizes = [r.n for r in chat.block_turns(cut).groupBy("block").agg(F.count("*").alias("n")).collect()]
    assert whole.count() == 0 and sum(sizes) == 6000 and max(sizes) <= 500
    assert [(r.n_turns, r.turns_sha256) for r in chat.conversation_digests(df, 500).collect()] == [(6000, sha("user\nsame\n" * 6000))]


def test_chat_examples_written_out(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e"), (2, 0, "user", "alone")]
    whole, _ = chat.formatted_blocks(chat.segments(spark.createDataFrame(rows, CHAT)))
    got = {(r.conv_id, r.no): (r.context, r.reply, r.trained) for r in chat.example_texts(whole).collect()}
    first = "<s>[INST]\na</s><s>[/INST]\n"
    second = first + "b<\\/s></s><s>[INST]\nc</s><s>[/INST]\n"
    assert got == {
        (1, 1): (first, "b<\\/s></s>", True), (1, 3): (second, "d</s>", True), (1, 4): (second + "d</s><s>[INST]\ne</s>", None, False), (2, 0): ("<s>[INST]\nalone</s>", None, False),
    }


@pytest.mark.parametrize("block", [chat.BLOCK_TURNS, 3])
def test_chat_is_expanded_into_prefixes_and_targets(spark, block):
    """Every example has its prefix, its target and a mask over the reply, as a plain formatter writes them; a block's prefix begins behind the blocks before."""
    rows = [r for r in chatter(random.Random(8), 25) if r[0] is None or r[0] < 25]
    whole, cut = chat.formatted_blocks(chat.segments(spark.createDataFrame(rows, CHAT).repartition(3)), block)
    got, earlier = Counter(), {}
    for blocks, is_cut in ((whole, False), *([(cut, True)] if cut else [])):
        texts = blocks.collect()
        for r in texts:
            earlier[(r.conv_id, r.block)] = "".join(x.formatted for x in sorted(texts, key=lambda x: x.block) if x.conv_id == r.conv_id and x.block < r.block)
        for r in chat.turn_examples(blocks, is_cut).where("is_example").collect():
            front = earlier[(r.conv_id, r.block)]
            assert r.before == len(front)
            text = front + r.prefix + (r.target or "")
            got[(r.conv_id, front + r.prefix, r.target, r.trained and text[r.loss_start : r.loss_end], r.chars == len(text))] += 1
    assert got == plain_examples(rows)


def test_chat_digest_is_read_under_the_mask(spark):
    """Another target under the mask gives another digest: the turns' own texts are not read for it."""
    whole, _ = chat.formatted_blocks(chat.segments(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b</s>")], CHAT)))
    examples = chat.turn_examples(whole)
    assert [r.loss for r in chat._told(examples).collect()] == ["b</s>"]
    assert [r.loss for r in chat._told(examples.withColumn("target", F.translate("target", "b", "c"))).collect()] == ["c</s>"]


def test_chat_query_has_the_probe(spark, sf_dir, tmp_path):
    r = chat.op11_chat(spark, sf_dir).where("conv_id = -1").first()
    assert (r.n_turns, r.turns_sha256, r.loss_sha256) == (2, sha(f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n"), sha(chat.PROBE))
    spark.createDataFrame([], CHAT).write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.conv_id for r in chat.op11_chat(spark, str(tmp_path)).collect()] == [-1]


# 12

FIRST = "vec_id long, embedding array<double>, label int, cluster int, planes int, mark int, error int"


def table(spark, path, rows, types=FIRST):
    spark.createDataFrame([(*r, *[1] * (types.count(",") + 1 - len(r))) for r in rows], types).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def vectors(rng, n, spread=0.2):
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, spread, 64)], int(rng.integers(3))) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[5][1], None), (None, rows[6][1], None), (3, rows[7][1], 1), (n, None, 1), (n + 1, [1.0] * 63 + [None], 1), (n + 2, [0.1] * 63 + [float("nan")], 1)]
    return rows + [(n + 3, [float("inf")] * 64, 1), (n + 4, [0.0] * 64, None)]


def whole(v, scale):
    return tuple(int(np.floor(x)) if abs(x) < 2**60 else int(x) for x in (y * scale for y in v))


def finite_rows(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]


def plain_clusters(rows):
    kept = [(r[0], r[1], whole(r[1], 64)) for r in finite_rows(rows) if len(r[1]) == 64]
    first = sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:16]
    centroids = [list(r[2]) for r in first]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for k in range(4):
        found = [min((far(v, c), i) for i, c in enumerate(centroids)) for _, _, v in kept]
        for i in range(len(centroids) if k < 3 else 0):
            mine = [v for (_, _, v), f in zip(kept, found) if f[1] == i]
            if mine:
                centroids[i] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = Counter()
    for d, c in found:
        inertia[c] += d
    end = lambda x: min(x, LONG_MAX)
    return Counter(
        (i, c, end(d), end(inertia[c]), end(sum(inertia.values())), sha(",".join(map(str, centroids[c])))) for (i, _, _), (d, c) in zip(kept, found)
    )


@pytest.mark.parametrize("n,spread", [(150, 0.2), (8, 0.2), (60, 1e5)])
def test_clusters(spark, tmp_path, n, spread):
    rows = vectors(np.random.default_rng(n), n, spread) + [(900, [0.5] * 7, 1), (901, [], 2)]
    got = popcount.op12_popcount(spark, table(spark, tmp_path, rows)).collect()
    assert Counter(tuple(r) for r in got) == plain_clusters(rows)


def test_clusters_of_very_large_components(spark, tmp_path):
    """A few vectors beyond 64 bits beside usual ones: sums are exact, centroids too; distances end at the end of long."""
    rng = np.random.default_rng(8)
    rows = vectors(rng, 30)[:30] + [(100 + i, [float(x) for x in rng.normal(0, 10.0 ** (4 + 3 * i), 64)], 1) for i in range(5)]
    assert Counter(tuple(r) for r in popcount.op12_popcount(spark, table(spark, tmp_path, rows)).collect()) == plain_clusters(rows)


def test_planes_give_dot_products():
    rng = np.random.default_rng(2)
    for top in (1, 3, 100, 1 << 26, 1 << 40):
        a, b = rng.integers(-top, top + 1, (20, 64)), rng.integers(-top, top + 1, (7, 64))
        want = a.astype(object) @ b.T.astype(object)
        assert (popcount.dots(popcount.pack(a), popcount.pack(b)) == want).all()
        assert (popcount.squares(popcount.pack(a)) == (a.astype(object) ** 2).sum(axis=1)).all()
        assert popcount.plane_sums(popcount.pack(a)) == a.sum(axis=0).tolist()


@pytest.mark.parametrize("query", [popcount.op12_popcount, vector_codes.op13_vector_codes])
def test_no_vectors(spark, tmp_path, query):
    assert query(spark, table(spark, tmp_path / "a", [])).count() == 0
    assert query(spark, table(spark, tmp_path / "b", [(1, None, 1), (2, [float("nan")], None)])).count() == 0


# 13


def plain_codes(rows, parts=16, entries=64):
    kept = finite_rows(rows)
    length = -(-max(max(len(r[1]) for r in kept), 1) // parts) * parts
    cut = lambda v: [v[i : i + length // parts] for i in range(0, length, length // parts)]
    data = [(r[0], r[2], cut(whole([*r[1], *[0.0] * (length - len(r[1]))], 256)), r[1]) for r in kept]
    first = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[list(r[2][p]) for r in first] for p in range(parts)]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for k in range(3):
        found = [[min((far(r[2][p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for r in data]
        for p in range(parts if k < 2 else 0):
            for i in range(len(books[p])):
                mine = [r[2][p] for r, f in zip(data, found) if f[p][1] == i]
                if mine:
                    books[p][i] = [sum(x) // len(mine) for x in zip(*mine)]
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    errors = [min(sum(d for d, _ in f), LONG_MAX) for f in found]
    by_label = Counter()
    for r, e in zip(data, errors):
        by_label[r[1]] += e
    return Counter((r[0], "".join(f"{i:02x}" for _, i in f), e, min(by_label[r[1]], LONG_MAX), digest) for r, f, e in zip(data, found, errors))


@pytest.mark.parametrize("n,spread", [(200, 0.2), (10, 0.2), (70, 1e5)])
def test_codes(spark, tmp_path, monkeypatch, n, spread):
    monkeypatch.setattr(vector_codes, "CHUNK_VALUES", 64 * 70)
    rows = vectors(np.random.default_rng(n), n, spread)
    assert Counter(tuple(r) for r in vector_codes.op13_vector_codes(spark, table(spark, tmp_path, rows)).collect()) == plain_codes(rows)


def test_codes_of_other_lengths_and_large_components(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, rng.integers(0, 20))], None) for i in range(90)] + [(200, [1e30, -1e200, 5.0], 1), (201, [2.0**45] * 17, 1), (-5, [-(2.0**45)] * 3, 1)]
    assert Counter(tuple(r) for r in vector_codes.op13_vector_codes(spark, table(spark, tmp_path, rows)).collect()) == plain_codes(rows)


def test_shortlists_hold_the_nearest_and_hilbert_order_is_a_curve():
    rng = np.random.default_rng(7)
    for d in (1, 2, 4, 9):
        parts = rng.integers(-60, 60, (1000, d))
        books = rng.integers(-60, 60, (64, d))
        b = vector_codes.Blocks.cut(parts[vector_codes.hilbert_order(parts)])
        code, length = b.nearest(books)
        want = ((b.parts[:, None] - books[None]) ** 2).sum(axis=2)
        assert (code == want.argmin(axis=1)).all() and (b.errors(books, code) == want.min(axis=1)).all()
        assert d > 2 or length.mean() < 20
    grid = np.stack(np.meshgrid(range(16), range(16), indexing="ij"), axis=2).reshape(-1, 2)
    walked = grid[vector_codes.hilbert_order(grid)]
    assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()
