import hashlib
import math
import random
import re
from collections import Counter

import duckdb

import corpus_pipeline
from marlstone.llm import mixing, quality, secrets
from tests.llm.cases import documents, empty, prose
from tests.llm.test_ops import brute_kept, library  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(rows):
    """The rows that the rules keep, without their frequent lines: (doc_id, text, n_chars)."""
    lines = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    normal = lambda x: " ".join(WORD.findall(x)).lower()
    hosts, held = {}, {}
    for i, r in enumerate(rows):
        key = ("row", i) if r.doc_id is None else r.doc_id
        hosts.setdefault(r.source, set()).add(key)
        for x in set(map(normal, lines(r.text))):
            held.setdefault((r.source, x), set()).add(key)
    often = {k for k, ids in held.items() if len(ids) > max(quality.MIN_DOCS, quality.MAX_SHARE * len(hosts[k[0]]))}
    out = Counter()
    for r in rows:
        ws = WORD.findall(r.text or "")
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        again = {j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        gone = sum(len(WORD.findall(x)) for x in lines(r.text) if (r.source, normal(x)) in often)
        if len(ws) < quality.MIN_WORDS or 100 * len(again) > 50 * len(ws) or len(ws) - gone < quality.MIN_LEFT * len(ws):
            continue
        text = "\n".join(x for x in r.text.split("\n") if not WORD.search(x) or (r.source, normal(x)) not in often)
        out[(r.doc_id, text, r.n_chars if text == r.text else len(text))] += 1
    return out


def plain_mixing(rows):
    """Rows by the takes of the SQL, rounded to whole texts."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in rows])
    taken = {d: (size, n) for d, size, n in con.sql(f"WITH {mixing.MIXED_SQL} SELECT doc_id, size, taken FROM mixed").fetchall()}
    out = Counter()
    for r in rows:
        size, n = taken[r.doc_id]
        if size and math.floor(n / size + 0.5):
            out[(r.doc_id, r.text)] += math.floor(n / size + 0.5)
    return out


def test_stages(spark, library):  # noqa: F811
    menu = spark.createDataFrame([(1000 + i, f"Home  Menu of{i % 7}\n{prose(random.Random(i), 80)}\nhome menu OF{i % 7}", "en", "b", 1) for i in range(60)], documents(spark, n=1).schema)
    docs = documents(spark, n=40).union(menu)  # with lines that many documents of a host share
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, "").cache()
        seen[name] = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            kept = out
    names = [n for n, _ in corpus_pipeline.STAGES]
    good, single, masked, mixed, coded = (seen[n] for n in names)
    assert Counter((r.doc_id, r.text, r.n_chars) for r in good) == plain_quality(docs.collect()) and 0 < len(good) < docs.count()
    assert Counter(r.doc_id for r in single) == brute_kept(good)
    assert Counter((r.doc_id, r.text) for r in masked) == Counter((r.doc_id, secrets.masked(r.text)) for r in single)
    assert Counter((r.doc_id, r.text) for r in mixed) == plain_mixing(masked)
    want = Counter()
    for r in mixed:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded) == want


def test_stages_on_nothing_and_on_extra_columns(spark):
    kept = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "")
        assert kept.count() == 0
    wide = documents(spark, n=10, extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns
        wide = out
