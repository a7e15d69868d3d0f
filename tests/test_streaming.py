import random

from marlstone.config import ExtractionConfig
from marlstone.operators.chunking import flush_events
from marlstone.streaming.fold import EVENT_ROW, advance, follow_events
from marlstone.streaming.ingest import chunk_documents, ingest


def test_arrivals_once(spark, tmp_path):
    arrivals, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    first = spark.createDataFrame([(1, "a b\nc d"), (2, None), (1, "a b\nc d")], "doc_id long, text string").coalesce(1)
    first.write.parquet(arrivals)
    for _ in range(2):  # a second start finds nothing new
        ingest(spark, arrivals, first.schema, out, mark).awaitTermination(120)
    assert [(r.doc_id, r.text, r.n_tokens) for r in spark.read.parquet(out).collect()] == [(1, "a b\n\nc d", 4)]
    spark.createDataFrame([(3, "e")], "doc_id long, text string").write.mode("append").parquet(arrivals)
    ingest(spark, arrivals, first.schema, out, mark).awaitTermination(120)
    got = {(r.doc_id, r.text) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "a b\n\nc d"), (3, "e")}
    batch = chunk_documents(spark.read.parquet(arrivals).distinct())
    assert {(r.doc_id, r.text) for r in batch.collect()} == got


def events_of(rng, n):
    out = []
    for _ in range(n):
        kind = rng.choice(["para"] * 6 + ["flush", "table"])
        text = " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 40))) if kind != "flush" else None
        section = rng.choice(["A", "B", None])
        out.append({"kind": kind, "page": len(out) // 5, "section": section, "section_id": section and section.lower(), "text": text, "n": rng.randint(1, 2) if kind == "table" else 0})
    return out


def test_fold_in_any_split():
    """However a document's events are cut into arrivals, with repeats, the chunks are those of one run."""
    config = ExtractionConfig(chunk_size=60, chunk_overlap=10, min_chunk_tokens=25)
    rng = random.Random(6)
    for _ in range(150):
        events = events_of(rng, rng.randint(0, 60))
        want = flush_events(events, config)
        rows = [{"doc_name": "d", "seq": i, **e} for i, e in enumerate(events)] + [{"doc_name": "d", "seq": len(events), "kind": "end", "page": None, "section": None, "section_id": None, "text": None, "n": None}]
        kept, got, at = None, [], 0
        while at < len(rows):
            k = rng.randint(1, 12)
            out, kept = advance("d", rows[max(0, at - rng.randint(0, 3)) : at + k], kept, config)
            got, at = got + out, at + k
        assert kept is None and [{k: c[k] for k in want[0]} for c in got] == want if want else got == []
        names = [c["chunk_id"] for c in got]
        assert [c["prev_chunk_id"] for c in got] == [None, *names][: len(got)] and [c["next_chunk_id"] for c in got] == [*names[1:], None][: len(got)]


def test_stream_of_events(spark, tmp_path):
    """Arrivals in several files and two runs give the chunks of one batch."""
    config = ExtractionConfig(chunk_size=60, chunk_overlap=10, min_chunk_tokens=25)
    rng = random.Random(8)
    docs = {f"d{i}": events_of(rng, 40) for i in range(5)}
    rows = [(d, i, *(e[k] for k in ("kind", "page", "section", "section_id", "text", "n"))) for d, es in docs.items() for i, e in enumerate(es)]
    rows += [(d, len(es), "end", None, None, None, None, None) for d, es in docs.items()]
    where = [str(tmp_path / x) for x in ("in", "out", "mark")]
    for cut in (15, 41):
        part = [r for r in rows if (r[1] < 15) == (cut == 15)]
        spark.createDataFrame(part, EVENT_ROW).coalesce(1).write.mode("append").parquet(where[0])
        follow_events(spark, *where, config).awaitTermination(180)
    got = {}
    for r in spark.read.parquet(where[1]).orderBy("doc_name", "chunk_index").collect():
        got.setdefault(r.doc_name, []).append((r.chunk_index, r.chunk_type, r.page_start, r.page_end, r.section, r.text, r.n_tokens))
    want = {d: [(c["chunk_index"], c["chunk_type"], c["page_start"], c["page_end"], c["section"], c["text"], c["n_tokens"]) for c in flush_events(es, config)] for d, es in docs.items()}
    assert got == want
