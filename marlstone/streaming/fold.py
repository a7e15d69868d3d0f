"""Chunks of documents whose events keep arriving (an extension): the fold of a document waits in the state store between arrivals."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.config import ExtractionConfig
from marlstone.operators.chunking import EVENT, Fold

#: A row of the stream: a document's events are numbered; ``end`` is the kind of its last one.
EVENT_ROW = "doc_name string, seq long, " + EVENT[len("struct<") : -1].replace(":", " ").replace(",", ", ")
CHUNK_ROW = (
    "doc_name string, chunk_index int, chunk_id string, prev_chunk_id string, next_chunk_id string, chunk_type string, page_start int, page_end int, section string, section_id string, text string, n_tokens int"
)


def _named(doc: str, page: int, index: int) -> str:
    return f"{doc}__p{page:04d}__c{index:04d}"


def advance(doc: str, rows: list[dict], kept: str | None, config: ExtractionConfig) -> tuple[list[dict], str | None]:
    """Feeds a document's new events to its fold: the chunks that are settled now, with the names of their neighbours, and the state to
    keep (None after the end). Events whose number was seen are left out, so a batch that is run again changes nothing."""
    state = json.loads(kept) if kept else {"fold": None, "seen": -1, "before": None}
    fold, seen = Fold(config, state["fold"]), state["seen"]
    new = [e for e in sorted(rows, key=lambda e: e["seq"]) if e["seq"] > seen]
    ended = any(e["kind"] == "end" for e in new)
    fold.feed({k: v for k, v in e.items() if k not in ("doc_name", "seq")} for e in new if e["kind"] != "end")
    if ended:
        fold.finish()
    out, before = fold.taken(last=ended), state["before"]
    for c in out:
        c.update(doc_name=doc, chunk_id=_named(doc, c["page_start"], c["chunk_index"]), prev_chunk_id=before, next_chunk_id=None)
        before = c["chunk_id"]
    names = [c["chunk_id"] for c in out] + [_named(doc, c.page_start, fold.index) for c in fold.chunks[:1]]
    for c, after in zip(out, names[1:]):
        c["next_chunk_id"] = after
    last = max((e["seq"] for e in new), default=seen)
    return out, None if ended else json.dumps({"fold": fold.state(), "seen": last, "before": before})


def stream_chunks(events: DataFrame, config: ExtractionConfig = ExtractionConfig()) -> DataFrame:
    """A stream of chunks (``CHUNK_ROW``) from a stream of events (``EVENT_ROW``), each emitted once when nothing can change it. A document's
    events may be spread over arrivals in any way that keeps their order. The state of a document is its last chunk and the paragraphs of one
    run, until its ``end``; documents are dealt to tasks by name."""
    import pandas as pd

    names = [c.split()[0] for c in CHUNK_ROW.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b.astype(object).where(b.notna(), None).to_dict("records")]
        for r in rows:
            r["page"], r["n"] = (None if r[c] is None else int(r[c]) for c in ("page", "n"))
        out, kept = advance(key[0], rows, state.get[0] if state.exists else None, config)
        if kept is None:
            state.remove()
        else:
            state.update((kept,))
        yield pd.DataFrame([[c[n] for n in names] for c in out], columns=names)

    return events.groupBy("doc_name").applyInPandasWithState(step, CHUNK_ROW, "fold string", "append", GroupStateTimeout.NoTimeout)


def follow_events(spark: SparkSession, arrivals: str, out: str, checkpoint: str, config: ExtractionConfig = ExtractionConfig(), files_per_batch: int = 1000):
    """Follows a folder of Parquet files of events and appends their chunks; stops when all that is there has been read."""
    stream = spark.readStream.schema(EVENT_ROW).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
    writer = stream_chunks(stream, config).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
