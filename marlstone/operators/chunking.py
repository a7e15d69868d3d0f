"""Packing paragraphs into chunks. Packing is sequential inside a document and parallel over documents."""

from __future__ import annotations

import traceback
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.config import ExtractionConfig
from marlstone.functions.text import chunk_id, count_tokens


def pack(sizes: Iterable[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges (start, end exclusive) of paragraphs: a group closes before it would exceed the limit, and the next
    begins with its longest suffix of whole paragraphs within the overlap."""
    out, held, start = [], 0, 0
    sizes = list(sizes)
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            out.append((start, i))
            start, held = i, 0
            while start > out[-1][0] and held + sizes[start - 1] <= overlap:
                start -= 1
                held += sizes[start]
        held += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def packed_ranges(docs: DataFrame, id_col: str, sizes_col: str, limit: int, overlap: int) -> DataFrame:
    """``id, group_no, start, end`` from a column of token counts; one row per group, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, g, *r) for k, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for g, r in enumerate(pack(sizes or [], limit, overlap))]
            columns = zip(*rows) if rows else ([], [], [], [])
            kinds = (b.schema.types[0], pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["id", "group_no", "start", "end"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), sizes_col).mapInArrow(run, f"id {kind}, group_no int, start int, end int")


def packed_texts(docs: DataFrame, id_col: str, paragraphs_col: str, limit: int, overlap: int, separator: str = "\n\n") -> DataFrame:
    """``id, group_no, first, last, text, n_tokens`` from a column of paragraph texts, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                rows = []
                for k, texts, sizes in zip(*(part.column(i).to_pylist() for i in range(3))):
                    rows += [(k, g, s, e - 1, separator.join(texts[s:e])) for g, (s, e) in enumerate(pack(sizes or [], limit, overlap))]
                columns = zip(*rows) if rows else ([], [], [], [], [])
                kinds = (b.schema.types[0], pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["id", "group_no", "first", "last", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    sizes = F.transform(F.col(paragraphs_col), count_tokens)
    made = docs.select(F.col(id_col).alias("id"), F.col(paragraphs_col), sizes.alias("sizes")).mapInArrow(run, f"id {kind}, group_no int, first int, last int, text string")
    return made.withColumn("n_tokens", count_tokens(F.col("text")))


@dataclass
class Draft:
    """A chunk while its document is folded: texts joined by blank lines, whose tokens add up."""

    chunk_type: str
    texts: list[str]
    n_tokens: int
    page_start: int
    page_end: int
    section: str | None
    section_id: str | None

    def attach(self, group: list[dict], n_tokens: int) -> None:
        self.texts += [p["text"] for p in group]
        self.n_tokens += n_tokens
        self.page_end = group[-1]["page"]

    def row(self) -> dict:
        return {**{k: v for k, v in vars(self).items() if k != "texts"}, "text": "\n\n".join(self.texts)}


def _tokens(text: str | None) -> int:
    return len((text or "").split())


def settle(run: list[dict], chunks: list[Draft], last: bool, config: ExtractionConfig) -> list[dict]:
    """Adds the chunks of one run of paragraphs; returns the paragraphs that wait for the next run.

    A group that is large enough is a chunk, and a small one joins the narrative chunk before it. So only the head of a
    run needs care, where no such chunk stands before: it is the shortest row of groups that is large enough together.
    Where there is none, all of them wait, or are one chunk at the end of the document."""
    sizes = [_tokens(p["text"]) for p in run]
    groups = [(run[s:e], sum(sizes[s:e])) for s, e in pack(sizes, config.chunk_size, config.chunk_overlap)]
    if groups and not (chunks and chunks[-1].chunk_type == "narrative"):
        sums = list(accumulate(n for _, n in groups))
        k = next((i for i, n in enumerate(sums) if n >= config.min_chunk_tokens), len(groups) - 1)
        head = [p for g, _ in groups[: k + 1] for p in g]
        if sums[k] < config.min_chunk_tokens and not last:
            return head
        named = groups[k][0][0]
        chunks.append(Draft("narrative", [p["text"] for p in head], sums[k], head[0]["page"], head[-1]["page"], named["section"], named["section_id"]))
        groups = groups[k + 1 :]
    for group, n in groups:
        if n < config.min_chunk_tokens:
            chunks[-1].attach(group, n)
        else:
            chunks.append(Draft("narrative", [p["text"] for p in group], n, group[0]["page"], group[-1]["page"], group[0]["section"], group[0]["section_id"]))
    return []


class Fold:
    """A document's chunks from its events in their order: ``para`` (text, page, section, section_id), ``flush`` (a changed heading),
    ``table`` (n chunks with its text). Paragraphs that wait are put before those of the next run.

    The last chunk may still grow, so ``taken`` gives all others; what stays is that chunk and the paragraphs of one run, and can be
    kept as JSON between arrivals of the document's events."""

    def __init__(self, config: ExtractionConfig, state: dict | None = None):
        state = state or {"chunks": [], "waiting": [], "run": [], "index": 0}
        self.config, self.waiting, self.run, self.index = config, state["waiting"], state["run"], state["index"]
        self.chunks = [Draft(**c) for c in state["chunks"]]

    def state(self) -> dict:
        return {"chunks": [vars(c) for c in self.chunks], "waiting": self.waiting, "run": self.run, "index": self.index}

    def feed(self, events: Iterable[dict]) -> None:
        for e in events:
            if e["kind"] == "para":
                self.run.append(e)
                continue
            self._settle(False)
            if e["kind"] == "table":
                made = (e["text"] or "", _tokens(e["text"]), e["page"])
                self.chunks += [Draft("table", [made[0]], made[1], made[2], made[2], e["section"], e["section_id"]) for _ in range(e["n"] or 0)]

    def _settle(self, last: bool) -> None:
        self.waiting = settle(self.waiting + self.run, self.chunks, last, self.config)
        self.run = []

    def finish(self) -> None:
        """The document has no more events."""
        self._settle(True)

    def taken(self, last: bool = False) -> list[dict]:
        """The chunks that won't change any more, once each, with their index."""
        n = len(self.chunks) if last else max(0, len(self.chunks) - 1)
        out = [{"chunk_index": self.index + i, **c.row()} for i, c in enumerate(self.chunks[:n])]
        self.chunks, self.index = self.chunks[n:], self.index + n
        return out


def flush_events(events: list[dict], config: ExtractionConfig) -> list[dict]:
    """Chunks of one whole document."""
    fold = Fold(config)
    fold.feed(events)
    fold.finish()
    return fold.taken(last=True)


EVENT = "struct<kind:string,page:int,section:string,section_id:string,text:string,n:int>"
_CHUNK = "chunk_index int, chunk_type string, page_start int, page_end int, section string, section_id string, text string, n_tokens int"


def linked_chunks(key: object, chunks: list[dict]) -> list[dict]:
    """The chunks of a whole document with their neighbours' ids, and the number of each table chunk among these as ``k``."""
    ids = [f"{key}__p{c['page_start']:04d}__c{c['chunk_index']:04d}" for c in chunks]
    k = accumulate(int(c["chunk_type"] == "table") for c in chunks)
    return [{**c, "prev_chunk_id": a, "next_chunk_id": b, "k": n if c["chunk_type"] == "table" else None} for c, a, b, n in zip(chunks, [None, *ids], [*ids[1:], None], k)]


def flush_chunks(docs: DataFrame, doc: str, events: str, config: ExtractionConfig = ExtractionConfig(), errors: bool = False, keep: tuple[str, ...] = (), linked: bool = False) -> DataFrame:
    """Chunks of documents given as one ordered array of events each (no shuffle, a document is one row). ``keep`` names columns of the document that
    its chunks get, and with ``linked`` they have those of ``linked_chunks``.

    With ``errors`` a document that fails gives one row with its traceback in the column ``error`` and no chunk, and the others
    go on; without it the failure is raised."""
    more = ", prev_chunk_id string, next_chunk_id string, k int" if linked else ""
    names = [c.split()[0] for c in (_CHUNK + more).split(", ")]

    def folded(key: object, found: list[dict] | None) -> list[dict]:
        try:
            made = flush_events(found or [], config)
            return linked_chunks(key, made) if linked else made
        except Exception:
            if not errors:
                raise
            return [{"error": traceback.format_exc(limit=3)}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), *[pa.string(), pa.string(), pa.int32()][: 3 * linked]]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [(i, c) for i, (key, found) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())) for c in folded(key, found)]
                of = pa.array([i for i, _ in rows], pa.int32())
                columns = [part.column(0).take(of)] + [pa.array([r.get(n) for _, r in rows], t) for n, t in zip([*names, "error"], [*kinds, pa.string()])]
                yield pa.RecordBatch.from_arrays([*columns, *[part.column(c).take(of) for c in keep]], names=[doc, *names, "error", *keep])

    kind = docs.schema[doc].dataType.simpleString()
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    made = docs.select(doc, events, *keep).mapInArrow(run, f"{doc} {kind}, {_CHUNK}{more}, error string{kept}")
    named = made.withColumn("chunk_id", F.when(F.col("error").isNull(), chunk_id(F.col(doc).cast("string"), F.col("page_start"), F.col("chunk_index"))))
    return named if errors else named.drop("error")


def link_neighbors(chunks: DataFrame, doc: str = "doc_name", index: str = "chunk_index", key: str = "chunk_id") -> DataFrame:
    """Adds ``prev_chunk_id`` and ``next_chunk_id``; null at the ends of a document."""
    w = Window.partitionBy(doc).orderBy(index)
    return chunks.withColumn("prev_chunk_id", F.lag(key).over(w)).withColumn("next_chunk_id", F.lead(key).over(w))


def number_tables(tables: DataFrame, doc: str, order: list[str]) -> Column:
    """1-based number of each table of a document, used up even where a table gives no chunk."""
    return F.row_number().over(Window.partitionBy(doc).orderBy(*order))
