"""License scans as an exact set-similarity join of text blocks with license templates.

Templates are the paragraphs of whole license texts (the files of ``license_texts``; of a paragraph of few words, together
with the next) and statements that name a license. A block is a run of consecutive words; it matches a template when it
holds at least ``THRESHOLD`` of the template's distinct words, however many other words stand between them. The join is exact:

* *order*: the template words are counted over all documents and ordered, rarest first;
* *prefix filter*: a matching block holds one of the first ``|T| - ceil(t |T|) + 1`` words of its template; an inverted index
  from these words to templates names the few that a document can match;
* *length filter*: the document has as many words, and as many of the template's words, as are needed;
* *positional filter*: with its rarest prefix word at place i of the order, a document can hold at most
  ``|T| - i`` of them, which must be enough;
* in what survives, one pass over the places of the template's words gives all *least* blocks (that lose the match with their first
  or last word): a block matches when it holds a least one. Those that overlap are given as one block.

A block of any length is found, so the words of a short statement may stand far apart in a long text. ``closeness`` tells: the
containment of its best least block, times the template's length by the block's where that is longer. ``stretch`` bounds the
length of least blocks, as a multiple of the template's, for who wants dense ones only.

Base: the places where the words of a phrase stand consecutively.

Defined results: null and empty texts have no words, null places, empty labels and score 0. Texts are read whole, however
long. Of equally frequent words the smaller is the rarer. Rows are independent (repeated rows give repeated results, null ids
stay). Only the id and text columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import read_table

THRESHOLD = 0.85
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Names of licenses, and the forms of statements that name one.
NAMES = (("mit", "the MIT License"), ("apache", "the Apache License, Version 2.0"), ("gpl", "the GNU General Public License, version 3"), ("bsd", "the BSD 3-Clause License"), ("cc", "CC BY-NC 4.0"), ("cc", "CC BY-SA 4.0"))
FORMS = ("Released under {}", "Licensed under {}")
#: Words of a paragraph below which it is joined to the next.
PARAGRAPH_WORDS = 12
TEXTS = Path(__file__).parent / "license_texts"
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def license_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of ASCII letters, digits and other characters beyond ASCII."""
    return (text or "").encode().translate(_SPLIT).split()


def paragraph_templates(text: str) -> list[str]:
    """The paragraphs of a license text; short ones go with the next (the last with the one before)."""
    out, held = [], ""
    for part in re.split(r"\n[ \t]*\n", text):
        held = f"{held}\n{part}".strip()
        if len(license_words(held)) >= PARAGRAPH_WORDS:
            out.append(held)
            held = ""
    if held and out:
        out[-1] = f"{out[-1]}\n{held}"
    return out or ([held] if held else [])


@lru_cache(maxsize=1)
def default_templates() -> tuple[tuple[str, str], ...]:
    """Label and text of every template."""
    found = [(label, form.format(name)) for label, name in NAMES for form in FORMS]
    for path in sorted(TEXTS.glob("*.txt")):
        found += [(path.stem.split("-")[0], t) for t in paragraph_templates(path.read_text(encoding="utf-8"))]
    return tuple(found)


def template_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """Occurrences of each template word in all documents; the result is as large as the templates."""

    def run(batches):
        total = Counter()
        for b in batches:
            for t in b.column(0):
                total.update(w for w in license_words(t.as_py()) if w in vocabulary)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Template:
    """A template's words in the global order, and what its filters need."""

    def __init__(self, label: str, text: str, counts: dict[bytes, int], threshold: float, stretch: float | None = None):
        ws = license_words(text)
        order = sorted(set(ws), key=lambda w: (counts.get(w, 0), w))
        self.label, self.words, self.place = label, len(ws), {w: i for i, w in enumerate(order)}
        self.need = math.ceil(threshold * len(order) - 1e-9)
        self.longest = None if stretch is None else math.floor(stretch * len(ws) + 1e-9)
        self.prefix = order[: len(order) - self.need + 1]

    def least_blocks(self, at: np.ndarray, which: np.ndarray) -> list[tuple[int, int]]:
        """Blocks that hold enough words, and don't without their first or last, in order; from the places of template words and
        their numbers."""
        inside, distinct, left, out = [0] * len(self.place), 0, 0, []
        for right, x in enumerate(which.tolist()):
            distinct += inside[x] == 0
            inside[x] += 1
            while distinct > self.need or (distinct == self.need and inside[which[left]] > 1):
                inside[which[left]] -= 1
                distinct -= inside[which[left]] == 0
                left += 1
            if distinct == self.need and inside[x] == 1:
                a, b = int(at[left]), int(at[right]) + 1
                if self.longest is None or b - a <= self.longest:
                    out.append((a, b))
        return out

    def matches(self, ws: list[bytes], present: set[bytes]) -> list[tuple[int, int, float, float]]:
        """Start, end, containment and closeness of the blocks."""
        held = present & self.place.keys()
        rarest = min(map(self.place.__getitem__, held), default=0)
        if len(ws) < self.need or len(held) < self.need or len(self.place) - rarest < self.need:
            return []
        number = np.fromiter((self.place.get(w, -1) for w in ws), np.int64, len(ws))
        known = np.flatnonzero(number >= 0)
        out: list[list] = []
        for a, b in self.least_blocks(known, number[known]):
            near = self.need * self.words / max(self.words, b - a)
            if out and a < out[-1][1]:
                out[-1][1:] = [b, max(out[-1][2], near)]
            else:
                out.append([a, b, near])
        n = len(self.place)
        spans = np.searchsorted(known, [x[:2] for x in out]).tolist()
        shares = [len(np.unique(number[known[i:j]])) / n for i, j in spans]
        return [(a, b, share, min(share, near / n)) for (a, b, near), share in zip(out, shares)]


class TemplateIndex:
    """Templates by the words of their prefixes."""

    def __init__(self, templates: Iterable[tuple[str, str]], counts: dict[bytes, int], threshold: float, stretch: float | None = None):
        self.templates = [Template(label, t, counts, threshold, stretch) for label, t in templates]
        self.of: dict[bytes, list[int]] = {}
        for i, t in enumerate(self.templates):
            for w in t.prefix:
                self.of.setdefault(w, []).append(i)

    def blocks(self, ws: list[bytes], present: set[bytes]) -> list[tuple[str, int, int, float, float]]:
        """Label, start, end, containment and closeness of all matching blocks."""
        some = sorted({i for w in present & self.of.keys() for i in self.of[w]})
        return [(self.templates[i].label, *x) for i in some for x in self.templates[i].matches(ws, present)]


def phrase_places(ws: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """First word and label of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases:
        i = -1
        while True:
            try:
                i = ws.index(phrase[0], i + 1)
            except ValueError:
                break
            if ws[i : i + len(phrase)] == phrase:
                out.append((i, label))
    return out


def scan_licenses(
    docs: DataFrame, templates: Iterable[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
    stretch: float | None = None,
) -> DataFrame:
    """id, ``n_words``, ``places`` of phrases (word, label) and ``blocks`` that match (label, start, end, containment, closeness). No
    templates (an empty list) find no blocks; None are the default ones."""
    texts = default_templates() if templates is None else [(label, t) for label, t in templates if license_words(t)]
    listed = [(license_words(p), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    vocabulary = {w for _, t in texts for w in license_words(t)}
    ready = TemplateIndex(texts, template_counts(docs, vocabulary, text_col) if vocabulary else {}, threshold, stretch)
    firsts = {p[0] for p, _ in listed}
    places_t = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    blocks_t = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64()), ("closeness", pa.float64())]))

    def run(batches):
        for b in batches:
            n_words, places, blocks = [], [], []
            for t in b.column(1):
                ws = license_words(t.as_py())
                present = set(ws)
                n_words.append(len(ws))
                places.append([{"word": i, "label": x} for i, x in phrase_places(ws, listed)] if not firsts.isdisjoint(present) else [])
                blocks.append([dict(zip(("label", "start", "end", "containment", "closeness"), x)) for x in ready.blocks(ws, present)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(places, places_t), pa.array(blocks, blocks_t)], names=["key", "n_words", "places", "blocks"]
            )

    schema = "key long, n_words long, places array<struct<word:long,label:string>>, blocks array<struct<label:string,start:long,end:long,containment:double,closeness:double>>"
    picked = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    base = F.transform("places", lambda x: x["label"])
    every = F.concat(base, F.transform("blocks", lambda x: x["label"]))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    at = F.transform("places", lambda x: x["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(every).alias("labels"),
        F.coalesce(F.array_max(F.transform("blocks", lambda x: x["closeness"])), F.lit(0.0)).alias("score"),
    )
