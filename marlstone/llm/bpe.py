"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Text goes in block by block and token ids come out as soon as no later text can change them, so the
state is a few kilobytes however long a text is.

*Sufficient lookahead.*  Run the merge list in rank order over the same bytes with two different
continuations. Left of a front both runs hold the same tokens. The front moves only when a merge
``(z, x)`` happens in one run and not in the other, with ``z`` the last common token: it then moves left
by ``len(z)``. The next move needs a later merge whose right part starts (down its left spine) with
``z``. The longest such chain of merges of rising rank, weighted by ``len(z)``, bounds how far unseen
bytes can reach back. ``MergeTable.lookahead`` computes it from the merge list in one pass.

*Decoding* maps ids to bytes and feeds an incremental UTF-8 decoder, which holds at most three bytes.

Defined results: a null text is the empty text; empty texts have no ids; null ids stay null, repeated rows give repeated results, and an
empty table gives no rows. ``bpe_digests`` keeps constant memory however long a text is; ``bpe_round_trip`` holds one document's ids and
text, which it returns. Of merges of one rank the leftmost is made first. The string of a special token
inside a text becomes that token's id, as the tokenizers library does when ``encode_special_tokens`` is
off. Other columns of the input, whatever their names, are not touched by the operator: it takes the
names of the id and text columns as parameters.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import read_table

#: Characters of a text handed to the transducer at once.
BLOCK_CHARS = 1 << 16
#: A run of one character class longer than this is encoded piecewise.
LONG_RUN = 1 << 12
#: Words remembered by a worker, per generation.
MEMO_WORDS = 400_000

# The byte-level pre-tokenizer's pattern is a fixed value of the vocabulary's format. White space and classes are spelled out: Python's own \s also has U+001C-U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"
_GENERAL = {"L": r"\p{L}", "N": r"\p{N}", "S": _SPACE}
# The same classes for texts below U+0250, which the faster standard module can match.
_LATIN = {"L": r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "N": r"0-9\xb2\xb3\xb9\xbc-\xbe", "S": r"\t-\r \x85\xa0"}


def _pattern(module, c: dict):
    return module.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?[{c['L']}]+| ?[{c['N']}]+| ?[^{c['S']}{c['L']}{c['N']}]+|[{c['S']}]+(?![^{c['S']}])|[{c['S']}]+"
    )


GENERAL, LATIN = _pattern(regex, _GENERAL), _pattern(re, _LATIN)
BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")
RUNS = [regex.compile(f"[{c}]+") for c in (r"\p{L}", r"\p{N}", _SPACE, rf"^{_SPACE}\p{{L}}\p{{N}}")]
SPACE_RUN = RUNS[2]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the byte-level format: printable Latin-1 is itself, the rest follows U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """A byte-level BPE vocabulary: merges by pair of ids, bytes by id, and the lookahead that suffices."""

    def __init__(self, spec: str | bytes):
        data = json.loads(spec)
        alphabet = byte_alphabet()
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        of = {self.bytes[i]: i for i in vocab.values()}
        self.byte_id = [of[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        order = []
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = vocab[a], vocab[b]
            c = of[self.bytes[a] + self.bytes[b]]
            self.pairs.setdefault((a, b), (rank, c))
            order.append((a, b, c))
        self.names = [str(i) for i in range(size)]
        self.lookahead = self._sufficient_lookahead(order)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _sufficient_lookahead(self, order: list[tuple[int, int, int]]) -> int:
        left = {}
        for a, _, c in order:
            left.setdefault(c, a)
        reach = [0] * len(self.bytes)  # of chains whose last merge had this left part
        for z, x, _ in order:
            far, s = 0, x
            while s is not None:
                far = max(far, reach[s])
                s = left.get(s)
            reach[z] = max(reach[z], far + len(self.bytes[z]))
        return max(reach, default=0) + 1

    def merge(self, data: bytes) -> list[int]:
        """The ids of bytes that form one whole pre-token."""
        ids = [self.byte_id[b] for b in data]
        return self._merge_long(ids) if len(ids) > 48 else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.pairs.get, (1 << 40, 0)
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none or best[0] == none[0]:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := get((c, ids[k])):
                    heapq.heappush(heap, (m[0], i, c, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := get((ids[h], c))):
                heapq.heappush(heap, (m[0], h, ids[h], c, m[1]))
        return [i for i in ids if i >= 0]


class Encoder:
    """Streaming encoder: ``feed`` text blocks, then ``finish``; both return the ids that are stable by then."""

    def __init__(self, table: MergeTable, memo: "Memo | None" = None):
        self.table, self.memo = table, memo or Memo(table)
        self.text = ""  # not yet cut into pre-tokens
        self.run = None  # the class of a long run that is being encoded piecewise
        self.bytes = b""  # of that run, not yet stable

    def feed(self, block: str) -> list[int]:
        out: list[int] = []
        self.text += block
        while self.run is not None:
            m = self.run.match(self.text)
            end = m.end() if m else 0
            if end == len(self.text):
                self._push(max(0, end - 3), out)
                return out
            if self.run is SPACE_RUN and end:  # its last character goes with what follows
                end -= 1
            self._push(end, out)
            out += self.table.merge(self.bytes) if self.bytes else []
            self.run, self.bytes = None, b""
        self._words(out, final=False)
        if len(self.text) > LONG_RUN:
            m = (LATIN if not BEYOND_LATIN.search(self.text) else GENERAL).match(self.text)
            if m.end() == len(self.text):
                lead = self.text[0] == " " and not SPACE_RUN.fullmatch(self.text)
                self.run = next(r for r in RUNS if r.match(self.text, 1 if lead else 0))
                self._push(len(self.text) - 3, out)
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        if self.run is not None:
            m = self.run.match(self.text)
            end = m.end() if m else 0
            if self.run is SPACE_RUN and end and end < len(self.text):
                end -= 1
            self._push(end, out)
            out += self.table.merge(self.bytes) if self.bytes else []
            self.run, self.bytes = None, b""
        self._words(out, final=True)
        return out

    def _words(self, out: list[int], final: bool) -> None:
        text = self.text
        pattern = GENERAL if BEYOND_LATIN.search(text) else LATIN
        found = pattern.findall(text)
        self.text = ""
        if not final:  # the last pre-token, and those that end in the last two characters, can still change
            kept = 0
            while found and (not kept or kept < 3):
                kept += len(found.pop())
            self.text = text[len(text) - kept :] if kept else ""
        get, slow = self.memo.words.get, self.memo.slow
        for w in found:
            ids = get(w)
            out += slow(w) if ids is None else ids

    def _push(self, chars: int, out: list[int]) -> None:
        """Moves characters of the run to the byte buffer and emits the tokens that the lookahead makes stable."""
        self.bytes += self.text[:chars].encode()
        self.text = self.text[chars:]
        far = self.table.lookahead
        if len(self.bytes) < 4 * far:
            return
        done, stable = 0, len(self.bytes) - far
        for i in self.table.merge(self.bytes):
            if done + len(self.table.bytes[i]) > stable:
                break
            done += len(self.table.bytes[i])
            out.append(i)
        self.bytes = self.bytes[done:]


class Memo:
    """Ids of recent words, in two generations of bounded size."""

    def __init__(self, table: MergeTable, size: int = MEMO_WORDS):
        self.table, self.size = table, size
        self.words: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def slow(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = tuple(self.table.merge(word.encode()))
        if len(word) <= 64:
            if len(self.words) >= self.size:
                self.old = dict(self.words)
                self.words.clear()
            self.words[word] = ids
        return ids


def id_blocks(table: MergeTable, memo: Memo, text: str) -> Iterator[list[int]]:
    """The ids of a text in pieces, as the streaming encoder makes them stable."""
    at = 0
    for m in table.specials.finditer(text) if table.specials is not None else ():
        yield from _plain_blocks(table, memo, text[at : m.start()])
        yield [table.special[m[0]]]
        at = m.end()
    yield from _plain_blocks(table, memo, text[at:] if at else text)


def _plain_blocks(table: MergeTable, memo: Memo, text: str) -> Iterator[list[int]]:
    stream = Encoder(table, memo)
    for i in range(0, len(text), BLOCK_CHARS):
        yield stream.feed(text[i : i + BLOCK_CHARS])
    yield stream.finish()


def encode_text(table: MergeTable, memo: Memo, text: str) -> list[int]:
    """All ids of a text, through the streaming encoder."""
    return [i for ids in id_blocks(table, memo, text) for i in ids]


def digest_text(table: MergeTable, memo: Memo, text: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids and of the text decoded from them, piece by piece: neither is ever held whole."""
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
    state, known, names = codecs.getincrementaldecoder("utf-8")("replace"), table.bytes, table.names
    for ids in id_blocks(table, memo, text):
        if ids:
            of_ids.update((("," if n else "") + ",".join([names[i] for i in ids])).encode())
            of_text.update(state.decode(b"".join([known[i] for i in ids])).encode())
            n += len(ids)
    of_text.update(state.decode(b"", True).encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def decode_blocks(table: MergeTable, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
    """Text pieces of a stream of ids; invalid bytes become U+FFFD, and only an unfinished character is kept back."""
    state = codecs.getincrementaldecoder("utf-8")("replace")
    known, size = table.bytes, len(table.bytes)
    ids = list(ids) if not isinstance(ids, list) else ids
    for i in range(0, len(ids), block):
        yield state.decode(b"".join([known[x] for x in ids[i : i + block] if x is not None and 0 <= x < size]))
    yield state.decode(b"", True)


@lru_cache(maxsize=4)
def _loaded(spec: bytes) -> tuple[MergeTable, Memo]:
    table = MergeTable(spec)
    return table, Memo(table)


def tokenizer_spec(path: str | None = None) -> bytes:
    """The vocabulary file's bytes; a fixed size (about 1.5 MB), so they travel with the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size) -> Iterator[pa.RecordBatch]:
    """Output batches of a few megabytes."""
    held, weight = [], 0
    schema = pa.schema(list(zip(names, types)))
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema)


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id and ``ids array<int>`` of every text."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_spec(path))

    def run(batches):
        table, memo = _loaded(shared.value)

        def rows():
            for b in batches:
                for key, text in zip(b.column(0), b.column(1)):
                    yield key.as_py(), encode_text(table, memo, text.as_py() or "")

        yield from _batches(rows(), ["key", "ids"], [pa.int64(), pa.list_(pa.int32())], lambda r: 4 * len(r[1]) + 16)

    picked = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", id_col)


def bpe_decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id and ``decoded`` text of every id list; null lists and ids outside the vocabulary give no text."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_spec(path))

    def run(batches):
        table, _ = _loaded(shared.value)

        def rows():
            for b in batches:
                for key, ids in zip(b.column(0), b.column(1)):
                    yield key.as_py(), "".join(decode_blocks(table, ids.as_py() or []))

        yield from _batches(rows(), ["key", "decoded"], [pa.int64(), pa.string()], lambda r: 2 * len(r[1]) + 16)

    picked = df.select(F.col(id_col).cast("long").alias("key"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, "key long, decoded string").withColumnRenamed("key", id_col)


def bpe_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ``ids array<int>`` and the text ``decoded`` from them, in one pass over each text."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_spec(path))

    def run(batches):
        table, memo = _loaded(shared.value)

        def rows():
            for b in batches:
                for key, text in zip(b.column(0), b.column(1)):
                    ids = encode_text(table, memo, text.as_py() or "")
                    yield key.as_py(), ids, "".join(decode_blocks(table, ids))

        kinds = [pa.int64(), pa.list_(pa.int32()), pa.string()]
        yield from _batches(rows(), ["key", "ids", "decoded"], kinds, lambda r: 4 * len(r[1]) + 2 * len(r[2]) + 16)

    picked = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "key long, ids array<int>, decoded string").withColumnRenamed("key", id_col)


def digests(coded: DataFrame, *more: str) -> DataFrame:
    """Per document: token count, and SHA-256 of the comma-joined ids and of the decoded text; then ``more`` columns."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def bpe_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ``n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded in one pass of constant memory."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_spec(path))

    def run(batches):
        table, memo = _loaded(shared.value)

        def rows():
            for b in batches:
                for key, text in zip(b.column(0), b.column(1)):
                    yield key.as_py(), *digest_text(table, memo, text.as_py() or "")

        yield from _batches(rows(), ["key", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()], lambda r: 160)

    picked = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", id_col)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"))
