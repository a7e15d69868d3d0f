"""Secret scans by assignment-aware lexing.

The text is lexed as source or configuration syntax into statements ``name = term + term ...`` (``:``,
``:=`` and ``=>`` too; names may be quoted, as in JSON). Terms are quoted literals, bare values or names.
Other syntaxes give the same pairs of name and literal: elements (``<password>x</password>``), block scalars (``key: |`` with the
indented lines below), commands (``set password x``, ``--password x``), calls of a sensitive name (``setPassword("x")``), a name and a
literal as neighbouring arguments (``put("api_key", "x")``), and literals inside a call that is assigned (``token := f("x")``).
A value that begins with ``$`` or stands in ``%`` signs refers to another name and is no literal. Comments are lexed like the rest, as a
secret in a comment is one; a name has its last value, whatever the scope.
Names keep the literals they were given, so constants propagate: in ``k = "..."; db_password = k`` the
literal is scored under ``db_password``. A literal's score is the sensitivity of the target name times how
much the literal looks like a credential; those of ``THRESHOLD`` or more are findings of kind ``literal``.
Three plain patterns (assign, access, hex) are the base; their findings always stay.

Defined results: null and empty texts have no findings; whole texts are scanned, however long. Rows are
independent, so repeated rows give repeated results, and an empty table gives none; offsets are code points, ends exclusive. Columns
other than the named ones are not read by ``scan_secrets`` and pass unchanged through ``redact``.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import read_table

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5
FINDINGS = "array<struct<kind:string,start:long,end:long,score:double>>"
MASK = "[SECRET]"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Weight of the parts of a target name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9,
    "apikey": 1.0, "api_key": 1.0, "access_key": 1.0, "private_key": 1.0, "secret_key": 1.0, "auth": 0.7, "signature": 0.6, "cookie": 0.6,
    "passcode": 0.9, "passphrases": 1.0, "passwords": 1.0, "secrets": 1.0, "tokens": 0.9, "bearer": 0.8, "jwt": 0.9, "privkey": 1.0, "encryption_key": 1.0, "signing_key": 1.0,
    "master_key": 1.0, "session_key": 0.9, "shared_key": 0.9, "account_key": 0.9, "auth_key": 0.9, "connection_string": 0.7, "connstr": 0.7, "dsn": 0.6,
}
#: Lower-case pieces of which every sensitive name has one.
_STEMS = ("pass", "pwd", "secret", "token", "cred", "key", "auth", "sign", "cookie", "bearer", "jwt", "conn", "dsn")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)(?:[ \t][^<>\n]*)?>([^<>\n]*)</\1[ \t]*>")
_BLOCK = re.compile(r"^([ \t]*)(?:- )?[\"']?([A-Za-z_][A-Za-z0-9_.-]*)[\"']?[ \t]*:[ \t]*[|>][+-]?[0-9]?[ \t]*\n((?:\1[ \t]+[^\n]*(?:\n|\Z)|[ \t]*\n)+)", re.M)
_COMMAND = re.compile(r"""(?:\b(?:set|setenv|export|define|declare|let|put|login[ \t]+[^\s]+)[ \t]+|--?)([A-Za-z_][A-Za-z0-9_.-]*)[ \t]+(?=[^\s=:])""", re.I)
_CALL = re.compile(r"(?<![A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_.]*)[ \t]*\([ \t]*(?=[\"'`A-Za-z_])")
_NEXT = re.compile(r"[ \t]*,[ \t]*(?=[\"'`])")
_REFERENCE = re.compile(r"\$|%[A-Za-z_][A-Za-z0-9_]*%")
#: What stands between a name and its value; the name is looked for backwards from it, so that no text is read twice.
_SEPARATOR = re.compile(r"(?::=|=>|=(?!=)|:)[ \t]*")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_NAME_START = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_]")
#: A literal up to the closing quote of its own kind; a backslash escapes the next character.
_QUOTED = re.compile(
    r"""(?:[rRbBuUfFL@$]{1,2}(?=["'`]))?(?:"{3}([^\n]*?)"{3}|'{3}([^\n]*?)'{3}|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`)"""
)
#: A bare value up to white space, a quote or a delimiter, also the next pair of a query string.
_BARE = re.compile(r"""(?:(?!\+["'`]|&[A-Za-z_][A-Za-z0-9_.-]*=)[^\s"'`,;()\[\]{}<>])+""")
_PLUS = re.compile(r"""[ \t]*\+[ \t]*(?=["'`A-Za-z0-9_])""")
_QUOTES = frozenset("\"'`")
#: First characters of a literal with its prefix, and of a plus.
_MAY_QUOTE, _MAY_PLUS = frozenset("rRbBuUfFL@$\"'`"), frozenset(" \t+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")


@lru_cache(maxsize=1 << 12)
def sensitivity(name: str) -> float:
    """Weight of the most sensitive part, or pair of parts, of a name; camel case and _ - . separate."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = ["_".join(p) for p in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *pairs, "".join(parts)]), default=0.0)


class Shape:
    """Length, entropy and kinds of characters of a literal, kept up to date as characters are added."""

    __slots__ = ("n", "counts", "weighted", "kinds", "blank")

    def __init__(self):
        self.n, self.counts, self.weighted, self.kinds, self.blank = 0, {}, 0.0, 0, False

    def add(self, c: str) -> None:
        k = self.counts.get(c, 0) + 1
        self.counts[c] = k
        self.n += 1
        self.weighted += k * math.log2(k) - (k - 1) * math.log2(k - 1) if k > 1 else 0.0
        self.kinds |= 1 if c.islower() else 2 if c.isupper() else 4 if c.isdigit() else 0
        self.kinds |= 0 if c.isalnum() else 8
        self.blank = self.blank or c.isspace()

    def score(self) -> float:
        """From 0 (prose, placeholder) to 1 (long, mixed, high entropy per character)."""
        if self.n < 8 or self.blank:
            return 0.0
        entropy = math.log2(self.n) - self.weighted / self.n
        return min(1.0, entropy / 4) * (0.4 + 0.2 * min(3, self.kinds.bit_count()))


def credential_score(literal: str) -> float:
    shape = Shape()
    for c in literal:
        shape.add(c)
    return shape.score()


class Bare:
    """A bare value; values that start further on in it end with it, and are scored in one pass from the end."""

    __slots__ = ("text", "start", "end", "tails")

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end, self.tails = text, start, end, None

    def score(self, at: int) -> float:
        if at == self.start:
            return credential_score(self.text[at : self.end])
        if self.tails is None:
            shape, tails = Shape(), []
            for i in range(self.end - 1, self.start - 1, -1):
                shape.add(self.text[i])
                tails.append(shape.score())
            self.tails = tails
        return self.tails[self.end - 1 - at]


def heads(text: str):
    """``name, end`` of each name with a separator after it; end is where its value starts."""
    low, chars = 0, _NAME_CHARS  # names don't reach back over the separator before
    for m in _SEPARATOR.finditer(text):
        at, past = m.span()
        while at > low and text[at - 1] in " \t":
            at -= 1
        if at > low and text[at - 1] in "\"'":
            at -= 1
        end = at
        while at > low and text[at - 1] in chars:
            at -= 1
        if at < end and (first := _NAME_START.search(text, at, end)):
            yield text[first.start() : end], past
        low = past


class Value:
    """What a name was given: literals (start, end, bare value or None), the values of other names, and the highest
    weight it was scored under."""

    __slots__ = ("spans", "parts", "weight")

    def __init__(self, spans: list[tuple[int, int, Bare | None]], parts: list[Value]):
        self.spans, self.parts, self.weight = spans, parts, 0.0


def quoted(text: str, at: int) -> tuple[int, int, int] | None:
    """Start and end of the literal that is quoted at a place, and where its quotes end."""
    m = _QUOTED.match(text, at) if text[at : at + 1] in _MAY_QUOTE else None
    return (*m.span(m.lastindex), m.end()) if m else None


def other_pairs(text: str):
    """``name, start, end`` of the literals that other syntaxes than assignments give to sensitive names; an end of -1 is a name."""
    for m in _ELEMENT.finditer(text) if "</" in text else ():
        yield m[1].rpartition(":")[2], m.end(2) - len(m[2].lstrip()), m.start(2) + len(m[2].rstrip())
    for m in _BLOCK.finditer(text):
        if sensitivity(m[2]):
            at = m.start(3)
            for line in m[3].split("\n"):
                yield m[2], at + len(line) - len(line.lstrip()), at + len(line.rstrip())
                at += len(line) + 1
    for m in _COMMAND.finditer(text):
        if sensitivity(m[1]) and not _REFERENCE.match(text, m.end()):
            found = quoted(text, m.end()) or ((*v.span(), 0) if (v := _BARE.match(text, m.end())) else None)
            if found:
                yield m[1], found[0], found[1]
    for m in _CALL.finditer(text) if "(" in text else ():
        if sensitivity(m[1].rpartition(".")[2]):
            if found := quoted(text, m.end()):
                yield m[1], found[0], found[1]
            elif v := _IDENTIFIER.match(text, m.end()):
                yield m[1], v.start(), -1
        if (first := quoted(text, m.end())) and (comma := _NEXT.match(text, first[2])) and (second := quoted(text, comma.end())):
            yield text[first[0] : first[1]], second[0], second[1]


def assigned(text: str) -> list[tuple[int, int, float]]:
    """Literals that reach a sensitive name: start, end, score."""
    known: dict[str, Value] = {}
    found: dict[tuple[int, int], float] = {}

    def reach(value: Value, weight: float) -> None:
        todo = [value]
        while todo:
            v = todo.pop()
            if v.weight >= weight:
                continue
            v.weight = weight
            todo += v.parts
            for a, b, bare in v.spans:
                score = weight * (credential_score(text[a:b]) if bare is None else bare.score(a))
                if score >= THRESHOLD:
                    found[a, b] = max(score, found.get((a, b), 0.0))

    run = Bare(text, -1, -1)  # the last bare value
    for name, at in heads(text):
        spans, parts = [], []
        while True:
            if m := quoted(text, at):
                spans.append((*m[:2], None))
                end = m[2]
            else:
                at += text[at : at + 1] in _QUOTES  # not closed
                if not run.start <= at < run.end:
                    if not (m := _BARE.match(text, at)):
                        break
                    run = Bare(text, at, m.end())
                end = run.end
                named = _NAME.match(text, at + (text[at] == "$"), end)
                if text[end : end + 1] == "(" and _NAME.match(text, at, end):  # a call: its first literals on the line
                    at = end + 1
                    while m := quoted(text, at):
                        spans.append((*m[:2], None))
                        end = m[2]
                        if not (comma := _NEXT.match(text, end)):
                            break
                        at = comma.end()
                    break
                if named and named[0] in known:
                    parts.append(known[named[0]])
                elif not _REFERENCE.match(text, at) and (not named or any(c.isdigit() for c in named[0])):
                    spans.append((at, end, run))
            if text[end : end + 1] not in _MAY_PLUS or not (m := _PLUS.match(text, end)):
                break
            at = m.end()
        if spans or parts:
            value = known[name] = Value(spans, parts)
            if weight := sensitivity(name):
                reach(value, weight)
    low = text.lower()
    for name, a, b in other_pairs(text) if any(s in low for s in _STEMS) else ():
        if weight := sensitivity(name):
            if b >= 0:
                reach(Value([(a, b, None)], []), weight)
            elif (v := _IDENTIFIER.match(text, a)) and v[0] in known:
                reach(known[v[0]], weight)
    return [(a, b, s) for (a, b), s in found.items()]


def find_secrets(text: str) -> list[tuple[str, int, int, float]]:
    """All findings of a text by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or any(s in low for s in _STEMS):
        out += [("literal", a, b, s) for a, b, s in assigned(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def masked(text: str) -> str:
    """The text with every finding, overlapping ones together, replaced by the mask."""
    out, at, spans = [], 0, find_secrets(text)
    for _, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``findings`` (kind, start, end, score) of every text."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), f)) for f in find_secrets(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, spans)], names=["key", "findings"])

    picked = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"key long, findings {FINDINGS}").withColumnRenamed("key", id_col)


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The input with secrets masked in the text, and its length column, where there is one, brought up to date."""
    names = df.columns
    k, n = names.index(text_col), names.index(length_col) if length_col in names else -1

    def run(batches):
        for b in batches:
            new = [t if t is None else masked(t) for t in b.column(k).to_pylist()]
            columns = list(b.columns)
            columns[k] = pa.array(new, b.column(k).type)
            if n >= 0:
                columns[n] = pa.array([x if t is None else len(t) for t, x in zip(new, b.column(n).to_pylist())], b.column(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return df.mapInArrow(run, df.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    spell = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda *kinds: F.filter("findings", lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(of(*KINDS[:3]), spell), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", spell), ",").alias("spans"),
    )
