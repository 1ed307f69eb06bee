"""Operator 4, secret scans.

An Aho-Corasick automaton of keywords finds candidate places; regular
expressions are tried only there, anchored; formats that embed a checksum are
kept only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel

#: The base kinds in the order in which equal starts are listed, then the kinds with a checksum.
KINDS = ("assign", "access", "hex", "forge", "registry", "wif")
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign"}
PREFIXES = {"AKIA": "access", "ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge", "ghr_": "forge", "npm_": "registry"}
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_TAGGED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_WIF = re.compile(r"(?<![A-Za-z0-9])[5KL][1-9A-HJ-NP-Za-km-z]{50,51}(?![A-Za-z0-9])")

_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGITS58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

Span = tuple[str, int, int]


def base62_crc(body: str) -> str:
    """The CRC-32 of a token's body, six base-62 digits."""
    x, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        x, r = divmod(x, 62)
        out = _DIGITS62[r] + out
    return out


def base58_check(text: str) -> bool:
    """Whether the last four bytes are the double SHA-256 of the rest."""
    x = 0
    for c in text:
        x = x * 58 + _DIGITS58.index(c)
    if x.bit_length() > 38 * 8:
        return False
    data = x.to_bytes((x.bit_length() + 7) // 8, "big")
    return len(data) in (37, 38) and data[0] == 0x80 and hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


@cache
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


_LOWER = {c: c + 32 for c in range(65, 91)}
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true values that are long enough."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    keep = end - start >= least
    return start[keep], end[keep]


def keyword_spans(text: str) -> list[Span]:
    """Spans of the kinds that have a keyword. Candidates are tried in the
    order of their place; within a kind none starts inside the last match,
    even one that is too short, so the result equals a scan from the left."""
    out: list[Span] = []
    last = 0
    for end, word in sorted((e + 1 - len(w), w) for e, w in _automaton(tuple(KEYWORDS)).iter(text.translate(_LOWER))):
        if end >= last and (m := _ASSIGN.match(text, end)):
            last = m.end()
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                out.append(("assign", m.start(), m.end()))
    last = dict.fromkeys(KINDS, 0)
    for e, w in _automaton(tuple(PREFIXES)).iter(text):
        at, kind = e + 1 - len(w), PREFIXES[w]
        if at < last[kind]:
            continue
        if kind == "access":
            if m := _ACCESS.match(text, at):
                last[kind] = m.end()
                if m.end() - at >= MIN_ACCESS:
                    out.append((kind, at, m.end()))
        elif (m := _TAGGED.match(text, at)) and base62_crc(m[1]) == m[2]:
            last[kind] = m.end()
            out.append((kind, at, m.end()))
    return out


def scan(docs: list[bytes]) -> list[list[Span]]:
    """All spans of each text in code points, by start, then kind."""
    buf = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    found: list[list[Span]] = [[] for _ in docs]
    a, b = runs(_HEX[buf], MIN_HEX)
    for i, s, e in zip(np.searchsorted(end, a).tolist(), a.tolist(), b.tolist(), strict=True):
        found[i].append(("hex", int(points[s] - points[begin[i]]), int(points[e] - points[begin[i]])))
    a, b = runs(_ALNUM[buf], 51)
    for i, s, e in zip(np.searchsorted(end, a).tolist(), a.tolist(), b.tolist(), strict=True):
        word = docs[i][s - begin[i] : e - begin[i]].decode()
        if _WIF.fullmatch(word) and base58_check(word):
            found[i].append(("wif", int(points[s] - points[begin[i]]), int(points[e] - points[begin[i]])))
    rank = {k: i for i, k in enumerate(KINDS)}
    for i, doc in enumerate(docs):
        found[i] += keyword_spans(doc.decode())
        found[i].sort(key=lambda x: (x[1], rank[x[0]]))
    return found


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: array of (kind, start, end) over the whole
    text in code points, end exclusive, ordered by start, then kind.

    A null or empty text has none; overlapping kinds are all listed; repeated
    rows are scanned one by one; a column named ``secrets`` is replaced. One
    pass over the rows, no shuffle.
    """
    base = docs.drop("secrets")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, text):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in scan(kernel.raw(batch.column(text)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "secrets"])

    return base.mapInArrow(run, kernel.extended(base.schema, secrets="array<struct<kind:string,start:bigint,end:bigint>>"))


def mask_secrets(docs: DataFrame, text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``by``; spans that overlap or
    touch become one. Texts without secrets, null ones too, stay as they are;
    repeated rows are masked one by one; other columns stay, whatever their
    names; an empty table gives an empty one. One pass, no shuffle."""
    base = docs

    def clean(raw: bytes, spans: list[Span]) -> str:
        s, out, at = raw.decode(), [], 0
        for _, a, b in spans:
            if a >= at and not (out and a == at):
                out += [s[at:a], by]
            at = max(at, b)
        return "".join([*out, s[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, text):
            k = batch.schema.get_field_index(text)
            old = kernel.raw(batch.column(k))
            nulls = batch.column(k).is_null().to_pylist()
            new = [None if z else clean(x, s) for x, s, z in zip(old, scan(old), nulls, strict=True)]
            yield batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))

    return base.mapInArrow(run, base.schema)


def joined(spans: F.Column, kinds: tuple[str, ...] | None = None) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
