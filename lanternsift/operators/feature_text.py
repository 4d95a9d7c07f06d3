"""Features of one text, in Python: names, CRC-32 buckets and 64-bit hashes.

Nested column lambdas over token arrays are interpreted element by element; here tokens come from one search over UTF-8
bytes and what a token gives is kept for the next time that it is met. Bytes beyond ASCII are in no class of a pattern, so
searches of bytes and of code points find the same.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens whose parts a worker remembers.
KNOWN = 300_000
#: Features and hashes that a task adds up before it passes them on, and rows of a batch that it passes on.
SUMMED, HASHED, ROWS = 500_000, 4_000_000, 50_000
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
_APOSTROPHE = "’".encode()
_TOKEN = re.compile(rb"[a-z][a-z0'_-]{0,39}|0+(?:[/.:-]0+){0,5}")
_MARKS = b"'_-/.:"
_PLAIN = re.compile(rb"[a-z]{6,}")


def tokens(raw: bytes, most: int | None = None) -> list[bytes]:
    """As features.normal_tokens."""
    found = _TOKEN.findall(raw.replace(_APOSTROPHE, b"'").translate(_FOLD))
    return found if most is None else found[: max(most, 0)]


def _parts(token: bytes) -> tuple[bytes, bytes | None, bytes | None]:
    """A token's word feature and, if it is plain, its affix features."""
    plain = token.translate(None, _MARKS) if len(token) >= 6 else b""
    return (b"u:" + token, b"p:" + plain[:5], b"s:" + plain[-5:]) if _PLAIN.fullmatch(plain) else (b"u:" + token, None, None)


# --- shapes: each is tried where its rarest part is

_RUN = re.compile(rb"[0-9][-0-9 .]{6,}")
_IN_RUN = {
    b"r:card": re.compile(rb"(?<![0-9])(?:[0-9][- ]?){13,19}(?![0-9])"),
    b"r:ipv4": re.compile(rb"(?<![0-9])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![0-9])"),
    b"r:itin": re.compile(rb"(?<![0-9])9[0-9]{2}[ -]?(?:8[0-8]|7[0-9])[ -]?[0-9]{4}(?![0-9])"),
    b"r:ssn": re.compile(rb"(?<![0-9])[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}(?![0-9])"),
}
_LOCAL = frozenset(b"-!#$%&'*+/=?^_`.{|}~0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DOMAIN = re.compile(rb"@[-.a-zA-Z0-9]+[.][a-zA-Z]{2}")
_TWO = re.compile(rb"[0-9][0-9]")
_IBAN = re.compile(rb"(?i)(?<![0-9A-Z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}(?![0-9A-Z])")
_COLONS = re.compile(rb":[a-fA-F0-9]{1,4}:")
_IPV6 = re.compile(rb"(?i)(?<![a-f0-9])(?:[a-f0-9]{1,4}:){2,7}[a-f0-9]{0,4}(?![a-f0-9])")


def _has_email(raw: bytes) -> bool:
    at = raw.find(b"@")
    while at >= 0:
        if at and raw[at - 1] in _LOCAL and _DOMAIN.match(raw, at):
            return True
        at = raw.find(b"@", at + 1)
    return False


def shapes(raw: bytes) -> list[bytes]:
    """Names of the shapes of features.SHAPES that a text holds."""
    found = set()
    for m in _RUN.finditer(raw):
        found.update(n for n, p in _IN_RUN.items() if n not in found and p.search(raw, m.start(), m.end()))
    if _has_email(raw):
        found.add(b"r:email")
    if any(m.start() >= 2 and raw[m.start() - 2 : m.start()].isalpha() and _IBAN.match(raw, m.start() - 2) for m in _TWO.finditer(raw)):
        found.add(b"r:iban")
    if _COLONS.search(raw) and _IPV6.search(raw):
        found.add(b"r:ipv6")
    return sorted(found)


def length_name(chars: int) -> bytes:
    return b"m:length:%d" % min(20, max(chars, 1).bit_length() - 1)


def names(raw: bytes, chars: int, most: int | None = None) -> list[bytes]:
    """The distinct features of a text of so many code points, of all of its tokens or the first ones."""
    found = tokens(raw, most)
    parts = [_parts(t) for t in dict.fromkeys(found)]
    out = [p[0] for p in parts]
    out += dict.fromkeys(p[1] for p in parts if p[1])
    out += dict.fromkeys(p[2] for p in parts if p[2])
    out += [b"b:" + a + b"|" + b for a, b in dict.fromkeys(zip(found, found[1:]))]
    out += shapes(raw)
    out.append(length_name(chars))
    return out


class _Crcs(dict):
    """Token to the CRC-32 of its features and of the first half of a bigram that it opens."""

    def __missing__(self, token: bytes) -> tuple[int, tuple[int, ...]]:
        crc = zlib.crc32
        made = crc(b"|", crc(token, _B)), tuple(crc(p) for p in _parts(token) if p)
        if len(self) >= KNOWN:
            self.clear()
        self[token] = made
        return made


_B = zlib.crc32(b"b:")
_CRCS = _Crcs()


def buckets(raw: bytes, chars: int, n: int, found: list[bytes] | None = None) -> list[int]:
    """Sorted distinct CRC-32 buckets of names(); found: the tokens to be taken, if not all."""
    crc, mask, found = zlib.crc32, n - 1, tokens(raw) if found is None else found
    known = [_CRCS[t] for t in found]
    every = {c for k in known for c in k[1]}
    every.update(map(crc, found[1:], [k[0] for k in known]))
    every.update(map(crc, shapes(raw)))
    every.add(crc(length_name(chars)))
    return sorted({c & mask for c in every})


def thinned(ids: list[int], most: int) -> list[int]:
    """Evenly spaced ones, most at the most."""
    return [ids[int(i * (len(ids) / most))] for i in range(most)] if len(ids) > most else ids


# --- 64-bit hashes


def _code(name: bytes) -> int:
    """A name as a number: its kind and itself if it is short, else 64 bits of its digest."""
    return int.from_bytes(name.replace(b":", b"", 1) if len(name) <= 9 else hashlib.blake2b(name, digest_size=8).digest(), "little", signed=True)


class _Codes(dict):
    """Token to the place of its codes in the columns: word, prefix, suffix; the word again where there is no affix."""

    def __init__(self):
        super().__init__()
        self.columns = np.zeros((3, KNOWN), np.int64)

    def __missing__(self, token: bytes) -> int:
        word, prefix, suffix = _parts(token)
        at = len(self)
        code = _code(word)
        self.columns[:, at] = (code, _code(prefix), _code(suffix)) if prefix else code
        self[token] = at
        return at

    def of(self, found: list[bytes]) -> np.ndarray:
        if len(self) + len(found) > self.columns.shape[1]:
            self.clear()
            if len(found) > self.columns.shape[1]:
                self.columns = np.zeros((3, len(found)), np.int64)
        return self.columns[:, np.fromiter(map(self.__getitem__, found), np.int64, len(found))]


_CODES = _Codes()
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """A number's hash, or that of two in order."""
    with np.errstate(over="ignore"):
        z = a.view(np.uint64) * _C1
        z ^= z >> np.uint64(29)
        if b is not None:
            z += b.view(np.uint64)
        z *= _C2
        z ^= z >> np.uint64(32)
        z *= _C1
        z ^= z >> np.uint64(29)
    return z.view(np.int64)


def hashes(raw: bytes, chars: int) -> np.ndarray:
    """Distinct 64-bit hashes of the features of a whole text, sorted."""
    found = _CODES.of(tokens(raw))
    words = _mixed(found[0])
    rest = np.array([_code(n) for n in (*shapes(raw), length_name(chars))], np.int64)
    return np.unique(np.concatenate((words, _mixed(found[1:].ravel()), _mixed(rest), _mixed(words[:-1], words[1:]))))


def texts(column: pa.Array) -> Iterator[tuple[bytes, int]]:
    """UTF-8 bytes and number of code points of each text, one at a time; no text is an empty one."""
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    for x, n in zip(column.cast(pa.binary()), sizes):
        yield (x.as_py(), int(n)) if x.is_valid else (b"", 0)


# --- many texts: sums by feature, and scores


def _batch(columns: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def named_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """feature and sums from batches of text and an array of width numbers; rows of one feature come again after SUMMED."""
    schema = pa.schema([("feature", pa.string()), *((f"s{i}", pa.int64()) for i in range(width))])
    held: dict[tuple[int, ...], Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        while held:
            vector, counts = held.popitem()
            keys, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            counts.clear()
            for i in range(0, len(keys), ROWS):
                yield _batch([pa.array(keys[i : i + ROWS], pa.binary()), *(pa.array(n[i : i + ROWS] * v) for v in vector)], schema)

    for b in batches:
        for at, ((raw, chars), vector) in enumerate(zip(texts(b.column(0)), b.column(1))):
            held.setdefault(tuple(vector.as_py()), Counter()).update(names(raw, chars))
            if at % 32 == 31 and sum(map(len, held.values())) > SUMMED:
                yield from flush()
    yield from flush()


def hashed_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """As named_sums by hash."""
    schema = pa.schema([("feature", pa.int64()), *((f"s{i}", pa.int64()) for i in range(width))])
    held: dict[tuple[int, ...], list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        while held:
            vector, parts = held.popitem()
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            for i in range(0, len(keys), ROWS):
                yield _batch([pa.array(keys[i : i + ROWS]), *(pa.array(n[i : i + ROWS] * v) for v in vector)], schema)

    for b in batches:
        for (raw, chars), vector in zip(texts(b.column(0)), b.column(1)):
            found = hashes(raw, chars)
            held.setdefault(tuple(vector.as_py()), []).append(found)
            size += len(found)
            if size > HASHED:
                yield from flush()
                size = 0
    yield from flush()


def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk and its distinct hashes from batches of chunk and text, in runs of a chunk."""
    schema = pa.schema([("_c", pa.int32()), ("feature", pa.int64())])
    chunk, parts, size = None, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        for i in range(0, len(keys), ROWS):
            part = keys[i : i + ROWS]
            yield _batch([pa.array(np.full(len(part), chunk, np.int32)), pa.array(part)], schema)

    for b in batches:
        for c, (raw, chars) in zip(b.column(0).to_pylist(), texts(b.column(1))):
            if c != chunk:
                yield from flush()
                chunk, parts, size = c, [], 0
            parts.append(hashes(raw, chars))
            size += len(parts[-1])
            if size > HASHED:
                parts = [np.unique(np.concatenate(parts))]
                size = 0
    yield from flush()


def chunk_scores(docs: pa.Table, weights: pa.Table, tags: list[str], k: int, schema: pa.Schema) -> pa.Table:
    """key, tag, total, mean and top of a chunk's texts (chunk, key, text) by its weights (chunk, feature, w of all tags)."""
    import pandas as pd

    if not len(weights) or not len(docs):
        return schema.empty_table()
    by_hash = pd.Index(weights["feature"].to_numpy())
    w = weights["w"].combine_chunks().flatten().to_numpy().reshape(-1, len(tags))
    found: dict = {}
    for key, (raw, chars) in zip(docs.column(1).to_pylist(), texts(docs.column(2).combine_chunks())):
        a = hashes(raw, chars)
        at = by_hash.get_indexer(a)
        found.setdefault(key, []).append((len(a), at[at >= 0]))
    out: dict[str, list] = {n: [] for n in schema.names}
    for key, parts in found.items():
        n, met = sum(p[0] for p in parts), w[np.concatenate([p[1] for p in parts])]
        if not len(met):
            continue
        total, most = met.sum(axis=0), np.maximum(met, 0.0)
        best = (np.partition(most, len(most) - k, axis=0)[-k:] if len(most) > k else most).sum(axis=0)
        for c, v in zip(schema.names, ([key] * len(tags), tags, total, total / n, best / min(n, k))):
            out[c] += list(v)
    return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def hash_of(name: bytes) -> np.int64:
    """The hash of one named feature, as in hashes()."""
    if name.startswith(b"b:"):
        a, b = (_mixed(np.array([_code(b"u:" + t)], np.int64)) for t in name[2:].split(b"|"))
        return _mixed(a, b)[0]
    return _mixed(np.array([_code(name)], np.int64))[0]
