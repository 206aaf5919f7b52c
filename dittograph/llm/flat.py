"""Whole Arrow batches of texts as flat numpy arrays: code points, words, hashes.

Every function works on all texts of a chunk at once; none loops over
characters, words or documents in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TOP = 0x32400  # beyond it Unicode has no letters or digits so far


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20, max_rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``max_bytes`` of text each; a longer text is a slice of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total, start = np.cumsum(size), 0
    while start < len(size):
        base = total[start] - size[start]
        end = min(max(int(np.searchsorted(total, base + max_bytes, "right")), start + 1), start + max_rows)
        yield batch.slice(start, end - start)
        start = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets between them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (uint32) and the offsets between them."""
    raw, at = utf8(texts)
    try:
        wide = raw.tobytes().decode().encode("utf-32-le")
    except UnicodeDecodeError:
        fixed = [raw[a:b].tobytes().decode(errors="replace") for a, b in zip(at[:-1], at[1:])]
        return codepoints(pa.array(fixed, pa.large_string()))
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return np.frombuffer(wide, "<u4"), lead[at]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower, word = np.arange(_TOP + 1, dtype=np.uint32), np.zeros(_TOP + 1, bool)
    for c in range(_TOP):
        s = chr(c)
        word[c] = s.isalnum()
        small = s.lower()
        if small != s and len(small) == 1:
            lower[c] = ord(small)
    return lower, word


def lowered(cp: np.ndarray) -> np.ndarray:
    """Code points in lower case, one for one."""
    table = _tables()[0]
    return np.where(cp < _TOP, table[np.minimum(cp, _TOP)], cp)


def is_word(cp: np.ndarray) -> np.ndarray:
    """Whether a code point is a letter or a digit."""
    return _tables()[1][np.minimum(cp, _TOP)]


def runs(flag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of true flags; a run never crosses two texts."""
    first = np.zeros(len(flag) + 1, bool)
    first[at[:-1]] = True
    before = np.zeros(len(flag), bool)
    before[1:] = flag[:-1]
    start = np.flatnonzero(flag & (~before | first[:-1]))
    after = np.zeros(len(flag), bool)
    after[:-1] = flag[1:]
    end = np.flatnonzero(flag & (~after | first[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64, in place where it can."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_grown: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; they are kept, and grow with the longest chunk."""
    if len(_grown[0]) < n:
        for k, x in enumerate((_BASE, _INVERSE)):
            p = np.full(n, x, U64)
            p[0] = 1
            _grown[k] = np.cumprod(p)
    return _grown


def span_hashes(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``units`` by one prefix sum of a polynomial."""
    n = 1 << max(16, int(len(units)).bit_length())
    power, inverse = _powers(n)
    prefix = np.zeros(len(units) + 1, U64)
    np.cumsum((units.astype(U64) + U64(1)) * power[: len(units)], out=prefix[1:])
    return mixed((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


#: ASCII bytes that no word has.
_APART = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def parts(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """A text longer than ``most`` bytes, where it is alone, in parts that end between words; all else as it is."""
    raw, at = utf8(texts)
    if len(at) != 2 or len(raw) <= most:
        yield texts
        return
    begin = 0
    while begin < len(raw):
        end = begin + most
        while end < len(raw) and not len(hit := np.flatnonzero(_APART[raw[end : end + 4096]])):
            end += 4096
        end = min(len(raw), end + int(hit[0]) + 1) if end < len(raw) else len(raw)
        yield pa.array([raw[begin:end].tobytes().decode(errors="replace")], pa.large_string())
        begin = end


def words(texts: pa.Array, most: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and digits, lower case) and each word's text."""
    found = []
    for part in parts(texts, most):
        cp, at = codepoints(part)
        start, end, doc = runs(is_word(cp), at)
        found.append((span_hashes(lowered(cp), start, end), doc))
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found))


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words and their texts; a shorter text is one gram of all its words."""
    if len(h) == 0:
        return h, doc
    size = np.bincount(doc)
    begin = np.cumsum(size) - size
    total = np.zeros(len(h), U64)
    left = np.minimum((begin + size)[doc] - np.arange(len(h)), n)
    for j in range(n):
        odd = U64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        part = np.zeros(len(h), U64)
        part[: len(h) - j] = h[j:] * odd
        if j:
            part[left <= j] = 0
        total += part
    keep = (left == n) | ((size[doc] < n) & (np.arange(len(h)) == begin[doc]))
    return mixed(total[keep] + U64(n)), doc[keep]
