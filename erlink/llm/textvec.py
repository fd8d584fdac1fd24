"""Whole-batch tokenising and hashing with numpy.

Texts of a batch are joined into one byte array with a separator byte between
them, so that word boundaries, word hashes and hashes of word sequences come
from a few array passes instead of a Python loop over words.  All hashes are
64-bit and depend on the bytes only, never on the process or the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32

#: Byte classes: True where a byte of UTF-8 text belongs to a word.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


#: Masks that keep the first 0..8 bytes of a little-endian chunk.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one by one; up to here all words take a step per eight bytes together.
LONG = 1024


@dataclass
class Words:
    """Words of a batch: byte start and end, owning document, and the first word of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # len(docs) + 1 offsets into the words
    edge: np.ndarray  # len(docs) + 1 offsets into the bytes; a separator ends each text


def join_bytes(texts, sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes with ``sep`` after each, and where each text starts (one more entry at the end).

    Null texts count as empty.
    """
    raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    at = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    return np.frombuffer(sep.join([*raw, b""]), dtype=np.uint8), at


def split_words(texts, is_word: np.ndarray, lower: bool) -> Words:
    """Maximal runs of word bytes; with ``lower``, A-Z are lower-cased first."""
    data, at = join_bytes(texts)
    if lower:
        data = _LOW[data]
    inside = is_word[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]  # the last byte is a separator, so runs are closed
    first = np.searchsorted(start, at).astype(np.int64)
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(first))
    return Words(data, start, end, doc, first, at)


def _chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as little-endian numbers; ``data`` is followed by zeros."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def word_hashes(w: Words, seed: int = 0, block: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word's bytes: chained mixing of its eight-byte chunks, XXH64 beyond ``LONG`` bytes."""
    out = np.empty(len(w.start), dtype=np.uint64)
    chunk = _chunks(w.data)
    for i in range(0, len(out), block):
        start = w.start[i : i + block]
        size = w.end[i : i + block] - start
        h = mix((chunk[start] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _MUL + np.uint64(seed)))
        more, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(more):
            left = size[more] - at
            h[more] = mix(h[more] ^ (chunk[start[more] + at] & _KEEP[np.minimum(left, 8)]))
            at += 8
            more = more[left > 8]
        for k in np.flatnonzero(size > LONG):
            h[k] = xxhash.xxh64_intdigest(w.data[start[k] : start[k] + size[k]].tobytes(), seed)
        out[i : i + block] = h
    return out


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word ``i`` of ``a`` and word ``j`` of ``b`` have the same bytes, for each pair of indexes."""
    size = a.end[i] - a.start[i]
    same = size == b.end[j] - b.start[j]
    left, right = _chunks(a.data), _chunks(b.data)
    some, at = np.flatnonzero(same & (size > 0)), 0
    while len(some) and at < LONG:
        rest = size[some] - at
        keep = _KEEP[np.minimum(rest, 8)]
        ok = (left[a.start[i[some]] + at] & keep) == (right[b.start[j[some]] + at] & keep)
        same[some[~ok]] = False
        some, at = some[ok & (rest > 8)], at + 8
    for k in some:  # very long words
        x, y, n = a.start[i[k]], b.start[j[k]], size[k]
        same[k] = np.array_equal(a.data[x : x + n], b.data[y : y + n])
    return same


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (len(h) - n + 1 of them), order-sensitive; every join of two parts is mixed."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out, size, have, width = h, 1, None, 0  # hashes of `size` words; `have` those of `width` words
    while n:
        if n & 1:
            if have is None:
                have = out
            else:  # `have` first, then `out`
                m = len(h) - width - size + 1
                have = mix(have[:m] * _MUL + out[width : width + m])
            width += size
        n >>= 1
        if n:
            m = len(out) - size
            out, size = mix(out[:m] * _MUL + out[size:]), 2 * size
    return mix(have)


def inside_documents(w: Words, n: int) -> np.ndarray:
    """Start indexes of the runs of ``n`` words that stay inside one document."""
    if len(w.doc) < n:
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(w.doc[: len(w.doc) - n + 1] == w.doc[n - 1 :])
