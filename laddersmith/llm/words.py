"""Vectorised words, hashes and shingles over the bytes of an Arrow string column.

Texts stay in Arrow's buffers as UTF-8; nothing here makes a Python string per word.
Hashes are 64-bit: eight bytes a step go through an avalanche function that starts from the
length, so that words of up to eight bytes never collide with others of their length; long spans go
through BLAKE2b. (A polynomial modulo 2**64 would not do: Thue-Morse strings collide under every base.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes from which on a span is hashed by BLAKE2b.
LONG = 256
_ODD = U(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing)
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = False
NOT_ALNUM[97:123] = False


def mix(x: np.ndarray, own: bool = False) -> np.ndarray:
    """Avalanche step (the finaliser of splitmix64); in place if the array is the caller's ``own``."""
    x = x if own else x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which is faster here than np.unique's hash table)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros behind the end), as little-endian integers: a view, one more than bytes."""
    wide = np.zeros(len(buf) + 8, np.uint8)
    wide[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, np.dtype("<u8"), wide, strides=(1,))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], the same wherever the bytes stand."""
    n = end - start
    h = n.astype(U) * _ODD
    long = n > LONG
    todo = np.flatnonzero(~long & (n > 0))
    if len(todo):
        wide = eights(buf)
        at, left = start[todo], n[todo]
        while len(todo):
            w = wide[at].astype(U)
            part = left < 8
            w[part] &= (U(1) << (left[part].astype(U) * U(8))) - U(1)
            h[todo] = mix(h[todo] ^ w)
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
    if long.any():
        raw = memoryview(np.ascontiguousarray(buf))
        for i in np.flatnonzero(long).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def window_hashes(buf: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the ``k`` bytes (8 or more) from each place on that has so many: halves are joined by an avalanche step, from eight bytes up."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    x = mix(np.array(eights(buf)[: len(buf) - 7]) + U(seed) * _ODD)
    size = 8
    while size < k:
        shift = min(size, k - size)  # the last step's halves may overlap
        a = x[: len(x) - shift] * U(0xD6E8FEB86659FD93)
        a += x[shift:] * U(0xC2B2AE3D27D4EB4F)
        x = mix(a, own=True)
        size += shift
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if "binary" in str(col.type) else "")
    _, offs, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8), o


def chunks(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows, of about ``limit`` bytes or one row."""
    data, offs = buffers(col)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more at the end)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    is_word = np.zeros(n + 2, bool)
    np.logical_not(sep[buf], out=is_word[1 : n + 1])
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = is_word[1:] & (~is_word[:-1] | edge)
    end = is_word[:-1] & (~is_word[1:] | edge)
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    return s, e, np.searchsorted(s, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, starts, ends, first word of each row. ``buf`` is hashed as it stands."""
    s, e, first = word_spans(buf, offs, sep)
    return span_hashes(buf, s, e), s, e, first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles (its whole sequence if shorter), and each row's first shingle.

    Rows without words have none.
    """
    n_words = np.diff(first)
    n_out = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(n_out, out=at[1:])
    if not len(words):
        return np.zeros(0, U), at
    h = np.zeros(len(words) + k, U)
    m = U(0xD1342543DE82EF95)
    padded = np.zeros(len(words) + k, U)
    padded[: len(words)] = words
    for j in range(k):
        h[: len(words)] = h[: len(words)] * m + padded[j : j + len(words)]
    row = np.repeat(np.arange(len(n_out)), n_out)
    src = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    out = mix(h[src])
    for r in np.flatnonzero((n_words > 0) & (n_words < k)):
        x = 0
        for w in words[first[r] : first[r + 1]].tolist():
            x = (x * 0xD1342543DE82EF95 + w + 1) & 0xFFFFFFFFFFFFFFFF
        out[at[r]] = mix(np.array([x ^ int(n_words[r])], U))[0]
    return out, at
