"""Vectorised helpers over the bytes of many texts at once.

A text is lower-cased in A-Z only and split at ``[\\x20\\x09-\\x0D]+``; hashes are 64-bit polynomials
over a fixed random table of byte values, taken from prefix sums (all arithmetic wraps at 2**64).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(_B))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, SLICE + 8), base, dtype=_U)
        p[0] = 1
        p = _powers[base] = np.multiply.accumulate(p)
        if len(p) > 4 * SLICE:
            del _powers[base]
    return p[:n]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; nulls count as empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(col: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past last, bytes, offsets) of runs of whole texts of about ``most`` bytes; one longer text stands alone."""
    if not len(col):
        return
    data, offs = flat(col)
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, word: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the text it stands in. word: which byte values make words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = word[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hash of each span data[s:e], of the byte values in ``value``."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(value[data] * powers(_BINV, n), out=sums[1:])
    return mix((sums[e] - sums[s]) * powers(_B, n + 1)[e] + (e - s).astype(_U))


LOWER_VALUE = BYTE_VALUE[LOWER]


def pieces(data: np.ndarray, offs: np.ndarray, word: np.ndarray = ~SPACE, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets) of parts of about ``most`` bytes that cut no word, so that a very long text needs no arrays of its length."""
    at, n = 0, len(data)
    while at < n:
        end = at + most
        while end < n:  # on to a byte outside words
            free = np.flatnonzero(~word[data[end : end + most]])
            if len(free):
                end += int(free[0])
                break
            end += most
        end = min(end, n)
        inside = offs[np.searchsorted(offs, at, "right") : np.searchsorted(offs, end)]
        yield at, data[at:end], np.concatenate([[0], inside - at, [end - at]])
        at = end


def word_hashes(data: np.ndarray, offs: np.ndarray, word: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and text of every lower-cased word."""
    out = []
    for at, part, cuts in pieces(data, offs, word):
        s, e, _ = words(part, cuts, word)
        out.append((span_hashes(part, s, e, LOWER_VALUE), s + at, e + at))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(_U), z, z, z
    h, s, e = (np.concatenate(x) for x in zip(*out, strict=True)) if len(out) > 1 else out[0]
    return h, s, e, np.searchsorted(offs, s, "right") - 1


def per_text(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each text's entries in a list sorted by text."""
    return np.searchsorted(doc, np.arange(n + 1))


def shingle_sets(col: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct word shingles as sorted hashes; with fewer words, the whole sequence as one; without, none."""
    for lo, hi, data, offs in slices(col):
        h, _, _, doc = word_hashes(data, offs)
        cut = per_text(doc, hi - lo)
        n = len(h)
        acc = np.zeros(n, dtype=_U)
        for k in range(size):
            if n > k:
                acc[: n - k] = acc[: n - k] * _U(0xD6E8FEB86659FD93) + h[k:]
        acc = mix(acc)
        for i in range(hi - lo):
            a, b = cut[i], cut[i + 1]
            if b - a >= size:
                yield np.unique(acc[a : b - size + 1])
            elif b > a:
                x = int(b - a)
                for v in h[a:b].tolist():
                    x = (x * 0xD6E8FEB86659FD93 + v) % (1 << 64)
                yield mix(np.array([x], dtype=_U))
            else:
                yield np.zeros(0, dtype=_U)
