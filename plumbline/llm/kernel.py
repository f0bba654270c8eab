"""Vectorised passes over the UTF-8 bytes of an Arrow batch of texts.

A batch's texts lie end to end in one buffer. Words, their 64-bit hashes and windows over them are found
with whole-array operations in pieces of about 256 kB, so the memory of a task does not depend on the
number of rows; only arrays of a few bytes a word follow a batch's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=U).copy()
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def fixed_randoms(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * U(0x9E3779B97F4A7C15))


_BYTE = fixed_randoms(7, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=U)
    with np.errstate(over="ignore"):
        k = 1
        b = U(base)
        while k < len(out):
            step = out[: min(k, len(out) - k)]
            out[k : k + len(step)] = step * b
            k *= 2
            b = b * b
    return out


_BASE = 0xD1342543DE82EF95
_POW, _INV = _powers(2 * PIECE), _powers(2 * PIECE, pow(_BASE, -1, 1 << 64))


def _is_alnum() -> np.ndarray:
    ok = np.zeros(256, dtype=bool)
    ok[48:58] = ok[65:91] = ok[97:123] = True
    ok[128:] = True
    return ok


def _is_visible() -> np.ndarray:
    ok = np.ones(256, dtype=bool)
    ok[[32, 9, 10, 11, 12, 13]] = False
    return ok


#: Bytes that belong to words: of letters and digits (A-Z are lower-cased first), or of anything but white space.
ALNUM, VISIBLE = _is_alnum(), _is_visible()


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(raw: np.ndarray, offsets: np.ndarray, ok: np.ndarray) -> list[int]:
    """Where a piece may end: between texts, or else between words."""
    cuts, at, n = [0], 0, len(raw)
    while n - at > PIECE:
        k = int(offsets[np.searchsorted(offsets, at + PIECE, side="right") - 1])
        if k <= at:
            gap = np.flatnonzero(~ok[raw[at : at + PIECE]])
            k = at + int(gap[-1]) + 1 if len(gap) else 0
            ahead = at + PIECE
            while not k:
                gap = np.flatnonzero(~ok[raw[ahead : ahead + PIECE]])
                k = ahead + int(gap[0]) + 1 if len(gap) else 0
                ahead += PIECE
                if not k and ahead >= n:
                    k = n
            following = offsets[np.searchsorted(offsets, at, side="right")]
            k = int(min(k, following))
        cuts.append(k)
        at = k
    return cuts + [n] * (cuts[-1] < n)


def words(raw: np.ndarray, offsets: np.ndarray, ok: np.ndarray, lower: bool = True, spans: bool = False):
    """Hashes of all words of all texts, and for each text where its words begin in that array
    (length texts + 1). With spans, also the byte each word starts at and ends before."""
    hashes, starts, ends = [], [], []
    value = np.where(ok, _BYTE[_LOWER] if lower else _BYTE, U(0))
    cuts = _cuts(raw, offsets, ok)
    for a, b in zip(cuts, cuts[1:]):
        inside = ok[raw[a:b]]
        edge = inside.copy()
        edge[1:] ^= inside[:-1]  # where words begin or have just ended
        inner = offsets[np.searchsorted(offsets, a, side="left") : np.searchsorted(offsets, b, side="left")] - a
        within = inner[(inner > 0) & inside[inner] & inside[inner - 1]] if len(inner) else inner  # a word meets the next text's
        at = np.flatnonzero(edge)
        if len(within):
            at = np.sort(np.concatenate([at, np.repeat(np.unique(within), 2)]))
        if not len(at):
            continue
        if len(at) % 2:
            at = np.append(at, b - a)
        st, en = at[::2], at[1::2]
        n = b - a
        power, inverse = (_POW, _INV) if n <= len(_POW) else (_powers(n), _powers(n, pow(_BASE, -1, 1 << 64)))
        with np.errstate(over="ignore"):
            h = np.add.reduceat(value[raw[a:b]] * power[:n], st) * inverse[st] + (en - st).astype(U) * U(0x9E3779B97F4A7C15)
        hashes.append(mix(h))
        starts.append(st + a)
        ends.append(en + a)
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, dtype=t)
    st = cat(starts, np.int64)
    by_text = np.searchsorted(st, offsets, side="left")
    if spans:
        return cat(hashes, U), by_text, st, cat(ends, np.int64)
    return cat(hashes, U), by_text


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words (of those that cross texts too; callers take what lies inside)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(n, dtype=U)
    with np.errstate(over="ignore"):
        for j, m in enumerate(fixed_randoms(11, k)):
            out += h[j : j + n] * (m | U(1))
    return mix(out)


def shingle_sets(h: np.ndarray, by_text: np.ndarray, k: int):
    """For each text, the sorted distinct hashes of its k-word shingles; a text of fewer words, but not none,
    has its whole sequence as one."""
    grams = windows(h, k)
    for a, b in zip(by_text[:-1].tolist(), by_text[1:].tolist()):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        elif b > a:
            n = b - a
            yield mix(windows(h[a:b], n) ^ U(n))
        else:
            yield np.zeros(0, dtype=U)


def long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=U).view(np.int64)
