"""Pieces of texts around content-defined anchors.

A text is a sequence of symbols (words or bytes). Every window of ``length`` symbols has an anchor: of
the grams inside it, the one of the smallest hash, rightmost on ties. The windows that share an anchor
follow each other, and together make a piece. Equal windows have equal anchors at equal offsets,
wherever they stand; so windows need to be compared only among pieces of one anchor, and a window whose
anchor occurs once occurs once itself.
"""

from __future__ import annotations

import numpy as np

#: Window starts looked at in one go; longer texts are cut into pieces of pieces, which changes no result.
STARTS = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that small differences spread over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A number for each byte, and odd multipliers, one for each doubling.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MIX)
_STEPS = mix(np.arange(300, 364, dtype=np.uint64) * _MIX) | np.uint64(1)


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` symbols (uint8 or uint64), built from runs of half the length.

    Runs of a power of two symbols come first; two overlapping ones make a run of ``k``.
    """
    if len(symbols) < k:
        return np.zeros(0, dtype=np.uint64)
    h, span, step = _BYTE[symbols] if symbols.dtype == np.uint8 else symbols, 1, 0
    while span < k:
        d = min(span, k - span)
        left = h[:-d] * _STEPS[step]
        left += h[d:]
        h, span, step = left, span + d, step + 1
    return mix(h)


def window_anchors(g: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` neighbouring hashes, where the smallest stands, rightmost on ties."""
    at, low, span = np.arange(len(g), dtype=np.int32), g, 1

    def merge(d: int) -> None:
        nonlocal at, low
        right = low[d:] <= low[:-d]
        at = np.where(right, at[d:], at[:-d])
        low = np.minimum(low[d:], low[:-d])

    while 2 * span <= width:
        merge(span)
        span *= 2
    if span < width:
        merge(width - span)
    return at.astype(np.int64)


def pieces(symbols: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, offset of the anchor from the first start, first start, number of starts) of one text."""
    out = []
    n = len(symbols) - length + 1
    for a in range(0, max(n, 0), STARTS):
        m = min(STARTS, n - a)
        g = gram_hashes(symbols[a : a + m + length - 1], k)
        at = window_anchors(g, length - k + 1)[:m]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        p = at[first]
        out.append((g[p].view(np.int64), p - first, first + a, np.diff(np.append(first, m))))
    if not out:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def batched(parts: list[np.ndarray], length: int, k: int):
    """``pieces`` of many texts: yields (text numbers, anchor hash, offset, first start, starts).

    Short texts are laid end to end and handled at once; a window that would reach into the next text
    is none.
    """
    group: list[int] = []
    total = 0

    def flush():
        lens = np.array([len(parts[i]) for i in group])
        base = np.concatenate(([0], np.cumsum(lens)))
        joined = np.concatenate([parts[i] for i in group])
        g = gram_hashes(joined, k)
        at = window_anchors(g, length - k + 1)
        m = len(at)
        text = np.repeat(np.arange(len(group)), lens)[:m]
        valid = np.arange(m) + length <= base[text + 1]
        turn = np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])))
        first = np.flatnonzero(turn)
        size = np.diff(np.append(first, m))
        keep = valid[first]
        first, size = first[keep], size[keep]
        p, t = at[first], text[first]
        return np.array(group)[t], g[p].view(np.int64), p - first, first - base[t], size

    for i, x in enumerate(parts):
        if len(x) < length:
            continue
        if len(x) > STARTS:
            a, o, f, s = pieces(x, length, k)
            yield np.full(len(a), i), a, o, f, s
            continue
        group.append(i)
        total += len(x)
        if total > STARTS:
            yield flush()
            group, total = [], 0
    if group:
        yield flush()
