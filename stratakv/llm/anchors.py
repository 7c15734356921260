"""Winnowed anchors: seeds of repeats of at least `length` symbols, and the spans of windows they stand for.

A window is `length` consecutive symbols of one text. Its anchor is its first k-gram of least hash. Which
k-gram that is depends on the window's symbols alone, so equal windows have equal anchors at equal offsets,
and a window that occurs twice always shows as an anchor whose k-gram occurs twice. Consecutive windows with
the same anchor form a span; every window belongs to exactly one span.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from stratakv.llm.text import Family


class Spans(NamedTuple):
    key: np.ndarray  # hash of the anchor
    h: np.ndarray  # hash of all symbols from the first window's start to the last window's end
    text: np.ndarray  # which text
    lo: np.ndarray  # start of the first window in the text
    n: np.ndarray  # number of windows
    at: np.ndarray  # where the anchor is in the text


#: Hashes are compared by their upper half; the lower half holds the place, so that the first least one is the least number.
HIGH = np.uint64(2**64 - 2**32)


def least(hashes: np.ndarray, w: int) -> np.ndarray:
    """Where the first least hash is in each run of w of them. Places are below 2**32; the upper 32 bits decide."""
    low, span = hashes & HIGH | np.arange(len(hashes), dtype=np.uint64), 1
    while span * 2 <= w:
        n = len(low) - span
        low, span = np.minimum(low[:n], low[span:]), span * 2
    if span < w:
        low = np.minimum(low[: span - w], low[w - span :])
    return low.astype(np.uint32)


def spans(seed: tuple[Family, np.ndarray], check: tuple[Family, np.ndarray] | None, first: np.ndarray, length: int, k: int) -> Spans:
    """seed, check: hash families with prefix hashes of all texts' symbols; first: where each text begins in these.
    Without check, h is left out: keys alone, for counting."""
    size = np.diff(first)
    wins = np.maximum(size - length + 1, 0)
    if not wins.any():
        none = np.zeros(0, np.int64)
        return Spans(none, none, none, none, none, none)
    fam, h = seed
    at = least(fam.grams(h, k), length - k + 1)
    # Windows of each text are a..b-1; those between reach over the end of a text.
    a = first[:-1][wins > 0]
    b = a + wins[wins > 0]
    new = np.r_[True, at[1:] != at[:-1], True]
    new[a] = new[b] = True
    cut = np.flatnonzero(new)
    lo, hi = cut[:-1], cut[1:] - 1
    own = np.searchsorted(a, lo, "right") - 1
    use = (own >= 0) & (lo < b[own])
    lo, hi = lo[use], hi[use]
    at = at[lo].astype(np.int64)
    text = np.searchsorted(first, lo, "right") - 1
    return Spans(fam.span(h, at, at + k), check[0].span(check[1], lo, hi + length) if check else at[:0], text, lo - first[text], hi - lo + 1, at - first[text])
