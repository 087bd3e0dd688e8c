"""Vectorised pre-token spans of the byte-level BPE pattern, and their hashes.

The pattern's alternatives are: contractions, `` ?letters``, `` ?numbers``, `` ?others``, white space not
before a non-space, white space. Over runs of one character class this reads: the last character of a
white-space run before other text stands apart from the run; it joins the next run if it is U+0020; and an
apostrophe that stands alone between other classes takes a following s, t, re, ve, m, ll or d.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

from skylattice.llm.arrays import BASE, mix, powers

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: What an apostrophe may take; as the pattern has them.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point, asked of the regex library once per process."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            shift = [i + 0x800 * (i >= 0xD800) for i in (m.start(), m.end() - 1)]
            table[shift[0] : shift[1] + 1] = kind
    return table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as code points, and where each begins."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return points, off


def spans(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start of each pre-token; the next start, or the end, ends it. No pre-token crosses a text boundary."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    new = np.ones(n + 1, bool)
    new[1:n] = kind[1:] != kind[:-1]
    new |= edge
    space = kind == SPACE
    # the last character of a white-space run that other text follows
    tail = space & new[1:] & ~edge[1:]
    tail[-1] = False
    start = new[:n].copy()
    start[tail] = True
    joins = np.flatnonzero(tail & (points == 32)) + 1
    start[joins] = False
    # contractions: an apostrophe run of length 1 that begins a token, then letters
    quote = np.flatnonzero((points == 39) & start & new[:n] & new[1:])
    if len(quote):
        quote = quote[(quote + 1 < n)]
        quote = quote[~edge[quote + 1]]
        second = points[quote + 1]
        third_ok = quote + 2 < n
        third = np.where(third_ok, points[np.minimum(quote + 2, n - 1)], 0)
        third = np.where(third_ok & ~edge[np.minimum(quote + 2, n)], third, 0)
        size = np.zeros(len(quote), np.int64)
        for c in CONTRACTIONS:
            hit = (second == ord(c[0])) if len(c) == 1 else (second == ord(c[0])) & (third == ord(c[1]))
            size[(size == 0) & hit] = len(c)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        inside = after < n
        start[after[inside]] = True
    return np.flatnonzero(start)


@functools.cache
def point_values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * BASE)


def span_keys(points: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit key of each pre-token's characters."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lens = np.diff(np.append(start, len(points)))
    at = np.arange(len(points)) - np.repeat(start, lens)
    return mix(np.add.reduceat(point_values()[points] * powers(int(lens.max()))[at], start) + lens.astype(np.uint64))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, index of one example, place of each key in them)."""
    return np.unique(keys, return_index=True, return_inverse=True)
