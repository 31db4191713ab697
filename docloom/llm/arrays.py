"""Texts as code-point arrays: the vectorised tokenising that the text operators share.

One Arrow batch of texts becomes one array of code points; tokens, sentences and blocks are found with array
operations, so that the Python cost is a few nanoseconds a character and does not depend on the number of tokens.
A token is a run of letters and digits, or one Chinese or Japanese character. Tokens are known by a 64-bit hash of
their lower-cased characters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

OTHER, WORD, IDEO, STOP, IDEO_STOP, LINE, SPACE = range(7)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower case of each code point of the basic plane, and whether it is a lower-case letter or digit."""
    kind = np.zeros(0x10000, np.uint8)
    lower = np.arange(0x10000, dtype=np.uint32)
    small = np.zeros(0x10000, bool)
    for i in range(0x10000):
        c = chr(i)
        if 0x3040 <= i <= 0x30FF or 0x3400 <= i <= 0x9FFF or 0xF900 <= i <= 0xFAFF:
            kind[i] = IDEO if c.isalnum() or i == 0x30FC else OTHER
        elif c.isalnum():
            kind[i] = WORD
            if len(c.lower()) == 1:
                lower[i] = ord(c.lower())
            small[i] = c.islower() or c.isdigit()
        elif c.isspace():
            kind[i] = SPACE
    for full in range(0xFF01, 0xFF5F):  # full-width forms are read as their plain ones
        half = full - 0xFEE0
        lower[full] = lower[half]
        kind[full], small[full] = kind[half], small[half]
    for c in ".!?":
        kind[ord(c)] = STOP
    for c in "。！？．｡":
        kind[ord(c)] = IDEO_STOP
    kind[10] = kind[13] = kind[0x2028] = kind[0x2029] = LINE
    return kind, lower, small


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@dataclass
class Tokens:
    """points: code points; begin: start of each text in them (one more at the end); start, end, hash, text: of each token."""

    points: np.ndarray
    begin: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts joined by a NUL each, as code points, with the start of each (null counts as empty)."""
    clean = [(t.replace("\x00", " ") if "\x00" in t else t) if t else "" for t in texts]
    raw = ("\x00".join(clean) + "\x00").encode("utf-32-le", "replace")
    points = np.frombuffer(raw, np.uint32).copy()
    return points, np.concatenate([[0], np.cumsum([len(t) + 1 for t in clean])]).astype(np.int64)


def tokenize(texts: list[str | None], escapes: bool = True) -> Tokens:
    """Tokens of a batch of texts. With escapes, a written backslash-n or backslash-t counts as white space."""
    kinds, lower, _ = tables()
    points, begin = code_points(texts)
    if escapes:
        at = np.flatnonzero(points[:-1] == 92)
        at = at[(points[at + 1] == 110) | (points[at + 1] == 116)]
        points[at] = points[at + 1] = 10
    wide = np.flatnonzero(points > 0xFFFF)
    flat = points.astype(np.intp)
    flat[wide] = 0
    kind = kinds.take(flat)
    kind[wide[(points[wide] < 0x40000) & (points[wide] >= 0x20000)]] = IDEO
    word = kind == WORD
    ideo = kind == IDEO
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    start = np.flatnonzero((word & ~before) | ideo)
    end = np.flatnonzero((word & ~after) | ideo) + 1
    up, down = _powers(1 << max(12, int(len(points) - 1).bit_length()))
    total = lower.take(flat).astype(np.uint64)
    total[wide] = points[wide]
    total *= up[: len(points)]
    np.cumsum(total, out=total)
    left = np.where(start > 0, total[start - 1], np.uint64(0))
    value = (total[end - 1] - left) * down[start]
    value ^= value >> np.uint64(29)
    value *= _MIX
    value ^= value >> np.uint64(32)
    return Tokens(points, begin, kind, start, end, value, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, begin))))


def sentence_starts(t: Tokens) -> np.ndarray:
    """For each token, whether it begins a sentence: after a stop, an empty line, a list mark, or in a new text.

    A full stop after a token of up to three letters ("e.g. v1", "no. 4") ends nothing if a small letter or digit follows.
    """
    n = len(t.start)
    first = np.zeros(n, bool)
    if not n:
        return first
    first[0] = True
    first[1:] = t.text[1:] != t.text[:-1]
    size = len(t.points)
    stop = np.flatnonzero(t.kind == STOP)
    follows = t.kind[np.minimum(stop + 1, size - 1)]
    stop = stop[(follows != WORD) & (follows != IDEO)]
    line = np.flatnonzero(t.kind == LINE)
    nxt = np.minimum(line + 1, size - 1)
    mark = (t.kind[nxt] == LINE) | np.isin(t.points[nxt], np.array([35, 42, 45, 124, 62], np.uint32))
    soft, hard = np.zeros((2, n + 1), bool)
    soft[np.searchsorted(t.start, stop)] = True
    hard[np.searchsorted(t.start, np.concatenate([np.flatnonzero(t.kind == IDEO_STOP), line[mark]]))] = True
    _, _, small = tables()
    nextpoint = t.points[t.start[1:]]
    nextsmall = small[np.where(nextpoint > 0xFFFF, 0, nextpoint)]
    lastpoint = t.points[t.end[:-1] - 1]
    short = (t.end[:-1] - t.start[:-1] <= 3) & ~((lastpoint >= 48) & (lastpoint <= 57))
    first[1:] |= hard[1:n] | (soft[1:n] & ~(short & nextsmall))
    return first


def bins(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes as numbers below size, a power of two."""
    return (hashes & np.uint64(size - 1)).astype(np.int64)


def pairs(t: Tokens) -> np.ndarray:
    """A hash for each token with the next one (0 where the text ends)."""
    out = np.zeros(len(t.hash), np.uint64)
    if len(out) > 1:
        out[:-1] = (t.hash[:-1] * _BASE + t.hash[1:]) * _MIX
        out[:-1] ^= out[:-1] >> np.uint64(31)
        out[:-1][t.text[1:] != t.text[:-1]] = 0
    return out
