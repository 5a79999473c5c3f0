"""Pre-token boundaries of many texts at once, by array operations on their code points.

Both published split patterns are runs of letters, numbers, other characters and blanks with a few
exceptions (contractions, one blank that joins the next run, single digits), so the boundaries follow
from class changes between neighbours.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex

BLANK, LETTER, NUMBER, OTHER, EDGE = range(5)


class Spans(NamedTuple):
    """Pre-tokens of a block: ``text[start:end]`` of the joined texts; ``first[i]`` is the first of text i."""

    text: str
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    origin: np.ndarray

    points: np.ndarray

    def words(self, which: np.ndarray | None = None) -> list[str]:
        """The pre-tokens, or some of them."""
        text, start, end = self.text, self.start, self.end
        if which is not None:
            start, end = start[which], end[which]
        return [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]

    def keys(self) -> np.ndarray:
        """A rolling hash of each pre-token."""
        n = len(self.points)
        forth, back = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        mixed = (self.points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= forth[:n]
        np.cumsum(mixed, out=sums[1:])
        return (sums[self.end] - sums[self.start]) * back[self.start]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """For each pre-token the number of its distinct word, and for each distinct word one place of it.

        Words are told apart by a rolling hash; each word is then held against the word that stands for
        it, character by character, so that a collision cannot pass.
        """
        codes, seen = pd.factorize(self.keys())
        place = np.empty(len(seen), np.int64)
        place[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        size = self.end - self.start
        if len(codes):
            other = place[codes]
            again = np.flatnonzero(other != np.arange(len(codes)))
            shift = np.repeat(self.start[other[again]] - self.start[again], size[again])
            here = np.repeat(self.start[again] - (np.cumsum(size[again]) - size[again]), size[again])
            here += np.arange(len(here))
            if (size[again] != size[other[again]]).any() or (self.points[here] != self.points[here + shift]).any():
                words = self.words()
                numbers: dict[str, int] = {}
                codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                place = np.unique(codes, return_index=True)[1]
        return codes, place


@functools.lru_cache(maxsize=1)
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    def powers(b: int) -> np.ndarray:
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.cumprod(out)
    return powers(base), powers(pow(base, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    return _power_table(1 << max(19, int(n).bit_length()))


def _table(runs: Callable[[str, str], Iterable[tuple[int, int]]]) -> np.ndarray:
    points = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
    every = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for a, b in runs(pattern, every):
            table[points[a:b]] = kind
    return table


@functools.cache
def byte_level_classes() -> np.ndarray:
    """The class of each code point as the rank files' library sees it."""
    return _table(lambda pattern, every: [m.span() for m in regex.finditer(pattern, every)])


@functools.cache
def word_end_classes() -> np.ndarray:
    """The same by the tokenizers library, whose Unicode tables are older."""
    from tokenizers import Regex, pre_tokenizers

    def runs(pattern: str, every: str) -> list[tuple[int, int]]:
        return [span for _, span in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)]
    return _table(runs)


def _joined(texts: list[str], table: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one edge after each: text, code points, classes and the places of the edges."""
    text = "\n".join(texts) + "\n"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kinds = table[points]
    kinds[edges] = EDGE
    return text, points, kinds, edges


def _neighbours(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.empty_like(kinds), np.empty_like(kinds)
    before[0], before[1:] = EDGE, kinds[:-1]
    after[-1], after[:-1] = EDGE, kinds[1:]
    return before, after


#: The contractions of both patterns, without their apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _contractions(text: str, points: np.ndarray, kinds: np.ndarray, after: np.ndarray, start: np.ndarray) -> None:
    """An apostrophe that begins a pre-token takes a contraction's letters from the letter run after it."""
    for i in np.flatnonzero((points == 39) & start & (after == LETTER)).tolist():
        end = next((i + 1 + len(c) for c in CONTRACTIONS if text.startswith(c, i + 1)), 0)
        if end:
            start[i + 1] = False
            if kinds[end] == LETTER:
                start[end] = True


def _spans(text: str, points: np.ndarray, kinds: np.ndarray, edges: np.ndarray, start: np.ndarray,
           drop: tuple[int, ...]) -> Spans:
    start[edges] = True
    start[edges[:-1] + 1] = True
    at = np.flatnonzero(start)
    end = np.empty_like(at)
    end[:-1], end[-1] = at[1:], len(kinds)
    keep = ~np.isin(kinds[at], drop)
    at, end = at[keep], end[keep]
    origin = np.r_[0, edges[:-1] + 1]
    return Spans(text, at, end, np.r_[np.searchsorted(at, origin), len(at)], origin, points)


def byte_level_spans(texts: list[str], classes: np.ndarray | None = None) -> Spans:
    """Every match of the byte-level pattern (``public_tokenizers.PATTERN``); texts are covered without gaps.
    ``classes`` are those of the rank files' library unless given."""
    text, points, kinds, edges = _joined(texts, byte_level_classes() if classes is None else classes)
    before, after = _neighbours(kinds)
    start = kinds != before
    last = (kinds == BLANK) & (after != BLANK) & (after != EDGE)
    start |= last
    start[1:][(last & (points == 32))[:-1]] = False
    _contractions(text, points, kinds, after, start)
    return _spans(text, points, kinds, edges, start, (EDGE,))


def word_end_spans(texts: list[str]) -> Spans:
    """Every match of the word-end pattern: letter runs, single numbers, runs of others; blanks fall away."""
    text, points, kinds, edges = _joined(texts, word_end_classes())
    before, after = _neighbours(kinds)
    start = (kinds != before) | (kinds == NUMBER)
    _contractions(text, points, kinds, after, start)
    return _spans(text, points, kinds, edges, start, (EDGE, BLANK))
