"""Word shingles of texts as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Distinct words a task keeps; it begins anew beyond, which changes no result.
KEPT_WORDS = 1_000_000


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of a text; optionally each with the frequency class of its rarest word.

    ``frequent`` holds sorted word hashes with a class each (greater: more frequent); other words have class 0.
    """

    def __init__(self, width: int, frequent: tuple[np.ndarray, np.ndarray] | None = None):
        self.width, self.frequent = width, frequent
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes, self.classes = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def _codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KEPT_WORDS:
            self._forget()
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
            self.hashes = np.r_[self.hashes, h]
            if self.frequent is not None:
                keys, classes = self.frequent
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                self.classes = np.r_[self.classes, np.where(found, classes[at] if len(keys) else 0, 0).astype(np.uint64)]
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def shingles(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """For each text its shingle hashes (with repeats) and their classes; no words, no shingles."""
        lists = [words_of(t) for t in texts]
        codes = self._codes([w for ws in lists for w in ws])
        h = self.hashes[codes]
        c = self.classes[codes] if self.frequent is not None else None
        n, k = len(h), self.width
        run = np.full(max(n - k + 1, 0), k, np.uint64)
        weight = np.full(len(run), 255, np.uint64) if c is not None else None
        for i in range(k):
            run = mixed(run + h[i:i + len(run)] * np.uint64(2 * i + 0x9E3779B97F4A7C15))
            if c is not None:
                np.minimum(weight, c[i:i + len(run)], out=weight)
        at = 0
        for ws in lists:
            if len(ws) >= k:
                s = slice(at, at + len(ws) - k + 1)
                yield run[s], weight[s] if c is not None else None
            elif ws:
                one = np.array([len(ws)], np.uint64)
                for i in range(len(ws)):
                    one = mixed(one + h[at + i:at + i + 1] * np.uint64(2 * i + 0x9E3779B97F4A7C15))
                yield one, c[at:at + len(ws)].min(keepdims=True) if c is not None else None
            else:
                yield run[:0], weight[:0] if c is not None else None
            at += len(ws)
