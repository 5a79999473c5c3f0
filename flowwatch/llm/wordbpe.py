"""Token ids by a word-end BPE vocabulary (tokenizers ``.json``), each distinct pre-token encoded once a task."""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

from flowwatch.llm.pretokens import Spans, word_end_spans

#: Distinct pre-tokens that a task keeps before it begins anew; bounds the memory, not the result.
KEPT_WORDS = 200_000
#: Pre-tokens that the library encodes in one call.
RUN = 400


def normal_form(text: str) -> str:
    """NFC, then lower case character by character (no final-sigma rule), as the vocabulary's normalizer."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordBpe:
    """Encodes whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(vocabulary)
        self.special = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for t, i in self.whole.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.pool = np.empty(0, np.int32)
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Append the ids of new pre-tokens; a pre-token ends with the one id whose token has the word end."""
        runs = [" ".join(words[i:i + RUN]) for i in range(0, len(words), RUN)]
        ids = np.concatenate([np.asarray(e.ids, np.int32) for e in self.pieces.encode_batch_fast(runs)])
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words):
            raise ValueError("the vocabulary does not close each pre-token with a word end")
        first = np.r_[0, last[:-1]]
        self.at = np.r_[self.at, first + len(self.pool)]
        self.length = np.r_[self.length, last - first]
        self.pool = np.r_[self.pool, ids]

    def codes(self, spans: Spans) -> np.ndarray:
        """The kept number of each pre-token."""
        if len(self.slots) > KEPT_WORDS:
            self._forget()
        codes, place = spans.distinct()
        words, slots = spans.words(place), self.slots
        new = [w for w in words if w not in slots]
        if new:
            slots.update(zip(new, range(len(slots), len(slots) + len(new)), strict=True))
            self._learn(new)
        return np.fromiter(map(slots.__getitem__, words), np.int64, len(words))[codes]

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def encode_whole(self, text: str) -> np.ndarray:
        """By the library's own path; for texts with special strings."""
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.int32)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        spans = word_end_spans([normal_form(t) for t in texts])
        codes = self.codes(spans)
        sums = np.r_[0, np.cumsum(self.length[codes])]
        out = sums[spans.first[1:]] - sums[spans.first[:-1]]
        for i, t in enumerate(texts):
            if self.has_special(t):
                out[i] = len(self.encode_whole(t))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        spans = word_end_spans([normal_form(t) for t in texts])
        codes = self.codes(spans)
        sizes = self.length[codes]
        sums = np.r_[0, np.cumsum(sizes)]
        ids = self.pool[np.repeat(self.at[codes] - sums[:-1], sizes) + np.arange(sums[-1])]
        bounds = sums[spans.first].tolist()
        return [self.encode_whole(t) if self.has_special(t) else ids[a:b]
                for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def word_bpe(vocabulary: str) -> WordBpe:
    """One encoder a Python worker and vocabulary."""
    return WordBpe(vocabulary)
