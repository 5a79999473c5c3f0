"""Alignment of two tokenizers' tokens by a galloping intersection of their byte ends.

1. A task cuts each text, with its leading space, into stretches at single spaces between other characters: both
   tokenizers begin a pre-token there, so each stretch is encoded and aligned apart, and huge texts stay bounded.
   Distinct pre-tokens are encoded once a task, and their bytes are held against the tokens' bytes.
2. Of each stretch the tokenizer with fewer tokens drives: each of its ends is looked up among the other's ends by
   doubling steps from the place of the end before, and then by halving. Ends found are common: they cut the tokens
   into groups. The places give, as differences of ranks, the range of tokens that a token overlaps: its links.
3. Each block of documents writes its id pairs with the number of documents that hold them, and each document its
   pairs as numbers within the block. Pair counts are summed over all blocks, the highest count of each id of A
   follows from them, and both go back to the blocks by join, where each document adds up its links.

A block is bounded by its characters, and pairs of a block are shuffled, not links, so frequent tokens stay small.
Defined results: null or empty texts, and texts whose joined tokens differ from the space and the text (such as texts
with U+2581, which B reads as a space), have no tokens, zeros and an empty digest, and count for no pair. Null
doc_ids and repeated rows each give their row and count as documents of their own. An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.llm.byte_bpe import _planes, _unplaned
from flowwatch.llm.common import blocks, id_and_text, prepared, small_side, written
from flowwatch.llm.pretokens import BLANK, EDGE, OTHER, Spans, _joined, _spans, byte_level_spans, word_end_classes

#: Characters of a block; a longer document is a block of its own.
BLOCK_CHARS = 12_000_000
#: Characters that are encoded and aligned together.
STRETCH_CHARS = 800_000
#: Distinct pre-tokens that a task keeps for each tokenizer before it begins anew; bounds memory, not the result.
KEPT_WORDS = 300_000
#: Ends that one lane of the intersection handles in turn; all lanes of a call step together.
LANE = 32

#: Pre-tokens that a library encodes in one call, and what stands between them for the byte-level vocabulary.
RUN, BETWEEN = 400, "\ue000"

MARK = "▁"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
PARTS = ("block long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in COUNTS) +
         ", digest array<string>, body binary, pair array<long>, docs array<long>")


class Encoder:
    """Ids of pre-tokens, each distinct one encoded once while it is kept."""

    #: Bytes of each id's token.
    tokens: list[bytes]

    def encode_runs(self, runs: list[list[str]]) -> list[list[int]]:
        """Ids of each run of pre-tokens; where runs are not sound they are given again with one pre-token each."""
        raise NotImplementedError

    def encode_whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def spans(self, stretches: list[str]) -> Spans:
        raise NotImplementedError

    def ready(self) -> None:
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self._forget()

    def _forget(self) -> None:
        none = np.empty(0, np.int64)
        self.keys, self.points, self.word_at, self.word_size = none.astype(np.uint64), none.astype(np.uint32), none, none
        self.pool, self.at, self.length, self.sound = none.astype(np.int32), none, none, none.astype(bool)

    def codes(self, spans: Spans) -> tuple[np.ndarray, np.ndarray]:
        """The kept number of each pre-token, and whether it is that word, character by character."""
        if len(self.keys) > KEPT_WORDS:
            self._forget()
        keys, size = spans.keys(), spans.end - spans.start
        code = pd.Index(self.keys).get_indexer(keys)
        new = np.flatnonzero(code < 0)
        if len(new):
            number, seen = pd.factorize(keys[new])
            place = np.empty(len(seen), np.int64)
            place[number[::-1]] = new[::-1]
            code[new] = len(self.keys) + number
            before = np.cumsum(size[place]) - size[place]
            points = spans.points[np.repeat(spans.start[place] - before, size[place]) + np.arange(int(size[place].sum()))]
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            self._learn(spans.words(place), np.add.reduceat(width, before))
            self.word_at, self.points = np.r_[self.word_at, len(self.points) + before], np.r_[self.points, points]
            self.word_size, self.keys = np.r_[self.word_size, size[place]], np.r_[self.keys, seen]
        same = self.word_size[code] == size
        shift = np.repeat(self.word_at[code] - spans.start, size)
        here = np.repeat(spans.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        if not same.all() or (self.points[here + shift] != spans.points[here]).any():
            same &= np.array([size[i] == self.word_size[c] and (
                self.points[self.word_at[c]:self.word_at[c] + size[i]] == spans.points[spans.start[i]:spans.end[i]]).all()
                for i, c in enumerate(code.tolist())], bool)
        return code, same

    def _learn(self, words: list[str], size: np.ndarray) -> None:
        """Append the ids of new pre-tokens of ``size`` bytes. A run's ids fall to its pre-tokens by their bytes; a run whose tokens are not
        its bytes is encoded pre-token by pre-token."""
        runs = [words[i:i + RUN] for i in range(0, len(words), RUN)]
        pool, length, sound = [], [], []
        for i, (run, ids) in enumerate(zip(runs, self.encode_runs(runs), strict=True)):
            got = np.array(ids, np.int32)
            ends = np.cumsum(self.size[got])
            want = np.cumsum(size[i * RUN:(i + 1) * RUN])
            last = np.minimum(np.searchsorted(ends, want), len(ends) - 1)
            if (len(ends) and ends[-1] == want[-1] and (ends[last] == want).all()
                    and b"".join([self.tokens[i] for i in ids]) == "".join(run).encode()):
                length.append(np.diff(last, prepend=-1))
                sound.append(np.ones(len(run), bool))
            else:
                single = self.encode_runs([[w] for w in run])
                length.append(np.array(list(map(len, single)), np.int64))
                sound.append(np.array([b"".join([self.tokens[i] for i in x]) == w.encode()
                                       for w, x in zip(run, single, strict=True)], bool))
                got = np.array([i for x in single for i in x], np.int32)
            pool.append(got)
        sizes = np.concatenate(length)
        self.at = np.r_[self.at, len(self.pool) + np.cumsum(sizes) - sizes]
        self.length, self.sound = np.r_[self.length, sizes], np.concatenate([self.sound, *sound])
        self.pool = np.concatenate([self.pool, *pool])

    def encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all stretches in order, the first id of each stretch (and the end), and whether the tokens of all
        pre-tokens of a stretch are its bytes."""
        spans = self.spans(stretches)
        codes, same = self.codes(spans)
        sizes = self.length[codes]
        sums = np.r_[0, np.cumsum(sizes)]
        ids = self.pool[np.repeat(self.at[codes] - sums[:-1], sizes) + np.arange(sums[-1])]
        unsound = np.r_[0, np.cumsum(~(self.sound[codes] & same))][spans.first]
        return ids, sums[spans.first], unsound[1:] == unsound[:-1]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies (a published rule): printable
    Latin-1 characters stand for themselves, the other bytes follow from code point 256 on in their order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel(Encoder):
    """A byte-level BPE vocabulary (tokenizers ``.json``)."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # tasks share the cores already; the library's own threads would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_str(vocabulary)
        self.whole.encode_special_tokens = True
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(BETWEEN, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        alphabet = byte_alphabet()
        self.tokens = [b""] * self.whole.get_vocab_size()
        for token, i in self.whole.get_vocab(with_added_tokens=False).items():
            self.tokens[i] = bytes(alphabet[c] for c in token)
        self.merges = self.by_ranks(vocabulary)
        self.ready()

    def encode_runs(self, runs: list[list[str]]) -> list[list[int]]:
        """A separator that is in a pre-token is lost, which makes its run unsound."""
        joined = [BETWEEN.join(r) for r in runs]
        if self.merges:
            return [self.merges.encode_ordinary(r) for r in joined]
        return [e.ids for e in self.pieces.encode_batch_fast(joined, add_special_tokens=False)]

    def by_ranks(self, vocabulary: str):
        """Where ids count up with the merges, the rank library merges alike, and faster."""
        import tiktoken

        ids = {t: i for i, t in enumerate(self.tokens) if t}
        merges = [m.split(" ") if isinstance(m, str) else m for m in json.loads(vocabulary)["model"]["merges"]]
        alphabet = byte_alphabet()
        made = [ids[bytes(alphabet[c] for c in "".join(m))] for m in merges]
        if made == list(range(256, 256 + len(made))) and sorted(ids.values()) == list(range(len(ids))):
            return tiktoken.Encoding("pre-tokens", pat_str=f"[^{BETWEEN}]+", mergeable_ranks=ids, special_tokens={})
        return None

    def encode_whole(self, text: str) -> list[int]:
        return self.whole.encode(" " + text, add_special_tokens=False).ids

    def spans(self, stretches: list[str]) -> Spans:
        return byte_level_spans(stretches, word_end_classes())


@functools.cache
def _space_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    table[32] = BLANK
    return table


class Pieces(Encoder):
    """A sentencepiece BPE model with byte fallback, whose pieces hold spaces at their beginning only."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in names):
            raise ValueError("a piece reaches over the beginning of a word")
        self.tokens = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode()
                       for i, p in enumerate(names)]
        self.space = [self.model.piece_to_id(MARK)]
        self.ready()

    def encode_runs(self, runs: list[list[str]]) -> list[list[int]]:
        """Pre-tokens begin with spaces, so a run is a text; the model adds the first space itself."""
        got = self.model.encode(["".join(r)[1:] for r in runs], num_threads=1)
        return [ids if r != [" "] else self.space for r, ids in zip(runs, got, strict=True)]

    def encode_whole(self, text: str) -> list[int]:
        return self.model.encode(text)

    def spans(self, stretches: list[str]) -> Spans:
        """A run of spaces with the run of other characters after it."""
        text, points, kinds, edges = _joined(stretches, _space_classes())
        start = kinds == BLANK
        start[1:] &= ~start[:-1]
        return _spans(text, points, kinds, edges, start, (EDGE,))


def lower_places(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each x the first place in ``y[low:high]`` that is not less (or ``high``), looked for by doubling steps from
    ``low`` and by halving between the last two; y is sorted."""
    lo, hi = low.copy(), high.copy()
    at, reach = np.flatnonzero(lo < hi), 1
    while len(at):
        end = high[at]
        probe = np.minimum(low[at] + (reach - 1), end - 1)
        less = y[probe] < x[at]
        lo[at] = np.where(less, probe + 1, lo[at])
        hi[at] = np.where(less, end, probe)
        at = at[less & (probe + 1 < end)]
        reach *= 2
    at = np.flatnonzero(lo < hi)
    while len(at):
        middle = (lo[at] + hi[at]) >> 1
        less = y[middle] < x[at]
        lo[at] = np.where(less, middle + 1, lo[at])
        hi[at] = np.where(less, hi[at], middle)
        at = at[lo[at] < hi[at]]
    return lo


def gallop(x: np.ndarray, first: np.ndarray, count: np.ndarray, y: np.ndarray, low: np.ndarray,
           high: np.ndarray) -> np.ndarray:
    """Lower places in y of the ends ``x[first:first + count]`` of each list, list after list.

    Lists are cut into lanes. A lane gallops to its first end from the beginning of its list, and from there each end
    from the place of the one before; all lanes take their steps together.
    """
    lanes = -(-count // LANE)
    of = np.repeat(np.arange(len(count)), lanes)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = first[of] + turn * LANE
    left = np.minimum(count[of] - turn * LANE, LANE)
    out_at = (np.cumsum(count) - count)[of] + turn * LANE
    out = np.empty(int(count.sum()), np.int64)
    place, end = low[of], high[of]
    for step in range(LANE):
        more = left > step
        if not more.all():
            at, left, out_at, place, end = (v[more] for v in (at, left, out_at, place, end))
        if not len(at):
            break
        place = lower_places(x[at + step], y, place, end)
        out[out_at + step] = place
    return out


class Aligned(NamedTuple):
    """Groups and links of lists of tokens that cover the same bytes."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _driven(x, x_first, y, y_first, which) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lists ``which``: places of the tokens with common ends in x and y, and linked places in x and y."""
    first, count = x_first[which], (x_first[1:] - x_first[:-1])[which]
    place = gallop(x, first, count, y, y_first[which], y_first[1:][which])
    mine = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(place))
    common = y[np.minimum(place, len(y) - 1)] == x[mine]
    begin = np.empty_like(place)
    begin[1:] = place[:-1] + common[:-1]
    begin[(np.cumsum(count) - count)[count > 0]] = y_first[which][count > 0]
    size = place - begin + 1
    sums = np.cumsum(size)
    total = int(sums[-1]) if len(sums) else 0
    return (mine[common], place[common], np.repeat(mine, size),
            np.arange(total) + np.repeat(begin - (sums - size), size))


def align(size_a: np.ndarray, first_a: np.ndarray, size_b: np.ndarray, first_b: np.ndarray) -> Aligned:
    """Token sizes in bytes, list after list, with the first token of each list; the lists' byte sums are equal."""
    a, b = np.cumsum(size_a), np.cumsum(size_b)
    fewer = np.diff(first_a) <= np.diff(first_b)
    ga, gb, la, lb = _driven(a, first_a, b, first_b, np.flatnonzero(fewer))
    hb, ha, mb, ma = _driven(b, first_b, a, first_a, np.flatnonzero(~fewer))
    order = np.argsort(np.r_[ga, ha], kind="stable")
    return Aligned(np.r_[ga, ha][order], np.r_[gb, hb][order], np.r_[la, ma], np.r_[lb, mb])


def _numerals(n: int) -> np.ndarray:
    """Each id below n as decimal digits with a following comma, bar or semicolon, in fixed width."""
    width = len(str(max(n - 1, 0))) + 1
    return np.array([f"{i}{s}".encode() for s in ",|;" for i in range(n)], f"S{width}")


def group_cells(aligned: Aligned, ids_a: np.ndarray, ids_b: np.ndarray, numerals: np.ndarray) -> np.ndarray:
    """The ids in the order of the group text, as fixed-width cells: of each group A's ids, then B's."""
    n = len(numerals) // 3
    out = np.empty(len(ids_a) + len(ids_b), numerals.dtype)
    for ids, mine, other, last in ((ids_a, aligned.group_a, np.r_[0, aligned.group_b + 1][:-1], 1),
                                   (ids_b, aligned.group_b, aligned.group_a + 1, 2)):
        size = np.diff(np.r_[-1, mine])
        mark = np.zeros(len(ids), np.int64)
        mark[mine] = last
        out[np.arange(len(ids)) + np.repeat(other, size)] = numerals[mark * n + ids]
    return out


def cut_stretches(text: str, chars: int) -> list[str]:
    """The text in stretches of about ``chars`` characters (more where no place allows a cut), cut before single
    spaces between letters, digits and the like."""
    out, at = [], 0
    place = re.compile(r"(?<=\w) (?=\w)")
    while len(text) - at > chars:
        found = place.search(text, at + chars)
        if not found:
            break
        out.append(text[at:found.start()])
        at = found.start()
    out.append(text[at:])
    return out


class Aligner:
    """Both encoders and the tables that follow from them."""

    def __init__(self, vocabulary: str, model: bytes):
        self.a, self.b = ByteLevel(vocabulary), Pieces(model)
        self.bits = (len(self.b.tokens) - 1).bit_length()
        self.numerals = _numerals(max(len(self.a.tokens), len(self.b.tokens)))

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the libraries' own paths, or none where their bytes are not the space and the text."""
        a, b = self.a.encode_whole(text), self.b.encode_whole(text)
        full = (" " + text).encode()
        if b"".join([self.a.tokens[i] for i in a]) != full or b"".join([self.b.tokens[i] for i in b]) != full:
            return np.empty(0, np.int32), np.empty(0, np.int32)
        return np.array(a, np.int32), np.array(b, np.int32)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of both tokenizers and the first id of each text.

        A text goes through the libraries whole if a pre-token's tokens are not its bytes, or if it has a U+2581.
        """
        stretches = [" " + t for t in texts]
        ids_a, first_a, sound_a = self.a.encode(stretches)
        ids_b, first_b, sound_b = self.b.encode(stretches)
        odd = ~(sound_a & sound_b) | np.array([MARK in t for t in texts], bool)
        if not odd.any():
            return ids_a, first_a, ids_b, first_b
        rows = [self.whole(t) if o else (ids_a[first_a[i]:first_a[i + 1]], ids_b[first_b[i]:first_b[i + 1]])
                for i, (t, o) in enumerate(zip(texts, odd.tolist(), strict=True))]
        return (np.concatenate([a for a, _ in rows]), np.cumsum([0, *(len(a) for a, _ in rows)]),
                np.concatenate([b for _, b in rows]), np.cumsum([0, *(len(b) for _, b in rows)]))

    def documents(self, texts: list[str]) -> Aligns:
        """Counts, digests and pairs of texts that together are about one stretch long."""
        filled, out = [i for i, t in enumerate(texts) if t], Aligns.none(len(texts))
        if not filled:
            return out
        ids_a, first_a, ids_b, first_b = self.batch([texts[i] for i in filled])
        got, cells = self.aligned(ids_a, first_a, ids_b, first_b)
        digests = [hashlib.sha256(cells[a:b].tobytes().translate(None, b"\0")[:-1]).hexdigest() if b > a else ""
                   for a, b in zip((first_a + first_b)[:-1].tolist(), (first_a + first_b)[1:].tolist(), strict=True)]
        out.counts[:, filled], out.sizes[filled] = got.counts, got.sizes
        for i, digest in zip(filled, digests, strict=True):
            out.digests[i] = digest
        return out._replace(pairs=got.pairs, uses=got.uses)

    def aligned(self, ids_a, first_a, ids_b, first_b) -> tuple[Aligns, np.ndarray]:
        """Counts and pairs of texts by their ids, and the cells of their group texts."""
        n = len(first_a) - 1
        got = align(self.a.size[ids_a], first_a, self.b.size[ids_b], first_b)
        groups = np.searchsorted(got.group_a, first_a)
        doc = np.searchsorted(first_a, got.link_a, side="right") - 1
        pair = ids_a[got.link_a].astype(np.int64) << self.bits | ids_b[got.link_b]
        width = self.bits + (len(self.a.tokens) - 1).bit_length()
        keys = np.sort(doc << width | pair)
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.stack([np.diff(first_a), np.diff(first_b), np.diff(groups), np.bincount(doc, minlength=n)])
        return Aligns(counts, [""] * n, np.bincount(keys[new] >> width, minlength=n),
                      keys[new] & ((1 << width) - 1), np.diff(np.r_[new, len(keys)])), \
            group_cells(got, ids_a, ids_b, self.numerals)

    def huge(self, text: str) -> Aligns:
        """One long text, some stretches at a time; whole where its tokens are not its bytes."""
        out, digest, tail = Aligns.none(1), hashlib.sha256(), b""
        pairs, uses = [], []
        for stretch in cut_stretches(" " + text, STRETCH_CHARS):
            ids_a, at_a, sound_a = self.a.encode([stretch])
            ids_b, at_b, sound_b = self.b.encode([stretch])
            if MARK in stretch or not (sound_a & sound_b).all():
                return self.huge_whole(text)
            got, cells = self.aligned(ids_a, at_a, ids_b, at_b)
            digest.update(tail)
            body = cells.tobytes().translate(None, b"\0")
            digest.update(body[:-1])
            tail = body[-1:]
            out.counts[:] += got.counts
            pairs.append(got.pairs)
            uses.append(got.uses)
        return out.merged(pairs, uses, digest.hexdigest())

    def huge_whole(self, text: str) -> Aligns:
        ids_a, ids_b = self.whole(text)
        if not len(ids_a):
            return Aligns.none(1)
        got, cells = self.aligned(ids_a, np.array([0, len(ids_a)]), ids_b, np.array([0, len(ids_b)]))
        return got.merged([got.pairs], [got.uses],
                          hashlib.sha256(cells.tobytes().translate(None, b"\0")[:-1]).hexdigest())


class Aligns(NamedTuple):
    """Results of some documents: counts by kind and document, digests, and each document's pairs with their uses."""

    counts: np.ndarray
    digests: list[str]
    sizes: np.ndarray
    pairs: np.ndarray
    uses: np.ndarray

    @classmethod
    def none(cls, n: int) -> Aligns:
        empty = np.empty(0, np.int64)
        return cls(np.zeros((len(COUNTS), n), np.int64), [""] * n, np.zeros(n, np.int64), empty, empty)

    def merged(self, pairs: list[np.ndarray], uses: list[np.ndarray], digest: str) -> Aligns:
        """One document whose stretches' pairs become one list."""
        distinct, code = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.bincount(code, np.concatenate(uses), len(distinct)).astype(np.int64)
        return Aligns(self.counts, [digest], np.array([len(distinct)]), distinct, total)


@functools.lru_cache(maxsize=1)
def aligner(vocabulary: str, model: bytes) -> Aligner:
    return Aligner(vocabulary, model)


def _block_row(block: int, ids: list, parts: list[Aligns]) -> pa.RecordBatch:
    """One row: the block's documents, their pairs as numbers into the block's sorted pairs, and documents a pair."""
    pairs, code = np.unique(np.concatenate([p.pairs for p in parts]), return_inverse=True)
    counts = np.concatenate([p.counts for p in parts], axis=1)
    body = _planes(np.concatenate([p.sizes for p in parts]), code, np.concatenate([p.uses for p in parts]))
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block], pa.int64()), "doc_id": pa.array([ids], longs),
        **{c: pa.array([row], longs) for c, row in zip(COUNTS, counts, strict=True)},
        "digest": pa.array([[d for p in parts for d in p.digests]], pa.list_(pa.string())),
        "body": pa.array([body], pa.binary()), "pair": pa.array([pairs], longs),
        "docs": pa.array([np.bincount(code, minlength=len(pairs))], longs)})


def align_blocks(docs: DataFrame, vocabulary: str, model: bytes, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, text) to one row a block of documents (``PARTS``)."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        tool, block = aligner(vocabulary, model), TaskContext.get().partitionId() << 32
        ids, parts, chars = [], [], 0
        for part, texts in blocks(batches, chars=STRETCH_CHARS):
            parts.append(tool.huge(texts[0]) if len(texts) == 1 and len(texts[0]) > STRETCH_CHARS
                         else tool.documents(texts))
            ids += part.column("doc_id").to_pylist()
            chars += sum(map(len, texts))
            if chars > block_chars:
                yield _block_row(block, ids, parts)
                block += 1
                ids, parts, chars = [], [], 0
        if ids:
            yield _block_row(block, ids, parts)
    return docs.mapInArrow(run, PARTS)


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair, n: the documents of all blocks that hold the pair linked."""
    return (parts.select(F.explode(F.arrays_zip("pair", "docs")).alias("p")).select("p.*")
            .groupBy("pair").agg(F.sum("docs").alias("n")))


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one block with the sums over their links."""
    n = docs.column("doc_id")[0].values
    sizes, code, uses = (x.astype(np.int64) for x in _unplaned(docs.column("body")[0].as_py()))
    order = np.argsort(pairs.column("pair").to_numpy())
    count, best = (pairs.column(c).to_numpy()[order] for c in ("n", "best"))
    ends = np.cumsum(sizes)

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values)]
        return total[ends] - total[ends - sizes]
    return pa.table({
        "doc_id": n, **{c: docs.column(c)[0].values for c in COUNTS},
        "n_best": sums(uses * best[code] if len(code) else uses),
        "count_sum": sums(uses * count[code] if len(code) else uses),
        "groups_sha256": docs.column("digest")[0].values})


def align_documents(df: DataFrame, vocabulary: str, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    ``vocabulary`` is the text of a byte-level tokenizers ``.json`` file (A), ``model`` the bytes of a sentencepiece
    model (B). A pair's count is the number of documents that hold it linked; ``n_best`` counts the links whose pair
    has the highest count of its id of A, ``count_sum`` adds up the counts of all links.
    """
    prepared(df.sparkSession)
    parts = written(align_blocks(id_and_text(df, id_col, text_col), vocabulary, model, block_chars), "aligned-blocks")
    counts = written(pair_counts(parts), "pair-counts")
    bits = aligner(vocabulary, model).bits
    a = F.shiftright("pair", bits)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    # one row an id of A: bounded by the vocabulary
    marked = (counts.withColumn("a", a).join(F.broadcast(highest), "a")
              .select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best")))
    mine = parts.select(F.col("block").alias("of"), F.explode("pair").alias("pair"))
    scored = mine.join(small_side(marked, counts.count()), "pair")
    schema = ("doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) +
              ", n_best long, count_sum long, groups_sha256 string")
    return (parts.select("block", "doc_id", *COUNTS, "digest", "body").groupBy("block")
            .cogroup(scored.groupBy("of")).applyInArrow(_scored, schema))
