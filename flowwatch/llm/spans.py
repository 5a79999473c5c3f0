"""Spans of kinds in texts: their order, text form and digest, and cutting them out."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:long,end:long>>"
Span = tuple[str, int, int]


def in_order(spans: Iterable[Span], kinds: Sequence[str]) -> list[Span]:
    """By start, then by kind as listed."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def disjoint(found: Iterable[Span], kept: Iterable[Span]) -> list[Span]:
    """Of spans, in the given order, those that overlap neither ``kept`` nor an earlier one."""
    taken = sorted((s, e) for _, s, e in kept)
    out = []
    for kind, s, e in found:
        i = bisect_left(taken, (s, s))
        if (i and taken[i - 1][1] > s) or (i < len(taken) and taken[i][0] < e):
            continue
        insort(taken, (s, e))
        out.append((kind, s, e))
    return out


def as_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def cut_out(text: str, spans: Iterable[Span], mask: str = "<{}>") -> str:
    """The text with each stretch of overlapping spans replaced by the mask of its first kind."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if s >= end:
            out += [text[end:s], mask.format(kind.upper())]
        end = max(end, e)
    return "".join([*out, text[end:]])
