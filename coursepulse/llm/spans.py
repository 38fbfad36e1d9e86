"""Spans of regular expressions in texts, as DataFrame functions only.

A span is a struct (start, rank, end, kind, value) with offsets in code points, end exclusive; rank
is the kind's place in its list, so that sorting spans puts them by start and then by kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
#: Values that are folded at once; arrays grow by copying, so the work is n * BLOCK.
BLOCK = 256
#: Code points in a piece of a text.
PIECE = 256
LAST = 2**31 - 1


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of op over a short array."""
    return F.aggregate(
        values,
        F.array().cast("array<int>"),
        lambda done, x: F.concat(done, F.array(F.coalesce(op(F.try_element_at(done, F.lit(-1)), x), x))),
    )


def running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running results of op (with its neutral value) over an array of int, in blocks.

    Whatever a lambda uses more than once is bound first: an expression inside one is computed each time.
    """

    def whole(own: Column) -> Column:
        last = F.ceil(F.size(own) / BLOCK).cast("int") - 1
        return let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(own, b * BLOCK + 1, BLOCK)), in_blocks)

    def in_blocks(blocks: Column) -> Column:
        totals = _folded(F.transform(blocks, lambda block: F.aggregate(block, F.lit(zero), op)), op)
        return let(totals, lambda known: F.flatten(F.transform(blocks, lambda block, i: after(known, block, i))))

    def after(known: Column, block: Column, i: Column) -> Column:
        before = F.coalesce(F.get(known, i - 1), F.lit(zero))
        return let(before, lambda start: F.transform(_folded(block, op), lambda x: op(start, x)))

    return let(values, lambda own: F.when(F.size(own) > 0, whole(own)).otherwise(F.array().cast("array<int>")))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _later(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull(), F.greatest(a, b))


def _sooner(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull(), F.least(a, b))


def matches(text: Column, pattern: str, kind: str, rank: int, value: int = 0, needs: Column | None = None) -> Column:
    """Leftmost non-overlapping matches, the value being one group of the pattern.

    Gaps and matches alternate, so their lengths give the offsets. needs: a cheap condition
    without which a text can't hold a match.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def spans(hits: Column) -> Column:
        values = hits if value == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
        steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: gap + F.length(hit))
        ended = F.zip_with(running(steps, _plus, 0), hits, lambda end, hit: F.struct(end.alias("end"), hit.alias("hit")))
        return F.zip_with(
            ended,
            values,
            lambda e, v: F.struct(
                (e["end"] - F.length(e["hit"])).alias("start"),
                F.lit(rank).alias("rank"),
                e["end"].alias("end"),
                F.lit(kind).alias("kind"),
                v.alias("value"),
            ),
        )

    found = text.rlike(pattern) if needs is None else needs & text.rlike(pattern)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(found, let(hits, spans)).otherwise(no_spans())


def merged(*spans: Column) -> Column:
    """Spans of several kinds by start and kind."""
    return F.array_sort(F.concat(*spans))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of base, sorted: one sweep over both in the order of their starts.

    A span is kept if no base span that starts before it ends behind its start, and the next one starts
    behind its end.
    """

    def side(own: Column, of: int) -> Column:
        return F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(of).alias("side"), s.alias("span")))

    def sweep(both: Column) -> Column:
        ends = F.transform(both, lambda t: F.when(t["side"] == 0, t["span"]["end"]).otherwise(0))
        starts = F.transform(F.reverse(both), lambda t: F.when(t["side"] == 0, t["start"]).otherwise(LAST))
        around = F.zip_with(
            running(ends, _later, 0),
            F.reverse(running(starts, _sooner, LAST)),
            lambda reach, ahead: F.struct(reach.alias("reach"), ahead.alias("ahead")),
        )
        met = F.zip_with(both, around, lambda t, a: F.struct(t.alias("t"), a["reach"], a["ahead"]))
        free = F.filter(
            met,
            lambda m: (m["t"]["side"] == 1)
            & (m["reach"] <= m["t"]["span"]["start"])
            & (m["ahead"] >= m["t"]["span"]["end"]),
        )
        return F.transform(free, lambda m: m["t"]["span"])

    def free_of(own: Column) -> Column:
        both = F.array_sort(F.concat(side(base, 0), side(own, 1)))
        return F.when((F.size(base) > 0) & (F.size(own) > 0), let(both, sweep)).otherwise(own)

    return let(F.array_sort(spans), free_of)


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points, so that a place in it is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points from start to end (exclusive, or the text's end) of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    count = F.floor((end - 1) / PIECE).cast("int") - first + 1
    own = F.substring(F.array_join(F.slice(parts, first + 1, count), ""), start - first * PIECE + 1, end - start)
    return F.when(end > start, own).otherwise("")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with every stretch covered by spans replaced. spans: sorted by start."""

    def filled(parts: Column, at: Column) -> Column:
        kept = F.zip_with(
            spans,
            F.slice(at, 1, F.size(spans)),
            lambda s, a: F.when(s["start"] >= a, F.concat(cut(parts, a, s["start"]), F.lit(mask))).otherwise(""),
        )
        rest = cut(parts, F.element_at(at, -1), F.length(text))
        return F.concat(F.array_join(kept, ""), rest)

    ends = running(F.transform(spans, lambda s: s["end"]), _later, 0)
    at = F.concat(F.array(F.lit(0)), ends)
    whole = let(pieces(text), lambda parts: let(at, lambda a: filled(parts, a)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sheltered(docs: DataFrame, apply: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """apply(docs, name of the text) while columns have names that can't clash; it may change columns and rows."""
    names = docs.columns
    at = [c.lower() for c in names].index("text")
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"_col{i}") for i, c in enumerate(names)))
    return apply(renamed, f"_col{at}").select(*(F.col(f"_col{i}").alias(c) for i, c in enumerate(names)))
