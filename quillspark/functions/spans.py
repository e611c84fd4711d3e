"""Matches with their places: pieces of a text, intervals, and the sweep that resolves overlaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands around matches while a text is cut; in the text itself a space stands for it, so places stay.
MARK = "\x02"


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at the pattern's matches: what stands before each and the match itself in turn, then the rest."""
    plain = F.translate(text, MARK, " ")
    return F.split(F.regexp_replace(plain, pattern, f"{MARK}$0{MARK}"), MARK)


def rebuilt(parts: Column, change: Callable[[Column, Column], Column]) -> Column:
    """The text of pieces(), with change(match, ordinal) in the place of each match."""
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, change(x, F.floor(i / 2).cast("int"))).otherwise(x)), "")


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the pattern's matches; places count from 0, `end` is behind the match."""
    at = "struct<at:int,spans:array<struct<start:int,end:int,match:string>>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(at)

    def step(seen: Column, x: Column) -> Column:
        behind = seen["at"] + F.length(x["text"])
        one = F.array(F.struct(seen["at"].alias("start"), behind.alias("end"), x["text"].alias("match")))
        return F.struct(behind.alias("at"), F.when(x["odd"], F.concat(seen["spans"], one)).otherwise(seen["spans"]).alias("spans")).cast(at)

    parts = F.transform(pieces(text, pattern), lambda x, i: F.struct((i % 2 == 1).alias("odd"), x.alias("text")))
    return F.aggregate(parts, begin, step, lambda seen: seen["spans"])


def longest(spans: Column, kind: str) -> Column:
    """Of overlapping spans, array<struct<start, end, ...>> of the type `kind`, the leftmost stays, and of those that start together the longest: one sweep in order of start."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("behind"), s.alias("span"))))
    state = f"struct<end:int,kept:{kind}>"
    begin = F.struct(F.lit(-1).alias("end"), F.array().alias("kept")).cast(state)
    step = lambda seen, s: F.when(s["start"] >= seen["end"], F.struct(s["span"]["end"].alias("end"), F.concat(seen["kept"], F.array(s["span"])).alias("kept")).cast(state)).otherwise(seen)
    return F.aggregate(ordered, begin, step, lambda seen: seen["kept"])
