"""Spans of a pattern's matches: what lies between matches, and the matches, give every position in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start:int,end:int,value:string>> of the matches, left to right; end is exclusive."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["f"])
        span = F.struct(start.alias("start"), end.alias("end"), x["f"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("f"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, step, lambda a: a["out"])).otherwise(none)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once. A column that a lambda reads is otherwise copied into it, and worked out
    again wherever, and as often as, the lambda reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines_with(text: Column, pattern: str) -> Column:
    """array<struct<at:int,line:string>> of the lines that hold a match, with their places. What is sought within a line
    then costs that line's length, not the text's."""
    none = F.array().cast("array<struct<at:int,line:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, line: Column) -> Column:
        held = F.when(line.rlike(pattern), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), line.alias("line"))))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), held.alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(F.split(text, "\n", -1), zero, step, lambda a: a["out"])).otherwise(none)


def line_prefix(text: Column, start: Column) -> Column:
    """What stands before ``start`` on its line."""
    return F.substring_index(text.substr(F.lit(1), start), "\n", -1)


def left_context(text: Column, start: Column, most: int) -> Column:
    """At most ``most`` characters before ``start``, on its line."""
    return F.substring_index(text.substr(F.greatest(start - most, F.lit(0)) + 1, F.least(start, F.lit(most))), "\n", -1)


def ordered_distinct(values: Column) -> Column:
    """Non-blank values, each once, in the order of first sight."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")))


def blank_out(text: Column, found: Column, mark: str = "") -> Column:
    """The text with the given spans (ordered, disjoint) replaced by ``mark``."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = text.substr(acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, F.lit(mark)).alias("out"))

    return F.aggregate(found, zero, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))
