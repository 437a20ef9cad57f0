"""Spans of pattern matches, and folds over long arrays, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a fold appends to one array before it starts the next.
BLOCK = 256


def fold(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column, Column]],
         block: int = BLOCK) -> Column:
    """The elements that ``step(state, item)`` gives, in order, as array<out>.

    ``step`` returns the next state, whether to emit an element, and the element. Results are gathered block by
    block, so n items cost n * block copies at most and not n squared.
    """
    none = F.array().cast(f"array<{out}>")

    def one(a: Column, x: Column) -> Column:
        after, wanted, value = step(a["s"], x)
        return F.struct(after.alias("s"), F.when(wanted, F.concat(a["out"], F.array(value))).otherwise(a["out"]).alias("out"))

    def part(a: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(items, at + 1, F.lit(block)), F.struct(a["s"].alias("s"), none.alias("out")), one)
        # a one-element array names the inner result, which is then computed once
        return F.get(F.transform(F.array(inner), lambda r: F.struct(
            r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out"))), F.lit(0))

    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    zero = F.struct(state.alias("s"), F.array().cast(f"array<array<{out}>>").alias("out"))
    return F.flatten(F.aggregate(starts, zero, part)["out"])


def matches(text: Column, pattern: str, before: int = 0, after: int = 0) -> Column:
    """The leftmost non-overlapping matches: array of gap (characters since the last match), hit, and the text
    next to it, at most ``before`` and ``after`` characters of what lies between the neighbouring matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    n = F.size(hits)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("gap"), hits.alias("hit"), F.slice(gaps, F.lit(2), n).alias("next"))
    return F.transform(zipped, lambda m: F.struct(
        F.length(m["gap"]).alias("gap"), m["hit"].alias("hit"),
        F.right(m["gap"], F.lit(before)).alias("before"), F.left(m["next"], F.lit(after)).alias("after")))


def located(found: Column, score: Callable[[Column], Column], kind: int) -> Column:
    """Spans (start, kind, end, score) in code points of those ``matches`` whose score is not null."""
    judged = F.transform(found, lambda m: F.struct(m["gap"].alias("gap"), F.length(m["hit"]).alias("own"), score(m).cast("int").alias("score")))

    def step(at: Column, m: Column):
        start = at + m["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + m["own"]).alias("end"), m["score"].alias("score"))
        return start + m["own"], m["score"].isNotNull(), span

    return fold(judged, F.lit(0), SPAN, step)


#: A span.
SPAN = "struct<start:int,kind:int,end:int,score:int>"
