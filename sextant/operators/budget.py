"""Budgets over the ordered parts of one row: which parts fit. Folds inside the row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STATE = "struct<used:bigint,out:array<bigint>>"


def _fold(sizes: Column, step) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("out")).cast(_STATE)

    def merge(s: Column, size: Column) -> Column:
        n = F.coalesce(size, F.lit(0)).cast("bigint")
        kept, used = step(s["used"], n)
        return F.struct(used.cast("bigint").alias("used"), F.concat(s["out"], F.array(kept.cast("bigint"))).alias("out")).cast(_STATE)

    return F.aggregate(sizes, start, merge, lambda s: s["out"])


def cap_prefix(sizes: Column, cap: int) -> Column:
    """What is kept of each part (its size or 0): parts are kept while the running sum stays within ``cap``; after the first that does not, none is.

    A part that starts when the sum has reached ``cap`` is dropped; NULL sizes count as 0; NULL or empty arrays give the same.
    """
    return _fold(sizes, lambda used, n: (F.when((used < cap) & (used + n <= cap), n).otherwise(0), F.when(used < cap, used + n).otherwise(used)))


def greedy_skip(sizes: Column, cap: int) -> Column:
    """What is kept of each part: one that does not fit is skipped, later smaller ones may still fit."""
    return _fold(sizes, lambda used, n: (F.when(used + n <= cap, n).otherwise(0), F.when(used + n <= cap, used + n).otherwise(used)))


def cap_truncate(sizes: Column, cap: int, marker: int = 0) -> Column:
    """What is kept of each part: the first that does not fit is cut to the room left, less ``marker`` for the sign that says so; later ones are dropped."""
    room = lambda used: F.greatest(F.lit(cap) - used, F.lit(0))
    return _fold(sizes, lambda used, n: (F.when(used + n <= cap, n).otherwise(F.greatest(room(used) - marker, F.lit(0))), F.when(used + n <= cap, used + n).otherwise(F.lit(cap))))


def cap_each(sizes: Column, each: int, cap: int) -> Column:
    """What is kept of each part: at most ``each``, and no more than what is left of ``cap``."""

    def step(used: Column, n: Column) -> tuple[Column, Column]:
        kept = F.greatest(F.least(n, F.lit(each), F.lit(cap) - used), F.lit(0))
        return kept, used + kept

    return _fold(sizes, step)


def commentable_lines(patch: Column) -> Column:
    """New-file line numbers of added and context lines of a unified diff; lines before the first hunk count from 0; NULL and empty give an empty array."""
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("out")).cast("struct<next:int,out:array<int>>")
    # Fixed value: the header of a hunk in a unified diff.
    header = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"

    def merge(s: Column, line: Column) -> Column:
        hunk, gone = line.rlike(header), line.startswith("-")
        at = F.when(hunk, F.regexp_extract(line, header, 1).try_cast("int")).when(gone, s["next"]).otherwise(s["next"] + 1)
        out = F.when(hunk | gone, s["out"]).otherwise(F.concat(s["out"], F.array(s["next"])))
        return F.struct(at.cast("int").alias("next"), out.alias("out")).cast("struct<next:int,out:array<int>>")

    lines = F.when(F.coalesce(patch, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(patch, "\n"))
    return F.aggregate(lines, start, merge, lambda s: s["out"])
