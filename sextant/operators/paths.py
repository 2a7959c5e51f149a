"""Joins on path prefixes, as equality joins on the ancestors of a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.runtime import sized


def ancestors(path: Column, sep: str = "/") -> Column:
    """The path and all its ancestors, shortest first: a, a/b, a/b/c. NULL gives NULL."""
    parts = F.split(path, f"\\Q{sep}\\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))


def longest_prefix(files: DataFrame, modules: DataFrame, file: str = "f", path: str = "path") -> DataFrame:
    """(file, path): the longest module path that is the file or an ancestor of it; files in no module have no row.

    Works on the distinct files, so a file named by a third of all rows is looked up once.
    """
    one = files.select(F.col(file)).where(F.col(file).isNotNull()).distinct()
    known = modules.select(F.col(path).alias("_p")).where(F.col("_p").isNotNull()).distinct()
    hits = one.select(file, F.explode(ancestors(F.col(file))).alias("_p")).join(sized(known), "_p")
    return hits.groupBy(file).agg(F.max_by("_p", F.length("_p")).alias(path))


def overlapping(left: DataFrame, right: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rows of ``left`` whose path ``a`` equals, lies above or lies below a path ``b`` of ``right`` with equal ``by`` columns."""
    key = [F.col(c) for c in by]
    r = right.select(*(F.col(c).alias(f"_r_{c}") for c in by), F.col(b).alias("_b")).where("_b is not null").distinct()
    l = left.withColumn("_up", ancestors(F.col(a)))
    same = lambda: [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    lifted = r.select(*(f"_r_{c}" for c in by), F.explode(ancestors(F.col("_b"))).alias("_anc")).distinct()
    below = left.select(*key, a, F.explode(ancestors(F.col(a))).alias("_x")).join(r, [*same(), F.col("_x") == F.col("_b")], "left_semi").select(*by, a)
    above = left.select(*by, a).join(lifted, [*same(), F.col(a) == F.col("_anc")], "left_semi").select(*by, a)
    hit = below.unionByName(above).distinct().select(*(F.col(c).alias(f"_h_{c}") for c in by), F.col(a).alias("_h"))
    return l.drop("_up").join(hit, [*(F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in by), F.col(a) == F.col("_h")], "left_semi")
