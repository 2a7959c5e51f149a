"""Positions within groups of any size, without gathering a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_within(df: DataFrame, keys: list[str], by: list[str], name: str = "rank", rows_per_task: int = 200_000) -> DataFrame:
    """``df`` with a bigint ``name``: 0-based positions within ``keys``, without gaps.

    The order is pseudo-random but fixed: by a salt of the columns ``by``, then by them (they should tell rows
    apart; rows equal in them get neighbouring positions in any order). Each group is cut into as many salts as
    the largest needs, rows are numbered within their salt and the salts' counts are summed up. NULL keys form a
    group of their own. ``df`` is read twice, so it should be a table or the result of ``cut``.
    """
    most = df.groupBy(*keys).agg(F.count("*").alias("_most")).agg(F.max("_most")).first()[0] or 0
    salts = max(1, math.ceil(most / rows_per_task))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    inner = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*by)).cast("bigint") - 1
    if salts == 1:
        return salted.withColumn(name, inner).drop("_salt")
    counts = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_salt").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    on = F.col("_salt") == F.col("_s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return salted.withColumn("_at", inner).join(starts, on).withColumn(name, F.col("_at") + F.col("_before")).select(*df.columns, name)
