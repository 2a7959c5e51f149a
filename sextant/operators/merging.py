"""Keeping a table up to date: upserts, carry-forward, zero-filled dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``target`` after ``updates`` (both unique on ``key``): values of updates win where they are not NULL; action tells 'inserted', 'updated' or 'kept'. NULL keys never match."""
    rest = [c for c in target.columns if c != key]
    t, u = target.withColumn("_t", F.lit(True)), updates.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_u_{c}") for c in rest), F.lit(True).alias("_u"))
    both = t.join(u, F.col(key) == F.col("_k"), "full")
    action = F.when(F.col("_t").isNull(), "inserted").when(F.col("_u").isNull(), "kept").otherwise("updated")
    return both.select(F.coalesce(key, "_k").alias(key), *(F.coalesce(f"_u_{c}", c).alias(c) for c in rest), action.alias("action"))


def carry_forward(now: DataFrame, before: DataFrame, touched: DataFrame, key: str, value: str) -> DataFrame:
    """``now`` with ``value`` taken from ``before`` where the key is neither new nor touched; state is 'new', 'dirty' or 'kept'."""
    b = before.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.lit(True).alias("_old")).dropDuplicates(["_k"])
    t = touched.select(F.col(key).alias("_tk"), F.lit(True).alias("_touched")).distinct()
    full = now.join(b, F.col(key) == F.col("_k"), "left").join(t, F.col(key) == F.col("_tk"), "left")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_touched").isNotNull(), "dirty").otherwise("kept")
    return full.withColumn("state", state).withColumn(value, F.when(F.col("state") == "kept", F.col("_v"))).drop("_k", "_v", "_old", "_tk", "_touched")


def zero_filled(counts: DataFrame, dimension: list[str], key: str, value: str) -> DataFrame:
    """``counts`` with a 0 for each listed key that has none; keys beyond the list stay."""
    known = counts.sparkSession.createDataFrame([(k,) for k in dimension], f"{key} string")
    return counts.join(F.broadcast(known), key, "full").select(key, F.coalesce(value, F.lit(0)).alias(value))


def without_known(df: DataFrame, known: DataFrame, keys: list[str], forced: Column | None = None) -> DataFrame:
    """Rows whose keys are not in ``known`` yet, and forced ones. NULL keys count as unknown."""
    left = df if forced is None else df.where(~F.coalesce(forced, F.lit(False)))
    fresh = left.join(known.select(*keys).distinct(), keys, "left_anti")
    return fresh if forced is None else fresh.unionByName(df.where(F.coalesce(forced, F.lit(False))))
