"""Mixing sources to target shares of tokens: entropy balancing.

Each document gets a rate, its expected number of copies. Two constraints hold for a source: its tokens meet
their goal, and the copies keep the mean size of its documents, so that a source that shrinks or grows does
not lose or favour its long texts. Entropy balancing tilts a document by ``exp(intercept + slope * size)``; with
the mean size kept, the dual is solved by slope 0 and intercept ``log(goal / available tokens)``: every document
of a source has the same rate, which never exceeds the source's cap, as the goal is at most cap times the
available tokens. Rates become copies from the longest text down: each size gets the copies that bring the tokens
so far nearest to what the rates give so far, so that all sizes are thinned or repeated alike, what a long text
adds or leaves out is made up by the next shorter ones, and a source meets its goal to about its shortest texts.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.functions.ranking import rank_within
from sextant.runtime import cut, skew_join


def _by_source(values: dict[str, float]) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))))[F.col("source")]


def _rounded(sizes: pd.DataFrame) -> pd.DataFrame:
    """One source's sizes with all copies of each size; one row per size, so bounded by the longest text."""
    sizes = sizes.sort_values("n_tokens", ascending=False)
    out, due = [], 0.0  # tokens that the sizes so far should have and do not have yet
    for size, n, rate in zip(sizes["n_tokens"], sizes["n"], sizes["rate"]):
        due += n * rate * size
        best = round(due / size) if size else round(n * rate)
        out.append(min(max(best, n * math.floor(rate)), n * math.ceil(rate)))
        due -= out[-1] * size
    return sizes.assign(all=out)[["source", "n_tokens", "n", "rate", "all"]]


def balance(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, slack: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """(copies, shares).

    ``sizes``: doc_id, source, n_tokens; ``targets``: source, target_share, max_repeats (few rows; rows without a
    source, a positive share or a positive cap are left out, of a source named twice the shares add up and the lower
    cap counts). ``total_tokens``: size of the mix; by default the tokens of all named sources, or ``slack`` times
    what the scarcest source allows, if that is less. A target without documents can't be met: the other shares are
    scaled to sum 1 and the report says so. Documents of other sources, or of none, get no copies.

    copies: doc_id, source, n_tokens, rate, copies, for all documents of the named sources. shares: source,
    target_share, wanted_share, reached_share, n_documents, n_tokens, tokens_reached, most_copies, max_repeats, for
    named sources and all others that occur (target 0).
    """
    spark = sizes.sparkSession
    want = {r.source: (r.s, r.m) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("s"), F.min("max_repeats").alias("m")).collect()}
    hist = cut(sizes.where(F.col("source").isin(*want) if want else F.lit(False)).groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    have = {r.source: r.t for r in hist.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t")).collect() if r.t > 0}
    scale = sum(want[s][0] for s in have)
    share = {s: want[s][0] / scale for s in have}
    cap = {s: float(want[s][1]) for s in have}
    room = min((cap[s] * have[s] / share[s] for s in have), default=0.0)
    total = total_tokens or min(sum(have.values()), slack * room)
    goal = {s: min(share[s] * total, cap[s] * have[s]) for s in have}

    rate = _by_source({s: goal[s] / have[s] for s in have} or {"": 0.0})
    rated = hist.where(F.col("source").isin(*have) if have else F.lit(False)).withColumn("rate", rate)
    rated = rated.groupBy("source").applyInPandas(_rounded, "source string, n_tokens bigint, n bigint, rate double, all bigint")
    rated = cut(rated.select(F.concat_ws("\u0001", "source", F.col("n_tokens").cast("string")).alias("cell"), "n", "rate", "all"))

    docs = cut(sizes.where(F.col("source").isin(*have) if have else F.lit(False)).withColumn("cell", F.concat_ws("\u0001", "source", F.col("n_tokens").cast("string"))))
    ranked = rank_within(docs, ["cell"], ["doc_id"])
    total_rows = rated.agg(F.sum("n")).first()[0] or 0
    weights = rated.withColumn("w", F.col("n"))
    copies = F.floor(F.col("all") / F.col("n")) + F.when(F.col("rank") < F.col("all") % F.col("n"), 1).otherwise(0)
    out = skew_join(ranked, weights, "cell", "w", total_rows).select("doc_id", "source", "n_tokens", "rate", copies.cast("bigint").alias("copies"))

    reached = out.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_reached"), F.max("copies").alias("most_copies"))
    present = sizes.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    named = spark.createDataFrame([(s, v[0], share.get(s, 0.0), v[1]) for s, v in want.items()], "source string, target_share double, wanted_share double, max_repeats int")
    both = present.join(F.broadcast(named), "source", "full").join(reached, "source", "left")
    everything = F.sum(F.coalesce("tokens_reached", F.lit(0))).over(W.partitionBy(F.lit(1)))  # one row per source
    zero = lambda c: F.coalesce(c, F.lit(0))
    shares = both.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("wanted_share", F.lit(0.0)).alias("wanted_share"), F.coalesce(F.try_divide(zero("tokens_reached"), everything), F.lit(0.0)).alias("reached_share"), zero("n_documents").alias("n_documents"), zero("n_tokens").alias("n_tokens"), zero("tokens_reached").alias("tokens_reached"), zero("most_copies").alias("most_copies"), "max_repeats")
    return out, shares
