"""Consensus from several annotators: confidence-aware truth discovery.

``trust``: truth and annotators are estimated in turn until the items hardly move any more:

* a label is read as a measurement of the truth: an annotator's share of ups where the truth is down and where it is up
  give an offset and a slope, and the label is calibrated with them. A voter who is mostly wrong has a negative slope
  and counts reversed, one who always says the same has next to none and so a large error;
* the weighted label distance of an annotator is the sum of squared differences between calibrated labels and the
  current truth; over the votes it is the error variance;
* the variance gets an upper bound, the distance over a chi-squared quantile with as many degrees of freedom as there
  are votes, so a rarely seen annotator (the long tail) cannot get a high weight by luck;
* the weight of an annotator is the reciprocal of that bound, the truth of an item the mean of calibrated labels under
  these weights, which minimises the weighted distance, within 0 and 1.

``discover`` is another form: a source is one user giving one
label, the weight the log ratio of the bounded variances of the reversed label and of the label as written, less what
the label's base rate alone would give. Users who mostly vote wrong count reversed there, users who always give the same
label count for nothing.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.runtime import cut, drop_cut, skew_join

# Spellings of the two verdicts, after case, outer spaces and skin tones are gone.
UP = ("up", "thumbs_up", "thumbsup", "thumbs up", ":thumbsup:", ":+1:", "+1", "+", "1", "👍", "⬆", "✅", "✔", "positivo", "positive", "yes", "sim", "y", "true", "upvote", "like")
DOWN = ("down", "thumbs_down", "thumbsdown", "thumbs down", ":thumbsdown:", ":-1:", "-1", "-", "👎", "⬇", "❌", "✖", "negativo", "negative", "no", "não", "nao", "n", "false", "downvote", "dislike")
UNKNOWN_USERS = ("", "anonymous")
#: Normal quantile of the lower 2.5 per cent, for the two-sided 95 per cent bound.
Z = -1.959964


def vote_value(verdict: Column) -> Column:
    """1 for up, 0 for down, NULL if the verdict is neither."""
    v = F.lower(F.trim(F.regexp_replace(verdict, "[\\x{1F3FB}-\\x{1F3FF}\\x{FE0F}]", "")))
    return F.when(v.isin(*UP), 1).when(v.isin(*DOWN), 0)


def last_votes(feedback: DataFrame) -> DataFrame:
    """(item_id, voter, up): each known user's last usable vote on an item.

    Needs item_id, user, verdict, at, feedback_id. Users differ only beyond case and outer spaces; NULL, empty
    and anonymous users and unusable verdicts are left out. Votes of the same moment: the higher feedback_id
    counts; a vote without a moment counts before all others. The last vote is taken by an aggregate that
    combines before the shuffle.
    """
    rows = feedback.select("item_id", F.lower(F.trim("user")).alias("voter"), vote_value(F.col("verdict")).alias("up"), F.struct(F.coalesce(F.col("at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), F.coalesce("feedback_id", F.lit(-1))).alias("when"))
    rows = rows.where(F.col("item_id").isNotNull() & F.col("voter").isNotNull() & ~F.col("voter").isin(*UNKNOWN_USERS) & F.col("up").isNotNull())
    return rows.groupBy("item_id", "voter").agg(F.max_by("up", "when").alias("up"))


def chi2_lower(n: Column) -> Column:
    """Lower 2.5 per cent quantile of chi-squared with n degrees of freedom (Wilson and Hilferty)."""
    h = F.lit(2.0) / (F.lit(9.0) * n)
    return n * F.pow(F.greatest(F.lit(1.0) - h + F.lit(Z) * F.sqrt(h), F.lit(1e-3)), F.lit(3.0))


def _log_odds(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass(frozen=True)
class Progress:
    """How an estimate ended: rounds made and how far the last one moved the items in the mean."""

    rounds: int
    moved: float
    converged: bool


def trust(votes: DataFrame, rounds: int = 40, least_move: float = 1e-3, steady: float = 2.0, least_slope: float = 0.02, least_variance: float = 0.1) -> tuple[DataFrame, DataFrame, Progress]:
    """(items, annotators, progress) from ``last_votes``.

    items: item_id, n, n_up, p_up (weighted mean of the calibrated labels, 1 for up). annotators: voter, n, offset, slope, distance,
    weight, reliability (the share of votes that agree with the truth as found). ``steady`` votes, half of them right, steady
    slopes and distances; a slope nearer to 0 than ``least_slope`` is moved there, so that its labels have a large but finite error.
    ``least_variance`` is added to the error variance of all, else those who agree most with the truth found set it alone in the end.
    Ends when p_up moves by less than ``least_move`` in the mean of all items; a warning tells if ``rounds`` were not enough.
    Items of one vote count for the estimate too. An empty table gives empty frames. Each round aggregates before
    it shuffles; joins with heavy items or voters are split by ``skew_join``.
    """
    votes = cut(votes)
    total, mean = votes.agg(F.count("*"), F.avg("up")).first()
    items = cut(votes.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("up").alias("n_up")).withColumn("p_up", F.col("n_up") / F.col("n")))
    done, moved = 0, math.inf if total else 0.0
    people = None
    while people is None or (done < rounds and moved >= least_move):
        seen = skew_join(votes, items.select("item_id", "n", "p_up"), "item_id", "n", total)
        new_people = cut(_calibrated(seen, mean or 0.0, steady, least_slope, least_variance))
        pull = skew_join(votes, new_people.select("voter", "n", "offset", "slope", "weight"), "voter", "n", total)
        label = (F.col("up") - F.col("offset")) / F.col("slope")
        truth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.col("weight") * label) / F.sum("weight")))
        new = cut(pull.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("up").alias("n_up"), truth.alias("p_up")))
        moved = new.join(items.select("item_id", F.col("p_up").alias("old")), "item_id").agg(F.avg(F.abs(F.col("p_up") - F.col("old")))).first()[0] or 0.0
        drop_cut(items)
        if people is not None:
            drop_cut(people)
        items, people, done = new, new_people, done + 1
    if moved >= least_move:
        warnings.warn(f"not settled after {done} rounds: items moved by {moved:.4f}", stacklevel=2)
    return items, people, Progress(done, moved, moved < least_move)


def _calibrated(seen: DataFrame, mean: float, steady: float, least_slope: float, least_variance: float) -> DataFrame:
    """voter, n, offset, slope, distance, weight, reliability of votes (voter, up, p_up); one aggregate, as the distance follows from sums."""
    y, p, n = F.col("up"), F.col("p_up"), F.col("n")
    sums = seen.groupBy("voter").agg(F.count("*").alias("n"), F.sum(y).alias("ups"), F.sum(p).alias("ps"), F.sum(y * p).alias("both"), F.sum(p * p).alias("squares"))
    # steadying votes: half of them right, half at the mean label
    low = (F.col("ups") - F.col("both") + steady * mean / 2) / (n - F.col("ps") + steady)
    high = (F.col("both") + steady * (1 + mean) / 2) / (F.col("ps") + steady)
    sums = sums.withColumn("slope", high - low)
    away = F.when(F.abs("slope") >= least_slope, F.col("slope")).when(F.col("slope") < 0, -least_slope).otherwise(least_slope)
    # the mean label stands for the mean truth of the voter's items
    sums = sums.withColumn("slope", away).withColumn("offset", (F.col("ups") - F.col("slope") * F.col("ps")) / n)
    square = F.col("slope") * F.col("slope")
    labels = (F.col("ups") - 2 * F.col("offset") * F.col("ups") + n * F.col("offset") * F.col("offset")) / square
    cross = (F.col("both") - F.col("offset") * F.col("ps")) / F.col("slope")
    distance = F.greatest(labels - 2 * cross + F.col("squares"), F.lit(0.0)) + steady * max(mean * (1 - mean), 0.01) / square + least_variance * n
    right = (2 * F.col("both") + n - F.col("ups") - F.col("ps")) / n
    out = sums.withColumn("distance", distance).withColumn("weight", chi2_lower(n.cast("double")) / F.col("distance"))
    return out.select("voter", "n", "offset", "slope", "distance", "weight", right.alias("reliability"))


def discover(votes: DataFrame, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(items, sources) from ``last_votes``.

    items: item_id, n, n_up, p_up (probability that the truth is up). sources: voter, up, n, right (expected
    votes in accord with the truth), weight. Stops early when no p_up moves by 0.001. Items of one vote count
    for the estimate too. An empty table gives empty frames. Each round aggregates before it shuffles; joins
    with heavy items or voters are split by ``skew_join``.
    """
    votes = cut(votes.withColumn("source", F.concat(F.col("up").cast("string"), "voter")))
    total = votes.count()
    items = cut(votes.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("up").alias("n_up")).withColumn("p_up", F.col("n_up") / F.col("n")))
    sources = None
    for k in range(rounds):
        pi = min(max(items.agg(F.avg("p_up")).first()[0] or 0.5, 0.05), 0.95)
        seen = skew_join(votes, items.select("item_id", "n", "p_up"), "item_id", "n", total)
        base = F.when(F.col("up") == 1, F.lit(pi)).otherwise(F.lit(1 - pi))
        right = F.sum(F.when(F.col("up") == 1, F.col("p_up")).otherwise(1 - F.col("p_up")))
        # two votes' worth of the base rate steadies users with few votes
        s = seen.groupBy("source", "voter", "up").agg(F.count("*").alias("n"), right.alias("right")).withColumn("m", F.col("n") + 2.0).withColumn("error", (F.col("n") - F.col("right") + 2 * (1 - base)) / F.col("m"))
        small = F.least("error", 1 - F.col("error"))
        bound = F.least(small * F.col("m") / chi2_lower(F.col("m")), 1 - small)
        signed = F.log((1 - small) / bound) * F.when(F.col("error") < 0.5, 1.0).otherwise(-1.0)
        sources = cut(s.withColumn("weight", signed - F.when(F.col("up") == 1, F.lit(_log_odds(pi))).otherwise(F.lit(_log_odds(1 - pi)))).drop("m", "error"))
        pull = skew_join(votes.select("item_id", "source", "up"), sources.select("source", "n", "weight"), "source", "n", total)
        score = F.sum(F.when(F.col("up") == 1, F.col("weight")).otherwise(-F.col("weight")))
        new = pull.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("up").alias("n_up"), score.alias("score")).select("item_id", "n", "n_up", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("score") + F.lit(_log_odds(pi))))))).alias("p_up"))
        new = cut(new)
        moved = new.join(items.select("item_id", F.col("p_up").alias("old")), "item_id").agg(F.max(F.abs(F.col("p_up") - F.col("old")))).first()[0]
        drop_cut(items)
        items = new
        if moved is None or moved < 1e-3:
            break
    return items, sources


def consensus(items: DataFrame, least_users: int = 3) -> DataFrame:
    """item_id, n_users, n_up, consensus, confidence and agreement (share of pairs of votes that agree) of items with enough users."""
    n, up = F.col("n"), F.col("n_up")
    pairs = (up * (up - 1) + (n - up) * (n - up - 1)) / (n * (n - 1))
    return items.where(n >= least_users).select("item_id", n.alias("n_users"), "n_up", F.when(F.col("p_up") > 0.5, "up").otherwise("down").alias("consensus"), F.greatest("p_up", 1 - F.col("p_up")).alias("confidence"), F.when(n > 1, pairs).alias("agreement"))


def reliability(sources: DataFrame) -> DataFrame:
    """Of the sources of ``discover``: voter, n_votes, reliability (expected share of right votes), weight_up, weight_down."""
    pick = lambda v: F.max(F.when(F.col("up") == v, F.col("weight")))
    return sources.groupBy("voter").agg(F.sum("n").alias("n_votes"), (F.sum("right") / F.sum("n")).alias("reliability"), pick(1).alias("weight_up"), pick(0).alias("weight_down"))


def overall_agreement(votes: DataFrame) -> DataFrame:
    """One row: items with two votes or more, mean pairwise agreement, agreement expected by chance, kappa."""
    per = votes.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("up").alias("k")).where("n > 1")
    pairs = (F.col("k") * (F.col("k") - 1) + (F.col("n") - F.col("k")) * (F.col("n") - F.col("k") - 1)) / (F.col("n") * (F.col("n") - 1))
    one = per.agg(F.count("*").alias("n_items"), F.avg(pairs).alias("agreement"), (F.sum("k") / F.sum("n")).alias("p"))
    chance = F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))
    return one.select("n_items", "agreement", chance.alias("by_chance"), F.try_divide(F.col("agreement") - chance, 1 - chance).alias("kappa"))
