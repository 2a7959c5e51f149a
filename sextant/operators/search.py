"""Ranking over texts: similar titles, BM25, fusion of signals and its evaluation. All of it for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.functions.text import token_set, tokens
from sextant.operators.changes import top_per
from sextant.runtime import cut, literals, sized

SIGNALS = ("title_sim", "fts", "cochange", "centrality")
# The weights of the default ranking and those that the grid tries.
DEFAULT_WEIGHTS = (0.5, 0.2, 0.2, 0.1)
# The weightings that are compared, for title_sim, fts, cochange, centrality.
GRID = {
    "default": (0.35, 0.35, 0.2, 0.1),
    "fts-heavy": (0.2, 0.5, 0.2, 0.1),
    "titleSim-heavy": (0.5, 0.2, 0.2, 0.1),
    "no-centrality": (0.4, 0.4, 0.2, 0.0),
    "cochange-heavy": (0.25, 0.25, 0.4, 0.1),
}

#: Most asked words that are looked up as literals.
LITERAL_WORDS = 20_000
#: Beyond so many words, sets that differ by one word may have scores that are equal when rounded.
LONG = 10_000
#: More queries than these meet the entries by their frequent words' subsets.
MANY = 2_000
#: So many words, those that most pairs of a query and an entry share, are frequent.
FREQUENT = 256
#: Most frequent words of a text whose subsets are listed; texts with more meet word by word.
SUBSET_WORDS = 10


def grouped(sets: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """(pr, _key, _g): entries by their number of words and their words that are ``asked`` for, which is all that a score depends on.

    ``sets``: pr, _key, _s (distinct words); ``asked``: _t. A group keeps its first ``top`` entries of each key and the first
    ``2 * top`` of these: what lies behind has ``top`` better ones before it, whichever key is left out.
    """
    words = [r[0] for r in asked.where("_t is not null").limit(LITERAL_WORDS + 1).collect()]
    if len(words) <= LITERAL_WORDS:  # in the row; as a member of an array, as a filter on it would work the words out again
        one = f"filter(transform(array(_s), s -> struct(size(s) AS ne, array_join(array_sort(filter(s, w -> w IN ({literals(words)}))), ' ') AS a)), x -> x.a <> '')"
        named = sets.select("pr", "_key", F.explode(F.expr(one)).alias("_x")).select("pr", "_key", F.concat_ws(" ", "_x.ne", "_x.a").alias("_g"))
    else:
        e = cut(sets.where("size(_s) > 0").withColumn("_e", F.monotonically_increasing_id()))
        hits = e.select("_e", "pr", "_key", F.size("_s").alias("_ne"), F.explode("_s").alias("_t")).join(sized(asked), "_t")
        named = hits.groupBy("_e", "pr", "_key", "_ne").agg(F.array_sort(F.collect_list("_t")).alias("_a")).select("pr", "_key", F.concat_ws(" ", "_ne", F.array_join("_a", " ")).alias("_g"))
    each = top_per(named, ["_g", "_key"], [F.asc("pr")], top).drop("place")
    return top_per(each, ["_g"], [F.asc("pr")], 2 * top).drop("place")


def similar(queries: DataFrame, entries: DataFrame, top: int = 15, own: tuple[str, str] | None = None) -> DataFrame:
    """The ``top`` most similar entries of each query: query_id, pr, score, place.

    ``queries``: query_id, text; ``entries``: pr, text. ``own`` names a column of the entries and one of the queries; an entry
    whose value equals the query's is none of its results, NULL equals nothing. The score is the Jaccard index of the word
    sets, found through shared words; entries that share none score 0 and are not listed. Ties go to the smaller pr. NULL
    and empty texts match nothing.

    Words that no query has count for the size of a set only, so queries meet the sets of asked words (``grouped``). Of
    entries with the same asked words the smaller is the more similar, so a set stands for its smallest entry.
    """
    none = F.lit(None).cast("string")
    q = cut(queries.select("query_id", (F.col(own[1]) if own else none).alias("_own"), token_set(F.col("text")).alias("_w")).where("size(_w) > 0"))
    asked = q.select("query_id", "_own", F.size("_w").alias("_nq"), F.explode("_w").alias("_t"))
    kept = grouped(entries.select("pr", (F.col(own[0]) if own else none).alias("_key"), token_set(F.col("text")).alias("_s")), asked.select("_t").distinct(), top)
    longest = q.agg(F.max(F.size("_w"))).first()[0] or 0
    long = longest > LONG
    if longest <= LONG and q.count() > MANY:
        e = cut(_first_of_each(_parsed(kept), ["_a"], top))
        if (e.agg(F.max("ne")).first()[0] or 0) <= LONG:
            return _similar_by_subsets(q, e, top)

    # a set stands for its first entry, or for the first of another key where that is the query's own
    n = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, so that few bytes with many hits stay spread
    part = F.split("_g", " ", 2)
    ne = F.get(part, F.lit(0)).cast("int")
    members = kept.select(F.struct(ne.alias("ne"), "pr", F.col("_key").alias("key")).alias("_m"), F.get(part, F.lit(1)).alias("_a"), F.when(F.lit(long) | (ne > LONG), ne).alias("_n"))
    groups = members.groupBy("_a", "_n").agg(F.array_sort(F.collect_list("_m")).alias("_m")).select(F.monotonically_increasing_id().alias("_i"), F.split("_a", " ").alias("_a"), "_m")
    groups = cut(groups)
    first = F.get("_m", F.lit(0))
    other = F.get(F.filter("_m", lambda x: ~x["key"].eqNullSafe(first["key"])), F.lit(0))
    stand = groups.select("_i", "_a", first["key"].alias("_k"), first["ne"].alias("_ne"), first["pr"].alias("_pr"), other["ne"].alias("_one"), other["pr"].alias("_opr"))
    is_own = F.coalesce(F.col("_k") == F.col("_own"), F.lit(False))
    stands = lambda a, b: F.when(is_own, F.col(b)).otherwise(F.col(a))
    words = stand.repartition(n, "_i").select("_i", "_k", "_ne", "_pr", "_one", "_opr", F.explode("_a").alias("_t"))
    hits = words.join(sized(asked), "_t").select("query_id", "_own", "_nq", "_i", stands("_ne", "_one").alias("ne"), stands("_pr", "_opr").alias("pr")).where("ne is not null").groupBy("query_id", "_own", "_nq", "_i", "ne", "pr").agg(F.count("*").alias("_both"))
    score = F.col("_both") / (F.col("_nq") + F.col("ne") - F.col("_both"))
    order = [F.desc(F.round("score", 9)), F.asc("pr")]
    best = cut(top_per(hits.withColumn("score", score), ["query_id"], order, top).select("query_id", "_own", "_nq", "_i", "_both"))
    full = groups.select("_i", F.explode("_m").alias("_x")).select("_i", "_x.*").join(sized(best), "_i").where(~F.coalesce(F.col("key") == F.col("_own"), F.lit(False)))
    return top_per(full.select("query_id", "pr", score.alias("score")), ["query_id"], order, top)


def _parsed(kept: DataFrame) -> DataFrame:
    """pr, _key, ne and _a (asked words, parted by blanks) of what ``grouped`` gives."""
    part = F.split("_g", " ", 2)
    return kept.select("pr", "_key", F.get(part, F.lit(0)).cast("int").alias("ne"), F.get(part, F.lit(1)).alias("_a"))


def _first_of_each(entries: DataFrame, by: list[str], top: int, order: tuple[Column, ...] = ()) -> DataFrame:
    """The first ``2 * top`` of each group after the first ``top`` of each of its keys, as in ``grouped``; smaller sets come first."""
    order = [*order] or [F.asc("ne"), F.asc("pr")]
    return top_per(top_per(entries, [*by, "_key"], order, top).drop("place"), by, order, 2 * top).drop("place")


def _similar_by_subsets(q: DataFrame, e: DataFrame, top: int) -> DataFrame:
    """``similar`` for many queries: no pair is made of a query and an entry only because both have a frequent word.

    ``q``: query_id, _own, _w; ``e``: pr, _key, ne, _a. The score of an entry that shares no rare word depends on the
    query's size and frequent words, its class. For each set of frequent words the first entries that have it all are kept: an
    entry behind them in the set that it shares with a query has as many better ones before it, as they share that set or more
    and are no larger. A class looks at its whole set and those with one word less; if what it found is not better than
    sets of fewer words can be, at these too. Entries that share a rare word meet their queries by it.
    """
    asked = q.select(F.explode("_w").alias("_t")).groupBy("_t").agg(F.count("*").alias("nq"))
    held = e.select(F.explode(F.split("_a", " ")).alias("_t")).groupBy("_t").agg(F.count("*").alias("n"))
    common = [r[0] for r in held.join(asked, "_t").orderBy(F.desc(F.col("nq") * F.col("n")), "_t").limit(FREQUENT).collect()]
    parts = lambda d, words: d.withColumn("_w", words).select("*", F.array_sort(F.expr(f"filter(_w, w -> w IN ({literals(common)}))")).alias("_f"), F.expr(f"filter(_w, w -> w NOT IN ({literals(common)}))").alias("_r"))
    q = cut(parts(q, F.col("_w")).select("query_id", "_own", F.size("_w").alias("_nq"), F.array_join("_f", " ").alias("_qf"), "_r"))
    e = cut(parts(e, F.split("_a", " ")).select("pr", "_key", "ne", F.array_join("_f", " ").alias("_ef"), "_r"))
    words = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    score = lambda both: F.col(both) / (F.col("_nq") + F.col("ne") - F.col(both))
    not_own = ~F.coalesce(F.col("_key") == F.col("_own"), F.lit(False))
    best_first = (F.desc(F.round("score", 9)), F.asc("pr"))

    # by rare words
    rare = q.select("query_id", "_own", "_nq", "_qf", F.explode("_r").alias("_t")).join(e.select("pr", "_key", "ne", "_ef", F.explode("_r").alias("_t")), "_t").where(not_own)
    rare = rare.groupBy("query_id", "pr", "_nq", "ne", "_qf", "_ef").agg(F.count("*").alias("_n")).withColumn("_both", F.col("_n") + F.size(F.array_intersect(words("_qf"), words("_ef"))))
    found = top_per(rare.select("query_id", "pr", score("_both").alias("score")), ["query_id"], [*best_first], top).drop("place")

    # by sets of frequent words
    sets = cut(_first_of_each(e.where("_ef <> ''"), ["_ef"], top).select("_ef", "pr", "_key", "ne"))
    classes = cut(q.where("_qf <> ''").select("_qf", "_nq").distinct().withColumn("_k", F.size(words("_qf"))))
    bits = lambda c: f"filter(split({c}, ' '), (w, i) -> (m >> i) & 1 = 1)"
    subsets = lambda c: F.explode(F.expr(f"transform(sequence(1, (1 << size(split({c}, ' '))) - 1), m -> array_join({bits(c)}, ' '))"))
    short = F.size(words("_ef")) <= SUBSET_WORDS
    of_sets = cut(sets.where(short).select("_ef").distinct().select("_ef", subsets("_ef").alias("_s")))
    of_classes = cut(classes.where(F.col("_k") <= SUBSET_WORDS).select("_qf", "_nq", "_k", subsets("_qf").alias("_s")).withColumn("_both", F.size(F.split("_s", " "))))
    rows = []
    left = of_classes.where("_both >= _k - 1")
    for step in (0, 1):
        listed = of_sets.join(left.select("_s").distinct(), "_s", "left_semi").join(sets, "_ef")
        listed = _first_of_each(listed.select("_s", "pr", "_key", "ne"), ["_s"], top)
        met = left.join(listed, "_s").groupBy("_qf", "_nq", "_k", "pr", "_key", "ne").agg(F.max("_both").alias("_both")).withColumn("score", score("_both"))
        rows.append(cut(_first_of_each(met, ["_qf", "_nq"], top, best_first)))
        if not step:
            done = rows[0].groupBy("_qf", "_nq", "_k").agg(F.count("*").alias("n"), F.min(F.round("score", 9)).alias("worst")).where((F.col("n") == 2 * top) & (F.col("worst") > F.round((F.col("_k") - 2) / F.col("_nq"), 9)))
            left = cut(of_classes.join(done.select("_qf", "_nq"), ["_qf", "_nq"], "left_anti").where("_both < _k - 1"))

    # texts with too many frequent words for their subsets, word by word
    c, s = classes.select("_qf", "_nq", "_k", F.explode(words("_qf")).alias("_t")), sets.withColumn("_long", ~short).select("*", F.explode(words("_ef")).alias("_t"))
    far = c.join(s.where("_long"), "_t").unionByName(c.where(F.col("_k") > SUBSET_WORDS).join(s.where("not _long"), "_t"))
    met = far.groupBy("_qf", "_nq", "_k", "pr", "_key", "ne").agg(F.count("*").alias("_both")).withColumn("score", score("_both"))
    rows.append(_first_of_each(met, ["_qf", "_nq"], top, best_first).select(*rows[0].columns))

    near = cut(_first_of_each(rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("_qf", "_nq", "pr", "_key").agg(F.max("score").alias("score")), ["_qf", "_nq"], top, best_first))
    near = q.select("query_id", "_own", "_qf", "_nq").join(near, ["_qf", "_nq"]).where(not_own).select("query_id", "pr", "score")
    both = near.unionByName(found).groupBy("query_id", "pr").agg(F.max("score").alias("score"))
    return top_per(both, ["query_id"], [*best_first], top)


def bm25(queries: DataFrame, documents: DataFrame, top: int = 40, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 of each query's distinct words over ``documents`` (path, text): query_id, path, score, place.

    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. Ties go to the smaller path. Documents without words count for N.
    """
    d = documents.select("path", tokens(F.col("text")).alias("w"))
    n, mean = d.agg(F.count("*"), F.avg(F.size("w"))).first()
    post = d.select("path", F.size("w").alias("_len"), F.explode("w").alias("t")).groupBy("path", "_len", "t").agg(F.count("*").alias("_tf"))
    df = post.groupBy("t").agg(F.count("*").alias("_df"))
    asked = sized(queries.select("query_id", F.explode(token_set(F.col("text"))).alias("t")))
    hits = post.join(asked, "t").join(sized(df), "t")
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5)))
    part = idf * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.lit(mean or 1.0)))
    scored = hits.groupBy("query_id", "path").agg(F.sum(part).alias("score"))
    return top_per(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("path")], top)


def min_max(df: DataFrame, keys: list[str], value: str = "raw") -> DataFrame:
    """``value`` scaled to 0..1 within ``keys``; where all are equal 1, or 0 if they are 0."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("norm", F.when(hi == lo, F.when(hi == 0, 0.0).otherwise(1.0)).otherwise((F.col(value) - lo) / (hi - lo)))


def seeds(title: DataFrame, fts: DataFrame, top: int = 15) -> DataFrame:
    """Modules by the sum of both raw signals: query_id, path, place."""
    both = title.select("query_id", "path", "raw").unionByName(fts.select("query_id", "path", "raw")).groupBy("query_id", "path").agg(F.sum("raw").alias("raw"))
    return top_per(both, ["query_id"], [F.desc(F.round("raw", 9)), F.asc("path")], top)


def expand(seed: DataFrame, pairs: DataFrame, removed_pairs: DataFrame, removed: DataFrame, per_seed: int = 8) -> DataFrame:
    """Sum of conditionals over each seed's best neighbours, without the query's own changes.

    ``pairs``: ``cochange``; ``removed_pairs``: query_id, a, b, e_ab and ``removed``: query_id, a, e_a count what the
    query's own changes contributed, so nothing is counted anew for a query.
    """
    seed = cut(seed.select("query_id", F.col("path").alias("a")).join(removed, ["query_id", "a"], "left"))
    c = lambda n_ab, n_a: (n_ab / F.nullif(n_a, F.lit(0))).alias("c")
    order = [F.desc(F.round("c", 9)), F.asc("b")]
    # a module that the query's own changes don't touch has the same neighbours for all queries
    same = top_per(pairs.select("a", "b", c(F.col("n_ab"), F.col("n_a"))).where("c > 0"), ["a"], order, per_seed)
    same = seed.where("e_a is null").join(sized(same), "a").select("query_id", "b", "c")
    near = seed.where("e_a is not null").join(sized(pairs), "a").join(removed_pairs, ["query_id", "a", "b"], "left")
    near = near.select("query_id", "a", "b", c(F.col("n_ab") - F.coalesce("e_ab", F.lit(0)), F.col("n_a") - F.col("e_a"))).where("c > 0")
    best = top_per(near, ["query_id", "a"], order, per_seed)
    return same.unionByName(best.select("query_id", "b", "c")).groupBy("query_id", F.col("b").alias("path")).agg(F.sum("c").alias("raw"))


def combine(raw: dict[str, DataFrame]) -> DataFrame:
    """query_id, path and each signal scaled to 0..1 (0 where missing); ``raw`` has query_id, path, raw by signal.

    The last signal only counts for modules that another one proposed.
    """
    first = [d.select("query_id", "path", F.lit(s).alias("signal"), "raw") for s, d in raw.items() if s != "centrality"]
    long = first[0]
    for d in first[1:]:
        long = long.unionByName(d)
    wide = long.groupBy("query_id", "path").agg(*(F.max(F.when(F.col("signal") == s, F.col("raw"))).alias(s) for s in raw if s != "centrality"))
    if "centrality" in raw:
        prior = raw["centrality"].select("path", F.col("raw").alias("centrality"))
        wide = wide.join(sized(prior), "path", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    for s in raw:  # all in one window, so rows are moved once
        wide = min_max(wide, ["query_id"], s).withColumn(s, F.coalesce("norm", F.lit(0.0))).drop("norm")
    return wide.select("query_id", "path", *(F.col(s) if s in raw else F.lit(0.0).alias(s) for s in SIGNALS))


def fuse(signals: DataFrame, weights: tuple[float, ...] = DEFAULT_WEIGHTS, top: int = 20) -> DataFrame:
    """The ``top`` modules of each query by weighted sum: query_id, path, score, place and the signals. Ties go to the smaller path."""
    score = sum((F.lit(w) * F.col(s) for w, s in zip(weights, SIGNALS)), F.lit(0.0))
    return top_per(signals.withColumn("score", score), ["query_id"], [F.desc(F.round("score", 9)), F.asc("path")], top)


def dominant(weights: tuple[float, ...] = DEFAULT_WEIGHTS) -> Column:
    """The signal with the greatest weighted value; ties go to the first."""
    best = F.greatest(*(F.round(F.lit(w) * F.col(s), 9) for w, s in zip(weights, SIGNALS)))
    return F.coalesce(*(F.when(F.round(F.lit(w) * F.col(s), 9) == best, F.lit(s)) for w, s in zip(weights, SIGNALS)))


def evaluate(ranked: DataFrame, gold: DataFrame, cases: DataFrame, by: list[str], ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """recall@k, hit@k and average precision@10 of each case.

    ``ranked``: ``by`` + path, place; ``gold``: query_id, path; ``cases``: all cases with the ``by`` columns. A case
    without gold gets 1 everywhere; one with gold but without ranking 0.
    """
    good = gold.select("query_id", "path").distinct()
    hit = ranked.join(good, ["query_id", "path"]).select(*by, "place")
    ordered = hit.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy("place")))
    got = ordered.groupBy(*by).agg(*(F.count_if(F.col("place") <= k).alias(f"h{k}") for k in ks), F.sum(F.when(F.col("place") <= 10, F.col("nth") / F.col("place")).otherwise(0.0)).alias("ap"))
    size = good.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    full = cases.join(sized(size), "query_id", "left").join(got, by, "left")
    n = F.coalesce("n_gold", F.lit(0))
    none = lambda c: F.when(n == 0, 1.0).otherwise(c)
    h = lambda k: F.coalesce(F.col(f"h{k}"), F.lit(0))
    return full.select(*by, n.alias("n_gold"), *(none(h(k) / F.nullif(n, F.lit(0))).alias(f"recall_{k}") for k in ks), *(none(F.when(h(k) > 0, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks), none(F.coalesce("ap", F.lit(0.0)) / F.nullif(F.least(n, F.lit(10)), F.lit(0))).alias("ap_10"))


def allowed_answers(answers: DataFrame, allowed: DataFrame, by: str, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """``by``, path, score: the members of each answer that are among the allowed paths of its group, scores within bounds.

    ``answers``: ``by``, answer (JSON array of {path, score}); ``allowed``: ``by``, path. What is no such array gives no rows; a path
    that an answer names twice keeps its highest score; a score that is no number counts as ``low``.
    """
    rows = answers.select(by, F.explode(F.from_json("answer", "array<struct<path string, score string>>")).alias("a")).where("a.path is not null")
    score = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.coalesce(F.col("a.score").try_cast("double"), F.lit(float(low)))))
    best = rows.groupBy(by, F.col("a.path").alias("path")).agg(F.max(score).alias("score"))
    return best.join(allowed.select(by, "path").distinct(), [by, "path"], "left_semi")
