"""Queries that rank modules for searched issues, and evaluate the ranking."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import changes as C
from sextant.operators import graph as G
from sextant.operators import search as S
from sextant.plans.history import EVERY_ISSUE, KEPT, SEARCHED, _every_issue, _searched, similar_sql
from sextant.plans.parts import CHANGES, MODULES, NEIGHBOURS, PAIRS, rounded, sql_tokens, the_changes, the_module_sets, the_pr_modules, without_bumps
from sextant.runtime import cut, sized, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module texts: name, path words, classes twice, summary."""
    classes = F.array_join("classes", " ")
    return table(spark, sf_dir, "modules").select("path", F.concat_ws(" ", "name", F.replace("path", F.lit("/"), F.lit(" ")), classes, classes, "summary").alias("text"))


def _edges(pairs: DataFrame) -> DataFrame:
    near = C.top_per(pairs, ["a"], [F.desc(F.round("conditional", 9)), F.asc("b")], 8)
    return near.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _ranks(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    return G.page_rank(table(spark, sf_dir, "modules").select(F.col("path").alias("id")), _edges(pairs))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty modules whose text fits each searched issue best."""
    return rounded(S.bm25(_searched(spark, sf_dir), _documents(spark, sf_dir)), "score")


def _near(changes: DataFrame, searched: DataFrame) -> DataFrame:
    entries = without_bumps(changes).select("pr", "key", F.coalesce("jiraTitle", "title").alias("text"))
    return S.similar(searched, entries, 15, ("key", "q_key"))


def _touched(sets: DataFrame, near: DataFrame) -> DataFrame:
    """``near`` for each module that its changes touch."""
    return sets.select("pr", "m").join(sized(near), "pr").select(*near.columns, F.explode("m").alias("path"))


def _title(touched: DataFrame) -> DataFrame:
    return touched.groupBy("query_id", "path").agg(F.sum("score").alias("raw"))


def title_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules by the similarity of the changes that touch them."""
    t = the_changes(spark, sf_dir)
    near = cut(_near(t, _searched(spark, sf_dir)))
    found = cut(t.select("pr", "files").join(sized(near.select("pr").distinct()), "pr", "left_semi"))
    return rounded(_title(_touched(the_module_sets(spark, sf_dir, found), near)), "raw")


def _parts(spark: SparkSession, sf_dir: str, searched: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    """The raw signals that are an issue's own, the pairs of co-change, the modules that its own changes touch (query_id, path) and those that near ones touch."""
    t = the_changes(spark, sf_dir)
    sets = the_module_sets(spark, sf_dir, t, ("key",))
    pairs = cut(C.cochange_of(sets))
    near = cut(_near(t, searched))
    touched = cut(_touched(sets, near))
    raw = {"title_sim": cut(_title(touched)), "fts": cut(S.bm25(searched, _documents(spark, sf_dir)).select("query_id", "path", F.col("score").alias("raw")))}
    own = cut(sets.join(sized(searched.select("query_id", F.col("q_key").alias("key")).distinct()), "key").select("query_id", F.explode("m").alias("path"), "m"))
    removed = own.groupBy("query_id", F.col("path").alias("a")).agg(F.count("*").alias("e_a"))
    removed_pairs = own.select("query_id", F.col("path").alias("a"), F.explode("m").alias("b")).where("a <> b").groupBy("query_id", "a", "b").agg(F.count("*").alias("e_ab"))
    raw["cochange"] = cut(S.expand(S.seeds(raw["title_sim"], raw["fts"]), pairs, removed_pairs, removed))
    return raw, pairs, own.select("query_id", "path").distinct(), touched


def _signals(spark: SparkSession, sf_dir: str, searched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scaled signals, (query_id, path) of the modules that an issue's own changes touch, and the most similar change by module."""
    raw, pairs, own, touched = _parts(spark, sf_dir, searched)
    raw["centrality"] = _ranks(spark, sf_dir, pairs).select(F.col("id").alias("path"), F.col("rank").alias("raw"))
    return cut(S.combine(raw)), own, touched.groupBy("query_id", "path").agg(F.min_by("pr", "place").alias("pr"))


def seed_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that change together with the best seeds, without the issue's own changes."""
    return rounded(_parts(spark, sf_dir, _searched(spark, sf_dir))[0]["cochange"], "raw")


def fused_retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty modules most likely to change for each searched issue."""
    return rounded(S.fuse(_signals(spark, sf_dir, _searched(spark, sf_dir))[0]), "score", *S.SIGNALS)


def dominant_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which signal carries each module ranked for any issue."""
    return S.fuse(_signals(spark, sf_dir, _every_issue(spark, sf_dir))[0]).select("query_id", "path", "place", S.dominant().alias("signal"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar change that touches each module ranked for any issue, if there is one."""
    sig, _, best = _signals(spark, sf_dir, _every_issue(spark, sf_dir))
    return S.fuse(sig).select("query_id", "path", "place").join(best, ["query_id", "path"], "left").select("query_id", "path", "place", F.col("pr").alias("evidence_pr"))


def eval_recall_hit_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the ranking finds the modules that really changed, for each issue."""
    sig, gold, _ = _signals(spark, sf_dir, _every_issue(spark, sf_dir))
    out = S.evaluate(S.fuse(sig), gold, _every_issue(spark, sf_dir).select("query_id"), ["query_id"])
    return rounded(out, *(c for c in out.columns if c not in ("query_id", "n_gold")))


def eval_grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall, hit and average precision of each weighting, signals computed once; the best by recall@10."""
    sig, gold, _ = _signals(spark, sf_dir, _searched(spark, sf_dir))
    grid = F.explode(F.array(*(F.struct(F.lit(n).alias("config"), F.array(*map(F.lit, w)).alias("w")) for n, w in S.GRID.items())))
    score = sum((F.get("w", F.lit(i)) * F.col(s) for i, s in enumerate(S.SIGNALS)), F.lit(0.0))
    each = sig.withColumn("g", grid).select("*", "g.config", "g.w").withColumn("score", score)
    ranked = C.top_per(each.select("config", "query_id", "path", "score"), ["config", "query_id"], [F.desc(F.round("score", 9)), F.asc("path")], 20)
    cases = _searched(spark, sf_dir).select("query_id", grid.alias("g")).select("query_id", "g.config")
    one = S.evaluate(ranked, gold, cases, ["config", "query_id"])
    mean = one.groupBy("config").agg(F.count("*").alias("n_cases"), *(F.round(F.avg(c), 6).alias(c) for c in one.columns if c not in ("config", "query_id", "n_gold")))
    mean = cut(mean)
    best = mean.agg(F.max_by("config", F.struct("recall_10", "config"))).first()[0]
    return mean.withColumn("is_best", F.col("config") == F.lit(best))


def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the first ten modules where a module above or below a true one counts as right."""
    from sextant.operators.paths import overlapping

    sig, gold, _ = _signals(spark, sf_dir, _searched(spark, sf_dir))
    found, gold = cut(S.fuse(sig, top=10).select("query_id", "path")), cut(gold)
    count = lambda d, name: d.groupBy("query_id").agg(F.count("*").alias(name))
    out = _searched(spark, sf_dir).select("query_id")
    for d, name in ((found, "n_found"), (gold, "n_gold"), (overlapping(found, gold, "path", "path", ["query_id"]), "hit_found"), (overlapping(gold, found, "path", "path", ["query_id"]), "hit_gold")):
        out = out.join(count(d, name), "query_id", "left")
    z = {c: F.coalesce(c, F.lit(0)) for c in ("n_found", "n_gold", "hit_found", "hit_gold")}
    p = F.when(z["n_found"] > 0, z["hit_found"] / z["n_found"]).otherwise(F.when(z["n_gold"] > 0, 0.0).otherwise(1.0))
    r = F.when(z["n_gold"] > 0, z["hit_gold"] / z["n_gold"]).otherwise(1.0)
    out = out.select("query_id", p.cast("double").alias("precision"), r.cast("double").alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rounded(out.withColumn("f1", f1), "precision", "recall", "f1")


def pagerank_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of each module in the graph of co-change."""
    return rounded(_ranks(spark, sf_dir, cut(C.cochange(the_pr_modules(spark, sf_dir)))), "rank")


def pagerank_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of each customer and supplier in the graph of who buys from whom, over all line items."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    e = li.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst")).join(o.select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey")).alias("src")), "o_orderkey").select("src", "dst").distinct()
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id")).unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id")))
    return rounded(G.page_rank(nodes, e), "rank")


def _gold(spark: SparkSession, sf_dir: str, changes: DataFrame, pm: DataFrame) -> DataFrame:
    keys = _searched(spark, sf_dir).select("query_id", F.col("q_key").alias("key"))
    return changes.select("pr", "key").join(sized(keys), "key").join(pm, "pr").select("query_id", "path").distinct()


def related_nodes_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six modules next to those that each searched issue changed, by links, then by rank."""
    t = cut(the_changes(spark, sf_dir))
    pm = the_pr_modules(spark, sf_dir, t)
    pairs = cut(C.cochange(pm))
    near = G.neighbours(_edges(pairs), _gold(spark, sf_dir, t, pm).select("query_id", F.col("path").alias("id")), ["query_id"])
    full = near.join(sized(_ranks(spark, sf_dir, pairs)), "id")
    return rounded(C.top_per(full, ["query_id"], [F.desc("links"), F.desc(F.round("rank", 9)), F.asc("id")], 6), "rank")


QUERIES = {f.__name__: f for f in (bm25_topk, title_signal, seed_expansion, fused_retrieval_topk, dominant_signal, evidence, eval_recall_hit_ap, eval_grid_best, precision_recall_f1, pagerank_modules, pagerank_customers, related_nodes_topk)}

_BM25 = f"""doc AS (SELECT path, {sql_tokens("concat_ws(' ', name, replace(path, '/', ' '), array_to_string(classes, ' '), array_to_string(classes, ' '), summary)")} AS w FROM modules),
facts AS (SELECT count(*) AS n, avg(len(w)) AS l FROM doc), post AS (SELECT path, len(w) AS dl, t, count(*) AS tf FROM (SELECT path, w, unnest(w) AS t FROM doc) GROUP BY ALL),
freq AS (SELECT t, count(*) AS df FROM post GROUP BY t), asked AS (SELECT query_id, unnest(list_distinct({sql_tokens("text")})) AS t FROM searched),
bm AS (SELECT query_id, path, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / l))) AS score FROM post JOIN asked USING (t) JOIN freq USING (t), facts GROUP BY ALL),
fts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS place FROM bm) WHERE place <= 40)"""
_BASE, _EVERY = (f"WITH RECURSIVE {CHANGES}, {MODULES}, {PAIRS}, {NEIGHBOURS}, {KEPT}, {s}, " for s in (SEARCHED, EVERY_ISSUE))
_TITLE = similar_sql('SELECT pr, key, coalesce("jiraTitle", title) AS text FROM kept', 15) + ", title AS (SELECT query_id, path, sum(score) AS raw FROM alike JOIN pr_modules USING (pr) GROUP BY ALL)"


def _rank_sql(nodes: str, edges: str) -> str:
    """CTE ranks(id, rank); edges as a text column pair over nodes."""
    return f"""nodes AS (SELECT DISTINCT id FROM ({nodes})), edges AS (SELECT DISTINCT src, dst FROM ({edges}) WHERE src <> dst),
    deg AS (SELECT id, count(src) AS deg FROM nodes LEFT JOIN edges ON src = id GROUP BY id),
    walk(it, id, deg, r) AS (SELECT 0, id, deg, 1.0::DOUBLE / (SELECT count(*) FROM nodes) FROM deg
      UNION ALL SELECT p.it + 1, t.id, t.deg, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * sum(CASE WHEN p.deg = 0 THEN p.r / (SELECT count(*) FROM nodes) WHEN e.src IS NOT NULL THEN p.r / p.deg ELSE 0 END)
      FROM walk p CROSS JOIN deg t LEFT JOIN edges e ON e.src = p.id AND e.dst = t.id WHERE p.it < 20 GROUP BY p.it, t.id, t.deg),
    ranks AS (SELECT id, r AS rank FROM walk WHERE it = 20)"""


_RANKS = _rank_sql("SELECT path AS id FROM modules", "SELECT a AS src, b AS dst FROM neighbours")
_EXPAND = """seed AS (SELECT * FROM (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(raw), 9) DESC, path) AS place
  FROM (SELECT query_id, path, raw FROM title UNION ALL SELECT query_id, path, score FROM fts) GROUP BY query_id, path) WHERE place <= 15),
own AS (SELECT DISTINCT query_id, pr, path FROM searched JOIN changes ON key = q_key JOIN pr_modules USING (pr)),
rem AS (SELECT query_id, path AS a, count(*) AS e_a FROM own GROUP BY ALL),
remp AS (SELECT x.query_id, x.path AS a, y.path AS b, count(*) AS e_ab FROM own x JOIN own y ON x.query_id = y.query_id AND x.pr = y.pr AND x.path <> y.path GROUP BY ALL),
close AS (SELECT s.query_id, c.a, c.b, (n_ab - coalesce(e_ab, 0)) / nullif(n_a - coalesce(e_a, 0), 0) AS c FROM seed s JOIN cochange c ON c.a = s.path
  LEFT JOIN remp p ON p.query_id = s.query_id AND p.a = c.a AND p.b = c.b LEFT JOIN rem r ON r.query_id = s.query_id AND r.a = c.a),
expanded AS (SELECT query_id, b AS path, sum(c) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY query_id, a ORDER BY round(c, 9) DESC, b) AS place FROM close WHERE c > 0) WHERE place <= 8 GROUP BY ALL)"""
_FUSED = """long AS (SELECT query_id, path, 'title_sim' AS s, raw FROM title UNION ALL SELECT query_id, path, 'fts', score FROM fts UNION ALL SELECT query_id, path, 'cochange', raw FROM expanded),
every AS (SELECT * FROM long UNION ALL SELECT query_id, path, 'centrality', coalesce(rank, 0) FROM (SELECT DISTINCT query_id, path FROM long) d LEFT JOIN ranks ON id = path),
mm AS (SELECT *, min(raw) OVER w AS lo, max(raw) OVER w AS hi FROM every WINDOW w AS (PARTITION BY query_id, s)),
nn AS (SELECT query_id, path, s, CASE WHEN hi = lo THEN CASE WHEN hi = 0 THEN 0.0 ELSE 1.0 END ELSE (raw - lo) / (hi - lo) END AS v FROM mm),
sig AS (SELECT query_id, path, coalesce(max(v) FILTER (s = 'title_sim'), 0) AS title_sim, coalesce(max(v) FILTER (s = 'fts'), 0) AS fts, coalesce(max(v) FILTER (s = 'cochange'), 0) AS cochange, coalesce(max(v) FILTER (s = 'centrality'), 0) AS centrality FROM nn GROUP BY ALL),
scored AS (SELECT *, 0.5 * title_sim + 0.2 * fts + 0.2 * cochange + 0.1 * centrality AS score FROM sig),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS place FROM scored) WHERE place <= 20)"""
_ALL, _WHOLE = (f"{b}{_TITLE}, {_BM25}, {_EXPAND}, {_RANKS}, {_FUSED}" for b in (_BASE, _EVERY))
_EVAL = """gold AS (SELECT DISTINCT query_id, path FROM own), ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
hits AS (SELECT query_id, place, row_number() OVER (PARTITION BY query_id ORDER BY place) AS nth FROM fused JOIN gold USING (query_id, path)),
got AS (SELECT query_id, count(*) FILTER (place <= 5) AS h5, count(*) FILTER (place <= 10) AS h10, count(*) FILTER (place <= 20) AS h20, coalesce(sum(nth / place) FILTER (place <= 10), 0) AS ap FROM hits GROUP BY 1),
ev AS (SELECT query_id, coalesce(n_gold, 0) AS n_gold, coalesce(h5, 0) AS h5, coalesce(h10, 0) AS h10, coalesce(h20, 0) AS h20, coalesce(ap, 0) AS ap FROM searched LEFT JOIN ng USING (query_id) LEFT JOIN got USING (query_id))"""


def _eval_columns() -> str:
    one = lambda c, name: f"round(CASE WHEN n_gold = 0 THEN 1.0 ELSE {c} END::DOUBLE, 6) AS {name}"
    return ", ".join([*(one(f"h{k} / n_gold", f"recall_{k}") for k in (5, 10, 20)), *(one(f"(h{k} > 0)::INT", f"hit_{k}") for k in (5, 10, 20)), one("ap / least(n_gold, 10)", "ap_10")])


_GRID = ", ".join(f"('{n}', {', '.join(map(str, w))})" for n, w in S.GRID.items())


def _mean_columns() -> str:
    one = lambda c, name: f"round(avg(CASE WHEN n_gold = 0 THEN 1.0 ELSE {c} END::DOUBLE), 6) AS {name}"
    return ", ".join([*(one(f"h{k} / n_gold", f"recall_{k}") for k in (5, 10, 20)), *(one(f"(h{k} > 0)::INT", f"hit_{k}") for k in (5, 10, 20)), one("ap / least(n_gold, 10)", "ap_10")])


SQL = {
    "bm25_topk": f"{_BASE}{_BM25} SELECT query_id, path, round(score, 6) AS score, place FROM fts",
    "title_signal": f"{_BASE}{_TITLE} SELECT query_id, path, round(raw, 6) AS raw FROM title",
    "seed_expansion": f"{_BASE}{_TITLE}, {_BM25}, {_EXPAND} SELECT query_id, path, round(raw, 6) AS raw FROM expanded",
    "fused_retrieval_topk": f"{_ALL} SELECT query_id, path, place, round(score, 6) AS score, round(title_sim, 6) AS title_sim, round(fts, 6) AS fts, round(cochange, 6) AS cochange, round(centrality, 6) AS centrality FROM fused",
    "dominant_signal": f"""{_WHOLE}, d AS (SELECT *, round(greatest(0.5 * title_sim, 0.2 * fts, 0.2 * cochange, 0.1 * centrality), 9) AS best FROM fused)
    SELECT query_id, path, place, CASE best WHEN round(0.5 * title_sim, 9) THEN 'title_sim' WHEN round(0.2 * fts, 9) THEN 'fts' WHEN round(0.2 * cochange, 9) THEN 'cochange' ELSE 'centrality' END AS signal FROM d""",
    "evidence": f"{_WHOLE}, b AS (SELECT query_id, path, arg_min(pr, place) AS pr FROM alike JOIN pr_modules USING (pr) GROUP BY ALL) SELECT query_id, path, place, pr AS evidence_pr FROM fused LEFT JOIN b USING (query_id, path)",
    "eval_recall_hit_ap": f"{_WHOLE}, {_EVAL} SELECT query_id, n_gold, {_eval_columns()} FROM ev",
    "pagerank_modules": f"{_BASE}{_RANKS} SELECT id, round(rank, 6) AS rank FROM ranks",
    "related_nodes_topk": f"""{_BASE}{_RANKS}, gold AS (SELECT DISTINCT query_id, path AS id FROM searched JOIN changes ON key = q_key JOIN pr_modules USING (pr)),
    l AS (SELECT query_id, dst AS id FROM gold JOIN edges ON src = gold.id UNION ALL SELECT query_id, src FROM gold JOIN edges ON dst = gold.id),
    c AS (SELECT query_id, id, count(*) AS links FROM l WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.query_id = l.query_id AND g.id = l.id) GROUP BY ALL)
    SELECT query_id, id, links, round(rank, 6) AS rank, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY links DESC, round(rank, 9) DESC, id) AS place FROM c JOIN ranks USING (id)) WHERE place <= 6""",
    "pagerank_customers": f"""WITH RECURSIVE {_rank_sql("SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier", "SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey")} SELECT id, round(rank, 6) AS rank FROM ranks""",
    "eval_grid_best": f"""{_ALL}, gold AS (SELECT DISTINCT query_id, path FROM own), ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1), grid(config, w0, w1, w2, w3) AS (VALUES {_GRID}),
    rk AS (SELECT * FROM (SELECT config, query_id, path, row_number() OVER (PARTITION BY config, query_id ORDER BY round(w0 * title_sim + w1 * fts + w2 * cochange + w3 * centrality, 9) DESC, path) AS place FROM sig CROSS JOIN grid) WHERE place <= 20),
    hits AS (SELECT config, query_id, place, row_number() OVER (PARTITION BY config, query_id ORDER BY place) AS nth FROM rk JOIN gold USING (query_id, path)),
    got AS (SELECT config, query_id, count(*) FILTER (place <= 5) AS h5, count(*) FILTER (place <= 10) AS h10, count(*) AS h20, coalesce(sum(nth / place) FILTER (place <= 10), 0) AS ap FROM hits GROUP BY ALL),
    ev AS (SELECT config, query_id, coalesce(n_gold, 0) AS n_gold, coalesce(h5, 0) AS h5, coalesce(h10, 0) AS h10, coalesce(h20, 0) AS h20, coalesce(ap, 0) AS ap FROM searched CROSS JOIN (SELECT config FROM grid) LEFT JOIN ng USING (query_id) LEFT JOIN got USING (config, query_id)),
    mean AS (SELECT config, count(*) AS n_cases, {_mean_columns()} FROM ev GROUP BY config)
    SELECT *, config = (SELECT arg_max(config, struct_pack(r := recall_10, c := config)) FROM mean) AS is_best FROM mean""",
    "precision_recall_f1": f"""{_ALL}, gold AS (SELECT DISTINCT query_id, path FROM own), top10 AS (SELECT query_id, path FROM fused WHERE place <= 10),
    p AS (SELECT query_id, avg((EXISTS (SELECT 1 FROM gold g WHERE g.query_id = t.query_id AND (g.path = t.path OR starts_with(g.path, t.path || '/') OR starts_with(t.path, g.path || '/'))))::INT) AS p FROM top10 t GROUP BY 1),
    r AS (SELECT query_id, avg((EXISTS (SELECT 1 FROM top10 t WHERE g.query_id = t.query_id AND (g.path = t.path OR starts_with(g.path, t.path || '/') OR starts_with(t.path, g.path || '/'))))::INT) AS r FROM gold g GROUP BY 1),
    b AS (SELECT query_id, coalesce(p, CASE WHEN r IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS p, coalesce(r, 1.0)::DOUBLE AS r FROM searched LEFT JOIN p USING (query_id) LEFT JOIN r USING (query_id))
    SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM b""",
}
