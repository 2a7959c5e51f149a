"""What keeps the rankings within their limits, each beside the plain way of the same result."""

import random

from pyspark.sql import functions as F

from sextant.functions.text import strip_diacritics
from sextant.operators import changes as C
from sextant.operators import graph as G
from sextant.operators import search as S
from sextant.plans.ranking import _touched

FILES = "array<struct<f string, add bigint, del bigint>>"


def test_latest_leaves_single_arrivals_where_they_are(spark, monkeypatch):
    rows = [(pr, f"K-{pr}" if i else None, f"2025-01-0{1 + i}", [(f"f{pr}", 1, i)]) for pr in range(20) for i in range(1 + (pr % 5 == 0))] + [(None, "K", None, None), (50, None, None, None)]
    df = spark.createDataFrame(rows, f"pr bigint, key string, mergedAt string, files {FILES}").withColumn("mergedAt", F.to_timestamp("mergedAt"))
    got = C.latest(df)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()  # nothing but the once merged keys is aggregated
    plain = sorted(map(str, got.collect()))
    monkeypatch.setattr(C, "TWICE", 0)
    assert plain == sorted(map(str, C.latest(df).collect())) and len(plain) == 21


def test_module_sets_in_the_row_and_by_joins(spark, monkeypatch):
    names = ["a/b/c.x", "a/bc/d", "a/b", "z", None, "a//b/x", "/r/s", "a/", "it's/x", "b\\s/x", "", "a/b/c/d/e"]
    rows = [(1, [(n, 1, 1) for n in names]), (2, [("z", 1, 1)]), (3, None), (4, []), (None, [("a/b", 1, 1)]), (5, [("a/b/1", 1, 1), ("a/b/2", 1, 1)])]
    changes = spark.createDataFrame(rows, f"pr bigint, files {FILES}")
    modules = spark.createDataFrame([(p,) for p in ("a", "a/b", "a/", "/r", "it's", "b\\s", None, "a/b/c/d")], "path string")
    plain = sorted(map(tuple, C.change_modules(changes, modules).collect()))
    got = lambda: sorted(map(tuple, C.module_sets(changes, modules).select("pr", F.explode("m")).collect()))
    assert got() == plain and (5, "a/b") in plain and (1, "a/b/c/d") in plain and (1, "it's") in plain
    assert "Exchange" not in C.module_sets(changes, modules)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "LITERAL_PATHS", 0)
    assert got() == plain
    assert C.module_sets(changes, modules.limit(0)).select(F.explode("m")).count() == 0


def test_touched_modules_of_few_changes(spark):
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["c"])], "pr bigint, m array<string>")
    near = spark.createDataFrame([(9, 1, 0.5), (8, 1, 0.25), (9, 2, 0.5), (9, 3, 0.5)], "query_id bigint, pr bigint, score double")
    assert sorted(map(tuple, _touched(sets, near).select("query_id", "pr", "score", "path").collect())) == [(8, 1, 0.25, "a"), (8, 1, 0.25, "b"), (9, 1, 0.5, "a"), (9, 1, 0.5, "b")]


def test_similar_in_the_row_by_joins_and_of_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    words = ["fila", "nota", "caixa", "tela", "saldo", "conta"]
    key = lambda i: rng.choice([None, "k1", "k2", f"k{i}"])
    entries = [(i, key(i), " ".join([*rng.sample(words, 1 + i % 4), *(f"nome{i}x{j}" for j in range(rng.randrange(4)))])) for i in range(500)] + [(900, None, None), (901, "k1", "")]
    q = [(1, "k1", "fila nota nome7x0"), (2, None, "saldo tela caixa"), (3, "k2", "fila"), (4, "k1", "nenhuma"), (5, None, None)]
    queries, of = spark.createDataFrame(q, "query_id bigint, q_key string, text string"), spark.createDataFrame(entries, "pr bigint, key string, text string")
    want = []
    for qid, own, text in q:
        a = set((text or "").split())
        scored = ((-round(len(a & set(t.split())) / len(a | set(t.split())), 9), pr) for pr, k, t in entries if t and a & set(t.split()) and (k is None or k != own))
        want += [(qid, place, pr, -s) for place, (s, pr) in enumerate(sorted(scored)[:5], 1)]
    got = lambda: sorted((r.query_id, r.place, r.pr, round(r.score, 9)) for r in S.similar(queries, of, 5, ("key", "q_key")).collect())
    assert got() == want
    monkeypatch.setattr(S, "LITERAL_WORDS", 0)
    assert got() == want
    monkeypatch.setattr(S, "LONG", 1)
    assert got() == want


def test_grouped_moves_no_words(spark):
    sets = spark.createDataFrame([(1, None, ["fila", "nota", "x"]), (2, "k", ["y"]), (3, None, []), (4, None, None)], "pr bigint, _key string, _s array<string>")
    got = S.grouped(sets, spark.createDataFrame([("fila",), ("nota",), ("it's",)], "_t string"), 2)
    assert [tuple(r) for r in got.select("pr", "_g").collect()] == [(1, "3 fila nota")]
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()


def test_manifests_end_with_the_path_as_in_sql(spark):
    rows = [("sub/Composer.JSON", True), ("composer.json\n", False), ("xcomposer.json", False), ("yarn.lock/x", False), ("yarn.lock", True), (None, False)]
    df = spark.createDataFrame([(i, [(f, 1, 1)]) for i, (f, _) in enumerate(rows)], f"i int, files {FILES}")
    none = F.lit(None).cast("string")
    got = df.select("i", C.is_bump(none, none, none, F.lit("K"), F.col("files")).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == [b for _, b in rows]


def test_accents_of_mixed_texts(spark):
    rows = [("plain", "plain"), ("São João", "Sao Joao"), ("São", "Sao"), ("É é ß 漢", "E e ß 漢"), ("", ""), (None, None)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(strip_diacritics(F.col("t"))).collect()] == [b for _, b in rows]


def test_accents_are_looked_up_once(spark):
    plan = spark.createDataFrame([("São",)], "t string").select(strip_diacritics(F.col("t")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1


def test_small_graphs_are_walked_without_a_job_a_step(spark, monkeypatch):
    nodes = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "e", "e", None)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "a"), ("c", "c"), ("d", "a"), ("d", "x"), (None, "a")], "src string, dst string")
    written, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda *a: written.append(a) or cut(*a))
    got = lambda: {r.id: round(r["rank"], 12) for r in G.page_rank(nodes, edges).collect()}
    small = got()
    assert len(written) <= 2 and len(small) == 5 and G.page_rank(nodes, edges.limit(0)).count() == 5 and G.page_rank(nodes.limit(0), edges).count() == 0
    assert G.page_rank(nodes, edges).dtypes == [("id", "string"), ("rank", "double")]
    monkeypatch.setattr(G, "SMALL_GRAPH", 0)
    assert got() == small
