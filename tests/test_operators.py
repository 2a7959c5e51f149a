import itertools
import json
import random

import numpy as np
from pyspark.sql import functions as F

from sextant.operators import budget as B
from sextant.operators import changes as C
from sextant.operators import graph as G
from sextant.operators import merging as M
from sextant.operators import search as S
from sextant.operators import shred
from sextant.operators.paths import longest_prefix, overlapping

FILES = "array<struct<f string, add bigint, del bigint>>"


def files(*names):
    return [(n, 1, 2) for n in names]


def test_longest_prefix(spark):
    f = spark.createDataFrame([("a/b/c.x",), ("a/bc/d",), ("a/b",), ("z",), (None,), ("a/b/c.x",)], "f string")
    m = spark.createDataFrame([("a",), ("a/b",), (None,)], "path string")
    assert sorted(map(tuple, longest_prefix(f, m).collect())) == [("a/b", "a/b"), ("a/b/c.x", "a/b"), ("a/bc/d", "a")]
    assert longest_prefix(f.limit(0), m).count() == 0


def test_overlapping_is_symmetric_and_by_group(spark):
    a = spark.createDataFrame([(1, "x/y"), (1, "x/yz"), (2, "q"), (None, "n")], "g int, path string")
    b = spark.createDataFrame([(1, "x/y/z"), (1, "x"), (2, "x/y"), (None, "n")], "g int, path string")
    assert sorted(r.path for r in overlapping(a, b, "path", "path", ["g"]).collect()) == ["n", "x/y", "x/yz"]


def test_latest_prefers_the_fuller_arrival(spark):
    rows = [(1, None, None, files("a")), (1, "K-1", None, files("a")), (2, None, None, None), (None, "K", None, None)]
    df = spark.createDataFrame(rows, f"pr bigint, key string, mergedAt timestamp, files {FILES}")
    assert sorted((r.pr, r.key) for r in C.latest(df).collect()) == [(1, "K-1"), (2, None)]


def test_bump(spark):
    rows = [
        ("Bump the version of x", None, "b", "K", files("a"), True),
        ("ATUALIZA a VERSÃO", None, "b", "K", files("a"), True),
        ("preatualiza versão", None, "b", "K", files("a"), False),
        ("x", None, "bot/bump-1", "K", files("a"), True),
        ("x", None, "b", "K", files("composer.json", "composer.lock", "yarn.lock", "package.json", "a"), True),
        ("x", None, "b", "K", files("composer.json", "composer.lock", "a"), False),
        ("x", None, "b", None, files("sub/package-lock.json"), True),
        ("x", None, "b", None, [], False),
        (None, None, None, None, None, False),
    ]
    df = spark.createDataFrame([(*r[:5], i) for i, r in enumerate(rows)], f"title string, jiraTitle string, branch string, key string, files {FILES}, i int")
    got = df.select("i", C.is_bump(*(F.col(c) for c in ("title", "jiraTitle", "branch", "key", "files"))).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == [r[5] for r in rows]


def test_size_class_bounds(spark):
    df = spark.createDataFrame([(n,) for n in (149, 150, 600, 601)], "n int")
    assert [r[0] for r in df.select(C.size_class(F.col("n"))).collect()] == ["P", "M", "M", "G"]


def test_cochange_against_brute_force(spark):
    rng = random.Random(3)
    rows = sorted({(pr, f"m{rng.randrange(6)}") for pr in range(40) for _ in range(3)})
    got = {(r.a, r.b): (r.n_ab, r.n_a) for r in C.cochange(spark.createDataFrame(rows, "pr bigint, path string")).collect()}
    sets = {pr: {p for q, p in rows if q == pr} for pr, _ in rows}
    for a, b in itertools.permutations([f"m{i}" for i in range(6)], 2):
        n = sum(a in s and b in s for s in sets.values())
        assert got.get((a, b), (0, 0))[0] == n


def test_similar_against_brute_force(spark):
    words = ["fila", "nota", "caixa", "tela", "saldo"]
    rng = random.Random(1)
    entries = [(i, " ".join(rng.sample(words, 2 + i % 3))) for i in range(30)] + [(99, None), (98, "")]
    q = [(1, "fila nota"), (2, "saldo tela caixa"), (3, None), (4, "")]
    got = S.similar(spark.createDataFrame(q, "query_id bigint, text string"), spark.createDataFrame(entries, "pr bigint, text string"), 5).collect()
    for qid, text in q[:2]:
        a = set(text.split())
        want = sorted(((-len(a & set(t.split())) / len(a | set(t.split())), pr) for pr, t in entries if t and a & set(t.split())))[:5]
        assert [(r.pr, round(r.score, 9)) for r in sorted((r for r in got if r.query_id == qid), key=lambda r: r.place)] == [(pr, round(-s, 9)) for s, pr in want]
    assert {r.query_id for r in got} == {1, 2}


def test_similar_meets_groups_and_leaves_out_own_entries(spark):
    rng = random.Random(2)
    words = ["fila", "nota", "caixa", "tela", "saldo"]
    key = lambda i: rng.choice([None, "k1", "k2", f"k{i}"]) if i % 3 else "k1"
    entries = [(i, key(i), " ".join([*rng.sample(words, 1 + i % 4), f"nome{i}"])) for i in range(400)]
    q = [(1, "k1", "fila nota nome7"), (2, None, "saldo tela caixa"), (3, "k2", "fila"), (4, "k1", "nenhuma")]
    queries, of = spark.createDataFrame(q, "query_id bigint, q_key string, text string"), spark.createDataFrame(entries, "pr bigint, key string, text string")
    got = S.similar(queries, of, 5, ("key", "q_key")).collect()
    for qid, own, text in q:
        a = set(text.split())
        want = sorted((-round(len(a & set(t.split())) / len(a | set(t.split())), 9), pr) for pr, k, t in entries if a & set(t.split()) and (k is None or k != own))[:5]
        assert [(-round(r.score, 9), r.pr) for r in sorted((r for r in got if r.query_id == qid), key=lambda r: r.place)] == want
    # names that nobody asks for make no groups of their own, and a group is cut to what can be in a result
    sets = of.selectExpr("pr", "key as _key", "split(text, ' ') as _s")
    kept = S.grouped(sets, spark.createDataFrame([("fila",), ("nota",)], "_t string"), 2).groupBy("_g").count().collect()
    assert len(kept) == 11 and all(r["count"] <= 4 for r in kept)


def test_representatives_carry_only_what_is_kept(spark):
    rows = [("k", 1, "a", None, "2025-01-01", [("x", 1, 2)]), ("k", 2, "b", "B", "2025-01-02", [("x", 10, 0), ("y", 0, 5)]), (None, 3, "c", None, "2025-01-03", [])]
    c = spark.createDataFrame(rows, "key string, pr bigint, title string, jiraTitle string, mergedAt string, files array<struct<f:string,add:bigint,del:bigint>>").withColumn("mergedAt", F.to_timestamp("mergedAt"))
    got = C.representatives(C.latest(c.union(c)), ("pr", "title", "jiraTitle"))
    assert got.columns == ["key", "pr", "title", "jiraTitle", "lines", "n_changes"]
    assert [tuple(r) for r in got.collect()] == [("k", 2, "b", "B", 18, 2)]


def test_evaluation_identities(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "query_id bigint, path string, place int")
    gold = spark.createDataFrame([(1, "b"), (1, "c"), (4, "z")], "query_id bigint, path string")
    cases = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "query_id bigint")
    got = {r.query_id: r for r in S.evaluate(ranked, gold, cases, ["query_id"]).collect()}
    assert (got[1].recall_5, got[1].hit_5, got[1].ap_10) == (0.5, 1.0, 0.25)
    assert got[2].recall_5 == got[3].ap_10 == 1.0 and got[4].recall_20 == got[4].hit_5 == got[4].ap_10 == 0.0


def test_min_max(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", 0.0)], "k string, raw double")
    got = sorted((r.k, r.norm) for r in S.min_max(df, ["k"]).collect())
    assert got == [("a", 0.0), ("a", 1.0), ("b", 1.0), ("c", 0.0)]


def test_page_rank_against_numpy(spark):
    rng = random.Random(2)
    n = 12
    edges = {(rng.randrange(n - 2), rng.randrange(n)) for _ in range(25)}
    nodes = spark.createDataFrame([(str(i),) for i in range(n)] + [(None,)], "id string")
    e = spark.createDataFrame([(str(a), str(b)) for a, b in edges] * 2 + [("0", "elsewhere")], "src string, dst string")
    got = {int(r.id): r.rank for r in G.page_rank(nodes, e).collect()}
    out = [[b for a, b in edges if a == i and a != b] for i in range(n)]
    r = np.full(n, 1 / n)
    for _ in range(20):
        new = np.full(n, 0.15 / n + 0.85 * sum(r[i] for i in range(n) if not out[i]) / n)
        for i in range(n):
            for b in out[i]:
                new[b] += 0.85 * r[i] / len(out[i])
        r = new
    assert all(abs(got[i] - r[i]) < 1e-12 for i in range(n))


def test_code_graph(spark):
    a = "<?php\nnamespace App\\A\\One;\nuse \\App\\B\\Two;\nuse App\\B\\{Three, Four as Vier};\nuse function strlen;\nuse Other\\Thing as T;\nnew \\App\\A\\One\\Self_();\n"
    b = "<?php\nclass Two { function f() { return App\\A\\One::class; } }"
    f = spark.createDataFrame([("app/A/One.php", a), ("app/B/Two.php", b), ("app/B/Three.php", "")], "path string, content string")
    p = spark.createDataFrame([("App\\", "app"), ("App\\B\\", "app/B/")], "prefix string, base_dir string")
    edges, counts = G.code_graph(f, p)
    assert sorted(map(tuple, edges.collect())) == [("app/A/One.php", "app/B/Three.php"), ("app/A/One.php", "app/B/Two.php"), ("app/B/Two.php", "app/A/One.php")]
    c = counts.first()
    assert c.total_refs >= 6 and c.unresolved >= 3
    got = f.where("path = 'app/A/One.php'").select(G.use_targets(F.col("content")).alias("u")).first().u
    assert got == ["\\App\\B\\Two", "App\\B\\Three", "App\\B\\Four", "Other\\Thing"]
    names = spark.createDataFrame([("App\\",), ("App",), ("None\\X",), ("App\\B\\C\\D",)], "fqcn string")
    assert [tuple(r) for r in G.resolve(names.where("fqcn <> 'App\\\\'"), p).collect()] == [("App\\B\\C\\D", "app/B/C/D.php")]


def test_budgets_against_brute_force(spark):
    rng = random.Random(5)
    rows = [[rng.choice([0, 5, 20, 60, 100, None]) for _ in range(rng.randrange(0, 7))] for _ in range(60)] + [None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s array<int>").select("i", B.cap_prefix(F.col("s"), 100).alias("cap"), B.greedy_skip(F.col("s"), 100).alias("skip"), B.cap_truncate(F.col("s"), 100, 3).alias("cut"))
    for r in df.collect():
        if rows[r.i] is None:
            assert r.cap is None
            continue
        used, cap, skip, cut_, u2, u3 = 0, [], [], [], 0, 0
        for n in (x or 0 for x in rows[r.i]):
            if used >= 100:
                cap.append(0)
            else:
                used += n
                cap.append(n if used <= 100 else 0)
            skip.append(n if u2 + n <= 100 else 0)
            u2 += skip[-1]
            if u3 + n <= 100:
                cut_.append(n)
                u3 += n
            else:
                cut_.append(max(100 - u3 - 3, 0))
                u3 = 100
        assert (r.cap, r.skip, r.cut) == (cap, skip, cut_)


def test_commentable_lines(spark):
    patches = ["@@ -1,2 +10,3 @@ x\n a\n-b\n+c\n+d\n@@ -9 +20 @@\n+e", "+a\n b\n-c\n\\ No newline", "", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(patches)], "i int, p string")
    assert [r.l for r in df.select(B.commentable_lines(F.col("p")).alias("l")).collect()] == [[10, 11, 12, 20], [0, 1, 2], [], []]


def test_merging(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (None, "n", None)], "k int, v string, w string")
    u = spark.createDataFrame([(2, None, "y"), (3, "c", None), (None, "m", None)], "k int, v string, w string")
    got = sorted(map(str, (tuple(r) for r in M.upsert(t, u, "k").collect())))
    assert got == sorted(map(str, [(1, "a", None, "kept"), (2, "b", "y", "updated"), (None, "n", None, "kept"), (3, "c", None, "inserted"), (None, "m", None, "inserted")]))
    now, old = spark.createDataFrame([("a",), ("b",), ("c",)], "p string").withColumn("s", F.lit("new text")), spark.createDataFrame([("a", "A"), ("b", "B")], "p string, s string")
    got = {r.p: (r.s, r.state) for r in M.carry_forward(now, old, spark.createDataFrame([("b",)], "p string"), "p", "s").collect()}
    assert got == {"a": ("A", "kept"), "b": (None, "dirty"), "c": (None, "new")}
    known = spark.createDataFrame([(1,)], "k int")
    assert sorted(str(r.k) for r in M.without_known(t, known, ["k"]).collect()) == ["2", "None"]


def walk(value, path, parent, root, out):
    if isinstance(value, dict):
        for k, v in value.items():
            walk(v, f"{path}.{k}", parent, root, out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            p = f"{path}[{i}]"
            if isinstance(v, dict):
                out.append((p, parent))
                walk(v, p, p, root, out)
            else:
                walk(v, p, parent, root, out)


def random_json(rng, depth):
    r = rng.random()
    if depth == 0 or r < 0.25:
        return rng.choice([None, 1, "s", True, "é", {}, []])
    if r < 0.6:
        return {rng.choice("abcd"): random_json(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]


def test_shredding_round_trip(spark):
    rng = random.Random(11)
    docs = [{"key": "K", "fields": {"description": random_json(rng, 5), "customfield_10020": random_json(rng, 3)}} for _ in range(150)]
    rows = [(i, "issue", json.dumps(d), 1) for i, d in enumerate(docs)]
    rows += [(900, "search", json.dumps({"issues": [docs[0], None, docs[1]]}), 1), (901, "issue", None, 1), (902, "issue", '{"key": 1', 1), (903, "search", "[]", 1), (904, "issue", '{"key": NaN}', 1), (905, "issue", '"\\ud800"', 1), (906, "issue", "", 1)]
    df = spark.createDataFrame(rows, "record_id bigint, shape string, payload string, steps int")
    sprint = ("customfield_10020",)
    levels = shred.shred(df, ["description", "customfield_10020"], sprint)
    want = []
    for i, no, d in [(i, 0, d) for i, d in enumerate(docs)] + [(900, 0, docs[0]), (900, 2, docs[1])]:
        out = []
        for root in ("description", "customfield_10020"):
            v = d["fields"][root]
            single = root == "customfield_10020" and isinstance(v, dict)
            if single:
                out.append((root, ""))
            walk(v, root, root if single else "", root, out)
        want += [(i, no, *o) for o in out]
    got = [(r.record_id, r.issue_no, r.node_path, r.parent_path) for r in shred.objects(levels, sprint).collect()]
    assert sorted(got) == sorted(want) and len(want) > 200
    leaves = shred.values(levels, sprint).collect()
    texts = [json.dumps(x) for d in docs for x in (d["fields"]["description"],)]
    assert sum(r.value == "é" and r.record_id < 900 and (r.node_path or r.name).startswith("d") for r in leaves if r.node_path.startswith("description") or r.name.startswith("description")) == sum(t.count("\\u00e9") for t in texts)
    assert shred.objects(shred.shred(df.limit(0), ["description"])).count() == 0


def test_php_names_and_members(spark):
    a = "<?php\nuse App\\Models\\User;\nuse App\\Models\\{Team, Role as R};\nuse A\\B, C\\D as E;\nuse A\\{function f, G};\nuse const A\\X;\nfinal class Foo extends Bar\n{\n    use Helper;\n    public function __construct() {}\n    public static function make(int $a): self { return function () use ($a) {}; }\n    public function run()\n    {\n        return new \\App\\Models\\Team();\n    }\n    private function hidden() {}\n}\n"
    df = spark.createDataFrame([(a,), ("",), (None,), ("class X { function f() { return new \\App\\Models\\Team(); } }",)], "c string")
    rows = df.select(G.use_targets(F.col("c")).alias("u"), G.body_references(F.col("c")).alias("b"), G.php_members(F.col("c")).alias("m")).collect()
    assert rows[0].u == ["App\\Models\\User", "App\\Models\\Team", "App\\Models\\Role", "A\\B", "C\\D", "A\\G"]
    assert rows[0].m.name == "Foo" and rows[0].m.namespace is None and rows[0].m.methods == ["make", "run"]
    assert rows[1].u == [] and rows[1].b == [] and rows[1].m is None and rows[2].m is None
    assert rows[3].b == ["App\\Models\\Team"] and rows[3].m.name == "X"
    named = spark.createDataFrame([("<?php\nnamespace App\\Http;\nabstract class A {}\n",)], "c string").select(G.php_members(F.col("c")).alias("m")).first().m
    assert (named.namespace, named.name, named.methods) == ("App\\Http", "A", [])


def test_module_centrality(spark):
    ranks = spark.createDataFrame([("a/x.php", 0.5), ("a/b/y.php", 0.25), ("a/b/z.php", 0.125), ("q.php", 0.125)], "id string, rank double")
    modules = spark.createDataFrame([("a",), ("a/b",)], "path string")
    assert {r.path: r["rank"] for r in G.module_centrality(ranks, modules).collect()} == {"a": 0.5, "a/b": 0.375}
    assert G.module_centrality(ranks.limit(0), modules).count() == 0


def test_shred_deep_nesting(spark):
    """What the parser reads is shredded, however deep; what it refuses has no rows."""
    deep = lambda n: '{"key": "K", "fields": {"description": ' + '{"content": [' * n + "{}" + "]}" * n + "}}"
    df = spark.createDataFrame([(1, "issue", deep(1500)), (2, "issue", deep(3)), (3, "issue", deep(300000))], "record_id bigint, shape string, payload string")
    got = {r.record_id: r["count"] for r in shred.objects(shred.shred(df, ["description"])).groupBy("record_id").count().collect()}
    assert got == {1: 1500, 2: 3}
