"""Operators of reviews and of source files, on fixtures."""

from pyspark.sql import functions as F

from sextant.functions import json_text as J
from sextant.functions import shapes as X
from sextant.operators import budget as B
from sextant.operators import changes as C
from sextant.operators import graph as G
from sextant.operators import search as S
from sextant.streaming import events as E

PHP = """<?php
namespace App\\Sales;
final class Order {
    public function total(int $a): ?int {
        if ($a) { return 1; }
        return 2;
    }
    private function hidden() { return 3; }
    public static function make() { return new self(); }
    public function open() { if (true) {
}
"""


def test_cap_each(spark):
    df = spark.createDataFrame([([50, None, 30, 90, 5],), ([],), (None,)], "s array<int>")
    assert [r[0] for r in df.select(B.cap_each(F.col("s"), 40, 100)).collect()] == [[40, 0, 30, 30, 0], [], None]


def test_limit_comes_before_the_filter(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "pr int, key string")
    assert [r.pr for r in C.newest_then(df, [F.desc("pr")], 2, F.col("key").isNotNull()).collect()] == [3]
    full = C.with_defaults(df, {"key": "?", "base": "main"})
    assert [tuple(r) for r in full.orderBy("pr").collect()][1:3] == [(2, "?", "main"), (3, "c", "main")]


def test_diff_text(spark):
    t = "array<struct<f string, status string, add bigint, del bigint, patch string>>"
    df = spark.createDataFrame([("T", [("a", "added", 1, None, "+x"), ("b", None, 0, 2, "")]), (None, [])], f"t string, files {t}")
    got = [r[0] for r in df.select(X.diff_text(F.col("t"), F.col("files"))).collect()]
    assert got == ["T\n\n### a (added, +1/-0)\n+x\n\n### b (+0/-2)\n(no patch)\n\n", "\n\n"]


def test_fold_messages(spark):
    rows = [([("user", "a"), ("system", "s1"), (None, "b"), ("system", "s2")],), ([],), (None,)]
    got = [r.m for r in spark.createDataFrame(rows, "m array<struct<role string, content string>>").select(X.fold_messages(F.col("m")).alias("m")).collect()]
    assert (got[0].first_system, got[0].last_system, got[0].said) == ("s1", "s2", "a\n\nb") and [m.content for m in got[0].others] == ["a", "b"]
    assert all((g.first_system, g.last_system, g.said) == ("", "", "") for g in got[1:])


def test_fan_out_of_a_stream(spark, tmp_path):
    rows = [(1, ["x", "y", "x"]), (2, []), (3, None), (4, ["z", None])]
    df = spark.createDataFrame(rows, "event int, prs array<string>")
    want = [(1, "x"), (1, "y"), (4, "z")]
    assert sorted((r.event, r.pr) for r in E.fan_out(df, F.col("prs"), "pr").collect()) == want
    df.write.parquet(str(tmp_path / "in"))
    stream = E.fan_out(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), F.col("prs"), "pr", F.col("event") < 4)
    got = E.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r.event, r.pr) for r in got.collect()) == want[:2]


def test_answers(spark):
    df = spark.createDataFrame([('["a", " ", "", null, "b "]',), ("{}",), ("x",), (None,)], "j string")
    assert [r[0] for r in df.select(J.non_blank_strings(F.col("j"))).collect()] == [["a", "b "], [], [], []]
    answers = spark.createDataFrame([(1, '[{"path": "p", "score": 99}, {"path": "p", "score": 1}, {"path": "q", "score": "x"}, {"path": "no", "score": 5}]'), (2, "broken"), (3, None)], "g int, answer string")
    allowed = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p"), (1, "p")], "g int, path string")
    assert sorted(map(tuple, S.allowed_answers(answers, allowed, "g").collect())) == [(1, "p", 10.0), (1, "q", 0.0)]


def test_public_members(spark):
    df = spark.createDataFrame([(PHP,), ("",), (None,)], "c string")
    whole = [r[0] for r in df.select(G.public_members(F.col("c"))).collect()]
    assert whole[1:] == ["", ""] and whole[0].count("public") == 2 and "hidden" not in whole[0] and "open" not in whole[0]
    assert whole[0].startswith("public function total") and whole[0].endswith("return new self(); }")
    cut = df.select(G.public_members(F.col("c"), 20)).first()[0]
    assert cut == PHP[PHP.index("public") :][:20] + "\n/* ... */"


def test_module_blocks(spark):
    owners = spark.createDataFrame([("m/a.php", "m"), ("m/b.php", "m"), ("m/c.txt", "m"), ("k/x.php", "k")], "f string, path string")
    contents = spark.createDataFrame([("m/a.php", "<?php\nclass A {\n}\n"), ("m/b.php", PHP), ("m/c.txt", PHP), ("k/x.php", None)], "f string, content string")
    classes = G.module_classes(owners, contents)
    assert sorted((r.path, r.name) for r in classes.collect()) == [("m", "A"), ("m", "Order")]
    blocks = {r.path: r.block for r in G.module_blocks(classes, owners).collect()}
    assert blocks["k"] == "MODULE_PATH: k\nFILES: 1"
    assert blocks["m"] == "MODULE_PATH: m\nFILES: 3\n  CLASSE: App\\Sales\\Order (total, make, open)\n  CLASSE: A (sem métodos públicos)"
