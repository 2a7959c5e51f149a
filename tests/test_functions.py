import json
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.functions import json_text as J
from sextant.functions import shapes as X
from sextant.functions import text as T
from sextant.functions.ranking import rank_within
from sextant.runtime import cut, skew_join


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


def test_table_of_accents_matches_unicode():
    for a, b in zip(T.ACCENTED, T.PLAIN):
        assert unicodedata.normalize("NFD", a)[0] == b
    assert len(T.ACCENTED) == len(T.PLAIN) > 100


def test_tokens(spark):
    assert one(spark, "Correção DA fila: não-carregá 12 abc123 de", T.tokens) == ["correcao", "fila", "carrega", "abc123"]
    assert one(spark, None, T.tokens) == [] and one(spark, "", T.tokens) == []
    assert one(spark, "élément", T.tokens) == ["element"]


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), ([], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    assert [r.j for r in df.select(T.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [0.5, 0.0, 0.0]


def test_deletions_join_one_edit_apart(spark):
    a, b = set(one(spark, "vagutava", T.deletions)), set(one(spark, "vgautava", T.deletions))
    assert a & b and "vagutava" in a and one(spark, "", T.deletions) == [""]


def test_slug_and_hash(spark):
    assert one(spark, "  Ação: é #1!  ", T.slug) == "acao-e-1"
    assert one(spark, "??", T.slug) == "item" and one(spark, None, T.slug) == "item"
    assert one(spark, "abc", T.short_hash) == "ba7816bf"


def test_duration(spark):
    for n, want in ((0, "0s"), (59, "59s"), (60, "1min"), (90061, "1d 1h 1min"), (-5, "0s"), (None, None), (7200, "2h")):
        assert one(spark, n, X.duration_label, "bigint") == want


def test_clamp_flag_estimate(spark):
    assert [one(spark, v, lambda c: X.clamp(c, 1, 10)) for v in ("5", "x", None, "99")] == [5.0, 1.0, 1.0, 10.0]
    assert [one(spark, v, X.flag) for v in ("TRUE", " yes ", "0", None)] == [True, True, False, False]
    assert [one(spark, v, X.estimated_tokens) for v in (None, "", "abcde")] == [0, 0, 2]


def test_sections(spark):
    put = lambda c: X.upsert_section(c, F.lit("x"), "<s>", "<e>")
    first = one(spark, "head", put)
    assert first == "head\n\n<s>\nx\n<e>" and one(spark, first + " tail", put) == first + " tail"
    assert one(spark, None, put) == "<s>\nx\n<e>" and one(spark, "<s> open", put).endswith("<e>")
    assert one(spark, "a-b-c", lambda c: X.replace_first(c, "-", "+")) == "a+b-c"


def test_headers_and_rows(spark):
    m = spark.createDataFrame([({"X-Left": " ", "x-rest": "5"},)], "m map<string,string>")
    assert m.select(X.first_header(F.col("m"), "x-left", "X-Rest").alias("r")).first().r == "5"
    assert m.select(X.first_header(F.col("m"), "none").alias("r")).first().r is None
    assert one(spark, "a|b", lambda c: X.table_row(c, F.lit(1))) == "| a\\|b | 1 |"
    assert one(spark, None, lambda c: X.fixed_width([(c, 3), (F.lit(7), -3)])) == "      7"


def test_json_in_text(spark):
    cases = {'{"a": 1}': '{"a": 1}', 'x ```json\n{"a": 2}\n``` y': '{"a": 2}', 'well {"a": "}{", "b": {"c": 3}} end}': '{"a": "}{", "b": {"c": 3}}', "none": None, "": None, "{broken": None}
    for text, want in cases.items():
        assert one(spark, text, J.extract_json) == want
    assert one(spark, None, J.extract_json) is None
    assert one(spark, "a {b} c} d", J.greedy_json) == "{b} c}" and one(spark, "no", J.greedy_json) is None


def test_rich_text(spark):
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"type": "paragraph", "content": None}, {"type": "text", "text": "c"}]}
    assert one(spark, json.dumps(tree), J.flatten_rich_text) == "a\nb\n\nc"
    assert one(spark, json.dumps(tree), lambda c: J.flatten_rich_text(c, False)) == "abc"
    assert [one(spark, v, J.flatten_rich_text) for v in (None, '"s"', "[]", "{cut")] == ["", "s", "", ""]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 10**6)), max_size=60, unique=True), st.sampled_from([2, 1000]))
def test_rank_within(spark, rows, per_task):
    df = cut(spark.createDataFrame(rows, "k string, v bigint"))
    out = rank_within(df, ["k"], ["v"], "r", rows_per_task=per_task).collect()
    assert sorted((str(r.k), r.v) for r in out) == sorted((str(k), v) for k, v in rows)
    for k in {r.k for r in out}:
        ranks = sorted(r.r for r in out if r.k == k)
        assert ranks == list(range(len(ranks)))


def test_skew_join_equals_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i % 50}", i) for i in range(200)] + [(None, 1)], "k string, v int")
    dim = big.groupBy("k").count().withColumnRenamed("count", "w").withColumn("x", F.length("k"))
    want = sorted(map(tuple, big.join(dim.drop("w"), "k").collect()))
    for most in (0, 1000):
        got = skew_join(big, dim, "k", "w", 1100, share=0.3, most_rows=most)
        assert sorted(map(tuple, got.select("k", "v", "x").collect())) == want


def test_addresses_percent_and_ends(spark):
    df = spark.createDataFrame([("a/b#12", 0.125, "x/y.ts", "y.ts"), ("a/b", None, "xy.ts", "y.ts"), (None, 1.0, "y.ts", "a/y.ts")], "r string, s double, a string, b string")
    got = [tuple(r) for r in df.select(T.pull_url(F.col("r")), T.percent(F.col("s")), T.ends_alike(F.col("a"), F.col("b"))).collect()]
    assert got == [("https://github.com/a/b/pull/12", "12.5%", True), (None, None, False), (None, "100.0%", True)]
