import pytest

from sextant.llm.mixing import balance


def test_a_source_that_shrinks_keeps_its_long_documents(spark):
    sizes = [100] * 900 + [1000] * 100
    rows = [(i, "big", n) for i, n in enumerate(sizes)] + [(5000 + i, "scarce", 50) for i in range(40)] + [(9000, None, 10), (9001, "other", 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.8, 1), ("scarce", 0.15, 3), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    copies, shares = balance(docs, targets)
    c, s = copies.where("source = 'big'").collect(), {r.source: r for r in shares.collect()}
    assert len(c) == len(sizes) and all(r.copies <= 1 for r in c)
    used = [r.n_tokens for r in c for _ in range(r.copies)]
    # long documents hold 10 % of the documents and more than half of the text, in the mix as before
    assert abs(used.count(1000) / len(used) - 0.1) < 0.02
    assert abs(sum(used) / len(used) - sum(sizes) / len(sizes)) < 20
    assert all(abs(r.reached_share - r.wanted_share) < 0.003 for r in s.values())
    assert s["scarce"].most_copies == 3 and s["other"].tokens_reached == 0 and s["absent"].wanted_share == 0


@pytest.mark.parametrize("total", [3000.0, 1e6])
def test_given_size_and_caps(spark, total):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 10 + i) for i in range(100)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    _, shares = balance(docs, targets, total)
    for r in shares.collect():
        assert r.most_copies <= r.max_repeats
        assert abs(r.tokens_reached - min(r.wanted_share * total, r.max_repeats * r.n_tokens)) <= 10
