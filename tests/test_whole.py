"""Queries that take their whole table."""

import random

import pytest

from sextant.operators import search as S
from sextant.plans import registry
from sextant.runtime import table
from tools.compare import views


@pytest.fixture(scope="module")
def con(small):
    return views(small)


def _ids(spark, small):
    return {r[0] for r in table(spark, small, "jira_issues").select("issue_id").collect()}


def test_dominant_signal_ranks_for_every_issue(spark, con, small):
    ids = _ids(spark, small)
    got = {r[0] for r in registry.queries()["dominant_signal"](spark, small).select("query_id").distinct().collect()}
    want = {r[0] for r in con.execute(f"SELECT DISTINCT query_id FROM ({registry.oracle_sql()['dominant_signal']})").fetchall()}
    assert got == want and got <= ids and any(i % 100 for i in got) and len(got) > len(ids) / 2


def test_eval_recall_hit_ap_has_every_issue(spark, small):
    got = [r[0] for r in registry.queries()["eval_recall_hit_ap"](spark, small).select("query_id").collect()]
    assert sorted(got) == sorted(_ids(spark, small))


def test_evidence_ranks_for_every_issue(spark, con, small):
    got = {r[0] for r in registry.queries()["evidence"](spark, small).select("query_id").distinct().collect()}
    want = {r[0] for r in con.execute(f"SELECT DISTINCT query_id FROM ({registry.oracle_sql()['evidence']})").fetchall()}
    assert got == want and any(i % 100 for i in got) and len(got) > len(_ids(spark, small)) / 2


def test_many_searches_meet_entries_by_subsets_of_frequent_words(spark, monkeypatch):
    rng = random.Random(7)
    common = [f"pal{chr(97 + i)}" for i in range(14)]
    key = lambda: rng.choice([None, "k0", "k0", *(f"k{i}" for i in range(40))])
    text = lambda: " ".join([*rng.sample(common, rng.choice([1, 2, 3, 4, 5, 6, 8])), *(f"raro{rng.randrange(60)}" for _ in range(rng.randrange(3)))])
    entries = [(i, key(), text()) for i in range(1000)] + [(9000, None, None), (9001, "k1", "")]
    queries = [(i, key(), text()) for i in range(80)] + [(500, "k1", None), (501, None, "nenhuma"), (None, "k2", text())]  # one without id
    want = set()
    for qid, own, q in queries:
        a = set((q or "").split())
        scored = ((-round(len(a & set(t.split())) / len(a | set(t.split())), 9), pr) for pr, k, t in entries if t and a & set(t.split()) and (k is None or k != own))
        want |= {(qid, place, pr, -s) for place, (s, pr) in enumerate(sorted(scored)[:5], 1)}
    q, e = spark.createDataFrame(queries, "query_id bigint, q_key string, text string"), spark.createDataFrame(entries, "pr bigint, key string, text string")
    got = lambda: {(r.query_id, r.place, r.pr, round(r.score, 9)) for r in S.similar(q, e, 5, ("key", "q_key")).collect()}
    assert got() == want  # few searches meet by words
    monkeypatch.setattr(S, "MANY", 0)
    for frequent, most in ((10, 10), (14, 3)):  # the second: sets too long for their subsets
        monkeypatch.setattr(S, "FREQUENT", frequent)
        monkeypatch.setattr(S, "SUBSET_WORDS", most)
        assert got() == want


def test_expansion_without_own_changes(spark):
    pairs = spark.createDataFrame([("a", "b", 4, 8), ("a", "c", 2, 8), ("a", "d", 1, 8), ("z", "b", 1, 2)], "a string, b string, n_ab bigint, n_a bigint")
    seed = spark.createDataFrame([(1, "a"), (2, "a"), (2, "z"), (3, "a")], "query_id int, path string")
    removed = spark.createDataFrame([(1, "a", 4), (3, "a", 8)], "query_id int, a string, e_a bigint")
    removed_pairs = spark.createDataFrame([(1, "a", "b", 4), (3, "a", "b", 4)], "query_id int, a string, b string, e_ab bigint")
    got = sorted((r.query_id, r.path, r.raw) for r in S.expand(seed, pairs, removed_pairs, removed, 2).collect())
    assert got == [(1, "c", 0.5), (1, "d", 0.25), (2, "b", 1.0), (2, "c", 0.25)]
