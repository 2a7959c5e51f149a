from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm import mixing, packing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece_once(hist):
    ranges, n = packing.plan(hist, 64)
    fill, seen, told, places = Counter(), defaultdict(set), {}, {}
    for length, a, b, window, place, total, tier in ranges:
        for k in range(b - a):
            assert a + k not in seen[length]
            seen[length].add(a + k)
            fill[window + k] += length
            told[window + k] = total
            places[window + k] = place + k
            assert 0 <= tier <= 3
    assert {x: len(s) for x, s in seen.items()} == hist
    assert set(fill) == set(range(n)) and dict(fill) == told and sorted(places.values()) == list(range(n))
    assert not fill or max(fill.values()) <= 64
    tokens = sum(k * v for k, v in hist.items())
    assert n <= 2 * -(-tokens // 64) + 1


def test_tiers_have_windows_of_their_own():
    """Pieces of a shorter tier fill gaps of longer windows first and then share windows of their own size; containers are as full as without tiers."""
    hist = {60: 3, 20: 5, 9: 14, 4: 7, 3: 30, 2: 40, 1: 60}
    put, windows = packing.best_fit(hist, 64, 4)
    sizes = {tier: max(fill for _, _, fill, t in windows if t == tier) for tier in {t for *_, t in windows}}
    assert all(most <= 64 >> tier for tier, most in sizes.items()) and {0, 1, 2} <= set(sizes)
    assert put[0][0] == 60 and all(fill == 64 for _, _, fill, t in windows if t == 0)  # gaps of the long windows are filled
    where = lambda tiers: {(length, a, b, c) for length, a, b, c, *_ in packing.plan(hist, 64, tiers)[0]}
    assert where(1) != where(3) and packing.plan(hist, 64, 4)[1] <= packing.plan(hist, 64, 1)[1] + 1


def test_pack_rows(spark):
    rows = [(1, 5), (2, 23), (3, None), (4, 0), (5, 10), (5, 10), (6, 7)]
    sizes = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id bigint, n_tokens bigint, spec_id int, source string")
    specs = spark.createDataFrame([(1, 10), (2, 100), (3, 0), (None, 5), (1, 10)], "spec_id int, capacity_tokens int")
    out = packing.pack(sizes, specs).collect()
    for s, cap in ((1, 10), (2, 100)):
        mine = [r for r in out if r.spec_id == s]
        by = defaultdict(int)
        for r in mine:
            by[r.container_id] += r.n_tokens
        assert max(by.values()) <= cap
        got = Counter()
        for r in mine:
            got[r.doc_id] += r.n_tokens
        assert got == {1: 5, 2: 23, 3: 0, 4: 0, 5: 20, 6: 7}
    assert sorted((r.piece_no, r.token_start, r.n_tokens) for r in out if r.spec_id == 1 and r.doc_id == 2) == [(0, 0, 10), (1, 10, 10), (2, 20, 3)]
    assert {r.spec_id for r in out} == {1, 2}
    assert packing.pack(sizes.limit(0), specs).count() == 0
    only_empty = packing.pack(sizes.where("doc_id in (3, 4)"), specs).collect()
    assert {r.container_id for r in only_empty} == {0} and len(only_empty) == 4


def mix(spark, rows, targets, **kw):
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    copies, shares = mixing.balance(sizes, t, **kw)
    return {r.doc_id: r for r in copies.collect()}, {r.source: r for r in shares.collect()}


def test_shares_and_caps(spark):
    rows = [(i, "a", 10 + i % 90) for i in range(3000)] + [(10000 + i, "b", 5 + i % 50) for i in range(400)] + [(20000, "c", 9), (20001, None, 9), (20002, "b", 0)]
    copies, shares = mix(spark, rows, [("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 9), (None, 0.2, 1), ("bad", 0.0, 1)])
    assert shares["a"].reached_share == pytest.approx(0.5 / 0.9, abs=0.002) and shares["b"].reached_share == pytest.approx(0.4 / 0.9, abs=0.002)
    assert max(r.copies for r in copies.values() if r.source == "a") <= 1 and max(r.copies for r in copies.values() if r.source == "b") <= 3
    assert shares["gone"].n_documents == 0 and shares["c"].tokens_reached == 0 and 20000 not in copies
    total = sum(r.copies * r.n_tokens for r in copies.values())
    assert total == sum(r.tokens_reached for r in shares.values())


def test_mix_of_nothing(spark):
    copies, shares = mix(spark, [], [("a", 1.0, 2)])
    assert not copies and shares["a"].reached_share == 0.0
    copies, _ = mix(spark, [(1, "a", 0), (2, "b", 5)], [])
    assert not copies
