import itertools
import random

from sextant.llm import cooccurrence as O


def brute(rows, least, lift):
    sets = {}
    for k, items in rows:
        if k is not None and items:
            sets.setdefault(k, set()).update(x for x in items if x is not None)
    sets = {k: v for k, v in sets.items() if v}
    n = len(sets)
    count = lambda *xs: sum(all(x in s for x in xs) for s in sets.values())
    items = sorted(set().union(*sets.values())) if sets else []
    return {(a, b): (count(a, b), count(a), count(b), n) for a, b in itertools.combinations(items, 2) if count(a, b) >= least and count(a, b) * n >= lift * count(a) * count(b)}


def run(spark, rows, least=2, lift=1.5):
    df = spark.createDataFrame([(k, i, 1, "x") for k, i in rows], "pr bigint, items array<string>, id int, basket string")
    return {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in O.cooccurring_pairs(df, "pr", "items", least, lift).collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, [f"f{int(rng.random() ** 2 * 14)}" for _ in range(rng.randrange(6))]) for k in range(60)]
    rows += [(1, ["extra", "f1"]), (None, ["f1", "f2"]), (70, None), (71, []), (72, [None, "f3", "f3"]), (73, ["É", "a", "Z"]), (74, ["É", "a", "Z"])]
    rows += [(100 + i, ["hot", f"f{i % 5}"]) for i in range(40)]
    assert run(spark, rows) == brute(rows, 2, 1.5)


def test_shuffled_path_gives_the_same(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, [f"f{rng.randrange(9)}" for _ in range(3)]) for k in range(80)]
    monkeypatch.setattr("sextant.runtime.BROADCAST_ROWS", 0)
    monkeypatch.setattr(O, "BLOCK", 2)
    monkeypatch.setattr(O, "sized", lambda df: df)
    split = O.skew_join
    monkeypatch.setattr(O, "skew_join", lambda *a, **k: split(*a, **k, most_rows=0))
    assert run(spark, rows, 2, 1.0) == brute(rows, 2, 1.0)


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [(1, ["a"])]) == {}


def test_a_huge_basket_is_spread(spark, monkeypatch):
    """A basket with most of all rows: its pairs are made in several tasks, and none is lost."""
    monkeypatch.setattr(O, "BLOCK", 8)
    rows = [(1, [f"i{k}" for k in range(120)]), (2, [f"i{k}" for k in range(0, 120, 3)])] + [(10 + k, [f"i{k % 120}", "other"]) for k in range(400)]
    spread, cut = [], O.cut
    monkeypatch.setattr(O, "cut", lambda df: spread.append(cut(df)) or spread[-1])
    assert run(spark, rows, 2, 1.5) == brute(rows, 2, 1.5)
    sizes = [r.k for df in spread if "blocks" in df.columns and "b" in df.columns for r in df.selectExpr("size(b) as k").collect()]
    assert len(sizes) > 20 and max(sizes) < 24
