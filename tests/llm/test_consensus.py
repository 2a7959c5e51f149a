import numpy as np
from pyspark.sql import functions as F

from sextant.llm import consensus as C

SCHEMA = "feedback_id bigint, item_id bigint, verdict string, user string, at string, voter int, up int"


def votes(spark, rows):
    return spark.createDataFrame([(i, *r, 7, 7) for i, r in enumerate(rows)], SCHEMA).withColumn("at", F.to_timestamp("at"))


def test_last_usable_vote(spark):
    rows = [
        (1, "up", "A ", "2024-01-01"), (1, "Thumbs_Down", "a", "2024-01-02"), (1, "?", "a", "2024-01-03"),
        (1, "👍🏽", "b", None), (1, "-1", "b", None),
        (1, "up", "anonymous", "2024-01-01"), (1, "up", None, "2024-01-01"), (1, "up", " ", "2024-01-01"),
        (None, "up", "c", "2024-01-01"), (2, None, "c", "2024-01-01"),
    ]
    assert sorted(map(tuple, C.last_votes(votes(spark, rows)).collect())) == [(1, "a", 0), (1, "b", 0)]


def test_trust_beats_majority(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for i in range(150):
        t = int(rng.random() < 0.6)
        truth[i] = "up" if t else "down"
        for u in range(3):
            rows.append((i, "up" if (t if rng.random() < 0.95 else 1 - t) else "down", f"good{u}", "2024-01-01"))
        for u in range(3):
            rows.append((i, "down" if (t if rng.random() < 0.85 else 1 - t) else "up", f"bad{u}", "2024-01-01"))
        rows.append((i, "up", "always", "2024-01-01"))
        if i % 2:
            rows.append((i, "up" if t else "down", f"once{i}", "2024-01-01"))
    items, sources = C.discover(C.last_votes(votes(spark, rows)))
    got = {r.item_id: r.consensus for r in C.consensus(items).collect()}
    assert sum(got[i] == truth[i] for i in truth) > 0.95 * len(truth)
    rel = {r.voter: r for r in C.reliability(sources).collect()}
    assert rel["good0"].reliability > 0.85 > rel["bad0"].reliability and rel["bad0"].weight_up < 0
    assert abs(rel["always"].weight_up) < 0.6 < rel["good0"].weight_up


def test_few_and_none(spark):
    items, _ = C.discover(C.last_votes(votes(spark, [(1, "up", "a", None), (1, "up", "b", None), (2, "up", "a", None), (2, "down", "b", None), (2, "up", "c", None)])))
    got = C.consensus(items).collect()
    assert [(r.item_id, r.n_users, r.n_up) for r in got] == [(2, 3, 2)] and abs(got[0].agreement - 1 / 3) < 1e-9
    items, sources = C.discover(C.last_votes(votes(spark, []).limit(0)))
    assert items.count() == 0 and C.reliability(sources).count() == 0


def test_named_weighting(spark):
    """Weights are chi-squared quantile over squared distance; trusted voters outweigh the majority, one lucky vote doesn't count much, the estimate settles."""
    rng = np.random.default_rng(2)
    rows, truth = [], {}
    for i in range(150):
        t = int(rng.random() < 0.5)
        truth[i] = "up" if t else "down"
        right = lambda p: "up" if (t if rng.random() < p else 1 - t) else "down"  # noqa: E731, B023
        rows += [(i, right(0.95), f"good{u}", "2024-01-01") for u in range(3)] + [(i, right(0.5), f"coin{u}", "2024-01-01") for u in range(4)] + [(i, right(1.0), f"once{i}", "2024-01-01")]
    items, people, progress = C.trust(C.last_votes(votes(spark, rows)))
    got = {r.item_id: r.consensus for r in C.consensus(items).collect()}
    assert progress.converged and 1 < progress.rounds <= 40
    assert sum(got[i] == truth[i] for i in truth) > 0.95 * len(truth)
    by = {r.voter: r for r in people.collect()}
    assert by["good0"].weight > 4 * by["coin0"].weight and by["good0"].weight > 10 * by["once0"].weight
    assert by["good0"].reliability > 0.8 > by["coin0"].reliability >= 0
    assert by["good0"].slope > 0.7 > by["coin0"].slope
    chi = {r.n: r.q for r in people.select("n", C.chi2_lower(F.col("n").cast("double")).alias("q")).distinct().collect()}
    assert all(abs(r.weight - chi[r.n] / r.distance) < 1e-9 for r in by.values())
    empty, nobody, progress = C.trust(C.last_votes(votes(spark, rows)).limit(0))
    assert empty.count() == 0 and nobody.count() == 0 and progress.converged


def test_named_weighting_reverses_and_discounts(spark):
    """Voters who are mostly wrong count reversed, one who always says the same counts for almost nothing; the distance is that of the calibrated labels."""
    rng = np.random.default_rng(5)
    rows, truth = [], {}
    for i in range(200):
        t = int(rng.random() < 0.6)
        truth[i] = "up" if t else "down"
        say = lambda p: "up" if (t if rng.random() < p else 1 - t) else "down"  # noqa: E731, B023
        rows += [(i, say(0.95), f"good{u}", "2024-01-01") for u in range(3)] + [(i, say(0.15), f"bad{u}", "2024-01-01") for u in range(2)] + [(i, "up", f"always{u}", "2024-01-01") for u in range(3)]
    found = C.last_votes(votes(spark, rows))
    items, people, progress = C.trust(found)
    got = {r.item_id: r.consensus for r in C.consensus(items).collect()}
    assert progress.converged and sum(got[i] == truth[i] for i in truth) > 0.97 * len(truth)
    by = {r.voter: r for r in people.collect()}
    assert by["bad0"].slope < -0.4 and by["good0"].weight > 20 * by["always0"].weight
    again = {r.voter: r for r in C._calibrated(found.join(items, "item_id"), 0.7, 2.0, 0.02, 0.1).collect()}
    each = found.join(items, "item_id").where("voter = 'bad0'").collect()
    b = again["bad0"]
    assert abs(b.distance - 2 * 0.21 / b.slope**2 - 0.1 * b.n - sum(((r.up - b.offset) / b.slope - r.p_up) ** 2 for r in each)) < 1e-6


def test_unanimous_votes_stay(spark):
    """Where nobody disagrees the verdict is the one given, whatever it is."""
    for verdict in ("up", "down"):
        items, _, progress = C.trust(C.last_votes(votes(spark, [(i, verdict, f"u{u}", None) for i in range(4) for u in range(3)])))
        assert progress.converged and {r.consensus for r in C.consensus(items).collect()} == {verdict}
