"""Queries of the numbered problems and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import consensus as C
from sextant.llm.cooccurrence import cooccurring_pairs
from sextant.llm.linkage import link
from sextant.llm import langid, mixing, packing, pii
from sextant.llm.tokens import sized_documents
from sextant.runtime import cut, table


def _private(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, pii.Detector]:
    rows = pii.rows_of(table(spark, sf_dir, "jira_issues"), table(spark, sf_dir, "jira_comments"))
    return rows, pii.fit(rows)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of personal data."""
    return pii.spans(*_private(spark, sf_dir)).select("origin", "row_id", "kind", "start_pos")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with placeholders."""
    return pii.redact(*_private(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker items and the changes of the same task."""
    return link(table(spark, sf_dir, "tracker_items"), table(spark, sf_dir, "task_index")).select("item_id", "pr")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with task and confidence."""
    return link(table(spark, sf_dir, "tracker_items"), table(spark, sf_dir, "task_index"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus of each item with votes of three users or more."""
    return C.consensus(C.trust(C.last_votes(table(spark, sf_dir, "feedback")))[0]).select("item_id", "consensus")


def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with confidence and agreement."""
    return C.consensus(C.trust(C.last_votes(table(spark, sf_dir, "feedback")))[0])


def p4_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reliability of each user."""
    people = C.trust(C.last_votes(table(spark, sf_dir, "feedback")))[1]
    return people.select("voter", F.col("n").alias("n_votes"), "offset", "slope", "distance", "weight", "reliability")


def p4_users_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where each label of a user is a source of its own."""
    return C.reliability(C.discover(C.last_votes(table(spark, sf_dir, "feedback")))[1])


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement over all items."""
    out = C.overall_agreement(C.last_votes(table(spark, sf_dir, "feedback")))
    return out.select("n_items", *(F.round(c, 6).alias(c) for c in ("agreement", "by_chance", "kappa")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of paths that change together."""
    return cooccurring_pairs(table(spark, sf_dir, "task_index"), "pr", "files.f").select(F.col("item_a").alias("f_a"), F.col("item_b").alias("f_b"))


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with counts, lift and conviction."""
    out = cooccurring_pairs(table(spark, sf_dir, "task_index"), "pr", "files.f")
    score = lambda c: F.round(c, 6).alias(c)
    return out.select(F.col("item_a").alias("f_a"), F.col("item_b").alias("f_b"), "n_ab", "n_a", "n_b", score("lift"), score("conviction_ab"), score("conviction_ba"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text, for each capacity."""
    return packing.pack(sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "container_specs"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.report(p6_pack(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return mixing.balance(cut(sized_documents(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens that each source has reached."""
    return mixing.balance(cut(sized_documents(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "mix_targets"))[1]


def _languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return docs, cut(langid.segments(docs, langid.fit(docs)))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and their languages, of documents with a missing or wrong label or several languages."""
    docs, segs = _languages(spark, sf_dir)
    wrong = langid.relabel(docs, segs).where("problem is not null").select("doc_id").distinct()
    return segs.join(wrong, "doc_id", "left_semi").select("doc_id", "para_no", "lang")


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, beside its label."""
    return langid.relabel(*_languages(spark, sf_dir))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each paragraph."""
    return _languages(spark, sf_dir)[1]


_PAIRS = """
WITH x AS (SELECT DISTINCT pr, unnest(files).f AS f FROM task_index WHERE pr IS NOT NULL),
b AS (SELECT * FROM x WHERE f IS NOT NULL),
s AS (SELECT f, count(*) AS k FROM b GROUP BY f),
n AS (SELECT count(DISTINCT pr) AS n FROM b),
p AS (SELECT p.f AS f_a, q.f AS f_b, count(*) AS n_ab FROM b p JOIN b q ON p.pr = q.pr AND p.f < q.f GROUP BY 1, 2 HAVING count(*) >= 6),
r AS (SELECT f_a, f_b, n_ab, sa.k AS n_a, sb.k AS n_b, n FROM p JOIN s sa ON sa.f = f_a JOIN s sb ON sb.f = f_b CROSS JOIN n WHERE n_ab * n >= 3 * sa.k * sb.k)
"""

_UP, _DOWN = (", ".join(f"'{x}'" for x in words) for words in (C.UP, C.DOWN))
_VOTES = f"""
WITH a AS (SELECT item_id, lower(trim("user")) AS u, lower(trim(verdict)) AS vd, "at", feedback_id FROM feedback WHERE item_id IS NOT NULL),
b AS (SELECT *, CASE WHEN vd IN ({_UP}) THEN 1 WHEN vd IN ({_DOWN}) THEN 0 END AS up FROM a WHERE u NOT IN ('', 'anonymous')),
c AS (SELECT item_id, u, up, row_number() OVER (PARTITION BY item_id, u ORDER BY "at" DESC NULLS LAST, feedback_id DESC) AS rn FROM b WHERE up IS NOT NULL),
v AS (SELECT item_id, u, up FROM c WHERE rn = 1)
"""

SQL = {
    "p4_agreement": _VOTES
    + """, i AS (SELECT item_id, count(*) AS n, sum(up) AS k FROM v GROUP BY 1 HAVING count(*) > 1),
    o AS (SELECT count(*) AS n_items, avg((k * (k - 1) + (n - k) * (n - k - 1)) / (n * (n - 1))) AS agreement, sum(k) / sum(n) AS p FROM i)
    SELECT n_items, round(agreement, 6) AS agreement, round(p * p + (1 - p) * (1 - p), 6) AS by_chance,
    round((agreement - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 6) AS kappa FROM o""",
    "p5_found": _PAIRS + "SELECT f_a, f_b FROM r",
    "p5_scores": _PAIRS
    + """SELECT f_a, f_b, n_ab, n_a, n_b, round(n_ab * n / (n_a * n_b), 6) AS lift,
    round(((n - n_b) * n_a) / nullif(n * (n_a - n_ab), 0), 6) AS conviction_ab,
    round(((n - n_a) * n_b) / nullif(n * (n_b - n_ab), 0), 6) AS conviction_ba FROM r""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
