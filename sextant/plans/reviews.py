"""Queries for reviews: labels to choose from, changes as text, updates that one event causes, conversations, scans with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import shapes as X
from sextant.operators import budget as B
from sextant.operators.changes import newest_then, with_defaults
from sextant.plans.parts import CHANGES, the_changes
from sextant.runtime import table
from sextant.streaming.events import fan_out


def label_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels and types that issues have, each once, with how many issues have it."""
    i = table(spark, sf_dir, "jira_issues").select("issue_id", F.array_distinct(F.concat(F.coalesce("labels", F.array().cast("array<string>")), F.array(F.col("issuetype.name")))).alias("l"))
    return i.select(F.explode("l").alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


def change_diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change as text for a reviewer; the tables hold counts of lines, but no patches."""
    t = the_changes(spark, sf_dir)
    none = F.lit(None).cast("string")
    files = F.transform("files", lambda x: F.struct(x["f"].alias("f"), none.alias("status"), x["add"].alias("add"), x["del"].alias("del"), none.alias("patch")))
    title = F.concat(F.lit("PR #"), F.col("pr").cast("string"), F.lit(' "'), F.coalesce("title", F.lit("")), F.lit('"'))
    return t.select("pr", X.diff_text(title, files).alias("text"))


def comment_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update for each ticket that a comment names."""
    c = table(spark, sf_dir, "jira_comments").select("comment_id", "issue_id", "body")
    named = F.regexp_extract_all("body", F.lit(r"\b([A-Z]{2,6}-\d+)\b"), F.lit(1))
    return fan_out(c, named, "ticket", F.col("issue_id").isNotNull()).select("comment_id", "issue_id", "ticket")


def file_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fit when a file may take 40 and a change 100."""
    t = the_changes(spark, sf_dir).where("size(files) > 0")
    kept = B.cap_each(F.transform("files", lambda x: x["add"] + x["del"]), 40, 100)
    return t.select("pr", F.aggregate(kept, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("kept_lines"), F.size(F.filter(kept, lambda x: x > 0)).alias("kept_files"))


def conversation_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last text that nobody is named for, in each issue's comments, and how many others there are. Aggregates combine before the shuffle."""
    c = table(spark, sf_dir, "jira_comments").where("issue_id is not null and body is not null")
    at, system = F.struct("created", "comment_id"), F.col("author.displayName").isNull()
    said = F.when(system, at)
    return c.groupBy("issue_id").agg(F.min_by(F.when(system, F.col("body")), said).alias("first_system"), F.max_by(F.when(system, F.col("body")), said).alias("last_system"), F.count_if(~system).alias("n_others"))


def newest_then_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 500 newest changes those with a ticket: the limit comes before the filter."""
    t = the_changes(spark, sf_dir).select("pr", "key", "title", "mergedAt")
    return newest_then(t, [F.desc_nulls_last("mergedAt"), F.desc("pr")], 500, F.col("key").isNotNull()).select("pr", "key", "title")


def change_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes with values where a field is missing, and fields that no record has."""
    t = the_changes(spark, sf_dir).select("pr", "key", "branch", "issueType")
    return with_defaults(t, {"key": "?", "branch": "main", "issueType": "?", "author": "?", "additions": 0})


QUERIES = {f.__name__: f for f in (label_facet, change_diff_text, comment_fan_out, file_budget_pack, conversation_ends, newest_then_named, change_defaults)}

SQL = {
    "label_facet": "WITH l AS (SELECT DISTINCT issue_id, unnest(list_append(coalesce(labels, []), issuetype.name)) AS label FROM jira_issues) SELECT label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY 1",
    "change_diff_text": f"""WITH {CHANGES}, f AS (SELECT pr, unnest(files) AS x, generate_subscripts(files, 1) AS pos FROM changes),
    g AS (SELECT pr, string_agg('### ' || coalesce(x.f, '') || ' (+' || coalesce(x.add, 0) || '/-' || coalesce(x.del, 0) || ')' || chr(10) || '(no patch)' || chr(10) || chr(10), '' ORDER BY pos) AS said FROM f GROUP BY 1)
    SELECT pr, 'PR #' || pr || ' "' || coalesce(title, '') || '"' || chr(10) || chr(10) || coalesce(said, '') AS text FROM changes LEFT JOIN g USING (pr)""",
    "comment_fan_out": r"SELECT comment_id, issue_id, unnest(list_distinct(regexp_extract_all(body, '\b([A-Z]{2,6}-\d+)\b', 1))) AS ticket FROM jira_comments WHERE issue_id IS NOT NULL",
    "file_budget_pack": f"""WITH RECURSIVE {CHANGES}, s AS (SELECT pr, list_transform(files, lambda x: x.add + x.del) AS l FROM changes WHERE len(files) > 0),
    w(pr, l, i, used, n) AS (SELECT pr, l, 1, 0::BIGINT, 0 FROM s UNION ALL SELECT pr, l, i + 1, used + greatest(least(l[i], 40, 100 - used), 0), n + (least(l[i], 40, 100 - used) > 0)::INT FROM w WHERE i <= len(l))
    SELECT pr, used AS kept_lines, n AS kept_files FROM w WHERE i = len(l) + 1""",
    "conversation_ends": """WITH c AS (SELECT issue_id, body, author.displayName IS NULL AS s, row_number() OVER (PARTITION BY issue_id ORDER BY created NULLS FIRST, comment_id) AS rn FROM jira_comments WHERE issue_id IS NOT NULL AND body IS NOT NULL)
    SELECT issue_id, arg_min(body, rn) FILTER (s) AS first_system, arg_max(body, rn) FILTER (s) AS last_system, count(*) FILTER (NOT s) AS n_others FROM c GROUP BY 1""",
    "newest_then_named": f"""WITH {CHANGES}, n AS (SELECT pr, key, title FROM changes ORDER BY "mergedAt" DESC NULLS LAST, pr DESC LIMIT 500) SELECT * FROM n WHERE key IS NOT NULL""",
    "change_defaults": f"""WITH {CHANGES} SELECT pr, coalesce(key, '?') AS key, coalesce(branch, 'main') AS branch, coalesce("issueType", '?') AS "issueType", '?' AS author, 0 AS additions FROM changes""",
}
