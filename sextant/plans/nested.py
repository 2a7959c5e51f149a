"""Queries over the raw nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import shred as S
from sextant.runtime import table

ROOTS, SPRINT = ["description", "comment", "customfield_10020"], ("customfield_10020",)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shred(table(spark, sf_dir, "jira_raw"), ROOTS, SPRINT)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object in an array below the three fields, with its parent."""
    return S.objects(_levels(spark, sf_dir), SPRINT).select("record_id", "issue_key", "node_path", "parent_path")


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar with the object that it belongs to."""
    return S.values(_levels(spark, sf_dir), SPRINT).select("record_id", "issue_no", "issue_key", "node_path", "name", "value")


def _flat(spark: SparkSession, sf_dir: str, where, columns: dict[str, str]) -> DataFrame:
    levels = _levels(spark, sf_dir)
    nodes = S.objects(levels, SPRINT).where(where).drop("table_path")
    return S.widen(S.values(levels, SPRINT), nodes, columns)


def p2_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of comments."""
    where = F.col("table_path").isin("comment.comments[]", "comment[]")
    return _flat(spark, sf_dir, where, {"id": "comment_id", "created": "created", "author.displayName": "author", "body": "body_text"})


def p2_sprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of sprints."""
    where = F.col("table_path").isin("customfield_10020[]", "customfield_10020")
    return _flat(spark, sf_dir, where, {"id": "sprint_id", "name": "sprint_name", "state": "sprint_state"})


def p2_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of rich-text nodes."""
    where = F.col("table_path").contains("content[]")
    return _flat(spark, sf_dir, where, {"type": "type", "text": "text", "attrs.level": "heading_level", "attrs.url": "url"})


QUERIES = {f.__name__: f for f in (p2_found, p2_values, p2_comments, p2_sprints, p2_content)}

_ISSUES = """
WITH p AS (SELECT record_id, shape, payload FROM jira_raw WHERE json_valid(payload)),
i AS (SELECT record_id, 0 AS issue_no, payload::JSON AS j FROM p WHERE shape = 'issue'
  UNION ALL SELECT record_id, e.key::INT, e.value FROM (SELECT * FROM p WHERE shape = 'search') s, json_each(s.payload, '$.issues') e),
r AS (SELECT record_id, issue_no, j->>'$.key' AS issue_key, root, j->('$.fields.' || root) AS v FROM i, (VALUES ('description'), ('comment'), ('customfield_10020')) x(root)),
t AS (SELECT record_id, issue_no, issue_key, r.root, r.root || substr(e.fullkey, 2) AS node_path, e.type, e.fullkey FROM r, json_tree(r.v) e WHERE r.v IS NOT NULL)
"""

SQL = {
    "p2_found": _ISSUES
    + """SELECT record_id, issue_key, replace(node_path, '"', '') AS node_path,
    coalesce(nullif(regexp_extract(regexp_replace(replace(node_path, '"', ''), '(\\[\\d+\\])+$', ''), '^.*\\]', 0), ''),
      CASE WHEN root = 'customfield_10020' AND fullkey <> '$' AND replace(node_path, '"', '') LIKE 'customfield_10020.%' THEN root ELSE '' END) AS parent_path
    FROM t WHERE type = 'OBJECT' AND (fullkey LIKE '%]' OR (root = 'customfield_10020' AND fullkey = '$'))""",
    "p2_comments": _ISSUES
    + """, c AS (SELECT record_id, issue_no, issue_key, 'comment.comments[' || e.key || ']' AS node_path, e.value AS v, e.type FROM r, json_each(r.v, '$.comments') e WHERE r.root = 'comment' AND json_type(r.v) = 'OBJECT'
      UNION ALL SELECT record_id, issue_no, issue_key, 'comment[' || e.key || ']', e.value, e.type FROM r, json_each(r.v) e WHERE r.root = 'comment' AND json_type(r.v) = 'ARRAY')
    SELECT record_id, issue_no, issue_key, node_path, '' AS parent_path, v->>'$.id' AS comment_id, v->>'$.created' AS created, v->>'$.author.displayName' AS author, CASE WHEN json_type(v, '$.body') = 'VARCHAR' THEN v->>'$.body' END AS body_text FROM c WHERE type = 'OBJECT'""",
    "p2_sprints": _ISSUES
    + """, s AS (SELECT record_id, issue_no, issue_key, 'customfield_10020[' || e.key || ']' AS node_path, e.value AS v, e.type FROM r, json_each(r.v) e WHERE r.root = 'customfield_10020' AND json_type(r.v) = 'ARRAY'
      UNION ALL SELECT record_id, issue_no, issue_key, 'customfield_10020', v, json_type(v) FROM r WHERE root = 'customfield_10020' AND json_type(v) = 'OBJECT')
    SELECT record_id, issue_no, issue_key, node_path, '' AS parent_path, v->>'$.id' AS sprint_id, v->>'$.name' AS sprint_name, v->>'$.state' AS sprint_state FROM s WHERE type = 'OBJECT'""",
    "p2_values": _ISSUES
    + """, a AS (SELECT r.record_id, r.issue_no, r.issue_key, r.root, replace(r.root || substr(e.fullkey, 2), '"', '') AS p, e.atom->>'$' AS value FROM r, json_tree(r.v) e WHERE r.v IS NOT NULL AND e.type NOT IN ('OBJECT', 'ARRAY', 'NULL')),
    o AS (SELECT *, coalesce(nullif(regexp_extract(regexp_replace(p, '(\\[\\d+\\])+$', ''), '^.*\\]', 0), ''), CASE WHEN starts_with(p, 'customfield_10020.') THEN root ELSE '' END) AS node_path FROM a)
    SELECT record_id, issue_no, issue_key, node_path, CASE WHEN node_path = '' THEN p ELSE substr(p, length(node_path) + 2) END AS name, value FROM o""",
}
