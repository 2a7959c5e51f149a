"""Queries over texts: words, references, JSON and rich text, composed texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import json_text as J
from sextant.functions import shapes as X
from sextant.functions import text as T
from sextant.operators.changes import top_per
from sextant.plans.parts import sql_tokens
from sextant.runtime import sized, table


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and distinct words of each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("n_distinct"))


def token_df_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred words in the most documents."""
    d = table(spark, sf_dir, "documents").select(F.explode(T.token_set(F.col("text"))).alias("word"))
    return d.groupBy("word").agg(F.count("*").alias("n_documents")).orderBy(F.desc("n_documents"), "word").limit(100)


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each issue's summary its description repeats."""
    i = table(spark, sf_dir, "jira_issues").select("issue_id", T.token_set(F.col("summary")).alias("a"), T.token_set(F.col("description")).alias("b"))
    return i.select("issue_id", T.overlap_count(F.col("a"), F.col("b")).alias("shared"), F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def issue_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name for each issue, and a short hash of its text."""
    i = table(spark, sf_dir, "jira_issues")
    return i.select("issue_id", T.slug(F.col("summary")).alias("slug"), T.short_hash(F.coalesce("description", F.lit(""))).alias("hash"))


def url_ref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests linked in documents, as folder#number, each once per document."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?i)https?://[^/\s]+/([^\s]+?/pull/\d+)"), F.lit(1))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("r"))
    return d.select("doc_id", F.regexp_replace("r", "/pull/", "#").alias("ref"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines inside documents, counted by level and place."""
    line = F.explode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("line")
    d = table(spark, sf_dir, "documents").select(line)
    rx = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ ([A-Z]+) (\S+) code=(\d+)$"
    hit = d.where(F.col("line").rlike(rx)).select(F.regexp_extract("line", rx, 1).alias("level"), F.regexp_extract("line", rx, 2).alias("place"), F.regexp_extract("line", rx, 3).cast("bigint").alias("code"))
    return hit.groupBy("level", "place").agg(F.count("*").alias("n"), F.max("code").alias("most_code"))


def json_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of each comment: the whole text, or the first object in it, if there is one."""
    c = table(spark, sf_dir, "jira_comments").select("comment_id", J.extract_json("body").alias("found"))
    return c.where("found is not null").select("comment_id", F.get_json_object("found", "$.nome").alias("name"), F.length("found").alias("length"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, issue_no, issue): each issue of a payload that is whole, of one issue or of a search, as JSON."""
    raw = table(spark, sf_dir, "jira_raw").where(F.try_parse_json("payload").isNotNull())
    found = F.when(F.col("shape") == "search", F.from_json(F.get_json_object("payload", "$.issues"), "array<string>")).otherwise(F.array("payload"))
    return raw.select("record_id", F.posexplode(found).alias("issue_no", "issue")).where("issue is not null")


def issue_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat fields of all issues, fetched alone or by a search: names with defaults, labels, number of sub-tasks. Broken JSON has no rows."""
    schema = "key string, fields struct<summary string, status struct<name string>, priority struct<name string>, issuetype struct<name string>, labels array<string>, subtasks array<struct<key string>>, parent struct<key string>>"
    j = _issues(spark, sf_dir).select("record_id", "issue_no", F.from_json("issue", schema, {"mode": "PERMISSIVE"}).alias("j"))
    f = j.select("record_id", "issue_no", "j.key", "j.fields.*")
    return f.select("record_id", "issue_no", "key", "summary", F.coalesce("status.name", F.lit("?")).alias("status"), F.coalesce("priority.name", F.lit("Medium")).alias("priority"), F.coalesce("issuetype.name", F.lit("?")).alias("type"), F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"), F.coalesce(F.size("subtasks"), F.lit(0)).alias("n_subtasks"), F.col("parent.key").alias("parent"))


def rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain text of all issues' descriptions."""
    j = _issues(spark, sf_dir).select("record_id", "issue_no", F.get_json_object("issue", "$.fields.description").alias("d"))
    return j.select("record_id", "issue_no", J.flatten_rich_text(F.col("d")).alias("text"), J.flatten_rich_text(F.col("d"), False).alias("run_together"))


def active_sprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active sprint of each issue that has sprints with a name, else its first; a single object counts as a list of one."""
    d = F.get_json_object("issue", "$.fields.customfield_10020")
    each = F.when(F.startswith(d, F.lit("[")), F.from_json(d, "array<string>")).when(F.startswith(d, F.lit("{")), F.array(d))
    named = F.filter(F.transform(each, lambda x: F.when(F.startswith(x, F.lit("{")), F.struct(F.get_json_object(x, "$.name").alias("name"), F.lower(F.get_json_object(x, "$.state")).alias("state")))), lambda x: x["name"].isNotNull())
    active = F.filter(named, lambda x: x["state"] == "active")
    best = F.coalesce(F.get(active, F.lit(0)), F.get(named, F.lit(0)))
    return _issues(spark, sf_dir).select("record_id", "issue_no", best.alias("s")).where("s is not null").select("record_id", "issue_no", F.col("s.name").alias("sprint"), F.col("s.state").alias("state"))


#: A pull request's address: folders, then its number.
_PULL = r"(?i)https?://[^/\s]+/([^\s]+?/pull/\d+)"


def issue_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests that an issue's description, comments or documents link, each once, with the address made from the reference."""
    i, c = table(spark, sf_dir, "jira_issues"), table(spark, sf_dir, "jira_comments")
    docs = table(spark, sf_dir, "documents").select(F.col("task_key").alias("key"), "text").join(sized(i.select("key", "issue_id")), "key").select("issue_id", "text")
    texts = i.select("issue_id", F.col("description").alias("text")).unionByName(c.where("issue_id is not null").select("issue_id", F.col("body").alias("text"))).unionByName(docs)
    found = texts.select("issue_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_PULL), F.lit(1))).alias("r")).distinct()
    ref = F.regexp_replace("r", "/pull/", "#")
    return found.select("issue_id", ref.alias("ref"), T.pull_url(ref).alias("url"))


def ticket_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other tickets that an issue names in its summary, description or comments, with how many texts name them."""
    i, c = table(spark, sf_dir, "jira_issues"), table(spark, sf_dir, "jira_comments")
    texts = i.select("issue_id", "summary").unionByName(i.select("issue_id", F.col("description").alias("summary"))).unionByName(c.where("issue_id is not null").select("issue_id", F.col("body").alias("summary")))
    named = texts.select("issue_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("summary", F.lit("")), F.lit(r"\b([A-Z]{2,6}-\d+)\b"), F.lit(1)))).alias("ticket"))
    return named.join(i.select("issue_id", "key"), "issue_id").where(F.col("key").isNull() | (F.col("key") != F.col("ticket"))).groupBy("issue_id", "ticket").agg(F.count("*").alias("n"))


def composed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary, parent, labels, description and the eight latest comments of each issue, 6000 characters at most."""
    c = top_per(table(spark, sf_dir, "jira_comments").where("trim(coalesce(body, '')) <> ''"), ["issue_id"], [F.desc_nulls_last("created"), F.desc("comment_id")], 8)
    said = c.groupBy("issue_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]), "\n---\n").alias("said"))
    i = table(spark, sf_dir, "jira_issues").join(said, "issue_id", "left")
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("Labels: "), F.array_join("labels", ", ")))
    text = F.concat_ws("\n\n", part(F.col("summary")), F.concat(F.lit("Parent: "), part(F.col("parent_summary"))), labels, part(F.col("description")), F.concat(F.lit("Comments:\n"), F.col("said")))
    return i.select("issue_id", F.substring(text, 1, 6000).alias("text"))


def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules as lines of a Markdown table and of a table of fixed width."""
    m = table(spark, sf_dir, "modules")
    return m.select("path", X.table_row(F.col("name"), F.col("path"), F.col("files"), F.col("summary")).alias("markdown"), X.fixed_width([(F.col("path"), 30), (F.col("files"), -6)]).alias("fixed"))


def section_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each issue's description with a marked section, put in twice: the second replaces the first."""
    i = table(spark, sf_dir, "jira_issues")
    once = X.upsert_section(F.col("description"), F.lit("first"), "<!-- s -->", "<!-- e -->")
    d = i.select("issue_id", "summary", once.alias("once"))
    return d.select("issue_id", X.upsert_section(F.col("once"), F.col("summary"), "<!-- s -->", "<!-- e -->").alias("body"), X.replace_first(F.col("summary"), "[aeiou]", "_").alias("marked"))


QUERIES = {f.__name__: f for f in (tokenize_counts, token_df_top, token_overlap, issue_slugs, url_ref_extract, log_lines, json_in_prose, issue_fields, rich_text, active_sprint, issue_refs, ticket_refs, composed_text, table_text, section_upsert)}

_W = sql_tokens("text")
SQL = {
    "tokenize_counts": f"SELECT doc_id, len(coalesce({_W}, [])) AS n, len(list_distinct(coalesce({_W}, []))) AS n_distinct FROM documents",
    "token_df_top": f"SELECT word, count(*) AS n_documents FROM (SELECT unnest(list_distinct({_W})) AS word FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "token_overlap": f"""WITH t AS (SELECT issue_id, list_distinct({sql_tokens("summary")}) AS a, list_distinct(coalesce({sql_tokens("description")}, [])) AS b FROM jira_issues), s AS (SELECT issue_id, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM t)
    SELECT issue_id, i AS shared, round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE i / (na + nb - i) END, 6)::DOUBLE AS jaccard FROM s""",
    "issue_slugs": "WITH s AS (SELECT issue_id, substr(regexp_replace(regexp_replace(strip_accents(lower(coalesce(summary, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS s, description FROM jira_issues) SELECT issue_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug, substr(sha256(coalesce(description, '')), 1, 8) AS hash FROM s",
    "url_ref_extract": r"SELECT doc_id, replace(r, '/pull/', '#') AS ref FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '(?i)https?://[^/\s]+/([^\s]+?/pull/\d+)', 1))) AS r FROM documents)",
    "log_lines": r"""WITH l AS (SELECT unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents WHERE text IS NOT NULL), h AS (SELECT regexp_extract(line, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ ([A-Z]+) (\S+) code=(\d+)$', ['level', 'place', 'code']) AS m FROM l WHERE regexp_matches(line, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ ([A-Z]+) (\S+) code=(\d+)$'))
    SELECT m.level AS level, m.place AS place, count(*) AS n, max(m.code::BIGINT) AS most_code FROM h GROUP BY ALL""",
    "json_in_prose": r"WITH x AS (SELECT comment_id, CASE WHEN json_valid(trim(body)) THEN trim(body) ELSE regexp_extract(body, '\{[^{}]*\}') END AS j FROM jira_comments) SELECT comment_id, j->>'$.nome' AS name, length(j) AS length FROM x WHERE j <> '' AND json_valid(j)",
    "issue_fields": """WITH r AS (SELECT record_id, CASE WHEN shape = 'search' THEN (payload::JSON->'$.issues')::JSON[] ELSE [payload::JSON] END AS a FROM jira_raw WHERE json_valid(payload)),
    p AS (SELECT record_id, unnest(a) AS j, generate_subscripts(a, 1)::INT - 1 AS issue_no FROM r)
    SELECT record_id, issue_no, j->>'$.key' AS key, j->>'$.fields.summary' AS summary, coalesce(j->>'$.fields.status.name', '?') AS status, coalesce(j->>'$.fields.priority.name', 'Medium') AS priority, coalesce(j->>'$.fields.issuetype.name', '?') AS type, coalesce(array_to_string((j->'$.fields.labels')::VARCHAR[], ','), '') AS labels, coalesce(json_array_length(j->'$.fields.subtasks'), 0) AS n_subtasks, j->>'$.fields.parent.key' AS parent FROM p""",
    "active_sprint": """WITH r AS (SELECT record_id, CASE WHEN shape = 'search' THEN (payload::JSON->'$.issues')::JSON[] ELSE [payload::JSON] END AS a FROM jira_raw WHERE json_valid(payload)),
    p AS (SELECT record_id, unnest(a) AS j, generate_subscripts(a, 1)::INT - 1 AS issue_no FROM r), d AS (SELECT record_id, issue_no, j->'$.fields.customfield_10020' AS d FROM p),
    l AS (SELECT record_id, issue_no, list_filter(CASE json_type(d) WHEN 'ARRAY' THEN d::JSON[] WHEN 'OBJECT' THEN [d] END, lambda x: json_type(x) = 'OBJECT' AND (x->>'$.name') IS NOT NULL) AS l FROM d),
    s AS (SELECT record_id, issue_no, coalesce(list_filter(l, lambda x: lower(x->>'$.state') = 'active')[1], l[1]) AS s FROM l WHERE len(l) > 0)
    SELECT record_id, issue_no, s->>'$.name' AS sprint, lower(s->>'$.state') AS state FROM s""",
    "issue_refs": r"""WITH t AS (SELECT issue_id, description AS text FROM jira_issues UNION ALL SELECT issue_id, body FROM jira_comments WHERE issue_id IS NOT NULL UNION ALL SELECT issue_id, text FROM documents JOIN jira_issues ON key = task_key),
    f AS (SELECT DISTINCT issue_id, unnest(regexp_extract_all(coalesce(text, ''), '(?i)https?://[^/\s]+/([^\s]+?/pull/\d+)', 1)) AS r FROM t)
    SELECT issue_id, replace(r, '/pull/', '#') AS ref, 'https://github.com/' || r AS url FROM f""",
    "ticket_refs": r"""WITH t AS (SELECT issue_id, summary AS text FROM jira_issues UNION ALL SELECT issue_id, description FROM jira_issues UNION ALL SELECT issue_id, body FROM jira_comments WHERE issue_id IS NOT NULL),
    f AS (SELECT issue_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '\b([A-Z]{2,6}-\d+)\b', 1))) AS ticket FROM t)
    SELECT issue_id, ticket, count(*) AS n FROM f JOIN jira_issues i USING (issue_id) WHERE i.key IS NULL OR i.key <> ticket GROUP BY ALL""",
    "composed_text": """WITH c AS (SELECT issue_id, string_agg(body, chr(10) || '---' || chr(10) ORDER BY place) AS said FROM (SELECT issue_id, body, row_number() OVER (PARTITION BY issue_id ORDER BY created DESC NULLS LAST, comment_id DESC) AS place FROM jira_comments WHERE trim(coalesce(body, '')) <> '') WHERE place <= 8 GROUP BY 1)
    SELECT issue_id, substr(concat_ws(chr(10) || chr(10), nullif(trim(summary), ''), 'Parent: ' || nullif(trim(parent_summary), ''), CASE WHEN len(labels) > 0 THEN 'Labels: ' || array_to_string(labels, ', ') END, nullif(trim(description), ''), 'Comments:' || chr(10) || said), 1, 6000) AS text FROM jira_issues LEFT JOIN c USING (issue_id)""",
    "table_text": "SELECT path, '| ' || concat_ws(' | ', replace(coalesce(name, ''), '|', '\\|'), replace(path, '|', '\\|'), files::VARCHAR, replace(coalesce(summary, ''), '|', '\\|')) || ' |' AS markdown, rpad(path, 30, ' ') || ' ' || lpad(files::VARCHAR, 6, ' ') AS fixed FROM modules",
    "section_upsert": "SELECT issue_id, CASE WHEN trim(coalesce(description, '')) = '' THEN '' ELSE rtrim(description, ' ') || chr(10) || chr(10) END || '<!-- s -->' || chr(10) || summary || chr(10) || '<!-- e -->' AS body, regexp_replace(summary, '[aeiou]', '_') AS marked FROM jira_issues",
}
