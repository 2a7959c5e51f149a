"""Queries over the change history: clean-up, modules, co-change, effort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.functions.text import token_set
from sextant.operators import changes as C
from sextant.operators.paths import longest_prefix, overlapping
from sextant.operators.search import similar
from sextant.plans.parts import CHANGES, MODULES, NEIGHBOURS, PAIRS, BUMP, rounded, sql_tokens, the_changes, the_pr_modules, without_bumps
from sextant.runtime import cut, sized, table


def latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change once, from its fullest arrival."""
    return the_changes(spark, sf_dir).select("pr", "key", "title", "branch", "jiraTitle", "issueType", F.size("files").alias("n_files"))


def bump_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that only raise a dependency's version."""
    bump = C.is_bump(*(F.col(c) for c in ("title", "jiraTitle", "branch", "key", "files")))
    return the_changes(spark, sf_dir).select("pr", bump.alias("is_bump"))


def generated_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a machine writes, by change."""
    f = the_changes(spark, sf_dir).select("pr", F.explode("files").alias("x")).select("pr", "x.*")
    lines = F.col("add") + F.col("del")
    gen = C.is_generated(F.col("f"))
    return f.groupBy("pr").agg(F.count_if(gen).alias("n_generated"), F.count_if(~gen).alias("n_kept"), F.coalesce(F.sum(F.when(~gen, lines)), F.lit(0)).alias("kept_lines"))


def ticket_key_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticket key named in branch or title beside the one stored."""
    t = the_changes(spark, sf_dir)
    found = C.ticket_key(F.col("branch"), F.col("title"))
    return t.select("pr", "key", found.alias("found"), F.col("key").eqNullSafe(found).alias("same"))


def key_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket data looked up once per distinct key and written back to all its changes; what is not found stays as it was."""
    t = the_changes(spark, sf_dir)
    issues = table(spark, sf_dir, "jira_issues").select("key", F.col("summary"), F.col("issuetype.name").alias("type"))
    keys = t.select("key").where("key is not null").distinct().join(issues, "key")
    out = t.join(sized(keys), "key", "left")
    return out.select("pr", "key", F.coalesce("summary", "jiraTitle").alias("ticket_title"), F.coalesce("type", "issueType").alias("ticket_type"), F.col("summary").isNotNull().alias("found"))


def module_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest module path above each file."""
    files = table(spark, sf_dir, "task_index").select(F.explode("files.f").alias("f"))
    return longest_prefix(files, table(spark, sf_dir, "modules"))


def pr_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules that each change touches, as one sorted text."""
    return the_pr_modules(spark, sf_dir).groupBy("pr").agg(F.array_join(F.sort_array(F.collect_set("path")), ",").alias("modules"), F.count("*").alias("n_modules"))


def unmatched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that lie in no module, with the number of changes."""
    files = the_changes(spark, sf_dir).select("pr", F.explode("files.f").alias("f")).where("f is not null").distinct()
    of = longest_prefix(files, table(spark, sf_dir, "modules"))
    return files.join(of, "f", "left_anti").groupBy("f").agg(F.count("*").alias("n_changes"))


def path_overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that lie above, below or at a module voted on."""
    votes = table(spark, sf_dir, "feedback").select(F.regexp_replace(F.trim("modulePath"), r"^\./", "").alias("v"))
    return overlapping(table(spark, sf_dir, "modules").select("path"), votes, "path", "v", [])


def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one module changes where another does."""
    return rounded(C.cochange(the_pr_modules(spark, sf_dir)), "conditional")


def cochange_neighbors_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each module's eight nearest by co-change."""
    near = C.top_per(C.cochange(the_pr_modules(spark, sf_dir)), ["a"], [F.desc(F.round("conditional", 9)), F.asc("b")], 8)
    return rounded(near.select("a", "b", "conditional", "place"), "conditional")


def cochange_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-change of modules without the changes of each ticket, by subtraction from the whole."""
    pm, t = the_pr_modules(spark, sf_dir), the_changes(spark, sf_dir)
    own = cut(t.where("key is not null").select("pr", "key").join(pm, "pr"))
    pairs = C.cochange(pm)
    o = own.select("key", "pr", F.col("path").alias("a")).join(own.select("pr", F.col("path").alias("b")), "pr").where("a <> b").groupBy("key", "a", "b").agg(F.count("*").alias("e_ab"))
    alone = own.groupBy("key", F.col("path").alias("a")).agg(F.count("*").alias("e_a"))
    out = o.join(alone, ["key", "a"]).join(sized(pairs), ["a", "b"])
    return out.select("key", "a", "b", (F.col("n_ab") - F.col("e_ab")).alias("n_ab"), (F.col("n_a") - F.col("e_a")).alias("n_a"), F.round(F.coalesce(F.try_divide(F.col("n_ab") - F.col("e_ab"), F.col("n_a") - F.col("e_a")), F.lit(0.0)), 6).alias("conditional"))


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticket's latest change, its lines and its size class."""
    r = C.representatives(without_bumps(the_changes(spark, sf_dir)))
    return r.select("key", "pr", "lines", "n_changes", C.size_class(F.col("lines")).alias("size_class"))


def stratified_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tickets of each size class, at even quantiles of their lines."""
    r = C.representatives(without_bumps(the_changes(spark, sf_dir))).where("size(files) >= 3 and lines > 0").withColumn("size_class", C.size_class(F.col("lines")))
    r = cut(r.select("size_class", "key", "pr", "lines"))
    # positions from the histogram of lines, then inside the few chosen cells: no class is ordered in one task
    order = W.partitionBy("size_class").orderBy("lines")
    h = r.groupBy("size_class", "lines").agg(F.count("*").alias("k"))
    h = h.withColumn("from", F.sum("k").over(order) - F.col("k")).withColumn("n", F.sum("k").over(W.partitionBy("size_class")))
    wanted = F.when(F.col("n") <= 3, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).otherwise(F.array(*(F.floor(F.lit(i) * F.col("n") / 4) for i in (1, 2, 3))))
    cells = h.withColumn("at", F.explode(wanted)).where("at >= from and at < from + k").select("size_class", "lines", (F.col("at") - F.col("from")).alias("at"))
    offsets = cells.groupBy("size_class", "lines").agg(F.collect_set("at").alias("at"))
    inside = r.join(F.broadcast(offsets), ["size_class", "lines"]).withColumn("pos", (F.row_number().over(W.partitionBy("size_class", "lines").orderBy("pr")) - 1).cast("bigint"))
    return inside.where(F.array_contains("at", F.col("pos"))).select("size_class", "key", "pr", "lines")


def benchmark_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest tickets whose latest change has three files or more."""
    r = C.representatives(without_bumps(the_changes(spark, sf_dir))).where("size(files) >= 3")
    return r.orderBy(F.desc("mergedAt"), F.desc("pr")).limit(20).select("key", "pr", F.size("files").alias("n_files"))


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches: issues whose id is divisible by 100."""
    return table(spark, sf_dir, "jira_issues").where("issue_id % 100 = 0").select(F.col("issue_id").alias("query_id"), F.col("key").alias("q_key"), F.col("summary").alias("text"))


def _every_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues as searches."""
    return table(spark, sf_dir, "jira_issues").select(F.col("issue_id").alias("query_id"), F.col("key").alias("q_key"), F.col("summary").alias("text"))


def similar_tasks_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen changes most like each searched issue, but for its own."""
    entries = without_bumps(the_changes(spark, sf_dir)).select("pr", "key", F.coalesce("jiraTitle", "title").alias("text"))
    return rounded(similar(_searched(spark, sf_dir), entries, 15, ("key", "q_key")).select("query_id", "pr", "score", "place"), "score")


def effort_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected lines of each searched issue: the median over its five most similar tickets."""
    reps = cut(C.representatives(without_bumps(the_changes(spark, sf_dir)), ("pr", "title", "jiraTitle")).select("pr", "key", "lines", F.coalesce("jiraTitle", "title").alias("text")))
    near = similar(_searched(spark, sf_dir), reps.select("pr", "key", "text"), 5, ("key", "q_key"))
    got = reps.select("pr", "lines").join(sized(cut(near)), "pr").groupBy("query_id").agg(F.count("*").alias("n"), F.percentile("lines", 0.5).alias("median_lines"))
    out = _searched(spark, sf_dir).select("query_id").join(got, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= 2
    return out.select("query_id", "n", F.when(enough, F.col("median_lines")).alias("median_lines"), F.when(enough, C.size_class(F.col("median_lines"))).otherwise("none").alias("size_class"))


def hierarchical_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules from paths alone: a second-level folder of eight files or more is one, small top folders stay whole, the rest goes to the folder above."""
    f = table(spark, sf_dir, "task_index").select(F.explode("files.f").alias("f")).where("f is not null").distinct()
    p = F.split("f", "/")
    f = f.select("f", F.when(F.size(p) > 2, F.concat_ws("/", F.get(p, F.lit(0)), F.get(p, F.lit(1)))).when(F.size(p) > 1, F.get(p, F.lit(0))).otherwise("(root)").alias("top"), F.when(F.size(p) > 3, F.get(p, F.lit(2))).alias("child"))
    by_child = f.groupBy("top", "child").agg(F.count("*").alias("n"))
    by_top = by_child.groupBy("top").agg(F.sum("n").alias("n_top"), F.count("child").alias("n_children"), F.max(F.when(F.col("child").isNotNull(), F.col("n"))).alias("largest"))
    full = by_child.join(by_top, "top")
    whole = (F.col("n_children") == 0) | ((F.coalesce("largest", F.lit(0)) < 8) & (F.col("n_top") <= 25))
    kind = F.when(whole, "whole").when(F.col("child").isNotNull() & (F.col("n") >= 8), "child").otherwise("rest")
    named = full.select(F.when(kind == "child", F.concat_ws("/", "top", "child")).otherwise(F.col("top")).alias("module"), kind.alias("kind"), "n")
    return named.groupBy("module", "kind").agg(F.sum("n").alias("n_files"))


def top_members_per_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each module's ten most changed files, as one text, with a summary where it has none."""
    mods = table(spark, sf_dir, "modules")
    files = the_changes(spark, sf_dir).select("pr", F.explode("files.f").alias("f")).where("f is not null").distinct()
    used = files.groupBy("f").agg(F.count("*").alias("k"))
    best = C.top_per(longest_prefix(files, mods).join(used, "f"), ["path"], [F.desc("k"), F.asc("f")], 10)
    listed = best.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "f"))), lambda x: x["f"]), ",").alias("members"), F.sum("k").alias("n_changes"))
    out = mods.select("path", "summary", F.col("files").alias("n_files")).join(sized(listed), "path", "left")
    text = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.format_string("Module of %d files.", "n_files"))
    return out.select("path", text.alias("summary"), F.coalesce("members", F.lit("")).alias("members"), F.coalesce("n_changes", F.lit(0)).alias("n_changes"))


QUERIES = {f.__name__: f for f in (latest_changes, bump_filter, generated_filter, ticket_key_extract, key_enrichment, module_of_file, pr_modules, unmatched_files, path_overlap_semi, cochange_pairs, cochange_neighbors_topk, cochange_leave_one_out, latest_per_key, stratified_examples, benchmark_selection, similar_tasks_topk, effort_knn, hierarchical_modules, top_members_per_module)}

_LINES = "coalesce(list_sum(list_transform(files, lambda x: coalesce(x.add, 0) + coalesce(x.del, 0))), 0)"
KEPT = f"kept AS (SELECT * FROM changes WHERE NOT ({BUMP}))"
REPS = f"""reps AS (SELECT key, arg_max(pr, struct_pack(m := "mergedAt", p := pr)) AS pr, sum(l)::BIGINT AS lines, count(*) AS n_changes FROM (SELECT *, {_LINES} AS l FROM kept WHERE key IS NOT NULL) GROUP BY key),
rep AS (SELECT r.*, k.files, k.title, k."jiraTitle", k."mergedAt" FROM reps r JOIN kept k USING (pr))"""
_CLASS = "CASE WHEN {0} < 150 THEN 'P' WHEN {0} <= 600 THEN 'M' ELSE 'G' END"
SEARCHED = "searched AS (SELECT issue_id AS query_id, key AS q_key, summary AS text FROM jira_issues WHERE issue_id % 100 = 0)"
EVERY_ISSUE = "searched AS (SELECT issue_id AS query_id, key AS q_key, summary AS text FROM jira_issues)"


def similar_sql(entries: str, top: int) -> str:
    """CTEs q, e and alike(query_id, pr, score, place); ``entries`` selects pr, key, text."""
    return f"""q AS (SELECT query_id, q_key, list_distinct({sql_tokens("text")}) AS w FROM searched),
e AS (SELECT pr, key, list_distinct({sql_tokens("text")}) AS w FROM ({entries})),
qe AS (SELECT query_id, pr, len(list_intersect(q.w, e.w)) AS i, len(q.w) AS nq, len(e.w) AS ne FROM q JOIN e ON e.key IS NULL OR q_key IS NULL OR e.key <> q_key),
alike AS (SELECT * FROM (SELECT query_id, pr, i / (nq + ne - i) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(i / (nq + ne - i), 9) DESC, pr) AS place FROM qe WHERE i > 0) WHERE place <= {top})"""


_WITH = f"WITH {CHANGES}"
_ENTRIES = 'SELECT pr, key, coalesce("jiraTitle", title) AS text FROM '
SQL = {
    "latest_changes": _WITH + ' SELECT pr, key, title, branch, "jiraTitle", "issueType", len(files) AS n_files FROM changes',
    "bump_filter": _WITH + f" SELECT pr, ({BUMP}) AS is_bump FROM changes",
    "generated_filter": _WITH
    + r""", f AS (SELECT pr, unnest(files) AS x FROM changes), g AS (SELECT pr, x.add + x.del AS l, regexp_matches(x.f, 'package-lock\.json$|bun\.lock(b)?$|yarn\.lock$|pnpm-lock\.yaml$|composer\.lock$|\.min\.(js|css)$|^dist/|^build/') AS gen FROM f)
    SELECT pr, count(*) FILTER (gen) AS n_generated, count(*) FILTER (NOT gen) AS n_kept, coalesce(sum(l) FILTER (NOT gen), 0)::BIGINT AS kept_lines FROM g GROUP BY pr""",
    "ticket_key_extract": _WITH + r""", x AS (SELECT pr, key, nullif(regexp_extract(concat_ws(' ', branch, title), '[A-Z][A-Z0-9]+-\d+'), '') AS found FROM changes) SELECT *, key IS NOT DISTINCT FROM found AS same FROM x""",
    "key_enrichment": _WITH + """ SELECT pr, c.key, coalesce(i.summary, c."jiraTitle") AS ticket_title, coalesce(i.issuetype.name, c."issueType") AS ticket_type, i.summary IS NOT NULL AS found FROM changes c LEFT JOIN jira_issues i ON c.key = i.key""",
    "module_of_file": f"{_WITH}, {MODULES} SELECT f, path FROM file_module",
    "pr_modules": f"{_WITH}, {MODULES} SELECT pr, string_agg(path, ',' ORDER BY path) AS modules, count(*) AS n_modules FROM pr_modules GROUP BY pr",
    "unmatched_files": f"{_WITH}, {MODULES} SELECT f, count(*) AS n_changes FROM pr_files WHERE f IS NOT NULL AND f NOT IN (SELECT f FROM file_module) GROUP BY f",
    "path_overlap_semi": r"""WITH v AS (SELECT DISTINCT regexp_replace(trim("modulePath"), '^\./', '') AS v FROM feedback WHERE "modulePath" IS NOT NULL)
    SELECT path FROM modules m WHERE EXISTS (SELECT 1 FROM v WHERE v.v = m.path OR starts_with(v.v, m.path || '/') OR starts_with(m.path, v.v || '/'))""",
    "cochange_pairs": f"{_WITH}, {MODULES}, {PAIRS} SELECT a, b, n_ab, n_a, round(conditional, 6) AS conditional FROM cochange",
    "cochange_neighbors_topk": f"{_WITH}, {MODULES}, {PAIRS}, {NEIGHBOURS} SELECT a, b, round(conditional, 6) AS conditional, place FROM neighbours",
    "cochange_leave_one_out": f"""{_WITH}, {MODULES}, {PAIRS},
    own AS (SELECT key, pr, path FROM changes JOIN pr_modules USING (pr) WHERE key IS NOT NULL),
    o AS (SELECT x.key, x.path AS a, y.path AS b, count(*) AS e_ab FROM own x JOIN own y ON x.pr = y.pr AND x.path <> y.path GROUP BY ALL),
    s AS (SELECT key, path AS a, count(*) AS e_a FROM own GROUP BY ALL)
    SELECT key, a, b, n_ab - e_ab AS n_ab, n_a - e_a AS n_a, round(CASE WHEN n_a = e_a THEN 0 ELSE (n_ab - e_ab) / (n_a - e_a) END, 6) AS conditional FROM o JOIN s USING (key, a) JOIN cochange USING (a, b)""",
    "latest_per_key": f"{_WITH}, {KEPT}, {REPS} SELECT key, pr, lines, n_changes, {_CLASS.format('lines')} AS size_class FROM rep",
    "stratified_examples": f"""{_WITH}, {KEPT}, {REPS}, c AS (SELECT *, {_CLASS.format("lines")} AS size_class FROM rep WHERE len(files) >= 3 AND lines > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY size_class ORDER BY lines, pr) - 1 AS pos, count(*) OVER (PARTITION BY size_class) AS n FROM c)
    SELECT size_class, key, pr, lines FROM r WHERE n <= 3 OR pos IN (floor(n / 4), floor(2 * n / 4), floor(3 * n / 4))""",
    "benchmark_selection": f'{_WITH}, {KEPT}, {REPS} SELECT key, pr, len(files) AS n_files FROM rep WHERE len(files) >= 3 ORDER BY "mergedAt" DESC, pr DESC LIMIT 20',
    "similar_tasks_topk": f"{_WITH}, {KEPT}, {SEARCHED}, {similar_sql(_ENTRIES + 'kept', 15)} SELECT query_id, pr, round(score, 6) AS score, place FROM alike",
    "effort_knn": f"""{_WITH}, {KEPT}, {REPS}, {SEARCHED}, {similar_sql(_ENTRIES + "rep", 5)}, g AS (SELECT query_id, count(*) AS n, median(lines) AS m FROM alike JOIN reps USING (pr) GROUP BY 1)
    SELECT query_id, coalesce(n, 0) AS n, CASE WHEN n >= 2 THEN m END AS median_lines, CASE WHEN n >= 2 THEN {_CLASS.format("m")} ELSE 'none' END AS size_class FROM searched LEFT JOIN g USING (query_id)""",
    "hierarchical_modules": """WITH f AS (SELECT DISTINCT unnest(files).f AS f FROM task_index), p AS (SELECT f, string_split(f, '/') AS p FROM f WHERE f IS NOT NULL),
    t AS (SELECT CASE WHEN len(p) > 2 THEN p[1] || '/' || p[2] WHEN len(p) > 1 THEN p[1] ELSE '(root)' END AS top, CASE WHEN len(p) > 3 THEN p[3] END AS child FROM p),
    c AS (SELECT top, child, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT top, sum(n) AS n_top, count(child) AS k, max(n) FILTER (child IS NOT NULL) AS largest FROM c GROUP BY top),
    x AS (SELECT top, child, n, CASE WHEN k = 0 OR (coalesce(largest, 0) < 8 AND n_top <= 25) THEN 'whole' WHEN child IS NOT NULL AND n >= 8 THEN 'child' ELSE 'rest' END AS kind FROM c JOIN s USING (top))
    SELECT CASE WHEN kind = 'child' THEN top || '/' || child ELSE top END AS module, kind, sum(n)::BIGINT AS n_files FROM x GROUP BY ALL""",
    "top_members_per_module": f"""{_WITH}, {MODULES}, u AS (SELECT path, f, count(*) AS k FROM pr_files JOIN file_module USING (f) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k DESC, f) AS place FROM u), l AS (SELECT path, string_agg(f, ',' ORDER BY place) AS members, sum(k)::BIGINT AS n FROM r WHERE place <= 10 GROUP BY path)
    SELECT path, coalesce(nullif(trim(summary), ''), 'Module of ' || files || ' files.') AS summary, coalesce(members, '') AS members, coalesce(n, 0) AS n_changes FROM modules LEFT JOIN l USING (path)""",
}
