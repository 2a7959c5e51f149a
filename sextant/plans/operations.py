"""Queries of operational statistics, budgets, merging and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.functions import shapes as X
from sextant.operators import budget as B
from sextant.operators import merging as M
from sextant.operators.changes import is_generated
from sextant.plans.parts import CHANGES, MODULES, the_changes, the_pr_modules
from sextant.runtime import cut, scratch_dir, sized, table
from sextant.streaming import events as E

KINDS = ["view", "click", "purchase", "signup", "error", "refund"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, users, failures, clicks and value of all events; the mean leaves out errors."""
    ok = F.col("event_type") != "error"
    return _events(spark, sf_dir).agg(F.count("*").alias("runs"), F.count_distinct("user_id").alias("users"), F.count_if(~ok).alias("failures"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.round(F.sum("value"), 4).alias("value"), F.round(F.coalesce(F.avg(F.when(ok & (F.col("value") > 0), F.col("value"))), F.lit(0.0)), 6).alias("mean_value"))


def stats_by_kind_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each known kind, 0 where there are none."""
    return M.zero_filled(_events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")), KINDS, "event_type", "n")


def stats_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by UTC day and kind."""
    return E.by_day(_events(spark, sf_dir)).withColumn("value", F.round("value", 4))


def stats_recent30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty latest events."""
    return _events(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "user_id", "event_type", "ts")


def trailing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the seven days before the latest, by user."""
    e = _events(spark, sf_dir)
    last = e.agg(F.max("ts")).first()[0]
    near = e.where(F.col("ts") >= F.lit(last) - F.expr("interval 7 days"))
    return near.groupBy("user_id").agg(F.count("*").alias("n"))


def last_value_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event and value."""
    at = F.struct("ts", "event_id")
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", at).alias("event_type"), F.max_by("value", at).alias("value"), F.max("ts").alias("ts"))


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and kind a day; errors always pass."""
    e = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    first = e.where("event_type <> 'error'").groupBy("user_id", "event_type", "day").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return first.select("event_id", "user_id", "event_type", "day").unionByName(e.where("event_type = 'error'").select("event_id", "user_id", "event_type", "day"))


def demux_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived streams put together again, with the number each event carries."""
    out = None
    for kind, d in E.route(_events(spark, sf_dir)).items():
        one = d.select("event_id", F.lit(kind).alias("stream"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
        out = one if out is None else out.unionByName(one)
    return out


def feedback_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ups and other votes by module."""
    f = table(spark, sf_dir, "feedback").where("modulePath is not null")
    up = F.lower(F.trim(F.coalesce("verdict", F.lit("")))) == "up"
    return f.groupBy(F.regexp_replace(F.trim("modulePath"), r"^\./", "").alias("module")).agg(F.count_if(up).alias("ups"), F.count_if(~up).alias("downs"), F.count("*").alias("total"))


def feedback_recent50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty latest votes."""
    return table(spark, sf_dir, "feedback").orderBy(F.desc_nulls_last("at"), F.desc("feedback_id")).limit(50).select("feedback_id", "item_id", "verdict")


def valid_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of feedback that can be used, and why the others cannot."""
    f = table(spark, sf_dir, "feedback")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    why = F.when(empty("taskText"), "no text").when(empty("modulePath"), "no module").when(~F.coalesce(F.lower(F.trim("verdict")), F.lit("")).isin("up", "down"), "no verdict").otherwise("ok")
    return f.select("feedback_id", why.alias("state"), F.substring(F.trim("taskText"), 1, 200).alias("text"))


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens by source and label, with subtotals and a total."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("(none)")).alias("source"), F.coalesce("lang", F.lit("(none)")).alias("lang"), X.estimated_tokens(F.col("text"), 1).alias("tokens"))
    g = d.rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.grouping_id().alias("level"))
    return g.select(F.coalesce("source", F.lit("(all)")).alias("source"), F.coalesce("lang", F.lit("(all)")).alias("lang"), "level", "n", "tokens")


def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters delivered so far, by source and day: summed by day first, so that the running sum has a row a day."""
    d = table(spark, sf_dir, "documents").where("created_at is not null").groupBy(F.coalesce("source", F.lit("(none)")).alias("source"), F.to_date("created_at").alias("day")).agg(F.sum("n_chars").alias("chars"))
    return d.withColumn("so_far", F.sum("chars").over(W.partitionBy("source").orderBy("day")))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's state from its lines: none, failure before pending before success; and the failing lines in order."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("n_failing"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber").cast("string")))), ",").alias("failing"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    state = F.when(n("total") == 0, "none").when(n("n_failing") > 0, "failure").when(n("n_open") > 0, "pending").otherwise("success")
    return o.select("o_orderkey", n("total").alias("total"), F.coalesce("failing", F.lit("")).alias("failing"), state.alias("state"))


def answer_time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long after its issue each comment came, in words."""
    c = table(spark, sf_dir, "jira_comments").select("comment_id", "issue_id", F.col("created").alias("at"))
    j = c.join(table(spark, sf_dir, "jira_issues").select("issue_id", "created"), "issue_id")
    seconds = F.unix_seconds("at") - F.unix_seconds("created")
    return j.select("comment_id", seconds.alias("seconds"), X.duration_label(seconds).alias("label"))


def cap_running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each change's files that fit 200 in file order; generated files don't count; the first file too many ends it."""
    t = the_changes(spark, sf_dir)
    sizes = F.transform("files", lambda x: F.when(is_generated(x["f"]), 0).otherwise(x["add"] + x["del"]))
    kept = B.cap_prefix(sizes, 200)
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    all_ = total(F.transform(sizes, lambda x: x.cast("bigint")))
    return t.where("size(files) > 0").select("pr", total(kept).alias("kept_lines"), F.size(F.filter(kept, lambda x: x > 0)).alias("kept_files"), (total(kept) < all_).alias("truncated"))


def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fit 100 when files that don't fit are skipped."""
    t = the_changes(spark, sf_dir)
    kept = B.greedy_skip(F.transform("files", lambda x: x["add"] + x["del"]), 100)
    return t.where("size(files) > 0").select("pr", F.aggregate(kept, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("kept_lines"), F.size(F.filter(kept, lambda x: x > 0)).alias("kept_files"))


def truncated_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fit 100 when the first file too many is cut."""
    t = the_changes(spark, sf_dir)
    kept = B.cap_truncate(F.transform("files", lambda x: x["add"] + x["del"]), 100, 5)
    return t.where("size(files) > 0").select("pr", F.aggregate(kept, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("kept_lines"))


def commentable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each changed file that can be commented, from a diff made of its counts: a context line, deletions, additions."""
    f = the_changes(spark, sf_dir).select("pr", F.posexplode("files").alias("pos", "x")).select("pr", "pos", "x.*")
    start = F.col("pr") % 50 + 1
    patch = F.concat(F.lit("@@ -1,"), F.col("del") + 1, F.lit(" +"), start, F.lit(","), F.col("add") + 1, F.lit(" @@\n context"), F.repeat(F.lit("\n-x"), F.col("del").cast("int")), F.repeat(F.lit("\n+y"), F.col("add").cast("int")))
    lines = B.commentable_lines(patch)
    return f.select("pr", "pos", lines.alias("l")).select("pr", "pos", F.size("l").alias("n"), F.array_min("l").alias("first"), F.array_max("l").alias("last"))


def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes without a ticket title brought up to date by the arrivals that have one."""
    t = table(spark, sf_dir, "task_index").where("pr is not null")
    side = lambda d: d.groupBy("pr").agg(F.max("jiraTitle").alias("jiraTitle"), F.max("issueType").alias("issueType"))
    return M.upsert(side(t.where("jiraTitle is null")), side(t.where("jiraTitle is not null")), "pr")


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module summaries kept where no change of the last thirty days touched the module; modules that no earlier change touched are new."""
    t = the_changes(spark, sf_dir)
    last = t.agg(F.max("mergedAt")).first()[0]
    since = F.lit(last) - F.expr("interval 30 days")
    seen = the_pr_modules(spark, sf_dir).join(t.select("pr", "mergedAt"), "pr").groupBy("path").agg(F.max("mergedAt").alias("latest"), F.min("mergedAt").alias("first"))
    seen = cut(seen)
    touched = seen.where(F.col("latest") >= since).select("path")
    mods = table(spark, sf_dir, "modules").select("path", "summary")
    before = mods.join(sized(seen.where(F.col("first") < since).select("path")), "path", "left_semi")
    return M.carry_forward(mods, before, sized(touched), "path", "summary")


def new_event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and kinds of the second half that the first half has not seen; errors always pass."""
    e = _events(spark, sf_dir)
    old, new = e.where("day(ts) <= 15"), e.where("day(ts) > 15")
    out = M.without_known(new, old, ["user_id", "event_type"], F.col("event_type") == "error")
    return out.select("event_id", "user_id", "event_type")


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and kind through a streaming aggregation."""
    work = f"{scratch_dir(spark)}/sextant-stream-{uuid.uuid4().hex}"
    out = E.run_to_table(E.by_day(E.read_events(spark, sf_dir)), f"{work}/out", f"{work}/state", "complete")
    return out.withColumn("value", F.round("value", 4))


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, through a streaming deduplication."""
    work = f"{scratch_dir(spark)}/sextant-stream-{uuid.uuid4().hex}"
    s = E.first_in_window(E.read_events(spark, sf_dir), ["event_id"], "365 days").select("event_id", "user_id", "event_type")
    return E.run_to_table(s, f"{work}/out", f"{work}/state")


QUERIES = {f.__name__: f for f in (stats_totals, stats_by_kind_zero_filled, stats_by_day, stats_recent30, trailing_days, last_value_per_user, dedup_events, demux_events, feedback_aggregate, feedback_recent50, valid_feedback, usage_rollup, running_total, status_rollup, answer_time_labels, cap_running_budget, greedy_pack, truncated_pack, commentable_lines, upsert_changes, carry_forward, new_event_keys, stream_daily_counts, stream_first_seen)}

_BY_DAY = "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"
_GEN = r"regexp_matches(x.f, 'package-lock\.json$|bun\.lock(b)?$|yarn\.lock$|pnpm-lock\.yaml$|composer\.lock$|\.min\.(js|css)$|^dist/|^build/')"
_FOLD = """WITH RECURSIVE {changes}, s AS (SELECT pr, list_transform(files, lambda x: x.add + x.del) AS l FROM changes WHERE len(files) > 0),
w(pr, l, i, used, lines, n) AS (SELECT pr, l, 1, 0::BIGINT, 0::BIGINT, 0 FROM s UNION ALL SELECT pr, l, i + 1, {used}, lines + {kept}, n + ({kept} > 0)::INT FROM w WHERE i <= len(l))
SELECT pr, lines AS kept_lines{more} FROM w WHERE i = len(l) + 1"""
SQL = {
    "stats_totals": "SELECT count(*) AS runs, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'click') AS clicks, round(sum(value), 4) AS value, round(coalesce(avg(value) FILTER (event_type <> 'error' AND value > 0), 0), 6) AS mean_value FROM events",
    "stats_by_kind_zero_filled": f"SELECT coalesce(event_type, k) AS event_type, coalesce(n, 0) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) FULL JOIN (SELECT unnest({KINDS}) AS k) ON k = event_type",
    "stats_by_day": _BY_DAY,
    "stats_recent30": "SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 30",
    "trailing_days": "SELECT user_id, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1",
    "last_value_per_user": "SELECT user_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "dedup_events": "SELECT event_id, user_id, event_type, ts::DATE AS day FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1 OR event_type = 'error'",
    "demux_events": f"SELECT event_id, CASE WHEN list_contains({KINDS}, event_type) THEN event_type ELSE 'other' END AS stream, (props->>'$.k')::BIGINT AS k FROM events",
    "feedback_aggregate": r"""WITH f AS (SELECT regexp_replace(trim("modulePath"), '^\./', '') AS module, lower(trim(coalesce(verdict, ''))) = 'up' AS up FROM feedback WHERE "modulePath" IS NOT NULL) SELECT module, count(*) FILTER (up) AS ups, count(*) FILTER (NOT up) AS downs, count(*) AS total FROM f GROUP BY 1""",
    "feedback_recent50": 'SELECT feedback_id, item_id, verdict FROM feedback ORDER BY "at" DESC NULLS LAST, feedback_id DESC LIMIT 50',
    "valid_feedback": """SELECT feedback_id, CASE WHEN coalesce(trim("taskText"), '') = '' THEN 'no text' WHEN coalesce(trim("modulePath"), '') = '' THEN 'no module' WHEN coalesce(lower(trim(verdict)), '') NOT IN ('up', 'down') THEN 'no verdict' ELSE 'ok' END AS state, substr(trim("taskText"), 1, 200) AS text FROM feedback""",
    "usage_rollup": "WITH d AS (SELECT coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, greatest(1, ceil(length(coalesce(text, '')) / 4))::BIGINT AS tokens FROM documents) SELECT coalesce(source, '(all)') AS source, coalesce(lang, '(all)') AS lang, grouping(source, lang) AS level, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ROLLUP (source, lang)",
    "running_total": "WITH d AS (SELECT coalesce(source, '(none)') AS source, created_at::TIMESTAMP::DATE AS day, sum(n_chars)::BIGINT AS chars FROM documents WHERE created_at IS NOT NULL GROUP BY ALL) SELECT source, day, chars, (sum(chars) OVER (PARTITION BY source ORDER BY day))::BIGINT AS so_far FROM d",
    "status_rollup": """WITH l AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS f, count(*) FILTER (l_linestatus = 'O') AS o, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) FILTER (l_returnflag = 'R') AS failing FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(total, 0) AS total, coalesce(failing, '') AS failing, CASE WHEN coalesce(total, 0) = 0 THEN 'none' WHEN f > 0 THEN 'failure' WHEN o > 0 THEN 'pending' ELSE 'success' END AS state FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "answer_time_labels": """WITH j AS (SELECT comment_id, (floor(epoch(c.created)) - floor(epoch(i.created)))::BIGINT AS seconds FROM jira_comments c JOIN jira_issues i USING (issue_id)), g AS (SELECT *, greatest(seconds, 0) AS s FROM j),
    p AS (SELECT comment_id, seconds, s, concat_ws(' ', CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd' END, CASE WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || 'h' END, CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || 'min' END) AS l FROM g)
    SELECT comment_id, seconds, CASE WHEN l = '' THEN (s % 60) || 's' ELSE l END AS label FROM p WHERE seconds IS NOT NULL""",
    "cap_running_budget": f"""WITH {CHANGES}, f AS (SELECT pr, unnest(files) AS x, generate_subscripts(files, 1) AS pos FROM changes), z AS (SELECT pr, pos, CASE WHEN {_GEN} THEN 0 ELSE x.add + x.del END AS n FROM f),
    c AS (SELECT *, sum(n) OVER (PARTITION BY pr ORDER BY pos) AS upto FROM z), k AS (SELECT *, CASE WHEN upto - n < 200 AND upto <= 200 THEN n ELSE 0 END AS kept FROM c)
    SELECT pr, sum(kept)::BIGINT AS kept_lines, count(*) FILTER (kept > 0) AS kept_files, sum(kept) < sum(n) AS truncated FROM k GROUP BY pr""",
    "greedy_pack": _FOLD.format(changes=CHANGES, used="used + CASE WHEN used + l[i] <= 100 THEN l[i] ELSE 0 END", kept="CASE WHEN used + l[i] <= 100 THEN l[i] ELSE 0 END", more=", n AS kept_files"),
    "truncated_pack": _FOLD.format(changes=CHANGES, used="least(used + l[i], 100)", kept="CASE WHEN used + l[i] <= 100 THEN l[i] ELSE greatest(greatest(100 - used, 0) - 5, 0) END", more=""),
    "commentable_lines": f"""WITH {CHANGES}, f AS (SELECT pr, unnest(files) AS x, generate_subscripts(files, 1) - 1 AS pos FROM changes) SELECT pr, pos, x.add + 1 AS n, pr % 50 + 1 AS first, pr % 50 + 1 + x.add AS last FROM f""",
    "upsert_changes": """WITH o AS (SELECT pr, max("jiraTitle") AS jt, max("issueType") AS it FROM task_index WHERE "jiraTitle" IS NULL AND pr IS NOT NULL GROUP BY 1), n AS (SELECT pr, max("jiraTitle") AS jt, max("issueType") AS it FROM task_index WHERE "jiraTitle" IS NOT NULL AND pr IS NOT NULL GROUP BY 1)
    SELECT coalesce(o.pr, n.pr) AS pr, coalesce(n.jt, o.jt) AS "jiraTitle", coalesce(n.it, o.it) AS "issueType", CASE WHEN o.pr IS NULL THEN 'inserted' WHEN n.pr IS NULL THEN 'kept' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.pr = n.pr""",
    "new_event_keys": "SELECT event_id, user_id, event_type FROM events e WHERE day(ts) > 15 AND (event_type = 'error' OR NOT EXISTS (SELECT 1 FROM events o WHERE day(o.ts) <= 15 AND o.user_id = e.user_id AND o.event_type = e.event_type))",
    "stream_daily_counts": _BY_DAY,
    "stream_first_seen": "SELECT event_id, user_id, event_type FROM events",
}
SQL["carry_forward"] = f"""WITH {CHANGES}, {MODULES}, t AS (SELECT DISTINCT path FROM pr_modules JOIN changes USING (pr) WHERE "mergedAt" >= (SELECT max("mergedAt") FROM changes) - INTERVAL 30 DAY),
    e AS (SELECT DISTINCT path FROM pr_modules JOIN changes USING (pr) WHERE "mergedAt" < (SELECT max("mergedAt") FROM changes) - INTERVAL 30 DAY),
    s AS (SELECT path, summary, CASE WHEN path NOT IN (SELECT path FROM e) THEN 'new' WHEN path IN (SELECT path FROM t) THEN 'dirty' ELSE 'kept' END AS state FROM modules) SELECT path, CASE WHEN state = 'kept' THEN summary END AS summary, state FROM s"""
