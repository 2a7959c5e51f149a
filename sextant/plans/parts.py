"""Pieces of SQL that several queries share, and the frames they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.text import STOP_WORDS
from sextant.operators import changes as C
from sextant.runtime import cut, table

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_tokens(expr: str) -> str:
    return f"list_filter(regexp_extract_all(strip_accents(lower({expr})), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([{_STOP}], w))"


#: One row per pr, as operators.changes.latest: the fullest arrival, then the later.
CHANGES = """changes AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY
  (key IS NOT NULL)::INT + (title IS NOT NULL)::INT + ("mergedAt" IS NOT NULL)::INT + (branch IS NOT NULL)::INT + (files IS NOT NULL)::INT + ("jiraTitle" IS NOT NULL)::INT + ("issueType" IS NOT NULL)::INT DESC,
  "mergedAt" DESC NULLS LAST, key DESC NULLS LAST, title DESC NULLS LAST, branch DESC NULLS LAST, files DESC NULLS LAST, "jiraTitle" DESC NULLS LAST, "issueType" DESC NULLS LAST) AS rn FROM task_index WHERE pr IS NOT NULL) WHERE rn = 1)"""

#: Modules by file and by change.
MODULES = """pr_files AS (SELECT DISTINCT pr, unnest(files).f AS f FROM changes),
file_module AS (SELECT f, arg_max(path, length(path)) AS path FROM (SELECT DISTINCT f FROM pr_files WHERE f IS NOT NULL) x
  JOIN (SELECT DISTINCT path FROM modules WHERE path IS NOT NULL) m ON x.f = m.path OR starts_with(x.f, m.path || '/') GROUP BY f),
pr_modules AS (SELECT DISTINCT pr, path FROM pr_files JOIN file_module USING (f))"""

PAIRS = """pair AS (SELECT p.path AS a, q.path AS b, count(*) AS n_ab FROM pr_modules p JOIN pr_modules q ON p.pr = q.pr AND p.path <> q.path GROUP BY 1, 2),
alone AS (SELECT path AS a, count(*) AS n_a FROM pr_modules GROUP BY 1),
cochange AS (SELECT a, b, n_ab, n_a, n_ab / n_a AS conditional FROM pair JOIN alone USING (a))"""

NEIGHBOURS = """near AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(conditional, 9) DESC, b) AS place FROM cochange),
neighbours AS (SELECT * FROM near WHERE place <= 8)"""

BUMP = """(coalesce(regexp_matches(strip_accents(lower(coalesce("jiraTitle", title, ''))), '(^|[^a-z0-9_])(bump|update|upgrade|atualiza)($|[^a-z0-9_]).*(package|pacote|composer|dependenc|versao|version)'), false) AND
  regexp_matches(strip_accents(lower(coalesce("jiraTitle", title, ''))), '(^|[^a-z0-9_])(bump|update|upgrade|atualiza)($|[^a-z0-9_])(.*[^a-z0-9_])?(package|pacote|composer|dependenc|versao|version)($|[^a-z0-9_])'))
  OR regexp_matches(lower(coalesce(branch, '')), '(^|/)(update|bump)-')
  OR coalesce(len(files) > 0 AND (len(list_filter(files, lambda x: regexp_matches(lower(x.f), '(^|/)(composer\\.(json|lock)|package(-lock)?\\.json|yarn\\.lock)$'))) >= 0.8 * len(files)
    OR (key IS NULL AND len(files) <= 2 AND len(list_filter(files, lambda x: regexp_matches(lower(x.f), '(^|/)(composer\\.(json|lock)|package(-lock)?\\.json|yarn\\.lock)$'))) = len(files))), false)"""


def the_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest(table(spark, sf_dir, "task_index"))


def the_module_sets(spark: SparkSession, sf_dir: str, changes: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    return cut(C.module_sets(the_changes(spark, sf_dir) if changes is None else changes, table(spark, sf_dir, "modules"), keep))


def the_pr_modules(spark: SparkSession, sf_dir: str, changes: DataFrame | None = None) -> DataFrame:
    return the_module_sets(spark, sf_dir, changes).select("pr", F.explode("m").alias("path"))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def without_bumps(changes: DataFrame) -> DataFrame:
    return changes.where(~C.is_bump(*(F.col(c) for c in ("title", "jiraTitle", "branch", "key", "files"))))
