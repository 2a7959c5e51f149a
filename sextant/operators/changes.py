"""The change history: one row per merged change, and what is derived from it."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.operators.paths import longest_prefix
from sextant.runtime import cut, literals, sized, skew_join

# What marks a version bump and a generated file.
BUMP_TITLE = r"(?iu)(?<![A-Za-z0-9_])(bump|update|upgrade|atualiza)(?![A-Za-z0-9_]).*(?<![A-Za-z0-9_])(package|pacote|composer|dependenc|versão|version)(?![A-Za-z0-9_])"
BUMP_BRANCH = r"(?i)(^|/)(update|bump)-"
#: What each title and branch of a bump holds, whatever its case; looked for before the patterns are tried.
BUMP_STEMS, BRANCH_STEMS = ("bump", "update", "upgrade", "atual"), ("update-", "bump-")
MANIFESTS = ("composer.json", "composer.lock", "package.json", "package-lock.json", "yarn.lock")
GENERATED = r"package-lock\.json$|bun\.lock(b)?$|yarn\.lock$|pnpm-lock\.yaml$|composer\.lock$|\.min\.(js|css)$|^dist/|^build/"
TICKET = r"[A-Z][A-Z0-9]+-\d+"

#: Most keys with several arrivals that are broadcast (a key only, no other columns).
TWICE = 500_000
#: Most module paths, times their depth, that are looked up as literals.
LITERAL_PATHS = 20_000


def latest(changes: DataFrame, key: str = "pr") -> DataFrame:
    """One row per ``key``: each column's value from the fullest arrival, the later one if equally full
    (then the one greater in its columns, in order).

    Only keys that came twice are merged, the others' rows stay where they are; with more than ``TWICE`` of them all rows are.
    Rows with a NULL key are left out.
    """
    rest = [c for c in changes.columns if c != key]
    filled = sum((F.col(c).isNotNull().cast("int") for c in rest), F.lit(0))
    whole = F.max(F.struct(filled.alias("_filled"), F.col("mergedAt").alias("_at"), *rest))  # one struct: as order and value of its own it would be moved twice
    return merge_repeated(changes, key, lambda d: d.groupBy(key).agg(whole.alias("_w")).select(key, *(F.col(f"_w.{c}").alias(c) for c in rest)))


def merge_repeated(rows: DataFrame, key: str, merged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``merged`` of the rows whose ``key`` comes several times; the others, which it would leave as they are, stay where they are.

    ``merged`` keeps the columns. With more than ``TWICE`` repeated keys all rows are merged. Rows with a NULL key are left out.
    """
    known = rows.where(F.col(key).isNotNull())
    twice = cut(known.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    if twice.count() > TWICE:
        return merged(known)
    once = known.join(F.broadcast(twice), key, "left_anti").select(key, *(c for c in rows.columns if c != key))
    return once.unionByName(cut(merged(known.join(F.broadcast(twice), key, "left_semi"))))


def is_bump(title: Column, jira_title: Column, branch: Column, key: Column, files: Column) -> Column:
    """A change that only raises the version of a dependency. Changes without files are none by their files."""
    manifests = F.size(F.filter(files, lambda x: F.lower(F.substring_index(x["f"], "/", -1)).isin(*MANIFESTS)))
    has = lambda text, stems: functools.reduce(operator.or_, (F.contains(F.lower(text), F.lit(s)) for s in stems))
    title, branch = F.coalesce(jira_title, title, F.lit("")), F.coalesce(branch, F.lit(""))
    n = F.size(files)
    by_files = (n > 0) & ((manifests >= 0.8 * n) | (key.isNull() & (n <= 2) & (manifests == n)))
    return F.coalesce((has(title, BUMP_STEMS) & title.rlike(BUMP_TITLE)) | (has(branch, BRANCH_STEMS) & branch.rlike(BUMP_BRANCH)) | by_files, F.lit(False))


def is_generated(path: Column) -> Column:
    return path.rlike(GENERATED)


def ticket_key(branch: Column, title: Column) -> Column:
    """First ticket key in branch or title; NULL if there is none."""
    return F.nullif(F.regexp_extract(F.concat_ws(" ", branch, title), TICKET, 0), F.lit(""))


def changed_lines(files: Column) -> Column:
    """Added and deleted lines over all files; 0 for no files."""
    return F.coalesce(F.aggregate(files, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["add"], F.lit(0)) + F.coalesce(x["del"], F.lit(0))), F.lit(0).cast("bigint"))


def change_modules(changes: DataFrame, modules: DataFrame) -> DataFrame:
    """(pr, path): the distinct modules that a change touches."""
    files = changes.select("pr", F.explode("files.f").alias("f")).where("pr is not null and f is not null").distinct()
    counted = cut(files.groupBy("f").agg(F.count("*").alias("n")))
    of = cut(longest_prefix(counted, modules).join(counted, "f"))
    return skew_join(files, of, "f", "n", counted.agg(F.sum("n")).first()[0] or 0).select("pr", "path").distinct()


def module_sets(changes: DataFrame, modules: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """pr, the columns ``keep`` and m, the sorted distinct modules that a change touches (NULL or empty for none); ``changes`` has one row per pr.

    The longest module above a file is looked up in the row, so nothing is moved; where there are too many modules for
    that, by joins.
    """
    paths = [r[0] for r in modules.select("path").where("path is not null").distinct().limit(LITERAL_PATHS + 1).collect()]
    depth = max((p.count("/") + 1 for p in paths), default=1)
    changes = changes.where("pr is not null")
    if len(paths) * depth > LITERAL_PATHS:
        sets = change_modules(changes, modules).groupBy("pr").agg(F.sort_array(F.collect_set("path")).alias("m"))
        return changes.select("pr", *keep).join(sets, "pr", "left")
    known = literals(paths)
    at = [f"CASE WHEN substring_index(f, '/', {k}) IN ({known}) THEN substring_index(f, '/', {k}) END" for k in range(depth, 0, -1)]
    return changes.select("pr", *keep, F.expr(f"array_sort(array_distinct(filter(transform(files.f, f -> coalesce({', '.join(at)}, NULL)), p -> p IS NOT NULL)))").alias("m"))


def cochange(pr_modules: DataFrame, min_support: int = 1) -> DataFrame:
    """(a, b, n_ab, n_a, conditional): how often b changes where a changes, for both directions of a pair; ``pr_modules``: pr, path."""
    return cochange_of(pr_modules.groupBy("pr").agg(F.sort_array(F.collect_set("path")).alias("m")), min_support)


def cochange_of(sets: DataFrame, min_support: int = 1) -> DataFrame:
    """``cochange`` of each change's sorted distinct modules ``m``. Pairs are made inside them and summed before the shuffle."""
    pairs = sets.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y")).groupBy("x", "y").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_support)
    both = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "n_ab").unionByName(pairs.select(F.col("y").alias("a"), F.col("x").alias("b"), "n_ab"))
    alone = sets.select(F.explode("m").alias("a")).groupBy("a").agg(F.count("*").alias("n_a"))
    return both.join(sized(alone), "a").withColumn("conditional", F.col("n_ab") / F.col("n_a"))


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first ``k`` rows of each group, with their place."""
    return df.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= k)


def representatives(changes: DataFrame, kept: tuple[str, ...] = ("pr", "title", "jiraTitle", "mergedAt", "files")) -> DataFrame:
    """One row per ticket key: its latest change (the higher pr at the same moment; its columns ``kept``) and the lines of all its changes.

    Aggregates combine before the shuffle, so an umbrella ticket is no heavy group. NULL keys are left out.
    """
    last = F.max_by(F.struct(*kept), F.struct("mergedAt", "pr"))
    one = changes.where("key is not null").groupBy("key").agg(last.alias("r"), F.sum(changed_lines(F.col("files"))).alias("lines"), F.count("*").alias("n_changes"))
    return one.select("key", "r.*", "lines", "n_changes")


def size_class(lines: Column) -> Column:
    """P under 150 lines, M up to 600, else G."""
    return F.when(lines < 150, "P").when(lines <= 600, "M").otherwise("G")


def newest_then(changes: DataFrame, order: list[Column], n: int, keep: Column) -> DataFrame:
    """Of the first ``n`` rows in ``order`` those that ``keep`` holds for: the limit comes before the filter. A top-n by partition, then one merge."""
    return changes.orderBy(*order).limit(n).where(keep)


def with_defaults(df: DataFrame, defaults: dict[str, str | int | float]) -> DataFrame:
    """``df`` with these values where a column is NULL; a column that is not there is added. Other columns stay as they are."""
    plain = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()}
    return df.withColumns(plain)
