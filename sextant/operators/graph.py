"""Directed graphs: PageRank, neighbours, and references between source files."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.operators.changes import top_per
from sextant.operators.paths import ancestors, longest_prefix
from sextant.runtime import cut, drop_cut, sized, skew_join

#: Most nodes, and most edges, of a graph whose steps are taken as arrays in the driver.
SMALL_GRAPH = 20_000


def _small_page_rank(nodes: DataFrame, edges: DataFrame, steps: int, damping: float) -> DataFrame:
    """``page_rank`` of at most ``SMALL_GRAPH`` known nodes and edges: no job a step."""
    ids = [r[0] for r in nodes.select("id").collect()]
    at = {x: i for i, x in enumerate(ids)}
    ends = np.array([(at[r.src], at[r.dst]) for r in edges.select("src", "dst").collect()], dtype=int).reshape(-1, 2)
    n, deg = len(ids), np.bincount(ends[:, 0], minlength=len(ids))
    rank = np.full(n, 1.0 / max(n, 1))
    for _ in range(steps):
        part = rank / np.maximum(deg, 1)
        rank = (1 - damping + damping * rank[deg == 0].sum()) / max(n, 1) + damping * np.bincount(ends[:, 1], part[ends[:, 0]], minlength=n)
    return nodes.sparkSession.createDataFrame(list(zip(ids, map(float, rank))), T.StructType([nodes.schema["id"], T.StructField("rank", T.DoubleType())]))


def page_rank(nodes: DataFrame, edges: DataFrame, steps: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank) after exactly ``steps`` steps from an even start; nodes without out-edges spread their rank evenly.

    ``nodes``: id; ``edges``: src, dst. Repeated edges and self-loops are dropped, ends outside ``nodes`` too. Each step
    is one job over the edges whose result is written to the shared folder; sums are taken before the shuffle, and nodes
    that most edges leave from are joined apart from the others. A graph of few nodes and edges (``SMALL_GRAPH``, counted
    first) is walked in the driver. No nodes give no rows.
    """
    nodes = cut(nodes.select("id").where("id is not null").distinct())
    n = nodes.count()
    e = edges.select("src", "dst").where("src <> dst").distinct()
    known = sized(nodes)
    e = cut(e.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi"))
    m = e.count()
    if max(n, m) <= SMALL_GRAPH:
        return _small_page_rank(nodes, e, steps, damping)
    nodes = cut(nodes.join(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg")), "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg")))
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    lost = nodes.where("deg = 0").count() / max(n, 1)
    for i in range(steps):
        flow = skew_join(e, ranks.where("deg > 0").select(F.col("id").alias("src"), F.col("deg").alias("w"), (F.col("rank") / F.col("deg")).alias("part")), "src", "w", m, rows=n)
        into = flow.groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("into"))
        new = nodes.join(into, "id", "left").select("id", "deg", (F.lit((1 - damping + damping * lost) / max(n, 1)) + damping * F.coalesce("into", F.lit(0.0))).alias("rank"))
        seen = Observation()  # the rank of nodes without out-edges is summed while the step is written
        new = cut(new.observe(seen, F.sum(F.when(F.col("deg") == 0, F.col("rank")).otherwise(0.0)).alias("lost")))
        lost = seen.get["lost"] or 0.0
        if i:
            drop_cut(ranks)
        ranks = new
    return ranks.select("id", "rank")


def neighbours(edges: DataFrame, seeds: DataFrame, by: list[str]) -> DataFrame:
    """``by`` + id, links: nodes one step from a group's seeds in either direction, with the number of links; seeds themselves are left out.

    ``seeds``: ``by`` + id.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    s = sized(seeds.select(*by, F.col("id").alias("seed")).distinct())
    out = e.join(s, e.src == s.seed).select(*by, F.col("dst").alias("id"))
    into = e.join(s, e.dst == s.seed).select(*by, F.col("src").alias("id"))
    return out.unionByName(into).join(seeds.select(*by, "id").distinct(), [*by, "id"], "left_anti").groupBy(*by, "id").agg(F.count("*").alias("links"))


#: A run of letters of qualified PHP names.
_NAME = r"[\w\\]+"


def use_targets(content: Column) -> Column:
    """Names that a PHP file imports: ``use A\\B;``, ``use A\\B, C as D;``, ``use A\\{B, C as D};`` without aliases; functions and constants are none.

    The file is cut into statements; an import is one whose last lines begin with the word ``use`` at the margin. What follows
    is a list, whose members share what stands before a brace; the first name of each member counts.
    """
    first = lambda x: F.regexp_extract(x, _NAME, 0)
    statements = F.transform(F.slice(F.split(content, ";"), 1, F.greatest(F.size(F.split(content, ";")) - 1, F.lit(0))), lambda s: F.element_at(F.split(s, r"\n(?=use\s)"), -1))
    lists = F.transform(F.filter(statements, lambda s: s.rlike(r"\Ause\s")), lambda s: F.trim(F.regexp_replace(F.substring(s, 4, 1 << 30), r"\s+", " ")))

    def names(body: Column) -> Column:
        kind = F.substring_index(body, " ", 1)
        group = F.contains(body, F.lit("{"))
        head = F.when(group, F.concat(F.rtrim(F.trim(F.substring_index(body, "{", 1)), F.lit("\\")), F.lit("\\"))).otherwise("")
        members = F.split(F.when(group, F.substring_index(F.substring_index(body, "{", -1), "}", 1)).otherwise(body), ",")
        members = F.filter(F.transform(members, lambda m: F.trim(m)), lambda m: (first(m) != "") & ~F.substring_index(m, " ", 1).isin("function", "const"))
        return F.when(kind.isin("function", "const"), F.array().cast("array<string>")).otherwise(F.transform(members, lambda m: F.concat(head, first(m))))

    return F.flatten(F.transform(lists, names))


def body_references(content: Column) -> Column:
    """Full names ``App\\X\\Y`` (two parts or more after App) anywhere in a file, without a leading backslash."""
    runs = F.transform(F.regexp_extract_all(content, F.lit(_NAME), F.lit(0)), lambda x: F.trim(x, F.lit("\\")))
    return F.filter(runs, lambda x: F.startswith(x, F.lit("App\\")) & (F.size(F.split(x, r"\\+")) > 2))


def php_members(content: Column) -> Column:
    """struct(namespace, name, methods) of the first class, interface, trait or enum of a PHP file, NULL if it has none.

    Lines are cut into words; a declaration at the margin is a kind after modifiers only, a public method a line whose
    words are ``public``, perhaps ``static``, ``function`` and the name; constructors are left out.
    """
    modifiers, kinds = ("abstract", "final", "readonly"), ("class", "interface", "trait", "enum")
    lines = F.split(content, r"\r?\n")
    words = lambda x: F.filter(F.split(x, r"[\s(){;:]+"), lambda w: w != "")
    at_margin = F.transform(F.filter(lines, lambda x: x.rlike(r"^[a-z]")), words)
    declared = F.filter(F.transform(at_margin, lambda w: F.filter(w, lambda x: ~x.isin(*modifiers))), lambda w: (F.size(w) > 1) & F.get(w, F.lit(0)).isin(*kinds))
    spaces = F.filter(at_margin, lambda w: (F.size(w) > 1) & (F.get(w, F.lit(0)) == "namespace"))
    public = F.filter(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("(")) & F.contains(x, F.lit("function"))), words), lambda w: F.get(w, F.lit(0)) == "public")
    plain = F.filter(F.transform(public, lambda w: F.filter(w, lambda x: x != "static")), lambda w: F.get(w, F.lit(1)) == "function")
    methods = F.filter(F.transform(plain, lambda w: F.get(w, F.lit(2))), lambda m: m.isNotNull() & (m != "__construct"))
    name = F.get(F.get(declared, F.lit(0)), F.lit(1))
    return F.when(name.isNotNull(), F.struct(F.get(F.get(spaces, F.lit(0)), F.lit(1)).alias("namespace"), name.alias("name"), methods.alias("methods")))


def module_centrality(ranks: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, rank): the sum of the ranks of each module's files; files outside all modules add nothing.

    ``ranks``: id (a file's path), rank; ``modules``: path. A file counts for its longest matching module.
    """
    owner = longest_prefix(ranks.select(F.col("id").alias("f")), modules.select("path"))
    return ranks.join(owner.withColumnRenamed("f", "id"), "id").groupBy("path").agg(F.sum("rank").alias("rank"))


def resolve(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(fqcn, path): the file of a full name by its longest matching namespace prefix; no row if no prefix matches or nothing is left of the name.

    ``names``: fqcn; ``prefixes``: prefix, base_dir. Matched as an equality join on the ancestors of the name.
    """
    p = prefixes.select(F.regexp_replace("prefix", r"\\+$", "").alias("_p"), F.regexp_replace("base_dir", "/+$", "").alias("_d"))
    one = names.select("fqcn").where("fqcn is not null").distinct()
    hits = one.select("fqcn", F.explode(ancestors(F.col("fqcn"), "\\")).alias("_p")).join(sized(p), "_p")
    best = hits.groupBy("fqcn").agg(F.max_by(F.struct("_p", "_d"), F.length("_p")).alias("b"))
    left = F.expr("substring(fqcn, length(b._p) + 2)")
    return best.where(left != "").select("fqcn", F.concat(F.col("b._d"), F.lit("/"), F.replace(left, F.lit("\\"), F.lit("/")), F.lit(".php")).alias("path"))


def code_graph(files: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, counts): edges src -> dst between the paths of ``files`` (path, content); counts: total_refs and unresolved.

    A file's reference counts once for each distinct name; self-references make no edge.
    """
    refs = files.select("path", F.explode(F.array_union(use_targets(F.col("content")), body_references(F.col("content")))).alias("raw")).distinct()
    refs = refs.withColumn("fqcn", F.regexp_replace("raw", r"^\\", ""))
    found = refs.join(resolve(refs, prefixes).withColumnRenamed("path", "dst"), "fqcn", "left")
    found = found.join(files.select(F.col("path").alias("dst"), F.lit(True).alias("known")).distinct(), "dst", "left")
    counts = found.agg(F.count("*").alias("total_refs"), F.count_if(F.col("known").isNull()).alias("unresolved"))
    return found.where("known and path <> dst").select(F.col("path").alias("src"), "dst").distinct(), counts


_PUBLIC = re.compile(r"\bpublic\b[^;{}()]*\bfunction\b[^;{]*\{")
_BRACE = re.compile(r"[{}]")


def public_members(content: Column, most: int = 4000, marker: str = "\n/* ... */") -> Column:
    """The public functions of a source text with their bodies, parted by blank lines, until ``most`` characters are reached.

    The one that exceeds them is cut and marked; a body that does not end is left out, as are functions inside a body that was
    taken. NULL and texts without public functions give ''.
    """

    def end_of(text: str, start: int) -> int | None:
        depth = 0
        for brace in _BRACE.finditer(text, start):
            depth += 1 if brace[0] == "{" else -1
            if not depth:
                return brace.end()
        return None

    def members(text: str | None) -> str:
        parts, used, at = [], 0, 0
        while used < most and (head := _PUBLIC.search(text or "", at)):
            end = end_of(text, head.end() - 1)
            if end is not None:
                body = text[head.start() : end]
                parts.append(body if len(body) <= most - used else body[: most - used] + marker)
                used += len(parts[-1])
            at = end or head.end()
        return "\n\n".join(parts)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(members)

    return run(content)


def module_classes(owners: DataFrame, contents: DataFrame) -> DataFrame:
    """(path, f, namespace, name, methods): the classes of each module's PHP files; files without content or class have no row.

    ``owners``: f, path (see ``longest_prefix``); ``contents``: f, content.
    """
    php = contents.where(F.endswith("f", F.lit(".php"))).select("f", php_members(F.col("content")).alias("c")).where("c is not null")
    return owners.join(php, "f").select("path", "f", "c.*")


def module_blocks(classes: DataFrame, files: DataFrame, most_classes: int = 8, most_methods: int = 6) -> DataFrame:
    """(path, block): a text for each module of ``files`` (f, path): its path, its number of files and its classes with the most methods.

    Classes with equally many methods come by file name. Modules without classes have the first two lines only.
    """
    first = top_per(classes.withColumn("m", F.size("methods")), ["path"], [F.desc("m"), F.col("f")], most_classes)
    # The words of a module's lines.
    shown = F.coalesce(F.nullif(F.array_join(F.slice("methods", 1, most_methods), ", "), F.lit("")), F.lit("sem métodos públicos"))
    line = F.concat(F.lit("  CLASSE: "), F.coalesce(F.concat("namespace", F.lit("\\")), F.lit("")), "name", F.lit(" ("), shown, F.lit(")"))
    lines = first.withColumn("line", line).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    counts = files.groupBy("path").agg(F.count_distinct("f").alias("n"))
    block = F.concat_ws("\n", F.concat(F.lit("MODULE_PATH: "), "path"), F.concat(F.lit("FILES: "), F.col("n").cast("string")), "lines")
    return counts.join(lines, "path", "left").select("path", block.alias("block"))
