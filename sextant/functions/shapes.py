"""Small expressions on text, numbers and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_label(seconds: Column) -> Column:
    """'2d 3h 5min'; seconds only where nothing larger is left; '0s' for none and below; NULL stays NULL."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0))
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    long = F.concat_ws(" ", part(d, "d"), part(h, "h"), part(m, "min"))
    return F.when(seconds.isNotNull(), F.when(long == "", F.concat((s % 60).cast("string"), F.lit("s"))).otherwise(long))


def clamp(c: Column, low: float, high: float) -> Column:
    """A number within bounds; what is no number counts as 0."""
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.coalesce(c.try_cast("double"), F.lit(0.0))))


def estimated_tokens(text: Column, least: int = 0) -> Column:
    """A fourth of the characters, rounded up, at least ``least``; NULL counts as empty."""
    return F.greatest(F.lit(least), F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("bigint")


def flag(c: Column) -> Column:
    """1, true or yes in any case; all else, NULL too, is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes"), F.lit(False))


def upsert_section(body: Column, content: Column, start: str, end: str) -> Column:
    """``body`` with the text between the markers replaced, or the marked section added at the end; a NULL body is empty."""
    b = F.coalesce(body, F.lit(""))
    block = F.concat(F.lit(start + "\n"), F.coalesce(content, F.lit("")), F.lit("\n" + end))
    i = F.locate(start, b)
    j = F.when(i > 0, F.expr("0") + F.locate(end, F.substring(b, i, F.length(b)))).otherwise(0)
    replaced = F.concat(F.substring(b, F.lit(1), i - 1), block, F.substring(b, i + j - 1 + len(end), F.length(b)))
    return F.when((i > 0) & (j > 0), replaced).when(F.trim(b) == "", block).otherwise(F.concat(F.rtrim(b), F.lit("\n\n"), block))


def replace_first(c: Column, pattern: str, to: str) -> Column:
    """Only the first match of a pattern is replaced."""
    return F.regexp_replace(c, f"(?s)^(.*?)(?:{pattern})", f"$1{to}")


def first_header(headers: Column, *names: str) -> Column:
    """The first non-empty value of a map under any of the names, whatever their case."""
    lower = F.transform_keys(headers, lambda k, v: F.lower(k))
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(lower, F.lit(n.lower()))), F.lit("")) for n in names))


def table_row(*cells: Column) -> Column:
    """A line of a Markdown table; bars inside cells are escaped, NULL is empty."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells)), F.lit(" |"))


def fixed_width(cells: list[tuple[Column, int]]) -> Column:
    """Text cells padded right, those with a negative width padded left."""
    return F.concat_ws(" ", *(F.rpad(F.coalesce(c.cast("string"), F.lit("")), w, " ") if w > 0 else F.lpad(F.coalesce(c.cast("string"), F.lit("")), -w, " ") for c, w in cells))


def diff_text(title: Column, files: Column, no_patch: str = "(no patch)") -> Column:
    """A change as text: its title, a blank line, then each file in order with its counts and its patch.

    ``files``: array of struct(f, status, add, del, patch), may be NULL or empty; a NULL status is left out, a file without
    a patch has the sign ``no_patch``.
    """
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")

    def block(x: Column) -> Column:
        marks = F.concat_ws(", ", x["status"], F.concat(F.lit("+"), number(x["add"]), F.lit("/-"), number(x["del"])))
        body = F.coalesce(F.nullif(x["patch"], F.lit("")), F.lit(no_patch))
        return F.concat(F.lit("### "), F.coalesce(x["f"], F.lit("")), F.lit(" ("), marks, F.lit(")\n"), body, F.lit("\n\n"))

    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(F.array_join(F.transform(files, block), ""), F.lit("")))


def fold_messages(messages: Column) -> Column:
    """struct(first_system, last_system, others, said) of an array of struct(role, content): the first and the last system message
    ('' if there is none), all other messages in order, and their contents joined by blank lines. NULL counts as empty.
    """
    system = F.filter(messages, lambda m: m["role"] == "system")
    others = F.filter(messages, lambda m: ~F.coalesce(m["role"] == "system", F.lit(False)))
    content = lambda m: F.coalesce(m["content"], F.lit(""))
    first, last = (F.coalesce(F.get(F.transform(system, content), at), F.lit("")) for at in (F.lit(0), F.size(system) - 1))
    said = F.coalesce(F.array_join(F.transform(others, content), "\n\n"), F.lit(""))
    return F.struct(first.alias("first_system"), last.alias("last_system"), others.alias("others"), said.alias("said"))
