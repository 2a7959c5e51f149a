"""JSON inside text, and rich-text trees."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
# Rich-text nodes whose children stand on lines of their own.
BLOCKS = ("doc", "paragraph", "heading", "bulletList", "orderedList", "listItem", "blockquote", "codeBlock", "panel", "table", "tableRow", "tableCell", "rule")


def _valid(text: str | None) -> str | None:
    try:
        json.loads(text) if text is not None else None
        return text
    except (ValueError, RecursionError):
        return None


def _balanced(text: str) -> str | None:
    """The first balanced {...}; braces in strings don't count."""
    at = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(at, len(text)) if at >= 0 else ():
        c = text[i]
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[at : i + 1]
    return None


def extract_json(c: str | Column) -> Column:
    """The JSON of a model's answer: the whole text, a fenced block, or the first balanced object in prose; else NULL."""

    def one(text):
        if text is None:
            return None
        fence = _FENCE.search(text)
        return _valid(text.strip() or None) or _valid(fence.group(1).strip() if fence else None) or _valid(_balanced(text))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(c)


def greedy_json(c: Column) -> Column:
    """From the first { to the last }; NULL if there are none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def _flatten(node, lines: bool) -> str:
    if not isinstance(node, dict):
        return node if isinstance(node, str) else ""

    def walk(n) -> str:
        if not isinstance(n, dict):
            return ""
        if isinstance(n.get("text"), str):
            return n["text"]
        kids = n.get("content")
        parts = [walk(k) for k in kids] if isinstance(kids, list) else []
        return ("\n" if lines and n.get("type") in BLOCKS else "").join(parts)

    return walk(node)


def flatten_rich_text(c: Column, lines: bool = True) -> Column:
    """The plain text of a rich-text tree given as JSON: children of block nodes on lines of their own (or, without ``lines``, run together). A JSON string is itself; NULL and other JSON give ''."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return _flatten(json.loads(t), lines) if t is not None else ""
            except (ValueError, RecursionError):
                return ""

        return texts.map(one)

    return run(c)


def non_blank_strings(c: Column) -> Column:
    """The non-blank strings of a JSON array; an empty array for anything else."""
    kept = F.filter(F.from_json(c, "array<string>"), lambda x: F.trim(x) != "")
    return F.coalesce(kept, F.array().cast("array<string>"))
