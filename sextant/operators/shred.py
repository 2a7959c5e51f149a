"""Deeply nested records into flat tables: columnar shredding with repetition and definition levels.

``shred`` turns each JSON document into columns, one for each leaf path, in which an array step of the
path is a NULL. A column holds, in document order, one entry for each place where its leaf could be:
the repetition level (at which array step of the path a new element began; 0 starts a document), the
definition level (how many steps of the path exist there) and the value. Array elements have a column
of their own that tells their JSON type, so arrays of mixed types and empty objects keep their shape.

``objects`` and ``values`` rebuild flat tables from the level sequences alone: the index at array step
``j`` counts the entries that repeat at ``j`` since the last that repeats further out.

Both directions are narrow: no shuffle, one pass, batches through Arrow.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = "record_id bigint, issue_no int, issue_key string, steps array<string>, is_type boolean, reps array<int>, defs array<int>, vals array<string>"
_OBJECT, _ARRAY, _NULL = "object", "array", "null"


class _Node:
    """What was seen at one path: members, elements, scalars."""

    __slots__ = ("element", "members", "scalar", "steps", "typed", "types", "values")

    def __init__(self, steps: tuple, typed: bool):
        self.steps, self.typed, self.members, self.element, self.scalar = steps, typed, {}, None, False
        self.types, self.values = ([], [], []), ([], [], [])

    def see(self, value) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                if k not in self.members:
                    self.members[k] = _Node((*self.steps, k), False)
                self.members[k].see(v)
        elif isinstance(value, list):
            if self.element is None:
                self.element = _Node((*self.steps, None), True)
            for x in value:
                self.element.see(x)
        elif value is not None:
            self.scalar = True

    def put(self, value, there: bool, rep: int, level: int, depth: int) -> None:
        """Append what is at this path, or that nothing is, to this column and all below it."""
        if self.typed:
            kind = _OBJECT if isinstance(value, dict) else _ARRAY if isinstance(value, list) else _NULL if value is None else "scalar"
            _append(self.types, rep, level, kind if there else None)
        if self.scalar:
            is_leaf = there and value is not None and not isinstance(value, (dict, list))
            _append(self.values, rep, level if is_leaf else min(level, len(self.steps) - 1), _text(value) if is_leaf else None)
        for k, child in self.members.items():
            found = isinstance(value, dict) and value.get(k) is not None
            child.put(value[k] if found else None, found, rep, level + found, depth)
        if self.element is not None:
            if isinstance(value, list) and value:
                for i, x in enumerate(value):
                    self.element.put(x, True, rep if i == 0 else depth + 1, level + 1, depth + 1)
            else:
                self.element.put(None, False, rep, level, depth + 1)

    def columns(self) -> Iterator[tuple]:
        if self.typed:
            yield self.steps, True, self.types
        if self.scalar:
            yield self.steps, False, self.values
        for child in [*self.members.values(), *([self.element] if self.element is not None else [])]:
            yield from child.columns()


def _append(column: tuple, rep: int, level: int, value) -> None:
    column[0].append(rep)
    column[1].append(level)
    column[2].append(value)


def _clean(s: str) -> str:
    return s if s.isascii() else s.encode("utf-8", "replace").decode()  # a lone surrogate can't be stored


def _text(value) -> str:
    return _clean(value) if isinstance(value, str) else json.dumps(value)


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def _issues(text: str | None, shape: str | None) -> list:
    try:
        doc = json.loads(text, parse_constant=_refuse) if text is not None else None
    except (ValueError, RecursionError):
        return []
    if shape == "search":
        doc = doc.get("issues") if isinstance(doc, dict) else None
        return doc if isinstance(doc, list) else []
    return [doc]


def shred(df: DataFrame, roots: list[str], typed_roots: tuple[str, ...] = ()) -> DataFrame:
    """Columns of all documents below ``fields.<root>``: one row per document, issue and leaf path (schema ``LEVELS``).

    ``df`` needs record_id, shape ('issue': the document is an issue; 'search': its member ``issues`` lists them)
    and payload. NULL payloads, text that isn't valid JSON (also NaN, cut-off text, nesting beyond the parser's
    limit) and anything that has not the shape give no rows. Of a member named twice the last counts.
    ``typed_roots``: roots that get a type column although they are no array elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the walks below use one Python frame a level and no C stack, so what the parser reads may be walked
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 400_000))
        schema = pa.schema([("record_id", pa.int64()), ("issue_no", pa.int32()), ("issue_key", pa.string()), ("steps", pa.list_(pa.string())), ("is_type", pa.bool_()), ("reps", pa.list_(pa.int32())), ("defs", pa.list_(pa.int32())), ("vals", pa.list_(pa.string()))])
        for batch in batches:
            rows = []
            for rid, shape, text in zip(*(batch.column(c).to_pylist() for c in ("record_id", "shape", "payload"))):
                for no, issue in enumerate(_issues(text, shape)):
                    fields = issue.get("fields") if isinstance(issue, dict) else None
                    if not isinstance(fields, dict):
                        continue
                    key = issue.get("key")
                    key = _clean(key) if isinstance(key, str) else None
                    for root in roots:
                        value = fields.get(root)
                        if value is None:
                            continue
                        node = _Node((root,), root in typed_roots)
                        node.see(value)
                        node.put(value, True, 0, 1, 0)
                        rows += [(rid, no, key, [s if s is None else _clean(s) for s in steps], typed, *column) for steps, typed, column in node.columns()]
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return df.select(F.col("record_id").cast("bigint"), F.col("shape").cast("string"), F.col("payload").cast("string")).mapInArrow(run, LEVELS)


def indexes(reps: np.ndarray, depth: int) -> np.ndarray:
    """The index at each of ``depth`` array steps, for each entry, from the repetition levels of whole columns laid end to end."""
    at = np.arange(len(reps))
    out = np.zeros((len(reps), depth), dtype=np.int64)
    for j in range(1, depth + 1):
        steps = np.cumsum(reps == j)
        start = np.maximum.accumulate(np.where(reps < j, at, 0))
        out[:, j - 1] = steps - steps[start]
    return out


def _path(steps: list, index) -> str:
    parts, k = [], 0
    for s in steps:
        if s is None:
            parts.append(f"[{index[k]}]")
            k += 1
        else:
            parts.append(f".{s}" if parts else s)
    return "".join(parts)


def _owner(steps: list, typed_roots: tuple[str, ...]) -> int:
    """How many steps name the nearest object around these steps that is an array element or a typed root; 0 if there is none.

    Steps end below that object: at a member of it, or at arrays below the member.
    """
    n = len(steps)
    while n and steps[n - 1] is None:
        n -= 1
    n -= 1  # the member itself
    while n > 0 and steps[n - 1] is not None:
        n -= 1
    return n or int(len(steps) > 1 and steps[0] in typed_roots and steps[1] is not None)


def _assemble(levels: DataFrame, want_types: bool, names: list[str], make) -> DataFrame:
    """Rebuild rows from the columns: ``make(steps, index, value)`` gives the row of an entry that exists, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.int64()), ("issue_no", pa.int32()), ("issue_key", pa.string())] + [(n, pa.string()) for n in names])
        for batch in batches:
            rows = []
            cols = {c: batch.column(c).to_pylist() for c in ("record_id", "issue_no", "issue_key", "steps", "vals")}
            offsets = batch.column("reps").offsets.to_numpy()
            flat = batch.column("reps").flatten().to_numpy()
            defs = batch.column("defs").flatten().to_numpy()
            base = offsets[0]
            for i, steps in enumerate(cols["steps"]):
                a, b = offsets[i] - base, offsets[i + 1] - base
                index = indexes(flat[a:b], sum(s is None for s in steps))
                head = (cols["record_id"][i], cols["issue_no"][i], cols["issue_key"][i])
                for e in np.flatnonzero(defs[a:b] == len(steps)):
                    row = make(steps, index[e], cols["vals"][i][e])
                    if row is not None:
                        rows.append((*head, *row))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    chosen = levels.where(F.col("is_type") if want_types else ~F.col("is_type"))
    return chosen.mapInArrow(run, "record_id bigint, issue_no int, issue_key string, " + ", ".join(f"{n} string" for n in names))


def objects(levels: DataFrame, typed_roots: tuple[str, ...] = ()) -> DataFrame:
    """One row per object that is an array element (or a typed root): record_id, issue_no, issue_key, node_path, parent_path, table_path.

    ``table_path`` is the path without positions: the rows that share it are one flat table.
    """

    def make(steps, index, value):
        if value != _OBJECT:
            return None
        n = _owner(steps, typed_roots)
        return _path(steps, index), _path(steps[:n], index), _path(["[]" if s is None else s for s in steps], ()).replace(".[]", "[]")

    return _assemble(levels, True, ["node_path", "parent_path", "table_path"], make)


def values(levels: DataFrame, typed_roots: tuple[str, ...] = ()) -> DataFrame:
    """One row per scalar: record_id, issue_no, issue_key, node_path (the object it belongs to, '' if none), name (its path below that), value."""

    def make(steps, index, value):
        n = _owner(steps, typed_roots)
        return _path(steps[:n], index), _path(steps[n:], index[sum(s is None for s in steps[:n]) :]), value

    return _assemble(levels, False, ["node_path", "name", "value"], make)


def widen(vals: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The objects of ``table`` with some of their scalars as columns: {name below the object: column}."""
    keys = ["record_id", "issue_no", "node_path"]
    picked = vals.where(F.col("name").isin(*columns)).groupBy(*keys).agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(c) for n, c in columns.items()))
    return table.join(picked, keys, "left")
