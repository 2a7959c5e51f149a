"""Filling containers of fixed capacity: hierarchical multi-length packing.

A text that exceeds the capacity is cut into full pieces and a rest, every other text stays whole.

1. Pieces are routed to tiers of context sizes: the capacity, a half, a quarter and so on; a piece goes to the
   smallest size that holds it.
2. Tiers are packed from the longest down. A piece first fills a gap that windows of longer tiers or its own have left,
   the tightest that takes it; where there is none, windows of the tier's own size are opened.
3. Windows are put together to containers of the full capacity, again best fit first, by how much they hold.
4. Containers are dealt to step groups in serpentine order of fill, so that groups are of even size.

All pieces of one length are alike to the packing, so it works on the histogram of lengths, which has at
most ``capacity`` entries however many texts there are; the result is a table of ranges ("the pieces of
length l with ranks a to b go to containers from c on"). Each piece finds its container by its rank among the
pieces of its length, a distributed step.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.ranking import rank_within
from sextant.runtime import cut


def tier_of(length: int, capacity: int, tiers: int) -> int:
    """0 for pieces over a half of the capacity, 1 for those over a quarter and so on; the last tier takes the rest."""
    t = 0
    while t < tiers - 1 and length * 2 <= capacity:
        capacity //= 2
        t += 1
    return t


def best_fit(histogram: dict[int, int], capacity: int, tiers: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Ranges (length, rank_from, rank_to, window_from) and groups of alike windows (first, count, fill, tier), by first window."""
    open_: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # room -> (first window, windows, tier, size)
    rooms: list[int] = []
    put: list[tuple[int, int, int, int]] = []
    n = 0

    def add(room: int, first: int, count: int, tier: int, size: int) -> None:
        if not open_[room]:
            bisect.insort(rooms, room)
        open_[room].append((first, count, tier, size))

    for length in sorted((x for x in histogram if x > 0), reverse=True):  # so tiers come from the longest down
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                tier = tier_of(length, capacity, tiers)
                size = capacity >> tier
                count = -(-left // (size // length))
                add(size, n, count, tier, size)
                n += count
                continue
            room = rooms[i]
            first, count, tier, size = open_[room].pop()
            if not open_[room]:
                rooms.pop(i)
            take = min(left, count)
            put.append((length, rank, rank + take, first))
            add(room - length, first, take, tier, size)
            if take < count:
                add(room, first + take, count - take, tier, size)
            left, rank = left - take, rank + take
    return put, sorted((first, count, size - room, tier) for room, groups in open_.items() for first, count, tier, size in groups)


def plan(histogram: dict[int, int], capacity: int, tiers: int = 4) -> tuple[list[tuple], int]:
    """Ranges (length, rank_from, rank_to, container_from, place_from, fill, tier) and the number of containers.

    ``tier`` is that of the window inside the container; ``place`` numbers all containers by falling fill.
    """
    put, windows = best_fit(histogram, capacity, tiers)
    held: dict[int, int] = defaultdict(int)
    for _, count, fill, _ in windows:
        held[fill] += count
    put_windows, containers = best_fit(held, capacity, 1)
    place, at = {}, 0
    for first, count, _, _ in sorted(containers, key=lambda g: (-g[2], g[0])):
        place[first] = at
        at += count
    firsts = [g[0] for g in containers]
    # where the windows of each fill go, cut where the groups of containers part
    goes: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # fill -> (rank_from, rank_to, container_from, group)
    for fill, a, b, container in put_windows:
        i = bisect.bisect_right(firsts, container) - 1
        while a < b:
            take = min(b - a, firsts[i] + containers[i][1] - container)
            goes[fill].append((a, a + take, container, i))
            a, container, i = a + take, container + take, i + 1
    segments: list[tuple[int, int, int, int, int]] = []  # (first window, windows, first container, group, tier), by first window
    seen: dict[int, int] = defaultdict(int)
    for first, count, fill, tier in windows:
        rank, end = seen[fill], seen[fill] + count
        k = bisect.bisect_right(goes[fill], rank, key=lambda g: g[0]) - 1
        while rank < end:
            a, b, container, i = goes[fill][k]
            take = min(b, end) - rank
            segments.append((first, take, container + rank - a, i, tier))
            first, rank, k = first + take, rank + take, k + 1
        seen[fill] = end
    starts = [g[0] for g in segments]
    out = []
    for length, a, b, window in put:  # cut each range where the segments part
        k = bisect.bisect_right(starts, window) - 1
        while a < b:
            first, count, container, i, tier = segments[k]
            take, container = min(b - a, first + count - window), container + window - first
            out.append((length, a, a + take, container, place[firsts[i]] + container - firsts[i], containers[i][2], tier))
            a, window, k = a + take, window + take, k + 1
    return out, sum(g[1] for g in containers)


def pack(sizes: DataFrame, specs: DataFrame, tiers: int = 4, step_windows: int = 8) -> DataFrame:
    """Where each piece of each text goes, for each row of ``specs``.

    ``sizes``: doc_id, n_tokens; ``specs``: spec_id, capacity_tokens (a few rows; those without a positive capacity
    are left out). Result: spec_id, capacity_tokens, container_id, doc_id, piece_no, token_start, n_tokens,
    container_tokens, tier, step_group. Texts of no tokens are spread over the windows (over one, if there is no
    other text). Repeated doc_ids are packed each on its own; a NULL size counts as 0. Without texts there are no rows.
    """
    spark = sizes.sparkSession
    caps = {r.spec_id: r.capacity_tokens for r in specs.where("spec_id is not null and capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().collect()}
    docs = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("size"))
    rows = [F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("int").alias("capacity")) for s, c in caps.items()]
    every = F.array(*rows) if rows else F.array().cast("array<struct<spec_id:int,capacity:int>>")
    each = docs.select("doc_id", "size", F.inline(every))
    whole = F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)).cast("bigint")
    pieces = each.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1))).withColumn("token_start", F.col("piece_no") * F.col("capacity"))
    pieces = cut(pieces.select("spec_id", "doc_id", "piece_no", "token_start", F.least(F.col("size") - F.col("token_start"), F.col("capacity").cast("bigint")).alias("n_tokens")))
    counted: dict[int, dict[int, int]] = {s: {} for s in caps}
    for r in pieces.groupBy("spec_id", "n_tokens").agg(F.count("*").alias("k")).collect():  # at most capacity + 1 rows a spec
        counted[r.spec_id][r.n_tokens] = r.k
    plans = {}
    for s, cap in caps.items():
        ranges, n = plan(counted[s], cap, tiers)
        starts, at = {}, 0
        for length in sorted(counted[s]):
            starts[length] = at
            at += counted[s][length]
        ranges.sort(key=lambda r: (r[0], r[1]))
        keys = np.array([starts[r[0]] + r[1] for r in ranges], dtype=np.int64)
        plans[s] = (keys, np.array(ranges, dtype=np.int64).reshape(-1, 7), np.array(sorted(starts)), np.array([starts[x] for x in sorted(starts)], dtype=np.int64), max(n, 1), cap)
    shared = spark.sparkContext.broadcast(plans)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, part in pdf.groupby("spec_id"):
                keys, ranges, lengths, starts, n, cap = shared.value[s]
                size, rank = part["n_tokens"].to_numpy(), part["rank"].to_numpy()
                steps = -(-n // step_windows)
                some = size > 0
                window, at, fill, tier = rank % n, rank % n, np.zeros(len(part), dtype=np.int64), np.full(len(part), tiers - 1)
                if some.any():
                    found = ranges[np.searchsorted(keys, starts[np.searchsorted(lengths, size[some])] + rank[some], side="right") - 1]
                    off = rank[some] - found[:, 1]
                    window[some], at[some], fill[some], tier[some] = found[:, 3] + off, found[:, 4] + off, found[:, 5], found[:, 6]
                turn, seat = at // steps, at % steps
                yield pd.DataFrame({"spec_id": s, "capacity_tokens": cap, "container_id": window, "doc_id": part["doc_id"], "piece_no": part["piece_no"], "token_start": part["token_start"], "n_tokens": size, "container_tokens": fill, "tier": tier, "step_group": np.where(turn % 2 == 0, seat, steps - 1 - seat)})

    schema = "spec_id int, capacity_tokens int, container_id bigint, doc_id bigint, piece_no bigint, token_start bigint, n_tokens bigint, container_tokens bigint, tier int, step_group bigint"
    out = rank_within(pieces, ["spec_id", "n_tokens"], ["doc_id", "piece_no"]).mapInPandas(place, schema)
    # empty texts lie in windows whose fill their own rows don't tell
    return out.withColumn("container_tokens", F.when(F.col("n_tokens") > 0, F.col("container_tokens"))).withColumn("tier", F.when(F.col("n_tokens") > 0, F.col("tier"))).withColumn("step_group", F.when(F.col("n_tokens") > 0, F.col("step_group")))


def report(packed: DataFrame) -> DataFrame:
    """One row per spec: texts, pieces, tokens, windows, the least number of windows possible, fill, and the spread of tokens over step groups."""
    windows = packed.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"), F.max("step_group").alias("step_group"))
    steps = windows.groupBy("spec_id", "step_group").agg(F.avg("tokens").alias("step_mean")).groupBy("spec_id").agg(F.min("step_mean").alias("least_step_mean"), F.max("step_mean").alias("most_step_mean"))
    out = windows.groupBy("spec_id", "capacity_tokens").agg(F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("n_tokens"), F.count("*").alias("n_containers"), F.max("tokens").alias("most_tokens"))
    least = F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    return out.join(steps, "spec_id").withColumn("least_containers", least).withColumn("fill", F.try_divide(F.col("n_tokens"), F.col("n_containers") * F.col("capacity_tokens")))
