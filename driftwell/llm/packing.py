"""Containers of fixed capacity filled with documents by a linear grouping scheme (problem 8).

The plan is made from the HISTOGRAM of sizes (at most ``capacity`` rows, whatever the number of
documents) and never sees a document:

1. a document longer than the capacity is split into full containers and one rest; all other
   documents and the rests are pieces of 1..capacity tokens; documents without tokens go nowhere;
2. large pieces (over ``small`` tokens) are put, by size, into groups of equal cardinality and
   rounded up to the largest size of their group: few sizes remain;
3. the configurations of those few sizes are optimised: a linear program over all multisets of
   sizes that fit, solved by column generation (a knapsack finds the best new configuration);
   its rounded-down solution is used, the remaining pieces are first-fit-decreasing;
4. the actual sizes replace the rounded ones, which frees room;
5. the small pieces are put, largest first, into the container with the least room that takes them,
   then into new ones.

Containers of like content are kept as one line (content, how many), so all steps are bounded by the
number of sizes. A piece then finds its container by its rank among the pieces of its size: ranks
are made by a two-level count (per partition of the input, then offsets), so a size that a third of
all documents share is never collected into one task, and the plan's lines are joined by a range
of ranks.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.joins import spread_join
from driftwell.session import cut_lineage

CAPACITY = 2048
#: Pieces up to capacity / SMALL_SHARE tokens are filled into the room that the large ones leave.
SMALL_SHARE = 8
#: Number of groups that the large pieces are rounded to.
GROUPS = 48
#: Slices that the pieces of one size are ranked in; bounds what one task ranks and the offsets table.
BUCKETS = 256


def rounded(sizes: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(size, count) in falling order -> groups of about equal cardinality, each in falling order."""
    total, out, room = sum(n for _, n in sizes), [], 0
    each = -(-total // groups) if total else 1
    for size, n in sizes:
        while n:
            if not room:
                out.append([])
                room = each
            take = min(n, room)
            out[-1].append((size, take))
            n, room = n - take, room - take
    return out


def best_pattern(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Multiset of *sizes* of the greatest value that fits: an unbounded knapsack by dynamic programming."""
    size = np.array(sizes)
    pad = int(size.max())
    best, choice = np.full(pad + capacity + 1, -np.inf), np.full(capacity + 1, -1)  # best[pad + room]
    best[pad : pad + int(size.min())] = 0.0
    for room in range(int(size.min()), capacity + 1):
        worth = best[pad + room - size] + value
        k = int(worth.argmax())
        if worth[k] > best[pad + room - 1] + 1e-12:
            best[pad + room], choice[room] = worth[k], k
        else:
            best[pad + room] = best[pad + room - 1]
    pattern, room = [0] * len(sizes), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[pad + capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(pattern, times): the linear program's optimum, rounded down. Patterns never overdraw the demand.

    Columns are generated until none saves anything; only a row of 4 rounds a size without any gain (a degenerate
    cycle) ends it before.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    b = np.array(demand, dtype=float)
    x = b / np.diag(basis)
    least, idle = np.inf, 0
    while idle < 4 * m:
        idle = 0 if x.sum() < least - 1e-9 else idle + 1
        least = min(least, float(x.sum()))
        inverse = np.linalg.inv(basis)
        prices = np.ones(m) @ inverse
        value, pattern = best_pattern(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-5:  # a better configuration would save less than the rounding loses
            break
        direction = inverse @ np.array(pattern, dtype=float)
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(np.argmin(ratios))
        if not np.isfinite(ratios[leave]):
            break
        basis[:, leave] = pattern
        x = np.maximum(np.linalg.solve(basis, b), 0)
    return [([int(v) for v in basis[:, k]], int(x[k] + 1e-9)) for k in range(m) if int(x[k] + 1e-9) > 0]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_share: int = SMALL_SHARE) -> list[tuple[tuple[int, ...], int]]:
    """(sizes in one container, how many such containers) for size -> number of pieces.

    All pieces are used exactly once; no container exceeds the capacity.
    """
    limit = capacity // small_share
    large = sorted(((s, n) for s, n in histogram.items() if s > limit and n), reverse=True)
    grouped = rounded(large, groups)
    tops = [g[0][0] for g in grouped]
    left = [sum(n for _, n in g) for g in grouped]
    lines: list[tuple[list[int], int]] = []  # (groups of the slots, times)
    for pattern, times in configurations(tops, left, capacity):
        lines.append(([k for k, c in enumerate(pattern) for _ in range(c)], times))
        for k, c in enumerate(pattern):
            left[k] -= c * times
    while any(left):  # what rounding down left over: first fit, decreasing, in runs
        room, slots, need = capacity, [], defaultdict(int)
        for k, top in enumerate(tops):
            while need[k] < left[k] and top <= room:
                need[k] += 1
                room -= top
                slots.append(k)
        times = min(left[k] // need[k] for k in need if need[k])
        for k, c in need.items():
            left[k] -= c * times
        lines.append((slots, times))
    # actual sizes for rounded ones: the slots of a line take runs of equal sizes
    stock = [[list(x) for x in g] for g in grouped]
    open_: dict[tuple[int, ...], int] = defaultdict(int)
    for slots, times in lines:
        while times:
            heads = defaultdict(int)
            for k in slots:
                heads[k] += 1
            run, content = times, []
            for k, c in heads.items():
                size, n = stock[k][0]
                if n >= c:
                    run = min(run, n // c)
                    content += [(k, size, c)]
                else:  # the last few of a size: one container takes them with the next size
                    run = 1
                    content += [(k, size, n)]
                    need = c - n
                    for s, a in stock[k][1:]:
                        take = min(a, need)
                        content.append((k, s, take))
                        need -= take
                        if not need:
                            break
            for k, size, c in content:
                row = next(r for r in stock[k] if r[0] == size)
                row[1] -= c * run
            for k in heads:
                stock[k] = [r for r in stock[k] if r[1]]
            open_[tuple(sorted((s for _, s, c in content for _ in range(c)), reverse=True))] += run
            times -= run
    # small pieces: largest first, into the least room that takes them
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for content, times in open_.items():
        by_room[capacity - sum(content)][content] += times
    for size in sorted((s for s, n in histogram.items() if 0 < s <= limit and n), reverse=True):
        n = histogram[size]
        while n:
            room = min((r for r in by_room if r >= size), default=None)
            if room is None:
                by_room[capacity][()] += -(-n // (capacity // size))
                room = capacity
            content, times = next(iter(by_room[room].items()))
            fill = room // size
            whole = min(times, n // fill)
            used, put = (whole, fill) if whole else (1, n)
            by_room[room][content] -= used
            if not by_room[room][content]:
                del by_room[room][content]
            if not by_room[room]:
                del by_room[room]
            by_room[room - put * size][content + (size,) * put] += used
            n -= used * put
    return [(content, times) for rooms in by_room.values() for content, times in rooms.items() if content]


def ranges(lines: list[tuple[tuple[int, ...], int]], first: int) -> pd.DataFrame:
    """Rank ranges: pieces of *size* with ranks from *start* go, *per* at a time, into *container* onwards."""
    used, rows, container = defaultdict(int), [], first
    for content, times in sorted(lines, key=lambda x: (x[0], x[1]), reverse=True):
        at = 0
        for size in sorted(set(content), reverse=True):
            per = content.count(size)
            rows.append((size, used[size], used[size] + per * times, per, container, at))
            used[size] += per * times
            at += per * size
        container += times
    return pd.DataFrame(rows, columns=["size", "start", "stop", "per", "container", "at"]).astype("int64")


def pack(counts: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """key, piece, piece_tokens, container, position of every piece of every row with tokens.

    counts: one row for each document, with its number of tokens. piece counts from 0 (always 0 for
    a document that fits); position is the token in the container at which the piece begins. Null,
    zero and negative sizes go nowhere. Equal keys are separate documents.
    """
    spark = counts.sparkSession
    buckets = max(BUCKETS, counts.rdd.getNumPartitions())  # a slice holds what one task read, however large the table
    rows = counts.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("n")).filter("n > 0")
    rows = rows.select("key", ((F.col("n") - 1) % capacity + 1).alias("rest"), F.floor((F.col("n") - 1) / capacity).cast("bigint").alias("full"), (F.spark_partition_id() % buckets).alias("bucket"), F.monotonically_increasing_id().alias("row"))
    inside = Window.partitionBy("bucket", "rest").orderBy("row")
    ranked = rows.select("key", "rest", "full", "bucket", (F.row_number().over(inside) - 1).cast("bigint").alias("rank"), (F.sum("full").over(inside) - F.col("full")).alias("full_rank"))
    # sizes are expensive to count and ranks must stay the same in both passes: written once
    ranked = cut_lineage(ranked)
    slices = ranked.groupBy("bucket", "rest").agg(F.count("*").alias("pieces"), F.sum("full").alias("fulls"))
    histogram = slices.groupBy("rest").agg(F.sum("pieces").alias("pieces"), F.sum("fulls").alias("fulls")).orderBy("rest").collect()  # at most capacity rows
    total = sum(r.fulls for r in histogram)
    lines = ranges(plan({r.rest: r.pieces for r in histogram}, capacity, groups), total)
    bases, at = [], 0
    for r in histogram:
        bases.append((r.rest, at))
        at += r.fulls
    base = spark.createDataFrame(bases, "rest bigint, base bigint")
    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offsets = slices.join(base, "rest").select("bucket", "rest", F.coalesce(F.sum("pieces").over(before), zero).alias("offset"), (F.coalesce(F.sum("fulls").over(before), zero) + F.col("base")).alias("full_offset"))
    table = spark.createDataFrame([tuple(map(int, r)) for r in lines.itertuples(index=False)], "size bigint, start bigint, stop bigint, per bigint, container bigint, at bigint")
    # a size has a few hundred ranges at most: they travel as one array a size
    by_size = table.groupBy(F.col("size").alias("rest")).agg(F.collect_list(F.struct("start", "stop", "per", "container", "at")).alias("lines"))
    # the ranges are bounded by the capacity, the offsets by slices x capacity: broadcast as long as they are small
    placed = spread_join(ranked, offsets, ["bucket", "rest"], "inner", ["key", "rank"]).join(F.broadcast(by_size), "rest")
    placed = placed.withColumn("nth", F.col("rank") + F.col("offset"))
    placed = placed.withColumn("line", F.expr("filter(lines, l -> nth >= l.start and nth < l.stop)[0]"))
    last = placed.select(
        F.col("key").alias(key),
        F.col("full").cast("int").alias("piece"),
        F.col("rest").alias("piece_tokens"),
        (F.col("line.container") + F.floor((F.col("nth") - F.col("line.start")) / F.col("line.per"))).cast("bigint").alias("container"),
        (F.col("line.at") + (F.col("nth") - F.col("line.start")) % F.col("line.per") * F.col("rest")).alias("position"),
    )
    first = F.col("full_offset") + F.col("full_rank")
    split = placed.filter("full > 0").select(F.col("key").alias(key), F.posexplode(F.sequence(first, first + F.col("full") - 1)).alias("piece", "container"))
    split = split.select(key, "piece", F.lit(capacity).cast("bigint").alias("piece_tokens"), "container", zero.alias("position"))
    return last.unionByName(split)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers there could be, share of room used."""
    # per container first: the totals are then over one row a container
    each = packed.groupBy("container").agg(F.sum("piece_tokens").alias("tokens"))
    out = each.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"))
    return out.select("containers", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("least"), F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)).alias("used_share"))


def check(packed: DataFrame, counts: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row: documents with tokens, and how often a rule is broken.

    over_full: containers above the capacity; apart: containers whose pieces overlap or leave room between; lost: documents whose
    pieces do not add up to their tokens; split: documents in several pieces though one container holds them; loose: whether a
    hundredth of the room or more is unused.
    """
    each = packed.groupBy("container").agg(F.sum("piece_tokens").alias("tokens"), F.max(F.col("position") + F.col("piece_tokens")).alias("end"), F.count("*").alias("n"), F.count_distinct("position").alias("places"))
    rooms = each.agg(F.coalesce(F.sum((F.col("tokens") > capacity).cast("int")), F.lit(0)).cast("bigint").alias("over_full"), F.coalesce(F.sum(((F.col("end") != F.col("tokens")) | (F.col("n") != F.col("places"))).cast("int")), F.lit(0)).cast("bigint").alias("apart"), (F.coalesce(F.sum("tokens"), F.lit(0)) < 0.99 * capacity * (F.count("*") - 1)).alias("loose"))
    pieces = packed.groupBy(key).agg(F.sum("piece_tokens").alias("got"), F.count("*").alias("pieces"))
    both = counts.select(key, F.col(size).alias("want")).filter("want > 0").join(pieces, key, "full")
    docs = both.agg(F.count("want").alias("documents"), F.coalesce(F.sum((~F.col("got").eqNullSafe(F.col("want"))).cast("int")), F.lit(0)).cast("bigint").alias("lost"), F.coalesce(F.sum(((F.col("pieces") > 1) & (F.col("want") <= capacity)).cast("int")), F.lit(0)).cast("bigint").alias("split"))
    return docs.withColumn("__one", F.lit(1)).join(rooms.withColumn("__one", F.lit(1)), "__one").drop("__one")  # a row each
