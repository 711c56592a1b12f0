"""Filling containers of fixed capacity with items, splitting only items above the capacity.

Method: bin completion with branch and bound. The first incumbent is the plan of best fit decreasing. A node
completes the container of the largest open item: its maximal fillings are enumerated, fullest first, as
far as their waste may still beat the incumbent; a branch is given up when the waste so far exceeds
what one container less than the incumbent leaves. The search goes back over its choices until
the incumbent meets a lower bound, all is searched, or its budget of nodes is used up; the incumbent is the
result, so the plan never needs more containers than best fit decreasing.

Scale: only sizes decide. Items are counted by size (at most ``capacity`` counters, whatever the number
of items) and the plan is made from the counters on the driver. While many items are open, a filling is
used as often as the counters allow, so the plan grows with the number of sizes, not of items: at
most three entries for each size, each with at most sqrt(2 * capacity) different sizes. Items take their
places by rank within their size. Ranks are made in buckets of bounded size with offsets from bucket counts,
so a size that a third of all items have is ranked by many tasks; the place of a rank is found by
binary search in the plan, which is sent to the tasks as arrays.

Bounds of the search (none drops an item): ``SEARCH_NODES`` for all of it; above ``EXACT_ITEMS`` open items a
container is completed from at most ``FILLINGS`` fillings found within ``FILLING_NODES`` nodes that
try ``SIZES_A_NODE`` sizes each; up to that number of items all maximal fillings are tried, one container
at a time, so small instances are solved to the optimum unless the budget ends first.

Defined cases: items of size 0 (null or empty texts) take no place: their container is null. An item
above the capacity is cut into full pieces and a rest; the rest is packed like any item. Ties are
broken by id, repeated ids by piece and row order, so reruns give the same containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
#: Items of one rank bucket, about.
BUCKET_ROWS = 200_000
SEARCH_NODES, EXACT_ITEMS = 300_000, 40
FILLINGS, FILLING_NODES, SIZES_A_NODE = 4, 2_000, 24

Plan = list[tuple[tuple[int, ...], int]]


class _Budget:
    def __init__(self, nodes: int):
        self.nodes = nodes


def fillings(counts: dict[int, int], room: int, most_waste: int, exact: bool, budget: _Budget) -> list[tuple[int, ...]]:
    """Maximal fillings of ``room`` that waste at most ``most_waste``: fullest first, then those of larger items.

    A filling to which an open item could be added is dominated, and so is every other one where a single item
    fills the room. ``exact``: all of them, else some of the best.
    """
    sizes = sorted((s for s in counts if s <= room), reverse=True)
    if not sizes:
        return [()] if room <= most_waste else []
    if sizes[0] == room:
        return [(room,)]
    falling = [-s for s in sizes]
    smallest = sizes[-1]
    found: dict[tuple[int, ...], int] = {}
    full = 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, 0, ())]
    nodes = budget.nodes if exact else min(budget.nodes, FILLING_NODES)
    while stack and nodes > 0:
        left, start, taken = stack.pop()
        nodes -= 1
        budget.nodes -= 1
        options = []
        if left >= smallest:
            at = bisect_left(falling, -left, start)
            while at < len(sizes) and (exact or len(options) < SIZES_A_NODE):
                size = sizes[at]
                if counts[size] > taken.count(size):
                    options.append((left - size, at, (*taken, size)))
                at += 1
        stack.extend(reversed(options))
        # maximal: no open item, not even a larger one passed over, has room
        if left <= most_waste and not any(counts[s] > taken.count(s) for s in sizes[bisect_left(falling, -left) :]):
            found[taken] = left
            full += not left
            if full >= FILLINGS and not exact:
                break
    best = sorted(found, key=lambda f: (found[f], tuple(-s for s in f)))
    return best if exact else best[:FILLINGS]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Plan of best fit decreasing over counters: at most three entries for each size."""
    rooms: list[int] = []
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, filling: tuple[int, ...], times: int) -> None:
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append((filling, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                whole, rest = divmod(n, per)
                if whole:
                    put(capacity - per * size, (size,) * per, whole)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[at]
            filling, times = open_at[room].pop()
            # a container takes as many items of this size as best fit would give it in a row
            per = min(room // size, n)
            k = min(times, n // per)
            if times > k:
                open_at[room].append((filling, times - k))
            if not open_at[room]:
                del open_at[room], rooms[at]
            put(room - per * size, filling + (size,) * per, k)
            n -= k * per
    return [entry for room in rooms for entry in open_at[room]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that any plan needs: for each k, items above capacity - k stand alone, those above half a container
    share with none of their kind, and what their rooms can't take of the others of at least k needs more."""
    if not counts:
        return 0
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], object)
    n_before, sum_before = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * sizes)))
    half = int(np.searchsorted(sizes, capacity / 2, "right"))
    best = 0
    for k in [0, *(int(s) for s in sizes if 2 * s <= capacity)]:
        alone, low = int(np.searchsorted(sizes, capacity - k, "right")), int(np.searchsorted(sizes, k, "left"))
        alone = max(alone, half)
        n_alone, n_big = n_before[-1] - n_before[alone], n_before[alone] - n_before[half]
        rooms = n_big * capacity - (sum_before[alone] - sum_before[half])
        small = sum_before[half] - sum_before[min(low, half)]
        best = max(best, n_alone + n_big + max(0, -(-(small - rooms) // capacity)))
    return int(best)


def _used(plan: Plan) -> int:
    return sum(times for _, times in plan)


def plan_containers(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """[(sizes of one container, how many such containers)] for items counted by size."""
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    lower = lower_bound(counts, capacity)
    plan = best_fit_decreasing(counts, capacity)
    best, total = _used(plan), sum(s * n for s, n in counts.items())
    budget, seen = _Budget(SEARCH_NODES), set()
    left, items, waste, used = dict(counts), sum(counts.values()), 0, 0
    path: list[tuple[tuple[int, ...], int]] = []
    choices: list[Iterator[tuple[int, ...]]] = []

    def take(filling: tuple[int, ...], times: int, sign: int) -> None:
        nonlocal items, waste, used
        for s in filling:
            left[s] = left.get(s, 0) - sign * times
            if not left[s]:
                del left[s]
        items -= sign * times * len(filling)
        waste += sign * times * (capacity - sum(filling))
        used += sign * times

    def open_choices() -> Iterator[tuple[int, ...]]:
        slack = (best - 1) * capacity - total - waste
        exact = items <= EXACT_ITEMS
        if exact:
            state = (used, tuple(sorted(left.items())))
            if state in seen:
                return iter(())
            seen.add(state)
        largest = max(left)
        take((largest,), 1, 1)
        rest = fillings(left, capacity - largest, slack, exact, budget)
        take((largest,), 1, -1)
        return iter([(largest, *f) for f in rest])

    choices.append(open_choices())
    while choices and best > lower and budget.nodes > 0:
        filling = next(choices[-1], None)
        if filling is None:
            choices.pop()
            if path:
                take(*path.pop(), -1)
            continue
        times = 1 if items <= EXACT_ITEMS else min(left[s] // n for s, n in Counter(filling).items())
        if waste + times * (capacity - sum(filling)) > (best - 1) * capacity - total:
            times = max(1, ((best - 1) * capacity - total - waste) // max(1, capacity - sum(filling)))
            if waste + times * (capacity - sum(filling)) > (best - 1) * capacity - total:
                continue
        take(filling, times, 1)
        path.append((filling, times))
        if left:
            choices.append(open_choices())
            continue
        if used < best:
            plan, best = list(path), used
        take(*path.pop(), -1)
    return plan


def plan_arrays(plan: Plan) -> dict[str, np.ndarray]:
    """The plan by size and rank: where the ranks of a size go. Equal sizes of one container are one row."""
    rows, base, taken = [], 0, Counter()
    for filling, times in plan:
        place = 0
        for size, per in sorted(Counter(filling).items(), reverse=True):
            rows.append((size, taken[size], per, base, place))
            taken[size] += times * per
            place += per
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("size", "rank_from", "per", "container_from", "place"), columns))


def split_large(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, size): pieces from 1; only items above the capacity have more than one."""
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    n = F.greatest(F.ceil(size / capacity), F.lit(1)).cast("int")
    cut = items.select(F.col(id_col), size.alias("_whole"), F.explode(F.sequence(F.lit(1), n)).alias("piece"))
    start = (F.col("piece").cast("long") - 1) * capacity
    return cut.select(id_col, "piece", start.alias("start"), F.least(F.col("_whole") - start, F.lit(capacity)).cast("long").alias("size"))


def assign_containers(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, size, container_id, place) with place counted within the container.

    ``items`` is read three times (counters, bucket counts, rows): cut its lineage if it is costly.
    """
    pieces = split_large(items.select(id_col, size_col), id_col, size_col, capacity)
    placed = pieces.where("size > 0")
    counted = placed.groupBy("size").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    counts = {r["size"]: r["n"] for r in counted}
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    salted = placed.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)))
    offsets = salted.groupBy("size", "bucket").agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("size", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("size", "bucket").orderBy(id_col, "piece")
    ranked = salted.withColumn("in_rank", F.row_number().over(within) - 1).join(offsets, ["size", "bucket"])
    ranked = ranked.select(id_col, "piece", "start", "size", (F.col("in_rank") + F.col("offset")).cast("long").alias("rank"))
    empty = pieces.where("size <= 0").select(id_col, "piece", "start", F.lit(0).cast("long").alias("size"))
    empty = empty.withColumns({"container_id": F.lit(None).cast("long"), "place": F.lit(None).cast("int")})
    return _placed(ranked, plan_arrays(plan_containers(counts, capacity)), id_col).unionByName(empty)


def _placed(ranked: DataFrame, plan: dict[str, np.ndarray], id_col: str) -> DataFrame:
    """Container and place of each rank, by binary search among the ranks at which a size changes containers."""
    plan_size, rank_from, per, container_from, first_place = (plan[c] for c in ("size", "rank_from", "per", "container_from", "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, begins = np.unique(plan_size, return_index=True)
        ends = np.append(begins[1:], len(plan_size))
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            at = np.zeros(len(size), np.int64)
            for value in np.unique(size).tolist():
                mine, k = size == value, int(np.searchsorted(sizes, value))
                at[mine] = begins[k] - 1 + np.searchsorted(rank_from[begins[k] : ends[k]], rank[mine], "right")
            beyond = rank - rank_from[at]
            container, place = container_from[at] + beyond // per[at], first_place[at] + beyond % per[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container), pa.array(place.astype(np.int32))], names=[*batch.schema.names[:4], "container_id", "place"])

    kind = ranked.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, size long, container_id long, place int")
