"""A few keys holding most records: joins and per-key results without overloaded tasks.

Method: fragment-replicate by estimated load. Keys are bin-packed to as many tasks as the session
shuffles to; a key above the capacity of a task is split into shards in proportion to its load, and
the matching side is copied only to those shards. Rows travel by an explicit partition id, so the
packing is what runs, not what a hash makes of it.

Bounds: the plan that is collected and broadcast has at most ``8 * tasks`` heavy keys, each of at
least an eighth of a task's capacity, and ``16 * tasks`` buckets for all others, whatever the number
of keys or rows. A key may hold any share of the rows.

Null keys match nothing: the join drops them, per-key results leave them out.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS_OF_CAPACITY, BUCKETS_PER_TASK = 8, 16


@dataclass(frozen=True)
class LoadPlan:
    """``heavy``: key -> tasks of its shards; ``buckets``: task of each bucket of light keys."""

    tasks: int
    total: int
    heavy: tuple[tuple[str, tuple[int, ...]], ...]
    buckets: tuple[int, ...]


def pack(tasks: int, heavy: list[tuple[str, int]], buckets: list[int], total: int) -> LoadPlan:
    """Largest load first to the least loaded task; shards of one key to different tasks."""
    capacity = max(1, -(-total // tasks))
    pieces = []
    for key, load in heavy:
        shards = min(tasks, max(1, round(load / capacity + 0.49)))
        pieces += [(load / shards, 0, key, i) for i in range(shards)]
    pieces += [(load, 1, "", b) for b, load in enumerate(buckets)]
    pieces.sort(key=lambda p: (-p[0], p[1:]))
    free = [(0.0, t) for t in range(tasks)]
    heapq.heapify(free)
    homes: dict[str, list[int]] = {}
    bucket_home = [0] * len(buckets)
    for load, kind, key, i in pieces:
        aside = []
        while not kind and free[0][1] in homes.get(key, ()) and len(free) > 1:
            aside.append(heapq.heappop(free))
        have, task = heapq.heappop(free)
        heapq.heappush(free, (have + load, task))
        for x in aside:
            heapq.heappush(free, x)
        if kind:
            bucket_home[i] = task
        else:
            homes.setdefault(key, []).append(task)
    return LoadPlan(tasks, total, tuple(sorted((k, tuple(v)) for k, v in homes.items())), tuple(bucket_home))


def _bucket(key: Column, tasks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(tasks * BUCKETS_PER_TASK)).cast("int")


def estimate_load(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """Count rows by key (partial counts before the shuffle) and pack them. One job, bounded result."""
    tasks = tasks or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    loads = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))
    total = loads.agg(F.sum("n").alias("n")).first()["n"] or 0
    floor = max(1, -(-total // (tasks * PARTS_OF_CAPACITY)))
    is_heavy = F.col("n") >= floor
    rows = (
        loads.groupBy(F.when(is_heavy, F.col("key")).alias("key"), F.when(~is_heavy, _bucket(F.col("key"), tasks)).alias("bucket"))
        .agg(F.sum("n").alias("n"))
        .collect()
    )  # at most 8 * tasks heavy keys and 16 * tasks buckets
    buckets = [0] * (tasks * BUCKETS_PER_TASK)
    for r in rows:
        if r["bucket"] is not None:
            buckets[r["bucket"]] = r["n"]
    return pack(tasks, [(r["key"], r["n"]) for r in rows if r["bucket"] is None], buckets, total)


def _with_tasks(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """Add ``_tasks``, the tasks of the row's key, by two lookups in broadcast tables of bounded size."""
    spark = df.sparkSession
    heavy = spark.createDataFrame([(k, list(t)) for k, t in plan.heavy], "_heavy_key string, _shards array<int>")
    light = spark.createDataFrame(list(enumerate(plan.buckets)), "_bucket int, _home int")
    text = F.col(key).cast("string")
    out = df.where(F.col(key).isNotNull()).withColumn("_bucket", _bucket(text, plan.tasks))
    out = out.join(F.broadcast(heavy), text == F.col("_heavy_key"), "left").join(F.broadcast(light), "_bucket", "left")
    tasks = F.coalesce("_shards", F.array("_home"))
    return out.withColumn("_tasks", tasks).drop("_heavy_key", "_shards", "_bucket", "_home")


def fragment(df: DataFrame, key: str, plan: LoadPlan, spread_by: list[str]) -> DataFrame:
    """Give each row its task in ``_task``. Rows equal in ``spread_by`` and key share one."""
    out = _with_tasks(df, key, plan)
    shard = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.size("_tasks")).cast("int")
    return out.withColumn("_task", F.get("_tasks", shard)).drop("_tasks").repartitionById(plan.tasks, F.col("_task"))


def replicate(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """Copy each row of the matching side to the tasks that hold shards of its key, and to no other."""
    out = _with_tasks(df, key, plan)
    return out.withColumn("_task", F.explode("_tasks")).drop("_tasks").repartitionById(plan.tasks, F.col("_task"))


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, spread_by: list[str], how: str = "left") -> DataFrame:
    """Join a skewed ``left`` with ``right`` on ``key``; inner or left. Keeps ``_task`` for local aggregation."""
    plan = estimate_load(left, key)
    return fragment(left, key, plan, spread_by).join(replicate(right, key, plan), ["_task", key], how)


def tidy_name(name: Column) -> Column:
    """Lower case, no outer white space, each inner run of white space one blank; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " ")), F.lit(""))


def organism_totals(features: DataFrame, records: DataFrame, organisms: DataFrame | None = None) -> DataFrame:
    """Per organism: feature rows and their share, distinct features, records, residues.

    The skewed side is ``features``; the facts of each organism are replicated only to its shards.
    A shard holds all copies of a feature, so distinct features are counted where they lie and the
    last step adds up one row for each shard.
    """
    f = features.select(tidy_name(F.col("organism")).alias("organism"), "feature_id")
    per = records.groupBy(tidy_name(F.col("source.organism")).alias("organism")).agg(
        F.count("*").alias("n_records"), F.sum(F.coalesce(F.length("residues"), F.lit(0))).cast("long").alias("n_residues")
    )
    if organisms is not None:
        taxa = organisms.groupBy(tidy_name(F.col("organism")).alias("organism")).agg(F.min("taxon_id").alias("taxon_id"))
        per = per.join(taxa, "organism", "left")
    else:
        per = per.withColumn("taxon_id", F.lit(None).cast("long"))
    joined = fragment_replicate_join(f, per, "organism", ["feature_id"])
    facts = ("n_records", "n_residues", "taxon_id")
    local = joined.groupBy("_task", "organism").agg(
        F.count("*").alias("n_rows"), F.countDistinct("feature_id").alias("n_features"), *[F.max(c).alias(c) for c in facts]
    )
    sums = local.groupBy("organism").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_features").alias("n_features"), *[F.max(c).alias(c) for c in facts]
    )
    # records of organisms without a feature; both sides have one row for each organism
    rest = per.where(F.col("organism").isNotNull()).join(sums.select("organism"), "organism", "left_anti")
    rest = rest.select("organism", F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_features"), *facts)
    every = sums.withColumns({c: F.coalesce(c, F.lit(0)) for c in facts[:2]}).unionByName(rest)
    return every.select("organism", "taxon_id", "n_records", "n_rows", "n_features", "n_residues")
