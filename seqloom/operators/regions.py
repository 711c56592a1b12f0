"""Interval joins and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of a bin. Intervals are copied to each bin they touch.
BIN = 65_536


def _bins(start: Column, end: Column, size: int) -> Column:
    last = F.greatest(end - 1, start)
    return F.sequence(F.floor(start / size).cast("long"), F.floor(last / size).cast("long"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int = BIN) -> DataFrame:
    """Pairs of one key whose spans [start, end) overlap: an equi-join on (key, bin), never a nested loop.

    A pair that meets in several bins is kept only in the first bin they share, so no distinct is
    needed. A key with very many rows is spread over its bins. Empty and null spans match nothing.
    """
    (ls, le), (rs, re) = left_span, right_span
    a = left.where(F.col(ls) < F.col(le)).withColumn("_bin", F.explode(_bins(F.col(ls), F.col(le), bin_size)))
    b = right.where(F.col(rs) < F.col(re)).withColumn("_bin", F.explode(_bins(F.col(rs), F.col(re), bin_size)))
    joined = a.join(b, [key, "_bin"])
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / bin_size).cast("long")
    return joined.where((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.col("_bin") == first)).drop("_bin")


def merge_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Spans of a key that overlap or touch become one (gaps and islands)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col(start) > reach)).cast("int")
    island = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumn("_fresh", fresh).withColumn("_island", island)
    merged = marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans"))
    return merged.drop("_island")


def merge_adjacent_segments(segments: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """Neighbouring segments in list order become one where the end of one is the start of the next.

    ``before`` and ``after`` flags between the two keep them apart. Other kinds than ranges break a run.
    """
    order = Window.partitionBy(*keys).orderBy(order_by)
    touches = (
        (F.lag("end").over(order) == F.col("start"))
        & ~F.coalesce(F.lag("after").over(order), F.lit(False))
        & ~F.coalesce("before", F.lit(False))
        & (F.col("kind") == "range")
        & (F.lag("kind").over(order) == "range")
    )
    marked = segments.withColumn("_fresh", (~F.coalesce(touches, F.lit(False))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        marked.groupBy(*keys, "_run")
        .agg(F.min_by("start", order_by).alias("start"), F.max_by("end", order_by).alias("end"), F.min_by("before", order_by).alias("before"), F.max_by("after", order_by).alias("after"), F.count("*").alias("n_segments"))
        .withColumn("seg_idx", (F.row_number().over(Window.partitionBy(*keys).orderBy("_run")) - 1).cast("int"))
        .drop("_run")
    )
