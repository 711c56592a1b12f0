"""Corpus statistics: totals by source, frequencies, and the cut at a share of the total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import native


def source_totals(records: DataFrame, by: str = "_source_file") -> DataFrame:
    """Per source: records, declared and read letters, and whether the two agree."""
    out = records.groupBy(by).agg(
        F.count("*").alias("n_records"),
        F.sum(F.coalesce("locus_len", F.lit(0))).cast("long").alias("declared"),
        F.sum(F.coalesce(F.length("residues"), F.lit(0))).cast("long").alias("letters"),
    )
    return out.withColumn("agrees", F.col("declared") == F.col("letters"))


def kind_frequency(features: DataFrame) -> DataFrame:
    return features.groupBy("kind").agg(F.count("*").alias("n"))


def key_frequency(features: DataFrame) -> DataFrame:
    """Qualifier keys, those without value included."""
    return features.select(F.explode("qualifiers").alias("q")).groupBy(F.col("q.key").alias("key")).agg(F.count("*").alias("n"))


def percentile_cut(counts: DataFrame, key: str, share: float = 0.99) -> DataFrame:
    """Most frequent keys until their sum exceeds ``trunc(total * share)``; the one that crosses is in.

    Ties are taken by key. The running sum is made over the different frequencies, of which a table of N rows has at most
    sqrt(2 N), and only keys of the frequencies within the cut are ranked, each among those of its own.
    """
    levels = counts.groupBy("n").agg((F.col("n") * F.count("*")).alias("_sum"))
    earlier = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    most = F.floor(F.sum("_sum").over(Window.partitionBy()) * share)
    levels = levels.select("n", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), most.alias("_most")).where("_before <= _most")
    rank = F.row_number().over(Window.partitionBy("n").orderBy(key))
    ranked = counts.join(levels, "n").withColumn("running", (F.col("_before") + F.col("n") * rank).cast("long"))
    return ranked.where(F.col("running") - F.col("n") <= F.col("_most")).select(*counts.columns, "running")


def composition(records: DataFrame, by: str = "division") -> DataFrame:
    """Letters of each IUPAC code, upper and lower case together, without exploding the residues."""
    upper = F.upper("residues")
    counts = {c: (F.length("residues") - F.length(F.replace(upper, F.lit(c), F.lit("")))).cast("long") for c in native.CODES[:15]}
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(f"n_{c.lower()}") for c, n in counts.items()]
    return records.groupBy(by).agg(F.sum(F.length("residues")).cast("long").alias("letters"), *sums)
