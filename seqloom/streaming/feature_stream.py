"""Streams of flat files: totals kept as records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.genbank import stream_genbank


def record_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """One row for each record with its sizes and any error."""
    records = stream_genbank(spark, path, columns=["accession", "locus_len", "residues", "division", "features"], max_files=max_files)
    return records.select(
        "_source_file", "accession", "division", "locus_len", F.length("residues").alias("letters"), F.size("features").alias("n_features"), "_error"
    )


def division_totals(stream: DataFrame) -> DataFrame:
    """Running totals; state has one row for each division."""
    return stream.groupBy("division").agg(
        F.count("*").alias("n_records"), F.sum("letters").alias("letters"), F.sum("n_features").alias("n_features"), F.count("_error").alias("n_errors")
    )


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Take in all that is there now and return it as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
