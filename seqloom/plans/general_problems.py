"""Queries of the general corpus problems: packed values (p2), unreadable rows (p5), heavy keys (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.invalid_rows import failures, parse_lines, separate
from seqloom.operators.packed_values import explode_values
from seqloom.operators.skew import organism_totals
from seqloom.session import table

#: Least share of all feature rows that makes an organism a heavy one.
HEAVY_SHARE = 0.04


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = explode_values(table(spark, sf_dir, "record_refs"), "ref_id", "authors", "authors")
    return authors.unionByName(explode_values(table(spark, sf_dir, "records"), "record_id", "keywords", "keywords"))


def p2_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields hold how many values."""
    per = p2_found(spark, sf_dir).groupBy("field", "row_id").agg(F.count("*").alias("n_values"))
    return per.groupBy("field", "n_values").agg(F.count("*").alias("n_fields"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parse_lines(table(spark, sf_dir, "raw_entries"))
    return failures(lines).select(F.col("row_id").alias("raw_id"), "reason")


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = separate(table(spark, sf_dir, "raw_entries"))
    return good.withColumnRenamed("row_id", "raw_id").withColumn("locus_len", F.col("locus_len").cast("long"))


def p6_organism_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organism_totals(*[table(spark, sf_dir, t) for t in ("features", "records", "organisms")])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "features")
    n_all = features.count()  # from the footers
    totals = organism_totals(features, table(spark, sf_dir, "records"))
    return totals.where((F.col("n_rows") > 0) & (F.col("n_rows") >= HEAVY_SHARE * n_all)).select("organism")


QUERIES = {
    "p2_found": p2_found,
    "p2_value_counts": p2_value_counts,
    "p5_found": p5_found,
    "p5_loaded": p5_loaded,
    "p6_found": p6_found,
    "p6_organism_totals": p6_organism_totals,
}

_TIDY = r"nullif(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), '')"
ORACLE = {
    "p6_found": f"""
        SELECT organism FROM (SELECT {_TIDY.format("organism")} AS organism, count(*) AS n FROM features GROUP BY 1)
        WHERE organism IS NOT NULL AND n >= {HEAVY_SHARE} * (SELECT count(*) FROM features)""",
    "p6_organism_totals": f"""
        WITH f AS (SELECT {_TIDY.format("organism")} AS organism, count(*) AS n_rows, count(DISTINCT feature_id) AS n_features
                   FROM features GROUP BY 1),
             r AS (SELECT {_TIDY.format("source.organism")} AS organism, count(*) AS n_records,
                          CAST(sum(coalesce(length(residues), 0)) AS BIGINT) AS n_residues FROM records GROUP BY 1),
             o AS (SELECT {_TIDY.format("organism")} AS organism, min(taxon_id) AS taxon_id FROM organisms GROUP BY 1)
        SELECT coalesce(f.organism, r.organism) AS organism, CASE WHEN r.organism IS NOT NULL THEN o.taxon_id END AS taxon_id,
               coalesce(n_records, 0) AS n_records, coalesce(n_rows, 0) AS n_rows, coalesce(n_features, 0) AS n_features,
               coalesce(n_residues, 0) AS n_residues
        FROM (SELECT * FROM f WHERE organism IS NOT NULL) f FULL JOIN (SELECT * FROM r WHERE organism IS NOT NULL) r USING (organism)
        LEFT JOIN o ON o.organism = coalesce(f.organism, r.organism)""",
}
