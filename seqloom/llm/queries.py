"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bin_packing, name_variants, shared_spans, spam_pages, splitting, term_counts, tokens
from seqloom.operators.packed_values import explode_values
from seqloom.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "records"))


def p1_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record is shared."""
    return shared_spans.shared_share(table(spark, sf_dir, "records"), p1_found(spark, sf_dir))


def p1_later_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches that repeat letters of an earlier record, with their original offsets."""
    return shared_spans.later_copies(table(spark, sf_dir, "records"), cut(p1_found(spark, sf_dir)))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.mark_terms(term_counts.count_terms(table(spark, sf_dir, "features")), table(spark, sf_dir, "records").count())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_counts(spark, sf_dir).where("mark IS NOT NULL").select("term_class", "term", "mark")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    residues = splitting.residue_pieces(table(spark, sf_dir, "records"))
    return residues.unionByName(splitting.location_pieces(table(spark, sf_dir, "features")))


def p4_page_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut by section, paragraph, sentence, word and letter: limit 2,000 letters, overlap 100."""
    return splitting.text_pieces(table(spark, sf_dir, "documents"), "doc_id", "text", 2000, 100)


def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct spelling of a person or body, how often it stands, and its entity."""
    refs = table(spark, sf_dir, "record_refs")
    authors = explode_values(refs, "ref_id", "authors", "authors").select("field", F.col("item").alias("name"))
    return name_variants.name_entities(authors.unionByName(name_variants.bodies(refs.dropDuplicates(["ref_id"]))))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.variant_pairs(p7_entities(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut(tokens.token_counts(table(spark, sf_dir, "documents")))
    out = bin_packing.assign_containers(sizes, "doc_id", "n_tokens")
    return out.select("doc_id", F.col("piece").cast("long").alias("piece"), "start", "size", "container_id", F.col("place").cast("long").alias("place"))


def p10_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, measures, thresholds and decision of every page with text."""
    documents = table(spark, sf_dir, "documents")
    return spam_pages.judged(cut(spam_pages.page_measures(documents, spam_pages.learn(documents))))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_measures(spark, sf_dir).where("stuffed").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_share, p1_later_copies, p3_counts, p3_found, p4_found, p4_page_pieces, p7_entities, p7_found, p8_ids, p9_containers, p10_measures, p10_found)}

_P3 = r"""
    WITH f AS (SELECT DISTINCT ON (feature_id, record_id) * FROM features),
    q AS (SELECT record_id, unnest(qualifiers) AS q FROM f),
    t AS (SELECT 'kind' AS term_class, regexp_replace(kind, '^\s+|\s+$', '', 'g') AS term, record_id FROM f
          UNION ALL SELECT 'key', q.key, record_id FROM q
          UNION ALL SELECT 'word', unnest(regexp_extract_all(lower(q.value), '[a-z]+')), record_id FROM q WHERE q.key IN ('product', 'note')),
    c AS (SELECT term_class, term, count(*) AS n_occurrences, count(DISTINCT record_id) AS n_records
          FROM t WHERE term IS NOT NULL AND term <> '' GROUP BY 1, 2),
    m AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records > 0.5 * (SELECT count(*) FROM records) THEN 'common' END AS mark FROM c)
"""
_P1 = """
    WITH r AS (SELECT DISTINCT record_id, residues FROM records WHERE length(residues) >= 80),
    w AS (SELECT record_id, p, w FROM (SELECT record_id, p, substr(residues, p + 1, 80) AS w FROM (SELECT *, unnest(range(length(residues) - 79)) AS p FROM r)) WHERE NOT regexp_matches(w, '[nN]{10}')),
    s AS (SELECT w FROM w GROUP BY w HAVING min(record_id) <> max(record_id)),
    h AS (SELECT DISTINCT record_id, p FROM w SEMI JOIN s USING (w)),
    f AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY record_id ORDER BY p) + 80 THEN 0 ELSE 1 END AS fresh FROM h),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY record_id ORDER BY p) AS island FROM f),
    spans AS (SELECT record_id, CAST(min(p) AS BIGINT) AS span_start, CAST(max(p) + 80 AS BIGINT) AS span_end FROM i GROUP BY record_id, island)
"""
ORACLE = {
    "p1_found": _P1 + "SELECT * FROM spans",
    "p1_share": _P1
    + """, c AS (SELECT record_id, CAST(sum(span_end - span_start) AS BIGINT) AS shared, count(*) AS n_spans FROM spans GROUP BY record_id),
        l AS (SELECT record_id, CAST(max(coalesce(length(residues), 0)) AS BIGINT) AS letters FROM records GROUP BY record_id)
        SELECT record_id, letters, coalesce(shared, 0) AS shared, coalesce(n_spans, 0) AS n_spans, CASE WHEN letters = 0 THEN 0.0 ELSE CAST(coalesce(shared, 0) AS DOUBLE) / letters END AS share FROM l LEFT JOIN c USING (record_id)""",
    "p3_counts": _P3 + "SELECT * FROM m",
    "p3_found": _P3 + "SELECT term_class, term, mark FROM m WHERE mark IS NOT NULL",
}
