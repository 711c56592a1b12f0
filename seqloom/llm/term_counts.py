"""Frequency of every distinct term, and marks for the too rare and the too common ones.

Method: heavy-light aggregation. Heavy terms are detected on a bounded sample and broadcast; before anything is
shuffled they are replaced by their number, and each task counts these in exact local arrays and sends
one row for each term it saw. Only the remaining terms are shuffled as terms; the two count tables are
united by the last, small aggregation.

Exactness: features of a record are brought together first (one shuffle of ids and terms; values that are
no terms stay behind), so the number of records of a term is a sum over tasks. A record that holds a large part
of all rows would be one overloaded task; a record above ``HOT_ROWS`` is spread by feature over as many
tasks as it has times that number, and for these alone (term, record) pairs are made distinct by one more
shuffle. Which records these are is found by a count over one column and joined, not collected.

The sample only decides how a term is counted, never whether: results don't depend on it.

Defined cases: repeated rows of a feature count once; null or blank kinds, null keys and null values
are no terms; terms of a null record_id count as occurrences, in no record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import cut

#: Rows of the sample that heavy terms are looked for in, and the most terms that are broadcast.
SAMPLE_ROWS, HEAVY_TERMS = 100_000, 1024
#: A term is heavy from this share of the sampled occurrences on.
HEAVY_SHARE = 1 / 4096
HOT_ROWS, NULL_SHARDS = 200_000, 64
RARE_RECORDS, COMMON_SHARE = 2, 0.5
WORD_KEYS = ("product", "note")
#: White space taken off the ends of a kind.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_COUNT_SCHEMA = "term_class string, term string, record_id long, n long, n_records long"


def feature_terms():
    """Array of (term_class, term) of a feature row, as a Column over kind and qualifiers."""
    quals = F.coalesce("qualifiers", F.array().cast("array<struct<key:string,value:string>>"))
    kind = F.btrim("kind", F.lit(BLANKS))

    def term(cls: str, value):
        return F.struct(F.lit(cls).alias("term_class"), value.alias("term"))

    keys = F.transform(F.filter(quals, lambda q: q["key"].isNotNull() & (q["key"] != "")), lambda q: term("key", q["key"]))
    told = F.filter(quals, lambda q: q["key"].isin(*WORD_KEYS) & q["value"].isNotNull())
    words = F.flatten(F.transform(told, lambda q: F.regexp_extract_all(F.lower(q["value"]), F.lit("[a-z]+"), F.lit(0))))
    kinds = F.when(kind != "", F.array(term("kind", kind))).otherwise(F.array().cast("array<struct<term_class:string,term:string>>"))
    return F.concat(kinds, keys, F.transform(words, lambda w: term("word", w)))


def _terms(features: DataFrame, *keep: str) -> DataFrame:
    return features.select(*keep, F.explode(feature_terms()).alias("t")).select(*keep, "t.term_class", "t.term")


def heavy_terms(features: DataFrame) -> list[tuple[str, str]]:
    """At most HEAVY_TERMS terms that a bounded sample shows to be frequent."""
    n = features.count()  # from the footers
    sample = features if n <= SAMPLE_ROWS else features.sample(SAMPLE_ROWS / n, seed=7)
    counts = _terms(sample).groupBy("term_class", "term").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "term_class", "term").limit(HEAVY_TERMS).collect()
    total = sum(r["n"] for r in top)
    return [(r["term_class"], r["term"]) for r in top if r["n"] >= HEAVY_SHARE * total]


def _number_heavy(heavy: list[tuple[str, str]]):
    """Arrays of (term_class, term) to arrays of (number, term_class, term): a heavy term is told by its number alone."""
    known = pa.array([f"{c}\x00{t}" for c, t in heavy], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(3)
            cls, term = terms.flatten().flatten()
            number = pc.index_in(pc.binary_join_element_wise(cls, term, "\x00"), value_set=known)
            light = pc.is_null(number)
            cls, term = (pc.if_else(light, x, pa.scalar(None, pa.string())) for x in (cls, term))
            found = pa.StructArray.from_arrays([number.cast(pa.int32()), cls, term], names=["number", "term_class", "term"])
            offsets = pc.subtract(terms.offsets, terms.offsets[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(offsets, found)], names=["record_id", "feature_id", "shards", "terms"])

    return run


def _count_heavy(heavy: list[tuple[str, str]]):
    """Local counters for heavy terms; the rest is passed on, and so are heavy terms of spread records."""
    number = [(c, pa.int64()) for c in ("record_id", "n", "n_records")]
    schema = pa.schema([("term_class", pa.string()), ("term", pa.string()), *number])
    classes, terms = (pa.array([x[i] for x in heavy], pa.string()) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        for batch in batches:
            place, cls, term, record, n, n_records = batch.columns
            counted = pc.and_(pc.is_valid(place), pc.is_null(record))
            at = place.filter(counted).to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(seen, at, n.filter(counted).to_numpy())
            np.add.at(held, at, n_records.filter(counted).to_numpy())
            rest = pc.invert(counted)
            place = place.filter(rest)
            cls, term = (pc.coalesce(x.filter(rest), names.take(place)) for x, names in ((cls, classes), (term, terms)))
            yield pa.RecordBatch.from_arrays([cls, term, *(x.filter(rest) for x in (record, n, n_records))], schema=schema)
        hit = np.flatnonzero(seen)
        if len(hit):
            pick = pa.array(hit)
            yield pa.RecordBatch.from_arrays([classes.take(pick), terms.take(pick), pa.nulls(len(hit), pa.int64()), pa.array(seen[hit]), pa.array(held[hit])], schema=schema)

    return run


def count_terms(features: DataFrame) -> DataFrame:
    """(term_class, term, n_occurrences, n_records) of every term."""
    rows = features.select("record_id", "feature_id", "kind", "qualifiers")
    sizes = features.groupBy("record_id").agg(F.count("*").alias("n")).where(F.col("record_id").isNotNull() & (F.col("n") > HOT_ROWS))
    hot = sizes.select(F.col("record_id").alias("hot_id"), F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("hot_shards"))
    hot = cut(hot)  # a table of known size
    heavy = heavy_terms(rows)
    # at most one row for each HOT_ROWS rows of the table; the join is broadcast where that is small
    told = rows.select("record_id", "feature_id", feature_terms().alias("terms")).join(hot, F.col("record_id") == F.col("hot_id"), "left")
    shards = F.when(F.col("record_id").isNull(), NULL_SHARDS).otherwise(F.coalesce("hot_shards", F.lit(0)))
    told = told.select(F.col("record_id").cast("long").alias("record_id"), F.col("feature_id").cast("long").alias("feature_id"), shards.cast("int").alias("shards"), "terms")
    numbered = told.mapInArrow(_number_heavy(heavy), "record_id long, feature_id long, shards int, terms array<struct<number:int,term_class:string,term:string>>")
    shard = F.when(F.col("shards") > 0, F.pmod(F.xxhash64("feature_id"), F.col("shards"))).otherwise(F.lit(-1).cast("long"))
    placed = numbered.withColumn("shard", shard).repartition("record_id", "shard").dropDuplicates(["record_id", "shard", "feature_id"])
    # all rows of a (record, shard) lie in one task: this aggregation needs no shuffle
    pairs = placed.select("record_id", "shard", F.explode("terms").alias("t")).groupBy("record_id", "shard", "t.number", "t.term_class", "t.term").agg(F.count("*").alias("n"))
    spread = (F.col("shard") >= 0) & F.col("record_id").isNotNull()
    local = pairs.select(
        "number",
        "term_class",
        "term",
        F.when(spread, F.col("record_id")).alias("record_id"),  # kept only where the pair is still to be made distinct
        "n",
        F.when(spread | F.col("record_id").isNull(), 0).otherwise(1).cast("long").alias("n_records"),
    )
    counted = local.mapInArrow(_count_heavy(heavy), _COUNT_SCHEMA)
    # light terms of one record or another are added up first; only pairs of spread records are made distinct
    per = counted.groupBy("term_class", "term", "record_id").agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records"))
    per = per.withColumn("n_records", F.when(F.col("record_id").isNotNull(), 1).otherwise(F.col("n_records")))
    return per.groupBy("term_class", "term").agg(F.sum("n").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def mark_terms(counts: DataFrame, n_all: int) -> DataFrame:
    """Add ``mark``: rare, common or null. ``n_all`` is the number of all records."""
    mark = F.when(F.col("n_records") <= RARE_RECORDS, "rare").when(F.col("n_records") > COMMON_SHARE * n_all, "common")
    return counts.withColumn("mark", mark)
