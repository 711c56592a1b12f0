"""Operators on whole records: slice, rotate, reverse-complement, with the features carried along.

Residues are handled by Column expressions. Features of a record come as an array with their locations
as text; single ranges are mapped by expressions, other locations by Arrow-batched functions, and both
give the same results. A feature whose location can't be kept is dropped, and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import native
from seqloom.functions.location_udf import gb_extract, gb_region, gb_relocate, gb_revcomp_location, gb_segments, gb_truncate
from seqloom.operators import location as loc
from seqloom.operators.regions import overlap_join

SIMPLE_FEATURE = "array<struct<kind:string,location_gb:string,qualifiers:array<struct<key:string,value:string>>>>"


def is_circular() -> Column:
    return F.coalesce(F.col("topology") == "circular", F.lit(False))


def length_of() -> Column:
    return native.record_length("locus_len", "residues")


# Features as rows. Each step parses the text once into a helper column, so expressions stay small.


def _easy(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_loc", native.parse_simple(text)).withColumn("_rest", F.when(F.col("_loc").isNull(), F.col(text)))


def relocate_column(df: DataFrame, text: str, shift: Column, length: Column, circular: Column) -> DataFrame:
    """Location texts moved by ``shift``; natively for single ranges, else in Python."""
    by = F.when(circular, F.pmod(shift, length)).otherwise(shift)
    out = _easy(df, text).withColumn("_by", by).withColumn("_moved", native.shift_simple("_loc", "_by"))
    shown = F.when(circular, native.wrapped_simple("_moved", length)).otherwise(native.format_simple("_moved"))
    # ranges of more than a lap past the end of a circle have no native form
    out = out.withColumn("_shown", F.when(F.col("_loc").isNotNull(), shown))
    general = gb_relocate(F.when(F.col("_shown").isNull(), F.col(text)), shift, length, circular)
    return out.withColumn(text, F.coalesce("_shown", general)).drop("_loc", "_rest", "_by", "_moved", "_shown")


def reverse_column(df: DataFrame, text: str, length: Column) -> DataFrame:
    out = _easy(df, text).withColumn("_turned", native.revcomp_simple("_loc", length))
    shown = F.when(F.col("_loc").isNotNull(), native.format_simple("_turned"))
    return out.withColumn(text, F.coalesce(shown, gb_revcomp_location("_rest", length))).drop("_loc", "_rest", "_turned")


def truncate_column(df: DataFrame, text: str, start: Column, end: Column) -> DataFrame:
    """Location texts cut to [start, end); null where nothing is left."""
    out = _easy(df, text).withColumn("_cut", native.truncate_simple("_loc", start, end))
    shown = F.when(F.col("_cut").isNotNull(), native.format_simple("_cut"))
    return out.withColumn(text, F.coalesce(shown, gb_truncate("_rest", start, end))).drop("_loc", "_rest", "_cut")


def extract_column(df: DataFrame, text: str, residues: str) -> DataFrame:
    """Add ``letters`` and ``error`` of each location within the record's own residues."""
    out = _easy(df, text).withColumn("_letters", native.extract_simple("_loc", residues))
    out = out.withColumn("_found", gb_extract("_rest", F.when(F.col("_rest").isNotNull(), F.col(residues))))
    error = F.when(F.col("_loc").isNotNull() & F.col("_letters").isNull() & F.col(residues).isNotNull(), "out_of_bounds").otherwise(F.col("_found.error"))
    return out.withColumns({"letters": F.coalesce("_letters", "_found.residues"), "error": error}).drop("_loc", "_rest", "_letters", "_found")


# Records with nested features


def _map_features(records: DataFrame, fn, extra: list[Column]) -> DataFrame:
    """Apply ``fn(location, *extra)`` to each feature; features for which it fails are dropped with a warning."""
    named, n_extra = [c.alias(f"_x{i}") for i, c in enumerate(extra)], len(extra)
    kinds = records.schema
    keep = [f for f in kinds.fields if f.name not in ("features", "_warnings")]
    schema = T.StructType([*keep, kinds["features"], T.StructField("_warnings", T.ArrayType(T.StringType()))])
    source = records if "_warnings" in records.columns else records.withColumn("_warnings", F.array().cast("array<string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        own = [f.name for f in keep]
        for batch in batches:
            features, warnings = [], []
            rows = batch.select(["features", "_warnings", *(f"_x{i}" for i in range(n_extra))]).to_pylist()
            for row in rows:
                args = [row[f"_x{i}"] for i in range(n_extra)]
                kept, told = [], list(row["_warnings"] or ())
                for f in row["features"] or ():
                    try:
                        found = fn(loc.parse_location(f["location_gb"]), *args)
                    except loc.LocationError as e:
                        told.append(f"feature dropped: {e}")
                        continue
                    if found is not None:
                        shown = {"location_gb": loc.format_location(found)}
                        if "location" in f:
                            shown["location"] = loc.to_nodes(found)
                        kept.append(f | shown)
                features.append(kept)
                warnings.append(told)
            columns = [batch.column(n) for n in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(features, arrow.field("features").type), pa.array(warnings, pa.list_(pa.string()))], schema=arrow)

    return source.select(*own_columns(keep), "features", "_warnings", *named).mapInArrow(run, schema).select(*[f.name for f in schema.fields])


def _known(*values) -> None:
    """A record whose length isn't known has no coordinates to map to."""
    if any(v is None for v in values):
        raise loc.LocationError("no_length")


def _reversed(x, length):
    _known(length)
    return loc.reverse_complement(x, length)


def _turned(x, shift, length, turns):
    if not turns:
        return x
    _known(shift, length)
    return loc.relocate(x, shift, length, True)


def own_columns(fields) -> list[str]:
    return [f.name for f in fields]


def revcomp_records(records: DataFrame) -> DataFrame:
    """Reverse complement of residues and features; feature order and all metadata stay."""
    out = _map_features(records, _reversed, [length_of()])
    return out.withColumn("residues", native.revcomp("residues"))


def set_origin(records: DataFrame, origin: Column) -> DataFrame:
    """Rotate circular records so that ``origin`` comes first. Linear and empty records come out unchanged."""
    turns = is_circular() & (F.length("residues") > 0)
    shift = F.when(turns, F.pmod(-origin, length_of())).otherwise(0)
    marked = records.withColumn("_origin", F.when(turns, F.pmod(origin.cast("long"), length_of())))
    out = _map_features(marked, _turned, [shift, length_of(), turns])
    rotated = F.when(F.col("_origin").isNotNull(), native.rotate("residues", "_origin")).otherwise(F.col("residues"))
    return out.withColumn("residues", rotated).drop("_origin")


def extract_range(records: DataFrame, start: Column, end: Column) -> DataFrame:
    """One region of each record: residues and the features within, cut to the region, from 0 on.

    The result is a new linear record without metadata but ``record_id`` and source columns that
    ``records`` has. Regions out of range give a row with null residues and ``_error``.
    """
    n, around = length_of(), is_circular()
    at = F.when(n.isNotNull(), native.unwrap_range(start.cast("long"), end.cast("long"), n, around))
    marked = records.withColumn("_at", at)
    shift = F.when(around, F.pmod(-F.col("_at.start"), n)).otherwise(-F.col("_at.start"))

    def within(x, d, length, c, width):
        if width is None:
            return None
        return loc.truncate(loc.relocate(x, d, length, c), 0, width)

    out = _map_features(marked, within, [shift, n, around, F.col("_at.end") - F.col("_at.start")])
    letters = native.extract_range_seq("residues", start.cast("long"), end.cast("long"), around)
    keep = [c for c in ("record_id", "_source_file", "_record_idx") if c in records.columns]
    # a declared length that differs from the number of residues has no range
    error = F.when(F.col("_at").isNull(), "region out of range")
    return out.select(
        *keep, F.lit(None).cast("string").alias("name"), F.lit("linear").alias("topology"), F.lit("UNK").alias("division"), F.lit(None).cast("long").alias("locus_len"),
        F.when(F.col("_at").isNotNull(), letters).alias("residues"), "features", "_warnings", error.alias("_error"),
    )


# Many regions, and other records


def extract_regions(features: DataFrame, regions: DataFrame, bin_size: int = 65_536) -> DataFrame:
    """Features in each of many linear regions, cut to it and counted from its start.

    ``features`` (record_id, feature_id, location_gb, f_start, f_end); ``regions`` (record_id, region_id, start, end).
    """
    hits = overlap_join(regions, features, "record_id", ("start", "end"), ("f_start", "f_end"), bin_size)
    # an overlapping single range always leaves a part; other locations may lie around the region
    at = _easy(hits, "location_gb").withColumn("_general", gb_region("_rest", "start", "end"))
    at = at.where(F.col("_rest").isNull() | F.col("_general").isNotNull())
    part = native.truncate_simple(native.shift_simple("_loc", -F.col("start")), F.lit(0).cast("long"), F.col("end") - F.col("start"))
    at = at.withColumn("_part", part)
    shown = F.coalesce("_general", native.format_simple("_part"))
    return at.select("record_id", "region_id", "feature_id", shown.alias("location_gb"))


def lookup_keys(records: DataFrame) -> DataFrame:
    """(key, record_id, residues): a record is found by version, accession or name; the smallest id wins."""
    keys = F.array_distinct(F.filter(F.array("version", "accession", "name"), lambda k: k.isNotNull() & (k != "")))
    rows = records.select(F.explode(keys).alias("key"), "record_id")
    return rows.groupBy("key").agg(F.min("record_id").alias("key_record_id"))


def resolve_externals(segments: DataFrame, records: DataFrame) -> DataFrame:
    """Residues of leaf segments, those of other records fetched by join.

    ``segments`` (feature_id, record_id, seg_idx, accession, kind, start, end, strand). Adds ``residues`` and
    ``error``. Two joins on one key each; a hot accession is split by the adaptive skew join.
    """
    keys = lookup_keys(records)
    looked = segments.join(keys, segments["accession"] == keys["key"], "left").drop("key")
    home = F.when(F.col("accession").isNull(), F.col("record_id")).otherwise(F.col("key_record_id"))
    texts = records.select(F.col("record_id").alias("_home"), F.col("residues").alias("_text"))
    joined = looked.withColumn("_home_id", home).join(texts, F.col("_home_id") == F.col("_home"), "left")
    part = F.when(F.col("kind") == "whole", F.col("_text")).when(
        (F.col("kind") == "range") & (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.length("_text")),
        F.substring(F.col("_text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")),
    )
    error = (
        F.when(F.col("kind").isNull(), "syntax")
        .when(F.col("kind").isin("gap", "between"), "ambiguous")
        .when(F.col("_text").isNull() & F.col("accession").isNotNull(), "external")
        .when(part.isNull(), "out_of_bounds")
    )
    shown = F.when(F.col("strand") == -1, native.revcomp(part)).otherwise(part)
    return joined.withColumns({"residues": shown, "error": error}).drop("_home", "_home_id", "_text", "key_record_id")


def segments_of(features: DataFrame) -> DataFrame:
    """One row for each leaf of each location: (feature_id, record_id, seg_idx, accession, kind, start, end, strand).

    Single ranges are read by expressions, other locations in Python. A location that is null or can't be read gives one
    row without kind.
    """
    rows = _easy(features.select("feature_id", "record_id", "location_gb"), "location_gb")
    x = F.col("_loc")
    kind = F.array(F.struct(F.lit(None).cast("string").alias("accession"), F.lit("range").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.when(x["reverse"], -1).otherwise(1).cast("int").alias("strand")))
    leaves = F.when(x.isNotNull(), kind).otherwise(F.col("_others"))
    rows = rows.withColumn("_others", gb_segments("_rest"))
    return rows.select("feature_id", "record_id", F.posexplode_outer(leaves).alias("seg_idx", "leaf")).select("feature_id", "record_id", "seg_idx", "leaf.*")


def extract_locations(features: DataFrame, records: DataFrame) -> DataFrame:
    """(feature_id, residues, error) with externals resolved. Only joins and single ranges have a sequence.

    Lists of other kinds (order, bond, one-of) are ambiguous, as are gaps and places between letters; a null location
    is an error of syntax.
    """
    is_listed = F.coalesce(F.col("location_gb").rlike(r"(^|[(,:])(order|bond|one-of)\("), F.lit(False))
    listed, plain = features.where(is_listed), features.where(~is_listed)
    parts = resolve_externals(segments_of(plain), records)
    whole = parts.groupBy("feature_id").agg(
        F.array_sort(F.collect_list(F.struct("seg_idx", "residues"))).alias("parts"), F.min_by("error", F.when(F.col("error").isNotNull(), F.coalesce("seg_idx", F.lit(0)))).alias("error")
    )  # the leaves of one location
    joined = F.array_join(F.transform("parts", lambda p: p["residues"]), "")
    out = whole.select("feature_id", F.when(F.col("error").isNull(), joined).alias("residues"), "error")
    return out.unionByName(listed.select("feature_id", F.lit(None).cast("string").alias("residues"), F.lit("ambiguous").alias("error")))


def cds_fasta(records: DataFrame, features: DataFrame) -> DataFrame:
    """(feature_id, header, residues, error) of each CDS: header is record name, locus tag and gene."""
    cds = features.where(F.col("kind") == "CDS")
    tag, gene = (F.get(native.qualifier_values("qualifiers", k), F.lit(0)) for k in ("locus_tag", "gene"))
    names = cds.select("feature_id", "record_id", tag.alias("tag"), gene.alias("gene")).join(records.select("record_id", "name"), "record_id")
    header = F.concat("name", F.lit("_"), "tag", F.lit("_"), "gene")
    letters = extract_locations(cds, records)
    return names.select("feature_id", header.alias("header")).join(letters, "feature_id", "left")
