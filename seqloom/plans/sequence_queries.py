"""Queries of the sequence operators over the tables ``records`` and ``features``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import native
from seqloom.functions.location_udf import gb_find_bounds, gb_format_location, gb_parse_location, gb_segments, register
from seqloom.operators import records as ops
from seqloom.operators import statistics as stats
from seqloom.operators.regions import merge_spans, overlap_join
from seqloom.session import by_key, spread, table
from seqloom.sources.genbank import parse_genbank, to_genbank

REGION = 1000
#: A list that holds no other list.
FLAT_LIST = r"^(complement\()?(join|order|bond|one-of)\([^()]*(complement\([^()]*\)[^()]*)*\)+$"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "features")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with residues and a range that depends on its id; some run over the origin."""
    n = F.length("residues").cast("long")
    start = (F.col("record_id") * 7919) % (n * 2) - n
    rows = _records(spark, sf_dir).where(n > 0).select("record_id", "residues", n.alias("n"), ops.is_circular().alias("circular"), start.alias("a"))
    return rows.withColumn("b", F.col("a") + F.col("record_id") % F.col("n"))


def _simple_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir).select("feature_id", "record_id", "location_gb", native.parse_simple("location_gb").alias("loc"))
    return rows.where("loc IS NOT NULL")


def _on_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).select("record_id", "residues", F.length("residues").cast("long").alias("n"), ops.is_circular().alias("circular"))
    return _simple_features(spark, sf_dir).join(r.where("n > 0"), "record_id")


def revcomp_residues(spark, sf_dir):
    return _records(spark, sf_dir).select("record_id", native.revcomp("residues").alias("rc"))


def residue_composition(spark, sf_dir):
    return stats.composition(_records(spark, sf_dir))


def record_lengths(spark, sf_dir):
    return _records(spark, sf_dir).select("record_id", native.record_length("locus_len", "residues").alias("length"), ops.is_circular().alias("circular"))


def unwrapped_ranges(spark, sf_dir):
    rows = _ranges(spark, sf_dir).withColumn("at", native.unwrap_range("a", "b", "n", "circular"))
    return rows.select("record_id", F.col("at.start").alias("start"), F.col("at.end").alias("end"))


def range_residues(spark, sf_dir):
    return _ranges(spark, sf_dir).select("record_id", native.extract_range_seq("residues", "a", "b", "circular").alias("letters"))


def range_locations(spark, sf_dir):
    return _ranges(spark, sf_dir).select("record_id", native.range_to_location("a", "b", "n", "circular").alias("location"))


def rotated_residues(spark, sf_dir):
    return _ranges(spark, sf_dir).where("circular").select("record_id", native.rotate("residues", "a").alias("rotated"))


def simple_locations(spark, sf_dir):
    return _simple_features(spark, sf_dir).select("feature_id", "loc.*")


def location_round_trip(spark, sf_dir):
    """Every location parsed and printed again."""
    return spread(_features(spark, sf_dir).select("feature_id", "location_gb")).select("feature_id", gb_format_location(gb_parse_location("location_gb")).alias("shown"))


def location_segments(spark, sf_dir):
    """Each part of each location in reading order, with its strand."""
    return ops.segments_of(_features(spark, sf_dir).dropDuplicates(["feature_id"])).drop("record_id")


def list_bounds(spark, sf_dir):
    """Bounds of every list that holds no other list."""
    rows = _features(spark, sf_dir).where(F.col("location_gb").rlike(FLAT_LIST))
    at = gb_find_bounds(F.col("location_gb"))
    return rows.select("feature_id", at["start"].alias("start"), at["end"].alias("end"), at["error"].alias("error"))


def sql_location_functions(spark, sf_dir):
    """The functions registered for SQL, over single ranges of records with residues."""
    register(spark)
    _on_records(spark, sf_dir).createOrReplaceTempView("seqloom_features")
    return spark.sql(
        """SELECT feature_id, gb_find_bounds(location_gb).start AS start, gb_find_bounds(location_gb).end AS end, gb_truncate(location_gb, 100L, 500L) AS truncated,
                  gb_relocate(location_gb, 7L, 0L, false) AS moved, gb_revcomp_location(location_gb, n) AS reversed, gb_format_location(gb_parse_location(location_gb)) AS shown,
                  gb_simplify(concat('join(', location_gb, ')')) AS simplified, md5(gb_extract(location_gb, residues).residues) AS letters, md5(revcomp(residues)) AS turned
           FROM seqloom_features"""
    )


def truncated_locations(spark, sf_dir):
    rows = _simple_features(spark, sf_dir).withColumn("cut", native.truncate_simple("loc", F.lit(100), F.lit(500)))
    return rows.where("cut IS NOT NULL").select("feature_id", native.format_simple("cut").alias("location"))


def moved_locations(spark, sf_dir):
    shift = F.col("record_id") % 500 - 250
    inside = _on_records(spark, sf_dir).where("loc.end <= n AND loc.start >= 0 AND loc.start < loc.end")
    moved = ops.relocate_column(inside, "location_gb", shift, F.col("n"), F.col("circular"))
    return moved.select("feature_id", F.col("location_gb").alias("location"))


def reversed_locations(spark, sf_dir):
    return ops.reverse_column(_on_records(spark, sf_dir), "location_gb", F.col("n")).select("feature_id", F.col("location_gb").alias("location"))


def feature_residues(spark, sf_dir):
    return _on_records(spark, sf_dir).select("feature_id", native.extract_simple("loc", "residues").alias("letters"))


def segment_counts(spark, sf_dir):
    segments = ops.segments_of(_features(spark, sf_dir).dropDuplicates(["feature_id"]))
    return segments.groupBy("feature_id").agg(F.count("*").alias("n_segments"))


def external_lookup(spark, sf_dir):
    segments = ops.segments_of(_features(spark, sf_dir).dropDuplicates(["feature_id"]).where(F.col("location_gb").contains(":")))
    named = segments.where("accession IS NOT NULL")
    keys = ops.lookup_keys(_records(spark, sf_dir))
    return named.join(keys, F.col("accession") == F.col("key"), "left").select("feature_id", "accession", "start", "end", "key_record_id")


def location_residues(spark, sf_dir):
    """Residues of every location, parts of other records fetched."""
    features = _features(spark, sf_dir).dropDuplicates(["feature_id"])
    return ops.extract_locations(features, _records(spark, sf_dir))


def _regions(spark, sf_dir):
    r = _records(spark, sf_dir).where(F.length("residues") > 0)
    starts = F.sequence(F.lit(0).cast("long"), (F.length("residues") - 1).cast("long"), F.lit(REGION).cast("long"))
    rows = r.select("record_id", F.explode(starts).alias("start"))
    return rows.select("record_id", "start", (F.col("start") + REGION).alias("end"))


def region_overlap(spark, sf_dir):
    spans = _simple_features(spark, sf_dir).select("record_id", "feature_id", F.col("loc.start").alias("f_start"), F.col("loc.end").alias("f_end"))
    hits = overlap_join(_regions(spark, sf_dir), spans, "record_id", ("start", "end"), ("f_start", "f_end"), 4096)
    return hits.select("record_id", "start", "feature_id", "f_start", "f_end")


def region_features(spark, sf_dir):
    spans = _simple_features(spark, sf_dir).select("record_id", "feature_id", "location_gb", F.col("loc.start").alias("f_start"), F.col("loc.end").alias("f_end"))
    regions = _regions(spark, sf_dir).withColumn("region_id", F.col("start"))
    return ops.extract_regions(spans, regions, 4096)


def merged_spans(spark, sf_dir):
    spans = _simple_features(spark, sf_dir).select("record_id", F.col("loc.start").alias("start"), F.col("loc.end").alias("end"))
    return merge_spans(spans, ["record_id"])


# The same over features of every kind of location, for which SQL has no form: each name ends in _all.


def _all_on_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature with its record; ``n`` is the number of residues, without residues the declared length, else null."""
    size = F.coalesce(F.nullif(F.length("residues").cast("long"), F.lit(0)), F.when(F.col("locus_len") > 0, F.col("locus_len")))
    r = _records(spark, sf_dir).select("record_id", "residues", size.alias("n"), ops.is_circular().alias("circular"))
    return _features(spark, sf_dir).select("feature_id", "record_id", "location_gb").join(r, "record_id")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch [f_start, f_end) of its own record that a feature stands on; repeated rows count once.

    Letters between the parts of a list don't belong to it, so lists that run over the origin or backwards need no
    special case. A place between letters stands on both; whole gaps and parts of other records on nothing here.
    """

    def stretches(leaf):
        a, b = leaf["start"], leaf["end"]
        span = lambda x, y: F.struct(x.alias("f_start"), y.alias("f_end"))
        around = F.array(span(a, a + 1), span(b, b + 1))
        return F.when(leaf["kind"] == "range", F.array(span(a, b))).when(b == a + 1, F.array(span(a, b + 1))).otherwise(around)

    rows = _features(spark, sf_dir).dropDuplicates(["feature_id"]).select("feature_id", "record_id", "location_gb", native.parse_simple("location_gb").alias("loc"))
    rows = rows.withColumn("leaves", gb_segments(F.when(F.col("loc").isNull(), F.col("location_gb"))))
    own = F.filter("leaves", lambda x: x["accession"].isNull() & x["kind"].isin("range", "between"))
    simple = F.array(F.struct(F.col("loc.start").alias("f_start"), F.col("loc.end").alias("f_end")))
    parts = F.when(F.col("loc").isNotNull(), simple).otherwise(F.flatten(F.transform(own, stretches)))
    return rows.select("feature_id", "record_id", "location_gb", F.explode(parts).alias("p")).select("feature_id", "record_id", "location_gb", "p.*")


def truncated_locations_all(spark, sf_dir):
    rows = spread(_features(spark, sf_dir).select("feature_id", "location_gb"))
    cut = ops.truncate_column(rows, "location_gb", F.lit(100), F.lit(500))
    return cut.where("location_gb IS NOT NULL").select("feature_id", F.col("location_gb").alias("location"))


def moved_locations_all(spark, sf_dir):
    """Null where a circle has no known length."""
    shift, length = F.col("record_id") % 500 - 250, F.when(F.col("circular"), F.col("n")).otherwise(F.coalesce("n", F.lit(0)))
    moved = ops.relocate_column(_all_on_records(spark, sf_dir).drop("residues"), "location_gb", shift, length, F.col("circular"))
    return moved.select("feature_id", F.col("location_gb").alias("location"))


def reversed_locations_all(spark, sf_dir):
    """Null where the record has no known length."""
    turned = ops.reverse_column(_all_on_records(spark, sf_dir).drop("residues"), "location_gb", F.col("n"))
    return turned.select("feature_id", F.col("location_gb").alias("location"))


def feature_residues_all(spark, sf_dir):
    """Letters within the feature's own record, or why there are none; location_residues fetches other records."""
    return ops.extract_column(_all_on_records(spark, sf_dir), "location_gb", "residues").select("feature_id", "letters", "error")


def region_overlap_all(spark, sf_dir):
    """One row for each part of a location in a region."""
    hits = overlap_join(_regions(spark, sf_dir), _parts(spark, sf_dir).drop("location_gb"), "record_id", ("start", "end"), ("f_start", "f_end"), 4096)
    return hits.select("record_id", "start", "feature_id", "f_start", "f_end")


def region_features_all(spark, sf_dir):
    """One row for each feature in a region, however many of its parts lie there."""
    regions = _regions(spark, sf_dir).withColumn("region_id", F.col("start"))
    return ops.extract_regions(_parts(spark, sf_dir), regions, 4096).distinct()


def merged_spans_all(spark, sf_dir):
    return merge_spans(_parts(spark, sf_dir).select("record_id", F.col("f_start").alias("start"), F.col("f_end").alias("end")), ["record_id"])


def locus_lines(spark, sf_dir):
    r = _records(spark, sf_dir)
    length = F.coalesce(F.col("locus_len"), F.length("residues").cast("long"), F.lit(0))
    return r.select("record_id", native.locus_line("name", "accession", length, "molecule_type", "topology", "division", "date").alias("line"))


def locus_parsed(spark, sf_dir):
    """LOCUS lines of well-formed records, read back."""
    r = _records(spark, sf_dir).where("name RLIKE '^[A-Za-z0-9_.]+$' AND molecule_type RLIKE '^[A-Za-z-]+$' AND division RLIKE '^[A-Z]+$' AND locus_len IS NOT NULL AND topology IN ('linear', 'circular')")
    line = native.locus_line("name", "accession", "locus_len", "molecule_type", "topology", "division", "date")
    out = r.select("record_id", native.parse_locus(line).alias("x"))
    return out.select("record_id", "x.name", "x.locus_len", "x.molecule_type", "x.topology", "x.division", "x.ok")


def date_texts(spark, sf_dir):
    return _records(spark, sf_dir).select("record_id", native.format_date("date").alias("text"), native.calendar_date("date").cast("string").alias("day"))


def origin_blocks(spark, sf_dir):
    return _records(spark, sf_dir).select("record_id", native.origin_block("residues").alias("block"))


def scanned_residues(spark, sf_dir):
    block = F.regexp_replace(native.origin_block("residues"), "^ORIGIN *\n", "")
    return _records(spark, sf_dir).select("record_id", native.scan_residues(block).alias("letters"))


def fasta_texts(spark, sf_dir):
    return _records(spark, sf_dir).where("residues <> '' AND accession IS NOT NULL").select("record_id", native.fasta("accession", "residues").alias("fasta"))


def source_totals(spark, sf_dir):
    return stats.source_totals(_records(spark, sf_dir))


def kind_frequency(spark, sf_dir):
    return stats.kind_frequency(_features(spark, sf_dir))


def key_frequency(spark, sf_dir):
    return stats.key_frequency(_features(spark, sf_dir))


def frequent_kinds(spark, sf_dir):
    return stats.percentile_cut(kind_frequency(spark, sf_dir).where("kind IS NOT NULL"), "kind")


def frequent_keys(spark, sf_dir):
    return stats.percentile_cut(key_frequency(spark, sf_dir).where("key IS NOT NULL"), "key")


def product_values(spark, sf_dir):
    return _features(spark, sf_dir).select("feature_id", native.qualifier_values("qualifiers", "product").alias("products"))


def _nested(spark, sf_dir, columns=("name", "topology", "locus_len", "residues", "accession", "version", "definition", "division", "molecule_type", "date")):
    """Records with their features as an array, in order."""
    f = _features(spark, sf_dir).dropDuplicates(["feature_id"]).where("kind IS NOT NULL AND location_gb IS NOT NULL")
    quals = F.filter("qualifiers", lambda q: q["key"].isNotNull())
    grouped = f.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("feature_idx", "feature_id", "kind", "location_gb", quals.alias("qualifiers")))).alias("f"))
    listed = F.transform("f", lambda x: F.struct(x["kind"].alias("kind"), x["location_gb"].alias("location_gb"), x["qualifiers"].alias("qualifiers")))
    out = by_key(_records(spark, sf_dir).select("record_id", *columns), "record_id").join(grouped.select("record_id", listed.alias("features")), "record_id", "left")
    return out.withColumn("features", F.coalesce("features", F.array().cast(ops.SIMPLE_FEATURE)))


def _write_and_read(rows: DataFrame) -> DataFrame:
    full = rows.withColumn("locus_len", F.when(F.length("residues") > 0, F.length("residues").cast("long")).otherwise(F.col("locus_len"))).withColumn(
        "features", F.transform("features", lambda x: F.struct(x["kind"].alias("kind"), F.lit(None).cast("array<struct<op:string,parent:int,start:bigint,end:bigint,before:boolean,after:boolean,accession:string,gap_kind:string,gap_len:bigint>>").alias("location"), x["location_gb"].alias("location_gb"), x["qualifiers"].alias("qualifiers")))
    )
    read = full.select("record_id", F.explode(parse_genbank(to_genbank(full))).alias("x"))
    return read.select("record_id", "x.residues", F.size("x.features").alias("n_features"), F.col("x._error").alias("error"))


def written_and_read(spark, sf_dir):
    """Records with plain residues written as flat-file text and parsed again."""
    return _write_and_read(_nested(spark, sf_dir).where("length(residues) > 0 AND residues RLIKE '^[A-Za-z]+$'"))


def written_and_read_all(spark, sf_dir):
    """Every record written and parsed again, those without residues too."""
    return _write_and_read(_nested(spark, sf_dir))


def reversed_records(spark, sf_dir):
    """Every record; without a known length its features are dropped with a warning."""
    out = ops.revcomp_records(_nested(spark, sf_dir))
    return out.select("record_id", F.length("residues").alias("letters"), F.size("features").alias("n_features"), F.md5("residues").alias("digest"))


def rotated_records(spark, sf_dir):
    """Every record; linear and empty ones and those whose declared length differs aren't rotated."""
    out = ops.set_origin(_nested(spark, sf_dir), F.col("record_id") % 997)
    return out.select("record_id", F.substring("residues", 1, 60).alias("head"), F.md5("residues").alias("digest"), F.size("features").alias("n_features"), F.size("_warnings").alias("n_warnings"))


def record_regions(spark, sf_dir):
    """Letters 50 to 150 of every record; those that have no such region give an error."""
    out = ops.extract_range(_nested(spark, sf_dir), F.lit(50), F.lit(150))
    return out.select("record_id", "residues", F.size("features").alias("n_features"), "_error")


def cds_fasta(spark, sf_dir):
    """FASTA text of the CDS that have all it takes, and the error of the others."""
    features = _features(spark, sf_dir).dropDuplicates(["feature_id"])
    out = ops.cds_fasta(_records(spark, sf_dir), features)
    return out.select("feature_id", native.fasta("header", "residues").alias("fasta"), F.coalesce("error", F.when(F.col("header").isNull(), "no_name")).alias("error"))


def repaired_bodies(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("raw_body IS NOT NULL").select("doc_id", F.md5(native.repaired_text("raw_body")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        revcomp_residues, residue_composition, record_lengths, unwrapped_ranges, range_residues, range_locations, rotated_residues, simple_locations,
        location_round_trip, location_segments, list_bounds, sql_location_functions, truncated_locations, moved_locations, reversed_locations, feature_residues, segment_counts, external_lookup,
        location_residues, region_overlap, region_features, merged_spans, truncated_locations_all, moved_locations_all, reversed_locations_all,
        feature_residues_all, region_overlap_all, region_features_all, merged_spans_all, locus_lines, locus_parsed, date_texts, origin_blocks, scanned_residues,
        fasta_texts, source_totals, kind_frequency, key_frequency, frequent_kinds, frequent_keys, product_values, written_and_read, written_and_read_all, reversed_records,
        rotated_records, record_regions, cds_fasta, repaired_bodies,
    )
}

_RC = f"reverse(translate({{}}, '{native.CODES}', '{native.COMPLEMENTS}'))"
_RANGES = """
    WITH r0 AS (SELECT record_id, residues, CAST(length(residues) AS BIGINT) AS n, coalesce(topology = 'circular', false) AS circular FROM records WHERE length(residues) > 0),
    r1 AS (SELECT *, (record_id * 7919) % (n * 2) - n AS a FROM r0),
    r2 AS (SELECT *, a + record_id % n AS b FROM r1),
    r AS (SELECT *, CASE WHEN circular THEN ((a % n) + n) % n WHEN a <= b AND a >= 0 AND a < n AND b >= 0 AND b <= n THEN a END AS s,
                 CASE WHEN circular THEN ((a % n) + n) % n + CASE WHEN a >= b THEN b + n - a ELSE b - a END WHEN a <= b AND a >= 0 AND a < n AND b >= 0 AND b <= n THEN b END AS e FROM r2)
"""
_SHOWN = "CASE WHEN {e} = {s} + 1 AND NOT {lo} AND NOT {hi} THEN CAST({e} AS VARCHAR) ELSE (CASE WHEN {lo} THEN '<' ELSE '' END) || CAST({s} + 1 AS VARCHAR) || '..' || (CASE WHEN {hi} THEN '>' ELSE '' END) || CAST({e} AS VARCHAR) END"


def _shown(s: str, e: str, lo: str = "false", hi: str = "false") -> str:
    return "(" + _SHOWN.format(s=f"({s})", e=f"({e})", lo=f"({lo})", hi=f"({hi})") + ")"


_SIMPLE_SQL = r"""
    WITH s0 AS (SELECT feature_id, record_id, location_gb,
            regexp_extract(location_gb, '^(complement\()?(<?)([+-]?[0-9]{1,18})(?:(\.\.)(>?)([+-]?[0-9]{1,18}))?(\)?)$', ['c', 'lo', 'a', 'd', 'hi', 'b', 'z']) AS g FROM features
            WHERE regexp_matches(location_gb, '^(complement\()?(<?)([+-]?[0-9]{1,18})(?:(\.\.)(>?)([+-]?[0-9]{1,18}))?(\)?)$')),
    s AS (SELECT feature_id, record_id, location_gb, CAST(g.a AS BIGINT) - 1 AS st, CAST(CASE WHEN g.b = '' THEN g.a ELSE g.b END AS BIGINT) AS en,
                 g.lo <> '' AS lo, g.hi <> '' AS hi, g.c <> '' AS rev
          FROM s0 WHERE (g.c <> '') = (g.z <> '') AND (g.lo = '' OR g.b <> '')),
    n AS (SELECT s.*, CAST(length(residues) AS BIGINT) AS n, residues, coalesce(topology = 'circular', false) AS circular FROM s JOIN records USING (record_id) WHERE length(residues) > 0)
"""


def _wrapped(text: str) -> str:
    return f"CASE WHEN rev THEN 'complement(' || {text} || ')' ELSE {text} END"


#: A location as it is printed: a range of one letter, without fuzzy ends, is that letter alone.
CANONICAL = r"""array_to_string(list_transform(string_split(location_gb, ','), lambda part: CASE WHEN regexp_extract(part, '([0-9]+)\.\.([0-9]+)', 1) <> ''
    AND regexp_extract(part, '([0-9]+)\.\.([0-9]+)', 1) = regexp_extract(part, '([0-9]+)\.\.([0-9]+)', 2) AND NOT contains(part, '<')
    THEN replace(part, regexp_extract(part, '([0-9]+\.\.[0-9]+)', 1), regexp_extract(part, '([0-9]+)\.\.', 1)) ELSE part END), ',')"""
#: Parts of every location as written: place, accession, kind, bounds, and whether each and the whole list are reversed.
PARTS = r"""WITH f0 AS (SELECT DISTINCT ON (feature_id) feature_id, record_id, location_gb FROM features WHERE location_gb IS NOT NULL),
    p0 AS (SELECT *, unnest(string_split(location_gb, ',')) AS raw, unnest(range(len(string_split(location_gb, ',')))) AS pos FROM f0),
    p1 AS (SELECT *, regexp_extract(raw, '((?:[A-Za-z0-9_.]+:)?<?[0-9]+(?:\.\.>?[0-9]+|\^[0-9]+)?)\)*$', 1) AS e FROM p0),
    p2 AS (SELECT *, regexp_extract(e, '^([^:]+):', 1) AS acc, CAST(regexp_extract(e, '(?:^|:)<?([0-9]+)', 1) AS BIGINT) - 1 AS st, CAST(regexp_extract(e, '([0-9]+)$', 1) AS BIGINT) AS en0,
               contains(e, '^') AS between, regexp_matches(raw, 'complement\((?:[A-Za-z0-9_.]+:)?<?[0-9]+(?:\.\.>?[0-9]+|\^[0-9]+)?\)*$') AS own_rev,
               regexp_matches(location_gb, '^complement\((join|order|bond|one-of)\(') AS outer_rev FROM p1),
    p AS (SELECT feature_id, record_id, location_gb, pos, acc, CASE WHEN between THEN 'between' ELSE 'range' END AS kind, st, CASE WHEN between THEN en0 - 1 ELSE en0 END AS en, own_rev, outer_rev FROM p2)
"""
#: Stretches of the own record that parts stand on; a place between letters stands on both.
OWN = """, o AS (SELECT feature_id, record_id, st AS f_start, CASE WHEN kind = 'between' THEN en + 1 ELSE en END AS f_end FROM p WHERE acc = '' AND (kind = 'range' OR en = st + 1)
    UNION ALL SELECT feature_id, record_id, st, st + 1 FROM p WHERE acc = '' AND kind = 'between' AND en <> st + 1
    UNION ALL SELECT feature_id, record_id, en, en + 1 FROM p WHERE acc = '' AND kind = 'between' AND en <> st + 1)"""
#: Residues of every location, parts of other records fetched.
LETTERS = PARTS + rf""", k AS (SELECT key, min(record_id) AS home FROM (SELECT version AS key, record_id FROM records UNION ALL SELECT accession, record_id FROM records
              UNION ALL SELECT name, record_id FROM records) WHERE key IS NOT NULL AND key <> '' GROUP BY key),
        t AS (SELECT p.*, r.residues AS txt, regexp_matches(location_gb, '(^|[(,:])(order|bond|one-of)\(') AS listed FROM p LEFT JOIN k ON p.acc = k.key
              LEFT JOIN records r ON r.record_id = CASE WHEN p.acc = '' THEN p.record_id ELSE k.home END),
        x AS (SELECT *, CASE WHEN kind = 'range' AND st >= 0 AND st <= en AND en <= length(txt) THEN substr(txt, st + 1, en - st) END AS part FROM t),
        y AS (SELECT *, CASE WHEN outer_rev <> own_rev THEN {_RC.format('part')} ELSE part END AS letters, CASE WHEN outer_rev THEN -pos ELSE pos END AS place,
              CASE WHEN kind <> 'range' THEN 'ambiguous' WHEN txt IS NULL AND acc <> '' THEN 'external' WHEN part IS NULL THEN 'out_of_bounds' END AS error FROM x),
        z AS (SELECT feature_id, any_value(listed) AS listed, arg_min(error, place) FILTER (error IS NOT NULL) AS error, string_agg(letters, '' ORDER BY place) AS residues FROM y GROUP BY feature_id),
        letters AS (SELECT feature_id, CASE WHEN NOT listed AND error IS NULL THEN residues END AS residues, CASE WHEN listed THEN 'ambiguous' ELSE error END AS error FROM z)
"""
#: Records with their number of features and, where declared and real length agree, their length.
NESTED = """WITH m AS (SELECT record_id, residues, coalesce(topology = 'circular', false) AS circular, CAST(coalesce(n, 0) AS INTEGER) AS n,
        CASE WHEN locus_len IS NOT NULL AND coalesce(length(residues), 0) > 0 AND locus_len <> length(residues) THEN NULL ELSE coalesce(locus_len, length(residues), 0) END AS len
    FROM records LEFT JOIN (SELECT record_id, count(DISTINCT feature_id) AS n FROM features WHERE kind IS NOT NULL AND location_gb IS NOT NULL GROUP BY record_id) USING (record_id))
"""
_CODES = native.CODES[:15]
_COUNTS = ", ".join(f"CAST(coalesce(sum(length(residues) - length(replace(upper(residues), '{c}', ''))), 0) AS BIGINT) AS n_{c.lower()}" for c in _CODES)
_MONTH = "list_extract(['" + "','".join(native.MONTHS) + "'], date.month)"
_DATE = f"lpad(CAST(date.day AS VARCHAR), 2, '0') || '-' || {_MONTH} || '-' || lpad(CAST(date.year AS VARCHAR), 4, '0')"
_CUT = """SELECT {k}, n, running FROM (SELECT {k}, n, CAST(sum(n) OVER (ORDER BY n DESC, {k} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, sum(n) OVER () AS total FROM ({t}) WHERE {k} IS NOT NULL)
          WHERE running - n <= floor(total * 0.99)"""
_KINDS = "SELECT kind, count(*) AS n FROM features GROUP BY kind"
_KEYS = "SELECT q.key AS key, count(*) AS n FROM (SELECT unnest(qualifiers) AS q FROM features) GROUP BY 1"

ORACLE = {
    "revcomp_residues": f"SELECT record_id, {_RC.format('residues')} AS rc FROM records",
    "residue_composition": f"SELECT division, CAST(sum(length(residues)) AS BIGINT) AS letters, {_COUNTS} FROM records GROUP BY division",
    "record_lengths": """SELECT record_id, CASE WHEN locus_len IS NOT NULL AND coalesce(length(residues), 0) > 0 AND locus_len <> length(residues) THEN NULL
        ELSE coalesce(locus_len, length(residues), 0) END AS length, coalesce(topology = 'circular', false) AS circular FROM records""",
    "unwrapped_ranges": _RANGES + 'SELECT record_id, s AS start, e AS "end" FROM r',
    "range_residues": _RANGES + "SELECT record_id, substr(repeat(residues, CAST(ceil(e / n) AS BIGINT)), s + 1, e - s) AS letters FROM r",
    "range_locations": _RANGES
    + f"SELECT record_id, CASE WHEN s >= e THEN NULL WHEN e <= n THEN {_shown('s', 'e')} WHEN e < 2 * n THEN 'join(' || {_shown('s', 'n')} || ',' || {_shown('0', 'e - n')} || ')' END AS location FROM r",
    "rotated_residues": _RANGES + "SELECT record_id, substr(residues, s + 1) || substr(residues, 1, s) AS rotated FROM r WHERE circular",
    "simple_locations": _SIMPLE_SQL + 'SELECT feature_id, st AS start, en AS "end", lo AS before, hi AS after, rev AS reverse FROM s',
    "location_round_trip": f"SELECT feature_id, {CANONICAL} AS shown FROM features",
    "location_segments": PARTS + """SELECT feature_id, CAST(row_number() OVER (PARTITION BY feature_id ORDER BY CASE WHEN outer_rev THEN -pos ELSE pos END) - 1 AS INTEGER) AS seg_idx,
        nullif(acc, '') AS accession, kind, st AS start, en AS "end", CAST(CASE WHEN outer_rev <> own_rev THEN -1 ELSE 1 END AS INTEGER) AS strand FROM p""",
    "list_bounds": PARTS + rf""", l AS (SELECT f.feature_id, f.location_gb, min(CASE WHEN acc = '' THEN st END) AS least, max(CASE WHEN acc = '' THEN CASE WHEN kind = 'between' THEN en + 1 ELSE en END END) AS most,
            arg_min(CASE WHEN acc = '' THEN st END, pos) FILTER (pos = first) AS a, arg_max(CASE WHEN acc = '' THEN CASE WHEN kind = 'between' THEN en + 1 ELSE en END END, pos) FILTER (pos = last) AS b
            FROM (SELECT *, min(pos) OVER (PARTITION BY feature_id) AS first, max(pos) OVER (PARTITION BY feature_id) AS last FROM p) f GROUP BY f.feature_id, f.location_gb),
        t AS (SELECT *, regexp_matches(location_gb, '^(complement\()?(join|order)\(') AS in_order FROM l),
        w AS (SELECT *, CASE WHEN in_order THEN CASE WHEN a IS NULL OR b IS NULL THEN 'ambiguous' END WHEN least IS NULL THEN 'empty' END AS error FROM t)
        SELECT feature_id, CASE WHEN error IS NULL THEN CASE WHEN in_order THEN a ELSE least END END AS start, CASE WHEN error IS NULL THEN CASE WHEN in_order THEN b ELSE most END END AS "end", error
        FROM features JOIN w USING (feature_id) WHERE regexp_matches(features.location_gb, '{FLAT_LIST}')""",
    "sql_location_functions": _SIMPLE_SQL
    + f""", t AS (SELECT *, st >= 100 AND st < 500 AS si, en > 100 AND en <= 500 AS ei, CASE WHEN st >= 0 AND st <= en AND en <= n THEN substr(residues, st + 1, en - st) END AS x FROM n)
        SELECT feature_id, st AS start, en AS "end", CASE WHEN si OR ei OR (st <= 100 AND en >= 500) THEN {_wrapped(_shown("CASE WHEN si THEN st ELSE 100 END", "CASE WHEN ei THEN en ELSE 500 END", "lo AND si", "hi AND ei"))} END AS truncated,
            {_wrapped(_shown("st + 7", "en + 7", "lo", "hi"))} AS moved, CASE WHEN rev THEN {_shown('n - en', 'n - st', 'hi', 'lo')} ELSE 'complement(' || {_shown('n - en', 'n - st', 'hi', 'lo')} || ')' END AS reversed,
            {_wrapped(_shown("st", "en", "lo", "hi"))} AS shown, {_wrapped(_shown("st", "en", "lo", "hi"))} AS simplified, md5(CASE WHEN rev THEN {_RC.format('x')} ELSE x END) AS letters, md5({_RC.format('residues')}) AS turned FROM t""",
    "location_residues": LETTERS + "SELECT feature_id, residues, error FROM letters",
    "cds_fasta": LETTERS + r""", c AS (SELECT f.feature_id, r.name || '_' || list_filter(qualifiers, lambda q: q.key = 'locus_tag' AND q.value IS NOT NULL)[1].value || '_' || list_filter(qualifiers, lambda q: q.key = 'gene' AND q.value IS NOT NULL)[1].value AS header
            FROM (SELECT DISTINCT ON (feature_id) * FROM features) f JOIN records r USING (record_id) WHERE kind = 'CDS')
        SELECT c.feature_id, '>' || header || chr(10) || rtrim(regexp_replace(residues, '(.{60})', '\1' || chr(10), 'g'), chr(10)) || chr(10) AS fasta, coalesce(error, CASE WHEN header IS NULL THEN 'no_name' END) AS error FROM c LEFT JOIN letters USING (feature_id)""",
    "reversed_records": NESTED + f"""SELECT record_id, CAST(length(residues) AS INTEGER) AS letters, CASE WHEN len IS NULL THEN 0 ELSE n END AS n_features, md5({_RC.format('residues')}) AS digest FROM m""",
    "rotated_records": NESTED + """, t AS (SELECT *, circular AND coalesce(length(residues), 0) > 0 AS turns, record_id % 997 AS origin FROM m),
        u AS (SELECT *, CASE WHEN turns AND len IS NOT NULL THEN substr(residues, CAST((origin % len) % length(residues) AS BIGINT) + 1) || substr(residues, 1, CAST((origin % len) % length(residues) AS BIGINT)) ELSE residues END AS turned FROM t)
        SELECT record_id, substr(turned, 1, 60) AS head, md5(turned) AS digest, CASE WHEN turns AND len IS NULL THEN 0 ELSE n END AS n_features, CASE WHEN turns AND len IS NULL THEN n ELSE 0 END AS n_warnings FROM u""",
    "record_regions": PARTS.replace("WITH ", NESTED.rstrip() + ", ", 1) + """, v AS (SELECT *, coalesce(len > 0 AND (circular OR (len >= 150)), false) AS valid FROM m),
        q AS (SELECT p.*, v.circular, v.len, v.valid, CASE WHEN v.circular THEN st + ((-50 % len) + len) % len ELSE st - 50 END AS a0, CASE WHEN v.circular THEN en + ((-50 % len) + len) % len ELSE en - 50 END AS b0
              FROM p JOIN v USING (record_id) JOIN (SELECT DISTINCT feature_id FROM features WHERE kind IS NOT NULL) USING (feature_id) WHERE v.valid),
        w AS (SELECT *, CASE WHEN circular AND kind = 'range' THEN a0 - greatest(a0 // len, 0) * len ELSE a0 END AS a, CASE WHEN circular AND kind = 'range' THEN b0 - greatest(a0 // len, 0) * len ELSE b0 END AS b FROM q),
        k AS (SELECT record_id, count(DISTINCT feature_id) AS kept FROM w WHERE acc <> '' OR CASE WHEN kind = 'between' THEN (a >= 0 AND a < 100) OR (b >= 0 AND b < 100)
              ELSE (a < 100 AND b > 0) OR (circular AND b > len) END GROUP BY record_id)
        SELECT record_id, CASE WHEN valid AND length(residues) > 0 THEN CASE WHEN circular THEN substr(repeat(residues, CAST(ceil((50 % length(residues) + 100) / length(residues)) AS BIGINT)), CAST(50 % length(residues) + 1 AS BIGINT), 100)
            WHEN length(residues) >= 150 THEN substr(residues, 51, 100) END END AS residues, CAST(coalesce(kept, 0) AS INTEGER) AS n_features, CASE WHEN NOT valid THEN 'region out of range' END AS _error FROM v LEFT JOIN k USING (record_id)""",
    "written_and_read_all": NESTED + "SELECT record_id, coalesce(residues, '') AS residues, n AS n_features, CAST(NULL AS VARCHAR) AS error FROM m",
    "region_overlap_all": PARTS + f"""{{own}}, g AS (SELECT record_id, unnest(generate_series(0, length(residues) - 1, {REGION})) AS start FROM records WHERE length(residues) > 0)
        SELECT g.record_id, g.start, o.feature_id, o.f_start, o.f_end FROM g JOIN o ON g.record_id = o.record_id AND o.f_start < g.start + {REGION} AND g.start < o.f_end AND o.f_start < o.f_end""".replace("{own}", OWN),
    "merged_spans_all": PARTS + OWN + """, s AS (SELECT record_id, f_start AS st, f_end AS en FROM o),
        i0 AS (SELECT record_id, st, en, CASE WHEN st <= max(en) OVER (PARTITION BY record_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY record_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM i0)
        SELECT record_id, min(st) AS start, max(en) AS "end", count(*) AS n_spans FROM i GROUP BY record_id, island""",
    "truncated_locations": _SIMPLE_SQL
    + f""", t AS (SELECT *, st >= 100 AND st < 500 AS si, en > 100 AND en <= 500 AS ei FROM s)
        SELECT feature_id, {_wrapped(_shown("CASE WHEN si THEN st ELSE 100 END", "CASE WHEN ei THEN en ELSE 500 END", "lo AND si", "hi AND ei"))} AS location
        FROM t WHERE si OR ei OR (st <= 100 AND en >= 500)""",
    "moved_locations": _SIMPLE_SQL
    + f""", m AS (SELECT *, record_id % 500 - 250 AS d FROM n WHERE en <= n AND st >= 0 AND st < en),
        w0 AS (SELECT *, CASE WHEN circular THEN st + ((d % n) + n) % n ELSE st + d END AS a, CASE WHEN circular THEN en + ((d % n) + n) % n ELSE en + d END AS b FROM m),
        w AS (SELECT *, CASE WHEN circular AND a >= n THEN a - n ELSE a END AS x, CASE WHEN circular AND a >= n THEN b - n ELSE b END AS y FROM w0)
        SELECT feature_id, CASE WHEN circular AND y > n THEN {_wrapped("'join(' || " + _shown("x", "n", "lo") + " || ',' || " + _shown("0", "y - n", "false", "hi") + " || ')'")}
               ELSE {_wrapped(_shown("x", "y", "lo", "hi"))} END AS location FROM w""",
    "reversed_locations": _SIMPLE_SQL
    + f"SELECT feature_id, CASE WHEN rev THEN {_shown('n - en', 'n - st', 'hi', 'lo')} ELSE 'complement(' || {_shown('n - en', 'n - st', 'hi', 'lo')} || ')' END AS location FROM n",
    "feature_residues": _SIMPLE_SQL
    + f", p AS (SELECT *, CASE WHEN st >= 0 AND st <= en AND en <= n THEN substr(residues, st + 1, en - st) END AS x FROM n) SELECT feature_id, CASE WHEN rev THEN {_RC.format('x')} ELSE x END AS letters FROM p",
    "segment_counts": "SELECT DISTINCT feature_id, length(location_gb) - length(replace(location_gb, ',', '')) + 1 AS n_segments FROM features WHERE location_gb IS NOT NULL",
    "external_lookup": r"""WITH f AS (SELECT DISTINCT feature_id, location_gb FROM features WHERE contains(location_gb, ':')),
        x AS (SELECT feature_id, unnest(regexp_extract_all(location_gb, '[A-Za-z0-9_.]+:<?[0-9]+(?:\.\.>?[0-9]+)?')) AS part FROM f),
        y AS (SELECT feature_id, regexp_extract(part, '^([^:]+):', 1) AS accession, CAST(regexp_extract(part, ':<?([0-9]+)', 1) AS BIGINT) - 1 AS start,
                     CAST(regexp_extract(part, '([0-9]+)$', 1) AS BIGINT) AS "end" FROM x),
        k AS (SELECT key, min(record_id) AS key_record_id FROM (SELECT version AS key, record_id FROM records UNION ALL SELECT accession, record_id FROM records
              UNION ALL SELECT name, record_id FROM records) WHERE key IS NOT NULL AND key <> '' GROUP BY key)
        SELECT feature_id, accession, start, "end", key_record_id FROM y LEFT JOIN k ON accession = key""",
    "region_overlap": _SIMPLE_SQL
    + f""", g AS (SELECT record_id, unnest(generate_series(0, length(residues) - 1, {REGION})) AS start FROM records WHERE length(residues) > 0)
        SELECT g.record_id, g.start, s.feature_id, s.st AS f_start, s.en AS f_end FROM g JOIN s ON g.record_id = s.record_id AND s.st < g.start + {REGION} AND g.start < s.en AND s.st < s.en""",
    "region_features": _SIMPLE_SQL
    + f""", g AS (SELECT record_id, unnest(generate_series(0, length(residues) - 1, {REGION})) AS start FROM records WHERE length(residues) > 0),
        h AS (SELECT g.record_id, g.start AS region_id, s.feature_id, s.st - g.start AS a, s.en - g.start AS b, lo, hi, rev FROM g JOIN s ON g.record_id = s.record_id AND s.st < g.start + {REGION} AND g.start < s.en AND s.st < s.en)
        SELECT record_id, region_id, feature_id, {_wrapped(_shown("greatest(a, 0)", f"least(b, {REGION})", "lo AND a >= 0", f"hi AND b <= {REGION}"))} AS location_gb FROM h""",
    "merged_spans": _SIMPLE_SQL
    + """, o AS (SELECT record_id, st, en, CASE WHEN st <= max(en) OVER (PARTITION BY record_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY record_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM o)
        SELECT record_id, min(st) AS start, max(en) AS "end", count(*) AS n_spans FROM i GROUP BY record_id, island""",
    "locus_lines": rf"""WITH r AS (SELECT *, CAST(coalesce(locus_len, length(residues), 0) AS VARCHAR) AS n, coalesce(name, accession, 'UNTITLED') AS nm FROM records),
        e AS (SELECT *, CASE WHEN regexp_matches(trim(regexp_replace(nm, '\s+', ' ', 'g')), ' ') THEN replace(trim(regexp_replace(nm, '\s+', ' ', 'g')), ' ', '_') ELSE nm END AS locus, coalesce(molecule_type, '') AS mt FROM r)
        SELECT record_id, 'LOCUS       ' || locus || repeat(' ', greatest(28 - length(locus) - length(n), 1)) || n || ' bp    ' || (CASE WHEN length(mt) >= 7 THEN mt ELSE rpad(mt, 7, ' ') END)
            || ' ' || coalesce(topology, 'linear') || ' ' || coalesce(division, 'UNK') || ' ' || coalesce({_DATE}, '01-JAN-1970') AS line FROM e""",
    "locus_parsed": """SELECT record_id, name, locus_len, molecule_type, topology, division, true AS ok FROM records WHERE regexp_matches(name, '^[A-Za-z0-9_.]+$')
        AND regexp_matches(molecule_type, '^[A-Za-z-]+$') AND regexp_matches(division, '^[A-Z]+$') AND locus_len IS NOT NULL AND topology IN ('linear', 'circular')""",
    "date_texts": f"SELECT record_id, {_DATE} AS text, TRY_CAST(lpad(CAST(date.year AS VARCHAR), 4, '0') || '-' || lpad(CAST(date.month AS VARCHAR), 2, '0') || '-' || lpad(CAST(date.day AS VARCHAR), 2, '0') AS DATE)::VARCHAR AS day FROM records",
    "origin_blocks": """SELECT record_id, CASE WHEN coalesce(length(residues), 0) = 0 THEN '' ELSE 'ORIGIN      ' || chr(10) || array_to_string(list_transform(generate_series(0, CAST((length(residues) - 1) // 60 AS BIGINT)),
        lambda i: lpad(CAST(i * 60 + 1 AS VARCHAR), CAST(greatest(9, length(CAST(i * 60 + 1 AS VARCHAR))) AS INTEGER), ' ') || ' ' || rtrim(regexp_replace(substr(residues, i * 60 + 1, 60), '(.{10})', '\\1 ', 'g'))), chr(10)) || chr(10) END AS block FROM records""",
    "scanned_residues": "SELECT record_id, CASE WHEN regexp_full_match(coalesce(residues, ''), '[A-Za-z]*') THEN coalesce(residues, '') END AS letters FROM records",
    "fasta_texts": r"SELECT record_id, '>' || accession || chr(10) || rtrim(regexp_replace(residues, '(.{60})', '\1' || chr(10), 'g'), chr(10)) || chr(10) AS fasta FROM records WHERE residues <> '' AND accession IS NOT NULL",
    "source_totals": """SELECT _source_file, count(*) AS n_records, CAST(sum(coalesce(locus_len, 0)) AS BIGINT) AS declared, CAST(sum(coalesce(length(residues), 0)) AS BIGINT) AS letters,
        sum(coalesce(locus_len, 0)) = sum(coalesce(length(residues), 0)) AS agrees FROM records GROUP BY _source_file""",
    "kind_frequency": _KINDS,
    "key_frequency": _KEYS,
    "frequent_kinds": _CUT.format(k="kind", t=_KINDS),
    "frequent_keys": _CUT.format(k="key", t=_KEYS),
    "product_values": "SELECT feature_id, list_transform(list_filter(qualifiers, lambda q: q.key = 'product' AND q.value IS NOT NULL), lambda q: q.value) AS products FROM features",
    "written_and_read": """SELECT record_id, residues, coalesce(n, 0) AS n_features, CAST(NULL AS VARCHAR) AS error FROM records
        LEFT JOIN (SELECT record_id, count(DISTINCT feature_id) AS n FROM features WHERE kind IS NOT NULL AND location_gb IS NOT NULL GROUP BY record_id) USING (record_id)
        WHERE length(residues) > 0 AND regexp_matches(residues, '^[A-Za-z]+$')""",
}
