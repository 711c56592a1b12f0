"""Queries over flat files: the tables are written as files once, and everything is read back from these.

The LOCUS name of a written record is R and its ``record_id``, so results can be compared with the tables. Text is
wrapped when it is written, so texts are compared without white space; everything else is compared as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import native
from seqloom.functions.location_udf import register
from seqloom.operators import records as ops
from seqloom.operators import statistics as stats
from seqloom.session import by_key, new_folder, table
from seqloom.sources.genbank import read_genbank, stream_genbank, write_genbank
from seqloom.plans.sequence_queries import CANONICAL
from seqloom.streaming.feature_stream import run_available

_FOLDERS: dict[tuple, str] = {}
_REFERENCE = ("description", "authors", "consortium", "title", "journal", "pubmed", "remark")


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its references and features in order; rows that repeat an id count once."""
    f = table(spark, sf_dir, "features").dropDuplicates(["feature_id"]).where("kind IS NOT NULL AND location_gb IS NOT NULL")
    kind = F.regexp_replace(F.btrim("kind"), " ", "_")
    quals = F.filter(F.coalesce("qualifiers", F.array().cast("array<struct<key:string,value:string>>")), lambda q: q["key"].isNotNull())
    f = f.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("feature_idx", "feature_id", kind.alias("kind"), "location_gb", quals.alias("qualifiers")))).alias("f"))
    none = F.lit(None).cast("array<struct<op:string,parent:int,start:bigint,end:bigint,before:boolean,after:boolean,accession:string,gap_kind:string,gap_len:bigint>>")
    listed = F.transform("f", lambda x: F.struct(x["kind"].alias("kind"), none.alias("location"), x["location_gb"].alias("location_gb"), x["qualifiers"].alias("qualifiers")))
    r = table(spark, sf_dir, "record_refs").dropDuplicates(["ref_id"])
    r = r.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("ref_idx", "ref_id", *_REFERENCE))).alias("r"))
    refs = F.transform("r", lambda x: F.struct(*[x[c].alias(c) for c in _REFERENCE]))
    out = by_key(table(spark, sf_dir, "records"), "record_id").join(f.select("record_id", listed.alias("features")), "record_id", "left").join(r.select("record_id", refs.alias("references")), "record_id", "left")
    n = F.length("residues").cast("long")
    return out.withColumns({"name": F.concat(F.lit("R"), F.col("record_id").cast("string")), "locus_len": F.when(n > 0, n).otherwise(F.col("locus_len"))})


def _files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the files written from the tables, once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOLDERS:
        path = new_folder(spark)
        write_genbank(full_records(spark, sf_dir), path)
        _FOLDERS[key] = path
    return _FOLDERS[key]


def _id() -> Column:
    return F.regexp_extract("name", "^R([0-9]+)$", 1).try_cast("long").alias("record_id")


def _bare(text) -> Column:
    """Text without white space: where lines are wrapped doesn't matter."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def _header(records: DataFrame) -> DataFrame:
    date = native.format_date("date").alias("date")
    source = [_bare(F.col("source.source")).alias("source"), _bare(F.col("source.organism")).alias("organism")]
    texts = [_bare(F.col(c)).alias(c) for c in ("definition", "accession", "version", "dblink", "keywords")]
    contig = F.array_join(F.transform("contig", lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("op", "start", "end", "before", "after", "accession", "gap_kind", "gap_len")])), " ")
    sizes = [F.size("references").alias("n_references"), F.size("features").alias("n_features")]
    return records.select(
        _id(), "topology", "locus_len", "molecule_type", "division", date, *texts, *source, _bare(F.array_join("comments", "|")).alias("comments"), F.md5("residues").alias("residues"), contig.alias("contig"), *sizes, F.col("_error").alias("error"),
    )


def files_read(spark, sf_dir):
    """Header, residues and contig of every record, read from files."""
    return _header(read_genbank(spark, _files(spark, sf_dir)))


def files_streamed(spark, sf_dir):
    """The same through the streaming reader, two files a micro-batch."""
    stream = stream_genbank(spark, _files(spark, sf_dir), max_files=2)
    path = new_folder(spark)
    query = _header(stream).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def files_stream_totals(spark, sf_dir):
    """Running totals of each division at the end of a stream over the files."""
    from seqloom.streaming.feature_stream import division_totals, record_stream

    folder = new_folder(spark)
    name = "totals_" + folder.rsplit("-", 1)[-1]
    return run_available(division_totals(record_stream(spark, _files(spark, sf_dir), max_files=2)), name, folder)


def files_features(spark, sf_dir):
    """Each feature of the files with its place, kind and location."""
    rows = read_genbank(spark, _files(spark, sf_dir), columns=["name", "features"]).select(_id(), F.posexplode("features").alias("pos", "f"))
    return rows.select("record_id", "pos", "f.kind", "f.location_gb", F.size("f.qualifiers").alias("n_qualifiers"))


def files_qualifiers(spark, sf_dir):
    """Each qualifier of the files with the places of its feature and its own."""
    rows = read_genbank(spark, _files(spark, sf_dir), columns=["name", "features"]).select(_id(), F.posexplode("features").alias("pos", "f"))
    rows = rows.select("record_id", "pos", F.posexplode("f.qualifiers").alias("q_pos", "q"))
    return rows.select("record_id", "pos", "q_pos", "q.key", _bare(F.col("q.value")).alias("value"))


def files_references(spark, sf_dir):
    """Each reference of the files with its place and fields."""
    rows = read_genbank(spark, _files(spark, sf_dir), columns=["name", "references"]).select(_id(), F.posexplode("references").alias("pos", "r"))
    return rows.select("record_id", "pos", *[_bare(F.col(f"r.{c}")).alias(c) for c in _REFERENCE])


def files_statistics(spark, sf_dir):
    """Kinds of the features of the files, by frequency."""
    rows = read_genbank(spark, _files(spark, sf_dir), columns=["features"]).select(F.explode("features").alias("f")).select("f.kind")
    return stats.kind_frequency(rows)


def files_reversed(spark, sf_dir):
    """Files read, every record reversed, written, and read again."""
    records = read_genbank(spark, _files(spark, sf_dir), mode="DROPMALFORMED")
    back = records.select("name", "locus_len", "residues", "topology", "molecule_type", "division", "date", "features")
    path = new_folder(spark)
    write_genbank(ops.revcomp_records(back), path)
    out = read_genbank(spark, path, columns=["name", "residues", "features"])
    return out.select(_id(), F.md5("residues").alias("residues"), F.size("features").alias("n_features"), F.col("_error").alias("error"))


def sql_parsed(spark, sf_dir):
    """Texts written by the SQL function ``gb_format`` and parsed again by the table function ``gb_parse``."""
    register(spark)
    full = full_records(spark, sf_dir)
    full.createOrReplaceTempView("seqloom_records")
    return spark.sql(
        """WITH seqloom_texts AS (SELECT gb_format(struct(name, topology, date, locus_len, molecule_type, division, definition, accession, version, source, dblink,
                   keywords, references, comments, residues, contig, features)) AS text FROM seqloom_records)
           SELECT CAST(substr(g.name, 2) AS LONG) AS record_id, md5(g.residues) AS residues, size(g.features) AS n_features, g._error AS error
           FROM seqloom_texts, LATERAL gb_parse(text) g"""
    )


QUERIES = {
    f.__name__: f
    for f in (files_read, files_streamed, files_stream_totals, files_features, files_qualifiers, files_references, files_statistics, files_reversed, sql_parsed)
}


def _sql_bare(text: str) -> str:
    return rf"regexp_replace({text}, '[\s\x0b\x1c-\x1f\x85\xa0]+', '', 'g')"


_MONTH = "list_extract(['" + "','".join(native.MONTHS) + "'], date.month)"
_DATE = f"coalesce(CASE WHEN date.month BETWEEN 1 AND 12 THEN lpad(CAST(date.day AS VARCHAR), 2, '0') || '-' || {_MONTH} || '-' || lpad(CAST(date.year AS VARCHAR), 4, '0') END, '01-JAN-1970')"
_FEATURES = f"""f AS (SELECT record_id, feature_idx, replace(trim(kind), ' ', '_') AS kind, {CANONICAL} AS location_gb, list_filter(coalesce(qualifiers, []), lambda q: q.key IS NOT NULL) AS quals,
        CAST(row_number() OVER (PARTITION BY record_id ORDER BY feature_idx, feature_id) - 1 AS INTEGER) AS pos
    FROM (SELECT DISTINCT ON (feature_id) * FROM features) WHERE kind IS NOT NULL AND location_gb IS NOT NULL AND record_id IN (SELECT record_id FROM records))"""
_REFS = f"""r AS (SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY ref_idx, ref_id) - 1 AS INTEGER) AS pos, {', '.join(_REFERENCE)}
    FROM (SELECT DISTINCT ON (ref_id) * FROM record_refs) WHERE record_id IN (SELECT record_id FROM records))"""
_CONTIG = """array_to_string(list_transform(CASE WHEN len(contig) > 0 THEN contig END, lambda part: concat_ws(':', part.op, part.start, part."end", part.before, part.after, part.accession, part.gap_kind, part.gap_len)), ' ')"""
_N = "CASE WHEN length(residues) > 0 THEN CAST(length(residues) AS BIGINT) ELSE coalesce(locus_len, 0) END"
_READ = f"""WITH {_FEATURES}, {_REFS}, fn AS (SELECT record_id, CAST(count(*) AS INTEGER) AS n FROM f GROUP BY 1), rn AS (SELECT record_id, CAST(count(*) AS INTEGER) AS n FROM r GROUP BY 1)
    SELECT x.record_id, CASE WHEN molecule_type IS NULL THEN 'linear' ELSE coalesce(topology, 'linear') END AS topology, {_N} AS locus_len,
        coalesce(molecule_type, topology, 'linear') AS molecule_type, coalesce(division, 'UNK') AS division, {_DATE} AS date,
        {', '.join(_sql_bare(c) + ' AS ' + c for c in ('definition', 'accession', 'version', 'dblink', 'keywords'))},
        {_sql_bare("CASE WHEN source IS NOT NULL THEN coalesce(source.source, '') END")} AS source, {_sql_bare('source.organism')} AS organism,
        {_sql_bare("coalesce(array_to_string(comments, '|'), '')")} AS comments, md5(coalesce(residues, '')) AS residues, {_CONTIG} AS contig,
        coalesce(rn.n, 0) AS n_references, coalesce(fn.n, 0) AS n_features, CAST(NULL AS VARCHAR) AS error
    FROM records x LEFT JOIN fn ON fn.record_id = x.record_id LEFT JOIN rn ON rn.record_id = x.record_id"""
_RC = f"reverse(translate(coalesce(residues, ''), '{native.CODES}', '{native.COMPLEMENTS}'))"
ORACLE = {
    "files_read": _READ,
    "files_streamed": _READ,
    "files_stream_totals": """SELECT coalesce(division, 'UNK') AS division, count(*) AS n_records, CAST(0 AS BIGINT) AS n_errors, CAST(sum(coalesce(length(residues), 0)) AS BIGINT) AS letters, CAST(sum(n) AS BIGINT) AS n_features
        FROM records JOIN (SELECT record_id, count(feature_id) AS n FROM records LEFT JOIN (SELECT DISTINCT record_id, feature_id FROM features WHERE kind IS NOT NULL AND location_gb IS NOT NULL) USING (record_id) GROUP BY 1) USING (record_id) GROUP BY 1""",
    "files_features": f"WITH {_FEATURES} SELECT record_id, pos, kind, location_gb, CAST(len(quals) AS INTEGER) AS n_qualifiers FROM f",
    "files_qualifiers": f"""WITH {_FEATURES}, q AS (SELECT record_id, pos, unnest(quals) AS q, CAST(unnest(range(len(quals))) AS INTEGER) AS q_pos FROM f)
        SELECT record_id, pos, q_pos, q.key AS key, {_sql_bare('q.value')} AS value FROM q""",
    "files_references": f"WITH {_REFS} SELECT record_id, pos, {', '.join(_sql_bare(f'coalesce({c}, {chr(39) * 2})' if c in ('description', 'title') else c) + ' AS ' + c for c in _REFERENCE)} FROM r",
    "files_statistics": f"WITH {_FEATURES} SELECT kind, count(*) AS n FROM f GROUP BY kind",
    "files_reversed": f"""WITH {_FEATURES} SELECT record_id, md5({_RC}) AS residues, coalesce(CASE WHEN {_N} > 0 OR length(residues) > 0 THEN n END, n, 0) AS n_features, CAST(NULL AS VARCHAR) AS error
        FROM records LEFT JOIN (SELECT record_id, CAST(count(*) AS INTEGER) AS n FROM f GROUP BY 1) USING (record_id)""",
    "sql_parsed": f"""WITH {_FEATURES} SELECT record_id, md5(coalesce(residues, '')) AS residues, coalesce(n, 0) AS n_features, CAST(NULL AS VARCHAR) AS error
        FROM records LEFT JOIN (SELECT record_id, CAST(count(*) AS INTEGER) AS n FROM f GROUP BY 1) USING (record_id)""",
}
