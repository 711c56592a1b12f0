"""Flat files of annotated sequences as a source and sink of DataFrames, batch and streaming.

The text source splits files at ``//`` lines, so large files are read by many tasks; gzip files are
read by one task each. Records go to Python once, in Arrow batches, and come back as typed rows.
With ``columns`` only what is asked for comes back.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from seqloom.functions import native
from seqloom.schema import RECORD, RECORD_FIELDS
from seqloom.sources.record_text import read_record, read_text, repair_latin1
from seqloom.sources.record_writer import body_text

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
#: Record texts in one Arrow batch; records may be large.
BATCH_RECORDS = 64
_SEPARATOR = "\n//"
_FILE_FIELDS = [T.StructField("_source_file", T.StringType()), T.StructField("_block_start", T.LongType()), T.StructField("_block_idx", T.LongType())]


def record_schema(columns: list[str] | None = None) -> T.StructType:
    """The chosen fields in their usual order; errors and warnings are always there."""
    keep = None if columns is None else {*columns, "_warnings", "_error", "_corrupt_record"}
    return T.StructType([f for f in RECORD_FIELDS if keep is None or f.name in keep])


def _parser(schema: T.StructType, mode: str):
    names = [f.name for f in schema.fields]
    own = [f.name for f in _FILE_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(T.StructType([*_FILE_FIELDS, *schema.fields]))
        seen: dict[tuple, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_RECORDS):
                some = batch.slice(at, BATCH_RECORDS)
                rows = []
                for text, file, start in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist()):
                    idx = seen[file, start] = seen.get((file, start), -1) + 1
                    record = read_record(text)
                    if record["_error"] and mode == "FAILFAST":
                        raise ValueError(f"{file}: {record['_error']}")
                    if record["_error"] and mode == "DROPMALFORMED":
                        continue
                    rows.append(dict(zip(own, (file, start, idx))) | {n: record[n] for n in names})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return run


def _texts(lines: DataFrame, repair: bool) -> DataFrame:
    """One row for each record text: no blank rests, no rest of a ``//`` line, no carriage return at the end."""
    value = native.repaired_text("value") if repair else F.col("value")
    text = F.regexp_replace(value, r"\A[ \t]*\r?\n", "")
    rows = lines.select(text.alias("text"), F.col("_metadata.file_name").alias("_source_file"), F.col("_metadata.file_block_start").alias("_block_start"))
    return rows.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def read_genbank(spark: SparkSession, path, mode: str = "PERMISSIVE", columns: list[str] | None = None, encoding_repair: bool = True) -> DataFrame:
    """Records of flat files, plain or gzip. Mode: keep errors as rows, drop them, or fail at the first.

    A missing last ``//`` is tolerated. ``_block_idx`` counts records within a split of a file (errors
    count, too); :func:`with_record_index` numbers them within the file.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    schema = record_schema(columns)
    lines = spark.read.text(path, lineSep=_SEPARATOR)
    return _texts(lines, encoding_repair).mapInArrow(_parser(schema, mode), T.StructType([*_FILE_FIELDS, *schema.fields]))


def stream_genbank(spark: SparkSession, path: str, mode: str = "PERMISSIVE", columns: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """Records of the files that appear in a folder; stateless, one micro-batch for some files."""
    schema = record_schema(columns)
    reader = spark.readStream.option("lineSep", _SEPARATOR)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _texts(reader.text(path), True).mapInArrow(_parser(schema, mode), T.StructType([*_FILE_FIELDS, *schema.fields]))


def with_record_index(records: DataFrame) -> DataFrame:
    """Add ``_record_idx``, the place within the file: counts of earlier splits plus the place in the own one."""
    sizes = records.groupBy("_source_file", "_block_start").agg((F.max("_block_idx") + 1).alias("n"))
    before = Window.partitionBy("_source_file").orderBy("_block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_source_file", "_block_start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_earlier"))
    out = records.join(offsets, ["_source_file", "_block_start"])
    return out.withColumn("_record_idx", (F.col("_earlier") + F.col("_block_idx")).cast("int")).drop("_earlier", "_block_start", "_block_idx")


@F.arrow_udf(T.ArrayType(RECORD))
def parse_genbank(texts: pa.Array) -> pa.Array:
    """Array of the records of a text."""
    return pa.array([None if t is None else read_text(t) for t in texts.to_pylist()], to_arrow_type(T.ArrayType(RECORD)))


@F.udtf(returnType=RECORD)
class GenbankTable:
    """``SELECT * FROM gb_parse(text)``: one row for each record of the text."""

    def eval(self, text: str):
        for record in read_text(text):
            yield tuple(record[f.name] for f in RECORD_FIELDS)


@F.arrow_udf(T.StringType())
def format_record(records: pa.Array) -> pa.Array:
    """Flat-file text of each record struct, for SQL; :func:`to_genbank` leaves LOCUS line and residues to the JVM."""
    return pa.array([None if r is None else record_to_text(r) for r in records.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _body(records: pa.Array) -> pa.Array:
    return pa.array([body_text(row) for row in records.to_pylist()], pa.string())


_BODY_FIELDS = ("definition", "accession", "version", "dblink", "keywords", "source", "references", "comments", "contig", "features")


def to_genbank(records: DataFrame, truncate_locus: bool = False, escape_locus: bool = True) -> Column:
    """Flat-file text of each row. Fields that ``records`` lacks are left out.

    LOCUS line and residues are built by the JVM; only header and features go through Python.
    """
    types = {f.name: f.dataType for f in RECORD_FIELDS}

    def c(name: str) -> Column:
        return F.col(name) if name in records.columns else F.lit(None).cast(types[name])

    length = F.coalesce(c("locus_len"), F.length(c("residues")).cast("long"), F.lit(0))
    locus = native.locus_line(c("name"), c("accession"), length, c("molecule_type"), c("topology"), c("division"), c("date"), truncate_locus, escape_locus)
    body = _body(F.struct(*[c(name).alias(name) for name in _BODY_FIELDS]))
    return F.concat(locus, F.lit("\n"), body, native.origin_block(c("residues")), F.lit("//\n"))


def write_genbank(records: DataFrame, path: str, truncate_locus: bool = False, escape_locus: bool = True, mode: str = "error", compression: str | None = None) -> None:
    """One text file for each partition."""
    text = F.regexp_replace(to_genbank(records, truncate_locus, escape_locus), r"\n\z", "")
    out = records.select(text.alias("value")).write.mode(mode)
    (out.option("compression", compression) if compression else out).text(path)


def write_fasta(df: DataFrame, path: str, header: str = "header", residues: str = "residues", mode: str = "error") -> None:
    text = F.regexp_replace(native.fasta(header, residues), r"\n\z", "")
    df.where(F.col(header).isNotNull() & F.col(residues).isNotNull()).select(text.alias("value")).write.mode(mode).text(path)


def _file_system(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.\-]*:", path) else (fs.LocalFileSystem(), path)


class _FilePart(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.path, self.mode = [f.name for f in schema.fields], options["path"], options.get("mode", "PERMISSIVE").upper()

    def partitions(self):
        from pyarrow import fs

        system, path = _file_system(self.path)
        if system.get_file_info(path).type == fs.FileType.Directory:
            found = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        else:
            found = [path]
        return [_FilePart(f) for f in sorted(found)] or [_FilePart(None)]

    def read(self, partition):
        if partition.value is None:
            return
        with _file_system(self.path)[0].open_input_stream(partition.value, compression="gzip" if partition.value.endswith(".gz") else None) as f:
            text = repair_latin1(f.read())
        for record in read_text(text):
            if record["_error"] and self.mode == "FAILFAST":
                raise ValueError(record["_error"])
            if not record["_error"] or self.mode != "DROPMALFORMED":
                yield tuple(record[n] for n in self.names)


@dataclass
class _Part(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    """Each task writes a file that readers don't see; the commit gives those of the tasks that count their names."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows):
        system, folder = _file_system(self.path)
        system.create_dir(folder, recursive=True)
        part = f"{folder}/_{uuid.uuid4().hex}.gb"
        with system.open_output_stream(part) as out:
            for row in rows:
                out.write(record_to_text(row.asDict(recursive=True)).encode())
        return _Part(part)

    def commit(self, messages):
        from pyarrow import fs

        system, folder = _file_system(self.path)
        if self.overwrite and system.get_file_info(folder).type == fs.FileType.Directory:
            for old in system.get_file_info(fs.FileSelector(folder)):
                if old.type == fs.FileType.File and not old.base_name.startswith("_"):
                    system.delete_file(old.path)
        for m in messages:
            if m is not None:
                system.move(m.path, f"{folder}/part-{m.path.rsplit('/_', 1)[1]}")

    def abort(self, messages):
        system, _ = _file_system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class GenbankSource(DataSource):
    """``spark.read.format("genbank")`` over files of a shared folder, one task a file. :func:`read_genbank` splits large files."""

    @classmethod
    def name(cls):
        return "genbank"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def record_to_text(record: dict, truncate_locus: bool = False, escape_locus: bool = True) -> str:
    """Flat-file text of one record, without Spark."""
    residues = record.get("residues") or ""
    length = str(record["locus_len"] if record.get("locus_len") is not None else len(residues))
    locus = next((x for x in (record.get("name"), record.get("accession")) if x is not None), "UNTITLED")
    kind = record.get("molecule_type") or ""
    if truncate_locus:
        locus = locus[: 27 - len(length)] if len(locus) + 1 + len(length) > 28 else locus
        kind = "" if len(kind) > 7 else kind
    if escape_locus and len(locus.split()) > 1:
        locus = "_".join(locus.split())
    date = record.get("date")
    when = f"{date['day']:02}-{native.MONTHS[date['month'] - 1]}-{date['year']:04}" if date else "01-JAN-1970"
    gap = " " * max(28 - len(locus) - len(length), 1)
    first = f"LOCUS       {locus}{gap}{length} bp    {kind:<7} {record.get('topology') or 'linear'} {record.get('division') or 'UNK'} {when}\n"
    origin = ""
    if residues:
        rows = (f"{i + 1:>9} " + " ".join(residues[j : j + 10] for j in range(i, min(i + 60, len(residues)), 10)) for i in range(0, len(residues), 60))
        origin = "ORIGIN      \n" + "".join(row + "\n" for row in rows)
    return first + body_text(record) + origin + "//\n"
