"""Types of parsed records, features and locations."""

from __future__ import annotations

from pyspark.sql import types as T


def _f(name: str, kind, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind, nullable)


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

DATE = T.StructType([_f("year", _I), _f("month", _I), _f("day", _I)])
LOC_NODE = T.StructType(
    [_f("op", _S), _f("parent", _I), _f("start", _L), _f("end", _L), _f("before", _B), _f("after", _B), _f("accession", _S), _f("gap_kind", _S), _f("gap_len", _L)]
)
LOCATION = T.ArrayType(LOC_NODE)
QUALIFIERS = T.ArrayType(T.StructType([_f("key", _S), _f("value", _S)]))
SOURCE = T.StructType([_f("source", _S), _f("organism", _S)])
REFERENCE = T.StructType([_f(c, _S) for c in ("description", "authors", "consortium", "title", "journal", "pubmed", "remark")])
FEATURE = T.StructType([_f("kind", _S), _f("location", LOCATION), _f("location_gb", _S), _f("qualifiers", QUALIFIERS)])
RECORD_FIELDS = [
    _f("name", _S), _f("topology", _S), _f("date", DATE), _f("locus_len", _L), _f("molecule_type", _S), _f("division", _S),
    _f("definition", _S), _f("accession", _S), _f("version", _S), _f("source", SOURCE), _f("dblink", _S), _f("keywords", _S),
    _f("references", T.ArrayType(REFERENCE)), _f("comments", T.ArrayType(_S)), _f("residues", _S), _f("contig", LOCATION),
    _f("features", T.ArrayType(FEATURE)), _f("_warnings", T.ArrayType(_S)), _f("_error", _S), _f("_corrupt_record", _S),
]
RECORD = T.StructType(RECORD_FIELDS)

#: What a record is when nothing is known of it.
EMPTY = {
    "name": None, "topology": "linear", "date": None, "locus_len": None, "molecule_type": None, "division": "UNK", "definition": None,
    "accession": None, "version": None, "source": None, "dblink": None, "keywords": None, "references": (), "comments": (), "residues": "",
    "contig": None, "features": (),
}
