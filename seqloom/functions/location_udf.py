"""Location functions over text columns for every kind of location, as Arrow-batched functions.

Results that can't be had are null; ``find_bounds`` and ``extract`` also tell why in ``error``:
syntax, ambiguous, external, empty or out_of_bounds. For single ranges prefer
:mod:`seqloom.functions.native`; :func:`location_text` style helpers here combine both.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import native
from seqloom.operators import location as loc
from seqloom.schema import LOCATION
from seqloom.sources.genbank import GenbankTable, format_record, parse_genbank

_BOUNDS = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("error", T.StringType())])
_LETTERS = T.StructType([T.StructField("residues", T.StringType()), T.StructField("error", T.StringType())])
_LEAF = T.StructType(
    [T.StructField(n, k) for n, k in (("accession", T.StringType()), ("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("strand", T.IntegerType()))]
)


def _try(fn, *args):
    """Result, or None if an argument is missing or the location doesn't allow it."""
    if any(a is None or a != a for a in args):
        return None
    try:
        return fn(*args)
    except loc.LocationError:
        return None


def _texts(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series([_try(fn, *row) for row in zip(*columns)], dtype=object)


def _shown(found) -> str | None:
    return None if found is None else loc.format_location(found)


@F.pandas_udf(LOCATION)
def gb_parse_location(text: pd.Series) -> pd.Series:
    return _texts(lambda t: loc.to_nodes(loc.parse_location(t)), text)


@F.pandas_udf(T.StringType())
def gb_format_location(nodes: pd.Series) -> pd.Series:
    return pd.Series([None if n is None or not len(n) else loc.format_location(loc.from_nodes(list(n))) for n in nodes], dtype=object)


@F.pandas_udf(_BOUNDS)
def gb_find_bounds(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        try:
            rows.append((*loc.find_bounds(loc.parse_location(t)), None) if t is not None else (None, None, None))
        except loc.LocationError as e:
            rows.append((None, None, e.code))
    out = pd.DataFrame(rows, columns=["start", "end", "error"])
    return out.astype({"start": "Int64", "end": "Int64", "error": object})


@F.pandas_udf(T.StringType())
def gb_simplify(text: pd.Series) -> pd.Series:
    return _texts(lambda t: _shown(loc.simplify(loc.parse_location(t))), text)


@F.pandas_udf(T.StringType())
def gb_truncate(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return _texts(lambda t, a, b: _shown(loc.truncate(loc.parse_location(t), int(a), int(b))), text, start, end)


@F.pandas_udf(T.StringType())
def gb_relocate(text: pd.Series, shift: pd.Series, length: pd.Series, circular: pd.Series) -> pd.Series:
    return _texts(lambda t, d, n, c: _shown(loc.relocate(loc.parse_location(t), int(d), int(n), bool(c))), text, shift, length, circular)


@F.pandas_udf(T.StringType())
def gb_wrap(text: pd.Series, length: pd.Series) -> pd.Series:
    return _texts(lambda t, n: _shown(loc.wrap(loc.parse_location(t), int(n))), text, length)


@F.pandas_udf(T.StringType())
def gb_revcomp_location(text: pd.Series, length: pd.Series) -> pd.Series:
    return _texts(lambda t, n: _shown(loc.reverse_complement(loc.parse_location(t), int(n))), text, length)


@F.pandas_udf(T.StringType())
def gb_region(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """The part of a location within a linear region, counted from the region's start."""

    def cut(t, a, b):
        return _shown(loc.truncate(loc.relocate(loc.parse_location(t), -int(a), 0, False), 0, int(b) - int(a)))

    return _texts(cut, text, start, end)


@F.pandas_udf(_LETTERS)
def gb_extract(text: pd.Series, residues: pd.Series) -> pd.DataFrame:
    rows = []
    for t, r in zip(text, residues):
        try:
            rows.append((loc.extract(loc.parse_location(t), r), None) if t is not None and r is not None else (None, None))
        except loc.LocationError as e:
            rows.append((None, e.code))
    return pd.DataFrame(rows, columns=["residues", "error"], dtype=object)


@F.pandas_udf(T.ArrayType(_LEAF))
def gb_segments(text: pd.Series) -> pd.Series:
    """Leaves in reading order; those of an external part carry its accession."""
    names = [f.name for f in _LEAF.fields]
    return _texts(lambda t: [dict(zip(names, leaf)) for leaf in loc.leaves(loc.parse_location(t))], text)


@F.pandas_udf(T.BooleanType())
def gb_is_location(text: pd.Series) -> pd.Series:
    return text.map(loc.is_location)


def register(spark: SparkSession) -> None:
    """Make the functions usable from SQL."""
    functions = {
        "gb_parse_location": gb_parse_location, "gb_format_location": gb_format_location, "gb_format": format_record, "gb_find_bounds": gb_find_bounds, "gb_simplify": gb_simplify,
        "gb_truncate": gb_truncate, "gb_relocate": gb_relocate, "gb_wrap": gb_wrap, "gb_revcomp_location": gb_revcomp_location, "gb_extract": gb_extract,
        "gb_segments": gb_segments, "gb_region": gb_region, "gb_is_location": gb_is_location, "gb_parse_records": parse_genbank,
    }
    for name, f in functions.items():
        spark.udf.register(name, f)
    spark.udtf.register("gb_parse", GenbankTable)
    codes, complements = native.CODES, native.COMPLEMENTS
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, '{codes}', '{complements}'))")
