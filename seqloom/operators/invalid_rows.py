"""Rows that fail to parse: the reason for each, and the valid rows with typed columns.

Method: each line is cut into cells, the cells are exploded into (row, column, value), a small rule
table is joined on the column, the validations are evaluated, failures are aggregated by row, and
the clean rows are what an anti-join leaves. Only failures are shuffled for the report.

Defined cases: a null line has no cells (``column_count``), a blank line one; a carriage return at
the end is dropped; quotes may hold commas, line breaks and doubled quotes of any length. White
space means every Unicode white-space character.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from seqloom.operators.location import is_location
from seqloom.operators.packed_values import START, let, only_spans, quoted_parts, restore, skeleton

COLUMNS = ("name", "locus_len", "topology", "division", "definition", "location", "residues")
ROW = -1
#: rank, reason, column that is looked at. The first that fails is the reason of the row.
RULES = [
    (1, "quoting", ROW),
    (2, "column_count", ROW),
    (3, "name", COLUMNS.index("name")),
    (4, "location", COLUMNS.index("location")),
    (5, "residues", COLUMNS.index("residues")),
    (6, "length", COLUMNS.index("locus_len")),
]
_SIMPLE = r"<?[+-]?[0-9]{1,18}\.\.>?[+-]?[0-9]{1,18}|[+-]?[0-9]{1,18}"
_SIMPLE_LOCATION = rf"^(?:(?:{_SIMPLE})|complement\((?:{_SIMPLE})\))$"


@F.pandas_udf(BooleanType())
def _compound_ok(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else is_location(t))


def location_ok(text: Column) -> Column:
    """One range or number, perhaps complemented, is matched natively; only the rest goes to Python."""
    simple = text.rlike(_SIMPLE_LOCATION) & ~text.endswith("\n")
    return F.when(simple, True).otherwise(_compound_ok(F.when(~simple, text)))


def parse_lines(df: DataFrame, line: str = "raw_line", row_id: str = "raw_id") -> DataFrame:
    """(row_id, cells, quotes_ok): cells are null where the line is."""
    text = F.regexp_replace(F.col(line), r"\r\z", "")

    def cells(parts: Column) -> Column:
        def told(raw: Column) -> Column:
            bare = F.forall(raw, lambda c: only_spans(c) | ~(c.contains(START) | c.contains('"')))
            return F.struct(F.transform(raw, lambda c: restore(c, parts)).alias("cells"), bare.alias("quotes_ok"))

        return let(F.split(skeleton(parts), ",", -1), told)

    found = df.select(F.col(row_id).alias("row_id"), let(quoted_parts(text), cells).alias("x"))
    return found.select("row_id", "x.cells", "x.quotes_ok")


def _facts(lines: DataFrame) -> DataFrame:
    n = F.size("cells")
    seven = n == len(COLUMNS)

    def cell(name: str) -> Column:
        return F.when(seven, F.get("cells", F.lit(COLUMNS.index(name))))

    return lines.select(
        "row_id",
        "cells",
        F.coalesce("quotes_ok", F.lit(True)).alias("quotes_ok"),
        F.coalesce(n, F.lit(-1)).alias("n_cells"),
        F.length(F.regexp_replace(cell("residues"), "[^A-Za-z]", "")).alias("n_letters"),
        F.when(F.col("quotes_ok"), location_ok(cell("location"))).alias("location_ok"),
    )


def _fails() -> Column:
    """Whether the rule of this (cell, rule) pair fails."""
    v = F.col("value")
    digits = F.regexp_replace(v, "^0+(?=[0-9])", "")
    wrong_length = ~v.rlike(r"\A[0-9]+\z") | ((F.col("n_letters") > 0) & (digits != F.col("n_letters").cast("string")))
    return (
        F.when(F.col("reason") == "quoting", ~F.col("quotes_ok"))
        .when(F.col("reason") == "column_count", F.col("n_cells") != len(COLUMNS))
        .when(F.col("n_cells") != len(COLUMNS), False)
        .when(F.col("reason") == "name", (v == "") | v.rlike(r"(?U)[\s:]"))
        .when(F.col("reason") == "location", ~F.coalesce("location_ok", F.lit(False)))
        .when(F.col("reason") == "residues", v.rlike(r"[^A-Za-z0-9 \r\n]"))
        .otherwise(wrong_length)
    )


def failures(lines: DataFrame) -> DataFrame:
    """(row_id, reason, reasons) of the rows that fail: the first reason, and all of them in order."""
    rules = lines.sparkSession.createDataFrame(RULES, "rank int, reason string, at int")
    whole = F.array(F.struct(F.lit(ROW).alias("at"), F.lit(None).cast("string").alias("value")))
    cells = F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c, i: F.struct(i.alias("at"), c.alias("value")))
    exploded = _facts(lines).select(
        "row_id", "quotes_ok", "n_cells", "n_letters", "location_ok", F.explode(F.concat(whole, cells)).alias("cell")
    )
    exploded = exploded.select("*", F.col("cell.at").alias("at"), F.col("cell.value").alias("value")).drop("cell")
    checked = exploded.join(F.broadcast(rules), "at").where(_fails())  # a fixed table of six rows
    found = checked.groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("rank", "reason"))).alias("found"))
    return found.select("row_id", F.get("found", F.lit(0))["reason"].alias("reason"), F.col("found.reason").alias("reasons"))


def separate(df: DataFrame, line: str = "raw_line", row_id: str = "raw_id") -> tuple[DataFrame, DataFrame]:
    """(valid rows with typed columns, failures). Both keep ``row_id``; other columns aren't read."""
    lines = parse_lines(df, line, row_id)
    bad = failures(lines)
    good = lines.join(bad.select("row_id"), "row_id", "left_anti")
    typed = good.select("row_id", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(COLUMNS)])
    typed = typed.withColumn("locus_len", F.col("locus_len").try_cast("decimal(20,0)")).withColumn(
        "residues", F.regexp_replace("residues", "[^A-Za-z]", "")
    )
    return typed, bad
