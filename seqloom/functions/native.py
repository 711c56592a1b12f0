"""Column expressions over residues, dates, LOCUS lines and simple locations. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC codes and their complements, month names.
CODES, COMPLEMENTS = "AGCTYRWSKMDVHBNagctyrwskmdvhbn", "TCGARYWSMKHBDVNtcgaryswmkhbdvn"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

_C = str | Column


def _col(c: _C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_left(text: Column, width: int, fill: str = " ") -> Column:
    """Pad to ``width``; longer texts stay whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def pad_right(text: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, fill))


# Residues


def complement(residues: _C) -> Column:
    return F.translate(_col(residues), CODES, COMPLEMENTS)


def revcomp(residues: _C) -> Column:
    """Reverse complement; letters without a complement stay."""
    return F.reverse(complement(residues))


def scan_residues(block: _C) -> Column:
    """Letters of a sequence block: positions and white space go. Null if it holds another character."""
    kept = F.regexp_replace(_col(block), r"[0-9 \r\n]", "")
    return F.when(~kept.rlike("[^A-Za-z]"), kept)


def bad_residue(block: _C) -> Column:
    """The first character that no sequence block may hold, or null."""
    return F.nullif(F.regexp_extract(_col(block), r"([^A-Za-z0-9 \r\n])", 1), F.lit(""))


def record_length(locus_len: _C, residues: _C) -> Column:
    """Declared length, else the number of residues; null where both are known and differ."""
    declared, n = _col(locus_len), F.coalesce(F.length(_col(residues)), F.lit(0)).cast("long")
    return F.when(declared.isNotNull() & (n > 0) & (declared != n), None).otherwise(F.coalesce(declared, n))


def unwrap_range(start: _C, end: _C, length: _C, circular: _C) -> Column:
    """struct(start, end) with 0 <= start < length and start < end; on a circle end may exceed the length.

    Linear: within the molecule, start <= end, else null. Circular: start >= end runs over the origin.
    """
    s, e, n = _col(start), _col(end), _col(length)
    first = F.pmod(s, n)
    width = F.when(s >= e, e + n - s).otherwise(e - s)
    around = F.struct(first.alias("start"), (first + width).alias("end"))
    straight = F.struct(s.alias("start"), e.alias("end"))
    return (
        F.when(n <= 0, None)
        .when(_col(circular), F.when(width > 0, around))
        .when((s <= e) & (s >= 0) & (s < n) & (e >= 0) & (e <= n), straight)
    )


def extract_range_seq(residues: _C, start: _C, end: _C, circular: _C) -> Column:
    """Letters from start to end, as many times around a circle as needed; null out of range."""
    text = _col(residues)
    n = F.length(text).cast("long")
    at = unwrap_range(start, end, n, circular)
    laps = F.ceil(at["end"] / n).cast("int")
    return F.when(at.isNotNull(), F.substring(F.repeat(text, laps), (at["start"] + 1).cast("int"), (at["end"] - at["start"]).cast("int")))


def rotate(residues: _C, origin: _C) -> Column:
    """Residues of a circle that begins at ``origin``, taken modulo the length."""
    text = _col(residues)
    at = F.pmod(_col(origin), F.length(text).cast("long")).cast("int")
    return F.when(F.length(text) > 0, F.concat(F.substring(text, at + 1, F.length(text)), F.substring(text, F.lit(1), at))).otherwise(text)


def range_to_location(start: _C, end: _C, length: _C, circular: _C) -> Column:
    """Location text of a range; over the origin a join of two ranges; null if out of range or above one lap."""
    n = _col(length)
    at = unwrap_range(start, end, n, circular)
    s, e = at["start"], at["end"]
    joined = F.concat(F.lit("join("), format_range(s, n), F.lit(","), format_range(F.lit(0), e - n), F.lit(")"))
    return F.when(at.isNull() | (s >= e), None).when(e <= n, format_range(s, e)).when(e < 2 * n, joined)


def fasta(header: _C, residues: _C, width: int = 60) -> Column:
    body = F.rtrim(F.regexp_replace(_col(residues), "(.{%d})" % width, "$1\n"), F.lit("\n"))
    return F.concat(F.lit(">"), _col(header), F.lit("\n"), body, F.lit("\n"))


def origin_block(residues: _C) -> Column:
    """ORIGIN section: 60 letters a line in groups of ten, with positions; empty without residues."""
    text = F.coalesce(_col(residues), F.lit(""))
    last = F.floor((F.length(text) - 1) / 60).cast("int")

    def line(i: Column) -> Column:
        part = F.substring(text, i * 60 + 1, F.lit(60))
        return F.concat(pad_left((i * 60 + 1).cast("string"), 9), F.lit(" "), F.rtrim(F.regexp_replace(part, "(.{10})", "$1 ")))

    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), line), "\n")
    return F.when(F.length(text) > 0, F.concat(F.lit("ORIGIN      \n"), lines, F.lit("\n"))).otherwise("")


# Dates and LOCUS lines


def make_date(year: _C, month: _C, day: _C) -> Column:
    """struct(year, month, day) if month is 1 to 12 and day 1 to 31, else null; 31-FEB is allowed."""
    y, m, d = (_col(c).cast("int") for c in (year, month, day))
    return F.when(m.between(1, 12) & d.between(1, 31) & y.isNotNull(), F.struct(y.alias("year"), m.alias("month"), d.alias("day")))


def format_date(date: _C) -> Column:
    d = _col(date)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), d["month"])
    day, year = pad_left(d["day"].cast("string"), 2, "0"), pad_left(d["year"].cast("string"), 4, "0")
    return F.when(d["month"].between(1, 12), F.concat(day, F.lit("-"), month, F.lit("-"), year))


def parse_date(text: _C) -> Column:
    pattern = "^([0-9]+)-(" + "|".join(MONTHS) + ")-([+-]?[0-9]+)$"
    day, month, year = (F.regexp_extract(_col(text), pattern, i) for i in (1, 2, 3))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month)
    return make_date(year.try_cast("int"), number, day.try_cast("int"))


def calendar_date(date: _C) -> Column:
    """The DATE of a date struct; null where no calendar has it."""
    d = _col(date)
    text = F.concat_ws("-", pad_left(d["year"].cast("string"), 4, "0"), pad_left(d["month"].cast("string"), 2, "0"), pad_left(d["day"].cast("string"), 2, "0"))
    return F.when(d.isNotNull(), text.try_cast("date"))


_LOCUS_HEAD = r"^LOCUS[ \t]+([^: \t\r\n]++)[ \t]++([0-9]++)[ \t]++bp[ \t]++([^ ]++)[ \t]++"
_DATE = r"([0-9]++-(?:" + "|".join(MONTHS) + r")-[+-]?[0-9]++)"
LOCUS_FULL = _LOCUS_HEAD + r"(linear|circular)(?:[ \t]++([A-Za-z]++))?+(?:[ \t]++" + _DATE + ")?+"
LOCUS_TRADITIONAL = _LOCUS_HEAD + r"()([A-Za-z]++)(?:[ \t]++" + _DATE + ")?+"


def parse_locus(line: _C) -> Column:
    """struct of a LOCUS line: full form, else the form without topology, else all unknown.

    The forms are tried in order and a form that fits the beginning is final: if the rest of the line
    isn't blank, ``ok`` is false. Null for other lines.
    """
    text = _col(line)

    def read(pattern: str) -> Column:
        g = [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in range(1, 7)]
        rest = F.regexp_replace(text, pattern, "")
        return F.struct(
            g[0].alias("name"), g[1].try_cast("long").alias("locus_len"), g[2].alias("molecule_type"),
            F.coalesce(g[3], F.lit("linear")).alias("topology"), F.coalesce(g[4], F.lit("UNK")).alias("division"),
            parse_date(g[5]).alias("date"), (rest.rlike(r"\A[ \t]*\r?\n?\z") & (g[5].isNull() | parse_date(g[5]).isNotNull())).alias("ok"),
        )

    nothing = F.lit(None).cast("string")
    unknown = F.struct(
        nothing.alias("name"), F.lit(None).cast("long").alias("locus_len"), nothing.alias("molecule_type"), F.lit("linear").alias("topology"),
        F.lit("UNK").alias("division"), F.lit(None).cast("struct<year:int,month:int,day:int>").alias("date"), F.lit(True).alias("ok"),
    )
    return (
        F.when(~text.rlike(r"^LOCUS[ \t]"), None)
        .when(text.rlike(LOCUS_FULL), read(LOCUS_FULL))
        .when(text.rlike(LOCUS_TRADITIONAL), read(LOCUS_TRADITIONAL))
        .otherwise(unknown)
    )


def locus_line(
    name: _C, accession: _C, length: _C, molecule_type: _C, topology: _C, division: _C, date: _C, truncate: bool = False, escape: bool = True
) -> Column:
    """LOCUS line without its line break. Names with inner blanks get underscores unless ``escape`` is off."""
    n = _col(length).cast("string")
    locus = F.coalesce(_col(name), _col(accession), F.lit("UNTITLED"))
    if truncate:
        locus = F.when(F.length(locus) + 1 + F.length(n) > 28, F.substring(locus, F.lit(1), 27 - F.length(n))).otherwise(locus)
    if escape:
        words = F.trim(F.regexp_replace(locus, r"(?U)\s+", " "))
        locus = F.when(words.contains(" "), F.replace(words, F.lit(" "), F.lit("_"))).otherwise(locus)
    kind = F.coalesce(_col(molecule_type), F.lit(""))
    if truncate:
        kind = F.when(F.length(kind) > 7, "").otherwise(kind)
    gap = F.greatest(28 - F.length(locus) - F.length(n), F.lit(1))
    when = F.coalesce(format_date(date), F.lit("01-JAN-1970"))
    return F.concat(
        F.lit("LOCUS       "), locus, F.repeat(F.lit(" "), gap), n, F.lit(" bp    "), pad_right(kind, 7), F.lit(" "),
        F.coalesce(_col(topology), F.lit("linear")), F.lit(" "), F.coalesce(_col(division), F.lit("UNK")), F.lit(" "), when,
    )


# Qualifiers


def qualifier_values(qualifiers: _C, key: str) -> Column:
    """Values of a key in order; those without value are left out."""
    hit = F.filter(_col(qualifiers), lambda q: (q["key"] == key) & q["value"].isNotNull())
    return F.transform(hit, lambda q: q["value"])


# Simple locations: one range, perhaps complemented. struct(start, end, before, after, reverse)

SIMPLE = r"^(complement\()?(<?)([+-]?[0-9]{1,18})(?:\.\.(>?)([+-]?[0-9]{1,18}))?(\)?)$"


def simple(start: _C, end: _C, before: _C | None = None, after: _C | None = None, reverse: _C | None = None) -> Column:
    flags = [F.lit(False) if c is None else _col(c) for c in (before, after, reverse)]
    return F.struct(
        _col(start).cast("long").alias("start"), _col(end).cast("long").alias("end"), flags[0].alias("before"), flags[1].alias("after"), flags[2].alias("reverse")
    )


def parse_simple(text: _C) -> Column:
    """The simple location a text stands for; null for any other text, which is for the general parser."""
    t = _col(text)
    g = [F.regexp_extract(t, SIMPLE, i) for i in range(1, 7)]
    fits = t.rlike(SIMPLE) & ((g[0] != "") == (g[5] != "")) & ((g[1] == "") | (g[4] != "")) & ~t.endswith("\n")
    first, last = g[2].try_cast("long"), F.when(g[4] == "", g[2]).otherwise(g[4]).try_cast("long")
    return F.when(fits, simple(first - 1, last, g[1] != "", g[3] != "", g[0] != ""))


def format_range(start: _C, end: _C, before: _C | None = None, after: _C | None = None) -> Column:
    s, e = _col(start), _col(end)
    lo = F.lit(False) if before is None else _col(before)
    hi = F.lit(False) if after is None else _col(after)
    several = F.concat(F.when(lo, "<").otherwise(""), (s + 1).cast("string"), F.lit(".."), F.when(hi, ">").otherwise(""), e.cast("string"))
    return F.when((e == s + 1) & ~lo & ~hi, e.cast("string")).otherwise(several)


def format_simple(loc: _C) -> Column:
    x = _col(loc)
    text = format_range(x["start"], x["end"], x["before"], x["after"])
    return F.when(x["reverse"], F.concat(F.lit("complement("), text, F.lit(")"))).otherwise(text)


def truncate_simple(loc: _C, start: _C, end: _C) -> Column:
    """The part within [start, end), or null; cut ends lose their fuzzy flag."""
    x, lo, hi = _col(loc), _col(start), _col(end)
    s_in, e_in = (x["start"] >= lo) & (x["start"] < hi), (x["end"] > lo) & (x["end"] <= hi)
    some = s_in | e_in | ((x["start"] <= lo) & (x["end"] >= hi))
    cut = simple(F.when(s_in, x["start"]).otherwise(lo), F.when(e_in, x["end"]).otherwise(hi), x["before"] & s_in, x["after"] & e_in, x["reverse"])
    return F.when(some, cut)


def shift_simple(loc: _C, by: _C) -> Column:
    x, d = _col(loc), _col(by)
    return simple(x["start"] + d, x["end"] + d, x["before"], x["after"], x["reverse"])


def revcomp_simple(loc: _C, length: _C) -> Column:
    x, n = _col(loc), _col(length)
    return simple(n - x["end"], n - x["start"], x["after"], x["before"], ~x["reverse"])


def wrapped_simple(loc: _C, length: _C) -> Column:
    """Text of a range on a circle, brought back to its start; null for ranges of more than a lap past the end."""
    x, n = _col(loc), _col(length)
    laps = F.greatest(F.floor(x["start"] / n), F.lit(0)).cast("long")
    s, e = x["start"] - laps * n, x["end"] - laps * n
    joined = F.concat(F.lit("join("), format_range(s, n, x["before"]), F.lit(","), format_range(F.lit(0), e - n, None, x["after"]), F.lit(")"))
    text = F.when(e <= n, format_range(s, e, x["before"], x["after"])).when(e <= 2 * n, joined)
    return F.when((n > 0) & x.isNotNull(), F.when(x["reverse"], F.concat(F.lit("complement("), text, F.lit(")"))).otherwise(text))


def extract_simple(loc: _C, residues: _C) -> Column:
    """Letters of a simple location; null if it lies outside of the residues."""
    x, text = _col(loc), _col(residues)
    inside = (x["start"] >= 0) & (x["start"] <= x["end"]) & (x["end"] <= F.length(text))
    part = F.substring(text, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
    return F.when(inside, F.when(x["reverse"], revcomp(part)).otherwise(part))


def repaired_text(raw: _C) -> Column:
    """UTF-8 text of bytes; bytes that are no UTF-8 are read as Latin-1."""
    text = _col(raw).cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(_col(raw).cast("binary"), "ISO-8859-1"))
