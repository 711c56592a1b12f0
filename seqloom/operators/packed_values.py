"""Several values packed in one field: split into one value per row, position kept.

Method: quoted spans are replaced by indexed placeholders, the remaining delimiters are split, the
spans are put back by array lookup and the array is exploded with positions. Everything is a
built-in expression, so scan, split and explode stay in one stage; the only shuffle is the
removal of repeated rows.

Collision-free: a placeholder is START index END, two control characters. Where a text holds one of
the two itself, it is escaped before and restored after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ESCAPE = "\x01", "\x02", "\x03"

#: A value that stands after the comma of an author: initials, with or without full stops.
_INITIALS = r"(?:\p{Lu}\.?[\- ]?){1,4}"
_SUFFIX = r"(?:,?\s*(?:Jr|Sr)\b\.?|\s+(?:II|III|IV))?"
# possessive repetitions of groups run in a loop; others recurse and overflow the stack on long values
_PARTICLE = r"(?:(?:von|van|der|den|del|della|de|di|da|la|le|el|al|bin|ter|VON|VAN|DEL|DE|Von|Van|Del|De)\s+)*+"
_SURNAME = _PARTICLE + r"[^\s,.]{2,}"
_GIVEN = r"\p{Lu}[^\s,.]++(?:[\s\-]++(?!(?:Jr|Sr)\b)(?:\p{Lu}[^\s,.]++|\p{Lu}\.?))*+" + _SUFFIX
#: Delimiters that part authors wherever they stand.
_AUTHOR_STRONG = r"\s*[;|]\s*|\s+/\s+|\s*,?\s*&\s*|\s*,?\s+and\s+|,\s*and\s+"
#: A comma parts authors unless initials or a suffix follow it up to the next delimiter.
_AUTHOR_COMMA = r",(?!\s*(?:" + _INITIALS + _SUFFIX + r"|(?:Jr|Sr)\b\.?)\s*(?:,|$))"
_ET_AL = r"[,;]?\s*\bet\.?\s+al\b\.?\s*$"
#: A comma belongs to a keyword if it parts the digits of a number that starts a word.
_KEYWORD_DELIMITER = r"[;|]|\s/\s|(?<!(?<![\p{L}\p{N}_])\p{N}{1,4}),|,(?!\p{N})"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and give it to ``body``: inside a lambda a plain expression runs for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _protect(text: Column) -> Column:
    out = F.regexp_replace(text, ESCAPE, ESCAPE + "e")
    return F.regexp_replace(F.regexp_replace(out, START, ESCAPE + "s"), END, ESCAPE + "t")


def _unprotect(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, ESCAPE + "s", START), ESCAPE + "t", END)
    return F.regexp_replace(out, ESCAPE + "e", ESCAPE)


def quoted_parts(text: Column) -> Column:
    """The text cut at its double quotes: even places stand outside quotes, odd ones inside.

    A doubled quote appears as two spans that touch, so no regular expression has to run over a
    whole quoted value and values of any length are safe.
    """
    return F.split(_protect(text), '"', -1)


def skeleton(parts: Column) -> Column:
    """The outside parts with ``START index END`` for each quoted span.

    A last quote without a partner stays in the skeleton as a plain quote.
    """

    def piece(n: Column):
        def one(p: Column, i: Column) -> Column:
            index = F.concat(F.lit(START), i.cast("string"), F.lit(END))
            return F.when(i % 2 == 0, p).when(i == n - 1, F.concat(F.lit('"'), p)).otherwise(index)

        return one

    return let(F.size(parts), lambda n: F.array_join(F.transform(parts, piece(n)), ""))


def only_spans(value: Column) -> Column:
    """Whether nothing stands outside the placeholders. No repeated groups: those overflow the stack on long texts."""
    return value.rlike(f"^{START}[{START}{END}0-9]*{END}$") & ~value.rlike(f"{END}[0-9]")


def restore(value: Column, parts: Column) -> Column:
    """Put the spans back. Quotes that enclose the whole value go, others stay; doubled ones become one."""

    def joined(bits: Column, enclosed: Column, n: Column) -> Column:
        def bit(b: Column, i: Column) -> Column:
            span = F.element_at(parts, (F.when(i % 2 == 1, b).otherwise("0")).try_cast("int") + 1)
            touching = (i > 1) & (F.get(bits, i - 1) == "")
            opening = F.when(enclosed & ~touching, "").otherwise('"')
            closing = F.when(enclosed | ((F.get(bits, i + 1) == "") & (i + 2 < n)), "").otherwise('"')
            return F.when(i % 2 == 0, b).otherwise(F.concat(opening, span, closing))

        return F.array_join(F.transform(bits, bit), "")

    cut = F.split(value, f"[{START}{END}]", -1)
    whole = let(cut, lambda bits: let(only_spans(value), lambda enclosed: let(F.size(bits), lambda n: joined(bits, enclosed, n))))
    return _unprotect(F.when(value.contains(START), whole).otherwise(value))


def clean(value: Column) -> Column:
    """Each run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def _finish(values: Column, parts: Column) -> Column:
    restored = F.transform(values, lambda v: clean(restore(clean(v), parts)))
    return F.filter(restored, lambda v: v != "")


def split_keywords(text: Column) -> Column:
    """Keywords of a field, in order. Null gives null; blank or only a full stop gives an empty array."""

    def values(parts: Column) -> Column:
        bare = clean(F.regexp_replace(skeleton(parts), "\t", ";"))
        return _finish(F.split(F.regexp_replace(bare, r" ?\.$", ""), _KEYWORD_DELIMITER, -1), parts)

    return let(quoted_parts(text), values)


def split_authors(text: Column) -> Column:
    """Author names of a field, in order and as written. Null gives null, blank an empty array."""

    def names(segment: Column) -> Column:
        # "Surname, Given" once or several times: surnames at even places, given names at odd ones
        def fits(t: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, t.rlike("^ ?" + _SURNAME + "$")).otherwise(t.rlike("^" + _GIVEN + " ?$"))

        def told(tokens: Column) -> Column:
            paired = (F.size(tokens) % 2 == 0) & F.forall(F.transform(tokens, fits), lambda x: x)
            firsts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 2, F.lit(0)), F.lit(2))
            pairs = F.transform(firsts, lambda i: F.concat(F.get(tokens, i), F.lit(", "), F.get(tokens, i + 1)))
            return F.when(paired, pairs).otherwise(F.split(segment, _AUTHOR_COMMA, -1))

        return let(F.split(segment, " ?, ?", -1), told)

    def values(parts: Column) -> Column:
        bare = F.regexp_replace(clean(skeleton(parts)), _ET_AL, "")
        return _finish(F.flatten(F.transform(F.split(bare, _AUTHOR_STRONG, -1), names)), parts)

    return let(quoted_parts(text), values)


SPLITTERS = {"authors": split_authors, "keywords": split_keywords}


def explode_values(df: DataFrame, id_col: str, text_col: str, field: str, splitter=None) -> DataFrame:
    """One row (field, row_id, pos, item) for each value of ``text_col``.

    Null or blank texts give no row. Positions are 1, 2, ... without gaps; empty values take none.
    Rows equal in id and text count once; rows with one id but other texts are split each for itself.
    Other columns of ``df`` don't matter: only the two named ones are read.
    """
    split = splitter or SPLITTERS[field]
    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("packed"))
    rows = rows.where(F.col("packed").isNotNull()).dropDuplicates()
    values = rows.select("row_id", F.posexplode(split(F.col("packed"))).alias("at", "item"))
    return values.select(
        F.lit(field).alias("field"), F.col("row_id").cast("long").alias("row_id"), (F.col("at") + 1).cast("int").alias("pos"), "item"
    )
