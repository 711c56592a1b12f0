"""Writing annotated sequences as flat-file text.

Lines are at most 79 bytes wide; values go on at column 13 (header) or 22 (features). Text is cut at
blanks, locations after commas. Bytes count, but letters of several bytes are never cut apart.
"""

from __future__ import annotations

from collections.abc import Iterator

from seqloom.operators.location import format_location, from_nodes

WIDTH, FEATURE_INDENT, FIELD_INDENT = 79, " " * 21, " " * 12
# Qualifiers written without quotes, and those wrapped like locations.
BARE_KEYS = ("anticodon", "codon_start", "estimated_length", "number", "rpt_type", "transl_except", "transl_table")
LOCATION_KEYS = ("transl_except", "anticodon")
#: Room that a line has at least, where the text before it leaves less.
LEAST_ROOM = 10


def wrap_location(text: str, first: str, indent: str, warnings: list | None = None) -> Iterator[str]:
    lead = first
    while len(lead) + len(text) > WIDTH:
        room = max(WIDTH - len(lead), LEAST_ROOM)
        if len(text) <= room:
            break
        cut = text.rfind(",", 0, room) + 1
        if not cut:
            cut = room
            if warnings is not None:
                warnings.append(f"location cut within a part: {text[:40]}")
        yield lead + text[:cut]
        text, lead = text[cut:], indent
    if text:
        yield lead + text


def _text_line(text: str, at: int, begun: str, room: int, quote: bool) -> tuple[str, int]:
    """One line that begins with ``begun`` and holds at most ``room`` bytes; where the text goes on."""
    out, used, blank = [begun], len(begun), None
    while used < room:
        if at >= len(text):
            return "".join(out), at
        c = text[at]
        if c == "\n":
            return "".join(out), at + 1
        if c == " ":
            blank = (len(out), at + 1)
        shown = '""' if quote and c == '"' else c
        if len(shown) == 2 and used >= room - 1:
            break  # an escaped quote is never cut
        out.append(shown)
        used += len(shown.encode())
        at += 1
    if at >= len(text):
        return "".join(out), at
    if text[at] in " \n":
        return "".join(out), at + 1
    if blank is not None:
        return "".join(out[: blank[0]]), blank[1]
    return "".join(out), at


def wrap_text(text: str, first: str, indent: str, quote: bool) -> Iterator[str]:
    line, at = _text_line(text, 0, '"' if quote else "", max(WIDTH - len(first.encode()), LEAST_ROOM), quote)
    lead = first
    while at < len(text):
        yield lead + line
        lead = indent
        line, at = _text_line(text, at, "", WIDTH - len(indent), quote)
    if not quote:
        yield lead + line
    elif len(line.encode()) + len(lead.encode()) >= WIDTH:
        yield lead + line
        yield indent + '"'
    else:
        yield lead + line + '"'


def _field(keyword: str, value: str | None) -> Iterator[str]:
    """Blanks before a value aren't written: further lines must be indented to where the value begins."""
    if value is not None:
        yield from wrap_text(value.lstrip(" "), f"{keyword:<12}", FIELD_INDENT, False)


def header_lines(record: dict) -> Iterator[str]:
    for name in ("definition", "accession", "version", "dblink", "keywords"):
        yield from _field(name.upper(), record.get(name))
    source = record.get("source")
    if source:
        yield from _field("SOURCE", source["source"] or "")
        yield from _field("  ORGANISM", source["organism"])
    for r in record.get("references") or ():
        yield from _field("REFERENCE", r["description"] or "")
        yield from _field("  AUTHORS", r["authors"])
        yield from _field("  CONSRTM", r["consortium"])
        yield from _field("  TITLE", r["title"] or "")
        yield from _field("  JOURNAL", r["journal"])
        yield from _field("   PUBMED", r["pubmed"])
        yield from _field("  REMARK", r["remark"])
    for comment in record.get("comments") or ():
        yield from _field("COMMENT", comment or "")


def feature_lines(features, warnings: list | None = None) -> Iterator[str]:
    if not features:
        return
    yield "FEATURES             Location/Qualifiers"
    for f in features:
        shown = f["location_gb"] if f.get("location") is None else format_location(from_nodes(f["location"]))
        yield from wrap_location(shown, f"     {f['kind']:<15} ", FEATURE_INDENT, warnings)
        for q in f["qualifiers"] or ():
            lead = f"{FEATURE_INDENT}/{q['key']}"
            if q["value"] is None:
                yield lead
            elif q["key"] in LOCATION_KEYS:
                yield from wrap_location(q["value"], lead + "=", FEATURE_INDENT, warnings)
            else:
                yield from wrap_text(q["value"], lead + "=", FEATURE_INDENT, q["key"] not in BARE_KEYS)


def body_text(record: dict, warnings: list | None = None) -> str:
    """All between the LOCUS line and the residues."""
    lines = [*header_lines(record), *feature_lines(record.get("features"), warnings)]
    if record.get("contig"):
        lines += wrap_location(format_location(from_nodes(record["contig"])), "CONTIG      ", FIELD_INDENT, warnings)
    return "".join(line + "\n" for line in lines)
