"""Reading flat-file text of annotated sequences: one record, or a whole file, from a string.

A record is read by a cursor that goes over its sections in order: LOCUS, header fields, features,
base count, contig, residues, end. Sections are optional after LOCUS. What can't be read as a header
line is passed over with a warning; what can't be read later makes the record an error.

Choices where the format leaves room:

* ``//`` at the beginning of a line always ends a record, also within the header.
* Blank lines at the end of a record don't matter, with or without ``//``.
* An error never stops the reading: each record is a row of its own, with ``_error`` and its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from seqloom.functions.native import LOCUS_FULL, LOCUS_TRADITIONAL, MONTHS
from seqloom.operators.location import LocationError, format_location, parse_prefix, to_nodes
from seqloom.schema import EMPTY

_FULL, _TRADITIONAL = re.compile(LOCUS_FULL[1:]), re.compile(LOCUS_TRADITIONAL[1:])
_LINE = re.compile(r"[^\n]*?(?=\r?\n)")
_BREAK = re.compile(r"\r?\n")
_BLANKS = re.compile(" +")
_NOT_RESIDUE = re.compile(r"[^A-Za-z0-9 \r\n]")
_KIND = re.compile("[^ ]+")
_KEY = re.compile(r"[^=\r\n]+")
_PLAIN = re.compile(r'[^"\r\n]*')
_FIELDS = ("DEFINITION", "ACCESSION", "VERSION", "DBLINK", "KEYWORDS")
END = re.compile(r"^//[^\n]*\n?", re.M)


class RecordError(ValueError):
    pass


class _Cursor:
    def __init__(self, text: str):
        self.text, self.at, self.warnings = text, 0, []

    def line(self) -> str | None:
        """Rest of the line; goes past its break. None at the end of the text."""
        m = _LINE.match(self.text, self.at)
        if not m:
            return None
        self.at = _BREAK.match(self.text, m.end()).end()
        return m[0]

    def starts(self, word: str) -> bool:
        return self.text.startswith(word, self.at)

    def indented(self, n: int) -> bool:
        return self.text.startswith(" " * n, self.at)

    def field(self, indent: int, name: str, joint: str) -> str | None:
        """A keyword, blanks and a value whose further lines are indented to where the value began."""
        here = self.at
        if not self.text.startswith(" " * indent + name, here):
            return None
        m = _BLANKS.match(self.text, here + indent + len(name))
        if not m:
            return None
        self.at = m.end()
        first = self.line()
        if first is None:
            self.at = here
            return None
        lines, width = [first], m.end() - here
        while self.indented(width):
            start = self.at
            self.at += width
            more = self.line()
            if more is None:
                self.at = start
                break
            lines.append(more)
        return joint.join(lines)

    def bare(self, indent: int) -> str | None:
        """Lines joined without a break, as long as they are indented and don't begin with a slash."""
        here, parts = self.at, []
        while True:
            part = self.line()
            if part is None:
                self.at = here
                return None
            parts.append(part)
            nxt = self.at + indent
            if not self.indented(indent) or nxt >= len(self.text) or self.text[nxt] == "/":
                return "".join(parts)
            self.at = nxt

    def quoted(self, indent: int, joint: str) -> str | None:
        here, parts = self.at, []
        if not self.starts('"'):
            return None
        at, text, pad = here + 1, self.text, " " * indent
        while True:
            m = _PLAIN.match(text, at)
            parts.append(m[0])
            at = m.end()
            if text.startswith('""', at):
                parts.append('"')
                at += 2
                continue
            quote = text.startswith('"', at)
            turn = _BREAK.match(text, at + quote)
            if turn and text.startswith(pad, turn.end()):
                if not quote:
                    parts.append(joint)
                    at = turn.end() + indent
                    continue
                if text.startswith('"', turn.end() + indent):
                    parts.append('"')
                    at = turn.end() + indent + 1
                    continue
            if quote and turn:
                self.at = turn.end()
                return "".join(parts)
            return None


def read_date(text: str | None) -> dict | None:
    if not text:
        return None
    day, month, year = text.split("-", 2)
    number = MONTHS.index(month) + 1
    return {"year": int(year), "month": number, "day": int(day)} if 1 <= int(day) <= 31 else None


def _locus(cur: _Cursor) -> dict:
    if not re.compile(r"LOCUS[ \t]").match(cur.text, cur.at):
        raise RecordError("unreadable LOCUS line")
    out = dict.fromkeys(("name", "date", "locus_len", "molecule_type")) | {"topology": "linear", "division": "UNK"}
    for form in (_FULL, _TRADITIONAL):
        m = form.match(cur.text, cur.at)
        if m:
            date = read_date(m[6])
            end = m.end() if date or not m[6] else m.start(6)
            out |= {"name": m[1], "locus_len": int(m[2]), "molecule_type": m[3], "topology": m[4] or "linear", "division": m[5] or "UNK", "date": date}
            cur.at = end
            rest = cur.line()
            if rest is None or rest.strip(" \t"):
                raise RecordError("unreadable LOCUS line")
            return out
    cur.warnings.append(f"unreadable LOCUS: {cur.line()}")
    return out


def _reference(cur: _Cursor) -> dict | None:
    here = cur.at
    description = cur.field(0, "REFERENCE", "\n")
    if description is None:
        return None
    authors, consortium = cur.field(2, "AUTHORS", "\n"), cur.field(2, "CONSRTM", "\n")
    title = cur.field(2, "TITLE", "\n")
    if title is None:
        cur.at = here
        return None
    journal, pubmed, remark = cur.field(2, "JOURNAL", "\n"), cur.field(3, "PUBMED", ""), cur.field(2, "REMARK", "\n")
    return {"description": description, "authors": authors, "consortium": consortium, "title": title, "journal": journal, "pubmed": pubmed, "remark": remark}


def _header(cur: _Cursor, out: dict) -> None:
    while cur.at < len(cur.text):
        name = next((f for f in _FIELDS if cur.starts(f)), None)
        value = cur.field(0, name, "\n") if name else None
        if value is not None:
            if name == "DEFINITION" and out["definition"] is not None:
                raise RecordError("a second DEFINITION")
            out[name.lower()] = value
        elif (value := cur.field(0, "SOURCE", "\n")) is not None:
            out["source"] = {"source": value, "organism": cur.field(2, "ORGANISM", "\n")}
        elif (found := _reference(cur)) is not None:
            out["references"].append(found)
        elif (value := cur.field(0, "COMMENT", "\n")) is not None:
            out["comments"].append(value)
        elif any(cur.starts(word) for word in ("ORIGIN", "CONTIG", "FEATURES")):
            return
        else:
            line = cur.line()
            if line is None:
                return
            cur.warnings.append(f"unreadable line: {line}")


def _location(text: str, cur: _Cursor) -> tuple[list[dict], str]:
    loc, end = parse_prefix(text)
    if end < len(text):
        cur.warnings.append(f"text after location: {text[end:]}")
    return to_nodes(loc), format_location(loc)


def _qualifier(cur: _Cursor, indent: int) -> dict | None:
    here = cur.at
    if not cur.indented(indent) or not cur.text.startswith("/", here + indent):
        return None
    m = _KEY.match(cur.text, here + indent + 1)
    if m:
        cur.at = m.end()
        if cur.starts("="):
            cur.at += 1
            value = cur.quoted(indent, "" if m[0] == "translation" else "\n")
            if value is None:
                value = cur.bare(indent)
            if value is not None:
                return {"key": m[0], "value": value}
        elif cur.line() is not None:
            return {"key": m[0], "value": None}
    cur.at = here
    return None


def _feature(cur: _Cursor) -> dict | None:
    here = cur.at
    before = _BLANKS.match(cur.text, here)
    kind = before and _KIND.match(cur.text, before.end())
    after = kind and _BLANKS.match(cur.text, kind.end())
    if not after:
        return None
    indent = len(before[0]) + len(kind[0].encode()) + len(after[0])
    cur.at = after.end()
    text = cur.bare(indent)
    try:
        nodes, shown = _location(text, cur) if text is not None else (None, None)
    except LocationError:
        nodes = None
    if nodes is None:
        cur.at = here
        return None
    qualifiers = []
    while (q := _qualifier(cur, indent)) is not None:
        qualifiers.append(q)
    return {"kind": kind[0], "location": nodes, "location_gb": shown, "qualifiers": qualifiers}


_FEATURES = re.compile(r"FEATURES[ \t]+Location/Qualifiers\r?\n")
_ORIGIN = re.compile(r"ORIGIN[ \t]*\r?\n")


def _residues(cur: _Cursor, declared: int | None, ended: bool) -> str:
    body = cur.text[cur.at :]
    stop = body.find("/")
    if stop >= 0:
        body = body[:stop]
    if m := _NOT_RESIDUE.search(body):
        raise RecordError(f"no residue: {m[0]!r} at {m.start()} of the sequence block")
    letters = re.sub(r"[0-9 \r\n]+", "", body)
    cur.at += len(body)
    if declared is not None and declared != len(letters):
        raise RecordError(f"{len(letters)} letters where LOCUS declares {declared}" if ended else "the file ends within the sequence")
    if not ended:
        if declared is None:
            raise RecordError("the file ends within the sequence")
        cur.warnings.append("end of file within the sequence; its length is right")
    return letters


def read_record(text: str, ended: bool = True) -> dict:
    """One record from its text, without the ``//`` line. ``ended``: whether that line was there.

    Text before the first LOCUS line is passed over with a warning for each line.
    """
    out = {k: list(v) if isinstance(v, tuple) else v for k, v in EMPTY.items()}
    out |= {"_error": None, "_corrupt_record": None}
    cur = _Cursor(text if text.endswith("\n") else text + "\n")
    out["_warnings"] = cur.warnings
    try:
        while cur.at < len(cur.text) and not cur.starts("LOCUS"):
            line = cur.line()
            if line is None or cur.at >= len(cur.text):
                raise RecordError("no LOCUS line")
            if line.strip():
                cur.warnings.append(f"line before LOCUS: {line}")
        out |= _locus(cur)
        _header(cur, out)
        if m := _FEATURES.match(cur.text, cur.at):
            cur.at = m.end()
            while (f := _feature(cur)) is not None:
                out["features"].append(f)
        cur.field(0, "BASE COUNT", "")
        here = cur.at
        contig = cur.field(0, "CONTIG", "")
        if contig is not None:
            try:
                out["contig"] = _location(contig, cur)[0]
            except LocationError:
                cur.at = here
        if m := _ORIGIN.match(cur.text, cur.at):
            cur.at = m.end()
            out["residues"] = _residues(cur, out["locus_len"], ended)
        elif cur.field(0, "ORIGIN", "\n") is not None:
            out["residues"] = _residues(cur, out["locus_len"], ended)
        rest = cur.text[cur.at :]
        if rest.strip():
            raise RecordError(f"unreadable from here on: {rest[:50]!r}")
    except RecordError as e:
        empty = {k: list(v) if isinstance(v, tuple) else v for k, v in EMPTY.items()}
        return out | empty | {"_warnings": cur.warnings, "_error": str(e), "_corrupt_record": text}
    return out


def split_records(text: str) -> Iterator[tuple[str, bool]]:
    """(record text, whether ``//`` followed) of a file's text; blank rests are left out."""
    at = 0
    for m in END.finditer(text):
        if text[at : m.start()].strip():
            yield text[at : m.start()], True
        at = m.end()
    if text[at:].strip():
        yield text[at:], False


def read_text(text: str | None) -> list[dict]:
    """All records of a text, errors included."""
    return [read_record(part, ended) for part, ended in split_records(text or "")]


def repair_latin1(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")
