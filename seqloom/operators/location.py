"""Location algebra on plain Python values, for the compound cases that Column expressions can't hold.

A location is a tuple whose first item names its kind::

    ("range", start, end, before, after)    0-based, end exclusive; flags for the fuzzy ends < and >
    ("between", a, b)                       between two neighbouring letters
    ("complement", location)
    ("join" | "order" | "bond" | "one_of", (location, ...))
    ("external", accession, location | None)
    ("gap", "known" | "unknown" | "unk100", length | None)

Texts count from 1 with inclusive ends. Simple locations (one range, perhaps complemented) are
handled by :mod:`seqloom.functions.native`; this module is the general path and its test partner.

Locations may be nested to any depth: nothing here calls itself, all walks keep their own stack.
"""

from __future__ import annotations

import re
from collections.abc import Callable

LISTS = {"join": "join", "order": "order", "bond": "bond", "one-of": "one_of"}
LIST_TEXT = {v: k for k, v in LISTS.items()}
_I64 = 2**63

_INT = r"[+-]?[0-9]+"
_SPAN = re.compile(rf"(<?)({_INT})\.\.(>?)({_INT})")
_BETWEEN = re.compile(rf"({_INT})\^({_INT})")
_SINGLE = re.compile(f"({_INT})")
_GAP = re.compile(rf"gap\(({_INT}|unk100|)\)")
_ACCESSION = re.compile(r"[^: \t\r\n]+")
_PLAIN_ACCESSION = re.compile(r"[^: \t\r\n(),]+")
_OPEN = re.compile(r"(join|order|bond|one-of|complement)\(")


class LocationError(ValueError):
    """``code``: ambiguous, external, empty, out_of_bounds or syntax."""

    def __init__(self, code: str, location=None):
        super().__init__(code if location is None else f"{code}: {format_location(location)}")
        self.code = code


def _int(text: str) -> int | None:
    digits = text.lstrip("+-").lstrip("0")
    if len(digits) > 19:  # beyond 64 bits; int() refuses texts of thousands of digits
        return None
    value = int(digits or "0") * (-1 if text[0] == "-" else 1)
    return value if -_I64 <= value < _I64 else None


class _Reader:
    """Ordered-choice reader. Each place is read at most once per mode, so the time is linear.

    ``_read`` is a generator that asks for the location at another place by yielding (place, external); :meth:`read`
    keeps the open ones on a stack of its own.
    """

    def __init__(self, text: str, strict: bool):
        self.text, self.strict, self.seen = text, strict, {}

    def read(self, at: int = 0, external: bool = True):
        seen, found = self.seen, None
        open_ones = [((at, external), self._read(at, external))]
        while open_ones:
            key, reader = open_ones[-1]
            try:
                wanted = reader.send(found)
            except StopIteration as done:
                found = seen[key] = done.value
                open_ones.pop()
                continue
            found = seen.get(wanted)
            if wanted not in seen:
                open_ones.append((wanted, self._read(*wanted)))
        return found

    def _read(self, at: int, external: bool):
        text = self.text
        if m := _SPAN.match(text, at):
            a, b = _int(m[2]), _int(m[4])
            if a is not None and b is not None:
                return ("range", a - 1, b, bool(m[1]), bool(m[3])), m.end()
        if m := _OPEN.match(text, at):
            items, end = [], m.end()
            while inner := (yield (end, True)):
                items.append(inner[0])
                end = inner[1]
                if text.startswith(")", end):
                    return (("complement", items[0]) if m[1] == "complement" else (LISTS[m[1]], tuple(items))), end + 1
                if m[1] == "complement" or not text.startswith(",", end):
                    break
                end += 1
        if m := _BETWEEN.match(text, at):
            a, b = _int(m[1]), _int(m[2])
            if a is not None and b is not None and (abs(a - b) == 1 or (a == 1) != (b == 1)):
                return ("between", a - 1, b - 1), m.end()
        if (m := _SINGLE.match(text, at)) and (a := _int(m[1])) is not None:
            return ("range", a - 1, a, False, False), m.end()
        if m := _GAP.match(text, at):
            if m[1] in ("", "unk100"):
                return ("gap", m[1] or "unknown", None), m.end()
            if (n := _int(m[1])) is not None:
                return ("gap", "known", n), m.end()
        if not external or not (m := (_PLAIN_ACCESSION if self.strict else _ACCESSION).match(text, at)):
            return None
        if text.startswith(":", m.end()) and (inner := (yield (m.end() + 1, False))):
            return ("external", m[0], inner[0]), inner[1]
        return None if self.strict else (("external", m[0], None), m.end())


def parse_prefix(text: str):
    """(location, characters read). Text after a complete location is left over, not an error."""
    found = _Reader(text, False).read()
    if not found:
        raise LocationError("syntax")
    return found


def parse_location(text: str):
    return parse_prefix(text)[0]


def is_location(text: str | None) -> bool:
    """Whether the text as a whole is a location; an external part needs its colon and location."""
    if not text:
        return False
    found = _Reader(text, True).read()
    return bool(found) and found[1] == len(text)


def parts_of(loc, inside_external: bool = False) -> tuple:
    kind = loc[0]
    if kind == "complement":
        return (loc[1],)
    if kind == "external":
        return (loc[2],) if inside_external and loc[2] is not None else ()
    return loc[1] if kind in LIST_TEXT else ()


def fold(loc, leave: Callable, enter: Callable | None = None, inside_external: bool = False):
    """Value of a location from the values of its parts: ``leave(node, values)``, parts first, in order.

    ``enter(node)`` may put another node in place of one before its parts are looked at.
    """
    open_ones: list[tuple] = []
    todo = enter(loc) if enter else loc
    while True:
        parts = parts_of(todo, inside_external)
        if parts:
            open_ones.append((todo, parts, []))
        else:
            value = leave(todo, [])
            while True:
                if not open_ones:
                    return value
                node, parts, values = open_ones[-1]
                values.append(value)
                if len(values) < len(parts):
                    break
                open_ones.pop()
                value = leave(node, values)
        _, parts, values = open_ones[-1]
        todo = enter(parts[len(values)]) if enter else parts[len(values)]


def _format(loc, parts: list[str]) -> str:
    kind = loc[0]
    if kind == "range":
        _, a, b, before, after = loc
        if b == a + 1 and not before and not after:
            return str(b)
        return f"{'<' if before else ''}{a + 1}..{'>' if after else ''}{b}"
    if kind == "between":
        return f"{loc[1] + 1}^{loc[2] + 1}"
    if kind == "complement":
        return f"complement({parts[0]})"
    if kind == "external":
        return loc[1] if loc[2] is None else f"{loc[1]}:{parts[0]}"
    if kind == "gap":
        return f"gap({ {'known': loc[2], 'unknown': '', 'unk100': 'unk100'}[loc[1]]})"
    return f"{LIST_TEXT[kind]}({','.join(parts)})"


def format_location(loc) -> str:
    return fold(loc, _format, inside_external=True)


def _bounds(loc, parts: list):
    """Bounds or the error of a node; errors of parts that don't matter are passed over."""
    kind = loc[0]
    if kind == "range":
        return loc[1], loc[2]
    if kind == "between":
        return loc[1], loc[2] + 1
    if kind == "complement":
        return parts[0]
    if kind in LIST_TEXT:
        good = [p for p in parts if not isinstance(p, LocationError)]
        if kind in ("join", "order") and parts:
            wrong = next((p for p in (parts[0], parts[-1]) if isinstance(p, LocationError)), None)
            return wrong or (parts[0][0], parts[-1][1])
        return (min(a for a, _ in good), max(b for _, b in good)) if good else LocationError("empty")
    return LocationError("ambiguous", loc)


def find_bounds(loc) -> tuple[int, int]:
    """Start and end. A join or order gives the start of its first and the end of its last part, so
    start > end where it runs over the origin; bond and one-of give the outermost of their parts."""
    found = fold(loc, _bounds)
    if isinstance(found, LocationError):
        raise found
    return found


def _rebuilt(loc, parts: list):
    if loc[0] == "complement":
        return ("complement", parts[0])
    return (loc[0], tuple(parts)) if loc[0] in LIST_TEXT else loc


def rewrite(loc, fn: Callable):
    """Apply ``fn`` to a node, then go on into the parts of what it returned."""
    return fold(loc, _rebuilt, fn)


def map_positions(loc, fn: Callable[[int], int]):
    """Apply ``fn`` to each coordinate; externals and gaps stay as they are."""

    def move(node):
        if node[0] == "range":
            return ("range", fn(node[1]), fn(node[2]), node[3], node[4])
        return ("between", fn(node[1]), fn(node[2])) if node[0] == "between" else node

    return rewrite(loc, move)


def toggle_complement(loc):
    return loc[1] if loc[0] == "complement" else ("complement", loc)


def _spliced(parts):
    """The parts with those of joins among them, at any depth, in their place."""
    todo = list(reversed(parts))
    while todo:
        part = todo.pop()
        if part[0] == "join":
            todo.extend(reversed(part[1]))
        else:
            yield part


def merge_adjacent(parts) -> list:
    """Neighbouring plain ranges that touch become one, unless a fuzzy end lies between them."""
    out: list = []
    for part in parts:
        last = out[-1] if out else None
        if last and last[0] == part[0] == "range" and last[2] == part[1] and not last[4] and not part[3]:
            out[-1] = ("range", last[1], part[2], last[3], part[4])
        else:
            out.append(part)
    return out


def simplify_once(loc):
    """One level: splice nested joins, merge neighbours, unwrap a lone part, hoist complements."""
    while loc[0] == "join":
        if not loc[1]:
            raise LocationError("empty")
        parts = merge_adjacent(_spliced(loc[1]))
        if len(parts) > 1:
            if all(part[0] == "complement" for part in parts):
                return ("complement", ("join", tuple(part[1] for part in reversed(parts))))
            return ("join", tuple(parts))
        loc = parts[0]
    return loc


def simplify(loc):
    return rewrite(loc, simplify_once)


def truncate(loc, start: int, end: int):
    """The part of the location within [start, end), or None. Cut ends lose their fuzzy flag."""

    def cut(node, parts: list):
        kind = node[0]
        if kind == "range":
            _, a, b, before, after = node
            starts_in, ends_in = start <= a < end, start < b <= end
            if starts_in or ends_in:
                return ("range", a if starts_in else start, b if ends_in else end, before and starts_in, after and ends_in)
            return ("range", start, end, False, False) if a <= start and b >= end else None
        if kind == "between":
            return node if start <= node[1] < end or start <= node[2] < end else None
        if kind == "complement":
            return parts[0] and ("complement", parts[0])
        if kind in LIST_TEXT:
            kept = tuple(part for part in parts if part)
            if not kept:
                return None
            return simplify_once((kind, kept)) if kind == "join" else (kind, kept)
        return node

    return fold(loc, cut)


def wrap(loc, length: int):
    """Bring ranges that run past the end of a circle of ``length`` letters back to its start."""
    if length <= 0:
        raise LocationError("out_of_bounds", loc)

    def back(node):
        if node[0] != "range":
            return node
        _, a, b, before, after = node
        laps = max(a // length, 0)
        a, b = a - laps * length, b - laps * length
        if b <= length:
            return ("range", a, b, before, after)
        return ("join", (("range", a, length, before, False), ("range", 0, b - length, False, after)))

    return simplify(rewrite(loc, back))


def relocate(loc, shift: int, length: int, circular: bool):
    """Move by ``shift`` letters; on a circle the result is wrapped and simplified."""
    if not circular:
        return map_positions(loc, lambda v: v + shift)
    if length <= 0:
        raise LocationError("out_of_bounds", loc)
    shift %= length
    return wrap(map_positions(loc, lambda v: v + shift), length)


def reverse_complement(loc, length: int):
    def flip(node):
        if node[0] == "range":
            return ("range", length - node[2], length - node[1], node[4], node[3])
        if node[0] == "between":
            return ("between", length - node[2] - 1, length - node[1] - 1)
        return (node[0], node[1][::-1]) if node[0] in LIST_TEXT else node

    return toggle_complement(simplify(rewrite(loc, flip)))


_COMPLEMENT = str.maketrans("AGCTYRWSKMDVHBNagctyrwskmdvhbn", "TCGARYWSMKHBDVNtcgaryswmkhbdvn")


def revcomp_text(residues: str) -> str:
    return residues.translate(_COMPLEMENT)[::-1]


def extract(loc, residues: str, fetch: Callable[[str], str | None] | None = None) -> str:
    """The letters a location stands for. ``fetch`` gives the residues of another record."""
    texts = [residues]

    def enter(node):
        if node[0] == "external":
            other = fetch(node[1]) if fetch else None
            if other is None:
                raise LocationError("external", node)
            texts.append(other)
        elif node[0] in LIST_TEXT and node[0] != "join":
            raise LocationError("ambiguous", node)
        return node

    def leave(node, parts: list[str]) -> str:
        kind = node[0]
        if kind == "range":
            if node[1] < 0 or node[2] > len(texts[-1]) or node[1] > node[2]:
                raise LocationError("out_of_bounds", node)
            return texts[-1][node[1] : node[2]]
        if kind == "join":
            return "".join(parts)
        if kind == "complement":
            return revcomp_text(parts[0])
        if kind == "external":
            other = texts.pop()
            return other if node[2] is None else parts[0]
        raise LocationError("ambiguous", node)

    return fold(loc, leave, enter, inside_external=True)


def leaves(loc, reverse: bool = False, within: str | None = None):
    """(accession, kind, start, end, strand) of each leaf in reading order."""
    todo = [(loc, reverse, within)]
    while todo:
        node, back, home = todo.pop()
        kind, strand = node[0], -1 if back else 1
        if kind == "complement":
            todo.append((node[1], not back, home))
        elif kind in LIST_TEXT:
            todo.extend((part, back, home) for part in (node[1] if back else reversed(node[1])))
        elif kind == "external" and node[2] is not None:
            todo.append((node[2], back, node[1]))
        elif kind == "external":
            yield node[1], "whole", None, None, strand
        elif kind == "gap":
            yield home, "gap", None, node[2], strand
        else:
            yield home, kind, node[1], node[2], strand


NODE_FIELDS = ("op", "parent", "start", "end", "before", "after", "accession", "gap_kind", "gap_len")


def to_nodes(loc) -> list[dict]:
    """Pre-order list of flat nodes; ``parent`` is an index, the root's is null."""
    out: list[dict] = []
    todo = [(loc, None)]
    while todo:
        node, parent = todo.pop()
        row = dict.fromkeys(NODE_FIELDS) | {"op": node[0], "parent": parent}
        if node[0] == "range":
            row |= {"start": node[1], "end": node[2], "before": node[3], "after": node[4]}
        elif node[0] == "between":
            row |= {"start": node[1], "end": node[2]}
        elif node[0] == "gap":
            row |= {"gap_kind": node[1], "gap_len": node[2]}
        elif node[0] == "external":
            row["accession"] = node[1]
        todo.extend((part, len(out)) for part in reversed(parts_of(node, inside_external=True)))
        out.append(row)
    return out


def from_nodes(nodes):
    """Inverse of :func:`to_nodes`. Parts come after their parent, so one backward pass is enough."""
    parts: dict[int, list] = {}
    made = None
    for at in range(len(nodes) - 1, -1, -1):
        n = nodes[at]
        inner = parts.pop(at, [])[::-1]
        op = n["op"]
        if op == "range":
            made = ("range", int(n["start"]), int(n["end"]), bool(n["before"]), bool(n["after"]))
        elif op == "between":
            made = ("between", int(n["start"]), int(n["end"]))
        elif op == "gap":
            made = ("gap", n["gap_kind"], None if n["gap_len"] is None else int(n["gap_len"]))
        elif op == "external":
            made = ("external", n["accession"], inner[0] if inner else None)
        elif op == "complement":
            made = ("complement", inner[0])
        else:
            made = (op, tuple(inner))
        if n["parent"] is not None:
            parts.setdefault(int(n["parent"]), []).append(made)
    return made
