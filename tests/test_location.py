"""The location algebra against its meaning: the letters a location stands for, place by place."""

import random

import pytest

from seqloom.operators import location as loc
from seqloom.operators.location import LocationError, format_location, is_location, parse_location, simplify


def R(a, b, before=False, after=False):
    return ("range", a, b, before, after)


def test_parse_and_print():
    rows = {
        "77": R(76, 77), "310..<412": None, "310..>412": R(309, 412, False, True), "<21..64": R(20, 64, True), "<8..>8": R(7, 8, True, True),
        "complement(-13..250)": ("complement", R(-14, 250)), "610^611": ("between", 609, 610), "96^1": ("between", 95, 0), "1^96": ("between", 0, 95),
        "gap()": ("gap", "unknown", None), "gap(unk100)": ("gap", "unk100", None), "gap(4711)": ("gap", "known", 4711),
        "one-of(33,41)": ("one_of", (R(32, 33), R(40, 41))), "bond(16,88)": ("bond", (R(15, 16), R(87, 88))),
        "order(31..40,complement(join(52,61..70)))": ("order", (R(30, 40), ("complement", ("join", (R(51, 52), R(60, 70)))))),
        "XY_77.3:order(4..6,ZW:19)": ("external", "XY_77.3", ("order", (R(3, 6), ("external", "ZW", R(18, 19))))),
    }
    for text, found in rows.items():
        if found is None:  # only the first place of it reads, the rest is left over
            assert loc.parse_prefix(text)[1] < len(text)
            continue
        assert parse_location(text) == found and format_location(found) == text
        assert loc.from_nodes(loc.to_nodes(found)) == found


def test_prefix_is_kept_and_odd_text_is_external():
    assert loc.parse_prefix("order(30,44)..90") == (("order", (R(29, 30), R(43, 44))), 12)
    assert parse_location("[55.66]") == ("external", "[55.66]", None)
    assert parse_location("order(3..9") == ("external", "order(3..9", None)
    assert parse_location("20^33") == R(19, 20)
    for bad in ("", ":20..31", " 20"):
        with pytest.raises(LocationError):
            parse_location(bad)


@pytest.mark.parametrize("text", ["20..31", "complement(17)", "order(20..31,KQ7:4..6)", "gap(unk100)", "17^18", "-9..12", "KQ7.2:20..31", "join(join(8,9),10)"])
def test_whole_locations(text):
    assert is_location(text)


@pytest.mark.parametrize("text", [None, "", "20..", "order()", "20..<31", ">20..31", "Order(2,3)", "ordr(2,3)", "20..31,40", "complement(2,3)", "KQ7", "join(20,KQ7)", "20...", "2.5", "order(20..31", "gap(unk55)", "20^31", "20-31", "20..31\n"])
def test_not_whole_locations(text):
    assert not is_location(text)


@pytest.mark.parametrize("depth", [1200, 20_000])
def test_any_depth(depth):
    """Ten and more times as deep as any limit there ever was."""
    for name in ("complement", "join", "order", "bond"):
        text = f"{name}(" * depth + "4..6" + ")" * depth
        found = parse_location(text)
        assert is_location(text) and format_location(found) == text and len(loc.to_nodes(found)) == depth + 1
        assert loc.find_bounds(found) == (3, 6)
        assert format_location(loc.from_nodes(loc.to_nodes(found))) == text
        assert loc.truncate(found, 0, 3) is None and loc.find_bounds(loc.truncate(found, 4, 9)) == (4, 6)
        assert len(list(loc.leaves(found))) == 1
    joins = parse_location("join(" * depth + "4..6" + ",9)" * depth)
    assert loc.extract(joins, "abcdefghi") == "def" + "i" * depth
    assert format_location(simplify(parse_location("join(" * depth + "4..6" + ")" * depth))) == "4..6"
    assert loc.find_bounds(loc.reverse_complement(parse_location("complement(" * depth + "4..6" + ")" * depth), 10)) == (4, 7)
    assert not is_location("order(" * depth + "4..6" + ")" * (depth - 1))


def test_numbers_of_thousands_of_digits():
    assert not loc.is_location("1.." + "9" * 5000) and loc.is_location("1.." + "0" * 5000 + "7")
    assert loc.parse_location("0" * 5000 + "1..-3") == ("range", 0, -3, False, False)
    assert loc.is_location(str(2**63 - 1)) and not loc.is_location(str(2**63)) and loc.is_location(str(-(2**63)))


N = 30
LETTERS = "".join(random.Random(77).choice("ACGTNRYacgtn") for _ in range(N))


def random_location(r, depth=0, kinds=("complement", "join", "order")):
    kind = r.choice(["range", "range", *kinds] if depth < 4 else ["range"])
    if kind == "range":
        a = r.randrange(N)
        b = r.randint(a + 1, N)
        return R(a, b, r.random() < 0.1, r.random() < 0.1)
    if kind == "complement":
        return ("complement", random_location(r, depth + 1, kinds))
    return (kind, tuple(random_location(r, depth + 1, kinds) for _ in range(r.randint(1, 4))))


def places(x, reverse=False):
    """(place, strand) of each letter in reading order, from the definition alone."""
    if x[0] == "range":
        run = [(p, -1 if reverse else 1) for p in range(x[1], x[2])]
        return run[::-1] if reverse else run
    if x[0] == "complement":
        return places(x[1], not reverse)
    parts = [places(p, reverse) for p in x[1]]
    return [q for part in (parts[::-1] if reverse else parts) for q in part]


@pytest.mark.parametrize("seed", range(8))
def test_every_operation_keeps_the_letters_it_should(seed):
    r = random.Random(seed)
    for _ in range(150):
        x = random_location(r, kinds=("complement", "join"))
        want = places(x)
        assert parse_location(format_location(x)) == x and loc.from_nodes(loc.to_nodes(x)) == x
        assert places(simplify(x)) == want
        # a turned location reads the same letters of the turned residues
        turned = loc.reverse_complement(x, N)
        assert places(turned) == [(N - 1 - p, -s) for p, s in want]
        assert loc.extract(turned, loc.revcomp_text(LETTERS)) == loc.extract(x, LETTERS)
        assert places(loc.reverse_complement(turned, N)) == want
        # a moved one reads the same letters of the rotated residues
        shift = r.randrange(-3 * N, 3 * N)
        moved = loc.relocate(x, shift, N, True)
        at = -shift % N
        assert [(p % N, s) for p, s in places(moved)] == [((p + shift) % N, s) for p, s in want]
        assert loc.extract(moved, LETTERS[at:] + LETTERS[:at]) == loc.extract(x, LETTERS)
        assert places(loc.relocate(x, shift, 0, False)) == [(p + shift, s) for p, s in want]
        # a cut one keeps the letters of the window, in order
        a = r.randrange(N)
        b = r.randint(a + 1, N)
        cut = loc.truncate(x, a, b)
        assert (places(cut) if cut else []) == [(p, s) for p, s in want if a <= p < b]
        complement = str.maketrans("ACGTNRYacgtn", "TGCANYRtgcan")
        assert loc.extract(x, LETTERS) == "".join(LETTERS[p] if s == 1 else LETTERS[p].translate(complement) for p, s in want)
        assert [(k, i, j) for _, k, i, j, _ in loc.leaves(x)] == [("range", i, j) for i, j in spans(x)]


def spans(x, reverse=False):
    """Ranges in reading order."""
    if x[0] == "range":
        return [(x[1], x[2])]
    if x[0] == "complement":
        return spans(x[1], not reverse)
    parts = [spans(p, reverse) for p in x[1]]
    return [s for part in (parts[::-1] if reverse else parts) for s in part]


def test_simple_forms():
    """Touching plain ranges melt, also from nested joins; a fuzzy end between them keeps them apart; complements come out."""
    for text, out in {"join(11..14,15..19)": "11..19", "join(11..14,14..19)": "join(11..14,14..19)", "join(join(11,12),join(13,20))": "join(11..13,20)", "join(complement(join(33,37)))": "complement(join(33,37))",
                      "join(<11..14,15..>19)": "<11..>19", "join(11..>14,15..19)": "join(11..>14,15..19)", "join(complement(40..44),complement(31..35),complement(20))": "complement(join(20,31..35,40..44))",
                      "order(11..14,15..19)": "order(11..14,15..19)", "order(join(11,12),30)": "order(11..12,30)"}.items():
        assert format_location(simplify(parse_location(text))) == out


def test_bounds():
    for text, out in {"join(25..30,1..9)": (24, 9), "order(17,4)": (16, 4), "bond(17,4..6)": (3, 17), "13^14": (12, 14), "complement(8..21)": (7, 21), "one-of(gap(9),13..15)": (12, 15), "order(4,gap(),17)": (3, 17)}.items():
        assert loc.find_bounds(parse_location(text)) == out
    for text, code in {"gap(12)": "ambiguous", "KQ7:4..6": "ambiguous", "one-of(gap(),KQ7:4)": "empty", "join(gap(),4)": "ambiguous"}.items():
        with pytest.raises(LocationError) as e:
            loc.find_bounds(parse_location(text))
        assert e.value.code == code


def test_fuzzy_ends_go_with_their_letters():
    for text, window, out in [("<6..>19", (9, 12), "10..12"), ("<6..19", (0, 12), "<6..12"), ("6..>19", (9, 40), "10..>19"), ("16^17", (0, 16), "16^17"), ("16^17", (0, 15), None), ("gap(8)", (3, 4), "gap(8)"), ("order(3..5,gap(8))", (20, 30), "order(gap(8))")]:
        found = loc.truncate(parse_location(text), *window)
        assert (found and format_location(found)) == out
    assert format_location(loc.relocate(parse_location("27..>33"), 0, 30, True)) == "join(27..30,1..>3)"
    assert format_location(loc.reverse_complement(parse_location("order(<2..5,7^8,gap())"), 30)) == "complement(order(gap(),23^24,26..>29))"
    with pytest.raises(LocationError):
        loc.wrap(R(0, 2), 0)


def test_letters_of_other_records():
    others = {"KQ7": "ttgaccatgg"}
    assert loc.extract(parse_location("join(2..3,complement(KQ7:1..4))"), "acgt", others.get) == "cg" + "tcaa"
    assert loc.extract(parse_location("KQ7"), "acgt", others.get) == others["KQ7"]
    assert loc.extract(parse_location("KQ7:complement(9..10)"), "acgt", others.get) == "cc"
    for text, code in {"LM4:2": "external", "0..3": "out_of_bounds", "3..5": "out_of_bounds", "KQ7:9..11": "out_of_bounds", "order(2,3)": "ambiguous", "2^3": "ambiguous", "gap()": "ambiguous"}.items():
        with pytest.raises(LocationError) as e:
            loc.extract(parse_location(text), "acgt", others.get)
        assert e.value.code == code
