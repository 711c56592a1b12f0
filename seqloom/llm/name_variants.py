"""Variant spellings of names typed by people: persons and bodies.

Method: noisy-channel attribution. Distinct spellings are counted once; a spelling is read into a core
(surname with particle, or place), a signature (first initial, or initials of the other words) and
details (given name and middle initials, or the words). Frequent forms are candidate canonical forms. A
rarer core is attached to the core of the same signature with the largest posterior: frequency as
prior, times the likelihood of the one edit between them. Within the forms of one core and signature, a
form is attached to the entity with the largest posterior: its frequency, times the likelihood that its given
name is written as an initial, a short form or with a typo, and that its middle initial is left out or
told for the first time; for bodies, times the likelihood of each word's abbreviation or typo. A form that no
entity can have brought about founds one.

A typo is only seen where the typed form isn't in use by itself: a given name that stands with another
surname too is a name of its own, and so is a surname of under ``SHORT_CORE`` letters that stands with two initials.

Scale: rows are reduced to distinct spellings first (partial counts before the shuffle), spellings to distinct forms
(given name and middle initial, or words) before a group is looked at: a group has as many members as its surname
and initial have different given names, however many rows or spellings there are. Candidates
come from an equi-join on deletion neighbours, each spelling in ``len + 1`` keys of its own field and
signature, and only rarer-to-more-frequent pairs are made. Nothing is collected; broadcasts are left to the planner.

Rules: particles belong to the surname; case, accents, full stops, hyphens and order of parts don't
matter; middle initials and Jr. may be missing; people with one surname and different first given
names stay apart (nicknames count as the names they stand for); bodies of one place with another
subject or kind stay apart. Null and blank names give no row; equal spellings count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seqloom.operators.packed_values import clean
from seqloom.session import by_key, cut

#: Cores of fewer letters have many neighbours by chance: an edit of one must be so much likelier.
SHORT_CORE, SHORT_FACTOR = 5, 0.1
#: How much likelier a near spelling is a typo than another entity with the same signature.
TYPO_ODDS = 10.0
#: Likelihood of one edit by its kind.
EDIT_LIKELIHOOD = {"swap": 0.3, "double": 0.3, "drop": 0.2, "add": 0.2, "near_key": 0.2, "alike": 0.2, "vowel": 0.2, "other": 0.02}
#: Likelihood that a given name is written as its initial or in its short form.
INITIAL_ONLY, SHORT_FORM = 0.3, 0.1
#: Likelihood that a middle initial is left out, and that a form tells one that no other form of the person had.
NO_MIDDLE, NEW_MIDDLE = 0.5, 0.02

# Common English short forms and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan alexander", "alex": "alexander alexandra", "andy": "andrew", "ann": "anna",
    "annie": "anna anne", "becky": "rebecca", "ben": "benjamin", "bert": "albert robert", "beth": "elizabeth",
    "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "brad": "bradley",
    "cathy": "catherine", "charlie": "charles", "chris": "christopher christine", "chuck": "charles", "cindy": "cynthia",
    "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard",
    "don": "donald", "doug": "douglas", "ed": "edward edmund", "eddie": "edward", "ellie": "eleanor", "fran": "frances francis",
    "frank": "francis franklin", "fred": "frederick", "gabe": "gabriel", "gene": "eugene", "greg": "gregory", "hal": "harold",
    "hank": "henry", "harry": "henry harold", "jack": "john", "jake": "jacob", "jeff": "jeffrey", "jen": "jennifer",
    "jenny": "jennifer", "jerry": "gerald jerome", "jill": "gillian", "jim": "james", "jimmy": "james", "joe": "joseph",
    "joey": "joseph", "johnny": "john", "jon": "jonathan", "josh": "joshua", "judy": "judith", "kate": "katherine",
    "kathy": "katherine kathleen", "katie": "katherine", "ken": "kenneth", "kim": "kimberly", "larry": "lawrence",
    "len": "leonard", "liz": "elizabeth", "lou": "louis louise", "maggie": "margaret", "mandy": "amanda", "marge": "margaret",
    "matt": "matthew", "meg": "margaret", "mel": "melvin melanie", "mike": "michael", "mickey": "michael", "molly": "mary",
    "nan": "nancy", "nate": "nathan nathaniel", "ned": "edward", "nell": "eleanor helen", "nick": "nicholas", "pam": "pamela",
    "pat": "patricia patrick", "patty": "patricia", "peg": "margaret", "peggy": "margaret", "penny": "penelope", "pete": "peter",
    "phil": "philip phillip", "polly": "mary", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert",
    "robby": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander sandra", "stan": "stanley",
    "steve": "stephen steven", "stu": "stuart", "sue": "susan", "susie": "susan", "ted": "edward theodore", "terry": "terence theresa",
    "tim": "timothy", "tina": "christina", "toby": "tobias", "tom": "thomas", "tommy": "thomas", "tony": "anthony",
    "tracy": "theresa", "vic": "victor", "vicky": "victoria", "vince": "vincent", "walt": "walter", "wendy": "gwendolyn",
    "will": "william", "zach": "zachary",
}
#: Words that open a surname.
PARTICLES = frozenset("von van der den del della de di da la le el al bin ter".split())
#: Neighbours on the usual keyboard.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEAR = {(a, b) for row in _ROWS for a, b in zip(row, row[1:])}
_NEAR |= {(a, b) for up, low in zip(_ROWS, _ROWS[1:]) for i, b in enumerate(low) for a in up[i : i + 2]}
_NEAR |= {(b, a) for a, b in _NEAR}

#: Letters that sound alike.
_ALIKE = {frozenset(p) for p in ("lr", "bp", "vw", "ck", "dt", "sz", "gk", "gj", "fv", "mn", "iy", "ks", "cs", "kq")}
#: A numeral only counts as a suffix where a given name is left; else it is initials.
_SUFFIX = re.compile(r"[,\s]+(?:(?:Jr|Sr|jr|sr)\.?|(?:JR|SR)\.)$")  # JR and SR without full stop are initials
_NUMERAL = re.compile(r"^(\S.*[\s,]\S.*)\s+(?:ii|iii|iv)$", re.I)


def fold(text: str) -> str:
    """Lower case without accents."""
    plain = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in plain if not unicodedata.combining(c))


def _given(text: str, compact: bool) -> tuple[str | None, list[str]]:
    """First given name in full, if written, and the initials of all given names."""
    words = [w for w in re.split(r"[.\s\-]+", text) if w]
    first, initials = None, []
    for i, w in enumerate(words):
        if compact or (w.isupper() and len(w) <= 3 and len(words) == 1 and i == 0 and len(w) > 1):
            initials += list(fold(w))
        elif len(w) == 1:
            initials.append(fold(w))
        else:
            if i == 0:
                first = fold(w)
            initials.append(fold(w)[:1])
    return first, initials


def read_person(name: str) -> tuple[str, list[str], str | None, str | None]:
    """(core, possible first initials, given name, middle initial)."""
    text = _SUFFIX.sub("", name.strip())
    text = _NUMERAL.sub(r"\1", text)
    if "," in text:
        surname, _, given = text.partition(",")
        first, initials = _given(given, False)
    else:
        words = text.split()
        tail = words[-1]
        if len(words) > 1 and tail.isupper() and tail.isalpha() and len(tail) <= 3 and len(words[-2]) > 1 and not words[-2].endswith("."):
            surname = " ".join(words[:-1])
            first, initials = _given(tail, True)
        else:
            at = len(words) - 1
            while at > 1 and words[at - 1].casefold() in PARTICLES:
                at -= 1
            surname = " ".join(words[at:])
            first, initials = _given(" ".join(words[:at]), False)
    core = re.sub(r"[^\w]+", "", fold(surname))
    firsts = [n[0] for n in NICKNAMES.get(first, "").split()] if first in NICKNAMES else []
    return core, list(dict.fromkeys(firsts or initials[:1] or [""])), first, initials[1] if len(initials) > 1 else None


def read_body(name: str) -> tuple[str, list[str], list[str] | None]:
    """(core, [signature], other words or None if only their initials are written)."""
    text = re.sub(r"\s*\([^()]*\)\s*$", "", name.strip())
    text = re.sub(r"^the\s+", "", text, flags=re.I)
    if m := re.fullmatch(r"(.+?)\s+(?:for|of)\s+(?:the\s+)?(.+)", text, re.I):
        text = f"{m[2]} {m[1]}"
    elif m := re.fullmatch(r"([^,]+),\s*([^,]+)", text):
        text = f"{m[2]} {m[1]}"
    words = [w for w in re.split(r"[\s\-.,]+", text) if w and w.casefold() not in ("the", "of", "for", "and", "&")]
    if not words:
        return "", [""], None
    rest = words[1:]
    core = re.sub(r"[^\w]+", "", fold(words[0]))
    if len(rest) == 1 and rest[0].isupper() and 2 <= len(rest[0]) <= 6 and not words[0].isupper():
        return core, [fold(rest[0])], None
    return core, ["".join(fold(w)[:1] for w in rest)], [fold(w) for w in rest]


def one_edit(typed: str, meant: str) -> str | None:
    """Kind of the one edit that turns ``meant`` into ``typed``; None if there is more than one."""
    n, m = len(typed), len(meant)
    if typed == meant or abs(n - m) > 1:
        return None
    i = next((k for k in range(min(n, m)) if typed[k] != meant[k]), min(n, m))
    if n == m:
        if typed[i + 1 :] == meant[i + 1 :]:
            a, b = typed[i], meant[i]
            return "near_key" if (a, b) in _NEAR else "alike" if frozenset((a, b)) in _ALIKE else "vowel" if a in "aeiouy" and b in "aeiouy" else "other"
        swapped = typed[i : i + 2] == meant[i : i + 2][::-1] and typed[i + 2 :] == meant[i + 2 :]
        return "swap" if swapped else None
    if n > m:
        if typed[i + 1 :] != meant[i:]:
            return None
        return "double" if i and typed[i] == typed[i - 1] else "add"
    return "drop" if meant[i + 1 :] == typed[i:] else None


def abbreviates(short: str, word: str) -> float:
    """Likelihood that ``short`` stands for ``word``."""
    if short == word:
        return 1.0
    if len(short) < len(word) and word.startswith(short):
        return 0.3
    letters = iter(word)
    if short[:1] == word[:1] and len(short) < len(word) and all(c in letters for c in short):
        return 0.03
    return 0.1 * EDIT_LIKELIHOOD[kind] if len(word) >= SHORT_CORE and (kind := one_edit(short, word)) else 0.0


def _names_meet(a: str, b: str) -> bool:
    return a == b or bool({a, *NICKNAMES.get(a, "").split()} & {b, *NICKNAMES.get(b, "").split()})


def given_likelihood(given: str | None, n: int, names: dict[str, int], in_use: bool) -> float:
    """Likelihood that a person of these given names (with their counts) is written ``n`` times with ``given``.

    As with surnames, a typo is taken for one only if it is likelier than another person.
    """
    if not names or given is None:
        return INITIAL_ONLY
    best = 0.0
    if given in names:
        return 1.0
    for name, times in names.items():
        if _names_meet(given, name):
            best = max(best, SHORT_FORM)
        elif not in_use and min(len(given), len(name)) > 2:
            p = EDIT_LIKELIHOOD.get(one_edit(given, name), 0.0)
            best = max(best, p if times * p * TYPO_ODDS >= n else 0.0)
    return best


def middle_likelihood(middle: str | None, known: str | None) -> float:
    if middle == known:
        return 1.0
    if middle is None:
        return NO_MIDDLE
    return NEW_MIDDLE if known is None else 0.0


def group_persons(forms: list[tuple[str | None, str | None, int, bool]]) -> list[int]:
    """Entity number for each distinct (given, middle, n, whether the given name is in use elsewhere) of one core and initial.

    Fuller and more frequent forms come first; names in use before those that may be typos.
    """

    def rank(i: int) -> tuple:
        given, middle, n, in_use = forms[i]
        return given is not None and not in_use and n < 2, -(bool(given) + bool(middle)), given in NICKNAMES, -n, str((given, middle))

    entities: list[dict] = []
    out = [0] * len(forms)
    for i in sorted(range(len(forms)), key=rank):
        given, middle, n, in_use = forms[i]
        posterior = [(e["n"] * given_likelihood(given, n, e["given"], in_use) * middle_likelihood(middle, e["middle"]), -e["id"]) for e in entities]
        best, at = max(posterior, default=(0.0, 0))
        if best > 0:
            entity = entities[-at]
        else:
            entity = {"given": {}, "middle": None, "n": 0, "id": len(entities)}
            entities.append(entity)
        if given:
            entity["given"][given] = entity["given"].get(given, 0) + n
        entity["middle"] = entity["middle"] or middle
        entity["n"] += n
        out[i] = entity["id"]
    return out


def group_bodies(forms: list[tuple[tuple[str, ...] | None, int]]) -> list[int]:
    """Entity number for each distinct (words, n) of one place and signature.

    Candidate canonical forms are word sequences that abbreviate no other of the group.
    """
    counts = dict(forms)

    def likelihood(form, canon) -> float:
        p = 1.0
        for a, b in zip(form, canon):
            p *= abbreviates(a, b)
        return p if len(form) == len(canon) else 0.0

    known = sorted((k for k in counts if k is not None), key=lambda k: (-sum(map(len, k)), -counts[k], k))
    weight: dict[tuple, float] = {}
    home: dict[tuple | None, tuple] = {}
    for form in known:
        best = max(weight, key=lambda c: (weight[c] * likelihood(form, c), c), default=None)
        if best is None or not likelihood(form, best):
            best = form
            weight[form] = 0
        home[form] = best
        weight[best] += counts[form]
    home[None] = max(weight, key=lambda c: (weight[c], c), default=())
    number = {c: i for i, c in enumerate(weight or [()])}
    return [number[home[words]] for words, _ in forms]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields, names, counts = (batch.column(i).to_pylist() for i in range(3))
        core, sig, given, middle, words = [], [], [], [], []
        for field, name in zip(fields, names):
            if field == "authors":
                c, s, g, m = read_person(name)
                w = None
            else:
                (c, s, w), g, m = read_body(name), None, None
            core.append(c)
            sig.append(s)
            given.append(g)
            middle.append(m)
            words.append(w)
        texts = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(fields, pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(core, pa.string()), pa.array(sig, texts), pa.array(given, pa.string()), pa.array(middle, pa.string()), pa.array(words, texts)],
            names=["field", "name", "n", "core", "sigs", "given", "middle", "words"],
        )


_READ_SCHEMA = "field string, name string, n long, core string, sigs array<string>, given string, middle string, words array<string>"
_FORM_SCHEMA = "field string, root string, sig string, given string, middle string, words array<string>, entity int"


@F.pandas_udf(DoubleType())
def _typo_likelihood(typed: pd.Series, meant: pd.Series) -> pd.Series:
    return pd.Series([EDIT_LIKELIHOOD.get(one_edit(a, b), 0.0) for a, b in zip(typed, meant)], dtype=float)


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (field, root, sig, forms) to one row for each form with its entity."""
    for batch in batches:
        rows = []
        for field, root, sig, forms in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if field == "authors":
                numbers = group_persons([(f["given"], f["middle"], f["n"], f["in_use"]) for f in forms])
            else:
                numbers = group_bodies([(None if f["words"] is None else tuple(f["words"]), f["n"]) for f in forms])
            rows += [(field, root, sig, f["given"], f["middle"], f["words"], k) for f, k in zip(forms, numbers)]
        columns = list(zip(*rows)) or [()] * 7
        kinds = (*[pa.string()] * 5, pa.list_(pa.string()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["field", "root", "sig", "given", "middle", "words", "entity"])


def core_links(profiles: DataFrame) -> DataFrame:
    """(field, sig, core, root): each core that is a variant, with the core it belongs to."""
    keyed = profiles.where(F.length("core") > 1).join(
        profiles.groupBy("field", "core").agg((F.min("sig") != F.max("sig")).alias("in_use")), ["field", "core"]
    )
    # a short surname that stands with two initials is a name of its own
    keyed = keyed.withColumn("fixed", F.col("in_use") & (F.length("core") < SHORT_CORE)).drop("in_use")
    deleted = F.transform(
        F.sequence(F.lit(1), F.length("core")), lambda i: F.concat(F.substring("core", 1, i - 1), F.substring("core", i + 1, F.length("core")))
    )
    keyed = keyed.withColumn("key", F.explode(F.array_distinct(F.concat(F.array("core"), deleted))))
    rare, often = keyed.alias("s"), keyed.alias("t")
    more = (F.col("t.n") > F.col("s.n")) | ((F.col("t.n") == F.col("s.n")) & (F.col("t.core") < F.col("s.core")))
    near = F.abs(F.length("t.core") - F.length("s.core")) <= 1
    on = [F.col(f"s.{c}") == F.col(f"t.{c}") for c in ("field", "sig", "key")]
    pairs = rare.join(often, [*on, more, near, ~F.col("s.fixed")]).select(
        F.col("s.field").alias("field"), F.col("s.sig").alias("sig"), F.col("s.core").alias("core"), F.col("s.n").alias("n"), F.col("t.core").alias("root"), F.col("t.n").alias("root_n")
    )
    pairs = pairs.dropDuplicates(["field", "sig", "core", "root"]).withColumn("p", _typo_likelihood("core", "root"))
    pairs = pairs.withColumn("p", F.when(F.least(F.length("core"), F.length("root")) < SHORT_CORE, F.col("p") * SHORT_FACTOR).otherwise(F.col("p")))
    fits = pairs.where((F.col("p") > 0) & (F.col("root_n") * F.col("p") * TYPO_ODDS >= F.col("n")))
    best = fits.groupBy("field", "sig", "core").agg(F.max_by("root", F.struct(F.col("root_n") * F.col("p"), "root")).alias("root"))
    links = cut(best)
    # links lead to ever more frequent cores, so doubling ends with the last core that has one above its root
    while True:
        up = links.select("field", "sig", F.col("core").alias("root"), F.col("root").alias("above"))
        if links.join(up, ["field", "sig", "root"], "left_semi").isEmpty():
            break
        links = cut(links.join(up, ["field", "sig", "root"], "left").select("field", "sig", "core", F.coalesce("above", "root").alias("root")))
    return links


def name_entities(names: DataFrame) -> DataFrame:
    """(field, name, n, core, sig, entity) of each distinct spelling of ``names`` (field, name).

    core, sig and entity together tell the person or body.
    """
    spelled = names.where(F.col("name").isNotNull() & (F.col("name") != "")).groupBy("field", "name").agg(F.count("*").alias("n"))
    read = cut(by_key(spelled, "name").mapInArrow(_read, _READ_SCHEMA))
    options = read.withColumn("sig", F.explode("sigs"))
    profiles = options.groupBy("field", "core", "sig").agg(F.sum(F.col("n") / F.size("sigs")).alias("n"))
    # a nickname that may stand for names with several initials goes where most of its core is
    prior = options.join(profiles.withColumnRenamed("n", "prior"), ["field", "core", "sig"])
    place = prior.groupBy("field", "name").agg(F.max_by("sig", F.struct("prior", "sig")).alias("sig"))
    placed = read.drop("sigs").join(place, ["field", "name"])
    rooted = cut(placed.join(core_links(profiles), ["field", "sig", "core"], "left").withColumn("root", F.coalesce("root", "core")))
    # given names that stand with two surnames are in use; distinct forms are all that a group is judged by
    names_in_use = rooted.where("given IS NOT NULL").groupBy("given").agg((F.min("root") != F.max("root")).alias("in_use")).where("in_use")
    forms = rooted.groupBy("field", "root", "sig", "given", "middle", "words").agg(F.sum("n").alias("n"))
    forms = forms.join(names_in_use, "given", "left").withColumn("in_use", F.coalesce("in_use", F.lit(False)))
    groups = forms.groupBy("field", "root", "sig").agg(F.collect_list(F.struct("given", "middle", "words", "n", "in_use")).alias("forms"))
    told = by_key(groups, "root", "sig").mapInArrow(_group, _FORM_SCHEMA)
    keys = ("field", "root", "sig", "given", "middle", "words")
    r, t = rooted.alias("r"), told.alias("t")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys]
    return r.join(t, same).select("r.field", "r.name", "r.n", F.col("r.root").alias("core"), "r.sig", "t.entity")


def variant_pairs(entities: DataFrame) -> DataFrame:
    """(field, name_a, name_b), name_a < name_b: every two spellings of one entity."""
    e = cut(entities)
    a, b = e.alias("a"), e.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("field", "core", "sig", "entity")]
    return a.join(b, [*same, F.col("a.name") < F.col("b.name")]).select("a.field", F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))


def bodies(refs: DataFrame) -> DataFrame:
    """(field, name) of the consortia, without outer blanks and with single inner ones."""
    return refs.select(F.lit("consortium").alias("field"), clean(F.col("consortium")).alias("name"))
