"""Keyword-stuffed and link-list pages.

Method: thresholds on top-word and n-gram shares, duplicate-line share, link-text ratio, separator density
and missing function words, calibrated per language. No word of any language is listed here; all is
learned from the corpus:

1. ``learn``: one counting step over all pages. The function words of a language are its most frequent
   words that stand in a third of its pages, up to two fifths of all its words. Menus and notices are
   the items and lines that many pages repeat.
2. ``page_measures``: one step that reads each page once. Lines that repeat over many pages are left out,
   lines of sentences make the honest part, and all the rest is measured: shares of its most frequent word, of
   repeated pairs of words, of repeated segments, of letters in links, of segments shaped like
   product tags, separators a word, function words.
3. ``thresholds``: quantiles of the same measures over the sentences of each language; ``stuffed_pages``
   compares columns with columns. A page is found if the rest is longer than its sentences and one measure of the
   rest is beyond its threshold, or if one word is repeated in its different sentences beyond measure.

A language is the class of pages with its declared code; a page belongs to the class whose function words it
holds most of, else to the declared one. Classes of under ``LEAST_PAGES`` pages, and pages in
languages of no class, are judged without function words: there a line is a sentence by its shape.
UTF-8 that was read in another charset is repaired first.

Scale: both steps over pages are narrow; only partial sums are shuffled. Each task sends the words that make
at least 1/1000 of its words of a class, so a share is at most 0.1 points too low. At most ``MOST_WORDS``
words and lines of each class (a code of two or three letters) reach the driver. Measures are cut
(checkpointed) once, a row of numbers for each page.

Defined cases: null, blank and empty texts give no row, and are never found; repeated rows give repeated
results; tables of other numbers (timetables, recipes, code) are no stuffing without tags or links.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import spread

#: A class needs so many pages, and function words are chosen up to this share of its words.
LEAST_PAGES, COVERAGE = 20, 0.4
#: Shares of a class's pages in which a function word, a menu word, a repeated line stands.
FUNCTION_PAGES, MENU_PAGES, LINE_PAGES = 1 / 3, 0.1, 0.05
MOST_WORDS = 300
#: A task sends what makes at least this share of its words or pages of a class.
SENT_SHARE = 1 / 1000
#: Part of ``COVERAGE`` that a line of sentences, and a page of the class, has at least.
SENTENCE_PART = 3 / 8
#: Share of words of one to three letters that sentences of an unknown language have.
SHORT_WORDS = 0.2
LEAST_SENTENCE, LONGEST_OPEN, LEAST_WORDS = 4, 60, 25
LONG_SENTENCE, DIFFERENT_WORDS = 6, 0.6
MOST_SEPARATORS, MENU_ITEM_WORDS, MENU_PART = 0.25, 3, 0.6
#: Notices and menus are lines of fewer letters.
NOTICE_LETTERS = 300
#: Letters that one product tag stands for at most.
TAG_LETTERS = 25
#: A rest is data, if it has neither links nor tags, where so many words hold digits or so many letters stand in short lines that begin with an amount.
DATA_SHARE, AMOUNT_SHARE, AMOUNT_WORDS = 0.25, 0.4, 8

#: Measures of stuffing: the quantile of a language's sentences and the least threshold.
LIMITS = {
    "top_word_share": (0.99, 0.1), "pair_share": (0.99, 0.3), "duplicate_share": (0.99, 0.25),
    "link_share": (0.99, 0.25), "tag_share": (0.99, 0.25), "separator_density": (0.99, 0.2),
}
#: The same for the share of one word among the different sentences of a page.
KEYWORD_LIMIT = (0.95, 0.15)

# Shapes of links and product tags, marks between and at the end of segments.
_LINK = re.compile(r"<a\s[^>]*>.*?(?:</a>|$)|\[url[^\]]*\]|(?:https?://|www\.)\S+", re.I)
_LINK_HINTS = ("://", "www.", "WWW.", "<a", "<A", "[url", "[URL")
_TAG = re.compile(r"(?<=\s)\(\d+\)|[$€£¥₽]\s?\d|\d\s?[€$£¥₽]|\b(?:eur|usd|gbp)\s?\d|\d\s?(?:eur|usd|gbp)\b|-\d+\s?%|^\W*#\w|#[^\W\d]\w+|\[[^\]\s]+\]|^\W*[^\W\d]*\.?\s?\d{4,}\b", re.I)
_TAG_HINT = re.compile(r"[$€£¥₽#\[%]|\(\d|\d{4}|eur|usd|gbp", re.I)
_AMOUNT = re.compile(r"\d+(?:[.,]\d+)?\s*[^\W\d]")
_NUMBERED = re.compile(r"^\(?\d+[.)]\s+")
_DIGIT, _DIGITS = re.compile(r"\d"), re.compile(r"\d+")
_SEPARATORS = (",", "、", ";", "|", "·", "•", "*", "»", ">", "・", "\t", "  ", " - ", " – ", " — ", " / ", " #", "][", "] [")
_ENDER = re.compile(r"[.!?…؟।](?=[\s\"”»’')]|$)|[。！？]")
_EDGE = re.compile(r"(?:[.!?…؟।。！？,、;|·•*»>・\t\n#\[\]]|\s[-–—/]+\s|\s\s)+")
_WORD = re.compile(r"[^\W_ぁ-ゟ゠-ヿ㐀-鿿]+|[ぁ-ゟ]+|[゠-ヺー-ヿ]+|[㐀-鿿]")
_PLAIN_WORD = re.compile(r"[a-z0-9]+")
_HAN = re.compile(r"[぀-ヿ㐀-鿿]")
_LOST = re.compile(r"�|[\x80-\x9f]|[À-ÿ]{3,}|[Ѐ-ЏѐҐґ][^\w\s]|[ΒΓ][\x80-\xbf΀-ώ]")
# a lead byte of UTF-8 and a byte that goes on, as letters of the charsets tried
_GARBLED = re.compile(r"[Â-ôВ-фΒ-τ][\x80-\xbf�ŒœŠšŽžŸˆ˜‚ƒ„…†‡‰‹‘’“”•–—™›Ђ-Џђ-џҐґ№΄-Ώ]")


def _as_byte(error: UnicodeEncodeError):
    bad = error.object[error.start : error.end]
    return bytes(ord(c) for c in bad if ord(c) < 256), error.end


codecs.register_error("seqloom_as_byte", _as_byte)


def repaired(text: str) -> str:
    """Undo UTF-8 that was read in a charset of one byte a letter.

    Sequences of several bytes that happen to be right UTF-8 are too rare to arise by chance: a repair is
    taken if letters outside ASCII become fewer by two fifths, and an eighth of them at least is left (bytes
    that were lost on the way break the sequences around them).
    """
    if text.isascii():
        return text
    odd = len(text) - len(text.encode("ascii", "ignore"))
    if len(_GARBLED.findall(text)) * 10 < odd:
        return text
    best, left = text, odd * 0.6
    for charset in ("cp1252", "latin-1", "cp1251", "cp1253"):
        raw = text.encode(charset, "seqloom_as_byte")
        fixed = raw.decode("utf-8", "ignore")
        now = len(fixed) - len(fixed.encode("ascii", "ignore"))
        if 0.12 * odd <= now < left:
            best, left = fixed, now
    return best


def words_of(text: str) -> list[str]:
    """Words in lower case; runs of kana and single Han letters count as words."""
    return (_PLAIN_WORD if text.isascii() else _WORD).findall(text.lower())


def class_of(lang: str | None) -> str:
    code = re.match(r"[a-z]{2,3}(?![a-z])", (lang or "").strip().lower())
    return code[0] if code and code[0] != "und" else ""


def mask(line: str) -> str:
    """A line with its numbers and addresses made alike."""
    return " ".join([w if w.isalpha() else _masked(w) for w in line.lower().split()])


def _masked(word: str) -> str:
    return "@" if word.isascii() and ("." in word[:-1] or "/" in word[:-1]) else _DIGITS.sub("0", word)


def _segments(line: str) -> list[str]:
    return [s for s in map(str.strip, _EDGE.split(line)) if s]


def menu_letters(line: str, menu: frozenset) -> int:
    """Letters of a line in menu items, whether these are separated by marks or by blanks."""
    found = 0
    for segment in _segments(line.lower()):
        words, at = segment.split(), 0
        while at < len(words):
            item = next((x for k in range(MENU_ITEM_WORDS, 0, -1) if (x := " ".join(words[at : at + k])) in menu and at + k <= len(words)), None)
            found += len(item or "")
            at += item.count(" ") + 1 if item else 1
    return found


def lines_of(text: str) -> list[str]:
    return [line for line in map(str.strip, text.splitlines()) if line]


@dataclass
class Known:
    """What was learned of one class."""

    function: frozenset = frozenset()
    menu: frozenset = frozenset()
    lines: frozenset = frozenset()


@dataclass
class Pool:
    """Lines of one kind and their counts."""

    letters: int = 0
    words: list = field(default_factory=list)
    lines: list = field(default_factory=list)
    n_function: int = 0
    n_separators: int = 0
    n_digits: int = 0
    link_letters: int = 0
    tag_letters: int = 0
    amount_letters: int = 0


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, list[int]] = {}
    words: dict[str, Counter] = {}
    held: dict[tuple[str, str], Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cls = class_of(lang)
            all_lines = lines_of(repaired(text))
            by_line = list(map(words_of, all_lines))
            found = list(chain.from_iterable(by_line))
            total = totals.setdefault(cls, [0, 0])
            total[0] += 1
            total[1] += len(found)
            words.setdefault(cls, Counter()).update(found)
            held.setdefault((cls, "word"), Counter()).update(set(found))
            lines = [line for line in all_lines if len(line) < NOTICE_LETTERS]
            held.setdefault((cls, "line"), Counter()).update(set(map(mask, lines)))
            items = set()
            for line in lines:
                if not _ENDER.search(line):
                    items.update(s.lower() for s in _segments(line) if s.count(" ") < MENU_ITEM_WORDS)
            held.setdefault((cls, "menu"), Counter()).update(items)
    rows = [(cls, "all", "", n_words, n_pages) for cls, (n_pages, n_words) in totals.items()]
    for (cls, kind), counts in held.items():
        n_pages, n_words = totals[cls]
        for item, n in counts.items():
            times = words[cls][item] if kind == "word" else 0
            if times >= SENT_SHARE * n_words if kind == "word" else n >= SENT_SHARE * n_pages * 5:
                rows.append((cls, kind, item, times, n))
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["class", "kind", "item", "n", "pages"])


def _with_text(documents: DataFrame, *columns: str) -> DataFrame:
    return spread(documents.where(F.col("text").rlike(r"\S")).select(*columns))


def learn(documents: DataFrame) -> dict[str, Known]:
    """Function words, menu words and repeated lines of each class with enough pages."""
    sent = _with_text(documents, "text", "lang").mapInArrow(_learn, "class string, kind string, item string, n long, pages long")
    sums = sent.where("class <> ''").groupBy("class", "kind", "item").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    of_class = Window.partitionBy("class")
    size = {c: F.max(F.when(F.col("kind") == "all", F.col(c))).over(of_class) for c in ("n", "pages")}
    sums = sums.withColumns({"all_n": size["n"], "all_pages": size["pages"]}).where((F.col("kind") != "all") & (F.col("all_pages") >= LEAST_PAGES))
    least = F.when(F.col("kind") == "word", FUNCTION_PAGES).when(F.col("kind") == "menu", MENU_PAGES).otherwise(LINE_PAGES)
    order = Window.partitionBy("class", "kind").orderBy(F.desc("n"), F.desc("pages"), "item")
    often = sums.where(F.col("pages") >= least * F.col("all_pages"))
    often = often.withColumns({"place": F.row_number().over(order), "before": F.sum("n").over(order) - F.col("n")})
    chosen = often.where((F.col("place") <= MOST_WORDS) & (F.col("before") < COVERAGE * F.col("all_n")))
    out: dict[str, dict[str, set]] = {}
    covered: Counter = Counter()
    for r in chosen.collect():
        out.setdefault(r["class"], {"word": set(), "menu": set(), "line": set()})[r["kind"]].add(r["item"])
        covered[r["class"]] += r["n"] / r["all_n"] if r["kind"] == "word" else 0
    return {c: Known(frozenset(x["word"] if covered[c] >= COVERAGE / 2 else ()), frozenset(x["menu"]), frozenset(x["line"])) for c, x in out.items()}


def _share(counts: Counter, least: int) -> float:
    return sum(n for n in counts.values() if n >= least) / max(1, counts.total())


def pool_measures(pool: Pool, segments: Counter, function: frozenset = frozenset()) -> dict[str, float]:
    """``top_word_share`` is that of the most frequent word that is no function word."""
    words, n = pool.words, max(1, len(pool.words))
    tops = Counter(words).most_common(len(function) + 1)
    return {
        "letters": pool.letters,
        "words": len(words),
        "top_word_share": next((c for w, c in tops if w not in function), 0) / n,
        "pair_share": _share(Counter(zip(words, words[1:])), 3),
        "duplicate_share": _share(segments, 2),
        "link_share": pool.link_letters / max(1, pool.letters),
        "tag_share": pool.tag_letters / max(1, pool.letters),
        "separator_density": pool.n_separators / n,
        "function_share": pool.n_function / n,
        "digit_share": pool.n_digits / n,
        "amount_share": pool.amount_letters / max(1, pool.letters),
    }


def keyword_share(segments: Counter, function: frozenset) -> float:
    """Largest share of one word of three letters or more, no function word, in segments that differ; it counts from three times on."""
    words = words_of("\n".join(segments))
    top = next((n for w, n in Counter(words).most_common() if len(w) > 2 and w not in function), 0)
    return top / len(words) if top >= 3 else 0.0


def read_page(text: str, lang: str | None, known: dict[str, Known]) -> dict:
    """Class and measures of a page: of its sentences (``s_``) and of the rest, and letters left out."""
    text = repaired(text)
    lines = []
    for line in lines_of(text):
        plain = bare = _NUMBERED.sub("", line) if line[0] in "(0123456789" else line
        if any(hint in bare for hint in _LINK_HINTS):
            plain = _LINK.sub(" ", bare)
        lines.append((line, plain, words_of(plain), len(bare) - len(plain.strip())))
    counts = Counter(chain.from_iterable(words for _, _, words, _ in lines))
    n_words = counts.total()
    fits = {c: sum(map(counts.__getitem__, k.function & counts.keys())) for c, k in known.items() if k.function}
    best = max(fits, key=lambda c: (fits[c], c), default="")
    own = class_of(lang)
    least = SENTENCE_PART * COVERAGE
    fit = bool(best) and fits[best] >= least * n_words
    cls = best if fit else own if own in known and known[own].function else ""
    k = known.get(cls, Known())
    lost = not text.isascii() and len(_LOST.findall(text)) * 40 > len(text)
    # sentences may be in a language other than the declared one: short words tell, or long sentences of different words
    easy = not cls or lost or (not fit and sum(n for w, n in counts.items() if len(w) < 4) >= SHORT_WORDS * n_words)
    sentences, rest, left_out = Pool(), Pool(), 0
    for line, plain, words, links in lines:
        if "©" in line or (len(line) < NOTICE_LETTERS and k.lines and mask(line) in k.lines):
            left_out += len(line)
            continue
        n = len(words)
        enders = len(_ENDER.findall(plain))
        if not enders and not links and k.menu and len(line) < NOTICE_LETTERS and menu_letters(line, k.menu) >= MENU_PART * sum(map(len, words)):
            left_out += len(line)
            continue
        hits = sum(map(k.function.__contains__, words))
        separators = sum(map(plain.count, _SEPARATORS))
        tags = min(len(line), TAG_LETTERS * len(_TAG.findall(plain))) if _TAG_HINT.search(plain) else 0
        crowded = separators > 2 and separators > MOST_SEPARATORS * n * (2 if enders and hits >= 2 * least * n > 0 else 1)
        whole = 2 * (links + tags) < len(line) and not crowded
        long = n >= LEAST_SENTENCE * max(enders, 1)
        told = k.function and (hits >= least * n * (1 if enders else 2) and (enders or long) or hits and enders and long) and max(enders, 1) * LONGEST_OPEN >= n
        shaped = (not fit or lost) and enders and long and n <= LONGEST_OPEN * enders and (easy or n >= LONG_SENTENCE * enders and len(set(words)) >= DIFFERENT_WORDS * n)
        pool = sentences if whole and n and (told or shaped) else rest
        letters = len(line) + (0 if line.isascii() else len(_HAN.findall(line)))  # wide letters count twice
        pool.letters += letters
        pool.words += words
        pool.lines.append(plain)
        pool.n_function += hits
        pool.n_separators += separators
        pool.n_digits += sum(not w.isalpha() for w in words) if _DIGIT.search(plain) else 0
        pool.link_letters += links
        pool.tag_letters += tags
        pool.amount_letters += letters if n <= AMOUNT_WORDS and _AMOUNT.match(line) else 0
    told, others = (Counter(_segments("\n".join(pool.lines).lower())) for pool in (sentences, rest))
    out = {"class": cls, "known": bool(k.function) and not lost, "left_out": left_out, "keyword_share": keyword_share(told, k.function)}
    out |= {f"s_{m}": v for m, v in pool_measures(sentences, told, k.function).items()}
    return out | pool_measures(rest, others, k.function)


_NAMES = list(pool_measures(Pool(), Counter()))
_FIELDS = [("class", "string"), ("known", "boolean"), ("left_out", "long"), ("keyword_share", "double")]
_FIELDS += [(p + m, "long" if m in ("letters", "words") else "double") for p in ("s_", "") for m in _NAMES]
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}


def page_measures(documents: DataFrame, known: dict[str, Known], id_col: str = "doc_id") -> DataFrame:
    """(id, class, measures): one row for each page with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                rows = [read_page(text, lang, known) for text, lang in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array([r[c] for r in rows], _ARROW[k]) for c, k in _FIELDS)], names=[id_col, *(c for c, _ in _FIELDS)])

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"`{c}` {k}" for c, k in _FIELDS)
    return _with_text(documents, id_col, "text", "lang").mapInArrow(run, schema)


def thresholds(measures: DataFrame) -> DataFrame:
    """(class, limit_...): one row for each class with enough pages, from their sentences; the least limits hold for the others."""
    told = measures.where(F.col("s_words") >= LEAST_WORDS)
    limits = [F.greatest(F.percentile_approx(f"s_{m}", q, 1000), F.lit(least)).alias(f"limit_{m}") for m, (q, least) in LIMITS.items()]
    usual = F.percentile_approx("s_function_share", 0.5, 1000).alias("usual_function_share")
    keyword = F.greatest(F.percentile_approx("keyword_share", KEYWORD_LIMIT[0], 10_000), F.lit(KEYWORD_LIMIT[1])).alias("limit_keyword_share")
    return told.groupBy("class").agg(F.count("*").alias("n"), *limits, usual, keyword).where(F.col("n") >= LEAST_PAGES).drop("n")


def judged(measures: DataFrame) -> DataFrame:
    """Measures with the thresholds of their class and ``stuffed``. ``measures`` is read twice: cut it before."""
    rows = measures.join(F.broadcast(thresholds(measures)), "class", "left")  # a class is a code of at most three letters
    limits = {f"limit_{m}": F.coalesce(f"limit_{m}", F.lit(least)) for m, (_, least) in [*LIMITS.items(), ("keyword_share", KEYWORD_LIMIT)]}
    rows = rows.withColumns(limits)
    beyond = {m: F.col(m) > F.col(f"limit_{m}") for m in LIMITS}
    listed = beyond["link_share"] | beyond["tag_share"]
    repeated = beyond["top_word_share"] | beyond["pair_share"] | beyond["duplicate_share"] | beyond["separator_density"]
    missing = F.col("known") & (F.col("function_share") < SENTENCE_PART * F.coalesce("usual_function_share", F.lit(COVERAGE)))
    enough = F.col("words") >= LEAST_WORDS
    stuffing = listed | ((F.col("digit_share") < DATA_SHARE) & (F.col("amount_share") < AMOUNT_SHARE) & enough & (repeated | missing))
    keyword = F.col("known") & (F.col("keyword_share") > F.col("limit_keyword_share"))
    stuffed = F.when(F.col("letters") > F.col("s_letters"), stuffing).otherwise(keyword)
    return rows.withColumn("stuffed", stuffed)


def stuffed_pages(measures: DataFrame) -> DataFrame:
    return judged(measures).where("stuffed")
