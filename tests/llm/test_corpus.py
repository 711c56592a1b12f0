import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.llm import bin_packing, name_variants, shared_spans, spam_pages, splitting, term_counts, tokens


def brute_spans(rows, width=80):
    held = defaultdict(set)
    for i, x in rows:
        for p in range(len(x or "") - width + 1):
            held[x[p : p + width]].add(i)
    out = set()
    for i, x in rows:
        cur = None
        for p in range(len(x or "") - width + 1):
            w = x[p : p + width]
            if len(held[w]) > 1 and not re.search("[nN]{10}", w):
                if cur and p <= cur[1]:
                    cur[1] = p + width
                else:
                    if cur:
                        out.add((i, *cur))
                    cur = [p, p + width]
        if cur:
            out.add((i, *cur))
    return out


def test_shared_spans_equal_brute_force(spark):
    r = random.Random(4)
    letters = "".join(r.choice("acgt") for _ in range(3000))
    rows = []
    for i in range(40):
        a = r.randrange(2500)
        x = list(letters[a : a + r.randrange(60, 500)])
        for _ in range(r.randrange(4)):
            x[r.randrange(len(x))] = r.choice("acgtN")
        if r.random() < 0.3:
            x[30:30] = "n" * r.choice([9, 10, 40])
        rows.append((i, "".join(x)))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, ""), (104, "a" * 300), (105, "a" * 200), (106, rows[1][1].upper()), (107, "acgt" * 100), (108, "acgt" * 60)]
    df = spark.createDataFrame([(*x, "own") for x in rows], "record_id long, residues string, text_id string")
    got = [tuple(x) for x in shared_spans.shared_spans(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows)
    again = shared_spans.shared_spans(df.union(df))
    assert {tuple(x) for x in again.collect()} == set(got)
    share = {x.record_id: x for x in shared_spans.shared_share(df, again).collect()}
    assert share[100].share > 0 and share[102].share == 0 and share[102].letters == 0
    copies = shared_spans.later_copies(df, again).collect()
    assert all(x.record_id >= x.kept_in for x in copies) and any(x.record_id == 100 for x in copies)
    assert shared_spans.shared_spans(df.limit(0)).count() == 0


def brute_copies(rows, width=80):
    """Stretches to remove by comparing all windows; rows in order of their ids, one for each."""
    held, out = defaultdict(list), set()
    for i, x in rows:
        for p in range(len(x or "") - width + 1):
            if not re.search("[nN]{10}", x[p : p + width]):
                held[x[p : p + width]].append((i, p))
    for i, x in rows:
        gone, firsts, own, kept = set(), set(), set(), {}
        for p in range(len(x or "") - width + 1):
            places = held.get(x[p : p + width])
            if not places or len({j for j, _ in places}) == 1:
                continue
            letters = range(p, p + width)
            target = gone if places[0][0] < i else firsts if places[0][1] == p else own
            target.update(letters)
            for q in letters if target is not firsts else ():
                kept[q] = min(kept.get(q, i), places[0][0])
        todo = sorted(gone | (own - firsts))
        cuts = [k for k, q in enumerate(todo) if not k or todo[k - 1] != q - 1] + [len(todo)]
        for a, b in zip(cuts, cuts[1:]):
            out.add((i, todo[a], todo[b - 1] + 1, min(kept[q] for q in todo[a:b])))
    return out


def test_later_copies_equal_brute_force(spark):
    r = random.Random(9)
    letters = "".join(r.choice("acgt") for _ in range(2500))
    rows = [(1, letters[:400]), (2, letters[300:700]), (3, letters[100:600]), (4, letters[100:600])]  # 3 is covered by 1 and 2, its span is equal to none of theirs
    rows += [(5, "ccc" + letters[50:250] + "t" * 9 + letters[350:380] + "g" + letters[1000:1200]), (6, letters[900:1300]), (7, letters[900:1300] + "n" * 12 + letters[1000:1150])]
    rows += [(8, letters[1500:1700] + "acca" + letters[1500:1650] + "tggt" + letters[1520:1700]), (9, "gg" + letters[1450:1720]), (10, "a" * 300), (11, "a" * 200), (12, "acgtgca" * 60), (13, "acgtgca" * 40), (14, letters[100:600])]
    for i in range(15, 45):
        a, b = r.randrange(2300), r.randrange(2300)
        rows.append((i, letters[a : a + r.randrange(60, 400)] + letters[b : b + r.randrange(60, 300)]))
    rows += [(45, None), (46, "")]
    df = spark.createDataFrame(rows, "record_id long, residues string").repartition(5)
    got = [tuple(x) for x in shared_spans.later_copies(df, shared_spans.shared_spans(df)).collect()]
    assert len(got) == len(set(got)) and {x[:3] for x in got} == {x[:3] for x in brute_copies(rows)}
    assert set(got) == brute_copies(rows)
    twice = df.union(df)
    assert {tuple(x) for x in shared_spans.later_copies(twice, shared_spans.shared_spans(twice)).collect()} == set(got)


def test_letters_of_all_scripts_count(spark):
    r = random.Random(2)
    common = "".join(r.choice("acgtéß") for _ in range(200))
    rows = [(1, "日" * 100), (2, "本" * 100), (3, "日" * 30 + common + "本"), (4, "ü" + common), (5, "𝛼" * 60 + common[50:] + "?" * 100), (6, "?" * 90), (7, "日" * 90)]
    got = {tuple(x) for x in shared_spans.shared_spans(spark.createDataFrame(rows, "record_id long, residues string")).collect()}
    assert got == brute_spans(rows) and (1, 0, 100) in got and not any(x[0] == 2 for x in got)


def test_many_pieces_of_one_record_merge_in_linear_time(spark):
    n = 1_000_000
    pieces = spark.range(n).select(F.lit(1).cast("long").alias("record_id"), (F.col("id") * 10).alias("span_start"), (F.col("id") * 10 + F.when(F.col("id") % 100 == 0, 5).otherwise(12)).alias("span_end"))
    began = time.monotonic()
    assert shared_spans._islands(pieces).count() == n // 100 + 1 and time.monotonic() - began < 60


def test_blocks_do_not_matter(monkeypatch):
    r = random.Random(1)
    text = shared_spans.Letters("".join(r.choice("acgt") for _ in range(1500)))
    covered = sorted(p for a, n, _, _ in shared_spans.units(text) for p in range(a, a + n))
    assert covered == list(range(len(text) - 79))
    monkeypatch.setattr(shared_spans, "BLOCK", 100)
    assert sorted(p for a, n, _, _ in shared_spans.units(text) for p in range(a, a + n)) == covered


QUALS = "qualifiers array<struct<key:string,value:string>>"


def features(spark, rows):
    return spark.createDataFrame([(i, r, k, q, "x") for i, r, k, q in rows], f"feature_id long, record_id long, kind string, {QUALS}, term string")


def test_term_counts(spark, monkeypatch):
    rows = [(1, 1, "CDS ", [("product", "The kinase, kinase-2"), ("note", None), (None, "x"), ("gene", "a b")]), (1, 1, "CDS ", [("product", "The kinase, kinase-2"), ("note", None), (None, "x"), ("gene", "a b")]),
            (2, 1, "CDS", [("product", "KINASE")]), (3, 2, None, None), (4, 2, " ", []), (5, 3, "gene", [("note", "kinase é x")]), (6, None, "CDS", [("note", "lost")])]
    rows += [(100 + i, 50 + i // 30, "hot", [("note", f"w{i % 7} common word")]) for i in range(300)]
    want_n, want_r = Counter(), defaultdict(set)
    for i, r, k, q in {x[0]: x for x in rows}.values():
        terms = [("kind", k.strip())] if k and k.strip() else []
        for key, value in q or ():
            terms += [("key", key)] if key else []
            terms += [("word", w) for w in re.findall("[a-z]+", value.lower())] if key in ("product", "note") and value else []
        for t in terms:
            want_n[t] += 1
            want_r[t] |= {r} - {None}
    df = features(spark, rows)
    for hot in (200_000, 20):
        monkeypatch.setattr(term_counts, "HOT_ROWS", hot)
        got = {(x.term_class, x.term): (x.n_occurrences, x.n_records) for x in term_counts.count_terms(df).collect()}
        assert got == {t: (n, len(want_r[t])) for t, n in want_n.items()}
    marks = {x.term: x.mark for x in term_counts.mark_terms(term_counts.count_terms(df), 18).collect()}
    assert marks["kinase"] == "rare" and marks["common"] == "common" and marks["hot"] == "common" and marks["lost"] == "rare"
    assert term_counts.count_terms(df.limit(0)).count() == 0


def test_residue_pieces(spark):
    gap = "n" * 12
    x = "a" * 1500 + gap + "c" * 300 + gap + "g" * 2500
    y = "a" * 900 + gap + "c" * 5000
    df = spark.createDataFrame([(1, x, 1), (1, x, 1), (2, "a" * 2000, 1), (3, None, 1), (4, "", 1), (5, y, 1)], "record_id long, residues string, piece int")
    got = defaultdict(list)
    for r in splitting.residue_pieces(df).orderBy("row_id", "piece").collect():
        got[r.row_id].append((r.piece_start, r.piece_end))
    assert got == {1: [(0, 1824), (1724, 3724), (3624, 4324)], 5: [(0, 2000), (1900, 3900), (3800, 5800), (5700, 5912)]}


def test_location_pieces(spark):
    parts = [f"{i}..{i + 5}" for i in range(1000, 2000, 10)]
    text = "complement(join(" + ",".join(parts) + "))"
    pieces = splitting.split_location(text)
    assert pieces[0][0] == 16 and pieces[-1][1] == len(text) - 2
    told = [text[a:b].split(",") for a, b in pieces]
    assert all(b - a <= 200 for a, b in pieces) and all(p[-1] == q[0] for p, q in zip(told, told[1:]))
    assert [*told[0], *(e for t in told[1:] for e in t[1:])] == parts
    nested = "join(1..2,one-of(" + ",".join(parts) + "),3)"
    assert all(b - a <= 200 for a, b in splitting.split_location(nested))
    assert splitting.split_location("A" * 450) == [(0, 200), (200, 400), (400, 450)]
    assert splitting.split_location("join(" + "A" * 199 + "," + "B" * 199 + ",1)") == [(5, 204), (205, 404), (405, 406)]
    df = spark.createDataFrame([(1, text), (1, text), (2, "1..2"), (3, None)], "feature_id long, location_gb string")
    assert splitting.location_pieces(df).count() == len(pieces)


def test_text_pieces():
    r = random.Random(6)
    for _ in range(200):
        text = "".join(r.choice(["word ", "a", ". ", "\n", "\n\n", "\n\n\n", "。", "日"]) for _ in range(r.randrange(1, 400)))
        limit = r.randrange(10, 60)
        p = splitting.split_text(text, limit, 5)
        assert p[0][0] == 0 and p[-1][1] == len(text) and all(0 < b - a <= limit for a, b in p)
        assert all(q[0] == max(a[1] - 5, a[0] + 1) for a, q in zip(p, p[1:]))
    with pytest.raises(ValueError):
        splitting.split_text("x" * 20, 5, 5)


def test_token_ids(spark):
    texts = ["Hello world, it's 2024!", "", None, "日本語 текст\n\n  x", " " * 20000 + "a", "a" * 30000, "<|endoftext|>", "é́\U0001f469‍🚀"] + ["word, " * 40000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = tokens.token_ids(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    enc = tokens.encoding(tokens.TokenizerSpec())
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in tokens.decoded(out).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_cuts_are_safe():
    r, enc = random.Random(1), tokens.encoding(tokens.TokenizerSpec())
    for _ in range(200):
        w = "".join(r.choice(["a", "B", "é", "日", "1", " ", "  ", "\n", "'s", "'", "!", "...", "\t"]) for _ in range(r.randint(1, 150)))
        parts = list(tokens.stretches(w, r.randint(1, 20)))
        assert "".join(parts) == w and sum((enc.encode_ordinary(x) for x in parts), []) == enc.encode_ordinary(w)


def n_containers(plan, counts, capacity):
    """How many containers a plan has, once it is sure that it holds all items and overfills none."""
    held = Counter()
    for filling, times in plan:
        assert sum(filling) <= capacity and times > 0
        for size in filling:
            held[size] += times
    assert held == Counter(counts)
    return sum(times for _, times in plan)


def least_containers(items, capacity):
    """The optimum by trying all."""
    items, rooms, best = sorted(items, reverse=True), [], len(items)

    def place(i):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            place(i + 1)
            rooms[k] += items[i]
        rooms.append(capacity - items[i])
        place(i + 1)
        rooms.pop()

    place(0)
    return best


def test_plans_are_never_worse_than_best_fit():
    r, better = random.Random(3), 0
    for _ in range(1000):
        counts = Counter(r.randint(1, r.choice([30, 50, 70, 100])) for _ in range(r.choice([1, 8, 20, 40, 60, 120, 300])))
        n = n_containers(bin_packing.plan_containers(counts, 100), counts, 100)
        first = n_containers(bin_packing.best_fit_decreasing(counts, 100), counts, 100)
        assert bin_packing.lower_bound(counts, 100) <= n <= first
        better += n < first
    assert better > 20
    for _ in range(200):
        capacity = r.choice([20, 50, 100])
        items = [r.randint(1, capacity) if r.random() < 0.3 else r.randint(capacity // 5, capacity // 2) for _ in range(r.randint(1, 11))]
        assert n_containers(bin_packing.plan_containers(Counter(items), capacity), Counter(items), capacity) == least_containers(items, capacity)
    assert bin_packing.plan_containers({}) == []


def test_plans_do_not_grow_with_the_number_of_items():
    r = random.Random(8)
    once = Counter(r.randint(1, 2048) for _ in range(5000))
    many = {size: n * 10**6 for size, n in once.items()}
    plan = bin_packing.plan_containers(many)
    assert n_containers(plan, many, 2048) <= 1.005 * bin_packing.lower_bound(many, 2048)
    assert len(bin_packing.plan_arrays(plan)["size"]) < 3 * len(once) * 3


def test_containers(spark, monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(bin_packing, "BUCKET_ROWS", 50)
    sizes = [(i, r.choice([0, 300, 300, 300, 700, 2048, 5000, r.randint(1, 2048)])) for i in range(600)] + [(600, None)]
    df = spark.createDataFrame([(*x, "y") for x in sizes], "doc_id long, n long, container_id string")
    rows = bin_packing.assign_containers(df, "doc_id", "n").collect()
    load, whole, places = Counter(), Counter(), set()
    for x in rows:
        if x.container_id is not None:
            load[x.container_id] += x["size"]
            places.add((x.container_id, x.place))
        whole[x.doc_id] += x["size"]
    assert max(load.values()) <= 2048 and whole == Counter({i: n or 0 for i, n in sizes})
    assert len(places) == sum(x.container_id is not None for x in rows) and sorted(load) == list(range(len(load)))
    assert len(load) <= sum(n for _, n in bin_packing.best_fit_decreasing(Counter(x["size"] for x in rows if x["size"]), 2048))
    assert all(x.piece == 1 for x in rows if dict(sizes)[x.doc_id] is None or dict(sizes)[x.doc_id] <= 2048)
    assert bin_packing.assign_containers(df.limit(0), "doc_id", "n").count() == 0


@pytest.mark.parametrize(
    "name, core, first, given, middle",
    [
        ("Wayidogan,F.S.", "wayidogan", "f", None, "s"), ("de Wayidogan, Anthony", "dewayidogan", "a", "anthony", None), ("A. de Wayidogan", "dewayidogan", "a", None, None),
        ("Wayidogan FS", "wayidogan", "f", None, "s"), ("Farid S. WAYIDOGÁN Jr.", "wayidogan", "f", "farid", "s"), ("Peggy Abc", "abc", "m", "peggy", None), ("Abc IV", "abc", "i", None, "v"), ("del Abc SR", "delabc", "s", None, "r"), ("Abc, J. Jr", "abc", "j", None, None),
    ],
)
def test_read_person(name, core, first, given, middle):
    got = name_variants.read_person(name)
    assert (got[0], got[1][0], got[2], got[3]) == (core, first, given, middle)


def test_read_body():
    whole = name_variants.read_body("Gewarirum Valley Transcriptome Working Group")
    for other in ("The Gewarirum-Valley Transcr. Wkg. Grp", "Working Group for the Gewarirum Valley Transcriptome", "Working Group, Gewarirum Valley Transcriptome", "GEWARIRUM VALLEY TRANSCRIPTOME WORKING GROUP (GVTWG)", "Gewarirum VTWG"):
        assert name_variants.read_body(other)[:2] == whole[:2]


@pytest.mark.parametrize("a, b, kind", [("abcdef", "abcdf", "add"), ("abcdf", "abcdef", "drop"), ("abbc", "abc", "double"), ("acb", "abc", "swap"), ("abs", "abd", "near_key"), ("abc", "abc", None), ("ab", "abcd", None), ("axyz", "bxzy", None)])
def test_one_edit(a, b, kind):
    assert name_variants.one_edit(a, b) == kind


def test_variant_pairs(spark):
    groups = [
        ("authors", ["Wayidogan,F.S."] * 9 + ["Farid S. Wayidogan", "Wayidogan F", "Wayidoghan, Farid Jr.", "WAYIDOGAN,F."]),
        ("authors", ["Wayidogan,J.G."] * 4 + ["Jim Wayidogan", "James G. Wayidogan"]),
        ("authors", ["Wayidogan, Karim"] * 3 + ["Wayidogan, Krim", "Karimm Wayidogan", "Wayidogan, Kairm"]),
        ("authors", ["Wayidogan, Maria"] * 3), ("authors", ["Marie Wayidogan"]), ("authors", ["Abc, Marie", "Marie Abc"]),
        ("authors", ["Wayidogan, Bela"]), ("authors", ["Wayidogan, Beta"]),
        ("authors", ["Lu, Otto"] * 40 + ["Lo, Otto"]), ("authors", ["Li, Otto"] * 2), ("authors", ["Li, Nils"]),
        ("authors", ["Miller, Ann B.", "A.B. Miller"]), ("authors", ["Miller, Alice", "Alice C. Miller"]),
        ("consortium", ["Huva Marsh Genome Institute"] * 3 + ["Huva Marsh Gen. Inst.", "The Huva Marsh Genome Institute"]),
        ("consortium", ["Huva Marsh Genome Initiative"] * 2 + ["Initiative for the Huva Marsh Genome"]),
        ("consortium", ["Huva Basin Virome Institute"]),
    ]
    rows = [(f, n, "x") for f, names in groups for n in names] + [("authors", None, "x"), ("authors", "", "x")]
    df = spark.createDataFrame(rows, "field string, name string, core string").select("field", "name")
    want = {(f, a, b) for f, names in groups for a in set(names) for b in set(names) if a < b}
    got = [tuple(r) for r in name_variants.variant_pairs(name_variants.name_entities(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert name_variants.variant_pairs(name_variants.name_entities(df.limit(0))).count() == 0


def test_long_chains_have_one_root(spark):
    cores = ["abcdefghijklmnopqrstuvwxyz"[:n] for n in range(26, 5, -1)]
    df = spark.createDataFrame([("authors", "a", c, 1000.0 - i) for i, c in enumerate(cores)], "field string, sig string, core string, n double")
    links = {x.core: x.root for x in name_variants.core_links(df).collect()}
    assert links == dict.fromkeys(cores[1:], cores[0])
    assert name_variants.core_links(df.limit(0)).count() == 0


def test_stuffed_pages(spark):
    prose = "The old mill was opened by the council in the spring. It rained all day, and the river was not measured. " * 6
    pages = {
        1: (prose, "en", False),
        2: ("Home | News | Contact\n" + "cheap sunglasses, buy boots, " * 40 + "\n© 2020 x.example. All rights reserved.", "en", True),
        3: (prose + "\n" + "\n".join(f"https://a{i}.example/x" for i in range(5)), "en", False),
        4: ("\n".join(f'<a href="//a{i}.example/{i}">Site {i}</a>' for i in range(30)), None, True),
        5: ("Fahrplan der Woche\n" + "\n".join(f"Ort{chr(97 + i)} 12:{i:02} 13:{i:02} 7" for i in range(20)), "de", False),
        6: ("\n".join(f"SKU{i}77 | matelas pas cher Ville{chr(97 + i)} {i}9,00 €" for i in range(20)), "fr", True),
        7: ("送料無料 時計 | " * 40, "ja", True),
        8: ("嵐のあと、静かな市場は閉鎖された。正午前、新しい図書館は調査された。" * 5, "ja", False),
        9: ("", "en", False), 10: (None, "en", False), 11: (" \n ", None, False),
        12: ((prose.replace("mill", "müll").encode().decode("latin-1")), "en", False),
        13: ("The tower was closed.\n" * 20 + "buy boots\n" * 3, "en", False),
    }
    df = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang, _) in pages.items()], "doc_id long, text string, lang string, stuffing string")
    known = spam_pages.learn(df)
    assert known == {}  # no class has enough pages: all is judged by shape
    measures = spam_pages.page_measures(df, known)
    found = {r.doc_id for r in spam_pages.stuffed_pages(measures).collect()}
    assert found == {i for i, (_, _, spam) in pages.items() if spam}
    assert measures.count() == 10 and spam_pages.learn(df.limit(0)) == {}
    assert spam_pages.judged(spam_pages.page_measures(df.limit(0), {})).count() == 0


# ordinary sentences written for this test, one language each
SENTENCES = {
    "it": "Il vecchio mulino è stato aperto dal comune in primavera, ma nessuno ha ancora visto le sue ruote girare. La gente del paese dice che l'acqua del fiume era troppo bassa per muovere le pietre.",
    "pt": "O velho moinho foi aberto pela câmara na primavera, mas ninguém viu ainda as suas rodas a girar. As pessoas da aldeia dizem que a água do rio era baixa demais para mover as pedras.",
    "pl": "Stary młyn został otwarty przez gminę na wiosnę, ale nikt nie widział jeszcze jego kół w ruchu. Ludzie ze wsi mówią, że woda w rzece była zbyt niska, aby poruszyć kamienie.",
    "tr": "Eski değirmen baharda belediye tarafından açıldı, ama kimse onun çarklarının döndüğünü görmedi. Köydeki insanlar nehrin suyunun taşları çevirmek için çok az olduğunu söylüyor.",
    "zh": "这座古老的磨坊在春天由镇政府开放，但是还没有人看到它的轮子转动。村里的人说，河里的水太浅，无法推动那些石头。去年冬天下了很多雪，所以今年的情况也许会好一些。",
    "fi": "Vanha mylly avattiin keväällä kunnan toimesta, mutta kukaan ei ole vielä nähnyt sen rattaiden pyörivän. Kylän asukkaat sanovat, että joen vesi oli liian matalalla kivien liikuttamiseen.",
}
STUFFED = {
    21: "Buy the cheap shoes and the best shoes in the city of the shoes. " * 15,
    22: "buy cheap boots online best boots sale boots " * 20,
    23: "boots (12) sale (40) watches (7) handbag (101) " * 12,
}


@pytest.mark.parametrize("lang", [None, "own", "en", "ja"])
def test_sentences_of_unknown_languages(spark, lang):
    """Prose of languages without a class is never found, whatever is declared; stuffing is, with function words or without."""
    english = ["The old mill was opened by the council in the spring, and the river was not measured until the people of the town had complained about it again.",
               "It was a long winter for the town, but the bridge that the council had built in the spring was not damaged by the water of the river."]
    rows = [(100 + i, f"{english[i % 2]} {chr(97 + i % 26) * (3 + i // 26)} was the next to be visited, and the owner of it was not at home.", "en") for i in range(30)]
    rows += [(i, text, lang if lang != "own" else code) for i, (code, text) in enumerate(SENTENCES.items())]
    rows += [(i, text, "en") for i, text in STUFFED.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spam_pages.learn(df)
    assert {"the", "was"} <= known["en"].function and set(known) == {"en"}
    assert {r.doc_id for r in spam_pages.stuffed_pages(spam_pages.page_measures(df, known)).collect()} == set(STUFFED)


def test_learning_does_not_depend_on_partitions(spark):
    rows = [(i, "Home | News | Contact\n" + f"The mill of the town number {i} was opened.", "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spam_pages.learn(df.repartition(7))
    assert known == spam_pages.learn(df.coalesce(1)) and {"home", "news", "contact"} <= known["en"].menu
    assert "home | news | contact" in known["en"].lines


def test_repaired():
    for text in ("Der Müller fuhr über die Brücke.", "Les élèves ont été là.", "Старый мост был открыт после бури.", "日本語の文章です。", "x² + y² ≤ r²"):
        assert spam_pages.repaired(text) == text
        for charset in ("latin-1", "cp1252", "cp1251", "cp1253"):
            garbled = text.encode().decode(charset, "replace")
            if "\ufffd" not in garbled and text != garbled and len(text) > 20:
                assert spam_pages.repaired(garbled) == text


def test_long_page():
    page = spam_pages.read_page("the mill was old. " * 60_000 + "\n" + "x" * 300_000 + "\n" + "1" * 300_000 + "\n<a " + "y" * 300_000, "en", {})
    assert page["s_letters"] > 0 and page["letters"] >= 900_000


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"p{i}_found" for i in (1, 2, 3, 4, 5, 6, 7, 10)} | {"p8_ids", "p9_containers"} <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
