import hashlib
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import native
from seqloom.functions.location_udf import gb_find_bounds, gb_relocate, gb_revcomp_location, gb_truncate
from seqloom.operators import location as loc
from seqloom.operators import records as ops
from seqloom.operators import statistics as stats
from seqloom.operators.regions import merge_adjacent_segments, merge_spans, overlap_join
from seqloom.plans import sequence_queries as plans

RECORD = "record_id long, name string, accession string, version string, topology string, locus_len long, residues string, features " + ops.SIMPLE_FEATURE


def feature(text, kind="CDS", **quals):
    return (kind, text, [(k, v) for k, v in quals.items()])


def test_residue_expressions(spark):
    """Ranges against walking letter by letter from the start, once around where start and end meet."""
    letters = "gattyrcNKm-"
    df = spark.createDataFrame([(letters + "xX",)], "s string")
    assert df.select(native.revcomp("s")).first()[0] == "Xx" + "-kMNgyraatc"
    n = len(letters)
    ends = [(a, b) for a in range(-n - 3, 2 * n, 3) for b in range(-n - 2, 3 * n, 4)]

    def walked(a, b, circular):
        if not circular:
            return letters[a:b] if 0 <= a <= b <= n and a < n else None
        size = b - a if a < b else b + n - a
        return "".join(letters[(a + i) % n] for i in range(size)) if size > 0 else None

    rows = spark.createDataFrame([(a, b, c) for a, b in ends for c in (True, False)], "a long, b long, c boolean").withColumn("r", F.lit(letters))
    got = rows.select("a", "b", "c", native.extract_range_seq("r", "a", "b", F.col("c")).alias("t"), native.range_to_location("a", "b", F.lit(n), F.col("c")).alias("at"), native.rotate("r", "a").alias("turned")).collect()
    for x in got:
        assert x.t == walked(x.a, x.b, x.c), x
        if x["at"] is not None:
            assert loc.extract(loc.parse_location(x["at"]), letters) == x.t
        assert x.turned == letters[x.a % n :] + letters[: x.a % n]
    assert sum(x["at"] is not None for x in got) > len(got) / 4
    assert spark.range(1).select(native.unwrap_range(F.lit(3), F.lit(4), F.lit(0), F.lit(True))).first()[0] is None


def test_text_expressions(spark):
    df = spark.createDataFrame([("acgt" * 40,), ("",), (None,), ("a" * 60,)], "s string")
    blocks = [r[0] for r in df.select(native.origin_block("s")).collect()]
    assert blocks[1] == blocks[2] == ""
    assert blocks[0].split("\n")[3] == "      121 " + " ".join(["acgtacgtac", "gtacgtacgt"] * 2)
    assert blocks[3].count("\n") == 2
    scanned = df.select("s", native.scan_residues(F.regexp_replace(native.origin_block("s"), "^ORIGIN *\n", "")).alias("t")).collect()
    assert all((r.s or "") == r.t for r in scanned)
    assert spark.range(1).select(native.bad_residue(F.lit("1 ac*t")), native.fasta(F.lit("h"), F.lit("a" * 120))).first()[:] == ("*", ">h\n" + ("a" * 60 + "\n") * 2)
    d = spark.range(1).select(native.parse_date(F.lit("31-FEB-2000")).alias("d")).select("d", native.format_date("d"), native.calendar_date("d")).first()
    assert tuple(d[0]) == (2000, 2, 31) and d[1] == "31-FEB-2000" and d[2] is None
    assert spark.range(1).select(native.make_date(F.lit(2000), F.lit(13), F.lit(1))).first()[0] is None


def test_native_equals_general(spark):
    r = random.Random(11)
    rows = []
    for _ in range(400):
        a = r.randrange(40)
        b = a + r.randrange(1, 40)
        x = ("range", a, b, r.random() < 0.2, r.random() < 0.2)
        rows.append((loc.format_location(("complement", x) if r.random() < 0.5 else x), r.randrange(-60, 60), r.randrange(0, 30), r.random() < 0.5))
    df = spark.createDataFrame(rows, "t string, d long, lo long, c boolean").withColumn("n", F.lit(80).cast("long")).withColumn("hi", F.col("lo") + 25)
    df = df.withColumns({"x": F.col("t"), "y": F.col("t"), "z": F.col("t")})
    out = ops.relocate_column(df, "x", F.col("d"), F.col("n"), F.col("c"))
    out = ops.reverse_column(ops.truncate_column(out, "y", F.col("lo"), F.col("hi")), "z", F.col("n"))
    out = out.select("x", "y", "z", gb_relocate("t", "d", "n", "c").alias("gx"), gb_truncate("t", "lo", "hi").alias("gy"), gb_revcomp_location("t", "n").alias("gz"), native.parse_simple("t").alias("s"), gb_find_bounds("t").alias("b"), "t")
    for q in out.withColumn("shown", native.format_simple("s")).collect():
        assert (q.x, q.y, q.z, q.s.start, q.s.end, q.shown) == (q.gx, q.gy, q.gz, q.b.start, q.b.end, q.t)


@pytest.mark.parametrize("text", ["<5", "complement(5", "5..", "join(1,2)", "1..2\n", "a", ""])
def test_not_simple(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(native.parse_simple("t")).first()[0] is None


def test_record_operators(spark):
    fs = [feature("1..4"), feature("join(8..10,1..2)"), feature("complement(5..6)"), feature("gap()"), feature("AB:1..2")]
    rows = [(1, "c", None, None, "circular", 10, "ACGTNacgtn", fs), (2, "l", None, None, "linear", None, "ACGTNacgtn", fs), (3, "e", None, None, "circular", None, "", []), (4, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, RECORD)
    turned = {r.record_id: r for r in ops.set_origin(df, F.lit(3)).collect()}
    assert turned[1].residues == "TNacgtnACG"
    assert [f.location_gb for f in turned[1].features] == ["join(8..10,1)", "5..9", "complement(2..3)", "gap()", "AB:1..2"]
    assert turned[2].residues == "ACGTNacgtn" and [f.location_gb for f in turned[2].features][1] == "join(8..10,1..2)"
    back = ops.set_origin(ops.set_origin(df, F.lit(3)), F.lit(7)).where("record_id = 1").first()
    assert back.residues == "ACGTNacgtn" and [f.location_gb for f in back.features] == ["1..4", "join(8..10,1..2)", "complement(5..6)", "gap()", "AB:1..2"]
    rc = {r.record_id: r for r in ops.revcomp_records(df).collect()}
    assert rc[1].residues == "nacgtNACGT" and rc[1].name == "c"
    assert [f.location_gb for f in rc[1].features] == ["complement(7..10)", "complement(join(9..10,1..3))", "5..6", "complement(gap())", "complement(AB:1..2)"]
    part = {r.record_id: r for r in ops.extract_range(df, F.lit(7), F.lit(2)).collect()}
    assert part[1].residues == "gtnAC" and part[1].topology == "linear"
    assert [f.location_gb for f in part[1].features] == ["4..5", "1..5", "gap()", "AB:1..2"]
    assert part[2].residues is None and part[2]._error == "region out of range"


def test_external_parts(spark):
    rows = [(1, "main", "M1", "M1.1", "linear", 10, "ACGTNacgtn", []), (2, "T", "X1", "X1.1", "linear", 8, "ttttggcc", []), (3, "T", None, None, "linear", 2, "aa", [])]
    records = spark.createDataFrame(rows, RECORD)
    texts = ["join(1..2,X1.1:1..5)", "T", "complement(X1:6..8)", "Q9:1", "9..12", "order(1,2)", "1^2", "join(1,gap(3))", "complement(join(1..2,complement(4..5)))"]
    quals = "array<struct<key:string,value:string>>"
    features = spark.createDataFrame([(i, 1, "CDS", t, [("locus_tag", "L"), ("gene", f"g{i}")]) for i, t in enumerate(texts)], f"feature_id long, record_id long, kind string, location_gb string, qualifiers {quals}")
    got = {r.feature_id: (r.residues, r.error) for r in ops.extract_locations(features, records).collect()}
    assert got == {
        0: ("ACttttg", None), 1: ("ttttggcc", None), 2: ("ggc", None), 3: (None, "external"), 4: (None, "out_of_bounds"), 5: (None, "ambiguous"), 6: (None, "ambiguous"),
        7: (None, "ambiguous"), 8: ("TNGT", None),
    }
    fasta = {r.feature_id: r for r in ops.cds_fasta(records, features).collect()}
    assert fasta[0].header == "main_L_g0" and fasta[0].residues == "ACttttg"


def test_overlap_join_equals_nested_loop(spark):
    r = random.Random(2)

    def some(n):
        return [(r.randrange(3), i, a, a + r.randrange(0, 60)) for i in range(n) for a in [r.randrange(-50, 300)]]

    a, b = some(200), some(200)
    left = spark.createDataFrame(a, "k int, i int, s long, e long")
    right = spark.createDataFrame(b, "k int, j int, fs long, fe long")
    got = sorted((x.i, x.j) for x in overlap_join(left, right, "k", ("s", "e"), ("fs", "fe"), 16).collect())
    assert got == sorted((i, j) for k, i, s, e in a for q, j, fs, fe in b if k == q and s < fe and fs < e and s < e and fs < fe)
    regions = left.selectExpr("k AS record_id", "i AS region_id", "s AS start", "e AS end").where("s >= 0")
    spans = right.selectExpr("k AS record_id", "j AS feature_id", "fs AS f_start", "fe AS f_end", "concat(fs + 1, '..', fe) AS location_gb").where("fs >= 0 AND fe > fs + 1")
    cut = ops.extract_regions(spans, regions, 16)
    for x in cut.join(regions, ["record_id", "region_id"]).join(spans.drop("location_gb"), ["record_id", "feature_id"]).collect():
        assert x.location_gb == loc.format_location(loc.truncate(("range", x.f_start - x.start, x.f_end - x.start, False, False), 0, x.end - x.start))


def test_merges(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 2, 3), (1, 9, 10), (2, 0, 1), (2, 0, 1)], "k int, start long, end long")
    assert sorted(tuple(r) for r in merge_spans(spans, ["k"]).collect()) == [(1, 0, 8, 3), (1, 9, 10, 1), (2, 0, 1, 2)]
    rows = [(1, 0, "range", 0, 4, False, False), (1, 1, "range", 4, 8, False, True), (1, 2, "range", 8, 9, False, False), (1, 3, "between", 9, 10, None, None), (1, 4, "range", 10, 11, True, False)]
    segments = spark.createDataFrame(rows, "k int, i int, kind string, start long, end long, before boolean, after boolean")
    assert [(r.start, r.end) for r in merge_adjacent_segments(segments, ["k"], "i").orderBy("seg_idx").collect()] == [(0, 8), (8, 9), (9, 10), (10, 11)]


def test_statistics(spark):
    counts = spark.createDataFrame([("a", 90), ("b", 5), ("c", 4), ("d", 1)], "key string, n long")
    assert [r.key for r in stats.percentile_cut(counts, "key", 0.95).orderBy("running").collect()] == ["a", "b", "c"]
    assert [r.key for r in stats.percentile_cut(counts, "key", 0.5).collect()] == ["a"]
    assert stats.percentile_cut(counts.limit(0), "key").count() == 0
    quals = "qualifiers array<struct<key:string,value:string>>"
    f = spark.createDataFrame([("x", [("k", None), ("k", "1")]), ("x", None), ("y", [])], f"kind string, {quals}")
    assert {tuple(r) for r in stats.key_frequency(f).collect()} == {("k", 2)}
    assert {tuple(r) for r in stats.kind_frequency(f).collect()} == {("x", 2), ("y", 1)}


def test_queries_over_every_location(spark, tmp_path):
    r = random.Random(5)
    rows = [(1, "circular", None, 1200), (2, "linear", 2300, 2300), (3, "circular", 900, 0), (4, "linear", None, None), (5, "circular", None, None), (6, "linear", 50, 600)]
    records = {i: (top, declared, n and "".join(r.choice("acgt") for _ in range(n)) or (None if n is None else "")) for i, top, declared, n in rows}
    texts = ["join(1..10,1100..1200)", "join(1150..1200,1..30)", "complement(join(50..60,400..510))", "order(<5..120,300..>700)", "one-of(20,150..160)", "bond(12,450)", "120^121", "1200^1", "join(complement(500..520),complement(90..110))",
             "X1:5..9", "join(1..5,X1:7..9,200..210)", "gap(10)", "join(3..9,gap(5),480..499)", "7..300", "complement(<40..90)", "1..2000", None, "nothing("]
    features = [(100 * i + k, i, t) for i in records for k, t in enumerate(texts)] + [(100, 1, texts[0])]
    spark.createDataFrame([(i, x[2], x[0], x[1]) for i, x in records.items()], "record_id long, residues string, topology string, locus_len long").write.parquet(f"{tmp_path}/records.parquet")
    spark.createDataFrame(features, "feature_id long, record_id long, location_gb string").write.parquet(f"{tmp_path}/features.parquet")

    def tried(fn, *args):
        try:
            out = fn(*args)
            return loc.format_location(out) if isinstance(out, tuple) else out
        except loc.LocationError:
            return None

    def got(name):
        return sorted(map(repr, (tuple(x) for x in plans.QUERIES[name](spark, str(tmp_path)).collect())))

    cut, moved, turned, letters = [], [], [], []
    for f, i, t in features:
        top, declared, text = records[i]
        n, x = len(text or "") or declared, loc.parse_location(t) if t else None
        part = x and tried(loc.truncate, x, 100, 500)
        cut += [(f, part)] if part else []
        moved.append((f, x and (n or top == "linear") and tried(loc.relocate, x, i % 500 - 250, n or 0, top == "circular") or None))
        turned.append((f, x and n and tried(loc.reverse_complement, x, n) or None))
        letters.append((f, x and text is not None and tried(loc.extract, x, text) or None))
    assert got("truncated_locations_all") == sorted(map(repr, cut))
    assert got("moved_locations_all") == sorted(map(repr, moved))
    assert got("reversed_locations_all") == sorted(map(repr, turned))
    assert sorted(repr((x.feature_id, x.letters or None)) for x in plans.feature_residues_all(spark, str(tmp_path)).collect()) == sorted(map(repr, letters))

    overlap, inside, covered = set(), set(), {}
    for f, i, t in dict.fromkeys(features):
        x = loc.parse_location(t) if t else None
        for accession, kind, a, b, _ in loc.leaves(x) if x else ():
            if accession is None and kind in ("range", "between"):
                pieces = [(a, b)] if kind == "range" else [(a, b + 1)] if b == a + 1 else [(a, a + 1), (b, b + 1)]
                for s, e in pieces:
                    covered.setdefault(i, set()).update(range(s, e))
                    for at in range(0, len(records[i][2] or ""), 1000):
                        if s < at + 1000 and at < e:
                            overlap.add((i, at, f, s, e))
                            inside.add((i, at, f, loc.format_location(loc.truncate(loc.relocate(x, -at, 0, False), 0, 1000))))
    assert got("region_overlap_all") == sorted(map(repr, overlap))
    assert got("region_features_all") == sorted(map(repr, inside))
    merged = {(x.record_id, x.start, x.end) for x in plans.merged_spans_all(spark, str(tmp_path)).collect()}
    assert {i: {q for j, a, b in merged if j == i for q in range(a, b)} for i in covered} == covered and len({(i, a) for i, a, _ in merged}) == len(merged)


def test_record_queries_take_every_record(spark, tmp_path):
    text = "".join(random.Random(3).choice("acgt") for _ in range(300))
    rows = [(1, "circular", 300, text), (2, "circular", None, text), (3, "linear", 300, text), (4, "circular", 250, text), (5, "circular", None, ""), (6, "linear", 900, None), (7, None, None, None), (8, "linear", None, text[:120])]
    records = [(i, f"n{i}", top, n, x, f"A{i}", f"A{i}.1", "d", "SYN", "DNA", (2000, 1, 1)) for i, top, n, x in rows]
    types = "record_id long, name string, topology string, locus_len long, residues string, accession string, version string, definition string, division string, molecule_type string, date struct<year:int,month:int,day:int>"
    spark.createDataFrame(records, types).write.parquet(f"{tmp_path}/records.parquet")
    features = [(i, i, 0, "CDS", "61..90", [("gene", "x")]) for i, *_ in rows]
    spark.createDataFrame(features, "feature_id long, record_id long, feature_idx int, kind string, location_gb string, qualifiers array<struct<key:string,value:string>>").write.parquet(f"{tmp_path}/features.parquet")

    def run(name):
        return {x.record_id: x for x in plans.QUERIES[name](spark, str(tmp_path)).collect()}

    def digest(x):
        return None if x is None else hashlib.md5(x.encode()).hexdigest()

    turned = run("reversed_records")
    assert {i: x.digest for i, x in turned.items()} == {i: digest(x and loc.revcomp_text(x)) for i, _, _, x in rows}
    assert {i: x.n_features for i, x in turned.items()} == {i: 0 if i == 4 else 1 for i, *_ in rows}
    rotated = run("rotated_records")
    assert {i: x.digest for i, x in rotated.items()} == {i: digest(x[i:] + x[:i] if i in (1, 2) else x) for i, _, _, x in rows}
    regions = run("record_regions")
    assert {i: x.residues for i, x in regions.items()} == {i: x[50:150] if i in (1, 2, 3) else None for i, _, _, x in rows}
    assert all(regions[i]._error for i in (4, 5, 7, 8)) and not any(regions[i]._error for i in (1, 2, 3))
    read = run("written_and_read_all")
    assert {i: (x.residues or "", x.n_features, x.error) for i, x in read.items()} == {i: (x or "", 1, None) for i, _, _, x in rows}
