import csv
import io
import random

from seqloom.operators.invalid_rows import failures, parse_lines, separate

GOOD = [
    "n1,4,linear,BCT,clone,1..4,acgt",
    'n2,"4",circular,,"the ""long"" form, complete","join(1..2,complement(4))","1 ac gt\n"\r',
    'n3,0007,linear,,"two\nlines",AB1.1:3..9,acgtacg',
    "n4,99,linear,,,gap(),",
    'n5,4,linear,,"""",3^4,ACGT',
]
BAD = [
    ('n1,4,linear,BCT,"clone,1..4,acgt', "quoting"), ('n1,4,linear,BCT,clo"ne,1..4,acgt', "quoting"), ('n1,4,linear,BCT, "clone",1..4,acgt', "quoting"),
    ('n1,4,linear,BCT,"cl"one",1..4,acgt', "quoting"), ('"x', "quoting"), ("n1,4,linear,BCT,1..4,acgt", "column_count"), (None, "column_count"),
    ("", "column_count"), ("\r", "column_count"), ("a,b,c,d,e,f,g,h", "column_count"), (",4,linear,,,1..4,acgt", "name"), ("n 1,4,linear,,,1..4,acgt", "name"),
    ("n:1,4,linear,,,1..4,acgt", "name"), ("n 1,4,linear,,,1..4,acgt", "name"), ("n1,4,linear,,,,acgt", "location"), ("n1,4,linear,,,1..,acgt", "location"),
    ('n1,4,linear,,,"join(1..2,3",acgt', "location"), ("n1,4,linear,,,AB1,acgt", "location"), ('n1,4,linear,,,"1..2\n",acgt', "location"), ("n1,4,linear,,,1..4,ac-t", "residues"),
    ("n1,4,linear,,,1..4,acgé", "residues"), ("n1,4,linear,,,1..4,ac\tt", "residues"), ("n1,5,linear,,,1..4,acgt", "length"), ("n1,,linear,,,1..4,acgt", "length"),
    ("n1,+4,linear,,,1..4,acgt", "length"), ("n1,4.0,linear,,,1..4,acgt", "length"), ("n1,x,linear,,,1..4,", "length"), ("n:1,x,linear,,,bad,a-", "name"),
]


def test_reasons(spark):
    rows = [(i, t, "own") for i, t in enumerate([*GOOD, *(t for t, _ in BAD)])]
    df = spark.createDataFrame(rows, "raw_id long, raw_line string, reason string")
    bad = {r.row_id: r for r in failures(parse_lines(df)).collect()}
    assert {i: r.reason for i, r in bad.items()} == {len(GOOD) + i: reason for i, (_, reason) in enumerate(BAD)}
    assert list(bad[len(GOOD) + len(BAD) - 1].reasons) == ["name", "location", "residues", "length"]
    good, _ = separate(df)
    loaded = {r.row_id: r for r in good.collect()}
    assert set(loaded) == set(range(len(GOOD)))
    assert loaded[1].definition == 'the "long" form, complete' and loaded[1].residues == "acgt" and loaded[1].locus_len == 4
    assert loaded[4].definition == '"'
    assert failures(parse_lines(df.limit(0))).count() == 0


def test_cells_as_csv_reads_them(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        cells = ["".join(r.choice('ab",\n \x01\x02\x030') for _ in range(r.randrange(6))) for _ in range(7)]
        out = io.StringIO()
        csv.writer(out, lineterminator="", quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerow(cells)
        rows.append((i, out.getvalue(), cells))
    df = spark.createDataFrame([x[:2] for x in rows], "raw_id long, raw_line string")
    got = {x.row_id: x for x in parse_lines(df).collect()}
    for i, line, cells in rows:
        assert got[i].quotes_ok and list(got[i].cells) == cells, line


def test_long_values(spark):
    quotes = '"' + '""' * 20_000 + '"'
    nested = '"' + "join(" * 3000 + "1" + ",2)" * 3000 + '"'
    many = '"join(' + ",".join(f"{i}..{i + 1}" for i in range(20_000)) + ')"'
    lines = [f"a,4,l,d,{quotes},1..4,acgt", f"b,4,l,d,x,{nested},acgt", f"c,1000000,l,d,x,{many}," + "acgt" * 250_000, ",".join("x" * 100_000)]
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id long, raw_line string")
    assert {r.row_id: r.reason for r in failures(parse_lines(df)).collect()} == {3: "column_count"}
