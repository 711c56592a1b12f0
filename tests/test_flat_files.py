import gzip
import json

import pytest
from pyspark.sql import functions as F

from seqloom.schema import RECORD
from seqloom.sources.genbank import GenbankSource, read_genbank, record_to_text, stream_genbank, to_genbank, with_record_index, write_fasta, write_genbank
from seqloom.sources.record_text import read_record, read_text, repair_latin1
from seqloom.sources.record_writer import wrap_location, wrap_text

PREAMBLE = "RELEASE NOTES\nof a small collection\n\n"
ONE = """LOCUS       AB000001                  24 bp    DNA     circular BCT 01-AUG-2014
DEFINITION  A small circle, made
            for tests.
ACCESSION   AB000001
VERSION     AB000001.1
KEYWORDS    one; two.
SOURCE      Testus primus (first)
  ORGANISM  Testus primus
REFERENCE   1  (bases 1 to 24)
  AUTHORS   Maker,A. and Taker,B.
  CONSRTM   Makers
  TITLE     How to make
            a circle
  JOURNAL   J. Circles 1, 2-3
   PUBMED   12345
  REMARK    none
COMMENT     First comment.
COMMENT     Second
            comment.
FEATURES             Location/Qualifiers
     source          1..24
                     /organism="Testus primus"
                     /note="a ""quoted"" word
                     /and a slash"
     CDS             join(20..24,
                     1..4)
                     /codon_start=1
                     /pseudo
                     /gene=""
                     /note=
                     /product="say ""
                     hello"
                     /translation="MKV
                     LLA"
                     /product="second"
BASE COUNT        6 a      6 c      6 g      6 t
ORIGIN      from somewhere
        1 acgtacgtac gtacgtacgt
       21 acgt
//
"""
TWO = """LOCUS       TRAD01          8 bp    mRNA            PLN       02-FEB-1999
DEFINITION  No topology.
ODDLINE     passed over
REFERENCE   1
  AUTHORS   No Title
ORIGIN
        1 ACGTNNac
//
"""
THREE = """LOCUS       PROT1                    360 aa            linear   01-JAN-2000
ACCESSION   \n\
FEATURES             Location/Qualifiers
     Bond            bond(12,
                     63)
ORIGIN
        1 mkvlla
//
"""
CONTIG = """LOCUS       CON1                   5000 bp    DNA     linear   CON 05-MAY-2005
CONTIG      join(AB1.1:1..20,gap(10
            0),complement(AB2.1:5..9),gap(unk100))
//
"""
BAD = "LOCUS       BAD1                      4 bp    DNA     linear   UNK 05-MAY-2005\nORIGIN\n        1 ac-t\n//\n"
SHORT = "LOCUS       BAD2                      9 bp    DNA     linear   UNK 05-MAY-2005\nORIGIN\n        1 acgt\n//\n"
ALL = PREAMBLE + ONE + TWO + THREE + CONTIG + BAD + SHORT + TWO


def test_full_record():
    r = read_record(ONE[: ONE.index("//\n")])
    assert r["_error"] is None
    assert (r["name"], r["locus_len"], r["molecule_type"], r["topology"], r["division"]) == ("AB000001", 24, "DNA", "circular", "BCT")
    assert r["date"] == {"year": 2014, "month": 8, "day": 1}
    assert r["definition"] == "A small circle, made\nfor tests."
    assert r["source"] == {"source": "Testus primus (first)", "organism": "Testus primus"}
    assert r["references"][0]["title"] == "How to make\na circle" and r["references"][0]["pubmed"] == "12345"
    assert r["comments"] == ["First comment.", "Second\ncomment."]
    assert r["residues"] == "acgt" * 6
    source, cds = r["features"]
    assert source["qualifiers"][1]["value"] == 'a "quoted" word\n/and a slash'
    assert cds["location_gb"] == "join(20..24,1..4)"
    assert [(q["key"], q["value"]) for q in cds["qualifiers"]] == [
        ("codon_start", "1"), ("pseudo", None), ("gene", ""), ("note", ""), ("product", 'say "\nhello'), ("translation", "MKVLLA"), ("product", "second"),
    ]


def test_other_records():
    rows = read_text(ALL)
    assert [r["name"] for r in rows] == ["AB000001", "TRAD01", None, "CON1", None, None, "TRAD01"]
    assert [bool(r["_error"]) for r in rows] == [False, False, False, False, True, True, False]
    two, three, con, bad, short = rows[1:6]
    assert (two["topology"], two["division"], two["references"], two["residues"]) == ("linear", "PLN", [], "ACGTNNac")
    assert any("ODDLINE" in w for w in two["_warnings"])
    assert (three["locus_len"], three["division"], three["residues"], three["accession"]) == (None, "UNK", "mkvlla", "")
    assert three["features"][0]["location_gb"] == "bond(12,63)"
    assert con["contig"][0]["op"] == "join" and con["contig"][3]["gap_len"] == 100
    assert "'-'" in bad["_error"] and "ac-t" in bad["_corrupt_record"]
    assert short["_error"] == "4 letters where LOCUS declares 9"


@pytest.mark.parametrize(
    "line, name, topology, division",
    [
        ("LOCUS       KQ000771     96 bp    RNA     linear   VRL 17-MAR-2021", "KQ000771", "linear", "VRL"),
        ("LOCUS  KQ000772 1200 bp mRNA circular 30-NOV-2009", "KQ000772", "circular", "UNK"),
        ("LOCUS\tplasmid_7\t88\tbp DNA circular\t\t", "plasmid_7", "circular", "UNK"),
        ("LOCUS       KQ:773   96 bp RNA linear", None, "linear", "UNK"),
        ("LOCUS       KQ000774 96 bp linear SYN 09-SEP-1999", "KQ000774", "linear", "SYN"),
    ],
)
def test_locus_forms(spark, line, name, topology, division):
    from seqloom.functions.native import parse_locus

    r = read_record(line + "\n")
    assert (r["name"], r["topology"], r["division"], r["_error"]) == (name, topology, division, None)
    x = spark.createDataFrame([(line,)], "t string").select(parse_locus("t").alias("x")).first().x
    assert (x.name, x.topology, x.division, x.ok) == (name, topology, division, True)


def test_a_form_that_fits_is_final(spark):
    from seqloom.functions.native import parse_locus

    for line in ("LOCUS       KQ000771 96 bp RNA linear VRL 17-MAR-2021 and more", "LOCUS       KQ000771 96 bp RNA linear VRL 99-MAR-2021"):
        assert read_record(line + "\n")["_error"]
        assert spark.createDataFrame([(line,)], "t string").select(parse_locus("t").alias("x")).first().x.ok is False
    assert "second DEFINITION" in read_record("LOCUS       KQ000771 4 bp RNA linear\nDEFINITION  a\nDEFINITION  b\n")["_error"]


@pytest.mark.parametrize(
    "text, value",
    [
        ("/ribosomal_slippage", None), ("/number=3b", "3b"), ('/locus_tag="KQ_0007"', "KQ_0007"), ('/note="one line\n                     and one more"', "one line\nand one more"),
        ('/note=""""""', '""'), ('/note="so ""called"" word"', 'so "called" word'), ('/note="never closed', '"never closed'), ('/translation="MK\n                     LV"', "MKLV"),
    ],
)
def test_qualifier_forms(text, value):
    r = read_record("LOCUS       KQ000771 96 bp RNA linear\nFEATURES             Location/Qualifiers\n     exon            7..55\n                     " + text + "\n")
    key = text[1:].split("=")[0].split("\n")[0]
    assert r["features"][0]["qualifiers"] == [{"key": key, "value": value}]


def test_every_prefix_gives_rows_not_exceptions():
    whole = ONE + CONTIG
    for n in range(len(whole)):
        for r in read_text(whole[:n]):
            assert r["_error"] is None or r["_corrupt_record"]


def test_missing_end_marker():
    body = TWO[: TWO.index("//")]
    assert read_text(body)[0]["_error"] is None
    assert read_text(body.replace("        1 ACGTNNac", "        1 ACGTN"))[0]["_error"] == "the file ends within the sequence"


def test_write_then_read_is_the_same():
    for r in read_text(ONE + CONTIG + TWO):
        again = read_text(record_to_text(r))[0]
        assert {k: v for k, v in again.items() if k[0] != "_"} == {k: v for k, v in r.items() if k[0] != "_"}
    assert record_to_text(read_text(ONE)[0]).splitlines()[0] == ONE.splitlines()[0]


def test_locus_names_may_be_cut():
    """Name and length have 28 columns; a longer name is cut only on demand, a shorter one is never."""
    for n in (3, 26, 27, 28, 60):
        name = "KQ" + "x" * (n - 2)
        kept, cut = (record_to_text({"name": name, "locus_len": 7}, truncate_locus=c).split("\n")[0] for c in (False, True))
        assert kept.split()[1:4] == [name, "7", "bp"] and cut.split()[1:4] == [name[:26], "7", "bp"]
        assert len(cut) == len("LOCUS       ") + 28 + len(" bp            linear UNK 01-JAN-1970")
    assert record_to_text({"name": " two  words "}).startswith("LOCUS       two_words ")


def test_wrapping():
    long = "word " * 40 + 'and a "quote"'
    lines = list(wrap_text(long, " " * 21 + "/note=", " " * 21, True))
    assert all(len(x) <= 79 for x in lines)
    text = "LOCUS       U0 4 bp DNA linear\nFEATURES             Location/Qualifiers\n     gene            1..4\n" + "\n".join(lines) + "\n"
    assert read_record(text)["features"][0]["qualifiers"][0]["value"].replace("\n", " ") == long
    parts = list(wrap_location("join(" + ",".join(f"{i}..{i + 5}" for i in range(1, 300, 10)) + ")", "     CDS             ", " " * 21))
    assert all(len(x) <= 79 for x in parts) and all(x.endswith((",", ")")) for x in parts)
    assert list(wrap_location("", "x", " ")) == []
    full = list(wrap_text("é" * 200, " " * 12, " " * 12, False))
    assert "".join(x[12:] for x in full) == "é" * 200 and all(len(x.encode()) <= 80 for x in full)


def test_latin1():
    for text in ("plain", "Grüße aus Århus", "naïve façade", ""):
        assert repair_latin1(text.encode()) == text
        assert repair_latin1(text.encode("latin-1")) == text


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("gb")
    (d / "a.gb").write_text(ALL)
    (d / "crlf.gb").write_bytes(TWO.replace("\n", "\r\n").encode() * 2)
    (d / "noend.gb").write_text(TWO[: TWO.index("//")])
    with gzip.open(d / "latin.gb.gz", "wb") as f:
        f.write(ONE.replace("First comment.", "Zö").encode("latin-1"))
    return d


def test_read_folder(spark, folder):
    df = with_record_index(read_genbank(spark, str(folder))).orderBy("_source_file", "_record_idx")
    rows = df.collect()
    assert [(r._source_file, r._record_idx) for r in rows] == [("a.gb", i) for i in range(7)] + [("crlf.gb", 0), ("crlf.gb", 1), ("latin.gb.gz", 0), ("noend.gb", 0)]
    assert sum(r._error is not None for r in rows) == 2
    assert rows[9].comments[0] == "Zö"
    assert rows[7].residues == rows[10].residues == "ACGTNNac"
    assert read_genbank(spark, str(folder), mode="DROPMALFORMED").count() == 9
    assert read_genbank(spark, str(folder), columns=["name"]).columns == ["_source_file", "_block_start", "_block_idx", "name", "_warnings", "_error", "_corrupt_record"]
    with pytest.raises(Exception, match="no residue"):
        read_genbank(spark, str(folder), mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        read_genbank(spark, str(folder), mode="SOMETIMES")


def test_write_and_read_back(spark, folder, tmp_path):
    good = read_genbank(spark, str(folder / "a.gb"), mode="DROPMALFORMED").where("locus_len IS NOT NULL")
    for r in good.select(*[F.col(f.name) for f in RECORD.fields], to_genbank(good).alias("text")).collect():
        assert r["text"] == record_to_text(r.asDict(recursive=True))
    write_genbank(good, str(tmp_path / "out"), compression="gzip")
    back = read_genbank(spark, str(tmp_path / "out"))
    columns = ["name", "residues", F.to_json(F.struct("features", "references", "contig", "date")).alias("rest")]
    assert sorted(map(tuple, back.select(*columns).collect())) == sorted(map(tuple, good.select(*columns).collect()))


def test_data_source(spark, folder, tmp_path):
    spark.dataSource.register(GenbankSource)
    df = spark.read.format("genbank").load(str(folder))
    assert df.where("_error IS NULL").count() == 9
    df.where("accession = 'AB000001'").write.format("genbank").mode("append").save(str(tmp_path / "out"))

    def kept():
        return spark.read.format("genbank").load(str(tmp_path / "out")).select("name", "accession", "residues").collect()

    assert {(r.accession, r.residues) for r in kept()} == {("AB000001", "acgt" * 6)}
    n = len(kept())
    df.where("name = 'CON1'").write.format("genbank").mode("append").save(str(tmp_path / "out"))
    assert len(kept()) == n + 1
    df.where("name = 'CON1'").write.format("genbank").mode("overwrite").save(str(tmp_path / "out"))
    assert [r.name for r in kept()] == ["CON1"] and not list((tmp_path / "out").glob("_*"))


def test_stream(spark, folder, tmp_path):
    from seqloom.streaming.feature_stream import division_totals, record_stream, run_available

    out = run_available(division_totals(record_stream(spark, str(folder), max_files=1)), "totals", str(tmp_path / "cp"))
    assert {r.division: (r.n_records, r.n_errors) for r in out.collect()} == {"BCT": (2, 0), "PLN": (5, 0), "UNK": (3, 2), "CON": (1, 0)}
    assert stream_genbank(spark, str(folder), columns=["name"]).isStreaming


def test_sql_functions(spark):
    from seqloom.functions.location_udf import register

    register(spark)
    spark.createDataFrame([(ONE + TWO,)], "t string").createOrReplaceTempView("texts")
    assert [r.name for r in spark.sql("SELECT g.name FROM texts, LATERAL gb_parse(t) g ORDER BY 1").collect()] == ["AB000001", "TRAD01"]
    r = spark.sql("SELECT revcomp('RyKaaTn') a, gb_simplify('join(11..14,15..19)') b, gb_truncate('11..19', 12, 15) c, gb_wrap('27..33', 30) d, gb_find_bounds('gap(8)').error e, gb_relocate('17', -40L, 30L, true) f").first()
    assert tuple(r) == ("nAttMrY", "11..19", "13..15", "join(27..30,1..3)", "ambiguous", "7")


def test_json_keeps_records(spark, folder):
    df = read_genbank(spark, str(folder / "a.gb"))
    back = df.select(F.from_json(F.to_json(F.struct("features", "date")), df.select("features", "date").schema).alias("x"), "features", "date")
    assert back.where("x.features <=> features AND x.date <=> date").count() == df.count()
    assert json.loads(df.select(F.to_json("date")).first()[0])["year"] == 2014


def test_fasta_sink(spark, tmp_path):
    write_fasta(spark.createDataFrame([("a", "acgt" * 20), (None, "x"), ("b", None)], "header string, residues string"), str(tmp_path / "fa"))
    assert spark.read.text(str(tmp_path / "fa")).count() == 3
