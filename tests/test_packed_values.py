import pytest

from seqloom.operators.packed_values import explode_values, split_authors, split_keywords

KEYWORDS = [
    ("one; two.", ["one", "two"]),
    (".", []), (" . ", []), ("", []), ("  \n ", []), (None, None),
    ("2,4-dienoyl reductase;iron/sulfur cluster", ["2,4-dienoyl reductase", "iron/sulfur cluster"]),
    ("HTGS_PHASE1,3,4-dioxygenase,EST", ["HTGS_PHASE1", "3,4-dioxygenase", "EST"]),
    ("pilus, phage tail / heat shock|quorum sensing\tcap", ["pilus", "phage tail", "heat shock", "quorum sensing", "cap"]),
    ('salt tolerance, "so-called ""relay"" protein", bile', ["salt tolerance", 'so-called "relay" protein', "bile"]),
    ('"kinase, calcium-dependent" | "channel | gated";"".', ["kinase, calcium-dependent", "channel | gated"]),
    ('"lipid A", "bile export".', ["lipid A", "bile export"]),
    ("a;; ,b;\n c   d", ["a", "b", "c d"]),
    ("5'UTR; bud and root growth", ["5'UTR", "bud and root growth"]),
    ('open "quote; rest', ['open "quote', "rest"]),
    ('so-called "a; b" thing; next', ['so-called "a; b" thing', "next"]),
    ("odd \x01 0\x02 marks\x03e; b", ["odd \x01 0\x02 marks\x03e", "b"]),
]
AUTHORS = [
    ("Sikenikin,Q.F., Puhuzulel,C.K., and Puzowilel,E.J.", ["Sikenikin,Q.F.", "Puhuzulel,C.K.", "Puzowilel,E.J."]),
    ("Fawocaton,M.M. Jr. and von Nitofelek,Y.", ["Fawocaton,M.M. Jr.", "von Nitofelek,Y."]),
    ("Nazeneman, Z., Pozzamoler, W.B. and Bitu, V.", ["Nazeneman, Z.", "Pozzamoler, W.B.", "Bitu, V."]),
    ("Elizabeth Fodonuter, Katherine G. Cocasover and Yuki F. Faxeheton", ["Elizabeth Fodonuter", "Katherine G. Cocasover", "Yuki F. Faxeheton"]),
    ("Lebivemum, Oscar M.; Watitogan, Alex Jr.; Zajubibon, Susan", ["Lebivemum, Oscar M.", "Watitogan, Alex Jr.", "Zajubibon, Susan"]),
    ("Lebivemum, Oscar M.", ["Lebivemum, Oscar M."]),
    ("F. Zawomabon, N. Piwekilin, & U.G. HONIPIRER", ["F. Zawomabon", "N. Piwekilin", "U.G. HONIPIRER"]),
    ("Jitimunek O, Jakivoran JF", ["Jitimunek O", "Jakivoran JF"]),
    (" Gadaputan U | Purululel VD ", ["Gadaputan U", "Purululel VD"]),
    ('"Vobaloger, W.S.", "von Nirofelek, Y."', ["Vobaloger, W.S.", "von Nirofelek, Y."]),
    ("Dulufutor,W., and Hekiheris,F., et al.", ["Dulufutor,W.", "Hekiheris,F."]),
    ("Curetovel,V. and Zawomabon,F.; Vobaloger,W. / Abc,D.", ["Curetovel,V.", "Zawomabon,F.", "Vobaloger,W.", "Abc,D."]),
    ("Vobaloger, W.; ; Wopebadus,\nF.H. ;", ["Vobaloger, W.", "Wopebadus, F.H."]),
    (None, None), ("", []), (" ; ", []),
]


@pytest.mark.parametrize("split, cases", [(split_keywords, KEYWORDS), (split_authors, AUTHORS)])
def test_split(spark, split, cases):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", split(df.t).alias("v")).collect()}
    assert got == {i: v for i, (_, v) in enumerate(cases)}


def test_rows(spark):
    long = "; ".join(f'"value {i}, part ""x"""' for i in range(20000))
    rows = [(1, "a; b", "x"), (1, "a; b", "x"), (2, None, "y"), (3, "", "z"), (4, long, None), (None, "c", "w")]
    df = spark.createDataFrame(rows, "ref_id long, authors string, item string").withColumnRenamed("authors", "keywords")
    out = explode_values(df, "ref_id", "keywords", "keywords")
    assert out.columns == ["field", "row_id", "pos", "item"]
    assert out.dtypes == [("field", "string"), ("row_id", "bigint"), ("pos", "int"), ("item", "string")]
    assert sorted(out.where("row_id < 4").select("row_id", "pos", "item").collect()) == [(1, 1, "a"), (1, 2, "b")]
    assert out.where("row_id IS NULL").count() == 1
    assert out.where("row_id = 4").count() == 20000
    assert out.where("row_id = 4 AND pos = 20000").first().item == 'value 19999, part "x"'
    assert explode_values(df.limit(0), "ref_id", "keywords", "keywords").count() == 0


def test_names_of_any_length_are_paired(spark):
    """Far beyond any limit there was: long surnames and thousands of given names keep their place in a list of pairs."""
    long, many = "X" + "y" * 5000, " ".join(["Anna", "B."] * 4000)
    text = f"{long}, Maria, Abcde, {many}, von der {long}, Jean-Paul A-b"
    rows = explode_values(spark.createDataFrame([(1, text)], "ref_id long, authors string"), "ref_id", "authors", "authors").orderBy("pos").collect()
    assert [r.item for r in rows] == [f"{long}, Maria", f"Abcde, {many}", f"von der {long}, Jean-Paul A-b"]
