from pyspark.sql import functions as F

from seqloom.operators.skew import estimate_load, fragment, fragment_replicate_join, organism_totals, pack


def test_packing_is_even_and_bounded():
    plan = pack(8, [("hot", 4000), ("warm", 900)], [30] * 128, 8740)
    loads = [0.0] * 8
    for key, tasks in plan.heavy:
        n = {"hot": 4000, "warm": 900}[key]
        assert len(set(tasks)) == len(tasks)
        for t in tasks:
            loads[t] += n / len(tasks)
    for t in plan.buckets:
        loads[t] += 30
    assert max(loads) <= 1.25 * 8740 / 8


def test_join_equals_plain_join(spark):
    rows = [("hot", i) for i in range(6000)] + [(f"k{i % 300}", i) for i in range(3000)] + [(None, i) for i in range(50)]
    left = spark.createDataFrame(rows, "key string, id long")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4), (None, 5)], "key string, v int")
    for how in ("inner", "left"):
        got = fragment_replicate_join(left, right, "key", ["id"], how).select("key", "id", "v")
        want = left.where("key IS NOT NULL").join(right, "key", how).select("key", "id", "v")
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    plan = estimate_load(left, "key", 4)
    sizes = [r.n for r in fragment(left, "key", plan, ["id"]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 1.3 * 9000 / 4


def test_totals(spark):
    features = spark.createDataFrame([("A  b", 1), (" a B", 1), ("a b\t", 2), (None, 3), ("", 4), ("c", 5)], "organism string, feature_id long")
    source = "source struct<source:string,organism:string>"
    records = spark.createDataFrame([(1, ("x", "a b"), "acgt"), (2, ("x", "A B"), None), (3, None, "ac"), (4, ("x", "d"), "a")], f"record_id long, {source}, residues string")
    organisms = spark.createDataFrame([("a b", 7)], "organism string, taxon_id long")
    got = {r.organism: tuple(r)[1:] for r in organism_totals(features, records, organisms).collect()}
    assert got == {"a b": (7, 2, 3, 2, 4), "c": (None, 0, 1, 1, 0), "d": (None, 1, 0, 0, 1)}
    assert organism_totals(features.limit(0), records.limit(0), organisms).count() == 0
