import math
import random

from pyspark.sql import functions as F

from sievewright.llm import top_in_group as top
from sievewright.session import new_path

SCHEMA = "g string, item string, v double, val double, grp string, place int"


def brute(rows, tie, n):
    best = {}
    for i, t in tie:
        if t is not None:
            best[i] = min(t, best.get(i, t))
    out = set()
    for g in {r[0] for r in rows if r[0] is not None}:
        own = sorted({(-v, best.get(i, math.inf), i) for h, i, v in rows if h == g and i is not None and v is not None and not math.isnan(v)})
        out |= {(g, i, k + 1) for k, (_, _, i) in enumerate(own[:n])}
    return out


def run(spark, rows, tie, n, **options):
    df = spark.createDataFrame([(*r, 1.0, "clash", 3) for r in rows], SCHEMA)
    ties = spark.createDataFrame(tie, "item string, tie int") if tie is not None else None
    return {(r["g"], r["item"], r["place"]) for r in top.top_in_group(df, "g", "item", "v", n, ties, **options).collect()}


def test_ties_nulls_and_order(spark):
    rows = [("a", "x", 1.0), ("a", "y", 1.0), ("a", "z", 1.0), ("a", "w", 0.5), ("b", "x", math.nan), ("b", "q", None), (None, "x", 1.0), ("c", None, 1.0), ("d", "long" * 20_000, 1.0)]
    tie = [("z", 5), ("z", 2), ("y", 3), ("x", None)]
    want = {("a", "z", 1), ("a", "y", 2), ("d", "long" * 20_000, 1)}
    assert run(spark, rows, tie, 2) == want == brute(rows, tie, 2)
    assert run(spark, rows, None, 2) == {("a", "x", 1), ("a", "y", 2), ("d", "long" * 20_000, 1)}
    assert run(spark, [], tie, 2) == set()


def test_hot_groups_and_skipping(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"g{rng.randrange(300)}" if n % 3 else "hot", f"i{n:06}", rng.randrange(400) / 400) for n in range(20_000)]
    tie = [(f"i{rng.randrange(20_000):06}", rng.randrange(50)) for _ in range(9_000)]
    assert run(spark, rows, tie, 10, row_group_bytes=2_000) == brute(rows, tie, 10)
    df = spark.createDataFrame(rows, "g string, item string, v double")
    path = top.cluster_by_group(df, "g", "item", "v", row_group_bytes=2_000, hot_least=500)
    all_rows = top.skipped_read(spark, path, 10, df.schema["item"].dataType, value_bounds=False).where("grp = 'hot'")
    kept = top.skipped_read(spark, path, 10, df.schema["item"].dataType).where("grp = 'hot'")
    assert spark.read.parquet(path).select(F.input_file_name().alias("f"), "grp").where("grp = 'hot'").select("f").distinct().count() > 1
    assert kept.count() <= all_rows.count() < 6_000
    assert kept.agg(F.max("val")).first()[0] == max(v for g, _, v in rows if g == "hot")


def test_all_values_tied(spark):
    rows = [("g", f"i{n:04}", 0.5) for n in range(2_000)]
    tie = [("i1999", 1), ("i0500", 2)]
    assert run(spark, rows, tie, 3, row_group_bytes=1_000) == {("g", "i1999", 1), ("g", "i0500", 2), ("g", "i0000", 3)}


def test_empty_folder(spark):
    path = new_path(spark)
    spark.createDataFrame([], "grp string, item string, val double").write.parquet(path)
    assert top.skipped_read(spark, path, 3, spark.createDataFrame([], "item string").schema["item"].dataType).count() == 0
