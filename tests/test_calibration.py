import random

from sievewright.operators.calibration import calibrate, pairwise_offsets


def test_chain_of_sources(spark):
    rng = random.Random(3)
    shift = {"a": 0.0, "b": 3.0, "c": -6.0, "lone": 9.0}
    rows = []
    for e in range(60):
        true = rng.uniform(-2, 4)
        for s in ("a", "b") if e < 30 else ("b", "c") if e < 58 else ("lone",):
            rows.append((f"e{e}", s, true - shift[s] + rng.gauss(0, 0.05) + (8 if rng.random() < 0.05 else 0)))
    rows += [(None, "a", 1.0), ("e1", None, 1.0), ("e1", "a", None)]
    df = spark.createDataFrame(rows, "entity string, source string, x double")
    out = calibrate(df, "entity", "source", "x", spark.createDataFrame([("a", 0.0)], "source string, shift double"))
    got = {(r["source"], None if r["common"] is None else round(r["common"] - r["x"])) for r in out.where("entity is not null and source is not null and x is not null").collect()}
    assert got == {("a", 0), ("b", 3), ("c", -6), ("lone", None)}


def test_no_scale_no_link_and_empty(spark):
    rng = random.Random(4)
    rows = [(f"e{e}", s, rng.uniform(-9, 9)) for e in range(30) for s in "ab"]
    df = spark.createDataFrame(rows, "entity string, source string, x double")
    assert pairwise_offsets(df, "entity", "source", "x").count() == 0
    assert calibrate(df.limit(0), "entity", "source", "x", spark.createDataFrame([], "source string, shift double")).count() == 0
