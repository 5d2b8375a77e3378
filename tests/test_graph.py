"""Components by one task and by distributed contraction, and joins by broadcast and by salted shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from sievewright import session
from sievewright.operators.graph import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            parent[max(find(u), find(v))] = min(find(u), find(v))
    return {(x, find(x)) for x in parent}


@pytest.mark.parametrize("task_edges", [0, 1_000])
def test_components(spark, task_edges):
    rng = random.Random(task_edges)
    name = lambda k: f"n{k:03}"
    edges = [(name(rng.randrange(150)), name(rng.randrange(150))) for _ in range(90)] + [(name(200 + k), name(201 + k)) for k in range(40)] + [("x", "x"), (None, "y"), ("z", None)] + [("hub", f"s{k}") for k in range(60)]
    df = spark.createDataFrame([*edges, *edges[:5]], "u string, v string")
    got = [tuple(r) for r in connected_components(df, task_edges=task_edges).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(edges)
    assert connected_components(df.limit(0), task_edges=task_edges).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_is_the_plain_one(spark, how, monkeypatch):
    monkeypatch.setattr(session, "HOT_ROWS", 100)
    rng = random.Random(2)
    facts = spark.createDataFrame([(n, "hot" if n % 2 else rng.choice(["a", "b", None, "gone"])) for n in range(1200)], "n int, k string").withColumn("m", F.create_map(F.lit("x"), "n"))
    dim = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3)], "k string, v int")
    want = sorted((r["n"], r["v"] or 0) for r in session.lookup_join(facts, dim, ["k"], how).collect())
    got = sorted((r["n"], r["v"] or 0) for r in session.lookup_join(facts, dim, ["k"], how, limit=0).collect())
    assert got == want and len(got) == (1200 if how == "left" else len(want))


def test_staged_tables_end_with_their_block(spark):
    with session.staging():
        path = session.stage(spark.range(3))._staged_path
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
