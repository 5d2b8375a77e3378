import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import keep_together as kt

SCHEMA = "record_id string, g string, h string, split string, score double, root string, _anchor string, u string"


def run(spark, rows, shares=None):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    return kt.keep_together(df, "record_id", {"g": F.col("g"), "h": F.col("h")}, F.nullif(F.lower(F.trim("split")), F.lit("")), F.col("score"), shares).collect()


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, g, h, _, _ in rows:
        if i is None:
            continue
        for key in (("g", g), ("h", h)):
            if key[1] and key[1].strip():
                parent[find(("r", i))] = find(key)
        find(("r", i))
    sets = defaultdict(set)
    splits = defaultdict(set)
    for i, _, _, s, _ in rows:
        if i is not None:
            sets[find(("r", i))].add(i)
            if s and s.strip():
                splits[find(("r", i))].add(s.strip().lower())
    return {(i, min(v), len(splits[k]) > 1) for k, v in sets.items() for i in v}


def test_sets_against_union_find(spark):
    rng = random.Random(7)
    rows = [(f"r{n:04}", rng.choice([None, "", " ", *[f"g{k}" for k in range(60)]]), rng.choice([None, "", *[f"h{k}" for k in range(150)]]), rng.choice(["train", " Train", "test", "", None]), rng.random()) for n in range(300)]
    rows += rows[:4]
    got = [(r["record_id"], r["set_key"], r["mixed"]) for r in run(spark, rows)]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_hot_group_empty_and_null_ids(spark):
    rows = [(f"r{n:04}", "big" if n % 3 == 0 else f"s{n}", f"h{n}", "train", None) for n in range(600)] + [(None, "big", None, "test", 0.5)]
    assert {r["set_key"] for r in run(spark, rows) if r["record_id"].endswith("0000")} == {"r0000"}
    assert run(spark, []) == [] and run(spark, [], {"train": 1.0}) == []


@pytest.mark.parametrize("head,block", [(4096, 4096), (20, 50)])
def test_new_splits(spark, monkeypatch, head, block):
    monkeypatch.setattr(kt, "HEAD", head)
    monkeypatch.setattr(kt, "BLOCK", block)
    rng = random.Random(3)
    rows = [(f"r{n:05}", f"g{int(rng.paretovariate(0.7)) % 400}", None, "train", rng.random()) for n in range(3000)]
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    out = run(spark, rows, shares)
    by = defaultdict(set)
    count = defaultdict(int)
    for r in out:
        by[r["set_key"]].add(r["new_split"])
        count[r["new_split"]] += 1
    assert len(out) == 3000 and all(len(v) == 1 for v in by.values())
    largest = max(sum(1 for r in out if r["set_key"] == k) for k in by) / 3000
    for s, share in shares.items():
        assert abs(count[s] / 3000 - share) < (0.02 if largest < share else largest)
    assert [tuple(r) for r in sorted(run(spark, rows, shares))] == [tuple(r) for r in sorted(out)]


def test_annealing_never_ends_worse_than_it_starts():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 30, 50).astype(float)
    start = rng.integers(0, 3, 50)
    want = np.array([0.7, 0.15, 0.15]) * sizes.sum()
    args = (sizes, sizes * 0.5, sizes, start, want, 0.5, 0.5, 3)
    before, _ = kt.anneal(*args, 0)
    after, at = kt.anneal(*args, 3000)
    assert after < before and abs(np.bincount(at, sizes, 3) - want).max() <= sizes.max()
    assert kt.anneal(sizes[:0], sizes[:0], sizes[:0], start[:0], want, 0.5, 0.5, 3, 10)[1].size == 0
