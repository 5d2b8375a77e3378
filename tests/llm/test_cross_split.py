import random

import pytest
from pyspark.sql import functions as F

from sievewright.llm import cross_split
from sievewright.llm.cross_split import cross_split_pairs, cross_split_report, segment_join

SCHEMA = "record_id string, heavy string, light string, split string, tid string, h string, key string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def clean(text):
    return "".join(c for c in text or "" if c.isalpha()).upper()


def brute(rows, k=3):
    kept = [(i, clean(h), clean(lo), (s or "").strip().lower()) for i, h, lo, s in rows if i and clean(h)]
    out = set()
    for i, h, lo, s in kept:
        for j, g, m, t in kept:
            if s == "train" and t in ("validation", "test") and i != j and distance(h, g) + distance(lo, m) <= k:
                out.add((i, j))
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    return [(r["id_train"], r["id_held"]) for r in cross_split_pairs(df, "record_id", "heavy", "light", "split", **options).collect()]


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        op, p = rng.randrange(3), rng.randrange(len(s) + 1)
        if op == 0:
            s.insert(p, rng.choice("ACDE"))
        elif s and op == 1:
            s.pop(min(p, len(s) - 1))
        elif s:
            s[min(p, len(s) - 1)] = rng.choice("ACDE")
    return "".join(s)


@pytest.mark.parametrize("hot,length", [(48, 24), (1, 24), (0, 40), (2, 6), (48, 3)])
def test_against_brute_force(spark, hot, length):
    rng = random.Random(length * 100 + hot)
    frame = "".join(rng.choice("ACDEFGHIKL") for _ in range(length))
    rows = []
    for n in range(120):
        h = edited(rng, frame, rng.randrange(7))
        lo = edited(rng, frame[: length // 2], rng.randrange(4)) if rng.random() < 0.6 else None
        rows.append((f"r{n}", h, lo, rng.choice(["train", "Train ", "test", "validation", None])))
    rows += rows[:5]
    got = found(spark, rows, hot=hot)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("hot,length", [(48, 24), (1, 24), (0, 40), (2, 6)])
def test_both_routes_agree(spark, hot, length):
    """Postings held by tasks and postings joined by a shuffle give the same pairs."""
    rng = random.Random(length)
    frame = "".join(rng.choice("ACDEFGHIKLäÄ𝒳") for _ in range(length))
    rows = [(f"r{n}", edited(rng, frame, rng.randrange(6)), edited(rng, frame[:9], 2), ["train", "test"][n % 2]) for n in range(90)]
    assert set(found(spark, rows, hot=hot)) == set(found(spark, rows, hot=hot, held=0)) == brute(rows)


def test_report_counts_the_pairs(spark):
    rng = random.Random(9)
    frame = "".join(rng.choice("ACDEFGHIKL") for _ in range(30))
    rows = [(f"r{n}", edited(rng, frame, rng.randrange(4)), None, ["train", "test", "validation"][n % 3], rng.choice(["s", "t", None])) for n in range(80)]
    df = spark.createDataFrame([*rows, *rows[:9]], "record_id string, heavy string, light string, split string, source_group string")
    pairs = cross_split_pairs(df, "record_id", "heavy", "light", "split", keep=("source_group",)).distinct().collect()
    want = {}
    for r in pairs:
        want.setdefault((r["split"], r["source_group"]), []).append(r)
    got = {(r["split"], r["source_group"]): (r["records"], r["pairs"], r["exact_records"]) for r in cross_split_report(df, "record_id", "heavy", "light", "split", ("source_group",)).collect()}
    assert got == {g: (len({r["id_held"] for r in x}), len(x), len({r["id_held"] for r in x if r["distance"] == 0})) for g, x in want.items()}


def test_edges(spark):
    long = "ACDEFGHIKLMNPQRSTVWY" * 500
    rows = [
        ("a\n", "ACDE\n", None, "train"), ("a", "AC-d e", None, "train"), ("b", "acde", "", "TEST "), ("c", "", "ACDE", "train"), ("d", None, "ACDE", "test"), ("e", "ACDE", "", None), ("f", "ACDE", "", " "), (None, "ACDE", "", "test"),
        ("g", long, "AC", "train"), ("h", long[:-2] + "A", "AC", "test"), ("i", long[3:], "", "validation"), ("j", "ACDE", "AAAA", "test"), ("k", "ACDE", "AAA", "test"),
    ]
    assert set(found(spark, rows)) == {("a", "b"), ("a", "k"), ("a\n", "b"), ("a\n", "k"), ("g", "h")} == brute(rows)
    assert found(spark, []) == []


def test_whole_group_alike(spark):
    """A third of the rows share all but their ends: hot keys are refined, nothing is lost."""
    rng = random.Random(1)
    core = "ACDEFGHIKLMNPQRSTVWY" * 4
    rows = [(f"r{n}", core + "".join(rng.choice("ACDE") for _ in range(12)), None, "train" if n % 2 else "test") for n in range(160)]
    assert set(found(spark, rows, hot=4)) == brute(rows)


def test_report_columns_and_distance(spark):
    df = spark.createDataFrame([("a", "ACDEF", "", "train", "s"), ("b", "ACDEG", "", "test", "t")], "record_id string, heavy string, light string, split string, source_group string")
    row = cross_split_pairs(df, "record_id", "heavy", "light", "split", keep=("source_group",)).first()
    assert (row["distance"], row["split"], row["source_group"]) == (1, "test", "t")


def test_segments_emit_few_candidates(spark):
    rng = random.Random(4)
    make = lambda n: spark.createDataFrame([(i, "".join(rng.choice("ACDEFGHIKL") for _ in range(60))) for i in range(n)], "tid long, s string")
    assert segment_join(make(300), make(300).withColumn("tid", F.col("tid") + 1000)).count() == 0
    assert cross_split.letters is not None
