import random
import re
from collections import defaultdict

from sievewright.llm.formatting_duplicates import collapse_formatting, formatting_groups

SCHEMA = "raw_id long, heavy string, light string, antigen_id string, key string, _id string, bucket int, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 7) for r in rows], SCHEMA)


def groups(spark, rows, **options):
    out = formatting_groups(frame(spark, rows), "raw_id", ["heavy", "light"], ["antigen_id"], **options).collect()
    return {(r["first_id"], r["copies"]) for r in out}


def brute(rows):
    plain = lambda t: re.sub(r"[\W_]+", "", (t or "").lower())
    by = defaultdict(list)
    for i, h, lo, a in rows:
        by[(*sorted((plain(h), plain(lo))), plain(a))].append(i)
    return {(min(v), len(v)) for v in by.values()}


def test_spellings(spark):
    rows = [
        (1, "ACD", "EFG", "A-1"), (2, "a c​d", " efg\n", "a 1"), (3, "EFG", "ACD", "(A_1),"), (4, "ACD", None, "A-1"), (5, "ACD", "", "A\xa01"), (6, "acd", " -- ", "A–1"), (7, None, None, None), (8, "", "﻿", "~"), (9, "ACDEFG", "", "A-1"), (10, "ACD", "EFG", "A-11"), (11, "AC" * 50_000, "", "z"), (12, "ac" * 50_000, None, "Z"),
    ]
    assert groups(spark, rows) == {(1, 3), (4, 3), (7, 2), (9, 1), (10, 1), (11, 2)} == brute(rows)


def test_hot_and_cold_agree(spark):
    rng = random.Random(2)
    rows = [(n, "ACDE" if n % 3 == 0 else "".join(rng.choice("ab") for _ in range(5)), rng.choice([None, "", "Q"]), rng.choice(["a", "A ", "b"])) for n in range(3000)]
    assert groups(spark, rows, hot_least=1, hot_share=1) == groups(spark, rows, hot_least=100) == groups(spark, rows) == brute(rows)


def test_empty_and_collapsed(spark):
    assert groups(spark, []) == set()
    rows = [(5, "ACD", "E", "x"), (3, "acd", "e", "X"), (9, "Q", "", "x")]
    out = collapse_formatting(frame(spark, rows), "raw_id", ["heavy", "light"], ["antigen_id"]).collect()
    assert {(r["raw_id"], r["heavy"], r["copies"], r["_copies"]) for r in out} == {(3, "acd", 7, 2), (9, "Q", 7, 1)}
