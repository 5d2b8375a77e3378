"""Registries, checked reads, filters, nearest names, balance by size classes, exact draws."""

import random

import pytest
from pyspark.sql import functions as F

from sievewright.functions import values
from sievewright.operators import ensembles, metrics, registry, splits, vectors, weights


def test_checked_reads_raise(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (" ", 4), (None, 5)], "record_id string, x int")
    assert tuple(registry.keyed_problems(df, "record_id").first()) == (5, 2, 1) and tuple(registry.keyed_problems(df.limit(0), "record_id").first()) == (0, 0, 0)
    for bad in (df, df.limit(0), df.where("x > 3")):
        with pytest.raises(ValueError):
            registry.keyed(bad, "record_id")
    assert registry.keyed(df.where("x < 3"), "record_id").count() == 2
    with pytest.raises(ValueError):
        registry.keyed(df, "id")
    with pytest.raises(ValueError):
        registry.pair_table(df)
    pairs = spark.createDataFrame([("a", "b", 1, 0.5, "g", "r")], "left_record_id string, right_record_id string, preference int, pair_weight double, comparison_group string, reason string")
    assert registry.pair_table(pairs).count() == 1
    with pytest.raises(ValueError):
        registry.pair_table(pairs.limit(0))
    with pytest.raises(Exception, match="registry repeats a/b"):
        registry.registry_table(spark.createDataFrame([("a\\b", 1), ("a/b", 1)], "source_file string, direction int")).collect()
    with pytest.raises(Exception, match="unknown key c"):
        registry.strict_lookup(spark.createDataFrame([("c",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int"), ["k"]).collect()
    with pytest.raises(Exception, match="not finite"):
        registry.prediction_score(spark.createDataFrame([(float("nan"),)], "prediction double")).collect()
    assert registry.prediction_score(spark.createDataFrame([(1.0, 2.0)], "prediction double, score double")).collect() == [(1.0, 2.0)]


def test_direction_of_names(spark):
    cases = [("fitness", "heavy | neg_log_kd", 1), ("Kd [M]", "heavy | Kd [M]", -1), ("x", "KD [Bind/No Bind]", 1), ("x", "y", 1), (None, None, 1), ("score", "IC50 | neg log", -1)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "l string, h string").select(registry.named_direction(F.col("l"), F.col("h")).alias("d")).collect()
    assert [r["d"] for r in rows] == [d for _, _, d in cases]


def test_near_names_against_all_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 30))) for _ in range(60)]

    def worn(s):
        t = list(s)
        for _ in range(rng.randrange(0, 4)):
            p = rng.randrange(len(t) + 1)
            t[p : p + rng.randrange(2)] = rng.choice(["", "a", "bc"])
        return "".join(t)

    asked = [worn(rng.choice(base)) for _ in range(80)] + ["", None, "aaaaaaaaaaaaaaaaaaaa"]
    known = base + ["aaaaaaaaaaaaaaaaaaab"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = {}
    for a in {x for x in asked if x}:
        best = min((distance(a, b) / max(len(a), len(b)), b) for b in known)
        if 1 - best[0] >= 0.88:
            want[a] = best[1]
    got = registry.near_names(*[spark.createDataFrame([(x,) for x in xs], "name string") for xs in (asked, known)]).collect()
    assert {r["name"]: r["match"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_balance_by_classes_is_the_plain_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(splits, "DEALT", 37)
    rng = random.Random(seed)
    sizes = {f"k{n:04}": rng.choice([1, 1, 1, 2, 3, 50, 400]) for n in range(700)}
    df = spark.createDataFrame([(k, n) for k, n in sizes.items()], "k string, n int").select("k", F.explode(F.sequence(F.lit(1), "n")))
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    total, load, want = sum(sizes.values()), dict.fromkeys(sorted(shares), 0.0), {}
    for i, k in enumerate(sorted(sizes, key=lambda k: (-sizes[k], k))):
        want[k] = "train" if i == 0 else min(load, key=lambda s: load[s] / (total * shares[s]))
        load[want[k]] += sizes[k]
    assert {r["k"]: r["split"] for r in splits.greedy_balance(df, "k", shares).collect()} == want
    assert splits.greedy_balance(df.limit(0), "k", shares).count() == 0


def test_draws_are_exact(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(200)] + [(900, None), (901, float("nan")), (902, -1.0)], "id int, w double").where("not isnan(w) or w is null")
    out = weights.weighted_draws(df, "id", F.col("w"), 3000, 1).collect()
    assert sum(r["times"] for r in out) == 3000 and all(r["w"] > 0 for r in out)
    by = {w: sum(r["times"] for r in out if r["w"] == w) for w in (1.0, 2.0, 3.0, 4.0)}
    assert all(abs(by[w] - 300 * w) < 120 for w in by)
    assert weights.weighted_draws(df.where("w <= 0"), "id", F.col("w"), 10, 1).count() == 0


def test_numbers_as_text(spark):
    xs = [0.0, 1.0, 100.0, 0.3, 0.1 + 0.2, 1e-5, 0.00012345678901234, 123456789012.0, 1234567890123.0, -2.5e-300, 1e300, 99999999999.94]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(values.text_of_number(F.col("x"))).collect()]
    assert got == [f"{x:.12g}" for x in xs]


def test_regimes_and_blends(spark):
    rows = spark.createDataFrame([(1, "train", "a", "f"), (2, "test", "a", "f"), (3, "test", "b", "f"), (4, "validation", "a", "g"), (5, None, "z", "z"), (6, "test", None, None)], "id int, split string, antigen string, file string")
    got = {r["id"]: r["regime"] for r in metrics.with_regimes(rows, "split", {"cold": "antigen", "held": "file"}).collect()}
    assert got == {1: None, 2: "in-distribution", 3: "cold", 4: "held", 5: None, 6: "in-distribution"}
    with pytest.raises(ValueError):
        ensembles.recovered_expert(F.lit(1.0), F.lit(1.0), 0.0)


def test_trained_neighbours(spark):
    rows = spark.createDataFrame([(1, "train", "c", [1.0, 0.0]), (2, "train", "c", [0.9, 0.1]), (3, "validation", "c", [0.0, 1.0]), (4, "validation", "c", [0.0, 0.9]), (5, "train", "d", [0.0, 1.0]), (6, "train", None, [0.0, 1.0]), (7, "test", "c", [0.0, 1.0])], "id int, split string, c string, v array<double>")
    got = {r["query"]: r["neighbour"] for r in vectors.nearest_trained(rows, "id", "v", "c", "split").collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 2}
    assert vectors.nearest_trained(rows.limit(0), "id", "v", "c", "split").count() == 0


def test_bootstrap_routes_agree(spark):
    """Whole tables in tasks and distinct values in ranges give the same correlations."""
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), float(rng.randrange(6)), rng.random(), float(rng.randrange(3))) for _ in range(120)]
    df = spark.createDataFrame(rows, "c int, t double, a double, b double")
    out = [sorted((r["round"], round(r["rho_a"], 9), round(r["rho_b"], 9)) for r in metrics.bootstrap_correlations(df, "t", ["a", "b"], "c", 6, 3, task_rows=n).collect()) for n in (10**6, 0)]
    assert out[0] == out[1] and len(out[0]) == 6


def test_report_of_a_prediction_table(spark):
    rows = [(i, "train" if i % 2 else "test", f"s{i % 3}", i / 40, (i * 7 % 40) / 40, ["x", "y", None][i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, split string, source string, t double, p double, regime string")
    views = {"all": F.lit(""), "source": F.col("source"), "regime": F.col("regime")}
    got = {(r["view"], r["part"]): r for r in metrics.evaluation_report(df, "id", "t", "p", views, ("source",), ("x", "y")).collect()}
    assert set(got) == {("all", ""), ("source", "s0"), ("source", "s1"), ("source", "s2"), ("regime", "x"), ("regime", "y"), ("macro", "source"), ("weighted", "source"), ("composite", "")}
    macro = sum(got["source", f"s{k}"]["spearman"] for k in range(3)) / 3
    assert got["macro", "source"]["spearman"] == pytest.approx(macro, abs=1e-5)
    assert got["composite", ""]["spearman"] == pytest.approx(0.5 * macro + 0.25 * got["regime", "x"]["spearman"] + 0.25 * got["regime", "y"]["spearman"], abs=1e-5)
    assert metrics.evaluation_report(df.limit(0), "id", "t", "p", views, ("source",), ("x", "y")).where("view = 'composite'").first()["spearman"] is None


def test_strict_join_and_staged_sweep(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "id int, t double")
    b = spark.createDataFrame([(1, 0.1, 9.0), (2, 0.2, 8.0), (3, 0.3, 7.0)], "id int, t double, p double")
    assert sorted(map(tuple, ensembles.strictly_joined(a, b, "id").collect())) == [(1, 0.1, 9.0), (2, 0.2, 8.0), (3, 0.3, 7.0)]
    for x, y in ((a, b.limit(2)), (a.limit(2), b), (a.union(a), b), (a, b.union(b))):
        with pytest.raises(Exception, match="id not on both sides once"):
            ensembles.strictly_joined(x, y, "id").collect()
    rows = spark.createDataFrame([(i, float(i), float(-i), float(i), float(i) if i % 2 else None) for i in range(20)], "id int, t double, a double, b double, x double")
    out = ensembles.staged_sweep(rows, "id", "t", "a", "b", "x", [0.0, 0.25, 1.0]).collect()
    best = {s: max((r for r in out if r["stage"] == s), key=lambda r: r["spearman"]) for s in ("parent", "expert")}
    assert best["parent"]["weight"] == 1.0 and best["parent"]["spearman"] == 1.0 and best["expert"]["spearman"] == 1.0
