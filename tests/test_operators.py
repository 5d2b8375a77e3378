import math
import random

import pytest
from pyspark.sql import functions as F

from sievewright.functions import ranks, sequences, values
from sievewright.operators import ensembles, metrics, models, pairs, quality, splits, vectors, weights
from sievewright.operators.graph import connected_components
from sievewright.session import lookup_join, shared_dir
from sievewright.sources import delivered, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_percentiles_and_ranks(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", 2.0), (4, "a", 10.0), (5, "b", 7.0), (6, None, 1.0), (7, None, 3.0)], "id int, g string, v double")
    want = {1: 0.0, 2: 0.5, 3: 0.5, 4: 1.0, 5: 0.5, 6: 0.0, 7: 1.0}
    got = {r["id"]: r["s"] for r in ranks.with_percentile(df, F.col("v"), ["g"], "s").collect()}
    assert got == want
    ranged = ranks.with_ranks(df, F.col("v"), ["g"], window_rows=0).collect()
    assert {r["id"]: ranks and ((r["_rank"] - 1) / (r["_n"] - 1) if r["_n"] > 1 else 0.5) for r in ranged} == want


def test_ranged_ranks_match_windows(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.choice("aaab"), float(rng.randrange(50))) for i in range(2000)], "id int, g string, v double")
    key = lambda d: {r["id"]: (r["_rank"], r["_n"]) for r in d.collect()}
    for by in (["g"], []):
        assert key(ranks.with_ranks(df, F.col("v"), by)) == key(ranks.with_ranks(df, F.col("v"), by, window_rows=10))
    order = [-F.col("v"), F.col("id")]
    rn = lambda d: {r["id"]: r["k"] for r in d.collect()}
    assert sorted(rn(ranks.with_row_number(df, order, [], "k")).values()) == list(range(1, 2001))
    assert ranks.with_ranks(df.limit(0), F.col("v"), ["g"]).count() == 0


def test_lookup_join_keeps_columns_of_its_own_names(spark):
    facts = spark.createDataFrame([(i, i % 7, i * 2, i * 3) for i in range(50)], "id int, k int, _n int, _s int")
    dim = spark.createDataFrame([(k, k * 10) for k in range(7)], "k int, v int")
    rows = [sorted(map(tuple, lookup_join(facts, dim, ["k"], limit=n).select("id", "_n", "_s", "v").collect())) for n in (10**6, 0)]
    assert rows[0] == rows[1] and len(rows[0]) == 50 and rows[0][9] == (9, 18, 27, 20)


def test_large_groups_have_the_metrics_of_small_ones(spark):
    """Twice the rows of a window are ranked in ranges, with ties, null groups and a constant one."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), float(rng.randrange(30)), rng.choice([-0.0, 0.0, rng.random(), float(rng.randrange(9))])) for i in range(900)]
    rows += [(900 + i, "c", 1.0, float(i % 3)) for i in range(40)] + [(950, "d", 1.0, 2.0), (951, "a", None, 1.0), (952, "a", 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "id int, g string, t double, p double")
    for by in ([], ["g"]):
        got = [{tuple(r[b] for b in by): [r[m] for m in metrics.METRICS] for r in metrics.regression_metrics(df, "t", "p", "id", by, task_rows=n).collect()} for n in (10**6, 0)]
        assert got[0].keys() == got[1].keys()
        for k, want in got[0].items():
            assert got[1][k] == pytest.approx(want, abs=1e-9), k


def test_row_numbers_in_ranges_match_windows(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice(["a", None]), float(rng.randrange(9)), i) for i in range(500)], "id int, g string, _p double, _n int")
    for by in (["g"], []):
        got = [sorted(map(tuple, ranks.with_row_number(df, [-F.col("_p"), F.col("id")], by, "k", window_rows=n).select("id", "_p", "_n", "k").collect())) for n in (10**6, 0)]
        assert got[0] == got[1]


def test_sweep_of_many_rows_has_the_metrics_of_few(spark):
    """In a window, in parts of a task and shuffled; with ties at the top's edge, missing scores and an infinite one."""
    rng = random.Random(8)
    rows = [(i, float(rng.randrange(12)), float(rng.randrange(5)), rng.choice([0.0, -0.0, float(rng.randrange(40)), rng.random()])) for i in range(400)]
    rows += [(500, None, 1.0, 1.0), (501, 1.0, float("nan"), 1.0), (502, 1.0, 1.0, None)]
    shares, schema = [0.0, 0.25, 1.0], "id int, t double, a double, b double"
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([*rows, (600, 2.0, float("inf"), 1.0)], schema)):
        runs = [ensembles.blend_sweep(df, "id", "t", "a", "b", shares, **kw).collect() for kw in ({}, {"task_rows": 0, "part_rows": 90}, {"task_rows": 0, "part_rows": 1})]
        want = {r["weight"]: [r[m] for m in metrics.METRICS] for r in runs[0]}
        for run in runs[1:]:
            got = {r["weight"]: [r[m] for m in metrics.METRICS] for r in run}
            assert got.keys() == want.keys() == set(shares)
            for w in shares:
                assert got[w] == pytest.approx(want[w], abs=1e-9, nan_ok=True), w


def test_best_share_of_many_rows_is_the_smallest_of_equals(spark):
    df = spark.createDataFrame([(i, float(i), float(i), float(i * i)) for i in range(60)], "id int, t double, a double, b double")
    best = ensembles.best_of_sweep(ensembles.blend_sweep(df, "id", "t", "a", "b", [1.0, 0.5, 0.25], task_rows=0, part_rows=25)).first()
    assert best["weight"] == 0.25 and best["spearman"] == pytest.approx(1.0)


def test_sweep_of_a_recovered_expert_over_many_rows(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.random(), rng.random(), rng.random()) for i in range(150)], "id int, t double, g double, p double")
    df = df.withColumn("x", ensembles.recovered_expert(F.col("p"), F.col("g"), 0.4))
    runs = [{r["weight"]: [r[m] for m in metrics.METRICS] for r in ensembles.blend_sweep(df, "id", "t", "g", "x", [0.0, 0.3], **kw).collect()} for kw in ({}, {"task_rows": 0, "part_rows": 40})]
    for w in (0.0, 0.3):
        assert runs[0][w] == pytest.approx(runs[1][w], abs=1e-9)


def test_staged_sweep_of_many_rows_has_the_figures_of_few(spark):
    rng = random.Random(9)
    rows = [(i, float(rng.randrange(20)), float(rng.randrange(30)), rng.random(), float(rng.randrange(9)) if i % 3 == 0 else None) for i in range(300)]
    full = spark.createDataFrame(rows, "id int, t double, a double, b double, x double")
    runs = [sorted(map(tuple, ensembles.staged_sweep(full, "id", "t", "a", "b", "x", [0.0, 0.3, 1.0], task_rows=n).collect())) for n in (10**6, 0)]
    assert runs[0] == runs[1] and len(runs[0]) == 6 and len({r[2] for r in runs[0]}) > 3


def test_permuted_truth_of_many_rows(spark):
    df = spark.createDataFrame([(i, i / 7, float(i * 13 % 50)) for i in range(200)], "id int, t double, _p double")
    runs = [metrics.permuted_truth(df, "t", "id", 5, task_rows=n) for n in (10**6, 0)]
    rows = [sorted(map(tuple, r.select("id", "t", "_p", "permuted").collect())) for r in runs]
    assert rows[0] == rows[1] and sorted(r[3] for r in rows[0]) == [r[1] for r in rows[0]]
    found = [metrics.regression_metrics(r, "permuted", "_p", "id", [], task_rows=n).first()["spearman"] for r, n in zip(runs, (10**6, 0), strict=True)]
    assert found[0] == pytest.approx(found[1], abs=1e-12)


def test_lookup_join_routes_agree(spark):
    facts = spark.createDataFrame([(i, i % 7 if i % 3 else 0) for i in range(60_000)], "id int, k int")
    dim = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k int, v string")
    a = lookup_join(facts, dim, ["k"], "left").agg(F.count("v"), F.count("*")).first()
    assert tuple(a) == tuple(lookup_join(facts, dim, ["k"], "left", limit=1).agg(F.count("v"), F.count("*")).first())


def test_shared_folder_is_refused_off_local():
    class Fake:
        class sparkContext:
            master = "spark://x"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError):
        shared_dir(Fake)


def test_sequences(spark):
    assert one(spark, sequences.normalize_sequence(F.lit(" ac-d\n"))) == "ACD" and one(spark, sequences.normalize_sequence(F.lit("ACX"))) == "" and one(spark, sequences.normalize_sequence(F.lit(None).cast("string"))) == ""
    assert one(spark, sequences.kmers(F.lit("AC"))) == [] and one(spark, sequences.kmers(F.lit("ACACA"))) == ["ACA", "CAC"]
    assert len(one(spark, sequences.sampled_kmers(F.lit("ACDEFGHIKLMNPQRSTVWYACCA")))) == 16
    assert one(spark, sequences.interaction_tokens(F.lit("ACD"), F.lit(""), F.lit(""), F.lit("EFG"))) == ["X_ACD_EFG"] and one(spark, sequences.interaction_tokens(F.lit("ACD"), F.lit(""), F.lit(""), F.lit(""))) == []
    note = spark.range(1).select(*sequences.mutation_notation(F.lit("ACD"), F.lit("AGE"))).first()
    assert tuple(note) == ("C2G;D3E", 2)
    with pytest.raises(Exception, match="equal length"):
        spark.range(1).select(*sequences.mutation_notation(F.lit("AC"), F.lit("A"))).collect()
    assert one(spark, sequences.delta_tokens(sequences.sequence_tokens(F.lit("AC"), 3), sequences.sequence_tokens(F.lit("AD"), 3))) == [0, 1 + 21 * 2 + 3, 0]
    found = spark.range(1).select(*sequences.liabilities(F.lit("NASNGDG"))).first()
    assert (found["glycosylation_motifs"], found["deamidation_motifs"], found["isomerization_motifs"]) == (1, 1, 1)


def test_values(spark):
    texts = {"<1e-12": 1e-12, "1,000": 1000.0, "NA": None, "": None, None: None, "Binder": 1.0, "no bind": 0.0, "1e400": None, "abc": None}
    assert [one(spark, values.parse_number(F.lit(t).cast("string"))) for t in texts] == list(texts.values())
    assert tuple(one(spark, values.censored_number(F.lit("<= 5")))) == (None, True) and tuple(one(spark, values.censored_number(F.lit("5")))) == (5.0, False)
    assert [one(spark, values.quality_weight(F.lit(t).cast("string"))) for t in ("1", ".65", "0", "bad", None, "")] == [1.0, 0.65, 0.05, 1.0, 1.0, 1.0]
    import hashlib

    assert one(spark, values.stable_bucket(F.lit("abc"), 97)) == int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big") % 97
    valid = lambda v, policy, metric: one(spark, values.label_is_valid(F.lit(v).cast("double"), F.lit(policy), F.lit("0"), F.lit(None).cast("string"), F.lit(metric)))
    assert [valid(1e-9, "require_positive_finite", "KD"), valid(0.0, "require_positive_finite", "KD"), valid(0.5, "reject_nonfinite", "binding_class"), valid(None, "x", "KD")] == [True, False, False, False]
    rules = [("source_contains", "mix", "route_by_metric"), ("source_contains", "m", "A"), ("metric", "KD", "B")]
    route = lambda s, m: one(spark, values.first_match(rules, F.lit(s), F.lit(m), "none"))
    assert [route("mix", "KD"), route("mix", "z"), route("m", "KD"), route("q", "KD"), route("q", "z")] == ["B", "none", "A", "B", "none"]


def test_metrics(spark):
    df = spark.createDataFrame([(i, "a", float(i), float(i)) for i in range(30)] + [(i, "b", float(i), float(-i)) for i in range(30, 60)] + [(60, "c", 1.0, 2.0), (61, "d", 1.0, math.nan), (62, "d", None, 1.0)], "id int, g string, t double, p double")
    got = {r["g"]: r for r in metrics.regression_metrics(df, "t", "p", "id", ["g"]).collect()}
    assert got["a"]["spearman"] == pytest.approx(1) and got["a"]["top10_enrichment"] == pytest.approx(10) and got["b"]["spearman"] == pytest.approx(-1) and got["c"]["spearman"] is None and "d" not in got
    macro = metrics.macro_means(metrics.regression_metrics(df, "t", "p", "id", ["g"])).first()
    assert macro["groups"] == 2 and macro["macro_spearman"] == pytest.approx(0)
    assert metrics.regression_metrics(df.limit(0), "t", "p", "id", ["g"]).count() == 0
    rows = df.where("g = 'a'").withColumn("c", F.col("id") % 3)
    boot = metrics.bootstrap_interval(metrics.bootstrap_correlations(rows, "t", ["p"], "c", 10, 1), "rho_p").first()
    assert boot["rounds_valid"] == 10 and boot["low"] == pytest.approx(1)


def comparable(spark, rows):
    return spark.createDataFrame(rows, "record_id string, label double, quality double, is_censored boolean, conflict double, split string, comparison_group string")


def test_preference_pairs(spark):
    base = [("a", 0.1), ("b", 0.5), ("c", 0.9), ("d", 0.9)]
    rec = comparable(spark, [(i, v, 1.0, False, 0.0, "train", "g") for i, v in base])
    out = pairs.preference_pairs(rec)
    assert {(r["left_record_id"], r["right_record_id"]) for r in out.collect()} == {("b", "a"), ("c", "a"), ("d", "a"), ("c", "b"), ("d", "b")}
    assert all(r["violations"] == 0 for r in pairs.validate_pairs(out, rec).collect())
    none = comparable(spark, [("a", 0.1, 1.0, True, 0.0, "train", "g"), ("b", 0.9, 1.0, True, 0.0, "train", "g"), ("c", 0.1, 1.0, False, 0.0, "x", "h"), ("d", 0.9, 1.0, False, 0.0, "y", "h"), (None, 0.5, 1.0, False, 0.0, "", "g"), ("e", 0.5, 1.0, False, 0.0, "", None)])
    assert pairs.preference_pairs(none).count() == 0
    big = comparable(spark, [(f"r{i:03}", i / 100, 1.0, False, 0.0, "", g) for g in "gh" for i in range(100)]).withColumn("record_id", F.concat("comparison_group", "record_id"))
    few = pairs.preference_pairs(big, total=20)
    assert {r["comparison_group"]: r["count"] for r in few.groupBy("comparison_group").count().collect()} == {"g": 10, "h": 10}
    assert pairs.preference_pairs(rec.limit(0)).count() == 0


def test_splits(spark):
    df = spark.createDataFrame([(i, f"g{i % 20}") for i in range(100)], "id int, g string")
    got = {r["split"]: r["count"] for r in splits.group_hash_split(df, "g").groupBy("split").count().collect()}
    assert got == {"train": 14, "validation": 3, "test": 3}
    with pytest.raises(ValueError):
        splits.group_hash_split(df.limit(1), "g")
    sizes = [50, 30, 20, 10, 5, 5]
    big = spark.createDataFrame([(f"f{k}",) for k, n in enumerate(sizes) for _ in range(n)], "k string")
    made = {r["k"]: r["split"] for r in splits.greedy_balance(big, "k", {"train": 0.7, "validation": 0.15, "test": 0.15}).collect()}
    load, want, target = {"test": 0, "train": 0, "validation": 0}, {}, {"train": 84, "validation": 18, "test": 18}
    for k, n in enumerate(sizes):
        s = "train" if k == 0 else min(load, key=lambda x: (load[x] / target[x], x))
        want[f"f{k}"] = s
        load[s] += n
    assert made == want
    leak = spark.createDataFrame([("a", "k1", "train"), ("b", "k1", "test"), ("c", "k2", "train"), ("d", None, "train")], "id string, k string, s string")
    assert {r["id"] for r in splits.purge_leakage(leak, F.col("k"), "s").collect()} == {"b", "c", "d"} and [r["key"] for r in splits.leaking_keys(leak, F.col("k"), "s").collect()] == ["k1"]
    with pytest.raises(Exception, match="unknown group"):
        splits.check_manifest(leak, leak.select(F.lit("k1").alias("k")).distinct(), "k").collect()


def test_components(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "u string, v string")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and (got["y"], got["z"]) == ("x", "z") and "q" not in got
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_ensembles_and_weights(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, s double")
    assert ensembles.strict_align({"x": t, "y": t}, "id", "s").count() == 2
    with pytest.raises(Exception, match="different ids"):
        ensembles.strict_align({"x": t, "y": t.limit(1)}, "id", "s").collect()
    with pytest.raises(Exception, match="truth differs"):
        ensembles.intersection_align(t, t.withColumn("s", F.col("s") + 1), "id", "s").collect()
    rows = spark.createDataFrame([(i, float(i), float(-i), i < 3) for i in range(6)], "id int, base double, expert double, r boolean")
    got = {r["id"]: r["score"] for r in ensembles.routed_remap(rows, "id", "base", "expert", F.col("r")).collect()}
    assert got == {0: 2.0, 1: 1.0, 2: 0.0, 3: 3.0, 4: 4.0, 5: 5.0}
    sizes = spark.createDataFrame([("s",)] * 10 + [("l",)] * 1000, "src string")
    mass = {r["src"]: r["m"] for r in weights.temperature(sizes, "src", F.lit(1.0), 0.5).groupBy("src").agg(F.sum("weight").alias("m")).collect()}
    assert mass["l"] / mass["s"] == pytest.approx(10)
    equal = {r["src"]: r["m"] for r in weights.source_balance(sizes, "src", 1.0).groupBy("src").agg(F.sum("weight").alias("m")).collect()}
    assert equal["l"] == pytest.approx(equal["s"])
    with pytest.raises(ValueError):
        weights.temperature(sizes, "src", F.lit(0.0))


def test_vectors_and_models(spark):
    rng = random.Random(2)
    e = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(200)] + [(500, None, 1)], "id long, v array<double>, y int")
    near = vectors.nearest(e, e.where("id < 5"), "id", "v", 3).collect()
    assert len(near) == 15 and all(r["query"] != r["neighbour"] for r in near)
    exact = spark.createDataFrame([("g", "ACC"), ("g", "AGC"), ("g", "AGT"), ("h", "")], "g string, s string")
    assert [tuple(r) for r in vectors.consensus(exact, "g", "s").collect()] == [("g", "AGC")]
    items = spark.createDataFrame([(a, b, 1.0) for a, b in [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]], "left_record_id string, right_record_id string, pair_weight double")
    strength = {r["item"]: r["strength"] for r in models.bradley_terry(items, 20).collect()}
    assert strength["a"] > strength["b"] > strength["c"] > strength["d"] and abs(sum(strength.values())) < 1e-6
    demo = spark.createDataFrame([(i, "ACDEFGHIKL"[i % 10] * 8, "", "AAAA", (i % 10) / 10) for i in range(120)], "id int, h string, l string, a string, score double")
    rows = models.positional_features(demo, "h", "l", 256)
    out = models.predict(models.fit_linear(rows.where("id < 90"), "score", strength=0.001), rows.where("id >= 90"))
    assert metrics.regression_metrics(out, "score", "prediction", "id", []).first()["spearman"] > 0.95
    mutants = models.single_mutants(spark.createDataFrame([("AC",)], "cdr string"), "cdr").collect()
    assert len(mutants) == 19 and all(r["candidate"][1] == "C" and r["mutation_count"] == 1 for r in mutants)


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "in"
    (root / "g").mkdir(parents=True)
    (root / "g" / "a.csv").write_bytes(b'\xef\xbb\xbfdraft\nHC,LC,fitness\nACD,,"1,5"\n"ACE",FGH,high\nACF,"x\ny",2\nACG,,3')
    (root / "g" / "b.tsv").write_bytes(b"heavy\tKd [M]\nACD\t1e-9\r\n")
    files = delivered.delivered_files(spark, f"file://{root}")
    lines = delivered.delivered_lines(files)
    inv = delivered.inventory_of(lines, files)
    assert {r["path"]: (r["header_row"], r["label_candidates"]) for r in inv.collect()} == {"g/a.csv": (2, ["fitness"]), "g/b.tsv": (1, ["Kd [M]"])}
    got = {(r["source_file"], r["heavy"], r["raw_label"]) for r in delivered.raw_records(lines, inv).collect()}
    assert got == {("g/a.csv", "ACD", 15.0), ("g/a.csv", "ACG", 3.0), ("g/b.tsv", "ACD", 1e-9)}
    df = spark.createDataFrame([("a", "ACD", 0.5), ("b", "", 1.0)], "id string, s string, x double")
    sinks.write_csv(df, f"file://{tmp_path}/c", gzip=True)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 2
    sinks.write_fasta(df, f"file://{tmp_path}/f", "id", "s")
    assert "".join(p.read_text() for p in (tmp_path / "f").glob("part*")) == ">a\nACD\n"
    with pytest.raises(Exception, match="not finite"):
        sinks.write_predictions(df.withColumn("x", F.lit(math.inf)), f"file://{tmp_path}/p", "x")
    with pytest.raises(ValueError):
        sinks.guard_output("/data/raw/x", "/data/raw")
    sinks.write_summary(df, f"file://{tmp_path}/s")
    one_, two = (spark.createDataFrame([("p", n, "AA"), (x, 1, "bb")], "path string, size_bytes long, sha256 string") for n, x in ((1, "q"), (2, "r")))
    assert {tuple(r) for r in sinks.snapshot_check(one_, two).collect()} == {("p", "size"), ("q", "extra"), ("r", "missing")}


def test_quality(spark):
    df = spark.createDataFrame([("f", "ACD", 1.0), ("f", "", 2.0), ("f", "AX", None)], "file string, h string, y double")
    p = quality.file_profile(df, "file", ["h"], "y").first()
    assert (p["rows"], p["h_missing"], p["h_valid"], p["h_invalid"], p["labels"], p["label_max"]) == (3, 1, 1, 1, 2, 2.0)
    assert quality.file_profile(df.limit(0), "file", ["h"], "y").count() == 0


def test_stream(spark, tmp_path):
    from test_structural import INV, LINE, SEQ, inventory

    from sievewright.streaming.lines import classified_stream, write_split

    spark.createDataFrame([(1, "a.csv", 2, f"{SEQ},,1,x"), (2, "a.csv", 3, "bad")], LINE).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(LINE).parquet(f"file://{tmp_path}/in")
    query = write_split(classified_stream(stream, inventory(spark)), f"file://{tmp_path}/good", f"file://{tmp_path}/bad", f"file://{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    assert INV and spark.read.parquet(f"file://{tmp_path}/good").count() == 1 and spark.read.parquet(f"file://{tmp_path}/bad").count() == 1
