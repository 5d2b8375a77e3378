"""Registered queries do their whole job: no cut keys, rounds, terms or pairs."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sievewright.functions import sequences
from sievewright.operators import metrics, models
from sievewright.plans import catalogue
from sievewright.plans.reference import _chains

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sf():
    if not FOLDER.exists():
        pytest.skip("the shared tables are not here")
    return str(FOLDER)


def test_greedy_split_places_whole_families(spark, sf):
    families = _chains(spark, sf).where("h <> ''").groupBy(sequences.family_key(F.col("h"), F.col("l")).alias("k")).count().collect()
    sizes = {r["k"]: r["count"] for r in families}
    got = catalogue.queries()["family_split_greedy"](spark, sf).collect()
    assert len(sizes) > 256 and {r["family"]: r["size"] for r in got} == sizes and len(got) == len(sizes)
    shares = {"test": 0.15, "train": 0.7, "validation": 0.15}
    load, want, total = dict.fromkeys(shares, 0.0), {}, sum(sizes.values())
    for i, k in enumerate(sorted(sizes, key=lambda k: (-sizes[k], k))):
        want[k] = "train" if i == 0 else min(shares, key=lambda s: (load[s] / (total * shares[s]), s))
        load[want[k]] += sizes[k]
    assert {r["family"]: r["split"] for r in got} == want


def demo(spark, folder, groups, size):
    """math_demo with unlike scores and one split: every pair of a group is a comparison."""
    rows = [(f"r{g}_{i}", "ACDEFGHIKL"[i % 10] * 12 + "MNPQ"[g % 4], "", "AAAA", f"g{g}", "f", 0.1 + 0.7 * i / size, "train") for g in range(groups) for i in range(size)]
    spark.createDataFrame(rows, "record_id string, heavy string, light string, antigen_seq string, antigen_id string, source_file string, score double, split string").write.parquet(f"{folder}/math_demo.parquet")
    return str(folder)


def test_pairs_take_the_default_limit(spark, tmp_path, monkeypatch):
    sf, every = demo(spark, tmp_path, 60, 32), 60 * 32 * 31 // 2
    assert catalogue.queries()["preference_pairs"](spark, sf).count() == every > 20_000
    assert catalogue.queries()["pair_accuracy"](spark, sf).first()["pairs"] == every
    seen, fit = [], models.fit_pairwise
    monkeypatch.setattr(models, "fit_pairwise", lambda made, *a, **k: seen.append(made.count()) or fit(made.limit(100), *a, **k))
    catalogue.queries()["pairwise_linear"](spark, sf)
    assert seen == [every]


def test_candidates_are_scored_in_their_chains(spark, sf):
    rows = catalogue.queries()["candidate_ranking"](spark, sf)
    whole = F.expr("concat(substr(heavy, 1, instr(heavy, cdrh3) - 1), candidate, substr(heavy, instr(heavy, cdrh3) + length(cdrh3)))")
    full = rows.withColumn("_h", whole).withColumn("penalty", sequences.liabilities(F.concat("_h", "light"))[-1]).toPandas()
    assert (abs(full["penalty"] - full["liability_penalty"]) < 1e-9).all()
    assert (abs(full["predicted_score"] - full["liability_penalty"] - 0.01 * full["mutation_count"] - full["score"]) < 1e-8).all()
    assert full["predicted_score"].nunique() > 100 and set(full["mutation_count"]) >= {1, 2, 3} and full["place"].max() == 10
    assert not full.duplicated(["heavy", "light", "antigen_seq", "cdrh3", "candidate"]).any()


def test_candidate_predictions_are_the_models(spark):
    from sievewright.operators import design

    made = [("ACDEFNGHIK", "QV", "AAAA", "DEFN"), ("ACDEFSGHIK", "", "AAAA", "FSG"), ("CCCC", "", "A", "CC")]
    rows = spark.createDataFrame(made, "heavy string, light string, antigen_seq string, cdrh3 string")
    train = rows.withColumn("score", F.length("heavy") / 20.0 + F.length("light") / 10.0)
    model = models.fit_linear(models.positional_features(train, "heavy", "light", 16, binary=False), "score", strength=0.001)
    out = design.ranked_candidates(rows, model, 16, 60).toPandas()
    out["parent"], out["heavy"] = out["heavy"], [h.replace(c, x, 1) for h, c, x in zip(out["heavy"], out["cdrh3"], out["candidate"])]
    again = models.predict(model, models.positional_features(spark.createDataFrame(out[["heavy", "light", "parent", "cdrh3", "candidate"]]), "heavy", "light", 16, binary=False))
    want = {(r["parent"], r["cdrh3"], r["candidate"]): r["prediction"] for r in again.collect()}
    assert set(out["parent"]) == {"ACDEFNGHIK", "ACDEFSGHIK"}
    assert all(want[r.parent, r.cdrh3, r.candidate] == pytest.approx(r.predicted_score, abs=1e-9) for r in out.itertuples())


def test_bootstrap_resamples_users_in_all_rounds(spark, sf, monkeypatch):
    seen, run = [], metrics.bootstrap_correlations
    monkeypatch.setattr(metrics, "bootstrap_correlations", lambda df, truth, scores, cluster, rounds, seed: seen.append((cluster, rounds)) or run(df, truth, scores, cluster, rounds, seed))
    assert catalogue.queries()["cluster_bootstrap_ci"](spark, sf).first()["rounds_valid"] == 1000
    p = catalogue.queries()["paired_bootstrap"](spark, sf).first()["p_better"]
    assert p * 2000 == pytest.approx(round(p * 2000)) and seen == [("user_id", 1000), ("user_id", 2000)]


def test_bootstrap_routes_agree(spark):
    df = spark.createDataFrame([(f"u{i % 13}" if i % 7 else None, float(i * i % 31), float(i * 7 % 29), float(i % 5)) for i in range(200)], "u string, t double, a double, b double")
    key = lambda n: {r["round"]: (r["rho_a"], r["rho_b"]) for r in metrics.bootstrap_correlations(df, "t", ["a", "b"], "u", 30, 3, n).collect()}
    one, many = key(1_000), key(0)
    assert set(one) == set(many) == set(range(30)) and all(one[r] == pytest.approx(many[r], abs=1e-9) for r in one)


def test_bradley_terry_settles(spark, sf):
    chain = [(f"n{i:02}", f"n{i + 1:02}", 5.0) for i in range(30)] + [("x", "y", 2.0)]
    made = spark.createDataFrame(chain, "left_record_id string, right_record_id string, pair_weight double")
    got = {r["item"]: r["strength"] for r in models.bradley_terry(made).collect()}
    few = {r["item"]: r["strength"] for r in models.bradley_terry(made, 8).collect()}
    apart = {r["item"]: r["strength"] for r in models.bradley_terry(made, 3, task_pairs=0).collect()}
    assert apart == pytest.approx({r["item"]: r["strength"] for r in models.bradley_terry(made, 3).collect()}, abs=1e-9)
    more = {r["item"]: r["strength"] for r in models.bradley_terry(made, 5_000, 0.0).collect()}
    assert got == pytest.approx(more, abs=1e-3) and few != pytest.approx(more, abs=0.1)


def test_bradley_terry_takes_all_pairs(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "bradley_terry", lambda made, *a: seen.append((made.count(), a)) or made)
    catalogue.queries()["bradley_terry"](spark, demo(spark, tmp_path, 60, 32))
    assert seen == [(60 * 32 * 31 // 2, ())]


def test_hashed_models_take_the_references_buckets(spark, sf, monkeypatch):
    seen, fit = [], models.fit_linear
    monkeypatch.setattr(models, "fit_linear", lambda train, *a, **k: seen.append(train.first()["features"].size) or fit(train, *a, **k))
    for name in ("experts_blend", "interaction_linear"):
        assert catalogue.queries()[name](spark, sf).first()["n"] > 0
    assert seen[0] == (1 << 16) + 15 and seen[-1] == 1 << 17


def test_pairwise_model_is_sparse_and_wide(spark, sf, monkeypatch):
    seen, fit = [], models.fit_pairwise
    monkeypatch.setattr(models, "fit_pairwise", lambda *a, **k: seen.append(fit(*a, **k)) or seen[-1])
    assert catalogue.queries()["pairwise_linear"](spark, sf).first()["n"] > 0
    assert len(seen[0].coefficients) == (1 << 16) + 15
