"""Rankers against closed forms, small brute-force versions and held-out figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import metrics, models, rankers

RES = "ACDEFGHIKL"


def demo(spark, n=160, seed=0):
    rng = np.random.default_rng(seed)
    effect = rng.normal(size=(8, 10))
    rows = []
    for i in range(n):
        at = rng.integers(10, size=8)
        rows.append((i, ["s1", "s2", None][i % 3] if i < n - 4 else "only_train", "".join(RES[a] for a in at), None if i % 5 else "AC", float(effect[np.arange(8), at].sum()), "train" if i % 4 or i >= n - 4 else "validation"))
    return spark.createDataFrame(rows, "id int, source string, h string, l string, score double, split string")


def test_ridge_is_the_closed_form():
    rng = np.random.default_rng(1)
    codes, y = rng.integers(0, 22, (40, 5)), rng.normal(size=40)
    x = np.zeros((40, 110))
    for p in range(5):
        x[np.arange(40), 22 * p + codes[:, p]] = 1
    centred = x - x.mean(0)
    want = np.linalg.solve(centred.T @ centred + 10 * np.eye(110), centred.T @ (y - y.mean()))
    got, start = rankers.ridge_fit(codes, y, 10.0)
    assert np.allclose(got.ravel(), want, atol=1e-7) and np.isclose(start, y.mean() - x.mean(0) @ want)
    assert np.allclose(rankers.ridge_fit(codes[:1], y[:1], 10.0)[0], 0)


def test_ridge_by_group(spark):
    df = demo(spark)
    out = rankers.ridge_by_group(df, "source", "h", "l", "score", F.col("split") == "train", 1.0)
    assert {r["source"] for r in out.select("source").distinct().collect()} == {"s1", "s2"} and out.columns == [*df.columns, "prediction"]
    figures = lambda d: metrics.regression_metrics(d.where("split = 'validation'"), "score", "prediction", "id", []).first()["spearman"]
    large = rankers.ridge_by_group(df, "source", "h", "l", "score", F.col("split") == "train", 1.0, fit_rows=10)
    assert figures(out) > 0.3 and figures(large) > 0.3 and out.count() == large.count()
    assert rankers.ridge_by_group(df.limit(0), "source", "h", "l", "score", F.col("split") == "train").count() == 0


def test_clusters_within_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"g{i % 2}", (rng.normal(size=3) + 20 * (i % 4)).tolist(), i % 5 != 0) for i in range(80)] + [(900, "g0", None, True), (901, None, [0.0] * 3, True), (902, "none_trained", [0.0] * 3, False), (903, "single", [1.0, 2.0, 3.0], True)]
    df = spark.createDataFrame(rows, "id int, g string, v array<double>, t boolean")
    out = {r["id"]: r for r in rankers.grouped_clusters(df, "g", "id", "v", F.col("t"), k=2).collect()}
    assert set(out) == {*range(80), 903} and out[903]["distance"] == 0.0 and out[903]["percentile"] == 1.0
    for g in (0, 1):
        mine = [i for i in range(80) if i % 2 == g]
        assert len({out[i]["cluster"] for i in mine}) == 2 and all((out[i]["cluster"] == out[j]["cluster"]) == (i % 4 == j % 4) for i in mine for j in mine)
        for i in mine:
            same = [j for j in mine if out[j]["cluster"] == out[i]["cluster"] and j % 5 != 0]
            assert out[i]["percentile"] == pytest.approx(sum(out[j]["distance"] <= out[i]["distance"] for j in same) / len(same))
            centre = np.mean([rows[j][2] for j in same], axis=0)
            assert out[i]["distance"] == pytest.approx(np.linalg.norm(np.array(rows[i][2]) - centre))
    again = {r["id"]: r["cluster"] for r in rankers.grouped_clusters(df, "g", "id", "v", F.col("t"), k=2).collect()}
    assert again == {i: r["cluster"] for i, r in out.items()}
    assert rankers.grouped_clusters(df.limit(0), "g", "id", "v", F.col("t")).count() == 0


def test_masked_mean_and_features(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [True, True, False]), ([[1.0, 2.0]], [False]), ([], [])], "e array<array<double>>, m array<boolean>")
    assert [r[0] for r in df.select(rankers.masked_mean(F.col("e"), F.col("m"))).collect()] == [[2.0, 3.0], None, None]
    rows = spark.createDataFrame([("ACD", "", "x", "ACE", None), ("ACE", None, None, "ACE", "A")], "h string, l string, c string, ph string, pl string")
    sizes = [r["features"].values.sum() for r in rankers.conditioned_features(rows, "h", "l", ["c"], "ph", "pl").collect()]
    assert sizes == [3 + 1 + 1 + 1, 3 + 1 + 0 + 1]  # places, the blank chain, condition, places that differ


def test_learners_rank_held_out_rows(spark):
    df = models.positional_features(demo(spark, 400).fillna("", ["l"]), "h", "l", 512)
    for fitted in (rankers.fit_factors(df.where("split = 'train'"), "score"), models.fit_linear(df.where("split = 'train'"), "score", strength=0.05, huber=True)):
        out = fitted.transform(df.where("split = 'validation'"))
        assert metrics.regression_metrics(out, "score", "prediction", "id", []).first()["spearman"] > 0.5


def test_differences_of_sparse_and_dense_vectors(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T

    rows = [(Vectors.sparse(6, [1, 3], [1.0, 2.0]), Vectors.sparse(6, [3, 5], [2.0, 4.0]), 0.5, 1), (Vectors.dense([1.0, 0, 0, 0, 0, 3.0]), Vectors.sparse(6, [], []), 1.0, -1), (Vectors.sparse(6, [], []), Vectors.sparse(6, [], []), 1.0, 1)]
    fields = [T.StructField("_left", VectorUDT()), T.StructField("_right", VectorUDT()), T.StructField("pair_weight", T.DoubleType()), T.StructField("preference", T.IntegerType())]
    df = spark.createDataFrame(rows, T.StructType(fields))
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("pair_weight", T.DoubleType()), T.StructField("label", T.DoubleType())])
    got = [(r["features"].toArray().tolist(), r["pair_weight"], r["label"]) for r in df.repartition(1).mapInArrow(models._differences, schema).collect()]
    want = [([0, 1, 0, 0, 0, -4.0], 0.5, 1.0), ([1, 0, 0, 0, 0, 3.0], 1.0, 0.0), ([0] * 6, 1.0, 1.0), ([0, -1, 0, 0, 0, 4.0], 0.5, 0.0), ([-1, 0, 0, 0, 0, -3.0], 1.0, 1.0), ([0] * 6, 1.0, 0.0)]
    assert sorted(got) == sorted(want)
