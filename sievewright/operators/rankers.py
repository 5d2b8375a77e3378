"""Rankers by source and cluster, clusters within groups, pooled embeddings, pairwise fine-tuning against a teacher."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import FMRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.sequences import RESIDUES, filled
from sievewright.operators import ensembles, models, pairs, vectors
from sievewright.session import lookup_join, stage

#: Most rows of a source or group that one task fits; larger ones are fitted by Spark's own learners, one after the other.
FIT_ROWS = 50_000


def _codes(texts: pd.Series, length: int) -> np.ndarray:
    """Residue codes from 1, other letters 21, gaps 0, one row a text, cut or filled to a length."""
    table = np.full(0x110000 if any(ord(c) > 255 for t in texts for c in t) else 256, 21, np.int16)
    for i, c in enumerate(RESIDUES, 1):
        table[ord(c)] = i
    table[ord(" ")] = 0
    joined = "".join(t.ljust(length)[:length] for t in texts)
    return table[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].reshape(len(texts), length) if length else np.zeros((len(texts), 0), np.int16)


def ridge_fit(codes: np.ndarray, y: np.ndarray, alpha: float, rounds: int = 2_000, eps: float = 1e-9) -> tuple[np.ndarray, float]:
    """(weights [place, code], intercept) of ridge regression on one-hot places, by conjugate gradients on the centred normal equations.

    The design is never written out: a row adds the weights of its codes, its residual goes back to them.
    """
    n, places = codes.shape
    at = codes + 22 * np.arange(places)
    flat, size = at.ravel(), 22 * places
    mean, means = y.mean(), np.bincount(flat, minlength=size) / n
    forward = lambda w: w[at].sum(1) - means @ w
    back = lambda r: np.bincount(flat, np.repeat(r, places), size) - means * r.sum()
    w, r = np.zeros(size), back(y - mean)
    p, rho = r.copy(), r @ r
    goal = eps * eps * max(rho, 1e-300)
    for _ in range(rounds):
        if rho <= goal:
            break
        q = back(forward(p)) + alpha * p
        step = rho / (p @ q)
        w, r = w + step * p, r - step * q
        new = r @ r
        p, rho = r + new / rho * p, new
    return w.reshape(places, 22), float(mean - means @ w)


def ridge_by_group(rows: DataFrame, by: str, heavy: str, light: str, label: str, train: Column, alpha: float = 10.0, fit_rows: int = FIT_ROWS) -> DataFrame:
    """rows of the groups that have training and other rows, with `prediction` by a ridge of each group on aligned one-hot places.

    A group is fitted in one task; one of more than `fit_rows` rows is fitted by Spark's linear regression on the same places,
    in as many distributed fits as there are such groups. Null groups are left out; texts longer than the group's longest
    training text are cut, letters that training never saw at a place count nothing.
    """
    data = stage(rows.where(F.col(by).isNotNull()).withColumn("_train", F.coalesce(train, F.lit(False))))
    sizes = data.groupBy(by).agg(F.count("*").alias("_n"), F.count_if("_train").alias("_t")).where("_t > 0 and _t < _n")
    large = [r[by] for r in sizes.where(F.col("_n") > fit_rows).orderBy(by).collect()]  # at most rows / fit_rows groups
    kept = rows.columns
    schema = f"{data.select(*kept).schema.simpleString()[7:-1]},prediction double"

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        told = part["_train"].to_numpy(bool)
        lengths = [int(part.loc[told, c].fillna("").str.len().max()) for c in (heavy, light)]
        codes = np.concatenate([_codes(part[c].fillna(""), n) for c, n in zip((heavy, light), lengths, strict=True)], axis=1)
        weights, start = ridge_fit(codes[told], part.loc[told, label].to_numpy(float), alpha)
        made = start + weights[np.arange(codes.shape[1]), codes].sum(1) if codes.shape[1] else np.full(len(part), start)
        return part[kept].assign(prediction=made)

    out = data.join(sizes.where(F.col("_n") <= fit_rows).select(by), by, "left_semi").groupBy(by).applyInPandas(lambda part: fit(part), schema)
    for group in large:
        own = models.positional_features(data.where(F.col(by) == F.lit(group)), heavy, light, 1 << 16, "features")
        spread, n = own.where("_train").agg(F.stddev_pop(label), F.count("*")).first()
        model = models.fit_linear(own.where("_train"), label, strength=alpha * (spread or 1.0) / n)
        out = out.unionByName(model.transform(own).select(*kept, "prediction"))
    return out


def _lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 100) -> np.ndarray:
    """Centres of k-means: spread starts drawn by a seed, then Lloyd's rounds until no centre moves; an empty centre stays."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        d = ((x[:, None] - centres) ** 2).sum(2).min(1) if len(x) * len(centres) * x.shape[1] < 1 << 24 else np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
        centres = np.concatenate([centres, x[[rng.choice(len(x), p=p)]]])
    for _ in range(rounds):
        near = nearest_centre(x, centres)[0]
        new = np.stack([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)
    at = d.argmin(1)
    return at, np.sqrt(d[np.arange(len(x)), at])


def grouped_clusters(rows: DataFrame, by: str, id_col: str, vector: str, train: Column, k: int = 8, seed: int = 20260812, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, by, cluster, distance, percentile, train): k-means of each group fitted on its training rows only, all its rows assigned.

    distance is that to the own centre, percentile the share of the cluster's training rows at or below it. A group of fewer
    training rows than k has as many clusters. Groups without training rows, null groups and vectors are left out. A group is
    fitted in one task on `fit_rows` training rows at most: a larger one on those with the smallest hashes of their ids, which is a
    stated bound of the fit; every row is assigned and every training row counts in the percentiles.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    data = stage(rows.where(F.col(by).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(by).cast("string").alias("g"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.coalesce(train, F.lit(False)).alias("train")))
    order = Window.partitionBy("g").orderBy(F.xxhash64("id"), "id")
    sample = data.where("train").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= fit_rows)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x = np.stack(part["v"].to_numpy())
        return pd.DataFrame({"g": part["g"].iloc[0], "centres": [_lloyd(x, min(k, len(x)), seed).tolist()]})

    centres = sample.groupBy("g").applyInPandas(lambda part: fit(part), "g string, centres array<array<double>>")
    met = lookup_join(data, stage(centres), ["g"], "inner", row_size=k * 8_192)

    def assign(batches):
        for b in batches:
            parts = []
            for _, own in b.groupby("g"):
                at, d = nearest_centre(np.stack(own["v"].to_numpy()), np.array([list(c) for c in own["centres"].iloc[0]]))
                parts.append(own[["id", "g", "train"]].assign(cluster=own["g"] + "|C" + pd.Series(at, own.index).astype(str), distance=d))
            if parts:
                yield pd.concat(parts)[["id", "g", "cluster", "distance", "train"]]

    placed = stage(met.mapInPandas(assign, f"id {kind}, g string, cluster string, distance double, train boolean"))
    return vectors.ecdf(placed, "cluster", "distance", "train").select(F.col("id").alias(id_col), F.col("g").alias(by), "cluster", "distance", "percentile", "train")


def masked_mean(embeddings: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is true, place by place; null where none is."""
    kept = F.filter(F.arrays_zip(embeddings.alias("e"), mask.alias("m")), lambda z: z["m"])
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), kept[0]["e"], lambda s, z: F.zip_with(s, z["e"], lambda a, b: a + b))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def conditioned_features(df: DataFrame, heavy: str, light: str, conditions: list[str], parent_heavy: str, parent_light: str, size: int = 1 << 16, name: str = "features") -> DataFrame:
    """df with positional features of both chains, indicators of its conditions, and indicators of each place that differs from a parent.

    A null condition has none; a blank chain has one indicator of its own, a null parent is a blank chain. Indicators that
    share a bucket add up.
    """
    at = lambda c, tag: F.transform(F.split(filled(F.col(c)), ""), lambda x, i: F.concat(F.lit(tag), i.cast("string"), x))

    def deltas(c: str, parent: str, tag: str) -> Column:
        pairs_ = F.zip_with(F.split(filled(F.col(c)), ""), F.split(filled(F.col(parent)), ""), lambda x, y: F.struct(F.coalesce(x, F.lit("-")).alias("x"), F.coalesce(y, F.lit("-")).alias("y")))
        return F.filter(F.transform(pairs_, lambda z, i: F.when(z["x"] != z["y"], F.concat(F.lit(tag), i.cast("string"), z["y"], z["x"]))), lambda t: t.isNotNull())

    told = F.array_compact(F.array(*[F.concat(F.lit(f"C{i}="), F.col(c).cast("string")) for i, c in enumerate(conditions)]))
    rows = df.withColumn("_at", F.concat(at(heavy, "H"), at(light, "L"), told, deltas(heavy, parent_heavy, "DH"), deltas(light, parent_light, "DL")))
    return HashingTF(inputCol="_at", outputCol=name, numFeatures=size).transform(rows).drop("_at")


def fit_factors(train: DataFrame, label: str, factors: int = 4, seed: int = 7):
    """A factorisation machine: linear weights and pairwise interactions of features in a few factors."""
    return FMRegressor(featuresCol="features", labelCol=label, factorSize=factors, regParam=0.01, stepSize=0.01, maxIter=30, seed=seed).fit(train)


def tuned_by_pairs(rows: DataFrame, id_col: str, label: str, group: str, split: str, teacher: str, shares: list[float], comparable: DataFrame, least: int = 2) -> tuple[DataFrame, float]:
    """(rows with `prediction`, share): a pairwise model on the rows' features anchored to a teacher's prediction.

    The pairwise scores, as percentiles within groups, are blended with the teacher's; the share is the one with the best
    mean correlation over validation groups of `least` rows or more, the smallest among equals.
    """
    model = models.fit_pairwise(pairs.preference_pairs(comparable), rows, id_col)
    scored = stage(models.pairwise_scores(model, rows, "_pair").drop("features"))
    ranked = stage(ensembles.with_percentile(ensembles.with_percentile(scored, F.col("_pair"), [group], "_a"), F.col(teacher), [group], "_b"))
    by = ensembles.blend_sweep(ranked.where(F.col(split) == "validation"), id_col, label, "_b", "_a", shares, by=[group])
    best = by.where((F.col("n") >= least) & F.col("spearman").isNotNull()).groupBy("weight").agg(F.avg("spearman").alias("spearman"))
    row = ensembles.best_of_sweep(best).first()
    share = float(row["weight"]) if row and row["weight"] is not None else 0.0
    return ranked.withColumn("prediction", F.lit(1.0 - share) * F.col("_b") + F.lit(share) * F.col("_a")), share


def pair_features(heavy: Column, light: Column) -> Column:
    """Features of an antibody by itself: both chain vectors, one after the other."""
    return array_to_vector(F.concat(heavy, light))
