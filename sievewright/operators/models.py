"""Linear, pairwise and cluster models on Spark's own learners, and candidate design."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions.sequences import RESIDUES, filled, interaction_tokens, mutation_notation, numeric_features, sequence_text
from sievewright.operators.graph import connected_components
from sievewright.session import drop_staged, stage


def ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """All character n-grams of the lengths low to high."""
    one = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[one(n) for n in range(low, high + 1)])


def hashed_features(df: DataFrame, heavy: str, light: str, antigen: str, size: int = 1 << 12, name: str = "features") -> DataFrame:
    """df with hashed 2- to 4-grams of unit length and the numeric features of each chain in one vector."""
    rows = df.withColumn("_grams", ngrams(sequence_text(F.col(heavy), F.col(light), F.col(antigen))))
    rows = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=size).transform(rows))
    numbers = [x.alias(f"_x{i}") for i, x in enumerate(x for c in (heavy, light, antigen) for x in numeric_features(F.col(c)))]
    rows = rows.select("*", *numbers)
    names = [f"_x{i}" for i in range(len(numbers))]
    return VectorAssembler(inputCols=["_unit", *names], outputCol=name).transform(rows).drop("_grams", "_tf", "_unit", *names)


def interaction_features(df: DataFrame, heavy: str, light: str, cdr: str, antigen: str, size: int = 1 << 12, name: str = "features") -> DataFrame:
    """df with hashed tokens that join the antibody's k-mers to the antigen's; tokens add up, signs do not alternate."""
    rows = df.withColumn("_tokens", interaction_tokens(F.col(heavy), F.col(light), F.col(cdr), F.col(antigen)))
    return Normalizer(inputCol="_tf", outputCol=name, p=2.0).transform(HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=size).transform(rows)).drop("_tokens", "_tf")


def positional_features(df: DataFrame, heavy: str, light: str, size: int = 1 << 13, name: str = "features", binary: bool = True) -> DataFrame:
    """df with one hashed indicator for each residue at each place of both chains; without `binary` those that share a bucket add up."""
    at = lambda c, tag: F.transform(F.split(filled(F.col(c)), ""), lambda x, i: F.concat(F.lit(tag), i.cast("string"), x))
    rows = df.withColumn("_at", F.concat(at(heavy, "H"), at(light, "L")))
    return HashingTF(inputCol="_at", outputCol=name, numFeatures=size, binary=binary).transform(rows).drop("_at")


def fit_linear(train: DataFrame, label: str, weight: str | None = None, strength: float = 0.01, mix: float = 0.0, huber: bool = False):
    """Linear regression; Huber loss takes a squared penalty only, squared loss an elastic net of `mix`."""
    model = LinearRegression(featuresCol="features", labelCol=label, regParam=strength, elasticNetParam=0.0 if huber else mix, loss="huber" if huber else "squaredError", maxIter=20, solver="l-bfgs")
    return (model.setWeightCol(weight) if weight else model).fit(train)


def predict(model, rows: DataFrame, name: str = "prediction") -> DataFrame:
    """Predictions clipped to 0..1."""
    return model.transform(rows).withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))))


def _entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of all entries of a column of vectors, dense ones without their zeros."""
    kind, places, values = vectors.field("type").to_numpy(zero_copy_only=False), vectors.field("indices"), vectors.field("values")
    size = np.asarray(pc.fill_null(pc.list_value_length(values), 0))
    row, value = np.repeat(np.arange(len(size)), size), values.flatten().to_numpy(zero_copy_only=False)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)  # of a dense vector
    sparse = (kind == 0)[row]
    place[sparse] = places.flatten().to_numpy(zero_copy_only=False)
    kept = sparse | (value != 0)
    return row[kept], place[kept].astype(np.int64), value[kept]


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse left minus right vectors of whole batches, each in both directions, with weight and label."""
    for batch in batches:
        n = len(batch)
        left, right = batch.column("_left"), batch.column("_right")
        size = pc.max(pc.fill_null(left.field("size"), pc.list_value_length(left.field("values")))).as_py() or 0
        (i, p, x), (j, q, y) = _entries(left), _entries(right)
        key, where = np.unique(np.concatenate([i * size + p, j * size + q]), return_inverse=True)
        value = np.bincount(where, np.concatenate([x, -y]), len(key))
        offsets = np.searchsorted(key, np.arange(n + 1) * size).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(offsets), pa.array((key % max(size, 1)).astype(np.int32)))
        better = batch.column("preference").to_numpy() == 1
        for sign in (1.0, -1.0):
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sign * value))
            made = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), places, values], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([made, batch.column("pair_weight"), pa.array((better == (sign > 0)).astype(float))], names=["features", "pair_weight", "label"])


def fit_pairwise(pairs: DataFrame, features: DataFrame, id_col: str, strength: float = 0.01):
    """Logistic regression without intercept on sparse feature differences, each pair in both directions."""
    side = lambda s: features.select(F.col(id_col).alias(f"{s}_record_id"), F.col("features").alias(f"_{s}"))
    met = pairs.join(side("left"), "left_record_id").join(side("right"), "right_record_id")
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("pair_weight", T.DoubleType()), T.StructField("label", T.DoubleType())])
    rows = stage(met.select("_left", "_right", "pair_weight", F.col("preference").cast("int").alias("preference")).mapInArrow(_differences, schema))
    return LogisticRegression(fitIntercept=False, regParam=strength, elasticNetParam=0.05, weightCol="pair_weight", maxIter=20).fit(rows)


def pairwise_scores(model, features: DataFrame, name: str = "score") -> DataFrame:
    """features with the linear score of a pairwise model; only its order means anything."""
    scored = model.transform(features)
    return scored.withColumn(name, vector_to_array("rawPrediction")[1]).select(*[c for c in features.columns if c != name], name)


def _settled(rows: pd.DataFrame, rounds: int | None, tolerance: float) -> pd.DataFrame:
    """The fixed point of bradley_terry for whole components in one task."""
    names, codes = np.unique(rows[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    a, b = codes.reshape(-1, 2).T
    w, size = rows["w"].to_numpy(), len(names)
    won, p = np.bincount(a, w, size), np.ones(size)
    for _ in itertools.count() if rounds is None else range(rounds):
        share = w / (p[a] + p[b])
        new = (won + 0.5) / (np.bincount(a, share, size) + np.bincount(b, share, size) + 1.0 / (p + 1.0))
        change, p = np.abs(np.log(new / p)).max(), new
        if change < tolerance:
            break
    return pd.DataFrame({"item": names, "p": p})


def _settled_apart(both: DataFrame, rounds: int | None, tolerance: float) -> DataFrame:
    """The same with items and pairs distributed: one round is two joins and two aggregations over the pair table."""
    wins = both.groupBy("a").agg(F.sum("w").alias("won"))
    met = stage(both.select("a", "b", "w").union(both.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("n")))
    now = stage(met.select("a").distinct().join(wins, "a", "left").select(F.col("a").alias("item"), F.coalesce("won", F.lit(0.0)).alias("won"), F.lit(1.0).alias("p")))
    for _ in itertools.count() if rounds is None else range(rounds):
        other = now.select(F.col("item").alias("b"), F.col("p").alias("q"))
        own = met.join(now.select(F.col("item").alias("a"), "p"), "a").join(other, "b")
        load = own.groupBy("a").agg(F.sum(F.col("n") / (F.col("p") + F.col("q"))).alias("load")).withColumnRenamed("a", "item")
        p = (F.col("won") + 0.5) / (F.col("load") + 1.0 / (F.col("p") + 1.0))
        new = stage(now.join(load, "item").select("item", "won", p.alias("p"), F.abs(F.log(p / F.col("p"))).alias("change")))
        drop_staged(now)
        now = new
        if now.agg(F.max("change")).first()[0] < tolerance:
            break
    return now.select("item", "p")


def bradley_terry(pairs: DataFrame, rounds: int | None = None, tolerance: float = 1e-6, task_pairs: int = 1_000_000) -> DataFrame:
    """(item, strength): log strengths with mean 0 of a preference graph, by the fixed point of weighted wins.

    A virtual draw against an average item keeps items without wins or losses finite. It ends when no log strength changes
    by `tolerance`, or after `rounds` if they are given. Components do not touch each other: those of up to `task_pairs`
    pairs are dealt to tasks whole, larger ones iterate over distributed tables.
    """
    both = stage(pairs.groupBy(F.col("left_record_id").alias("a"), F.col("right_record_id").alias("b")).agg(F.sum("pair_weight").alias("w")))
    roots = stage(connected_components(both, "a", "b").select(F.col("node").alias("a"), "root"))
    rooted = stage(both.join(roots, "a"))
    large = rooted.groupBy("root").count().where(F.col("count") > task_pairs).select("root")
    small = rooted.join(large, "root", "left_anti")
    buckets = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), rooted.count() // 100_000 + 1)
    kind = both.schema["a"].dataType.simpleString()
    found = small.groupBy(F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("_bucket")).applyInPandas(lambda rows: _settled(rows, rounds, tolerance), f"item {kind}, p double")
    if large.limit(1).count():
        found = found.unionByName(_settled_apart(rooted.join(large, "root", "left_semi"), rounds, tolerance))
    now = stage(found)
    mean = now.agg(F.avg(F.log("p"))).first()[0] or 0.0
    return now.select("item", (F.log("p") - mean).alias("strength"))


def cluster_vectors(rows: DataFrame, vector: str, train: Column, k: int, seed: int = 7) -> DataFrame:
    """rows with `cluster`, by k-means fitted on the training rows only."""
    vectors = rows.withColumn("_v", array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))))
    model = KMeans(featuresCol="_v", predictionCol="cluster", k=k, seed=seed, maxIter=20).fit(vectors.where(train))
    return model.transform(vectors).drop("_v")


def experts(rows: DataFrame, metric: str, label: str, train: Column, least: int = 200) -> DataFrame:
    """rows with `global_prediction` and `expert_prediction`: one model on all training rows and one for each metric with enough of them.

    Metrics are a short registry list. A metric without an expert takes the global prediction.
    """
    base = predict(fit_linear(rows.where(train), label), rows, "global_prediction").drop("prediction")
    sizes = rows.where(train).groupBy(metric).count().where(F.col("count") >= least).orderBy(metric).collect()
    known = [r[metric] for r in sizes if r[metric] is not None]
    parts = [predict(fit_linear(base.where(train & (F.col(metric) == m)), label), base.where(F.col(metric) == m), "expert_prediction").drop("prediction") for m in known]
    rest = base.where(F.col(metric).isNull() | ~F.col(metric).isin(known)) if known else base
    out = rest.withColumn("expert_prediction", F.col("global_prediction"))
    for p in parts:
        out = out.unionByName(p)
    return out


def single_mutants(parents: DataFrame, cdr: str, protect: str = "C") -> DataFrame:
    """parents with `candidate`, `mutations` and `mutation_count`: every single substitution outside protected residues."""
    at = F.sequence(F.lit(1), F.length(cdr))
    rows = parents.where(F.length(cdr) > 0).withColumn("_p", F.explode(at)).withColumn("_to", F.explode(F.split(F.lit(RESIDUES), "")))
    old = F.substring(F.col(cdr), F.col("_p"), F.lit(1))
    rows = rows.where((F.col("_to") != "") & (old != F.col("_to")) & (old != protect))
    made = F.concat(F.substring(F.col(cdr), F.lit(1), F.col("_p") - 1), F.col("_to"), F.substring(F.col(cdr), F.col("_p") + 1, F.length(cdr)))
    rows = rows.withColumn("candidate", made)
    return rows.select(*parents.columns, "candidate", *mutation_notation(F.col(cdr), F.col("candidate")))


def candidate_score(predicted: Column, penalty: Column, mutations: Column) -> Column:
    return predicted - penalty - F.lit(0.01) * mutations
