"""Queries that fit models; they have no SQL and are checked by held-out figures in the tests."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import ranks, sequences
from sievewright.operators import design, metrics, models, pairs, rankers, splits, vectors, weights
from sievewright.plans.reference import _DOT, _comparable, query, r9, read
from sievewright.session import lookup_join, stage


def _demo(spark: SparkSession, sf: str) -> DataFrame:
    n = sequences.normalize_sequence
    rows = read(spark, sf, "math_demo").where("score is not null and record_id is not null")
    return rows.select("record_id", n(F.col("heavy")).alias("heavy"), n(F.col("light")).alias("light"), n(F.col("antigen_seq")).alias("antigen_seq"), "source_file", "score", F.lower(F.trim("split")).alias("split")).distinct()


def _evaluated(predicted: DataFrame) -> DataFrame:
    rows = predicted.where("split = 'validation'")
    return metrics.regression_metrics(rows, "score", "prediction", "record_id", [])


@query()
def linear_hashed(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(models.hashed_features(_demo(spark, sf), "heavy", "light", "antigen_seq", 1 << 16))
    return _evaluated(models.predict(models.fit_linear(rows.where("split = 'train'"), "score", mix=0.05), rows))


@query()
def huber_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Huber loss with weights that balance the sources."""
    rows = models.positional_features(_demo(spark, sf), "heavy", "light")
    train = weights.source_balance(rows.where("split = 'train' and source_file is not null"), "source_file", 0.5, "w")
    return _evaluated(models.predict(models.fit_linear(stage(train), "score", "w", 0.1, huber=True), rows))


@query()
def ridge_positional(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(models.positional_features(_demo(spark, sf), "heavy", "light"))
    return _evaluated(models.predict(models.fit_linear(rows.where("split = 'train'"), "score", strength=0.1), rows))


@query()
def experts_blend(spark: SparkSession, sf: str) -> DataFrame:
    registry = read(spark, sf, "label_registry").select("source_file", "metric")
    rows = stage(models.hashed_features(_demo(spark, sf).join(registry, "source_file", "left"), "heavy", "light", "antigen_seq", 1 << 16))
    out = models.experts(rows, "metric", "score", F.col("split") == "train")
    return _evaluated(out.withColumn("prediction", F.col("global_prediction") * 0.5 + F.col("expert_prediction") * 0.5))


@query()
def bradley_terry(spark: SparkSession, sf: str) -> DataFrame:
    return models.bradley_terry(pairs.preference_pairs(_comparable(spark, sf)))


@query()
def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    return models.cluster_vectors(e, "embedding", F.col("vec_id") % 5 != 0, 10).select("vec_id", "cluster")


@query()
def candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best of the single and multi-point mutants of every binding loop, each in its own chains."""
    size, n = 1 << 13, sequences.normalize_sequence
    train = _demo(spark, sf).where("split = 'train'")
    model = models.fit_linear(models.positional_features(train, "heavy", "light", size, binary=False), "score", strength=0.1)
    targets = read(spark, sf, "raw_record").select(*[n(F.col(c)).alias(c) for c in ("heavy", "light", "antigen_seq", "cdrh3")]).distinct()
    return design.ranked_candidates(targets, model, size)


def _raw_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled raw records with all their chains, the percentile of the label in its group and a split by identity."""
    n = sequences.normalize_sequence
    rows = read(spark, sf, "raw_record").where("raw_label is not null and not isnan(raw_label)")
    rows = rows.select("record_id", *[n(F.col(c)).alias(c) for c in ("heavy", "light", "antigen_seq", "cdrh3")], (F.col("raw_label") * F.col("direction")).alias("v"), F.coalesce("comparison_group", "source_file").alias("grp")).where("heavy <> ''")
    scored = ranks.with_percentile(rows, F.col("v"), ["grp"], "score")
    return splits.identity_split(scored, sequences.pair_key(F.col("heavy"), F.col("light"))).select("record_id", "heavy", "light", "antigen_seq", "cdrh3", "score", "split")


@query()
def interaction_linear(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(models.interaction_features(_raw_scored(spark, sf), "heavy", "light", "cdrh3", "antigen_seq", 1 << 17))
    return _evaluated(models.predict(models.fit_linear(rows.where("split = 'train'"), "score"), rows))


@query()
def pairwise_linear(spark: SparkSession, sf: str) -> DataFrame:
    made = pairs.preference_pairs(_comparable(spark, sf).where("split = 'train'"))
    rows = stage(models.hashed_features(_demo(spark, sf), "heavy", "light", "antigen_seq", 1 << 16))
    scored = models.pairwise_scores(models.fit_pairwise(made, rows, "record_id"), rows, "prediction")
    return _evaluated(scored)


@query()
def embedding_head(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").withColumn("sequence", F.col("vec_id").cast("string"))
    rows = e.select("vec_id", "label", "sequence", F.when(F.col("vec_id") % 2 == 0, (F.col("vec_id") - 1).cast("string")).otherwise("").alias("other"))
    both = vectors.chain_embeddings(rows, e.select("sequence", "embedding"), "sequence", "other", 64)
    rows = both.select(F.col("vec_id").alias("record_id"), (F.col("label") / F.lit(10.0)).alias("score"), F.when(F.col("vec_id") % 5 == 0, "validation").otherwise("train").alias("split"), array_to_vector(vectors.interaction_features(F.col("heavy_vector"), F.col("light_vector"))).alias("features"))
    rows = stage(rows)
    return _evaluated(models.predict(models.fit_linear(rows.where("split = 'train'"), "score"), rows))


@query()
def ridge_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """A ridge of each source on aligned places, its validation rows judged together."""
    rows = _demo(spark, sf).where("source_file is not null and split in ('train', 'validation')")
    return _evaluated(rankers.ridge_by_group(rows, "source_file", "heavy", "light", "score", F.col("split") == "train"))


@query()
def grouped_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters within groups, fitted on training rows, with distances and their percentiles."""
    e = read(spark, sf, "embeddings")
    out = rankers.grouped_clusters(e, "label", "vec_id", "embedding", F.col("vec_id") % 5 != 0)
    return out.select("vec_id", "cluster", r9("distance", "distance"), r9("percentile", "percentile"))


@query()
def pairwise_held_out(spark: SparkSession, sf: str) -> DataFrame:
    """The share of held-out preference pairs that the pairwise model orders rightly."""
    rows = stage(models.hashed_features(_demo(spark, sf), "heavy", "light", "antigen_seq", 1 << 16))
    sides = {s: pairs.preference_pairs(_comparable(spark, sf).where(F.col("split") == s)) for s in ("train", "validation")}
    scored = models.pairwise_scores(models.fit_pairwise(sides["train"], rows, "record_id"), rows)
    return metrics.pair_accuracy(sides["validation"], scored.select("record_id", "score"), "record_id", "score")


_SIDES_SQL = f"""SELECT q.vec_id AS query, r.vec_id AS neighbour, round({_DOT('q.embedding', 'r.embedding')} / (sqrt({_DOT('q.embedding', 'q.embedding')}) * sqrt({_DOT('r.embedding', 'r.embedding')})), 6) AS similarity FROM embeddings q JOIN embeddings r ON q.label = r.label AND r.vec_id % 5 <> 0 AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 < 10"""


@query(f"SELECT query, neighbour, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS place FROM ({_SIDES_SQL})) WHERE place = 1")
def local_references(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest other training vector of the same label: the local reference of train and validation rows."""
    e = read(spark, sf, "embeddings").withColumn("split", F.when(F.col("vec_id") % 5 != 0, "train").otherwise("validation"))
    asked = F.col("vec_id") % 50 < 10  # a stated query set against all training rows
    return vectors.nearest(e.where("split = 'train'"), e.where(asked), "vec_id", "embedding", 1, by="label").select("query", "neighbour", "similarity")


_POOL_SQL = "list_transform(string_split(heavy, ''), lambda c: [CASE WHEN c IN ('A', 'V', 'I', 'L', 'M', 'F', 'W', 'Y') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN c IN ('K', 'R', 'H') THEN 1.0::DOUBLE WHEN c IN ('D', 'E') THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END])"


@query(f"SELECT raw_id, round(list_avg(list_transform(v, lambda x: x[1])), 9) AS first, round(list_avg(list_transform(v, lambda x: x[2])), 9) AS second FROM (SELECT raw_id, list_filter({_POOL_SQL}, lambda x, i: string_split(heavy, '')[i] <> 'C') AS v FROM raw_record WHERE regexp_full_match(heavy, '[ACDEFGHIKLMNPQRSTVWY]+'))")
def pooled_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of residues pooled over the places that a mask keeps."""
    rows = read(spark, sf, "raw_record").where(F.col("heavy").rlike(rf"^[{sequences.RESIDUES}]+\z")).select("raw_id", F.filter(F.split("heavy", ""), lambda c: c != "").alias("c"))
    vector = F.transform("c", lambda c: F.array(c.isin(*sequences.HYDROPHOBIC).cast("double"), F.when(c.isin(*sequences.POSITIVE), 1.0).when(c.isin(*sequences.NEGATIVE), -1.0).otherwise(0.0)))
    pooled = rankers.masked_mean(vector, F.transform("c", lambda c: c != "C"))
    return rows.select("raw_id", pooled.alias("v")).select("raw_id", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[1], 9).alias("second"))


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    """(record_id, score, grp, split, heavy_vector, light_vector) of the embeddings, odd ones single chains."""
    e = read(spark, sf, "embeddings").withColumn("sequence", F.col("vec_id").cast("string"))
    rows = e.select("vec_id", "label", "sequence", F.when(F.col("vec_id") % 2 == 0, (F.col("vec_id") - 1).cast("string")).otherwise("").alias("other"))
    both = vectors.chain_embeddings(rows, e.select("sequence", "embedding"), "sequence", "other", 64)
    return both.select(F.col("sequence").alias("record_id"), (F.col("label") / F.lit(10.0)).alias("score"), (F.col("vec_id") % 7).cast("string").alias("grp"), F.when(F.col("vec_id") % 5 == 0, "validation").otherwise("train").alias("split"), "heavy_vector", "light_vector")


@query()
def antibody_ranker(spark: SparkSession, sf: str) -> DataFrame:
    """A ranker on the antibody's own embeddings, without an antigen."""
    rows = stage(_embedded(spark, sf).withColumn("features", rankers.pair_features(F.col("heavy_vector"), F.col("light_vector"))).drop("heavy_vector", "light_vector"))
    return _evaluated(models.predict(models.fit_linear(rows.where("split = 'train'"), "score"), rows))


@query()
def tuned_head(spark: SparkSession, sf: str) -> DataFrame:
    """A pairwise model on embedding features anchored to a linear teacher, by the best mean over groups."""
    rows = stage(_embedded(spark, sf).withColumn("features", array_to_vector(vectors.interaction_features(F.col("heavy_vector"), F.col("light_vector")))).drop("heavy_vector", "light_vector"))
    taught = models.predict(models.fit_linear(rows.where("split = 'train'"), "score"), rows, "teacher").drop("prediction")
    comparable = rows.where("split = 'train'").select("record_id", F.col("score").alias("label"), F.col("grp").alias("comparison_group"), "split", F.lit(1.0).alias("quality"), F.lit(False).alias("is_censored"), F.lit(0.0).alias("conflict"))
    return _evaluated(rankers.tuned_by_pairs(taught, "record_id", "score", "grp", "split", "teacher", [0.0, 0.25, 0.5, 0.75, 1.0], comparable)[0])


@query()
def conditioned_positional(spark: SparkSession, sf: str) -> DataFrame:
    """Places of both chains, conditioned on assay and file, with what differs from the consensus of the antigen's training rows."""
    registry = read(spark, sf, "label_registry").select("source_file", "metric")
    rows = lookup_join(_demo(spark, sf).withColumn("antigen", F.md5("antigen_seq")), registry, ["source_file"], "left")
    train = rows.where("split = 'train'")
    parents = vectors.consensus(train, "antigen", "heavy").withColumnRenamed("consensus", "parent_heavy").join(vectors.consensus(train, "antigen", "light").withColumnRenamed("consensus", "parent_light"), "antigen", "left")
    rows = lookup_join(rows, stage(parents), ["antigen"], "left", row_size=400)
    rows = stage(rankers.conditioned_features(rows, "heavy", "light", ["metric", "source_file"], "parent_heavy", "parent_light"))
    return _evaluated(models.predict(models.fit_linear(rows.where("split = 'train'"), "score", strength=0.1), rows))


@query()
def factor_ranker(spark: SparkSession, sf: str) -> DataFrame:
    """A factorisation machine over hashed places, in place of a convolutional encoder."""
    rows = stage(models.positional_features(_demo(spark, sf), "heavy", "light", 1 << 12))
    return _evaluated(models.predict(rankers.fit_factors(rows.where("split = 'train'"), "score"), rows))
