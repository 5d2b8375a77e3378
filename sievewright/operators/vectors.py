"""Nearest neighbours, prototypes and distances over embedding arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.ranks import ranged_sums
from sievewright.session import lookup_join, stage

#: Query vectors held by a task at once; more queries are run in blocks over all rows.
QUERY_BLOCK = 2_048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.try_divide(dot(a, b), F.when(norm > 0, norm))


def _query_blocks(files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, unit vectors, groups) of the written queries, QUERY_BLOCK at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for path in files:
        system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        for batch in pq.ParquetFile(at, filesystem=system).iter_batches(QUERY_BLOCK, columns=["id", "v", "g"]):
            if len(batch):
                q = np.stack([np.asarray(v, float) for v in batch.column("v").to_pylist()])
                norm = np.linalg.norm(q, axis=1)
                yield batch.column("id").to_numpy(zero_copy_only=False), q / np.where(norm > 0, norm, np.nan)[:, None], np.array(batch.column("g").to_pylist(), object)


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, allow_same: bool = False, by: str | None = None, decimals: int = 6) -> DataFrame:
    """(query, neighbour, similarity, place): exact k nearest rows of each query by cosine, ties by id.

    The stated queries are written to the shared folder, where every task reads them in blocks of QUERY_BLOCK against its
    rows, once a batch; it keeps the k best of a batch for each query, and a window with a limit merges them. With `by` only
    rows of the query's group count, and null groups match none. Null and zero vectors and null ids are left out;
    similarities are rounded so that ties are stable.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"query {kind}, neighbour {kind}, similarity double"
    group = (F.col(by).cast("string") if by else F.lit("")).alias("g")
    pick = lambda d: d.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"), group).where("g is not null")
    usable, asked = pick(rows), stage(pick(queries))
    files = asked.inputFiles()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = list(_query_blocks(files)) if len(files) == 1 else None  # one small file stays in memory
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy()).astype(float)
            size = np.linalg.norm(x, axis=1)
            x = (x / np.where(size > 0, size, np.nan)[:, None]).T
            own_ids, own_groups = batch["id"].to_numpy(), batch["g"].to_numpy()
            for ids, q, groups in kept or _query_blocks(files):
                sim = np.round(q @ x, decimals)
                for s, query, g in zip(sim, ids, groups, strict=True):
                    at = np.flatnonzero(~np.isnan(s) & (own_groups == g) & ((own_ids != query) | allow_same))
                    if len(at):
                        top = at[np.lexsort((own_ids[at], -s[at]))[:k]]
                        yield pd.DataFrame({"query": query, "neighbour": own_ids[top], "similarity": s[top]})

    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return usable.mapInPandas(run, schema).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_trained(rows: DataFrame, id_col: str, vector: str, condition: str, split: str) -> DataFrame:
    """(query, neighbour, similarity): the nearest other training row of the same condition for every train or validation row.

    Validation rows see training rows only, training rows themselves excepted. A row alone in its condition has none.
    """
    sides = rows.where(F.col(split).isin("train", "validation"))
    return nearest(sides.where(F.col(split) == "train"), sides, id_col, vector, 1, by=condition).select("query", "neighbour", "similarity")


def softmax_label(neighbours: DataFrame, labels: DataFrame, id_col: str, label: str, temperature: float = 0.05) -> DataFrame:
    """(query, predicted): neighbours' labels weighted by exp(similarity / temperature)."""
    rows = neighbours.join(labels.select(F.col(id_col).alias("neighbour"), F.col(label).cast("double").alias("_y")), "neighbour")
    top = rows.groupBy("query").agg(F.max("similarity").alias("_m"))
    w = F.exp((F.col("similarity") - F.col("_m")) / temperature)
    return rows.join(top, "query").groupBy("query").agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("predicted"))


def centroids(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, pos, mean): the mean vector of each group in long form, summed partially."""
    return rows.where(F.col(vector).isNotNull()).select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroid_distance(rows: DataFrame, by: str, id_col: str, vector: str) -> DataFrame:
    """(id, by, distance): Euclidean distance of each vector to its group's mean; means are broadcast while small, else joined."""
    mean = centroids(rows, by, vector).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("_c"))
    d = F.sqrt(F.aggregate(F.zip_with(vector, "_c", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    return lookup_join(rows.where(F.col(vector).isNotNull()).select(id_col, by, vector), mean, [by], "inner", row_size=16_384).select(id_col, by, d.alias("distance"))


def ecdf(rows: DataFrame, by: str, value: str, reference: str) -> DataFrame:
    """rows with `percentile`, the share of the group's reference rows at or below each value; null without any.

    The step function is summed over distinct values in ranges, so a group of any size is spread.
    """
    steps = rows.groupBy(by, value).agg(F.count_if(reference).alias("_c"))
    share = F.try_divide(F.col("_before") + F.col("_c"), F.when(F.col("_total") > 0, F.col("_total"))).cast("double")
    return rows.join(ranged_sums(steps, value, "_c", [by]).select(by, value, share.alias("percentile")), [by, value])


def consensus(rows: DataFrame, by: str, seq: str) -> DataFrame:
    """(by, consensus): the most frequent letter of each position, the smallest among equals, up to the longest sequence."""
    chars = rows.where(F.coalesce(F.col(seq), F.lit("")) != "").select(by, F.posexplode(F.filter(F.split(seq, ""), lambda c: c != "")).alias("pos", "c")).groupBy(by, "pos", "c").agg(F.count("*").alias("n"))
    best = chars.groupBy(by, "pos").agg(F.min(F.struct((-F.col("n")).alias("neg"), "c")).alias("b"))
    return best.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("b.c").alias("c")))), lambda s: s["c"]), "").alias("consensus"))


def cluster_report(rows: DataFrame, by: str, held: str, far: float = 0.9) -> DataFrame:
    """Of each cluster: training and validation rows, their median distances, and the share of validation rows from the percentile `far` on."""
    mine = lambda test, c: F.when(test, F.col(c))
    return rows.groupBy(by).agg(
        F.count_if(~F.col(held)).alias("train"), F.count_if(held).alias("validation"), F.round(F.median(mine(~F.col(held), "distance")), 6).alias("train_median"), F.round(F.median(mine(F.col(held), "distance")), 6).alias("validation_median"),
        F.round(F.avg(F.when(F.col(held), (F.col("percentile") >= far).cast("int"))), 6).alias("far_share"),
    )


def bins(value: Column) -> Column:
    return F.when(value <= 0.5, "near").when(value <= 0.9, "middle").when(value.isNotNull(), "far")


def chain_embeddings(rows: DataFrame, store: DataFrame, heavy: str, light: str, size: int) -> DataFrame:
    """rows with `heavy_vector` and `light_vector` from a store of (sequence, embedding); a missing light chain is the zero vector.

    Rows whose heavy chain the store lacks are left out.
    """
    zero = F.array_repeat(F.lit(0.0), size)
    one = store.groupBy("sequence").agg(F.first("embedding").alias("_e"))
    side = lambda c, name: one.select(F.col("sequence").alias(c), F.transform("_e", lambda x: x.cast("double")).alias(name))
    return rows.join(side(heavy, "heavy_vector"), heavy).join(side(light, "_l"), light, "left").withColumn("light_vector", F.coalesce("_l", zero)).drop("_l")


def interaction_features(a: Column, b: Column) -> Column:
    """Both vectors, their absolute difference and their product, one after the other."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))
