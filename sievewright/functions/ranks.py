"""Tie-aware ranks, row numbers and percentiles that hold for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.session import lookup_join, stage

#: Largest group that one task may rank by a window; larger ones take ranged prefix sums.
WINDOW_ROWS = 4_000_000

#: Most offsets of ranged sums that are broadcast; more are joined by a shuffle.
OFFSET_ROWS = 100_000


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group; null groups are a group."""
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def ranged_sums(amounts: DataFrame, value: str, amount: str, by: list[str]) -> DataFrame:
    """amounts, one row a (by, value), with `_before`, the sum of `amount` over smaller values of the group, and `_total`, its whole sum.

    Values are range-partitioned and staged, so that a group of any size is spread over partitions; offsets come
    from the totals of (partition, group), of which a group has one a partition at most.
    """
    parts = max(8, int(amounts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(amounts.repartitionByRange(parts, *by, value).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_range").agg(F.sum(amount).alias("_range_sum"))
    order = Window.partitionBy(*by).orderBy("_range")
    offsets = totals.select(*by, "_range", (F.sum("_range_sum").over(order) - F.col("_range_sum")).alias("_off"), F.sum("_range_sum").over(Window.partitionBy(*by)).alias("_total"))
    if totals.limit(OFFSET_ROWS + 1).count() <= OFFSET_ROWS:
        offsets = F.broadcast(offsets)
    within = Window.partitionBy("_range", *by).orderBy(value)
    running = ranged.withColumn("_run", F.sum(amount).over(within) - F.col(amount))
    same = [running[b].eqNullSafe(offsets[b]) for b in by]
    joined = running.join(offsets, [*same, running["_range"] == offsets["_range"]])
    return joined.select(*[running[c] for c in amounts.columns], (offsets["_off"] + running["_run"]).alias("_before"), offsets["_total"])


def _ranged_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct (by, value) with their count, the rows of the group before them and the group's size."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    return ranged_sums(counts, value, "_c", by).withColumnRenamed("_total", "_n")


def with_ranks(df: DataFrame, value: Column, by: list[str], rank: str = "_rank", size: str = "_n", window_rows: int = WINDOW_ROWS, largest: int | None = None) -> DataFrame:
    """df with the rank of value within its group, from 1 in rising order with ties at the mean of their places, and the group's size.

    Over a unique value this is the row number. While every group fits one task, one window does it; beyond that the
    distinct values are ranked in ranges and looked up. Null groups are a group; values are not null. `largest`, if the
    caller has counted the largest group before, saves counting it.
    """
    keys = [f"_by_{i}" for i in range(max(1, len(by)))]
    rows = df.select("*", value.alias("_val"), *([F.coalesce(F.col(b).cast("string"), F.lit("\u0000")).alias(k) for b, k in zip(by, keys, strict=True)] if by else [F.lit(0).alias(keys[0])]))
    if (largest_group(rows, keys) if largest is None else largest) <= window_rows:
        group = Window.partitionBy(*keys)
        out = rows.select("*", F.rank().over(group.orderBy("_val")).alias("_low"), F.count("*").over(Window.partitionBy(*keys, "_val")).alias("_c"), F.count("*").over(group).alias(size))
        return out.withColumn(rank, F.col("_low") + (F.col("_c") - 1) / F.lit(2.0)).drop("_val", "_low", "_c", *keys)
    dim = _ranged_ranks(rows, "_val", keys).withColumnRenamed("_n", size).withColumn(rank, F.col("_before") + (F.col("_c") + 1) / F.lit(2.0)).drop("_c", "_before")
    return lookup_join(rows, stage(dim), [*keys, "_val"], "left").drop("_val", *keys)


def percentile_score(rank: Column, size: Column) -> Column:
    """Rank from 0 over n - 1; 0.5 for a group of one."""
    return F.when(size == 1, F.lit(0.5)).otherwise((rank - 1) / (size - 1))


def with_percentile(df: DataFrame, value: Column, by: list[str], name: str) -> DataFrame:
    ranked = with_ranks(df, value, by, "_rk", "_sz")
    return ranked.withColumn(name, percentile_score(F.col("_rk"), F.col("_sz"))).drop("_rk", "_sz")


def with_rank_over_n(df: DataFrame, value: Column, by: list[str], name: str, plus: int = 0) -> DataFrame:
    """Average rank over n, or over n + 1 with plus = 1."""
    ranked = with_ranks(df, value, by, "_rk", "_sz")
    return ranked.withColumn(name, F.col("_rk") / (F.col("_sz") + plus)).drop("_rk", "_sz")


def with_row_number(df: DataFrame, order: list[Column], by: list[str], name: str, largest: int | None = None, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Row number from 1 by an order that ends in a unique column.

    Groups that no window holds are numbered where their rows lie once these are range-partitioned, without a lookup.
    """
    if (largest_group(df, by) if largest is None else largest) <= window_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)).cast("long"))
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rows = df.select("*", place.alias("_row_place"), F.lit(1).alias("_row_one"))
    return ranged_sums(rows, "_row_place", "_row_one", by).withColumn(name, F.col("_before") + 1).drop("_row_place", "_row_one", "_before", "_total")


def over_mean(df: DataFrame, weight: Column, name: str) -> DataFrame:
    """A weight divided by its mean over all rows; all weights zero raise."""
    rows = df.withColumn("_w", weight)
    mean = rows.agg(F.avg("_w")).first()[0]
    if mean is not None and mean <= 0:
        raise ValueError("no row has a positive weight")
    return rows.withColumn(name, F.col("_w") / F.lit(mean if mean is not None else 1.0)).drop("_w")
