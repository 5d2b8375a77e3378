"""Row weights that balance sources and qualities, and replicate handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.ranks import over_mean, ranged_sums
from sievewright.session import lookup_join, stage


def _with_count(df: DataFrame, source: str) -> DataFrame:
    counts = df.groupBy(source).agg(F.count("*").alias("_count"))
    return lookup_join(df, counts, [source], "inner", row_size=64)


def source_balance(df: DataFrame, source: str, power: float, name: str = "weight") -> DataFrame:
    """count ** -power of the row's source over its mean; 0 leaves rows equal, 1 sources. Rows without a source are left out."""
    if not 0 <= power <= 1:
        raise ValueError("power must lie in 0..1")
    return over_mean(_with_count(df, source), F.pow(F.col("_count").cast("double"), F.lit(-power)), name).drop("_count")


def temperature(df: DataFrame, source: str, quality: Column, alpha: float = 0.4, cap: int = 200_000, name: str = "weight") -> DataFrame:
    """min(count, cap) ** alpha / count * quality over the mean, so a source's mass grows as its size to the alpha."""
    if not 0 <= alpha <= 1 or cap <= 0:
        raise ValueError("alpha must lie in 0..1 and cap above 0")
    n = F.col("_count").cast("double")
    weight = F.pow(F.least(n, F.lit(float(cap))), F.lit(alpha)) / n * F.greatest(F.lit(0.0), F.coalesce(quality, F.lit(0.0)))
    return over_mean(_with_count(df, source), weight, name).drop("_count")


def collapse_replicates(df: DataFrame, keys: list[str], score: str, power: float) -> DataFrame:
    """Mean score and count of each key, with `copy` from 1 to max(1, round(count ** power))."""
    one = df.groupBy(*keys).agg(F.avg(score).alias("score"), F.count("*").alias("replicates"))
    times = F.greatest(F.lit(1), F.bround(F.pow(F.col("replicates").cast("double"), F.lit(power))).cast("int"))
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def group_means(df: DataFrame, keys: list[str], score: str, source: str | None = None) -> DataFrame:
    """Mean score of each key, and how many sources it has if one is named."""
    extra = [F.count_distinct(source).alias("source_count")] if source else []
    return df.groupBy(*keys).agg(F.avg(score).alias("score"), *extra)


def weighted_draws(df: DataFrame, id_col: str, weight: Column, size: int, seed: int) -> DataFrame:
    """df with `times`: `size` draws with replacement in proportion to the weight; rows drawn 0 times are left out.

    The weights of all rows stand in one line in the order of the ids, summed in ranges; draw i falls on the place that the
    MD5 of seed and i gives. Rows and draws meet in as many cells of the line as there are draws, so no task holds them all.
    Rows without a positive weight are never drawn; if none has one there are no rows. Ids are unique.
    """
    rows = df.withColumn("_w", F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))).where("_w > 0")
    line = stage(ranged_sums(rows.select(F.col(id_col).alias("_id"), "_w"), "_id", "_w", []))
    cell = lambda x: F.least(F.floor(x / F.col("_total") * size), F.lit(size - 1))
    spread = line.withColumn("_cell", F.explode(F.sequence(cell(F.col("_before")), cell(F.col("_before") + F.col("_w")))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") / F.lit(2.0**48)
    draws = df.sparkSession.range(size).select(u.alias("_u"), F.least(F.floor(u * size), F.lit(size - 1)).alias("_cell"))
    place = F.col("_u") * F.col("_total")
    drawn = spread.join(draws, "_cell").where((place >= F.col("_before")) & (place < F.col("_before") + F.col("_w")))
    times = drawn.groupBy("_id").agg(F.count("*").alias("times"))
    return df.join(times, df[id_col] == times["_id"]).drop("_id")
