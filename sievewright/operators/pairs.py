"""Preference pairs within comparison groups: sampled candidates, rank offsets, cyclic neighbours, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.ranks import with_row_number
from sievewright.session import stage


def pair_weight(gap: Column, scale: Column, q1: Column, q2: Column, censored: Column, conflict: Column) -> Column:
    """Product of both qualities, the gap against the group's range, half for a censored side and what conflict leaves."""
    share = F.when(scale > 0, F.least(F.lit(1.0), gap / scale)).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), q1 * q2 * share * F.when(censored, 0.5).otherwise(1.0) * (F.lit(1.0) - conflict)))


def _drawn(seed: int, group: Column, t: Column, side: str, size: Column) -> Column:
    text = F.concat_ws("|", F.lit(f"{seed}{side}"), group, t.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") % size).cast("bigint")


def preference_pairs(records: DataFrame, min_gap: float = 0.0, per_group: int = 100_000, total: int = 1_000_000, seed: int = 42) -> DataFrame:
    """(left_record_id, right_record_id, preference, pair_weight, comparison_group, reason), the better record left.

    records: record_id unique, label, quality, is_censored, conflict, split, comparison_group. A group may give
    limit = max(1, min(per_group, total // groups)) pairs. A group with at most 3 * limit pairs tries them all; a larger
    one tries 3 * limit hash-drawn pairs of places, so no group is ever joined with itself whole. Kept are pairs
    of one split (a blank one fits any) with a gap above min_gap, not both censored, with a positive weight; of those the
    `limit` with the smallest SHA-256 of seed and ids. Records without id, label or group are left out.
    """
    rows = records.where(F.col("record_id").isNotNull() & F.col("label").isNotNull() & (F.coalesce("comparison_group", F.lit("")) != ""))
    placed = stage(with_row_number(rows, [F.col("label"), F.col("record_id")], ["comparison_group"], "_i").withColumn("_i", F.col("_i") - 1))
    groups = placed.groupBy("comparison_group").agg(F.count("*").alias("_n"), (F.max("label") - F.min("label")).alias("_range"))
    limit = max(1, min(per_group, total // max(1, groups.count())))
    n = F.col("_n")
    all_pairs = n * (n - 1) / 2 <= 3 * limit
    base = groups.where("_n > 1")
    small = base.where(all_pairs).select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 2)).alias("_a")).select("*", F.explode(F.sequence(F.col("_a") + 1, n - 1)).alias("_b"))
    drawn = base.where(~all_pairs).select("*", F.explode(F.sequence(F.lit(0), F.lit(3 * limit - 1))).alias("_t"))
    first = _drawn(seed, F.col("comparison_group"), F.col("_t"), "a", n)
    second = _drawn(seed, F.col("comparison_group"), F.col("_t"), "b", n - 1)
    drawn = drawn.select(*base.columns, first.alias("_x"), second.alias("_y")).withColumn("_y", F.when(F.col("_y") >= F.col("_x"), F.col("_y") + 1).otherwise(F.col("_y")))
    drawn = drawn.select(*base.columns, F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b")).distinct()
    places = small.unionByName(drawn)
    side = lambda s, k: placed.select("comparison_group", F.col("_i").alias(k), *[F.col(c).alias(f"{s}_{c}") for c in ("record_id", "label", "quality", "is_censored", "conflict", "split")])
    met = places.join(side("w", "_a"), ["comparison_group", "_a"]).join(side("b", "_b"), ["comparison_group", "_b"])
    gap = F.col("b_label") - F.col("w_label")
    either = F.col("b_is_censored") | F.col("w_is_censored")
    conflict = F.greatest("b_conflict", "w_conflict")
    same = (F.coalesce("b_split", F.lit("")) == "") | (F.coalesce("w_split", F.lit("")) == "") | (F.col("b_split") == F.col("w_split"))
    weight = pair_weight(gap, F.col("_range"), F.col("b_quality"), F.col("w_quality"), either, conflict)
    reason = F.concat_ws("+", F.lit("ordered_label"), F.when(either, "censored_downweighted"), F.when(conflict > 0, "conflict_downweighted"))
    kept = met.where(same & (gap > min_gap) & ~(F.col("b_is_censored") & F.col("w_is_censored"))).select(F.col("b_record_id").alias("left_record_id"), F.col("w_record_id").alias("right_record_id"), F.lit(1).alias("preference"), weight.alias("pair_weight"), "comparison_group", reason.alias("reason")).where("pair_weight > 0")
    order = Window.partitionBy("comparison_group").orderBy(F.sha2(F.concat_ws("\u001f", F.lit(str(seed)), "left_record_id", "right_record_id"), 256))
    return kept.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def rank_offset_pairs(records: DataFrame, id_col: str, score: str, group: str, offsets: tuple[float, ...] = (0.05, 0.25, 0.5, 1.0), least_gap: float = 0.1) -> DataFrame:
    """(comparison group, better, worse): each record against those at fixed shares of its group further up, gap permitting."""
    rows = stage(with_row_number(df_scored := records.where(F.col(score).isNotNull() & F.col(group).isNotNull()), [F.col(score), F.col(id_col)], [group], "_i"))
    sizes = df_scored.groupBy(group).agg(F.count("*").alias("_n"))
    steps = F.array(*[F.lit(float(f)) for f in offsets])
    step = F.greatest(F.lit(1).cast("long"), F.bround((F.col("_n") - 1) * F.col("_f")).cast("long"))
    low = rows.join(sizes, group).where("_i < _n").select(group, F.col(id_col).alias("worse"), F.col(score).alias("_s"), "_i", "_n", F.explode(steps).alias("_f")).withColumn("_j", F.least(F.col("_n"), F.col("_i") + step))
    high = rows.select(group, F.col(id_col).alias("better"), F.col(score).alias("_h"), F.col("_i").alias("_j"))
    return low.join(high, [group, "_j"]).where(F.col("_h") - F.col("_s") >= least_gap).select(group, "better", "worse").distinct()


def cyclic_pairs(df: DataFrame, id_col: str, group: str) -> DataFrame:
    """(group, id, partner): each row with the one before it in its group, the first with the last."""
    rows = stage(with_row_number(df.where(F.col(group).isNotNull()), [F.col(id_col)], [group], "_i").select(group, id_col, "_i"))
    size = rows.groupBy(group).agg(F.max("_i").alias("_n"))
    prev = rows.select(group, F.col(id_col).alias("partner"), F.col("_i").alias("_j"))
    return rows.join(size, group).withColumn("_j", F.when(F.col("_i") == 1, F.col("_n")).otherwise(F.col("_i") - 1)).join(prev, [group, "_j"]).select(group, id_col, "partner")


def validate_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(check, violations): duplicate pairs, unknown ids, preference off -1/1, weight off (0, 1], group or split differing, wrong direction, both censored."""
    side = lambda s: records.select(F.col("record_id").alias(f"{s}_record_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("label", "is_censored", "split", "comparison_group")])
    rows = pairs.join(side("left"), "left_record_id", "left").join(side("right"), "right_record_id", "left")
    known = F.col("left_comparison_group").isNotNull() & F.col("right_comparison_group").isNotNull()
    off = F.when(F.col("preference") == 1, F.col("left_label") <= F.col("right_label")).otherwise(F.col("left_label") >= F.col("right_label"))
    apart = (F.coalesce("left_split", F.lit("")) != "") & (F.coalesce("right_split", F.lit("")) != "") & (F.col("left_split") != F.col("right_split"))
    checks = {
        "unknown_id": ~known, "bad_preference": ~F.col("preference").isin(-1, 1), "bad_weight": ~((F.col("pair_weight") > 0) & (F.col("pair_weight") <= 1)),
        "cross_group": known & (F.col("left_comparison_group") != F.col("right_comparison_group")), "cross_split": known & apart, "wrong_direction": known & off, "both_censored": known & F.col("left_is_censored") & F.col("right_is_censored"),
    }
    one = rows.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    twice = pairs.groupBy("left_record_id", "right_record_id").count().where("count > 1").agg(F.count("*").alias("duplicate_pair"))
    long = one.select(F.explode(F.create_map(*[x for n in checks for x in (F.lit(n), F.col(n))])).alias("check", "violations"))
    return long.union(twice.select(F.lit("duplicate_pair"), F.col("duplicate_pair")))


def pair_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs and the range and mean of their weights, by group, reason or any other columns."""
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.min("pair_weight").alias("weight_min"), F.avg("pair_weight").alias("weight_mean"), F.max("pair_weight").alias("weight_max"))
