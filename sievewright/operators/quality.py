"""Profiles, dataset validation, curation counters and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.ranks import with_ranks
from sievewright.functions.sequences import RESIDUES, sequence_state
from sievewright.functions.values import finite
from sievewright.operators.metrics import safe_correlation


def file_profile(df: DataFrame, by: str, sequences: list[str], label: str) -> DataFrame:
    """Rows, states and lengths of each sequence column and the label's range, one row a file."""
    df = df.select(by, label, *[sequence_state(F.col(c)).alias(f"_s_{c}") for c in sequences])  # each state is computed once
    aggs = [F.count("*").alias("rows")]
    for c in sequences:
        s = F.col(f"_s_{c}")
        for state in ("missing", "valid", "invalid"):
            aggs.append(F.count_if(s["state"] == state).alias(f"{c}_{state}"))
        n = F.when(s["sequence"] != "", F.length(s["sequence"]))
        aggs += [F.min(n).alias(f"{c}_min"), F.avg(n).alias(f"{c}_mean"), F.max(n).alias(f"{c}_max")]
    v = finite(F.col(label).cast("double"))
    return df.groupBy(by).agg(*aggs, F.count(v).alias("labels"), F.min(v).alias("label_min"), F.avg(v).alias("label_mean"), F.max(v).alias("label_max"))


def profile_totals(profile: DataFrame, sums: list[str]) -> DataFrame:
    """Totals over files, and how many files have any of each."""
    return profile.agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in sums], *[F.count_if(F.col(c) > 0).alias(f"files_with_{c}") for c in sums])


def label_profile(df: DataFrame, by: list[str], text: str, number: Column, censored: Column) -> DataFrame:
    """Numeric, missing and censored cells, distinct numbers and their range by group."""
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count(number).alias("numeric"), F.count_if(blank).alias("missing"), F.count_if(censored).alias("censored"), F.count_distinct(number).alias("unique_values"), F.min(number).alias("low"), F.max(number).alias("high"))


def label_agreement(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation of two label columns by group, null under three pairs; rows that lack one of them are left out."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c, name in ((a, "_ra"), (b, "_rb")):
        rows = with_ranks(rows, F.col(c), by, name, f"{name}_n")
    return rows.groupBy(*by).agg(F.count("*").alias("pairs"), safe_correlation("_ra", "_rb").alias("spearman"))


def validation_report(df: DataFrame, id_col: str, sequences: list[str], score: str, direction: str, split: list[str], keys: dict[str, Column]) -> DataFrame:
    """(check, violations): repeated ids, bad residues, scores off 0..1, directions off -1/0/1, and of each split column its blanks and the keys in several splits.

    Null keys and null splits tell nothing. Each key is aggregated by itself, so one that a third of all rows share is no burden.
    """
    one = df.agg(
        *[F.count_if((F.coalesce(F.col(c), F.lit("")) != "") & ~F.col(c).rlike(rf"^[{RESIDUES}]+\z")).alias(f"bad_{c}") for c in sequences],
        F.count_if(F.col(score).isNotNull() & ~F.col(score).between(0.0, 1.0)).alias("score_range"),
        F.count_if(~F.col(direction).isin(-1, 0, 1)).alias("direction_domain"),
        *[F.count_if(F.coalesce(F.trim(s), F.lit("")) == "").alias(f"blank_{s}") for s in split],
    )
    names = one.columns
    out = one.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("check", "violations"))
    out = out.union(df.groupBy(id_col).count().where("count > 1").agg(F.count("*").alias("v")).select(F.lit("repeated_id"), "v"))
    for s in split:
        told = F.explode(F.array(*[F.struct(F.lit(f"{n}_in_{s}s").alias("check"), c.cast("string").alias("k")) for n, c in keys.items()]))
        long = df.where(F.col(s).isNotNull()).select(told.alias("x"), F.col(s).alias("s")).where("x.k is not null").select("x.check", "x.k", "s")
        bad = long.groupBy("check", "k").agg((F.min("s") < F.max("s")).cast("long").alias("v")).groupBy("check").agg(F.sum("v").alias("v"))
        out = out.union(bad)
    return out


def key_stats(df: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """(key, rows, groups, first_group): how often and where each key occurs, first by an explicit order."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"), F.min_by(group, order).alias("first_group"))


def dispositions(df: DataFrame, by: str, rules: list[tuple[str, Column]], rest: str = "curated") -> DataFrame:
    """(by, one count a disposition): each row falls under the first rule that holds."""
    chosen = F.lit(rest)
    for name, test in reversed(rules):
        chosen = F.when(F.coalesce(test, F.lit(False)), name).otherwise(chosen)
    tagged = df.select(by, chosen.alias("_d"))
    return tagged.groupBy(by).agg(*[F.count_if(F.col("_d") == n).alias(n) for n in [*[n for n, _ in rules], rest]])


def curation_counters(df: DataFrame, by: str, rules: list[tuple[str, Column]], kept: list[str], key: Column, group: str, order: str, rest: str = "curated") -> DataFrame:
    """(by, one count a disposition, repeated, cross_group): each row under the first rule that holds.

    Of the rows whose disposition is in `kept`, repeated are those whose key an earlier one (by `order`) has, cross_group
    those of them whose first one lies in another group. A key's first row is found by a partial minimum, not a window.
    """
    chosen = F.lit(rest)
    for name, test in reversed(rules):
        chosen = F.when(F.coalesce(test, F.lit(False)), name).otherwise(chosen)
    rows = df.select(by, chosen.alias("_d"), key.alias("_k"), F.col(group).alias("_g"), F.col(order).alias("_o"))
    first = rows.where(F.col("_d").isin(kept)).groupBy("_k").agg(F.min("_o").alias("_first"), F.min_by("_g", "_o").alias("_fg"))
    met = rows.withColumn("_key", F.when(F.col("_d").isin(kept), F.col("_k"))).join(first.withColumnRenamed("_k", "_key"), "_key", "left")
    again = F.col("_o") > F.col("_first")
    return met.groupBy(by).agg(*[F.count_if(F.col("_d") == n).alias(n) for n in [n for n, _ in rules] + [rest]], F.count_if(again).alias("repeated"), F.count_if(again & (F.col("_fg") != F.col("_g"))).alias("cross_group"))


def duplicate_contents(df: DataFrame, content: Column, id_col: str) -> DataFrame:
    """(digest, copies, first_id) of contents that occur more than once."""
    return df.select(F.sha2(content, 256).alias("digest"), F.col(id_col).alias("_i")).where("digest is not null").groupBy("digest").agg(F.count("*").alias("copies"), F.min("_i").alias("first_id")).where("copies > 1")


def size_histogram(df: DataFrame, by: list[str]) -> DataFrame:
    """(size, groups): how many groups have each number of rows."""
    return df.groupBy(*by).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def flag_counts(df: DataFrame, flags: dict[str, Column], weight: str) -> DataFrame:
    """(issue, rows, weight): how many rows raise each issue, and their weight."""
    raised = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in flags.items()]))
    return df.select(F.explode(raised).alias("issue"), weight).groupBy("issue").agg(F.count("*").alias("rows"), F.sum(weight).alias("weight"))


def coverage_gap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables holds."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left_only")).union(y.join(x, key, "left_anti").withColumn("side", F.lit("right_only")))
