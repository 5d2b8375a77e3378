"""Records that differ only in how they are written, collapsed into one each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.session import stage


def canonical_text(text: Column) -> Column:
    """Lower-cased letters and digits only; null, blank and pure punctuation all become ''."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def canonical_key(swappable: list[str], others: list[str]) -> Column:
    """16-byte digest of the canonical cells; the cells of `swappable` count as a bag, so their order is no difference."""
    bag = F.array_sort(F.array(*[canonical_text(F.col(c)) for c in swappable]))
    return F.unhex(F.md5(F.concat_ws("\u001f", bag, *[canonical_text(F.col(c)) for c in others])))


def formatting_groups(df: DataFrame, id_col: str, swappable: list[str], others: list[str], hot_share: int = 4, hot_least: int = 10_000) -> DataFrame:
    """(key, first_id, copies) for every distinct canonical record.

    Hot keys are found exactly: row counts of 65,536 key buckets show the only buckets that can hold a key
    of `threshold` rows, and the keys of those buckets are counted. threshold is 1/hot_share of a partition's
    even share, hot_least at least, so there are at most hot_share * partitions hot keys, and only they are
    broadcast. Their rows are aggregated by (key, salt) and then by key; all other keys in one shuffle of
    24-byte rows. The representative is the smallest id.

    Nulls, blanks and punctuation-only cells are equal; rows without an id count as copies but cannot stand
    for their group unless none has an id (first_id is then null). An empty table gives no rows. Extra columns are ignored.
    """
    spark = df.sparkSession
    keyed = stage(df.select(F.col(id_col).alias("_id"), canonical_key(swappable, others).alias("key")))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("key"), F.lit(65_536)).cast("int")
    sizes = keyed.groupBy(bucket.alias("bucket")).count().collect()  # 65,536 rows at most
    threshold = max(hot_least, sum(r["count"] for r in sizes) // (hot_share * parts))
    full = [r["bucket"] for r in sizes if r["count"] >= threshold]
    hot = []
    if full:
        counted = keyed.where(bucket.isin(full)).groupBy("key").count()
        hot = [r["key"] for r in counted.where(F.col("count") >= threshold).collect()]  # at most hot_share * parts keys
    one = [F.min("_id").alias("first_id"), F.count("*").alias("copies")]
    if not hot:
        return keyed.groupBy("key").agg(*one)
    known = spark.createDataFrame([(bytes(k),) for k in hot], "key binary")
    cold = keyed.join(F.broadcast(known), "key", "left_anti").groupBy("key").agg(*one)
    salted = keyed.join(F.broadcast(known), "key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(parts)))
    warm = salted.groupBy("key", "salt").agg(*one).groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    return cold.union(warm)


def collapse_formatting(df: DataFrame, id_col: str, swappable: list[str], others: list[str]) -> DataFrame:
    """The representative row of every group, all columns kept, with its number of copies in `_copies`.

    The row with the smallest id stands for its group; ids are unique.
    """
    groups = formatting_groups(df, id_col, swappable, others).select(F.col("first_id").alias("_first"), F.col("copies").alias("_copies"))
    return df.join(groups, df[id_col] == groups["_first"]).drop("_first")
