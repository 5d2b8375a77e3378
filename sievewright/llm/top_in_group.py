"""The N best items of every group, read from score-clustered files whose statistics rule out row groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.session import new_path, stage

_FOOTER = "file string, row_group int, n long, g_min string, g_max string, v_min double, v_max double"


def _open(path: str):
    from urllib.parse import unquote

    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + unquote(path.removeprefix("file:")))
    return pq.ParquetFile(at, filesystem=system)


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["file"]:
            meta = _open(path).metadata
            names = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            for k in range(meta.num_row_groups):
                group = meta.row_group(k)
                g, v = (group.column(names[c]).statistics for c in ("grp", "val"))
                known = [x is not None and x.has_min_max for x in (g, v)]
                rows.append((path, k, group.num_rows, *((g.min, g.max) if known[0] else (None, None)), *((v.min, v.max) if known[1] else (None, None))))
        yield pd.DataFrame(rows, columns=["file", "row_group", "n", "g_min", "g_max", "v_min", "v_max"])


def cluster_by_group(items: DataFrame, group: str, item: str, value: str, row_group_bytes: int = 1 << 18, hot_least: int = 50_000) -> str:
    """Write (grp, item, val) to the shared folder, clustered by group and sorted by group and falling value; returns the path.

    A group with more than an even share of one partition is spread over as many files as it fills, so a
    group of any size never meets one task; there are at most as many such groups as partitions.
    """
    spark = items.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = stage(items.select(F.col(group).cast("string").alias("grp"), F.col(item).alias("item"), F.col(value).cast("double").alias("val")))
    counts = rows.groupBy("grp").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    share = max(hot_least, total // parts + 1)
    hot = counts.where(F.col("count") > share).select("grp", F.ceil(F.col("count") / share).cast("int").alias("_n"))  # at most `parts` groups
    spread = rows.join(F.broadcast(hot), "grp", "left").withColumn("_s", F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("item"), F.col("_n"))))
    path = new_path(spark)
    spread.repartition(parts, "grp", "_s").sortWithinPartitions("grp", F.desc("val")).select("grp", "item", "val").write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", min(row_group_bytes, 1 << 16)).parquet(path)
    return path


def skipped_read(spark, path: str, n: int, item_type: T.DataType, value_bounds: bool = True) -> DataFrame:
    """(grp, item, val): all rows of the clustered table that can be among the n best of their group, ties included.

    The footers give every row group's range of groups and values. A row group that holds one group only is
    left out if its maximum is strictly below a value that n rows of its group are known to reach: first by the
    footers of all files, then, while the files are read in descending maximum, by the rows seen.
    """
    files = spark.read.parquet(path).inputFiles()
    if not files:
        return spark.createDataFrame([], T.StructType([T.StructField("grp", T.StringType()), T.StructField("item", item_type), T.StructField("val", T.DoubleType())]))
    slices = len(files)  # one reader a file, whatever their number
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(slices)
    groups = listed.mapInPandas(_footers, _FOOTER)
    alone = F.col("g_min") == F.col("g_max")
    floors = groups.where(alone & (F.col("n") >= n)).groupBy(F.col("g_min").alias("g")).agg(F.max("v_min").alias("floor"))
    kept = groups.join(floors, alone & (F.col("g_min") == F.col("g")), "left").where(F.col("floor").isNull() | F.col("v_max").isNull() | (F.col("v_max") >= F.col("floor")) | F.lit(not value_bounds))
    out = T.StructType([T.StructField("grp", T.StringType()), T.StructField("item", item_type), T.StructField("val", T.DoubleType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for path, own in batch.groupby("file", sort=False):
                file, floor = _open(path), {}
                for r in own.sort_values("v_max", ascending=False, na_position="first").itertuples():
                    single = r.g_min is not None and r.g_min == r.g_max
                    if value_bounds and single and r.v_max < floor.get(r.g_min, -np.inf):
                        continue
                    t = file.read_row_group(r.row_group, columns=["grp", "item", "val"]).to_pandas()
                    if not len(t):
                        continue
                    g, v = t["grp"].to_numpy(), t["val"].to_numpy()
                    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                    end = np.r_[start[1:], len(g)]
                    nth = v[np.minimum(start + n - 1, end - 1)]  # sorted by falling value within a group
                    if single and len(g) >= n:
                        floor[r.g_min] = max(floor.get(r.g_min, -np.inf), nth[0])
                    yield t[v >= np.repeat(nth, end - start)]

    return kept.repartition(slices, "file").mapInPandas(read, out)


def top_in_group(items: DataFrame, group: str, item: str, value: str, n: int = 10, tie: DataFrame | None = None, tie_value: str = "tie", row_group_bytes: int = 1 << 18) -> DataFrame:
    """(group, item, value, place): the n best items of each group by value descending, then smallest tie value (none last), then item.

    `items` holds one row an item; rows without group, item or value, and NaN, are left out; groups are compared as
    stored. `tie` holds (item, tie_value), repeats allowed, the smallest counts. Ties at the n-th value reach the final
    ranking whole. The last step is row_number under a limit, which Spark prunes before it shuffles. An empty table gives no rows.
    """
    spark = items.sparkSession
    usable = items.where(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    path = cluster_by_group(usable, group, item, value, row_group_bytes)
    best = skipped_read(spark, path, n, items.schema[item].dataType)
    if tie is not None:
        places = tie.where(F.col(tie_value).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.min(tie_value).alias("_tie"))
        best = best.join(places, "item", "left")
    else:
        best = best.withColumn("_tie", F.lit(None).cast("int"))
    order = Window.partitionBy("grp").orderBy(F.desc("val"), F.asc_nulls_last("_tie"), "item")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(F.col("grp").alias(group), F.col("item").alias(item), F.col("val").alias(value), "place")
