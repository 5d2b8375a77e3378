"""Deterministic splits, leakage checks and purges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions.ranks import with_row_number
from sievewright.functions.values import hashed_split, stable_bucket
from sievewright.operators.graph import connected_components
from sievewright.session import lookup_join, stage

#: Splits in the order in which a key's records are kept when it occurs in several.
PRIORITY = {"test": 0, "validation": 1, "train": 2}
#: Places among groups of one size that a task of the greedy balance deals.
DEALT = 100_000


def group_hash_split(df: DataFrame, group: str, train: float = 0.70, validation: float = 0.15, few: str | None = None) -> DataFrame:
    """(group, split): distinct groups in SHA-256 order, the first share to train, the next to validation.

    Counts are rounded half to even and at least one; if no group were left for test, all but two go to train. Fewer than
    three groups raise, or all take the split `few` if that is given.
    """
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    n = groups.count()
    if n < 3:
        if few is None:
            raise ValueError("at least three groups are needed")
        return groups.withColumn("split", F.lit(few))
    a, b = max(1, round(n * train)), max(1, round(n * validation))
    if a + b >= n:
        a, b = n - 2, 1
    placed = with_row_number(groups, [F.sha2(F.col(group), 256), F.col(group)], [], "_k")
    return placed.select(group, F.when(F.col("_k") <= a, "train").when(F.col("_k") <= a + b, "validation").otherwise("test").alias("split"))


def identity_split(df: DataFrame, key: Column, name: str = "split") -> DataFrame:
    """df with a split by the hash of an identity key: equal keys share it. A blank key raises; an existing column too."""
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, F.when(F.coalesce(key, F.lit("")) == "", F.raise_error(F.lit("identity key is blank")).cast("string")).otherwise(hashed_split(key)))


def source_held_out(df: DataFrame, group: str, percent: int) -> DataFrame:
    """(group, split): groups whose bucket lies under `percent` are test; never none, never all of several."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct().select(group, (stable_bucket(F.col(group)) < percent).alias("hit"))
    low, high, hits, n = groups.agg(F.min(group), F.max(group), F.count_if("hit"), F.count("*")).first()
    test = F.col("hit")
    if n and not hits:
        test = F.col(group) == high
    elif n > 1 and hits == n:
        test = F.col(group) != low
    return groups.select(group, F.when(test, "test").otherwise("train").alias("split"))


def _dealt(load: list[float], target: list[float], size: float, picks: int) -> list[float]:
    """The loads after `picks` groups of one size went to the split with the least load against its target, ties by place.

    The k-th group of a split is dealt when its ratio is (load + k * size) / target, so the picks are the smallest of these
    numbers: all but a few are counted at once under the common level they reach, the rest are dealt one by one.
    """
    load = list(load)
    sure = picks - 4 * len(load)
    if sure > 0:
        low, high = 0.0, (max(load) + size * picks) / min(target)
        count = lambda level: [max(0, int((level * t - x) / size) - 1) for x, t in zip(load, target, strict=True)]
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(count(middle)) <= sure else (low, middle)
        done = count(low)
        load = [x + n * size for x, n in zip(load, done, strict=True)]
        picks -= sum(done)
    for _ in range(picks):
        load[_least(load, target)] += size
    return load


def _least(load: list[float], target: list[float]) -> int:
    return min(range(len(load)), key=lambda i: load[i] / target[i])


def greedy_balance(df: DataFrame, key: str, shares: dict[str, float], first: str = "train") -> DataFrame:
    """(key, size, split): whole groups by falling size, each to the split with the least load against its target, ties by name.

    The largest goes to `first`. Groups of one size are dealt by their place among them: the driver goes over the distinct
    sizes, whose number grows with the square root of the rows at most, and tasks deal DEALT places each from the loads before them.
    """
    sizes = stage(df.groupBy(key).agg(F.count("*").alias("size"))).where(F.col(key).isNotNull())  # before it the key would be computed twice
    names = sorted(shares)
    classes = sizes.groupBy("size").count().orderBy(F.desc("size")).collect()
    total = sum(r["size"] * r["count"] for r in classes)
    target = [max(total * shares[s], 1e-300) for s in names]
    load, state, place = [0.0] * len(names), {}, 1
    for r in classes:
        size, n = r["size"], r["count"]
        state[size] = (place, list(load))
        if place == 1:
            load[names.index(first)] += size
            load = _dealt(load, target, size, n - 1)
        else:
            load = _dealt(load, target, size, n)
        place += n
    shared = df.sparkSession.sparkContext.broadcast(state)

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_k")
        size, at = int(rows["size"].iloc[0]), int(rows["_k"].iloc[0])
        begin, load = shared.value[size]
        out = []
        if begin == 1:
            load = [x + size * (s == first) for x, s in zip(load, names, strict=True)]
            if at == 1:
                out.append(first)
            load = _dealt(load, target, size, max(0, at - 2))
        else:
            load = _dealt(load, target, size, at - begin)
        for _ in range(len(rows) - len(out)):
            to = _least(load, target)
            load[to] += size
            out.append(names[to])
        return rows[[key, "size"]].assign(split=out)

    placed = with_row_number(sizes, [-F.col("size"), F.col(key)], [], "_k")
    schema = T.StructType([*sizes.schema.fields, T.StructField("split", T.StringType())])
    return placed.groupBy("size", F.floor(F.col("_k") / DEALT).alias("_chunk")).applyInPandas(lambda rows: deal(rows), schema)


def inner_split(df: DataFrame, family: str, inside: Column, shares: dict[str, float], name: str = "inner_split") -> DataFrame:
    """df with an inner split: the greedy balance of whole families over the rows that are `inside`, 'excluded' for all others.

    An existing column of that name raises.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    rows = df.withColumn("_inside", F.coalesce(inside, F.lit(False)))
    placed = greedy_balance(rows.where("_inside"), family, shares).select(family, "split").withColumnRenamed("split", name)
    found = lookup_join(rows, stage(placed), [family], "left")
    return found.withColumn(name, F.when(F.col("_inside"), F.col(name)).otherwise("excluded")).drop("_inside")


def component_split(df: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """(group, component, split): groups that share a key value are one component; components are hash-split at 0.70/0.15.

    Fewer than three components all go to train. A key links groups through its smallest group; null keys link nothing.
    """
    edges = df.select(F.col(group).alias("u"), F.col(group).alias("v"))
    for k in keys:
        pairs = df.where(F.col(k).isNotNull() & F.col(group).isNotNull()).select(F.col(k).alias("_k"), F.col(group).alias("u")).distinct()
        edges = edges.union(pairs.join(pairs.groupBy("_k").agg(F.min("u").alias("v")), "_k").select("u", "v"))
    parts = connected_components(edges.distinct()).select(F.col("node").alias(group), F.col("root").alias("component"))
    return parts.join(group_hash_split(parts, "component", few="train"), "component").select(group, "component", "split")


def purge_leakage(df: DataFrame, key: Column, split: str, by_count: int = 0) -> DataFrame:
    """df without records whose key also occurs in a split of higher priority (test, validation, train); null keys stay.

    The priority of each key is aggregated first, so a key with any number of records is no burden.
    """
    rank = F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p])[F.col(split)]
    rows = df.withColumn("_key", key).withColumn("_rank", rank)
    best = rows.where("_key is not null").groupBy("_key").agg(F.min("_rank").alias("_best"))
    kept = rows.join(best, "_key", "left").where(F.col("_best").isNull() | F.col("_rank").isNull() | (F.col("_rank") == F.col("_best")))
    return kept.select(*df.columns)


def purge_summary(df: DataFrame, key: Column, split: str, source: str, top: int = 20) -> DataFrame:
    """(part, name, rows): rows of each split taken in, kept and removed by a purge, its keys and those in several splits, the `top` sources that lose most.

    Splits are those of PRIORITY; null keys are kept. Sources that lose the same come by name.
    """
    rank = F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p])[F.col(split)]
    rows = df.select(F.col(split).alias("s"), F.coalesce(F.col(source), F.lit("")).alias("f"), key.alias("k"), rank.alias("r"))
    keys = rows.where("k is not null").groupBy("k").agg(F.min("r").alias("best"), F.count_distinct("s").alias("n"))
    counts = rows.join(keys, "k", "left").groupBy("s", "f").agg(F.count("*").alias("rows"), F.count_if(F.col("r") > F.col("best")).alias("gone"))
    counts = stage(counts)
    by_split = counts.groupBy("s").agg(F.sum("rows").alias("input"), F.sum(F.col("rows") - F.col("gone")).alias("kept"), F.sum("gone").alias("removed"))
    long = by_split.select(F.explode(F.create_map(*[x for p in ("input", "kept", "removed") for x in (F.lit(p), F.col(p))])).alias("part", "rows"), F.col("s").alias("name")).where("rows > 0").select("part", "name", "rows")
    both = keys.agg(F.count("*").alias("all"), F.count_if(F.col("n") > 1).alias("cross_split")).select(F.explode(F.create_map(*[x for p in ("all", "cross_split") for x in (F.lit(p), F.col(p))])).alias("name", "rows")).select(F.lit("keys").alias("part"), "name", "rows")
    lost = counts.groupBy("f").agg(F.sum("gone").alias("rows")).where("rows > 0").orderBy(F.desc("rows"), "f").limit(top).select(F.lit("removed_by_source").alias("part"), F.col("f").alias("name"), "rows")
    return long.union(both).union(lost)


def linked_groups(df: DataFrame, group: str, keys: dict[str, list[Column]]) -> DataFrame:
    """(kind, group, component) for each kind of link: groups that share a value of any of its keys, directly or through others.

    A component is named by its smallest group; null keys link nothing. Edges go through each key value's smallest group.
    """
    said = F.array(*[F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(f"{i}|"), c).alias("k")) for kind, cs in keys.items() for i, c in enumerate(cs)])
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.explode(said).alias("x")).where("x.k is not null").select("x.kind", "x.k", "g").distinct()
    node = lambda g: F.concat("kind", F.lit("\u001f"), F.col(g))
    low = rows.groupBy("kind", "k").agg(F.min("g").alias("low"))
    edges = rows.join(low, ["kind", "k"]).select(node("g").alias("u"), node("low").alias("v")).distinct()
    alone = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.explode(F.array(*map(F.lit, keys))).alias("kind")).distinct().select(node("g").alias("u"), node("g").alias("v"))
    parts = connected_components(edges.union(alone))
    return parts.select(F.substring_index("node", "\u001f", 1).alias("kind"), F.substring_index("node", "\u001f", -1).alias("group"), F.substring_index("root", "\u001f", -1).alias("component"))


def leaking_keys(df: DataFrame, key: Column, split: str) -> DataFrame:
    """(key, splits): keys that occur in more than one split."""
    return df.select(key.alias("key"), F.col(split).alias("s")).where("key is not null and s is not null").groupBy("key").agg(F.count_distinct("s").alias("splits")).where("splits > 1")


def check_manifest(df: DataFrame, manifest: DataFrame, group: str) -> DataFrame:
    """df joined to a split manifest on its group; a group that the manifest lacks raises."""
    found = F.col("_found").isNotNull()
    rows = df.join(manifest.withColumn("_found", F.lit(1)), group, "left")
    return rows.where(F.when(found, True).otherwise(F.raise_error(F.concat(F.lit("unknown group: "), F.coalesce(F.col(group), F.lit("null")))).cast("boolean"))).drop("_found")


def first_occurrence(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order; partial maxima, no window."""
    rows = df.withColumn("_o", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    packed = F.struct("_o", F.struct(*df.columns).alias("row"))
    return rows.groupBy(*keys).agg(F.min_by(packed, "_o").alias("m")).select("m.row.*")


def hash_sample(df: DataFrame, id_col: str, by: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each group, those with the smallest keyed hash: a repeatable reservoir."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
