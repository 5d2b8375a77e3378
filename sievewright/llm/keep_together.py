"""Splits that keep joined records together: joined sets, then a component swap search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators.graph import connected_components
from sievewright.session import lookup_join, stage

#: Largest sets that are placed first, together; a bound on what the driver ever holds of them.
HEAD = 4_096
#: Expected sets in one block of the rest; each block is annealed by one task.
BLOCK = 4_096


def joined_sets(records: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """records, without the key columns, with `_set`, a 16-byte label that is equal for records joined directly or through others.

    `keys` are text columns; equal non-blank values of one key join records, null and blank values join nothing.
    A record is anchored at its first key that has a value; every other key adds an edge from the anchor to the
    smallest anchor that shares it, so the graph has key values for nodes and no pair of records is ever formed.
    """
    digest = lambda n, c: F.when(c.rlike(r"\S"), F.unhex(F.md5(F.concat(F.lit(n + "\u001f"), c))))
    named = records.select("*", *[digest(n, c).alias(f"_key_{n}") for n, c in keys.items()])
    own = F.unhex(F.md5(F.concat(F.lit("\u001e"), F.col(id_col).cast("string"))))
    anchored = stage(named.withColumn("_anchor", F.coalesce(*[F.col(f"_key_{n}") for n in keys], own)).drop(*keys))
    edges = None
    for n in list(keys)[1:]:
        shared = anchored.where(F.col(f"_key_{n}").isNotNull()).select(F.col(f"_key_{n}").alias("key"), F.col("_anchor").alias("u")).distinct()
        low = shared.groupBy("key").agg(F.min("u").alias("v"), F.max("u").alias("top")).where("v <> top").drop("top")
        links = shared.join(low, "key").where("u <> v").select("u", "v").distinct()
        edges = links if edges is None else edges.union(links)
    if edges is None:
        return anchored.withColumn("_set", F.col("_anchor")).drop("_anchor", *[f"_key_{n}" for n in keys])
    roots = connected_components(edges).select(F.col("node").alias("_anchor"), "root")
    out = lookup_join(anchored, stage(roots), ["_anchor"], "left", row_size=48)
    return out.withColumn("_set", F.coalesce("root", "_anchor")).drop("root", "_anchor", *[f"_key_{n}" for n in keys])


def set_summary(sets: DataFrame, id_col: str, split: Column, label: Column) -> DataFrame:
    """(_set, set_key, records, low_split, high_split, label_sum, labelled): one row a joined set."""
    value = F.when(label.isNotNull() & ~F.isnan(label), label)
    return sets.groupBy("_set").agg(F.min(id_col).alias("set_key"), F.count("*").alias("records"), F.min(split).alias("low_split"), F.max(split).alias("high_split"), F.sum(value).alias("label_sum"), F.count(value).alias("labelled"))


def _cost(load: np.ndarray, labels: np.ndarray, counts: np.ndarray, want: np.ndarray, mean: float, spread: float) -> float:
    """Relative deviation of sizes plus a quarter of that of the label means."""
    size = np.abs(load - want).sum() / max(want.sum(), 1.0)
    means = np.where(counts > 0, labels / np.maximum(counts, 1), mean)
    return float(size + 0.25 * (np.abs(means - mean) / spread * want / max(want.sum(), 1.0)).sum())


def anneal(sizes: np.ndarray, sums: np.ndarray, counts: np.ndarray, start: np.ndarray, want: np.ndarray, mean: float, spread: float, seed: int, steps: int, base: tuple | None = None) -> tuple[float, np.ndarray]:
    """Moves whole sets between splits, or swaps two, where that lowers the cost, or at a falling temperature raises it a little.

    `base` is what the splits hold already. Returns the best state seen; at worst the start.
    """
    rng, k = np.random.default_rng(seed), len(want)
    at = start.copy()
    zero = np.zeros(k)
    load, labels, held = [b + np.bincount(at, w, k) for b, w in zip(base or (zero, zero, zero), (sizes, sums, counts), strict=True)]
    now = best = _cost(load, labels, held, want, mean, spread)
    kept = at.copy()
    if len(at) == 0:
        return best, kept
    for step, (i, j, to, swap, u) in enumerate(zip(rng.integers(len(at), size=steps), rng.integers(len(at), size=steps), rng.integers(k, size=steps), rng.random(steps), rng.random(steps), strict=True)):
        moves = [(i, at[j]), (j, at[i])] if swap < 0.5 else [(i, to)]
        if all(at[x] == t for x, t in moves):
            continue
        trial = [load.copy(), labels.copy(), held.copy()]
        for x, t in moves:
            for total, w in zip(trial, (sizes, sums, counts), strict=True):
                total[at[x]] -= w[x]
                total[t] += w[x]
        cost = _cost(*trial, want, mean, spread)
        heat = 0.02 * (1 - step / steps) ** 2
        if cost <= now or (heat > 0 and u < np.exp((now - cost) / heat)):
            for x, t in moves:
                at[x] = t
            (load, labels, held), now = trial, cost
            if now < best:
                best, kept = now, at.copy()
    return best, kept


def _hashed(keys: pd.Series, shares: np.ndarray) -> np.ndarray:
    """A split a key by its hash, in proportion to the shares."""
    import xxhash

    u = np.array([xxhash.xxh64_intdigest(str(x)) for x in keys], dtype=np.float64) / 2.0**64
    return np.minimum(np.searchsorted(np.cumsum(shares) / max(shares.sum(), 1e-12), u, side="right"), len(shares) - 1)


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["set_key", "records", "label_sum", "labelled"]).astype({"records": float, "label_sum": float, "labelled": float})


def assign_sets(summary: DataFrame, shares: dict[str, float], steps: int = 4_000, chains: int = 4) -> DataFrame:
    """(set_key, new_split): every set placed whole, sizes near the shares and label means near the overall mean.

    All sets start where the hash of their key puts them. The HEAD largest are annealed together by `chains` chains, each a
    task of its own, and the best end is kept; their number is bounded, so nothing that grows is collected. What remains of
    the targets goes to the other sets in hashed blocks of about BLOCK sets, which tasks anneal at once, again by `chains`
    chains each. A set larger than its share stays whole and the shares shift. Ties and repeated runs give the same result.
    """
    spark = summary.sparkSession
    names, share = list(shares), np.array(list(shares.values()), float)
    share = share / share.sum()
    cells = summary.select("set_key", "records", F.coalesce("label_sum", F.lit(0.0)).alias("label_sum"), "labelled")
    total, label_sum, labelled, sets = cells.agg(F.sum("records"), F.sum("label_sum"), F.sum("labelled"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "set_key string, new_split string")
    mean = label_sum / labelled if labelled else 0.0
    spread = max(abs(mean), 1e-9)
    order = [F.desc("records"), "set_key"]
    head = _frame([tuple(r) for r in cells.orderBy(*order).limit(HEAD).collect()])
    sizes, want = head["records"].to_numpy(), share * total
    rest = total - sizes.sum()
    base = tuple(rest * share * w for w in (1.0, labelled and label_sum / total, labelled / total))
    start = _hashed(head["set_key"], share)
    given = (sizes, head["label_sum"].to_numpy(), head["labelled"].to_numpy(), start, want, mean, spread)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = [(seed, *anneal(*given, seed, steps * 4, base)) for seed in batch["seed"].tolist()]
            yield pd.DataFrame([(seed, cost, at.tolist()) for seed, cost, at in ends], columns=["seed", "cost", "at"])

    seeds = spark.createDataFrame([(n,) for n in range(chains)], "seed int").repartitionByRange(chains, "seed")
    best = seeds.mapInPandas(chain, "seed int, cost double, at array<int>").orderBy("cost", "seed").first()
    at = np.array(best["at"], dtype=int)
    placed = spark.createDataFrame(pd.DataFrame({"set_key": head["set_key"], "new_split": [names[i] for i in at]}), "set_key string, new_split string")
    if sets <= HEAD:
        return placed
    left = np.maximum(want - np.bincount(at, sizes, len(share)), 0.0)
    left = left / max(left.sum(), 1e-12)
    blocks = max(1, int((sets - HEAD) // BLOCK))
    tail = cells.join(F.broadcast(placed.select("set_key")), "set_key", "left_anti").withColumn("block", F.pmod(F.xxhash64("set_key"), F.lit(blocks)))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        own = batch.sort_values("set_key")
        s, l, c = (own[x].to_numpy(float) for x in ("records", "label_sum", "labelled"))
        start, aim = _hashed(own["set_key"], left), left * s.sum()
        best = min((anneal(s, l, c, start, aim, mean, spread, seed, steps) for seed in range(chains)), key=lambda r: r[0])[1]
        return pd.DataFrame({"set_key": own["set_key"], "new_split": [names[i] for i in best]})

    return placed.union(tail.groupBy("block").applyInPandas(run, "set_key string, new_split string"))


def keep_together(records: DataFrame, id_col: str, keys: dict[str, Column], split: Column, label: Column, shares: dict[str, float] | None = None) -> DataFrame:
    """(id, set_key, mixed[, new_split]): every record's joined set, whether the set now holds more than one split, and its new split.

    Records without an id are left out; a repeated row counts once. A null split counts as none. Without `shares` only the
    sets are returned. An empty table gives no rows.
    """
    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), split.alias("_split"), label.cast("double").alias("_label"), *[c.alias(n) for n, c in keys.items()]).distinct()
    sets = stage(joined_sets(rows, "_id", {n: F.col(n) for n in keys}).select("_id", "_split", "_label", "_set"))
    summary = set_summary(sets, "_id", F.col("_split"), F.col("_label"))
    if shares is None:
        known = summary.select("_set", "set_key", (F.col("low_split") < F.col("high_split")).alias("mixed"))
    else:
        summary = stage(summary)
        new = assign_sets(summary, shares)
        known = summary.select("_set", "set_key", (F.col("low_split") < F.col("high_split")).alias("mixed")).join(new, "set_key")
    out = lookup_join(sets, known, ["_set"], "inner", row_size=96)
    return out.select(F.col("_id").alias(id_col), "set_key", F.coalesce("mixed", F.lit(False)).alias("mixed"), *["new_split"] * (shares is not None)).distinct()
