"""Ranking quality: errors, correlations, enrichment, macro means, bootstrap and permutation."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.ranks import WINDOW_ROWS, largest_group, ranged_sums, with_ranks, with_row_number
from sievewright.session import lookup_join, stage

METRICS = ["n", "rmse", "mae", "pearson", "spearman", "top10_enrichment"]


def safe_correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null for fewer than three rows or a constant side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count("*") >= 3, F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread)))


def known(c: str) -> Column:
    """Whether a column has a value that is not NaN."""
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def top_places(n: Column, share: float) -> Column:
    return F.greatest(F.lit(1.0), F.ceil(n * F.lit(float(share))).cast("double"))


def _ranged_values(counts: DataFrame, value: str, keys: list[str], share: float) -> DataFrame:
    """counts, one row a (keys, value) with its rows `_c`, staged with the group's size `_n` and `_r`, the value's mean rank less the group's.

    `_sure` says that all its rows are in the top, `_left` how many places the top has for it where that are some of them only.
    """
    d = ranged_sums(counts, value, "_c", keys).withColumnRenamed("_total", "_n")
    above, places = F.col("_n") - F.col("_before") - F.col("_c"), top_places(F.col("_n"), share)
    centred = F.col("_before") + (F.col("_c") - F.col("_n")) / F.lit(2.0)
    return stage(d.select(*counts.columns, "_n", centred.alias("_r"), (above + F.col("_c") <= places).alias("_sure"), F.when((above < places) & (above + F.col("_c") > places), places - above).alias("_left")))


def with_truth_ranks(rows: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """rows (keys, _id, _t and others) of groups of any size, staged with `_rt`, the truth's rank less the mean rank, and `_top`. Keys are not null."""
    dim = _ranged_values(rows.groupBy(*keys, "_t").agg(F.count("*").alias("_c")), "_t", keys, share)
    edge = dim.where("_left is not null").select(*keys, "_t", "_left")  # one value a group at most
    tied = lookup_join(rows.select(*keys, "_id", "_t"), edge, [*keys, "_t"], "inner")
    last = stage(with_row_number(tied, [F.col("_id")], keys, "_k").where("_k = _left").select(*keys, F.col("_id").alias("_last")))
    dim = stage(lookup_join(dim, last, keys).select(*keys, "_t", F.col("_r").alias("_rt"), "_sure", F.when(F.col("_left").isNotNull(), F.col("_last")).alias("_last")))
    found = lookup_join(rows, dim, [*keys, "_t"])
    return stage(found.withColumn("_top", F.col("_sure") | F.coalesce(F.col("_id") <= F.col("_last"), F.lit(False))).drop("_sure", "_last"))


def _ranged_metrics(rows: DataFrame, by: list[str], share: float) -> DataFrame:
    """regression_metrics of groups that no task holds: truth ranks are looked up once, predictions are summed by value before they are ranked.

    Only the rows whose prediction stands at the edge of the top are numbered by id.
    """
    keys = [f"_key_{i}" for i in range(max(1, len(by)))]
    rows = rows.select("*", *([F.coalesce(F.col(b).cast("string"), F.lit("\u0000")).alias(k) for b, k in zip(by, keys, strict=True)] if by else [F.lit(0).alias(keys[0])]))
    rows = with_truth_ranks(rows, keys, share)
    per = rows.groupBy(*keys, "_p").agg(F.count("*").alias("_c"), F.sum("_rt").alias("_s"), F.sum(F.col("_rt") * F.col("_rt")).alias("_q"), F.count_if("_top").alias("_h"))
    dim = _ranged_values(per, "_p", keys, share)
    tied = lookup_join(rows.select(*keys, "_id", "_p", "_top"), dim.where("_left is not null").select(*keys, "_p", "_left"), [*keys, "_p"], "inner")
    edge = with_row_number(tied, [F.col("_id")], keys, "_k").where("_k <= _left").groupBy(*keys).agg(F.count_if("_top").alias("_edge"))
    sums = dim.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_s")).alias("_cov"), F.sum("_q").alias("_vt"), F.sum(F.col("_c") * F.col("_r") * F.col("_r")).alias("_vp"), F.sum(F.when(F.col("_sure"), F.col("_h")).otherwise(0)).alias("_h"))
    errors = rows.groupBy(*by, *keys).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg((F.col("_t") - F.col("_p")) * (F.col("_t") - F.col("_p")))).alias("rmse"),
        F.avg(F.abs(F.col("_t") - F.col("_p"))).alias("mae"),
        safe_correlation("_t", "_p").alias("pearson"),
    )
    spread, places = F.sqrt("_vt") * F.sqrt("_vp"), top_places(F.col("n"), share)
    return errors.join(sums, keys).join(edge, keys, "left").select(
        *by, "n", "rmse", "mae", "pearson",
        F.when(F.col("n") >= 3, F.try_divide(F.col("_cov"), F.when(spread > 0, spread))).alias("spearman"),
        ((F.col("_h") + F.coalesce("_edge", F.lit(0))) / (places * places / F.col("n"))).alias("top10_enrichment"),
    )


def regression_metrics(df: DataFrame, truth: str, prediction: str, id_col: str, by: list[str], share: float = 0.1, task_rows: int = WINDOW_ROWS) -> DataFrame:
    """n, rmse, mae, pearson, spearman and top10_enrichment of each group, null groups kept; no grouping gives one row.

    Spearman is Pearson's correlation of tie-averaged ranks. The top holds ceil(share * n) rows, one at least, by value
    descending and then id; enrichment is the overlap of both tops over the one expected by chance. Undefined values are null.
    Rows whose truth or prediction is null or NaN are left out. Groups of more than `task_rows` rows are ranked in ranges.
    """
    rows = df.where(known(truth) & known(prediction)).select(*by, F.col(id_col).alias("_id"), F.col(truth).cast("double").alias("_t"), F.col(prediction).cast("double").alias("_p"))
    most = largest_group(rows, by)
    if most > task_rows:
        return _ranged_metrics(rows, by, share)
    rows = with_ranks(rows, F.col("_t"), by, "_rt", "_n", largest=most)
    rows = with_ranks(rows, F.col("_p"), by, "_rp", "_n2", largest=most)
    rows = with_row_number(rows, [-F.col("_t"), F.col("_id")], by, "_ot", largest=most)
    rows = with_row_number(rows, [-F.col("_p"), F.col("_id")], by, "_op", largest=most)
    rows = rows.withColumn("_c", top_places(F.col("_n"), share))
    hit = ((F.col("_ot") <= F.col("_c")) & (F.col("_op") <= F.col("_c"))).cast("double")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg((F.col("_t") - F.col("_p")) * (F.col("_t") - F.col("_p")))).alias("rmse"),
        F.avg(F.abs(F.col("_t") - F.col("_p"))).alias("mae"),
        safe_correlation("_t", "_p").alias("pearson"),
        safe_correlation("_rt", "_rp").alias("spearman"),
        (F.sum(hit) / F.max(F.col("_c") * F.col("_c") / F.col("_n"))).alias("top10_enrichment"),
    )


def macro_means(by_group: DataFrame, least: int = 20) -> DataFrame:
    """Means over groups with a defined Spearman: plain, of groups of `least` rows or more, by size, and the median."""
    rho, n = F.col("spearman"), F.col("n")
    return by_group.agg(
        F.count(rho).alias("groups"), F.avg(rho).alias("macro_spearman"), F.avg(F.when(n >= least, rho)).alias("stable_macro_spearman"), F.count(F.when(n >= least, rho)).alias("stable_groups"),
        F.try_divide(F.sum(rho * n), F.sum(F.when(rho.isNotNull(), n))).alias("weighted_spearman"), F.median(rho).alias("median_spearman"),
    )


def draw(seed: int, rounds: Column, k: Column, size: Column) -> Column:
    """A draw from 0 to size - 1 by the MD5 of seed, round and index, equal in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), rounds.cast("string"), k.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") % size).cast("bigint")


def bootstrap_multiplicities(clusters: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(round, cluster, times): each round draws as many clusters as there are, with replacement.

    clusters has one column `cluster`; clusters are numbered in their order. A cluster enters a round with the number of
    its draws as weight, so no row is copied.
    """
    numbered = with_row_number(clusters.distinct(), [F.col("cluster")], [], "_k").select("cluster", (F.col("_k") - 1).alias("_k"))
    size = numbered.count()
    draws = numbered.select(F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"), "_k").select("round", draw(seed, F.col("round"), F.col("_k"), F.lit(max(size, 1))).alias("_k"))
    return draws.groupBy("round", "_k").agg(F.count("*").alias("times")).join(numbered, "_k").select("round", "cluster", "times")


def _weighted_correlation(x: str, y: str, w: str) -> Column:
    s = lambda c: F.sum(c * F.col(w))
    X, Y, n = F.col(x), F.col(y), F.sum(w)
    cov = s(X * Y) - s(X) * s(Y) / n
    var = lambda c: s(c * c) - s(c) * s(c) / n
    spread = F.sqrt(F.greatest(var(X), F.lit(0.0)) * F.greatest(var(Y), F.lit(0.0)))
    return F.when(n >= 3, F.try_divide(cov, F.when(spread > 0, spread)))


def _block_correlations(rows: pd.DataFrame, truth: str, scores: list[str], rounds: range, seed: int) -> pd.DataFrame:
    """The rounds of bootstrap_correlations over the whole table in one task, all in numpy; clusters are never null."""
    names, cluster = np.unique(rows["cluster"].to_numpy(), return_inverse=True)
    size, codes = len(names), {c: np.unique(rows[c].to_numpy(), return_inverse=True)[1] for c in [truth, *scores]}
    out = []
    for r in rounds:
        drawn = [int(md5(f"{seed}|{r}|{k}".encode()).hexdigest()[:12], 16) % size for k in range(size)]
        w = np.bincount(drawn, minlength=size).astype(float)[cluster]
        n, centred = w.sum(), {}
        for c, code in codes.items():
            per = np.bincount(code, w)
            rank = (np.cumsum(per) - per + (per + 1) / 2.0)[code]
            centred[c] = rank - (w * rank).sum() / n
        var = {c: (w * x * x).sum() for c, x in centred.items()}
        spread = [np.sqrt(var[truth] * var[s]) for s in scores]
        out.append((r, *[(w * centred[truth] * centred[s]).sum() / d if n >= 3 and d > 0 else None for s, d in zip(scores, spread)]))
    return pd.DataFrame(out, columns=["round", *[f"rho_{s}" for s in scores]])


def bootstrap_correlations(df: DataFrame, truth: str, scores: list[str], cluster: str, rounds: int, seed: int, task_rows: int = WINDOW_ROWS) -> DataFrame:
    """(round, one correlation a score): Spearman of cluster-resampled rows.

    Ranks within a round weigh rows by their cluster's draws: a value's rank is the weight before it plus half its own.
    While the table fits one task, blocks of rounds are dealt to tasks that each take it whole; beyond that only the
    distinct values meet the rounds, and their weights are summed in ranges. Rows without a cluster are left out.
    """
    df = df.select(F.col(cluster).alias("cluster"), truth, *scores).where("cluster is not null")
    if df.count() <= task_rows:
        blocks = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        many = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks, "_block")
        run = lambda key, rows: _block_correlations(rows, truth, scores, range(key[0], rounds, blocks), seed)
        return many.groupBy("_block").applyInPandas(run, ", ".join(["round int", *[f"rho_{s} double" for s in scores]]))
    times = bootstrap_multiplicities(df.select("cluster"), rounds, seed)
    rows = df.join(times, "cluster")
    for c in [truth, *scores]:
        per = rows.groupBy("round", c).agg(F.sum("times").alias("_w"))
        ranks = ranged_sums(per, c, "_w", ["round"]).select("round", c, (F.col("_before") + (F.col("_w") + 1) / 2.0).alias(f"_r_{c}"))
        rows = rows.join(ranks, ["round", c])
    return rows.groupBy("round").agg(*[_weighted_correlation(f"_r_{truth}", f"_r_{s}", "times").alias(f"rho_{s}") for s in scores])


def bootstrap_interval(values: DataFrame, column: str) -> DataFrame:
    """Valid rounds and the 2.5, 50 and 97.5 % points by linear interpolation."""
    p = lambda q: F.percentile(F.col(column), F.lit(q))
    return values.agg(F.count(column).alias("rounds_valid"), p(0.025).alias("low"), p(0.5).alias("median"), p(0.975).alias("high"))


def paired_delta(values: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Mean, spread and interval of candidate minus baseline over rounds, and how often the candidate is better."""
    d = values.select((F.col(candidate) - F.col(baseline)).alias("d"))
    p = lambda q: F.percentile(F.col("d"), F.lit(q))
    return d.agg(F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("sd_delta"), p(0.025).alias("low"), p(0.975).alias("high"), F.avg((F.col("d") > 0).cast("double")).alias("p_better"))


def permuted_truth(df: DataFrame, truth: str, id_col: str, seed: int, task_rows: int = WINDOW_ROWS) -> DataFrame:
    """df with `permuted`, the truth column dealt out again in the order of a keyed hash of the ids; ids are unique."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    here = with_row_number(df, [F.col(id_col)], [], "_k", window_rows=task_rows)
    there = with_row_number(df.select(id_col, truth), [h, F.col(id_col)], [], "_k", window_rows=task_rows).select("_k", F.col(truth).alias("permuted"))
    return here.join(there, "_k").drop("_k")


def selection_composite(macro: Column, held_out: Column, cold: Column) -> Column:
    """Half the macro mean and a quarter each of two regimes; null unless all three are defined."""
    return F.lit(0.5) * macro + F.lit(0.25) * held_out + F.lit(0.25) * cold


def with_regimes(df: DataFrame, split: str, unseen: dict[str, str], rest: str = "in-distribution", train: str = "train") -> DataFrame:
    """df with `regime`: of rows outside `train` that have a split, the first of `unseen` (regime: column) whose value no training row has, else `rest`.

    Training rows, rows without a split and nulls that nothing can be said of have none, or go on to the next.
    """
    rows, out = df, F.lit(rest)
    for i, (regime, column) in reversed(list(enumerate(unseen.items()))):
        known = df.where((F.col(split) == train) & F.col(column).isNotNull()).select(column).distinct().withColumn(f"_seen{i}", F.lit(True))
        rows = lookup_join(rows, known, [column], "left")
        out = F.when(F.col(column).isNotNull() & F.col(f"_seen{i}").isNull(), regime).otherwise(out)
    held = F.col(split).isin("validation", "test")
    return rows.withColumn("regime", F.when(held, out)).select(*df.columns, "regime")


def evaluation_report(df: DataFrame, id_col: str, truth: str, prediction: str, views: dict[str, Column], macro: tuple[str, ...], regimes: tuple[str, str]) -> DataFrame:
    """(view, part, n, rmse, mae, pearson, spearman, top10_enrichment): all figures of a prediction table in long form.

    Each view (name: part column) gives a row a part; null parts are left out, blank ones kept for the first view and those of
    `macro`. For the latter come the plain and the size-weighted mean of their parts' correlations, n being the parts that
    have one. The composite is half the macro mean of the first of `macro` and a quarter each of two parts of the view
    'regime', null unless all are there. One pass ranks all views together.
    """
    first = next(iter(views))
    wanted = F.array(*[F.struct(F.lit(v).alias("view"), p.cast("string").alias("part")) for v, p in views.items()])
    long = df.select(F.col(id_col).alias("_id"), F.col(truth).alias("_t"), F.col(prediction).alias("_p"), F.explode(wanted).alias("_v")).select("_id", "_t", "_p", "_v.view", "_v.part")
    long = long.where(F.col("part").isNotNull() & ((F.col("part") != "") | F.col("view").isin(first, *macro)))
    parts = regression_metrics(long, "_t", "_p", "_id", ["view", "part"])
    digits = {"rmse": 4, "mae": 4}
    parts = stage(parts.select("view", "part", "n", *[F.round(c, digits.get(c, 6)).alias(c) for c in METRICS[1:]]))
    rho, n, none = F.col("spearman"), F.col("n"), F.lit(None).cast("double")
    means = parts.where(F.col("view").isin(*macro)).groupBy(F.col("view").alias("part")).agg(F.count(rho).alias("n"), F.avg(rho).alias("macro"), F.try_divide(F.sum(rho * n), F.sum(F.when(rho.isNotNull(), n))).alias("weighted"))
    row = lambda d, view, part, n, x: d.select(F.lit(view).alias("view"), part.alias("part"), n.alias("n"), none.alias("rmse"), none.alias("mae"), none.alias("pearson"), F.round(x, 5).alias("spearman"), none.alias("top10_enrichment"))
    at = lambda v, p=None: F.avg(F.when((F.col("view") == v) & (F.lit(True) if p is None else F.col("part") == p), rho))
    one = parts.agg(selection_composite(at(macro[0]), at("regime", regimes[0]), at("regime", regimes[1])).alias("x"))
    out = parts.union(row(means, "macro", F.col("part"), F.col("n"), F.col("macro"))).union(row(means, "weighted", F.col("part"), F.col("n"), F.col("weighted")))
    return out.union(row(one, "composite", F.lit(""), F.lit(None).cast("long"), F.col("x")))


def pair_accuracy(pairs: DataFrame, scores: DataFrame, id_col: str, score: str) -> DataFrame:
    """Weighted share of preference pairs that the scores order rightly; ties count half."""
    left, right = (scores.select(F.col(id_col).alias(f"{s}_record_id"), F.col(score).alias(f"_{s}")) for s in ("left", "right"))
    rows = pairs.join(left, "left_record_id").join(right, "right_record_id")
    right_way = F.sign(F.col("_left") - F.col("_right")) == F.sign(F.col("preference").cast("double"))
    won = F.when(F.col("_left") == F.col("_right"), 0.5).when(right_way, 1.0).otherwise(0.0)
    return rows.agg(F.count("*").alias("pairs"), F.try_divide(F.sum(won * F.col("pair_weight")), F.sum("pair_weight")).alias("accuracy"))
