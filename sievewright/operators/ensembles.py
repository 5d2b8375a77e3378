"""Alignment, rank normalisation, blending, sweeps and export of prediction tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.ranks import WINDOW_ROWS, with_percentile, with_rank_over_n, with_ranks, with_row_number
from sievewright.operators.metrics import known, regression_metrics, with_truth_ranks
from sievewright.session import stage

#: Rows that a task of a sweep sorts at once, and the most such parts of a share; each part reads the table, so one of more parts is shuffled.
SWEEP_ROWS, SWEEP_PARTS = 2_000_000, 32


def alignment_report(truth: DataFrame, prediction: DataFrame, id_col: str) -> DataFrame:
    """One row: ids in both, missing from the prediction, extra in it, and repeated on either side."""
    t, p = (d.groupBy(id_col).agg(F.count("*").alias(c)) for d, c in ((truth, "_t"), (prediction, "_p")))
    rows = t.join(p, id_col, "full_outer")
    return rows.agg(F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("matched"), F.count_if(F.col("_p").isNull()).alias("missing"), F.count_if(F.col("_t").isNull()).alias("extra"), F.count_if((F.col("_t") > 1) | (F.col("_p") > 1)).alias("repeated"))


def strictly_joined(truth: DataFrame, prediction: DataFrame, id_col: str) -> DataFrame:
    """truth with the prediction's columns, one row an id; ids that one side lacks or that repeat raise when they are read.

    Columns that both have keep the truth's.
    """
    own = prediction.select(id_col, *[c for c in prediction.columns if c not in truth.columns])
    rows = truth.withColumn("_t", F.lit(1)).join(own.withColumn("_p", F.lit(1)), id_col, "full_outer")
    copies = truth.select(id_col).union(own.select(id_col)).groupBy(id_col).agg(F.count("*").alias("_n"))
    fine = (F.coalesce("_t", F.lit(0)) + F.coalesce("_p", F.lit(0)) == 2) & (F.col("_n") == 2)
    return rows.join(copies, id_col).where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("id not on both sides once: "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).cast("boolean"))).drop("_t", "_p", "_n")


def strict_align(tables: dict[str, DataFrame], id_col: str, score: str) -> DataFrame:
    """(id, one score column a table): all tables must hold the same unique ids, else it raises."""
    parts = [d.select(id_col, F.lit(m).alias("_m"), F.col(score).cast("double").alias("_v")) for m, d in tables.items()]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    wide = rows.groupBy(id_col).agg(F.count("*").alias("_n"), F.count_distinct("_m").alias("_m"), *[F.max(F.when(F.col("_m") == m, F.col("_v"))).alias(m) for m in tables])
    fine = (F.col("_n") == len(tables)) & (F.col("_m") == len(tables))
    return wide.where(F.when(fine, True).otherwise(F.raise_error(F.lit("prediction tables hold different ids")).cast("boolean"))).select(id_col, *tables)


def intersection_align(left: DataFrame, right: DataFrame, id_col: str, truth: str, eps: float = 1e-9) -> DataFrame:
    """Inner join on id; where both know the truth it must agree, else it raises."""
    rows = left.join(right.withColumnRenamed(truth, "_truth"), id_col)
    agree = F.col("_truth").isNull() | F.col(truth).isNull() | (F.abs(F.col(truth) - F.col("_truth")) <= eps)
    return rows.where(F.when(agree, True).otherwise(F.raise_error(F.lit("truth differs")).cast("boolean"))).drop("_truth")


def percentile_blend(aligned: DataFrame, weights: dict[str, float], by: list[str], name: str = "score") -> DataFrame:
    """Weighted mean of each model's percentile within its group; weights are not negative and are normalised."""
    if min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative nor all zero")
    total, rows = sum(weights.values()), aligned
    for m in weights:
        rows = with_percentile(rows, F.col(m), by, f"_q_{m}")
    return rows.withColumn(name, reduce(lambda a, b: a + b, [F.col(f"_q_{m}") * (w / total) for m, w in weights.items()])).drop(*[f"_q_{m}" for m in weights])


def global_rank_blend(aligned: DataFrame, weights: dict[str, float], name: str = "score", plus: int = 1) -> DataFrame:
    """Weighted mean of each model's average rank over all rows, over n + plus."""
    total, rows = sum(weights.values()), aligned
    for m in weights:
        rows = with_rank_over_n(rows, F.col(m), [], f"_q_{m}", plus)
    return rows.withColumn(name, reduce(lambda a, b: a + b, [F.col(f"_q_{m}") * (w / total) for m, w in weights.items()])).drop(*[f"_q_{m}" for m in weights])


def _by_score(p: np.ndarray, *sums: np.ndarray) -> list[np.ndarray]:
    """Distinct scores in rising order and the sums of other columns over each."""
    order = np.argsort(p, kind="stable")
    p = p[order]
    start = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.empty(0, int)
    return [p[start], *[np.add.reduceat(x[order], start) if len(p) else x for x in sums]]


def _sweep_part(files: list[str], w: float, low: float, high: float, n: int, places: float, mean_t: float, mean_p: float, most: int) -> dict[str, float | None]:
    """Sums over the rows whose blend lies from low up to below high, ranked among all n; more than `most` rows are held as distinct scores."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    below, rows, sums, held, full = 0, 0, np.zeros(7), [[np.empty(0)] * 4], 2 * most
    for path in files:
        system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        for batch in pq.ParquetFile(at, filesystem=system).iter_batches(1 << 18, columns=["_a", "_b", "_t", "_rt", "_top"]):
            a, b, t, rt, top = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            p = (1.0 - w) * a + w * b
            below += int((p < low).sum())
            at_home = (p >= low) & (p < high) if high < math.inf else p >= low
            p, t, rt, top = p[at_home], t[at_home], rt[at_home], top[at_home].astype(float)
            e, dt, dp = t - p, t - mean_t, p - mean_p
            sums += [(e * e).sum(), np.abs(e).sum(), dt.sum(), dp.sum(), (dt * dt).sum(), (dp * dp).sum(), (dt * dp).sum()]
            held.append([p, np.ones(len(p)), rt, top])
            rows += len(p)
            if rows > full:
                held = [_by_score(*map(np.concatenate, zip(*held, strict=True)))]
                rows = len(held[0][0])
                full = 2 * max(most, rows)
    p, c, s, h = _by_score(*map(np.concatenate, zip(*held, strict=True)))
    before = below + np.cumsum(c) - c
    r, above = before + (c - n) / 2.0, n - before - c
    edge = np.flatnonzero((above < places) & (above + c > places))  # one score at most
    out = dict(zip(["ee", "ae", "dt", "dp", "tt", "pp", "tp"], map(float, sums), strict=True))
    out |= {"cov": float((r * s).sum()), "var": float((c * r * r).sum()), "hits": float(h[above + c <= places].sum())}
    return out | {"edge": float(p[edge[0]]) if len(edge) else None, "left": float(places - above[edge[0]]) if len(edge) else None}


def _sweep_in_parts(rows: DataFrame, n: int, shares: list[float], part_rows: int) -> DataFrame:
    """blend_sweep of rows (_id, _t, _a, _b) without a shuffle of every share's rows.

    Truth ranks are looked up once. A task takes a share and a range of its blends from the staged table, which it reads whole
    to rank that range among all rows. Some rows place the bounds of the ranges, which decide on nothing but the tasks' sizes.
    """
    spark, share = rows.sparkSession, 0.1
    ranked = with_truth_ranks(rows.withColumn("_key_0", F.lit(0)), ["_key_0"], share)
    files, parts, places = ranked.inputFiles(), math.ceil(n / part_rows), max(1.0, math.ceil(n * share))
    m = ranked.agg(F.avg("_t"), F.avg("_a"), F.avg("_b"), F.sum(F.col("_rt") * F.col("_rt"))).first()
    some = ranked.where(F.pmod(F.xxhash64("_id"), F.lit(max(1, n // 20_000))) == 0).select("_a", "_b").toPandas() if parts > 1 else pd.DataFrame({"_a": [], "_b": []})
    jobs = []
    for i, w in enumerate(shares):
        p = (1.0 - w) * some["_a"].to_numpy(float) + w * some["_b"].to_numpy(float)
        inner = np.unique(np.quantile(p, np.arange(1, parts) / parts)).tolist() if len(p) else []
        bounds = [-math.inf, *inner, math.inf]
        jobs += [(i, w, low, high, n, places, m[0], (1.0 - w) * m[1] + w * m[2], part_rows) for low, high in zip(bounds, bounds[1:], strict=False)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                yield pd.DataFrame([{"i": jobs[k][0]} | _sweep_part(files, *jobs[k][1:])]).astype({"edge": float, "left": float})

    names = ["ee", "ae", "dt", "dp", "tt", "pp", "tp", "cov", "var", "hits", "edge", "left"]
    found = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(run, ", ".join(["i int", *[f"{c} double" for c in names]])).toPandas()  # a row a task
    tied = found[found["edge"].notna()]
    hits = {}
    if len(tied):
        asked = F.array(*[F.struct(F.lit(int(i)).alias("i"), F.lit(shares[int(i)]).alias("w"), F.lit(float(v)).alias("v"), F.lit(float(k)).alias("k")) for i, v, k in zip(tied["i"], tied["edge"], tied["left"], strict=True)])
        at = ranked.select("_id", "_top", "_a", "_b", F.explode(asked).alias("_e")).where((F.lit(1.0) - F.col("_e.w")) * F.col("_a") + F.col("_e.w") * F.col("_b") == F.col("_e.v"))
        at = with_row_number(at.select("_id", "_top", F.col("_e.i").alias("i"), F.col("_e.k").alias("k")), [F.col("_id")], ["i"], "_k").where("_k <= k")
        hits = {r["i"]: r["h"] for r in at.groupBy("i").agg(F.count_if("_top").alias("h")).collect()}
    out = []
    for i, x in found.groupby("i")[names[:10]].sum().iterrows():
        tt, pp, tp = x["tt"] - x["dt"] ** 2 / n, x["pp"] - x["dp"] ** 2 / n, x["tp"] - x["dt"] * x["dp"] / n
        ratio = lambda c, v, u: float(c / (math.sqrt(v) * math.sqrt(u))) if n >= 3 and v > 0 and u > 0 else None
        flat = x["var"] == 0 or m[3] == 0  # one side is constant
        top = (x["hits"] + hits.get(i, 0)) / (places * places / n)
        out.append((shares[i], n, math.sqrt(x["ee"] / n), x["ae"] / n, None if flat else ratio(tp, tt, pp), ratio(x["cov"], m[3], x["var"]), top))
    return spark.createDataFrame([tuple(None if v is None else int(v) if k == 1 else float(v) for k, v in enumerate(r)) for r in out], "weight double, n bigint, rmse double, mae double, pearson double, spearman double, top10_enrichment double")


def blend_sweep(rows: DataFrame, id_col: str, truth: str, a: str, b: str, shares: list[float], by: list[str] | None = None, task_rows: int = WINDOW_ROWS, part_rows: int = SWEEP_ROWS) -> DataFrame:
    """Metrics of (1 - w) * a + w * b for each share w, optionally by group; the shares are a short stated list.

    Ungrouped rows that no window holds are taken in parts by tasks, as long as all shares have the same rows: an infinite
    score has no blend by some.
    """
    shares = [float(s) for s in shares]
    if not by and len(set(shares)) == len(shares) and all(0 <= s <= 1 for s in shares):
        usable = rows.where(known(truth) & known(a) & known(b)).select(F.col(id_col).alias("_id"), F.col(truth).cast("double").alias("_t"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
        endless = reduce(lambda x, y: x | y, [F.abs(F.col(c)) == math.inf for c in ("_t", "_a", "_b")])
        n, wild = usable.agg(F.count("*"), F.count_if(endless)).first()
        if n > task_rows and not wild and n <= part_rows * SWEEP_PARTS:
            return _sweep_in_parts(usable, n, shares, part_rows)
    many = rows.select(id_col, truth, *(by or []), a, b, F.explode(F.array(*[F.lit(s) for s in shares])).alias("weight"))
    many = many.withColumn("_blend", (F.lit(1.0) - F.col("weight")) * F.col(a) + F.col("weight") * F.col(b))
    return regression_metrics(many, truth, "_blend", id_col, ["weight", *(by or [])], task_rows=task_rows)


def best_of_sweep(metrics: DataFrame, metric: str = "spearman") -> DataFrame:
    """The row with the highest metric, the smallest weight among equals."""
    return metrics.where(F.col(metric).isNotNull()).agg(F.max_by(F.struct("weight", metric), F.struct(F.round(metric, 12), -F.col("weight"))).alias("b")).select("b.*")


def routed_remap(rows: DataFrame, id_col: str, base: str, expert: str, routed: Column, name: str = "score") -> DataFrame:
    """The routed rows keep the multiset of their base scores but take it in the expert's order; the others keep theirs.

    Ties in base or expert are broken by id.
    """
    tagged = stage(rows.withColumn("_routed", F.coalesce(routed & F.col(expert).isNotNull(), F.lit(False))))
    part = tagged.where("_routed")
    by_expert = with_row_number(part.select(id_col, expert), [F.col(expert), F.col(id_col)], [], "_k").select(id_col, "_k")
    by_base = with_row_number(part.select(id_col, base), [F.col(base), F.col(id_col)], [], "_k").select("_k", F.col(base).alias("_new"))
    new = by_expert.join(by_base, "_k").select(id_col, "_new")
    return tagged.join(new, id_col, "left").withColumn(name, F.coalesce("_new", base)).drop("_new", "_routed")


def submission_rank(rows: DataFrame, id_col: str, score: str, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Places 1..n by falling score, then the tie columns, then id; within groups if given."""
    order = [-F.col(score), *[F.col(t) for t in ties or []], F.col(id_col)]
    return with_row_number(rows, order, by or [], "place")


def recovered_expert(blend: Column, base: Column, share: float) -> Column:
    """The expert's score in a blend of which it had `share`, from 0 (not included) to 1."""
    if not 0 < share <= 1:
        raise ValueError("share must lie above 0 and at most at 1")
    return (blend - F.lit(1.0 - share) * base) / F.lit(share)


def nested_blend(rows: DataFrame, inner: tuple, outer: tuple[float, str], name: str = "score", plus: int = 1) -> DataFrame:
    """rows with a blend of ranks over n + plus by fixed weights: of a pair of columns, and of that pair with a third.

    inner is (weight, (weight, column), (weight, column)), outer (weight, column).
    """
    for _, c in (*inner[1:], outer):
        rows = with_rank_over_n(rows, F.col(c), [], f"_q_{c}", plus)
    q = lambda pair: F.lit(pair[0]) * F.col(f"_q_{pair[1]}")
    out = F.lit(inner[0]) * (q(inner[1]) + q(inner[2])) + q(outer)
    return rows.withColumn(name, out).drop(*[f"_q_{c}" for _, c in (*inner[1:], outer)])


def _routed_correlations(now: DataFrame, id_col: str, truth: str, placed: DataFrame, kept: DataFrame, shares: list[float]) -> DataFrame:
    """(weight, spearman) of scores dealt out anew, for any rows: every share's whole table is ranked."""
    routed = now.select(id_col, truth, "_base", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("weight")).join(placed.join(kept, "_k").drop("_k"), [id_col, "weight"], "left").withColumn("_score", F.coalesce("_new", "_base"))
    return regression_metrics(routed, truth, "_score", id_col, ["weight"]).select("weight", "spearman")


def _dealt_correlations(now: DataFrame, placed: DataFrame, kept: DataFrame, shares: list[float]) -> DataFrame:
    """The same where every row has a truth and a score: the set of scores, and with it every score's rank, is then the same for all shares.

    now has ranks less their mean, _rt of the truth and _rb of the score; only the products of the rows dealt to differ by share.
    """
    whole = now.agg(F.count("*").alias("n"), (F.sqrt(F.sum(F.col("_rt") * F.col("_rt"))) * F.sqrt(F.sum(F.col("_rb") * F.col("_rb")))).alias("spread"), F.coalesce(F.sum(F.when(F.col("_x").isNull(), F.col("_rt") * F.col("_rb"))), F.lit(0.0)).alias("rest")).first()
    dealt = placed.join(kept.withColumnRenamed("_rb", "_new_rb"), "_k").groupBy("weight").agg(F.sum(F.col("_rt") * F.col("_new_rb")).alias("cov"))
    weights = now.sparkSession.createDataFrame([(float(s),) for s in shares], "weight double")
    defined = whole["n"] >= 3 and whole["spread"] > 0
    rho = (F.coalesce("cov", F.lit(0.0)) + F.lit(whole["rest"])) / F.lit(whole["spread"]) if defined else F.lit(None).cast("double")
    return weights.join(dealt, "weight", "left").select("weight", rho.alias("spearman"))


def staged_sweep(rows: DataFrame, id_col: str, truth: str, base: str, parent: str, expert: str, shares: list[float], task_rows: int = WINDOW_ROWS) -> DataFrame:
    """(stage, weight, spearman): the parent's share over ranks, then, with the best of it kept, the expert's.

    The expert speaks for the rows where it is not null: they keep their set of scores and take it in the order of base and
    expert ranks blended within them, ties by id. All shares of a stage are ranked in one pass.
    """
    ranked = rows
    for c in (base, parent):
        ranked = with_rank_over_n(ranked, F.col(c), [], f"_r_{c}")
    ranked = stage(ranked.select(id_col, truth, F.col(f"_r_{base}").alias("_a"), F.col(f"_r_{parent}").alias("_b"), F.col(expert).alias("_x")))
    first = stage(blend_sweep(ranked, id_col, truth, "_a", "_b", shares, task_rows=task_rows).select("weight", F.round("spearman", 6).alias("spearman")))
    best = best_of_sweep(first).first()
    weight = float(best["weight"]) if best and best["weight"] is not None else 0.0
    now = ranked.select(id_col, truth, "_x", (F.lit(1.0 - weight) * F.col("_a") + F.lit(weight) * F.col("_b")).alias("_base"))
    n, whole = now.agg(F.count("*"), F.count_if(known(truth) & known("_base"))).first()
    dealt = n == whole and n > task_rows and len(set(shares)) == len(shares)
    if dealt:  # ranks come before the rows are multiplied
        for value, name in ((F.col(truth).cast("double"), "_rt"), (F.col("_base"), "_rb")):
            now = with_ranks(now, value, [], name, "_all", largest=n, window_rows=task_rows).withColumn(name, F.col(name) - (F.col("_all") + 1) / 2.0).drop("_all")
    now = stage(now)
    own = ["_rt"] if dealt else []
    part = now.where("_x is not null")
    part = with_rank_over_n(with_rank_over_n(part, F.col("_base"), [], "_p"), F.col("_x"), [], "_q")
    part = stage(part)
    many = part.select(id_col, *own, "_p", "_q", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("weight"))
    many = many.select(id_col, *own, "weight", ((F.lit(1.0) - F.col("weight")) * F.col("_p") + F.col("weight") * F.col("_q")).alias("_m"))
    placed = with_row_number(many, [F.col("_m"), F.col(id_col)], ["weight"], "_k").select(id_col, *own, "weight", "_k")
    kept = with_row_number(part, [F.col("_base"), F.col(id_col)], [], "_k")
    if dealt:
        second = _dealt_correlations(now, placed, kept.select("_k", "_rb"), shares)
    else:
        second = _routed_correlations(now, id_col, truth, placed, kept.select("_k", F.col("_base").alias("_new")), shares)
    second = second.select("weight", F.round("spearman", 6).alias("spearman"))
    return first.select(F.lit("parent").alias("stage"), "weight", "spearman").union(second.select(F.lit("expert"), "weight", "spearman"))


def scheduled_blends(rows: DataFrame, id_col: str, truth: str, base: str, parent: str, distance: Column, schedules: dict[str, float], usual: float = 0.225, far: float = 0.9) -> DataFrame:
    """Metrics of rank blends by schedule: the parent has `usual` of the weight, and the schedule's where the distance is `far` or more."""
    ranked = rows.withColumn("_far", F.coalesce(distance >= far, F.lit(False)))
    for c in (base, parent):
        ranked = with_rank_over_n(ranked, F.col(c), [], f"_r_{c}")
    many = ranked.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(n).alias("schedule"), F.lit(float(w)).alias("w")) for n, w in schedules.items()])))
    w = F.when(F.col("_far"), F.col("_s.w")).otherwise(F.lit(usual))
    many = many.select(id_col, truth, F.col("_s.schedule").alias("schedule"), ((F.lit(1.0) - w) * F.col(f"_r_{base}") + w * F.col(f"_r_{parent}")).alias("_blend"))
    return regression_metrics(many, truth, "_blend", id_col, ["schedule"])
