"""The queries of the ranking and curation operators over the shared tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import ranks, sequences, values
from sievewright.operators import ensembles, metrics, pairs, quality, splits, vectors, weights
from sievewright.operators.graph import connected_components
from sievewright.session import lookup_join

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RES = sequences.RESIDUES


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def r9(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9).alias(name)


# --- scores and ranks -----------------------------------------------------------------------------------------------

_LABELLED = "raw_label IS NOT NULL AND NOT isnan(raw_label)"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "raw_record").where("raw_label is not null and not isnan(raw_label)").select("raw_id", F.coalesce("comparison_group", "source_file").alias("grp"), (F.col("raw_label") * F.col("direction")).alias("v"))


def _rank_sql(inner: str, value: str, by: str, expr: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    ties = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
    return f"SELECT *, {expr} FROM (SELECT *, rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({ties}) - 1) / 2.0 AS rk, count(*) OVER ({part}) AS sz FROM ({inner}))"


_LAB_SQL = f"SELECT raw_id, coalesce(comparison_group, source_file) AS grp, raw_label * direction AS v FROM raw_record WHERE {_LABELLED}"


@query(f"SELECT raw_id, round(s, 9) AS score FROM ({_rank_sql(_LAB_SQL, 'v', 'grp', 'CASE WHEN sz = 1 THEN 0.5 ELSE (rk - 1) / (sz - 1) END AS s')})")
def grouped_percentile_score(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.with_percentile(_labelled(spark, sf), F.col("v"), ["grp"], "s").select("raw_id", r9("s", "score"))


_EVENTS_SQL = "SELECT event_id, event_type, user_id, value AS truth, value * 0.5 + CAST(user_id % 17 AS DOUBLE) AS a, value * 0.3 + CAST(event_id % 101 AS DOUBLE) AS b FROM events WHERE value IS NOT NULL"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return read(spark, sf, "events").where("value is not null").select("event_id", "event_type", "user_id", v.alias("truth"), (v * F.lit(0.5) + (F.col("user_id") % 17).cast("double")).alias("a"), (v * F.lit(0.3) + (F.col("event_id") % 101).cast("double")).alias("b"))


@query(f"SELECT event_id, round(s, 9) AS score FROM ({_rank_sql(_EVENTS_SQL, 'truth', '', 'rk / sz AS s')})")
def rank_norm_n(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.with_rank_over_n(_events(spark, sf), F.col("truth"), [], "s").select("event_id", r9("s", "score"))


@query(f"SELECT event_id, round(s, 9) AS score FROM ({_rank_sql(_EVENTS_SQL, 'truth', '', 'rk / (sz + 1) AS s')})")
def rank_norm_n_plus_1(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.with_rank_over_n(_events(spark, sf), F.col("truth"), [], "s", 1).select("event_id", r9("s", "score"))


# --- metrics --------------------------------------------------------------------------------------------------------


def metrics_sql(inner: str, truth: str, pred: str, key: str, by: list[str]) -> str:
    """All six metrics by group in SQL."""
    g = ", ".join(by)
    p = f"PARTITION BY {g}" if by else ""
    pt = lambda c: f"PARTITION BY {g + ', ' if by else ''}{c}"
    return f"""
        WITH x AS (SELECT * FROM ({inner})),
        y AS (SELECT *, count(*) OVER ({p}) AS sz, rank() OVER ({p} ORDER BY {truth}) + (count(*) OVER ({pt(truth)}) - 1) / 2.0 AS rt, rank() OVER ({p} ORDER BY {pred}) + (count(*) OVER ({pt(pred)}) - 1) / 2.0 AS rp,
              row_number() OVER ({p} ORDER BY {truth} DESC, {key}) AS ot, row_number() OVER ({p} ORDER BY {pred} DESC, {key}) AS op FROM x),
        z AS (SELECT *, greatest(1.0, ceil(sz * CAST(0.1 AS DOUBLE))) AS c FROM y)
        SELECT {g + ', ' if by else ''}count(*) AS n, round(sqrt(avg(({truth} - {pred}) * ({truth} - {pred}))), 4) AS rmse, round(avg(abs({truth} - {pred})), 4) AS mae,
               round(CASE WHEN count(*) >= 3 AND stddev_pop({truth}) * stddev_pop({pred}) > 0 THEN covar_pop({truth}, {pred}) / (stddev_pop({truth}) * stddev_pop({pred})) END, 6) AS pearson,
               round(CASE WHEN count(*) >= 3 AND stddev_pop(rt) * stddev_pop(rp) > 0 THEN covar_pop(rt, rp) / (stddev_pop(rt) * stddev_pop(rp)) END, 6) AS spearman,
               round(sum(CASE WHEN ot <= c AND op <= c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / max(c * c / sz), 6) AS top10_enrichment
        FROM z {'GROUP BY ' + g if by else ''}"""


def _rounded(m: DataFrame, keep: list[str]) -> DataFrame:
    return m.select(*keep, "n", *[F.round(c, 4 if c in ("rmse", "mae") else 6).alias(c) for c in metrics.METRICS[1:]])


@query(metrics_sql(_EVENTS_SQL, "truth", "a", "event_id", []))
def regression_metrics_global(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.regression_metrics(_events(spark, sf), "truth", "a", "event_id", []), [])


@query(metrics_sql(_EVENTS_SQL, "truth", "a", "event_id", ["event_type"]))
def regression_metrics_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.regression_metrics(_events(spark, sf), "truth", "a", "event_id", ["event_type"]), ["event_type"])


@query(f"""SELECT count(spearman) AS groups, round(avg(spearman), 5) AS macro_spearman, round(avg(CASE WHEN n >= 20 THEN spearman END), 5) AS stable_macro_spearman, count(CASE WHEN n >= 20 THEN spearman END) AS stable_groups,
       round(sum(spearman * n) / sum(CASE WHEN spearman IS NOT NULL THEN n END), 5) AS weighted_spearman, round(median(spearman), 5) AS median_spearman FROM ({metrics_sql(_EVENTS_SQL, 'truth', 'b', 'event_id', ['user_id'])})""")
def macro_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = _rounded(metrics.regression_metrics(_events(spark, sf), "truth", "b", "event_id", ["user_id"]), ["user_id"])
    out = metrics.macro_means(m, 20)
    return out.select(*[F.round(c, 5).alias(c) if c.endswith("spearman") else c for c in out.columns])


_SEED, _CI_ROUNDS, _PAIRED_ROUNDS = 11, 1_000, 2_000
_DRAWS_SQL = f"""
    c AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS k FROM (SELECT DISTINCT cluster FROM e)),
    d AS (SELECT r.round, (CAST('0x' || substr(md5('{_SEED}|' || r.round || '|' || c.k), 1, 12) AS BIGINT) % (SELECT count(*) FROM c)) AS k FROM c, (SELECT unnest(range({{rounds}})) AS round) r),
    t AS (SELECT d.round, c.cluster, count(*) AS times FROM d JOIN c USING (k) GROUP BY 1, 2)"""


def _weighted_rank(c: str) -> str:
    return f"sum(times) OVER (PARTITION BY round ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(times) OVER (PARTITION BY round, {c}) + (sum(times) OVER (PARTITION BY round, {c}) + 1) / 2.0"


def _weighted_rho(s: str) -> str:
    return f"(sum(times * rt * r_{s}) - sum(times * rt) * sum(times * r_{s}) / sum(times)) / sqrt((sum(times * rt * rt) - sum(times * rt) * sum(times * rt) / sum(times)) * (sum(times * r_{s} * r_{s}) - sum(times * r_{s}) * sum(times * r_{s}) / sum(times))) AS rho_{s}"


def _boot_sql(scores: list[str], rounds: int) -> str:
    return f"""WITH e AS (SELECT *, user_id AS cluster FROM ({_EVENTS_SQL}) WHERE user_id IS NOT NULL), {_DRAWS_SQL.format(rounds=rounds)},
        x AS (SELECT t.round, CAST(t.times AS DOUBLE) AS times, e.* FROM e JOIN t USING (cluster)),
        y AS (SELECT *, CAST({_weighted_rank('truth')} AS DOUBLE) AS rt, {', '.join(f'CAST({_weighted_rank(s)} AS DOUBLE) AS r_{s}' for s in scores)} FROM x),
        b AS (SELECT round, {', '.join(map(_weighted_rho, scores))} FROM y GROUP BY round)"""


def _boot(spark: SparkSession, sf: str, scores: list[str], rounds: int) -> DataFrame:
    return metrics.bootstrap_correlations(_events(spark, sf), "truth", scores, "user_id", rounds, _SEED)


@query(_boot_sql(["b"], _CI_ROUNDS) + "SELECT count(rho_b) AS rounds_valid, round(quantile_cont(rho_b, 0.025), 6) AS low, round(quantile_cont(rho_b, 0.5), 6) AS median, round(quantile_cont(rho_b, 0.975), 6) AS high FROM b")
def cluster_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.bootstrap_interval(_boot(spark, sf, ["b"], _CI_ROUNDS), "rho_b")
    return out.select("rounds_valid", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")])


@query(_boot_sql(["a", "b"], _PAIRED_ROUNDS) + """SELECT round(avg(rho_b - rho_a), 6) AS mean_delta, round(stddev_samp(rho_b - rho_a), 6) AS sd_delta, round(quantile_cont(rho_b - rho_a, 0.025), 6) AS low, round(quantile_cont(rho_b - rho_a, 0.975), 6) AS high,
       avg(CASE WHEN rho_b > rho_a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p_better FROM b""")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.paired_delta(_boot(spark, sf, ["a", "b"], _PAIRED_ROUNDS), "rho_a", "rho_b")
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean_delta", "sd_delta", "low", "high")], "p_better")


_PERM_SQL = f"""SELECT h.event_id, t.truth AS permuted, h.a FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM ({_EVENTS_SQL})) h
    JOIN (SELECT truth, row_number() OVER (ORDER BY md5('5|' || event_id), event_id) AS k FROM ({_EVENTS_SQL})) t USING (k)"""


@query(f"SELECT n, spearman FROM ({metrics_sql(_PERM_SQL, 'permuted', 'a', 'event_id', [])})")
def label_permutation(spark: SparkSession, sf: str) -> DataFrame:
    shuffled = metrics.permuted_truth(_events(spark, sf), "truth", "event_id", 5)
    return _rounded(metrics.regression_metrics(shuffled, "permuted", "a", "event_id", []), []).select("n", "spearman")


@query(f"""WITH m AS ({metrics_sql(_EVENTS_SQL, 'truth', 'a', 'event_id', ['event_type'])}) SELECT round(0.5 * avg(spearman) + 0.25 * min(spearman) + 0.25 * max(spearman), 5) AS composite FROM m""")
def selection_composite(spark: SparkSession, sf: str) -> DataFrame:
    m = _rounded(metrics.regression_metrics(_events(spark, sf), "truth", "a", "event_id", ["event_type"]), ["event_type"])
    return m.agg(F.round(metrics.selection_composite(F.avg("spearman"), F.min("spearman"), F.max("spearman")), 5).alias("composite"))


@query(f"SELECT * FROM ({metrics_sql(_EVENTS_SQL.replace('SELECT event_id,', 'SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 2 = 0 THEN {q}seen{q} ELSE {q}held{q} END AS regime,'.replace('{q}', chr(39))), 'truth', 'a', 'event_id', ['regime'])}) WHERE regime IS NOT NULL")
def regime_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).withColumn("regime", F.when(F.col("user_id") % 5 == 0, None).when(F.col("user_id") % 2 == 0, "seen").otherwise("held")).where("regime is not null")
    return _rounded(metrics.regression_metrics(rows, "truth", "a", "event_id", ["regime"]), ["regime"])


# --- alignment and ensembles ----------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT event_id FROM events WHERE value IS NOT NULL), p AS (SELECT event_id FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT -event_id - 1 FROM events WHERE event_id % 11 = 0),
    a AS (SELECT event_id, count(*) AS c FROM t GROUP BY 1), b AS (SELECT event_id, count(*) AS c FROM p GROUP BY 1)
    SELECT count(*) FILTER (a.c IS NOT NULL AND b.c IS NOT NULL) AS matched, count(*) FILTER (b.c IS NULL) AS missing, count(*) FILTER (a.c IS NULL) AS extra, count(*) FILTER (a.c > 1 OR b.c > 1) AS repeated FROM a FULL JOIN b USING (event_id)""")
def strict_align_check(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    prediction = e.where("event_id % 7 <> 0").select("event_id").union(e.where("event_id % 11 = 0").select(-F.col("event_id") - 1))
    return ensembles.alignment_report(e.where("value is not null").select("event_id"), prediction, "event_id")


@query(f"SELECT event_id, round(truth, 9) AS truth, round(a, 9) AS a, round(b, 9) AS b FROM ({_EVENTS_SQL}) WHERE event_id % 3 <> 0 AND event_id % 2 = 0")
def intersection_align(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    rows = ensembles.intersection_align(e.where("event_id % 3 <> 0").select("event_id", "truth", "a"), e.where("event_id % 2 = 0").select("event_id", "truth", "b"), "event_id", "truth")
    return rows.select("event_id", r9("truth", "truth"), r9("a", "a"), r9("b", "b"))


_BLEND_SQL = f"""WITH x AS ({_EVENTS_SQL}), y AS (SELECT *, {{p}} FROM x) SELECT event_id, round({{e}}, 9) AS score FROM y"""
_avg_rank = lambda c, by: f"(rank() OVER ({by} ORDER BY {c}) + (count(*) OVER ({by + ',' if by else 'PARTITION BY'} {c}) - 1) / 2.0)"


@query(_BLEND_SQL.format(p=", ".join(f"({_avg_rank(c, 'PARTITION BY event_type')} - 1) / (count(*) OVER (PARTITION BY event_type) - 1) AS q_{c}" for c in "ab"), e="q_a * (0.65::DOUBLE / 1.0::DOUBLE) + q_b * (0.35::DOUBLE / 1.0::DOUBLE)"))
def ensemble_percentile(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    aligned = ensembles.strict_align({"a": e.select("event_id", F.col("a").alias("s")), "b": e.select("event_id", F.col("b").alias("s"))}, "event_id", "s").join(e.select("event_id", "event_type"), "event_id")
    return ensembles.percentile_blend(aligned, {"a": 0.65, "b": 0.35}, ["event_type"]).select("event_id", r9("score", "score"))


@query(_BLEND_SQL.format(p=", ".join(f"{_avg_rank(c, '')} / (count(*) OVER () + 1) AS q_{c}" for c in "ab"), e="q_a * 0.65::DOUBLE + q_b * 0.35::DOUBLE"))
def ensemble_global_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ensembles.global_rank_blend(_events(spark, sf), {"a": 0.65, "b": 0.35}).select("event_id", r9("score", "score"))


_SHARES = [round(0.025 * i, 3) for i in range(21)]
_SWEEP_SQL = f"SELECT e.*, w.weight, (1.0::DOUBLE - w.weight) * e.a + w.weight * e.b AS blend FROM ({_EVENTS_SQL}) e, (SELECT unnest([{', '.join(map(str, _SHARES))}]::DOUBLE[]) AS weight) w"


@query(metrics_sql(_SWEEP_SQL, "truth", "blend", "event_id", ["weight"]))
def blend_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ensembles.blend_sweep(_events(spark, sf), "event_id", "truth", "a", "b", _SHARES), ["weight"])


@query(f"SELECT weight, spearman FROM ({metrics_sql(_SWEEP_SQL, 'truth', 'blend', 'event_id', ['weight'])}) ORDER BY spearman DESC, weight LIMIT 1")
def sweep_argmax(spark: SparkSession, sf: str) -> DataFrame:
    m = _rounded(ensembles.blend_sweep(_events(spark, sf), "event_id", "truth", "a", "b", _SHARES), ["weight"])
    return ensembles.best_of_sweep(m)


@query(f"""WITH x AS ({_EVENTS_SQL}), p AS (SELECT * FROM x WHERE event_type = (SELECT min(event_type) FROM events)),
    n AS (SELECT e.event_id, b.a AS new FROM (SELECT event_id, row_number() OVER (ORDER BY b, event_id) AS k FROM p) e JOIN (SELECT a, row_number() OVER (ORDER BY a, event_id) AS k FROM p) b USING (k))
    SELECT x.event_id, round(coalesce(n.new, x.a), 9) AS score FROM x LEFT JOIN n USING (event_id)""")
def routed_rank_remap(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    first = e.agg(F.min("event_type")).first()[0]
    return ensembles.routed_remap(e, "event_id", "a", "b", F.col("event_type") == first).select("event_id", r9("score", "score"))


@query(f"SELECT event_id, row_number() OVER (ORDER BY a DESC, event_id) AS place FROM ({_EVENTS_SQL})")
def submission_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ensembles.submission_rank(_events(spark, sf), "event_id", "a").select("event_id", "place")


_MEANS_SQL = "SELECT antigen_id, coalesce(heavy, '') AS heavy, coalesce(light, '') AS light, avg(score) AS score, count(DISTINCT source_file) AS source_count FROM (SELECT DISTINCT * FROM math_demo) WHERE antigen_id IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2, 3"


def _means(spark: SparkSession, sf: str) -> DataFrame:
    demo = read(spark, sf, "math_demo").distinct().where("antigen_id is not null and score is not null").withColumn("heavy", F.coalesce("heavy", F.lit(""))).withColumn("light", F.coalesce("light", F.lit("")))
    return weights.group_means(demo, ["antigen_id", "heavy", "light"], "score", "source_file")


@query(f"SELECT antigen_id, heavy, light, row_number() OVER (PARTITION BY antigen_id ORDER BY round(score, 9) DESC, heavy, light) AS place FROM ({_MEANS_SQL})")
def rank_per_target(spark: SparkSession, sf: str) -> DataFrame:
    rows = _means(spark, sf).withColumn("score", F.round("score", 9))
    return ranks.with_row_number(rows, [-F.col("score"), F.col("heavy"), F.col("light")], ["antigen_id"], "place").select("antigen_id", "heavy", "light", "place")


@query(f"SELECT antigen_id, heavy, light, round(score, 9) AS score, source_count FROM ({_MEANS_SQL})")
def export_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _means(spark, sf).select("antigen_id", "heavy", "light", r9("score", "score"), "source_count")


# --- weights --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, round(w / avg(w) OVER (), 9) AS weight FROM (SELECT doc_id, pow(count(*) OVER (PARTITION BY source)::DOUBLE, -0.5::DOUBLE) AS w FROM documents WHERE source IS NOT NULL)")
def source_balance_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").where("source is not null").select("doc_id", "source")
    return weights.source_balance(rows, "source", 0.5).select("doc_id", r9("weight", "weight"))


@query("""SELECT value_id, round(w / avg(w) OVER (), 9) AS weight FROM (SELECT a.value_id, pow(least(count(*) OVER (PARTITION BY a.source_file), 200)::DOUBLE, 0.4::DOUBLE) / count(*) OVER (PARTITION BY a.source_file) * CASE r.tier WHEN 'Gold' THEN 1.0 WHEN 'Silver' THEN 0.65 WHEN 'Weak' THEN 0.25 ELSE 0.0 END AS w
    FROM assay_value a JOIN label_registry r USING (source_file))""")
def temperature_weights(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.create_map(*[F.lit(x) for p in values.QUALITY_BY_TIER.items() for x in p])[F.col("tier")]
    rows = lookup_join(read(spark, sf, "assay_value").select("value_id", "source_file"), read(spark, sf, "label_registry").select("source_file", "tier"), ["source_file"], "inner", 64)
    return weights.temperature(rows, "source_file", F.coalesce(tier, F.lit(0.0)), 0.4, 200).select("value_id", r9("weight", "weight"))


_TIER_TEXT = "CASE tier WHEN 'Gold' THEN '1.0' WHEN 'Silver' THEN ' 0.65' WHEN 'Weak' THEN '0.01' ELSE '' END"


@query(f"SELECT source_file, least(1.0::DOUBLE, greatest(0.05::DOUBLE, coalesce(try_cast(nullif(trim(q), '') AS DOUBLE), 1.0::DOUBLE))) AS weight FROM (SELECT source_file, {_TIER_TEXT} AS q FROM label_registry)")
def quality_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights from a quality given as text: clamped, 1 where it is blank."""
    text = F.when(F.col("tier") == "Gold", "1.0").when(F.col("tier") == "Silver", " 0.65").when(F.col("tier") == "Weak", "0.01").otherwise("")
    return read(spark, sf, "label_registry").select("source_file", values.quality_weight(text).alias("weight"))


@query("""WITH g AS (SELECT coalesce(heavy, '') AS heavy, coalesce(light, '') AS light, avg(score) AS score, count(*) AS replicates FROM math_demo WHERE score IS NOT NULL GROUP BY 1, 2)
    SELECT heavy, light, round(score, 9) AS score, replicates, CAST(unnest(range(1, greatest(1, round_even(pow(replicates, 0.5), 0))::BIGINT + 1)) AS INTEGER) AS copy FROM g""")
def replicate_collapse(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "math_demo").where("score is not null").select(F.coalesce("heavy", F.lit("")).alias("heavy"), F.coalesce("light", F.lit("")).alias("light"), "score")
    return weights.collapse_replicates(rows, ["heavy", "light"], "score", 0.5).select("heavy", "light", r9("score", "score"), "replicates", "copy")


# --- sequences and numbers ------------------------------------------------------------------------------------------

_SEQ = lambda c: f"upper(regexp_replace(coalesce({c}, ''), '[^A-Za-z]', '', 'g'))"
_NORM = lambda c: f"CASE WHEN regexp_full_match({_SEQ(c)}, '[{RES}]+') THEN {_SEQ(c)} ELSE '' END"
_COUNT = lambda s, letters: f"(length({s}) - length(translate({s}, '{letters}', '')))"


@query(f"SELECT raw_id, {_NORM('heavy')} AS heavy, {_NORM('light')} AS light, {_NORM('antigen_seq')} AS antigen_seq FROM raw_record")
def normalize_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "raw_record").select("raw_id", *[sequences.normalize_sequence(F.col(c)).alias(c) for c in ("heavy", "light", "antigen_seq")])


@query(f"SELECT raw_id, CASE WHEN trim(coalesce(light, '')) = '' THEN 'missing' WHEN {_NORM('light')} = '' THEN 'invalid' ELSE 'valid' END AS state FROM raw_record")
def sequence_state(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "raw_record").select("raw_id", sequences.sequence_state(F.col("light"))["state"].alias("state"))


_NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_CELL = "replace(trim(coalesce(value_text, '')), ',', '')"
_IN = lambda xs: "(" + ", ".join("'" + x + "'" for x in xs) + ")"
_PARSED = f"CASE WHEN lower({_CELL}) IN {_IN(values.MISSING)} THEN NULL WHEN lower({_CELL}) IN {_IN(values.TRUE)} THEN 1.0::DOUBLE WHEN lower({_CELL}) IN {_IN(values.FALSE)} THEN 0.0::DOUBLE ELSE try_cast(nullif(regexp_extract({_CELL}, '{_NUM}'), '') AS DOUBLE) END"


@query(f"SELECT value_id, {_PARSED} AS number FROM assay_value")
def parse_number(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "assay_value").select("value_id", values.parse_number(F.col("value_text")).alias("number"))


@query(f"SELECT value_id, CASE WHEN regexp_full_match({_CELL}, '{_NUM}') THEN try_cast({_CELL} AS DOUBLE) END AS value, regexp_matches({_CELL}, '^\\s*[<>]=?') AS censored FROM assay_value")
def censored_number(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "assay_value").select("value_id", values.censored_number(F.col("value_text")).alias("x")).select("value_id", "x.value", "x.censored")


_HEAVY = f"SELECT raw_id, {_NORM('heavy')} AS h, {_NORM('light')} AS l, {_NORM('antigen_seq')} AS g, {_NORM('cdrh3')} AS c FROM raw_record"


def _chains(spark: SparkSession, sf: str) -> DataFrame:
    n = sequences.normalize_sequence
    return read(spark, sf, "raw_record").select("raw_id", n(F.col("heavy")).alias("h"), n(F.col("light")).alias("l"), n(F.col("antigen_seq")).alias("g"), n(F.col("cdrh3")).alias("c"))


@query(f"""SELECT raw_id, round(length(h) / 1000.0::DOUBLE, 9) AS length_k, round({_COUNT('h', 'AVILMFWY')}::DOUBLE / greatest(length(h), 1), 9) AS hydrophobic, round(({_COUNT('h', 'KRH')} - {_COUNT('h', 'DE')})::DOUBLE / greatest(length(h), 1), 9) AS net_charge,
    round({_COUNT('h', 'C')}::DOUBLE / greatest(length(h), 1), 9) AS cysteine, round({_COUNT('h', 'P')}::DOUBLE / greatest(length(h), 1), 9) AS proline FROM ({_HEAVY})""")
def numeric_sequence_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chains(spark, sf).select("raw_id", *sequences.numeric_features(F.col("h")))
    return rows.select("raw_id", *[r9(c, c) for c in rows.columns[1:]])


@query(f"""SELECT raw_id, len(regexp_extract_all(h, 'N[^P][ST]'))::INTEGER AS glycosylation_motifs, len(regexp_extract_all(h, 'N[GSHT]'))::INTEGER AS deamidation_motifs, len(regexp_extract_all(h, 'D[GST]'))::INTEGER AS isomerization_motifs, {_COUNT('h', 'MW')}::INTEGER AS oxidation_residues, {_COUNT('h', 'C')}::INTEGER AS cysteine_count,
    round(0.08::DOUBLE * len(regexp_extract_all(h, 'N[^P][ST]')) + 0.04::DOUBLE * greatest({_COUNT('h', 'C')} - 4, 0) + 0.3::DOUBLE * greatest({_COUNT('h', 'AVILMFWY')}::DOUBLE / greatest(length(h), 1) - 0.45::DOUBLE, 0.0) + 0.01::DOUBLE * len(regexp_extract_all(h, 'N[GSHT]')) + 0.01::DOUBLE * len(regexp_extract_all(h, 'D[GST]')), 9) AS liability_penalty FROM ({_HEAVY})""")
def liability_motifs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chains(spark, sf).select("raw_id", *sequences.liabilities(F.col("h")))
    return rows.select("raw_id", "glycosylation_motifs", "deamidation_motifs", "isomerization_motifs", "oxidation_residues", "cysteine_count", r9("liability_penalty", "liability_penalty"))


_DISTINCT = lambda s: f"(CASE WHEN length({s}) >= 3 THEN list_reduce(list_transform(range(1, length({s}) - 1), lambda i: [substr({s}, i, 3)]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) ELSE []::VARCHAR[] END)"
_SAMPLED = lambda k: f"(CASE WHEN len({k}) <= 16 THEN {k} ELSE list_transform(range(0, 16), lambda j: {k}[CAST(floor(j * (len({k}) - 1)::DOUBLE / 15::DOUBLE) AS BIGINT) + 1]) END)"


@query(f"SELECT raw_id, array_to_string({_SAMPLED('k')}, ' ') AS kmers FROM (SELECT raw_id, {_DISTINCT('h')} AS k FROM ({_HEAVY}))")
def kmers_sampled(spark: SparkSession, sf: str) -> DataFrame:
    return _chains(spark, sf).select("raw_id", F.array_join(sequences.sampled_kmers(F.col("h")), " ").alias("kmers"))


@query(f"""WITH r AS (SELECT raw_id, {_DISTINCT("((CASE WHEN c <> '' THEN c ELSE right(h, 36) END) || right(l, 24))")} AS a, {_DISTINCT('g')} AS b, g FROM ({_HEAVY})), s AS (SELECT raw_id, {_SAMPLED('a')} AS a, {_SAMPLED('b')} AS b, g FROM r)
    SELECT raw_id, CASE WHEN g = '' THEN '' ELSE array_to_string(flatten(list_transform(a, lambda x: list_transform(b, lambda y: 'X_' || x || '_' || y))), ' ') END AS tokens FROM s""")
def interaction_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _chains(spark, sf).select("raw_id", F.array_join(sequences.interaction_tokens(F.col("h"), F.col("l"), F.col("c"), F.col("g")), " ").alias("tokens"))


_TAIL = lambda s: "(" + " || ".join(f"substr(right({s}, 36), {i}, 1)" for i in range(1, 37, 6)) + ")"
_OR = lambda v: f"CASE WHEN l <> '' THEN {v} ELSE 'VHH' END"
_KEY = lambda parts: "substr(sha256(" + " || chr(31) || ".join(f"({p})" for p in parts) + "), 1, 24)"
_FAMILY = ["substr(h, 1, 20)", "(length(h) // 5)::VARCHAR", _OR("substr(l, 1, 20)"), "(length(l) // 5)::VARCHAR"]


@query(f"SELECT raw_id, {_KEY([*_FAMILY, _TAIL('h'), _OR(_TAIL('l'))])} AS family_key FROM ({_HEAVY})")
def family_key_v2(spark: SparkSession, sf: str) -> DataFrame:
    return _chains(spark, sf).select("raw_id", sequences.family_key(F.col("h"), F.col("l")).alias("family_key"))


_CDR_LENGTH = "CASE WHEN c <> '' THEN length(c)::VARCHAR ELSE 'unknown_cdrh3' END"


@query(f"SELECT raw_id, {_KEY([*_FAMILY, _CDR_LENGTH, _TAIL('h'), _OR(_TAIL('l'))])} AS family_key FROM ({_HEAVY})")
def family_key_v1(spark: SparkSession, sf: str) -> DataFrame:
    return _chains(spark, sf).select("raw_id", sequences.family_key(F.col("h"), F.col("l"), F.col("c")).alias("family_key"))


@query(f"SELECT raw_id, {_KEY(['(length(h) // 5)::VARCHAR', '(length(l) // 5)::VARCHAR', 'substr(h, 1, 24) || right(h, 18)', _OR('substr(l, 1, 24) || right(l, 18)'), 'CASE WHEN c <> chr(0) AND length(c) > 0 THEN c ELSE substr(right(h, 28), 1, greatest(least(length(h), 28) - 8, 0)) END'])} AS family_key FROM ({_HEAVY})")
def antibody_family_key(spark: SparkSession, sf: str) -> DataFrame:
    return _chains(spark, sf).select("raw_id", sequences.antibody_family_key(F.col("h"), F.col("l"), F.col("c")).alias("family_key"))


@query("SELECT raw_id, substr(sha256(coalesce(source_file, '') || chr(31) || coalesce(antigen_id, '') || chr(31) || coalesce(heavy, '') || chr(31) || coalesce(light, '')), 1, 24) AS stable_id FROM raw_record")
def stable_record_id(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "raw_record").select("raw_id", values.stable_id([F.col(c) for c in ("source_file", "antigen_id", "heavy", "light")]).alias("stable_id"))


@query("""SELECT record_id, CASE WHEN trim(coalesce(source_file, '')) <> '' AND trim(coalesce(antigen_id, '')) <> '' THEN 'source_file=' || trim(source_file) || chr(31) || 'antigen_id=' || trim(antigen_id) WHEN trim(coalesce(source_file, '')) <> '' THEN 'source_file=' || trim(source_file)
    WHEN trim(coalesce(antigen_id, '')) <> '' THEN 'antigen_id=' || trim(antigen_id) WHEN trim(coalesce(source_group, '')) <> '' THEN 'source_group=' || trim(source_group) ELSE '' END AS comparison_group FROM math_demo""")
def comparison_groups(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "math_demo").select("record_id", values.comparison_group(F.lit(None).cast("string"), {"source_file": F.col("source_file"), "antigen_id": F.col("antigen_id")}, F.col("source_group")).alias("comparison_group"))


@query(f"""SELECT a.value_id, coalesce(v IS NOT NULL AND (r.censor_policy NOT IN ('require_positive_finite', 'require_positive_and_below_max') OR v > 0) AND (try_cast(r.valid_min AS DOUBLE) IS NULL OR v >= try_cast(r.valid_min AS DOUBLE)) AND (try_cast(r.valid_max AS DOUBLE) IS NULL OR v <= try_cast(r.valid_max AS DOUBLE)) AND (r.metric <> 'binding_class' OR v IN (0.0, 1.0)), false) AS valid
    FROM (SELECT *, {_PARSED} AS v FROM assay_value) a JOIN label_registry r USING (source_file)""")
def label_validity(spark: SparkSession, sf: str) -> DataFrame:
    rows = lookup_join(read(spark, sf, "assay_value"), read(spark, sf, "label_registry").select("source_file", "censor_policy", "valid_min", "valid_max", "metric"), ["source_file"], "inner", 128)
    return rows.select("value_id", values.label_is_valid(values.parse_number(F.col("value_text")), F.col("censor_policy"), F.col("valid_min"), F.col("valid_max"), F.col("metric")).alias("valid"))


@query("""WITH m AS (SELECT source_file, avg(score) AS s, count(score)::DOUBLE / count(*) AS q FROM math_demo WHERE source_file IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY round(s, 9) DESC NULLS LAST, source_file) AS place, count(*) OVER () AS n FROM m)
    SELECT source_file, place, round(100.0::DOUBLE * (n - place) / (n - 1), 9) AS points, round(0.7::DOUBLE * (100.0::DOUBLE * (n - place) / (n - 1)) + 0.2::DOUBLE * (100 * q) + 0.1::DOUBLE * 50, 6) AS final FROM r""")
def place_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points by place and the weighted final score of every source."""
    mean = read(spark, sf, "math_demo").where("source_file is not null").groupBy("source_file").agg(F.coalesce(F.round(F.avg("score"), 9), F.lit(-1.0)).alias("s"), (F.count("score") / F.count("*")).alias("q"))
    rows = ranks.with_row_number(mean, [-F.col("s"), F.col("source_file")], [], "place")
    points = F.lit(100.0) * (F.count("*").over(Window.partitionBy()) - F.col("place")) / (F.count("*").over(Window.partitionBy()) - 1)
    return rows.withColumn("p", points).select("source_file", "place", r9("p", "points"), F.round(values.final_score(F.col("p"), F.lit(100) * F.col("q"), F.lit(50)), 6).alias("final"))


# --- splits and leakage ---------------------------------------------------------------------------------------------

_U64 = lambda x: f"('0x' || substr(sha256({x}), 1, 16))::UBIGINT"


@query(f"SELECT DISTINCT source_file, CAST({_U64('source_file')} % 100 AS INTEGER) AS bucket FROM label_registry")
def stable_bucket_split(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "label_registry").select("source_file", values.stable_bucket(F.col("source_file")).alias("bucket")).distinct()


_IDENT = "coalesce(heavy, '') || chr(31) || coalesce(light, '')"


@query(f"SELECT record_id, CASE WHEN u < 0.70 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS new_split FROM (SELECT record_id, {_U64(_IDENT)}::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM math_demo)")
def identity_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.identity_split(read(spark, sf, "math_demo"), sequences.pair_key(F.col("heavy"), F.col("light")), "new_split").select("record_id", "new_split")


def _hash_split_sql(groups: str, g: str) -> str:
    return f"""WITH g AS ({groups}), n AS (SELECT count(*) AS n FROM g), c AS (SELECT n, greatest(1, round_even(n * 0.70::DOUBLE, 0)) AS a, greatest(1, round_even(n * 0.15::DOUBLE, 0)) AS b FROM n),
        d AS (SELECT CASE WHEN a + b >= n THEN n - 2 ELSE a END AS a, CASE WHEN a + b >= n THEN 1 ELSE b END AS b FROM c),
        k AS (SELECT {g}, row_number() OVER (ORDER BY sha256({g}), {g}) AS k FROM g) SELECT {g}, CASE WHEN k <= a THEN 'train' WHEN k <= a + b THEN 'validation' ELSE 'test' END AS split FROM k, d"""


@query(_hash_split_sql("SELECT DISTINCT source_group FROM label_registry WHERE source_group IS NOT NULL", "source_group"))
def group_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.group_hash_split(read(spark, sf, "label_registry"), "source_group")


@query(f"""WITH g AS (SELECT DISTINCT source_group AS s FROM label_registry WHERE source_group IS NOT NULL), h AS (SELECT s, {_U64('s')} % 100 < 20 AS hit FROM g), c AS (SELECT count(*) AS n, count(*) FILTER (hit) AS k, min(s) AS lo, max(s) AS hi FROM h)
    SELECT s AS source_group, CASE WHEN (k = 0 AND s = hi) OR (k > 0 AND hit AND NOT (k = n AND n > 1 AND s = lo)) THEN 'test' ELSE 'train' END AS split FROM h, c""")
def source_heldout_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.source_held_out(read(spark, sf, "label_registry"), "source_group", 20)


@query("SELECT source_file, CASE WHEN publication_year <= 2022 THEN 'train' WHEN publication_year = 2023 THEN 'validation' ELSE 'test' END AS split FROM label_registry WHERE publication_year IS NOT NULL")
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "label_registry").where("publication_year is not null").select("source_file", values.time_split(F.col("publication_year")).alias("split"))


@query()
def family_split_greedy(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chains(spark, sf).where("h <> ''").select(sequences.family_key(F.col("h"), F.col("l")).alias("family"))
    return splits.greedy_balance(rows, "family", {"train": 0.7, "validation": 0.15, "test": 0.15})


_CHAIN_KEY = "nullif(upper(regexp_replace(coalesce(heavy, ''), '[^A-Za-z]', '', 'g')), '')"
_PRIO = "CASE lower(trim(split)) WHEN 'test' THEN 0 WHEN 'validation' THEN 1 WHEN 'train' THEN 2 END"


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "math_demo").select("record_id", F.lower(F.trim("split")).alias("split"), F.nullif(F.upper(F.regexp_replace(F.coalesce("heavy", F.lit("")), "[^A-Za-z]", "")), F.lit("")).alias("key"))


@query(f"SELECT record_id, split FROM (SELECT record_id, lower(trim(split)) AS split, {_CHAIN_KEY} AS k, {_PRIO} AS p, min({_PRIO}) OVER (PARTITION BY {_CHAIN_KEY}) AS best FROM math_demo) WHERE k IS NULL OR p IS NULL OR best IS NULL OR p = best")
def leakage_purge(spark: SparkSession, sf: str) -> DataFrame:
    return splits.purge_leakage(_keyed(spark, sf), F.col("key"), "split").select("record_id", "split")


@query(f"SELECT k AS key, count(DISTINCT s) AS splits FROM (SELECT {_CHAIN_KEY} AS k, lower(trim(split)) AS s FROM math_demo) WHERE k IS NOT NULL AND s IS NOT NULL GROUP BY k HAVING count(DISTINCT s) > 1")
def leakage_validate(spark: SparkSession, sf: str) -> DataFrame:
    return splits.leaking_keys(_keyed(spark, sf), F.col("key"), "split")


@query("SELECT record_id, min(scored_at) AS scored_at, arg_min(task_name, {'a': scored_at, 'b': task_name}) AS task_name FROM score_row GROUP BY record_id")
def dedup_first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return splits.first_occurrence(read(spark, sf, "score_row").select("record_id", "scored_at", "task_name"), ["record_id"], [F.col("scored_at"), F.col("task_name")]).select("record_id", "scored_at", "task_name")


@query("SELECT min(record_id) AS record_id FROM math_demo GROUP BY heavy, light, score, split")
def biological_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "math_demo").select("record_id", "heavy", "light", "score", "split")
    return splits.first_occurrence(rows, ["heavy", "light", "score", "split"], [F.col("record_id")]).select("record_id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT antigen_id AS u, 's' || source_file AS v FROM math_demo WHERE antigen_id IS NOT NULL AND source_file IS NOT NULL), x AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
    c(node, root) USING KEY (node) AS (SELECT DISTINCT u, u FROM x UNION SELECT x.v, min(c.root) FROM c JOIN x ON x.u = c.node JOIN recurring.c AS r ON r.node = x.v WHERE c.root < r.root GROUP BY x.v) SELECT node, root FROM c""")
def connected_sets(spark: SparkSession, sf: str) -> DataFrame:
    edges = read(spark, sf, "math_demo").where("antigen_id is not null and source_file is not null").select(F.col("antigen_id").alias("u"), F.concat(F.lit("s"), "source_file").alias("v")).distinct()
    return connected_components(edges)


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('3|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 25")
def hash_sample_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return splits.hash_sample(read(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", 25, 3)


# --- joins to registries --------------------------------------------------------------------------------------------


@query("SELECT r.raw_id, g.source_group FROM raw_record r JOIN label_registry g USING (source_file)")
def split_manifest_join(spark: SparkSession, sf: str) -> DataFrame:
    return splits.check_manifest(read(spark, sf, "raw_record").select("raw_id", "source_file"), read(spark, sf, "label_registry").select("source_file", "source_group"), "source_file").select("raw_id", "source_group")


@query("SELECT raw_id FROM raw_record WHERE source_file IN (SELECT source_file FROM label_registry WHERE supervised_use = 'yes')")
def registry_gate(spark: SparkSession, sf: str) -> DataFrame:
    allowed = read(spark, sf, "label_registry").where("supervised_use = 'yes'").select("source_file").distinct()
    return lookup_join(read(spark, sf, "raw_record").select("raw_id", "source_file"), allowed, ["source_file"], "inner", 64).select("raw_id")


_RULES = [("source_contains", "panel", "route_by_metric"), ("source_contains", "_kd_", "kinetic"), ("source_contains", "_fit_", "fitness"), ("metric", "KD", "affinity"), ("metric", "negative_log10_KD", "affinity"), ("metric", "IC50", "potency"), ("metric", "EC50", "potency")]
_BY_METRIC = "CASE metric WHEN 'KD' THEN 'affinity' WHEN 'negative_log10_KD' THEN 'affinity' WHEN 'IC50' THEN 'potency' WHEN 'EC50' THEN 'potency' ELSE 'unsupervised' END"


@query(f"SELECT source_file, CASE WHEN contains(source_file, 'panel') THEN {_BY_METRIC} WHEN contains(source_file, '_kd_') THEN 'kinetic' WHEN contains(source_file, '_fit_') THEN 'fitness' ELSE {_BY_METRIC} END AS route FROM label_registry")
def policy_routing(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "label_registry").select("source_file", values.first_match(_RULES, F.col("source_file"), F.col("metric"), "unsupervised").alias("route"))


@query("SELECT r.raw_id, coalesce(d.score, CASE WHEN NOT isnan(r.raw_label) THEN r.raw_label END) AS label FROM raw_record r LEFT JOIN (SELECT antigen_id, min(score) AS score FROM math_demo WHERE score IS NOT NULL GROUP BY antigen_id) d USING (antigen_id)")
def update_merge(spark: SparkSession, sf: str) -> DataFrame:
    new = read(spark, sf, "math_demo").where("score is not null and antigen_id is not null").groupBy("antigen_id").agg(F.min("score").alias("score"))
    rows = lookup_join(read(spark, sf, "raw_record").select("raw_id", "antigen_id", "raw_label"), new, ["antigen_id"], "left", 64)
    return rows.select("raw_id", F.coalesce("score", values.finite(F.col("raw_label"))).alias("label"))



_CURATED_SQL = f"""WITH r AS (SELECT r.raw_id, r.source_file, g.source_group, {_NORM('heavy')} AS h, {_NORM('light')} AS l, {_NORM('antigen_seq')} AS s, r.raw_label * r.direction AS v, coalesce(r.comparison_group, r.source_file) AS grp FROM raw_record r JOIN label_registry g USING (source_file)
        WHERE g.supervised_use = 'yes' AND r.raw_label IS NOT NULL AND NOT isnan(r.raw_label) AND (g.censor_policy NOT IN ('require_positive_finite', 'require_positive_and_below_max') OR r.raw_label > 0)),
    k AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY v) + (count(*) OVER (PARTITION BY grp, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY grp) AS sz FROM r WHERE h <> ''),
    d AS (SELECT *, row_number() OVER (PARTITION BY source_group, h, l, s ORDER BY raw_id) AS o FROM k)
    SELECT raw_id, source_group, round(CASE WHEN sz = 1 THEN 0.5 ELSE (rk - 1) / (sz - 1) END, 9) AS score FROM d WHERE o = 1"""


@query(_CURATED_SQL)
def curated_records(spark: SparkSession, sf: str) -> DataFrame:
    """Registry gate, label policy, percentile within the comparison group, then the first record of each chain triple in its source group."""
    n = sequences.normalize_sequence
    registry = read(spark, sf, "label_registry").where("supervised_use = 'yes'").select("source_file", "source_group", "censor_policy")
    rows = lookup_join(read(spark, sf, "raw_record"), registry, ["source_file"], "inner", 160).where(F.col("raw_label").isNotNull() & ~F.isnan("raw_label"))
    positive = F.col("censor_policy").isin("require_positive_finite", "require_positive_and_below_max")
    rows = rows.where(~positive | (F.col("raw_label") > 0)).select("raw_id", "source_group", n(F.col("heavy")).alias("h"), n(F.col("light")).alias("l"), n(F.col("antigen_seq")).alias("s"), (F.col("raw_label") * F.col("direction")).alias("v"), F.coalesce("comparison_group", "source_file").alias("grp")).where("h <> ''")
    scored = ranks.with_percentile(rows, F.col("v"), ["grp"], "score")
    return splits.first_occurrence(scored, ["source_group", "h", "l", "s"], [F.col("raw_id")]).select("raw_id", "source_group", r9("score", "score"))


# --- pairs ----------------------------------------------------------------------------------------------------------

_LIMIT_TOTAL, _PAIR_SEED = 1_000_000, 42  # the operator's default
_COMPARABLE_SQL = """SELECT DISTINCT record_id, score AS label, antigen_id AS comparison_group, lower(trim(split)) AS split, CASE WHEN length(coalesce(light, '')) = 0 THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END AS quality, score < 0.05 AS is_censored, CASE WHEN score > 0.9 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS conflict
    FROM math_demo WHERE score IS NOT NULL AND antigen_id IS NOT NULL AND antigen_id <> '' AND record_id IS NOT NULL"""


def _comparable(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "math_demo").where("score is not null and antigen_id is not null and antigen_id <> '' and record_id is not null")
    return rows.select("record_id", F.col("score").alias("label"), F.col("antigen_id").alias("comparison_group"), F.lower(F.trim("split")).alias("split"), F.when(F.length(F.coalesce("light", F.lit(""))) == 0, 0.65).otherwise(1.0).alias("quality"), (F.col("score") < 0.05).alias("is_censored"), F.when(F.col("score") > 0.9, 0.25).otherwise(0.0).alias("conflict")).distinct()


_PAIRS_SQL = f"""
    WITH x AS ({_COMPARABLE_SQL}), p AS (SELECT *, row_number() OVER (PARTITION BY comparison_group ORDER BY label, record_id) - 1 AS i FROM x),
    g AS (SELECT comparison_group, count(*) AS n, max(label) - min(label) AS rng FROM p GROUP BY 1), l AS (SELECT greatest(1, least(100000, {_LIMIT_TOTAL} // greatest(1, count(*)))) AS lim FROM g),
    small AS (SELECT comparison_group, n, rng, a.i AS a, b.i AS b FROM g, l, (SELECT DISTINCT i FROM p) a, (SELECT DISTINCT i FROM p) b WHERE n > 1 AND n * (n - 1) / 2.0 <= 3 * lim AND a.i < b.i AND b.i < n),
    d0 AS (SELECT comparison_group, n, rng, unnest(range(3 * lim)) AS t FROM g, l WHERE n > 1 AND n * (n - 1) / 2.0 > 3 * lim),
    d1 AS (SELECT comparison_group, n, rng, CAST('0x' || substr(md5('{_PAIR_SEED}a|' || comparison_group || '|' || t), 1, 12) AS BIGINT) % n AS x, CAST('0x' || substr(md5('{_PAIR_SEED}b|' || comparison_group || '|' || t), 1, 12) AS BIGINT) % (n - 1) AS y FROM d0),
    d2 AS (SELECT comparison_group, n, rng, x, CASE WHEN y >= x THEN y + 1 ELSE y END AS y FROM d1), drawn AS (SELECT DISTINCT comparison_group, n, rng, least(x, y) AS a, greatest(x, y) AS b FROM d2),
    m AS (SELECT c.comparison_group, c.rng, w.record_id AS wid, w.label AS wl, w.quality AS wq, w.is_censored AS wc, w.conflict AS wf, w.split AS ws, h.record_id AS hid, h.label AS hl, h.quality AS hq, h.is_censored AS hc, h.conflict AS hf, h.split AS hs
          FROM (SELECT * FROM small UNION ALL SELECT * FROM drawn) c JOIN p w ON w.comparison_group = c.comparison_group AND w.i = c.a JOIN p h ON h.comparison_group = c.comparison_group AND h.i = c.b),
    k AS (SELECT hid AS left_record_id, wid AS right_record_id, 1 AS preference, least(1.0, greatest(0.0, hq * wq * (CASE WHEN rng > 0 THEN least(1.0, (hl - wl) / rng) ELSE 1.0 END) * (CASE WHEN hc OR wc THEN 0.5 ELSE 1.0 END) * (1.0 - greatest(hf, wf)))) AS pair_weight, comparison_group,
          'ordered_label' || CASE WHEN hc OR wc THEN '+censored_downweighted' ELSE '' END || CASE WHEN greatest(hf, wf) > 0 THEN '+conflict_downweighted' ELSE '' END AS reason
          FROM m WHERE (coalesce(hs, '') = '' OR coalesce(ws, '') = '' OR hs = ws) AND hl - wl > 0 AND NOT (hc AND wc)),
    r AS (SELECT *, row_number() OVER (PARTITION BY comparison_group ORDER BY sha256('{_PAIR_SEED}' || chr(31) || left_record_id || chr(31) || right_record_id)) AS rn FROM k WHERE pair_weight > 0),
    pairs AS (SELECT left_record_id, right_record_id, preference, pair_weight, comparison_group, reason FROM r, l WHERE rn <= lim)"""


@query(_PAIRS_SQL + " SELECT left_record_id, right_record_id, preference, round(pair_weight, 9) AS pair_weight, comparison_group, reason FROM pairs")
def preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = pairs.preference_pairs(_comparable(spark, sf), seed=_PAIR_SEED)
    return out.withColumn("pair_weight", F.round("pair_weight", 9))


@query(_PAIRS_SQL + ", s AS (SELECT record_id, CAST(length(comparison_group) + length(record_id) % 3 AS DOUBLE) * 0.1 + label * label AS score FROM x) SELECT count(*) AS pairs, round(sum((CASE WHEN a.score = b.score THEN 0.5 WHEN a.score > b.score THEN 1.0 ELSE 0.0 END) * pair_weight) / sum(pair_weight), 6) AS accuracy FROM pairs JOIN s a ON a.record_id = left_record_id JOIN s b ON b.record_id = right_record_id")
def pair_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = _comparable(spark, sf)
    scores = rows.select("record_id", ((F.length("comparison_group") + F.length("record_id") % 3).cast("double") * F.lit(0.1) + F.col("label") * F.col("label")).alias("score"))
    out = metrics.pair_accuracy(pairs.preference_pairs(rows, seed=_PAIR_SEED), scores, "record_id", "score")
    return out.select("pairs", F.round("accuracy", 6).alias("accuracy"))


@query("""WITH x AS (SELECT DISTINCT record_id, score, antigen_id FROM math_demo WHERE score IS NOT NULL AND antigen_id IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY antigen_id ORDER BY score, record_id) AS i, count(*) OVER (PARTITION BY antigen_id) AS n FROM x)
    SELECT DISTINCT l.antigen_id, h.record_id AS better, l.record_id AS worse FROM p l, (SELECT unnest([0.05, 0.25, 0.5, 1.0]::DOUBLE[]) AS f) o JOIN p h ON h.antigen_id = l.antigen_id AND h.i = least(l.n, l.i + greatest(1, round_even((l.n - 1) * o.f, 0)::BIGINT)) WHERE l.i < l.n AND h.score - l.score >= 0.1""")
def rank_offset_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "math_demo").select("record_id", "score", "antigen_id").distinct()
    return pairs.rank_offset_pairs(rows, "record_id", "score", "antigen_id")


@query("SELECT user_id, event_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), max(event_id) OVER (PARTITION BY user_id)) AS partner FROM events WHERE user_id IS NOT NULL")
def cyclic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.cyclic_pairs(read(spark, sf, "events").select("event_id", "user_id"), "event_id", "user_id")


# --- profiles -------------------------------------------------------------------------------------------------------


def _profile_sql() -> str:
    parts = ["source_file", "count(*) AS rows"]
    for c in ("heavy", "light"):
        state = f"CASE WHEN trim(coalesce({c}, '')) = '' THEN 'missing' WHEN {_NORM(c)} = '' THEN 'invalid' ELSE 'valid' END"
        parts += [f"count(*) FILTER ({state} = '{s}') AS {c}_{s}" for s in ("missing", "valid", "invalid")]
        n = f"nullif(length({_NORM(c)}), 0)"
        parts += [f"min({n})::INTEGER AS {c}_min", f"round(avg({n}), 6) AS {c}_mean", f"max({n})::INTEGER AS {c}_max"]
    v = "CASE WHEN NOT isnan(raw_label) AND abs(raw_label) < 'infinity'::DOUBLE THEN raw_label END"
    return f"SELECT {', '.join(parts)}, count({v}) AS labels, min({v}) AS label_min, round(avg({v}), 3) AS label_mean, max({v}) AS label_max FROM raw_record GROUP BY source_file"


@query(_profile_sql())
def file_audit_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = quality.file_profile(read(spark, sf, "raw_record"), "source_file", ["heavy", "light"], "raw_label")
    return p.select(*[F.round(c, 3 if c == "label_mean" else 6).alias(c) if c.endswith("_mean") else F.col(c) for c in p.columns])


@query(f"SELECT count(*) AS files, sum(heavy_invalid)::BIGINT AS heavy_invalid, sum(light_missing)::BIGINT AS light_missing, count(*) FILTER (heavy_invalid > 0) AS files_with_heavy_invalid, count(*) FILTER (light_missing > 0) AS files_with_light_missing FROM ({_profile_sql()})")
def audit_totals(spark: SparkSession, sf: str) -> DataFrame:
    return quality.profile_totals(file_audit_profile(spark, sf), ["heavy_invalid", "light_missing"])


@query(f"SELECT source_file, count(*) AS rows, count(number) AS numeric, count(*) FILTER (trim(coalesce(value_text, '')) = '') AS missing, count(*) FILTER (censored) AS censored, count(DISTINCT number) AS unique_values, min(number) AS low, max(number) AS high FROM (SELECT *, CASE WHEN regexp_full_match({_CELL}, '{_NUM}') THEN try_cast({_CELL} AS DOUBLE) END AS number, regexp_matches({_CELL}, '^\\s*[<>]=?') AS censored FROM assay_value) GROUP BY source_file")
def label_profile(spark: SparkSession, sf: str) -> DataFrame:
    x = values.censored_number(F.col("value_text"))
    return quality.label_profile(read(spark, sf, "assay_value"), ["source_file"], "value_text", x["value"], x["censored"])


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_contents(read(spark, sf, "documents"), F.col("text"), "doc_id")


@query(f"""SELECT source_file, count(*) FILTER (d = 'unlabelled') AS unlabelled, count(*) FILTER (d = 'no_heavy') AS no_heavy, count(*) FILTER (d = 'no_antigen') AS no_antigen, count(*) FILTER (d = 'curated') AS curated FROM (SELECT source_file,
    CASE WHEN raw_label IS NULL OR isnan(raw_label) THEN 'unlabelled' WHEN {_NORM('heavy')} = '' THEN 'no_heavy' WHEN coalesce(trim(antigen_seq), '') = '' THEN 'no_antigen' ELSE 'curated' END AS d FROM raw_record) GROUP BY source_file""")
def disposition_counts(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("unlabelled", F.col("raw_label").isNull() | F.isnan("raw_label")), ("no_heavy", sequences.normalize_sequence(F.col("heavy")) == ""), ("no_antigen", F.coalesce(F.trim("antigen_seq"), F.lit("")) == "")]
    return quality.dispositions(read(spark, sf, "raw_record"), "source_file", rules)


@query("SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM raw_record GROUP BY antigen_id) GROUP BY size")
def size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return quality.size_histogram(read(spark, sf, "raw_record"), ["antigen_id"])


@query("""SELECT issue, count(*) AS rows, sum(row_count)::BIGINT AS weight FROM (SELECT row_count, unnest(list_filter([CASE WHEN size_bytes IS NULL THEN 'no_size' END, CASE WHEN bad_width_rows > 0 THEN 'bad_width' END, CASE WHEN len(antigen_candidates) = 0 THEN 'no_antigen' END], lambda x: x IS NOT NULL)) AS issue FROM inventory_row) GROUP BY issue""")
def issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    flags = {"no_size": F.col("size_bytes").isNull(), "bad_width": F.col("bad_width_rows") > 0, "no_antigen": F.size("antigen_candidates") == 0}
    return quality.flag_counts(read(spark, sf, "inventory_row"), flags, "row_count")


@query("SELECT record_id, count(*) AS rows, count(DISTINCT task_name) AS groups, arg_min(task_name, {'a': scored_at, 'b': task_name}) AS first_group FROM score_row WHERE record_id IS NOT NULL GROUP BY record_id")
def key_occurrence_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "score_row").withColumn("o", F.struct("scored_at", "task_name"))
    return quality.key_stats(rows, "record_id", "task_name", "o")


_KEYS_IN = {"antibody": "heavy || chr(31) || coalesce(light, '')", "antigen": "antigen_seq", "group": "source_group"}


def _validation_sql() -> str:
    bad = lambda c: f"SELECT 'bad_{c}', count(*) FILTER (coalesce({c}, '') <> '' AND NOT regexp_full_match({c}, '[{RES}]+')) FROM x"
    shared = lambda n, k, s: f"SELECT '{n}_in_{s}s', count(*) FILTER (c > 1) FROM (SELECT {k} AS k, count(DISTINCT {s}) AS c FROM x WHERE {s} IS NOT NULL AND ({k}) IS NOT NULL GROUP BY 1)"
    parts = [bad("heavy"), bad("light"), "SELECT 'score_range', count(*) FILTER (score IS NOT NULL AND NOT score BETWEEN 0 AND 1) FROM x", "SELECT 'direction_domain', count(*) FILTER (direction NOT IN (-1, 0, 1)) FROM x"]
    parts += [f"SELECT 'blank_{s}', count(*) FILTER (coalesce(trim({s}), '') = '') FROM x" for s in ("split", "tier_split")]
    parts += ["SELECT 'repeated_id', count(*) FROM (SELECT record_id FROM x GROUP BY 1 HAVING count(*) > 1)"] + [shared(n, k, s) for s in ("split", "tier_split") for n, k in _KEYS_IN.items()]
    return "WITH x AS (SELECT m.*, CASE WHEN r.tier = 'Weak' THEN 2 ELSE r.direction END AS direction, CASE WHEN r.tier = 'Gold' THEN 'train' WHEN r.tier = 'Auxiliary' THEN '' ELSE 'test' END AS tier_split FROM math_demo m LEFT JOIN label_registry r USING (source_file)) SELECT * FROM (" + " UNION ALL ".join(parts) + ') t("check", violations)'


@query(_validation_sql())
def dataset_validation(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with a table under two split columns, a direction off its domain among it."""
    tier = read(spark, sf, "label_registry").select("source_file", F.when(F.col("tier") == "Weak", 2).otherwise(F.col("direction")).alias("direction"), F.when(F.col("tier") == "Gold", "train").when(F.col("tier") == "Auxiliary", "").otherwise("test").alias("tier_split"))
    rows = lookup_join(read(spark, sf, "math_demo"), tier, ["source_file"], "left").fillna("test", ["tier_split"])
    keys = {"antibody": F.concat("heavy", F.lit("\u001f"), F.coalesce("light", F.lit(""))), "antigen": F.col("antigen_seq"), "group": F.col("source_group")}
    return quality.validation_report(rows, "record_id", ["heavy", "light"], "score", "direction", ["split", "tier_split"], keys)


# --- vectors --------------------------------------------------------------------------------------------------------

_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_SIM_SQL = f"""SELECT q.vec_id AS query, r.vec_id AS neighbour, r.label, q.label AS own, round({_DOT('q.embedding', 'r.embedding')} / (sqrt({_DOT('q.embedding', 'q.embedding')}) * sqrt({_DOT('r.embedding', 'r.embedding')})), 6) AS similarity
    FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id"""


def _near(spark: SparkSession, sf: str, k: int, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", k, by=by), e


@query(f"SELECT query, neighbour, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour)::INTEGER AS place FROM ({_SIM_SQL})) WHERE place <= 5")
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, 5)[0].select("query", "neighbour", "similarity", "place")


@query(f"SELECT query, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS place FROM ({_SIM_SQL}) WHERE label = own) WHERE place = 1")
def nearest_reference(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, 1, "label")[0].select("query", "neighbour")


@query(f"SELECT query, round(sum(exp((similarity - m) / 0.05) * label) / sum(exp((similarity - m) / 0.05)), 5) AS predicted FROM (SELECT *, max(similarity) OVER (PARTITION BY query) AS m, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS place FROM ({_SIM_SQL})) WHERE place <= 32 GROUP BY query")
def knn_label(spark: SparkSession, sf: str) -> DataFrame:
    near, e = _near(spark, sf, 32)
    return vectors.softmax_label(near, e, "vec_id", "label").select("query", F.round("predicted", 5).alias("predicted"))


_OOD_SQL = """WITH m AS (SELECT label, pos, avg(x::DOUBLE) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2),
    d AS (SELECT e.vec_id, e.label, round(sqrt(sum((e.x - m.mean) * (e.x - m.mean))), 6) AS distance FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) e JOIN m ON m.label = e.label AND m.pos = e.pos GROUP BY 1, 2),
    p AS (SELECT a.vec_id, a.label, a.distance, count(*) FILTER (b.distance <= a.distance) / count(*)::DOUBLE AS percentile FROM d a JOIN d b ON a.label = b.label AND b.vec_id % 5 <> 0 GROUP BY 1, 2, 3)"""


def _ood(spark: SparkSession, sf: str) -> DataFrame:
    d = vectors.centroid_distance(read(spark, sf, "embeddings"), "label", "vec_id", "embedding").withColumn("distance", F.round("distance", 6)).withColumn("train", F.col("vec_id") % 5 != 0)
    return vectors.ecdf(d, "label", "distance", "train")


@query(_OOD_SQL + " SELECT vec_id, label, distance, round(percentile, 9) AS percentile FROM p")
def centroid_ood(spark: SparkSession, sf: str) -> DataFrame:
    return _ood(spark, sf).select("vec_id", "label", "distance", r9("percentile", "percentile"))


@query(_OOD_SQL + " SELECT CASE WHEN percentile <= 0.5 THEN 'near' WHEN percentile <= 0.9 THEN 'middle' ELSE 'far' END AS bin, count(*) AS n, round(median(distance), 6) AS median_distance FROM p GROUP BY 1")
def ood_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _ood(spark, sf).groupBy(vectors.bins(F.col("percentile")).alias("bin")).agg(F.count("*").alias("n"), F.round(F.median("distance"), 6).alias("median_distance"))


@query(f"""WITH x AS (SELECT antigen_id, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS pos FROM (SELECT antigen_id, {_NORM('heavy')} AS s FROM math_demo) WHERE s <> ''), n AS (SELECT antigen_id, pos, c, count(*) AS k FROM x GROUP BY 1, 2, 3),
    b AS (SELECT antigen_id, pos, c, row_number() OVER (PARTITION BY antigen_id, pos ORDER BY k DESC, c) AS r FROM n) SELECT antigen_id, string_agg(c, '' ORDER BY pos) AS consensus FROM b WHERE r = 1 GROUP BY antigen_id""")
def consensus_sequence(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "math_demo").select("antigen_id", sequences.normalize_sequence(F.col("heavy")).alias("s"))
    return vectors.consensus(rows, "antigen_id", "s")
