"""Mixing sources to target weights in tokens by iterative proportional fitting under repeat limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.session import lookup_join, stage

#: Documents of a cell that one window may order; larger cells are ordered in hashed buckets of about as many.
BUCKET_ROWS = 50_000
#: Languages and topics kept apart, those with most tokens; the others of a kind are one value together.
KEPT = 48
#: Most target sources; more raise, since their cells are raked together on the driver.
TARGETS = 10_000
REST = "(rest)"


def token_counts(docs: DataFrame, text_col: str, tokenizer: str) -> DataFrame:
    """docs with `tokens`, the length of each text under a public byte-pair vocabulary in a tiktoken file; null texts have 0.

    The text column itself is not carried on.
    """
    kept = [c for c in docs.columns if c != text_col]
    schema = docs.select(*kept).schema.add("tokens", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(tokenizer, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in batch[text_col]]
            yield batch[kept].assign(tokens=sizes)

    return docs.select(*kept, text_col).mapInPandas(run, schema)


def plain_name(text: Column) -> Column:
    """Lower case, with runs of other characters than letters and digits as one underscore, none outside."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def _shortened(text: Column, most: int) -> Column:
    """A text and all that is left of it without up to `most` of its letters: two texts within as many edits share one."""
    found = F.array(text)
    for _ in range(most):
        less = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>"))
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, less))))
    return found


def matched_sources(spellings: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """(spelling, source): the target source (of `names.source`) each distinct spelling stands for.

    Equal as plain names, else the only source within `most` edits, short names fewer (a quarter of their length). Spellings
    and names meet on their shortened forms, never all with all. Others, nulls and blanks have no row.
    """
    said = spellings.where("spelling is not null").distinct().withColumn("_plain", plain_name(F.col("spelling"))).where("_plain <> ''")
    exact = said.join(names.select("source", F.col("source").alias("_plain")), "_plain").select("spelling", "source")
    key = lambda c: F.explode(_shortened(F.col(c), most)).alias("_key")
    met = said.select("spelling", "_plain", key("_plain")).join(names.select("source", key("source")), "_key").select("spelling", "_plain", "source").distinct()
    allowed = F.least(F.lit(most), F.floor(F.length("source") / 4))
    close = met.where(F.levenshtein("_plain", "source") <= allowed).groupBy("spelling").agg(F.min("source").alias("source"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return exact.union(close.join(exact.select("spelling"), "spelling", "left_anti"))


def language(text: Column) -> Column:
    """The primary subtag of a language code in lower case, 'und' where missing."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"^\s*([a-z]{2,3})\b", 1), F.lit("")), F.lit("und"))


def rake(tokens: np.ndarray, limits: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = 500, eps: float = 1e-9) -> np.ndarray:
    """Weights of cells, from 0 to their limits, whose weighted tokens meet each margin (group of each cell, wanted tokens of each group).

    Classical raking with truncation: every margin in turn scales down the groups above it whole, and in those below it the
    cells under their limit. The first margin is fitted last in each round and so is met wherever the limits allow it.
    """
    w = np.minimum(1.0, limits).astype(float)
    for _ in range(rounds):
        before = w.copy()
        for group, wanted in [*margins[1:], margins[0]]:
            for _ in range(20):
                have = np.bincount(group, w * tokens, len(wanted))
                free = w < limits - 1e-12
                loose = np.bincount(group, np.where(free, w * tokens, 0.0), len(wanted))
                down = (have > wanted)[group]
                less = np.where(have > 0, wanted / np.maximum(have, 1e-300), 1.0)[group]
                more = np.where(loose > 0, (wanted - (have - loose)) / np.where(loose > 0, loose, 1.0), 1.0)[group]
                new = np.where(down, w * less, np.where(free, np.minimum(w * more, limits), w))
                moved = np.abs(new - w).max(initial=0.0)
                w = new
                if moved < eps:
                    break
        if np.abs(w - before).max(initial=0.0) < eps:
            break
    return w


def _kept(sizes: DataFrame, column: str) -> list[str]:
    top = sizes.groupBy(column).agg(F.sum("tokens").alias("t")).orderBy(F.desc("t"), column).limit(KEPT)
    return [r[0] for r in top.collect()]  # KEPT values at most


def _drawn(sized: DataFrame, cells: pd.DataFrame) -> DataFrame:
    """sized with `repeats` by its cell's weight: the whole part, and one more by systematic sampling with the fraction.

    The documents of a source stand in one line: cell after cell, within a cell bucket after bucket, within a bucket by size.
    Each step of the line is its cell's fraction; a document is drawn where the running sum passes a whole number. Only the
    counts of the buckets, one for about BUCKET_ROWS documents, are summed over a whole source.
    """
    spark, key = sized.sparkSession, ["source", "lang", "topic"]
    whole = np.floor(cells["weight"].to_numpy(float) + 1e-9)
    known = cells[key].assign(whole=whole.astype(int), part=np.maximum(cells["weight"].to_numpy(float) - whole, 0.0), buckets=(cells["docs"] // BUCKET_ROWS + 1).astype(int) if len(cells) else 0)
    weights = spark.createDataFrame(known, "source string, lang string, topic string, whole int, part double, buckets int")
    order = F.xxhash64("_id")
    placed = lookup_join(sized, weights, key, "inner", row_size=160).withColumn("bucket", F.pmod(order, F.col("buckets")).cast("int"))
    units = placed.groupBy(*key, "bucket").agg(F.count("*").alias("_n"), F.first("part").alias("_part"))
    line = Window.partitionBy("source").orderBy("lang", "topic", "bucket")
    start = (F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("_at")  # where the source's line begins
    units = units.select(*key, "bucket", (F.sum(F.col("_n") * F.col("_part")).over(line) - F.col("_n") * F.col("_part") + start).alias("_before"))
    within = Window.partitionBy(*key, "bucket").orderBy("tokens", order, "_id")
    upto = F.col("_before") + F.row_number().over(within) * F.col("part")
    rows = lookup_join(placed, units, [*key, "bucket"], "inner", row_size=160).withColumn("_upto", upto)
    return rows.withColumn("repeats", (F.col("whole") + F.floor(F.col("_upto")) - F.floor(F.col("_upto") - F.col("part"))).cast("int"))


def mix_sources(docs: DataFrame, targets: DataFrame, tokenizer: str, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang: Column | None = None, topic: Column | None = None, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): documents with how often each is used, and the shares of tokens reached by source.

    chosen is (doc_col, source, tokens, repeats) with repeats from 1 to the source's max_repeats. shares is (source,
    target_share, actual_share, tokens, documents, uses, reached), one row a target, also where a source has no documents.

    Token weights of the cells (source, language, topic) are raked: sources to their target shares of total_tokens (all
    tokens of the wanted sources, unless given), languages and topics to their own shares of those tokens, under the repeat
    limits. A source whose repeats cannot reach its share gives all it may; the others keep their proportions.
    A cell of weight w gives each document floor(w) uses and one more with the probability of the fraction: documents are
    drawn by systematic sampling along the cells of their source, ordered by size within a cell, so each has exactly its
    calibrated probability and counts and tokens stay next to their expectation. Cells are at most TARGETS * (KEPT + 1)^2, so
    raking on the driver is bounded; documents never leave the tasks. Documents of other or unreadable sources, without id, or with empty texts are not used.
    """
    spark = docs.sparkSession
    wanted = targets.groupBy(F.col("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("limit")).orderBy("source").limit(TARGETS + 1).collect()
    if len(wanted) > TARGETS:
        raise ValueError(f"more than {TARGETS} target sources")
    names = [r["source"] for r in wanted]
    shares_schema = "source string, target_share double, actual_share double, tokens bigint, documents bigint, uses bigint, reached boolean"
    if not names:
        return spark.createDataFrame([], "doc string, source string, tokens bigint, repeats int"), spark.createDataFrame([], shares_schema)
    known = matched_sources(docs.select(F.col(source_col).alias("spelling")), spark.createDataFrame([(n,) for n in names], "source string"))
    rows = docs.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("spelling"), (lang if lang is not None else F.lit("und")).alias("lang"), (topic if topic is not None else F.lit("none")).alias("topic"))
    rows = lookup_join(rows, stage(known), ["spelling"], "inner").drop("spelling")
    sized = stage(token_counts(rows, "_text", tokenizer).where("tokens > 0"))
    for c in ("lang", "topic"):
        known = _kept(sized, c)
        sized = sized.withColumn(c, F.when(F.col(c).isin(known), F.col(c)).otherwise(F.lit(REST)) if known else F.col(c))
    cells = sized.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).orderBy("source", "lang", "topic").toPandas()
    position = {n: i for i, n in enumerate(names)}
    share = np.array([r["share"] or 0.0 for r in wanted], float)
    share = share / max(share.sum(), 1e-12)
    if len(cells):
        tokens, source = cells["tokens"].to_numpy(float), cells["source"].map(position).to_numpy(int)
        limits = np.array([max(0, r["limit"] or 0) for r in wanted], float)[source]
        total = float(total_tokens or tokens.sum())
        goal = np.minimum(share * total, np.bincount(source, tokens * limits, len(names)))
        margins = [(source, goal)]
        for c in ("lang", "topic"):
            code, values = pd.factorize(cells[c])
            own = np.bincount(code, tokens, len(values))
            margins.append((code, own / own.sum() * goal.sum()))
        cells["weight"] = rake(tokens, limits, margins)
    else:
        cells["weight"] = np.zeros(0)
    chosen = _drawn(sized, cells).select(F.col("_id").alias(doc_col), "source", "tokens", "repeats").where("repeats > 0")
    chosen = stage(chosen)
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.sum("repeats").alias("uses"))
    plan = spark.createDataFrame([(n, float(s)) for n, s in zip(names, share, strict=True)], "source string, target_share double")
    out = plan.join(used, "source", "left").na.fill(0)
    actual = F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)).cast("double")
    shares = out.select("source", "target_share", actual.alias("actual_share"), "tokens", "documents", "uses", (F.abs(actual - F.col("target_share")) <= 0.05 * F.col("target_share")).alias("reached"))
    return chosen, shares
