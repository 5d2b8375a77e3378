"""The queries of the training-data operators over the shared tables, and SQL where SQL can express them on whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.cross_split import cross_split_pairs, cross_split_report, letters
from sievewright.llm.formatting_duplicates import collapse_formatting, formatting_groups
from sievewright.llm.keep_together import keep_together
from sievewright.llm.leaked_passages import leaked_spans, without_leaks
from sievewright.llm.mixing import language, mix_sources
from sievewright.llm.oracle import SQL
from sievewright.llm.personal_data import personal_spans, without_personal
from sievewright.llm.top_in_group import top_in_group

#: Key of the pseudonyms; set PSEUDONYM_KEY for one of your own, which links the same values across runs.
KEY = os.environ.get("PSEUDONYM_KEY", "public example key").encode()
CHAINS = ["heavy", "light"]
#: Vocabulary file by which texts are measured; set TOKENIZER_FILE for another.
TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _filled(name: str) -> Column:
    """Neither null nor blank."""
    return F.col(name).rlike(r"\S")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Train records and the validation or test records within three edits of them."""
    pairs = cross_split_pairs(_read(spark, sf, "math_demo"), "record_id", "heavy", "light", "split")
    return pairs.select(F.least("id_train", "id_held").alias("record_id_a"), F.greatest("id_train", "id_held").alias("record_id_b")).distinct()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping records and pairs by held-out split and source_group."""
    demo = _read(spark, sf, "math_demo").withColumn("source_group", F.replace(F.trim("source_group"), F.lit("\\"), F.lit("/")))
    return cross_split_report(demo, "record_id", "heavy", "light", "split", ("source_group",))


def _together(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job of problem 4: joined sets and the new split of each."""
    shares = {r["split_name"]: r["share"] for r in _read(spark, sf, "split_share").orderBy("split_name").collect()}  # a few rows
    keys = {"source_group": F.replace(F.trim("source_group"), F.lit("\\"), F.lit("/")), "heavy": letters(F.col("heavy"))}
    split = F.nullif(F.lower(F.trim("split")), F.lit(""))
    return keep_together(_read(spark, sf, "math_demo"), "record_id", keys, split, F.col("score"), shares)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The records of every joined set that now holds more than one split."""
    return _together(spark, sf).where("mixed").select("record_id", "set_key")


def p4_split(spark: SparkSession, sf: str) -> DataFrame:
    """A new split for every record in which joined records stay together."""
    return _together(spark, sf).select("record_id", "set_key", "new_split")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of records that differ only in how they are written."""
    groups = formatting_groups(_read(spark, sf, "raw_record"), "raw_id", CHAINS, ["antigen_id"])
    return groups.where("copies > 1").select(F.col("first_id").alias("first_raw_id"), "copies")


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """One record of each group with its number of copies."""
    rows = _read(spark, sf, "raw_record").select("raw_id", "record_id", "heavy", "light", "antigen_id")
    return collapse_formatting(rows, "raw_id", CHAINS, ["antigen_id"]).select("raw_id", "record_id", F.col("_copies").alias("copies"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best records of every antigen."""
    scores = _read(spark, sf, "score_row").where((F.col("task_name") == "affinity_rank") & F.col("value").isNotNull() & ~F.isnan("value"))
    best = scores.groupBy("record_id").agg(F.max("value").alias("value"))
    records = _read(spark, sf, "raw_record").where(_filled("antigen_id")).select("record_id", "antigen_id")
    earlier = _read(spark, sf, "rank_row").select("record_id", F.col("value").alias("tie"))
    return top_in_group(records.join(best, "record_id"), "antigen_id", "record_id", "value", 10, earlier).select("antigen_id", "record_id", F.col("place").cast("int").alias("place"))


def _items(spark: SparkSession, sf: str) -> tuple:
    return _read(spark, sf, "documents").select("doc_id", "text"), _read(spark, sf, "heldout_item").select("item_id", "item_text"), "doc_id", "text", "item_id", "item_text"


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold twelve consecutive words or more of an item."""
    return leaked_spans(*_items(spark, sf)).select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"))


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The longest run of words each such pair shares."""
    return leaked_spans(*_items(spark, sf)).select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), "longest", "last_word")


def p8_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without leaked passages."""
    return without_leaks(*_items(spark, sf)).select(F.col("doc").alias("doc_id"), "text", "leaked_words", "dropped")


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    topic = F.coalesce(F.nullif(F.upper(F.regexp_extract(F.coalesce("antigen_id", F.lit("")), r"^[^A-Za-z]*([A-Za-z]+)", 1)), F.lit("")), F.lit("none"))
    return mix_sources(_read(spark, sf, "documents"), _read(spark, sf, "mix_target"), TOKENIZER, lang=language(F.col("lang")), topic=topic)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen documents, each with how often it is used."""
    return _mixed(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of tokens of every source."""
    return _mixed(spark, sf)[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each name, address or number of a person in the documents."""
    rows = personal_spans(_read(spark, sf, "documents"), "doc_id", "text")
    return rows.select(F.col("doc").alias("doc_id"), "pii_type", "start_pos").distinct()


def p10_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with typed placeholders."""
    return without_personal(_read(spark, sf, "documents"), "doc_id", "text", KEY).select(F.col("doc").alias("doc_id"), "text", "replaced")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p4_found, p4_split, p5_found, p5_collapsed, p7_found, p8_found, p8_spans, p8_cleaned, p9_mix, p9_shares, p10_found, p10_replaced)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
