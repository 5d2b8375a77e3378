"""Writers for tables, summaries and sequences."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions.values import text_of_number


def guard_output(path: str, read_only_root: str) -> str:
    """The path, unless it lies in or below a read-only root."""
    clean = lambda p: "/" + p.removeprefix("file://").strip("/") + "/"
    if clean(path).startswith(clean(read_only_root)):
        raise ValueError(f"{path} lies below {read_only_root}, which is read-only")
    return path


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """CSV with a header; numbers keep Spark's own text form."""
    df.write.option("header", True).option("compression", "gzip" if gzip else "none").mode("overwrite").csv(path)


def write_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with the given columns in their order, numbers with twelve significant digits; a missing column raises."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"table lacks {missing}")
    number = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    write_csv(df.select(*[text_of_number(F.col(c)).alias(c) if c in number else F.col(c) for c in columns]), path)


def write_inventory(df: DataFrame, path: str) -> None:
    """An inventory twice: nested as JSON lines below `json`, flat as CSV below `csv`."""
    df.write.mode("overwrite").json(f"{path}/json")
    write_csv(inventory_rows(df), f"{path}/csv")


def write_model(model, path: str, config: dict[str, object]) -> None:
    """A fitted model and what it was fitted with."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(type(model).__module__ + "." + type(model).__name__, json.dumps(config, sort_keys=True))], "kind string, config string").coalesce(1).write.mode("overwrite").json(f"{path}/config")


def read_model(spark: SparkSession, path: str) -> tuple[object, dict[str, object]]:
    """A model of pyspark.ml written by write_model, and its configuration."""
    from importlib import import_module

    row = spark.read.schema("kind string, config string").json(f"{path}/config").first()
    module, name = row["kind"].rsplit(".", 1)
    if not module.startswith("pyspark.ml."):
        raise ValueError(f"{row['kind']} is no model of pyspark.ml")
    return getattr(import_module(module), name).load(f"{path}/model"), json.loads(row["config"])


def write_predictions(df: DataFrame, path: str, score: str) -> None:
    """A prediction table as CSV; a score that is not finite raises."""
    fine = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    write_csv(df.where(F.when(fine, True).otherwise(F.raise_error(F.lit("score is not finite")).cast("boolean"))), path)


def write_summary(df: DataFrame, path: str) -> None:
    """A small summary as one JSON file of lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_fasta(df: DataFrame, path: str, id_col: str, seq: str) -> None:
    """'>id' and the sequence on two lines a record; blank sequences are left out."""
    df.where(F.coalesce(F.col(seq), F.lit("")) != "").select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def inventory_rows(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for flat formats."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def snapshot_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem): missing, extra, size or hash; files and manifest hold path, size_bytes, sha256."""
    f, m = (d.select("path", F.col("size_bytes").alias(f"{s}_size"), F.lower("sha256").alias(f"{s}_sha")) for d, s in ((files, "f"), (manifest, "m")))
    rows = f.join(m, "path", "full_outer")
    problem = F.when(F.col("f_sha").isNull(), "missing").when(F.col("m_sha").isNull(), "extra").when(F.col("f_size") != F.col("m_size"), "size").when(F.col("f_sha") != F.col("m_sha"), "hash")
    return rows.select("path", problem.alias("problem")).where("problem is not null")
