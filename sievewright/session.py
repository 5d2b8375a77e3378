"""Session helpers: sessions for local runs, staged tables, joins that check sizes before broadcasting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest estimated size in bytes of a table that may be broadcast; anything above is shuffled.
BROADCAST_BYTES = 32 * 1024 * 1024

#: Fewest rows of a key that a shuffled lookup salts.
HOT_ROWS = 10_000

_STAGED: dict[str, tuple[SparkSession, str]] = {}


def local_session(cpus: int = 8, memory: str = "8g", app: str = "sievewright") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster session is refused, since a
    machine-local folder would be lost with its machine.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sievewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/sievewright-{uuid.uuid4().hex}"
    _STAGED[path] = (spark, path)
    return path


def stage(df: DataFrame, **options: object) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, computes once, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
    out._staged_path = path  # type: ignore[attr-defined]
    return out


def drop_staged(df: DataFrame) -> None:
    """Remove a staged table that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path and path in _STAGED:
        _delete(*_STAGED.pop(path))


@contextmanager
def staging() -> Iterator[None]:
    """Removes at its end the tables staged inside; results are to be written or collected before that."""
    before = set(_STAGED)
    try:
        yield
    finally:
        for path in [p for p in _STAGED if p not in before]:
            _delete(*_STAGED.pop(path))


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_STAGED.values()):
        _delete(spark, path)
    _STAGED.clear()


def row_bytes(schema: T.StructType, text: int = 64) -> int:
    """A rough size of one row, text cells counted as `text` bytes."""
    return sum(8 if not isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) else text for f in schema) + 16


def lookup_join(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "left", row_size: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a large table to one with at most one row a key.

    dim is counted; it is broadcast when its rows times row_size stay under `limit`. Beyond that both sides
    are shuffled, and the keys that hold more than a quarter of one partition's even share of facts are
    salted, their dim rows repeated, so that no task gets an unbounded key. Null keys, which meet nothing, are dealt out too.
    The salt is a hash of the row and its map partition: a task that is run again gives every row the salt it had.
    """
    spark = facts.sparkSession
    size = row_size or row_bytes(dim.schema)
    if dim.limit(limit // size + 1).count() * size <= limit:
        return facts.join(F.broadcast(dim), on, how)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = facts.count()
    hot = facts.groupBy(*on).count().where(F.col("count") > max(HOT_ROWS, total // (4 * parts))).select(*on, F.lit(parts).alias("_lookup_copies"))  # at most 4 * parts keys
    plain = [f.name for f in facts.schema if "map<" not in f.dataType.simpleString()]
    void = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    copies = F.when(void, parts).otherwise(F.coalesce("_lookup_copies", F.lit(1)))
    salted = facts.join(F.broadcast(hot), on, "left").withColumn("_lookup_salt", F.pmod(F.xxhash64(*plain, F.spark_partition_id()), copies).cast("int")).drop("_lookup_copies")
    spread = dim.join(F.broadcast(hot), on, "left").withColumn("_lookup_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_lookup_copies") - 1, F.lit(0))))).drop("_lookup_copies")
    return salted.join(spread, [*on, "_lookup_salt"], how).drop("_lookup_salt")
