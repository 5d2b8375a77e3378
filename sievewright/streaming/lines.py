"""Delivered lines as a stream: classified as they arrive, late repeats dropped under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators.structural import classify_lines


def classified_stream(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """The stream of lines with their reasons; the inventory is a static table known before its lines arrive."""
    return classify_lines(lines, inventory)


def first_deliveries(events: DataFrame, id_col: str, time_col: str, delay: str = "1 day") -> DataFrame:
    """Each id once within the delay of its first arrival, state dropped behind the watermark. Times without a zone are cast."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def write_split(stream: DataFrame, good: str, bad: str, checkpoint: str):
    """Starts a query that writes valid and failing lines of each micro-batch to two tables; reruns of a batch overwrite it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("reason is null").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where("reason is not null").write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
