"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievewright.plans import curation, learned, problems, reference


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    assert curation and learned  # they register their queries
    return reference.QUERIES | problems.queries()


def oracle_sql() -> dict[str, str]:
    assert curation
    return reference.SQL | problems.oracle_sql()
