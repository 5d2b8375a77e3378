"""Every query that has SQL gives the rows of its SQL on the smallest shared tables."""

import inspect
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from sievewright import session
from sievewright.functions import ranks
from sievewright.operators import ensembles, metrics
from sievewright.plans import catalogue

from verify import rows_of

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def con():
    if not FOLDER.exists():
        pytest.skip("the shared tables are not here")
    c = duckdb.connect()
    for f in FOLDER.iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, con, name):
    df = catalogue.queries()[name](spark, str(FOLDER))
    rel = con.sql(catalogue.oracle_sql()[name])
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(rel.fetchall(), rel.columns)


def test_entry(spark, con):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def same_beyond_limits(spark, con, monkeypatch, name):
    """The query's rows are those of its SQL where no window, task or broadcast holds its table, as if that had many rows."""
    small = {"limit": 0, "window_rows": 0, "task_rows": 0, "part_rows": 400}
    for f in (session.lookup_join, ranks.with_ranks, ranks.with_row_number, metrics.regression_metrics, ensembles.blend_sweep):
        given = {k: p.default for k, p in inspect.signature(f).parameters.items() if p.default is not p.empty}
        monkeypatch.setattr(f, "__defaults__", tuple((given | {k: v for k, v in small.items() if k in given}).values()))
    test_same_rows(spark, con, name)


def test_expert_blend_sweep_beyond_limits(spark, con, monkeypatch):
    same_beyond_limits(spark, con, monkeypatch, "expert_blend_sweep")


def test_sweep_argmax_beyond_limits(spark, con, monkeypatch):
    same_beyond_limits(spark, con, monkeypatch, "sweep_argmax")
