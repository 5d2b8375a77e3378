"""The queries over the smallest shared tables: exact columns, no repeats, and the rows of their SQL."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from sievewright.llm import queries

from verify import rows_of

FOLDER = Path("/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["record_id_a", "record_id_b"], "p4_found": ["record_id", "set_key"], "p5_found": ["first_raw_id", "copies"], "p7_found": ["antigen_id", "record_id", "place"], "p8_found": ["item_id", "doc_id"], "p10_found": ["doc_id", "pii_type", "start_pos"],
}

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the shared tables are not here")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_without_repeats(spark, name):
    df = queries.queries()[name](spark, str(FOLDER))
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(set(rows)) == len(rows)
    assert df.columns == COLUMNS.get(name, df.columns)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in FOLDER.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, str(FOLDER))
    rel = con.sql(queries.oracle_sql()[name])
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(rel.fetchall(), rel.columns)
