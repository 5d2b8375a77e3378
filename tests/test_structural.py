import datetime
import random

import numpy as np
import pyarrow as pa
import pytest

from sievewright.operators.structural import LineIndex, classify_lines, finite_number

SEQ = "ACDEFGHIK"
INV = "path string, format string, header_row int, column_count int, columns array<string>, heavy_candidates array<string>, light_candidates array<string>, antigen_candidates array<string>, label_candidates array<string>, source_group string, delivered_at timestamp"
LINE = "line_id long, path string, line_no int, line_text string"


def inventory(spark, rows=None):
    when = datetime.datetime(2024, 1, 1)
    base = ("a.csv", "csv", 1, 4, ["h", "l", "kd", "note"], ["h"], ["l"], [], ["kd"], "g", when)
    return spark.createDataFrame(rows if rows is not None else [base, base, ("t.tsv", "tsv", 2, 2, ["h", "kd"], ["h"], [], [], ["kd"], "g", when), ("x.xlsx", "xlsx", 1, 2, ["h", "kd"], ["h"], [], [], ["kd"], "g", when)], INV)


def reasons(spark, texts, path="a.csv"):
    lines = spark.createDataFrame([(i, path, i + 2 + (path == "t.tsv"), t) for i, t in enumerate(texts)], LINE)
    got = {r["line_id"]: r["reason"] for r in classify_lines(lines, inventory(spark)).collect()}
    return [got[i] for i in range(len(texts))]


def test_reasons(spark):
    cases = {
        f"{SEQ},,1.5,ok": None, f'"{SEQ}",{SEQ},"1,234.5","a ""b"", c"': None, f'{SEQ},,2,"two\nlines"': None, f"{SEQ.lower()}, {SEQ} ,n/a,": None, f"{SEQ},,<5 nM,x": None,
        f'{SEQ},,1,a"b': "quoting", f'{SEQ},,1,"open': "quoting", f'{SEQ},,1,"a"b': "quoting", f"{SEQ},,1,a\nb": "quoting", f'{SEQ}"': "quoting",
        f"{SEQ},,1": "width", f"{SEQ},,1,x,y": "width", "": "width", None: "width", f'{SEQ},,"1,x"': "width",
        ",,1,x": "value", "  ,,1,x": "value", f"{SEQ}X,,1,x": "value", f"{SEQ},AB,1,x": "value", f"{SEQ},,high,x": "value", f"{SEQ},,1e999,x": "value", f"{SEQ},n/a,1,x": "value", f"{SEQ},,\\,": None, '"' * 3: "quoting",
    }
    assert reasons(spark, list(cases)) == list(cases.values())
    assert reasons(spark, [f"{SEQ}\t1", f"{SEQ},1", f"\t1"], "t.tsv") == [None, "width", "value"]


def test_empty_unknown_and_extra_columns(spark):
    empty = spark.createDataFrame([], LINE)
    assert classify_lines(empty, inventory(spark)).count() == 0
    lines = spark.createDataFrame([(1, "a.csv", 1, "h,l,kd,note"), (2, "nowhere.csv", 5, "x"), (3, None, 5, "x"), (4, "a.csv", None, "x"), (5, "a.csv", 9, f"{SEQ},,1,x"), (5, "a.csv", 9, f"{SEQ},,1,x"), (6, "x.xlsx", 3, "q")], LINE)
    extra = lines.selectExpr("*", "'z' as names", "1 as sep", "2 as width")
    assert sorted(r["line_id"] for r in classify_lines(extra, inventory(spark)).collect()) == [5, 5]
    assert classify_lines(lines, spark.createDataFrame([], INV)).count() == 0


def test_cells_round_trip(spark):
    rng = random.Random(5)
    rows = [[SEQ, "", "1.5", "".join(rng.choice('ab ,"\n') for _ in range(rng.randrange(30)))] for _ in range(200)] + [[SEQ * 20_000, "", "7", "x"]]
    text = [",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in r) for r in rows]
    lines = spark.createDataFrame([(i, "a.csv", i + 2, t) for i, t in enumerate(text)], LINE)
    got = {r["line_id"]: r["cells"] for r in classify_lines(lines, inventory(spark), with_cells=True).where("reason is null").collect()}
    assert [got[i] for i in range(len(rows))] == rows


def scan(text, sep):
    """One character after the other: the cells, or None where RFC 4180 is broken."""
    cells, i = [], 0
    while True:
        if text[i : i + 1] == '"':
            j, cell = i + 1, ""
            while True:
                if j >= len(text):
                    return None
                if text[j] == '"' and text[j + 1 : j + 2] == '"':
                    cell, j = cell + '"', j + 2
                elif text[j] == '"':
                    break
                else:
                    cell, j = cell + text[j], j + 1
            i = j + 1
            if i < len(text) and text[i] != sep:
                return None
        else:
            j = i
            while j < len(text) and text[j] != sep:
                if text[j] in '"\n\r':
                    return None
                j += 1
            cell, i = text[i:j], j
        cells.append(cell)
        if i >= len(text):
            return cells
        i += 1


@pytest.mark.parametrize("seed", range(5))
def test_index_against_scanner(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice('aé,",\n"') for _ in range(rng.randrange(12))) for _ in range(3000)]
    index = LineIndex(pa.array(texts), np.full(len(texts), ord(","), np.uint8))
    for i, t in enumerate(texts):
        cells = scan(t, ",")
        assert index.faulty[i] == (cells is None), t
        if cells is not None:
            assert index.width[i] == len(cells), t


def test_finite_number():
    assert [finite_number(x) for x in ("1,5", "x 2e3", "1e400", "", "high", "-.5")] == [True, True, False, False, False, True]
