import datetime

from pyspark.sql import functions as F

from sievewright.operators.drift import SKETCH, consistent_table, match_columns, schema_changes, sketch_overlap

from test_structural import INV, LINE, SEQ


def build(spark, files):
    """files: (path, group, day, columns, label, rows of cells)."""
    inv, lines = [], []
    for path, group, day, columns, label, rows in files:
        inv.append((path, "csv", 1, len(columns), columns, ["h"], [], [], [label], group, datetime.datetime(2024, 1, day)))
        for k, row in enumerate([columns, *rows]):
            lines.append((len(lines), path, k + 1, ",".join(row)))
    return spark.createDataFrame(lines, LINE), spark.createDataFrame(inv, INV)


WELLS, TEMPS = ["A01", "B07", "C12", "H03"], ["4.0", "25.0", "37.0", "20.0"]


def rows(*columns):
    return [[SEQ, *cells] for cells in zip(*columns)]


def test_changes(spark):
    lines, inv = build(spark, [
        ("1", "g", 1, ["h", "kd", "well", "temp"], "kd", rows(["1"] * 4, WELLS, TEMPS)),
        ("2", "g", 2, ["h", "temp", "kd", "well_pos"], "kd", rows(TEMPS, ["1"] * 4, WELLS[::-1])),
        ("3", "g", 3, ["h", "temp", "log", "run"], "log", rows(["4 C", "25 C", "n/a", "4 C"], ["1"] * 4, ["2024-01-02"] * 4)),
        ("0", "other", 9, ["h", "kd"], "kd", rows(["1"])),
    ])
    got = {tuple(r) for r in schema_changes(lines, inv.union(inv)).collect()}
    assert got == {("2", "renamed", "well_pos"), ("3", "removed", "well_pos"), ("3", "added", "run"), ("3", "renamed", "log"), ("3", "type_changed", "temp")}
    table = consistent_table(lines, inv).where("path = '2'").select("heavy", "label_number", F.expr("extras['well']").alias("well"), F.expr("extras['temp']").alias("temp")).collect()
    assert sorted(r["well"] for r in table) == sorted(WELLS) and {r["heavy"] for r in table} == {SEQ} and {r["label_number"] for r in table} == {1.0}


def test_no_cells_no_type_and_empty(spark):
    lines, inv = build(spark, [("1", "g", 1, ["h", "kd", "x"], "kd", rows(["1"], ["NA"])), ("2", "g", 2, ["h", "kd", "x"], "kd", rows(["1"], ["5"])), ("3", None, 3, ["h", "kd"], "kd", [])])
    assert schema_changes(lines, inv).count() == 0
    assert schema_changes(lines.limit(0), inv.limit(0)).count() == 0


def test_matching_prefers_content_to_names():
    col = lambda name, **k: {"name": name, "role": None, "type": "text", "n": 4, "n_number": 0, "n_bool": 0, "n_date": 0, "n_value": 0, "total": 0.0, "squares": 0.0, "vals": [1, 2, 3], "shapes": [9]} | k
    old = [col("plate"), col("buffer", vals=[5, 6, 7], shapes=[8])]
    new = [col("plate2", vals=[5, 6, 7], shapes=[8]), col("zz")]
    assert sorted(match_columns(old, new)) == [("buffer", "plate2"), ("plate", "zz")]
    assert match_columns(old, old) == [] and match_columns([], new) == []
    assert match_columns([col("a", vals=[1], shapes=[1])], [col("b", vals=[2], shapes=[2])]) == []


def test_a_column_that_becomes_a_chain_changes_its_type(spark):
    """Numbers that become residues, and residues that become numbers, under one name; a chain without any cell has no type."""
    lines, inv = build(spark, [("1", "g", 1, ["h", "kd", "x", "y"], "kd", [[SEQ, "1", "1", ""], [SEQ, "2", "2", "NA"]]), ("2", "g", 2, ["h", "kd", "x", "y"], "kd", [[SEQ, "1", SEQ, "7"], [SEQ, "2", SEQ, "8"]]), ("3", "g", 3, ["h", "kd", "x", "y"], "kd", [[SEQ, "1", "5", ""]])])
    light = F.when(F.col("path") == "2", F.array(F.lit("x"))).otherwise(F.array(F.lit("y")))
    inv = inv.withColumn("light_candidates", light)
    got = {tuple(r) for r in schema_changes(lines, inv).collect()}
    assert got == {("2", "type_changed", "x"), ("3", "type_changed", "x")}


def test_surroundings_decide_in_doubt():
    col = lambda name, vals, type="text": {"name": name, "role": None, "type": type, "n": 4, "n_number": 0, "n_bool": 0, "n_date": 0, "n_value": 0, "total": 0.0, "squares": 0.0, "vals": vals, "shapes": [vals[0] + 100]}
    left, right = col("left", [70]), col("right", [80])
    half, other = [1, 2, 3, 4], [1, 2, 7, 8]  # half of the values agree
    a, b = col("assay.well", half), col("assay.well_pos", other) | {"shapes": [5]}
    assert match_columns([left, a, right], [left, b, right]) == [("assay.well", "assay.well_pos")]
    assert match_columns([a, left, right], [left, right, b | {"name": "zz", "type": "number"}]) == []
    assert sketch_overlap(list(range(20)), list(range(400))[:SKETCH]) == 1.0 and sketch_overlap([1, 2], [3, 4]) == 0.0 and sketch_overlap([], []) == 0.0
