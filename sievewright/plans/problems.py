"""The queries of the general data-quality problems: units, rejected lines, drifting schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators.drift import consistent_table, schema_changes
from sievewright.operators import units
from sievewright.operators.structural import classify_lines
from sievewright.operators.units import harmonise
from sievewright.sources import delivered


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every affinity value in nM or ug/mL, as 1000 times its logarithm."""
    rows = harmonise(_read(spark, sf, "assay_value"), _read(spark, sf, "label_registry"))
    return rows.select("value_id", "common_unit", F.round(F.col("log10_value") * 1000).cast("int").alias("log_milli"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that fail, each with the first reason."""
    return classify_lines(_read(spark, sf, "raw_line"), _read(spark, sf, "inventory_row")).where("reason is not null").select("line_id", "reason")


def p3_valid(spark: SparkSession, sf: str) -> DataFrame:
    """The valid rows with their cells."""
    rows = classify_lines(_read(spark, sf, "raw_line"), _read(spark, sf, "inventory_row"), with_cells=True)
    return rows.where("reason is null").select("line_id", "path", F.to_json("cells").alias("cells"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The changes of each file against the one delivered before it."""
    return schema_changes(_read(spark, sf, "raw_line"), _read(spark, sf, "inventory_row")).distinct()


def p6_table(spark: SparkSession, sf: str) -> DataFrame:
    """All valid lines in one consistent table."""
    rows = consistent_table(_read(spark, sf, "raw_line"), _read(spark, sf, "inventory_row"))
    return rows.withColumn("extras", F.to_json("extras"))


def structure_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The failing lines of every file by reason."""
    return delivered.structure_audit(_read(spark, sf, "raw_line"), _read(spark, sf, "inventory_row"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p3_found, p3_valid, p6_found, p6_table, structure_audit)}


_CELLS = lambda sep: f"regexp_extract_all(line_text || '{sep}', '((?:\"(?:[^\"]|\"\")*\")|[^\"{sep}]*){sep}', 1)"
_WELL = lambda sep: f"regexp_full_match(line_text, '(?s)(?:\"(?:[^\"]|\"\")*\"|[^\"{sep}\\r\\n]*)(?:{sep}(?:\"(?:[^\"]|\"\")*\"|[^\"{sep}\\r\\n]*))*')"
_CELL = lambda role: f"trim(CASE WHEN {role} IS NULL THEN NULL WHEN starts_with(c[p_{role}], '\"') THEN replace(c[p_{role}][2:-2], '\"\"', '\"') ELSE c[p_{role}] END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_WORDS = "('', 'na', 'n/a', 'nan', 'none', chr(92))"
_LABEL = "try_cast(nullif(regexp_extract(replace(label, ',', ''), '[-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?'), '') AS DOUBLE)"
_RESIDUE = lambda c: f"(coalesce({c}, '') <> '' AND NOT regexp_full_match({c}, '[ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]+'))"
_ROLES = ("heavy", "light", "antigen", "label")
_P3 = f"""WITH f AS (SELECT DISTINCT path, lower(format) AS format, header_row, column_count, columns, {', '.join(f"{r}_candidates[1] AS {r}" for r in _ROLES)} FROM inventory_row WHERE lower(format) IN ('csv', 'tsv')),
    x AS (SELECT l.line_id, coalesce(l.line_text, '') AS line_text, f.*, {', '.join(f"list_position(columns, {r}) AS p_{r}" for r in _ROLES)} FROM raw_line l JOIN f USING (path) WHERE l.line_no > f.header_row),
    y AS (SELECT *, CASE format WHEN 'csv' THEN {_WELL(',')} ELSE {_WELL(chr(9))} END AS well, CASE format WHEN 'csv' THEN {_CELLS(',')} ELSE {_CELLS(chr(9))} END AS c FROM x),
    z AS (SELECT line_id, path, p_light, well, line_text <> '' AND len(c) = column_count AS fits, c, {', '.join(f"{_CELL(r)} AS {r}" for r in _ROLES)}, heavy IS NOT NULL AS has_heavy FROM y),
    w AS (SELECT line_id, c, CASE WHEN NOT well THEN 'quoting' WHEN NOT fits THEN 'width' WHEN (has_heavy AND coalesce(heavy, '') = '') OR {' OR '.join(_RESIDUE(r) for r in _ROLES[:3])} OR (label IS NOT NULL AND lower(label) NOT IN {_WORDS} AND NOT coalesce(abs({_LABEL}) < 'infinity'::DOUBLE, false)) THEN 'value' END AS reason FROM z)"""


_END = "(?:$|[^A-Za-z0-9/])"
_EXPONENT = lambda k: f"replace(regexp_extract(t, '{units._NUMBER}', {k}), '−', '-')"


def _scale_sql(u: str, name: str) -> str:
    """Columns {name}_common and {name}_shift of a unit's text."""
    power = lambda text, table: f"CASE {text} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"
    part = lambda rx, k: f"regexp_extract({u}, '{rx}', {k})"
    short, word = f"^({units._LETTER})(?:M|mol(?:/[lL]| ?[lL] ?\\^?-1))$", f"^({units._WORD})molar$"
    mass, spelled = f"^({units._LETTER})g/({units._LETTER})[lL]$", f"^({units._WORD})grams? per ({units._WORD})lit(?:re|er)s?$"
    is_ = lambda rx: f"regexp_matches({u}, '{rx}')"
    shift = f"CASE WHEN {is_(short)} THEN {power(part(short, 1), units.PREFIX)} + 9 WHEN {is_(word)} THEN {power(part(word, 1), units.PREFIX_WORD)} + 9 WHEN {is_(mass)} THEN {power(part(mass, 1), units.PREFIX)} - {power(part(mass, 2), units.PREFIX)} + 3 WHEN {is_(spelled)} THEN {power(part(spelled, 1), units.PREFIX_WORD)} - {power(part(spelled, 2), units.PREFIX_WORD)} + 3 END"
    return f"CASE WHEN {is_(short)} OR {is_(word)} THEN 'nM' WHEN {is_(mass)} OR {is_(spelled)} THEN 'ug/mL' END AS {name}_common, {shift} AS {name}_shift"


def _p2_sql() -> str:
    found = lambda c, rx: f"nullif(regexp_extract(coalesce({c}, ''), '{rx}', 1), '')"
    inner, told = f"[\\[(/]\\s*({units._UNIT})\\s*[\\])]", f"(?:\\bin|\\bas|:)\\s+({units._UNIT}){_END}"
    bare = f"^\\s*(?:(?:-|−|negative )?\\s*(?:{units._LOG}|ln)\\s*[\\[(]?\\s*)?({units._UNIT})\\s*[\\])]?\\s*$"
    low = lambda c: f"lower(trim(coalesce({c}, '')))"
    step = lambda c: f"CASE WHEN regexp_matches({low(c)}, '^(?:-|−|negative )\\s*{units._LOG}') THEN '-log10' WHEN regexp_matches({low(c)}, '^{units._LOG}') THEN 'log10' WHEN regexp_matches({low(c)}, '^ln\\b') THEN 'ln' END"
    return f"""WITH r AS (SELECT source_file, coalesce({step('unit')}, {step('stored_transform')}, CASE WHEN starts_with(lower(metric), 'negative_log10') THEN '-log10' WHEN contains(lower(metric), 'log10') THEN 'log10' END, 'none') AS step,
            coalesce({found('unit', bare)}, {found('stored_transform', inner)}, {found('notes', told)}, {found('evidence', told)}) AS u FROM label_registry WHERE metric IN ({', '.join(f"'{m}'" for m in units.METRICS)})),
        s AS (SELECT source_file, step, {_scale_sql('u', 'r')} FROM r), v AS (SELECT value_id, source_file, coalesce(value_text, '') AS t FROM assay_value),
        c AS (SELECT value_id, source_file, try_cast(replace(replace(regexp_extract(t, '{units._NUMBER}', 1), ',', ''), '−', '-') || 'e' || coalesce(nullif({_EXPONENT(2)}, ''), nullif({_EXPONENT(3)}, ''), '0') AS DOUBLE) AS x, {found(f"regexp_replace(t, '{units._NUMBER}', '')", f"^\\s*[\\[(]?\\s*({units._UNIT}){_END}")} AS u FROM v),
        d AS (SELECT value_id, source_file, x, {_scale_sql('u', 'c')} FROM c WHERE abs(x) < 'infinity'::DOUBLE),
        e AS (SELECT value_id, x, coalesce(c_common, r_common) AS common_unit, CASE WHEN c_common IS NOT NULL THEN c_shift ELSE r_shift END AS shift, CASE WHEN c_common IS NOT NULL THEN 'none' ELSE step END AS step FROM d JOIN s USING (source_file)),
        f AS (SELECT value_id, common_unit, shift + CASE step WHEN '-log10' THEN -x WHEN 'log10' THEN x WHEN 'ln' THEN x / ln(10.0::DOUBLE) ELSE CASE WHEN x > 0 THEN log10(x) END END AS y FROM e WHERE common_unit IS NOT NULL)
        SELECT value_id, common_unit, round(y * 1000)::INTEGER AS log_milli FROM f WHERE y IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    """SQL of the problems that it can express on whole tables."""
    plain = "list_transform(c, lambda x: CASE WHEN starts_with(x, '\"') THEN replace(x[2:-2], '\"\"', '\"') ELSE x END)"
    counts = ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("quoting", "width", "value"))
    gap = "z.p_light IS NULL OR lower(z.light) IN " + _WORDS
    return {
        "p2_found": _p2_sql(),
        "structure_audit": f"{_P3} SELECT z.path, count(*) AS rows, {counts}, count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason IS NULL AND ({gap})) AS missing_light FROM w JOIN z USING (line_id) GROUP BY 1",
        "p3_found": f"{_P3} SELECT line_id, reason FROM w WHERE reason IS NOT NULL",
        "p3_valid": f"{_P3} SELECT w.line_id, l.path, to_json({plain})::VARCHAR AS cells FROM w JOIN raw_line l USING (line_id) WHERE reason IS NULL",
    }
