"""Schemas that drift between deliveries: column profiles, matching by similarity flooding, one consistent table."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.operators.graph import connected_components
from sievewright.operators.structural import MISSING, ROLES, classify_lines
from sievewright.session import lookup_join, stage

#: Distinct values and shapes kept per column: those with the smallest hashes over all cells (a bottom-k sketch).
SKETCH = 48
#: Settled score from which two columns correspond, and what their surroundings weigh in it against their own likeness.
ACCEPT, AROUND = 0.5, 0.2

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_FIRST = re.compile(r"[^\d+\-.]{0,2}([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*[^\d\s]{0,8}")
_ISO = re.compile(r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])")
_DATE = re.compile(r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/. ](?:\d{1,2}|[A-Za-z]{3,9})\.?,?[-/. ]\d{4}|[A-Za-z]{3,9}\.? \d{1,2},? \d{4})")
_PROFILE = "path string, name string, n long, n_number long, n_bool long, n_iso long, n_date long, n_value long, total double, squares double, vals array<long>, shapes array<long>"


def _shape(text: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d", "9", text)))


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1


def _profile(cells: list[str]) -> tuple:
    """Counts of the cells by kind, moments of the numbers in them and sketches of values and shapes."""
    kept = [c for c in (x.strip() for x in cells) if c.lower() not in MISSING]
    number = flag = iso = date = value = 0
    total = squares = 0.0
    for c in kept:
        if _NUMBER.fullmatch(c) and np.isfinite(float(c)):
            number += 1
        truth = c.lower() in ("true", "false")
        flag += truth
        iso += bool(_ISO.fullmatch(c))
        if _DATE.fullmatch(c):
            date += 1
        elif truth or ((m := _FIRST.fullmatch(c)) and np.isfinite(float(m.group(1)))):
            x = float(c.lower() == "true") if truth else float(m.group(1))
            if abs(x) < 1e100:
                value, total, squares = value + 1, total + x, squares + x * x
    distinct = set(kept)
    sketch = lambda xs: sorted({_hash(x) for x in xs})[:SKETCH]
    return len(kept), number, flag, iso, date, value, total, squares, sketch(x.lower() for x in distinct), sketch(_shape(x) for x in distinct)


def _chain_profile(cells: list[str]) -> tuple:
    """The profile of a column that holds residues or nothing: text, or no cells."""
    return int(any(c.strip().lower() not in MISSING for c in cells)), 0, 0, 0, 0, 0, 0.0, 0.0, [], []


def column_profiles(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, name, counts, moments, sketches) of every column over the cells of its valid lines that are not missing.

    Each Arrow batch is reduced to one row a file and column before anything is shuffled. Of the columns that the line
    check itself reads as chains, whose filled cells are residues and so text, only whether any cell is filled is noted.
    """
    chains = list(ROLES[:3])
    valid = classify_lines(lines, inventory, with_cells=True, with_roles=True).where("reason is null").select("path", "names", "cells", *chains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by: dict[str, tuple[list, set, list]] = {}
            for path, names, cells, *at in zip(batch["path"], batch["names"], batch["cells"], *(batch[c] for c in chains), strict=True):
                if path not in by:
                    by[path] = (list(names), set(at), [])
                by[path][2].append(cells)
            rows = []
            for path, (names, checked, cells) in by.items():
                for k, (name, column) in enumerate(zip(names, zip(*cells, strict=True), strict=False)):
                    rows.append((path, name, *(_chain_profile if k in checked else _profile)(column)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PROFILE.split(", ")])

    partial = valid.mapInPandas(run, _PROFILE)
    sums = [F.sum(c).alias(c) for c in ("n", "n_number", "n_bool", "n_iso", "n_date", "n_value", "total", "squares")]
    least = [F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, SKETCH).alias(c) for c in ("vals", "shapes")]
    return partial.groupBy("path", "name").agg(*sums, *least)


def column_type(prefix: str = "") -> F.Column:
    """number, bool, date or text, holding for all cells that are not missing; null where there is none."""
    c = lambda x: F.col(prefix + x)
    return F.when(c("n") == c("n_number"), "number").when(c("n") == c("n_bool"), "bool").when(c("n") == c("n_iso"), "date").when(c("n") > 0, "text")


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of two names, case and punctuation aside."""
    pairs = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or {s}
    x, y = (pairs(re.sub(r"[^a-z0-9]+", "", s.lower())) for s in (a, b))
    return 2 * len(x & y) / max(1, len(x) + len(y))


def sketch_overlap(a: list[int], b: list[int]) -> float:
    """The share of the smaller of two sets that the other holds too, from their bottom-k sketches.

    Only hashes that both sketches reach are compared, so sets of any two sizes are.
    """
    upto = min([x[-1] for x in (a, b) if len(x) >= SKETCH], default=None)
    x, y = ({v for v in s if upto is None or v <= upto} for s in (a, b))
    return len(x & y) / max(1, min(len(x), len(y)))


def content_similarity(a: dict, b: dict) -> float | None:
    """How alike two columns' cells are, 0 to 1; None where either has no cells."""
    if not a.get("n") or not b.get("n"):
        return None
    share = lambda p, k: p[k] / p["n"]
    if share(a, "n_date") > 0.8 or share(b, "n_date") > 0.8:
        return 1.0 if min(share(a, "n_date"), share(b, "n_date")) > 0.8 else 0.0
    overlap = lambda k: sketch_overlap(a[k], b[k])
    if min(share(a, "n_value"), share(b, "n_value")) > 0.8:
        moments = []
        for p in (a, b):
            m = p["total"] / p["n_value"]
            moments.append((m, max(p["squares"] / p["n_value"] - m * m, (0.05 * m) ** 2, 1e-9)))
        (m, v), (k, w) = moments
        spread = np.sqrt(2 * np.sqrt(v * w) / (v + w)) * np.exp(-((m - k) ** 2) / (4 * (v + w)))  # overlap of two normal laws
        alike = max(0.0, (float(spread) - 0.4) / 0.6)  # an overlap of 0.7 counts half
        lettered = max(share(a, "n_number"), share(b, "n_number")) < 0.5 and max(share(a, "n_bool"), share(b, "n_bool")) < 0.5
        return alike * (0.3 + 0.7 * overlap("shapes")) if lettered else alike
    if max(share(a, "n_value"), share(b, "n_value")) > 0.8:
        return 0.3 * overlap("vals")
    return max(overlap("vals"), 0.9 * overlap("shapes"))


def _parent(name: str) -> str | None:
    """The path above a nested column's own name ('a.b' or 'a/b')."""
    cut = max(name.rfind("."), name.rfind("/"))
    return name[:cut] if cut > 0 else None


def _own_likeness(a: dict, b: dict) -> float | None:
    """How alike two columns are by themselves: roles must agree, then content tells; without cells on a side the names, for less."""
    if a["role"] != b["role"]:
        return None
    if a["role"]:
        return 1.0
    content = content_similarity(a, b)
    return 0.6 * name_similarity(a["name"], b["name"]) if content is None else content


def flooded(old: list[dict], new: list[dict], rounds: int = 100, eps: float = 1e-6) -> dict[tuple[str, str], float]:
    """The settled score of each pair of columns that may correspond, 0 to 1, by similarity flooding.

    Nodes of the graph are pairs of columns: those that kept their name, which are certain, and those of a gone and a new
    column. A pair's score is 1 - AROUND of its own likeness and AROUND of the mean score of what stands around it:
    the pairs of its left and right neighbours, its types, its names and, for nested columns, its parents, whose
    score is the best of the other pairs below them. Scores flow until none moves by eps.
    """
    before, after = {c["name"] for c in old}, {c["name"] for c in new}
    own = {(c["name"], c["name"]): 1.0 for c in old if c["name"] in after}
    kind = lambda c: c.get("type")
    around: dict[tuple[str, str], list] = {}
    for i, a in enumerate(old):
        for j, b in enumerate(new):
            if a["name"] in after or b["name"] in before or (likeness := _own_likeness(a, b)) is None:
                continue
            pair = (a["name"], b["name"])
            own[pair] = likeness
            near = [float(bool(kind(a)) and kind(a) == kind(b)), name_similarity(*pair)]
            near += [(old[i + d]["name"], new[j + d]["name"]) for d in (-1, 1) if 0 <= i + d < len(old) and 0 <= j + d < len(new)]
            if (above := (_parent(pair[0]), _parent(pair[1]))) != (None, None):
                near.append([p for p in ((x["name"], y["name"]) for x in old for y in new if (_parent(x["name"]), _parent(y["name"])) == above) if p != pair])
            around[pair] = near
    score = dict(own)

    def from_node(x: object) -> float:
        if isinstance(x, list):
            return max((score.get(p, 0.0) for p in x), default=0.0)
        return x if isinstance(x, float) else score.get(x, 0.0)

    for _ in range(rounds):
        moved = {p: (1 - AROUND) * own[p] + AROUND * sum(map(from_node, near)) / len(near) for p, near in around.items()}
        change = max((abs(moved[p] - score[p]) for p in moved), default=0.0)
        score |= moved
        if change < eps:
            break
    return {p: score[p] for p in around}


def match_columns(old: list[dict], new: list[dict]) -> list[tuple[str, str]]:
    """Correspondences of columns that are gone and columns that are new: settled pairs of ACCEPT or more, best first, each column once."""
    out: list[tuple[str, str]] = []
    for (a, b), score in sorted(flooded(old, new).items(), key=lambda x: (-round(x[1], 9), x[0])):
        if score >= ACCEPT and all(a != x and b != y for x, y in out):
            out.append((a, b))
    return out


def file_schemas(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, source_group, delivered_at, columns as JSON): one row a file with its columns in order, roles, types and profiles."""
    one = inventory.where("path is not null and source_group is not null").groupBy("path").agg(F.min(F.struct("source_group", "delivered_at", "columns", *[f"{r}_candidates" for r in ROLES])).alias("x")).select("path", "x.*")
    flat = one.select("path", "source_group", "delivered_at", *[f"{r}_candidates" for r in ROLES], F.posexplode_outer("columns").alias("pos", "name"))
    role = F.lit(None).cast("string")
    for r in ROLES:
        role = F.when(F.array_contains(f"{r}_candidates", F.col("name")), r).otherwise(role)
    profiled = column_profiles(lines, inventory)
    profiled = profiled.select("*", column_type().alias("type"))
    joined = flat.select("path", "source_group", "delivered_at", "pos", "name", role.alias("role")).join(profiled, ["path", "name"], "left")
    fields = ["pos", "name", "role", "type", "n", "n_number", "n_bool", "n_date", "n_value", "total", "squares", "vals", "shapes"]
    return joined.groupBy("path").agg(F.first("source_group").alias("source_group"), F.first("delivered_at").alias("delivered_at"), F.array_sort(F.collect_list(F.struct(*fields))).alias("columns"))


def schema_steps(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, previous, change_kind, old_name, column_name): what each file does to the columns of the one delivered just before.

    change_kind is 'kept', 'type_changed' (name kept, type differs), 'renamed', 'added' or 'removed'; the first file of a
    group has one 'first' row a column. Names are compared exactly, column order is no change. A column without cells that
    are not missing has no type and so changes none. Files inventoried twice count once; files without a source_group are
    left out; ties in delivered_at follow the path. An empty inventory gives no rows.
    """
    files = file_schemas(lines, inventory)
    order = Window.partitionBy("source_group").orderBy(F.col("delivered_at").asc_nulls_first(), "path")
    pairs = files.select("path", "columns", F.lag("path").over(order).alias("previous"), F.lag("columns").over(order).alias("before"))
    pairs = pairs.select("path", "previous", F.to_json("columns").alias("columns"), F.to_json("before").alias("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, previous, columns, before in zip(batch["path"], batch["previous"], batch["columns"], batch["before"], strict=True):
                new = [{"role": None, **c} for c in json.loads(columns) if c.get("name") is not None]
                if previous is None:
                    rows += [(path, None, "first", None, c["name"]) for c in new]
                    continue
                old = [{"role": None, **c} for c in json.loads(before) if c.get("name") is not None]
                renamed = match_columns(old, new)
                was, now = {c["name"]: c for c in old}, {c["name"]: c for c in new}
                rows += [(path, previous, "renamed", a, b) for a, b in renamed]
                rows += [(path, previous, "removed", x, x) for x in was if x not in now and x not in {a for a, _ in renamed}]
                rows += [(path, previous, "added", None, x) for x in now if x not in was and x not in {b for _, b in renamed}]
                for x in was.keys() & now.keys():
                    s, t = was[x].get("type"), now[x].get("type")
                    rows.append((path, previous, "type_changed" if s and t and s != t else "kept", x, x))
            yield pd.DataFrame(rows, columns=["path", "previous", "change_kind", "old_name", "column_name"])

    return pairs.mapInPandas(run, "path string, previous string, change_kind string, old_name string, column_name string")


def schema_changes(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, change_kind, column_name): the changes of schema_steps without what stayed."""
    return schema_steps(lines, inventory).where(F.col("change_kind").isin("renamed", "added", "removed", "type_changed")).select("path", "change_kind", "column_name")


def consistent_table(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """(line_id, path, line_no, heavy, light, antigen, label, label_number, extras): all valid lines under one schema.

    Role columns come under their role's name whatever a file calls them. Every other column keeps one name through all
    deliveries of its source_group, the one it had first: columns linked by 'kept' or 'renamed' steps are one component.
    Those stand in the map `extras`. Missing cells are null; label_number is the first number of the label.
    """
    steps = stage(schema_steps(lines, inventory))
    node = lambda p, c: F.concat_ws("\u001f", p, c)
    all_nodes = steps.where("change_kind <> 'removed'").select(node("path", "column_name").alias("u"), node("path", "column_name").alias("v"))
    links = steps.where(F.col("change_kind").isin("kept", "type_changed", "renamed")).select(node("path", "column_name").alias("u"), node("previous", "old_name").alias("v"))
    roots = connected_components(links.union(all_nodes))
    one = inventory.where("path is not null").groupBy("path").agg(F.min("delivered_at").alias("delivered_at"))
    named = roots.withColumn("path", F.substring_index("node", "\u001f", 1)).withColumn("name", F.substring_index("node", "\u001f", -1)).join(one, "path")
    first = named.groupBy("root").agg(F.min(F.struct("delivered_at", "path", "name")).alias("f")).select("root", F.col("f.name").alias("first_name"))
    names = named.join(first, "root").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "first_name"))).alias("canonical"))
    roles = inventory.where("path is not null").groupBy("path").agg(F.min(F.struct(*[F.element_at(F.when(F.size(f"{r}_candidates") > 0, F.col(f"{r}_candidates")), 1).alias(r) for r in ROLES])).alias("r")).select("path", "r.*")
    layout = roles.withColumnsRenamed({r: f"_{r}" for r in ROLES}).join(names, "path", "left")
    valid = classify_lines(lines, inventory, with_cells=True).where("reason is null").drop("reason")
    cell = F.map_from_arrays("names", "cells")
    known = F.transform_values(cell, lambda _, v: F.when(~F.lower(F.trim(v)).isin(*MISSING), v))
    rows = lookup_join(valid, layout, ["path"], "inner", row_size=2_000).withColumn("_m", known)
    pick = lambda r: F.when(F.col(f"_{r}").isNotNull(), F.element_at("_m", F.col(f"_{r}"))).alias(r)
    is_role = lambda k: F.coalesce(F.array_contains(F.array(*[f"_{r}" for r in ROLES]), k), F.lit(False))
    extras = F.map_from_entries(F.transform(F.filter(F.map_entries("_m"), lambda e: ~is_role(e["key"])), lambda e: F.struct(F.coalesce(F.element_at("canonical", e["key"]), e["key"]), e["value"])))
    out = rows.select("line_id", "path", "line_no", *[pick(r) for r in ROLES], extras.alias("extras"))
    number = F.expr("try_cast(regexp_extract(replace(label, ',', ''), '[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?', 0) as double)")
    return out.withColumn("label_number", number)
