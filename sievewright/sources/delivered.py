"""Delivered text files: record reading, header search, alias binding, typed records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions.sequences import normalize_sequence
from sievewright.functions.values import parse_number
from sievewright.operators.structural import MISSING, ROLES, SEPARATORS, classify_lines
from sievewright.session import lookup_join, stage

# Header names of each role in delivered files, first match wins.
KNOWN_NAMES = {
    "heavy": ["heavy", "HC", "Ab_heavy_chain_seq", "Ab/Nano H_Chain AA", "sequence"],
    "light": ["light", "LC", "Ab_light_chain_seq", "Ab/Nano L_Chain AA"],
    "antigen": ["antigen_seq", "Ag_seq", "Ag_Seq"],
    "antigen_id": ["Antigen", "Target", "Ag_name", "Ag_Name", "name"],
    "cdrh3": ["CDRH3", "HCDR3", "Ab/Nano_CDR H3"],
    "label": ["fitness", "Pred_affinity", "KD [bind/no bind]", "Kd [M]"],
}
#: Further names of some roles, tried after the known ones.
MORE_NAMES = {"heavy": ["heavy_chain", "H_seq"], "light": ["light_chain", "L_seq"], "antigen": ["target_seq"], "label": ["KD (nM)", "IC50", "binding_affinity", "log_aff"]}
ALIASES = {role: names + MORE_NAMES.get(role, []) for role, names in KNOWN_NAMES.items()}
HEADER_ROWS = 80
CHUNK = 1 << 23
#: Bytes of a file that one task reads, and of a record that stays open before its first line counts as broken.
RANGE_BYTES, OPEN_BYTES = 1 << 27, 1 << 26


def _open(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system.open_input_file(at)


def _lines(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its line feed) of the physical lines that begin at `start` or later."""
    at, skip = max(start - 1, 0), start > 0  # what comes up to the first line feed belongs to the line before
    file.seek(at)
    left = b""
    while True:
        chunk = file.read(CHUNK)
        *lines, left = (left + chunk).split(b"\n")
        for line in [*(x + b"\n" for x in lines), *([left] if left and not chunk else [])]:
            if not skip:
                yield at, line
            skip = False
            at += len(line)
        if not chunk:
            return


def file_width(file, separator: bytes) -> int | None:
    """Cells of the header: the first of HEADER_ROWS lines that holds a name of the heavy chain; None without one."""
    known = {a.lower() for a in ALIASES["heavy"]}
    for k, (_, line) in enumerate(_lines(file, 0)):
        if k == HEADER_ROWS:
            return None
        cells = line.decode("utf-8-sig", "replace").rstrip("\r\n").split(separator.decode())
        if known & {c.strip().strip('"').strip().lower() for c in cells}:
            return len(cells)
    return None


def _fits(line: bytes, separator: bytes, width: int | None) -> bool:
    """Whether a line is a whole record by itself: even quotes and the width of the header, separators in quotes aside."""
    if width is None or width < 2:
        return False
    parts = line.split(b'"')
    return len(parts) % 2 == 1 and sum(p.count(separator) for p in parts[::2]) + 1 == width


def records(path: str, separator: bytes, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """The records of a file whose lines begin from byte `start` on, up to the first whole record at `end` or later.

    A line with an open quote takes in the lines after it until the quote closes. If a line that is a whole record by itself
    comes first, the quote was a stray one: the lines before it are records of their own, broken ones, and reading goes on
    there. Such a line always begins a record, so ranges of a file meet at them and together give what one reader gives.
    """
    with _open(path) as file:
        width = file_width(file, separator)
        held: list[bytes] = []
        odd, size, begun = False, 0, start == 0
        for at, line in _lines(file, start):
            whole = (held or not begun or (end is not None and at >= end)) and _fits(line, separator, width)
            if not begun:
                if not whole:
                    continue
                begun = True
            if whole:
                yield from held
                held, odd, size = [], False, 0
                if end is not None and at >= end:
                    return
            held.append(line)
            odd, size = odd ^ (line.count(b'"') % 2 == 1), size + len(line)
            if not odd:
                yield b"".join(held)
                held, size = [], 0
            elif size > OPEN_BYTES:
                yield from held
                held, odd, size = [], False, 0
        yield from held


def delivered_files(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*.csv", "*.tsv")) -> DataFrame:
    """(file, path, format, size_bytes): files below root, path relative to it; contents are not read."""
    found = None
    for p in patterns:
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", p).load(root).select(F.col("path").alias("file"), F.col("length").alias("size_bytes"))
        found = one if found is None else found.union(one)
    base = "/" + root.removeprefix("file://").strip("/") + "/"
    return found.select("file", F.substring_index("file", base, -1).alias("path"), F.lower(F.substring_index("file", ".", -1)).alias("format"), "size_bytes")


def delivered_lines(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(line_id, path, line_no, line_text): one row a record, quoted line breaks kept inside it.

    Files are read in ranges of `range_bytes`, spread over tasks; records are numbered by the counts of the ranges before.
    Bytes that are not UTF-8 are replaced, a byte order mark is dropped. A stray quote breaks the line that holds it, see `records`.
    """
    parts = max(8, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sep = F.create_map(*[F.lit(x) for p in SEPARATORS.items() for x in p])
    last = F.greatest(F.lit(0), F.ceil(F.col("size_bytes") / range_bytes) - 1).cast("int")
    ranges = files.select("file", "path", F.coalesce(sep[F.col("format")], F.lit(",")).alias("sep"), last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, path, sep, last, part in batch[["file", "path", "sep", "last", "part"]].itertuples(index=False):
                rows, n = [], 0
                for record in records(file, sep.encode(), part * range_bytes, None if part == last else (part + 1) * range_bytes):
                    n += 1
                    rows.append((path, part, n, record.rstrip(b"\r\n").decode("utf-8-sig" if n == 1 and part == 0 else "utf-8", "replace")))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["path", "part", "n", "line_text"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "part", "n", "line_text"])

    lines = ranges.repartition(parts, "path", "part").mapInPandas(run, "path string, part int, n int, line_text string")
    if files.where(F.col("size_bytes") > range_bytes).isEmpty():
        numbered = lines.withColumn("line_no", F.col("n"))
    else:
        lines = stage(lines)
        order = Window.partitionBy("path").orderBy("part")
        counts = lines.groupBy("path", "part").agg(F.max("n").alias("_n"))
        before = counts.select("path", "part", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
        numbered = lookup_join(lines, before, ["path", "part"], "inner").withColumn("line_no", (F.col("_before") + F.col("n")).cast("int"))
    return numbered.select(F.xxhash64("path", "line_no").alias("line_id"), "path", "line_no", "line_text")


def inventory_of(lines: DataFrame, files: DataFrame) -> DataFrame:
    """An inventory row a file: the header is the first of HEADER_ROWS lines with a known heavy column, then roles by alias."""
    sep = F.create_map(*[F.lit(x) for p in SEPARATORS.items() for x in p])[F.col("format")]
    head = lines.where(F.col("line_no") <= HEADER_ROWS).join(files.select("path", "format", "size_bytes"), "path")
    cells = F.transform(F.split("line_text", F.concat(F.lit("\\Q"), sep, F.lit("\\E"))), lambda c: F.trim(F.trim(c), F.lit('"')))
    known = F.array(*[F.lit(a.lower()) for a in ALIASES["heavy"]])
    rows = head.withColumn("columns", cells).where(F.arrays_overlap(F.transform("columns", lambda c: F.lower(F.trim(c))), known))
    first = rows.groupBy("path").agg(F.min_by(F.struct("line_no", "columns", "format", "size_bytes"), "line_no").alias("h"))
    counts = lines.groupBy("path").agg(F.max("line_no").alias("last"))

    def named(alias: str) -> F.Column:
        """The header cell that spells an alias, in any case; null without one."""
        return F.get(F.filter("columns", lambda c: F.lower(F.trim(c)) == alias.lower()), 0)

    role = lambda r: F.array_distinct(F.array_compact(F.array(*[named(a) for a in ALIASES[r]]))).alias(f"{r}_candidates")
    out = first.join(counts, "path").select("path", "h.format", "h.size_bytes", F.col("h.line_no").alias("header_row"), (F.col("last") - F.col("h.line_no")).cast("bigint").alias("row_count"), F.col("h.columns").alias("columns"))
    return out.select("*", F.size("columns").alias("column_count"), *[role(r) for r in ALIASES])


def raw_records(lines: DataFrame, inventory: DataFrame, lenient: bool = False) -> DataFrame:
    """(source_file, line_no, antigen_id, heavy, light, antigen, cdrh3, raw_label): valid lines with a residue heavy chain and a number for label.

    A role takes the first of its candidates; one that a file lacks, or that the inventory has no column for, is blank. A
    `lenient` reader also takes well-formed lines that fail: missing cells are blank, cells beyond the header are dropped, chains
    keep their letters if all of them are residues.
    """
    read = classify_lines(lines, inventory, with_cells=True, uneven_cells=lenient)
    valid = read.where("reason is null or reason <> 'quoting'" if lenient else "reason is null")
    roles = [r for r in ALIASES if f"{r}_candidates" in inventory.columns]
    named = inventory.groupBy("path").agg(F.min(F.struct(*[F.get(f"{r}_candidates", 0).alias(r) for r in roles])).alias("r")).select("path", "r.*")
    rows = lookup_join(valid, named, ["path"], "inner", row_size=400).withColumn("_m", F.map_from_arrays("names", F.transform("names", lambda _, i: F.coalesce(F.get("cells", i), F.lit("")))))
    pick = lambda r: F.when(F.col(r).isNotNull(), F.element_at("_m", F.col(r))) if r in roles else F.lit(None).cast("string")
    chains = [normalize_sequence(pick(r)).alias(r) for r in ("heavy", "light", "antigen", "cdrh3")]
    out = rows.select(F.col("path").alias("source_file"), "line_no", F.trim(F.coalesce(pick("antigen_id"), F.lit(""))).alias("antigen_id"), *chains, parse_number(pick("label")).alias("raw_label"))
    return out.where("heavy <> '' and raw_label is not null")


def file_digests(files: DataFrame) -> DataFrame:
    """(path, size_bytes, sha256, problem): each file read once in pieces of CHUNK bytes; the members of zips are checked against their sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import zipfile

        for batch in batches:
            rows = []
            for file, path in zip(batch["file"], batch["path"], strict=True):
                digest, size, problem = hashlib.sha256(), 0, None
                with _open(file) as source:
                    while piece := source.read(CHUNK):
                        digest.update(piece)
                        size += len(piece)
                    if path.lower().endswith((".zip", ".xlsx", ".docx")):
                        source.seek(0)
                        try:
                            with zipfile.ZipFile(source) as z:
                                bad = z.testzip()
                                problem = f"damaged member {bad}" if bad else None
                        except zipfile.BadZipFile:
                            problem = "no zip file"
                rows.append((path, size, digest.hexdigest(), problem))
            yield pd.DataFrame(rows, columns=["path", "size_bytes", "sha256", "problem"])

    parts = max(8, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("file", "path").repartition(parts, "path").mapInPandas(run, "path string, size_bytes long, sha256 string, problem string")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets or inventories in JSON, one object or an array a file, over any number of lines."""
    return spark.read.option("multiLine", True).json(path)


def first_rows(lines: DataFrame, limit: int) -> DataFrame:
    """The first `limit` lines of every file: the sample that a profile reads."""
    return lines.where(F.col("line_no") <= limit)


def structure_audit(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, rows, quoting, width, value, valid, missing_light): how many lines of every file fail by reason, and valid ones without a light chain.

    Lines before and at the header do not count; files without lines are left out.
    """
    rows = classify_lines(lines, inventory, with_cells=True, with_roles=True)
    light = F.lower(F.trim(F.get("cells", F.col("light"))))
    gap = F.col("reason").isNull() & ((F.col("light") < 0) | light.isin(*MISSING))
    return rows.groupBy("path").agg(F.count("*").alias("rows"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("quoting", "width", "value")], F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(gap).alias("missing_light"))
