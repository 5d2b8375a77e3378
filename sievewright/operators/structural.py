"""Delimited lines separated into valid rows and rejects with a reason, by structural indexing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.session import lookup_join

#: Cells that count as missing, compared in lower case without outer spaces.
MISSING = ("", "na", "n/a", "nan", "none", "\\")
#: Byte of the separator of each delivered text format.
SEPARATORS = {"csv": ",", "tsv": "\t"}
ROLES = ("heavy", "light", "antigen", "label")

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_QUOTE, _SPACES = 34, np.frombuffer(b" \t\r\n\x0b\x0c", dtype=np.uint8)
_RESIDUE = np.zeros(256, dtype=bool)
_RESIDUE[np.frombuffer(b"ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy", dtype=np.uint8)] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[_SPACES] = True


def finite_number(text: str) -> bool:
    """Whether the first number in a text is finite; no number is none."""
    m = _NUMBER.search(text.replace(",", ""))
    return bool(m) and np.isfinite(float(m.group()))


class LineIndex:
    """Cell bounds and quoting faults of a batch of records that lie one after the other in one byte buffer."""

    def __init__(self, lines: pa.Array, separators: np.ndarray):
        lines = lines.cast(pa.large_string())
        ends = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + len(lines) + 1]
        body = lines.buffers()[2]
        self.data = data = np.frombuffer(body, dtype=np.uint8)[ends[0] : ends[-1]] if body is not None else np.zeros(0, np.uint8)
        self.starts, self.ends = (ends[:-1] - ends[0]), (ends[1:] - ends[0])
        count = len(lines)
        n = len(data)
        record = np.repeat(np.arange(count), self.ends - self.starts)
        quote = data == _QUOTE
        seen = np.concatenate([[0], np.cumsum(quote, dtype=np.int64)])
        inside = ((seen[:-1] - seen[self.starts[record]]) & 1).astype(bool)  # parity of the record's quotes before each byte
        sep = (data == separators[record]) & ~inside
        at_start, at_end = np.zeros(n, bool), np.zeros(n, bool)
        filled = self.ends > self.starts
        at_start[self.starts[filled]] = True
        at_end[self.ends[filled] - 1] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)  # a separator or another quote on that side, in the same record
        before[1:], after[:-1] = (sep | quote)[:-1], (sep | quote)[1:]
        opening, closing = quote & ~inside, quote & inside
        broken = (opening & ~(at_start | before)) | (closing & ~(at_end | after))
        bare = ((data == 10) | (data == 13)) & ~inside
        fault = np.zeros(count, dtype=bool)
        fault[record[broken | bare]] = True
        self.faulty = fault | (((seen[self.ends] - seen[self.starts]) & 1) == 1)
        self.sep_at = np.flatnonzero(sep)
        self.first_sep = np.searchsorted(self.sep_at, self.starts)
        self.width = np.searchsorted(self.sep_at, self.ends) - self.first_sep + 1
        self.quote = quote

    def cell(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of cell k[r] of each record r without the quotes around it; (0, 0) where it has none."""
        has = (k >= 0) & (k < self.width) & (self.ends > self.starts)
        lo, hi = self.starts.copy(), self.ends.copy()
        inner, last = has & (k > 0), has & (k < self.width - 1)
        lo[inner] = self.sep_at[(self.first_sep + k - 1)[inner]] + 1
        hi[last] = self.sep_at[(self.first_sep + k)[last]]
        lo[~has], hi[~has] = 0, 0
        quoted = has & (hi - lo >= 2)
        quoted[quoted] = self.quote[lo[quoted]] & self.quote[hi[quoted] - 1]
        return lo + quoted, hi - quoted

    def trimmed(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds without outer spaces; lo == hi where nothing is left."""
        solid = np.flatnonzero(~_SPACE[self.data]) if len(self.data) else np.zeros(0, np.int64)
        if not len(solid):
            return lo, lo
        a = np.searchsorted(solid, lo)
        b = np.searchsorted(solid, hi) - 1
        some = a <= b
        return np.where(some, solid[np.minimum(a, len(solid) - 1)], lo), np.where(some, solid[np.maximum(b, 0)] + 1, lo)

    def texts(self, lo: np.ndarray, hi: np.ndarray) -> list[str]:
        whole = self.data.tobytes()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def reasons(index: LineIndex, width: np.ndarray, roles: dict[str, np.ndarray]) -> np.ndarray:
    """The first reason that holds for each record: '' for none, 'quoting', 'width' or 'value'."""
    out = np.full(len(index.starts), "", dtype=object)
    ok_width = (index.width == width) & (index.ends > index.starts)
    bad = np.zeros(len(out), dtype=bool)
    wrong = np.concatenate([[0], np.cumsum(~_RESIDUE[index.data], dtype=np.int64)]) if len(index.data) else np.zeros(1, np.int64)
    for role in ("heavy", "light", "antigen"):
        lo, hi = index.trimmed(*index.cell(roles[role]))
        there = roles[role] >= 0
        bad |= there & (wrong[hi] > wrong[lo])
        if role == "heavy":
            bad |= there & (hi <= lo)
    lo, hi = index.trimmed(*index.cell(roles["label"]))
    ask = np.flatnonzero((roles["label"] >= 0) & (hi > lo) & ~index.faulty & ok_width & ~bad)
    for r, text in zip(ask, index.texts(lo[ask], hi[ask]), strict=True):
        if text.lower() not in MISSING and not finite_number(text):
            bad[r] = True
    out[bad] = "value"
    out[~ok_width] = "width"
    out[index.faulty] = "quoting"
    return out


def file_layout(inventory: DataFrame) -> DataFrame:
    """One row a path: separator, header_row, width, the position of each role's first candidate (-1: none), and the column names.

    Equal rows of one path count once; where they differ the least in the order of the columns stands. Files without
    lines (other formats) are left out.
    """
    first = lambda c: F.when(F.size(c) > 0, F.array_position("columns", F.element_at(c, 1)) - 1).otherwise(F.lit(-1)).cast("int")
    sep = F.create_map(*[F.lit(x) for pair in SEPARATORS.items() for x in pair])[F.lower("format")]
    rows = inventory.where(F.col("path").isNotNull()).select("path", sep.alias("sep"), "header_row", F.col("column_count").alias("width"), *[F.coalesce(first(f"{r}_candidates"), F.lit(-1)).alias(r) for r in ROLES], F.coalesce("columns", F.array().cast("array<string>")).alias("names")).where("sep is not null")
    return rows.groupBy("path").agg(F.min(F.struct(*[c for c in rows.columns if c != "path"])).alias("x")).select("path", "x.*")


def classify_lines(lines: DataFrame, inventory: DataFrame, with_cells: bool = False, with_roles: bool = False, uneven_cells: bool = False) -> DataFrame:
    """(line_id, path, line_no[, names][, roles], reason[, cells]) of every line after its file's header line.

    reason is null for a valid row, else the first that holds of 'quoting' (not RFC 4180), 'width' (cells differ from
    column_count; an empty or null line has too few) and 'value' (heavy blank, a chain or antigen with anything but the
    20 residues, a label without a finite number). cells are the unquoted cells of valid rows
    (with `uneven_cells` of all well-formed ones), the roles the places of their columns. Lines of paths that the
    inventory does not list, or without a path or number, are left out; repeated lines stay. An empty table gives no rows.

    The layout of the files is broadcast while small, else joined by path with hot paths salted; the lines themselves go
    through one Arrow pass: quote masks and the parity of their prefix counts find separators and record ends in bytes.
    """
    layout = file_layout(inventory)
    plan = lines.select("line_id", "path", "line_no", F.coalesce("line_text", F.lit("")).alias("line_text"))
    rows = lookup_join(plan, layout if with_cells else layout.drop("names"), ["path"], "inner", row_size=400).where("line_no > header_row")
    kept = ["line_id", "path", "line_no", *["names"] * with_cells, *ROLES * with_roles]
    rows = rows.select(*kept, "line_text", F.ascii("sep").cast("int").alias("sep"), F.coalesce("width", F.lit(-1)).cast("int").alias("width"), *[r for r in ROLES if not with_roles])
    fields = [rows.schema[c] for c in kept] + [T.StructField("reason", T.StringType())] + [T.StructField("cells", T.ArrayType(T.StringType()))] * with_cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            index = LineIndex(batch.column("line_text"), ints("sep").astype(np.uint8))
            why = reasons(index, ints("width"), {r: ints(r) for r in ROLES})
            columns = [batch.column(c) for c in kept] + [pa.array([x or None for x in why], pa.string())]
            if with_cells:
                read = (~index.faulty & (index.ends > index.starts)) if uneven_cells else why == ""
                good = np.flatnonzero(read)
                counts = np.where(read, index.width, 0)
                which = np.repeat(good, counts[good])
                nth = np.arange(len(which)) - np.repeat(np.cumsum(counts[good]) - counts[good], counts[good])
                flat = _cells(index, which, nth)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), flat))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def _cells(index: LineIndex, which: np.ndarray, nth: np.ndarray) -> pa.Array:
    lo, hi = index.starts[which].copy(), index.ends[which].copy()
    inner, last = nth > 0, nth < index.width[which] - 1
    lo[inner] = index.sep_at[(index.first_sep[which] + nth - 1)[inner]] + 1
    hi[last] = index.sep_at[(index.first_sep[which] + nth)[last]]
    quoted = hi - lo >= 2
    quoted[quoted] = index.quote[lo[quoted]]
    texts = index.texts(lo + quoted, hi - quoted)
    return pa.array([t.replace('""', '"') if q else t for t, q in zip(texts, quoted.tolist(), strict=True)], pa.string())
