"""Same or near-same records across splits: an edit-distance segment join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.session import drop_staged, stage

#: Most index postings (about 24 bytes each) that every task may hold; more are joined by a shuffle.
POSTINGS = 4_000_000
#: Most letters and matches that a task works on at once.
CHUNK = 1 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BUCKETS = 21


def letters(text: Column) -> Column:
    """Upper-cased letters of a text; null gives ''."""
    return F.when(text.rlike(r"^[A-Z]+\z"), text).otherwise(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", "")))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FACTOR, _FACTOR_INVERSE = _U(0x5851F42D4C957F2D), _U(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[_U(1)], np.full(n, factor)]))


class Texts:
    """A block of texts as code points, with hashes of any of their substrings by prefix sums."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.length) - self.length
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)

    def signatures(self) -> np.ndarray:
        """Counts of the letters modulo 8, three bits for each of 21 kinds; k edits move at most 2k counts by one."""
        row = np.repeat(np.arange(len(self.texts)), self.length)
        counts = np.bincount(row * _BUCKETS + self.codes % _BUCKETS, minlength=len(self.texts) * _BUCKETS).reshape(-1, _BUCKETS) & 7
        return (counts << (3 * np.arange(_BUCKETS))).sum(1)

    def hashed(self) -> None:
        n = len(self.codes)
        self._back = _powers(_FACTOR_INVERSE, n)
        terms = _mix(self.codes.astype(_U) + _STEP) * _powers(_FACTOR, n)[:n]
        self._sums = np.concatenate([[_U(0)], np.cumsum(terms)])

    def part(self, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        a = self.start[row] + at
        return (self._sums[a + size] - self._sums[a]) * self._back[a]


def _key(base: np.ndarray, n: np.ndarray, i: int, part: np.ndarray) -> np.ndarray:
    """The key of segment i of a text of n letters under the keys matched before."""
    return _mix(_mix(base.astype(_U) + (n.astype(_U) << _U(8)) + _U(i)) ^ part).view(np.int64)


def _cut(n: np.ndarray, k: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of k + 1 even segments of texts of n letters; the later segments are the longer ones."""
    base, more = np.divmod(n, k + 1)
    extra = i - (k + 1 - more)
    return i * base + np.maximum(extra, 0), base + (extra >= 0)


def _short_keys(base: int, text: str, least: int) -> np.ndarray:
    """Keys of all subsequences of a few letters with `least` of them or more."""
    import xxhash

    subs = {"".join(c) for size in range(max(least, 0), len(text) + 1) for c in combinations(text, size)}
    part = np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in subs], _U)
    return _key(np.full(len(subs), base, np.int64), np.full(len(subs), 1 << 40, np.int64), 255, part)


def index_keys(block: Texts, base: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, key, at, len): the k + 1 segments of each text; texts of k letters or fewer give their subsequences."""
    long = np.flatnonzero(block.length > k)
    for i in range(k + 1):
        at, size = _cut(block.length[long], k, i)
        yield long, _key(base[long], block.length[long], i, block.part(long, at, size)), at, size
    for r in np.flatnonzero(block.length <= k).tolist():
        key = _short_keys(int(base[r]), block.texts[r], 0)
        yield np.full(len(key), r), key, np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)


def probe_keys(block: Texts, base: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, key, at, len): every substring that a segment of a text within k edits can match.

    For an indexed length and segment i at p, a match leaves at least i edits to its left and k - i to its right,
    which bounds its position from both ends.
    """
    m = block.length
    for shift in range(-k, k + 1):  # letters that the probe has more than the indexed text
        n = m - shift
        for i in range(k + 1):
            p, size = _cut(n, k, i)
            low = np.maximum(0, np.maximum(p - i, p + shift - (k - i)))
            high = np.minimum(m - size, np.minimum(p + i, p + shift + (k - i)))
            for off in range(2 * k + 1):
                row = np.flatnonzero((n > k) & (low + off <= high))
                if not len(row):
                    break
                at = (low + off)[row]
                yield row, _key(base[row], n[row], i, block.part(row, at, size[row])), at, size[row]
    for r in np.flatnonzero(m <= 2 * k).tolist():
        key = _short_keys(int(base[r]), block.texts[r], len(block.texts[r]) - k)
        yield np.full(len(key), r), key, np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Texts, dict[str, np.ndarray]]]:
    """Texts of at most CHUNK letters (or one longer text) with the numbers that come with them."""
    for batch in batches:
        texts = batch.column("s").to_pylist()
        others = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "s"}
        sizes = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, side="right")))
            block = Texts(texts[a:b])
            block.hashed()
            yield block, {c: x[a:b] for c, x in others.items()}
            a = b


def _without(block: Texts, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[str]:
    return [block.texts[r][:a] + block.texts[r][a + n :] for r, a, n in zip(row.tolist(), at.tolist(), size.tolist(), strict=True)]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the sum of differences of letter counts of two signatures."""
    total = np.zeros(len(a), np.int64)
    for j in range(_BUCKETS):
        d = np.abs(((a >> (3 * j)) & 7) - ((b >> (3 * j)) & 7))
        total += np.minimum(d, 8 - d)
    return total


def _apart(a: str, b: str) -> Column:
    """The same as a column."""
    part = lambda c, j: F.shiftright(F.col(c), 3 * j).bitwiseAND(F.lit(7))
    gap = lambda j: F.abs(part(a, j) - part(b, j))
    return reduce(lambda x, y: x + y, [F.least(gap(j), F.lit(8) - gap(j)) for j in range(_BUCKETS)])


_KEYS = "key long, base long, tid long, sig long, at long, len long"


def _keyed(rows: DataFrame, keys, k: int) -> DataFrame:
    """(key, base, tid, sig, at, len) of rows (base, tid, sig, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in _blocks(batches):
            for row, key, at, size in keys(block, own["base"], k):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, own["base"][row], own["tid"][row], own["sig"][row], at, size)], names=[c.split()[0] for c in _KEYS.split(", ")])

    return rows.select("base", "tid", "sig", "s").mapInArrow(run, _KEYS)


def _signed(texts: DataFrame) -> DataFrame:
    """(base, tid, sig, s) of texts (tid, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = Texts(batch.column("s").to_pylist()).signatures()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(batch), np.int64)), batch.column("tid"), pa.array(sig), batch.column("s")], names=["base", "tid", "sig", "s"])

    return texts.select("tid", "s").mapInArrow(run, "base long, tid long, sig long, s string")


def _rests(keyed: DataFrame, rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(base, tid, sig, s): what remains of the texts under hot keys without the matched segment, the key as new base."""
    own = keyed.join(hot.select("key"), "key", "left_semi").join(rows.select("base", "tid", "s"), ["base", "tid"])
    rest = F.concat(F.substring("s", F.lit(1), F.col("at").cast("int")), F.substring(F.col("s"), (F.col("at") + F.col("len") + 1).cast("int"), F.length("s")))
    return own.select(F.col("key").alias("base"), "tid", "sig", rest.alias("s")).distinct()


def _held_in_tasks(postings: DataFrame, hot: DataFrame, probe: DataFrame, k: int) -> DataFrame:
    """(tid_i, tid_p, base, sig, s): candidate pairs, and the remainders of probes that meet hot keys (tid_i null).

    The postings of the other keys, at most POSTINGS, are held sorted by every task; no key is shuffled.
    """
    spark = probe.sparkSession
    table = postings.join(hot.select("key"), "key", "left_anti").select("key", "tid", "sig").toArrow()
    key, tid, sig = (table.column(c).to_numpy() for c in ("key", "tid", "sig"))
    order = np.argsort(key, kind="stable")
    hot_keys = np.sort(hot.select("key").toArrow().column("key").to_numpy())  # one of more than `hot` postings each
    shared = spark.sparkContext.broadcast((key[order], tid[order], sig[order], hot_keys))
    names = ["tid_i", "tid_p", "base", "sig", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tids, sigs, warm = shared.value
        for block, own in _blocks(batches):
            for row, key, at, size in probe_keys(block, own["base"], k):
                a, b = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
                hits = np.flatnonzero(b > a)
                for part in np.split(hits, np.flatnonzero(np.diff(np.cumsum((b - a)[hits]) // CHUNK)) + 1) if len(hits) else []:
                    n = (b - a)[part]
                    at_i = np.repeat(a[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    mine = np.repeat(row[part], n)
                    close = apart(sigs[at_i], own["sig"][mine]) <= 2 * k
                    pairs = np.unique(np.stack([tids[at_i[close]], own["tid"][mine[close]]]), axis=1)
                    if pairs.shape[1]:
                        none = pa.nulls(pairs.shape[1], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), none, none, pa.nulls(pairs.shape[1], pa.string())], names=names)
                if len(warm):
                    w = np.minimum(np.searchsorted(warm, key), len(warm) - 1)
                    met = np.flatnonzero(warm[w] == key)
                    if len(met):
                        r = row[met]
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(met), pa.int64()), pa.array(own["tid"][r]), pa.array(key[met]), pa.array(own["sig"][r]), pa.array(_without(block, r, at[met], size[met]))], names=names)

    return probe.select("base", "tid", "sig", "s").mapInArrow(run, "tid_i long, tid_p long, base long, sig long, s string")


def _shuffled(postings: DataFrame, hot: DataFrame, probe: DataFrame, k: int) -> DataFrame:
    """The same by joins on the key, for indexes of any size. A key has few postings, so AQE may split one that many probes share."""
    keyed = _keyed(probe, probe_keys, k)
    side = postings.join(hot.select("key"), "key", "left_anti").select("key", F.col("tid").alias("tid_i"), F.col("sig").alias("sig_i"))
    met = keyed.select("key", F.col("tid").alias("tid_p"), "sig").join(side, "key").where(_apart("sig", "sig_i") <= 2 * k)
    null = F.lit(None)
    pairs = met.select("tid_i", "tid_p", null.cast("long").alias("base"), null.cast("long").alias("sig"), null.cast("string").alias("s")).distinct()
    return pairs.union(_rests(keyed, probe, hot).select(null.cast("long"), "tid", "base", "sig", "s"))


def _last(postings: DataFrame, counts: DataFrame, probe: DataFrame, k: int, hot: int) -> DataFrame:
    """(tid_i, tid_p): the pairs under all keys, those of hot keys dealt out in shares of about `hot` postings."""
    shares = counts.where(F.col("n") > hot).select("key", F.ceil(F.col("n") / max(hot, 1)).cast("int").alias("_n"))
    deal = lambda rows, salt: rows.join(shares, "key", "left").withColumn("_s", salt).drop("_n")
    n = F.coalesce("_n", F.lit(1))
    left = deal(postings.select("key", F.col("tid").alias("tid_i"), F.col("sig").alias("sig_i")), F.pmod(F.xxhash64("tid_i"), n).cast("int"))
    right = deal(_keyed(probe, probe_keys, k).select("key", F.col("tid").alias("tid_p"), "sig"), F.explode(F.sequence(F.lit(0), n - 1)))
    return right.join(left, ["key", "_s"]).where(_apart("sig", "sig_i") <= 2 * k).select("tid_i", "tid_p").distinct()


def segment_join(indexed: DataFrame, probes: DataFrame, k: int = 3, hot: int = 48, levels: int = 3, held: int = POSTINGS) -> DataFrame:
    """(tid_i, tid_p): every pair of texts (tid, s) within k edits, and some others, which the caller verifies.

    Each indexed text is cut into k + 1 segments, of which one must occur unchanged in any text within k edits, at a
    position the edits allow. Pairs whose letter counts differ by more than k edits can explain are left out at once.
    Keys that more than `hot` indexed texts share do not emit their pairs: the matched
    segment is cut out and the remainders, which must also be within k edits, are joined the same way under the key, so
    a segment common to a third of all rows costs a more selective key and not all its pairs. At the last of `levels`
    rounds the pairs under the remaining hot keys are formed, dealt out in shares where they are shuffled; nothing is dropped.

    While the index has at most `held` postings every task holds them and probes are not shuffled; beyond that keys are joined.
    """
    index, probe = stage(_signed(indexed)), _signed(probes)
    found = []
    for level in range(levels):
        postings = stage(_keyed(index, index_keys, k))
        counts = postings.groupBy("key").agg(F.count("*").alias("n"))
        fits, last = postings.count() <= held, level + 1 == levels
        if last and not fits:
            found.append(stage(_last(postings, counts, probe, k, hot)))
            break
        warm = stage(counts.where(F.col("n") > (F.lit(2**62) if last else hot)).select("key"))
        met = stage((_held_in_tasks if fits else _shuffled)(postings, warm, probe, k))
        found.append(met.where("tid_i is not null").select("tid_i", "tid_p"))
        again = met.where("tid_i is null").select("base", F.col("tid_p").alias("tid"), "sig", "s")
        if last or again.isEmpty():
            break
        index, probe = stage(_rests(postings, index, warm)), again.distinct()
        drop_staged(postings)
    return reduce(DataFrame.union, found).distinct()


def _records(df: DataFrame, id_col: str, first: str, second: str, split: str, train: tuple[str, ...], held_out: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """(_id, tid, h, l, _split, held, _k_...): the records that take part, one row each."""
    side = F.lower(F.trim(F.col(split)))
    rec = df.select(F.col(id_col).alias("_id"), letters(F.col(first)).alias("h"), letters(F.col(second)).alias("l"), side.alias("_split"), *[F.col(c).alias(f"_k_{c}") for c in keep])
    rec = rec.where(F.col("_id").isNotNull() & (F.col("h") != "") & F.col("_split").isin(*train, *held_out))
    return stage(rec.withColumn("held", F.col("_split").isin(*held_out)).withColumn("tid", F.xxhash64("h", F.lit("|"), "l")))


def close_texts(records: DataFrame, k: int = 3, hot: int = 48, held: int = POSTINGS) -> DataFrame:
    """(tid_i, h_i, l_i, tid_p, h_p, l_p, distance): the held-out (i) and train (p) texts within k edits, each pair once.

    Verified by banded dynamic programming (threshold Levenshtein in the JVM) over both texts.
    """
    texts = stage(records.select("tid", "h", "l", "held").distinct())
    parts = {x: texts.where("held" if x else "not held").select("tid", "h", "l") for x in (True, False)}
    joined = [parts[x].select("tid", F.concat("h", "l").alias("s")) for x in (True, False)]
    pairs = stage(segment_join(joined[0], joined[1], k, hot, held=held))
    left = parts[True].select(F.col("tid").alias("tid_i"), F.col("h").alias("h_i"), F.col("l").alias("l_i"))
    right = parts[False].select(F.col("tid").alias("tid_p"), F.col("h").alias("h_p"), F.col("l").alias("l_p"))
    if pairs.count() <= POSTINGS // 8:  # 16 bytes a row
        pairs = F.broadcast(pairs)
    near = (F.abs(F.length("h_i") - F.length("h_p")) + F.abs(F.length("l_i") - F.length("l_p"))) <= k
    met = left.join(pairs, "tid_i").join(right, "tid_p").where(near)
    verified = met.withColumn("_d", F.levenshtein("h_i", "h_p", k)).where("_d >= 0").withColumn("_e", F.levenshtein("l_i", "l_p", k)).where(f"_e >= 0 and _d + _e <= {k}")
    return stage(verified.select("tid_i", "h_i", "l_i", "tid_p", "h_p", "l_p", (F.col("_d") + F.col("_e")).alias("distance")))


def cross_split_pairs(df: DataFrame, id_col: str, first: str, second: str, split: str, k: int = 3, train: tuple[str, ...] = ("train",), held_out: tuple[str, ...] = ("validation", "test"), keep: tuple[str, ...] = (), hot: int = 48, held: int = POSTINGS) -> DataFrame:
    """(id_train, id_held, distance, split, ...): pairs of a train and a held-out record within k edits over both texts.

    The distance is that of the first texts plus that of the second; only letters count, in any case. Null or blank
    second texts have no letters; records without letters in the first, without a split or an id are left out; the
    split ignores case and outer spaces. Equal texts are joined once and expanded to records at the end, a repeated
    row gives no second pair. Columns named in `keep` are returned for the held-out record. Empty tables give no rows.
    """
    rec = _records(df, id_col, first, second, split, train, held_out, keep)
    true = close_texts(rec, k, hot, held)
    mine = rec.where("held").select(F.col("_id").alias("id_held"), F.col("tid").alias("tid_i"), F.col("h").alias("h_i"), F.col("l").alias("l_i"), F.col("_split").alias("split"), *[F.col(f"_k_{c}").alias(c) for c in keep]).distinct()
    trained = rec.where("not held").select(F.col("_id").alias("id_train"), F.col("tid").alias("tid_p"), F.col("h").alias("h_p"), F.col("l").alias("l_p")).distinct()
    out = true.join(mine, ["tid_i", "h_i", "l_i"]).join(trained, ["tid_p", "h_p", "l_p"])
    return out.where("id_train <> id_held").select("id_train", "id_held", "distance", "split", *keep)


def cross_split_report(df: DataFrame, id_col: str, first: str, second: str, split: str, by: tuple[str, ...] = (), k: int = 3, train: tuple[str, ...] = ("train",), held_out: tuple[str, ...] = ("validation", "test"), hot: int = 48) -> DataFrame:
    """(split, by, records, pairs, exact_records): held-out records that overlap with train, by split and the columns `by`.

    pairs counts the pairs of cross_split_pairs without forming them: each held-out record with the number of train records
    of the texts near its own. An id with several texts counts once for each. exact_records have an equal text in train.
    Nulls in `by` are a group.
    """
    rec = _records(df, id_col, first, second, split, train, held_out, by)
    text = ["tid", "h", "l"]
    sizes = rec.where("not held").groupBy(*text).agg(F.count_distinct("_id").alias("_n")).withColumnsRenamed({c: f"{c}_p" for c in text})
    near = close_texts(rec, k, hot).join(sizes, [f"{c}_p" for c in text]).groupBy(*[f"{c}_i" for c in text]).agg(F.sum("_n").alias("_n"), F.min("distance").alias("_d"))
    mine = rec.where("held").select("_id", F.col("_split").alias("split"), *[F.col(f"_k_{c}").alias(c) for c in by], *[F.col(c).alias(f"{c}_i") for c in text]).distinct()
    met = mine.join(near, [f"{c}_i" for c in text])
    return met.groupBy("split", *by).agg(F.count_distinct("_id").alias("records"), F.sum("_n").alias("pairs"), F.count_distinct(F.when(F.col("_d") == 0, F.col("_id"))).alias("exact_records"))
