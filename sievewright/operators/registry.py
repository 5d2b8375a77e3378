"""Registries, overrides, ordered policies and checked reads of record, pair and prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.values import finite
from sievewright.session import lookup_join

# What the names of a label and of a file's header tell of the direction, in the order in which rules are
# tried: texts of which the label holds one (none: any label), texts of which the header holds one, the direction.
DIRECTION_RULES = [
    (("neg_log", "neg log", "-log", "fitness"), ("neg_log", "neg log", "-log", "log_aff"), 1),
    ((), ("bind/no bind", "binary"), 1),
    ((), ("kd", "ic50", "ec50", "affinity"), -1),
]
#: Most rules of a routing policy; a policy is read by people.
POLICY_RULES = 10_000


def checked(df: DataFrame, test: Column, message: str | Column) -> DataFrame:
    """df, in which a row that fails the test raises when it is read."""
    told = message if isinstance(message, Column) else F.lit(message)
    return df.where(F.when(F.coalesce(test, F.lit(False)), True).otherwise(F.raise_error(told).cast("boolean")))


def clean_path(path: Column) -> Column:
    return F.replace(F.trim(path), F.lit("\\"), F.lit("/"))


def keyed_problems(df: DataFrame, id_col: str) -> DataFrame:
    """One row: rows, blank_ids and repeated_ids of a table that ought to hold each id once."""
    blank = F.trim(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) == ""
    per = df.groupBy(F.when(~blank, F.col(id_col)).alias("_id")).agg(F.count("*").alias("_n"))
    return per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("_n"))), F.lit(0)).alias("blank_ids"), F.count_if(F.col("_id").isNotNull() & (F.col("_n") > 1)).alias("repeated_ids"))


def keyed(df: DataFrame, id_col: str) -> DataFrame:
    """df, if it holds rows and each with an id of its own; else it raises. One aggregation, checked at once."""
    if id_col not in df.columns:
        raise ValueError(f"no column {id_col}")
    rows, blank, repeated = keyed_problems(df, id_col).first()
    if not rows or blank or repeated:
        raise ValueError(f"{rows} rows, {blank} without {id_col}, {repeated} repeated")
    return df


def pair_table(df: DataFrame) -> DataFrame:
    """A pair table with its columns in order; one without rows or columns raises."""
    wanted = ["left_record_id", "right_record_id", "preference", "pair_weight", "comparison_group", "reason"]
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"pair table lacks {missing}")
    if df.isEmpty():
        raise ValueError("pair table is empty")
    return df.select("left_record_id", "right_record_id", F.col("preference").cast("int").alias("preference"), F.col("pair_weight").cast("double").alias("pair_weight"), "comparison_group", "reason")


def registry_table(df: DataFrame) -> DataFrame:
    """A registry with clean paths; a source_file that occurs twice raises when it is read."""
    rows = df.where("source_file is not null").withColumn("source_file", clean_path(F.col("source_file")))
    one = rows.groupBy("source_file").agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in rows.columns if c != "source_file"])).alias("_r"))
    return checked(one, F.col("_n") == 1, F.concat(F.lit("registry repeats "), "source_file")).select("source_file", "_r.*").select(*df.columns)


def override_table(df: DataFrame) -> DataFrame:
    """(source_file, direction) of the overrides whose direction is 1 or -1; a repeated file takes the smaller."""
    rows = df.where(F.col("direction").try_cast("int").isin(-1, 1)).select(clean_path(F.col("source_file")).alias("source_file"), F.col("direction").try_cast("int").alias("direction"))
    return rows.where("source_file is not null").groupBy("source_file").agg(F.min("direction").alias("direction"))


def named_direction(label: Column, header: Column) -> Column:
    """1 where larger labels are better, else -1, by the first of DIRECTION_RULES that holds; 1 if none does."""
    label, header = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(header, F.lit("")))
    says = lambda text, words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(not words))
    out = F.lit(1)
    for own, around, direction in reversed(DIRECTION_RULES):
        out = F.when(says(label, own) & says(header, around), direction).otherwise(out)
    return out


def file_directions(files: DataFrame, registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """(source_file, direction, told_by): an override first, then the registry, then what the names in the header say.

    files holds source_file, label and columns (array of names), one row a file.
    """
    known = registry.where(F.col("direction").isin(-1, 1)).select("source_file", F.col("direction").alias("_registered"))
    rows = lookup_join(files.select("source_file", "label", "columns"), known, ["source_file"], "left")
    rows = lookup_join(rows, overrides.select("source_file", F.col("direction").alias("_override")), ["source_file"], "left")
    named = named_direction(F.col("label"), F.array_join("columns", " | "))
    told = F.when(F.col("_override").isNotNull(), "override").when(F.col("_registered").isNotNull(), "registry").otherwise("header")
    return rows.select("source_file", F.coalesce("_override", "_registered", named).alias("direction"), told.alias("told_by"))


def policy_rules(df: DataFrame) -> list[tuple[str, str, str]]:
    """The rules (kind, value, route) of a policy table in the order of `ordinal`, for values.first_match."""
    rows = df.where("kind is not null and value is not null").orderBy("ordinal", "kind", "value").limit(POLICY_RULES + 1).collect()
    if len(rows) > POLICY_RULES:
        raise ValueError(f"more than {POLICY_RULES} rules")
    return [(r["kind"], r["value"], r["route"]) for r in rows]


# --- predicates ------------------------------------------------------------------------------------------------------


def in_split(split: Column, wanted: str, blank_passes: bool = False) -> Column:
    """Whether a split is the wanted one; rows without a split pass where that is asked for."""
    text = F.lower(F.trim(F.coalesce(split, F.lit(""))))
    return ((text == "") & F.lit(blank_passes)) | (text == wanted)


def in_tiers(tier: Column, tiers: tuple[str, ...]) -> Column:
    return F.coalesce(tier.isin(*tiers), F.lit(False))


def of_lengths(sequence: Column, low: int, high: int) -> Column:
    return F.length(F.coalesce(sequence, F.lit(""))).between(low, high)


def present(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) != ""


def paired(heavy: Column, light: Column) -> Column:
    """Not a single domain: both chains are there."""
    return present(heavy) & present(light)


def scan_records(df: DataFrame, split: str | None = None, tiers: tuple[str, ...] = (), split_column: str = "split") -> DataFrame:
    """df with its split under the name `split`, only the rows of a split and of some tiers if they are given."""
    rows = df if split_column == "split" else df.drop("split").withColumnRenamed(split_column, "split")
    if split is not None:
        rows = rows.where(in_split(F.col("split"), split))
    return rows.where(in_tiers(F.col("tier"), tiers)) if tiers else rows


# --- joins -----------------------------------------------------------------------------------------------------------


def strict_lookup(facts: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """facts with the columns of dim; a row of facts whose key dim lacks raises when it is read."""
    rows = lookup_join(facts, dim.withColumn("_met", F.lit(True)), on, "left")
    return checked(rows, F.col("_met"), F.concat(F.lit("unknown key "), F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in on]))).drop("_met")


def prediction_score(df: DataFrame, name: str = "score") -> DataFrame:
    """df with the score of a prediction table, from its column `score`, else `prediction`; one that is not finite raises."""
    source = "score" if "score" in df.columns else "prediction"
    value = finite(F.col(source).cast("double"))
    return checked(df.withColumn("_score", value), F.col("_score").isNotNull(), "score is not finite").drop(*({source, name} & set(df.columns))).withColumnRenamed("_score", name)


def file_key(path: Column) -> Column:
    """Letters and digits of a path's last part, in lower case."""
    return F.regexp_replace(F.lower(F.substring_index(clean_path(path), "/", -1)), "[^a-z0-9]", "")


def near_names(asked: DataFrame, known: DataFrame, least: float = 0.88) -> DataFrame:
    """(name, match, ratio): the known name nearest to each asked one, if their ratio is `least` or more.

    The ratio is 1 - edits / length of the longer name; equal names have 1. It allows a name of n letters so many edits k; the
    name is cut into k + 1 even parts, of which one must stand unchanged in any name that near, at a place the edits allow.
    Names meet on such parts only, never all with all, and none that is near enough is missed. Ties go to the smaller name. asked
    and known hold a column `name` each; nulls and blanks match nothing.
    """
    a, b = (d.where(present(F.col("name"))).select("name").distinct() for d in (asked, known))
    edits = lambda n: F.floor(F.lit(1.0 - least) * n / F.lit(least) + 1e-9).cast("int")

    def part(n: Column, k: Column, i: Column) -> tuple[Column, Column]:
        base, late = F.floor(n / (k + 1)).cast("int"), i - (k + 1 - n % (k + 1))
        return i * base + F.greatest(late, F.lit(0)), base + (late >= 0).cast("int")

    n, k, i, m = (F.col(c) for c in ("n", "k", "i", "m"))
    same = a.join(b.select("name"), "name", "left_semi").select("name", F.col("name").alias("match"), F.lit(1.0).alias("ratio"))
    mine = a.join(b.select("name"), "name", "left_anti").withColumn("n", F.length("name")).withColumn("k", edits(F.col("n"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    start, size = part(n, k, i)
    mine = mine.select("name", "n", "k", "i", F.substring("name", start + 1, size).alias("_s"))
    theirs = b.withColumnRenamed("name", "match").withColumn("m", F.length("match"))
    theirs = theirs.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.floor(m * least).cast("int")), F.ceil(m / least).cast("int")))).withColumn("k", edits(n)).where(F.abs(m - n) <= k)
    theirs = theirs.withColumn("i", F.explode(F.sequence(F.lit(0), k)))
    low = F.greatest(F.lit(0), start - i, start + (m - n) - (k - i))
    high = F.least(m - size, start + i, start + (m - n) + (k - i))
    theirs = theirs.withColumn("_low", low).withColumn("_high", high).where("_low <= _high").withColumn("_at", F.explode(F.sequence("_low", "_high")))
    theirs = theirs.select("match", "n", "i", F.substring("match", F.col("_at") + 1, size).alias("_s")).distinct()
    # few bytes meet in many pairs, so the parts are spread by number and not by size
    parts = max(8, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = lambda d: d.repartition(parts, "n", "i", "_s")
    met = spread(mine).join(spread(theirs), ["n", "i", "_s"]).withColumn("_d", F.expr("levenshtein(name, match, k)")).where("_d >= 0")
    scored = met.withColumn("ratio", F.lit(1.0) - F.col("_d") / F.greatest(F.length("name"), F.length("match"))).where(F.col("ratio") >= least)
    best = scored.groupBy("name").agg(F.min_by(F.struct("match", "ratio"), F.struct(-F.col("ratio"), "match")).alias("b"))
    return same.union(best.select("name", "b.match", "b.ratio"))


def reconciled(documents: DataFrame, registry: DataFrame, records: DataFrame, least: float = 0.88) -> DataFrame:
    """(name, source_file, match_type, told_direction, direction, rows, train_rows, validation_rows, test_rows, issues) of each documented file.

    documents: name and the direction it tells (null: none); registry: source_file and direction; records: source_file and
    split. A document's file is the registry's by its key, else by the nearest key. issues names a direction that differs.
    """
    reg = registry.select("source_file", F.col("direction").cast("int").alias("direction"), file_key(F.col("source_file")).alias("_key")).groupBy("_key").agg(F.min(F.struct("source_file", "direction")).alias("_r")).select("_key", "_r.*")
    docs = documents.select("name", F.col("direction").cast("int").alias("told_direction"), file_key(F.col("name")).alias("_doc"))
    near = near_names(docs.select(F.col("_doc").alias("name")), reg.select(F.col("_key").alias("name")), least)
    split = F.lower(F.trim("split"))
    counts = records.groupBy("source_file").agg(F.count("*").alias("rows"), *[F.count_if(split == s).alias(f"{s}_rows") for s in ("train", "validation", "test")])
    rows = docs.join(near.select(F.col("name").alias("_doc"), F.col("match").alias("_key"), "ratio"), "_doc", "left")
    rows = lookup_join(lookup_join(rows, reg, ["_key"], "left"), counts, ["source_file"], "left")
    kind = F.when(F.col("ratio").isNull(), "unmatched").when(F.col("ratio") == 1.0, "exact").otherwise("near")
    issues = F.when(F.col("told_direction") != F.col("direction"), "direction_conflict").otherwise("")
    return rows.select("name", "source_file", kind.alias("match_type"), "told_direction", "direction", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "train_rows", "validation_rows", "test_rows")], issues.alias("issues"))
