"""The queries of registries, checked reads, filters, splits and reports over the shared tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import sequences, values
from sievewright.operators import ensembles, metrics, quality, registry, splits, vectors, weights
from sievewright.plans import reference as ref
from sievewright.plans.reference import _KEY, _NORM, _OR, _TAIL, metrics_sql, query, r9, read
from sievewright.session import lookup_join

# --- registries, reads and filters -----------------------------------------------------------------------------------

_OVERRIDES_SQL = "SELECT source_file, CASE WHEN tier = 'Weak' THEN 1 ELSE 0 END AS direction FROM label_registry WHERE tier IN ('Weak', 'Auxiliary')"
_SAYS = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")" if words else "true"
_NAMED_SQL = "CASE " + " ".join(f"WHEN {_SAYS('lower(label)', own)} AND {_SAYS('lower(header)', around)} THEN {d}" for own, around, d in registry.DIRECTION_RULES) + " ELSE 1 END"


@query(f"""WITH f AS (SELECT source_file, selected_label_column AS label, 'heavy | light | ' || selected_label_column AS header FROM label_registry UNION ALL SELECT path, label_candidates[1], array_to_string(columns, ' | ') FROM (SELECT DISTINCT path, label_candidates, columns FROM inventory_row)),
    o AS (SELECT * FROM ({_OVERRIDES_SQL}) WHERE direction IN (-1, 1)), g AS (SELECT source_file, direction FROM label_registry WHERE direction IN (-1, 1) AND supervised_use = 'yes')
    SELECT f.source_file, coalesce(o.direction, g.direction, {_NAMED_SQL})::INTEGER AS direction, CASE WHEN o.direction IS NOT NULL THEN 'override' WHEN g.direction IS NOT NULL THEN 'registry' ELSE 'header' END AS told_by FROM (SELECT source_file, coalesce(label, '') AS label, coalesce(header, '') AS header FROM f) f LEFT JOIN g USING (source_file) LEFT JOIN o USING (source_file)""")
def direction_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The direction of every file: an override, else the registry, else the names in its header."""
    reg = registry.registry_table(read(spark, sf, "label_registry"))
    files = reg.select("source_file", F.col("selected_label_column").alias("label"), F.array(F.lit("heavy"), F.lit("light"), F.col("selected_label_column")).alias("columns"))
    delivered = read(spark, sf, "inventory_row").select(F.col("path").alias("source_file"), F.get("label_candidates", 0).alias("label"), "columns").distinct()
    overrides = registry.override_table(reg.where("tier in ('Weak', 'Auxiliary')").select("source_file", F.when(F.col("tier") == "Weak", 1).otherwise(0).alias("direction")))
    return registry.file_directions(files.union(delivered), reg.where("supervised_use = 'yes'"), overrides)


@query("SELECT m.record_id, r.tier FROM math_demo m JOIN label_registry r USING (source_file) WHERE lower(trim(m.split)) = 'validation' AND r.tier IN ('Gold', 'Silver')")
def scanned_records(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one split and two tiers of a table whose split column has a name of its own."""
    tiers = read(spark, sf, "label_registry").select("source_file", "tier")
    rows = lookup_join(read(spark, sf, "math_demo").select("record_id", "source_file", F.col("split").alias("family_split")), tiers, ["source_file"], "inner")
    return registry.scan_records(rows, "validation", ("Gold", "Silver"), "family_split").select("record_id", "tier")


@query("SELECT record_id FROM math_demo WHERE trim(coalesce(split, '')) = '' OR lower(trim(split)) = 'test'")
def blank_split_passes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "math_demo").where(registry.in_split(F.col("split"), "test", blank_passes=True)).select("record_id")


@query("SELECT m.record_id FROM math_demo m JOIN label_registry r USING (source_file) WHERE r.metric IN ('KD', 'IC50', 'EC50') AND length(coalesce(m.heavy, '')) BETWEEN 110 AND 118 AND trim(coalesce(m.antigen_seq, '')) <> '' AND trim(coalesce(m.heavy, '')) <> '' AND trim(coalesce(m.light, '')) <> ''")
def filtered_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of some routes whose chains have a length, with an antigen, single domains left out."""
    routes = read(spark, sf, "label_registry").where(F.col("metric").isin("KD", "IC50", "EC50")).select("source_file")
    rows = read(spark, sf, "math_demo").where(registry.of_lengths(F.col("heavy"), 110, 118) & registry.present(F.col("antigen_seq")) & registry.paired(F.col("heavy"), F.col("light")))
    return lookup_join(rows.select("record_id", "source_file"), routes, ["source_file"], "inner").select("record_id")


@query("SELECT (SELECT count(*) FROM score_row) AS rows, (SELECT count(*) FROM score_row WHERE trim(coalesce(record_id, '')) = '') AS blank_ids, (SELECT count(*) FROM (SELECT record_id FROM score_row WHERE trim(coalesce(record_id, '')) <> '' GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids")
def keyed_check(spark: SparkSession, sf: str) -> DataFrame:
    return registry.keyed_problems(read(spark, sf, "score_row"), "record_id")


@query("SELECT raw_id, heavy FROM raw_record WHERE raw_id IN (SELECT vec_id FROM embeddings)")
def with_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Records that have an embedding."""
    known = read(spark, sf, "embeddings").select(F.col("vec_id").alias("raw_id"))
    return read(spark, sf, "raw_record").select("raw_id", "heavy").join(known, "raw_id", "left_semi")


_POLICY = [(1, "source_contains", "panel", "route_by_metric"), (2, "source_contains", "_kd_", "kinetic"), (3, "metric", "KD", "affinity"), (4, "metric", "IC50", "potency"), (5, "source_contains", "_bli_", "kinetic")]


@query("""SELECT source_file, CASE WHEN contains(source_file, 'panel') THEN CASE metric WHEN 'KD' THEN 'affinity' WHEN 'IC50' THEN 'potency' ELSE 'none' END WHEN contains(source_file, '_kd_') THEN 'kinetic' WHEN contains(source_file, '_bli_') THEN 'kinetic'
    ELSE CASE metric WHEN 'KD' THEN 'affinity' WHEN 'IC50' THEN 'potency' ELSE 'none' END END AS route FROM label_registry""")
def policy_table_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Routes by an ordered policy that is itself a table."""
    rules = registry.policy_rules(spark.createDataFrame(_POLICY, "ordinal int, kind string, value string, route string"))
    return read(spark, sf, "label_registry").select("source_file", values.first_match(rules, F.col("source_file"), F.col("metric"), "none").alias("route"))


# --- names and ids ---------------------------------------------------------------------------------------------------

_G12 = lambda x: f"CASE WHEN {x} = 0 THEN '0' ELSE printf('%.12g', {x}) END"


@query(f"""SELECT raw_id, substr(sha256(array_to_string([coalesce(source_file, ''), coalesce(antigen_id, ''), coalesce(antigen_seq, ''), coalesce(heavy, ''), coalesce(light, ''), coalesce(cdrh3, ''), {_G12('raw_label')}], chr(31))), 1, 24) AS record_id, {_G12('raw_label')} AS label_text
    FROM raw_record WHERE raw_label IS NOT NULL AND NOT isnan(raw_label)""")
def record_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Stable ids of records over their seven fields, the label in twelve significant digits."""
    rows = read(spark, sf, "raw_record").where("raw_label is not null and not isnan(raw_label)")
    c = F.col
    return rows.select("raw_id", values.record_id(c("source_file"), c("antigen_id"), c("antigen_seq"), c("heavy"), c("light"), c("cdrh3"), c("raw_label")).alias("record_id"), values.text_of_number(c("raw_label")).alias("label_text"))


@query("""SELECT m.record_id, CASE WHEN m.source_file = f.first THEN array_to_string([m.source_file, 'provenance', CASE WHEN contains(upper(coalesce(r.metric, '')), 'IC50') THEN 'IC50' WHEN contains(upper(coalesce(r.metric, '')), 'KD') THEN 'KD' ELSE 'other' END, coalesce(m.antigen_id, '')], '::') ELSE m.source_file END AS comparison_group
    FROM math_demo m JOIN label_registry r USING (source_file), (SELECT min(source_file) AS first FROM label_registry) f""")
def nested_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison groups by source, one mixed source divided by what was measured and antigen."""
    reg = read(spark, sf, "label_registry").select("source_file", "metric")
    first = reg.agg(F.min("source_file")).first()[0] or ""
    rows = lookup_join(read(spark, sf, "math_demo").select("record_id", "source_file", "antigen_id"), reg, ["source_file"], "inner")
    return rows.select("record_id", values.nested_group(F.col("source_file"), first, F.col("metric"), F.col("antigen_id")).alias("comparison_group"))


_ASSAYS = [("_panel_", "panel"), ("_kd", "kinetics"), ("_bli_", "interferometry")]


@query("""SELECT source_file, coalesce(nullif(trim(censor_policy), ''), 'unknown') AS metric_key, CASE WHEN contains(source_file, '_panel_') THEN 'panel' WHEN contains(source_file, '_kd') THEN 'kinetics' WHEN contains(source_file, '_bli_') THEN 'interferometry' ELSE source_file END AS assay, string_split(source_group, '/')[-1] AS group_number,
    array_to_string(string_split(source_file, '/')[1:2], '/') AS dataset_group, trim(regexp_replace(lower(trim(selected_label_column)), '[^a-z0-9]+', '_', 'g'), '_') AS label_name, regexp_replace(lower(string_split(source_file, '/')[-1]), '[^a-z0-9]', '', 'g') AS file_key FROM label_registry""")
def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    """Metric key, assay, group number, dataset group, header name and file key of every source."""
    c = F.col
    return read(spark, sf, "label_registry").select("source_file", values.metric_key(c("censor_policy")).alias("metric_key"), values.assay_name(c("source_file"), _ASSAYS).alias("assay"), values.last_part(c("source_group")).alias("group_number"), values.source_group(c("source_file")).alias("dataset_group"), values.snake_name(c("selected_label_column")).alias("label_name"), registry.file_key(c("source_file")).alias("file_key"))


_IDENTITY_SQL = {"antibody": "CASE WHEN coalesce(heavy, '') <> '' THEN coalesce(heavy, '') || chr(31) || coalesce(light, '') END", "antigen": "nullif(coalesce(antigen_seq, ''), '')"}


@query(f"SELECT record_id, {_IDENTITY_SQL['antibody']} AS antibody, {_IDENTITY_SQL['antigen']} AS antigen, 'AB-' || substr(sha256(coalesce(heavy, '') || chr(31) || coalesce(light, '')), 1, 20) AS sequence_id FROM math_demo")
def identity_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = [F.col(x) for x in ("heavy", "light", "antigen_seq")]
    return read(spark, sf, "math_demo").select("record_id", values.identity_key("antibody", *c).alias("antibody"), values.identity_key("antigen", *c).alias("antigen"), values.stable_id(c[:2], 20, "AB-").alias("sequence_id"))


@query("SELECT DISTINCT s AS sequence FROM (SELECT heavy AS s FROM math_demo UNION ALL SELECT light FROM math_demo UNION ALL SELECT antigen_seq FROM math_demo) WHERE trim(coalesce(s, '')) <> ''")
def sequence_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """All sequences of all chains, each once."""
    return read(spark, sf, "math_demo").select(F.explode(F.array("heavy", "light", "antigen_seq")).alias("sequence")).where(registry.present(F.col("sequence"))).distinct()


@query("""SELECT source_file, chain, sequence FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY first_id, chain) AS k FROM (SELECT source_file, chain, sequence, min(raw_id) AS first_id FROM (SELECT source_file, raw_id, 'H' AS chain, heavy AS sequence FROM raw_record UNION ALL SELECT source_file, raw_id, 'L', light FROM raw_record) WHERE trim(coalesce(sequence, '')) <> '' GROUP BY ALL)) WHERE k <= 50""")
def first_chains(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty different chains of every file, a sample for numbering tools."""
    rows = read(spark, sf, "raw_record").select("source_file", "raw_id", F.explode(F.array(F.struct(F.lit("H").alias("chain"), F.col("heavy").alias("sequence")), F.struct(F.lit("L").alias("chain"), F.col("light").alias("sequence")))).alias("x")).select("source_file", "raw_id", "x.*")
    one = rows.where(registry.present(F.col("sequence"))).groupBy("source_file", "chain", "sequence").agg(F.min("raw_id").alias("first_id"))
    order = Window.partitionBy("source_file").orderBy("first_id", "chain")
    return one.withColumn("_k", F.row_number().over(order)).where("_k <= 50").select("source_file", "chain", "sequence")


# --- splits and leakage ----------------------------------------------------------------------------------------------


def _greedy_sql(sizes: str, shares: dict[str, float]) -> str:
    """The greedy balance over (key, size) as a recursive walk."""
    names = sorted(shares)
    least = lambda skip: " AND ".join(f"l_{skip} / t_{skip} {'<' if n < skip else '<='} l_{n} / t_{n}" for n in names if n != skip)
    pick = "CASE " + " ".join(f"WHEN {least(n)} THEN '{n}'" for n in names) + " END"
    return f"""WITH RECURSIVE s AS ({sizes}), o AS (SELECT *, row_number() OVER (ORDER BY size DESC, key) AS k FROM s), t AS (SELECT {', '.join(f'sum(size) * {shares[n]}::DOUBLE AS t_{n}' for n in names)} FROM s),
        w AS (SELECT k, key, size, 'train' AS split, {', '.join(f"{'size' if n == 'train' else '0'}::DOUBLE AS l_{n}" for n in names)} FROM o WHERE k = 1
              UNION ALL SELECT k, key, size, p AS split, {', '.join(f"l_{n} + CASE WHEN p = '{n}' THEN size ELSE 0 END AS l_{n}" for n in names)} FROM (SELECT o.k, o.key, o.size, {', '.join(f'w.l_{n}' for n in names)}, {pick} AS p FROM w JOIN o ON o.k = w.k + 1, t))
        SELECT key AS family, size, split FROM w"""


_FAMILY_V2 = _KEY([*ref._FAMILY, _TAIL("h"), _OR(_TAIL("l"))])
ref.SQL["family_split_greedy"] = _greedy_sql(f"SELECT {_FAMILY_V2} AS key, count(*) AS size FROM ({ref._HEAVY}) WHERE h <> '' GROUP BY 1", {"train": 0.7, "validation": 0.15, "test": 0.15})


_INNER_SQL = f"SELECT m.record_id, {_FAMILY_V2} AS family, lower(trim(m.split)) = 'train' AND r.metric IN ('KD', 'negative_log10_KD') AS inside FROM (SELECT *, {_NORM('heavy')} AS h, {_NORM('light')} AS l FROM math_demo) m LEFT JOIN label_registry r USING (source_file)"


@query(f"WITH x AS ({_INNER_SQL}), g AS ({_greedy_sql(f'SELECT family AS key, count(*) AS size FROM ({_INNER_SQL}) WHERE inside GROUP BY 1', {'train': 0.8, 'validation': 0.2})}) SELECT x.record_id, CASE WHEN coalesce(x.inside, false) THEN g.split ELSE 'excluded' END AS inner_split FROM x LEFT JOIN g USING (family)")
def inner_family_split(spark: SparkSession, sf: str) -> DataFrame:
    """An inner split by whole families inside the outer training rows of a route; all other rows are excluded."""
    route = read(spark, sf, "label_registry").select("source_file", F.col("metric").isin("KD", "negative_log10_KD").alias("_route"))
    n = sequences.normalize_sequence
    rows = lookup_join(read(spark, sf, "math_demo").select("record_id", "source_file", "split", n(F.col("heavy")).alias("h"), n(F.col("light")).alias("l")), route, ["source_file"], "left")
    inside = F.coalesce(registry.in_split(F.col("split"), "train") & F.col("_route"), F.lit(False))
    return splits.inner_split(rows.withColumn("family", sequences.family_key(F.col("h"), F.col("l"))), "family", inside, {"train": 0.8, "validation": 0.2}).select("record_id", "inner_split")


_PURGE_SQL = f"SELECT *, min(p) OVER (PARTITION BY k) AS best, count(*) OVER () AS _n FROM (SELECT record_id, source_file, lower(trim(split)) AS split, {ref._CHAIN_KEY} AS k, {ref._PRIO} AS p FROM math_demo) WHERE p IS NOT NULL"


@query(f"""WITH x AS ({_PURGE_SQL}), y AS (SELECT *, k IS NOT NULL AND p <> best AS gone FROM x)
    SELECT 'input' AS part, split AS name, count(*) AS rows FROM y GROUP BY split UNION ALL SELECT 'kept', split, count(*) FROM y WHERE NOT gone GROUP BY split UNION ALL SELECT 'removed', split, count(*) FROM y WHERE gone GROUP BY split
    UNION ALL SELECT 'keys', 'all', count(DISTINCT k) FROM y UNION ALL SELECT 'keys', 'cross_split', count(*) FROM (SELECT k FROM y WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT split) > 1)
    UNION ALL SELECT * FROM (SELECT 'removed_by_source', coalesce(source_file, ''), count(*) AS n FROM y WHERE gone GROUP BY 2 ORDER BY n DESC, 2 LIMIT 20)""")
def purge_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What a purge would take in, keep and remove by split, its keys, and the twenty sources that lose most."""
    key = F.nullif(F.upper(F.regexp_replace(F.coalesce("heavy", F.lit("")), "[^A-Za-z]", "")), F.lit(""))
    rows = read(spark, sf, "math_demo").select("record_id", "source_file", F.lower(F.trim("split")).alias("split"), key.alias("key"))
    return splits.purge_summary(rows.where(F.col("split").isin(*splits.PRIORITY)), F.col("key"), "split", "source_file")


_COMPONENTS_SQL = f"""WITH RECURSIVE m AS (SELECT DISTINCT replace(trim(source_group), chr(92), '/') AS g, {_NORM('heavy')} AS h, {_NORM('light')} AS l, {_NORM('antigen_seq')} AS a FROM math_demo WHERE trim(coalesce(source_group, '')) <> ''),
    n AS (SELECT kind, g, k FROM (SELECT 'exact' AS kind, g, CASE WHEN h <> '' THEN h || chr(31) || l END AS k FROM m UNION ALL SELECT 'family', g, CASE WHEN h <> '' THEN h || chr(31) || l END FROM m UNION ALL SELECT 'family', g, CASE WHEN h <> '' THEN 'f' || {_KEY(['substr(h, 1, 20)', '(length(h) // 5)::VARCHAR'])} END FROM m UNION ALL SELECT 'antigen', g, nullif(a, '') FROM m) WHERE k IS NOT NULL),
    e AS (SELECT DISTINCT x.kind, x.g AS u, y.g AS v FROM n x JOIN (SELECT kind, k, min(g) AS g FROM n GROUP BY 1, 2) y USING (kind, k)), b AS (SELECT kind, u, v FROM e UNION SELECT kind, v, u FROM e UNION SELECT kind, g, g FROM m, (SELECT unnest(['exact', 'family', 'antigen']) AS kind)),
    c(kind, node, root) USING KEY (kind, node) AS (SELECT DISTINCT kind, u, u FROM b UNION SELECT b.kind, b.v, min(c.root) FROM c JOIN b ON b.kind = c.kind AND b.u = c.node JOIN recurring.c AS r ON r.kind = b.kind AND r.node = b.v WHERE c.root < r.root GROUP BY b.kind, b.v)"""


@query(_COMPONENTS_SQL + " SELECT kind, node AS source_group, root AS component FROM c")
def group_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of source groups that share exact chains, a family or an antigen; exact matches also join families."""
    n = sequences.normalize_sequence
    group = registry.clean_path(F.col("source_group"))
    rows = read(spark, sf, "math_demo").where(registry.present(F.col("source_group"))).select(group.alias("g"), n(F.col("heavy")).alias("h"), n(F.col("light")).alias("l"), n(F.col("antigen_seq")).alias("a"))
    exact = F.when(F.col("h") != "", F.concat_ws("\u001f", "h", "l"))
    family = F.when(F.col("h") != "", F.concat(F.lit("f"), F.substring(F.sha2(F.concat_ws("\u001f", F.substring("h", 1, 20), F.floor(F.length("h") / 5).cast("string")), 256), 1, 24)))
    return splits.linked_groups(rows, "g", {"exact": [exact], "family": [exact, family], "antigen": [F.nullif(F.col("a"), F.lit(""))]}).select("kind", F.col("group").alias("source_group"), "component")


@query(_COMPONENTS_SQL + f""", p AS (SELECT node, root FROM c WHERE kind = 'exact'), q AS ({ref._hash_split_sql('SELECT DISTINCT root FROM p', 'root')}), z AS (SELECT count(DISTINCT root) AS n FROM p)
    SELECT p.node AS source_group, p.root AS component, CASE WHEN z.n < 3 THEN 'train' ELSE q.split END AS split FROM p JOIN q USING (root), z""")
def component_split(spark: SparkSession, sf: str) -> DataFrame:
    """Source groups split by their components."""
    n = sequences.normalize_sequence
    rows = read(spark, sf, "math_demo").where(registry.present(F.col("source_group"))).select(registry.clean_path(F.col("source_group")).alias("source_group"), F.when(n(F.col("heavy")) != "", F.concat_ws("\u001f", n(F.col("heavy")), n(F.col("light")))).alias("pair"))
    return splits.component_split(rows, "source_group", ["pair"])


@query(f"""WITH g AS ({ref._hash_split_sql("SELECT DISTINCT source_group FROM label_registry WHERE source_group IS NOT NULL", 'source_group')}) SELECT g.split, count(*) AS rows, count(DISTINCT r.source_file) AS files FROM raw_record r JOIN label_registry l USING (source_file) JOIN g ON g.source_group = l.source_group GROUP BY g.split""")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A split of source groups joined back to the records, counted."""
    reg = read(spark, sf, "label_registry").select("source_file", "source_group").where("source_group is not null")
    placed = lookup_join(reg, splits.group_hash_split(reg, "source_group"), ["source_group"], "inner")
    rows = lookup_join(read(spark, sf, "raw_record").select("source_file"), placed, ["source_file"], "inner")
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("source_file").alias("files"))


# --- joins -----------------------------------------------------------------------------------------------------------

@query(f"SELECT raw_id FROM raw_record WHERE {_NORM('heavy')} <> '' AND substr({_NORM('heavy')}, 1, 4) IN (SELECT substr({_NORM('heavy')}, 1, 4) FROM math_demo)")
def domain_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose heavy chain begins as one of another table does."""
    key = F.substring(sequences.normalize_sequence(F.col("heavy")), 1, 4).alias("k")
    ours = read(spark, sf, "raw_record").select("raw_id", key).where("k <> ''")
    return ours.join(read(spark, sf, "math_demo").select(key).distinct(), "k", "left_semi").select("raw_id")


@query("(SELECT antigen_id AS key, 'left_only' AS side FROM (SELECT antigen_id FROM raw_record WHERE antigen_id IS NOT NULL EXCEPT SELECT antigen_id FROM math_demo WHERE antigen_id IS NOT NULL)) UNION ALL (SELECT antigen_id, 'right_only' FROM (SELECT antigen_id FROM math_demo WHERE antigen_id IS NOT NULL EXCEPT SELECT antigen_id FROM raw_record WHERE antigen_id IS NOT NULL))")
def coverage_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Antigens that only one of two tables holds."""
    a, b = (read(spark, sf, t).where("antigen_id is not null") for t in ("raw_record", "math_demo"))
    return quality.coverage_gap(a, b, "antigen_id").withColumnRenamed("antigen_id", "key")


@query("""SELECT m.record_id, c.cluster FROM math_demo m JOIN (SELECT heavy, light, antigen_seq, min(record_id) AS cluster FROM math_demo GROUP BY ALL) c ON coalesce(m.heavy, '') = coalesce(c.heavy, '') AND coalesce(m.light, '') = coalesce(c.light, '') AND coalesce(m.antigen_seq, '') = coalesce(c.antigen_seq, '')
    WHERE c.cluster = (SELECT min(record_id) FROM math_demo x WHERE coalesce(x.heavy, '') = coalesce(m.heavy, '') AND coalesce(x.light, '') = coalesce(m.light, '') AND coalesce(x.antigen_seq, '') = coalesce(m.antigen_seq, ''))""")
def strict_cluster_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every record's cluster by its three sequences; a record without one raises."""
    key = F.concat_ws("\u001f", *[F.coalesce(c, F.lit("")) for c in ("heavy", "light", "antigen_seq")]).alias("k")
    rows = read(spark, sf, "math_demo").select("record_id", key)
    return registry.strict_lookup(rows, rows.groupBy("k").agg(F.min("record_id").alias("cluster")), ["k"]).select("record_id", "cluster")


_DOCS_SQL = "SELECT CASE WHEN publication_year % 2 = 1 THEN regexp_replace(replace(source_file, '_', '-'), '[aeiou]', '') ELSE upper(replace(source_file, '_', ' ')) END AS name, CASE WHEN better_means = 'smaller' THEN -1 WHEN tier = 'Weak' THEN -1 ELSE 1 END AS direction FROM label_registry WHERE publication_year IS NOT NULL"
_FKEY = lambda c: f"regexp_replace(lower(string_split(replace(trim({c}), chr(92), '/'), '/')[-1]), '[^a-z0-9]', '', 'g')"
_NEAREST_SQL = f"""WITH d AS ({_DOCS_SQL}), k AS (SELECT DISTINCT {_FKEY('name')} AS a FROM d), r AS (SELECT DISTINCT {_FKEY('source_file')} AS b FROM label_registry),
    n AS (SELECT a, b, 1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) AS ratio FROM k, r), best AS (SELECT a, b, ratio, row_number() OVER (PARTITION BY a ORDER BY ratio DESC, b) AS o FROM n WHERE ratio >= 0.88)"""


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """The registry's files as a document would name them: spelled differently, some with a letter lost."""
    dashed = F.regexp_replace(F.replace("source_file", F.lit("_"), F.lit("-")), "^([^aeiou]*)[aeiou]", "$1")
    name = F.when(F.col("publication_year") % 2 == 1, dashed).otherwise(F.upper(F.replace("source_file", F.lit("_"), F.lit(" "))))
    return read(spark, sf, "label_registry").where("publication_year is not null").select(name.alias("name"), F.when(F.col("better_means") == "smaller", -1).when(F.col("tier") == "Weak", -1).otherwise(1).alias("direction"))


@query(_NEAREST_SQL + " SELECT a AS name, b AS match, round(ratio, 9) AS ratio FROM best WHERE o = 1")
def fuzzy_name_match(spark: SparkSession, sf: str) -> DataFrame:
    """The registry file nearest to each documented name, if near enough."""
    asked = _documents(spark, sf).select(registry.file_key(F.col("name")).alias("name"))
    return registry.near_names(asked, read(spark, sf, "label_registry").select(registry.file_key(F.col("source_file")).alias("name"))).select("name", "match", r9("ratio", "ratio"))


@query(_NEAREST_SQL + f""", g AS (SELECT {_FKEY('source_file')} AS b, min({{'source_file': source_file, 'direction': direction}}) AS r FROM label_registry GROUP BY 1), c AS (SELECT source_file, count(*) AS rows, count(*) FILTER (lower(trim(split)) = 'train') AS train_rows, count(*) FILTER (lower(trim(split)) = 'validation') AS validation_rows, count(*) FILTER (lower(trim(split)) = 'test') AS test_rows FROM math_demo GROUP BY 1)
    SELECT d.name, g.r.source_file AS source_file, CASE WHEN x.ratio IS NULL THEN 'unmatched' WHEN x.ratio = 1 THEN 'exact' ELSE 'near' END AS match_type, d.direction::INTEGER AS told_direction, g.r.direction::INTEGER AS direction, coalesce(c.rows, 0) AS rows, coalesce(c.train_rows, 0) AS train_rows, coalesce(c.validation_rows, 0) AS validation_rows, coalesce(c.test_rows, 0) AS test_rows, CASE WHEN d.direction <> g.r.direction THEN 'direction_conflict' ELSE '' END AS issues
    FROM d LEFT JOIN (SELECT * FROM best WHERE o = 1) x ON x.a = {_FKEY('d.name')} LEFT JOIN g ON g.b = x.b LEFT JOIN c ON c.source_file = g.r.source_file""")
def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Documented files against the registry and the records, with conflicts."""
    return registry.reconciled(_documents(spark, sf), read(spark, sf, "label_registry"), read(spark, sf, "math_demo"))


# --- counters --------------------------------------------------------------------------------------------------------

_STATE = lambda c: f"CASE WHEN trim(coalesce({c}, '')) = '' THEN 'missing' WHEN {_NORM(c)} = '' THEN 'invalid' ELSE 'valid' END"
_RULES = [
    ("auxiliary", "coalesce(g.supervised_use, '') <> 'yes'"), ("missing_label", "v IS NULL"), ("out_of_range", "(g.censor_policy IN ('require_positive_finite', 'require_positive_and_below_max') AND v <= 0) OR v < try_cast(g.valid_min AS DOUBLE) OR v > try_cast(g.valid_max AS DOUBLE)"),
    ("quarantined_heavy", "heavy_state <> 'valid'"), ("ambiguous_light", "light_state = 'invalid'"),
]


@query(f"""WITH x AS (SELECT r.source_file, g.source_group, r.raw_id, {_NORM('heavy')} AS h, {_NORM('light')} AS l, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c in _RULES)} ELSE 'curated' END AS d FROM (SELECT *, CASE WHEN NOT isnan(raw_label) AND abs(raw_label) < 'infinity'::DOUBLE THEN raw_label END AS v, {_STATE('heavy')} AS heavy_state, {_STATE('light')} AS light_state FROM raw_record) r LEFT JOIN label_registry g USING (source_file)),
    k AS (SELECT raw_id, row_number() OVER (PARTITION BY h, l ORDER BY raw_id) AS o, first(source_group) OVER (PARTITION BY h, l ORDER BY raw_id) AS fg FROM x WHERE d IN ('curated', 'ambiguous_light'))
    SELECT x.source_file, {', '.join(f"count(*) FILTER (d = '{n}') AS {n}" for n, _ in _RULES)}, count(*) FILTER (d = 'curated') AS curated, count(*) FILTER (k.o > 1) AS repeated, count(*) FILTER (k.o > 1 AND k.fg <> x.source_group) AS cross_group FROM x LEFT JOIN k USING (raw_id) GROUP BY x.source_file""")
def curation_counters(spark: SparkSession, sf: str) -> DataFrame:
    """The disposition of every record by file, and how many repeat an antibody seen before, in their own or another group."""
    reg = read(spark, sf, "label_registry").select("source_file", "source_group", "supervised_use", "censor_policy", "valid_min", "valid_max")
    state, v = (lambda c: sequences.sequence_state(F.col(c))), values.finite(F.col("raw_label"))
    rows = lookup_join(read(spark, sf, "raw_record").select("raw_id", "source_file", v.alias("v"), state("heavy").alias("h"), state("light").alias("l")), reg, ["source_file"], "left", 200)
    positive = F.col("censor_policy").isin("require_positive_finite", "require_positive_and_below_max")
    rules = [
        ("auxiliary", F.coalesce("supervised_use", F.lit("")) != "yes"), ("missing_label", F.col("v").isNull()),
        ("out_of_range", (positive & (F.col("v") <= 0)) | (F.col("v") < F.col("valid_min").try_cast("double")) | (F.col("v") > F.col("valid_max").try_cast("double"))),
        ("quarantined_heavy", F.col("h.state") != "valid"), ("ambiguous_light", F.col("l.state") == "invalid"),
    ]
    return quality.curation_counters(rows, "source_file", rules, ["curated", "ambiguous_light"], F.concat_ws("\u001f", "h.sequence", "l.sequence"), "source_group", "raw_id")


@query(ref._PAIRS_SQL + " SELECT comparison_group, reason, count(*) AS pairs, round(min(pair_weight), 9) AS weight_min, round(avg(pair_weight) + 1e-12, 9) AS weight_mean, round(max(pair_weight), 9) AS weight_max FROM pairs GROUP BY 1, 2")
def pair_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Preference pairs and their weights by comparison group and reason."""
    made = ref.pairs.preference_pairs(ref._comparable(spark, sf), seed=ref._PAIR_SEED)
    out = ref.pairs.pair_summary(made, ["comparison_group", "reason"])
    mean = F.col("weight_mean") + F.lit(1e-12)  # both engines then round a tie the same way
    return out.select("comparison_group", "reason", "pairs", r9("weight_min", "weight_min"), r9(mean, "weight_mean"), r9("weight_max", "weight_max"))


@query("SELECT k AS \"check\", 0::BIGINT AS violations FROM (SELECT unnest(['unknown_id', 'bad_preference', 'bad_weight', 'cross_group', 'cross_split', 'wrong_direction', 'both_censored', 'duplicate_pair']) AS k)")
def pair_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Generated pairs break none of their rules."""
    rows = ref._comparable(spark, sf)
    return ref.pairs.validate_pairs(ref.pairs.preference_pairs(rows, seed=ref._PAIR_SEED), rows)


_DRAWS, _DRAW_SEED = 500, 9


@query(f"""WITH d AS (SELECT doc_id, source, pow(count(*) OVER (PARTITION BY source)::DOUBLE, -1.0::DOUBLE) AS w FROM documents WHERE source IS NOT NULL), c AS (SELECT *, sum(w) OVER (ORDER BY doc_id) AS upto, sum(w) OVER () AS total FROM d),
    k AS (SELECT CAST('0x' || substr(md5('{_DRAW_SEED}|' || i), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS u FROM (SELECT unnest(range({_DRAWS})) AS i)) SELECT c.doc_id, c.source, count(*) AS times FROM k JOIN c ON k.u * c.total >= c.upto - c.w AND k.u * c.total < c.upto GROUP BY 1, 2""")
def weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Five hundred draws with replacement in which every source has the same chance."""
    rows = weights.source_balance(read(spark, sf, "documents").where("source is not null").select("doc_id", "source"), "source", 1.0)
    return weights.weighted_draws(rows, "doc_id", F.col("weight"), _DRAWS, _DRAW_SEED).select("doc_id", "source", "times")


# --- evaluation ------------------------------------------------------------------------------------------------------

_PREDICTED_SQL = """SELECT DISTINCT record_id, source_file, antigen_id, coalesce(nullif(trim(source_group), ''), source_file) AS cluster, lower(trim(split)) AS split, coalesce(nullif(trim(light), ''), '') AS light, score AS truth, 0.6123457::DOUBLE * score + (length(coalesce(heavy, '')) % 7)::DOUBLE * 0.0371893::DOUBLE AS prediction FROM math_demo WHERE score IS NOT NULL AND record_id IS NOT NULL"""
_REGIMES_SQL = f"""p AS ({_PREDICTED_SQL}), q AS (SELECT p.*, CASE WHEN split IN ('validation', 'test') THEN CASE WHEN antigen_id NOT IN (SELECT antigen_id FROM p WHERE split = 'train' AND antigen_id IS NOT NULL) THEN 'antigen-cold' WHEN source_file NOT IN (SELECT source_file FROM p WHERE split = 'train' AND source_file IS NOT NULL) THEN 'source-held-out' ELSE 'in-distribution' END END AS regime FROM p)"""
_VIEWS = {"all": "''", "source": "coalesce(source_file, '')", "target": "coalesce(antigen_id, '')", "split": "split", "regime": "regime", "antibody": "CASE WHEN light = '' THEN 'VHH' ELSE 'Fv' END", "censoring": "CASE WHEN truth < 0.05 THEN 'censored' ELSE 'uncensored' END"}
_VIEWS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS view, {e} AS part, record_id, truth, prediction FROM q" for n, e in _VIEWS.items())


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = read(spark, sf, "math_demo").where("score is not null and record_id is not null")
    prediction = F.lit(0.6123457) * F.col("score") + (F.length(F.coalesce("heavy", F.lit(""))) % 7).cast("double") * F.lit(0.0371893)
    return rows.select("record_id", "source_file", "antigen_id", F.coalesce(text("source_group"), "source_file").alias("cluster"), F.lower(F.trim("split")).alias("split"), F.coalesce(text("light"), F.lit("")).alias("light"), F.col("score").alias("truth"), prediction.alias("prediction"), (F.col("score") < 0.05).alias("censored")).distinct()


def _regimes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.with_regimes(_predicted(spark, sf), "split", {"antigen-cold": "antigen_id", "source-held-out": "source_file"})


@query(f"WITH {_REGIMES_SQL} SELECT regime, count(*) AS n FROM q WHERE regime IS NOT NULL GROUP BY regime")
def evaluation_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows by what of them training has not seen."""
    return _regimes(spark, sf).where("regime is not null").groupBy("regime").agg(F.count("*").alias("n"))


@query(f"""WITH {_REGIMES_SQL}, v AS MATERIALIZED (SELECT * FROM ({_VIEWS_SQL}) WHERE part IS NOT NULL AND (part <> '' OR view IN ('all', 'source', 'target'))), m AS MATERIALIZED ({metrics_sql('SELECT * FROM v', 'truth', 'prediction', 'record_id', ['view', 'part'])})
    SELECT view, part, n, rmse, mae, pearson, spearman, top10_enrichment FROM m UNION ALL SELECT 'macro', view, count(spearman), NULL, NULL, NULL, round(avg(spearman), 5), NULL FROM m WHERE view IN ('source', 'target') GROUP BY view
    UNION ALL SELECT 'weighted', view, count(spearman), NULL, NULL, NULL, round(sum(spearman * n) / sum(CASE WHEN spearman IS NOT NULL THEN n END), 5), NULL FROM m WHERE view IN ('source', 'target') GROUP BY view
    UNION ALL SELECT 'composite', '', NULL, NULL, NULL, NULL, round(0.5::DOUBLE * (SELECT avg(spearman) FROM m WHERE view = 'source') + 0.25::DOUBLE * (SELECT max(spearman) FROM m WHERE view = 'regime' AND part = 'source-held-out') + 0.25::DOUBLE * (SELECT max(spearman) FROM m WHERE view = 'regime' AND part = 'antigen-cold'), 5), NULL""")
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """All figures of a prediction table in long form: overall, by view, macro and weighted means, and the composite."""
    c = F.col
    views = {"all": F.lit(""), "source": F.coalesce("source_file", F.lit("")), "target": F.coalesce("antigen_id", F.lit("")), "split": c("split"), "regime": c("regime"), "antibody": values.antibody_type(F.lit(None).cast("string"), c("light")), "censoring": values.censoring(c("censored"))}
    return metrics.evaluation_report(_regimes(spark, sf), "record_id", "truth", "prediction", views, ("source", "target"), ("source-held-out", "antigen-cold"))


_REPORT_ROUNDS = 500


@query(f"""WITH e AS MATERIALIZED (SELECT record_id, truth, prediction AS b, cluster FROM ({_PREDICTED_SQL}) WHERE cluster IS NOT NULL AND truth IS NOT NULL), {ref._DRAWS_SQL.format(rounds=_REPORT_ROUNDS)},
    x AS (SELECT t.round, CAST(t.times AS DOUBLE) AS times, e.* FROM e JOIN t USING (cluster)), y AS (SELECT *, {', '.join(f"CAST({ref._weighted_rank(c)} AS DOUBLE) AS {n}" for c, n in (('truth', 'rt'), ('b', 'r_b')))} FROM x), b AS (SELECT round, {ref._weighted_rho('b')} FROM y GROUP BY round)
    SELECT count(rho_b) AS rounds_valid, round(quantile_cont(rho_b, 0.025), 6) AS low, round(quantile_cont(rho_b, 0.5), 6) AS median, round(quantile_cont(rho_b, 0.975), 6) AS high FROM b""")
def report_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The interval of the report's correlation over resampled source groups."""
    values_ = metrics.bootstrap_correlations(_predicted(spark, sf), "truth", ["prediction"], "cluster", _REPORT_ROUNDS, ref._SEED)
    return metrics.bootstrap_interval(values_, "rho_prediction").select("rounds_valid", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")])


# --- ensembles -------------------------------------------------------------------------------------------------------

_EV = ref._EVENTS_SQL
_RK = lambda c: f"{ref._avg_rank(c, '')} / count(*) OVER ()"
_GRID = [round(0.025 * i, 3) for i in range(13)]
_GRID_SQL = f"(SELECT unnest([{', '.join(map(str, _GRID))}]::DOUBLE[]) AS weight) w"


@query(metrics_sql(f"SELECT e.event_id, e.truth, w.weight, (1.0::DOUBLE - w.weight) * g + w.weight * ((p - 0.6::DOUBLE * g) / 0.4::DOUBLE) AS blend FROM (SELECT event_id, truth, a AS g, 0.6::DOUBLE * a + 0.4::DOUBLE * b AS p FROM ({_EV})) e, {_GRID_SQL}", "truth", "blend", "event_id", ["weight"]))
def expert_blend_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep of an expert that is known only through its blend: its score is solved for first."""
    rows = ref._events(spark, sf).select("event_id", "truth", F.col("a").alias("g"), (F.lit(0.6) * F.col("a") + F.lit(0.4) * F.col("b")).alias("p"))
    rows = rows.withColumn("x", ensembles.recovered_expert(F.col("p"), F.col("g"), 0.4))
    return ref._rounded(ensembles.blend_sweep(rows, "event_id", "truth", "g", "x", _GRID), ["weight"])


@query(f"SELECT weight, user_id AS target, n, spearman FROM ({metrics_sql(f'SELECT e.*, w.weight, (1.0::DOUBLE - w.weight) * qa + w.weight * qb AS blend FROM (SELECT *, ' + ', '.join(f'''CASE WHEN count(*) OVER (PARTITION BY user_id) = 1 THEN 0.5 ELSE ({ref._avg_rank(c, 'PARTITION BY user_id')} - 1) / (count(*) OVER (PARTITION BY user_id) - 1) END AS q{c}''' for c in 'ab') + f' FROM ({_EV})) e, (SELECT unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS weight) w', 'truth', 'blend', 'event_id', ['weight', 'user_id'])})")
def target_weight_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Pointwise and pairwise percentiles within targets, blended by several weights and scored by target."""
    rows = ref._events(spark, sf)
    for c in "ab":
        rows = ref.ranks.with_percentile(rows, F.col(c), ["user_id"], f"q{c}")
    out = ref._rounded(ensembles.blend_sweep(rows, "event_id", "truth", "qa", "qb", [0.0, 0.5, 1.0], by=["user_id"]), ["weight", "user_id"])
    return out.select("weight", F.col("user_id").alias("target"), "n", "spearman")


_STAGE_SQL = f"""WITH e AS MATERIALIZED (SELECT *, {_RK('a')} AS ra, {_RK('b')} AS rb FROM ({_EV})), s1 AS MATERIALIZED ({metrics_sql(f'SELECT e.*, w.weight, (1.0::DOUBLE - w.weight) * ra + w.weight * rb AS blend FROM e, {_GRID_SQL}', 'truth', 'blend', 'event_id', ['weight'])}),
    w1 AS (SELECT weight FROM s1 ORDER BY spearman DESC, weight LIMIT 1), f AS MATERIALIZED (SELECT e.*, (1.0::DOUBLE - w1.weight) * ra + w1.weight * rb AS base FROM e, w1), p AS MATERIALIZED (SELECT *, {_RK('base')} AS rp, {_RK('truth + a')} AS rx FROM f WHERE user_id % 3 = 0),
    m AS (SELECT p.event_id, w.weight, row_number() OVER (PARTITION BY w.weight ORDER BY (1.0::DOUBLE - w.weight) * rp + w.weight * rx, event_id) AS k FROM p, {_GRID_SQL}), v AS (SELECT base, row_number() OVER (ORDER BY base, event_id) AS k FROM p),
    g AS (SELECT f.event_id, f.truth, w.weight, coalesce(v.base, f.base) AS blend FROM f CROSS JOIN {_GRID_SQL} LEFT JOIN m ON m.event_id = f.event_id AND m.weight = w.weight LEFT JOIN v ON v.k = m.k), s2 AS MATERIALIZED ({metrics_sql('SELECT * FROM g', 'truth', 'blend', 'event_id', ['weight'])})"""


@query(_STAGE_SQL + " SELECT 'parent' AS stage, weight, spearman FROM s1 UNION ALL SELECT 'expert', weight, spearman FROM s2")
def staged_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """A parent's weight is swept and kept, then an expert's on the rows it is routed to, which keep their set of scores."""
    rows = ref._events(spark, sf).withColumn("expert", F.when(F.col("user_id") % 3 == 0, F.col("truth") + F.col("a")))
    out = ensembles.staged_sweep(rows, "event_id", "truth", "a", "b", "expert", _GRID)
    return out.select("stage", "weight", F.round("spearman", 6).alias("spearman"))


@query(f"SELECT event_id, round(0.9::DOUBLE * (0.775::DOUBLE * ({ref._avg_rank('a', '')} / (count(*) OVER () + 1)) + 0.225::DOUBLE * ({ref._avg_rank('b', '')} / (count(*) OVER () + 1))) + 0.1::DOUBLE * ({ref._avg_rank('truth', '')} / (count(*) OVER () + 1)), 9) AS score FROM ({_EV})")
def nested_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights fixed beforehand, one blend inside another, applied once."""
    return ensembles.nested_blend(ref._events(spark, sf), (0.9, (0.775, "a"), (0.225, "b")), (0.1, "truth")).select("event_id", r9("score", "score"))


@query("SELECT p.record_id, p.prediction, m.antigen_seq FROM (SELECT record_id, max(value) AS prediction FROM score_row WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1) p JOIN raw_record m USING (record_id) WHERE trim(coalesce(m.light, '')) <> ''")
def predictions_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions joined to what is known of their records; others and single domains are left out of the export."""
    scores = read(spark, sf, "score_row").where("value is not null and not isnan(value)").groupBy("record_id").agg(F.max("value").alias("prediction"))
    known = read(spark, sf, "raw_record").where(registry.present(F.col("light"))).select("record_id", "antigen_seq")
    return registry.prediction_score(scores).join(known, "record_id").select("record_id", F.col("score").alias("prediction"), "antigen_seq")


@query(ref._OOD_SQL + """, q AS (SELECT *, CASE WHEN percentile <= 0.5 THEN 'near' WHEN percentile <= 0.9 THEN 'middle' ELSE 'far' END AS bin, vec_id % 5 = 0 AS held FROM p)
    SELECT label, count(*) FILTER (NOT held) AS train, count(*) FILTER (held) AS validation, round(median(distance) FILTER (NOT held), 6) AS train_median, round(median(distance) FILTER (held), 6) AS validation_median, round(avg(CASE WHEN held THEN (percentile >= 0.9)::INTEGER END), 6) AS far_share FROM q GROUP BY label""")
def cluster_report(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes, median distances and the share of far validation rows of every cluster."""
    return vectors.cluster_report(ref._ood(spark, sf).withColumn("held", F.col("vec_id") % 5 == 0), "label", "held")


_GATE_SQL = f"""{ref._OOD_SQL}, e AS (SELECT p.vec_id, p.percentile, label::DOUBLE AS truth, distance AS a, (vec_id % 13)::DOUBLE AS b FROM p), r AS (SELECT *, {_RK('a')} AS ra, {_RK('b')} AS rb FROM e),
    s AS (SELECT r.*, x.schedule, CASE x.schedule WHEN 'fixed' THEN 0.225::DOUBLE WHEN 'less_when_far' THEN CASE WHEN percentile >= 0.9 THEN 0.075::DOUBLE ELSE 0.225::DOUBLE END ELSE CASE WHEN percentile >= 0.9 THEN 0.3::DOUBLE ELSE 0.225::DOUBLE END END AS w FROM r, (SELECT unnest(['fixed', 'less_when_far', 'more_when_far']) AS schedule) x)"""


@query(_GATE_SQL + f" SELECT schedule, n, spearman FROM ({metrics_sql('SELECT vec_id, truth, schedule, (1.0::DOUBLE - w) * ra + w * rb AS blend FROM s', 'truth', 'blend', 'vec_id', ['schedule'])})")
def weight_schedules(spark: SparkSession, sf: str) -> DataFrame:
    """A second model's weight fixed, lowered or raised where rows are far from training."""
    rows = ref._ood(spark, sf).select("vec_id", "percentile", F.col("label").cast("double").alias("truth"), F.col("distance").alias("a"), (F.col("vec_id") % 13).cast("double").alias("b"))
    return ref._rounded(ensembles.scheduled_blends(rows, "vec_id", "truth", "a", "b", F.col("percentile"), {"fixed": 0.225, "less_when_far": 0.075, "more_when_far": 0.3}), ["schedule"]).select("schedule", "n", "spearman")


# --- further fields and exports --------------------------------------------------------------------------------------

_BEST_SQL = "SELECT record_id, max(value) AS value FROM score_row WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1"
_FINITE = lambda c: f"CASE WHEN NOT isnan({c}) AND abs({c}) < 'infinity'::DOUBLE THEN {c} END"


@query(f"SELECT r.raw_id, coalesce(s.value, {_FINITE('r.raw_label')} * CASE WHEN r.direction IN (-1, 1) THEN r.direction ELSE 1 END) AS label FROM raw_record r LEFT JOIN ({_BEST_SQL}) s USING (record_id)")
def oriented_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The first label that a record has: a score, else its raw label in its direction."""
    best = read(spark, sf, "score_row").where("value is not null and not isnan(value)").groupBy("record_id").agg(F.max("value").alias("value"))
    rows = read(spark, sf, "raw_record").select("raw_id", "record_id", "raw_label", "direction").join(best, "record_id", "left")
    return rows.select("raw_id", values.oriented_label([F.col("value")], F.col("raw_label"), F.col("direction")).alias("label"))


@query("SELECT source_file, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(try_cast(valid_max AS DOUBLE), 0.5::DOUBLE))) AS bounded, lower(trim(coalesce(supervised_use, ''))) IN ('1', 'true', 'yes', 'y', 'censored') AS used FROM label_registry")
def cleaned_fields(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "label_registry").select("source_file", values.bounded(F.col("valid_max"), 0.5).alias("bounded"), values.truthy(F.col("supervised_use")).alias("used"))


@query(f"SELECT family, count(*) AS size FROM (SELECT {_FAMILY_V2} AS family FROM ({ref._HEAVY}) WHERE h <> '') GROUP BY 1")
def family_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = ref._chains(spark, sf).where("h <> ''").select(sequences.family_key(F.col("h"), F.col("l")).alias("family"))
    return rows.groupBy("family").agg(F.count("*").alias("size"))


@query(f"""WITH x AS (SELECT r.source_file, {_FINITE('r.raw_label')} AS a, s.value AS b FROM raw_record r JOIN ({_BEST_SQL}) s USING (record_id)), y AS (SELECT *, rank() OVER (PARTITION BY source_file ORDER BY a) + (count(*) OVER (PARTITION BY source_file, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY source_file ORDER BY b) + (count(*) OVER (PARTITION BY source_file, b) - 1) / 2.0 AS rb FROM x WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT source_file, count(*) AS pairs, round(CASE WHEN count(*) >= 3 AND stddev_pop(ra) * stddev_pop(rb) > 0 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END, 6) AS spearman FROM y GROUP BY 1""")
def label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How alike two labels order the records of each file."""
    best = read(spark, sf, "score_row").where("value is not null and not isnan(value)").groupBy("record_id").agg(F.max("value").alias("b"))
    rows = read(spark, sf, "raw_record").select("source_file", "record_id", values.finite(F.col("raw_label")).alias("a")).join(best, "record_id")
    out = quality.label_agreement(rows, ["source_file"], "a", "b")
    return out.select("source_file", "pairs", F.round("spearman", 6).alias("spearman"))


@query("SELECT DISTINCT 'AB-' || substr(sha256(heavy || chr(31) || light), 1, 20) AS sequence_id, heavy, light FROM math_demo WHERE trim(coalesce(heavy, '')) <> '' AND trim(coalesce(light, '')) <> ''")
def sequence_export(spark: SparkSession, sf: str) -> DataFrame:
    """Every two-chain antibody once under its id, as it is handed on."""
    rows = read(spark, sf, "math_demo").where(registry.paired(F.col("heavy"), F.col("light")))
    return rows.select(values.stable_id([F.col("heavy"), F.col("light")], 20, "AB-").alias("sequence_id"), "heavy", "light").distinct()


@query("SELECT e.vec_id, round(e.embedding[1]::DOUBLE, 6) AS heavy_first, round(coalesce(o.embedding[1]::DOUBLE, 0.0::DOUBLE), 6) AS light_first FROM embeddings e LEFT JOIN embeddings o ON e.vec_id % 3 = 0 AND o.vec_id = e.vec_id + 1")
def embedding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Both chains' embeddings of a record; a missing light chain is the zero vector."""
    e = read(spark, sf, "embeddings").withColumn("sequence", F.col("vec_id").cast("string"))
    rows = e.select("vec_id", "sequence", F.when(F.col("vec_id") % 3 == 0, (F.col("vec_id") + 1).cast("string")).otherwise("").alias("other"))
    both = vectors.chain_embeddings(rows, e.select("sequence", "embedding"), "sequence", "other", 64)
    return both.select("vec_id", F.round(F.col("heavy_vector")[0], 6).alias("heavy_first"), F.round(F.col("light_vector")[0], 6).alias("light_first"))


@query(f"SELECT event_id, round(truth, 9) AS truth, round(p, 9) AS prediction FROM (SELECT event_id, truth, a AS p FROM ({_EV}))")
def strict_align_join(spark: SparkSession, sf: str) -> DataFrame:
    """Truth and prediction joined one to one; any id without its partner would raise."""
    rows = ref._events(spark, sf)
    joined = ensembles.strictly_joined(rows.select("event_id", "truth"), rows.select("event_id", F.col("a").alias("prediction")), "event_id")
    return joined.select("event_id", r9("truth", "truth"), r9("prediction", "prediction"))


_PARENTS_SQL = f"WITH h AS (SELECT raw_id, antigen_id, {_NORM('heavy')} AS h FROM raw_record WHERE antigen_id IS NOT NULL), p AS (SELECT antigen_id, length(h) AS n, min(h) AS parent FROM h WHERE h <> '' GROUP BY 1, 2), x AS (SELECT h.raw_id, h.h AS candidate, p.parent FROM h JOIN p ON p.antigen_id = h.antigen_id AND p.n = length(h.h) WHERE h.h <> '')"
_AT = lambda s, i: f"substr({s}, {i}, 1)"
_CODE_SQL = lambda c: f"strpos('{sequences.RESIDUES}', {c})"


def _with_parents(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "raw_record").where("antigen_id is not null").select("raw_id", "antigen_id", sequences.normalize_sequence(F.col("heavy")).alias("candidate")).where("candidate <> ''").withColumn("n", F.length("candidate"))
    return lookup_join(rows, rows.groupBy("antigen_id", "n").agg(F.min("candidate").alias("parent")), ["antigen_id", "n"], "inner", 200)


@query(f"""{_PARENTS_SQL} SELECT raw_id, array_to_string(list_filter(list_transform(range(1, length(parent) + 1), lambda i: CASE WHEN {_AT('parent', 'i')} <> {_AT('candidate', 'i')} THEN {_AT('parent', 'i')} || i || {_AT('candidate', 'i')} END), lambda s: s IS NOT NULL), ';') AS mutations,
    len(list_filter(range(1, length(parent) + 1), lambda i: {_AT('parent', 'i')} <> {_AT('candidate', 'i')}))::INTEGER AS mutation_count FROM x""")
def parent_mutations(spark: SparkSession, sf: str) -> DataFrame:
    """How every heavy chain differs from the first of its antigen and length."""
    return _with_parents(spark, sf).select("raw_id", *sequences.mutation_notation(F.col("parent"), F.col("candidate")))


@query(f"""{_PARENTS_SQL} SELECT raw_id, array_to_string(list_transform(range(1, 131), lambda i: {_CODE_SQL(_AT('candidate', 'i'))} * (i <= length(candidate))::INTEGER), ' ') AS tokens,
    array_to_string(list_transform(range(1, 131), lambda i: CASE WHEN i > length(parent) OR {_AT('parent', 'i')} = {_AT('candidate', 'i')} THEN 0 ELSE 1 + 21 * {_CODE_SQL(_AT('parent', 'i'))} + {_CODE_SQL(_AT('candidate', 'i'))} END), ' ') AS deltas FROM x""")
def parent_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Residue tokens of every heavy chain and its deltas from its parent's."""
    own, parent = (sequences.sequence_tokens(F.col(c), 130) for c in ("candidate", "parent"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return _with_parents(spark, sf).select("raw_id", text(own).alias("tokens"), text(sequences.delta_tokens(parent, own)).alias("deltas"))


@query(f"""WITH e AS MATERIALIZED (SELECT p.truth, p.prediction AS b, 0.5::DOUBLE * p.prediction + 0.2::DOUBLE * (length(p.record_id) % 3) AS a, m.cluster FROM ({_PREDICTED_SQL}) p JOIN (SELECT DISTINCT record_id, coalesce(heavy, '') || chr(31) || coalesce(light, '') AS cluster FROM math_demo) m USING (record_id)), {ref._DRAWS_SQL.format(rounds=100)},
    x AS (SELECT t.round, CAST(t.times AS DOUBLE) AS times, e.* FROM e JOIN t USING (cluster)), y AS (SELECT *, {', '.join(f"CAST({ref._weighted_rank(c)} AS DOUBLE) AS {n}" for c, n in (('truth', 'rt'), ('a', 'r_a'), ('b', 'r_b')))} FROM x), r AS (SELECT round, {ref._weighted_rho('a')}, {ref._weighted_rho('b')} FROM y GROUP BY round)
    SELECT round(avg(rho_b - rho_a), 6) AS mean_delta, avg(CASE WHEN rho_b > rho_a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p_better FROM r""")
def paired_bootstrap_by_antibody(spark: SparkSession, sf: str) -> DataFrame:
    """Two predictions compared over a hundred resamples of whole antibodies."""
    pair = read(spark, sf, "math_demo").select("record_id", sequences.pair_key(F.col("heavy"), F.col("light")).alias("pair")).distinct()
    rows = _predicted(spark, sf).drop("cluster").join(pair, "record_id").select("truth", F.col("prediction").alias("b"), (F.lit(0.5) * F.col("prediction") + F.lit(0.2) * (F.length("record_id") % 3)).alias("a"), "pair")
    out = metrics.paired_delta(metrics.bootstrap_correlations(rows, "truth", ["a", "b"], "pair", 100, ref._SEED), "rho_a", "rho_b")
    return out.select(F.round("mean_delta", 6).alias("mean_delta"), "p_better")
