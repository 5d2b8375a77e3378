"""Column builders over amino-acid sequences. Missing sequences are the empty string, as null is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet and its classes.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
HYDROPHOBIC, POSITIVE, NEGATIVE = "AVILMFWY", "KRH", "DE"
UNIT_SEPARATOR = "\u001f"
# Motifs of liabilities, what each adds to the penalty, and what is free of it.
MOTIFS = {"glycosylation": "N[^P][ST]", "deamidation": "N[GSHT]", "isomerization": "D[GST]"}
PENALTY = {"glycosylation": 0.08, "cysteine": 0.04, "hydrophobic": 0.3, "deamidation": 0.01, "isomerization": 0.01}
FREE_CYSTEINES, FREE_HYDROPHOBIC = 4, 0.45


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where a lambda uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def normalize_sequence(text: Column) -> Column:
    """Letters only, upper case; '' unless all of them are residues."""
    letters = F.upper(F.regexp_replace(filled(text), "[^A-Za-z]", ""))
    return F.when(letters.rlike(f"^[{RESIDUES}]+$"), letters).otherwise(F.lit(""))


def sequence_state(text: Column) -> Column:
    """struct(sequence, state): state is missing, valid or invalid."""
    seq = normalize_sequence(text)
    state = F.when(F.trim(filled(text)) == "", "missing").when(seq == "", "invalid").otherwise("valid")
    return F.struct(seq.alias("sequence"), state.alias("state"))


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of seq are among letters."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def numeric_features(seq: Column) -> list[Column]:
    """Length in thousands, hydrophobic share, net charge share, cysteine share and proline share."""
    seq = filled(seq)
    n = F.greatest(F.length(seq), F.lit(1))
    return [
        (F.length(seq) / 1000.0).alias("length_k"),
        (count_of(seq, HYDROPHOBIC) / n).alias("hydrophobic"),
        ((count_of(seq, POSITIVE) - count_of(seq, NEGATIVE)) / n).alias("net_charge"),
        (count_of(seq, "C") / n).alias("cysteine"),
        (count_of(seq, "P") / n).alias("proline"),
    ]


def liabilities(seq: Column) -> list[Column]:
    """Motif counts that do not overlap, residue counts and the penalty they add up to."""
    seq = filled(seq)
    n = F.greatest(F.length(seq), F.lit(1))
    glyco, deamid, isomer = (F.regexp_count(seq, F.lit(rx)) for rx in MOTIFS.values())
    hydro, cysteine = count_of(seq, HYDROPHOBIC) / n, count_of(seq, "C")
    over = {"glycosylation": glyco, "cysteine": F.greatest(cysteine - FREE_CYSTEINES, F.lit(0)), "hydrophobic": F.greatest(hydro - F.lit(FREE_HYDROPHOBIC), F.lit(0.0)), "deamidation": deamid, "isomerization": isomer}
    penalty = reduce(lambda a, b: a + b, [F.lit(PENALTY[k]) * x for k, x in over.items()])
    return [
        glyco.alias("glycosylation_motifs"), hydro.alias("hydrophobic_fraction"), ((count_of(seq, POSITIVE) - count_of(seq, NEGATIVE)) / n).alias("charge_density"), cysteine.alias("cysteine_count"),
        deamid.alias("deamidation_motifs"), isomer.alias("isomerization_motifs"), count_of(seq, "MW").alias("oxidation_residues"), penalty.alias("liability_penalty"),
    ]


def kmers(seq: Column, k: int = 3) -> Column:
    """Distinct k-mers in order of first occurrence; none for shorter sequences."""
    seq = filled(seq)
    return F.when(F.length(seq) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(seq, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def sampled_kmers(seq: Column, k: int = 3, limit: int = 16) -> Column:
    """All distinct k-mers if at most `limit`, else `limit` of them at evenly spaced, truncated positions."""
    pick = lambda found: F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.element_at(found, (i * (F.size(found) - 1) / F.lit(limit - 1)).cast("int") + 1))
    return let(kmers(seq, k), lambda found: F.when(F.size(found) <= limit, found).otherwise(pick(found)))


def interaction_tokens(heavy: Column, light: Column, cdr: Column, antigen: Column, limit: int = 16) -> Column:
    """X_a_b for sampled k-mers a of the antibody's binding region and b of the antigen; none without an antigen."""
    region = F.concat(F.coalesce(F.nullif(filled(cdr), F.lit("")), F.right(filled(heavy), F.lit(36))), F.right(filled(light), F.lit(24)))
    ours, theirs = sampled_kmers(region, limit=limit), sampled_kmers(antigen, limit=limit)
    tokens = let(F.struct(ours.alias("ours"), theirs.alias("theirs")), lambda s: F.flatten(F.transform(s["ours"], lambda a: F.transform(s["theirs"], lambda b: F.concat(F.lit("X_"), a, F.lit("_"), b)))))
    return F.when(filled(antigen) == "", F.array().cast("array<string>")).otherwise(tokens)


def _tail(seq: Column) -> Column:
    """Every sixth character of the last 36."""
    tail = F.right(seq, F.lit(36))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(36), F.lit(6)), lambda i: F.substring(tail, i, F.lit(1))), "")


def _digest(parts: list[Column], size: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws(UNIT_SEPARATOR, *parts), 256), 1, size)


def _or_single(light: Column, value: Column) -> Column:
    return F.when(light != "", value).otherwise(F.lit("VHH"))


def family_key(heavy: Column, light: Column, cdr: Column | None = None) -> Column:
    """Coarse family bucket by length classes and framework anchors; with `cdr` its length takes part (first version)."""
    h, l = filled(heavy), filled(light)
    parts = [F.substring(h, 1, 20), F.floor(F.length(h) / 5).cast("string"), _or_single(l, F.substring(l, 1, 20)), F.floor(F.length(l) / 5).cast("string")]
    if cdr is not None:
        c = filled(cdr)
        parts.append(F.when(c != "", F.length(c).cast("string")).otherwise(F.lit("unknown_cdrh3")))
    return _digest([*parts, _tail(h), _or_single(l, _tail(l))])


def antibody_family_key(heavy: Column, light: Column, cdr: Column) -> Column:
    """Family bucket by length classes, end anchors and the binding loop, or where it is missing the stretch before the end."""
    h, l, c = filled(heavy), filled(light), filled(cdr)
    loop = F.when(c != "", c).otherwise(F.substring(F.right(h, F.lit(28)), F.lit(1), F.greatest(F.least(F.length(h), F.lit(28)) - 8, F.lit(0))))
    return _digest([F.floor(F.length(h) / 5).cast("string"), F.floor(F.length(l) / 5).cast("string"), F.concat(F.substring(h, 1, 24), F.right(h, F.lit(18))), _or_single(l, F.concat(F.substring(l, 1, 24), F.right(l, F.lit(18)))), loop])


def sequence_text(heavy: Column, light: Column, antigen: Column) -> Column:
    return F.concat(F.lit("H:"), filled(heavy), F.lit(" L:"), filled(light), F.lit(" A:"), filled(antigen))


def pair_key(heavy: Column, light: Column) -> Column:
    return F.concat_ws(UNIT_SEPARATOR, filled(heavy), filled(light))


def sequence_tokens(seq: Column, size: int) -> Column:
    """Residues as 1 to 20, anything else as 21, padded with 0 or cut to `size`."""
    padded = F.rpad(filled(seq), size, " ")
    return F.transform(F.split(padded, ""), lambda c: F.when(c == " ", 0).when(F.instr(F.lit(RESIDUES), c) > 0, F.instr(F.lit(RESIDUES), c)).otherwise(21))


def delta_tokens(origin: Column, current: Column) -> Column:
    """0 where two token arrays agree, else one code for each ordered pair of different tokens."""
    return F.zip_with(origin, current, lambda a, b: F.when(a == b, 0).otherwise(1 + 21 * a + b))


def mutation_notation(parent: Column, candidate: Column) -> list[Column]:
    """'A3G;...' and the number of changes; sequences of unequal length raise."""
    same = F.length(parent) == F.length(candidate)
    at = F.sequence(F.lit(1), F.greatest(F.length(parent), F.lit(1)))
    steps = F.filter(F.transform(at, lambda i: F.when(F.substring(parent, i, F.lit(1)) != F.substring(candidate, i, F.lit(1)), F.concat(F.substring(parent, i, F.lit(1)), i.cast("string"), F.substring(candidate, i, F.lit(1))))), lambda x: x.isNotNull())
    checked = F.when(same, steps).otherwise(F.raise_error(F.lit("parent and candidate must have equal length")).cast("array<string>"))
    return [F.array_join(checked, ";").alias("mutations"), F.size(checked).alias("mutation_count")]
