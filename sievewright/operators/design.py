"""Candidate design: variants of a binding loop put back into their chain and ranked by a fitted model and the chain's liabilities."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.sequences import FREE_CYSTEINES, FREE_HYDROPHOBIC, HYDROPHOBIC, PENALTY, RESIDUES, mutation_notation
from sievewright.operators import models

_CODES = np.frombuffer(RESIDUES.encode(), np.uint8)
_CODE = np.full(256, 20, np.int8)
_CODE[_CODES] = np.arange(20)
_A = {x: i for i, x in enumerate(RESIDUES)}
_IS = lambda letters: np.isin(np.arange(21), [_A[x] for x in letters])
_ST, _GSHT, _GST, _WATER = _IS("ST"), _IS("GSHT"), _IS("GST"), _IS(HYDROPHOBIC)


def loop_variants(loop: np.ndarray, seed: list[int], count: int, max_mutations: int, protect: str = "C") -> np.ndarray:
    """Residue codes of all single mutants outside protected residues, then drawn mutants of 2 to max_mutations changes.

    Of `count` variants a share of 1 / max_mutations goes to single mutants, of which all are made whatever their number;
    the draws are that share's remainder and may repeat.
    """
    free = np.flatnonzero(loop != _A[protect])
    if not len(free):
        return np.empty((0, len(loop)), np.int8)
    one = np.repeat(loop[None], 19 * len(free), 0)
    at = np.repeat(free, 19)
    one[np.arange(len(one)), at] = (loop[at] + np.tile(np.arange(1, 20), len(free))) % 20
    most = min(max_mutations, len(free))
    if most < 2:
        return one
    rng = np.random.default_rng(seed)
    n = count - count // max_mutations
    many = np.repeat(loop[None], n, 0)
    places = free[np.argsort(rng.random((n, len(free))), 1)[:, :most]]
    changes = rng.integers(1, 20, (n, most))
    wanted = rng.integers(2, most + 1, n)
    for j in range(most):
        rows = np.flatnonzero(wanted > j)
        many[rows, places[rows, j]] = (loop[places[rows, j]] + changes[rows, j]) % 20
    return np.concatenate([one, many])


def _motifs(text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row: glycosylation motifs that do not overlap, deamidation and isomerization motifs, cysteines, hydrophobic residues."""
    n, d = text[:, :-1] == _A["N"], text[:, :-1] == _A["D"]
    sugar = n[:, :-1] & (text[:, 1:-1] != _A["P"]) & _ST[text[:, 2:]]
    glyco = sugar.sum(1) - (sugar[:, :-1] & sugar[:, 1:]).sum(1)  # three in a row cannot be: the third place is S or T
    return glyco, (n & _GSHT[text[:, 1:]]).sum(1), (d & _GST[text[:, 1:]]).sum(1), (text == _A["C"]).sum(1), _WATER[text].sum(1)


def chain_penalties(chains: np.ndarray, start: int, loops: np.ndarray) -> np.ndarray:
    """The penalty of sequences.liabilities for both chains with each loop at `start`, motifs across its borders included."""
    low, high = max(start - 3, 0), start + loops.shape[1] + 3
    part = chains[low:high]
    made = np.repeat(part[None], len(loops), 0)
    made[:, start - low : start - low + loops.shape[1]] = loops
    glyco, deamid, isomer, cysteine, water = (whole + new - old for whole, new, old in zip(_motifs(chains[None]), _motifs(made), _motifs(part[None])))
    over = {"glycosylation": glyco, "cysteine": np.maximum(cysteine - FREE_CYSTEINES, 0), "hydrophobic": np.maximum(water / len(chains) - FREE_HYDROPHOBIC, 0.0), "deamidation": deamid, "isomerization": isomer}
    return sum(PENALTY[k] * x for k, x in over.items())


def ranked_candidates(targets: DataFrame, model, size: int, count: int = 1000, max_mutations: int = 3, best: int = 10, seed: int = 20260722) -> DataFrame:
    """targets with the `best` variants of each loop: candidate, mutations, predicted_score, liability_penalty, score and place.

    targets: heavy, light, antigen_seq and cdrh3, normalised; those whose heavy chain does not hold the loop are left out. model
    is linear in the counts of models.positional_features of `size` buckets, so a variant is scored exactly by its changed
    places. The score is models.candidate_score of the clipped prediction and the penalty of heavy and light chain.
    """
    rows = targets.where((F.col("cdrh3") != "") & F.contains("heavy", "cdrh3"))
    longest = rows.agg(F.max(F.length("heavy"))).first()[0] or 0
    hasher, coefficients = HashingTF(numFeatures=size), model.coefficients.toArray()
    weight = np.array([[coefficients[hasher.indexOf(f"H{i}{x}")] for x in RESIDUES] for i in range(longest)]).reshape(longest, 20)
    base = model.transform(models.positional_features(rows, "heavy", "light", size, binary=False)).select("heavy", "light", "antigen_seq", "cdrh3", F.col("prediction").alias("_base"))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for heavy, light, antigen, cdr, prediction in b.itertuples(index=False):
                chains = _CODE[np.frombuffer((heavy + light).encode(), np.uint8)]
                start, n = heavy.index(cdr), len(cdr)
                loop = chains[start : start + n]
                made = loop_variants(loop, [seed, crc32("\x1f".join((heavy, light, antigen, cdr)).encode())], count, max_mutations)
                if not len(made):
                    continue
                w = weight[start : start + n]
                parent = w[np.arange(n), loop].sum()
                predicted = np.clip(prediction + w[np.arange(n), made].sum(1) - parent, 0.0, 1.0)
                penalty = chain_penalties(chains, start, made)
                score = np.round(predicted - penalty - 0.01 * (made != loop).sum(1), 9)
                need = min(len(score), best * 4)
                top = np.flatnonzero(score >= np.partition(score, len(score) - need)[len(score) - need])
                found = {_CODES[made[i]].tobytes().decode(): i for i in top}
                if len(found) < best:  # the first are draws of the same few
                    found = {_CODES[x].tobytes().decode(): i for i, x in enumerate(made)}
                for place, (name, i) in enumerate(sorted(found.items(), key=lambda x: (-score[x[1]], x[0]))[:best], 1):
                    out.append((heavy, light, antigen, cdr, name, predicted[i], penalty[i], score[i], place))
            yield pd.DataFrame(out, columns=names)

    names = ["heavy", "light", "antigen_seq", "cdrh3", "candidate", "predicted_score", "liability_penalty", "score", "place"]
    kept = base.mapInPandas(rank, "heavy string, light string, antigen_seq string, cdrh3 string, candidate string, predicted_score double, liability_penalty double, score double, place int")
    return kept.select("heavy", "light", "antigen_seq", "cdrh3", "candidate", *mutation_notation(F.col("cdrh3"), F.col("candidate")), "predicted_score", "liability_penalty", "score", "place")
