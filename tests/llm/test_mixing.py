import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import mixing
from sievewright.llm.mixing import language, matched_sources, mix_sources, rake

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DOC, TARGET = "doc_id long, text string, source string, lang string, topic string, tokens string, bucket string", "source string, target_share double, max_repeats int"


def run(spark, docs, targets, **options):
    d = spark.createDataFrame([(*x, "clash", "clash", "clash") for x in docs], DOC)
    chosen, shares = mix_sources(d, spark.createDataFrame(targets, TARGET), TOKENIZER, lang=language(F.col("lang")), **options)
    return chosen.collect(), {r["source"]: r for r in shares.collect()}


def test_rake_meets_margins_and_limits():
    rng = np.random.default_rng(0)
    tokens, limits = rng.uniform(10, 100, 12), np.full(12, 3.0)
    a, b = np.repeat([0, 1, 2], 4), np.tile([0, 1, 2, 3], 3)
    goal_a, goal_b = np.array([0.5, 0.3, 0.2]) * tokens.sum(), np.full(4, tokens.sum() / 4)
    w = rake(tokens, limits, [(a, goal_a), (b, goal_b)])
    assert np.allclose(np.bincount(a, w * tokens), goal_a, rtol=1e-3) and np.allclose(np.bincount(b, w * tokens), goal_b, rtol=1e-2) and w.min() >= 0 and w.max() <= 3
    assert np.allclose(rake(tokens, np.full(12, 0.5), [(np.zeros(12, int), np.array([1e9]))]), 0.5)


def test_shares(spark):
    docs = [(n, f"word number {n} of this text", "big one" if n % 4 else "SMALL-ONE ", "en" if n % 2 else None) for n in range(1200)]
    docs += [(5000, "x " * 20, "smal_one", "EN-gb"), (5001, "x", "unknown", "en"), (5002, None, "big_one", "en"), (5003, "", "big_one", "en"), (None, "x y", "big_one", "en"), (5004, "y", None, "en")]
    targets = [("big_one", 0.5, 1), ("small_one", 0.45, 4), ("absent", 0.05, 2)]
    chosen, shares = run(spark, docs, targets)
    assert {r["doc_id"] for r in chosen}.isdisjoint({5001, 5002, 5003, 5004, None}) and sum(r["source"] == "small_one" for r in chosen) > 280
    assert max(r["repeats"] for r in chosen if r["source"] == "big_one") == 1 and 2 <= max(r["repeats"] for r in chosen if r["source"] == "small_one") <= 4
    assert shares["absent"]["tokens"] == 0 and not shares["absent"]["reached"]
    assert shares["big_one"]["actual_share"] == pytest.approx(0.5 / 0.95, abs=0.02) and sum(r["actual_share"] for r in shares.values()) == pytest.approx(1)
    assert len({r["doc_id"] for r in chosen}) == len(chosen) and sorted(run(spark, docs, targets)[0]) == sorted(chosen)


def test_capacity_and_empty(spark):
    docs = [(n, "a b c d", "a", "en") for n in range(100)] + [(1000 + n, "a b c d", "b", "en") for n in range(10)]
    chosen, shares = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)])
    assert shares["b"]["uses"] == 20 and shares["b"]["documents"] == 10 and not shares["b"]["reached"]
    chosen, shares = run(spark, [], [("a", 1.0, 1)])
    assert chosen == [] and shares["a"]["actual_share"] == 0.0
    assert run(spark, docs, []) == ([], {})
    assert run(spark, [(1, "word " * 50_000, "a", "en")], [("a", 1.0, 1)])[0][0]["tokens"] > 50_000 - 2


def test_names(spark):
    names = spark.createDataFrame([("qc_memos",), ("assay_reports",), ("assay_report2",)], "source string")
    said = ["QC Memos ", "qc_memo", "assay_report", None, "", "memos"]
    got = {r["spelling"]: r["source"] for r in matched_sources(spark.createDataFrame([(t,) for t in said], "spelling string"), names).collect()}
    assert [got.get(t) for t in said] == ["qc_memos", "qc_memos", None, None, None, None]
    assert [spark.range(1).select(language(F.lit(t).cast("string"))).first()[0] for t in ("en-GB", " DE", None, "", "und")] == ["en", "de", "und", "und", "und"]


def test_every_document_has_its_probability(spark, monkeypatch):
    """One more use goes to a share of the documents that the weight gives, in whatever buckets they are ordered."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    docs = [(n, "word " * (1 + n % 9), "a", "en" if n % 3 else "de") for n in range(900)] + [(2000 + n, "word " * 5, "b", "en") for n in range(900)]
    chosen, shares = run(spark, docs, [("a", 0.75, 2), ("b", 0.25, 2)])
    for source, share in (("a", 0.75), ("b", 0.25)):
        assert abs(shares[source]["actual_share"] - share) < 0.005
    uses = [r["repeats"] for r in chosen if r["source"] == "a"]
    assert set(uses) == {1, 2} and len(uses) == 900
