import random
import re

import pytest

from sievewright.llm.leaked_passages import WordAutomaton, leaked_spans, without_leaks, words

DOC, ITEM = "doc_id long, text string, doc string, item string", "item_id long, item_text string, text string"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "clash", "clash") for d in docs], DOC), spark.createDataFrame([(*i, "clash") for i in items], ITEM)


def run(spark, docs, items, **options):
    d, i = frames(spark, docs, items)
    return {(r["doc"], r["item"]): r["longest"] for r in leaked_spans(d, i, "doc_id", "text", "item_id", "item_text", **options).collect()}


def plain(text):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text or "")]


def brute(docs, items, least):
    out = {}
    for d, text in docs:
        w = plain(text)
        for i, item in items:
            x = plain(item)
            best = 0
            for a in range(len(w)):
                for b in range(len(x)):
                    n = 0
                    while a + n < len(w) and b + n < len(x) and w[a + n] == x[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= least:
                out[(d, i)] = max(best, out.get((d, i), 0))
    return out


@pytest.mark.parametrize("seed,most", [(1, 400_000), (2, 30)])
def test_against_brute_force(spark, seed, most):
    rng = random.Random(seed)
    make = lambda n, k: " ".join(rng.choice("abcd"[:k]) for _ in range(n))
    items = [(i, make(rng.randrange(3, 25), 3)) for i in range(8)]
    docs = [(d, make(rng.randrange(0, 60), 4)) for d in range(40)]
    assert run(spark, docs, items, least=5, most=most) == brute(docs, items, 5)


def test_words_and_edges(spark):
    item = "One two-three FOUR five_six seven eight nine ten eleven twelve"
    docs = [(1, "x\n" + item.upper().replace(" ", "\n  ") + " y"), (2, None), (3, ""), (4, "one two"), (5, item.replace("six", "siſ")), (1, "x " + item), (6, "z " * 100_000 + item), (None, item)]
    assert run(spark, docs, [(7, item), (7, item), (8, None), (9, "short one"), (None, item)]) == {(1, 7): 12, (6, 7): 12}
    assert run(spark, docs, []) == {} and run(spark, [], [(7, item)]) == {}
    assert words("KK ÀB9") == [b"k", b"b9"]


def test_removal(spark):
    item = " ".join(f"w{k}" for k in range(15))
    d, i = frames(spark, [(1, f"Keep this, please: {item}! And this."), (2, item), (3, "nothing here"), (4, None)], [(1, item)])
    got = {r["doc"]: (r["text"], r["leaked_words"], r["dropped"]) for r in without_leaks(d, i, "doc_id", "text", "item_id", "item_text", coverage=0.9).collect()}
    assert got == {1: ("Keep this, please: ! And this.", 15, False), 2: (None, 15, True), 3: ("nothing here", 0, False), 4: (None, 0, False)}


def test_removal_by_several_automata(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefg") + str(rng.randrange(9)) for _ in range(14))) for i in range(4)]
    docs = [(k, f"Start {items[k % 4][1]} middle {' '.join(items[(k + 1) % 4][1].split()[:12])} " + "end " * 40) for k in range(6)]
    d, i = frames(spark, docs, items)
    out = [sorted(map(tuple, without_leaks(d, i, "doc_id", "text", "item_id", "item_text", most=m).collect())) for m in (400_000, 20, 1)]
    assert out[0] == out[1] == out[2] and {r[2] for r in out[0]} == {26}


def test_automaton_knows_every_item_of_a_run():
    a = WordAutomaton([(1, [b"a", b"b", b"c", b"d"]), (2, [b"x", b"b", b"c", b"d"])], 3)
    assert set(a.longest([b"b", b"c", b"d"])) == {1, 2} and a.longest([b"a", b"b", b"c", b"d"]) == {1: (4, 3), 2: (3, 3)}
