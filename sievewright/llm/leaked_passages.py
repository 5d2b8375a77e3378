"""Passages of held-out items inside a corpus: a generalised suffix automaton over words, streamed through every text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import drop_staged, stage

#: Most words of items in one automaton; more items make more automata, each run over all texts.
AUTOMATON_WORDS = 400_000

_WORD = re.compile(rb"[a-z0-9]+")


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits in lower case (bytes.lower touches ASCII only)."""
    return _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


class WordAutomaton:
    """All runs of words of a set of items, as a generalised suffix automaton.

    items_of[v] are the items that hold the runs of state v, kept for states that can hold runs of `least` words or more.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], least: int):
        self.least = least
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for item, ws in items]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.items_of: list[set[int] | tuple] = [set() if n >= least else () for n in self.length]
        for item, ws in coded:
            v = 0
            for w in ws:
                v = self.next[v][w]
                u = v
                while u > 0 and self.length[u] >= least and item not in self.items_of[u]:
                    self.items_of[u].add(item)
                    u = self.link[u]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # this run is known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        now, p = self._new(self.length[last] + 1), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = now
            p = self.link[p]
        if p == -1:
            self.link[now] = 0
        else:
            q = self.next[p][w]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return now

    def matches(self, tokens: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) at each token where the longest run that ends there has `least` words or more."""
        ids, nxt, link, lengths, least = self.ids.get, self.next, self.link, self.length, self.least
        v = n = 0
        for k, token in enumerate(tokens):
            w = ids(token)
            if w is None:
                v = n = 0
                continue
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                n = lengths[v]
                to = nxt[v].get(w)
            if to is None:
                n = 0
                continue
            v, n = to, n + 1
            if n >= least:
                yield k, n, v

    def longest(self, tokens: list[bytes]) -> dict[int, tuple[int, int]]:
        """item: (words of its longest run in the tokens, end of that run)."""
        out: dict[int, tuple[int, int]] = {}
        for k, n, v in self.matches(tokens):
            while v > 0 and self.length[v] >= self.least:
                size = min(n, self.length[v])
                for item in self.items_of[v]:
                    if out.get(item, (0, 0))[0] < size:
                        out[item] = (size, k)
                v = self.link[v]
        return out


def _automata(items: DataFrame, item_col: str, text_col: str, least: int, most: int) -> Iterator[WordAutomaton]:
    """Automata over the items in blocks of at most `most` words, a single longer item by itself."""
    block, size = [], 0
    for row in items.where(f"{item_col} is not null and {text_col} is not null").select(item_col, text_col).distinct().orderBy(item_col, text_col).toLocalIterator():
        ws = words(row[1])
        if len(ws) < least:
            continue
        if block and size + len(ws) > most:
            yield WordAutomaton(block, least)
            block, size = [], 0
        block.append((row[0], ws))
        size += len(ws)
    if block:
        yield WordAutomaton(block, least)


def leaked_spans(docs: DataFrame, items: DataFrame, doc_col: str, text_col: str, item_col: str, item_text: str, least: int = 12, most: int = AUTOMATON_WORDS) -> DataFrame:
    """(doc, item, longest, last_word): every document and item that share a run of `least` words or more.

    Words are runs of ASCII letters and digits in any case. The items are a stated query set: they are read on the driver in
    blocks of at most `most` words, each block one broadcast automaton of bounded size run over all texts. longest is
    the length of the longest shared run, last_word its end in the document, counted in words from 0. Null and short
    texts share nothing; repeated rows give one row; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    out = None
    texts = docs.where(docs[doc_col].isNotNull() & docs[text_col].isNotNull()).select(docs[doc_col].alias("doc"), docs[text_col].alias("text"))
    kind, kind_item = texts.schema["doc"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"doc {kind}, item {kind_item}, longest int, last_word int"
    for automaton in _automata(items, item_col, item_text, least, most):
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            find = shared.value.longest
            for batch in batches:
                rows = [(doc, item, n, k) for doc, text in zip(batch["doc"], batch["text"], strict=True) for item, (n, k) in find(words(text)).items()]
                yield pd.DataFrame(rows, columns=["doc", "item", "longest", "last_word"])

        found = texts.mapInPandas(run, schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def without_leaks(docs: DataFrame, items: DataFrame, doc_col: str, text_col: str, item_col: str, item_text: str, least: int = 12, coverage: float = 0.5, most: int = AUTOMATON_WORDS) -> DataFrame:
    """(doc, text, leaked_words, share, dropped): texts without the runs of `least` words that items share with them.

    A text of which more than `coverage` of the words lie in such runs is dropped whole (null text, dropped true). The
    rest keeps everything outside the runs unchanged. Null texts stay null. Documents are returned one row each. Items of
    more than `most` words make several automata, which go over the texts one after the other.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_col].dataType.simpleString()
    rows = docs.select(docs[doc_col].alias("doc"), docs[text_col].alias("text"), F.array().cast("array<int>").alias("runs"))
    earlier = None
    for automaton in _automata(items, item_col, item_text, least, most):  # a task holds one at a time
        shared = spark.sparkContext.broadcast(automaton)

        def mark(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            find = shared.value.matches
            for batch in batches:
                batch["runs"] = [[*runs, *(x for k, n, _ in find(words(text)) for x in (k - n + 1, k + 1))] for text, runs in zip(batch["text"], batch["runs"], strict=True)]
                yield batch

        if earlier is not None:  # the marks of the block before are written, so that its automaton is let go
            staged = stage(rows)
            if hasattr(earlier, "_staged_path"):
                drop_staged(earlier)
            rows = staged
        earlier = rows
        rows = rows.mapInPandas(mark, f"doc {kind}, text string, runs array<int>")
    place = re.compile(r"[A-Za-z0-9]+")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, runs in zip(batch["doc"], batch["text"], batch["runs"], strict=True):
                tokens = words(text)
                hit = [False] * len(tokens)
                for a, b in zip(runs[::2], runs[1::2], strict=True):
                    hit[a:b] = [True] * (b - a)
                leaked = sum(hit)
                share = leaked / len(tokens) if tokens else 0.0
                if leaked and share > coverage:
                    text = None
                elif leaked:
                    at, parts, end = list(place.finditer(text)), [], 0
                    for k, (m, h) in enumerate(zip(at, hit, strict=True)):
                        if h and (k == 0 or not hit[k - 1]):
                            parts.append(text[end : m.start()])
                        if h:
                            end = m.end()
                    text = "".join([*parts, text[end:]])
                rows.append((doc, text, leaked, share, text is None and leaked > 0))
            yield pd.DataFrame(rows, columns=["doc", "text", "leaked_words", "share", "dropped"])

    return rows.mapInPandas(run, f"doc {kind}, text string, leaked_words int, share double, dropped boolean")
