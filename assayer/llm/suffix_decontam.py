"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items' words recognises every run of words that occurs in an item. Each
document streams through it; the length of the longest match that ends at a word tells
whether the last ``window`` words occur in an item, and the state then names the items. An
item shorter than a window counts where it occurs as a whole. Words that no item has reset
the match, so only runs of known words that are long enough are walked through.

Items are a given, small set, yet no size is assumed: they are dealt into blocks of about
``BLOCK_WORDS`` words, each block is one automaton and one pass over the documents, and the
matches of all blocks are united. Nothing is shuffled; a task holds one batch of texts and
the automaton of one block.

Defined results: NULL and empty texts have no words and match nothing; items without words
are left out; items with equal ids count once; repeated documents each get their own row;
other columns pass through, and a column named like an output is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from assayer.llm.common import plain_words

WINDOW = 10
BLOCK_WORDS = 100_000
# A document with a larger share of its words in matches is dropped, not cut.
MOST_COVERED = 0.5

_WORD = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")
_FOUND = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("hits", T.ArrayType(T.LongType(), False), False),
    T.StructField("item_ids", T.ArrayType(T.StringType(), False), False),
])


class Automaton:
    """Generalised suffix automaton over the words of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        # For each item the states of its prefixes; cloning keeps them right, because the
        # clone takes the shorter strings and a prefix is the longest of its state.
        ends: list[list[int]] = []
        for _, words in items:
            last, states = 0, []
            for word in words:
                last = self._extend(last, self.words.setdefault(word, len(self.words) + 1))
                states.append(last)
            ends.append(states)
        self._name(items, ends)
        self.least = min((min(len(w), window) for _, w in items), default=window)

    def _new(self, length: int, link: int, arrows: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(arrows)
        return len(self.link) - 1

    def _split(self, at: int, word: int) -> int:
        """The state after ``word`` from ``at``, holding no longer strings than that."""
        to = self.next[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        clone = self._new(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = clone
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            self.link[state] = self._split(at, word)
        return state

    def _name(self, items, ends) -> None:
        """Items by the states of their windows, and of short items as a whole."""
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.at_window = [0] * len(order)  # the suffix state that holds length ``window``
        for s in order[1:]:
            up = self.link[s]
            self.at_window[s] = (0 if self.length[s] < self.window else
                                 s if self.length[up] < self.window else self.at_window[up])
        self.windows: dict[int, set[str]] = {}
        self.whole: dict[int, set[str]] = {}
        for (name, words), states in zip(items, ends, strict=True):
            if len(words) < self.window:
                self.whole.setdefault(states[-1], set()).add(name)
            for s in states[self.window - 1:]:
                self.windows.setdefault(self.at_window[s], set()).add(name)
        self.near_whole = [0] * len(order)  # itself or the next suffix that is a short item
        for s in order[1:]:
            self.near_whole[s] = s if s in self.whole else self.near_whole[self.link[s]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (end exclusive, in order of their ends) that match, and their items."""
        known = np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known != 0, [0]))))
        ranges: list[tuple[int, int]] = []
        found: set[str] = set()
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start >= self.least:
                self._walk(known[start:end].tolist(), start, ranges, found)
        return ranges, found

    def _walk(self, run: list[int], start: int, ranges, found: set[str]) -> None:
        arrows, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for at, word in enumerate(run, start + 1):
            while state and word not in arrows[state]:
                state = link[state]
                matched = length[state]
            state = arrows[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                ranges.append((at - window, at))
                found |= self.windows[self.at_window[state]]
            short = self.near_whole[state]
            while short:
                if length[short] <= matched:
                    ranges.append((at - length[short], at))
                    found |= self.whole[short]
                short = self.near_whole[link[short]]


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges joined, in order."""
    joined: list[list[int]] = []
    for a, b in sorted(ranges):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    return [(a, b) for a, b in joined]


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int):
    """Items in blocks of bounded size, one at a time."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("i"),
                        F.col(f"`{text}`").alias("t")).filter("t IS NOT NULL")
    # A word takes two bytes at least, with the one that ends it.
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-total // (2 * block_words)))
    for block in range(count):
        chosen = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == block)
        listed = [(r.i or "", plain_words(r.t)) for r in chosen.toLocalIterator()]
        yield [(i, w) for i, w in listed if w]


_BUILT: dict[str, Automaton] = {}


def _automaton(key: str, items, window: int) -> Automaton:
    """Built once in each Python process; only the block in use is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, window)
    return _BUILT[key]


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with ``n_words``, ``hits`` and ``item_ids``.

    ``hits`` lists the starts and ends (exclusive) of matching word ranges, one after the
    other; ``item_ids`` the items whose windows occur, in order of their text.
    """
    own = [f for f in docs.schema.fields if f.name not in _FOUND.names]
    found = docs.select(*[F.col(f"`{f.name}`") for f in own])
    schema = T.StructType(own + _FOUND.fields)
    names = [f.name for f in own]
    context = docs.sparkSession.sparkContext
    for number, block in enumerate(_blocks(items, item_id, item_text, block_words)):
        shared, key, first = context.broadcast(block), uuid.uuid4().hex, number == 0

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, key=key,
                 first=first) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, shared.value, window)
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = {n: k for k, n in enumerate(batch.schema.names)}
                texts = batch.column(at[text]).to_pylist()
                counts, hits, named = [], [], []
                for k, t in enumerate(texts):
                    words = plain_words(t)
                    ranges, items_found = automaton.scan(words)
                    if not first:
                        old = batch.column(at["hits"])[k].as_py()
                        ranges += zip(old[::2], old[1::2], strict=True)
                        items_found |= set(batch.column(at["item_ids"])[k].as_py())
                    counts.append(len(words))
                    hits.append([x for r in united(ranges) for x in r])
                    named.append(sorted(items_found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(at[n]) for n in names]
                    + [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())),
                       pa.array(named, pa.list_(pa.string()))], schema.names)

        found = found.mapInArrow(scan, schema)
    return found


def hit_words(found: DataFrame) -> DataFrame:
    """The result of ``find`` with ``n_hit``, the number of words in matching ranges."""
    return found.withColumn("n_hit", F.aggregate(
        F.transform("hits", lambda x, k: F.when(k % 2 == 0, -x).otherwise(x)),
        F.lit(0).cast("long"), lambda s, x: s + x))


def without_ranges(text: str, hits: list[int]) -> str:
    """A text without word ranges; what stands between two words of a range goes too."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data)]
    out, at = [], 0
    for a, b in zip(hits[::2], hits[1::2], strict=True):
        out.append(data[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode()


def remove(docs: DataFrame, items: DataFrame, text: str = "text",
           most_covered: float = MOST_COVERED, length: str | None = "n_chars",
           **options) -> DataFrame:
    """Documents without what they share with the items, in the columns of ``docs``.

    Matching ranges are cut out of the text; a document with more than ``most_covered`` of
    its words in them is dropped. ``length`` names a column that holds the length of the
    text and follows the cut.
    """
    found = hit_words(find(docs, items, text, **options))
    kept = found.filter((F.col("n_hit") == 0)
                        | (F.col("n_hit") <= F.lit(most_covered) * F.col("n_words")))
    schema = T.StructType([f for f in kept.schema.fields if f.name in docs.columns])
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            columns = {n: batch.column(at[n]) for n in names}
            hits = batch.column(at["hits"]).to_pylist()
            changed = [k for k, h in enumerate(hits) if h]
            if changed:
                texts = columns[text].to_pylist()
                for k in changed:
                    texts[k] = without_ranges(texts[k], hits[k])
                columns[text] = pa.array(texts, columns[text].type)
                if length in columns:
                    sizes = columns[length].to_pylist()
                    for k in changed:
                        sizes[k] = len(texts[k])
                    columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return kept.mapInArrow(cut, schema).select(*[F.col(f"`{c}`") for c in docs.columns])
