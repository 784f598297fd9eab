import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import chosen_path as C, queries
from assayer.llm.common import plain_words

from ..conftest import SMALL


def brute(pairs, threshold=C.THRESHOLD):
    """class_id and n_links by comparing all pairs."""
    def grams(text):
        w = plain_words(text)
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    sets = [(i, grams(t)) for i, t in pairs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b:
                common = len(a & b)
                if common >= threshold * (len(a) + len(b) - common) - 1e-9:
                    links[x] += 1
                    links[y] += 1
                    parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        r = root(x)
        least[r] = min(least.get(r, i), i, key=lambda v: (v is None, v))
    return Counter((i, least[root(x)], links[x]) for x, (i, _) in enumerate(sets))


def near_copy(words, pick, edits):
    words = list(words)
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"new{pick.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [C.BLOCK, 4])
def test_matches_brute_force(make_docs, some_words, block):
    """Groups of near copies, chains, copies, shared passages, short and empty texts; small
    blocks force splitting to the last level and groups of block pairs."""
    pick = random.Random(8)
    passage = " ".join(some_words(77, 60))
    pairs = []
    for g in range(12):
        base = some_words(g, pick.randrange(5, 300))
        for _ in range(pick.randrange(1, 12)):
            pairs.append((len(pairs), near_copy(base, pick, pick.randrange(0, 3))))
    for s in range(30):
        pairs.append((len(pairs), " ".join(some_words(900 + s, 90)) + " " + passage))
    pairs += [(500, "one two"), (501, "One, two!"), (502, "one"), (503, ""), (504, None),
              (505, "?"), (506, pairs[0][1]), (506, pairs[0][1]), (None, pairs[0][1])]
    docs = make_docs(pairs).withColumns({"key": F.lit(1), "_id": F.lit(2), "n": F.lit(3)})
    got = Counter((r._id, r.class_id, r.n_links) for r in C.join(docs, block=block).collect())
    assert got == brute(pairs)


def test_runs_reach_the_recall():
    missed = (1 - C.THRESHOLD ** C.DEPTH) ** C.runs_for()
    assert missed <= 1 - C.RECALL


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2 ** 63, 800).astype(np.uint64)
    a = np.concatenate([both, rng.integers(0, 2 ** 63, 100).astype(np.uint64)])
    b = np.concatenate([both, rng.integers(0, 2 ** 63, 100).astype(np.uint64)])
    equal = (C.samples(a, 2000) == C.samples(b, 2000)).mean()
    assert abs(equal - 0.8) < 0.03


def test_one_of_each(make_docs, some_words):
    base = some_words(1, 100)
    text, other = " ".join(base), " ".join(some_words(2, 50))
    pick = random.Random(1)
    out = C.one_of_each(make_docs([
        (3, text), (1, near_copy(base, pick, 1)), (2, text), (1, other), (7, ""), (8, None),
        (9, other), (9, other)]))
    rows = sorted((r.doc_id, r.text) for r in out.collect() if r.text)
    assert [i for i, _ in rows] == [1, 1] and out.count() == 4
    assert C.one_of_each(make_docs([])).count() == 0


def test_query_against_brute_force(spark):
    pairs = [(r.doc_id, r.text) for r in
             spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in
                  queries.queries()["op4_chosen_path"](spark, SMALL).collect())
    assert got == brute(pairs)


def test_components(spark):
    pick = random.Random(3)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)]
    edges += [(k, k + 1) for k in range(1000, 1040)]
    parent = {v: v for e in edges for v in e}
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.root for r in C.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(v, v) == r for v, r in parent.items())
