import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.llm import suffix_decontam as S


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        i = words(item)
        n = min(window, len(i))
        wins = {tuple(i[k:k + n]) for k in range(len(i) - n + 1)} if i else set()
        for p in range(len(w) - n + 1 if n else 0):
            if tuple(w[p:p + n]) in wins:
                hit |= set(range(p, p + n))
                found.add(str(name))
    return len(w), hit, sorted(found)


@pytest.mark.parametrize("block_words", [100_000, 40])
def test_matches_brute_force(spark, make_docs, block_words):
    pick = random.Random(3)
    items = [(k, " ".join(pick.choices("abcd", k=pick.randrange(0, 25)))) for k in range(30)]
    items += [(90, "Ünique-word x"), (91, None), (92, ""), (93, "x"), (93, "y z")]
    texts = [" ".join(pick.choices("abcdE", k=pick.randrange(0, 120))) for _ in range(60)]
    texts += [None, "", "?!", items[4][1], "the ünique word x", "Y, z", "x " * 3000]
    docs = make_docs(enumerate(texts)).withColumn("hits", F.lit("clash"))
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = S.hit_words(S.find(docs, table, block_words=block_words)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, found = brute(texts[r.doc_id], items, 10)
        assert (r.n_words, r.n_hit, r.item_ids) == (n, len(hit), found)
        assert {p for a, b in zip(r.hits[::2], r.hits[1::2]) for p in range(a, b)} == hit


def test_spans_are_removed(spark, make_docs, some_words):
    item = " ".join(some_words(1, 40))
    clean, other = " ".join(some_words(2, 60)), " ".join(some_words(3, 50))
    docs = make_docs([(1, clean), (2, f"{clean}.\n{item.upper()}! {other}"), (3, item),
                      (4, None), (5, "")])
    table = spark.createDataFrame([(7, item)], "item_id long, text string")
    out = {r.doc_id: r for r in S.remove(docs, table).collect()}
    assert set(out) == {1, 2, 4, 5}
    assert out[1].text == clean and out[4].text is None
    assert out[2].text == f"{clean}.\n! {other}" and out[2].n_chars == len(out[2].text)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert S.find(make_docs([(1, "a b")]), none).first().item_ids == []
    assert S.remove(make_docs([]), none).count() == 0
