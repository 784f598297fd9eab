import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import divergence as K

SCHEMA = "lang string, source string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    rows = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+",
                                          (t or "").translate(LOWER))) for a, b, t in rows]
    stands, n = defaultdict(Counter), defaultdict(Counter)
    for lang, _, words in rows:
        stands[lang].update(set(words))
    kept = {lang: [t for t, k in c.items() if k >= least] for lang, c in stands.items()}
    groups = {(a, b) for a, b, _ in rows}
    for lang, source, words in rows:
        n[lang, source].update(w for w in words if stands[lang][w] >= least)
    for lang in {a for a, _ in groups}:
        n[lang, None] = sum((n[g] for g in groups if g[0] == lang), Counter())
    def share(group, term):
        total = sum(n[group].values()) + 2 * len(kept[group[0]])
        return 1 + 1_000_000_000 * (n[group][term] + 2) // total
    def f(p, q):
        return (p - q) ** 2 // (p + q)
    out = []
    for lang, source in groups:
        own = {t: share((lang, source), t) for t in kept[lang]}
        pairs = [(-sum(f(own[t], share((lang, s), t)) for t in kept[lang]), s)
                 for a, s in groups if a == lang and s != source]
        terms = [(-f(own[t], q), t.encode()) for t in kept[lang]
                 if n[lang, source][t] and own[t] > (q := share((lang, None), t))]
        for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))),
                            ("term", sorted(terms)[:top])):
            out += [(lang, source, part, i if part == "pair" else i.decode(), -v, k + 1)
                    for k, (v, i) in enumerate(items)]
    return sorted(out)


def found(df, **options):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"])
                  for r in K.divergence(df, **options).collect())


def some_rows(seed, n=400):
    pick = random.Random(seed)
    words = [f"{a}{b}" for a in "abcÄéß" for b in "xyzÉw日"] + ["It's", "A1b", "don’t"]
    rows = []
    for _ in range(n):
        source = pick.choice(["s1", "s1", "s1", "s2", "s3", "é", "", None])
        few = words[:12] if source == "s2" else words
        text = pick.choice([" ", "\n", "3", "-"]).join(pick.choices(few, k=pick.randrange(0, 40)))
        rows.append((pick.choice(["en", "en", "de", None]), source,
                     pick.choice([text, text, text.upper(), None])))
    return rows + [("xx", "a", "one two"), ("xx", "b", "one"), ("xx", "c", None)]


def test_against_brute_force(spark):
    rows = some_rows(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.withColumn("term", F.lit("clash")).withColumn("n", F.lit("clash"))
    assert found(df) == brute(rows)


def test_small_shards_and_many_passes(spark, monkeypatch):
    monkeypatch.setattr(K, "HELD_CELLS", 30)
    monkeypatch.setattr(K, "HELD_TERMS", 20)
    rows = some_rows(2, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df, least=3, shard_terms=5, pass_bytes=60, top=3) == brute(rows, 3, 3)


def test_perfect_hashes():
    for n in (1, 2, 3, 4, 5, 7, 30, 1000, 4096, 5003):
        terms = [f"term{k}".encode() for k in range(n)]
        seed, displacement, slots = K.perfect(K._hashes(terms))
        assert sorted(slots) == list(range(n))
        in_order = [b""] * n
        for t, s in zip(terms, slots):
            in_order[s] = t
        table = K.Shards([{"shard": 0, "n_shards": 1, "n": n, "seed": seed,
                           "displacement": displacement.tobytes(), "terms": b" ".join(in_order)}])
        assert table.slots(terms) == slots.tolist()
        assert table.slots([b"other", b"", terms[0], b"term"]) == [None, None, slots[0], None]


def test_exact_shares():
    pick = random.Random(3)
    for _ in range(2000):
        total = pick.randrange(2, 9 * 10 ** 15)
        c = pick.randrange(0, total - 1)
        assert K.shares(np.array([c]), np.array(total))[0] == 1 + 10 ** 9 * (c + 2) // total
    p, q = np.array([10 ** 9 + 1]), np.array([1])
    assert K.distances(p, q)[0] == 10 ** 18 // (10 ** 9 + 2)


def test_odd_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [("en", None, None)] * 3 + [("en", "b", "x " * 30_000)] * 12
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    with pytest.raises(ValueError):
        K.perfect(np.zeros((2, 2), np.uint64))
