import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.llm import kdtree_shards as K, queries

from ..conftest import SMALL


def check(rows, shards):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    assert set(by_shard) <= set(range(shards))
    return {s: sum(r.size for r in m) for s, m in by_shard.items()}


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_bytes_are_near_equal(spark, shards):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = K.assign(docs, shards).collect()
    sizes = check(rows, shards)
    total = sum(len((r.text or "").encode()) + 1 for r in docs.collect())
    heaviest = max(r.size for r in rows)
    assert sum(sizes.values()) == total and len(sizes) == shards
    assert max(sizes.values()) <= total / shards + 2 * heaviest


def brute_tree(points, shards):
    """Shard of each point: split at the widest dimension, where the weight asks for it."""
    def ends(members):
        return [(min(c), max(c)) for c in zip(*(p.dims for p in members))]

    whole, out = ends(points), {}

    def split(members, first, leaves):
        if leaves < 2:
            out.update({(p._group, p._part): first for p in members})
            return
        spread = [(high - low) / ((a[1] - a[0]) or 1)
                  for (low, high), a in zip(ends(members), whole)]
        dim = spread.index(max(spread))
        ordered = sorted(members, key=lambda p: (p.dims[dim], p.tie))
        wanted = sum(p.w for p in members) * (leaves // 2) / leaves
        before, k = 0, 0
        while before + ordered[k].w < wanted:
            before, k = before + ordered[k].w, k + 1
        k += wanted - before >= before + ordered[k].w - wanted
        split(ordered[:k], first, leaves // 2)
        split(ordered[k:], first + leaves // 2, leaves - leaves // 2)

    split(points, 0, shards)
    return out


@pytest.mark.parametrize("shards", [3, 8])
def test_against_a_plain_tree(spark, make_docs, some_words, monkeypatch, shards):
    monkeypatch.setattr(K, "FINE", 0.0)
    pairs = [(k * k % 601, " ".join(some_words(k, 3 + k * 7 % 50))) for k in range(300)]
    pairs += [(2000 + k, pairs[k][1]) for k in range(30)]
    docs = make_docs(pairs).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 9))
    rows = K._rows(docs, "doc_id", "text", ("doc_id",), ("lang", "source"))
    points = K._points(rows, shards)[1].collect()
    want = brute_tree(points, shards)
    groups = {r.doc_id: r.g for r in docs.select(
        "doc_id", F.xxhash64("text").alias("g")).collect()}
    for r in K.tree(docs, shards).collect():
        assert r.shard in {s for (g, _), s in want.items() if g == groups[r._id]}
    single = {g for g, part in want} - {g for g, part in want if part}
    assert len(single) > 200


def test_text_ids(spark, make_docs):
    docs = make_docs([(k, f"text {k}") for k in range(20)]).withColumn(
        "doc_id", F.concat(F.lit("id"), F.col("doc_id")))
    assert len(check(K.assign(docs, 4).collect(), 4)) == 4


def test_copies_share_a_shard_unless_too_heavy(spark, make_docs, some_words):
    pairs = [(k, " ".join(some_words(k, 40))) for k in range(400)]
    pairs += [(1000 + k, pairs[k % 7][1]) for k in range(40)]
    pairs += [(5000 + k, "the same text in a third of all rows, over and over again " * 4)
              for k in range(220)]
    rows = K.assign(make_docs(pairs), 8).collect()
    sizes = check(rows, 8)
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 8
    shard = {r._id: r.shard for r in rows}
    for k in range(40):
        assert shard[1000 + k] == shard[k % 7]


def test_odd_rows(make_docs):
    pairs = [(None, None), (None, ""), (3, "é"), (3, "é"), (4, "x" * 50_000)]
    docs = make_docs(pairs).withColumns({"shard": F.lit("clash"), "_id": F.lit(0)})
    rows = K.assign(docs, 4).collect()
    check(rows, 4)
    assert Counter((r._id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs)
    assert K.assign(make_docs([]), 4).count() == 0


def test_query(spark):
    df = queries.queries()["op9_kdtree_shards"](spark, SMALL)
    rows = df.collect()
    sizes = check(rows, 16)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert len(sizes) == 16
