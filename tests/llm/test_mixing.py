import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.llm import mixing as K

SCHEMA = "doc_id long, text string, source string"


def targets_of(sizes):
    """Targets by resharing until none is above three times its source's words."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, shares = total - sum(fixed.values()), sum(weight[s] for s in free)
        found = {s: weight[s] * left / shares for s in free}
        above = {s: 3 * sizes[s] for s in free if found[s] > 3 * sizes[s]}
        if not above:
            return {**fixed, **found}
        fixed.update(above)


def some_docs(seed, n=300, hot="b"):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        source = pick.choice([hot, hot, hot, "a", "c", "d", None, "é"])
        words = [f"w{i}.{k}" for k in range(pick.choice([0, 1, 3, 40, 64, 65, 130, 900]))]
        text = pick.choice([" ", "\t\n", "\x0b"]).join(words)
        rows.append((i, text if words or i % 2 else None, source))
    return rows


def test_permutations_are_whole(spark):
    for n in (1, 2, 3, 4, 5, 17, 100, 1023, 5000):
        df = K.permuted(spark.range(n), F.col("id"), F.lit(n), F.lit(7), "to")
        got = [r.to for r in df.orderBy("id").collect()]
        assert sorted(got) == list(range(n))
        if n > 10:
            assert got != sorted(got)
            again = K.permuted(spark.range(n), F.col("id"), F.lit(n), F.lit(8), "to")
            assert got != [r.to for r in again.orderBy("id").collect()]


def test_running_sums(spark):
    rows = [(k % 3, k // 3, k) for k in range(200)]
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(7)
    got = {(r.g, r.o): r.s for r in K.running(df, ["g"], [F.col("o")], F.col("v"), "s").collect()}
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p < o) for g, o, _ in rows}


def test_blocks_and_targets(spark):
    rows = some_docs(1)
    mix = K.Mixture(spark.createDataFrame(rows, SCHEMA), block=16, shard=32, words=True)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_of(sizes)
    blocks = mix.blocks().collect()
    texts = {i: (t or "").split() for i, t, _ in rows}
    taken, uses, by_shard = Counter(), Counter(), defaultdict(list)
    for b in blocks:
        held = 0
        for p in b.pieces:
            assert p.at == held and p.words == texts[p.doc_id][p["from"]:p["from"] + p.n_words]
            held += len(p.words)
            taken[p.doc_id] += len(p.words)
        assert held == 16 or b.block == -(-sizes[b.source] // 16) - 1
        uses[b.source, b.block] += 1
        by_shard[b.shard].append(b.slot)
    for s in sizes:
        got = sum(n for i, n in taken.items() if rows[i][2] == s)
        assert abs(got - want[s]) <= 2 * 16
        times = {uses[s, k] for k in range(-(-sizes[s] // 16))}
        assert max(times) <= 3 and max(times) - min(times) <= 1
    last = max(by_shard)
    for shard, slots in by_shard.items():
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == 32 or shard == last)
    for r in mix.taken().collect():
        assert r.taken == taken[r.doc_id] <= 3 * r.size
        assert r.target == pytest.approx(want[rows[r.doc_id][2]])
        assert r.source_size == sizes[rows[r.doc_id][2]]


def test_draws_are_multinomial(spark):
    """Counts of two equal sources over shards, against the variance of such draws."""
    rows = [(i, "w " * 100, s) for i in range(300) for s in ("a", "d")]
    mix = K.Mixture(spark.createDataFrame(rows, SCHEMA), block=10, shard=100)
    n = {(r.shard, r.no): r.n for r in mix.draws.collect()}
    shards = 60
    assert sum(n.values()) == 100 * shards
    share = sum(v for (_, no), v in n.items() if no == 0) / (100 * shards)
    chi = sum((n.get((k, 0), 0) - 100 * share) ** 2 / (100 * share * (1 - share))
              for k in range(shards))
    assert 30 < chi < 100  # 59 degrees of freedom


def test_reruns_agree(spark):
    df = spark.createDataFrame(some_docs(2), SCHEMA)
    first = sorted(K.Mixture(df).taken().collect())
    assert first == sorted(K.Mixture(df.repartition(5)).taken().collect())


def test_odd_tables(spark):
    assert K.Mixture(spark.createDataFrame([], SCHEMA)).taken().collect() == []
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)
    assert [(r.target, r.taken) for r in K.Mixture(empty).taken().collect()] == [(0, 0)] * 2
    rows = [(7, "a b", None)] * 3 + [(None, "c", None), (9, "x " * 50_000, "z")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("no", F.lit("clash")) \
        .withColumn("size", F.lit("clash"))
    got = K.Mixture(df).taken().collect()
    assert len(got) == 5 and all(r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got if r.size == 50_000) == pytest.approx(49_986, abs=128)


def test_slots_are_never_broadcast(spark, monkeypatch):
    """A few rows stand for many slots: tasks share them, and no join sends them to all."""
    monkeypatch.setattr(K, "TASK_SLOTS", 100)
    mix = K.Mixture(spark.createDataFrame(some_docs(3), SCHEMA), block=16, shard=400)
    tasks = [r["count"] for r in mix.slots.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) > 1000 and max(tasks) <= sum(tasks) / 2
    for table in (mix.taken(), mix.blocks()):
        table.collect()
        plan = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        joins = [line for line in plan.splitlines() if "Join" in line and "block#" in line]
        assert joins and not any("Broadcast" in line for line in joins)
