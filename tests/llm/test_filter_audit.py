from itertools import permutations

import pytest
from pyspark.sql import functions as F

from assayer.errors import AssayError
from assayer.llm import filter_audit as K


def fails_of(rows):
    """Failed filters of (doc_id, text, lang) rows, word by word."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
        failed = set()
        if len(words) < 200:
            failed.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            failed.add("C")
        if set(t) & set("#$%&*|"):
            failed.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            failed.add("E")
        out.append(failed)
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    failed = fails_of(rows)
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, failed) if (p or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(f in x for _, x in mine) - len(gone),
                    sum(x == {f} for _, x in mine), sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone)]
        for f in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == f:
                    v.append(total)
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [
        r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
        for r in df.collect()}


def run(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("_row", F.lit("clash")).withColumn("part", F.lit("clash"))
    return found(K.audit(docs, marks, K.conditions(text)))


def test_against_brute_force(spark, some_words):
    long = " ".join(some_words(1, 250))
    rows = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, "de"), (0, "Short", None),
        (4, "a " * 300, "de"), (5, "a\x0b" * 300 + "#", "de"), (6, None, "en"), (7, "", "en"),
        (None, long, "en"), (None, "", None), (8, long.upper() + "|", "en"), (9, "ÀÉ é", "fr"),
        (10, long + " Z", ""), (11, "x" * 5000 + " A", "en"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, 1, 1), (None, 1, 1), (8, None, 1),
              (4, 1, 0), (99, 1, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_many_copies(spark, some_words):
    long = " ".join(some_words(2, 220))
    rows = [(i, long, "en") for i in range(400)] + [(500, long + " x", "en")]
    assert run(spark, rows, [(0, 1, 1), (7, 1, 1)]) == brute(rows, [(0, 1, 1), (7, 1, 1)])


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    got = run(spark, [(1, "a", "en")], [])
    assert len(got) == 600 and got["en", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


def test_id_tables_and_limits(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b c")], "doc_id long, text string")
    docs = docs.withColumn("lang", F.lit("en"))
    rows = K.numbered(docs, {"S": F.length("text") < 2})
    tables = K.id_tables(rows, ["S"], "copies")
    ids = {f: sorted(r._id for r in rows.join(t, "_row").collect()) for f, t in tables.items()}
    assert ids == {"S": [1, 2], "copies": [2]}
    with pytest.raises(AssayError, match="too_many_filters"):
        K.audit(docs, docs, {str(k): F.lit(True) for k in range(8)})
