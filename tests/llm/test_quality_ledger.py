import re
from collections import Counter

from pyspark.sql import functions as F

from assayer.llm import quality_ledger as L

from ..conftest import SMALL


def brute(text):
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    wins = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = Counter(wins)
    hit = {j for i, w in enumerate(wins) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines),
            len(lines) - len(set(lines)), len(hit))


def test_measures_match_brute_force(make_docs, some_words):
    run = " ".join(some_words(1, 9))
    texts = [None, "", " \n\t ", "one", run, run + " x " + run, " ".join(["a"] * 30),
             "a b c d e f g h " * 2, "l1 x\nl1 x\n\nl1 x", "É# *ü x <b>",
             " ".join(some_words(2, 4000)) + " " + run + "\n" + run]
    rows = {r.doc_id: r for r in L.ledger(make_docs(enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines,
                r.n_repeat_words) == brute(text), text
        assert bool(r.fail_bits & 1) == (r.n_words < 20)
        assert bool(r.fail_bits & 2) == (100 * r.n_repeat_words > 30 * r.n_words)


def test_clashing_columns_and_empty_table(make_docs):
    df = make_docs([(1, "a b"), (1, "a b"), (None, None)])
    df = df.withColumns({c: F.lit("mine") for c in
                         ("_words", "_row", "n_words", "_hashes", "a.b")})
    out = L.ledger(df)
    assert out.count() == 3
    assert {(r["_words"], r["a.b"], r.n_words) for r in out.collect()} == {
        ("mine", "mine", 2), ("mine", "mine", 0)}
    assert L.ledger(df.limit(0)).count() == 0


def test_keep_measures_once(make_docs, some_words):
    """The filter stays above the measurements, so each is in the plan once."""
    good = " ".join(some_words(1, 30))
    df = make_docs([(1, good), (2, "short"), (3, None)]).withColumn("_doc", F.lit("mine"))
    kept = L.keep(df, "prose-1")
    assert kept.columns == df.columns
    assert [(r.doc_id, r._doc) for r in kept.collect()] == [(1, "mine")]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2 and plan.count("split(") <= 2


def test_ablations_match_counting_rows(spark):
    entries = L.ledger(spark.read.parquet(f"{SMALL}/documents.parquet")).cache()
    bits = [r.fail_bits for r in entries.collect()]
    whole = L.mask("prose-2")
    for r in L.ablations(entries, "prose-2").collect():
        bit = L.BITS[r.rule]
        assert r.n_failed == sum(bool(b & bit) for b in bits)
        assert r.n_only == sum(b & whole == bit for b in bits)
        assert r.n_kept_without == sum(not b & whole & ~bit for b in bits)
    kept = L.apply_policy(entries, "prose-2").filter("kept").count()
    assert kept == sum(not b & whole for b in bits)
    assert L.summary(entries, "lang").count() == entries.select("lang").distinct().count()


def test_labelled_good_documents_are_kept(spark):
    """Of documents labelled good, only those too short for the fixed base rule go."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1")
    judged = L.apply_policy(L.ledger(docs), "prose-1").join(good, "doc_id")
    assert judged.filter("NOT kept AND n_words >= 20").count() == 0
