"""The pipeline on whole small tables, stage by stage against brute force."""

import pytest
import sentencepiece
import public_tokenizers

import __spark_entry__ as entry
import corpus_pipeline as P
from assayer.llm import line_chunks, suffix_decontam
from assayer.llm.common import plain_words

from ..conftest import SMALL
from .test_chosen_path import brute as classes
from .test_line_chunks import brute as repeated
from .test_quality_ledger import brute as measured
from .test_suffix_decontam import brute as leaked


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs]
    for name, stage in P.STAGES:
        found.append(P.stored(stage(spark, found[-1], SMALL), name))
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_names(stages):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_duplicates",
                                        "decontamination", "encoding"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert all(a.count() >= b.count() > 0 for a, b in zip(stages, stages[1:]))


def test_quality(stages):
    before, after = texts(stages[0]), texts(stages[1])
    for i, t in before.items():
        words, chars, symbols, lines, twice, hit = measured(t)
        upper = sum(c.isupper() for c in t)
        bad = (words < 20 or 100 * hit > 30 * words or 10 * symbols > words
               or 10 * twice > 4 * lines or 2 * upper > chars)
        assert (i in after) == (not bad)
        assert bad or after[i] == t


def test_lines(stages):
    before, after = texts(stages[1]), texts(stages[2])
    gone = {i: lines for (_, i, _), lines in repeated(list(before.items())).items()}
    for i, t in before.items():
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone[i]))
        assert after.get(i, left) == left and (i in after or not left.strip())


def test_near_duplicates(stages):
    before, after = texts(stages[2]), texts(stages[3])
    want = {i for i, least, _ in classes(list(before.items())) if i == least}
    assert set(after) == want and all(after[i] == before[i] for i in after)


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in
             spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = texts(stages[3])
    after = {r.doc_id: r for r in stages[4].collect()}
    for i, t in before.items():
        n, hit, _ = leaked(t, items, suffix_decontam.WINDOW)
        assert (i in after) == (len(hit) <= suffix_decontam.MOST_COVERED * n)
        if i in after:
            left = [w for k, w in enumerate(plain_words(t)) if k not in hit]
            assert plain_words(after[i].text) == left
            assert hit or after[i].text == t
            assert after[i].n_chars == len(after[i].text)


def test_encoding(stages):
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before = texts(stages[4])
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == set(before)
    for r in rows:
        assert r.ids == library.encode(before[r.doc_id]) + [2]
        assert r.decoded == library.decode(r.ids)


def test_registered(spark):
    assert entry.queries()["pipeline"] is P.run
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {
        f"op{k}" for k in range(1, 11)}


def test_empty_and_odd_documents(spark, make_docs):
    docs = make_docs([(1, None), (None, ""), (2, "x"), (2, "x")])
    for rows in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, rows, SMALL).columns == docs.columns
        out = rows
        for _, stage in P.STAGES:
            out = stage(spark, out, SMALL)
        assert out.count() == 0
    assert line_chunks.remove(docs).count() == 4
