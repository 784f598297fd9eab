import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from assayer.llm import piece_bpe, queries

from ..conftest import SMALL


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path(piece_bpe.MODEL))


def check(library, text):
    mine = piece_bpe.pieces()
    ids = mine.encode(text)
    assert ids == library.encode(text), repr(text[:80])
    assert mine.decode(ids + [2]) == library.decode(ids + [2])


@pytest.mark.parametrize("text", [
    "", " ", "   ", "a", "\n", "\n\n x", "a\x00b", "▁x ▁", "日本\U0001F600 é", "<s> </s>",
    "tab\tand\r\n", "    indented  twice   ", "x" * 500, "ab" * 700, "\U0001F9FF" * 3,
    "aaa bbb" * 40, "don't stop-it, (now)!", "ﬁ½²③", "   \U0001F9FF", " \U0001F9FFx",
])
def test_matches_the_library(library, text):
    check(library, text)


def test_runs_of_spaces(library):
    for n in range(1, 70):
        check(library, " " * n + "word" + " " * n)
        check(library, " " * n)


def test_random_texts(library):
    pick = random.Random(5)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 32000, 7)]
    for _ in range(400):
        check(library, "".join(pick.choices(pieces, k=pick.randrange(1, 60))))
        check(library, "".join(pick.choices("abeinst \n'.", k=pick.randrange(1, 300))))
    for _ in range(10_000):
        check(library, "".join(pick.choices("ab▁é\U0001F9FF    \n\n\t", k=pick.randrange(1, 12))))


def test_decoding_any_ids(library):
    pick = random.Random(6)
    for _ in range(300):
        ids = [pick.choice((2, 40, 228, 229, 195, 300, 28705, 29000)) for _ in range(8)]
        assert piece_bpe.pieces().decode([5000] + ids) == library.decode([5000] + ids)


def test_memory_does_not_change_results(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MEMORY", 3)
    for text in ("one two three four five six", "six five four three two one"):
        check(library, text)


def test_query_against_the_library(spark, library):
    mine = {r.doc_id: r for r in queries.queries()["op3_piece_bpe"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = library.encode(r.text) + [2]
        m = mine.pop(r.doc_id)
        assert m.n_tokens == len(ids)
        assert m.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert m.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert not mine


def test_columns_round_trip(make_docs):
    df = make_docs([(1, "some text"), (1, "some text"), (None, None), (2, "")])
    df = df.withColumn("ids", F.lit("clash"))
    out = piece_bpe.decode(piece_bpe.encode(df))
    rows = sorted((r.doc_id or 0, r.decoded, len(r.ids), r.lang) for r in out.collect())
    assert rows == [(0, "", 1, "en"), (1, "some text", 3, "en"), (1, "some text", 3, "en"),
                    (2, "", 1, "en")]
    both = piece_bpe.encode_decode(df)
    assert sorted((r.doc_id or 0, r.decoded, len(r.ids), r.lang) for r in both.collect()) == rows
    assert piece_bpe.round_trip(df.limit(0)).count() == 0
