import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.errors import AssayError
from assayer.llm import queries, token_files as K

from ..conftest import SMALL


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(K.TOKENIZER))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoding_matches_the_library(library):
    pick = random.Random(4)
    texts = ["", " ", "a  b", "a \n b\n\n", "don't, can't. I'll.'s", "x.'s y,.'ll", ",a.,b .c",
             "é,ü. ª,º.µ, ×.", "a\x1cb\x85c\xa0d e​f", "it's.\n'tis", "1,2.3, v1.2.",
             "<|endoftext|>", "<|endoftext|> a <|endoftext|>", "a<|endoftext|>\n b",
             "<|endoftext|", "a \n", "a\n\n", "a  ", " a", "\n a", "a\r\nb", "\U0001F600.,\t x", "é, á. x"]
    texts += ["".join(pick.choices("ab'st.,  \n\t1é\xa0-", k=pick.randrange(1, 60)))
              for _ in range(3000)]
    texts += ["".join(pick.choices("abc.,  \n\n\t\r\x85\u3000", k=pick.randrange(1, 12)))
              for _ in range(20_000)]
    texts += ["".join(pick.choices("abcd.    \n", k=pick.randrange(1, 40)))
              for _ in range(5000)]
    for text in texts:
        assert K.encoder().encode(text) == library(text), repr(text)


def test_special_tokens_as_ordinary_text():
    t = Tokenizer.from_file(public_tokenizers.path(K.TOKENIZER))
    t.encode_special_tokens = True
    mine = K.Encoder(public_tokenizers.path(K.TOKENIZER), plain_special=True)
    for text in ("<|endoftext|>", "a <|endoftext|>\nb"):
        assert mine.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_memory_does_not_change_results(library, monkeypatch):
    monkeypatch.setattr(K, "MEMORY", 3)
    mine = K.Encoder(public_tokenizers.path(K.TOKENIZER))
    for text in ("one two three four  five\nsix", "six five\nfour three two one") * 2:
        assert mine.encode(text) == library(text)


def test_text_ids_are_an_error(make_docs, tmp_path):
    docs = make_docs([(1, "a")]).withColumn("doc_id", F.lit("x"))
    with pytest.raises(AssayError, match="invalid_document_id"):
        K.write(docs, f"{tmp_path}/text")


def test_query_against_the_library(spark, library):
    rows = {r.doc_id: r for r in queries.queries()["op1_token_files"](spark, SMALL).collect()}
    start = 0
    for r in sorted(spark.read.parquet(f"{SMALL}/documents.parquet").collect()):
        ids = library(r.text) + [2]
        m = rows.pop(r.doc_id)
        assert (m.start, m.n_tokens) == (start, len(ids))
        assert m.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not rows


def test_store_round_trip(spark, make_docs, tmp_path, library):
    texts = ["b c", None, "", "b c", "long " * 20_000, "z"]
    docs = make_docs([(5, texts[0]), (None, texts[1]), (3, texts[2]), (5, texts[3]),
                      (4, texts[4]), (-2, texts[5])])
    docs = docs.withColumn("shard", F.lit("clash"))
    store = K.write(docs, f"{tmp_path}/store")
    assert store == K.store_of(f"{tmp_path}/store")
    found = [(d, s, list(ids)) for shard in store["shards"] for d, s, ids in
             K.documents_of(f"{tmp_path}/store", shard["shard"], store["kind"])]
    assert [d for d, _, _ in found] == [None, -2, 3, 4, 5, 5]
    by_id = dict(zip((5, None, 3, 5, 4, -2), texts))
    at = 0
    for d, s, ids in found:
        assert s == at and ids == library(by_id[d]) + [2]
        at += len(ids)
    assert at == store["n_tokens"]
    assert K.read(spark, f"{tmp_path}/store").count() == 6


def test_empty_store(spark, make_docs, tmp_path):
    K.write(make_docs([]), f"{tmp_path}/none")
    assert K.read(spark, f"{tmp_path}/none").count() == 0
