import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.llm import disclosure as D, queries

from ..conftest import SMALL

FORMS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute(text):
    out = []
    for k, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text or ""):
            digits = [int(c) for c in m.group() if c.isascii() and c.isdigit()]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10))
                            for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{FORMS[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def shown(spans):
    return ",".join(f"{D.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_base_matches_the_forms():
    pick = random.Random(7)
    texts = [None, "", "a@b.c_d@e.f", "a@b@c.d", "@x.y", "a@b", "a@b.", "x..y@-.-",
             "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.4", "00000000255.1.1.1",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485 x",
             "é4111111111111111é", "+12+3456789012", "1" * 3000, "a" * 3000 + "@" + "b" * 99,
             "٣.٤.٥.٦", "+1 988 555 24 85."]
    for chars, n in (("a1.@-_% ", 40), ("0123456789 -.", 60), ("+1( ).-0a", 40)):
        texts += ["".join(pick.choices(chars, k=pick.randrange(n))) for _ in range(1500)]
    texts += ["".join(pick.choices("0123456789", k=16)) for _ in range(300)]
    for text in texts:
        assert shown(D.base_spans(text)) == brute(text), repr(text)


def test_query_base(spark):
    rows = {r.doc_id: r for r in queries.queries()["op6_disclosure"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        m, want = rows[r.doc_id], brute(r.text)
        assert m.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (m.n_email, m.n_ip, m.n_card, m.n_phone) == tuple(
            want.count(k + ":") for k, _ in FORMS)
        assert set(want.split(",")) <= set(m.spans.split(",")) | {""}


@pytest.fixture
def corpus(some_words):
    """Falcon stands beside one address only, in contexts of its own; "common" everywhere;
    a copied letter repeats one context."""
    pairs = []
    for k in range(120):
        w = some_words(k, 40, 200)
        text = " ".join(["common", *("abc" + x.translate(str.maketrans(
            "0123456789", "qrstuvxyzk")) for x in w)])
        if k < 7:
            text += f" common Falcon {'pqrstuv'[k] * 4} boss@corp.example meets"
        pairs.append((k, text))
    letter = "dear zebra please write to lone@corp.example thanks"
    return pairs + [(200 + k, letter) for k in range(9)] + [(300, None), (301, ""),
                                                            (None, letter)]


def test_disclosing_terms(make_docs, corpus):
    docs = make_docs(corpus).withColumns({"spans": F.lit("clash"), "near": F.lit(1)})
    text_of = dict(corpus)
    got = {}
    for r in D.find(docs).collect():
        if r._id is not None:
            got[r._id] = sorted(text_of[r._id][s.start:s.end] for s in r.spans
                                if D.KINDS[s.kind] == "term")
    assert all(got[k] == ["Falcon", "meets"] for k in range(7))
    assert not any(v for k, v in got.items() if k >= 7)


def test_disclosing_matches_brute_force(make_docs, corpus, monkeypatch):
    monkeypatch.setattr(D, "HANDED", 0)
    rows = [r.text for r in make_docs(corpus).collect()]
    total, near, held = len(rows), {}, {}
    for text in rows:
        for w in {x.lower() for x in D._WORD.findall(text or "")}:
            held[D._hash(w)] = held.get(D._hash(w), 0) + 1
        for c in D.contexts(text or "", D.base_spans(text)):
            near.setdefault(c["entity"], {}).setdefault(c["context"], set()).add(c["word"])
    import math
    want = set()
    for e, found in near.items():
        words = {w for ws in found.values() for w in ws}
        for w in words:
            n = sum(w in ws for ws in found.values())
            if n >= D.SUPPORT and len(found) < total:
                part = math.log2(n * total / (held[w] * len(found))) / math.log2(
                    total / len(found))
                if part >= D.SHARE:
                    want.add((e, w))
    docs = make_docs(corpus)
    first = D._first_pass(docs, "doc_id", "text").select(F.explode("near").alias("x")).select("x.*")
    got = {(r.entity, r.word) for r in D.disclosing(docs, first).collect()}
    assert got == want and want


def test_sanitise(make_docs, corpus):
    out = {r.doc_id: r for r in D.sanitise(make_docs(corpus)).collect()}
    assert out[0].text.endswith("common [TERM] pppp [EMAIL] [TERM]")
    assert out[200].text == "dear zebra please write to [EMAIL] thanks"
    assert out[300].text is None and out[301].text == "" and len(out) == 132
    assert D.sanitise(make_docs([])).count() == 0


def test_copies_do_not_suppress_terms(make_docs, corpus):
    """A thousand copies of one text, or of one passage in different texts."""
    text_of = dict(corpus)
    passage = text_of[0][-60:]
    for more in ([(1000 + k, text_of[0]) for k in range(1000)],
                 [(1000 + k, f"{'qrstuvxyzk'[k % 10] * (3 + k // 10)} {passage}")
                  for k in range(1000)]):
        rows = {r._id: r for r in D.find(make_docs(corpus + more)).collect()
                if r._id is not None}
        for k in range(7):
            assert "Falcon" in [text_of[k][s.start:s.end] for s in rows[k].spans
                                if D.KINDS[s.kind] == "term"]
