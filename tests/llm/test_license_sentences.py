import re

from pyspark.sql import functions as F

from assayer.llm import license_sentences as L

S = L.SENTENCES


def found(make_docs, texts):
    rows = L.scan(make_docs(enumerate(texts))).collect()
    return [r.licenses for r in sorted(rows, key=lambda r: r.doc_id)]


def wrapped(text, width=40):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*out, line])


def test_sentences_hold_an_anchor_and_are_told_apart():
    assert len(L.KNOWN) == len(S) <= 200
    for _, names in L.RULES.values():
        assert re.search(L.ANCHOR, " ".join(S[n] for n in names))


def test_texts_and_notices(make_docs):
    mit = [S["mit-grant"], S["mit-notice"], S["mit-warranty"]]
    bsd = [S["bsd-grant"], S["bsd-source"], S["bsd-binary"]]
    texts = [
        "\n".join(mit), wrapped(" ".join(mit)), wrapped(" ".join(mit)).lower(),
        "\n".join(mit[::-1]), mit[0] + "\n" + mit[1],
        f"{mit[0]}\nOne more.\nAnother.\n{mit[1]}\n{mit[2]}",
        f"{mit[0]}\na.\nb.\nc.\n{mit[1]}\n{mit[2]}",
        "\n".join(bsd), "\n".join([*bsd, S["bsd-names"]]),
        "Some words without an end\nReleased under the MIT License.",
        "Words. Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General "
        "Public License, version 3.",
        "\n".join(S[k] for k in ("apache-notice", "apache-use", "apache-copy")),
        "A text about a license.", "", None, "released under the mit license",
    ]
    assert found(make_docs, texts) == [
        ["MIT"], ["MIT"], ["MIT"], [], [], ["MIT"], [], ["BSD-2-Clause"], ["BSD-3-Clause"],
        ["MIT"], ["CC-BY-NC-4.0", "GPL-3.0"], ["Apache-2.0"], [], [], [], ["MIT"]]


def test_every_rule_matches_its_own_sentences(make_docs):
    rules = list(L.RULES)
    texts = ["\n".join(S[s] for s in L.RULES[r][1]) for r in rules]
    assert found(make_docs, texts) == [[L.RULES[r][0]] for r in rules]


def test_clashing_columns_and_empty_table(make_docs):
    df = make_docs([(1, S["mit-released"])]).withColumns(
        {c: F.lit("mine") for c in ("_row", "_lines", "rules", "known")})
    r = L.scan(df).first()
    assert (r._row, r._lines, r.known, r.rules) == ("mine", "mine", "mine", ["mit-short"])
    assert L.scan(df.limit(0)).count() == 0
