import random

from pyspark.sql import functions as F

from assayer.llm import line_chunks as L


def brute(pairs, least=L.LEAST_WORDS):
    """Lines removed from each document, with texts in place of hashes."""
    docs = sorted({(i is None, i or 0, t) for i, t in pairs if t is not None})
    first, lines_of = {}, {}
    for key in docs:
        for *_, a, b in L.units(key[2]):
            content = "\n".join(key[2].split("\n")[a:b + 1])
            first[content] = min(first.get(content, (key, a)), (key, a))
    for key in docs:
        lines = key[2].split("\n")
        marked = {x for *_, a, b in L.units(key[2]) for x in range(a, b + 1)
                  if first["\n".join(lines[a:b + 1])] != (key, a)}
        gone, run = [], []
        for k in range(len(lines) + 1):
            if k in marked:
                run.append(k)
            else:
                gone += run if sum(len(lines[x].split()) for x in run) >= least else []
                run = []
        lines_of[key] = gone
    return lines_of


def results(df):
    return {r.row.doc_id: r for r in L.clean(df).collect()}


def test_matches_brute_force(make_docs, some_words):
    pick = random.Random(2)
    pool = [" ".join(some_words(s, pick.randrange(0, 24))) for s in range(60)]
    passages = ["\n".join(pick.choices(pool, k=pick.randrange(1, 9))) for _ in range(6)]
    pairs = []
    for k in range(60):
        own = [" ".join(some_words(1000 + 40 * k + j, pick.randrange(1, 30)))
               for j in range(pick.randrange(0, 6))]
        own.insert(pick.randrange(len(own) + 1), pick.choice(passages))
        pairs.append((k, "\n".join(own)))
    pairs += [(90, pairs[3][1]), (90, pairs[3][1]), (91, ""), (92, None), (93, "\n\n"),
              (None, pairs[5][1])]
    want = brute(pairs)
    # The order among equal ids is by hash here and by text there: ids differ above.
    got = results(make_docs(pairs).withColumn("row", F.lit("clash")))
    for i, t in pairs:
        if t is not None:
            assert sorted(got[i].removed) == want[(i is None, i or 0, t)], i
    assert got[92].kept_text is None


def test_passages_go_and_own_lines_stay(make_docs, some_words):
    """A passage of over 50 words, on one line or many, stays in its first document only."""
    for seed, parts in ((1, 1), (2, 3), (3, 12)):
        words = some_words(seed, 60)
        size = -(-60 // parts)
        passage = [" ".join(words[k:k + size]) for k in range(0, 60, size)]
        pairs, own = [], {}
        for k in range(8):
            own[k] = [" ".join(some_words(100 * seed + 10 * k + j, 5 + 4 * j))
                      for j in range(6)]
            at = k % 6
            pairs.append((k, "\n".join(own[k][:at] + passage + own[k][at:])))
        got = results(make_docs(pairs))
        assert got[0].kept_text == pairs[0][1]
        for k in range(1, 8):
            left = got[k].kept_text.split("\n")
            assert [x for x in left if x in own[k]] == own[k]
            assert sum(len(x.split()) for x in left if x in passage) <= 6, (parts, k)


def test_short_formulas_stay(make_docs, some_words):
    pairs = [(k, " ".join(some_words(k, 30)) + "\nReleased under the MIT License.")
             for k in range(20)]
    assert all(not r.removed for r in results(make_docs(pairs)).values())


def test_remove_drops_copies(make_docs, some_words):
    text = "\n".join(" ".join(some_words(s, 20)) for s in range(5))
    other = " ".join(some_words(9, 12))
    out = L.remove(make_docs([(1, text), (2, text), (3, text + "\n" + other), (4, None),
                              (5, "")]))
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert rows == {1: (text, len(text)), 3: (other, len(other)), 4: (None, None), 5: ("", 0)}
    assert L.remove(make_docs([])).count() == 0


def test_every_common_run_goes(make_docs, some_words):
    """Passages of short lines between short lines of their own, against all common runs."""
    pick = random.Random(5)
    docs, passages = [], []
    for m in (4, 5, 6, 8, 13):
        for p in range(8):
            passages.append([" ".join(some_words(1000 * m + 20 * p + j, -(-48 // m), 10 ** 9))
                             for j in range(m)])
    for k in range(160):
        own = [" ".join(some_words(10 ** 6 + 20 * k + j, 5, 10 ** 9)) if j % 5 else ""
               for j in range(12)]
        at = pick.randrange(13)
        docs.append(own[:at] + pick.choice(passages) + own[at:])
    runs = {}
    want = [set() for _ in docs]
    for d, lines in enumerate(docs):
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = "\n".join(lines[a:b + 1])
                if len(run.split()) >= L.LEAST_WORDS and runs.setdefault(run, (d, a)) != (d, a):
                    want[d] |= set(range(a, b + 1))
    got = results(make_docs([(d, "\n".join(lines)) for d, lines in enumerate(docs)]))
    assert sum(map(bool, want)) > 100
    for d, gone in enumerate(want):
        assert gone <= set(got[d].removed), d


def test_equal_lines_cost_their_length(make_docs):
    """What is compared grows with the text for equal, white and alternating lines."""
    for block in (["ab cd"], [""], ["", "\t"], ["ab", "cd"], ["", "\t", " "], ["", "", "ab"]):
        sizes = []
        for n in (3000, 6000):
            lines = ["one two", *(block * n)[:n], *["three four"] * 30, "", ""]
            places = [{"h1": a, "h2": b, "first": x, "last": y}
                      for a, b, x, y in L.units("\n".join(lines))]
            assert len(places) < 9 * n
            sizes.append(sum(len(t) for *_, t in L.unit_texts("\n".join(lines), places)))
        assert sizes[1] < 2.2 * sizes[0] + 100_000, block
    text = "\n".join(["same line"] * 20_000)
    got = results(make_docs([(1, text), (2, "same line"), (3, "\n" * 20_000 + "one word")]))
    assert got[1].kept_text == "same line" and not got[2].removed and not got[3].removed


def test_folded_lines_tell_texts_apart():
    seen = {}
    for text in ("a\na", "a", "2 a", "1 a", "a\n\n", "a\n", "\na", "1 a\n1 a", "a\nb", "b\na"):
        lines = text.split("\n")
        place = {"h1": 1, "h2": 1, "first": 0, "last": len(lines) - 1}
        (_, _, content), = L.unit_texts(text, [place])
        assert seen.setdefault(content, text) == text
