"""SQL forms of the queries, where SQL has one."""

from __future__ import annotations

from assayer.llm import license_sentences, mixing

_SQL: dict[str, str] = {}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_SQL["op10_quality_ledger"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
      FROM d),
p AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
g AS (SELECT r, pos, CASE WHEN count(*) OVER eight = 8
             THEN string_agg(word, ' ') OVER eight END AS win
      FROM p WINDOW eight AS (PARTITION BY r ORDER BY pos
                              ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
k AS (SELECT r, pos, win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 AS twice
      FROM g),
c AS (SELECT r, pos, max(twice::INT) OVER (PARTITION BY r ORDER BY pos
             ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM k),
n AS (SELECT r, sum(hit)::BIGINT AS n_repeat_words FROM c GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)),
                            lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
             length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT
               AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT
               AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_upper
      FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN n USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 4 * n_lines OR 2 * n_upper > word_chars) AS kept,
       ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT
        + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_dup_lines > 4 * n_lines)::INT
        + 16 * (2 * n_upper > word_chars)::INT + 32 * (word_chars < 2 * n_words)::INT
        + 64 * (word_chars > 14 * n_words)::INT)::BIGINT AS fail_bits
FROM m
"""

_SQL["op2_suffix_decontam"] = r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
places AS (SELECT item, ws, least(len(ws), 10) AS n,
                  unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p
           FROM items WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(ws[p:p + n - 1], ' ') AS win FROM places),
sizes AS (SELECT DISTINCT n FROM wins),
runs AS (SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS p, ws FROM words, sizes
         WHERE len(ws) >= n),
found AS (SELECT r, p, x.n, item FROM runs x JOIN wins w
          ON x.n = w.n AND array_to_string(ws[p:p + x.n - 1], ' ') = win),
hit AS (SELECT r, count(DISTINCT q) AS n_hit
        FROM (SELECT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

_SQL["op8_license_sentences"] = license_sentences.scan_sql()

_SQL["op12_filter_audit"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part,
                  coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
      FROM d),
m AS (SELECT doc_id, part, (len(ws) < 200)::INT
             + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
             + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))
                    > 3 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails
      FROM d JOIN w USING (r)),
g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good,
             bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
a AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             count(*) AS n
      FROM m LEFT JOIN g USING (doc_id) GROUP BY ALL),
f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
      FROM f p, f q, f r, f s, f t WHERE p.b | q.b | r.b | s.b | t.b = 31),
s AS (SELECT filter_order, step, bits[step] AS bit,
             coalesce(list_sum(bits[:step - 1]), 0)::INT AS before
      FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
c AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN n ELSE 0 END)::BIGINT
               AS removed,
             sum(CASE WHEN fails & bit <> 0 AND fails & before <> 0 THEN n ELSE 0 END)::BIGINT
               AS redundant,
             sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 AND good THEN n ELSE 0 END)
               ::BIGINT AS good_lost,
             sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 AND toxic THEN n ELSE 0 END)
               ::BIGINT AS toxic_lost
      FROM a, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM c
"""

# The rounds of a permutation over rows x width places, from place y of network input x.
_ROUNDS = f"""
    y // wd AS l0, y % wd AS r0,
    (l0 + ky) % {mixing.PRIME} AS a0, (r0 + (a0 * a0 % {mixing.PRIME} * {mixing.FACTOR} + a0) % {mixing.PRIME}) % wd AS r1,
    (r1 + ky + 1013904) % {mixing.PRIME} AS a1,
    (l0 + (a1 * a1 % {mixing.PRIME} * {mixing.FACTOR} + a1) % {mixing.PRIME}) % rw AS l1,
    (l1 + ky + 2 * 1013904) % {mixing.PRIME} AS a2,
    (r1 + (a2 * a2 % {mixing.PRIME} * {mixing.FACTOR} + a2) % {mixing.PRIME}) % wd AS r2,
    (r2 + ky + 3 * 1013904) % {mixing.PRIME} AS a3,
    (l1 + (a3 * a3 % {mixing.PRIME} * {mixing.FACTOR} + a3) % {mixing.PRIME}) % rw AS l2,
    l2 * wd + r2 AS z
"""

_SQL["op11_mixing"] = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(list_filter(regexp_split_to_array(
    coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no,
             [5, 2, 1][no % 3 + 1]::BIGINT AS w FROM d GROUP BY source),
p AS (SELECT *, coalesce(sum(3 * s) OVER prev, 0) AS ps, coalesce(sum(w) OVER prev, 0) AS pw,
             sum(s) OVER () AS ts, sum(w) OVER () AS tw
      FROM s WINDOW prev AS (ORDER BY s / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * s * (tw - pw) < w * (ts - ps) AS cut FROM p),
e AS (SELECT *, ts - coalesce(sum(CASE WHEN cut THEN 3 * s END) OVER (), 0) AS fs,
             tw - coalesce(sum(CASE WHEN cut THEN w END) OVER (), 0) AS fw FROM c),
t AS (SELECT source, s, no, least((3 * s)::DOUBLE, w * fs::DOUBLE / greatest(fw, 1)::DOUBLE) AS target,
             (s + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS nb FROM e),
k AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target * nb / s + 0.5)::BIGINT, 3 * nb) ELSE 0 END AS ns,
             ceil(sqrt(nb))::BIGINT AS rw, (nb + rw - 1) // greatest(rw, 1) AS wd,
             ((no + 1) * 69621 + {mixing.SEED}) % {mixing.PRIME} AS ky FROM t),
walk AS (
  SELECT no, k, nb, rw, wd, ky, k % nb AS y, false AS moved
  FROM (SELECT no, nb, rw, wd, ky, unnest(range(0, ns)) AS k FROM k)
  UNION ALL
  SELECT no, k, nb, rw, wd, ky, z AS y, true AS moved
  FROM (SELECT *, {_ROUNDS} FROM walk WHERE NOT moved OR y >= nb)),
b AS (SELECT no, y AS block, count(*) AS times FROM walk WHERE moved AND y < nb GROUP BY ALL),
o AS (SELECT d.*, k.no, k.s, k.target, coalesce(sum(size) OVER (
        PARTITION BY k.no ORDER BY doc_id NULLS FIRST, size, r
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
i AS (SELECT r, no, st, size, unnest(range((st // {mixing.BLOCK})::BIGINT,
             ((st + size - 1) // {mixing.BLOCK} + 1)::BIGINT)) AS block FROM o WHERE size > 0),
h AS (SELECT r, sum(times * (least(st + size, (block + 1) * {mixing.BLOCK})
                             - greatest(st, block * {mixing.BLOCK}))) AS taken
      FROM i JOIN b USING (no, block) GROUP BY r)
SELECT doc_id, size, s AS source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM o LEFT JOIN h USING (r)
"""

_SQL["op13_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang,
                  coalesce(source, '') AS source, regexp_extract_all(translate(
                    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term)
      GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total
       FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (total + 2 * v) AS p
      FROM gn JOIN k USING (lang) JOIN v USING (lang)
           LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 2))
                             // (sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT + 2 * any_value(v)) AS q
      FROM c JOIN v USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item,
             sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
             coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
           LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT
      FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part
                                   ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT * FROM z WHERE part = 'pair' OR rank <= 10
"""
