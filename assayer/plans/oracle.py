"""The same results as plain SQL, stated column by column, to check the queries against."""

from __future__ import annotations

from itertools import combinations

from assayer.operators.evaluate import BAD_PROBABILITY, NO_PROBABILITY, NOT_BINARY
from assayer.operators.features import CATEGORICAL_TRANSFORM, NUMERIC_TRANSFORM
from assayer.plans.inputs import DATED, MONTHS_FROM, source_sql

# Kind and type of every column of the inputs whose facts are checked.
KINDS: dict[str, dict[str, tuple[str, str]]] = {
    "lineitem": {
        **{n: ("numeric", "bigint") for n in ("l_orderkey", "l_partkey", "l_suppkey")},
        "l_linenumber": ("numeric", "int"),
        **{n: ("numeric", "double")
           for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")},
        "l_returnflag": ("string", "string"), "l_linestatus": ("string", "string"),
        "l_shipdate": ("datetime", "timestamp_ntz"),
    },
    "gappy_lineitem": {
        **{n: ("numeric", "bigint") for n in ("l_orderkey", "l_partkey", "l_suppkey")},
        "l_linenumber": ("numeric", "int"),
        **{n: ("numeric", "double")
           for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")},
        "l_returnflag": ("string", "string"), "l_linestatus": ("string", "string"),
        "l_shipdate": ("datetime", "timestamp_ntz"),
    },
    "messy_orders": {
        "o_orderkey": ("numeric", "bigint"),
        **{n: ("numeric", "double") for n in ("total_amount", "price", "ratio")},
        **{n: ("string", "string") for n in (
            "order_day", "mixed", "fixed", "nearly", "sparse", "code", "voucher", "note")},
        "big": ("boolean", "boolean"), "o_orderdate": ("datetime", "timestamp_ntz"),
    },
    "repeated_lines": {
        "l_returnflag": ("string", "string"), "l_linestatus": ("string", "string"),
        "l_quantity": ("numeric", "double"),
    },
    "feature_orders": {
        "o_orderkey": ("numeric", "bigint"), "status": ("string", "string"),
        "status_copy": ("string", "string"), "o_totalprice": ("numeric", "double"),
        "o_orderpriority": ("string", "string"), "big": ("boolean", "boolean"),
        "clerk": ("string", "string"), "fixed": ("numeric", "int"),
        "o_orderdate": ("datetime", "timestamp_ntz"), "note": ("string", "string"),
    },
    "edge_orders": {
        "o_orderkey": ("numeric", "bigint"),
        **{n: ("string", "string") for n in ("void", "few", "lone", "two")},
    },
    "part": {
        "p_partkey": ("numeric", "bigint"), "p_name": ("string", "string"),
        "p_brand": ("string", "string"), "p_type": ("string", "string"),
        "p_size": ("numeric", "int"), "p_retailprice": ("numeric", "double"),
    },
    "asked_orders": {
        "o_orderkey": ("numeric", "bigint"), "o_custkey": ("numeric", "bigint"),
        "total_amount": ("numeric", "double"), "o_orderstatus": ("string", "string"),
        "o_orderdate": ("datetime", "timestamp_ntz"), "o_orderpriority": ("string", "string"),
    },
    "wide_lineitem": {
        "l_orderkey": ("numeric", "bigint"), "l_linenumber": ("numeric", "int"),
        **{f"c{k:02d}": ("numeric", "double") for k in range(2, 66)},
        "l_returnflag": ("string", "string"),
    },
    "outlying": {n: ("numeric", "double") for n in ("near_one", "far", "price")},
}

NUMBER = r"[ \t]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf(inity)?))[ \t]*"
INFINITY = "CAST('Infinity' AS DOUBLE)"
WIDTHS = {"bigint": 8, "int": 4, "double": 8, "boolean": 1, "timestamp_ntz": 8}


def _value(name: str, kind: str) -> str:
    if kind == "numeric":
        v = f"CAST({name} AS DOUBLE)"
        return f"CASE WHEN NOT isnan({v}) THEN {v} END"
    return name


def _percent(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE round({part}::DOUBLE / {whole} * 100, 4) END"


def facts(name: str, kinds: dict | None = None, source: str | None = None) -> str:
    """One row per column: single-pass statistics, distinct counts, semantic type."""
    kinds = kinds or KINDS[name]
    source = source or source_sql(name)
    parts = []
    for i, (column, (kind, raw)) in enumerate(kinds.items()):
        number, word, time = kind == "numeric", kind == "string", kind == "datetime"
        day = "try_strptime(v, '%Y-%m-%d')" if word else ("v" if time else "NULL::TIMESTAMP")
        real = f"CASE WHEN abs(v) < {INFINITY} THEN v END" if number else "NULL::DOUBLE"

        def when(shown: bool, sql: str, cast: str) -> str:
            return f"({sql})::{cast}" if shown else f"NULL::{cast}"

        size = "coalesce(sum(strlen(v)), 0)" if word else f"count(v) * {WIDTHS.get(raw, 0)}"
        values = f"(SELECT {_value(column, kind)} AS v FROM {source})"
        parts.append(f"""
SELECT {i} AS ordinal, '{column}' AS "column", '{raw}' AS raw_type, '{kind}' AS kind,
  s.*, coalesce(f.unique_count, 0) AS unique_count, coalesce(f.top_count, 0) AS top_count,
  coalesce(f.bottom_count, 0) AS bottom_count, coalesce(f.rare_count, 0) AS rare_count
FROM (SELECT count(*) AS row_count, count(v) AS non_null_count,
  count(*) - count(v) AS null_count,
  {when(number, 'count(r)', 'BIGINT')} AS finite_count,
  {when(number, 'min(r)', 'DOUBLE')} AS "min", {when(number, 'max(r)', 'DOUBLE')} AS "max",
  {when(number, 'avg(r)', 'DOUBLE')} AS mean,
  {when(number, 'stddev_samp(r)', 'DOUBLE')} AS std,
  {when(number, 'quantile_cont(r, 0.25)', 'DOUBLE')} AS q1,
  {when(number, 'quantile_cont(r, 0.5)', 'DOUBLE')} AS median,
  {when(number, 'quantile_cont(r, 0.75)', 'DOUBLE')} AS q3,
  {when(number, 'count(*) FILTER (v = 0)' if number else '0', 'BIGINT')} AS zero_count,
  {when(number, 'count(*) FILTER (v < 0)' if number else '0', 'BIGINT')} AS negative_count,
  {when(number, f'count(*) FILTER (abs(v) = {INFINITY})' if number else '0', 'BIGINT')}
    AS infinite_count,
  {when(word, "count(*) FILTER (regexp_full_match(v, '-?[0-9]+'))" if word else '0', 'BIGINT')}
    AS plain_integer_count,
  {when(word, f"count(*) FILTER (regexp_full_match(v, '{NUMBER}'))" if word else '0', 'BIGINT')}
    AS number_like_count,
  {when(word or time, 'count(d)', 'BIGINT')} AS date_count,
  min(d)::TIMESTAMP AS min_date, max(d)::TIMESTAMP AS max_date,
  ({size})::BIGINT AS logical_bytes
  FROM (SELECT v, {day} AS d, {real} AS r FROM {values})) s,
 (SELECT count(*) AS unique_count, max(n) AS top_count, min(n) AS bottom_count,
    count(*) FILTER (n = 1) AS rare_count
  FROM (SELECT count(*) AS n FROM {values} WHERE v IS NOT NULL GROUP BY v)) f""")
    united = " UNION ALL ".join(parts)
    return f"""(SELECT *, CASE WHEN kind IN ('boolean', 'numeric', 'datetime') THEN kind
    WHEN kind = 'string' AND non_null_count > 0
      AND plain_integer_count < 0.9 * non_null_count
      AND date_count >= 0.9 * non_null_count THEN 'datetime'
    WHEN kind = 'string' AND row_count > 0 AND unique_count >= 0.95 * row_count
      AND unique_count >= 20 THEN 'text'
    WHEN kind = 'string' THEN 'categorical' ELSE 'unknown' END AS semantic_type,
  {_percent('null_count', 'row_count')} AS null_percentage,
  {_percent('unique_count', 'non_null_count')} AS unique_percentage,
  CASE WHEN kind IN ('string', 'datetime') THEN non_null_count - date_count END
    AS unparseable_count
  FROM ({united}))"""


def duplicates(name: str) -> str:
    columns = ", ".join(KINDS[name])
    return f"""(SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_row_count
      FROM (SELECT count(*) AS n FROM {source_sql(name)} GROUP BY {columns}))"""


def dataset(name: str) -> str:
    """One row, as ``dataset_profile``."""
    width = len(KINDS[name])
    return f"""(SELECT '{name}' AS dataset_id, f.row_count, {width} AS column_count,
      f.logical_bytes, d.duplicate_row_count,
      {_percent('d.duplicate_row_count', 'f.row_count')} AS duplicate_row_percentage,
      f.total_missing_cells,
      {_percent('f.total_missing_cells', f'(f.row_count * {width})')} AS missing_percentage,
      f.columns_with_missing
    FROM (SELECT max(row_count) AS row_count, sum(null_count)::BIGINT AS total_missing_cells,
            count(*) FILTER (null_count > 0) AS columns_with_missing,
            sum(logical_bytes)::BIGINT AS logical_bytes FROM {facts(name)}) f,
         {duplicates(name)} d)"""


def findings(name: str) -> str:
    """All quality findings of one table."""
    share = "(100.0 * {0}::DOUBLE / non_null_count)"
    top, distinct, number = (
        f"round({share.format(c)}, 4)"
        for c in ("top_count", "unique_count", "number_like_count"))
    words = " OR ".join(
        f"contains(lower(\"column\"), '{w}')"
        for w in ("age", "price", "amount", "quantity", "qty", "count", "total"))
    rules = [
        (5, "null_percentage >= 20", "column_high_missing",
         "CASE WHEN null_percentage >= 50 THEN 'critical' ELSE 'warning' END",
         "printf('''%s'' lacks %.4f%% of its values.', \"column\", null_percentage)",
         "null_percentage"),
        (6, "unique_count = 1", "constant_column", "'warning'",
         "printf('''%s'' holds one and the same value everywhere.', \"column\")", "NULL"),
        (7, "unique_count >= 2 AND top_count::DOUBLE / non_null_count >= 0.95",
         "near_constant_column", "'info'",
         f"printf('One value makes up %.4f%% of ''%s''.', {top}, \"column\")", top),
        (8, "semantic_type = 'categorical' AND unique_count::DOUBLE / non_null_count > 0.5",
         "high_cardinality_categorical", "'info'",
         "printf('''%s'' has %d different values in %d filled rows, many for a category.', "
         "\"column\", unique_count, non_null_count)", distinct),
        (9, "kind = 'string' AND number_like_count::DOUBLE / non_null_count "
            "BETWEEN 0.1 AND 0.9", "mixed_type_column", "'warning'",
         "printf('''%s'' holds both numbers and other text; %.4f%% are numbers.', "
         f"\"column\", {number})", number),
        (10, "semantic_type = 'numeric' AND infinite_count > 0", "infinite_values", "'critical'",
         "printf('''%s'' holds %d infinite values.', \"column\", infinite_count)",
         "infinite_count"),
        (11, f"semantic_type = 'numeric' AND negative_count > 0 AND ({words})",
         "unexpected_negative_values", "'warning'",
         "printf('''%s'' holds %d negative values, unexpected under this name.', "
         "\"column\", negative_count)", "negative_count"),
        (12, "semantic_type = 'datetime' AND unparseable_count > 0", "invalid_datetime_values",
         "'warning'", "printf('''%s'' holds %d values that are no dates.', \"column\", "
         "unparseable_count)", "unparseable_count"),
    ]
    by_column = " UNION ALL ".join(f"""
SELECT '{name}' AS dataset_id, ordinal, {rule} AS rule, '{code}' AS code,
  {severity} AS severity, "column", {message} AS message, ({metric})::DOUBLE AS metric
FROM f WHERE non_null_count > 0 AND {when}""" for rule, when, code, severity, message, metric
                                  in rules)
    return f"""(WITH f AS (SELECT * FROM {facts(name)}), d AS (SELECT * FROM {dataset(name)})
SELECT dataset_id, -1 AS ordinal, 3 AS rule, 'duplicate_rows' AS code, 'warning' AS severity,
  NULL::VARCHAR AS "column",
  printf('Rows repeated beyond their first copy: %d.', duplicate_row_count) AS message,
  duplicate_row_count::DOUBLE AS metric FROM d WHERE duplicate_row_count > 0
UNION ALL
SELECT dataset_id, -1, 4, 'missing_values',
  CASE WHEN missing_percentage >= 50 THEN 'critical' WHEN missing_percentage >= 20
    THEN 'warning' ELSE 'info' END, NULL,
  printf('Missing cells: %d, which is %.4f%% of the table.', total_missing_cells,
    missing_percentage), missing_percentage FROM d WHERE total_missing_cells > 0
UNION ALL {by_column})"""


def pairs(name: str) -> str:
    """Pairwise-complete coefficients; pairs without a defined one are dropped."""
    numeric = [c for c, (kind, _) in KINDS[name].items() if kind == "numeric"]
    values = ", ".join(f"{_value(c, 'numeric')} AS {c}" for c in numeric)
    selects = []
    for (a, x), (b, y) in combinations(enumerate(numeric), 2):
        both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
        clean = f"{both} AND abs({x}) < {INFINITY} AND abs({y}) < {INFINITY}"
        selects.append(f"""
SELECT {a} AS a, {b} AS b, '{x}' AS column_a, '{y}' AS column_b,
  CASE WHEN count(*) FILTER ({both}) = count(*) FILTER ({clean})
    THEN corr({x}, {y}) FILTER ({clean}) END AS coefficient,
  count(*) FILTER ({both}) AS observations FROM v""")
    return f"""(WITH v AS (SELECT {values} FROM {source_sql(name)})
SELECT a, b, column_a, column_b, round(coefficient, 6) AS coefficient, observations
FROM ({' UNION ALL '.join(selects)})
WHERE observations >= 3 AND coefficient IS NOT NULL AND NOT isnan(coefficient))"""


def many_pairs(name: str) -> str:
    """As ``pairs``, from one row for each cell; for inputs without infinite values."""
    numeric = [c for c, (kind, _) in KINDS[name].items() if kind == "numeric"]
    cells = ", ".join(f"{c}::DOUBLE" for c in numeric)
    names = ", ".join(f"'{c}'" for c in numeric)
    return f"""(WITH v AS (SELECT row_number() OVER () AS r, * FROM {source_sql(name)}),
l AS (SELECT * FROM (SELECT r, unnest(range({len(numeric)})) AS k, unnest([{cells}]) AS x FROM v)
      WHERE x IS NOT NULL)
SELECT ([{names}])[p.k + 1] AS column_a, ([{names}])[q.k + 1] AS column_b,
  round(corr(p.x, q.x), 6) AS coefficient, count(*) AS observations
FROM l p JOIN l q ON p.r = q.r AND p.k < q.k GROUP BY p.k, q.k
HAVING count(*) >= 3 AND var_pop(p.x) > 0 AND var_pop(q.x) > 0)"""


def ranked_pairs(name: str) -> str:
    return f"""(SELECT '{name}' AS dataset_id, *, row_number() OVER (
      ORDER BY abs(coefficient) DESC, a, b) AS "rank" FROM {pairs(name)})"""


STRENGTH = """(CASE WHEN abs(coefficient) >= 0.7 THEN 'strong'
  WHEN abs(coefficient) >= 0.4 THEN 'moderate' WHEN abs(coefficient) >= 0.2 THEN 'weak'
  ELSE 'very weak or negligible' END
  || CASE WHEN coefficient >= 0 THEN ' positive' ELSE ' negative' END)"""


def histogram(name: str, bins: int = 10) -> str:
    parts = []
    for i, (c, (kind, _)) in enumerate(KINDS[name].items()):
        if kind != "numeric":
            continue
        parts.append(f"""
SELECT {i} AS ordinal, '{c}' AS "column", e.k AS bin_index, e.lo AS bin_start, e.hi AS bin_end,
  count(x.v) AS count
FROM (SELECT range AS k, CASE WHEN range = 0 THEN mn ELSE mn + range * ((mx - mn) / {bins}.0::DOUBLE)
        END AS lo, CASE WHEN range = {bins - 1} THEN mx
          ELSE mn + (range + 1) * ((mx - mn) / {bins}.0::DOUBLE) END AS hi
      FROM (SELECT min(v) AS mn, max(v) AS mx FROM v{i}), range({bins})) e
LEFT JOIN v{i} x ON x.v >= e.lo AND (x.v < e.hi OR (e.k = {bins - 1} AND x.v = e.hi))
GROUP BY ALL""")
    named = ", ".join(
        f"v{i} AS (SELECT v FROM (SELECT {_value(c, kind)} AS v FROM {source_sql(name)}) "
        f"WHERE abs(v) < {INFINITY})"
        for i, (c, (kind, _)) in enumerate(KINDS[name].items()) if kind == "numeric")
    return f"""WITH {named} SELECT ordinal, "column", bin_index::INTEGER AS bin_index,
  round(bin_start, 6) AS bin_start, round(bin_end, 6) AS bin_end, count
FROM ({' UNION ALL '.join(parts)})"""


def top_values(name: str, columns: list[str], limit: int = 10) -> str:
    total = f"(SELECT count(*) FROM {source_sql(name)})"
    united = " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count
FROM {source_sql(name)} WHERE {c} IS NOT NULL GROUP BY {c}""" for c in columns)
    return f"""SELECT "column", place::INTEGER AS "rank", value, count,
  {_percent('count', total)} AS percentage
FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS place
      FROM ({united})) WHERE place <= {limit}"""


def _suitable(task: str) -> str:
    return {
        "binary_classification": "(non_null_count >= 10 AND unique_count = 2)",
        "multiclass_classification": "(non_null_count >= 10 AND unique_count BETWEEN 3 AND 20)",
        "regression": "(non_null_count >= 10 AND semantic_type = 'numeric' "
                      "AND unique_count > 2)",
    }[task]


TASKS = ("binary_classification", "multiclass_classification", "regression")


def suitability(name: str) -> str:
    reasons = {
        "binary_classification":
            "CASE WHEN unique_count = 2 THEN 'There are exactly 2 different values.' ELSE "
            "printf('Needs exactly 2 different values; there are %d.', unique_count) END",
        "multiclass_classification":
            "CASE WHEN unique_count BETWEEN 3 AND 20 THEN printf('There are %d different "
            "values, between 3 and 20.', unique_count) ELSE printf('Needs 3 to 20 different "
            "values; there are %d.', unique_count) END",
        "regression":
            "CASE WHEN semantic_type <> 'numeric' THEN 'Needs a numeric target.' "
            "WHEN unique_count > 2 THEN 'Numeric, with more than 2 different values.' "
            "ELSE 'No more than 2 different numbers: a binary target.' END",
    }
    return " UNION ALL ".join(f"""
SELECT ordinal, "column", '{t}' AS task, {_suitable(t)} AS suitable,
  CASE WHEN non_null_count < 10 THEN printf(
    '%d filled target rows; training takes at least 10.', non_null_count)
  ELSE {reasons[t]} END AS reason FROM {facts(name)}""" for t in TASKS)


def validation(name: str) -> str:
    """(ordinal, column, task, error) and the facts that warnings need."""
    tasks = " UNION ALL ".join(f"SELECT '{t}' AS task" for t in TASKS)
    return f"""(SELECT ordinal, "column", task, non_null_count, unique_count, bottom_count,
  CASE WHEN non_null_count = 0 THEN 'target_all_missing'
    WHEN non_null_count < 10 THEN 'insufficient_rows'
    WHEN task <> 'regression' AND unique_count = 1 THEN 'single_class_target'
    WHEN task = 'binary_classification' AND unique_count <> 2 THEN 'invalid_target_cardinality'
    WHEN task = 'multiclass_classification' AND unique_count NOT BETWEEN 3 AND 20
      THEN 'invalid_target_cardinality'
    WHEN task <> 'regression' AND bottom_count < 2 THEN 'insufficient_class_samples'
    WHEN task = 'regression' AND semantic_type <> 'numeric' THEN 'target_type_incompatible'
  END AS error FROM {facts(name)}, ({tasks}))"""


def split(source: str, key: str, label: str | None) -> str:
    """Rank all rows of a class by hash; the first ``quota`` of them are test rows."""
    group = label or "'all'"
    return f"""(WITH r AS (SELECT *, {group} AS g,
    md5('42|' || length(CAST({key} AS VARCHAR)) || ':' || CAST({key} AS VARCHAR)) AS h
    FROM {source} {f'WHERE {label} IS NOT NULL' if label else ''}),
  c AS (SELECT g, count(*)::HUGEINT AS n FROM r GROUP BY g),
  t AS (SELECT sum(n)::HUGEINT AS total,
          CAST(ceil(sum(n)::DOUBLE * 0.2::DOUBLE) AS HUGEINT) AS tested FROM c),
  b AS (SELECT g, (n * tested) // total AS base, (n * tested) % total AS rest, tested FROM c, t),
  q AS (SELECT g, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, g)
          <= tested - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b)
  SELECT r.*, row_number() OVER (PARTITION BY r.g ORDER BY h) <= quota AS is_test
  FROM r JOIN q ON r.g = q.g)"""


# Least squares on one number and one category over the training rows: the slope is that within
# categories, and each category keeps its mean.
BALANCE = f"""p AS (SELECT * FROM {split('customer', 'c_custkey', None)}),
      g AS (SELECT c_mktsegment, avg(c_nationkey) AS mx, avg(c_acctbal) AS my
            FROM p WHERE NOT is_test GROUP BY c_mktsegment),
      f AS (SELECT sum((c_nationkey - mx) * (c_acctbal - my)) / sum((c_nationkey - mx) ** 2)
              AS slope FROM p JOIN g USING (c_mktsegment) WHERE NOT is_test),
      t AS (SELECT c_custkey, c_acctbal AS label, my + slope * (c_nationkey - mx) AS prediction
            FROM p JOIN g USING (c_mktsegment), f WHERE is_test)"""


def ridge() -> str:
    """Least squares with penalty 1 on a scaled number and the slots of two categories: normal
    equations of centred features over the training rows, solved by conjugate gradients."""
    return f"""WITH RECURSIVE p AS (SELECT * FROM {split('events', 'event_id', None)}),
      m AS (SELECT avg(user_id) AS mu, stddev_pop(user_id) AS sd, avg(value) AS my,
            count(*)::DOUBLE AS n FROM p WHERE NOT is_test),
      x AS (SELECT event_id, is_test, value, unnest([
              {{'slot': 'n', 'x': (user_id - mu) / sd}}, {{'slot': 'e' || event_type, 'x': 1.0}},
              {{'slot': 'p' || props, 'x': 1.0}}], recursive := true) FROM p, m),
      s AS (SELECT slot, sum(x) AS total, sum(x * (value - my)) AS b
            FROM x, m WHERE NOT is_test GROUP BY slot),
      h AS (SELECT a.slot AS a, b.slot AS b, sum(a.x * b.x) AS v FROM x a JOIN x b
            USING (event_id) WHERE NOT a.is_test GROUP BY ALL),
      g AS (SELECT s.slot AS a, list(coalesce(v, 0) - s.total * t.total / n
              + CASE WHEN s.slot = t.slot THEN 1.0 ELSE 0.0 END ORDER BY t.slot) AS line
            FROM s CROSS JOIN s t CROSS JOIN m LEFT JOIN h ON h.a = s.slot AND h.b = t.slot
            GROUP BY s.slot),
      q AS (SELECT list(line ORDER BY slot) AS a, list(b ORDER BY slot) AS b,
              list(slot ORDER BY slot) AS slots FROM s JOIN g ON g.a = s.slot),
      c AS (SELECT 0 AS k, list_transform(b, lambda v: 0.0::DOUBLE) AS w, b AS r, b AS d FROM q
        UNION ALL
        SELECT k + 1, w, r, list_transform(list_zip(r, d), lambda v:
            v[1] + v[2] * list_dot_product(r, r) / rr) FROM (
          SELECT k, rr, d, list_transform(list_zip(w, d), lambda v: v[1] + v[2] * f) AS w,
            list_transform(list_zip(r, ad), lambda v: v[1] - v[2] * f) AS r FROM (
            SELECT *, rr / list_dot_product(d, ad) AS f FROM (
              SELECT k, w, r, d, list_dot_product(r, r) AS rr, list_transform(
                a, lambda line: list_dot_product(line, d)) AS ad FROM c, q
              WHERE k < 300 AND list_dot_product(r, r) > 1e-24 * list_dot_product(b, b))))),
      t AS (SELECT unnest(slots) AS slot, unnest(w) AS weight
              FROM q, (SELECT w FROM c ORDER BY k DESC LIMIT 1)),
      f AS (SELECT any_value(my) - sum(weight * total / n) AS base FROM t JOIN s USING (slot), m)
      SELECT event_id, round(any_value(value), 4) AS label,
        round(any_value(base) + coalesce(sum(weight * x), 0), 4) AS prediction, true AS optimal
      FROM x LEFT JOIN t USING (slot), f WHERE is_test GROUP BY event_id"""


def told_columns(name: str) -> str:
    """The narration of every column of a table without dates."""
    words = [c for c, (kind, _) in KINDS[name].items() if kind == "string"]
    return f"""SELECT '{name}' AS dataset_id, f."column", concat_ws(' ',
        printf('FACT: ''%s'' is stored as %s and reads as %s.', f."column", raw_type,
          semantic_type),
        printf('FACT: %.4f%% of its values are missing; %.4f%% of the others are different.',
          null_percentage, unique_percentage),
        CASE WHEN semantic_type = 'numeric' THEN printf('FACT: least %.4f, greatest %.4f, '
          || 'mean %.4f, median %.4f, deviation %.4f.', "min", "max", mean, median, std) END,
        CASE WHEN semantic_type IN ('categorical', 'text') THEN printf(
          'FACT: ''%s'' is most frequent, in %.4f%% of the rows, among %d values.',
          t.value, t.percentage, unique_count) END,
        printf('INTERPRETATION: the name ''%s'' alone does not tell what the values mean.',
          f."column")) AS narration
      FROM {facts(name)} f LEFT JOIN ({top_values(name, words, 1)}) t
        ON t."column" = f."column" """


def class_metrics(source: str, auc: str) -> str:
    return f"""WITH p AS (SELECT * FROM {source}),
  k AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
  s AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS support,
          (SELECT count(*) FROM p WHERE prediction = c) AS called,
          (SELECT count(*) FROM p WHERE prediction = c AND label = c) AS hits FROM k),
  m AS (SELECT *, CASE WHEN called = 0 THEN 0.0 ELSE hits::DOUBLE / called END AS pr,
          CASE WHEN support = 0 THEN 0.0 ELSE hits::DOUBLE / support END AS re FROM s),
  w AS (SELECT sum(hits)::DOUBLE / sum(support) AS accuracy,
          sum(pr * support) / sum(support) AS prec, sum(re * support) / sum(support) AS rec,
          sum(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END * support)
            / sum(support) AS f1 FROM m)
  SELECT 'accuracy' AS metric, round(accuracy, 6) AS value, NULL::VARCHAR AS reason FROM w
  UNION ALL SELECT 'precision', round(prec, 6), NULL FROM w
  UNION ALL SELECT 'recall', round(rec, 6), NULL FROM w
  UNION ALL SELECT 'f1', round(f1, 6), NULL FROM w
  UNION ALL {auc}"""


def area(source: str, positive: str) -> str:
    """Mann-Whitney with tied scores at their mean rank."""
    return f"""SELECT 'roc_auc' AS metric, round((sum(mid) FILTER (label = '{positive}')
      - pos * (pos + 1) / 2.0) / (pos * (n - pos)::DOUBLE), 6) AS value, NULL::VARCHAR AS reason
    FROM (SELECT label, count(*) OVER () AS n,
        count(*) FILTER (label = '{positive}') OVER () AS pos,
        rank() OVER (ORDER BY probability)
          + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS mid FROM {source})
    GROUP BY n, pos"""


def told_model() -> str:
    """The narration of a line fitted by least squares."""
    facts_of = " || ' FACT: ' || ".join(
        f"'{m} is ' || printf('%.6f', round({m}, 6)) || '.'" for m in ("mae", "mse", "r2", "rmse"))
    return f"""WITH {BALANCE},
      e AS (SELECT label AS y, label - prediction AS e FROM t),
      m AS (SELECT avg(abs(e)) AS mae, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse,
              1 - avg(e * e) / var_pop(y) AS r2, count(*) AS tested FROM e)
      SELECT 'customer' AS dataset_id, 'FACT: ''linear_regression'' learned ''c_acctbal'' '
        || '(regression) from 2 columns, with ' || (SELECT count(*) FROM p WHERE NOT is_test)
        || ' training and ' || tested || ' test rows. FACT: ' || {facts_of}
        || ' INTERPRETATION: these are baseline numbers, no verdict on the model.'
          AS narration FROM m"""


def summary(names: list[str]) -> str:
    """Evidence rows of several tables."""
    return "(" + " UNION ALL ".join(f"""
SELECT d.dataset_id, d.row_count, d.column_count::BIGINT AS column_count,
  d.missing_percentage, d.duplicate_row_percentage, q.n AS quality_finding_count,
  q.critical AS critical_count, q.warning AS warning_count, q.info AS info_count,
  least(30, d.column_count)::BIGINT AS columns
FROM {dataset(n)} d, (SELECT count(*) AS n, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'warning') AS warning,
  count(*) FILTER (severity = 'info') AS info FROM {findings(n)}) q""" for n in names) + ")"


def nodes(name: str, ring: str) -> str:
    """Column nodes; ``ring`` lists (column, order column) of the nodes wanted."""
    return f"""SELECT '{name}' AS dataset_id, r.*, f.semantic_type, f.null_percentage,
  coalesce(w.has_warning, false) AS has_warning, coalesce(w.has_critical, false) AS has_critical,
  CASE WHEN w.has_critical THEN 'error' ELSE 'idle' END AS state
FROM {ring} r JOIN {facts(name)} f ON r."column" = f."column"
LEFT JOIN (SELECT "column", bool_or(severity = 'warning') AS has_warning,
    bool_or(severity = 'critical') AS has_critical FROM {findings(name)}
    WHERE "column" IS NOT NULL GROUP BY "column") w ON w."column" = r."column" """


def touched(name: str) -> str:
    return f"""(SELECT "column", min(t) AS first_touch FROM (
      SELECT column_a AS "column", ("rank" * 2 - 1)::INTEGER AS t FROM {ranked_pairs(name)}
      WHERE "rank" <= 30
      UNION ALL SELECT column_b, ("rank" * 2)::INTEGER FROM {ranked_pairs(name)}
      WHERE "rank" <= 30) GROUP BY "column")"""


def worst_missing(name: str) -> str:
    return f"""(SELECT '{name}' AS dataset_id, "column", null_percentage, null_count, row_count
      FROM {facts(name)} ORDER BY null_percentage DESC, ordinal LIMIT 1)"""


def strongest(name: str) -> str:
    return f"""(SELECT dataset_id, column_a, column_b, coefficient FROM {ranked_pairs(name)}
      WHERE "rank" = 1)"""


def _asked_tables() -> dict[str, str]:
    return {"orders": "asked_orders", "part": "part"}


STATISTIC = """CASE WHEN contains(q, 'average') OR contains(q, 'mean') THEN 'mean'
  WHEN contains(q, 'median') THEN 'median' WHEN contains(q, 'min') THEN 'min'
  WHEN contains(q, 'max') THEN 'max' WHEN contains(q, 'standard deviation') THEN 'std' END"""


def column_stat() -> str:
    columns = " UNION ALL ".join(
        f"SELECT '{d}' AS dataset_id, * FROM {facts(n)}" for d, n in _asked_tables().items())
    return f"""(WITH a AS (SELECT *, lower(question) AS q FROM {source_sql('asked')}),
  s AS (SELECT *, {STATISTIC} AS statistic FROM a),
  m AS (SELECT s.question_id, s.statistic, c.*, row_number() OVER (
          PARTITION BY s.dataset_id, s.question_id ORDER BY c.ordinal) AS place
        FROM s JOIN ({columns}) c ON c.dataset_id = s.dataset_id
          AND regexp_matches(s.q, '\\b' || lower(c."column") || '\\b')
        WHERE s.statistic IS NOT NULL)
  SELECT dataset_id, question_id, "column", statistic, CASE statistic WHEN 'mean' THEN mean
    WHEN 'median' THEN median WHEN 'min' THEN "min" WHEN 'max' THEN "max" ELSE std END AS value
  FROM m WHERE place = 1 AND semantic_type = 'numeric')"""


def routed() -> str:
    by_table = " UNION ALL ".join(f"""
SELECT '{d}' AS dataset_id, p.row_count, p.duplicate_row_count, p.duplicate_row_percentage,
  w."column" AS worst, w.null_percentage AS worst_share, w.null_count AS worst_count,
  s.column_a, s.column_b, s.coefficient
FROM {dataset(n)} p, {worst_missing(n)} w LEFT JOIN {strongest(n)} s ON true"""
                                  for d, n in _asked_tables().items())

    def any_of(*words: str) -> str:
        return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"

    missing = f"{any_of('missing')} AND {any_of('most', 'which', 'highest')}"
    linked = f"{any_of('correlat')} AND {any_of('strong', 'most', 'which', 'highest')}"
    metric = any_of("f1", "accuracy", "precision", "recall", "rmse", "r2", "r-squared", "mae",
                    "mse", "model perform", "baseline model", "how did the model")
    issue = f"{any_of('quality')} AND {any_of('issue', 'problem')}"
    return f"""(WITH k AS ({by_table}), st AS (SELECT * FROM {column_stat()}),
  t AS (SELECT string_agg(metric || '=' || printf('%.6f', value), ', ' ORDER BY metric) AS told
        FROM ({class_metrics(source_sql('flag_predictions'), "SELECT 'x', NULL, NULL")})
        WHERE value IS NOT NULL),
  a AS (SELECT x.question_id, x.dataset_id, lower(x.question) AS q, k.* EXCLUDE (dataset_id),
          st."column" AS col, st.statistic, st.value,
          CASE WHEN x.dataset_id = 'orders' THEN told END AS told
        FROM {source_sql('asked')} x CROSS JOIN t
          LEFT JOIN k ON k.dataset_id = x.dataset_id
          LEFT JOIN st ON st.question_id = x.question_id AND st.dataset_id = x.dataset_id)
  SELECT question_id, dataset_id,
    CASE WHEN row_count IS NULL THEN 'unsupported'
      WHEN {any_of('duplicate')} OR ({missing}) THEN 'deterministic_lookup'
      WHEN {linked} THEN CASE WHEN column_a IS NULL THEN 'unsupported'
        ELSE 'deterministic_lookup' END
      WHEN value IS NOT NULL THEN 'deterministic_lookup'
      WHEN {metric} THEN CASE WHEN told IS NULL THEN 'unsupported'
        ELSE 'deterministic_lookup' END
      WHEN {issue} THEN 'explanation'
      ELSE 'analytical_interpretation' END AS category,
    CASE WHEN row_count IS NULL THEN NULL
      WHEN {any_of('duplicate')} THEN printf('%d rows are copies of another, %.4f%% of %d '
        || 'rows.', duplicate_row_count, duplicate_row_percentage, row_count)
      WHEN {missing} THEN printf('''%s'' misses most: %.4f%%, %d of %d rows.', worst,
        worst_share, worst_count, row_count)
      WHEN {linked} THEN CASE WHEN column_a IS NOT NULL THEN printf(
        '''%s'' and ''%s'' correlate most: %.6f (Pearson).', column_a, column_b, coefficient) END
      WHEN value IS NOT NULL THEN printf('The %s of ''%s'' is %.6f.', statistic, col, value)
      WHEN {metric} THEN 'The model ''fixed'' reported ' || told || '.'
    END AS answer FROM a)"""


def _rounded(columns: list[str], digits: int = 4) -> str:
    doubles = {"min", "max", "mean", "median", "std", "q1", "q3"}
    return ", ".join(
        f'round("{c}", {digits}) AS "{c}"' if c in doubles else f'"{c}"' for c in columns)


def oracle_sql() -> dict[str, str]:
    messy, gappy, feature = "messy_orders", "gappy_lineitem", "feature_orders"
    wide = "wide_lineitem"
    numeric = ["column", "row_count", "null_count", "min", "max", "mean", "median", "std",
               "q1", "q3"]
    numeric_tail = 'round(q3 - q1, 4) AS iqr, zero_count, negative_count, infinite_count'
    stats = ["ordinal", "column", "raw_type", "kind", "row_count", "non_null_count",
             "null_count", "finite_count", "min", "max", "mean", "std", "zero_count",
             "negative_count", "infinite_count", "plain_integer_count", "number_like_count",
             "date_count", "min_date", "max_date", "logical_bytes"]
    usable_feature = f"(SELECT * FROM {source_sql(feature)} WHERE status IS NOT NULL)"
    feature_facts = facts(feature, source=usable_feature)
    parted = split(source_sql(messy), "o_orderkey", None)
    chosen = f"""(SELECT ordinal, "column", kind, unique_count,
      CASE WHEN "column" = 'status_copy' THEN 'duplicate_of_target'
        WHEN semantic_type IN ('text', 'datetime', 'unknown')
          THEN 'unsupported_semantic_type:' || semantic_type
        WHEN unique_count <= 1 THEN 'constant_column' END AS reason, semantic_type
      FROM {feature_facts} WHERE "column" <> 'status')"""
    roles = f"""(SELECT ordinal, "column", CASE WHEN reason IS NOT NULL THEN 'excluded'
        WHEN semantic_type = 'numeric' THEN 'numeric' ELSE 'categorical' END AS role,
      reason, CASE WHEN kind IN ('string', 'boolean') THEN unique_count END AS unique_count
      FROM {chosen})"""
    priced, called = source_sql("flag_predictions"), source_sql("status_predictions")
    return {
        "numeric_profile": f"""SELECT {_rounded(numeric)}, {numeric_tail}
            FROM {facts('lineitem')} WHERE kind = 'numeric'""",
        "numeric_profile_gaps": f"""SELECT {_rounded(numeric)}, {numeric_tail}
            FROM {facts(messy)} WHERE kind = 'numeric'""",
        "value_frequencies": " UNION ALL ".join(f"""
            SELECT {i} AS ordinal, '{c}' AS "column",
              {f"printf('%.4f', {c})" if raw == 'double' else f'CAST({c} AS VARCHAR)'} AS value,
              count(*) AS count FROM {source_sql(gappy)} WHERE {c} IS NOT NULL GROUP BY {c}"""
            for i, (c, (_, raw)) in enumerate(KINDS[gappy].items())),
        "column_stats": f"SELECT {_rounded(stats)} FROM {facts(messy)}",
        "column_common": f"""SELECT ordinal, "column", raw_type, semantic_type, null_count,
            null_percentage, unique_count, unique_percentage FROM {facts(messy)}""",
        "semantic_types": f"""SELECT ordinal, "column", raw_type, semantic_type,
            round(plain_integer_count::DOUBLE / non_null_count, 6) AS integer_share,
            round(date_count::DOUBLE / non_null_count, 6) AS date_share FROM {facts(messy)}""",
        "datetime_layouts": f"""SELECT o_orderkey, CASE
            WHEN o_orderkey % {len(DATED)} >= {MONTHS_FROM}
              THEN CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)
            ELSE CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) END AS read FROM orders""",
        "categorical_profile": f"""SELECT "column", semantic_type, unique_count AS cardinality,
            rare_count AS rare_value_count FROM {facts(messy)}
            WHERE semantic_type IN ('categorical', 'text')""",
        "datetime_profile": f"""SELECT "column", min_date, max_date,
            round((epoch_us(max_date) - epoch_us(min_date)) / 86400000000.0, 4)
              AS date_range_days,
            null_count AS missing_count, unparseable_count FROM {facts(messy)}
            WHERE semantic_type = 'datetime'""",
        "top_values": top_values("part", ["p_name", "p_brand", "p_type"]),
        "top_values_gaps": top_values(messy, ["order_day", "mixed", "nearly", "sparse"]),
        "sample_values": " UNION ALL ".join(f"""
            SELECT {i} AS ordinal, '{c}' AS "column", n::INTEGER AS position, value FROM (
              SELECT CAST({c} AS VARCHAR) AS value, row_number() OVER (ORDER BY c_custkey) AS n
              FROM customer WHERE {c} IS NOT NULL) WHERE n <= 5"""
            for i, c in enumerate(("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                   "c_mktsegment"))),
        "duplicate_rows": f"SELECT * FROM {duplicates('repeated_lines')}",
        "duplicate_texts": """SELECT sum(n)::BIGINT AS row_count,
            sum(n - 1)::BIGINT AS duplicate_row_count
            FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)""",
        "missing_summary": f"""SELECT sum(null_count)::BIGINT AS total_missing_cells,
            round(sum(null_count)::DOUBLE / sum(row_count) * 100, 4) AS missing_percentage,
            count(*) FILTER (null_count > 0) AS columns_with_missing FROM {facts(gappy)}""",
        "structural_facts": f"""SELECT row_count, 3 AS column_count, (SELECT
            sum(null_count)::BIGINT FROM {facts('repeated_lines')}) AS missing_value_count,
            duplicate_row_count FROM {duplicates('repeated_lines')}""",
        "logical_size": f'SELECT "column", raw_type, logical_bytes FROM {facts(messy)}',
        "dataset_profile": f"SELECT * FROM {dataset('repeated_lines')}",
        "eligible_columns": f"""SELECT ordinal, "column", kind = 'numeric' AS eligible,
            non_null_count FROM {facts(messy)}""",
        "column_profile": f"""SELECT '{messy}' AS dataset_id, f.ordinal, f."column",
            semantic_type, null_count, unique_count, least(5, non_null_count)::BIGINT AS samples,
            round(median, 4) AS median, round(q3 - q1, 4) AS iqr, infinite_count,
            CASE WHEN semantic_type IN ('categorical', 'text') THEN unique_count END
              AS cardinality,
            CASE WHEN semantic_type IN ('categorical', 'text') THEN t.value END AS top_value,
            CASE WHEN semantic_type IN ('categorical', 'text') THEN rare_count END
              AS rare_value_count,
            CASE WHEN semantic_type = 'datetime' THEN min_date END AS min_date,
            CASE WHEN semantic_type = 'datetime' THEN unparseable_count END
              AS unparseable_count
            FROM {facts(messy)} f LEFT JOIN ({top_values(messy, [
                c for c, (k, _) in KINDS[messy].items() if k == 'string'], 1)}) t
              ON t."column" = f."column" """,
        "correlation": f"SELECT column_a, column_b, coefficient, observations FROM {pairs(gappy)}",
        "correlation_wide":
            f"SELECT * FROM {many_pairs('wide_lineitem')}",
        "correlation_complete":
            f"SELECT column_a, column_b, coefficient, observations FROM {pairs('lineitem')}",
        "correlation_status": f"""SELECT 'pearson' AS method, 3 AS minimum_observations,
            4 AS eligible_count, count(*) AS pair_count, 'computed' AS status,
            NULL::VARCHAR AS message FROM {pairs(messy)}
            UNION ALL SELECT 'pearson', 3, 1, 0, 'insufficient_data',
              'Correlation needs two numeric columns; there are 1.'""",
        "correlation_strength":
            f"SELECT column_a, column_b, {STRENGTH} AS strength FROM {pairs('part')}",
        "top_correlations": f"""SELECT dataset_id, "rank"::INTEGER AS "rank", column_a, column_b,
            coefficient, observations, {STRENGTH} AS strength FROM {ranked_pairs('lineitem')}
            WHERE "rank" <= 10""",
        "strongest_pair": f"SELECT * FROM {strongest('part')}",
        "histogram": histogram("lineitem"),
        "histogram_gaps": histogram(messy),
        "histogram_skipped": f"""SELECT ordinal, "column",
            CASE kind WHEN 'boolean' THEN 'boolean' WHEN 'numeric' THEN 'no_finite_values'
              ELSE 'non_numeric' END AS reason FROM {facts(messy)}
            WHERE kind <> 'numeric' OR finite_count = 0""",
        "quality_findings": f"""SELECT *, CASE code WHEN 'constant_column' THEN 'value='
            || (SELECT min(fixed) FROM {source_sql(messy)}) END AS details
            FROM {findings(messy)}""",
        "quality_duplicates": f"""SELECT *, CASE code WHEN 'duplicate_rows'
            THEN 'duplicate_row_percentage=' || printf('%.4f', (SELECT duplicate_row_percentage
              FROM {dataset('repeated_lines')})) END AS details
            FROM {findings('repeated_lines')}""",
        "quality_severity_counts": f"""SELECT dataset_id, severity, count(*) AS finding_count
            FROM {findings(messy)} GROUP BY dataset_id, severity""",
        "worst_missing_column": f"SELECT * FROM {worst_missing(messy)}",
        "target_facts": f"""SELECT ordinal, "column", row_count, non_null_count, null_count,
            unique_count, raw_type, semantic_type FROM {facts(feature)}""",
        "task_suitability": suitability(feature),
        "suggested_task": f"""SELECT ordinal, "column", CASE
            {' '.join(f"WHEN {_suitable(t)} THEN '{t}'" for t in TASKS)} END AS suggested_task
            FROM {facts(feature)}""",
        "target_validation": f'SELECT ordinal, "column", task, error FROM {validation(messy)}',
        "target_warnings": f"""SELECT "column", task, CASE WHEN task <> 'regression' THEN
              'The smallest class of ''' || "column" || ''' holds only '
              || printf('%.2f', round(bottom_count::DOUBLE / non_null_count * 100, 2))
              || '% of the rows; read accuracy with care.'
            ELSE printf('''%s'' has only %d different numbers; a binary task may fit better.',
              "column", unique_count) END AS warning
            FROM {validation(messy)} WHERE error IS NULL AND ((task <> 'regression'
              AND bottom_count::DOUBLE / non_null_count < 0.05)
              OR (task = 'regression' AND unique_count <= 2))""",
        "class_distribution": f"""SELECT status AS label, count(*) AS count,
            round(count(*)::DOUBLE / (SELECT count(*) FROM {usable_feature}) * 100, 4)
              AS percentage FROM {usable_feature} GROUP BY status""",
        "usable_rows": f"SELECT o_orderkey, status FROM {usable_feature}",
        "feature_selection": f"SELECT * FROM {roles}",
        "training_warnings": f"""SELECT ordinal, "column", printf('''%s'' has %d categories; '
            || 'one-hot encoding makes as many columns.', "column", unique_count) AS warning
            FROM {roles} WHERE role = 'categorical' AND unique_count > 50""",
        "train_test_split":
            f"SELECT o_orderkey, is_test FROM {split('orders', 'o_orderkey', None)}",
        "stratified_split": f"""SELECT o_orderkey, status, is_test
            FROM {split(source_sql(feature), 'o_orderkey', 'status')}""",
        "preprocess_numeric": f"""WITH p AS (SELECT o_orderkey, is_test, total_amount AS x,
              CASE WHEN abs(ratio) < {INFINITY} THEN ratio END AS y FROM {parted}),
            m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my
                  FROM p WHERE NOT is_test),
            i AS (SELECT o_orderkey, is_test, coalesce(x, mx) AS x, coalesce(y, my) AS y
                  FROM p, m),
            s AS (SELECT avg(x) AS ax, stddev_pop(x) AS sx, avg(y) AS ay, stddev_pop(y) AS sy
                  FROM i WHERE NOT is_test)
            SELECT o_orderkey, round((x - ax) / sx, 5) AS scaled_total_amount,
              round((y - ay) / sy, 5) AS scaled_ratio FROM i, s""",
        "preprocess_categorical": f"""SELECT o_orderkey, coalesce(sparse, (SELECT sparse
              FROM {source_sql(messy)} WHERE sparse IS NOT NULL GROUP BY sparse
              ORDER BY count(*) DESC, sparse LIMIT 1)) AS filled_sparse,
            nearly AS filled_nearly FROM {source_sql(messy)}""",
        "one_hot": """WITH a AS (SELECT o_orderstatus AS v, row_number() OVER (
              ORDER BY o_orderstatus) - 1 AS slot FROM (SELECT DISTINCT o_orderstatus FROM orders
              WHERE o_orderstatus <> 'P')),
            b AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1
              AS slot FROM (SELECT DISTINCT o_orderpriority FROM orders
              WHERE o_orderstatus <> 'P'))
            SELECT o_orderkey, a.slot AS status_slot, b.slot AS priority_slot,
              (SELECT count(*) FROM a) AS status_slots
            FROM orders LEFT JOIN a ON a.v = o_orderstatus LEFT JOIN b ON b.v = o_orderpriority""",
        "one_hot_wide": """WITH p AS (SELECT * FROM part WHERE p_retailprice < 1000),
            n AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS s
                  FROM (SELECT DISTINCT p_name AS v FROM p)),
            b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS s
                  FROM (SELECT DISTINCT p_brand AS v FROM p)),
            t AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS s
                  FROM (SELECT DISTINCT p_type AS v FROM p))
            SELECT p_partkey, n.s AS p_name_index, b.s AS p_brand_index, t.s AS p_type_index,
              (SELECT count(*) FROM n) AS p_name_slots, (SELECT count(*) FROM b) AS p_brand_slots,
              (SELECT count(*) FROM t) AS p_type_slots
            FROM part LEFT JOIN n ON n.v = p_name LEFT JOIN b ON b.v = p_brand
              LEFT JOIN t ON t.v = p_type""",
        "preprocessing_summary": f"""WITH p AS (SELECT * FROM {split(
              'orders', 'o_orderkey', 'o_orderstatus')} WHERE NOT is_test)
            SELECT 'o_custkey' AS "column", 'numeric' AS role, '{NUMERIC_TRANSFORM}' AS transform,
              printf('%.1f', quantile_cont(o_custkey, 0.5)) AS fill,
              round(avg(o_custkey), 4) AS mean, round(stddev_pop(o_custkey), 4) AS scale,
              1::BIGINT AS slots FROM p
            UNION ALL SELECT 'o_totalprice', 'numeric', '{NUMERIC_TRANSFORM}',
              quantile_cont(o_totalprice, 0.5)::VARCHAR, round(avg(o_totalprice), 4),
              round(stddev_pop(o_totalprice), 4), 1 FROM p
            UNION ALL SELECT 'o_orderpriority', 'categorical', '{CATEGORICAL_TRANSFORM}',
              (SELECT o_orderpriority FROM p GROUP BY ALL ORDER BY count(*) DESC, o_orderpriority
               LIMIT 1), NULL, NULL, count(DISTINCT o_orderpriority) FROM p""",
        "forest_exact_fit": f"""SELECT o_orderkey, count(*) OVER (
              PARTITION BY o_custkey, o_orderstatus, o_orderpriority) = 1 AS alone, true AS fitted
            FROM {split('orders', 'o_orderkey', None)} WHERE NOT is_test""",
        "model_predictions_linear_regression": f"""WITH {BALANCE} SELECT c_custkey,
            round(label, 3) AS label, round(prediction, 3) AS prediction FROM t""",
        "model_predictions_ridge_regression": ridge(),
        "linear_regression_wide": f"""SELECT event_id, round(value, 4) AS label, true AS optimal
            FROM {split('events', 'event_id', None)} WHERE is_test""",
        **{f"model_predictions_{n}": f"""SELECT doc_id, toxic AS label, true AS known_class,
            true AS is_probability, true AS learned, true AS calibrated
            FROM {split('(SELECT * FROM documents JOIN labels USING (doc_id))', 'doc_id',
                        'toxic')} WHERE is_test"""
           for n in ("logistic_regression", "random_forest_classifier")},
        "model_predictions_random_forest_regressor": f"""SELECT o_orderkey,
            o_totalprice AS label, true AS in_range, true AS learned
            FROM {split('orders', 'o_orderkey', None)} WHERE is_test""",
        "model_comparison": f"""WITH s AS (SELECT count(*) FILTER (NOT is_test) AS train_size,
              count(*) FILTER (is_test) AS test_size
              FROM {split('orders', 'o_orderkey', 'o_orderstatus')})
            SELECT model, metric, CASE WHEN metric <> 'roc_auc' THEN true END AS is_share,
              CASE WHEN metric = 'roc_auc' THEN '{NOT_BINARY}' END AS reason, train_size, test_size
            FROM s, (VALUES ('logistic_regression'), ('random_forest_classifier')) m(model),
              (VALUES ('accuracy'), ('precision'), ('recall'), ('f1'), ('roc_auc')) t(metric)""",
        "model_result": f"""SELECT 'orders' AS dataset_id, 'o_orderstatus' AS target_column,
            'multiclass_classification' AS task_type, 'logistic_regression' AS model_name,
            'o_custkey,o_totalprice,o_orderpriority' AS features,
            count(*) FILTER (NOT is_test) AS train_size,
            count(*) FILTER (is_test) AS test_size_actual, 0.2::DOUBLE AS test_share,
            42::BIGINT AS seed, true AS stratified, NULL::BIGINT AS depth,
            count(DISTINCT o_orderstatus) * count(DISTINCT o_orderstatus) AS cells,
            count(*) FILTER (is_test) AS counted, 'roc_auc' AS missing
            FROM {split('orders', 'o_orderkey', 'o_orderstatus')}""",
        "narrate_model": told_model(),
        "narrate_columns": told_columns("part"),
        "classification_metrics": class_metrics(priced, area(priced, "O")),
        "classification_metrics_multiclass": class_metrics(
            called, "SELECT 'roc_auc', NULL, 'Not computed for more than two classes.'"),
        "classification_metrics_numeric": class_metrics(
            f"(SELECT CAST(label AS VARCHAR) AS label, CAST(CAST(prediction AS INT) AS VARCHAR) "
            f"AS prediction FROM {source_sql('number_predictions')})",
            f"SELECT 'roc_auc', NULL, '{NO_PROBABILITY}'"),
        "roc_auc_invalid": f"""SELECT 'roc_auc' AS metric, NULL::DOUBLE AS value,
            '{BAD_PROBABILITY}' AS reason""",
        "correlation_outlier":
            f"SELECT column_a, column_b, coefficient, observations FROM {pairs('outlying')}",
        "confusion_matrix": f"""WITH p AS (SELECT * FROM {called}),
            k AS (SELECT label AS c FROM p UNION SELECT prediction FROM p)
            SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM p
              WHERE label = a.c AND prediction = b.c) AS count FROM k a, k b""",
        "roc_auc": area(priced, "O"),
        "regression_metrics": f"""WITH e AS (SELECT label AS y, label - prediction AS e
              FROM {source_sql('price_predictions')}),
            m AS (SELECT avg(abs(e)) AS mae, avg(e * e) AS mse,
              1 - avg(e * e) / var_pop(y) AS r2 FROM e)
            SELECT 'mae' AS metric, round(mae, 6) AS value, NULL::VARCHAR AS reason FROM m
            UNION ALL SELECT 'mse', round(mse, 6), NULL FROM m
            UNION ALL SELECT 'rmse', round(sqrt(mse), 6), NULL FROM m
            UNION ALL SELECT 'r2', round(r2, 6), NULL FROM m""",
        "csv_ingest": """SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey,
            CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS c_acctbal,
            CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer""",
        "csv_quoted": """SELECT conv_id, turn, role, replace(replace(text, '. ', '.' || chr(10)),
            ' the ', ' "the", ') AS text FROM conversations""",
        "csv_encodings": "SELECT c_custkey, c_name || ' Jos\u00e9 \u00df' AS c_name FROM customer",
        "file_screen": f"""SELECT path, name, length, CASE WHEN trim(name) = ''
              THEN 'missing_filename' WHEN lower(name) NOT LIKE '%.csv' THEN 'unsupported_file_type'
              WHEN length = 0 THEN 'empty_file' WHEN length > 52428800 THEN 'file_too_large' END
              AS verdict FROM {source_sql('uploads')}""",
        "binary_screen": f"""SELECT path, length, CASE WHEN length(s) > 0 AND (length(s)
              - length(regexp_replace(s, '[^\x20-\x7E\t\n\r\x0B\x0C]', '', 'g')))::DOUBLE
              / length(s) > 0.3 THEN 'unsupported_content' END AS verdict
            FROM (SELECT path, length, substring(text, 1, 4096) AS s
                  FROM {source_sql('uploads')})""",
        "infer_types": " UNION ALL ".join(f"""
            SELECT {i} AS ordinal, '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'double'
              WHEN bool_and(regexp_full_match({c}, '[+-]?[0-9]+')) THEN
                CASE WHEN bool_and({c} IS NULL OR TRY_CAST({c} AS BIGINT) IS NOT NULL) THEN 'bigint'
                  WHEN bool_and({c} IS NULL OR TRY_CAST({c} AS DECIMAL(20, 0)) IS NOT NULL)
                    THEN 'decimal(20,0)' ELSE 'string' END
              WHEN bool_and(regexp_full_match({c}, '{NUMBER}')) THEN 'double'
              WHEN bool_and({c} IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false'))
                THEN 'boolean' ELSE 'string' END AS inferred_type,
              count(*) AS row_count, count({c}) AS non_null_count
            FROM {source_sql('text_orders')}""" for i, c in enumerate(
                ("whole", "number", "truth", "word", "huge", "blank", "unsigned"))),
        "malformed_rows": """SELECT concat_ws(',', c_custkey, c_name, c_mktsegment, 'x') AS line,
            4::BIGINT AS field_count FROM customer WHERE c_custkey % 13 = 0""",
        "catalog": " UNION ALL ".join(f"""
            SELECT '{t}' AS id, '{t}.parquet' AS original_filename, count(*) AS row_count,
              {width}::BIGINT AS column_count, 0::BIGINT AS missing_value_count,
              (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})))::BIGINT
                AS duplicate_row_count,
              {'count(*)' if t == 'part' else 'NULL::BIGINT'} AS reopened_rows FROM {t}"""
            for t, width in (("customer", 5), ("part", 6), ("supplier", 4))),
        "evidence_summary": f"SELECT * FROM {summary([messy, 'repeated_lines'])}",
        "evidence_quality": f"""SELECT dataset_id, finding_count, place::INTEGER AS place, code,
            severity, "column", message, metric FROM (SELECT *, count(*) OVER ()
              AS finding_count, row_number() OVER (ORDER BY ordinal, rule) AS place
              FROM {findings(messy)}) WHERE place <= 20""",
        "evidence_column": f"""SELECT '{gappy}' AS dataset_id, "column", semantic_type,
            null_count, null_percentage, unique_count, round(mean, 4) AS mean,
            round(median, 4) AS median, round(std, 4) AS std FROM {facts(gappy)}
            WHERE "column" = 'l_tax'""",
        "evidence_model": """SELECT event_type,
            CASE WHEN event_type = 'error' THEN 'ml_result_malformed' END AS error,
            CASE WHEN event_type = 'error' THEN 'metrics' ELSE '' END AS missing,
            CASE WHEN event_type <> 'error' THEN 'fixed' END AS model_name,
            CASE WHEN event_type <> 'error' THEN count(*) END AS train_size,
            CASE WHEN event_type <> 'error' THEN round(avg(abs(value - 30.0)), 4) END AS mae
            FROM events GROUP BY event_type""",
        "narrate_profile": f"""SELECT dataset_id, concat_ws(' ',
            'FACT: ' || row_count || ' rows and ' || column_count || ' columns.',
            printf('FACT: %.4f%% of the cells are empty and %.4f%% of the rows are copies.',
              missing_percentage, duplicate_row_percentage),
            CASE WHEN quality_finding_count = 0 THEN 'FACT: no quality finding.' ELSE
              printf('FACT: %d quality findings: %d critical, %d warnings, %d notes.',
                quality_finding_count, critical_count, warning_count, info_count) END,
            'INTERPRETATION: what the table is about is not part of this evidence.')
              AS narration FROM {summary([messy, 'repeated_lines'])}""",
        "narrate_quality": f"""SELECT dataset_id, printf('FACT: %d quality findings. ', count(*))
            || string_agg('FACT (' || severity || ')' || coalesce(' on ''' || "column" || '''',
              '') || ': ' || message, ' ' ORDER BY ordinal, rule)
            || ' INTERPRETATION: whether they matter depends on the use of the table.'
              AS narration FROM {findings('repeated_lines')} GROUP BY dataset_id""",
        "quality_empty": """SELECT 'no_rows' AS dataset_id, -1 AS ordinal, 2 AS rule,
            'empty_dataset' AS code, 'info' AS severity, NULL::VARCHAR AS "column",
            'The table has columns but not a single row.' AS message
            FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey IS NULL) WHERE n = 0
            UNION ALL SELECT 'no_columns', -1, 1, 'zero_columns', 'critical', NULL,
            'The table has no columns at all.'""",
        "target_edges": f'SELECT ordinal, "column", task, error FROM {validation("edge_orders")}',
        "narrate_quality_clean": f"""SELECT 'part' AS dataset_id, CASE WHEN count(*) = 0
            THEN 'FACT: no quality finding. '
            || 'INTERPRETATION: no rule was broken; that does not make the values right.'
            ELSE printf('FACT: %d quality findings. ', count(*)) END AS narration
            FROM {findings('part')}""",
        "narrate_correlation": f"""SELECT dataset_id, printf(
            'FACT: Pearson''s coefficient, %d column pairs. ', count(*)) || string_agg(printf(
              'FACT: ''%s'' and ''%s'' have a coefficient of %.6f over %d rows, a %s association.',
              column_a, column_b, coefficient, observations, {STRENGTH}), ' ' ORDER BY "rank")
              FILTER ("rank" <= 5)
            || ' INTERPRETATION: an association in the numbers says nothing about causes.'
              AS narration FROM {ranked_pairs('part')} WHERE "rank" <= 10 GROUP BY dataset_id""",
        "route_questions": f"SELECT * FROM {routed()}",
        "route_column_stat": f"""SELECT dataset_id, question_id, "column", statistic,
            round(value, 4) AS value FROM {column_stat()}""",
        "narrate_answers": f"""SELECT question_id, CASE WHEN category = 'unsupported'
            THEN 'The evidence at hand holds nothing on this question.'
            WHEN answer IS NOT NULL THEN 'FACT: ' || answer
            ELSE 'The evidence at hand does not settle this question.' END AS narration
            FROM {routed()}""",
        "feature_nodes": nodes(messy, f'(SELECT ordinal, "column" FROM {facts(messy)})'),
        "correlation_edges": f"""SELECT dataset_id, "rank"::INTEGER AS "rank",
            column_a AS source, column_b AS target, coefficient, observations
            FROM {ranked_pairs('lineitem')} WHERE "rank" <= 30""",
        "correlated_columns":
            f"SELECT 'lineitem' AS dataset_id, * FROM {touched('lineitem')}",
        "analytics_nodes": nodes(messy, touched(messy)),
        "column_search": f"""SELECT * FROM ({nodes(
            wide, f'(SELECT ordinal, "column" FROM {facts(wide)})')})
            WHERE contains(lower("column"), 'c6') ORDER BY ordinal LIMIT 8""",
        "column_filter": f"""SELECT * FROM ({nodes(
            messy, f'(SELECT ordinal, "column" FROM {facts(messy)})')})
            WHERE null_percentage > 0 OR has_warning OR has_critical
              OR "column" IN (SELECT "column" FROM {roles} WHERE role <> 'excluded')
              OR "column" IN (SELECT "column" FROM {touched(messy)})""",
        "column_filter_kind": f"""SELECT * FROM ({nodes(
            messy, f'(SELECT ordinal, "column" FROM {facts(messy)})')})
            WHERE semantic_type = 'categorical' AND contains(lower("column"), 'e')""",
    }
