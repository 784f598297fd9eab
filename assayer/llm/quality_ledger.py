"""Quality rules as a ledger of failure bits, on DataFrame functions only.

``measure`` reads each text once and stores what the rules compare. ``ledger`` evaluates
every rule once and keeps one bit per failed rule. A policy is a named, versioned set of
rules; applying it is a bitwise AND, so policies change without reading texts again, and
``ablations`` tells from counts of the bit patterns what each rule of a policy removes.

Defined results: a NULL text counts as empty; an empty text has no words and fails
``few_words``; repeated rows each get their own verdict; other columns pass through, but a
column named like a measurement is replaced. Nothing is shuffled by ``measure`` and
``ledger``, whatever the length or number of copies of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the contract.
SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
            "n_repeat_words", "n_upper")

# Rules in the order of their bits: each is true for a text that fails it.
RULES = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 4 * n_lines",
    "capitals": "2 * n_upper > word_chars",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}

# Policies by version: once used, a version keeps its rules.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "prose-1": ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals"),
    "prose-2": ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals",
                "short_words"),
}


def mask(policy: str) -> int:
    return sum(BITS[rule] for rule in POLICIES[policy])


def _from(array: str, start: int) -> Column:
    """The elements of an array from position ``start`` on, counted from 0."""
    return F.slice(F.col(array), F.lit(start + 1),
                   F.greatest(F.size(array) - start, F.lit(0)))


def _doubled(df: DataFrame, hashes: str, width: int) -> DataFrame:
    """Hashes of windows of ``width`` words into hashes of windows twice as long."""
    return df.withColumn(hashes, F.zip_with(
        F.slice(F.col(hashes), F.lit(1), F.greatest(F.size(hashes) - width, F.lit(0))),
        _from(hashes, width), lambda a, b: F.xxhash64(a, b)))


def _repeated(df: DataFrame, hashes: str) -> DataFrame:
    """``n_repeat_words``: words in windows that occur twice or more, from the hashes of all
    windows in order.

    Few texts repeat a window at all, so only those are sorted: equal hashes become
    neighbours, and the positions of such windows, in order, each cover up to the next one
    or a whole window. The steps are columns of their own, so each is computed once.
    """
    by_hash = F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(F.col(hashes),
                                 lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    twins = F.zip_with("_sorted", _from("_sorted", 1), lambda a, b: F.when(
        a["h"] == b["h"], F.array(a["p"], b["p"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(
        twins, lambda t: t.isNotNull()))))
    lengths = F.zip_with("_starts", _from("_starts", 1), lambda p, q: F.least(
        F.coalesce(q - p, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(lengths, F.lit(0), lambda s, n: s + n)
    return df.withColumn("_sorted", by_hash).withColumn("_starts", starts) \
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their measurements (``MEASURES``)."""
    own = [c for c in docs.columns if c not in MEASURES]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = docs.select(
        row,
        F.array_remove(F.split(body, SPACES + "+"), "").alias("_words"),
        F.filter(F.split(body, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    counted = split.select(
        "_row", "n_symbols", "n_upper",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
        .alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    width = 1
    while width < WINDOW:
        counted, width = _doubled(counted, "_hashes", width), 2 * width
    return _repeated(counted, "_hashes").select(
        *[F.col("_row").getField(c).alias(c) for c in own], *MEASURES)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with measurements and ``fail_bits``: one bit per rule that fails."""
    bits = F.lit(0).cast("long")
    for name, rule in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BITS[name])).otherwise(0).cast("long"))
    return measure(docs, text).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: str, name: str = "kept") -> DataFrame:
    """A ledger with the verdict of a policy; rules outside the policy have no say."""
    return entries.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def keep(docs: DataFrame, policy: str, text: str = "text") -> DataFrame:
    """The documents, in their columns, that a policy keeps.

    A filter on the verdict itself would be moved below the measurements, with a copy of them
    in every place that reads one; the verdict passes through a generator, which holds the
    filter back.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                         F.col(f"`{text}`").alias("_text"))
    judged = apply_policy(ledger(packed, "_text"), policy, "_passed")
    verdict = judged.select("_doc", F.explode_outer(F.array("_passed")).alias("_verdict"))
    return verdict.filter("_verdict").select(
        *[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: rows that fail it, rows that only it removes, and
    rows the policy would keep without it.

    Rows are first counted by bit pattern, at most one per combination of rules; patterns
    are then compared with the masks.
    """
    whole = mask(policy)
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")) \
        .agg(F.count("*").alias("n"))
    rules = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit"))
        for r in POLICIES[policy]])

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return (
        patterns.withColumn("r", F.explode(rules)).select("bits", "n", "r.rule", "r.bit")
        .groupBy("rule", "bit").agg(
            rows(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            rows(F.col("bits") == F.col("bit")).alias("n_only"),
            rows(F.col("bits").bitwiseAND(F.lit(whole).bitwiseXOR(F.col("bit"))) == 0)
            .alias("n_kept_without"),
        ).select("rule", "n_failed", "n_only", "n_kept_without"))


def summary(entries: DataFrame, *by: str) -> DataFrame:
    """Rows, rules that any row fails and rules that all rows fail, for each group."""
    return entries.groupBy(*by).agg(
        F.count("*").alias("n"), F.bit_or("fail_bits").alias("any_bits"),
        F.bit_and("fail_bits").alias("all_bits"))
