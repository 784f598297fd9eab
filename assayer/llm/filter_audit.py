"""What filters remove alone, in common and in every order, from tables of failing ids.

One pass over the texts gives every row a number and the filters it fails; each filter's failing
numbers are stored as a table of their own. A row that repeats an earlier text is found with a
left-anti join as well: what is left of the rows once the smallest id of each text is taken out.

All rows are then split by one table after the other: the left-semi join keeps those that fail,
the left-anti join those that do not, so after k tables every row has gone through 2k joins, and
not through one join for each of the 2**k sets of filters that may come first. What a prefix of
an order leaves, removes and finds removed already follows from the number of rows with each
set of failed filters: the survivors of the prefix are the sets that are disjoint from it.

Shuffled are numbers, ids and digests (SHA-256) of texts, never texts. No key can be hot: rows
are joined by number, copies by digest and id together, and the smallest id of a text is combined
before the shuffle. Only the list of orders, whose length depends on the filters alone, may be
broadcast.

Defined results: NULL text counts as empty, a NULL part as ''; a condition that is NULL does not
fail; a row without an id is never a copy and has no labels; rows with equal id and text are no
copies of each other; several labels of an id count if one of them says so; an empty table gives
no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.errors import AssayError
from assayer.llm.common import stored

# Orders grow with the factorial of the filters.
MOST_FILTERS = 7
COPIES = "E"
_SPACE = r"[\x20\x09-\x0D]+"


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions of the four filters that look at one text alone."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n_upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * n_upper.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def numbered(docs: DataFrame, fails: dict[str, Column], doc_id: str = "doc_id",
             text: str = "text", part: str = "lang") -> DataFrame:
    """The rows as stored numbers, with id, part, digest of the text and failed filters."""
    failed = F.filter(F.array(*[F.when(c, F.lit(f)) for f, c in fails.items()]),
                      lambda f: f.isNotNull())
    return stored(docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(f"`{doc_id}`").alias("_id"),
        F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"),
        F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("_digest"),
        failed.alias("_failed")), "audit-rows")


def id_tables(rows: DataFrame, names: list[str], copies: str | None = COPIES,
              ) -> dict[str, DataFrame]:
    """One stored table of failing row numbers for each filter, ``copies`` among them."""
    listed = rows.select("_row", F.explode("_failed").alias("_filter"))
    if copies:
        known = rows.where(F.col("_id").isNotNull())
        smallest = known.groupBy("_digest").agg(F.min("_id").alias("_id"))
        later = known.join(smallest, ["_digest", "_id"], "left_anti")
        listed = listed.unionByName(later.select("_row", F.lit(copies).alias("_filter")))
    spark = rows.sparkSession
    path = stored_by(listed, "_filter", "audit-fails")
    found = spark.read.schema("_row long, _filter string").parquet(path)
    return {f: found.where(F.col("_filter") == f).select("_row")
            for f in [*names, *([copies] if copies else [])]}


def stored_by(df: DataFrame, column: str, name: str) -> str:
    """The table written with a folder for each value of a column."""
    from assayer.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(column).parquet(path)
    return path


def patterns(rows: DataFrame, tables: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """Rows by part, bits of the failed filters, and labels."""
    split = rows.select("_row", "_id", "part", F.lit(0).alias("_fails"))
    for k, table in enumerate(tables.values()):
        failing = split.join(table, "_row", "left_semi")
        passing = split.join(table, "_row", "left_anti")
        split = stored(
            failing.withColumn("_fails", F.col("_fails").bitwiseOR(F.lit(1 << k)))
            .unionByName(passing), f"audit-split-{k}")
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    return split.join(marked, "_id", "left").groupBy(
        "part", "_fails", F.coalesce("_good", F.lit(False)).alias("_good"),
        F.coalesce("_toxic", F.lit(False)).alias("_toxic"),
    ).agg(F.count(F.lit(1)).alias("_n"))


def interactions(counted: DataFrame, names: list[str]) -> DataFrame:
    """Every filter after every set of other filters, by part: what it removes, finds removed
    already, and loses of the labelled rows."""
    k = len(names)
    pairs = [(before, 1 << f) for f in range(k) for before in range(1 << k)
             if not before >> f & 1]
    every = counted.withColumn("_p", F.explode(F.array(*[
        F.struct(F.lit(before).alias("before"), F.lit(bit).alias("bit"))
        for before, bit in pairs])))
    fails = F.col("_fails")
    here = fails.bitwiseAND(F.col("_p.bit")) != 0
    earlier = fails.bitwiseAND(F.col("_p.before")) != 0
    removed = here & ~earlier

    def total(rows: Column) -> Column:
        return F.sum(F.when(rows, F.col("_n")).otherwise(0))

    shares = F.create_map(*[F.lit(v) for before in range(1 << k) for v in (
        before, factorial(before.bit_count()) * factorial(max(k - 1 - before.bit_count(), 0)))])
    found = every.groupBy("part", F.col("_p.before").alias("before"),
                          F.col("_p.bit").alias("bit")).agg(
        total(~here & ~earlier).alias("kept"), total(removed).alias("removed"),
        total(here & earlier).alias("redundant"),
        total(fails == F.col("_p.bit")).alias("unique_fails"),
        total(removed & F.col("_good")).alias("good_lost"),
        total(removed & F.col("_toxic")).alias("toxic_lost"))
    return found.withColumn("shapley", F.sum(
        F.col("removed") * shares[F.col("before")].cast("long"),
    ).over(Window.partitionBy("part", "bit")))


def audit(docs: DataFrame, labels: DataFrame, fails: dict[str, Column],
          copies: str | None = COPIES, doc_id: str = "doc_id", text: str = "text",
          part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step.

    ``fails`` holds conditions over the columns of ``docs`` by the names of the filters;
    ``copies`` names the filter that removes texts which a smaller id has.
    """
    names = list(fails)
    if len(names) + bool(copies) > MOST_FILTERS:
        raise AssayError("too_many_filters", f"At most {MOST_FILTERS} filters can be ordered.")
    rows = numbered(docs, fails, doc_id, text, part)
    tables = id_tables(rows, names, copies)
    names = list(tables)
    found = interactions(patterns(rows, tables, labels), names)
    steps = [("".join(names[f] for f in order), step + 1, names[f],
              sum(1 << g for g in order[:step]), 1 << f)
             for order in permutations(range(len(names))) for step, f in enumerate(order)]
    orders = docs.sparkSession.createDataFrame(
        steps, "filter_order string, step int, filter string, before int, bit int")
    return found.join(orders, ["before", "bit"]).select(
        "part", "filter_order", "step", "filter", "kept", "removed", "redundant",
        "unique_fails", "good_lost", "toxic_lost", "shapley")
