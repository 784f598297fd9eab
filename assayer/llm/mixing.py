"""Mixing of sources to target weights, by blocks of words.

1. Each document's words are counted; a distributed prefix sum lays the documents of a source,
   in the order of their ids, one after the other, and every ``block`` words make a block. A
   document so becomes pieces, and a block holds pieces of one source.
2. Each source gets a target: its weight's share of all words, at most ``most`` times its own;
   what is cut off is shared again by weight. In the order of size by weight the sources that
   are cut come first, so two prefix sums tell all of them at once.
3. A source has as many slots as blocks fill its target. A pseudorandom permutation of all slots
   deals them to output shards of ``shard`` blocks: the numbers of blocks that a shard draws
   from the sources are multinomial, given that every source comes to its target in the end.
   Free draws would miss it by the root of the number of blocks.
4. Prefix sums over the shards number the slots of a source. Slot k takes block
   p(k mod blocks), with a pseudorandom permutation p for each source: no block comes again
   before all others of its source have come, and none more often than ``most`` times.
5. Slots and blocks are joined by source and block number.

Permutations are Feistel networks over a rectangle of about the root of the range on either
side, walked until they hit the range: integers only, nothing is sorted or stored for them, and
equal input gives equal output in every run.

Everything is DataFrame functions. Texts are read once; only ids and numbers are shuffled, and
words only where ``blocks`` is asked for. Documents are dealt by ranges of (source, id), so a
hot source is spread over as many tasks as it needs, and blocks have a bounded number of words.
A few rows stand for many slots, so they are dealt to as many tasks as their slots need, and
joins with slots never broadcast them, which Spark would do by the size of those few rows.
Reaching the driver: two sums, and the number of slots.

Defined results: NULL text has no words, and such documents are never taken; the NULL source is
a source of its own, after all others; equal rows are laid one after the other; an empty table
gives no rows; columns other than id, text and source are not read.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm.common import stored

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SHARD = 4096
SEED = 17
# Slots that one task makes.
TASK_SLOTS = 65_536
_SPACE = r"[\x20\x09-\x0D]+"
# Fixed values of the permutations: a prime below 2**31, a multiplier, the number of rounds,
# and how many steps of a walk are tried before the general form.
PRIME = 2_147_483_647
FACTOR = 16_807
ROUNDS = 4
STEPS = 4


def running(df: DataFrame, by: list[str], order: list[Column], value: Column,
            name: str) -> DataFrame:
    """The rows with the sum of ``value`` over all rows before them, by some columns without
    NULLs: sums within ranges of rows, and prefix sums of the ranges."""
    placed = stored(
        df.withColumn("_value", value).repartitionByRange(*[F.col(c) for c in by], *order)
        .withColumn("_range", F.spark_partition_id()), f"ranges-{name}")
    keys = [*by, "_range"]
    sums = placed.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    base = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn(name, F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    return within.join(base, keys).withColumn(name, F.col(name) + F.col("_base")).drop(
        "_value", "_range", "_base")


def _network(x: Column, rows: Column, width: Column, key: Column) -> Column:
    """A permutation of 0 to ``rows * width - 1``."""
    def mixed(v: Column, j: Column) -> Column:
        a = (v + key + j * 1_013_904) % PRIME
        return (a * a % PRIME * FACTOR + a) % PRIME

    def turn(s: Column, j: Column) -> Column:
        left = F.when(j % 2 == 0, s["l"]).otherwise((s["l"] + mixed(s["r"], j)) % rows)
        right = F.when(j % 2 == 0, (s["r"] + mixed(s["l"], j)) % width).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.call_function("div", x, width).alias("l"), (x % width).alias("r"))
    rounds = F.array(*[F.lit(j).cast("long") for j in range(ROUNDS)])
    return F.aggregate(rounds, start, turn, lambda s: s["l"] * width + s["r"])


def permuted(df: DataFrame, index: Column, size: Column, key: Column, name: str) -> DataFrame:
    """The rows with the place of ``index`` in a pseudorandom permutation of 0 to ``size - 1``.

    ``key`` is a whole number that names the permutation."""
    laid = df.select(
        "*", index.cast("long").alias("_x"), size.cast("long").alias("_n"),
        ((key.cast("long") * 69_621 + SEED) % PRIME).alias("_key"),
        F.ceil(F.sqrt(size)).cast("long").alias("_rows"))
    laid = laid.withColumn("_width", F.expr("(_n + _rows - 1) div greatest(_rows, 1L)"))

    def step(x: Column) -> Column:
        return _network(x, F.col("_rows"), F.col("_width"), F.col("_key"))

    def walked(x: Column, steps: Column) -> Column:
        return F.aggregate(steps, x, lambda y, i: F.when(
            (i > 0) & (y < F.col("_n")), y).otherwise(step(y)))

    laid = laid.withColumn("_y", walked(
        F.col("_x"), F.array(*[F.lit(i) for i in range(STEPS)])))
    # A walk leaves the range for no longer than there are places outside it.
    rest = F.sequence(F.lit(1), (F.col("_rows") * F.col("_width") - F.col("_n")).cast("int"))
    done = F.when(F.col("_y") < F.col("_n"), F.col("_y")).otherwise(walked(F.col("_y"), rest))
    return laid.withColumn(name, done).drop("_x", "_n", "_key", "_rows", "_width", "_y")


class Mixture:
    """The mixture of one table of documents; its tables are made when they are asked for."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
                 block: int = BLOCK, shard: int = SHARD, words: bool = False) -> None:
        self.weights, self.most, self.block, self.shard = weights, most, block, shard
        split = F.array_remove(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), _SPACE), "")
        self.words = ["words"] if words else []
        read = docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
            split.alias("words"))
        self.sized = stored(read.select(
            "doc_id", "source", F.size("words").cast("long").alias("size"), *self.words),
            "mix-sizes")

    @cached_property
    def sources(self) -> DataFrame:
        """Number, weight, words, target, blocks and slots of each source."""
        sums = self.sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        order = [F.col("source").asc_nulls_last()]
        named = running(sums, [], [F.col("source").isNull(), *order], F.lit(1).cast("long"), "no")
        weights = F.array(*[F.lit(w).cast("long") for w in self.weights])
        named = named.withColumn("weight", F.get(
            weights, (F.col("no") % len(self.weights)).cast("int")))
        ceiling = F.col("source_size") * self.most
        rising = [F.col("source_size") / F.col("weight"), F.col("no")]
        named = running(named, [], rising, ceiling, "_words")
        named = stored(running(named, [], rising, F.col("weight"), "_weights"), "mix-sources")
        total = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"),
                          F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()

        def wide(c: Column) -> Column:
            return c.cast("decimal(19,0)")

        cut = (wide(ceiling) * wide(F.lit(total.weight) - F.col("_weights"))
               < wide(F.col("weight")) * wide(F.lit(total.words) - F.col("_words")))
        gone = named.where(cut).agg(F.coalesce(F.sum(ceiling), F.lit(0)).alias("words"),
                                    F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
        words, weight = total.words - gone.words, total.weight - gone.weight
        share = F.col("weight") * F.lit(float(words)) / F.lit(float(weight or 1))
        target = F.least(ceiling.cast("double"), share)
        n_blocks = F.expr(f"(source_size + {self.block - 1}) div {self.block}")
        slots = F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5)
        made = named.withColumn("target", target).withColumn("n_blocks", n_blocks).withColumn(
            "n_slots", F.when(F.col("source_size") > 0, F.least(
                slots.cast("long"), F.col("n_blocks") * self.most)).otherwise(F.lit(0)))
        made = running(made.drop("_words", "_weights"), [], [F.col("no")], F.col("n_slots"),
                       "first_slot")
        return stored(made, "mix-targets")

    @cached_property
    def documents(self) -> DataFrame:
        """The documents with their source's number and target, and where they start in it."""
        numbers = self.sources.select(F.col("source").alias("_source"), "no", "source_size",
                                      "target")
        placed = self.sized.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).drop(
            "_source")
        return running(placed, ["no"], [F.col("doc_id").asc_nulls_first(), F.col("size")],
                       F.col("size"), "start")

    @cached_property
    def n_slots(self) -> int:
        return self.sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]

    @property
    def _tasks(self) -> int:
        return max(-(-self.n_slots // TASK_SLOTS), 1)

    @cached_property
    def draws(self) -> DataFrame:
        """Blocks that each shard draws from each source, with the numbers of their slots and
        their places in the shard."""
        n_slots = self.n_slots
        runs = self.sources.where("n_slots > 0").select(
            "no", "first_slot", "n_slots", "n_blocks",
            F.explode(F.sequence(F.lit(0).cast("long"),
                                 F.expr(f"(n_slots - 1) div {self.shard}"))).alias("_run"))
        runs = runs.repartition(self._tasks, "no", "_run")
        last = F.least(F.col("n_slots"), (F.col("_run") + 1) * self.shard) - 1
        first = F.col("first_slot") + F.col("_run") * self.shard
        slots = runs.select("no", "n_blocks", F.explode(
            F.sequence(first, F.col("first_slot") + last)).alias("_slot"))
        dealt = permuted(slots, F.col("_slot"), F.lit(n_slots), F.lit(0), "_place")
        counts = dealt.groupBy(F.expr(f"_place div {self.shard}").alias("shard"), "no",
                               "n_blocks").agg(F.count(F.lit(1)).alias("n"))
        counts = running(counts, ["no"], [F.col("shard")], F.col("n"), "first")
        in_shard = Window.partitionBy("shard").orderBy("no").rowsBetween(
            Window.unboundedPreceding, -1)
        return counts.select(
            "shard", "no", "n_blocks", "n", "first",
            F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("before"),
            F.least(F.lit(self.shard), F.lit(n_slots) - F.col("shard") * self.shard)
            .alias("shard_size"))

    @cached_property
    def slots(self) -> DataFrame:
        """Each slot: shard, place in it, source, block, and how often the block came before."""
        each = self.draws.repartition(self._tasks, "shard", "no").select(
            "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_i"))
        each = each.withColumn("_k", F.col("first") + F.col("_i"))
        each = permuted(each, F.col("_k") % F.col("n_blocks"), F.col("n_blocks"),
                        F.col("no") + 1, "block")
        return each.withColumn("epoch", F.expr("_k div n_blocks"))

    @cached_property
    def pieces(self) -> DataFrame:
        """Each document's pieces: block, place of its first word there, and words."""
        b = self.block
        end = F.col("start") + F.col("size")
        cut = self.documents.where("size > 0").select("*", F.explode(F.sequence(
            F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))).alias("block"))
        first = F.greatest(F.col("start"), F.col("block") * b)
        return cut.select(
            "no", "block", "doc_id", "size", "source_size", "target", "start",
            (first - F.col("block") * b).alias("at"), (first - F.col("start")).alias("from"),
            (F.least(end, (F.col("block") + 1) * b) - first).alias("n_words"),
            *[F.slice("words", (first - F.col("start") + 1).cast("int"),
                      (F.least(end, (F.col("block") + 1) * b) - first).cast("int"))
              .alias(w) for w in self.words])

    def blocks(self) -> DataFrame:
        """The mixed blocks in the order of shard and slot: source, pieces, and words if they
        were asked for."""
        fields = ["at", "doc_id", "from", "n_words", *self.words]
        filled = self.pieces.groupBy("no", "block").agg(
            F.array_sort(F.collect_list(F.struct(*fields))).alias("pieces"))
        placed = permuted(self.slots, F.col("before") + F.col("_i"), F.col("shard_size"),
                          F.col("shard") + 1_000_003, "slot")
        named = self.sources.select("no", "source")
        return placed.join(filled.hint("merge"), ["no", "block"]).join(named, "no").select(
            "shard", "slot", "source", "block", "epoch", "pieces")

    def taken(self) -> DataFrame:
        """The documents with their size, their source's size and target, and how many of
        their words the mixed blocks hold, repeats counted."""
        times = self.slots.groupBy("no", "block").agg(F.count(F.lit(1)).alias("_times"))
        drawn = self.pieces.join(times.hint("merge"), ["no", "block"], "left")
        held = drawn.groupBy("no", "start", "doc_id", "size", "source_size", "target").agg(
            F.coalesce(F.sum(F.col("n_words") * F.col("_times")), F.lit(0)).alias("taken"))
        columns = ["doc_id", "size", "source_size", "target", "taken"]
        none = self.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        return held.select(*columns).unionByName(none.select(*columns))
