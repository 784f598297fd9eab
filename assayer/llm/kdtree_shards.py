"""Shards of near equal size by a k-d tree over the metadata of documents.

Points of the tree are groups of equal texts, weighted by their bytes, so copies share a
shard; a group too heavy for that (more than a ``PARTS``-th of a shard) is dealt into several
points by id. Every node is split across the dimension in which it is widest (its spread, as
a share of the spread of all points) at the weighted median, or at the share its numbers of
leaves ask for, until every leaf is one shard.

Medians are found together for all nodes of a level: weights are summed in ``BINS`` bins of
the node's range, the bin that holds the median is divided again, and where a bin holds a
single value, points of that value are ordered by a hash. What comes to the driver is one row
per node and bin, never a point. Points are few bytes each and written once per level.

Slots number the documents of a shard without gaps: documents are sorted by shard and id over
many partitions, each counts its own, and prefix sums over the partitions' counts give the
bases.

Defined results: NULL and empty texts have a size of 1; repeated rows are documents of their
own; NULL ids come first; missing or NULL metadata is a value of its own, and so is text that is
no number where a number is wanted; other columns are not read and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.common import stored

PARTS = 8
BINS = 512
# The bin of a median is not divided further below this share of a leaf's weight.
FINE = 0.0005


@dataclass
class _Search:
    """The search for the split of one node."""
    node: int
    dim: int
    low: float
    high: float
    wanted: float          # weight that should lie left of the split
    before: float = 0.0    # weight known to lie left of the bins
    tie: float | None = None  # the value whose points are ordered by hash
    value: float | None = None
    at_tie: float = 0.0

    def done(self) -> bool:
        return self.value is not None


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(-1.0))


def _category(c: Column) -> Column:
    """Text as a number in the order of its first bytes."""
    first = F.rpad(F.hex(F.substring(c.cast("string"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(F.substring(first, 1, 12), 16, 10).cast("double"), F.lit(-1.0))


def _rows(docs: DataFrame, doc_id: str, text: str, numbers: Sequence[str],
          categories: Sequence[str]) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = F.octet_length(body).cast("long") + 1
    dims = [_number(F.col(f"`{c}`")) for c in numbers if c in docs.columns]
    dims += [F.log2(size.cast("double"))]
    dims += [_category(F.col(f"`{c}`")) for c in categories if c in docs.columns]
    return docs.select(
        F.col(f"`{doc_id}`").alias("_id"), size.alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias("_group"), F.array(*dims).alias("_dims"))


def _points(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, float]:
    """Rows with the point they belong to, the points, and their whole weight."""
    groups = stored(rows.groupBy("_group").agg(F.sum("size").alias("w")), "groups")
    total = groups.agg(F.sum("w")).first()[0] or 0
    limit = max(1.0, total / (shards * PARTS))
    # Less than shards * PARTS groups can be heavier than the limit.
    heavy = groups.filter(F.col("w") > limit).select(
        "_group", F.ceil(F.col("w") / limit).cast("int").alias("_parts"))
    pieced = rows.join(F.broadcast(heavy), "_group", "left").withColumn(
        "_part", F.when(F.col("_parts").isNull(), 0).otherwise(
            F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_parts")).cast("int"))).drop("_parts")
    count = len(rows.select("_dims").first()._dims) if total else 0
    points = pieced.groupBy("_group", "_part").agg(
        F.sum("size").alias("w"), *[F.min(F.col("_dims")[k]).alias(f"d{k}")
                                    for k in range(count)])
    points = points.select(
        "_group", "_part", "w", F.array(*[f"d{k}" for k in range(count)]).alias("dims"),
        ((F.xxhash64("_group", "_part", F.lit(2)).bitwiseAND(F.lit((1 << 52) - 1)))
         .cast("double") / float(1 << 52)).alias("tie"),
        F.lit(0).alias("node"))
    return pieced, stored(points, "points"), total


def _ranges(points: DataFrame, count: int) -> dict[int, tuple[float, list, list]]:
    """Weight, minima and maxima of each node."""
    found = points.groupBy("node").agg(
        F.sum("w").alias("w"),
        F.array(*[F.min(F.col("dims")[k]) for k in range(count)]).alias("low"),
        F.array(*[F.max(F.col("dims")[k]) for k in range(count)]).alias("high"))
    return {r.node: (float(r.w), r.low, r.high) for r in found.collect()}


def _narrowed(points: DataFrame, open_: list[_Search], fine: float) -> None:
    """One round: sums the bins of all open searches and keeps the bin of each median."""
    spark = points.sparkSession
    plan = spark.createDataFrame(
        [(s.node, s.dim, s.low, s.high, s.tie) for s in open_],
        "node int, dim int, low double, high double, at double")
    here = points.join(F.broadcast(plan), "node")
    value = F.element_at("dims", F.col("dim") + 1)
    key = F.when(F.col("at").isNull(), value).otherwise(F.col("tie"))
    inside = (F.col("at").isNull() | (value == F.col("at"))) \
        & key.between(F.col("low"), F.col("high"))
    share = (key - F.col("low")) / (F.col("high") - F.col("low"))
    bin_ = F.when(F.col("high") > F.col("low"),
                  F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(0)
    bins = here.filter(inside).groupBy("node", bin_.cast("int").alias("bin")).agg(
        F.sum("w").alias("w"), F.min(key).alias("least"), F.max(key).alias("most"))
    by_node: dict[int, list] = {}
    for r in bins.collect():
        by_node.setdefault(r.node, []).append((r.bin, float(r.w), r.least, r.most))
    for s in open_:
        found = sorted(by_node[s.node])
        for k, (_, w, least, most) in enumerate(found):
            if s.before + w >= s.wanted or k == len(found) - 1:
                break
            s.before += w
        after = found[k + 1][2] if k + 1 < len(found) else float(np.nextafter(most, np.inf))
        if w <= fine or (least == most and s.tie is not None):
            cut = least if s.wanted - s.before < s.before + w - s.wanted else after
            if s.tie is None:
                s.value = cut
            else:
                s.value, s.at_tie = s.tie, cut
        elif least == most:
            s.tie, s.low, s.high = least, 0.0, 1.0
        else:
            s.low, s.high = least, most


def _splits(points: DataFrame, leaves: dict[int, int], first: tuple, count: int,
            fine: float) -> list[_Search]:
    ranges = _ranges(points, count)
    open_ = []
    for node, (weight, low, high) in ranges.items():
        if leaves[node] < 2:
            continue
        spread = [(high[k] - low[k]) / ((first[2][k] - first[1][k]) or 1)
                  for k in range(count)]
        dim = int(np.argmax(spread))
        open_.append(_Search(node, dim, low[dim], high[dim],
                             weight * (leaves[node] // 2) / leaves[node]))
    done = list(open_)
    while left := [s for s in open_ if not s.done()]:
        _narrowed(points, left, fine)
    return done


def tree(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text",
         numbers: Sequence[str] = ("doc_id",),
         categories: Sequence[str] = ("lang", "source")) -> DataFrame:
    """One row per document: _id, size, text_crc32 and its shard, from 0."""
    rows = stored(_rows(docs, doc_id, text, numbers, categories), "shard-rows")
    pieced, points, total = _points(rows, shards)
    if not total:
        return rows.select("_id", "size", "text_crc32", F.lit(0).alias("shard"))
    count = len(points.first().dims)
    first = _ranges(points, count)[0]
    # A node is named by its first leaf, so the left child keeps the name.
    leaves = {0: shards}
    while any(n > 1 for n in leaves.values()):
        found = _splits(points, leaves, first, count, FINE * total / shards)
        plan = docs.sparkSession.createDataFrame(
            [(s.node, s.dim, s.value, s.at_tie, s.node + leaves[s.node] // 2) for s in found],
            "node int, dim int, value double, at_tie double, right int")
        v = F.element_at("dims", F.col("dim") + 1)
        goes_left = (v < F.col("value")) | ((v == F.col("value"))
                                            & (F.col("tie") < F.col("at_tie")))
        points = stored(points.join(F.broadcast(plan), "node", "left").select(
            "_group", "_part", "w", "dims", "tie",
            F.when(F.col("right").isNull() | goes_left, F.col("node"))
            .otherwise(F.col("right")).alias("node")), "points")
        split = {s.node for s in found}
        leaves = {child: n for node, k in leaves.items() for child, n in (
            ((node, k // 2), (node + k // 2, k - k // 2)) if node in split else ((node, 1),))}
    return pieced.join(points.select("_group", "_part", F.col("node").alias("shard")),
                       ["_group", "_part"]).select("_id", "size", "text_crc32", "shard")


def slots(sharded: DataFrame) -> DataFrame:
    """``sharded`` with ``slot``: gapless numbers from 0 within each shard."""
    names = sharded.columns
    shard_at = names.index("shard")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(shard_at).to_numpy()
            places = np.empty(len(ids), np.int64)
            edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                start = seen if ids[a] == last else 0
                places[a:b] = np.arange(start, start + b - a)
                last, seen = ids[a], start + b - a
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(ids), part, np.int32)),
                 pa.array(places)], [*names, "_task", "_place"])

    schema = ", ".join(f"`{n}` {t}" for n, t in sharded.dtypes)
    ordered = sharded.repartitionByRange("shard", "_id").sortWithinPartitions(
        "shard", "_id", "text_crc32")
    placed = stored(ordered.mapInArrow(numbered, f"{schema}, _task int, _place long"), "slots")
    # One row for each partition and shard in it: partitions are ranges, so there are fewer
    # than partitions and shards together.
    base: dict[int, int] = {}
    bases = []
    for r in placed.groupBy("shard", "_task").count().orderBy("shard", "_task").collect():
        bases.append((r.shard, r._task, base.get(r.shard, 0)))
        base[r.shard] = base.get(r.shard, 0) + r["count"]
    table = sharded.sparkSession.createDataFrame(bases, "shard int, _task int, _base long")
    return placed.join(F.broadcast(table), ["shard", "_task"]).select(
        *names, (F.col("_place") + F.col("_base")).alias("slot"))


def assign(docs: DataFrame, shards: int, **options) -> DataFrame:
    """One row per document: _id, size, text_crc32, shard and slot."""
    return slots(tree(docs, shards, **options))
