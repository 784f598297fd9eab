"""Jaccard self-join of documents on word n-grams by chosen paths.

A document is the set of its n-grams (n words; a shorter text is one n-gram of all its
words). Documents with equal sets are one class and travel as one. In each of ``runs``
independent runs the sets are split recursively: at every level all sets of a bucket sample
one of their n-grams, the one that a hash function of run and level puts first, and those
that sample the same one stay together. Two sets of similarity s stay together at a level
with probability s. A bucket of at most ``BLOCK`` sets is not split further, nor is one after
``DEPTH`` levels. Buckets are then searched by brute force; one that is still larger is cut
into blocks, and every pair of blocks is searched in a group of its own, so no group holds
more than two blocks and none is cut short.

``runs`` follows from the wanted recall: at the threshold, a pair is missed by a run with
probability 1 - threshold^DEPTH at most, so a pair is lost with less than 1 - RECALL; most
buckets end after one level, where the runs miss next to nothing.

The search in a bucket first compares the samples of all runs and levels, which are already
there, and leaves out sets without a likely partner (a pair at the threshold would have to
agree in less than ``LIKELY`` of the samples, less than one in a million). The texts of the
others are fetched, and similarities are exact counts of common n-grams. A pair counts in the
first run only in which both sets end in the same bucket; groups return one row per set,
never pairs. Links join classes into components by alternating stars.

Defined results: texts without words, NULL included, are linked to nothing and each is a
class of its own; repeated rows are copies; a class is named by its smallest document id
(NULL if all are); only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.common import plain_words, stored, text_hash

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
DEPTH = 3
BLOCK = 128
LIKELY = 0.4
# Word hashes remembered by a Python process.
MEMORY = 150_000

_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def runs_for(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** depth))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


_HASHES: dict[bytes, int] = {}


def grams(text: str | None, n: int = WORDS) -> np.ndarray:
    """Hashes of the distinct n-grams of a text, in order."""
    words = plain_words(text)
    if not words:
        return np.empty(0, np.uint64)
    found = list(map(_HASHES.get, words))
    if None in found:
        if len(_HASHES) > MEMORY:
            _HASHES.clear()
        for k, h in enumerate(found):
            if h is None:
                found[k] = _HASHES[words[k]] = xxhash.xxh64_intdigest(words[k])
    hashes = np.array(found, np.uint64)
    width = min(n, len(hashes))
    rolled = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        rolled = _mixed(rolled * _M + hashes[k:len(hashes) - width + 1 + k])
    return np.unique(rolled)


def samples(sets: np.ndarray, count: int) -> np.ndarray:
    """The n-gram that each of ``count`` hash functions puts first, as its hash."""
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(sets), 2048):
        part = sets[start:start + 2048]
        for k in range(count):
            salt = np.uint64(((2 * k + 1) * 0xD6E8FEB86659FD93) & ((1 << 64) - 1))
            h = (part ^ (salt >> np.uint64(7))) * (salt | np.uint64(1))
            h = (h ^ (h >> np.uint64(32))) * _M
            out[k] = min(out[k], h.min())
    return out


def set_table(docs: DataFrame, doc_id: str, text: str, runs: int, depth: int) -> DataFrame:
    """_id, _hash, key (digest of the set, NULL without words) and the samples of each row."""
    keyed = docs.select(F.col(f"`{doc_id}`").alias("_id"),
                        text_hash(F.col(f"`{text}`")).alias("_hash"),
                        F.col(f"`{text}`").alias("_text"))
    kind = keyed.schema["_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, drawn = [], []
            for value in batch.column(2).to_pylist():
                found = grams(value)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                            if len(found) else None)
                drawn.append(samples(found, runs * depth).astype("<u8").tobytes()
                             if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()),
                 pa.array(drawn, pa.binary())], ["_id", "_hash", "key", "drawn"])

    return keyed.mapInArrow(each, f"_id {kind}, _hash long, key binary, drawn binary")


def _paths(sets: DataFrame, runs: int, depth: int) -> DataFrame:
    """One row per set and run with the buckets it could end in: p1, p2, ..."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            drawn = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8") \
                .reshape(n, runs, depth)
            at = np.repeat(np.arange(n), runs)
            path = np.tile(np.arange(1, runs + 1, dtype=np.uint64), (n, 1))
            columns = []
            for level in range(depth):
                path = _mixed((path ^ drawn[:, :, level]) * _M)
                columns.append(pa.array(path.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)),
                 pa.array(np.tile(np.arange(runs, dtype=np.int32), n)), *columns],
                ["key", "run", *[f"p{k + 1}" for k in range(depth)]])

    names = ", ".join(f"p{k + 1} long" for k in range(depth))
    return sets.select("key", "drawn").mapInArrow(each, f"key binary, run int, {names}")


def buckets(sets: DataFrame, runs: int, depth: int, block: int = BLOCK) -> DataFrame:
    """key, run, bucket and its size ``n``, for buckets of two sets or more."""
    rows, ended = _paths(sets, runs, depth), []
    for level in range(1, depth + 1):
        path = f"p{level}"
        counts = rows.groupBy(path).agg(F.count("*").alias("n")).filter("n > 1")
        shared = stored(rows.join(counts, path), f"paths-{level}")
        end = shared if level == depth else shared.filter(F.col("n") <= block)
        ended.append(end.select("key", "run", F.col(path).alias("bucket"), "n"))
        rows = shared.filter(F.col("n") > block).drop("n")
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out


def _grouped(df: DataFrame, group: str, each: Callable[[dict], dict], schema: str) -> DataFrame:
    """Calls ``each`` with the columns of whole groups, as many groups at a time as a batch
    holds; rows of a group are neighbours in a sorted partition, and only the last group of
    a batch waits for more."""
    names = df.columns
    at = names.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            out = each({n: table.column(n) for n in names})
            if out is not None:
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(at).to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut == 0 and held and held[-1].column(at)[-1].as_py() != ids[0]:
                yield from flush(held)
                held = []
            if cut:
                yield from flush([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from flush(held)

    return df.repartition(group).sortWithinPartitions(group).mapInArrow(run, schema)


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _first_together(ends: np.ndarray, run: np.ndarray, i: np.ndarray,
                    j: np.ndarray) -> np.ndarray:
    """True for pairs that end in one bucket in this run and in no run before it."""
    earlier = np.arange(ends.shape[1])[None, :] < run[i][:, None]
    return ~((ends[i] == ends[j]) & (ends[i] != 0) & earlier).any(axis=1)


def _likely(c: dict) -> pa.RecordBatch | None:
    """Sets of a group with a likely partner that no earlier run brings together."""
    group, bucket = c["grp"].to_numpy(), c["bucket"].to_numpy()
    side, cross = c["side"].to_numpy(), c["cross"].to_numpy()
    drawn, ends = _matrix(c["short"], "<u2"), _matrix(c["ends"], "<i8")
    run = c["run"].to_numpy()
    needed = np.zeros(len(group), bool)
    least = math.ceil(LIKELY * drawn.shape[1])
    for k in range(1, len(group)):
        i = np.flatnonzero(group[:-k] == group[k:])
        if not len(i):
            break
        i = i[(bucket[i] == bucket[i + k]) & (~cross[i] | (side[i] != side[i + k]))]
        i = i[(drawn[i] == drawn[i + k]).sum(axis=1) >= least]
        i = i[_first_together(ends, run, i, i + k)]
        needed[i] = needed[i + k] = True
    chosen = pa.array(np.flatnonzero(needed))
    if not len(chosen):
        return None
    names = ["grp", "bucket", "run", "side", "cross", "key", "ends", "copies"]
    return pa.RecordBatch.from_arrays(
        [c[n].take(chosen).combine_chunks() for n in names], names)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all pairs of sets."""
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1
    column = np.cumsum(several) - 1
    keep = several[at]
    owner, at = owner[keep], column[at[keep]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width, total = 4096, int(several.sum())
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for start in range(0, total, width):
        a, b = np.searchsorted(at, (start, start + width))
        part = np.zeros((len(sets), min(width, total - start)), np.float32)
        part[owner[a:b], at[a:b] - start] = 1
        out += part @ part.T
    return out


def _linked(c: dict, threshold: float) -> pa.RecordBatch | None:
    """For each set of a group: copies of its similar partners, and the least set of those
    it is joined with inside the group."""
    group, bucket = c["grp"].to_numpy(), c["bucket"].to_numpy()
    side, cross, run = c["side"].to_numpy(), c["cross"].to_numpy(), c["run"].to_numpy()
    copies, ends = c["copies"].to_numpy(), _matrix(c["ends"], "<i8")
    keys = c["key"].to_pylist()
    out: tuple[list, list, list] = ([], [], [])
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a < 2:
            continue
        sets = [grams(t) for t in c["text"].slice(a, b - a).to_pylist()]
        size = np.array([len(s) for s in sets], np.float64)
        common = _common(sets)
        near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        near &= bucket[a:b, None] == bucket[None, a:b]
        near &= ~cross[a:b, None] | (side[a:b, None] != side[None, a:b])
        np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        new = _first_together(ends[a:b], run[a:b], i, j)
        near[i[~new], j[~new]] = False
        links = near @ copies[a:b]
        root = np.array(sorted(range(b - a), key=lambda x: keys[a + x])).argsort()
        while True:
            least = np.where(near, root[None, :], b - a).min(axis=1)
            lower = np.minimum(root, least)
            if (lower == root).all():
                break
            root = lower
        by_rank = sorted(keys[a:b])
        for x in np.flatnonzero(links):
            out[0].append(keys[a + x])
            out[1].append(by_rank[root[x]])
            out[2].append(int(links[x]))
    if not out[0]:
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2])],
        ["key", "root", "links"])


def links(docs: DataFrame, sets: DataFrame, classes: DataFrame, doc_id: str, text: str,
          threshold: float, runs: int, depth: int, block: int) -> DataFrame:
    """key, root and links of sets with similar partners, several rows per set."""
    found = stored(buckets(classes, runs, depth, block), "buckets")
    ends = found.groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("run", "bucket"))).alias("by_run"))
    width = runs * depth

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            drawn = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8") \
                .reshape(n, width)
            short = (drawn & np.uint64(0xFFFF)).astype("<u2")
            where = np.zeros((n, runs), "<i8")
            for k, by_run in enumerate(batch.column(3).to_pylist()):
                for run, bucket in by_run:
                    where[k, run] = bucket
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in short], pa.binary()),
                 pa.array([r.tobytes() for r in where], pa.binary()), batch.column(2)],
                ["key", "short", "ends", "copies"])

    cards = classes.join(ends, "key").select("key", "drawn", "copies", "by_run") \
        .mapInArrow(packed, "key binary, short binary, ends binary, copies long")
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = (
        found.withColumn("blocks", F.when(F.col("n") > block, blocks).otherwise(1))
        .withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "run", "bucket",
                F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
                .alias("grp"),
                (F.col("own") != F.col("other")).alias("cross"),
                (F.col("own") <= F.col("other")).alias("side")))
    likely = stored(_grouped(
        rows.join(cards, "key"), "grp", _likely,
        "grp long, bucket long, run int, side boolean, cross boolean, key binary, "
        "ends binary, copies long"), "likely")

    wanted = likely.select("key").distinct().join(
        sets.groupBy("key").agg(F.min(F.struct("_id", "_hash")).alias("one")), "key") \
        .select("key", F.col("one._id").alias("_rid"), F.col("one._hash").alias("_rhash"))
    body = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("text"),
                       text_hash(F.col(f"`{text}`")).alias("_hash"))
    texts = body.join(wanted, body["_id"].eqNullSafe(wanted["_rid"])
                      & (body["_hash"] == wanted["_rhash"])) \
        .select("_id", "_hash", "key", "text").dropDuplicates(["_id", "_hash"]) \
        .select("key", "text")
    return stored(_grouped(
        likely.join(texts, "key"), "grp", lambda c: _linked(c, threshold),
        "key binary, root binary, links long"), "links")


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node and the least node of its component, from edges (a, b).

    Alternating stars: every node hands its larger neighbours to the least one it knows, then
    its smaller ones; each round is written, and the rounds end when nothing changes. Only
    minima are gathered, so a node with many edges is no hot group.
    """
    edges = stored(edges.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").filter("b > a") \
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = stored(large.filter("a != b").distinct(), "large-stars")
        least = _least(large)
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
            .alias("e")).select("e.a", "e.b")
        edges = stored(small.filter("a != b").distinct(), "small-stars")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH,
         block: int = BLOCK) -> DataFrame:
    """One row per document: _id, _hash (of its text), class_id, n_links (other documents of
    the threshold's similarity or more, copies included), n_copies (documents of its set,
    itself included) and first (true for the one row, or its repetitions, that stands for
    the class)."""
    runs = runs_for(threshold, recall, depth)
    sets = stored(set_table(docs, doc_id, text, runs, depth), "sets")
    classes = stored(sets.filter("key IS NOT NULL").groupBy("key").agg(
        F.count("*").alias("copies"), F.first("drawn").alias("drawn"),
        _first_row().alias("head")), "classes")
    found = links(docs, sets.filter("key IS NOT NULL"), classes, doc_id, text, threshold,
                  runs, depth, block)
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    whole = classes.select("key", "copies", "head") \
        .join(roots.withColumnRenamed("node", "key"), "key", "left") \
        .join(counts, "key", "left") \
        .withColumn("root", F.coalesce("root", "key"))
    heads = whole.groupBy("root").agg(F.min("head").alias("first_row"))
    named = whole.join(heads, "root").select(
        "key", "copies", "first_row",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = sets.filter("key IS NULL").select(
        "_id", "_hash", F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("first"))
    return sets.select("_id", "_hash", "key").join(named, "key").select(
        "_id", "_hash", F.col("first_row._id").alias("class_id"), "n_links",
        F.col("copies").alias("n_copies"),
        (F.col("first_row._id").eqNullSafe(F.col("_id"))
         & (F.col("first_row._hash") == F.col("_hash"))).alias("first")).unionByName(alone)


def _first_row() -> Column:
    """The row that stands for a group: the least id, NULL last, then the least hash."""
    return F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                **options) -> DataFrame:
    """One document of each class, in the columns of ``docs``; documents without words stay
    as well, but rows that repeat both id and text are one."""
    kept = join(docs, doc_id, text, **options).filter("first") \
        .select(F.col("_id").alias("_rid"), F.col("_hash").alias("_rhash")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col(f"`{doc_id}`").alias("_id"),
                        text_hash(F.col(f"`{text}`")).alias("_hash"))
    return keyed.join(kept, keyed["_id"].eqNullSafe(kept["_rid"])
                      & (keyed["_hash"] == kept["_rhash"])) \
        .dropDuplicates(["_id", "_hash"]) \
        .select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
