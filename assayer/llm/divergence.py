"""How sources of a language differ in their words, by an exact recount in dense slots.

1. A first pass counts in how many documents of a language each term stands; tasks combine
   their counts before the shuffle. Terms below ``least`` documents go.
2. The kept terms are hashed into shards of about ``SHARD_TERMS``. A task gives each shard a
   minimal perfect hash: terms fall into small buckets, and each bucket gets the first
   displacement that sends its terms to free slots. The terms themselves are stored in the order
   of their slots.
3. A second pass over the texts gets the shards as a broadcast. A term's slot is computed and the
   stored term compared with it, so terms that were not kept are told from those that were. Tasks
   add to one dense array for each (language, source) and give what they hold whenever it
   reaches ``HELD_CELLS``.
4. Counts are added up by (language, source, shard); every shard then yields the sums of its
   terms for all pairs of sources, and its best terms of every source; sums and ranks of those
   end the work.

The broadcast is bounded: shards above ``PASS_BYTES`` in all are counted in further passes, one
after the other, each with a table of its own, and a broadcast is given up when its pass is
done. The driver holds the sizes of the shards, and the shards of one pass. A hot source or
term is no hot key: rows of both passes are combined per task, by batches. A task of the last
step holds one number for each source of a language and term of a shard. All arithmetic is in
whole numbers and exact up to 9 * 10**15 terms in a language.

Defined results: NULL text, language and source count as empty; a group without terms has
pairs and no terms; repeated rows count again; a language without kept terms gives pairs of value
0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assayer.llm.common import stored

LEAST = 10
TOP = 10
SCALE = 1_000_000_000
SHARD_TERMS = 4096
PASS_BYTES = 64 << 20
# Terms a task counts in the first pass, and cells of arrays in the second, before it gives them.
HELD_TERMS = 300_000
HELD_CELLS = 6_000_000
SEEDS = 1000
LARGEST = (1 << 31) - 256
# Marks a bucket that names its slot.
DIRECT = np.uint32(1 << 31)
# Letters in lower case; every other ASCII character ends a term.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM_BYTES).split() if text else []


def _hashes(terms: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each term."""
    packed = b"".join(map(xxhash.xxh3_128_digest, terms))
    return np.frombuffer(packed, "<u8").reshape(-1, 2)


def _seeded(hashes: np.ndarray, seed: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stride of each hash under a seed."""
    salt = np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    start = (hashes[:, 0] ^ salt) * np.uint64(0xD6E8FEB86659FD93)
    stride = (hashes[:, 1] + salt) * np.uint64(0xCA5A826395121157)
    return start ^ (start >> np.uint64(32)), stride ^ (stride >> np.uint64(29))


def _slots(hashes: np.ndarray, seed: np.ndarray | int, n: np.ndarray | int,
           displacement: np.ndarray) -> np.ndarray:
    start, stride = _seeded(hashes, seed)
    n = np.asarray(n, np.uint64)
    turn, shift = displacement.astype(np.uint64) // n, displacement.astype(np.uint64) % n
    moved = (start % n + turn * (stride % n) + shift) % n
    return np.where(displacement & DIRECT, (displacement & ~DIRECT).astype(np.uint64), moved)


def _buckets(hashes: np.ndarray, seed: np.ndarray | int, count: np.ndarray | int) -> np.ndarray:
    start, stride = _seeded(hashes, seed)
    return ((start >> np.uint64(24)) ^ (stride >> np.uint64(16))) % np.asarray(count, np.uint64)


def buckets_for(n: int) -> int:
    return n // 4 + 1


def perfect(hashes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Seed and displacements of a minimal perfect hash, and the slot of each hash.

    Large buckets come first; a bucket of one term names its slot. A displacement is a number
    of strides and a shift; a bucket that none of them sends to free slots makes the seed
    change."""
    n, count = len(hashes), buckets_for(len(hashes))
    for seed in range(SEEDS):
        start, stride = _seeded(hashes, seed)
        start, stride = (start % np.uint64(n)).astype(np.int64), (stride % np.uint64(n)).astype(
            np.int64)
        bucket = _buckets(hashes, seed, count).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(count + 1))
        free, slots = np.ones(n, bool), np.empty(n, np.int64)
        displacement = np.zeros(count, np.uint32)
        for b in np.argsort(edges[:-1] - edges[1:], kind="stable"):
            members = order[edges[b]:edges[b + 1]]
            if not len(members):
                break
            if len(members) == 1:
                slots[members] = left = int(free.argmax())
                displacement[b] = DIRECT | np.uint32(left)
            else:
                d = _displacement(start[members], stride[members], free, n)
                if d is None:
                    break
                displacement[b] = d
                slots[members] = (start[members] + d // n * stride[members] + d % n) % n
            free[slots[members]] = False
        if not free.any():
            return seed, displacement, slots
    raise ValueError("no perfect hash found; are there equal terms?")


def _displacement(start: np.ndarray, stride: np.ndarray, free: np.ndarray, n: int) -> int | None:
    """The first displacement that sends a bucket to different free slots."""
    width = 128
    for low in range(0, min(n * n, LARGEST), width):
        d = np.arange(low, low + width)[:, None]
        places = (start + d // n * stride + d % n) % n
        good = free[places].all(axis=1)
        if good.any():
            ordered = np.sort(places, axis=1)
            good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
        if good.any():
            return low + int(good.argmax())
    return None


class Shards:
    """Shards of one language: slots of terms, told from terms that are in none of them."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r["shard"])
        self.n_shards = rows[0]["n_shards"]
        self.numbers = np.array([r["shard"] for r in rows])
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.seed = np.array([r["seed"] for r in rows], np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        counts = np.array([buckets_for(k) for k in self.n])
        self.first_bucket = np.concatenate([[0], np.cumsum(counts)])
        self.counts = counts
        self.displacement = np.concatenate(
            [np.frombuffer(r["displacement"], "<u4") for r in rows])
        self.terms: list[bytes] = []
        for r in rows:
            self.terms += bytes(r["terms"]).split(b" ")
        self.row_of = np.full(self.n_shards, -1)
        self.row_of[self.numbers] = np.arange(len(rows))

    @property
    def size(self) -> int:
        return len(self.terms)

    def slots(self, terms: list[bytes]) -> list[int | None]:
        """Dense slot of each term, None for one that is not stored."""
        if not terms:
            return []
        hashes = _hashes(terms)
        row = self.row_of[(hashes[:, 1] % np.uint64(self.n_shards)).astype(np.int64)]
        known = np.flatnonzero(row >= 0)
        row, hashes = row[known], hashes[known]
        seed = self.seed[row]
        bucket = self.first_bucket[row] + _buckets(hashes, seed, self.counts[row]).astype(np.int64)
        slot = self.first[row] + _slots(hashes, seed, self.n[row],
                                        self.displacement[bucket]).astype(np.int64)
        out: list[int | None] = [None] * len(terms)
        for k, s in zip(known.tolist(), slot.tolist(), strict=True):
            if self.terms[s] == terms[k]:
                out[k] = s
        return out


def _groups(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source"),
        F.col(f"`{text}`").cast("binary").alias("text"))


def _documents_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of documents of each term, by language, combined as far as memory allows."""
    held: dict[str, Counter] = defaultdict(Counter)

    def given() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()),
                 pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for k in range(batch.num_rows):
            held[langs[k]].update(set(terms_of(batch.column(2)[k].as_py())))
            if k % 256 == 255 and sum(map(len, held.values())) > HELD_TERMS:
                yield from given()
    yield from given()


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Terms in at least so many documents of their language, as lang and term (binary)."""
    counted = docs.mapInArrow(_documents_counted, "lang string, term binary, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(
        F.col("n") >= least).select("lang", "term")


def shards(kept: DataFrame, n_shards: int) -> DataFrame:
    """A perfect hash with its terms for each language and shard."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes = _hashes(batch.column(1).to_pylist())
                shard = pa.array((hashes[:, 1] % np.uint64(n_shards)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, shard], ["lang", "term", "shard"])

    def built(table: pa.Table) -> pa.Table:
        terms = sorted(table.column("term").to_pylist())
        seed, displacement, slots = perfect(_hashes(terms))
        in_order = [b""] * len(terms)
        for term, slot in zip(terms, slots.tolist(), strict=True):
            in_order[slot] = term
        joined = b" ".join(in_order)
        return pa.Table.from_pydict({
            "lang": table.column("lang")[:1], "shard": table.column("shard")[:1],
            "n_shards": pa.array([n_shards], pa.int32()),
            "n": pa.array([len(terms)], pa.int64()), "seed": pa.array([seed], pa.int64()),
            "displacement": pa.array([displacement.astype("<u4").tobytes()]),
            "terms": pa.array([joined])})

    spread = kept.mapInArrow(placed, "lang string, term binary, shard int")
    return spread.groupBy("lang", "shard").applyInArrow(
        built, "lang string, shard int, n_shards int, n long, seed long, displacement binary, "
               "terms binary")


_PACKED = "lang string, source string, shard int, total long, slots binary, counts binary"


def _packed(lang: str, source: str, shard: int, counts: np.ndarray) -> tuple:
    slots = np.flatnonzero(counts)
    return (lang, source, shard, int(counts.sum()), slots.astype("<u4").tobytes(),
            counts[slots].astype("<i8").tobytes())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in _PACKED.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _recounted(docs: DataFrame, given) -> DataFrame:
    """Second pass: counts of the broadcast shards' terms, by group, in dense arrays."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {lang: Shards(rows) for lang, rows in given.value.items()}
        held: dict[tuple[str, str], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in held.items():
                table = tables[lang]
                rows = [_packed(lang, source, int(table.numbers[k]),
                                counts[table.first[k]:table.first[k + 1]])
                        for k in range(len(table.numbers))]
                rows = [r for r in rows if r[3]]
                if rows:
                    yield _batch(rows)
            held.clear()

        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                words: dict[tuple[str, str], Counter] = defaultdict(Counter)
                for lang, source, text in zip(*(c.to_pylist() for c in batch.columns),
                                              strict=True):
                    if text and lang in tables:
                        words[lang, source].update(terms_of(text))
                slot_of: dict[str, dict[bytes, int]] = {}
                for lang in {g[0] for g in words}:
                    terms = list(set().union(*(c for g, c in words.items() if g[0] == lang)))
                    slot_of[lang] = dict(zip(terms, tables[lang].slots(terms), strict=True))
                for group, counts in words.items():
                    size = tables[group[0]].size
                    if group not in held:
                        if held and sum(map(len, held.values())) + size > HELD_CELLS:
                            yield from out()
                        held[group] = np.zeros(size, np.int64)
                    slots = list(map(slot_of[group[0]].__getitem__, counts))
                    known = [(s, n) for s, n in zip(slots, counts.values(), strict=True)
                             if s is not None]
                    if known:
                        s, n = zip(*known, strict=True)
                        held[group][list(s)] += n
        yield from out()

    return docs.mapInArrow(counted, _PACKED)


def _merged(counts: DataFrame) -> DataFrame:
    """Counts of all tasks added up by group and shard."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                key = key or (row["lang"], row["source"], row["shard"])
                slots = np.frombuffer(row["slots"], "<u4")
                if int(slots[-1]) >= len(total):
                    total = np.pad(total, (0, int(slots[-1]) + 1 - len(total)))
                total[slots] += np.frombuffer(row["counts"], "<i8")
        if key:
            yield _batch([_packed(*key, total)])

    return counts.groupBy("lang", "source", "shard").applyInArrow(added, _PACKED)


def recount(docs: DataFrame, made: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Exact counts of all stored terms by group and shard, in as many passes as the shards need
    to be broadcast in bounded parts."""
    spark = docs.sparkSession
    sizes = made.select("lang", "shard", (F.length("terms") + F.length("displacement"))
                        .alias("size")).orderBy("lang", "shard").collect()
    parts: list[list] = []
    room = 0
    for r in sizes:
        if not parts or r.size > room:
            parts.append([])
            room = pass_bytes
        parts[-1].append((r.lang, r.shard))
        room -= r.size
    tables = []
    for k, part in enumerate(parts):
        wanted = spark.createDataFrame(part, "lang string, shard int")
        by_lang: dict[str, list] = defaultdict(list)
        for r in made.join(F.broadcast(wanted), ["lang", "shard"]).toLocalIterator():
            by_lang[r.lang].append(r.asDict())
        given = spark.sparkContext.broadcast(dict(by_lang))
        tables.append(stored(_merged(_recounted(docs, given)), f"recount-{k}"))
        given.destroy()
    if not tables:
        return spark.createDataFrame([], _PACKED)
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / total), by long division in steps of 1,000."""
    quotient = np.zeros(np.broadcast_shapes(counts.shape, total.shape), np.int64)
    rest = counts + 2
    steps = SCALE
    whole, rest = np.divmod(rest, total)
    quotient += whole
    while steps > 1:
        digit, rest = np.divmod(rest * 1000, total)
        quotient = quotient * 1000 + digit
        steps //= 1000
    return quotient + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compared(full: pa.Table, made: pa.Table, top: int) -> pa.Table:
    """What one shard adds to all pairs of sources, and its best terms of each source."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()),
                        ("item", pa.string()), ("value", pa.int64())])
    if not full.num_rows or not made.num_rows:
        return schema.empty_table()
    rows = sorted(full.to_pylist(), key=lambda r: r["source"])
    terms = bytes(made.column("_terms")[0].as_py()).split(b" ")
    n, v = len(terms), rows[0]["v"]
    counts = np.zeros((len(rows), n), np.int64)
    for k, r in enumerate(rows):
        if r["slots"] is not None:
            counts[k, np.frombuffer(r["slots"], "<u4")] = np.frombuffer(r["counts"], "<i8")
    totals = np.array([r["n_group"] + 2 * v for r in rows], np.int64)
    p = np.stack([shares(counts[k], totals[k]) for k in range(len(rows))])
    q = shares(counts.sum(axis=0), np.array(sum(r["n_group"] for r in rows) + 2 * v, np.int64))
    names = [r["source"] for r in rows]
    lang = rows[0]["lang"]
    source, part, item, value = [], [], [], []
    for k in range(len(rows)):
        sums = distances(p[k], p[k + 1:]).sum(axis=1).tolist()
        for other, s in zip(names[k + 1:], sums, strict=True):
            source += (names[k], other)
            item += (other, names[k])
            value += (s, s)
        part += ["pair"] * (2 * len(sums))
        over = np.flatnonzero((counts[k] > 0) & (p[k] > q))
        f = distances(p[k][over], q[over])
        if len(over) > top:  # ties at the border stay
            best = f >= np.partition(f, len(f) - top)[len(f) - top]
            over, f = over[best], f[best]
        found = sorted((-int(x), terms[s]) for x, s in zip(f, over, strict=True))[:top]
        source += [names[k]] * len(found)
        part += ["term"] * len(found)
        item += [t.decode() for _, t in found]
        value += [-x for x, _ in found]
    return pa.table([pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()),
                     pa.array(part, pa.string()), pa.array(item, pa.string()),
                     pa.array(value, pa.int64())], schema=schema)


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
               least: int = LEAST, top: int = TOP, shard_terms: int = SHARD_TERMS,
               pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Pairs of sources of a language with their distance, and the terms that stand out most in
    each source, as lang, source, part, item, value and rank."""
    rows = _groups(docs, lang, source, text)
    kept = stored(kept_terms(rows, least), "divergence-terms")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    largest = sizes.agg(F.max("v")).first()[0] or 0
    made = stored(shards(kept, -(-largest // shard_terms) or 1), "divergence-shards")
    counts = recount(rows, made, pass_bytes)
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("n_group"))
    groups = stored(
        rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
        .join(sizes, "lang", "left").select(
            "lang", "source", F.coalesce("n_group", F.lit(0)).alias("n_group"), "v"),
        "divergence-groups")
    full = groups.join(made.select("lang", "shard"), "lang").join(
        counts.drop("total"), ["lang", "source", "shard"], "left")

    def compared(full: pa.Table, made: pa.Table) -> pa.Table:
        return _compared(full, made, top)

    named = made.toDF(*[f"_{c}" for c in made.columns])
    parts = full.groupBy("lang", "shard").cogroup(
        named.select("_lang", "_shard", "_terms").groupBy("_lang", "_shard")).applyInArrow(
        compared, "lang string, source string, part string, item string, value long")
    bare = groups.where(F.col("v").isNull())
    others = bare.select("lang", F.col("source").alias("item"))
    without = bare.join(others, "lang").where("source <> item").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        F.lit(0).cast("long").alias("value"))
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = summed.unionByName(without).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
