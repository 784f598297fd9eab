"""Personal data: fixed kinds by their form, further terms by what they disclose.

Values of the fixed kinds (e-mail, IP address, card, phone) are the protected entities. The
corpus tells which words give an entity away: every occurrence of an entity has a context,
the ``CONTEXT`` words on either side. For a word t in contexts of an entity e

    PMI(t, e) = log2(n_te * N / (n_t * n_e)),   IC(e) = log2(N / n_e)

with N different texts, n_e of them with e, n_te with t in a context of e, and n_t with t
anywhere: one unit on both sides, so copies of a text or of a passage change nothing.
PMI / IC is the share of the entity's information that the word discloses; it is 1 for a word
that stands nowhere else. Words of ``SHARE`` or more, found in ``SUPPORT`` different contexts
or more, are spans of kind ``term`` wherever they stand in a context of that entity. Equal
contexts count once there, so copies of a document prove nothing.

One pass over the texts yields spans and contexts, a few bytes each; a second counts the
texts that hold a candidate word, with copies as one. Counts are combined before every shuffle, so neither a
frequent word nor an entity in a third of all documents is a hot key.

Defined results: NULL and empty texts have no spans; repeated rows get the same spans each;
columns pass through ``sanitise``; only id and text are read by ``find``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.common import stored, text_hash

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 8
SUPPORT = 5
SHARE = 0.9
# Candidate words up to this number are handed to the counting tasks, which then count no
# others; beyond it they count all words and the join picks. The result is the same.
HANDED = 200_000

# The forms of the contract. A run of digits cannot match from its middle.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each @ so that long words cost no more than their length."""
    start, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > start and text[first - 1] in _LOCAL:
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            start = domain.end()
            yield 0, first, start
        else:
            # A later match cannot begin before this @.
            start = at + 1
        at = text.find("@", max(at + 1, start))


def _luhn(digits: list[int]) -> bool:
    double = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(double)) % 10 == 0


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if "0" <= c <= "9"]


def base_spans(text: str | None) -> list[Span]:
    """Spans (kind, start, end) of the fixed kinds, in code points."""
    if not text:
        return []
    found = list(_emails(text))
    if _DOTTED.search(text):
        for m in _IP.finditer(text):
            # Zeros in front do not count; more than three other digits are above 255.
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                found.append((3, *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text))


def contexts(text: str, spans: list[Span]) -> list[dict]:
    """The words around each span: entity, context and word as hashes, with the word's place."""
    out = []
    digest = _hash(text)
    for kind, start, end in spans:
        entity = _hash(f"{kind}:{text[start:end].lower()}")
        # Reads as far as the context needs, not the whole text.
        words: list[tuple[int, int]] = []
        width = 64
        while True:
            left = max(0, start - width)
            words = [m.span() for m in _WORD.finditer(text, left, start)]
            if left == 0 or len(words) > CONTEXT:
                break
            width *= 4
        before = words[-CONTEXT:]
        after = []
        for m in _WORD.finditer(text, end):
            after.append(m.span())
            if len(after) == CONTEXT:
                break
        near = [(a, b) for a, b in before + after
                if not any(a < e and s < b for _, s, e in spans)]
        whole = _hash(" ".join(text[a:b].lower() for a, b in near))
        out += [{"entity": entity, "context": whole, "word": _hash(text[a:b].lower()),
                 "text": digest, "start": a, "end": b} for a, b in near]
    return out


_SPANS = "array<struct<kind:int,start:int,end:int>>"
_CONTEXTS = "array<struct<entity:long,context:long,word:long,text:long,start:int,end:int>>"


def _first_pass(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    keyed = docs.select(F.col(f"`{doc_id}`").alias("_id"),
                        text_hash(F.col(f"`{text}`")).alias("_hash"),
                        F.col(f"`{text}`").alias("_text"))
    id_type = keyed.schema["_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()),
                                    ("end", pa.int32())]))
    context_type = pa.list_(pa.struct([
        ("entity", pa.int64()), ("context", pa.int64()), ("word", pa.int64()),
        ("text", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, near = [], []
            for value in batch.column(2).to_pylist():
                found = base_spans(value)
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                near.append(contexts(value, found) if found else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, span_type),
                 pa.array(near, context_type)], ["_id", "_hash", "spans", "near"])

    return keyed.mapInArrow(each, f"_id {id_type}, _hash long, spans {_SPANS}, "
                                  f"near {_CONTEXTS}")


def _holding(docs: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """word and n_t, the number of different texts that hold it, for some words."""
    spark = docs.sparkSession
    listed = words.limit(HANDED + 1).toArrow().column(0).to_pylist()
    chosen = spark.sparkContext.broadcast(
        frozenset(listed) if len(listed) <= HANDED else None)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        wanted = chosen.value
        for batch in batches:
            start, size, held = 0, 0, []
            for k, value in enumerate(batch.column(1).to_pylist()):
                words = []
                for w in set(_WORD.findall(value.lower())) if value else ():
                    h = known.get(w)
                    if h is None:
                        if len(known) > 500_000:
                            known.clear()
                        h = known[w] = _hash(w)
                    if wanted is None or h in wanted:
                        words.append(h)
                held.append(words)
                size += len(words)
                if size > 200_000 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, len(held)),
                         pa.array(held, pa.list_(pa.int64()))], ["_hash", "words"])
                    start, size, held = k + 1, 0, []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = batch.column(0).flatten().value_counts()
            yield pa.RecordBatch.from_arrays(
                [counted.field("values"), counted.field("counts")], ["word", "n"])

    if not listed:
        return spark.createDataFrame([], "word long, n_t long")
    # Copies are combined before the shuffle, so a large group of them is no hot key.
    texts = docs.select(text_hash(F.col(f"`{text}`")).alias("_hash"), F.col(f"`{text}`")) \
        .mapInArrow(hold, "_hash long, words array<long>") \
        .groupBy("_hash").agg(F.first("words").alias("words"))
    return texts.select("words").mapInArrow(count, "word long, n long") \
        .groupBy("word").agg(F.sum("n").alias("n_t")).join(words, "word")


def disclosing(docs: DataFrame, near: DataFrame, text: str = "text", support: int = SUPPORT,
               share: float = SHARE) -> DataFrame:
    """entity, word and the share of the entity's information that the word discloses.

    ``near`` has one row per word in a context.
    """
    total = docs.select(text_hash(F.col(f"`{text}`"))).distinct().count()
    spoken = near.select("entity", "context", "word").distinct().groupBy("entity", "word") \
        .agg(F.count("*").alias("n_contexts")).filter(F.col("n_contexts") >= support)
    seen = near.select("entity", "text", "word").distinct()
    both = seen.groupBy("entity", "word").agg(F.count("*").alias("n_te")) \
        .join(spoken, ["entity", "word"]).drop("n_contexts")
    entities = seen.select("entity", "text").distinct().groupBy("entity") \
        .agg(F.count("*").alias("n_e"))
    candidates = stored(both.join(entities, "entity"), "candidates")
    held = _holding(docs, text, candidates.select("word").distinct())
    rated = candidates.join(held, "word").withColumn("part", F.log2(
        F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
        / F.log2(F.lit(float(total)) / F.col("n_e")))
    return rated.filter((F.col("n_e") < total) & (F.col("part") >= share)) \
        .select("entity", "word", "part")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """One row per document: _id, _hash, ``base`` and ``spans``, both in order of start and
    kind (kinds by their place in ``KINDS``); ``spans`` holds the base spans and terms."""
    first = stored(_first_pass(docs, doc_id, text), "spans")
    near = first.filter(F.size("near") > 0).select("_id", "_hash", F.explode("near").alias("x")) \
        .select("_id", "_hash", "x.*")
    told = disclosing(docs, near, text, support, share)
    terms = near.join(told.select("entity", "word"), ["entity", "word"]) \
        .groupBy("_id", "_hash").agg(F.collect_set(F.struct(
            F.lit(KINDS.index("term")).alias("kind"), "start", "end")).alias("terms")) \
        .withColumnsRenamed({"_id": "_rid", "_hash": "_rhash"})
    joined = first.drop("near").join(
        terms, first["_id"].eqNullSafe(terms["_rid"]) & (first["_hash"] == terms["_rhash"]),
        "left")
    whole = F.concat("spans", F.coalesce("terms", F.array().cast(_SPANS)))
    return joined.select("_id", "_hash", F.col("spans").alias("base"),
                         _in_order(whole).alias("spans"))


def _in_order(spans: Column) -> Column:
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(by_start, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(text: str, spans: list[dict]) -> str:
    """A text with each span replaced by the name of its kind; overlapping spans are one."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             **options) -> DataFrame:
    """The documents, in their columns, with all spans replaced by the names of their kinds."""
    found = find(docs, doc_id, text, **options).filter(F.size("spans") > 0) \
        .select(F.col("_id").alias("_rid"), F.col("_hash").alias("_rhash"), "spans") \
        .dropDuplicates(["_rid", "_rhash"])
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col(f"`{doc_id}`").alias("_id"),
                        text_hash(F.col(f"`{text}`")).alias("_hash"))
    joined = keyed.join(found, keyed["_id"].eqNullSafe(found["_rid"])
                        & (keyed["_hash"] == found["_rhash"]), "left") \
        .select("_row", "spans")
    row_type = docs.schema
    names = docs.columns
    at = names.index(text)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = columns[at].to_pylist()
            for k, spans in enumerate(batch.column(1).to_pylist()):
                if spans:
                    texts[k] = masked(texts[k], spans)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(mask, row_type)
