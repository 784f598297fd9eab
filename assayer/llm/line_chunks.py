"""Line deduplication with content-defined chunks.

A document is a list of lines. Where a chunk ends is decided by content alone: after a line
whose rolling hash (over it and the line before) falls into a fixed class, and on both sides
of a line with many words. So an inserted line moves no boundary but those beside it. Units
of comparison below ``LEAST_WORDS`` words are the chunks with all their beginnings and ends,
because a passage that was put into other documents shares whole chunks inside and parts of
chunks at its edges. Beside them each line has two windows that know no boundary: the shortest
runs of lines from it and up to it that hold ``LEAST_WORDS`` words. Together these cover every
run of so many words that two places share, wherever the boundaries fall.

Units travel as two hashes of 64 bits and a place. Those that occur more than once are
fetched and compared byte by byte, with runs of equal lines written as one line and a number;
units of one hash that differ are left alone. A unit has fewer than ``LEAST_WORDS`` lines with
words before its last, and white lines that differ are never in one chunk, so the work on a
text grows with its length, also for logs, tables and filler. The first
place in the order of document id, text hash and line is the original; lines of all later
places are candidates, and runs of candidates with ``LEAST_WORDS`` words or more are removed.
Short formulas that many documents share therefore stay.

Counts are combined before the shuffle, so a passage in a third of all documents is no hot
key; joins on hashes carry places only and can be split where they are skewed.

Defined results: NULL stays NULL; a text without repeated lines is returned as it is, bytes
included; repeated rows (same id and text) are one document and get one answer; NULL ids come
last in the order; of white lines that differ beside a repeated run, those go that equal the
one next to it; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.llm.common import stored, text_hash

LEAST_WORDS = 40
# A line with so many words is a chunk of its own.
LONG_LINE = 16
# Mean number of short lines in a chunk.
MEAN_LINES = 3
# Characters of fetched lines handed on at a time.
PACKED = 4_000_000

_MASK = (1 << 64) - 1
_PRIME = 0x9E3779B185EBCA87
_SIGN = 1 << 63
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _signed(value: int) -> int:
    return (value & _MASK) - (1 << 64) if value & _SIGN else value & _MASK


def ends(lines: list[str], words: list[int], hashes: list[int]) -> list[int]:
    """Last lines of the chunks, in order."""
    last = len(lines) - 1
    found = []
    for k in range(last + 1):
        before = hashes[k - 1] if k else 0
        rolled = (before * _PRIME + hashes[k]) & _MASK
        if (k == last or words[k] >= LONG_LINE or words[k + 1] >= LONG_LINE
                or (rolled >> 20) % MEAN_LINES == 0
                or not words[k] and not words[k + 1] and hashes[k] != hashes[k + 1]):
            found.append(k)
    return found


def _edges(words: list[int], hashes: list[int]) -> bytearray:
    """Lines with words, and white lines that equal all those between them and such a line."""
    found = bytearray(len(words))
    for k, w in enumerate(words):
        found[k] = bool(w or not k or words[k - 1]
                        or found[k - 1] and hashes[k] == hashes[k - 1])
    return found


def _windows(words: list[int], hashes: list[int], total: list[int],
             least: int) -> Iterator[tuple[int, int]]:
    """The shortest runs with enough words from each line and up to each line."""
    n = len(words)
    starts = _edges(words[::-1], hashes[::-1])[::-1]
    stops = _edges(words, hashes)
    last = 0
    for first in range(n):
        last = max(last, first)
        while last < n and total[last + 1] - total[first] < least:
            last += 1
        if last == n:
            break
        if starts[first]:
            yield first, last
    first = 0
    for last in range(n):
        while total[last + 1] - total[first + 1] >= least and first < last:
            first += 1
        if stops[last] and total[last + 1] - total[first] >= least:
            yield first, last


def units(text: str, least: int = LEAST_WORDS) -> list[tuple[int, int, int, int]]:
    """Units of a text: two hashes, first and last line."""
    lines = text.split("\n")
    data = [line.encode() for line in lines]
    words = [len(d.split()) for d in data]
    hashes = [xxhash.xxh64_intdigest(d) for d in data]
    prefix = [(0, 0)]
    powers = [1]
    for d, h in zip(data, hashes, strict=True):
        a, b = prefix[-1]
        prefix.append(((a * _PRIME + h) & _MASK,
                       (b * _PRIME + xxhash.xxh64_intdigest(d, 7)) & _MASK))
        powers.append(powers[-1] * _PRIME & _MASK)
    total = [0]
    for w in words:
        total.append(total[-1] + w)
    stops = ends(lines, words, hashes)
    spans = set(_windows(words, hashes, total, least))
    start = 0
    for k, stop in enumerate(stops):
        later = stops[k + 1] if k + 1 < len(stops) else stop
        # Units with enough words consist of windows.
        for line in range(start, stop + 1):
            if total[line + 1] - total[start] >= least:
                break
            spans.add((start, line))
        for line in range(stop, start - 1, -1):
            if total[stop + 1] - total[line] >= least:
                break
            spans.add((line, stop))
        # The boundary after a passage's first line depends on the line before it.
        if total[later + 1] - total[stop] < least:
            spans.add((stop, later))
        start = stop + 1
    out = []
    for first, last in spans:
        if total[last + 1] > total[first]:
            n = last + 1 - first
            out.append((*(_signed(prefix[last + 1][s] - prefix[first][s] * powers[n] + n)
                          for s in (0, 1)), first, last))
    return out


_UNITS = "h1 long, h2 long, first int, last int"


def _with_key(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents as one column, with the id and hash that tell them apart."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{doc_id}`").alias("_id"), text_hash(F.col(f"`{text}`")).alias("_hash"),
        F.col(f"`{text}`").alias("_text"))


def _same_doc(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.withColumnsRenamed({"_id": "_rid", "_hash": "_rhash"})
    return left.join(right, left["_id"].eqNullSafe(right["_rid"])
                     & (left["_hash"] == right["_rhash"]), how).drop("_rid", "_rhash")


def _all_units(keyed: DataFrame, id_type: str, least: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for k, text in enumerate(batch.column(2).to_pylist()):
                found = units(text, max(least, 1))
                rows += [k] * len(found)
                for c, values in zip(cols, zip(*found), strict=False):
                    c.extend(values)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at),
                 pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                ["_id", "_hash", "h1", "h2", "first", "last"])

    return keyed.filter("_text IS NOT NULL").select("_id", "_hash", "_text").mapInArrow(
        each, f"_id {id_type}, _hash long, {_UNITS}")


def _place() -> Column:
    """Order of places; NULL ids last."""
    return F.struct(F.col("_id").isNull(), "_id", "_hash", "first")


def folded(lines: list[str], run_stops: list[int], first: int, last: int) -> str:
    """Lines of a place, equal ones in a row as one with their number."""
    out = []
    while first <= last:
        stop = min(run_stops[first], last)
        out.append(f"{stop + 1 - first} {lines[first]}")
        first = stop + 1
    return "\n".join(out)


def unit_texts(text: str, places: list[dict]) -> Iterator[tuple[int, int, str]]:
    """Hashes and folded lines of places in a text, equal ones once."""
    lines = text.split("\n")
    run_stops = list(range(len(lines)))
    for k in range(len(lines) - 2, -1, -1):
        if lines[k] == lines[k + 1]:
            run_stops[k] = run_stops[k + 1]
    known: dict[tuple[int, int], str] = {}
    for p in places:
        key = p["h1"], p["h2"]
        content = folded(lines, run_stops, p["first"], p["last"])
        if known.get(key) != content:
            known[key] = content
            yield *key, content


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(out, pa.string())],
            ["h1", "h2", "lines"])

    h1, h2, out, size = [], [], [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            for a, b, content in unit_texts(batch.column(0)[k].as_py(),
                                            batch.column(1)[k].as_py()):
                h1.append(a)
                h2.append(b)
                out.append(content)
                size += len(content)
                if size > PACKED:
                    yield packed()
                    h1, h2, out, size = [], [], [], 0
    yield packed()


def repeated_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    least_words: int = LEAST_WORDS) -> DataFrame:
    """Places whose lines occur earlier, byte for byte: _id, _hash, first, last."""
    keyed = _with_key(docs, doc_id, text)
    id_type = docs.schema[doc_id].dataType.simpleString()
    found = _all_units(keyed, id_type, least_words)
    several = found.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
    places = stored(found.join(several, ["h1", "h2"]), "line-places")

    listed = places.groupBy("_id", "_hash").agg(
        F.collect_set(F.struct("h1", "h2", "first", "last")).alias("_places"))
    texts = _same_doc(keyed.drop("_row"), listed, "inner") \
        .select("_text", "_places").mapInArrow(_texts, "h1 long, h2 long, lines string")
    equal = texts.groupBy("h1", "h2").agg(
        F.min("lines").alias("least"), F.max("lines").alias("most")) \
        .filter("least = most").select("h1", "h2")
    originals = places.groupBy("h1", "h2").agg(F.min(_place()).alias("original"))
    proven = stored(originals.join(equal, ["h1", "h2"]), "line-originals")
    return places.join(proven, ["h1", "h2"]).filter(_place() > F.col("original")) \
        .select("_id", "_hash", "first", "last")


def _removed(text: str, spans: list[dict], least: int) -> list[int]:
    """Lines of runs of repeated lines with enough words."""
    lines = text.split("\n")
    steps = [0] * (len(lines) + 1)
    for s in spans:
        steps[s["first"]] += 1
        steps[s["last"] + 1] -= 1
    marked = list(accumulate(steps))
    out: list[int] = []
    run: list[int] = []
    for k in range(len(lines) + 1):
        if k < len(lines) and marked[k]:
            run.append(k)
        elif run:
            if sum(len(_WORD.findall(lines[x])) for x in run) >= least:
                out += run
            run = []
    return out


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document: ``row`` (its columns), ``kept_text``, ``n_lines`` and
    ``removed``, the numbers of the lines that are gone, from 0."""
    keyed = _with_key(docs, doc_id, text)
    spans = repeated_places(docs, doc_id, text, least_words).groupBy("_id", "_hash").agg(
        F.collect_set(F.struct("first", "last")).alias("_spans"))
    joined = _same_doc(keyed, spans, "left").select("_row", "_text", "_spans")
    row_type = joined.schema["_row"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, gone = [], []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                value = texts[k]
                counts.append(value.count("\n") + 1 if value else 0)
                gone.append(_removed(value, spans, least_words) if spans else [])
                if gone[-1]:
                    drop = set(gone[-1])
                    texts[k] = "\n".join(line for i, line in enumerate(value.split("\n"))
                                         if i not in drop)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(gone, pa.list_(pa.int32()))],
                ["row", "kept_text", "n_lines", "removed"])

    schema = T.StructType([
        T.StructField("row", row_type), T.StructField("kept_text", T.StringType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("removed", T.ArrayType(T.IntegerType()))])
    return joined.mapInArrow(cut, schema)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           length: str | None = "n_chars", **options) -> DataFrame:
    """Documents without repeated runs of lines, in the columns of ``docs``; a document of
    which nothing but white space remains is dropped. ``length`` names a column that holds
    the length of the text and follows the cut."""
    done = clean(docs, doc_id, text, **options)
    changed = F.size("removed") > 0
    columns = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        new = {text: F.col("kept_text"), length: F.length("kept_text").cast(
            docs.schema[c].dataType)}.get(c)
        columns.append((old if new is None else F.when(changed, new).otherwise(old)).alias(c))
    return done.filter(~changed | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")) \
        .select(*columns)
