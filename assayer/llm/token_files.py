"""Token ids as flat binary files that can be memory-mapped.

A store is a folder in shared storage with three files per shard:

``tokens-K.bin``   ids of all documents of the shard, one after the other, as unsigned
                   integers of 16 bits if the vocabulary allows it, else 32 (little-endian)
``offsets-K.bin``  where each document of the shard starts among the ids of the whole store,
                   and where the last one ends: unsigned, 64 bits
``docs-K.bin``     the document ids: signed, 64 bits; the smallest one stands for NULL

and ``store.json`` with the width and the shards in order. Documents are in ascending order
of their id (NULL first, equal ids by text), within and across shards.

Writing needs one shuffle, by ranges of the id. Each task encodes its texts and writes its
ids as it goes, under a name of its own that is moved into place at the end, so a task can
run again or twice. Tasks return a document's length only. Sums of the lengths per shard are
all that reaches the driver: their prefix sums are the bases that a second, small job adds
to the offsets.

Defined results: ids that are no whole numbers are an error (``invalid_document_id``); a NULL or empty text has the end id only; repeated rows are stored again;
columns other than id and text are not stored; an empty table makes a store without shards.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayer.errors import AssayError
from assayer.llm.common import Recent

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
NO_ID = np.iinfo(np.int64).min
# Words remembered by a Python process, in each of two generations.
MEMORY = 600_000

_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SIGN = r"!-&(-/:-@\[-`{-~"
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
# Where a text must be cut by ``_CUT``: white space around a space or line break, across which
# the tokenizer may read; commas and full stops behind other signs, which it may join; words
# that end in other signs. Elsewhere it always cuts before a space, a line break, a comma and
# a full stop.
_RUN = re.compile(r"\s[ \n](?:\s|\Z)|[\W_][,.]|[!-+\-/:-@[-`{-~](?:[\s,.]|\Z)")
# Texts of these characters hold no such place unless they hold one of the pairs.
_COMMON = re.compile(f"[{_LETTER}0-9 \n,.]*").fullmatch
_PAIRS = ("  ", " \n", "\n ", "\n\n", " ,", " .", "\n,", "\n.", ",,", ",.", ".,", "..")


def _cut_anywhere(text: str) -> bool:
    """Whether a text can be cut at its spaces, line breaks, commas and full stops."""
    if _COMMON(text) and not any(p in text for p in _PAIRS):
        return True
    return not _RUN.search(text)


# Cuts where the tokenizer cuts as well: words of common letters, the ASCII signs that end
# them, other text between white space, white space. The space before a word belongs to it.
_CUT = re.compile(
    f" ?[{_LETTER}]+(?=[{_SIGN}]*(?:[{_SPACE}]|\\Z))|(?<=[{_LETTER}])[{_SIGN}]+(?=[{_SPACE}]|\\Z)"
    f"| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


_WORD = re.compile(f" ?[{_LETTER}]+").fullmatch
# Bytes as the vocabulary shows them: printable Latin-1 characters stand for themselves, the
# other bytes follow from character 256 on, in order.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
# What begins a part without a space.
_OWN = frozenset("\n,.")


class Encoder:
    """Byte-level encoding with the tokenizers library, each distinct word once.

    A special token written out in a text gets its special id, as the library does by
    default; with ``plain_special`` it is read as ordinary text.
    """

    def __init__(self, path: str, plain_special: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_special
        self.specials = [] if plain_special else [
            t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        # Parts as they are, and parts whose space is left out.
        self.plain, self.spaced = Recent(MEMORY // 8), Recent(MEMORY)

    def _bytes(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.kind.char, e.ids).tobytes() for e in made]

    def _words(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of a text. A word of common letters, with or without a space, is one
        piece of text to the tokenizer, so its model merges it straight away."""
        merge, code = self.tokenizer.model.tokenize, self.kind.char
        made: list[bytes | None] = [
            array(code, [t.id for t in merge(p.encode().decode("latin-1").translate(_SHOWN))])
            .tobytes() if _WORD(p) else None for p in parts]
        others = iter(self._bytes([p for p, ids in zip(parts, made, strict=True) if ids is None]))
        return [next(others) if ids is None else ids for ids in made]

    def _looked_up(self, memory: Recent, parts: list[str], text_of) -> list[bytes]:
        found = memory.found(parts)
        if None in found:
            missing = [k for k, ids in enumerate(found) if ids is None]
            new = list({parts[k] for k in missing})
            ids_of = dict(zip(new, self._words(list(map(text_of, new))), strict=True))
            for p, ids in ids_of.items():
                if len(p) <= 40:
                    memory.keep(p, ids)
            for k in missing:
                found[k] = ids_of[parts[k]]
        return found

    def packed(self, text: str | None) -> bytes:
        """Ids of a text in the layout of the files, without an end id."""
        if not text:
            return b""
        if any(t in text for t in self.specials):
            return self._bytes([text])[0]
        if not _cut_anywhere(text):
            parts = _CUT.findall(text)
            spaced = [p[1:] if p[0] == " " and p[1:2] not in _OWN else None for p in parts]
            plain = [p for p, s in zip(parts, spaced, strict=True) if s is None]
            left = iter(self._looked_up(self.plain, plain, str))
            right = iter(self._looked_up(self.spaced, [s for s in spaced if s is not None],
                                         _with_space))
            return b"".join([next(left) if s is None else next(right) for s in spaced])
        parts = text.replace("\n", " \n").replace(",", " ,").replace(".", " .").split(" ")
        first = self._looked_up(self.plain, parts[:1], str) if parts[0] else [b""]
        return first[0] + b"".join(self._looked_up(self.spaced, parts[1:], _with_space))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), self.kind).tolist()


def _with_space(part: str) -> str:
    """A part as it stands in the text: a line break, comma or full stop begins it, or the
    space that is left out."""
    return part if part[:1] in _OWN else " " + part


_LOADED: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The tokenizer of a file, loaded once in each Python process."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    if path not in _LOADED:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Placed:
    """A file that gets its name when it is complete."""

    def __init__(self, path: str) -> None:
        self.system, self.path = _at(path)
        self.hidden = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream = self.system.open_output_stream(self.hidden)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def done(self) -> None:
        self.stream.close()
        self.system.move(self.hidden, self.path)


def mapped(path: str, kind: np.dtype) -> np.ndarray:
    """A file as an array: memory-mapped where the storage is a file system, else read."""
    system, name = _at(path)
    if system.get_file_info(name).size == 0:
        return np.empty(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(name, kind, "r")
    with system.open_input_file(name) as f:
        return np.frombuffer(f.read(), kind)


def _tokens_written(rows: Iterator[pa.RecordBatch], shard: int, folder: str, end_id: int,
                    path: str | None) -> Iterator[pa.RecordBatch]:
    """Writes the ids of a partition; yields its shard, documents and ids."""
    packed, kind = encoder(path).packed, encoder(path).kind
    end = np.array([end_id], kind).tobytes()
    tokens = _Placed(f"{folder}/tokens-{shard:06d}.bin")
    docs: list[np.ndarray] = []
    lengths: list[int] = []
    for batch in rows:
        docs.append(batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy())
        found = [packed(text) for text in batch.column(1).to_pylist()]
        lengths += [len(ids) // kind.itemsize + 1 for ids in found]
        tokens.write(b"".join([part for ids in found for part in (ids, end)]))
    tokens.done()
    if not docs:
        return
    for name, array in (("docs", np.concatenate(docs).astype("<i8")),
                        ("lengths", np.array(lengths, "<u8"))):
        file = _Placed(f"{folder}/{name}-{shard:06d}.bin")
        file.write(array.tobytes())
        file.done()
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard]), pa.array([len(lengths)]), pa.array([sum(lengths)])],
        ["shard", "n_docs", "n_tokens"])


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text",
          end_id: int = END_ID, path: str | None = None) -> dict:
    """Writes a store and returns what its ``store.json`` says.

    ``spark.sql.shuffle.partitions`` sets the number of shards.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise AssayError("invalid_document_id", f"Column {doc_id} must hold whole numbers.")
    system, name = _at(folder)
    system.create_dir(name)
    kind = encoder(path).kind.str
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"),
                       F.col(f"`{text}`").alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "i").sortWithinPartitions("i", "t")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        return _tokens_written(batches, shard, folder, end_id, path)

    written = ordered.mapInArrow(tokens, "shard long, n_docs long, n_tokens long").collect()
    base, shards = 0, []
    for r in sorted(written):
        shards.append({"shard": r.shard, "n_docs": r.n_docs, "n_tokens": r.n_tokens,
                       "base": base})
        base += r.n_tokens
    if shards:
        _add_bases(spark, folder, shards)
    store = {"kind": kind, "end_id": end_id, "n_tokens": base, "shards": shards}
    with system.open_output_stream(f"{name}/store.json") as f:
        f.write(json.dumps(store).encode())
    return store


def _shard_rows(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """One row and one task for each shard."""
    rows = [(s["shard"], s["base"]) for s in shards]
    df = spark.createDataFrame(rows, "shard long, base long")
    return df.repartitionByRange(len(rows), "shard")


def _add_bases(spark: SparkSession, folder: str, shards: list[dict]) -> None:
    """Offsets of each shard from its lengths and its base."""
    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = mapped(f"{folder}/lengths-{row['shard']:06d}.bin", "<u8")
                starts = np.zeros(len(lengths) + 1, "<u8")
                np.cumsum(lengths, out=starts[1:])
                file = _Placed(f"{folder}/offsets-{row['shard']:06d}.bin")
                file.write((starts + np.uint64(row["base"])).tobytes())
                file.done()
            yield batch.select(["shard"])

    _shard_rows(spark, shards).mapInArrow(offsets, "shard long").count()


def store_of(folder: str) -> dict:
    system, name = _at(folder)
    with system.open_input_stream(f"{name}/store.json") as f:
        return json.loads(f.read())


def documents_of(folder: str, shard: int, kind: str) -> Iterator[tuple[int | None, int,
                                                                       np.ndarray]]:
    """Id, start and ids of each document of a shard, from its mapped files."""
    tokens = mapped(f"{folder}/tokens-{shard:06d}.bin", kind)
    offsets = mapped(f"{folder}/offsets-{shard:06d}.bin", "<u8")
    docs = mapped(f"{folder}/docs-{shard:06d}.bin", "<i8")
    base = int(offsets[0])
    for k, doc in enumerate(docs.tolist()):
        start, end = int(offsets[k]), int(offsets[k + 1])
        yield None if doc == NO_ID else doc, start, tokens[start - base:end - base]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens and the CRC-32 of its ids as
    unsigned integers of 32 bits, little-endian."""
    store = store_of(folder)
    kind, schema = store["kind"], "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not store["shards"]:
        return spark.createDataFrame([], schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                found = [(doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                         for doc, start, ids in documents_of(folder, shard, kind)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*found, strict=True)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _shard_rows(spark, store["shards"]).mapInArrow(rows, schema)
