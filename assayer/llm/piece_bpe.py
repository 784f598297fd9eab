"""SentencePiece models of the merge type: exact encoding by backtracking, and decoding.

A text is cut where no piece can reach across: before each run of word starts and around
line breaks. Inside such a segment the longest piece at a place is tried first (all longest
pieces of a segment come from one Aho-Corasick pass), then its shorter prefixes. A piece is
accepted when it can stand beside the one before it: undoing the merges of both, latest
first, must never meet a merge across their border that would have come earlier. Places from
which no encoding went on are marked in a bit field, so a segment takes linear time.
Characters outside the vocabulary become byte pieces.

Segments and the pairs of pieces that were checked are remembered, in two generations of
``MEMORY`` entries and up to ``PAIRS`` pairs, which never changes a result. Nothing is shuffled, and a task holds one batch
of texts.

Defined results: a NULL text counts as empty; an empty text has the end id only; repeated
rows are encoded again; other columns pass through, and a column named like an output is
replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from assayer.llm.common import Recent

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
MEMORY = 400_000
# Rows whose results are held at a time.
ROWS = 500
# Checked pairs of pieces that are remembered.
PAIRS = 400_000
_BASE = -1
_NEVER = float("inf")


class Pieces:
    """Vocabulary and merge order of one model."""

    def __init__(self, path: str, memory: int | None = None) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.end_id = model.eos_id()
        self.unknown_id = model.unk_id()
        self.surface: list[str | None] = [model.id_to_piece(i) for i in range(size)]
        self.byte_of: dict[int, int] = {}
        self.control = {i for i in range(size) if model.is_control(i)}
        normal: dict[str, int] = {}
        for i in range(size):
            if model.is_byte(i):
                self.byte_of[i] = int(self.surface[i][3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal[self.surface[i]] = i
        self.ids = normal
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        self.shown = [s.replace(SPACE, " ") for s in self.surface]
        self._check(normal)
        runs = [p for p in normal if not p.strip(SPACE)]
        self.runs = {len(p): normal[p] for p in runs}
        in_order = sorted((p for p in normal if p.strip(SPACE) and len(p) > 1),
                          key=lambda p: -model.get_score(normal[p]))
        self._learn([p for p in normal if len(p) == 1], in_order)
        solo = "" if any("\n" in p for p in normal if len(p) > 1) else "\n"
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{solo}]+|{SPACE}+" + (f"|{solo}" if solo else ""))
        self.solo = bool(solo)
        self.limit = memory or PAIRS
        self.memory, self.words = Recent(memory or MEMORY), Recent(memory or MEMORY)
        self.fits: dict[tuple[str, str], bool] = {}

    @staticmethod
    def _check(normal: dict[str, int]) -> None:
        inner = re.compile(f"[^{SPACE}]{SPACE}|{SPACE}{SPACE}[^{SPACE}]")
        if any(inner.search(p) for p in normal):
            raise ValueError("pieces of this model reach across word starts")
        if any(c not in normal for p in normal for c in p):
            raise ValueError("a character of a piece of this model is no piece itself")

    def _learn(self, characters: list[str], in_order: list[str]) -> None:
        """Ranks, and the two parts of every piece that merging can make."""
        self.rank: dict[str, float] = dict.fromkeys(characters, _BASE)
        self.characters = frozenset(characters)
        self.parts: dict[str, tuple[str, str]] = {}
        for rank, piece in enumerate(in_order):
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                if left in self.rank and right in self.rank and self.apart(left, right):
                    self.rank[piece], self.parts[piece] = rank, (left, right)
                    break
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[str, str] = {}
        for piece in self.rank:
            if len(piece) > 1:  # a character is a match at its place in any case
                self.automaton.add_word(piece, len(piece))
            for k in range(len(piece) - 1, 0, -1):
                if piece[:k] in self.rank:
                    self.shorter[piece] = piece[:k]
                    break
        self.automaton.make_automaton()

    def apart(self, left: str, right: str) -> bool:
        """True when merging leaves the border between two neighbouring pieces in place."""
        rank, limit = self.rank, _NEVER
        while True:
            across = rank.get(left + right)
            if across is not None and across < limit:
                return False
            a, b = rank[left], rank[right]
            if a > b:  # the left piece was made last; equal merges go from left to right
                limit, left = a, self.parts[left][1]
            elif b != _BASE:
                limit, right = b + 1, self.parts[right][0]
            else:
                return True

    def _known(self, word: str) -> list[str]:
        """Pieces of a word whose characters are all in the vocabulary."""
        size = len(word)
        longest = [1] * size
        for end, length in self.automaton.iter(word):
            if length > longest[end + 1 - length]:
                longest[end + 1 - length] = length
        alive = bytearray(b"\x01") * (size + 1)
        fits, shorter = self.fits, self.shorter
        taken: list[str] = []
        at, piece, before = 0, word[:longest[0]], ""
        while True:
            while piece:
                if alive[at + len(piece)]:
                    if not before:
                        break
                    fit = fits.get((before, piece))
                    if fit is None:
                        fit = fits[before, piece] = self.apart(before, piece)
                    if fit:
                        break
                piece = shorter.get(piece, "")
            if piece:
                taken.append(piece)
                at += len(piece)
                if at == size:
                    break
                before, piece = piece, word[at:at + longest[at]]
            else:  # nothing goes on from here: take the last piece back
                alive[at] = 0
                piece = taken.pop()
                at -= len(piece)
                before = taken[-1] if taken else ""
        if len(fits) > self.limit:
            fits.clear()
        return taken

    def _spaces(self, count: int) -> list[int]:
        """A run of word starts: equal merges, the leftmost first."""
        lengths: list[int] = []
        for _ in range(count):
            lengths.append(1)
            while len(lengths) > 1 and lengths[-2] + lengths[-1] in self.runs:
                lengths[-2:] = [lengths[-2] + lengths[-1]]
        return [self.runs[n] for n in lengths]

    def _segment(self, segment: str) -> tuple[int, ...]:
        word = segment.lstrip(SPACE)
        spaces = len(segment) - len(word)
        ids: list[int] = []
        first = bool(spaces)
        if first:
            word = SPACE + word
            if self.characters.issuperset(word):
                pieces = self._known(word)
                if spaces > 1 or pieces[0] == SPACE:
                    ids = self._spaces(spaces - (pieces[0] != SPACE))
                    del pieces[:pieces[0] == SPACE]
                return (*ids, *map(self.ids.__getitem__, pieces))
        start = 0
        for k in range(len(word) + 1):
            if k < len(word) and word[k] in self.rank:
                continue
            if k > start:
                pieces = self._known(word[start:k])
                if first:
                    ids += self._spaces(spaces - (pieces[0] != SPACE))
                    pieces, first = pieces[pieces[0] == SPACE:], False
                ids += map(self.ids.__getitem__, pieces)
            if k < len(word):
                ids += map(self.byte_ids.__getitem__, word[k].encode())
            start = k + 1
        return tuple(ids)

    def _looked_up(self, memory: Recent, parts: list[str], made) -> list[tuple[int, ...]]:
        found = memory.found(parts)
        if None in found:
            new: dict[str, tuple[int, ...]] = {}
            for k, ids in enumerate(found):
                if ids is None:
                    part = parts[k]
                    ids = new.get(part)
                    if ids is None:
                        ids = new[part] = made(part)
                        if len(part) <= 40:
                            memory.keep(part, ids)
                    found[k] = ids
        return found

    def _word(self, part: str) -> tuple[int, ...]:
        """A part between spaces: behind its line break, or behind a word start."""
        if part.startswith("\n"):
            rest = self._segment(part[1:]) if len(part) > 1 else ()
            return (*self._segment("\n"), *rest)
        return self._segment(SPACE + part)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without an end id."""
        if not text:
            return []
        if self.solo and not (text[0] == " " or "  " in text or SPACE in text):
            # Word starts stand alone, so every part is a segment of its own.
            parts = text.replace("\n", " \n").split(" ")
            found = self._looked_up(self.words, parts, self._word)
        else:
            segments = self.cut.findall(SPACE + text.replace(" ", SPACE))
            found = self._looked_up(self.memory, segments, self._segment)
        return list(chain.from_iterable(found))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: byte pieces as UTF-8, without control ids and the first space."""
        ids = list(ids)
        shown = self.shown
        if not self.byte_of.keys().isdisjoint(ids) or self.unknown_id in ids:
            out: list[str] = []
            held = bytearray()
            for i in ids:
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                if held:
                    out.append(_utf8(bytes(held)))
                    held.clear()
                if i == self.unknown_id:
                    out.append(" ⁇ ")
                elif i not in self.control:
                    out.append(shown[i])
            if held:
                out.append(_utf8(bytes(held)))
            text = "".join(out)
        else:
            text = "".join([shown[i] for i in ids if i not in self.control])
        spoken = next((i for i in ids if i not in self.control), None)
        starts = spoken is not None and self.surface[spoken].startswith(SPACE)
        return text[1:] if starts else text


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that begins no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at:at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


_LOADED: dict[tuple[str, int | None], Pieces] = {}


def pieces(path: str | None = None, memory: int | None = None) -> Pieces:
    """The model of a file, loaded once in each Python process; ``memory`` bounds what it
    remembers."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(MODEL)
    if (path, memory) not in _LOADED:
        _LOADED[path, memory] = Pieces(path, memory)
    return _LOADED[path, memory]


def _mapped(df: DataFrame, fields: list[T.StructField], source: str, row) -> DataFrame:
    """``df`` with columns computed from one column of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    inputs = [f.name for f in kept]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, ROWS) for whole in batches
                      for k in range(0, whole.num_rows, ROWS)):
            values = batch.column(batch.schema.get_field_index(source)).to_pylist()
            made = [row(v) for v in values]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in inputs]
            columns += [pa.array([m[k] for m in made], kinds[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, inputs + names)

    return df.mapInArrow(each, T.StructType(kept + fields))


def encode(df: DataFrame, text: str = "text", path: str | None = None,
           ids: str = "ids") -> DataFrame:
    """The rows with the ids of their texts and an end id."""
    def row(value):
        model = pieces(path)
        return (model.encode(value) + [model.end_id],)

    return _mapped(df, [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)],
                   text, row)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None,
           text: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; NULL ids are empty."""
    def row(value):
        return (pieces(path).decode(value or ()),)

    return _mapped(df, [T.StructField(text, T.StringType(), False)], ids, row)


def encode_decode(df: DataFrame, text: str = "text", path: str | None = None,
                  ids: str = "ids", decoded: str = "decoded",
                  memory: int | None = None) -> DataFrame:
    """The rows with their ids, an end id included, and the text decoded from them, in one
    pass: one Python worker and one model for each task."""
    def row(value):
        model = pieces(path, memory)
        found = model.encode(value) + [model.end_id]
        return found, model.decode(found)

    return _mapped(df, [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False),
                        T.StructField(decoded, T.StringType(), False)], text, row)


def round_trip(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The rows with the number and digest of their ids and the digest of the text decoded
    from them: encoding and decoding in one pass, so that no ids leave their task."""
    def row(value):
        model = pieces(path)
        ids = model.encode(value) + [model.end_id]
        decoded = model.decode(ids)
        listed = " ".join(map(str, ids))
        return (len(ids), hashlib.sha256(listed.encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest())

    return _mapped(df, [
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False)], text, row)
