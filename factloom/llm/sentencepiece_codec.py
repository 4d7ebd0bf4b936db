"""SentencePiece encoding and decoding of whole texts (operator 9).

A merge-type (BPE) model is encoded by backtracking instead of by a merge queue:

1. an Aho-Corasick automaton over the vocabulary gives all pieces that start at each position;
2. the longest piece is tried first; it may follow the piece before it only if merging the
   two pieces' joined characters anew gives those same two pieces;
3. where no piece fits, the position is set in a bitfield of failed positions, the last piece
   is taken back and its next shorter rival is tried.

A sequence of pieces whose neighbours are all compatible is the one the merge queue makes, so
the result is exact. Texts are cut where no piece of the vocabulary can cross, and the ids of
such a segment are kept in a bounded cache for the time of a task, which so encodes a frequent word once.
What two pieces do next to each other is kept for as long as the worker lives: that is a property of the model.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh, give_back, text_of, with_text

SPACE = "▁"
#: Entries each worker keeps; a full cache is emptied, so memory stays bounded.
SEGMENT_CACHE = 150_000
PAIR_CACHE = 400_000
#: Characters of the longest text that is a key of a cache: longer ones are encoded each time.
KEY_CHARS = 64
#: Texts are handled in slices of about so many characters, which bounds an output batch.
SLICE_CHARS = 4_000_000
#: Below any score: the pair is no piece.
ABSENT = float("-inf")
#: No piece.
NONE = -1
#: Letters without the few numeric signs that Python also counts as word characters.
LETTER = "[^\\W\\d_▁²³¹¼-¾]"
OTHER = "[\\W\\d_²³¹¼-¾]"
FINE = re.compile(f"{SPACE}*(?:{LETTER}+|(?:(?![{SPACE}\\n]){OTHER})+)|{SPACE}+|\\n+")
COARSE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class _Cache(dict):
    """Fills itself by a function and starts anew when it is full. Long texts are not kept."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= KEY_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class PieceCodec:
    """Exact encoder and decoder for a SentencePiece BPE model with an identity normaliser."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.special = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        self.byte_value = {i: int(self.pieces[i][3:-1], 16) for i in ids if model.is_byte(i)}
        self.byte_id = {value: i for i, value in self.byte_value.items()}
        self.unknown = model.unk_id()
        self.ids = {self.pieces[i]: i for i in ids if i not in self.special and i not in self.byte_value and not model.is_unused(i)}
        self.score = {piece: model.get_score(i) for piece, i in self.ids.items()}
        self.chars = {c for piece in self.ids for c in piece}
        if not self.chars <= self.ids.keys():
            raise ValueError("each character of a piece must be a piece itself")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merge(piece) == [piece]:  # a piece that merging never makes is never used
                self.automaton.add_word(piece, (i, len(piece) - 1))
        self.automaton.make_automaton()
        self.length = [len(piece) for piece in self.pieces]
        self.shorter = [NONE] * len(self.pieces)  # the longest piece that each one begins with
        for piece, (i, _) in self.automaton.items():
            self.shorter[i] = next((self.ids[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.automaton), NONE)
        edge = re.compile(LETTER)
        crosses = any(SPACE not in (a, b) and bool(edge.match(a)) != bool(edge.match(b)) for p in self.ids for a, b in pairwise(p))
        if any(b == SPACE != a for p in self.ids for a, b in pairwise(p)):
            raise ValueError("a piece goes on past a word's end; such models are not supported")
        self.split = COARSE.findall if crosses or "\n" in self.chars else FINE.findall
        self.compatible: dict[int, bool] = {}
        self.packed_pairs = array("q")
        self.segments = _Cache(self._packed, SEGMENT_CACHE)
        self.words = _Cache(self._word, SEGMENT_CACHE)
        self.shown = [self._shown(i) for i in ids]
        self.plain = pa.array([x.replace("\udc00", "") for x in self.shown], pa.string())
        #: Pieces that decode_all() leaves to decode(): parts of characters, and those that are no text at all.
        self.odd = np.array([x == "\udc00" or (i in self.special and i != self.unknown) for i, x in enumerate(self.shown)], bool)
        self.begins = np.array([i not in self.byte_value and x.startswith(SPACE) for i, x in enumerate(self.pieces)], bool)
        self._check(model)

    def forget(self) -> None:
        """Empties the caches of texts and packs that of pairs: a worker that waits for its next task holds no memory that others need."""
        self.segments.clear()
        self.words.clear()
        self.packed_pairs = array("q", (pair << 1 | fits for pair, fits in self.compatible.items()))
        self.compatible.clear()
        give_back()

    def recall(self) -> None:
        """Unpacks the pairs that forget() packed."""
        self.compatible.update((pair >> 1, bool(pair & 1)) for pair in self.packed_pairs)
        self.packed_pairs = array("q")

    def _check(self, model) -> None:
        """Refuses models whose normaliser is not the one that encode() assumes."""
        for probe in ("", " ", "a", " a  b ", "A\n\tbé一ﬁ x", "12 \U0001f600\U0001f600 x<s></s>"):
            if model.encode(probe) != self.encode(probe).tolist():
                raise ValueError("this model's normaliser or type is not supported")

    def merge(self, text: str) -> list[str]:
        """The pieces that repeated best-score merging makes of text (leftmost first on ties)."""
        parts, score = list(text), self.score.get
        pairs = [score(a + b, ABSENT) for a, b in pairwise(parts)]
        while pairs:
            best = max(pairs)
            if best == ABSENT:
                break
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = score(parts[k - 1] + parts[k], ABSENT)
            if k < len(pairs):
                pairs[k] = score(parts[k] + parts[k + 1], ABSENT)
        return parts

    def _compatible(self, last: int, piece: int) -> bool:
        """Whether merging the two pieces' characters anew gives the two again; kept for a bounded number of pairs."""
        left, right = self.pieces[last], self.pieces[piece]
        if len(self.compatible) >= PAIR_CACHE:
            self.compatible.clear()
        found = self.compatible[last * len(self.pieces) + piece] = self.merge(left + right) == [left, right]
        return found

    def _backtrack(self, text: str) -> list[int]:
        rivals: list[int] = [NONE] * len(text)  # the longest piece at each position not tried yet
        for end, (piece, before_end) in self.automaton.iter(text):  # longer pieces come later at each start
            rivals[end - before_end] = piece
        known, length, shorter, n = self.compatible.get, self.length, self.shorter, len(text)
        width = len(self.pieces)
        failed, at, last = 0, 0, NONE
        out: list[int] = []
        while at < n:
            piece = rivals[at]
            before = last * width
            while piece != NONE:
                if not failed or not failed >> (at + length[piece]) & 1:
                    if last == NONE:
                        break
                    fits = known(before + piece)
                    if fits is None:
                        fits = self._compatible(last, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece != NONE:
                rivals[at] = shorter[piece]  # what was tried at a place is not tried there again
                out.append(piece)
                at += length[piece]
                last = piece
            else:
                failed |= 1 << at
                at -= length[out.pop()]
                last = out[-1] if out else NONE
        return out

    def _packed(self, segment: str) -> bytes:
        """The ids of a segment as packed 32-bit integers."""
        if self.chars.issuperset(segment):
            return array("i", self._backtrack(segment)).tobytes()
        ids: list[int] = []
        for known, part in groupby(segment, self.chars.__contains__):
            if known:
                ids += self._backtrack("".join(part))
            else:
                ids += [i for c in part for i in ([self.byte_id[b] for b in c.encode()] if self.byte_id else [self.unknown])]
        return array("i", ids).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a text without spaces that stands after one, packed."""
        if word.isalpha():  # letters alone are never split, and are kept as a word already
            return self._packed(SPACE + word)
        return b"".join(map(self.segments.__getitem__, self.split(SPACE + word)))

    def encode(self, text: str) -> array:
        """The ids of a text, without begin or end ids."""
        ids = array("i")
        if text[:1] == " " or "  " in text or SPACE in text or text[-1:] == " ":
            ids.frombytes(b"".join(map(self.segments.__getitem__, self.split(SPACE + text.replace(" ", SPACE)))))
        elif text:
            ids.frombytes(b"".join(map(self.words.__getitem__, text.split(" "))))
        return ids

    def _shown(self, i: int) -> str:
        if i in self.byte_value:
            return chr(self.byte_value[i]) if self.byte_value[i] < 128 else "\udc00"
        if i == self.unknown:
            return " ⁇ "
        return "" if i in self.special else self.pieces[i].replace(SPACE, " ")

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are read as UTF-8, the leading space that encoding adds goes."""
        text = "".join(map(self.shown.__getitem__, ids))
        if "\udc00" in text:
            text = "".join(self._runs(ids))
        first = next((i for i in ids if i not in self.special or i == self.unknown), None)
        if first is not None and first not in self.byte_value and self.pieces[first].startswith(SPACE):
            text = text[1:]
        return text

    def decode_all(self, values: pa.ListArray) -> pa.Array:
        """decode() of each list (null: an empty text). Pieces are looked up and joined for all lists at once, where none is odd."""
        flat = values.flatten()
        ids = flat.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.plain.take(flat)), "")
        some = ends[1:] > ends[:-1]
        strip = np.zeros(len(values), bool)
        strip[some] = self.begins[ids[ends[:-1][some]]]
        texts = pc.if_else(pa.array(strip), pc.utf8_slice_codeunits(texts, 1), texts)
        counted = np.concatenate([[0], np.cumsum(self.odd[ids])])
        by_hand = counted[ends[1:]] > counted[ends[:-1]]
        if by_hand.any():
            lists = values.filter(pa.array(by_hand)).to_pylist()
            texts = pc.replace_with_mask(texts, pa.array(by_hand), pa.array(map(self.decode, lists), pa.string()))
        return texts

    def _runs(self, ids) -> Iterator[str]:
        run = bytearray()
        for i in ids:
            if i in self.byte_value:
                run.append(self.byte_value[i])
                continue
            if run:
                yield _utf8(run)
                run.clear()
            yield self.shown[i]
        yield _utf8(run)


def _utf8(run: bytearray) -> str:
    """UTF-8 where each byte that is not part of a whole character becomes U+FFFD by itself."""
    out, k = [], 0
    while k < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(run[k : k + size]).decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        k += size
    return "".join(out)


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with the ids of each whole text.

    Null and empty texts have no ids (an empty array). All other columns stay as they are; one
    already named ids_col is replaced. Rows are handled one by one, so ties and repeated rows keep
    their number, and an empty table stays empty.
    """
    return _mapped(with_text(df, text_col).drop(ids_col), text_col, ids_col, pa.list_(pa.int32()), "array<int>", model_path, _encode_column)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the text that each array of ids stands for; null ids give an empty text.

    All other columns stay; one already named text_col is replaced.
    """
    return _mapped(df.drop(text_col), ids_col, text_col, pa.string(), "string", model_path, _decode_column)


def _encode_column(model: PieceCodec, values: pa.Array) -> pa.Array:
    packed = [model.encode(x) if x else array("i") for x in values.to_pylist()]
    offsets, at = array("i", [0]), 0
    for x in packed:
        at += len(x)
        offsets.append(at)
    flat = b"".join(map(memoryview, packed))
    return pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(flat)]))


def _decode_column(model: PieceCodec, values: pa.Array) -> pa.Array:
    return model.decode_all(values)


def _mapped(df: DataFrame, source: str, target: str, arrow: pa.DataType, kind: str, model_path: str, convert) -> DataFrame:
    schema = df.select("*", F.lit(None).cast(kind).alias(target)).schema

    def run(batches):
        model = codec(model_path)
        model.recall()
        for batch in batches:
            rows = max(1, min(batch.num_rows, batch.num_rows * SLICE_CHARS // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                column = part.column(part.schema.get_field_index(source))
                yield pa.RecordBatch.from_arrays([*part.columns, convert(model, column).cast(arrow)], schema=part.schema.append(pa.field(target, arrow)))
        model.forget()

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns keep, ids and decoded of each row: encoding, then decoding of those ids, in one pass over the rows.

    Null texts count as empty: no ids, an empty decoded text. Rows are handled one by one, so repeated rows stay, an empty
    table stays empty, and long texts are coded whole. The columns keep may have any names but ids and decoded.
    """
    narrow = df.select(*keep, text_of(text_col).alias(fresh("text_to_code", *keep)))
    schema = narrow.select(*keep, F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("string").alias("decoded")).schema
    n = len(keep)

    def run(batches):
        model = codec(model_path)
        model.recall()
        for batch in batches:
            rows = max(1, min(batch.num_rows, batch.num_rows * SLICE_CHARS // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids = _encode_column(model, part.column(n))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], ids, _decode_column(model, ids)], names=[*keep, "ids", "decoded"])
        model.forget()

    return narrow.mapInArrow(run, schema)
