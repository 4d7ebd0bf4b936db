"""Substring dedup (operator 5): content-defined chunks, held together as windows of a least number of words.

A gear hash is rolled over a text's bytes: it is shifted left by one bit and a random number for the new byte is
added. A text is cut before words: of each WINDOW words in a row, the one with the least low half of the hash before
it (the last one of equals) is a cut. Those 16 bits depend on the 16 bytes before a cut only, so two texts that share a
passage have the same cuts from the first one chosen inside it to the last one. Sixteen bytes are eight words at
most, so WINDOW + 7 words at most are lost before these and WINDOW - 1 after them, and any passage of 51 words
leaves 20 words or more between them, whatever its words. Words of more than PIECE_BYTES bytes are cut further where
some bits of the same hash are all zero.

What is deduplicated is a window: from each cut the fewest chunks in a row that hold least_words words,
and before each cut where no such window ends the fewest chunks that lead up to it. A window is one
stretch of bytes, known by a 96-bit digest, so what is cut stands in one piece in an earlier place:
chunks that repeat by chance here and there are never put together. The first place of a window
(smallest id, then position) keeps it, later places are repeats, and all repeats together are cut.
A document is its id and a hash of its text, so rows that share an id, or have none, are told apart; should two of one id
agree in that hash, nothing is cut that is not where it was found, as each window's digest is held against the text again.

Windows are found once and written; only digests travel, counted on each side before the shuffle. The
few digests that repeat are written too and joined to all windows as plain tables, so that Spark can
split the join where a passage is in a third of all texts. Texts are shuffled once, to meet their cuts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh, give_back, materialise, text_of, with_text
from factloom.llm.ngram_join import SPACES

#: Words of which one is a cut, and the bits of the hash before a word by which it is chosen.
WINDOW, CHOICE = 12, 0xFFFF
#: A chunk has MIN_BYTES bytes at least and MAX_BYTES at most; a piece of a long word has PIECE_BYTES at least,
#: and PIECE_BYTES + MASK + 1 or so on average.
MIN_BYTES, PIECE_BYTES, MASK, MAX_BYTES = 1, 24, 31, 192
#: Words of a window, in whole or in part.
LEAST_WORDS = 20
#: Stands for a null id.
LEAST = -(1 << 63)
#: Bytes whose hashes are found at once.
BLOCK = 1 << 22

#: A random 32-bit number for each byte value, made from digests of the value.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=4, person=b"gear").digest(), "big") for k in range(256)], dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of GEAR[byte j back] << j, found by doubling the window."""
    h = GEAR[data]
    for window in (1, 2, 4, 8, 16):
        shifted = h[:-window] << np.uint32(window)
        h = h.copy()
        h[window:] += shifted
    return h


def rolled(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The gear hashes of a text's bytes, BLOCK bytes at a time, each with its first byte's number."""
    for start in range(0, len(data), BLOCK):  # 31 bytes before a block settle its first hashes
        lead = min(start, 31)
        yield start, gear_hashes(data[start - lead : start + BLOCK])[lead:]


def chosen(hashes: np.ndarray) -> np.ndarray:
    """The numbers of the words before which a text is cut, given by the gear hash before each word."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64)
    least = sliding_window_view(hashes[::-1], WINDOW).argmin(axis=1) + np.arange(len(hashes) - WINDOW + 1)
    return np.unique(len(hashes) - 1 - least)


def cut_places(data: bytes) -> list[int]:
    """The ends of the chunks of a text's bytes, the last one its length."""
    raw = np.frombuffer(data, np.uint8)
    change = np.flatnonzero(np.diff(SPACES[raw], prepend=True, append=True))  # where words start and end, in turn
    starts, stops = change[::2], change[1::2]
    before, zeros = np.full(len(starts), CHOICE + 1, np.uint32), []  # nothing is cut before the first byte
    for begin, hashes in rolled(raw):
        a, b = np.searchsorted(starts, [begin + 1, begin + len(hashes) + 1])
        before[a:b] = hashes[starts[a:b] - 1 - begin] & np.uint32(CHOICE)
        zeros.append(np.flatnonzero((hashes >> np.uint32(8)) & np.uint32(MASK) == 0) + begin + 1)
    marks = starts[chosen(before)].tolist()
    for k in np.flatnonzero(stops - starts > PIECE_BYTES).tolist():
        marks += piece_places(int(starts[k]), int(stops[k]), np.concatenate(zeros))
    ends, last = [], 0
    for place in [*sorted(set(marks)), len(data)]:
        while place - last > MAX_BYTES:
            last += MAX_BYTES
            ends.append(last)
        if place > last:
            ends.append(place)
            last = place
    return ends


def piece_places(start: int, stop: int, zeros: np.ndarray) -> list[int]:
    """Where a long word's bytes are cut: at zeros (sorted places after bytes whose hash has zero bits), PIECE_BYTES apart."""
    places, last = [], start
    inside = zeros[np.searchsorted(zeros, start + PIECE_BYTES) : np.searchsorted(zeros, stop)]
    for place in inside.tolist():
        if place - last >= PIECE_BYTES:
            places.append(place)
            last = place
    return places


def windows(data: bytes, least_words: int) -> list[tuple[int, int]]:
    """The windows of a text's bytes: start and end, in order. A part of a word counts as one."""
    ends = cut_places(data)
    if not ends:
        return []
    space = SPACES[np.frombuffer(data, np.uint8)]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    marks = np.array([0, *ends])
    before = np.searchsorted(starts, marks)  # words that start before each mark
    inner = np.concatenate([[False], ~space[marks[1:-1]] & ~space[marks[1:-1] - 1]]).astype(np.int64)  # is a mark inside a word
    n = np.arange(len(ends))
    forward = np.maximum(np.searchsorted(before, before[:-1] + least_words - inner), n + 1)
    found = {(int(i), int(j)) for i, j in zip(n, forward, strict=True) if j <= len(ends)}
    for j in set(range(1, len(ends) + 1)).difference(forward.tolist()):
        i = int(np.searchsorted((before[:-1] - inner)[:j], before[j] - least_words, side="right")) - 1
        if i >= 0:
            found.add((i, j))
    return [(int(marks[i]), int(marks[j])) for i, j in sorted(found)]


#: place has start (from bit 32), whether the same text has the window earlier (bit 31) and length (31 bits).
WINDOWS = "id bigint, version bigint, digest bigint, more int, place bigint"
AGAIN, LENGTH = 1 << 31, (1 << 31) - 1


def digest_of(window: bytes) -> tuple[int, int]:
    """96 bits of a window's hash, as two signed numbers."""
    digest = xxhash.xxh3_128_intdigest(window)
    return (digest & (1 << 64) - 1) - (1 << 63), (digest >> 64 & (1 << 32) - 1) - (1 << 31)


def window_table(ids: list, texts: list[str], versions: list[int], least_words: int) -> list[list]:
    """The columns of WINDOWS for all windows of the texts. Earlier places in the same text count if they do not overlap."""
    columns: list[list] = [[] for _ in range(5)]
    add = [x.append for x in columns]
    for own, text, version in zip(ids, texts, versions, strict=True):
        data = text.encode()
        ended: dict[tuple[int, int], int] = {}  # where the first place of a digest ends
        for start, end in windows(data, least_words):
            key = digest_of(data[start:end])
            place = start << 32 | end - start | (AGAIN if ended.setdefault(key, end) <= start else 0)
            for append, value in zip(add, (own, version, *key, place), strict=True):
                append(value)
    return columns


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about BLOCK bytes, so that few rows at a time become Python objects."""
    step = max(1, min(batch.num_rows, batch.num_rows * BLOCK // max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _windows(least_words: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    names = [x.split()[0] for x in WINDOWS.split(", ")]

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                columns = window_table(*(c.to_pylist() for c in batch.columns), least_words)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=names)
        give_back()

    return run


def keyed(df: DataFrame, id_col: str, text_col: str) -> list:
    """The id (null: the smallest number) and version (a hash of the text) that name a document here."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)), F.xxhash64(text_of(text_col))]


def found_windows(df: DataFrame, least_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The windows of each row; see window_table()."""
    own, version = keyed(df, id_col, text_col)
    return df.select(own.alias("id"), text_of(text_col).alias("text"), version.alias("version")).mapInArrow(_windows(least_words), WINDOWS)


def repeats(found: DataFrame) -> DataFrame:
    """The windows that stand earlier too, with first: in a smaller id, in another text of the same id, or before in their own text.

    found must be written already, as it is read twice. first is the smallest id that has the window; of several
    texts of that id the one with the smallest version keeps it.
    """
    firsts = found.groupBy("digest", "more").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = materialise(firsts.where(F.col("n") > 1).drop("n"), "first-places")
    repeated = materialise(found.join(firsts, ["digest", "more"]), "repeated")
    later = (F.col("id") > F.col("first")) | (F.shiftright("place", 31).bitwiseAND(F.lit(1)) == 1)
    same = repeated.where("id = first").groupBy("digest", "more").agg(F.min("version").alias("keeper"), F.max("version").alias("other"))
    same = materialise(same.where("keeper <> other").drop("other"), "keepers")  # ids that several rows have
    if same.isEmpty():
        return repeated.where(later)
    return repeated.join(same, ["digest", "more"], "left").where(later | (F.col("version") != F.col("keeper"))).drop("keeper")


def spans(repeated: DataFrame) -> DataFrame:
    """id, version and the sorted places of each document's repeats with their firsts and digests (no more than its own windows)."""
    return repeated.groupBy("id", "version").agg(F.array_sort(F.collect_set(F.struct("place", "first", "digest", "more"))).alias("places"))


def standing(data: bytes, places: Iterable[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """start, end and first of those places whose window is there in the text's bytes."""
    for place, first, digest, more in places:
        start = place >> 32
        end = start + (place & LENGTH)
        if digest_of(data[start:end]) == (digest, more):
            yield start, end, first


def runs_of(places: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted places (start, end, first) as runs of bytes that adjoin no other, each with the first that most of its windows have."""
    runs: list[list] = []
    for start, end, first in places:
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([start, end, Counter()])
        runs[-1][2][first] += 1
    return [(start, end, min(firsts, key=lambda x: (-firsts[x], x))) for start, end, firsts in runs]


def cut(text: str, runs: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without the runs, and what was cut as character positions with its first."""
    data = text.encode()
    kept, gone, at = [], [], 0
    for start, end, first in runs:
        while start > 0 and start < end and data[start] & 0xC0 == 0x80:  # whole characters only
            start += 1
        while end < len(data) and end > start and data[end] & 0xC0 == 0x80:
            end -= 1
        kept.append(data[at:start])
        gone.append((start, end, first))
        at = end
    kept.append(data[at:])
    places = [(len(data[:a].decode()), len(data[:b].decode()), first) for a, b, first in gone]
    return b"".join(kept).decode(), places


def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, spans_col: str | None = "cut_spans") -> DataFrame:
    """df with its repeated passages cut out of text_col, and the places of the cuts in spans_col.

    Of passages that repeat, those in the row with the smallest id stay (null ids first); repeats
    inside one text count too, the first stays. Of rows that share an id, or have none, and differ in text one keeps
    a passage; rows that are equal in id and text are one document and treated alike. spans_col (none if None) is an
    array of struct(start, end, first) in characters of the whole text, empty where nothing was cut; first
    is the id that keeps the passage (of most of its windows).
    Null texts stay null and cut nothing; texts that repeat whole become empty; no row is dropped.
    Other columns stay as they are, an empty table stays empty.
    """
    with_text(df, text_col)
    found = materialise(found_windows(df, least_words, id_col, text_col), "windows")
    found = materialise(spans(repeats(found)), "spans")
    rows = df.drop(spans_col) if spans_col else df
    *names, gone = (fresh(x, *rows.columns) for x in ("own_id", "text_version", "own_places"))
    rows = rows.withColumns(dict(zip(names, keyed(df, id_col, text_col), strict=True)))
    found = found.toDF(*names, gone)
    rows = rows.join(found, names, "left").drop(*names)
    names = [c for c in rows.columns if c != gone]
    at = names.index(text_col)
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first", pa.int64())]))

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                texts, places, a = batch.column(at).to_pylist(), [], 0
                own = batch.column(len(names))
                flat = [x.to_pylist() for x in own.flatten().flatten()]  # the fields of all rows' places
                for k, n in enumerate(pc.fill_null(pc.list_value_length(own), 0).to_pylist()):
                    cuts: list[tuple[int, int, int]] = []
                    if n and texts[k]:
                        texts[k], cuts = cut(texts[k], runs_of(standing(texts[k].encode(), zip(*(x[a : a + n] for x in flat), strict=True))))
                    a += n
                    places.append([{"start": x, "end": y, "first": None if first == LEAST else first} for x, y, first in cuts])
                columns = [*batch.columns[: len(names)]]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(places, pair)] if spans_col else [])], names=[*names, *([spans_col] if spans_col else [])])
        give_back()

    schema = rows.drop(gone).select("*", *([F.lit(None).cast("array<struct<start: bigint, end: bigint, first: bigint>>").alias(spans_col)] if spans_col else [])).schema
    return rows.mapInArrow(run, schema)
