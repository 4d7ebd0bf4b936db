"""Runs of periodic words, found and collapsed (operator 12).

A run is a stretch of consecutive words in which words one period apart are identical, that no neighbouring word
extends, and whose period is the smallest that it has. Stretches of 2**k words are named by Karp, Miller and
Rosenberg: names of level 0 are words, a name of level k + 1 stands for the pair of names of level k of its two
halves, so equal stretches have equal names. Names that occur once in their text are dropped, since they can be
equal to nothing: on ordinary prose few stretches are left after two or three levels.

How far two places agree is read from the names, from the longest down. A run of period q with four periods or
more covers a multiple of q from which it goes on for 2q + 1 words and more, so it is enough to compare names
at multiples of q with those q words further (n/q comparisons for each q) and to extend the few that agree.

Texts are worked on in tasks, many at once: their words get names of their own, so that nothing is ever equal across
texts. Memory grows with the longest text (4 bytes a word and level), not with the table.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh, text_of, with_text

#: Bytes of text that are named together; a longer text is taken alone.
PART_BYTES = 1 << 21


def name_levels(letters: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... letters that start at each place, -1 where a stretch occurs once.

    letters are numbers below their count n. Each level has n + 1 places, the last of which has no name.
    """
    n = len(letters)
    often = np.bincount(letters, minlength=1)[letters] > 1 if n else np.zeros(0, bool)
    levels = [np.append(np.where(often, letters, -1), -1).astype(np.int32)]
    width = 1
    while width < n:
        below = levels[-1]
        at = np.flatnonzero((below[: n - width] >= 0) & (below[width:n] >= 0))
        pairs = below[at].astype(np.int64) * n + below[at + width]
        _, name, count = np.unique(pairs, return_inverse=True, return_counts=True)
        again = count[name] > 1
        if not again.any():
            break
        level = np.full(n + 1, -1, np.int32)
        level[at[again]] = name[again]
        levels.append(level)
        width *= 2
    return levels


def reach_right(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters from a on equal those from b on (a < b)."""
    reach = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        left = levels[k][a + reach]
        reach += ((left >= 0) & (left == levels[k][b + reach])).astype(np.int64) << k
    return reach


def reach_left(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters before a equal those before b (a < b)."""
    reach = np.zeros(len(a), np.int64)
    none = len(levels[0]) - 1
    for k in reversed(range(len(levels))):
        at = a - reach - (1 << k)
        left = levels[k][np.where(at >= 0, at, none)]
        reach += ((left >= 0) & (left == levels[k][np.where(at >= 0, b - reach - (1 << k), none)])).astype(np.int64) << k
    return reach


def runs_of(letters: np.ndarray, lengths: np.ndarray, min_words: int, min_times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs in texts that follow one another, the longest text first.

    Letters of different texts must differ. Runs come by start, then period.
    """
    levels, ends = name_levels(letters), np.cumsum(lengths)
    places, periods = [], []
    for q in range(1, int(lengths[0]) // min_times + 1 if len(lengths) else 1):
        k = ((min_times - 2) * q + 1).bit_length() - 1
        if k >= len(levels):
            break
        long_enough = int(np.searchsorted(-lengths, -max(min_words, min_times * q), side="right"))
        end = int(ends[long_enough - 1]) if long_enough else 0
        here = levels[k][0 : max(0, end - q) : q]
        same = (here >= 0) & (here == levels[k][q:end:q])
        same[1:] &= ~same[:-1]  # neighbours that agree lie in one stretch, as names are longer than q
        at = np.flatnonzero(same) * q
        places.append(at)
        periods.append(np.full(len(at), q))
    place, period = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (places, periods))
    start = place - reach_left(levels, place, place + period)
    end = place + period + reach_right(levels, place, place + period)
    kept = end - start >= np.maximum(min_words, min_times * period)
    start, end, period = start[kept], end[kept], period[kept]
    # a stretch of four periods or more has its smallest period among the divisors of the others
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _collapsed(texts: list[bytes], min_words: int, min_times: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Runs and collapsed text of each of some texts."""
    words = [x.split() for x in texts]  # bytes are split at ASCII white space only
    order = sorted(range(len(texts)), key=lambda k: -len(words[k]))
    lengths = np.array([len(words[k]) for k in order], np.int64)
    letters, base = np.empty(int(lengths.sum()), np.int64), 0
    for k in order:
        n, first = len(words[k]), {}
        letters[base : base + n] = np.fromiter(map(first.setdefault, words[k], range(base, base + n)), np.int64, n)
        base += n
    starts, sizes, periods = runs_of(letters, lengths, min_words, min_times)
    dropped = np.zeros(base + 1, np.int32)
    np.add.at(dropped, starts + periods, 1)
    np.add.at(dropped, starts + sizes, -1)
    kept = np.cumsum(dropped) == 0
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    left: list[bytes] = [b""] * len(texts)
    ends = np.cumsum(lengths)
    which = np.searchsorted(ends, starts, side="right")
    for at, start, size, period in zip(which.tolist(), starts.tolist(), sizes.tolist(), periods.tolist(), strict=True):
        runs[order[at]].append((start - int(ends[at] - lengths[at]), size, period))
    for at, k in enumerate(order):
        end = int(ends[at])
        left[k] = b" ".join(compress(words[k], kept[end - len(words[k]) : end].tolist()) if runs[k] else words[k])
    return runs, left


def collapse(df: DataFrame, keep: tuple[str, ...] | None = None, text_col: str = "text", min_words: int = 6, min_times: int = 4) -> DataFrame:
    """The columns keep (all, if not named), runs and collapsed of each row's whole text.

    Words are what ASCII white space parts. runs is an array of (start, length, period) in words from 0, by start, then
    period: all runs of min_words words or more and min_times periods or more (4 at least). collapsed has the words
    that no run repeats, one blank between them: of each run its first period stays.

    Null and empty texts have no runs and an empty collapsed text. Rows are handled one by one, so ties and repeated
    rows keep their number, an empty table stays empty, and long texts are never cut. Columns of df that are named
    runs or collapsed are replaced; others may have any name.
    """
    if min_times < 4:
        raise ValueError("runs of fewer than four periods are not told apart from chance agreement")
    keep = tuple(x for x in df.columns if x.lower() not in ("runs", "collapsed")) if keep is None else keep
    text = fresh("text_to_collapse", *keep)
    narrow = with_text(df, text_col).select(*keep, text_of(text_col).alias(text))
    schema = narrow.select(*keep, F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"), F.lit(None).cast("string").alias("collapsed")).schema
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            begin = 0
            for end in _parts(pc.binary_length(batch.column(len(keep))).to_pylist()):
                part = batch.slice(begin, end - begin)
                runs, left = _collapsed(part.column(len(keep)).cast(pa.binary()).to_pylist(), min_words, min_times)
                found = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in x] for x in runs], run_type)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], found, pa.array(left, pa.binary()).cast(pa.string())], names=[*keep, "runs", "collapsed"])
                begin = end

    return narrow.mapInArrow(run, schema)


def _parts(sizes: list[int]) -> list[int]:
    """Ends of parts of rows, each of PART_BYTES at most or of one row."""
    ends, total = [], 0
    for at, size in enumerate(sizes):
        if total and total + size > PART_BYTES:
            ends.append(at)
            total = 0
        total += size
    return [*ends, len(sizes)] if len(sizes) else []
