"""Places of quotations in the texts that they cite, also where a quotation is not exact.

Seed and extend: words in a row that a quotation and its text share vote for the offset between the two, and only
where most votes fall is the quotation held against the text word by word, by edit distance within a band around that offset.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a row that vote together; shorter quotations vote by fewer.
SEED = 3
#: Words by which a place may be off its offset on either side, at least, and as a share of the quotation.
BAND, BAND_SHARE = 4, 4
#: Characters of texts that are worked on at once, about.
SLICE_BYTES = 4 << 20

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """The words of a text (runs of letters and digits) in lower case, with where each starts and ends."""
    return [(x[0].lower(), x.start(), x.end()) for x in _WORD.finditer(text)]


def best_offset(quote: list[str], places: dict[str, list[int]], text: list[str]) -> int | None:
    """The offset of the quotation in the text that most seeds vote for (the smallest of equals); None without a vote.

    Offsets that differ by a word or two are one place with a word more or less, so a vote counts for its neighbours too.
    """
    for size in range(min(SEED, len(quote)), 0, -1):
        votes: Counter[int] = Counter()
        for i in range(len(quote) - size + 1):
            seed = quote[i : i + size]
            for j in places.get(seed[0], ()):
                if text[j : j + size] == seed:
                    votes[j - i] += 1
        if votes:
            near = {offset: sum(votes.get(offset + k, 0) for k in (-2, -1, 0, 1, 2)) for offset in votes}
            return min(votes, key=lambda x: (-near[x], -votes[x], x))
    return None


def aligned(quote: list[str], text: list[str]) -> tuple[int, int, int]:
    """Edit distance in words of the quotation to the stretch of text that is nearest to it, and its start and end.

    Of stretches that are as near the one that ends first, then the longest is taken.
    """
    above = [(0, j) for j in range(len(text) + 1)]  # distance and start of the best stretch that ends before each word
    for i, word in enumerate(quote, 1):
        row = [(i, 0)]
        for j, other in enumerate(text, 1):
            (a, at_a), (b, at_b), (c, at_c) = above[j - 1], above[j], row[j - 1]
            row.append(min((a + (word != other), at_a), (b + 1, at_b), (c + 1, at_c)))
        above = row
    end = min(range(len(above)), key=lambda j: (above[j][0], j))
    return above[end][0], above[end][1], end


def place_of(quote: str, text_words: list[tuple[str, int, int]], places: dict[str, list[int]]) -> tuple[int, int, int] | None:
    """Start and end (characters) of a quotation's nearest stretch and its distance in words; None if no word of it is in the text."""
    own = [x[0] for x in words_of(quote)]
    words = [x[0] for x in text_words]
    offset = best_offset(own, places, words)
    if offset is None:
        return None
    band = max(BAND, len(own) // BAND_SHARE)
    first, last = max(0, offset - band), min(len(words), offset + len(own) + band)
    distance, start, end = aligned(own, words[first:last])
    if start == end:
        return None
    return text_words[first + start][1], text_words[first + end - 1][2], distance


def quote_places(quotes: DataFrame, snippets: DataFrame) -> DataFrame:
    """quote_id, snippet_id, part, start, end and distance of each part of each quotation (parts are joined by ...).

    start and end are characters of the snippet's text, distance counts words that are put in, left out or replaced: 0 for
    an exact part, whatever its case and punctuation. They are null where the snippet is missing or null, or shares no
    word with the part. A quotation without words has one part without a place. Quotations meet their snippet by an
    equi join, so that a text is only held against what cites it; ties and repeated rows stay.
    """
    parts = F.filter(F.split(F.coalesce("quote", F.lit("")), r"\.\.\."), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    cut = quotes.select("quote_id", "snippet_id", F.posexplode_outer(parts).alias("part", "said"))
    found = cut.join(snippets.select("snippet_id", "text"), "snippet_id", "left").select("quote_id", "snippet_id", F.coalesce("part", F.lit(0)).alias("part"), "said", "text")
    schema = found.drop("said", "text").select("*", *(F.lit(None).cast("long").alias(c) for c in ("start", "end", "distance"))).schema
    return found.mapInArrow(_places, schema)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        step = max(1, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes))
        for begin in range(0, whole.num_rows, step):
            batch = whole.slice(begin, step)
            places, known = [], None
            for said, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if said is None or text is None:
                    places.append(None)
                    continue
                if known is None or known[0] is not text and known[0] != text:
                    words, where = words_of(text), {}
                    for k, (word, _, _) in enumerate(words):
                        where.setdefault(word, []).append(k)
                    known = text, words, where
                places.append(place_of(said, known[1], known[2]))
            columns = [pa.array([None if x is None else x[k] for x in places], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["quote_id", "snippet_id", "part", "start", "end", "distance"])
