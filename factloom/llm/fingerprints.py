"""Document fingerprints (operator 1): SimHash, in DataFrame operations only.

The terms of a text are its shingles of SHINGLE words (lower case; near the end, what is left). Each
term votes once for each time it stands in the text, which weights it by its count: its hash adds
to 128 signed sums, one a bit, and a fingerprint's bit is set where the ones have the majority. The
votes are kept as 64 long sums that hold two 32-bit counters each, so a term costs 64 additions in
generated code, and all votes of a text are summed in the task that reads it.

search() finds all fingerprints within a Hamming radius through permuted block tables: a fingerprint
is split into blocks, and two that differ in at most radius bits agree on all but radius blocks, so
each choice of the blocks that agree is one table to join on.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import materialise, text_of, with_text

#: Words of a term.
SHINGLE = 5
#: Bits of a fingerprint: two hashes of 64.
BITS = 128
#: Bytes of text in a bucket of neighbouring documents, about. From MOST_BUCKETS on (2 TB) buckets grow instead, to
#: 200 MB at 100 TB: their first rows are broadcast, which so stays below 32 MB.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 500_000
#: Ranges of ids that buckets are laid out in, and ids that are looked at to find them.
RANGES, LOOKED_AT = 512, 200_000
#: Bits of two lanes that a hash adds to at once.
LANES = 0x0000000100000001
LEAST = -(1 << 63)


def words_of(text: Column) -> Column:
    """The lower-cased words of a text; an empty text has one empty word."""
    return F.split(F.lower(text), "[ \\t-\\r]+")


def terms(words: Column) -> Column:
    """The words that start at each word, SHINGLE at most."""
    later = (F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))) for k in range(1, SHINGLE))
    return F.arrays_zip(words, *later)


def votes() -> list[Column]:
    """The sums of bit votes over rows that have a long column hash."""
    first, second = F.col("hash"), F.xxhash64("hash")
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))).alias(f"v{i}_{k}") for i, h in enumerate((first, second)) for k in range(32)]


def fingerprint_of_votes() -> Column:
    """32 hexadecimal digits from the columns of votes() and n, the number of terms."""
    majority = lambda count: F.when(count * 2 > F.col("n"), "1").otherwise("0")
    parts = []
    for i in (0, 1):
        lanes = F.array(*(F.col(f"v{i}_{k}") for k in range(32)))
        high = F.transform(lanes, lambda x: majority(F.shiftrightunsigned(x, 32)))
        low = F.transform(lanes, lambda x: majority(x.bitwiseAND(F.lit(0xFFFFFFFF))))
        parts += [F.lpad(F.lower(F.conv(F.array_join(bits, ""), 2, 16)), 8, "0") for bits in (high, low)]
    return F.concat(*parts)


def _half(fingerprint: Column, start: int) -> Column:
    return F.conv(F.substring(fingerprint, start, 16), 16, -10).cast("long")


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1))) + F.bit_count(_half(a, 17).bitwiseXOR(_half(b, 17)))


def likeness(a: Column, b: Column) -> Column:
    """The share of bits in which two fingerprints agree."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def _summed(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and fingerprint; the keys of a row must be its own, and rows must be dealt by some of them to save a shuffle."""
    found = rows.select(*keys, words_of(F.col(text_col)).alias("words"))
    found = found.select(*keys, F.explode(terms(F.col("words"))).alias("term"))
    found = found.select(*keys, F.xxhash64(*(F.col("term")[name] for name in found.schema["term"].dataType.names)).alias("hash"))
    return found.groupBy(*keys).agg(F.count("*").alias("n"), *votes()).select(*keys, fingerprint_of_votes().alias("fingerprint"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the fingerprint of each row's whole text (null: empty).

    Equal texts have equal fingerprints. Rows that repeat an id stay apart by their text; rows equal in
    id and text become one. An empty table gives no rows; other columns are ignored.
    """
    with_text(df, text_col)
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["id", "digest"])
    return _summed(rows, ["id", "digest"], "text").select(F.col("id").alias(id_col), "fingerprint")


def id_ranges(rows: DataFrame, buckets: int) -> list[dict]:
    """Ranges of the column own, from high to low: low (not in it), high, buckets, and the number of the first one.

    RANGES quantiles of some ids give ranges of about as many rows; a range has buckets by its share. An id
    that so many rows have that it is several quantiles is a range of its own. Only how evenly rows are
    dealt depends on this.
    """
    n, least, most = rows.agg(F.count("*"), F.min("own"), F.max("own")).first()
    parts = min(RANGES, buckets)
    if parts < 2 or not n:
        return [{"low": None, "high": most, "k": buckets, "first": 0, "one": least == most, "span": float((most or 0) - (least or 0) + 1)}]
    shares = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    some = rows.select("own").sample(min(1.0, LOOKED_AT / n), 7).agg(F.percentile_approx("own", shares, 10 * RANGES)).first()[0] or []
    times = Counter([*some, most])
    heavy = {x for x, m in times.items() if m > 1}
    edges = sorted(set(times) | {x - 1 for x in heavy if x > least})
    out, low, number = [], least - 1 if least > LEAST else None, 0
    for high in edges:
        one = high in heavy
        share = (times.get(high, 1) if one else 1) / parts
        out.append({"low": low, "high": high, "k": max(1, math.ceil(buckets * share)), "one": one, "span": float(high - (least if low is None else low))})
        low = high
    for x in reversed(out):
        x["first"], number = number, number + x["k"]
    return out


def bucket_of(ranges: list[dict], own: Column, mark: Column) -> Column:
    """The bucket of a row, ascending in the order of descending own and ascending mark (a 64-bit hash)."""
    edges = F.from_json(F.lit(json.dumps([x["high"] for x in ranges[:-1]])), "array<bigint>")
    table = F.from_json(F.lit(json.dumps([{k: x[k] for k in ("high", "k", "first", "one", "span")} for x in ranges])), "array<struct<high: bigint, k: bigint, first: bigint, one: boolean, span: double>>")
    # a literal table is parsed once for each task, and searched in two steps of about the root of its length
    width = max(1, math.isqrt(len(ranges)))
    heads = F.from_json(F.lit(json.dumps([x["high"] for x in ranges[width - 1 : -1 : width]])), "array<bigint>")
    group = F.size(F.filter(heads, lambda e: e < own)) * width
    inside = F.size(F.filter(F.slice(edges, (group + 1).cast("int"), width), lambda e: e < own))
    at = F.element_at(table, (group + inside + 1).cast("int"))
    down = (at["high"].cast("double") - own.cast("double")) / at["span"]
    along = F.when(at["one"], (mark.cast("double") + 2.0**63) / 2.0**64).otherwise(down)
    return at["first"] + F.greatest(F.lit(0), F.least(at["k"] - 1, F.floor(along * at["k"])))


def in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, place, halo, id, text and following: each text with the next one by descending id.

    Ids are cut into buckets of about BUCKET_BYTES of text, which follow each other in that order. The first
    row of a bucket is also copied to the end of the bucket before it (the very first to the very last) as
    a halo row, so that each row's next one is in its own bucket, and one shuffle of the texts is enough.
    """
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.select("id", F.coalesce(F.col("id").cast("long"), F.lit(LEAST)).alias("own"), F.xxhash64("text").alias("mark"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = id_ranges(rows, min(MOST_BUCKETS, size // BUCKET_BYTES + 1))
    rows = rows.withColumn("bucket", bucket_of(ranges, F.col("own"), F.col("mark")))
    head = F.min(F.struct((F.lit(-1) - F.col("own")).alias("down"), "mark")).alias("head")
    marks = rows.groupBy("bucket").agg(head).select("bucket", (F.lit(-1) - F.col("head.down")).alias("own"), F.col("head.mark").alias("mark"))
    # a row for each bucket, MOST_BUCKETS or so at most
    order = W.orderBy("bucket")
    last = F.max("bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    firsts = materialise(marks.select("bucket", "own", "mark", F.coalesce(F.lag("bucket").over(order), last).alias("before")), "bucket-heads")
    at = lambda bucket, halo: F.struct(F.col(bucket).alias("bucket"), F.lit(halo).alias("halo"))
    rows = rows.join(F.broadcast(firsts), ["bucket", "own", "mark"], "left")
    rows = rows.select("id", "own", "mark", "text", F.inline(F.when(F.col("before").isNull(), F.array(at("bucket", 0))).otherwise(F.array(at("bucket", 0), at("before", 1)))))
    order = W.partitionBy("bucket").orderBy("halo", F.col("own").desc(), "mark")
    return rows.select("bucket", F.row_number().over(order).alias("place"), "halo", "id", "text", F.lead("text").over(order).alias("following"))


def with_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likeness.

    The edited text is the text whose last floor(n_chars / 3) characters are replaced by the first as
    many of the next document by descending id (after the last one: the first). One row for each row:
    id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Null texts count as empty, and all empty texts have one fingerprint. Null ids come last; rows with
    the same id are in the order of a hash of their texts. A table of one row is its own next. An empty
    table gives no rows; other columns are ignored.
    """
    with_text(df, text_col)
    rows = in_order(df, id_col, text_col)
    size = F.char_length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", 1, size - third), F.substring(F.coalesce("following", F.lit("")), 1, third))
    rows = rows.select("bucket", "place", "halo", "id", "text", edited.alias("edited"))
    keys = ["bucket", "place", "halo", "id", "n_chars", "sha", "version"]
    rows = rows.select("bucket", "place", "halo", "id", F.char_length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"), F.posexplode(F.array("text", "edited")).alias("version", "text"))
    found = _summed(rows, keys, "text")
    both = found.groupBy("bucket", "place", "halo", "id", "n_chars", "sha").agg(F.max(F.when(F.col("version") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("version") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    both = both.withColumn("following", F.lead("fingerprint").over(W.partitionBy("bucket").orderBy("place"))).where("halo = 0")
    return both.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )


def search(found: DataFrame, queries: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All pairs (query, fingerprint, distance) of distinct fingerprints at most radius bits apart.

    found and queries have a column fingerprint; copies are collapsed first on both sides, so a
    fingerprint that a third of all rows share is one row here. A pair is made by the first of the
    tables that agree on it, so none comes twice. Null fingerprints find nothing. With more blocks
    there are more tables with longer keys; radius + 1 blocks make radius + 1 tables.
    """
    blocks = blocks or radius + 1
    width = -(-32 // blocks)
    tables = list(combinations(range(blocks), blocks - radius))
    if blocks <= radius or width * (blocks - 1) >= 32:
        raise ValueError("there must be more blocks than radius, and at most 32")
    bits = [min(4 * width, BITS - 4 * width * k) for k in range(blocks)]

    def same(high: Column, low: Column, table: tuple[int, ...]) -> tuple[Column, Column]:
        """The bits of a fingerprint's halves that lie in the table's blocks."""
        mask = sum(((1 << bits[k]) - 1) << (BITS - 4 * width * k - bits[k]) for k in table if bits[k] > 0)
        long = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
        return high.bitwiseAND(long(mask >> 64)), low.bitwiseAND(long(mask & ((1 << 64) - 1)))

    def keys(high: str, low: str) -> Column:
        return F.array(*(F.xxhash64(F.lit(k), *same(F.col(high), F.col(low), t)) for k, t in enumerate(tables)))

    def entries(df: DataFrame, high: str, low: str) -> DataFrame:
        """A row for each table and fingerprint: three numbers, as all of them are shuffled."""
        one = df.select(_half(F.col("fingerprint"), 1).alias(high), _half(F.col("fingerprint"), 17).alias(low)).where(F.col("fingerprint").isNotNull()).distinct()
        return one.select(high, low, F.explode(keys(high, low)).alias("key"))

    # merged at every size: a side that looks small grows by the number of tables, and is not broadcast then
    pairs = entries(found, "high", "low").join(entries(queries, "query_high", "query_low").hint("merge"), "key")
    apart = [F.col("high").bitwiseXOR(F.col("query_high")), F.col("low").bitwiseXOR(F.col("query_low"))]
    agree = F.array(*(same(*apart, t)[0].bitwiseOR(same(*apart, t)[1]) == 0 for t in tables))
    first = F.element_at(keys("high", "low"), F.array_position(agree, True).cast("int"))
    pairs = pairs.withColumn("distance", F.bit_count(apart[0]) + F.bit_count(apart[1])).where((F.col("distance") <= radius) & (F.col("key") == first))
    text = lambda high, low: F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (high, low))))
    return pairs.select(text("query_high", "query_low").alias("query"), text("high", "low").alias("fingerprint"), "distance")


def count_within(rows: DataFrame, asked: Column, radius: int = 3, blocks: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """rows (with a column fingerprint), n_within and first_within: how many rows have a fingerprint within the radius, and their smallest id.

    They are found for the rows for which asked holds, their own row included, and null for the others.
    Fingerprints are counted before they are joined, so that copies cost one row.
    """
    rows = materialise(rows, "fingerprints")
    queries = rows.where(asked).select("fingerprint")
    copies = materialise(rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(id_col).alias("least")), "fingerprint-counts")
    near = search(copies, queries, radius, blocks).join(copies, "fingerprint")
    near = near.groupBy(F.col("query").alias("fingerprint")).agg(F.sum("n").alias("n_within"), F.min("least").alias("first_within"))
    none = {"n_within": F.lit(None).cast("long"), "first_within": F.lit(None).cast(rows.schema[id_col].dataType)}
    others = rows.where(F.coalesce(~asked, F.lit(True))).withColumns(none)
    return rows.where(asked).join(near, "fingerprint").select(others.columns).unionByName(others)
