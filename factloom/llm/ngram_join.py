"""N-gram Jaccard join (operator 3): an exact prefix-tree join of the texts' shingle sets.

1. Each text becomes the set of hashes of its shingles. Texts with one set are one class, so copies
   cost nothing from here on.
2. Shingles are ordered by how often they are known to be shared (those seen twice or more within a
   batch are counted over the corpus), rarest first, then by hash. Two sets that link share one of the
   first size - ceil(threshold * size) + 1 shingles of each, the prefixes. Where few sets share a prefix
   shingle, pairs are kept only if they share enough of the prefix that ends first: what that one has
   alone must not exceed what a link allows. Where many share one, they are kept together. Sets that are
   kept together, directly or through others, form a block, and no link leaves a block.
3. The sets of a block are stored in a prefix tree, in the same order read from its other end: most
   frequent shingles first, so that paths are shared. Each set walks the tree once: overlaps are summed up along shared paths, and a subtree is left as soon as the shingles
   that remain on both sides cannot make up the overlap that its smallest set needs.
4. Links become components. As only these are asked for, a pair that is already joined through others
   is not emitted: a block of n sets gives n - 1 links at most.

A block of more than CHUNK sets is split: each chunk is joined with itself and with the block's least
edited sets, which ties up most of it; then the sets outside the block's largest component are walked
through the block's sets of about their size, again chunk by chunk. No block is gathered in one task.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import give_back, materialise, text_of, with_text
from factloom.operators.components import components

#: Sets and shingles in one prefix tree, at most about so many, and least edited sets that each chunk of a block meets.
CHUNK, CHUNK_SHINGLES, PIVOTS = 256, 1_000_000, 8
#: Shingles counted as frequent from so many sets on, and at most so many of them (the most frequent;
#: 16 MB where tasks use them). The order steers the work only: any order gives the same links.
FREQUENT_FROM, FREQUENT_MOST = 3, 1_000_000
#: Sets that share a prefix shingle and are paired by it; more are kept together as they are.
PAIRED = 64
#: Parts of a block that find their least edited sets by themselves.
SHARES = 256
#: Rows of a table of numbers up to which it is broadcast (24 MB); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Shingles that are counted together in search of repeats.
BATCH_SHINGLES = 4_000_000
#: Bytes of text whose words are hashed together.
PIECE = 1 << 20
#: Sets that a task remembers so as not to emit them twice (a saving; what it forgets is dropped later).
REMEMBERED = 500_000

#: Odd numbers that mix the hashes of a shingle's words.
MIX = tuple(np.uint64(int.from_bytes(xxhash.xxh3_128_digest(f"shingle {k}")[:8], "big") | 1) for k in range(16))


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Words whose hashes a worker keeps, and bytes of the longest such word.
WORDS_KEPT, WORD_BYTES = 200_000, 64


class _WordHashes(dict):
    """The 64-bit hash of each word, found once for frequent ones."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = value
        return value


_KNOWN = _WordHashes()


def forget_words() -> None:
    """Empties the cache: a worker that waits for its next task holds no memory that others need."""
    _KNOWN.clear()
    give_back()


def _hashes(data: bytes) -> np.ndarray:
    words = data.lower().split()  # bytes: A-Z only, and ASCII white space only
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z in lower case. Long texts are cut between words, so that lists stay small."""
    if len(data) <= PIECE:
        return _hashes(data)
    found, start = [], 0
    while start < len(data):
        end = start + PIECE
        while end < len(data) and not SPACES[data[end]]:
            end += 1
        found.append(_hashes(data[start:end]))
        start = end
    return np.concatenate(found)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles: size words, or all words if there are fewer.

    Words are runs of anything but ASCII white space, with A-Z in lower case.
    """
    data = (text or "").encode()
    h = word_hashes(data)
    if not len(h):
        return np.zeros(0, np.uint64)
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    n = len(h) - size + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        part = h[k : k + n]
        mixed += (part ^ (part >> np.uint64(31 + k))) * MIX[k + 1]
    mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    return mixed[np.append(True, mixed[1:] != mixed[:-1])]


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def least_overlap(total: int, percent: int) -> int:
    """The overlap that two sets with total shingles between them need to link."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _slices(batch: pa.RecordBatch, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    step = max(1, min(batch.num_rows, batch.num_rows * size // max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


SIGNATURES = "doc bigint, key bigint, n bigint, set_id bigint, token bigint, times bigint"


def _signatures(shingle: int):
    """Rows (doc, key, n, set_id) of all texts, and rows (token, times) of shingles that a batch of sets repeats."""

    names = ["doc", "key", "n", "set_id", "token", "times"]

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(held)
        held.clear()
        tokens.sort()
        turns = np.diff((tokens[1:] == tokens[:-1]).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, last = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)  # of each run of equal shingles
        tokens, times = tokens[first].view(np.int64), last - first + 1
        none = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(tokens), pa.array(times)], names=names)

    def run(batches):
        held: list[np.ndarray] = []
        seen: set[int] = set()
        total = 0
        for whole in batches:
            for batch in _slices(whole):
                sizes, ids = [], []
                for text in batch.column(2).to_pylist():
                    tokens = shingle_set(text, shingle)
                    own = set_id(tokens)
                    sizes.append(len(tokens))
                    ids.append(own)
                    if own not in seen and len(tokens):
                        seen.add(own)
                        held.append(tokens)
                        total += len(tokens)
                none = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), none, none], names=names)
                if total >= BATCH_SHINGLES:
                    yield flush(held)
                    held, seen, total = [], set(), 0
        if held:
            yield flush(held)
        forget_words()

    return run


def known_times(tokens: np.ndarray, frequent: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each token is known to be shared (0: not frequent). frequent is sorted."""
    if not len(frequent):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    return np.where(frequent[at] == tokens, times[at], 0)


def global_order(tokens: np.ndarray, frequent: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of tokens in the order that prefixes and trees follow, rarest first, then by hash; and their known counts."""
    rank = known_times(tokens, frequent, times)
    return np.lexsort((tokens, rank)), rank


SIGN = np.uint64(1 << 63)
PREFIXES = "token bigint, set_id bigint, n bigint, size bigint, last_times bigint, last bigint, rare bigint"


def signed(tokens: np.ndarray) -> np.ndarray:
    """Hashes as signed numbers in the same order."""
    return (tokens ^ SIGN).view(np.int64)


def _prefixes(shingle: int, percent: int, frequent: np.ndarray, times: np.ndarray):
    """Rows (token, set_id) of each prefix shingle of each set, and a row without a token for each set.

    The latter has the set's size, its prefix's size and last place in the order, and how many of the
    set's shingles are not frequent.
    """
    names = ["token", "set_id", "n", "size", "last_times", "last", "rare"]

    def run(batches):
        done: set[int] = set()
        for whole in batches:
            for batch in _slices(whole):
                tokens, counts, rest = [np.zeros(0, np.int64)], [], []
                for text in batch.column(0).to_pylist():
                    own = shingle_set(text, shingle)
                    key = set_id(own)
                    if not len(own) or key in done:
                        continue
                    if len(done) < REMEMBERED:
                        done.add(key)
                    size = prefix_length(len(own), percent)
                    order, ranks = global_order(own, frequent, times)
                    first, ranks = own[order], ranks[order]
                    tokens.append(signed(first[:size]))
                    counts.append(size)
                    rest.append((key, len(own), size, int(ranks[size - 1]), int(tokens[-1][-1]), int((ranks == 0).sum())))
                table = np.array(rest, np.int64).reshape(-1, 6)
                none = lambda n, k: [pa.nulls(n, pa.int64())] * k
                flat = np.concatenate(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(table[:, 0], counts)), *none(len(flat), 5)], names=names)
                yield pa.RecordBatch.from_arrays([*none(len(table), 1), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(6))], names=names)
        forget_words()

    return run


class Tree:
    """A prefix tree of sets of ranks, with paths that no branch interrupts kept as one edge."""

    __slots__ = ("children", "count", "edge", "largest", "last", "members", "smallest")

    def __init__(self, edge: tuple[int, ...]):
        self.edge, self.children, self.members = edge, [], []

    @classmethod
    def build(cls, sets: list[tuple[tuple[int, ...], int]], depth: int = 0) -> list[Tree]:
        """The subtrees of sets, which are sorted (ranks, name) and equal up to depth."""
        nodes: list[Tree] = []
        stack = [(nodes, sets, depth)]
        while stack:
            into, part, at = stack.pop()
            start = 0
            while start < len(part):
                end = start + 1
                while end < len(part) and part[end][0][at : at + 1] == part[start][0][at : at + 1]:
                    end += 1
                own = part[start:end]
                first, last = own[0][0], own[-1][0]
                stop = at  # sorted sets share what the first and the last one share
                limit = min(len(x[0]) for x in own)
                while stop < limit and first[stop] == last[stop]:
                    stop += 1
                node = cls(first[at:stop])
                sizes = [len(x[0]) for x in own]
                node.smallest, node.largest, node.last = min(sizes), max(sizes), first[stop - 1] if stop else -1
                node.members = [x for x in own if len(x[0]) == stop]
                rest = [x for x in own if len(x[0]) > stop]
                if rest:
                    stack.append((node.children, rest, stop))
                into.append(node)
                start = end
        return nodes


def matches(nodes: list[Tree], probe: tuple[int, ...], percent: int) -> Iterator[int]:
    """The names of the tree's sets that link with probe (sorted ranks)."""
    have, n = frozenset(probe), len(probe)
    stack = [(node, 0, 0) for node in nodes]
    while stack:
        node, overlap, depth = stack.pop()
        if 100 * min(node.largest, n) < percent * max(node.smallest, n):
            continue
        overlap += len(have.intersection(node.edge))
        depth += len(node.edge)
        left = n - bisect_right(probe, node.last)  # of the probe's shingles, those that can still come
        if overlap + min(left, node.largest - depth) < least_overlap(node.smallest + n, percent):
            continue
        for ranks, name in node.members:
            if 100 * overlap >= percent * (len(ranks) + n - overlap):
                yield name
        stack += [(child, overlap, depth) for child in node.children]


def join(rows: Iterable[tuple[int, np.ndarray, bool, int]], percent: int, frequent: np.ndarray, times: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what links connect among rows (set id, tokens, is a probe, known component).

    Rows that are stored and probes meet; two probes or two rows of one known component do not.
    """
    rows = list(rows)
    tokens, where = np.unique(np.concatenate([x[1] for x in rows]), return_inverse=True)
    rank = np.empty(len(tokens), np.int64)
    rank[global_order(tokens, frequent, times)[0][::-1]] = np.arange(len(tokens))  # most frequent first
    ranks = rank[where]
    sets, at = [], 0
    for k, x in enumerate(rows):
        sets.append((tuple(np.sort(ranks[at : at + len(x[1])]).tolist()), k))
        at += len(x[1])
    probing = any(x[2] for x in rows)
    nodes = Tree.build(sorted(x for x in sets if not (probing and rows[x[1]][2])))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for own, k in sets:
        if probing and not rows[k][2]:
            continue
        for other in matches(nodes, own, percent):
            a, b = root(rows[k][3]), root(rows[other][3])
            if a != b:
                parent[a] = b
                links.append((rows[k][0], rows[other][0]))
    return links


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect what the given ones connect: each set with the smallest one it is connected to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for link in links:
        a, b = sorted(map(root, link))
        parent[b] = a
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def _joined(percent: int, frequent: np.ndarray, times: np.ndarray):
    """Links within each run of rows (block, chunk, set_id, tokens, probe, component) with one block and chunk."""

    def found(held: list) -> Iterator[tuple[int, int]]:
        if len(held) > 1:
            yield from stars(join(((i, np.frombuffer(t, np.uint64), p, c) for i, t, p, c in held), percent, frequent, times))

    def run(batches):
        key, held, seen = None, [], set()
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    out += found(held)
                    key, held, seen = row[:2], [], set()
                own = (row[2], row[4])  # a set may be stored and probe in one run
                if own not in seen:
                    seen.add(own)
                    held.append(row[2:])
            yield _pairs(out)
        yield _pairs(list(found(held)))

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _tokens(shingle: int):
    """Adds the packed shingle set to rows (text, set_id, ...) whose set it is; drops the others, and repeats."""

    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for batch in _slices(whole):
                keep, packed = [], []
                for k, (text, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    tokens = shingle_set(text, shingle)
                    if set_id(tokens) == own and own not in seen:
                        if len(seen) < REMEMBERED:
                            seen.add(own)
                        keep.append(k)
                        packed.append(tokens.tobytes())
                rest = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(packed, pa.binary())], names=[*batch.schema.names[1:], "tokens"])
        forget_words()

    return run


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few enough rows; df must be written already."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _near(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (first, set_id) that hold together the sets that may link."""
    places = prefixes.where("token is not null").select("token", "set_id")
    shared = places.groupBy("token").agg(F.min("set_id").alias("first"), F.max("set_id").alias("second")).where("first < second")
    shared = materialise(shared.select("token", "first"), "shared")
    found = materialise(places.join(shared, "token"), "shared-prefixes").distinct()
    sets = found.groupBy("token").agg(F.count("*").alias("sets"))
    found = materialise(found.join(sets, "token"), "shared-prefixes")
    together = found.where((F.col("sets") > PAIRED) & (F.col("set_id") != F.col("first"))).select("first", "set_id")
    known = prefixes.where("token is null").select("set_id", "n", "size", F.struct("last_times", "last").alias("end")).dropDuplicates(["set_id"])
    few = found.where(F.col("sets") <= PAIRED).select("token", "set_id").join(known, "set_id")
    a, b = few.alias("a"), few.alias("b")
    close = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.set_id") < F.col("b.set_id")) & close)
    ends_first = F.col("a.end") <= F.col("b.end")
    need = F.ceil(percent * (F.col("a.n") + F.col("b.n")) / (100 + percent) - 1e-9)
    alone = F.when(ends_first, F.col("a.n")).otherwise(F.col("b.n")) - need  # shingles that this one may have alone
    least = F.when(ends_first, F.col("a.size")).otherwise(F.col("b.size")) - alone
    pairs = pairs.groupBy(F.col("a.set_id").alias("first"), F.col("b.set_id").alias("set_id"), least.alias("least")).agg(F.count_distinct("a.token").alias("common"))
    return together.unionByName(pairs.where(F.col("common") >= F.col("least")).select("first", "set_id")).distinct()


def _in_groups(df: DataFrame, percent: int, frequent: np.ndarray, times: np.ndarray) -> DataFrame:
    rows = df.select("block", "chunk", "set_id", "tokens", "probe", "component")
    return rows.repartition("block", "chunk").sortWithinPartitions("block", "chunk").mapInArrow(_joined(percent, frequent, times), "a bigint, b bigint")


def _frequent(signatures: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted by hash, and their counts (FREQUENT_MOST at most)."""
    times = signatures.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT_FROM)
    table = times.orderBy(F.col("times").desc(), "token").limit(FREQUENT_MOST).toPandas()
    tokens = table["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table["times"].to_numpy(np.int64)[order]


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """A number that, with the id, names what a row says: a hash of its id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), text_of(text_col))


def link_components(df: DataFrame, shingle: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """id_col, n_shingles and component_id of each row; with groups also row_key and group.

    Words are runs of anything but ASCII white space, with A-Z in lower case. A text's set has its
    distinct shingles of so many words; with fewer words all of them are one shingle; without words the
    set is empty and links with nothing. Two texts link if percent / 100 or more of their shingles'
    union is shared. component_id is the smallest id that can be reached by links, the own one included.

    Null texts count as empty. A row with a null id takes part, but its id is never a component's: a
    component of null ids alone has a null component_id. Rows that repeat an id are texts of their own.
    Repeated rows stay, an empty table gives no rows, other columns are ignored. Very long texts are
    hashed piece by piece and are whole sets. Sets are told apart by 64-bit hashes of their shingles
    together with their sizes. group is one number for each component (null where the set is empty), also
    where two components have one smallest id because an id repeats; row_key is that of row_key().
    """
    with_text(df, text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    rows = rows.select("doc", row_key(rows, "doc", "text").alias("key"), "text")  # the key finds a text again
    signatures = materialise(rows.mapInArrow(_signatures(shingle), SIGNATURES), "signatures")
    docs = signatures.where("set_id is not null").select("doc", "key", "n", "set_id")
    frequent, times = _frequent(signatures)

    prefixes = materialise(rows.select("text").mapInArrow(_prefixes(shingle, percent, frequent, times), PREFIXES), "prefixes")
    near = materialise(_near(prefixes, percent), "near")
    blocks = materialise(components(near).select(F.col("node").alias("set_id"), F.col("root").alias("block")), "blocks")

    kept = docs.where("n > 0").groupBy("set_id", "n").agg(F.min("doc").alias("least"), F.min("key").alias("key"))
    kept = materialise(kept, "sets")
    blocks = materialise(blocks.join(kept.select("set_id", "n", "key"), "set_id"), "blocks")
    sizes = blocks.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("chunks"))
    active = blocks.select("set_id", "block", "key").join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")))
    active = materialise(active, "active")
    texts = rows.join(_small(active), "key").select("text", "set_id", "block", "chunk", "chunks")
    texts = texts.mapInArrow(_tokens(shingle), "set_id bigint, block bigint, chunk bigint, chunks bigint, tokens binary")
    texts = materialise(texts, "active-sets")

    own = texts.select("block", "chunk", "chunks", "set_id", "tokens", F.lit(False).alias("probe"), F.col("set_id").alias("component"))
    rare = prefixes.where("token is null").join(active.where("chunks > 1").select("set_id", "block"), "set_id").groupBy("block", "set_id").agg(F.min("rare").alias("rare"), F.max("n").alias("n"))
    rare = rare.withColumn("share", F.pmod(F.xxhash64("set_id", F.lit(2)), F.lit(SHARES)))
    for keys in (("block", "share"), ("block",)):  # first within shares of a block, so that no block is gathered
        first = F.row_number().over(W.partitionBy(*keys).orderBy("rare", F.col("n").desc(), "set_id"))
        rare = rare.withColumn("first", first).where(F.col("first") <= PIVOTS)
    pivots = rare.select("set_id")
    everywhere = own.where("chunks > 1").join(pivots, "set_id").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("to <> chunk")
    everywhere = everywhere.withColumn("chunk", F.col("to")).select(own.columns)
    links = materialise(_in_groups(own.unionByName(everywhere), percent, frequent, times), "set-links")

    roots = components(links)
    large = own.where("chunks > 1")
    if not large.isEmpty():
        probes = _residual_probes(large, roots, percent)
        more = materialise(_in_groups(probes, percent, frequent, times), "set-links")
        if not more.isEmpty():  # what is known already is a link of each set with its component's root
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    merged = kept.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    merged = materialise(merged, "merged")
    ends = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(merged.join(ends, "root").select("set_id", "n", "component_id", "root"), "named")
    out = docs.where("n > 0").join(named, ["set_id", "n"]).select("doc", "n", "component_id", "key", "root")
    out = out.unionByName(docs.where("n = 0").select("doc", "n", F.col("doc").alias("component_id"), "key", F.lit(None).cast("long").alias("root")))
    more = [F.col("key").alias("row_key"), F.col("root").alias("group")] if groups else []
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", *more)


def _residual_probes(own: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """The groups in which sets outside each large block's largest component meet the block's sets of other components.

    Sets that link differ in size by a factor of 100 / percent at most, so a level of sizes meets itself and the next
    ones only. Where levels are large, each part of the outside sets meets each chunk of a level.
    """
    roots = roots.select(F.col("node").alias("set_id"), "root")
    level = F.floor(F.log(F.length("tokens") / 8) / (math.log(100 / percent) + 1e-6))
    known = own.drop("component", "chunk", "chunks").join(roots, "set_id", "left").withColumn("component", F.coalesce("root", "set_id")).drop("root")
    known = materialise(known.withColumn("level", level), "large-blocks")
    sizes = known.groupBy("block", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    outside = materialise(known.join(largest, "block").where("component <> largest").drop("largest"), "outside")

    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.length("tokens") / 8) / CHUNK_SHINGLES))
    to_level = F.explode(F.sequence(F.col("from_level") - 1, F.col("from_level") + 1)).alias("to_level")
    cells = known.groupBy("block", F.col("level").alias("to_level")).agg(chunks.alias("chunks"))
    parts = outside.groupBy("block", F.col("level").alias("from_level")).agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    meet = materialise(parts.select("block", "from_level", "parts", to_level).join(cells, ["block", "to_level"]), "levels")

    number = lambda seed, column: F.pmod(F.xxhash64("set_id", F.lit(seed)), F.col(column))
    every = lambda column: F.explode(F.sequence(F.lit(0).cast("long"), F.col(column) - 1))
    group = F.array("from_level", "part", "to_level", "to_chunk").alias("chunk")
    rest = ["block", group, "set_id", "tokens", "probe", "component"]
    probes = outside.withColumnRenamed("level", "from_level").join(meet, ["block", "from_level"])
    probes = probes.withColumns({"probe": F.lit(True), "part": number(1, "parts")}).withColumn("to_chunk", every("chunks"))
    stored = known.withColumnRenamed("level", "to_level").join(meet, ["block", "to_level"])
    stored = stored.withColumns({"probe": F.lit(False), "to_chunk": number(2, "chunks")}).withColumn("part", every("parts"))
    return probes.select(rest).unionByName(stored.select(rest))
