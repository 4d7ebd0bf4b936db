"""Media columns (operator 6): local image descriptors that find cropped and edited copies.

Images are 8-bit grey PGM files in a binary column. Each is brought to a working size, then scanned at
several scales for corners (Harris response, local maxima); a corner gets an angle from its patch's
centre of brightness and 128 binary tests of the smoothed patch, turned by that angle.

1. Hamming tables: WINDOWS overlapping windows of a descriptor's bits are its keys. Where descriptors of two images share a
   key, all their bits are held together in the join; images with descriptors that differ in NEAR bits at most are
   candidates. This is the same for every key and every size of the table.
2. Geometric consensus: a candidate pair is held together in one row. Each descriptor of the one finds
   its nearest in the other (RADIUS bits at most), each match says how to turn, scale and shift one image
   onto the other, and a copy has many matches that say the same; chance matches do not.

Images with the same bytes are one class. So are near copies in the same frame: each image is held
against the one smallest image that it shares most keys with, and if their match is the identity on most
corners it becomes a member of that one's class. Queries are matched with representatives only, so a
group of many near copies costs what its representatives cost, not the square of its size.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialise
from factloom.operators.components import components
from factloom.staging import by_slices, in_slice

#: The longer side of an image at its working size, at most: larger ones are reduced first, which bounds their corners.
SIDE = 512
#: Sizes at which corners are sought, as shares of the working size: in a query, and in an image that is indexed. One
#: of a query's sizes is near one of an image's for copies of 0.6 to 1.7 times the size.
SCALES, INDEX_SCALES = (1.0, 0.84, 0.71, 0.59), (1.0, 0.77)
#: Pixels from a corner to its patch's edge, and between two corners at least.
PATCH, APART = 12, 4
#: Share of the strongest corner's response that a corner has.
LEAST_RESPONSE = 0.01
TESTS, BLOCKS, BLOCK_BITS, MORE_BITS = 128, 5, 25, 16
#: Bits of a stretch after a block, stretches in each of an entry's two numbers, and equal ones that make a candidate. Over
#: 80 edited images 0.91 of them have so many, and of pairs of any two images 0.0026 (blocks alone: 0.93 and 0.12).
STRETCH_BITS, STRETCHES, AGREE = 10, 4, 4
#: Windows of a descriptor whose bits are its keys, bits of each, and bits in which descriptors that share a key and make
#: a candidate differ at most.
WINDOWS, WINDOW_BITS, NEAR = 8, 30, 16
#: Bits in which matching descriptors differ, at most.
RADIUS = 24
#: Keys that two images of one class share, at least.
SHARED_CLASS = 2
#: Keys of an image by which it looks for its class: those of least hash, the same ones in near copies.
SKETCH = 32
#: Entries of queries up to which they are broadcast (32 bytes each); more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of queries' descriptors that are broadcast at once.
BROADCAST_BYTES = 32 << 20
#: Agreeing matches that make a copy.
CONSENSUS = 6
#: Share of the smaller image's corners that agree on the identity where two images are one class.
SAME_FRAME = 0.5
#: How far two matches may differ and still agree: degrees of turn, factor of scale, pixels of shift at the working size.
TURN, FACTOR, SHIFT = 20.0, 1.25, 5.0
#: Bytes of a descriptor: x, y, scale, angle as 32-bit floats and the bits.
RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", TESTS // 8)])
#: Pairs of descriptors whose distances are found at once.
PAIRS_AT_ONCE = 1 << 18


def pgm(pixels: np.ndarray) -> bytes:
    """A grey image as a PGM file."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def pixels_of(data: bytes | None) -> np.ndarray:
    """The pixels of a PGM file; anything else is an image of no size."""
    head = (data or b"")[:64].split(maxsplit=4)[:4]
    if len(head) < 4 or head[0] != b"P5" or not all(x.isdigit() for x in head[1:]) or int(head[3]) > 255:
        return np.zeros((0, 0), np.float32)
    width, height = int(head[1]), int(head[2])
    body = data[len(data) - width * height :]
    return np.frombuffer(body, np.uint8).reshape(height, width).astype(np.float32) if len(body) == width * height else np.zeros((0, 0), np.float32)


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear samples of an image; places outside count as its edge."""
    y, x = y.clip(0, image.shape[0] - 1), x.clip(0, image.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = y - y0, x - x0
    return (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    """The image at another size, about the same centre; when it shrinks it is smoothed first."""
    if scale == 1.0 or not image.size:
        return image
    if scale < 0.75:
        image = smoothed(image, max(1, round(0.5 / scale) if scale < 0.4 else 1))
    h, w = (max(1, round(n * scale)) for n in image.shape)
    y, x = np.arange(h, dtype=np.float32)[:, None], np.arange(w, dtype=np.float32)[None, :]  # rows and columns by themselves
    return sampled(image, unscaled(y, h, image.shape[0], scale), unscaled(x, w, image.shape[1], scale)).astype(np.float32)


def unscaled(place: np.ndarray, size: int, whole: int, scale: float) -> np.ndarray:
    """Where a place along an axis of a resized image lies in the image."""
    return (place - (size - 1) / 2) / scale + (whole - 1) / 2


def smoothed(image: np.ndarray, reach: int) -> np.ndarray:
    """Means over squares that reach so many pixels each way, along one axis and then the other."""
    h, w = image.shape
    padded = np.empty((h + 2 * reach, w + 2 * reach), np.float32)
    padded[reach : h + reach, reach : w + reach] = image
    padded[:reach, reach : w + reach], padded[h + reach :, reach : w + reach] = image[:1], image[-1:]
    padded[:, :reach], padded[:, w + reach :] = padded[:, reach : reach + 1], padded[:, w + reach - 1 : w + reach]
    rows = padded[:h].copy()
    for k in range(1, 2 * reach + 1):
        rows += padded[k : k + h]
    found = rows[:, :w].copy()
    for k in range(1, 2 * reach + 1):
        found += rows[:, k : k + w]
    found /= np.float32((2 * reach + 1) ** 2)
    return found


def corners(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of corners whose patch lies inside the image."""
    edge = PATCH + 1
    if min(image.shape, default=0) < 2 * edge + 3:
        return np.zeros(0, int), np.zeros(0, int)
    soft = smoothed(image, 1)
    gy, gx = np.gradient(soft)
    a, b, c = smoothed(gx * gx, 2), smoothed(gy * gy, 2), smoothed(gx * gy, 2)
    response = a * b - c * c - np.float32(0.05) * (a + b) ** 2
    best = response.copy()
    for shift in range(1, APART + 1):  # the largest value near each place, along one axis and then the other
        best[shift:] = np.maximum(best[shift:], response[:-shift])
        best[:-shift] = np.maximum(best[:-shift], response[shift:])
    rows = best.copy()
    for shift in range(1, APART + 1):
        best[:, shift:] = np.maximum(best[:, shift:], rows[:, :-shift])
        best[:, :-shift] = np.maximum(best[:, :-shift], rows[:, shift:])
    peak = (response == best) & (response > max(1e-3, LEAST_RESPONSE * float(response.max())))
    y, x = np.nonzero(peak[edge:-edge, edge:-edge])
    return y + edge, x + edge


@lru_cache(maxsize=1)
def _pattern() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of points that are compared, and the patch's pixels for the angle; from a fixed seed."""
    random = np.random.default_rng(20)
    reach = np.sqrt(random.uniform(0, 1, (TESTS, 2))) * (PATCH - 1)
    turn = random.uniform(0, 2 * math.pi, (TESTS, 2))
    dy, dx = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
    inside = dy**2 + dx**2 <= PATCH**2
    return reach * np.sin(turn), reach * np.cos(turn), dy[inside], dx[inside]


def describe(image: np.ndarray, scales: tuple[float, ...] = SCALES) -> np.ndarray:
    """The descriptors of an image, as RECORDs; x and y are in the image's own pixels, scale is the level's share of it."""
    py, px, dy, dx = _pattern()
    zoom = min(1.0, SIDE / max(image.shape)) if image.size else 1.0
    base = resized(image, zoom)
    found = [np.zeros(0, RECORD)]
    for scale in scales:
        level = resized(base, scale)
        y, x = corners(level)
        soft = smoothed(level, 2) if len(y) else level
        for start in range(0, len(y), 2000):  # so many patches are held at once
            ys, xs = y[start : start + 2000], x[start : start + 2000]
            patch = level.ravel()[(ys * level.shape[1] + xs)[:, None] + (dy * level.shape[1] + dx)]
            patch = patch - patch.mean(1, keepdims=True)
            angle = np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            ty = np.rint(ys[:, None, None] + py * cos + px * sin).astype(int)
            tx = np.rint(xs[:, None, None] + px * cos - py * sin).astype(int)
            values = soft.ravel()[ty * level.shape[1] + tx]
            part = np.zeros(len(ys), RECORD)
            for axis, places in (("y", ys), ("x", xs)):
                k = "yx".index(axis)
                part[axis] = unscaled(unscaled(places, level.shape[k], base.shape[k], scale), base.shape[k], image.shape[k], zoom)
            part["scale"] = scale * zoom
            part["angle"] = np.degrees(angle) % 360
            part["bits"] = np.packbits(values[:, :, 0] < values[:, :, 1], axis=1)
            found.append(part)
    return np.concatenate(found)


def keys(found: np.ndarray) -> np.ndarray:
    """The distinct long keys of an image: the number of a block, its bits and the MORE_BITS bits after it."""
    bits = np.unpackbits(found["bits"], axis=1).astype(np.int64)
    length = BLOCK_BITS + MORE_BITS
    powers = np.int64(1) << np.arange(length - 1, -1, -1, dtype=np.int64)
    parts = [(bits[:, (np.arange(length) + k * BLOCK_BITS) % TESTS] @ powers) + (k << length) for k in range(BLOCKS)]
    return np.unique(np.concatenate(parts))


def entries(found: np.ndarray) -> np.ndarray:
    """The distinct rows (key, low, high) of an image: a block's number and bits, and the stretches after it."""
    bits = np.unpackbits(found["bits"], axis=1).astype(np.int64)

    def number(start: int, length: int) -> np.ndarray:
        return bits[:, (start + np.arange(length)) % TESTS] @ (np.int64(1) << np.arange(length, dtype=np.int64))

    half = STRETCH_BITS * STRETCHES
    starts = [(k, k * BLOCK_BITS) for k in range(BLOCKS)]
    parts = [np.stack([number(at, BLOCK_BITS) + (k << BLOCK_BITS), number(at + BLOCK_BITS, half), number(at + BLOCK_BITS + half, half)], axis=1) for k, at in starts]
    return np.unique(np.concatenate(parts), axis=0)


def matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each descriptor of a that has one in b within RADIUS bits: its number and the nearest one's."""
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int)
    left, right = (np.ascontiguousarray(x["bits"]).view(np.uint64) for x in (a, b))
    step = max(1, PAIRS_AT_ONCE // len(right))
    words = [np.ascontiguousarray(x) for x in right.T]
    nearest, least = [], []
    for start in range(0, len(left), step):
        part = left[start : start + step, :, None]
        bits = np.bitwise_count(part[:, 0] ^ words[0])  # of one byte: descriptors have fewer than 256 bits
        for k, word in enumerate(words[1:], 1):
            bits += np.bitwise_count(part[:, k] ^ word)
        nearest.append(bits.argmin(1))
        least.append(bits[np.arange(len(bits)), nearest[-1]])
    near = np.concatenate(nearest)
    own = np.flatnonzero(np.concatenate(least) <= RADIUS)
    return own, near[own]


def consensus(a: np.ndarray, b: np.ndarray, least: int = 1) -> tuple[int, float, float, float, float]:
    """votes, turn (degrees), scale, dx and dy of the motion of b onto a that most matches agree on.

    Votes are counted by distinct places in b, so that one corner found at several scales counts once. Each
    match's motion is tried and all matches that agree with it are counted, in slices; the first best one wins.
    Where fewer than least votes are found there are none: places, and matches of like turn and scale, are counted first,
    as no motion has more votes than these.
    """
    own, other = matched(a, b)
    q, f = a[own], b[other]
    spots = (f["x"] // SHIFT).astype(np.int64) << 32 | (f["y"] // SHIFT).astype(np.int64)
    if len(own) < least or len(set(spots.tolist())) < least or not len(own):
        return 0, 0.0, 1.0, 0.0, 0.0
    turn = (q["angle"].astype(np.float64) - f["angle"]) % 360
    size = f["scale"].astype(np.float64) / q["scale"]
    cos, sin = np.cos(np.radians(turn)), np.sin(np.radians(turn))
    qx, qy, fx, fy = (x.astype(np.float64) for x in (q["x"], q["y"], f["x"], f["y"]))
    place = np.unique(spots, return_inverse=True)[1]
    by_place = np.argsort(place, kind="stable")
    starts = np.flatnonzero(np.diff(place[by_place], prepend=-1))
    slack = SHIFT / min(1.0, float(q["scale"].max()))
    best, agreed = 0, np.zeros(0, int)
    for start in range(0, len(own), max(1, PAIRS_AT_ONCE // len(own))):
        k = np.arange(start, min(len(own), start + max(1, PAIRS_AT_ONCE // len(own))))[:, None]
        like = (np.abs((turn - turn[k] + 180) % 360 - 180) <= TURN) & (np.abs(np.log(size / size[k])) <= math.log(FACTOR))
        enough = like.sum(1) >= least
        if not enough.any():
            continue
        k, like = k[enough], like[enough]
        # where match k's motion carries every matched place of b, against where that place is in a
        x, y = fx - fx[k], fy - fy[k]
        off = np.hypot(qx[k] + size[k] * (x * cos[k] - y * sin[k]) - qx, qy[k] + size[k] * (x * sin[k] + y * cos[k]) - qy)
        reach = 0.12 * size[k] * np.hypot(x, y) + slack  # an angle's error moves far places more
        fits = (off <= reach) & like
        votes = np.logical_or.reduceat(fits[:, by_place], starts, axis=1).sum(1)
        row = int(votes.argmax())
        if votes[row] > best:
            best, agreed = int(votes[row]), np.flatnonzero(fits[row])
    if best < least:
        return 0, 0.0, 1.0, 0.0, 0.0
    s, c = np.sin(np.radians(turn[agreed])).mean(), np.cos(np.radians(turn[agreed])).mean()
    scale = float(np.exp(np.log(size[agreed]).mean()))
    x, y = fx[agreed], fy[agreed]
    norm = math.hypot(s, c) or 1.0
    dx = float((qx[agreed] - scale * (x * c - y * s) / norm).mean())
    dy = float((qy[agreed] - scale * (x * s + y * c) / norm).mean())
    return best, float(np.degrees(math.atan2(s, c)) % 360), scale, dx, dy


def same_frame(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether b is a as a whole: the motion is the identity, on SAME_FRAME or more of the corners of either."""
    votes, turn, scale, dx, dy = consensus(a, b, CONSENSUS)
    still = min(turn, 360 - turn) <= TURN / 2 and abs(math.log(scale)) <= math.log(FACTOR) / 2 and max(abs(dx), abs(dy)) <= 2 * SHIFT / min(1.0, float(a["scale"].max(initial=1.0)))
    places = min(len(np.unique(np.stack([x["x"] // SHIFT, x["y"] // SHIFT]), axis=1).T) for x in (a, b)) if votes else 1
    return bool(votes >= CONSENSUS and still and votes >= SAME_FRAME * places)


def agreement(low: Column, high: Column) -> Column:
    """How many stretches are equal, given the exclusive or of two entries' numbers."""
    mask = (1 << STRETCH_BITS) - 1
    equal = [F.when(F.shiftright(x, k * STRETCH_BITS).bitwiseAND(F.lit(mask)) == 0, 1).otherwise(0) for x in (low, high) for k in range(STRETCHES)]
    return sum(equal[1:], start=equal[0])


DESCRIBED = "image binary, name bigint, found binary, keys array<bigint>"
AGREED = "name bigint, other bigint, votes bigint, turn double, scale double, dx double, dy double"


def _describe(scales: tuple[float, ...]):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                found = [describe(pixels_of(x), scales) for x in part.column(1).to_pylist()]
                names = [int.from_bytes(x[:8], "big", signed=True) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([keys(x) for x in found], pa.list_(pa.int64()))], names=["image", "name", "found", "keys"])

    return run


def described(images: DataFrame, media_col: str, scales: tuple[float, ...]) -> DataFrame:
    """The descriptors and keys of each distinct image of a binary column.

    image is the SHA-256 of its bytes, name its first eight bytes as a number, by which images are joined.
    """
    distinct = images.where(F.col(media_col).isNotNull()).select(F.unhex(F.sha2(media_col, 256)).alias("image"), F.col(media_col).alias("data")).dropDuplicates(["image"])
    return distinct.mapInArrow(_describe(scales), DESCRIBED)


def _entries(batches):
    """Rows (name, key, low, high) of rows (name, found)."""
    for batch in _sliced(batches):
        found = [entries(np.frombuffer(x, RECORD)) for x in batch.column(1).to_pylist()]
        rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
        names = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3))], names=["name", "key", "low", "high"])


def bits_of(found: np.ndarray) -> np.ndarray:
    """The distinct descriptors of an image, as rows of two 64-bit numbers."""
    return np.unique(np.ascontiguousarray(found["bits"]).view("<i8").reshape(-1, 2), axis=0)


def _bits(batches):
    """Rows (name, low, high) of rows (name, found)."""
    for batch in _sliced(batches):
        found = [bits_of(np.frombuffer(x, RECORD)) for x in batch.column(1).to_pylist()]
        rows = np.concatenate([np.zeros((0, 2), np.int64), *found])
        names = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(2))], names=["name", "low", "high"])


def window(k: int) -> Column:
    """A key of the columns low and high: k and the bits of window k, on the circle of all bits."""
    at = k * (TESTS // WINDOWS)
    one, other = ("low", "high") if at < 64 else ("high", "low")
    bits = F.shiftrightunsigned(one, at % 64)
    if at % 64 + WINDOW_BITS > 64:
        bits = bits.bitwiseOR(F.shiftleft(other, 64 - at % 64))
    return bits.bitwiseAND(F.lit((1 << WINDOW_BITS) - 1).cast("long")).bitwiseOR(F.lit(k << WINDOW_BITS).cast("long"))


def _sliced(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            yield batch.slice(start, 500)


def _agreed(batches):
    """votes and motion for rows (name, other, found of the one, found of the other); fewer than CONSENSUS votes are none."""
    for batch in _sliced(batches):
        rows = [consensus(np.frombuffer(a, RECORD), np.frombuffer(b, RECORD), CONSENSUS) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        columns = [pa.array([x[k] for x in rows], pa.int64() if k == 0 else pa.float64()) for k in range(5)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["name", "other", "votes", "turn", "scale", "dx", "dy"])


def _same(batches):
    for batch in _sliced(batches):
        keep = [same_frame(np.frombuffer(a, RECORD), np.frombuffer(b, RECORD)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep, pa.bool_())) for x in batch.columns[:2]], names=["name", "other"])


def _copies(pairs: DataFrame, found: DataFrame, index: DataFrame) -> DataFrame:
    """The pairs (name, other) with CONSENSUS votes or more, and their motions. Queries' descriptors are broadcast, some at a time, so
    that pairs are shuffled as two numbers, with the descriptors of neither image."""
    slices = max(1, -(-(found.agg(F.sum(F.length("found"))).first()[0] or 0) // BROADCAST_BYTES))

    def of_slice(k: int) -> DataFrame:
        two = in_slice(pairs, "name", slices, k).join(index.select(F.col("name").alias("other"), F.col("found").alias("other_found")), "other")
        one = F.broadcast(in_slice(found, "name", slices, k).select("name", F.col("found").alias("own_found")))
        return two.join(one, "name").select("name", "other", "own_found", "other_found").mapInArrow(_agreed, AGREED).where(F.col("votes") >= CONSENSUS)

    return of_slice(0) if slices == 1 else by_slices(pairs.sparkSession, slices, of_slice, "copies")


def _together(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (name, other) with what was found in both images."""
    one = left.select("name", F.col("found").alias("own_found"))
    two = right.select(F.col("name").alias("other"), F.col("found").alias("other_found"))
    return pairs.join(one, "name").join(two, "other").select("name", "other", "own_found", "other_found")


def classes(index: DataFrame) -> DataFrame:
    """name and other (its representative) of the images that are members of another one's class.

    An image points at the smallest image under one of its SKETCH keys that it shares most of them with
    (SHARED_CLASS at least), one pointer each, so work is in proportion to the images. Pointers make
    groups, and an image stays in its group only if it is the same frame as the group's smallest image.
    """
    sketch = F.slice(F.array_sort(F.transform("keys", lambda x: F.xxhash64(x))), 1, SKETCH)
    entries = index.select(F.explode(sketch).alias("key"), "name")
    least = materialise(entries.groupBy("key").agg(F.min("name").alias("other"), F.count("*").alias("n")).where("n > 1").drop("n"), "least-images")
    shared = entries.join(least, "key").where("name <> other").groupBy("name", "other").agg(F.count("*").alias("n"))
    best = shared.where(F.col("n") >= SHARED_CLASS).groupBy("name").agg(F.max_by("other", F.struct("n", -F.col("other"))).alias("other"))
    roots = components(materialise(best, "pointers")).where("node <> root").select(F.col("node").alias("name"), F.col("root").alias("other"))
    return _together(materialise(roots, "groups"), index, index).mapInArrow(_same, "name bigint, other bigint")


def near_candidates(found: DataFrame, index: DataFrame) -> DataFrame:
    """name and other of the images of found and of index with descriptors that share a key and differ in NEAR bits at most."""
    keys_of = F.explode(F.array(*(window(k) for k in range(WINDOWS)))).alias("key")
    of = lambda df: df.select("name", "found").mapInArrow(_bits, "name bigint, low bigint, high bigint").select("name", "low", "high", keys_of)
    asked = materialise(of(found), "query-windows")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    stored = of(index).select(F.col("name").alias("other"), "key", F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("other_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("other_high")))
    return stored.join(asked, "key").where(apart <= NEAR).select("name", "other").distinct()


def candidates(found: DataFrame, index: DataFrame) -> DataFrame:
    """name and other of the images of found and of index whose entries agree in AGREE stretches or more.

    find_copies took this rule before near_candidates, which joins fewer rows; it is kept to be compared with.
    """
    of = lambda df: df.select("name", "found").mapInArrow(_entries, "name bigint, key bigint, low bigint, high bigint")
    asked = materialise(of(found), "query-entries")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    stored = of(index).select(F.col("name").alias("other"), "key", F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    both = stored.join(asked, "key")
    equal = agreement(F.col("low").bitwiseXOR(F.col("other_low")), F.col("high").bitwiseXOR(F.col("other_high")))
    agreed = both.select("name", "other", equal.alias("equal")).where("equal > 0").groupBy("name", "other").agg(F.sum("equal").alias("equal"))
    return agreed.where(F.col("equal") >= AGREE).select("name", "other")


def find_copies(images: DataFrame, queries: DataFrame, media_col: str = "media", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Pairs of a query row and a class of images that are copies of each other, and the members of classes.

    images and queries have id_col and a binary media_col with PGM files; other columns are ignored. The
    pairs have query_id, class_id, votes, turn, scale, dx and dy (of the motion that carries the class's
    representative onto the query), the members class_id and id_col, one row for each row of images that has
    a file. class_id is the smallest id among the rows that hold the representative's bytes.

    Every image is described and indexed, at its working size if it is very large. A null, broken, too
    small or too plain file is a class of its own and finds nothing, nor is it found; a null file has no
    row. Equal bytes are one class whatever their number; ties between motions go to the first. Repeated
    rows are members each; each repeated query row has its own results. Empty tables give no rows.
    """
    index = materialise(described(images, media_col, INDEX_SCALES), "descriptors")
    within = materialise(classes(index), "classes")
    owners = materialise(images.where(F.col(media_col).isNotNull()).select(F.col(id_col), F.unhex(F.sha2(media_col, 256)).alias("image")), "owners")
    named = index.select("image", "name").join(within, "name", "left").select("image", F.coalesce("other", "name").alias("name"))
    rows = materialise(owners.join(named, "image").select(id_col, "image", "name"), "class-rows")
    heads = owners.groupBy("image").agg(F.min(id_col).alias("class_id")).join(index.select("image", "name"), "image").select("name", "class_id")
    members = rows.join(heads, "name").select("class_id", id_col)

    leaders = index.join(within.select("name"), "name", "left_anti")
    asked = queries.where(F.col(media_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.unhex(F.sha2(media_col, 256)).alias("image"))
    found = materialise(described(queries, media_col, SCALES), "query-descriptors")
    pairs = materialise(near_candidates(found, leaders), "candidates")
    copies = _copies(pairs, found, index).join(heads.select(F.col("name").alias("other"), "class_id"), "other").join(found.select("name", "image"), "name")
    return copies.join(asked, "image").select("query_id", "class_id", "votes", "turn", "scale", "dx", "dy"), members
