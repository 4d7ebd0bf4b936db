import numpy as np
from pyspark.sql import functions as F

from factloom.llm import media, queries, rasters


def image(seed):
    return rasters.raster(np.random.default_rng(seed).normal(size=64))


def agreed(a, b):
    """Equal stretches after equal blocks, entry by entry, bit by bit."""
    count = 0
    sides = []
    for found in (a, b):
        bits = np.unpackbits(found["bits"], axis=1)
        sides.append({(k, np.roll(row, -k * media.BLOCK_BITS)[: media.BLOCK_BITS + 2 * media.STRETCHES * media.STRETCH_BITS].tobytes()) for row in bits for k in range(media.BLOCKS)})
    for k, x in sides[0]:
        for j, y in sides[1]:
            if k == j and x[: media.BLOCK_BITS] == y[: media.BLOCK_BITS]:
                cut = range(media.BLOCK_BITS, len(x), media.STRETCH_BITS)
                count += sum(x[c : c + media.STRETCH_BITS] == y[c : c + media.STRETCH_BITS] for c in cut)
    return count


def test_pgm_round_trip_and_broken_files():
    pixels = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert (media.pixels_of(media.pgm(pixels)) == pixels).all()
    for broken in (None, b"", b"P5 4 4 255\nxx", b"GIF89a", b"P5 a b c\n"):
        assert media.pixels_of(broken).size == 0


def test_plain_and_small_images_have_no_corner():
    for pixels in (np.zeros((0, 0)), np.full((64, 64), 9.0), np.random.default_rng(1).normal(size=(10, 10))):
        found = media.describe(pixels.astype(np.float32))
        assert len(found) == 0 and len(media.keys(found)) == 0
        assert media.consensus(found, media.describe(image(1)))[0] == 0


def test_descriptors_turn_with_the_image():
    a, b = media.describe(image(2)), media.describe(np.rot90(image(2)).copy())
    same = (a["bits"][:, None, :] == b["bits"][None]).all(2).any(1)
    assert same.mean() > 0.5
    votes, turn, scale, _, _ = media.consensus(b, a)
    assert votes >= media.CONSENSUS and abs(turn - 270) < 5 and abs(scale - 1) < 0.05


def test_large_images_are_described_at_their_working_size():
    large = np.kron(image(3), np.ones((12, 12), np.float32))
    found = media.describe(large)
    assert len(found) and found["x"].max() > media.SIDE
    votes, turn, scale, _, _ = media.consensus(found, media.describe(np.kron(image(3), np.ones((4, 4), np.float32))))
    assert votes >= media.CONSENSUS and abs(scale - 3) < 0.2 and min(turn, 360 - turn) < 5


def test_matching_equals_brute_force():
    a, b = media.describe(image(4)), media.describe(rasters.edited(image(4), 4))
    own, other = media.matched(a, b)
    bits = [[int(np.unpackbits(x ^ y).sum()) for y in b["bits"]] for x in a["bits"]]
    assert own.tolist() == [k for k, row in enumerate(bits) if min(row) <= media.RADIUS]
    assert all(bits[k][j] == min(bits[k]) for k, j in zip(own.tolist(), other.tolist(), strict=True))


def test_consensus_equals_trying_each_motion():
    """Votes against a plain count, match by match, on small images."""
    for seed in range(6):
        a, b = media.describe(rasters.edited(image(seed), seed)), media.describe(image(seed))
        own, other = media.matched(a, b)
        q, f = a[own], b[other]
        turn, size = (q["angle"].astype(float) - f["angle"]) % 360, f["scale"].astype(float) / q["scale"]
        best = 0
        for k in range(len(q)):
            c, s = np.cos(np.radians(turn[k])), np.sin(np.radians(turn[k]))
            places = set()
            for j in range(len(q)):
                x, y = float(f["x"][j]) - float(f["x"][k]), float(f["y"][j]) - float(f["y"][k])
                off = np.hypot(q["x"][k] + size[k] * (x * c - y * s) - q["x"][j], q["y"][k] + size[k] * (x * s + y * c) - q["y"][j])
                near = off <= 0.12 * size[k] * np.hypot(x, y) + media.SHIFT / min(1.0, float(q["scale"].max()))
                if near and abs((turn[j] - turn[k] + 180) % 360 - 180) <= media.TURN and abs(np.log(size[j] / size[k])) <= np.log(media.FACTOR):
                    places.add((f["x"][j] // media.SHIFT, f["y"][j] // media.SHIFT))
            best = max(best, len(places))
        assert best >= media.CONSENSUS
        assert media.consensus(a, b)[0] == best


def test_recall_by_kind_of_edit():
    """Keys and votes together, for copies that are cropped, turned, resized, darker and coarser; and for other images."""
    edited = {k: media.describe(media.pixels_of(media.pgm(rasters.edited(image(k), k)))) for k in range(60)}
    whole = {k: media.describe(media.pixels_of(media.pgm(image(k))), media.INDEX_SCALES) for k in range(60)}
    found = [agreed(edited[k], whole[k]) >= media.AGREE and media.consensus(edited[k], whole[k])[0] >= media.CONSENSUS for k in edited]
    assert np.mean(found) >= 0.9
    assert not any(media.consensus(edited[k], whole[(k + 1) % 60])[0] >= media.CONSENSUS for k in edited)


def test_candidates_equal_a_plain_count(spark, monkeypatch):
    """Whether the queries' entries are broadcast or shuffled."""
    edited = {k: media.describe(rasters.edited(image(k), k)) for k in range(6)}
    whole = {k: media.describe(image(k), media.INDEX_SCALES) for k in range(12)}
    queried, index = (spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in side.items()], "name bigint, found binary") for side in (edited, whole))
    expected = {(a, b) for a in edited for b in whole if agreed(edited[a], whole[b]) >= media.AGREE}
    assert 5 <= len(expected) < 72
    for rows in (media.BROADCAST_ROWS, 0):
        monkeypatch.setattr(media, "BROADCAST_ROWS", rows)
        assert {tuple(x) for x in media.candidates(queried, index).collect()} == expected


def test_all_edited_copies_are_found(spark):
    """Recall against the truth: each edited image is a copy of its own row's class, and of no far one."""
    rows = queries.op6_media_copies(spark, "/root/testdata/sf0.1").collect()
    own = {x.vec_id: x.class_vec_id for x in rows if x.kind == "member"}
    got = {(x.vec_id, x.class_vec_id) for x in rows if x.kind == "copy"}
    asked = set(range(0, 2000, 50))
    assert len(own) == 2000 and {a for a, _ in got} <= asked
    assert sum((k, own[k]) in got for k in asked) >= 0.9 * len(asked)
    vectors = {x.vec_id: np.array(x.embedding) for x in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    cosine = lambda a, b: float(vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b]))
    assert all(cosine(a, b) > 0.8 for a, b in got)
    assert all(cosine(a, b) > 0.8 for a, b in own.items())
    near = {(a, b) for a in asked for b in vectors if cosine(a, b) > 0.99}
    assert sum((a, own[b]) in got for a, b in near) >= 0.9 * len(near)


def test_members_nulls_and_clashing_names(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=64).tolist() for _ in range(4)]
    near = (np.array(vectors[0]) + 0.01 * rng.normal(size=64)).tolist()
    table = spark.createDataFrame([(1, vectors[0]), (2, vectors[0]), (3, vectors[1]), (4, None), (5, [0.0] * 64), (3, vectors[1]), (6, near)], "id bigint, v array<double>")
    images = rasters.with_images(table, "v", "id").withColumns({x: F.lit("x") for x in ("image", "name", "key", "other", "found", "keys", "class_id", "query_id")})
    asked = rasters.with_images(table.where(F.col("id").isin(1, 4, 5)), "v", "id", edit=True)
    copies, members = media.find_copies(images, asked)
    head = {x.id: x.class_id for x in members.collect()}
    assert len({head[1], head[2], head[6]}) == 1 and head[3] == 3 and head[5] == 5 and 4 not in head
    assert members.count() == 6
    assert [(x.query_id, x.class_id) for x in copies.collect()] == [(1, head[1])]
    for a, b in ((images.limit(0), asked), (images, asked.limit(0)), (images.limit(0), asked.limit(0))):
        assert media.find_copies(a, b)[0].count() == 0


def near_rows(a, b):
    """How often descriptors share a window and are near, bit by bit."""
    sides = []
    for found in (a, b):
        bits = np.unique(np.unpackbits(found["bits"], axis=1, bitorder="little"), axis=0)
        sides.append((bits, [np.roll(bits, -k * media.TESTS // media.WINDOWS, axis=1)[:, : media.WINDOW_BITS] for k in range(media.WINDOWS)]))
    apart = (sides[0][0][:, None] != sides[1][0][None]).sum(2)
    shared = sum((x[:, None] == y[None]).all(2).astype(int) for x, y in zip(sides[0][1], sides[1][1], strict=True))
    return int(((apart <= media.NEAR) * shared).sum())


def test_near_candidates_equal_a_plain_count(spark, monkeypatch):
    """Whether the queries' keys are broadcast or shuffled."""
    edited = {k: media.describe(rasters.edited(image(k), k)) for k in range(6)}
    whole = {k: media.describe(image(k), media.INDEX_SCALES) for k in range(12)} | {12: np.zeros(0, media.RECORD)}
    queried, index = (spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in side.items()], "name bigint, found binary") for side in (edited, whole))
    expected = {(a, b) for a in edited for b in whole if near_rows(edited[a], whole[b])}
    assert {(k, k) for k in edited} <= expected and len(expected) < 72
    for rows in (media.BROADCAST_ROWS, 0):
        monkeypatch.setattr(media, "BROADCAST_ROWS", rows)
        assert {tuple(x) for x in media.near_candidates(queried, index).collect()} == expected


def test_rows_joined_by_key_are_near_ones():
    """Of images that are no copies of each other, few descriptors are joined; more edited copies are candidates than by stretches."""
    edited = {k: media.describe(media.pixels_of(media.pgm(rasters.edited(image(k), k)))) for k in range(60, 120)}
    whole = {k: media.describe(media.pixels_of(media.pgm(image(k))), media.INDEX_SCALES) for k in range(60, 120)}
    own = [near_rows(edited[k], whole[k]) > 0 for k in edited]
    assert np.mean(own) >= 0.95 and sum(own) >= sum(agreed(edited[k], whole[k]) >= media.AGREE for k in edited)
    chance = [(near_rows(edited[k], whole[k + 1]), agreed(edited[k], whole[k + 1])) for k in range(60, 119)]
    assert 4 * sum(x for x, _ in chance) < sum(x for _, x in chance)


def test_consensus_gives_up_only_below_the_votes_asked_for():
    """With a least number of votes the result is the same from that number on, and none below it."""
    rnd = np.random.default_rng(4)
    image = rasters.raster(list(rnd.normal(size=16)))
    pairs = [(media.describe(rasters.edited(image, k)), media.describe(rasters.raster(list(rnd.normal(size=16))) if k % 2 else image, media.INDEX_SCALES)) for k in range(12)]
    found = [(media.consensus(a, b), media.consensus(a, b, media.CONSENSUS)) for a, b in pairs]
    assert all(some == (every if every[0] >= media.CONSENSUS else (0, 0.0, 1.0, 0.0, 0.0)) for every, some in found)
    assert len({every[0] >= media.CONSENSUS for every, _ in found}) == 2


def test_copies_are_the_same_however_queries_are_dealt(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rnd.normal(size=16)]) for k in range(30)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    images, asked = rasters.with_images(vectors, "vector", "id"), rasters.with_images(vectors.where("id % 3 = 0"), "vector", "id", edit=True)
    whole = sorted(map(tuple, media.find_copies(images, asked)[0].collect()))
    monkeypatch.setattr(media, "BROADCAST_BYTES", 10_000)
    dealt = sorted(map(tuple, media.find_copies(images, asked)[0].collect()))
    assert len(whole) >= 9 and dealt == whole
