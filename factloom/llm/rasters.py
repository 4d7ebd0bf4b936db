"""Grey images drawn from vectors: a media column for tables that hold none, and edited copies of it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.media import pgm, sampled

#: An image has CELLS * CELLS squares of CELL pixels.
CELLS, CELL = 24, 5


@lru_cache(maxsize=4)
def _weights(n: int) -> np.ndarray:
    """What each number of a vector adds to each square; from a fixed seed."""
    return np.random.default_rng(n).normal(size=(n, CELLS * CELLS)).astype(np.float32)


def raster(vector: list[float]) -> np.ndarray:
    """An image whose squares mix the vector's numbers, so that near vectors make near images."""
    v = np.nan_to_num(np.asarray(vector, np.float32))
    length = float(np.linalg.norm(v)) or 1.0
    squares = (v / length) @ _weights(len(v)) * 45 + 128
    return np.kron(np.clip(squares, 0, 255).reshape(CELLS, CELLS), np.ones((CELL, CELL), np.float32))


def edited(image: np.ndarray, seed: int) -> np.ndarray:
    """A copy that is cropped, turned by up to 15 degrees and in half the cases by a right angle, resized to between
    0.75 and 1.25, darker, flatter, noisy and coarser in its grey levels."""
    random = np.random.default_rng(seed % (1 << 63))
    keep = int(image.shape[0] * 0.85)
    top, left = random.integers(0, image.shape[0] - keep + 1, 2)
    size, turn = random.uniform(0.75, 1.25), np.radians(random.uniform(-15, 15))
    n = round(keep * size)
    y, x = (np.mgrid[:n, :n] - (n - 1) / 2) / size
    middle = (keep - 1) / 2
    part = sampled(image, top + middle + y * np.cos(turn) + x * np.sin(turn), left + middle + x * np.cos(turn) - y * np.sin(turn))
    part = np.rot90(part, int(random.integers(0, 2))) * 0.8 + 15 + random.normal(0, 2, part.shape)
    return np.rint(part / 4) * 4


def with_images(df: DataFrame, vector_col: str, id_col: str, media_col: str = "media", edit: bool = False) -> DataFrame:
    """id_col and an image of each row's vector (null: no image), or an edited copy of it."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part, images = batch.slice(start, 500), []
                for own, vector in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    image = raster([x or 0.0 for x in vector]) if vector else None
                    images.append(None if image is None else pgm(edited(image, own or 0) if edit else image))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(images, pa.binary())], names=[id_col, media_col])

    return rows.mapInArrow(run, f"`{id_col}` bigint, `{media_col}` binary")
