"""Scaling of raw pixel tensors: channel order, stretch to a fixed size, values in [0, 1].

A tensor is a row's (height, width, channels, data), data being one byte a value, row by row, channels innermost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Height and width that models of this kind read.
TARGET = (224, 224)
#: Bytes of scaled tensors that a task hands on at once.
RUN_BYTES = 16 << 20


@lru_cache(maxsize=256)
def weights(size: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of the target: the two source places it lies between, by centres, and the share of the second."""
    at = np.clip((np.arange(target) + 0.5) * (size / target) - 0.5, 0, size - 1)
    low = np.minimum(np.floor(at).astype(np.int64), size - 1)
    return low, np.minimum(low + 1, size - 1), at - low


def scaled(pixels: np.ndarray, target: tuple[int, int] = TARGET, reverse: bool = True) -> np.ndarray:
    """(channels, *target) float32 of a uint8 tensor (height, width, channels): bilinear, rounded to whole levels, over 255.

    `reverse` turns the order of channels round (blue first to red first). Levels at a half go up.
    """
    if pixels.ndim != 3 or not pixels.size:
        raise ValueError("a tensor has height, width and channels, none of them 0")
    y0, y1, fy = weights(pixels.shape[0], target[0])
    x0, x1, fx = weights(pixels.shape[1], target[1])
    x = (pixels[:, :, ::-1] if reverse else pixels).transpose(2, 0, 1).astype(np.float64)
    rows = x[:, y0] * (1 - fy)[None, :, None] + x[:, y1] * fy[None, :, None]
    out = rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx
    return (np.floor(out + 0.5) / 255).astype(np.float32)


def tensor_of(height: int | None, width: int | None, channels: int | None, data: bytes | None) -> np.ndarray:
    """A row's tensor; values that don't fit together raise ValueError."""
    if data is None or not height or not width or not channels or min(height, width, channels) < 1 or height * width * channels != len(data):
        raise ValueError("the data do not fill height x width x channels")
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def scale_pixels(images: DataFrame, target: tuple[int, int] = TARGET, reverse: bool = True, id_col: str = "item_id") -> DataFrame:
    """(id, pixels array<float>) of `images` (id, height, width, channels, data): channel by channel, row by row; null where the data don't fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, held = [], [], 0
            rows = zip(*(batch.column(k) for k in range(5)), strict=True)
            for k, (i, *shape, data) in enumerate(rows):
                try:
                    one = scaled(tensor_of(*(x.as_py() for x in shape), data.as_py()), target, reverse).ravel()
                except ValueError:
                    one = None
                ids.append(i.as_py())
                out.append(one)
                held += 0 if one is None else one.nbytes
                if held > RUN_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(out, pa.list_(pa.float32()))], names=["id", "pixels"])
                    ids, out, held = [], [], 0

    src = images.select(F.col(id_col).alias("id"), *(F.col(c).cast("int").alias(c) for c in ("height", "width", "channels")), F.col("data").cast("binary").alias("data"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, pixels array<float>").withColumnRenamed("id", id_col)
