"""Vectors as binary: two bytes a number for storage, four bits a number for a first choice; multiplied straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that share a scale and a bias.
GROUP = 64


def to_bf16(x: np.ndarray) -> np.ndarray:
    """The upper halves of 32-bit floats, halves to even; what is not a number stays so."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return np.where(np.isnan(x), bits | 0x400000, bits + 0x7FFF + (bits >> 16 & 1)).astype(np.uint32).__rshift__(16).astype("<u2")


def matrix(blobs: pa.Array, dim: int) -> np.ndarray:
    """Rows of 32-bit floats: four bytes a number where a blob is that long, else two; zeros where it is null or too short."""
    if not len(blobs):
        return np.zeros((0, dim), np.float32)
    _, ends, data = blobs.buffers()
    kind = np.int64 if pa.types.is_large_binary(blobs.type) else np.int32
    at = np.frombuffer(ends, kind, len(blobs) + 1, blobs.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    sizes = np.diff(at)
    if not blobs.null_count and (sizes == 2 * dim).all():  # all in one piece
        return (data[at[0] : at[-1]].view("<u2").astype(np.uint32) << 16).view(np.float32).reshape(-1, dim)
    out, known = np.zeros((len(blobs), dim), np.float32), np.asarray(blobs.is_valid())
    for width, own in ((4, known & (sizes == 4 * dim)), (2, known & (sizes >= 2 * dim) & (sizes != 4 * dim))):
        rows = np.flatnonzero(own)
        if len(rows):
            raw = data[at[rows][:, None] + np.arange(width * dim)]
            out[rows] = raw.view("<f4") if width == 4 else (raw.view("<u2").astype(np.uint32) << 16).view(np.float32)
    return out


def pack(vec: Column) -> Column:
    """An array of numbers as binary, two bytes a number; null stays null."""

    @F.arrow_udf("binary")
    def packed(vec: pa.Array) -> pa.Array:
        values, sizes = to_bf16(vec.flatten().to_numpy(zero_copy_only=False)), np.nan_to_num(vec.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = values.tobytes()
        return pa.array([raw[2 * a : 2 * b] if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), vec.is_valid().to_pylist(), strict=True)], pa.binary())

    return packed(vec)


def unpack(dim: int | None) -> Callable[[Column], Column]:
    """Binary as an array of ``dim`` numbers; see ``matrix``."""
    size = dim or 0

    @F.arrow_udf("array<float>")
    def unpacked(blobs: pa.Array) -> pa.Array:
        x = matrix(blobs, size)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), pa.array(x.reshape(-1)))

    return unpacked


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scales, codes) of rows: of each group of numbers scale and bias as 32-bit floats, and codes 0 to 15, two a byte, the first in the lower half."""
    n, dim = x.shape
    pad = -dim % GROUP
    groups = np.concatenate([x, np.repeat(x[:, -1:], pad, 1)], 1).reshape(n, -1, GROUP).astype(np.float64)
    low = groups.min(2)
    scale = (groups.max(2) - low) / 15
    codes = np.where(scale[:, :, None] > 0, np.rint((groups - low[:, :, None]) / np.where(scale == 0, 1, scale)[:, :, None]), 0)
    codes = np.clip(codes, 0, 15).astype(np.uint8).reshape(n, -1)
    return np.stack([scale, low], 2).astype("<f4").reshape(n, -1), codes[:, ::2] | codes[:, 1::2] << 4


def coarse_scores(scales: np.ndarray, codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Products of the coded rows with a query: codes are multiplied as they are, and a group's scale and bias once."""
    n, dim = len(codes), len(query)
    groups = scales.shape[1] // 2
    q = np.zeros(groups * GROUP)
    q[:dim] = query
    parts = np.empty((n, groups * GROUP), np.float32)
    parts[:, ::2], parts[:, 1::2] = codes & 15, codes >> 4
    per = np.einsum("ngd,gd->ng", parts.reshape(n, groups, GROUP), q.reshape(groups, GROUP).astype(np.float32))
    own = scales.reshape(n, groups, 2).astype(np.float64)
    return (per * own[:, :, 0] + own[:, :, 1] * q.reshape(groups, GROUP).sum(1)).sum(1)


def quantised(rows: DataFrame, dim: int) -> DataFrame:
    """(path, modified, size, kind, chunk_index, scales, codes) of packed chunks; rows whose vector is not finite have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"), dim)
            sound = np.flatnonzero(np.isfinite(x).all(1))
            scales, codes = quantise(x[sound])
            kept = batch.drop_columns(["vec"]).take(pa.array(sound))
            arrays = [*kept.columns, pa.array([r.tobytes() for r in scales], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept.schema.names, "scales", "codes"])

    return rows.select("path", "modified", "size", "kind", "chunk_index", "vec").mapInArrow(run, "path string, modified double, size long, kind string, chunk_index int, scales binary, codes binary")


def rows_of(blobs: pa.Array, width: int, kind: str) -> np.ndarray:
    """Binary of one width as rows of numbers, straight from the buffer."""
    if not len(blobs):
        return np.zeros((0, width), kind)
    _, ends, data = blobs.buffers()
    at = np.frombuffer(ends, np.int32, len(blobs) + 1, blobs.offset * 4)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(-1, width)
