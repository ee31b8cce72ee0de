"""Embedders: vectors of texts, a batch at a time."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prefixes of queries and documents.
QUERY_PREFIX, DOCUMENT_PREFIX = "Query: ", "Document: "


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors from a text's FNV-1a hash by xorshift; a deterministic stand-in for a model."""

    dim = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        raw = [t.encode() for t in texts]
        length = np.array([len(b) for b in raw], np.int64)
        order = np.argsort(-length, kind="stable")  # longest first: those that still have a byte at a place are the first ones
        length, joined = length[order], np.frombuffer(b"".join(raw[i] for i in order), np.uint8).astype(np.uint64)
        starts, h = np.cumsum(length) - length, np.full(len(raw), 0xCBF29CE484222325, np.uint64)
        rising = -length
        for at in range(int(length[0]) if len(raw) else 0):
            n = np.searchsorted(rising, -at)  # texts longer than ``at``
            h[:n] = (h[:n] ^ joined[starts[:n] + at]) * np.uint64(0x100000001B3)
        seeds = np.empty_like(h)
        seeds[order] = h | np.uint64(1)
        x, out = seeds, np.empty((len(texts), self.dim), np.float32)
        for k in range(self.dim):
            x ^= x << np.uint64(13)
            x ^= x >> np.uint64(7)
            x ^= x << np.uint64(17)
            out[:, k] = (x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)
        return out / (np.sqrt((out * out).sum(1, keepdims=True)) + np.float32(1e-9))


def embed(rows: DataFrame, embedder: Embedder, text_col: str = "text", prefix: str = "", batch: int = 512) -> DataFrame:
    """``rows`` with vec; null texts have none. The embedder is sent to each task once."""
    schema = rows.select(F.struct("*").alias("row"), F.array().cast("array<float>").alias("vec")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                part = whole.slice(i, batch)
                texts = part.column(0).to_pylist()
                found = iter(embedder.embed([prefix + t for t in texts if t is not None]).tolist())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([None if t is None else next(found) for t in texts], pa.list_(pa.float32()))], names=["row", "vec"])

    return rows.select(F.col(text_col), F.struct("*").alias("row")).mapInArrow(run, schema).select("row.*", "vec")


def base64_vector(vector: list[float]) -> str:
    """A vector as base64 of little-endian 32-bit floats."""
    return base64.b64encode(np.asarray(vector, "<f4").tobytes()).decode()


def encode_bf16(vectors: np.ndarray) -> bytes:
    """Two bytes a number, halves to even."""
    bits = np.asarray(vectors, "<f4").view(np.uint32)
    rounded = bits + 0x7FFF + (bits >> 16 & 1)
    return np.where(np.isnan(vectors), bits | 0x400000, rounded).astype(np.uint32).__rshift__(16).astype("<u2").tobytes()


def decode_blob(blob: bytes, dim: int) -> np.ndarray:
    """A stored vector: four bytes a number if it is that long, else two; zeros if it is too short."""
    if len(blob) == 4 * dim:
        return np.frombuffer(blob, "<f4").copy()
    if len(blob) >= 2 * dim:
        return (np.frombuffer(blob, "<u2", dim).astype(np.uint32) << 16).view(np.float32)
    return np.zeros(dim, np.float32)
