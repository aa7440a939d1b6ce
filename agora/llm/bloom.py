"""A Bloom filter of fixed size over a column of 64-bit keys, built on Spark and sent to the tasks.

It only spares work: a key that was added always passes, and so do some others, more of them the fuller the filter
is. Whatever it lets through has to be joined with the keys themselves. Its size (``2 ** bits`` bits, 8 MB by default)
does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Bits of the filter as a power of two, and of the pieces that it is built from.
BITS, PIECE = 26, 18


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    k = keys.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        a = (k ^ (k >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        b = (k ^ (k >> np.uint64(27))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (a >> np.uint64(64 - bits)).astype(np.int64), (b >> np.uint64(64 - bits)).astype(np.int64)


def build(keys: DataFrame, bits: int = BITS) -> Broadcast:
    """``keys``: one long column. Null keys are ignored."""
    column, piece = keys.columns[0], min(PIECE, bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> piece, pa.int32()), pa.array(at & ((1 << piece) - 1), pa.int32())],
                                             ["piece", "at"])

    def fill(group: pd.DataFrame) -> pd.DataFrame:  # at most 2 ** PIECE places
        held = np.zeros(1 << piece, np.uint8)
        held[group["at"].to_numpy()] = 1
        return pd.DataFrame({"piece": group["piece"].iloc[:1], "held": [np.packbits(held).tobytes()]})

    pieces = (keys.where(f"`{column}` IS NOT NULL").mapInArrow(places, "piece int, at int").distinct()
              .groupBy("piece").applyInPandas(fill, "piece int, held binary"))
    whole = np.zeros(1 << max(0, bits - 3), np.uint8)
    size = 1 << (piece - 3)
    for row in pieces.toLocalIterator():  # at most 2 ** (bits - PIECE) rows of 2 ** (PIECE - 3) bytes
        whole[row["piece"] * size:(row["piece"] + 1) * size] = np.frombuffer(row["held"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)


def passes(whole: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` may be in the filter."""
    bits = (len(whole) * 8).bit_length() - 1
    out = np.ones(len(keys), bool)
    for at in _places(keys, bits):
        out &= (whole[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out
