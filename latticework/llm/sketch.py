"""Counts of hashes over a whole corpus by a sketch of fixed size.

Hashes of one counter share their count, and counts end at 255 a task and 65,535 in all, so they may only steer work.  Tasks send their
counters compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Counters (two bytes each, so 8 MB), and those of one block of them on the way.
SKETCH_BITS, BLOCK_BITS = 22, 16


def counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count(hashes: Callable[[pa.Array], Iterator[np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sketch of a partition's texts (id, text), by blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, size = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0

        def take() -> None:
            nonlocal waiting, size
            if waiting:
                np.add(counts, np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.uint32), out=counts)
            waiting, size = [], 0

        for batch in batches:
            for own in hashes(batch.column(1)):
                waiting.append(counter(own))
                size += len(own)
                if size > 1 << 20:
                    take()
        take()
        blocks = np.minimum(counts, 255).astype(np.uint8).reshape(-1, 1 << BLOCK_BITS)
        used = np.flatnonzero(blocks.any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zstandard.compress(blocks[b].tobytes()) for b in used], pa.binary())], names=["block", "counts"])

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zstandard.decompress(raw), np.uint8).astype(np.uint32)
            total[block] = np.minimum(total.get(block, 0) + own, 65535)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(np.uint16).tobytes() for v in total.values()], pa.binary())], names=["block", "counts"])


def hash_counts(texts: DataFrame, hashes: Callable[[pa.Array], Iterator[np.ndarray]]) -> np.ndarray:
    """How many hashes of the texts (id, text) fall on each counter, 65,535 at most; what returns to the driver has a fixed size."""
    schema = "block int, counts binary"
    blocks = texts.mapInArrow(_count(hashes), schema).repartition(1 << (SKETCH_BITS - BLOCK_BITS), "block").mapInArrow(_sum_blocks, schema)
    out = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint16)
    for r in blocks.collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.uint16)
    return out.ravel()
