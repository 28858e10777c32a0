"""A Bloom filter over a column of longs, sized for them, to keep rows that can't find a partner out of a shuffle.

The filter is cut into slices; all bits of a key lie in one of them. Keys are dealt by slice, so that each slice is
made once, whatever the number of tasks, and no task holds more than one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, bits looked at, and most bits in all: 32 MB. A fuller filter lets more rows pass, and loses none.
BITS_PER_KEY, PROBES, MOST_BITS = 16, 6, 1 << 28
#: Bits of a slice: 512 keys.
SLICE_BITS = 1 << 13


def _slices(keys: np.ndarray, slices: int) -> np.ndarray:
    return (((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.int64)


def _places(keys: np.ndarray) -> np.ndarray:
    """The places of a key's bits in its slice."""
    u = keys.view(np.uint64)
    low, high = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(PROBES, dtype=np.uint64) * high[:, None]) & np.uint64(SLICE_BITS - 1)).astype(np.int64)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of each slice, from keys in the order of their slices."""
    now, held = None, np.zeros(SLICE_BITS, dtype=bool)

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()])], ["slice", "bits"])

    for batch in batches:
        slices, places = batch.column("slice").to_numpy(), _places(batch.column("key").to_numpy())
        starts = np.flatnonzero(np.diff(slices, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(slices)], strict=True):
            if slices[start] != now:
                if now is not None:
                    yield made()
                now, held = int(slices[start]), np.zeros(SLICE_BITS, dtype=bool)
            held[places[start:end].ravel()] = True
    if now is not None:
        yield made()


def bloom(hashes: DataFrame, n: int) -> Broadcast:
    """The filter of the n hashes in the one column of `hashes`, broadcast."""
    slices = max(1, -(-min(MOST_BITS, BITS_PER_KEY * n) // SLICE_BITS))
    of_key = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(slices), 32).cast("int")
    dealt = hashes.toDF("key").select("key", of_key.alias("slice")).repartition("slice").sortWithinPartitions("slice")
    found = dealt.mapInArrow(_filled, "slice int, bits binary").toArrow()
    packed = np.zeros((slices, SLICE_BITS // 8), dtype=np.uint8)
    for at, bits in zip(found["slice"].to_pylist(), found["bits"], strict=True):
        packed[at] |= np.frombuffer(bits.as_py(), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(packed.ravel())


def might_hold(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = _slices(hashes, 8 * len(packed) // SLICE_BITS)[:, None] * SLICE_BITS + _places(hashes)
    return ((packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(axis=1)
