"""Blocked Bloom filter: every key sets eight bits inside one 32-byte block.

Built with a grouped bit-or over block numbers, so no task and no driver ever
sees the keys themselves; what reaches the driver is the filter, whose size is
bounded by ``max_bytes``. A filter that is too small for its keys only passes
more false hits, which the exact join behind it removes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: One odd multiplier a word; the top five bits of the product choose the bit.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)


def block_count(n_keys: int, max_bytes: int, bits_per_key: int = 16) -> int:
    """Blocks for ``n_keys`` keys, as many as ``max_bytes`` allows at most."""
    return max(1, min(n_keys * bits_per_key // 256 + 1, max_bytes // (4 * WORDS)))


def _places(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    keys = hashes.astype(np.int64).view(np.uint64)
    block = ((keys >> np.uint64(32)) % np.uint64(n_blocks)).astype(np.int64)
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return block, np.uint32(1) << ((low[:, None] * SALTS[None, :]) >> np.uint32(27))


def build(keys: DataFrame, column: str, n_blocks: int) -> np.ndarray:
    """The filter over the 64-bit hashes in ``column``: ``uint32[n_blocks, 8]``."""

    def partial(batches):
        for batch in batches:
            hashes = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            if not len(hashes):
                continue
            block, bits = _places(hashes, n_blocks)
            order = np.argsort(block, kind="stable")
            block, bits = block[order], bits[order]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            merged = np.bitwise_or.reduceat(bits, first, axis=0).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block[first]), *(pa.array(np.ascontiguousarray(merged[:, i])) for i in range(WORDS))], ["block", *(f"w{i}" for i in range(WORDS))])

    schema = "block long, " + ", ".join(f"w{i} int" for i in range(WORDS))
    blocks = keys.select(column).mapInArrow(partial, schema).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
    out = np.zeros((n_blocks, WORDS), dtype=np.uint32)
    found = blocks.toArrow()  # at most n_blocks rows
    if found.num_rows:
        at = found.column("block").to_numpy()
        for i in range(WORDS):
            out[at, i] = found.column(f"w{i}").to_numpy().view(np.uint32)
    return out


def contains(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; never false for one that is."""
    if not len(hashes):
        return np.zeros(0, dtype=bool)
    keys = hashes.astype(np.int64).view(np.uint64)
    block = ((keys >> np.uint64(32)) % np.uint64(len(bits))).astype(np.int64)
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.zeros(len(hashes), dtype=bool)
    left = np.arange(len(hashes))
    for i in range(WORDS):  # most keys that are not there go at the first word
        left = left[bits[block[left], i] >> ((low[left] * SALTS[i]) >> np.uint32(27)) & np.uint32(1) > 0]
    out[left] = True
    return out


def split(df: DataFrame, column: str, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose hash in ``column`` may be in the filter, and those whose hash is not; null is not."""
    sent = df.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def maybe(hashes: pa.Array) -> pa.Array:
        known = hashes.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(known & contains(sent.value, hashes.fill_null(0).to_numpy(zero_copy_only=False)))

    return df.filter(maybe(F.col(column))), df.filter(~maybe(F.col(column)))


def probe(df: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """Rows of ``df`` whose hash in ``column`` may be in the filter."""
    return split(df, column, bits)[0]
