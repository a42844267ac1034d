"""Shards by a Feistel permutation of global row numbers.

Rows are numbered in doc_id order; a keyed Feistel network over the next power
of two, walked until it falls below the row count, permutes the numbers. The
permuted number p gives shard p mod S and slot p div S: a reproducible
shuffle in which anyone can compute a row's place, or the row at a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import mix64
from ledgerlens.operators.ranks import ordered_prefix

ROUNDS = 6


class Feistel:
    """Permutation of 0..n-1. Halves of ``high`` and ``low`` bits are changed
    in turn by a keyed hash of the other half; results of n or more are
    permuted again (cycle walking), which ends, as the walk is a cycle
    through its start. The domain is under 2n, so two steps are usual."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n = n
        bits = max(2, (max(n, 1) - 1).bit_length())
        self.low, self.high = bits // 2, bits - bits // 2
        self.keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64((seed * 1000003) % (1 << 63)))

    def _change(self, half: np.ndarray, k: int, bits: int) -> np.ndarray:
        return mix64(half ^ self.keys[k]) >> np.uint64(64 - bits)

    def _step(self, x: np.ndarray) -> np.ndarray:
        low, high = np.uint64(self.low), np.uint64(self.high)
        a, b = x >> low, x & ((np.uint64(1) << low) - np.uint64(1))
        for k in range(len(self.keys)):
            if k % 2:
                b ^= self._change(a, k, int(low))
            else:
                a ^= self._change(b, k, int(high))
        return a << low | b

    def _back(self, x: np.ndarray) -> np.ndarray:
        low, high = np.uint64(self.low), np.uint64(self.high)
        a, b = x >> low, x & ((np.uint64(1) << low) - np.uint64(1))
        for k in reversed(range(len(self.keys))):
            if k % 2:
                b ^= self._change(a, k, int(low))
            else:
                a ^= self._change(b, k, int(high))
        return a << low | b

    def _walk(self, x, step) -> np.ndarray:
        x = np.asarray(x, np.uint64)
        shape, x = x.shape, step(x.ravel().copy())
        out = np.flatnonzero(x >= self.n)
        while len(out):
            x[out] = step(x[out])
            out = out[x[out] >= self.n]
        return x.astype(np.int64).reshape(shape)

    def place(self, number) -> np.ndarray:
        """Permuted numbers of row numbers."""
        return self._walk(number, self._step)

    def number(self, place) -> np.ndarray:
        """Row numbers of permuted numbers."""
        return self._walk(place, self._back)

    def at(self, shard, slot, shards: int) -> np.ndarray:
        """Row number of the row in a slot of a shard."""
        return self.number(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64))


def _place(n: int, seed: int, shards: int):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        permutation = Feistel(n, seed)
        for numbers in parts:
            p = permutation.place(numbers.to_numpy())
            yield pd.DataFrame({"shard": (p % shards).astype(np.int32), "slot": p // shards})
    return F.pandas_udf(run, "shard int, slot long")


def feistel_shards(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Place of every document: (doc_id, size, text_crc32, row_number, shard, slot).

    Law ``rows``: shard sizes differ by one row at most, slots of a shard run
    from 0 without gaps, and the place follows from the row number alone. Needs
    ``doc_id`` and ``text``; other columns are not read. ``size`` is the text's
    UTF-8 bytes (a null text has none) plus 8. Row numbers follow doc_id (null
    last), then size, CRC-32 and place in the scan: repeated rows get different
    places. An empty table gives an empty result. Only ids, sizes and CRCs are
    shuffled; numbering is a range partition with per-partition offsets.
    """
    raw = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("_tie"))
    numbered = ordered_prefix(rows, ["doc_id", "size", "text_crc32", "_tie"], {"_before": F.lit(1).cast("long")},
                              inclusive=False).drop("_tie")
    n = docs.select(F.count(F.lit(1))).first()[0]
    placed = numbered.withColumn("_p", _place(n, seed, shards)("_before"))
    return placed.select("doc_id", "size", "text_crc32", F.col("_before").alias("row_number"), "_p.shard", "_p.slot")


def write_shards(docs: DataFrame, places: DataFrame, path: str) -> None:
    """Write the documents as one sorted folder per shard; ``places`` is the
    result of ``feistel_shards`` over tables with unique doc_ids."""
    (docs.join(places.select("doc_id", "shard", "slot"), "doc_id")
     .repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
