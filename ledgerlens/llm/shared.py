"""Which hashes of a row occur in other rows: an exact shuffle of packed hashes.

Tasks send the distinct hashes of a slice of rows as blobs, one for each hash
partition; a partition sees all occurrences of its hashes, counts them, and
answers every slice in the same packed form. One Spark row thus carries
thousands of hashes, and a very common hash is one entry per row that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.common import released_group

MESSAGE = pa.schema([("slice", pa.int64()), ("part", pa.int64()), ("counts", pa.binary()), ("hashes", pa.binary())])
MESSAGE_DDL = "slice long, part long, counts binary, hashes binary"


def slice_key(part: pa.RecordBatch) -> int:
    """Key of a slice: the place (``row_key``) of its first row in the scan. A
    task that runs again reads the same rows in the same order from its files,
    so keys and contents stay."""
    return part.column("row_key")[0].as_py()


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes % np.uint64(parts)).astype(np.int64)


def scatter(key: int, n_rows: int, rows: np.ndarray, hashes: np.ndarray, parts: int, wide: bool,
            header: bytes) -> Iterator[pa.RecordBatch]:
    """Messages of one slice: per partition the number of hashes of each row,
    and the hashes in row order (the rest after division by ``parts``: in 32
    bits, or 64 if ``wide``); and one header message."""
    part = part_of(hashes, parts)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    rest = hashes // np.uint64(parts)
    rest = rest if wide else (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = [(key, -1 - key % parts, b"", header)]
    for p in range(parts):
        own = order[ends[p]:ends[p + 1]]
        if len(own):
            out.append((key, p, np.bincount(rows[own], minlength=n_rows).astype("<u4").tobytes(),
                        rest[own].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), MESSAGE)], schema=MESSAGE)


def _count(values: np.ndarray) -> np.ndarray:
    """How often each element's value occurs."""
    order = np.argsort(values, kind="stable")
    first = np.flatnonzero(np.r_[True, values[order][1:] != values[order][:-1]])
    size = np.diff(np.r_[first, len(values)])
    out = np.empty(len(values), np.uint32)
    out[order] = np.repeat(size, size)
    return out


def _per_row(table: pa.Table) -> pa.Table:
    """Answers: for each row of a slice, how many of its hashes occur in another row."""
    if table["part"][0].as_py() < 0:
        return table
    counts = [np.frombuffer(b, "<u4") for b in table["counts"].to_pylist()]
    hashes = [np.frombuffer(b, np.uint32) for b in table["hashes"].to_pylist()]
    values = np.sort(np.concatenate(hashes))
    again = np.unique(values[1:][values[1:] == values[:-1]])
    out = []
    for c, h in zip(counts, hashes):
        if len(again):
            at = np.minimum(np.searchsorted(again, h), len(again) - 1)
            sums = np.concatenate(([0], np.cumsum(again[at] == h)))
        else:
            sums = np.zeros(len(h) + 1, np.int64)
        end = np.cumsum(c)
        out.append((sums[end] - sums[end - c]).astype("<u4").tobytes())
    return pa.table([table["slice"], table["part"], pa.array([b""] * len(out), pa.binary()),
                     pa.array(out, pa.binary())], schema=MESSAGE)


def _per_hash(parts: int):
    def run(table: pa.Table) -> pa.Table:
        """Answers: counts as sent, then the hashes in full and how often each occurs."""
        if table["part"][0].as_py() < 0:
            return table
        sent = [np.frombuffer(b, np.uint64) for b in table["hashes"].to_pylist()]
        own = np.uint64(table["part"][0].as_py())
        df = _count(np.concatenate(sent))
        ends = np.cumsum([len(h) for h in sent])
        out = [(h * np.uint64(parts) + own).tobytes() + d.astype("<u4").tobytes()
               for h, d in zip(sent, np.split(df, ends[:-1]))]
        return pa.table([table["slice"], table["part"], table["counts"], pa.array(out, pa.binary())], schema=MESSAGE)
    return run


def count_shared(messages: DataFrame) -> DataFrame:
    return messages.groupBy("part").applyInArrow(released_group(_per_row), MESSAGE_DDL)


def count_hashes(messages: DataFrame, parts: int) -> DataFrame:
    return messages.groupBy("part").applyInArrow(released_group(_per_hash(parts)), MESSAGE_DDL)


def per_row_total(table: pa.Table, n_rows: int) -> np.ndarray:
    """Sum of a slice's answers of ``count_shared``."""
    total = np.zeros(n_rows, np.int64)
    for part, blob in zip(table["part"].to_pylist(), table["hashes"].to_pylist()):
        if part >= 0:
            total += np.frombuffer(blob, "<u4")
    return total


def header_of(table: pa.Table) -> bytes:
    return next(b for p, b in zip(table["part"].to_pylist(), table["hashes"].to_pylist()) if p < 0)
