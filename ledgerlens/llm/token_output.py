"""Token-id output: best-fit-decreasing packing with a segment tree.

Documents become ids, pieces no longer than a row, and blocks of pieces of
bounded size are packed on their own: longest piece first, each into the row
with the least room that still holds it, found by a descent in a segment tree
over capacities. The result is binary: id matrix rows, cumulative segment
lengths, and positions that begin again at every segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import LEAF, encoder, id_bytes, long_text_ids, split_by_length, vocabulary
from ledgerlens.llm.common import text_slices

ROW = 2048
BLOCK_BYTES = 8 << 20       # bytes of text of a block, about
PIECE_BYTES = 64            # what a row counts besides its text


class CapacityTree:
    """Open rows by remaining capacity: counts in a complete binary tree."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        k = self.base + capacity
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Capacity and number of a row with the smallest capacity of at least ``least``."""
        k = self.base + least
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        capacity = k - self.base
        while k:
            self.count[k] -= 1
            k >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of piece numbers. ``lengths`` in any order; equal ones keep it."""
    tree, rows = CapacityTree(size), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[k])
        if found is None:
            room, row = size, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(k)
        if room > lengths[k]:
            tree.add(room - lengths[k], row)
    return rows


_PIECES_DDL = "doc_id long, row_key long, start long, ids binary"
_PIECES = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _cut(doc, key, ids: bytes, size: int, kind: str, out: list) -> None:
    ids = np.frombuffer(ids, "<u4").astype(kind)
    for at in range(0, len(ids), size):
        out.append((doc, key, at, ids[at:at + size].tobytes()))


def _batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)


def _text_task(path: str, size: int, end: bytes, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            out: list = []
            for doc, key, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row_key", "text"))):
                _cut(doc, key, id_bytes(text, path) + end, size, kind, out)
            yield _batch(out)
    return run


def _ids_task(size: int, end: bytes, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (doc, ids) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist())):
                out: list = []
                _cut(doc, k, ids + end, size, kind, out)
                yield _batch(out)
    return run


_ROWS_DDL = ("block long, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, "
             "doc_ids array<long>, starts array<long>")
_ROWS = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
                   ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()),
                   ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])


def _pack_task(size: int, kind: str, pad: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("row_key", "ascending")])
        ids = [np.frombuffer(b, kind) for b in table["ids"].to_pylist()]
        docs, starts = table["doc_id"].to_pylist(), table["start"].to_pylist()
        block, out = table["block"][0].as_py(), []
        for number, row in enumerate(best_fit_decreasing([len(x) for x in ids], size)):
            lengths = [len(ids[k]) for k in row]
            used = sum(lengths)
            line, place = np.full(size, pad, kind), np.zeros(size, "<u2" if size <= 1 << 16 else "<u4")
            line[:used] = np.concatenate([ids[k] for k in row])
            place[:used] = np.concatenate([np.arange(n) for n in lengths])
            out.append((block, number, used, line.tobytes(), np.cumsum([0, *lengths]).astype(np.int32), place.tobytes(),
                        [docs[k] for k in row], [starts[k] for k in row]))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)
    return run


def packed_rows(docs: DataFrame, path: str | None = None, size: int = ROW, end_id: int = 49407,
                pad_id: int = 49407, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Packed rows: block, row, n_tokens, ids (``size`` little-endian ids, 16
    bits if the vocabulary allows, else 32; padded with ``pad_id`` after
    n_tokens), cu_seqlens (0, ..., n_tokens), position_ids (``size``
    little-endian numbers, 0 again at every segment and in the padding),
    doc_ids and starts of the segments.

    Needs ``doc_id`` and ``text``; other columns are not read. A null or empty
    text is the end id alone. Documents longer than a row are cut into full
    rows and a rest; ``starts`` puts them together again, so nothing is lost.
    Repeated rows and null doc_ids are packed like others. The number of blocks
    follows the bytes of text and the number of rows, pieces are dealt to blocks by a hash of their
    place, and ids are shuffled once. An empty table gives an empty result.
    """
    path = path or vocabulary()
    kind = "<u2" if len(encoder(path).token) <= 1 << 16 else "<u4"
    end = end_id.to_bytes(4, "little")
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(PIECE_BYTES))).first()[0] or 0
    blocks = total // block_bytes + 1
    short, long_ = split_by_length(docs)
    short = short.withColumn("row_key", F.monotonically_increasing_id())
    pieces = (short.mapInArrow(_text_task(path, size, end, kind), _PIECES_DDL)
              .unionByName(long_text_ids(long_, path, LEAF).mapInArrow(_ids_task(size, end, kind), _PIECES_DDL)))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "row_key", "start"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(_pack_task(size, kind, pad_id), _ROWS_DDL)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, in block and row order within the files."""
    rows.repartition("block").sortWithinPartitions("block", "row").write.parquet(path)
