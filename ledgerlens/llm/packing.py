"""Shortest-pack-first histogram packing.

Documents become token ids (with an end id) and are cut into pieces no longer
than a sequence. The histogram of piece lengths, at most one entry per
possible length, is packed on the driver: lengths are placed longest first,
each into the pattern with the most room, and only counts of equal patterns
are kept. The pieces of a length are ranked by a distributed running count,
and rank ranges join every piece to its pattern, sequence and offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import LEAF, id_bytes, long_text_ids, split_by_length, vocabulary
from ledgerlens.llm.common import released, text_slices
from ledgerlens.operators.ranks import ordered_prefix
from ledgerlens.plans.runtime import reliable_checkpoint

SEQUENCE = 2048
END_ID = 1

PIECES = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PIECES_DDL = "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(doc, key, ids: bytes, size: int, out: list) -> None:
    n = len(ids) // 4
    for at in range(0, n, size):
        part = ids[4 * at:4 * (at + size)]
        out.append((doc, key, at, len(part) // 4, zlib.crc32(part), n))


def _batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)


def _text_task(path: str, size: int, end: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            out: list = []
            for doc, key, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row_key", "text"))):
                _cut(doc, key, id_bytes(text, path) + end, size, out)
            yield _batch(out)
    return run


def _ids_task(size: int, end: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (doc, ids) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist())):
                out: list = []
                _cut(doc, k, ids + end, size, out)
                yield _batch(out)
    return run


def token_pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document's ids: full sequences, then the rest."""
    end = end_id.to_bytes(4, "little")
    short, long_ = split_by_length(docs)
    short = short.withColumn("row_key", F.monotonically_increasing_id())
    return (short.mapInArrow(released(_text_task(path, size, end)), PIECES_DDL)
            .unionByName(long_text_ids(long_, path, LEAF).mapInArrow(released(_ids_task(size, end)), PIECES_DDL)))


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns and their counts for a histogram of lengths: a pattern is a
    list of (length, how many). Longest lengths first; each goes into the open
    pattern with the most room, as often as it fits there, else into new ones.
    Splitting a count makes at most one further pattern, so their number stays
    near the number of lengths."""
    room: dict[int, list[list]] = {}        # free tokens -> [pattern, count], newest last

    def put(pattern: list, free: int, count: int) -> None:
        if count:
            room.setdefault(free, []).append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = max((f for f, found in room.items() if found and f >= length), default=None)
            if free is None:
                each = size // length
                put([(length, each)], size - each * length, left // each)
                if left % each:
                    put([(length, left % each)], size - left % each * length, 1)
                break
            pattern, count = room[free].pop()
            each = min(free // length, max(1, -(-left // count)))
            used = min(count, left // each)
            if used:
                put([*pattern, (length, each)], free - each * length, used)
            put(pattern, free, count - used)
            left -= used * each
    return [(pattern, count) for found in room.values() for pattern, count in found]


def pattern_ranks(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, after the last rank, first sequence, pieces of the
    length in one sequence, offset of the first): the ranks of a length are
    dealt to the patterns one after the other."""
    ranks, out, sequence = {}, [], 0
    for pattern, count in patterns:
        at = 0
        for length, each in pattern:
            first = ranks.get(length, 0)
            ranks[length] = first + each * count
            out.append((length, first, ranks[length], sequence, each, at))
            at += each * length
        sequence += count
    return out


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (a checkpoint)."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()     # at most ``size`` rows
    table = pattern_ranks(shortest_pack_first({r["length"]: r["n"] for r in counts}, size))
    ranked = ordered_prefix(pieces, ["doc_id", "start", "row_key"], {"_rank": F.lit(1).cast("long")}, inclusive=False,
                            partition_by=["length"])
    # A list of rank ranges per length: its size depends on the number of lengths, not on the rows.
    schema = "length long, _from long, _to long, _seq long, _each long, _at long"
    ranges = spark.createDataFrame(table, schema).groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("_from", "_to", "_seq", "_each", "_at"))).alias("_ranges"))
    joined = ranked.join(F.broadcast(ranges), "length").withColumn(
        "_r", F.filter("_ranges", lambda r: (r["_from"] <= F.col("_rank")) & (F.col("_rank") < r["_to"]))[0])
    nth = F.col("_rank") - F.col("_r._from")
    return joined.select(*pieces.columns, (F.col("_r._seq") + F.floor(nth / F.col("_r._each"))).alias("sequence_id"),
                         (F.col("_r._at") + (nth % F.col("_r._each")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Needs ``doc_id`` and ``text``; other columns are not read. Null and empty
    texts are documents of the end id alone; null doc_ids and repeated rows are
    packed like others (ranked by doc_id, start, place in the scan); an empty
    table gives an empty result. Documents longer than a sequence are cut into
    full sequences and a rest. Sequences are filled from offset 0 without gaps.
    """
    pieces = reliable_checkpoint(token_pieces(docs, path or vocabulary(), size, end_id))
    return pack(pieces, size).drop("row_key")


def sequence_matrix(spark: SparkSession, packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, lengths): the pieces of each sequence in offset order."""
    items = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length")))
    return packed.groupBy("sequence_id").agg(items.alias("items")).select(
        "sequence_id", F.col("items.doc_id").alias("doc_ids"), F.col("items.length").alias("lengths"))
