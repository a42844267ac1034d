"""N-gram Jaccard self-join with rare-first prefix filtering.

1. Every shingle is counted over all documents (packed hashes, one shuffle). A
   link needs 80 % of a document's shingles in common, so documents that have
   fewer shared ones can have no partner and are done.
2. Documents of equal shingle sets become one class.
3. The shingles of the remaining classes are counted again and each class's
   set is ordered rare-first. Two classes that link share a shingle of their
   prefixes; prefix shingles that occur once are not sent.
4. Prefix rows meet on the shingle. The length and positional filters act in
   the join, the suffix filter and the exact intersection once per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common, shared
from ledgerlens.llm.common import (attach, distinct_in_row, mix64, released, released_group, shingle_hashes, text_slices,
                                   word_hashes, word_lists)
from ledgerlens.llm.components import linked_components
from ledgerlens.plans.runtime import reliable_checkpoint, shuffle_partitions

WIDTH = 5
PERCENT = 80
SLICE = 8 << 20
BROADCAST_BYTES = 8 << 20
SUFFIX_DEPTH = 3
PIVOT_ROUNDS = 2


def shingle_sets(text: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text; A-Z are lower-cased."""
    rows, words = word_lists(text, lower=True)
    return distinct_in_row(*shingle_hashes(rows, word_hashes(words), width))


def _digests(rows: np.ndarray, hashes: np.ndarray, m: int) -> list[np.ndarray]:
    """Two 64-bit sums over each row's set: equal for equal sets."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15):
        total = np.zeros(m, np.uint64)
        np.add.at(total, rows, mix64(hashes ^ np.uint64(salt)))
        out.append(total.astype(np.int64))
    return out


_HEAD = np.dtype([("row_key", "<i8"), ("doc_id", "<i8"), ("null", "u1"), ("n", "<i8"), ("d1", "<i8"), ("d2", "<i8")])


def _send(parts: int, width: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            m = part.num_rows
            rows, hashes = shingle_sets(part.column("text"), width)
            head = np.zeros(m, _HEAD)
            head["row_key"] = part.column("row_key").to_numpy(zero_copy_only=False)
            ids = part.column("doc_id")
            head["null"] = ids.is_null().to_numpy(zero_copy_only=False)
            head["doc_id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            head["n"] = np.bincount(rows, minlength=m)
            head["d1"], head["d2"] = _digests(rows, hashes, m)
            yield from shared.scatter(shared.slice_key(part), m, rows, hashes, parts, wide, head.tobytes())
    return run


_DOCS = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()),
                   ("d2", pa.int64()), ("n_shared", pa.int64())])
_DOCS_DDL = "row_key long, doc_id long, n long, d1 long, d2 long, n_shared long"


def _per_doc(table: pa.Table) -> pa.Table:
    head = np.frombuffer(shared.header_of(table), _HEAD)
    total = shared.per_row_total(table, len(head))
    ids = pa.array(head["doc_id"], mask=head["null"].astype(bool))
    return pa.table([pa.array(head["row_key"]), ids, pa.array(head["n"]), pa.array(head["d1"]), pa.array(head["d2"]),
                     pa.array(total)], schema=_DOCS)


_SETS = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("rank", pa.float64()), ("hashes", pa.binary()),
                   ("prefix", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])
_SETS_DDL = "node long, size long, rank double, hashes binary, prefix array<long>, places array<int>"


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """n - ceil(percent n / 100) + 1: sets that link share one of so many first shingles."""
    return n - -(-percent * n // 100) + 1


def _order_sets(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """A slice's sets, rare shingles first (ties by hash), with the prefix
        shingles that other sets have, too. Sets with too few shared ones go."""
        head = np.frombuffer(shared.header_of(table), _HEAD)
        rows, hashes, df = [], [], []
        for part, counts, blob in zip(*(table[c].to_pylist() for c in ("part", "counts", "hashes"))):
            if part >= 0:
                c = np.frombuffer(counts, "<u4")
                k = int(c.sum())
                rows.append(np.repeat(np.arange(len(head)), c))
                hashes.append(np.frombuffer(blob, np.uint64, k))
                df.append(np.frombuffer(blob, "<u4", k, 8 * k))
        out: list[tuple] = []
        if rows:
            rows, hashes, df = map(np.concatenate, (rows, hashes, df))
            order = np.lexsort((hashes, df, rows))
            rows, hashes, df = rows[order], hashes[order], df[order]
            ends = np.searchsorted(rows, np.arange(len(head) + 1))
            for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                n = b - a
                if not n or 100 * int((df[a:b] > 1).sum()) < percent * n:
                    continue
                p = prefix_length(n, percent)
                at = np.flatnonzero(df[a:a + p] > 1)
                centre = float(np.log2(df[a:b]).mean())
                out.append((int(head["row_key"][k]), n, centre, hashes[a:b].tobytes(),
                            hashes[a:a + p][at].view(np.int64), at.astype(np.int32)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _SETS)] if out
                        else [pa.array([], f.type) for f in _SETS], schema=_SETS)
    return run


def need(a: Column, b: Column, percent: int) -> Column:
    """Least intersection at which sets of a and b elements link."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent))


def fits(percent: int):
    def cond(x: Column, y: Column) -> Column:
        """Length filter, and positional filter: after a first common shingle
        at these places at most so many more can follow."""
        a, b = x["size"], y["size"]
        rest = F.least(a - x["pos"], b - y["pos"])
        return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (rest >= need(a, b, percent))
    return cond


def _hamming(x: np.ndarray, y: np.ndarray, limit: int, depth: int) -> int:
    """Lower bound on how many elements two sorted suffixes differ in, by
    splitting both at a middle element; over ``limit``: it stops."""
    gap = abs(len(x) - len(y))
    if depth == 0 or gap > limit or not len(x) or not len(y):
        return gap
    pivot = y[len(y) // 2]
    i, j = np.searchsorted(x, pivot), len(y) // 2
    has = int(i < len(x) and x[i] == pivot)
    low = abs(int(i) - j) + abs((len(x) - int(i) - has) - (len(y) - j - 1)) + (1 - has)
    if low > limit:
        return low
    left = _hamming(x[:i], y[:j], limit, depth - 1)
    return left + _hamming(x[i + has:], y[j + 1:], limit - left, depth - 1) + (1 - has)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ok = [], [], []
            for u, v, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ha", "hb"))):
                x, y = np.sort(np.frombuffer(x, np.uint64)), np.sort(np.frombuffer(y, np.uint64))
                least = -(-percent * (len(x) + len(y)) // (100 + percent))
                limit = len(x) + len(y) - 2 * least
                if _hamming(x, y, limit, SUFFIX_DEPTH) <= limit:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        a.append(u)
                        b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def verifier(sets: DataFrame, percent: int):
    """Exact check of pairs against a table (node, hashes)."""
    def verify(pairs: DataFrame) -> DataFrame:
        out, n = pairs, pairs.count()
        for end, name in (("a", "ha"), ("b", "hb")):
            own = sets.select(F.col("node").alias(end), F.col("hashes").alias(name))
            if n <= common.HOT_LEAST:       # no node can be in many pairs
                out = out.join(own, end)
                continue
            uses = reliable_checkpoint(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("_uses")))
            out = attach(out, own.join(uses, end), [end], "_uses", n).drop("_uses")
        return out.mapInArrow(released(_verify(percent)), "a long, b long")
    return verify


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: (row_key, doc_id, n_shingles, component_id, component_key).

    Needs ``doc_id`` and ``text``; other columns are not read. Two documents
    link when 100 |A and B| >= percent |A or B| for their sets of distinct
    ``width``-word shingles (A-Z lower-cased; fewer words: the whole sequence
    is the one shingle). component_id is the smallest doc_id reachable by
    links. A null, empty or blank text has no shingle and links with nothing;
    a row with a null doc_id is linked like others and never names a component
    that has a doc_id. Repeated rows are one class. An empty table gives an
    empty result. ``row_key`` is the row's place in the scan of ``docs``, and
    ``component_key`` the row_key of one of the component's rows: it tells
    components apart, which a doc_id (null or of several rows) does not.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    scan = docs.select(F.monotonically_increasing_id().alias("row_key"),
                       docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    sent = scan.mapInArrow(released(_send(parts, width, False)), shared.MESSAGE_DDL)
    table = reliable_checkpoint(shared.count_shared(sent).groupBy("slice").applyInArrow(released_group(_per_doc), _DOCS_DDL))

    live = table.where((F.col("n") > 0) & (100 * F.col("n_shared") >= percent * F.col("n")))
    same = ["n", "d1", "d2"]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    classes = reliable_checkpoint(live.groupBy(*same).agg(first.alias("_f"), F.count(F.lit(1)).alias("copies"))
                                  .select(*same, "copies", F.col("_f.row_key").alias("node"),
                                          F.col("_f.doc_id").alias("first_id")))
    n_classes = classes.count()

    nodes = classes.select(F.col("node").alias("row_key"))
    if 8 * n_classes <= BROADCAST_BYTES:        # else the texts are shuffled to the list
        nodes = F.broadcast(nodes)
    again = scan.join(nodes, "row_key", "left_semi").mapInArrow(released(_send(parts, width, True)), shared.MESSAGE_DDL)
    sets = reliable_checkpoint(shared.count_hashes(again, parts).groupBy("slice")
                               .applyInArrow(released_group(_order_sets(percent)), _SETS_DDL))
    rows = reliable_checkpoint(
        sets.select("node", "size", "rank", F.explode(F.arrays_zip("prefix", "places")).alias("p"))
        .select(F.col("p.prefix").alias("bucket"), "node", "size", F.col("p.places").alias("pos"), "rank"))
    labels = linked_components(rows, sets, percent, fits(percent), verifier(sets, percent), PIVOT_ROUNDS, True)

    named = classes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = reliable_checkpoint(named)
    names = named.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n_classes"))
    names = reliable_checkpoint(names)
    named = reliable_checkpoint(attach(named, names, ["comp"], "n_classes", max(n_classes, 1)))
    n_live = live.count()
    members = attach(live.select("row_key", *same), named.select(*same, "copies", "component_id", "comp"), same,
                     "copies", max(n_live, 1)).select("row_key", "component_id", "comp")
    return table.join(members, "row_key", "left").select(
        "row_key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("comp", "row_key").alias("component_key"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` of which each component's first (smallest doc_id,
    then first of the scan) stays, with all their columns."""
    found = reliable_checkpoint(jaccard_components(docs, width, percent))
    stays = found.where("n_shingles > 0").groupBy("component_key").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("_f"), F.count(F.lit(1)).alias("_n"))
    stays = reliable_checkpoint(stays.where("_n > 1"))
    gone = attach(found.where("n_shingles > 0"), stays, ["component_key"], "_n", max(found.count(), 1)).where(
        "row_key <> _f.row_key")
    key, = common.free_names(docs, "_ll_row")
    return (docs.withColumn(key, F.monotonically_increasing_id())
            .join(gone.select(F.col("row_key").alias(key)), key, "left_anti").drop(key))
