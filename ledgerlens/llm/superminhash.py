"""Near-duplicate groups from SuperMinHash signatures.

A SuperMinHash signature of m entries comes from one random permutation of
0..m-1 per shingle, drawn step by step: step i sends the value i + r (r
uniform in [0, 1)) to the entry that the permutation has at place i, and each
entry keeps its least value. All entries of a shingle are ranks of the same
permutation, so their errors are negatively correlated and the estimate varies
less than with independent hashes. Once a signature's largest entry is under
i + 1 no later step can change it: most documents stop after two or three of m
steps.

Signatures are cut into bands; documents of equal sets are one class before
that, classes that share a band are compared on their full sets, and the
verified links are grouped: union-find inside every task, then star steps
across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import jaccard, shared
from ledgerlens.llm.common import (attach, discard, distinct_in_row, mix64, shingle_hashes, stored, text_slices,
                                   word_hashes, word_lists)
from ledgerlens.llm.components import components, smallest_labels
from ledgerlens.llm.jaccard import verifier
from ledgerlens.plans.runtime import reliable_checkpoint, shuffle_partitions

WIDTH = 2
PERCENT = 80
SIGNATURE = 96          # entries
BAND = 4                # entries of a band: at 0.8 a pair shares none of 24 bands with probability 3e-6
SLICE = 4 << 20         # bytes of text that a task hashes at a time
BROADCAST_BYTES = 8 << 20
ROUNDS = 1              # of pivots, before what is left is compared
BLOCK = 1024            # rows of a block of that comparison
FOREST = 1 << 20        # links that a task's union-find holds at a time

_FRACTION = np.uint64(40)       # bits of r under the step number


def signatures(rows: np.ndarray, hashes: np.ndarray, n_rows: int, m: int = SIGNATURE) -> np.ndarray:
    """(n_rows, m) signatures of rows given as (row, element hash); repeated
    elements change nothing. Steps run over all elements at once: the content
    of a place of an element's permutation is traced back through its earlier
    swaps, so no permutation is held. A row without elements stays at the
    largest value."""
    out = np.full(n_rows * m, np.iinfo(np.uint64).max, np.uint64)
    swaps: list[np.ndarray] = []
    for i in range(m):
        if not len(rows):
            break
        x = mix64(hashes + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = (((x & np.uint64(0xFFFFFF)) * np.uint64(m - i)) >> np.uint64(24)).astype(np.int16) + np.int16(i)
        entry = k.copy()
        for t in range(i - 1, -1, -1):
            entry[entry == swaps[t]] = t
        np.minimum.at(out, rows * m + entry, (np.uint64(i) << _FRACTION) | (x >> np.uint64(24)))
        worst = out.reshape(n_rows, m).max(axis=1)
        going = (worst >= np.uint64(i + 1) << _FRACTION)[rows]
        swaps.append(k)
        if not going.all():
            rows, hashes, swaps = rows[going], hashes[going], [s[going] for s in swaps]
    return out.reshape(n_rows, m)


def band_keys(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """(rows, bands) 64-bit keys of consecutive groups of ``band`` entries."""
    n, m = signature.shape
    out = np.broadcast_to(np.arange(1, m // band + 1, dtype=np.uint64), (n, m // band)).copy()
    for k in range(band):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + signature[:, k:m // band * band:band])
    return out


def sets_of(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each text's distinct shingles; A-Z are lower-cased."""
    rows, words = word_lists(text, lower=True)
    return distinct_in_row(*shingle_hashes(rows, word_hashes(words), width))


_SIGNED = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()),
                     ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SIGNED_DDL = "row_key long, doc_id long, n long, d1 long, d2 long, bands array<long>"


def _sign(width: int, m: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            count = part.num_rows
            rows, hashes = sets_of(part.column("text"), width)
            digests = []
            for salt in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15):     # sums over the set: equal for equal sets
                total = np.zeros(count, np.uint64)
                np.add.at(total, rows, mix64(hashes ^ np.uint64(salt)))
                digests.append(pa.array(total.view(np.int64)))
            keys = band_keys(signatures(rows, hashes, count, m), band)
            ends = np.arange(0, keys.size + 1, max(keys.shape[1], 1), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("row_key"), part.column("doc_id"), pa.array(np.bincount(rows, minlength=count)), *digests,
                 pa.ListArray.from_arrays(ends, keys.view(np.int64).ravel())], schema=_SIGNED)
    return run


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            rows, hashes = sets_of(part.column("text"), width)
            ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
            blobs = [hashes[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("row_key"), pa.array(blobs, pa.binary())],
                                             names=["node", "hashes"])
    return run


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links (a, b): every node that is not its tree's root, and the root (its smallest node)."""
    nodes, root = smallest_labels(a, b)
    inner = nodes != root
    return nodes[inner], root[inner]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task, some at a time, cut to the links of spanning trees."""
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("a", "b"))
        node, root = spanning_forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= FOREST:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def union_find(links: DataFrame) -> DataFrame:
    """(node, comp) of a link table: links that close a cycle inside a task go
    first, what is left is joined across tasks by star steps."""
    return components(links.mapInArrow(_forest, "a long, b long"))


def _similar_sizes(percent: int, x: Column, y: Column) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with comp replaced by its new component (old, new)."""
    merged = merged.select(F.col("node").alias("comp"), F.col("comp").alias("_new"))
    if 16 * merged.count() <= BROADCAST_BYTES:
        merged = F.broadcast(merged)
    return rows.join(merged, "comp", "left").withColumn("comp", F.coalesce("_new", "comp")).drop("_new")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linking ones of distinct pairs (node, other), as (a, b). While the
    pairs are few the sets of the nodes are read where they lie and only those
    that pairs ask for move, once a pair, to the sets of the others."""
    n = pairs.count()
    if 16 * n > BROADCAST_BYTES:
        return verifier(sets, percent)(pairs.select(F.col("node").alias("a"), F.col("other").alias("b")))
    uses = reliable_checkpoint(pairs.groupBy("other").agg(F.count(F.lit(1)).alias("_uses")))
    left = sets.select("node", F.col("hashes").alias("ha")).join(F.broadcast(pairs.select("node", "other")), "node")
    right = sets.select(F.col("node").alias("other"), F.col("hashes").alias("hb")).join(F.broadcast(uses), "other")
    met = attach(left, right, ["other"], "_uses", max(n, 1))
    return met.select(F.col("node").alias("a"), F.col("other").alias("b"), "ha", "hb").mapInArrow(
        jaccard._verify(percent), "a long, b long")


def grouped_nodes(rows: DataFrame, sets: DataFrame, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, comp) of the nodes that share a bucket and are verified to link.

    ``rows``: (bucket, node, size, rank), ``sets``: (node, hashes), both
    checkpoints. Only components are asked for, so nodes known to be connected
    are not compared. A round takes the foremost node (by ``rank``) of each
    bucket's largest component, compares it with the bucket's nodes of other
    components, and joins the components of all links found (union-find), also
    those found in other buckets. The foremost node then has met all it could
    and leaves the bucket; a bucket of one component is done.

    What the rounds leave are nodes that are near a family but not near enough
    to its foremost nodes. Most of their pairs would fail, so buckets give way
    to an exact filter: the shingles of the nodes left are counted, and nodes
    of different components are compared only where they share a shingle of
    their rare-first prefixes at places that leave room for the wanted
    intersection. No link between two components is lost.
    """
    rows = rows.withColumn("comp", F.col("node"))
    links = checked = held = None
    total, spark, paths = rows.count(), rows.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        table, path = stored(df, name)
        paths.append(path)
        return table

    for turn in range(rounds + 1):
        per = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(
            "rank", "node", "size")).alias("p"))
        stats = keep(per.groupBy("bucket").agg(
            F.sum("n").alias("w"), F.count(F.lit(1)).alias("_comps"),
            F.max(F.struct("n", "p", "comp")).alias("best")).where("_comps > 1").select(
            "bucket", "w", F.col("best.p.node").alias("pivot"), F.col("best.p.size").alias("pivot_size"),
            F.col("best.comp").alias("pivot_comp")), "buckets")
        most = stats.agg(F.max("w")).first()[0]
        if most is None:
            break
        closing = turn == rounds
        met = attach(rows, stats, ["bucket"], "w", total, most)
        if not closing:
            pairs = met.where((F.col("comp") != F.col("pivot_comp")) & _similar_sizes(percent, F.col("size"), F.col("pivot_size")))
            pairs = pairs.select("node", F.col("pivot").alias("other"), "comp", F.col("pivot_comp").alias("other_comp"))
        else:
            nodes = keep(met.select("node", "comp").distinct(), "nodes")
            own = keep(sets.join(nodes, "node"), "sets")
            near = _prefix_rows(own.select("node", "hashes"), percent).join(nodes, "node")
            near = keep(near.select(F.explode(F.arrays_zip("prefix", "places")).alias("p"), "node", "size", "comp")
                        .select(F.col("p.prefix").alias("bucket"), "node", "size", F.col("p.places").alias("pos"), "comp"), "prefixes")
            shared_ = keep(near.groupBy("bucket").agg(F.count(F.lit(1)).alias("w"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                           .where("lo <> hi").drop("lo", "hi"), "shingles")
            pairs = _all_pairs(attach(near, shared_, ["bucket"], "w", max(near.count(), 1)), percent)
        pairs = pairs.distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["node", "other"], "left_anti")
        pairs = keep(pairs, "pairs")
        found = keep(_verified(pairs, sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        if closing:
            break
        both = pairs.select("node", "other").unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other")))
        checked = both if checked is None else checked.unionByName(both)
        merged = found.join(pairs.select(F.col("node").alias("a"), F.col("other").alias("b"), "comp", "other_comp"), ["a", "b"])
        merged = union_find(merged.select(F.col("comp").alias("a"), F.col("other_comp").alias("b")).distinct())
        rows, path = stored(_relabelled(met.where("node <> pivot").select("bucket", "node", "size", "rank", "comp"), merged),
                            "rows")
        if held:
            discard(spark, held)
        held = path
    out = union_find(links) if links is not None else spark.createDataFrame([], "node long, comp long")
    discard(spark, *paths, *([held] if held else []))
    return out


def _scatter_sets(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of a slice of nodes as messages to the hash partitions."""
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("hashes")).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts[:-1], cuts[1:]):
                sets = [np.frombuffer(b, np.uint64) for b in batch.column("hashes").slice(at, end - at).to_pylist()]
                if not sets:
                    continue
                head = np.zeros(len(sets), jaccard._HEAD)
                head["row_key"] = batch.column("node").slice(at, end - at).to_numpy(zero_copy_only=False)
                head["n"] = [len(x) for x in sets]
                yield from shared.scatter(int(head["row_key"][0]), len(sets), np.repeat(np.arange(len(sets)), head["n"]),
                                          np.concatenate(sets), parts, True, head.tobytes())
    return run


def _prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(node, size, prefix, places) of a table of sets: the shingles of a set
    in the order of their counts among these sets, and those of the prefix that
    another set has with their places. A set that shares under ``percent`` of
    its shingles can link with none and is left out."""
    parts = shuffle_partitions(sets.sparkSession)
    counted = shared.count_hashes(sets.mapInArrow(_scatter_sets(parts), shared.MESSAGE_DDL), parts)
    return counted.groupBy("slice").applyInArrow(jaccard._order_sets(percent), jaccard._SETS_DDL).select(
        "node", "size", "prefix", "places")


def _all_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's nodes in different components whose sizes and places
    allow a link, block by block. Rows: (bucket, node, size, pos, comp, w)."""
    met = met.withColumn("_of", F.ceil(F.col("w") / F.lit(BLOCK)).cast("int"))
    met = met.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_of")).cast("int"))
    met = met.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    here = met.select("bucket", F.least("_own", "_with").alias("i"), F.greatest("_own", "_with").alias("j"), "_own",
                      F.struct("node", "size", "pos", "comp").alias("x"))
    keys = ["bucket", "i", "j"]
    x = here.where("_own = i").select(*keys, "x")
    y = here.where("_own = j").select(*keys, F.col("x").alias("y"))
    fits = jaccard.fits(percent)
    pairs = x.join(y, keys).where(((F.col("i") != F.col("j")) | (F.col("x.node") < F.col("y.node")))
                                  & (F.col("x.comp") != F.col("y.comp")) & fits(F.col("x"), F.col("y")))
    return pairs.select(F.least("x.node", "y.node").alias("node"), F.greatest("x.node", "y.node").alias("other"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, m: int = SIGNATURE,
                    band: int = BAND) -> DataFrame:
    """One row per document: (row_key, doc_id, n_shingles, component_id, component_key).

    Needs ``doc_id`` and ``text``; other columns are not read. A document's set
    are the distinct ``width``-word shingles of its whole text, A-Z lower-cased
    (fewer words: the whole sequence is the one shingle). Two documents link
    when 100 |A and B| >= percent |A or B|, checked on the full sets; a pair of
    exactly that similarity is a candidate but with probability
    (1 - (percent/100)^band)^(m/band). component_id is the smallest doc_id
    reachable by links. A null, empty or blank text has no shingle and links
    with nothing. Repeated rows and equal sets are one class. A row with a null
    doc_id is linked like others and never names a component that has a doc_id.
    Long texts are hashed whole, one at a time if need be. An empty table gives
    an empty result. ``row_key`` is the row's place in the scan of ``docs``;
    ``component_key``, the row_key of one of the component's rows, tells
    components apart where doc_ids do not.
    """
    scan = docs.select(F.monotonically_increasing_id().alias("row_key"), docs["doc_id"].cast("long").alias("doc_id"),
                       docs["text"].alias("text"))
    signed = reliable_checkpoint(scan.mapInArrow(_sign(width, m, band), _SIGNED_DDL))
    same = ["n", "d1", "d2"]
    live = signed.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "bands"))
    classes = reliable_checkpoint(live.groupBy(*same).agg(first.alias("_f"), F.count(F.lit(1)).alias("copies"))
                                  .select(*same, "copies", F.col("_f.row_key").alias("node"),
                                          F.col("_f.doc_id").alias("first_id"), F.col("_f.bands").alias("bands")))
    n_classes = classes.count()

    banded = classes.select(F.explode("bands").alias("bucket"), "node", F.col("n").alias("size"))
    shared = reliable_checkpoint(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_w")).where("_w > 1"))
    rows = reliable_checkpoint(attach(banded, shared, ["bucket"], "_w", max(n_classes * (m // band), 1)).drop("_w"))
    # the node that meets others in the most bands is its buckets' foremost one
    nodes = reliable_checkpoint(rows.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("rank")))
    rows = reliable_checkpoint(rows.join(nodes, "node"))
    wanted = nodes.select(F.col("node").alias("row_key"))
    if 8 * nodes.count() <= BROADCAST_BYTES:        # else the texts are shuffled to the list
        wanted = F.broadcast(wanted)
    sets = reliable_checkpoint(scan.join(wanted, "row_key", "left_semi").mapInArrow(
        _set_rows(width), "node long, hashes binary"))
    labels = grouped_nodes(rows, sets, percent)

    named = classes.drop("bands").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = reliable_checkpoint(named)
    names = reliable_checkpoint(named.groupBy("comp").agg(F.min("first_id").alias("component_id"),
                                                          F.count(F.lit(1)).alias("n_classes")))
    named = reliable_checkpoint(attach(named, names, ["comp"], "n_classes", max(n_classes, 1)))
    members = attach(live.select("row_key", *same), named.select(*same, "copies", "component_id", "comp"), same,
                     "copies", max(live.count(), 1)).select("row_key", "component_id", "comp")
    return signed.join(members, "row_key", "left").select(
        "row_key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("comp", "row_key").alias("component_key"))
