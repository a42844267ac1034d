"""Connected components of a link table, and verified links inside buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, released, released_group
from ledgerlens.plans.runtime import reliable_checkpoint

BLOCK = 1024            # rows of a block in the closing comparison
COLUMNS = 4096          # distinct hashes that a block counts at a time
ONE_TASK = 1 << 20      # links that one task joins by union-find


def _ends(edges: DataFrame) -> tuple[int, bool, int]:
    """Number of links (u, v), whether they are stars (no node is a u twice,
    and none is both a u and a v), and the links of the busiest node."""
    sides = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    found = sides.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("only"), F.count("up").alias("n")).agg(
        F.sum("up"), F.max((F.col("up") > F.col("only")).cast("int")), F.max("n")).first()
    return found[0] or 0, not found[1], found[2] or 0


def smallest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links (a, b), all at once: the nodes, and the smallest
    node that each reaches. Roots are hung under smaller roots, then all paths
    are halved until they end in a root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    a, b = (np.concatenate([np.asarray(h.column(c)) for h in held]) if held else np.zeros(0, np.int64) for c in ("u", "v"))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in smallest_labels(a, b)], names=["node", "comp"])


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest
    node of its component. Alternating large-star and small-star steps; a
    node's links are only ever aggregated or joined with one row, so a hub
    does not gather in a task. As soon as no more than ONE_TASK links are left
    one task finishes them by union-find: the same result without the further
    steps. An empty table gives an empty one."""
    edges = reliable_checkpoint(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return reliable_checkpoint(edges.coalesce(1).mapInArrow(released(_finish), "node long, comp long"))
    n, done, most = _ends(edges)
    while not done:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = reliable_checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"),
                                                        F.count(F.lit(1)).alias("n")))
        large = reliable_checkpoint(
            attach(both.where("v > u"), low, ["u"], "n", 2 * n, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = attach(large, low, ["u"], "n", n, most).where("v <> m").select(
            F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = reliable_checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        n, done, most = _ends(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def linked_components(rows: DataFrame, sets: DataFrame, percent: int, fits: Callable,
                      verify: Callable[[DataFrame], DataFrame], rounds: int, as_pairs: bool) -> DataFrame:
    """Components of the nodes that share a bucket and are verified to link.

    ``rows``: (bucket, node, size, pos, rank), ``sets``: (node, hashes), both
    checkpoints. Two nodes link when the Jaccard similarity of their sets is
    ``percent`` or more. ``fits(a, b)`` gives a cheap necessary condition on the
    struct columns of two rows of a bucket; ``verify`` takes distinct pairs
    (a, b) and returns those that link. ``as_pairs`` says that ``fits`` leaves
    few pairs of a bucket, so that what the rounds leave is compared as pairs.

    Only components are asked for, so pairs known to be connected are not
    compared: in each of the first ``rounds`` every bucket's foremost node (by
    ``rank``) is compared with the others and then leaves the bucket; buckets
    of nodes that are connected by the links found so far, in whatever bucket,
    are done. What is left is compared in full, in blocks of bucket rows: as distinct fitting pairs
    (``as_pairs``), or in blocks that carry their sets and count intersections
    at once. No link between two components is lost.
    """
    links = checked = None
    rows = rows.withColumn("comp", F.col("node"))
    turn = 0
    while True:
        total = rows.count()
        stats = reliable_checkpoint(rows.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.max_by(F.struct("node", "size", "pos", "comp"), F.struct("rank", "node")).alias("p"))
            .where("lo <> hi").drop("lo", "hi"))
        most = stats.agg(F.max("n")).first()[0]
        if most is None:
            break
        met = attach(rows, stats, ["bucket"], "n", total, most)
        closing = turn == rounds
        if closing and not as_pairs:
            found = reliable_checkpoint(_block_links(met, sets, total, percent))
            links = found if links is None else links.unionByName(found)
            break
        if closing:
            pairs = _bucket_pairs(met, fits)
        else:
            pairs = met.where((F.col("comp") != F.col("p.comp")) & fits(F.struct("node", "size", "pos"), F.col("p")))
            pairs = pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))
        pairs = pairs.distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = reliable_checkpoint(pairs)
        found = reliable_checkpoint(verify(pairs))
        links = found if links is None else links.unionByName(found)
        if closing:
            break
        checked = pairs if checked is None else checked.unionByName(pairs)
        labels = components(links)      # of all links so far, also those of other buckets
        rows = attach(rows, stats, ["bucket"], "n", total, most).where("node <> p.node").drop("n", "p", "comp")
        rows = reliable_checkpoint(rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        turn += 1
    if links is None:
        return rows.sparkSession.createDataFrame([], "node long, comp long")
    return components(links)


def _blocks(met: DataFrame) -> DataFrame:
    """Rows of a bucket of n, dealt to blocks of about BLOCK, each once for
    every block it meets: keys bucket, i <= j, and the row's own block."""
    met = met.withColumn("_of", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("_of")).cast("int"))
    met = met.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    return met.withColumn("i", F.least("own", "_with")).withColumn("j", F.greatest("own", "_with"))


def _bucket_pairs(met: DataFrame, fits: Callable) -> DataFrame:
    """Fitting pairs of rows of a bucket in different components, block by block."""
    here = _blocks(met).select("bucket", "i", "j", "own", F.struct("node", "size", "pos").alias("x"), "comp")
    keys = ["bucket", "i", "j"]
    left = here.where("own = i").select(*keys, F.col("x").alias("xa"), F.col("comp").alias("ca"))
    right = here.where("own = j").select(*keys, F.col("x").alias("xb"), F.col("comp").alias("cb"))
    pairs = left.join(right, keys).where(
        (F.col("ca") != F.col("cb")) & ((F.col("i") != F.col("j")) | (F.col("xa.node") < F.col("xb.node"))))
    return pairs.where(fits(F.col("xa"), F.col("xb"))).select(
        F.least("xa.node", "xb.node").alias("a"), F.greatest("xa.node", "xb.node").alias("b"))


def _block_links(met: DataFrame, sets: DataFrame, total: int, percent: int) -> DataFrame:
    """Links between rows of a bucket in different components, enough to
    connect what is linked: blocks with their sets meet each other."""
    met = met.select("bucket", "node", "comp", "n")
    uses = reliable_checkpoint(met.groupBy("node").agg(F.count(F.lit(1)).alias("_uses")))
    met = attach(met, sets.select("node", "hashes").join(uses, "node"), ["node"], "_uses", total)
    keyed = _blocks(met).select("bucket", "i", "j", "own", "node", "comp", "hashes")
    return keyed.groupBy("bucket", "i", "j").applyInArrow(released_group(_link_block(percent)), "a long, b long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays: products
    of 0/1 matrices, some columns at a time (exact in 32-bit floats)."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    many = times[column] > 1
    owner, column = owner[many], np.unique(column[many], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[owner[a:b], column[a:b] - at] = 1
        out += grid @ grid.T
    return out.astype(np.int64)


def _link_block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        node, comp, own = (table[c].to_numpy() for c in ("node", "comp", "own"))
        sets = [np.frombuffer(b, np.uint64) for b in table["hashes"].to_pylist()]
        size = np.asarray([len(x) for x in sets])
        both = intersections(sets)
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        linked &= (comp[:, None] != comp[None, :]) & (both > 0)
        if table["i"][0].as_py() != table["j"][0].as_py():
            linked &= own[:, None] != own[None, :]
        # labels: each node takes the smallest place it is linked to, over and over
        label = np.arange(len(node))
        while True:
            new = np.minimum(label, np.where(linked, label[None, :], len(node)).min(axis=1, initial=len(node)))
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(node))
        return pa.table({"a": pa.array(node[moved]), "b": pa.array(node[label[moved]])})
    return run
