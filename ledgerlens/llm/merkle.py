"""Merkle manifest of a documents table, as a persistent path-copying tree.

Version 0 of the tree holds, per source, the leaves by doc_id, nodes of
``ARITY`` children over them up to the source's subroot, and a tree of the
same kind over the subroots. Changing one leaf makes a version of its own: it
copies the leaf's ancestors and shares every other node with version 0.

The tree is built in aligned blocks of ARITY ** LEVELS nodes. A block is a
bounded group, hashed in one task over LEVELS levels; its root is a node of
the next, 4096 times smaller pass, until one node a source, then one in all,
is left. From there the upper paths (the siblings above each block) go down
again, one join a pass, and every block copies its versions' ancestors inside
the block and continues them along its upper path.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranks import ordered_prefix
from ledgerlens.plans.runtime import reliable_checkpoint

ARITY = 16
LEVELS = 3                  # of an aligned block: it has ARITY ** LEVELS leaves at most
GROUP = 2                   # full blocks that a group of rows has on average
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: dict[str, Column]) -> Column:
    """sha256 of the fields in order: ``-`` for null, else byte count, ``:``, value."""
    return F.sha2(F.concat(*[_field(fields[name]) for name in FIELDS]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_tampered(doc_id: Column) -> Column:
    """Where 5 divides the CRC-32 of the decimal doc_id; never for a null one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _groups(rows: int, width: int) -> int:
    return max(1, int(rows / (GROUP * width)))


def _bucket(groups: int, *keys: str) -> Column:
    """A group of whole blocks: hashed, so that many small trees share a group."""
    return F.pmod(F.xxhash64(*keys), F.lit(groups))


def join_run(run: list[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def fold_block(nodes: list[str], total: int, height: int) -> tuple[list[list[str]], str]:
    """The levels of one aligned block, its nodes first, and its root. ``total``
    is the number of nodes in the whole tree at the lowest level: a level that
    is one node is the top, so there it ends."""
    levels = [nodes]
    for _ in range(height):
        if total == 1:
            break
        levels.append([join_run(levels[-1][k:k + ARITY]) for k in range(0, len(levels[-1]), ARITY)])
        total = -(-total // ARITY)
    return levels, levels[-1][0]


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of a block's node and of its ancestors in their runs."""
    out = []
    for level in levels[:-1]:
        low = at - at % ARITY
        out.append(("".join(level[low:at]), "".join(level[at + 1:low + ARITY])))
        at //= ARITY
    return out


def copy_path(digest: str, path: list[tuple[str, str]]) -> list[str]:
    """The ancestors that a version with this node copies, lowest first."""
    out = []
    for left, right in path:
        digest = sha256((left + digest + right).encode()).hexdigest()
        out.append(digest)
    return out


_PATH = "array<struct<l:string,r:string>>"
_PATH_TYPE = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
_UP = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("path", _PATH_TYPE), ("up", pa.string()),
                 ("up_n", pa.int64())])
_UP_DDL = f"tree string, idx long, path {_PATH}, up string, up_n long"


def _by_block(table: pa.Table, width: int) -> Iterator[tuple[str, list[int], pa.Table]]:
    """The blocks of a group: tree, places in the block's order, and rows."""
    table = table.sort_by([("tree", "ascending"), ("idx", "ascending")])
    tree, idx = table["tree"].to_pylist(), table["idx"].to_pylist()
    at = 0
    for k in range(1, len(tree) + 1):
        if k == len(tree) or tree[k] != tree[at] or idx[k] // width != idx[at] // width:
            yield tree[at], idx[at:k], table.slice(at, k - at)
            at = k


def _up_total(total: int, height: int) -> int:
    for _ in range(height):
        total = -(-total // ARITY) if total > 1 else 1
    return total


def _paths_of(height: int):
    width = ARITY ** height

    def run(table: pa.Table) -> pa.Table:
        """Every node's siblings up to its block's root, and that root."""
        out: list[tuple] = []
        for tree, idx, rows in _by_block(table, width):
            total = rows["n"][0].as_py()
            levels, root = fold_block(rows["digest"].to_pylist(), total, height)
            up_n = _up_total(total, height)
            out += [(tree, i, [{"l": a, "r": b} for a, b in siblings(levels, i % width)], root, up_n) for i in idx]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _UP)], schema=_UP)
    return run


_ROOT = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])
_ROOT_DDL = "tree string, idx long, digest string, n long"


def _roots_of(height: int):
    width = ARITY ** height

    def run(table: pa.Table) -> pa.Table:
        """The root of each block: a node of the next pass."""
        out = []
        for tree, idx, rows in _by_block(table, width):
            total = rows["n"][0].as_py()
            root = fold_block(rows["digest"].to_pylist(), total, height)[1]
            out.append((tree, idx[0] // width, root, _up_total(total, height)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _ROOT)], schema=_ROOT)
    return run


def _passes(nodes: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """From nodes (tree, idx, digest, n) to one root a tree.

    Returns (tree, idx, path) with each given node's siblings on the whole way
    to its tree's root, lowest first, and the roots (tree, digest)."""
    width = ARITY ** height
    block = F.expr(f"idx div {width}")
    done, below = [], nodes
    while below.where("n > 1").head(1):
        below = below.withColumn("_b", block)
        below = below.withColumn("_g", _bucket(_groups(below.count(), width), "tree", "_b"))
        table = reliable_checkpoint(below.groupBy("_g").applyInArrow(_paths_of(height), _UP_DDL))
        done.append(table)
        below = table.where(F.col("idx") % width == 0).select(
            "tree", block.alias("idx"), F.col("up").alias("digest"), F.col("up_n").alias("n"))
    if not done:
        return nodes.select("tree", "idx", F.array().cast(_PATH).alias("path")), nodes.select("tree", "digest")
    path = done[-1].select("tree", "idx", "path")
    for table in reversed(done[:-1]):       # at most ``width`` nodes share an upper path
        above = path.select("tree", F.col("idx").alias("_b"), F.col("path").alias("_up"))
        path = table.withColumn("_b", block).join(above, ["tree", "_b"]).select(
            "tree", "idx", F.concat("path", "_up").alias("path"))
    return path, below.select("tree", "digest")


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, idx, n, digest, changed): every row's leaf with its place
    among the n of its source, and the leaf it has after tampering."""
    fields = {name: docs[name] for name in FIELDS}
    doc_id = docs["doc_id"].cast("long")
    tampered = fields | {"text": lower_ascii(docs["text"])}
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.concat(F.lit("+"), docs["source"].cast("string")), F.lit("")).alias("tree"),
                       leaf_hash(fields).alias("digest"),
                       F.when(is_tampered(doc_id), leaf_hash(tampered)).alias("changed"))
    rows = reliable_checkpoint(rows)        # the texts are hashed once
    return ordered_prefix(rows, ["tree", "doc_id", "digest", "changed"], {"idx": F.lit(1).cast("long")}, inclusive=False,
                          partition_by=["tree"], totals={"idx": "n"})


_DOC = pa.schema([("doc_id", pa.int64()), ("tree", pa.string()), ("idx", pa.int64()), ("leaf", pa.string()),
                  ("tampered", pa.bool_()), ("subroot", pa.string()), ("root", pa.string()),
                  ("proof_sha256", pa.string()), ("version", pa.list_(pa.string()))])
_DOC_DDL = ("doc_id long, tree string, idx long, leaf string, tampered boolean, subroot string, root string, "
            "proof_sha256 string, version array<string>")


def _versions(height: int):
    width = ARITY ** height

    def run(_key, rows: pa.Table, upper: pa.Table) -> pa.Table:
        """Path copies of every leaf of a group's blocks: inside the block,
        then on along the block's upper path."""
        above = {(t, i): (p, s, r) for t, i, p, s, r in zip(*(upper[c].to_pylist() for c in (
            "tree", "idx", "path", "subroot", "root")))}
        out: list[tuple] = []
        for tree, idx, block in _by_block(rows, width):
            path, subroot, root = above[tree, idx[0] // width]
            over = [(x["l"], x["r"]) for x in path]
            tail = "".join(a + b for a, b in over)
            digests = block["digest"].to_pylist()
            levels, _ = fold_block(digests, block["n"][0].as_py(), height)
            for i, doc_id, leaf, new in zip(idx, block["doc_id"].to_pylist(), digests, block["changed"].to_pylist()):
                own = siblings(levels, i % width)
                proof = sha256(("".join(a + b for a, b in own) + tail).encode()).hexdigest()
                first = leaf if new is None else new
                out.append((doc_id, tree, i, leaf, new is not None, subroot, root, proof,
                            [first, *copy_path(first, own + over)]))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _DOC)] if out
                        else [pa.array([], f.type) for f in _DOC], schema=_DOC)
    return run


def manifest(docs: DataFrame, height: int = LEVELS) -> DataFrame:
    """One row per document with its leaf, proof and version of the tree.

    Columns: doc_id, tree (``+`` and the source; empty for a null source),
    idx (the leaf's place in its source), leaf, tampered, subroot, root,
    proof_sha256, version. ``version`` holds the digests that the row's version
    of the tree owns, leaf to root; all its other nodes are those of version 0.
    For a row that was not tampered with it is the recomputed path of version 0.

    Needs the columns of ``documents``; others are not read. Nulls in any
    column are hashed as ``-``; an empty text as ``0:``; whole texts are
    hashed, however long. Leaves ascend by doc_id (null last), rows of one
    doc_id by their leaf, so repeated rows have places of their own and which
    of them has which does not matter. A row with a null doc_id is never
    tampered with. An empty table gives no row.
    """
    width = ARITY ** height
    rows = leaves(docs).withColumn("_b", F.expr(f"idx div {width}"))
    groups = _groups(docs.select(F.count(F.lit(1))).first()[0], width)
    rows = reliable_checkpoint(rows.withColumn("_g", _bucket(groups, "tree", "_b")))
    blocks = reliable_checkpoint(rows.select("_g", "tree", "idx", "digest", "n").groupBy("_g")
                                 .applyInArrow(_roots_of(height), _ROOT_DDL))
    path, subroots = _passes(blocks, height)
    subroots = reliable_checkpoint(subroots)
    n = subroots.count()
    ranked = ordered_prefix(subroots, ["tree"], {"idx": F.lit(1).cast("long")}, inclusive=False)
    ranked = reliable_checkpoint(ranked.withColumnRenamed("tree", "source_tree").select(
        "source_tree", F.lit("").alias("tree"), "idx", "digest", F.lit(n).cast("long").alias("n")))
    top, root = _passes(ranked.drop("source_tree"), height)
    ends = ranked.select(F.col("source_tree").alias("tree"), "idx", F.col("digest").alias("subroot")).join(
        top.select("idx", F.col("path").alias("_top")), "idx").drop("idx")
    ends = ends.crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))      # one row
    upper = path.join(ends, "tree").select(
        "tree", "idx", F.concat("path", "_top").alias("path"), "subroot", "root").withColumn(
        "_g", _bucket(groups, "tree", "idx"))
    return rows.groupBy("_g").cogroup(upper.groupBy("_g")).applyInArrow(_versions(height), _DOC_DDL)


def audit(found: DataFrame) -> DataFrame:
    """What a verifier sees of ``manifest``: the root folded from each row's
    present leaf, and whether it is the root of the manifest."""
    folded = F.element_at("version", -1)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"),
                        (folded == F.col("root")).alias("verified"))


def version_nodes(found: DataFrame) -> DataFrame:
    """Nodes that tampered versions copied: (doc_id, tree, idx, height,
    digest), height 0 the leaf. What a version does not list it shares."""
    return found.where("tampered").select("doc_id", "tree", "idx", F.posexplode("version").alias("height", "digest"))
