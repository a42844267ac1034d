"""Exact dedup by progressive refinement.

Texts are equal when they agree after white space is deleted. Rows are first
grouped by the length of that normal form, rows of a shared length by a hash
of its beginning, and only rows that still share both are hashed in full.
Every step groups small rows (ids, lengths, hashes); texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACE_CLASS, attach, free_names
from ledgerlens.plans.runtime import reliable_checkpoint

PREFIX = 256                    # characters of the normal form in the prefix hash
BROADCAST_BYTES = 32 << 20      # largest list of surviving rows that is broadcast


def normal_form(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", "")


def full_hash(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normal form."""
    return F.sha2(normal_form(text).cast("binary"), 256)


def _shared(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows whose key occurs more than once."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return attach(rows, sizes, keys, "_n", total).drop("_n")


def progressive_groups(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, row_key).

    Needs ``doc_id`` and ``text``; other columns are not read. A null text
    counts as empty; empty and blank texts are equal to each other. Of equal
    texts the row with the most code points stays, then the smallest doc_id (a
    null doc_id last), then, among repeated rows, the first of the scan.
    ``row_key`` is the row's place in the scan of ``docs``
    (``row_places``). An empty table gives an empty result. A key with very
    many rows is only counted and joined with its one result row.
    """
    rows = row_places(docs)
    norm = normal_form(F.col("text"))
    light = reliable_checkpoint(rows.select(
        "row_key", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("points"),
        F.octet_length(norm).alias("size"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix")))
    total = light.count()

    by_length = reliable_checkpoint(_shared(light, ["size"], total))
    by_prefix = reliable_checkpoint(_shared(by_length, ["size", "prefix"], total))
    n = by_prefix.count()

    # Full content is hashed for survivors only. Their list goes to the scan if it is small; beyond
    # that, hashing where the text lies and moving 32 bytes a row is less work than moving texts.
    texts = rows.select("row_key", "text")
    if 16 * n <= BROADCAST_BYTES:
        texts = texts.join(F.broadcast(by_prefix.select("row_key")), "row_key", "left_semi")
    hashed = texts.select("row_key", F.unhex(full_hash(F.col("text"))).alias("full"))
    members = reliable_checkpoint(by_prefix.join(hashed, "row_key"))

    first = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    groups = reliable_checkpoint(
        members.groupBy("size", "full")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("_best"))
        .where("group_size > 1"))
    copies = attach(members, groups, ["size", "full"], "group_size", max(total, 1)).select(
        "row_key", "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size",
        (F.col("row_key") == F.col("_best.row_key")).alias("kept"))
    copies = reliable_checkpoint(copies)
    alone = light.join(copies.select("row_key"), "row_key", "left_anti").select(
        "row_key", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"))
    return copies.unionByName(alone).select("doc_id", "keep_id", "group_size", "kept", "row_key")


def row_places(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, text): a number for every row of a scan. Scanning the
    same files again gives the same numbers, which joins the steps."""
    return docs.select(F.monotonically_increasing_id().alias("row_key"),
                       docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    key, = free_names(docs, "_ll_row")
    gone = progressive_groups(docs).where(~F.col("kept")).select(F.col("row_key").alias(key))
    return docs.withColumn(key, F.monotonically_increasing_id()).join(gone, key, "left_anti").drop(key)
