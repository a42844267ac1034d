"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has more than this fraction (1 / HOT_PARTS) of all rows;
#: so there are fewer than HOT_PARTS hot keys, whatever the data.
HOT_PARTS = 500
HOT_LEAST = 1000

#: A group below this leaves too little behind to be worth giving back.
RELEASE_BYTES = 1 << 20

#: White space of the word contracts, as a Java regex class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@lru_cache(maxsize=1)
def _malloc_trim() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):    # another C library than glibc
        return None


def release_memory() -> None:
    """Give freed memory of Arrow and numpy back to the system. Spark keeps a
    Python worker for the tasks to come; what the allocators hold on to from
    the largest task so far would stay beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = _malloc_trim()
    if trim is not None:
        trim(0)


def released(task: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives its memory back at its end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release_memory()
    return run


def released_group(task: Callable) -> Callable:
    """A function for ``applyInArrow`` that gives its memory back after a group of some size."""
    def run(table: pa.Table) -> pa.Table:
        out = task(table)
        if table.nbytes >= RELEASE_BYTES:
            release_memory()
        return out
    return run


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches with a ``text`` column into slices of about ``limit``
    bytes of text (one row at least), so that memory follows the slice."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def word_lists(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words (runs of anything but ASCII white space) of each text: the row
    number of every word, and the words. A null text has none."""
    text = pc.fill_null(text, "")
    if lower:
        text = pc.ascii_lower(text)
    parts = pc.ascii_split_whitespace(text)
    rows = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    words = pc.list_flatten(parts)
    real = pc.greater(pc.binary_length(words), 0)
    if not pc.all(real).as_py() and len(words):
        rows = rows[real.to_numpy(zero_copy_only=False)]
        words = words.filter(real)
    return rows.astype(np.int64), words


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of every word, the same in every task: each distinct word
    of the array is hashed once."""
    import xxhash

    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    table = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()),
                        dtype=np.uint64, count=len(coded.dictionary))
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def shingle_hashes(rows: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width``-word window (its row, the hash); a row with
    fewer words has one window over all of them."""
    n = len(rows)
    if not n:
        return rows, hashes
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[start, n])
    base = np.uint64(0x9E3779B97F4A7C15)
    roll = np.zeros(n, np.uint64)
    for k in range(width):
        nxt = np.zeros(n, np.uint64)
        nxt[:n - k] = hashes[k:] if k else hashes
        roll = roll * base + nxt
    left = np.repeat(start + count, count) - np.arange(n)
    whole = left >= width
    short = start[count < width]
    if len(short):
        for s, c in zip(short.tolist(), count[count < width].tolist()):
            value = c
            for h in hashes[s:s + c].tolist():
                value = (value * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
            roll[s] = value
        whole[short] = True
    return rows[whole], mix64(roll[whole])


def distinct_in_row(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) pairs without repeats, sorted by row, then hash."""
    if not len(rows):
        return rows, hashes
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.r_[True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])]
    return rows[first], hashes[first]


def distinct_of_rows(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) pairs without repeats, in their order; ``rows`` ascends. One
    plain sort of shortened pairs tells which rows may have repeats; only those
    are compared in full."""
    if not len(rows) or int(rows[-1]) >= 1 << 24:
        return distinct_in_row(rows, hashes)
    short = np.sort(rows.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    again = short[1:][short[1:] == short[:-1]]
    if not len(again):
        return rows, hashes
    has = np.zeros(int(rows[-1]) + 1, bool)
    has[(again >> np.uint64(40)).astype(np.int64)] = True
    at = np.flatnonzero(has[rows])
    order = at[np.lexsort((hashes[at], rows[at]))]
    same = (rows[order[1:]] == rows[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    keep = np.ones(len(rows), bool)
    keep[order[1:][same]] = False
    return rows[keep], hashes[keep]


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, total: int,
           largest: int | None = None) -> DataFrame:
    """Inner join of many rows with a per-key table, safe for hot keys.

    ``right`` has one row per key; its column ``weight`` counts the key's rows
    in ``left``, which has ``total`` rows. Keys with more than
    total / HOT_PARTS rows (and at least HOT_LEAST) number fewer than
    HOT_PARTS: that bound makes their broadcast safe. All other keys are joined
    by a shuffle in which no key can fill a task. ``largest`` is the greatest
    weight where it is known. Both sides may be read twice, so pass tables or
    checkpoints.
    """
    keys = list(keys)
    cut = max(total // HOT_PARTS, HOT_LEAST)
    is_hot = F.col(weight) > cut
    if min(total, total if largest is None else largest) <= cut or (
            largest is None and not right.where(is_hot).head(1)):
        return left.join(right, keys)
    known = F.broadcast(right.where(is_hot).select(*keys))
    return (left.join(F.broadcast(right.where(is_hot)), keys)
            .unionByName(left.join(known, keys, "left_anti").join(right.where(~is_hot), keys)))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the session's shared checkpoint folder: the
    table read again, and its path. Unlike a checkpoint its size estimate is
    the files', so loops that build on their own results can use it."""
    import uuid

    from ledgerlens.plans.runtime import ensure_checkpoint_dir

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def through_table(df: DataFrame, name: str) -> DataFrame:
    """``stored`` for a table that is kept."""
    return stored(df, name)[0]
