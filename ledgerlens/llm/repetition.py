"""Quality rules by repetition coverage.

Words of a text are given exact ids, windows of several lengths are hashed by
a rolling polynomial over the ids (in numpy, whole slices of the table at
once), equal hashes are checked word for word, and the characters that lie
inside repeated windows and repeated lines are measured (for these the first
occurrence does not count). The published thresholds for repeated 5- to
10-word windows and lines decide, with one rule on symbols per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ledgerlens.llm.common import mix64, released, text_slices, word_lists

#: Largest accepted share of word characters inside repeated
#: n-word windows, as published for the MassiveText filters.
WINDOW_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30          # repeated lines / lines with a word
LINE_CHARS_LIMIT = 0.20    # word characters in repeated lines / word characters
SYMBOL_LIMIT = 0.10        # symbols / words
SYMBOLS = b"#*$%&|<>"
BASE_WINDOW = 3

_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
           ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
           ("kept", pa.bool_()), ("n_lines", pa.int64()), ("dup_line_chars", pa.int64()),
           *[(f"dup_chars_{n}", pa.int64()) for n in WINDOW_LIMITS]]
SCHEMA = pa.schema(_FIELDS)
DDL = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, kept boolean, n_lines long, dup_line_chars long, "
       + ", ".join(f"dup_chars_{n} long" for n in WINDOW_LIMITS))


def repeated_windows(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks over ``at`` (window starts): its n ids occur at another start of
    the same row; they occur at an earlier one. ``hashes`` are the windows' hashes, which take in the row.
    Neighbours of equal hash are compared id by id; if ever two windows share
    a hash but not their ids, the ids themselves are sorted instead."""
    order = np.argsort(hashes, kind="stable")
    near = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    mask, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
    if not len(near):
        return mask, later
    a, b = at[order[near]], at[order[near + 1]]
    same = np.ones(len(near), bool)
    for k in range(n):
        same &= ids[a + k] == ids[b + k]
    if not same.all():
        grid = np.stack([ids[at + k] for k in range(n)])
        order = np.lexsort(grid)
        near = np.flatnonzero((grid[:, order[1:]] == grid[:, order[:-1]]).all(axis=0))
    mask[order[near]] = mask[order[near + 1]] = later[order[near + 1]] = True
    return mask, later


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The repetition measures of every text of an array."""
    m = len(text)
    text = pc.fill_null(text, "")
    rows, words = word_lists(text)
    per_row = lambda r, w=None: np.bincount(r, weights=w, minlength=m).astype(np.int64)
    out = {"n_words": per_row(rows)}
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    out["word_chars"] = per_row(rows, chars)

    # A row's word ids differ from those of other rows, so windows of two rows never agree.
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + rows * max(len(coded.dictionary), 1)
    size = len(ids)
    left = np.zeros(size, np.int64)
    if size:
        count = out["n_words"]
        left = np.repeat(np.cumsum(count), count) - np.arange(size)
    mixed, base = mix64(ids + 1), np.uint64(0xD1342543DE82EF95)
    roll, at = mixed.copy(), np.arange(size)
    for n in range(2, max(WINDOW_LIMITS) + 1):
        fits = left[at] >= n
        at, roll = at[fits], roll[fits]
        roll = roll * base + mixed[at + n - 1]
        if n < BASE_WINDOW:
            continue
        # a window can only recur if the shorter one at its start does
        again, later = repeated_windows(ids, roll, at, n)
        later = at[later]
        at, roll = at[again], roll[again]
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_row(rows[_covered(at, n, size)])
        if n in WINDOW_LIMITS:
            inside = _covered(later, n, size)
            out[f"dup_chars_{n}"] = per_row(rows[inside], chars[inside])

    raw = text.cast(pa.binary())
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + m + 1]
    table = np.zeros(256, np.int64)
    table[list(SYMBOLS)] = 1
    if m:
        sums = np.concatenate(([0], np.cumsum(table[data[offsets[0]:offsets[-1]]])))
        out["n_symbols"] = sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]]
    else:
        out["n_symbols"] = np.zeros(0, np.int64)

    lines = pc.split_pattern(text, "\n")
    line_row = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = pc.list_flatten(lines)
    real = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    line_row, lines = line_row[real], lines.filter(pa.array(real))
    coded = lines.dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + line_row * max(len(coded.dictionary), 1)
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    blank = pc.replace_substring_regex(lines.filter(pa.array(again)), pattern=r"[\x20\x09-\x0D]", replacement="")
    out["n_lines"] = per_row(line_row)
    out["n_dup_lines"] = per_row(line_row[again])
    out["dup_line_chars"] = per_row(line_row[again], pc.utf8_length(blank).to_numpy(zero_copy_only=False))
    return out


def verdict(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the measures, in exact integer arithmetic."""
    failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
    bad = 100 * x["n_dup_lines"] > round(100 * LINE_LIMIT) * x["n_lines"]
    bad |= 100 * x["dup_line_chars"] > round(100 * LINE_CHARS_LIMIT) * x["word_chars"]
    bad |= 100 * x["n_symbols"] > round(100 * SYMBOL_LIMIT) * x["n_words"]
    for n, limit in WINDOW_LIMITS.items():
        bad |= 100 * x[f"dup_chars_{n}"] > round(100 * limit) * x["word_chars"]
    return failed, ~failed & ~bad


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        x = measure(part.column("text"))
        x["base_failed"], x["kept"] = verdict(x)
        cols = [part.column("doc_id") if f.name == "doc_id" else pa.array(x[f.name], f.type) for f in SCHEMA]
        yield pa.RecordBatch.from_arrays(cols, schema=SCHEMA)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """Repetition measures and verdict of every document, one row each.

    Needs ``doc_id`` and ``text``; other columns are not read. A null or blank
    text has no words (all measures 0; it fails the base rule of 50 words). A
    null doc_id stays null; repeated rows give repeated results; an empty table
    an empty one. Whole texts are read, whatever their length. No shuffle.
    """
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return slim.mapInArrow(released(_task), DDL)


def _keep_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        yield part.filter(pa.array(verdict(measure(part.column("text")))[1]))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, with all their columns; judged row by row where they are
    read, so null or repeated doc_ids do not matter."""
    return docs.mapInArrow(released(_keep_task), docs.schema)
