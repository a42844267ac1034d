"""Substring dedup by MinHash banding of paragraphs.

Texts are cut into short segments whose borders depend on the words near them
alone (a border lies before the word pair with the smallest hash among its
neighbours), so that a passage put into another text keeps its inner segments
wherever it stands. Two kinds of paragraphs are compared, each with its own:
runs (from every segment on, the fewest segments in a row with ``min_run``
words), and spans: short lines, paragraphs (unbroken short lines together; a
long line by itself), and chunks of these (segments with borders farther
apart). A stretch that is a line, a paragraph and a chunk is one span of three
forms.

A run is compared as it is: its one band is its word sequence. Of a span the
5-word shingles give a MinHash signature whose number of bands is tuned for
recall; the bands of each of its forms are its own, so that a span does not
meet those it lies in. Sets too small to be near-equal without being equal have
one band, the set itself. Paragraphs with a band in common are found by packed counting,
those that are equal become one class, and of classes that share a band with another
one (told by 16 bits of their digests) the foremost members are read again for
their bands and sets, verified by exact Jaccard, and put into components: a component's first paragraph stays (of two that begin at one
place the longer), the others are removed. A run that stays for another's sake
stays whole, whatever else is found in its text, so every removed run is still
there, unbroken, in one text. A span that stays loses nothing but runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import shared
from ledgerlens.llm.common import (attach, discard, free_names, mix64, released, released_group, shingle_hashes,
                                   stored, text_slices)
from ledgerlens.llm.components import linked_components
from ledgerlens.llm.jaccard import verifier
from ledgerlens.llm.words import mixed, scanned, text_bytes, word_places
from ledgerlens.plans.runtime import reliable_checkpoint, shuffle_partitions

WIDTH = 5
PERCENT = 80
REACH = 4               # words to either side that decide a segment border
FAR = 20                # words to either side that decide a chunk border
MIN_RUN = 16            # words of the shortest run of segments
WRAPPED = 24            # shorter lines are joined to paragraphs
MIN_LINE = WIDTH        # words of the shortest line or paragraph that is compared
BAND_ROWS = 3
RECALL = 0.99
SLICE = 3 << 20
WORDS = 1 << 21         # words of texts whose units are merged at a time, one text at least
BROADCAST_BYTES = 16 << 20
SMALL = PERCENT // (100 - PERCENT) - 1      # largest sets of which near-equal ones are equal
RUN, SPAN = range(2)
LINE, PARAGRAPH, CHUNK = 1, 2, 4    # forms of a span, as bits


def tuned_bands(similarity: float, rows: int, recall: float) -> int:
    """Fewest bands of ``rows`` MinHash values with which two sets of that
    similarity share a band with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows)))


BANDS = tuned_bands(PERCENT / 100, BAND_ROWS, RECALL)


def _sizes(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hash of every word with the next one of its text; the last one's is the largest."""
    value = np.full(len(rows), np.iinfo(np.uint64).max, np.uint64)
    pair = rows[1:] == rows[:-1]
    value[:-1][pair] = mixed(hashes[:-1] * np.uint64(3) ^ hashes[1:])[pair]
    return value


def _borders(rows: np.ndarray, value: np.ndarray, reach: int) -> np.ndarray:
    """Mask of words that begin a segment (or chunk): those whose ``value`` is
    the smallest of ``reach`` ones to either side (of equal ones the first)."""
    if not len(rows):
        return np.zeros(0, bool)
    first = np.r_[True, rows[1:] != rows[:-1]]
    # texts lie ``reach`` places apart, so that no window sees two of them
    at = np.arange(len(rows)) + np.cumsum(first) * reach
    least = np.full(int(at[-1]) + reach + 1, np.iinfo(np.uint64).max, np.uint64)
    least[at] = value
    wide = 1
    while wide < reach:         # the smallest of ever more places from each one on
        step = min(wide, reach - wide)
        least[:len(least) - step] = np.minimum(least[:len(least) - step], least[step:])
        wide += step
    low = (value < least[at - reach]) & (value <= least[at + 1]) & (value < np.iinfo(np.uint64).max)
    return first | low


_BASE = 0x9E3779B97F4A7C15


def _windows(hashes: np.ndarray) -> np.ndarray:
    """Hash of the WIDTH words from each one on, as of ``shingle_hashes``, whether or not they are of one text."""
    roll = np.zeros(len(hashes), np.uint64)
    for k in range(WIDTH):
        roll *= np.uint64(_BASE)
        roll[:len(hashes) - k] += hashes[k:]
    return mixed(roll)


def _again(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending) whose value is at an earlier place of the row, too, and the last such place."""
    if len(rows) and int(rows[-1]) < 1 << 24:
        short = np.sort(rows.astype(np.uint64) << np.uint64(40) | values >> np.uint64(24))
        twice = short[1:][short[1:] == short[:-1]]
        has = np.zeros(int(rows[-1]) + 1, bool)
        has[(twice >> np.uint64(40)).astype(np.int64)] = True
        at = np.flatnonzero(has[rows])
    else:
        at = np.arange(len(rows))
    order = at[np.lexsort((values[at], rows[at]))]
    same = (rows[order[1:]] == rows[order[:-1]]) & (values[order[1:]] == values[order[:-1]])
    place, before = order[1:][same], order[:-1][same]
    order = np.argsort(place)
    return place[order], before[order]


class Units:
    """Paragraphs of the texts of a slice: kind, row, start word, words; and
    for all but runs their shingle sets, as places [begin, stop) among the
    shingles of the slice without those that repeat inside them."""

    def __init__(self, text: pa.Array, min_run: int):
        m = len(text)
        rows, line, hashes = scanned(text)
        self.words_of_row = np.bincount(rows, minlength=m)
        base = np.r_[0, np.cumsum(self.words_of_row)]
        n = len(rows)
        value = _sizes(rows, hashes)
        segment = np.flatnonzero(_borders(rows, value, REACH))
        # a run ends with the segment that brings it to so many words, in the same text
        ends = np.r_[segment[1:], n] if n else segment
        last = np.minimum(np.searchsorted(ends, segment + min_run), max(len(ends) - 1, 0))
        whole = (ends[last] - segment >= min_run) & (ends[last] <= base[rows[segment] + 1]) if n else np.zeros(0, bool)
        spans = [(0, rows[segment[whole]], segment[whole], ends[last][whole])]
        # lines with words
        begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if n else np.zeros(0, np.int64)
        line_end = np.r_[begin[1:], n] if n else begin
        line_rows, line, count = rows[begin], line[begin], line_end - begin
        long = (count >= MIN_LINE) & (count < WRAPPED)
        spans.append((LINE, line_rows[long], begin[long], line_end[long]))
        # paragraphs: unbroken short lines, up to a blank or a long one; a long line is one by itself
        short = count < WRAPPED
        joined = np.r_[False, short[1:] & short[:-1] & (line[1:] == line[:-1] + 1) & (line_rows[1:] == line_rows[:-1])][:len(begin)]
        top = begin[~joined]
        bottom = line_end[~np.r_[joined[1:], False][:len(begin)]]
        long = bottom - top >= MIN_LINE
        spans.append((PARAGRAPH, rows[top][long], top[long], bottom[long]))
        border = _borders(rows, value, FAR)
        border[top] = True
        chunk = np.flatnonzero(border)
        stop = np.r_[chunk[1:], n] if n else chunk
        long = stop - chunk >= min_run
        spans.append((CHUNK, rows[chunk[long]], chunk[long], stop[long]))
        self.forms = np.repeat(np.array([f for f, *_ in spans], np.uint8), [len(r) for _, r, *_ in spans])
        self.row, first, stop = (np.concatenate([x[k] for x in spans]).astype(np.int64) for k in (1, 2, 3))
        # in the order of row, kind, first word, longest first; a stretch of several forms once
        order = np.lexsort((-stop, first, self.forms > 0, self.row))
        self.forms, self.row, first, stop = self.forms[order], self.row[order], first[order], stop[order]
        new = np.ones(len(first), bool)
        new[1:] = ((self.forms[1:] > 0) != (self.forms[:-1] > 0)) | (first[1:] != first[:-1]) | (stop[1:] != stop[:-1])
        new[1:] |= self.row[1:] != self.row[:-1]
        once = np.flatnonzero(new)
        self.forms = np.bitwise_or.reduceat(self.forms, once) if len(once) else self.forms
        self.row, first, stop = self.row[once], first[once], stop[once]
        self.kind = np.where(self.forms > 0, SPAN, RUN)
        self.length = stop - first
        self.start = first - base[self.row]
        self._first, self._stop, self._hashes = first, stop, hashes
        # the shingles from each word on; a span of fewer words has one, behind all others
        self._shingles = _windows(hashes)
        few = np.flatnonzero((self.kind == SPAN) & (self.length < WIDTH))
        self._begin, self._end = first.copy(), np.where(self.kind == SPAN, stop - WIDTH + 1, first)
        if len(few):
            words = np.concatenate([hashes[a:b] for a, b in zip(first[few].tolist(), stop[few].tolist())])
            alone = shingle_hashes(np.repeat(np.arange(len(few)), self.length[few]), words, WIDTH)[1]
            self._begin[few], self._end[few] = n + np.arange(len(few)), n + np.arange(len(few)) + 1
            self._shingles = np.concatenate([self._shingles, alone])
        # what repeats inside a span: (span, place)
        inside = np.arange(n) <= base[rows + 1] - WIDTH
        places = np.flatnonzero(inside)
        place, before = _again(rows[places], self._shingles[places])
        place, before = places[place], places[before]
        low, high = np.searchsorted(place, self._begin), np.searchsorted(place, self._end)
        many = high - low
        of = np.repeat(np.arange(len(first)), many)
        at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
        real = before[at] >= self._begin[of]
        self._twice_of, self._twice_at = of[real], place[at[real]]
        self.size = np.where(self.kind == RUN, self.length,
                             self._end - self._begin - np.bincount(self._twice_of, minlength=len(first)))

    def set_of(self, unit: int) -> np.ndarray:
        """Shingles of a span, each once."""
        a, b = self._begin[unit], self._end[unit]
        low, high = np.searchsorted(self._twice_of, [unit, unit + 1])
        return np.delete(self._shingles[a:b], self._twice_at[low:high] - a)

    def digest(self, salt: int) -> np.ndarray:
        """Hash of every unit's shingle set, or of a run's words in order."""
        value = mixed(self._shingles, salt)
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(value)]
        total = sums[self._end] - sums[self._begin]
        if len(self._twice_of):
            begin = np.flatnonzero(np.r_[True, self._twice_of[1:] != self._twice_of[:-1]])
            total[self._twice_of[begin]] -= np.add.reduceat(value[self._twice_at], begin)
        # a run's words are the coefficients of a polynomial: a difference of sums over all words before
        run = np.flatnonzero(self.kind == RUN)
        n = len(self._hashes)
        power, back = (np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(n, b, np.uint64)])
                       for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed(self._hashes, salt) * power[:n])]
        first, stop = self._first[run], self._stop[run]
        total[run] = mixed((sums[stop] - sums[first]) * back[first] + self.length[run].astype(np.uint64))
        return total

    def bands(self, of: np.ndarray) -> np.ndarray:
        """Band hashes of the spans ``of``, one row each."""
        out = np.zeros((len(of), BANDS), np.uint64)
        if not len(of):
            return out
        order = np.argsort(self._begin[of], kind="stable")
        # every second stretch is a span, the others lie between two
        cuts = np.stack([self._begin[of[order]], self._end[of[order]]], axis=1).ravel()
        sets = np.append(self._shingles, np.uint64(0))
        for band in range(BANDS):
            value = np.full(len(of), band + 1, np.uint64)
            for k in range(BAND_ROWS):
                salt = (_BASE * (band * BAND_ROWS + k + 1)) & 0xFFFFFFFFFFFFFFFF
                value = mix64(value ^ np.minimum.reduceat(mixed(sets, salt), cuts)[::2])
            out[order, band] = value
        return out

    @property
    def banded(self) -> np.ndarray:
        """How many sets of bands each unit has: one for every form, none for runs and small sets."""
        forms = np.unpackbits(self.forms[:, None], axis=1).sum(axis=1)
        return np.where(self.size > SMALL, forms, 0).astype(np.uint8)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(unit, band hash) of all units in order."""
        sets = self.banded
        each = np.where(sets > 0, sets.astype(np.int64) * BANDS, 1)
        begin = np.cumsum(each) - each
        hashes = np.empty(int(each.sum()), np.uint64)
        one, many = np.flatnonzero(sets == 0), np.flatnonzero(sets)
        hashes[begin[one]] = mix64(self.digest(1) ^ self.kind.astype(np.uint64))[one]
        bands, place = self.bands(many), begin[many].copy()
        for form in (LINE, PARAGRAPH, CHUNK):
            own = self.forms[many] & form > 0
            hashes[place[own][:, None] + np.arange(BANDS)] = mix64(bands[own] ^ np.uint64(form))
            place[own] += BANDS
        return np.repeat(np.arange(len(each)), each), hashes


_HEAD = np.dtype([("row_key", "<i8"), ("units", "<i4")])


def _send(parts: int, min_run: int):
    """A hash goes out of a slice once for each tag (16 bits of the unit's
    digest) it has there; a slice knows by itself of those it has twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            units = Units(part.column("text"), min_run)
            unit, hashes = units.entries()
            tags = (units.digest(2) & np.uint64(0xFFFF)).astype("<u2")[unit]
            order = np.argsort(hashes)
            same = hashes[order[1:]] == hashes[order[:-1]]
            # hashes that the slice has twice, in the order of tag and place
            order = order[np.r_[same, False][:len(order)] | np.r_[False, same][:len(order)]]
            order = order[np.lexsort((order, tags[order], hashes[order]))]
            again, mingled, sent = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool), np.ones(len(hashes), bool)
            if len(order):
                new_hash = np.r_[True, hashes[order[1:]] != hashes[order[:-1]]]
                new_tag = new_hash | np.r_[True, tags[order[1:]] != tags[order[:-1]]]
                again[order] = True
                mingled[order] = (np.add.reduceat(new_tag.astype(np.int64), np.flatnonzero(new_hash)) > 1)[np.cumsum(new_hash) - 1]
                sent[order[~new_tag]] = False
            home = np.where(sent, shared.part_of(hashes, parts), parts).astype("<u2" if parts < 1 << 16 else "<u4")
            head = np.zeros(part.num_rows, _HEAD)
            head["row_key"] = part.column("row_key").to_numpy(zero_copy_only=False)
            head["units"] = np.bincount(units.row, minlength=part.num_rows)
            blob = (np.asarray([part.num_rows, len(hashes)], "<i8").tobytes() + head.tobytes()
                    + units.banded.tobytes() + np.packbits(again).tobytes() + np.packbits(mingled).tobytes()
                    + home.tobytes())
            by_home = np.argsort(home, kind="stable")
            ends = np.searchsorted(home[by_home], np.arange(parts + 1))
            rest = ((hashes // np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            key = shared.slice_key(part)
            out = [(key, -1 - key % parts, b"", blob)]
            for p in range(parts):
                own = by_home[ends[p]:ends[p + 1]]
                if len(own):
                    out.append((key, p, tags[own].tobytes(), rest[own].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shared.MESSAGE)],
                                             schema=shared.MESSAGE)
    return run


def _flags(table: pa.Table) -> pa.Table:
    """Answers: for each hash sent, whether it was sent elsewhere, too, and whether with another tag (bits)."""
    if table["part"][0].as_py() < 0:
        return table
    sent = [np.frombuffer(b, "<u4") for b in table["hashes"].to_pylist()]
    tags = np.concatenate([np.frombuffer(b, "<u2") for b in table["counts"].to_pylist()])
    hashes = np.concatenate(sent)
    order = np.argsort(hashes.astype(np.uint64) << np.uint64(16) | tags)
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    begin, of = np.flatnonzero(new), np.cumsum(new) - 1
    last = np.r_[begin[1:], len(order)] - 1
    many, other = np.zeros(len(order), bool), np.zeros(len(order), bool)
    many[order] = (last > begin)[of]
    other[order] = (tags[order[begin]] != tags[order[last]])[of]
    ends = np.cumsum([len(h) for h in sent])
    out = [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(many, ends[:-1]), np.split(other, ends[:-1]))]
    return pa.table([table["slice"], table["part"], pa.array([b""] * len(out), pa.binary()), pa.array(out, pa.binary())],
                    schema=shared.MESSAGE)


def _bits(blob: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), at), count=n).astype(bool)


_FLAGGED = pa.schema([("row_key", pa.int64()), ("bits", pa.binary())])


def _per_doc(parts: int):
    def run(table: pa.Table) -> pa.Table:
        """Documents with a repeated unit, with two bits for each unit: repeated, and near-equal to another one."""
        blob = shared.header_of(table)
        m, entries = np.frombuffer(blob, "<i8", 2).tolist()
        head = np.frombuffer(blob, _HEAD, m, 16)
        at, n = 16 + m * _HEAD.itemsize, int(head["units"].sum())
        banded = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
        at += n
        wide = -(-entries // 8)
        entry, near = _bits(blob, entries, at), _bits(blob, entries, at + wide)
        part = np.frombuffer(blob, "<u2" if parts < 1 << 16 else "<u4", entries, at + 2 * wide)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(int(part.max(initial=0)) + 2))
        for p, answer in zip(table["part"].to_pylist(), table["hashes"].to_pylist()):
            if p >= 0:
                own = order[ends[p]:ends[p + 1]]
                entry[own] |= _bits(answer, len(own))
                near[own] |= _bits(answer, len(own), -(-len(own) // 8))
        each = np.where(banded > 0, banded * BANDS, 1)
        begin = np.cumsum(each) - each
        unit = np.logical_or.reduceat(entry, begin) if n else entry
        # a span whose bands only equal sets have needs no comparison
        near = (np.logical_or.reduceat(near, begin) if n else near) & (banded > 0)
        keys, out = [], []
        stop = np.cumsum(head["units"])
        for k in np.unique(np.searchsorted(stop, np.flatnonzero(unit), side="right")).tolist():
            a, b = int(stop[k] - head["units"][k]), int(stop[k])
            keys.append(int(head["row_key"][k]))
            out.append(np.packbits(unit[a:b]).tobytes() + np.packbits(near[a:b]).tobytes())
        return pa.table([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], schema=_FLAGGED)
    return run


_CANDS = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("unit", pa.int32()), ("kind", pa.int8()),
                    ("forms", pa.int8()), ("near", pa.bool_()), ("start", pa.int32()), ("length", pa.int32()),
                    ("d1", pa.int64()), ("d2", pa.int64())])
_CANDS_DDL = "row_key long, doc_id long, unit int, kind byte, forms byte, near boolean, start int, length int, d1 long, d2 long"


def _candidates(min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The flagged units of documents (numbered inside their row) with digests (128 bits) of their kind and sets or word sequences."""
        for part in text_slices(batches, SLICE):
            units = Units(part.column("text"), min_run)
            count = np.bincount(units.row, minlength=part.num_rows)
            blobs = list(zip(part.column("bits").to_pylist(), count.tolist()))
            pick = np.flatnonzero(np.concatenate([_bits(b, c) for b, c in blobs])) if blobs else np.zeros(0, int)
            near = np.concatenate([_bits(b, c, -(-c // 8)) for b, c in blobs])[pick] if blobs else np.zeros(0, bool)
            number = pick - (np.cumsum(count) - count)[units.row[pick]]
            keys = part.column("row_key").to_numpy(zero_copy_only=False)[units.row[pick]]
            docs = part.column("doc_id").take(pa.array(units.row[pick]))
            d1 = mix64(units.digest(1) ^ units.kind.astype(np.uint64)).view(np.int64)[pick]
            d2 = units.digest(2).view(np.int64)[pick]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), docs, pa.array(number, pa.int32()), pa.array(units.kind[pick], pa.int8()),
                 pa.array(units.forms[pick].astype(np.int8)), pa.array(near), pa.array(units.start[pick], pa.int32()), pa.array(units.length[pick], pa.int32()),
                 pa.array(d1), pa.array(d2)], schema=_CANDS)
    return run


_MEMBERS = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("rank", pa.float64()), ("forms", pa.int64()),
                      ("hashes", pa.binary()), ("bands", pa.list_(pa.int64()))])
_MEMBERS_DDL = "node long, size long, rank double, forms long, hashes binary, bands array<long>"
_PICK = np.dtype([("unit", "<i4"), ("node", "<i8"), ("copies", "<i8"), ("forms", "<i8")])


def _pack_picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = []
        for picks in batch.column("picks").to_pylist():
            own = np.zeros(len(picks), _PICK)
            for name in _PICK.names:
                own[name] = [x[name] for x in picks]
            blobs.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(blobs, pa.binary())], names=["row_key", "bits"])


def _members(min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets and bands of the picked spans."""
        for part in text_slices(batches, SLICE):
            units = Units(part.column("text"), min_run)
            begin = np.searchsorted(units.row, np.arange(part.num_rows))
            picks = [np.frombuffer(b, _PICK) for b in part.column("bits").to_pylist()]
            of = np.concatenate([x["unit"] + b for x, b in zip(picks, begin.tolist())]) if picks else np.zeros(0, int)
            if not len(of):
                continue
            sets = [units.set_of(u).tobytes() for u in of.tolist()]
            bands = units.bands(of).view(np.int64)
            ends = np.arange(0, bands.size + 1, BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x["node"] for x in picks])), pa.array(units.size[of].astype(np.int64)),
                 pa.array(np.concatenate([x["copies"] for x in picks]).astype(np.float64)),
                 pa.array(np.concatenate([x["forms"] for x in picks])), pa.array(sets, pa.binary()),
                 pa.ListArray.from_arrays(ends, bands.ravel())], schema=_MEMBERS)
    return run


def _length_fits(x, y):
    return 100 * F.least(x["size"], y["size"]) >= PERCENT * F.greatest(x["size"], y["size"])


def _sent_to(scan: DataFrame, few: DataFrame, key: str, blob: str, how: str) -> DataFrame:
    """Join a table of some rows (key, blob) to the scan: sent to it if its
    measured size is small, else both are shuffled by row."""
    size = few.agg(F.sum(F.lit(24) + F.octet_length(blob))).first()[0] or 0
    return scan.join(F.broadcast(few) if size <= BROADCAST_BYTES else few, key, how)


def repeated_paragraphs(scan: DataFrame, min_run: int = MIN_RUN) -> tuple[DataFrame, list[str]]:
    """(row_key, kind, start, length, stays) of the paragraphs that have equal
    or near-equal ones, in words of the row: of a component the first by doc_id
    (null last), row, place and length stays, the others go. ``scan``:
    (row_key, doc_id, text). Second: tables to discard once the result has been
    used."""
    spark = scan.sparkSession
    parts = shuffle_partitions(spark)
    sent = scan.select("row_key", "text").mapInArrow(released(_send(parts, min_run)), shared.MESSAGE_DDL)
    flagged = reliable_checkpoint(
        sent.groupBy("part").applyInArrow(released_group(_flags), shared.MESSAGE_DDL)
        .groupBy("slice").applyInArrow(released_group(_per_doc(parts)), "row_key long, bits binary"))
    cands, path = stored(_sent_to(scan, flagged, "row_key", "bits", "inner").mapInArrow(released(_candidates(min_run)), _CANDS_DDL)
                         .withColumn("uid", F.monotonically_increasing_id()), "paragraphs")
    total = max(cands.count(), 1)

    same = ["d1", "d2"]
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "start", (-F.col("length")).alias("back"),
                     "uid", "unit")
    extent = [F.min("low").alias("low"), F.max("high").alias("high"), F.max("last").alias("last"), F.min("end").alias("end")]
    classes, classes_path = stored(cands.select(
        "*", F.col("row_key").alias("low"), F.col("row_key").alias("high"), F.col("start").alias("last"),
        (F.col("start") + F.col("length")).alias("end")).groupBy(*same).agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.bit_or("forms").cast("long").alias("forms"), F.max("near").alias("near"),
        *extent), "classes")

    # spans that may have near-equal ones: the foremost member of each class is read again
    near = classes.where(F.col("near"))
    picks = near.groupBy(F.col("first.row_key").alias("row_key")).agg(F.collect_list(F.struct(     # a row's units: bounded by its text
        F.col("first.unit").alias("unit"), F.col("first.uid").alias("node"), F.col("n").alias("copies"), "forms")).alias("picks"))
    picks = reliable_checkpoint(picks.mapInArrow(released(_pack_picks), "row_key long, bits binary"))
    own = reliable_checkpoint(_sent_to(scan, picks, "row_key", "bits", "inner").mapInArrow(released(_members(min_run)), _MEMBERS_DDL))
    # the paragraph with the most copies is compared first: its variants are most alike to it
    formed = own.withColumn("form", F.explode(F.array(*[F.lit(f) for f in (LINE, PARAGRAPH, CHUNK)]))).where(
        F.col("forms").bitwiseAND(F.col("form")) > 0)
    banded = formed.select(F.explode("bands").alias("band"), "form", "node", "size", "rank").select(
        F.xxhash64("band", "form").alias("bucket"), "node", "size", F.lit(0).alias("pos"), "rank")
    met = reliable_checkpoint(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_w")).where("_w > 1"))
    rows = reliable_checkpoint(attach(banded, met, ["bucket"], "_w", max(3 * BANDS * own.count(), 1)).drop("_w"))
    sets = own.select("node", "size", "hashes")
    labels = reliable_checkpoint(linked_components(rows, sets, PERCENT, _length_fits, verifier(sets, PERCENT), 1, False))
    # a component keeps its first paragraph; one whose members all lie over each other in one row is no repeat
    tagged, tagged_path = stored(near.join(labels, F.col("first.uid") == F.col("node"), "left").withColumn(
        "comp", F.coalesce("comp", "first.uid")).drop("node", "near", "forms"), "tagged")
    repeats = (F.col("members") > 1) & ((F.col("low") < F.col("high")) | (F.col("end") <= F.col("last")))
    comps = reliable_checkpoint(tagged.groupBy("comp").agg(
        F.min("first").alias("of"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("_k"), *extent)
        .where(repeats).select("comp", "_k", F.col("of.uid").alias("stays")))
    # a class without near-equal ones is a component by itself
    alone = classes.where(~F.col("near")).withColumnRenamed("n", "members").where(repeats).select(
        *same, F.col("members").alias("n"), F.col("first.uid").alias("stays"))
    named, named_path = stored(alone.unionByName(
        attach(tagged.select(*same, "n", "comp"), comps, ["comp"], "_k", max(tagged.count(), 1)).select(*same, "n", "stays")), "named")
    discard(spark, classes_path, tagged_path)
    return attach(cands.select("uid", "row_key", "kind", "start", "length", *same), named, same, "n", total).select(
        "row_key", "kind", "start", "length", (F.col("uid") == F.col("stays")).alias("stays")), [path, named_path]


def _stretches(rows: np.ndarray, units: np.ndarray, min_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of word stretches to remove, from packed units of rows
    (0, 1, ..): near-equal ones that go, without what stays; runs that go,
    without runs that stay. Beside what stays a rest of fewer than ``min_run``
    words stays, too."""
    units = units.astype(np.uint64)
    start, length = ((units >> np.uint64(k) & np.uint64(0x7FFFFFFF)).astype(np.int64) for k in (33, 2))
    kind, stays = units >> np.uint64(1) & np.uint64(1), (units & np.uint64(1)).astype(bool)
    # a place for every word, one after the other, and one before and behind each row's words
    wide = np.zeros(int(rows.max(initial=-1)) + 1, np.int64)
    np.maximum.at(wide, rows, start + length + 2)
    base = np.cumsum(wide) - wide
    first = base[rows] + 1 + start
    gone = np.zeros(int(wide.sum()) + 1, np.int8)
    for of, keeps, value in ((SPAN, False, 1), (SPAN, True, -1), (RUN, False, 1), (RUN, True, -1)):
        own = np.flatnonzero((kind == of) & (stays == keeps))
        over = (np.bincount(first[own], minlength=len(gone)) - np.bincount(first[own] + length[own], minlength=len(gone)))
        gone[np.cumsum(over) > 0] = value
    begin = np.flatnonzero((gone[1:] == 1) & (gone[:-1] != 1)) + 1
    end = np.flatnonzero((gone[1:] != 1) & (gone[:-1] == 1)) + 1
    real = (end - begin >= min_run) | ((gone[begin - 1] >= 0) & (gone[end] >= 0))
    begin, end = begin[real], end[real]
    row = np.searchsorted(base, begin, side="right") - 1
    return row, begin - base[row] - 1, end - base[row] - 1


def _merge(min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("units")
            rows = pc.list_parent_indices(units).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.list_flatten(units).to_numpy(zero_copy_only=False)
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            # some rows at a time, by the words that their units reach
            reach = np.zeros(batch.num_rows, np.int64)
            np.maximum.at(reach, rows, ((values.astype(np.uint64) >> np.uint64(33)) + (values.astype(np.uint64) >> np.uint64(2) & np.uint64(0x7FFFFFFF))).astype(np.int64))
            total, at = np.cumsum(reach), 0
            while at < len(keys):
                stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + WORDS, side="right")))
                a, b = np.searchsorted(rows, [at, stop])
                row, begin, end = _stretches(rows[a:b] - at, values[a:b], min_run)
                has, count = np.unique(row, return_counts=True)
                ends = np.r_[0, np.cumsum(count * 8)].astype(np.int32)
                blob = np.stack([begin, end], axis=1).astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at + has]), pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(ends), pa.py_buffer(blob)])],
                    names=["row_key", "bits"])
                at = stop
    return run


def _cut(text: pa.Array, blobs: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Texts without the word stretches, what went as code point offsets of
    the old texts, and the numbers of removed words."""
    own = np.flatnonzero(pc.and_(pc.is_valid(text), pc.is_valid(blobs)).to_numpy(zero_copy_only=False))
    found = [np.frombuffer(b, "<i4") for b in blobs.take(pa.array(own)).to_pylist()]
    each = np.asarray([len(x) // 2 for x in found], np.int64)
    a, b = (np.concatenate(found) if found else np.zeros(0, "<i4")).astype(np.int64).reshape(-1, 2).T
    old = text.take(pa.array(own))
    data, offsets = text_bytes(old)
    begin, end = word_places(data, offsets)
    row = np.repeat(np.arange(len(own)), each)
    word = np.searchsorted(begin, offsets)[row]
    first, last = begin[word + a], end[word + b - 1]
    # the blanks behind a stretch go with it
    other = np.append(np.flatnonzero((data != 0x20) & (data != 0x09)), len(data))
    last = np.minimum(other[np.searchsorted(other, last)], offsets[row + 1])
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    cuts = np.stack([points[first], points[last]], axis=1) - points[offsets[row]][:, None]
    step = np.zeros(len(data) + 1, np.int8)
    step[first] += 1
    step[last] -= 1
    gone = np.cumsum(step, dtype=np.int8).astype(bool)
    left = offsets - np.r_[0, np.cumsum(gone)][offsets]
    new = pa.Array.from_buffers(pa.string(), len(own), [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(data[~gone[:-1]])])
    changed, count, words = np.zeros(len(text), bool), np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    changed[own], count[own] = True, each
    np.add.at(words, own[row], b - a)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, cuts.size + 1, 2, dtype=np.int32)), pa.array(cuts.ravel(), pa.int64()))
    return (pc.replace_with_mask(text.cast(pa.string()), pa.array(changed), new),
            pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), inner), pa.array(words))


def _remove(text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            text, spans, words = _cut(part.column(text_at), part.column(part.num_columns - 1))
            cols = [text if k == text_at else part.column(k) for k in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, spans, words], names=names)
    return run


def remove_repeats(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with ``text`` freed of repeated paragraphs, and two further
    columns, the last ones: _ll_spans (removed stretches [begin, end) in code
    points of the old text) and _ll_removed (removed words); an underscore more
    where ``docs`` has a column of that name.

    Of every component of equal or near-equal paragraphs (Jaccard of 5-word
    shingles of 0.8 or more, A-Z lower-cased) the first by doc_id (null last),
    row and place (then the longest) stays. Lines and paragraphs count from
    MIN_LINE words on, chunks from ``min_run``; other passages when unbroken
    segments of ``min_run`` words occur together elsewhere. Rows are kept, even
    if nothing is left of the text. Null, empty and blank texts stay as they
    are; repeated rows lose all paragraphs but one row's; very long texts are
    cut to units whole, one text at a time if need be; other columns are
    carried along; an empty table gives an empty result.
    """
    at = docs.columns.index("text")
    scan = docs.select(F.monotonically_increasing_id().alias("row_key"),
                       docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    found, paths = repeated_paragraphs(scan, min_run)
    # a row's units are bounded by its text; merged stretches take a few bytes a row
    key, blob, spans, removed = free_names(docs, "_ll_row", "_ll_stretches", "_ll_spans", "_ll_removed")
    merged = reliable_checkpoint(
        found.select("row_key", F.shiftleft(F.col("start").cast("long"), 33).bitwiseOR(F.shiftleft(F.col("length").cast("long"), 2))
                     .bitwiseOR(F.shiftleft(F.col("kind").cast("long"), 1)).bitwiseOR(F.col("stays").cast("long")).alias("unit"))
        .groupBy("row_key").agg(F.collect_list("unit").alias("units"))
        .mapInArrow(released(_merge(min_run)), "row_key long, bits binary"))
    discard(docs.sparkSession, *paths)
    merged = merged.withColumnRenamed("row_key", key).withColumnRenamed("bits", blob)
    joined = _sent_to(docs.withColumn(key, F.monotonically_increasing_id()), merged, key, blob, "left").drop(key)
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, T.ArrayType(T.ArrayType(T.LongType()))),
                           T.StructField(removed, T.LongType())])
    return joined.mapInArrow(released(_remove(at, schema.names)), schema)


def without_repeats(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``remove_repeats`` with the columns of ``docs`` alone; ``n_chars``, if there, follows the new text."""
    out = remove_repeats(docs, min_run)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
