"""Katz backoff language model: Good-Turing discounted word pairs over words.

p(w | v) = d(c(v, w)) c(v, w) / (c(v) + 1)  if the pair was seen, else alpha(v) p(w);
p(w)     = d(c(w)) c(w) / (N + 1)           if the word was seen, else what the words leave over.

d(r) is the Good-Turing discount of Katz for r <= K and 1 beyond; the 1 in the
denominators keeps something for what was never seen, however few counts
there are. alpha(v) is exactly what the seen pairs of v leave over, divided by
the mass of the words not seen after v, so every distribution sums to 1. A
text starts after a start mark and ends with an end token; an unknown word
leaves no context, and the next word is scored by p(w).

Counts are held in hash partitions. Slices of the corpus send packed words to
their partitions and get frequency ranks back (the count of a word follows
from its rank and one small step table); word pairs then go to partitions by
their first word, very frequent first words by both, where pairs are counted,
scored and summed by document. A pair that a slice has OFTEN times or more is
sent once, with its count, as a document of its own behind the slice's
documents; its score comes back once, and the slice adds it to the documents
that have the pair. So one pair is fewer than OFTEN entries a slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import shared
from ledgerlens.llm.common import discard, mix64, stored, text_slices, through_table, word_lists
from ledgerlens.plans.runtime import reliable_checkpoint, shuffle_partitions

K = 5                   # counts up to K are discounted
FOLDS, HELD_OUT = 7, 2
SLICE = 8 << 20
OFTEN = 1024            # occurrences in a slice from which a pair is sent once
UNKNOWN, START = 0xFFFFFFFE, 0xFFFFFFFF


def discounts(counts_of_counts: dict[int, int], k: int = K) -> np.ndarray:
    """d(0..k): Katz's Good-Turing discounts. ``k`` is lowered until all are
    in (0, 1]; at 0 nothing is discounted. Entry 0 is not used."""
    while k:
        n = [counts_of_counts.get(r, 0) for r in range(k + 2)]
        if min(n[1:]) > 0:
            tail = (k + 1) * n[k + 1] / n[1]
            d = [1.0] + [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if tail != 1 else 0.0
                         for r in range(1, k + 1)]
            if all(0 < x <= 1 for x in d):
                return np.asarray(d)
        k -= 1
    return np.ones(1)


class Unigrams:
    """Step table of the words in order of falling count: id -> count -> p(w)."""

    def __init__(self, counts: list[tuple[int, int]]):
        counts = sorted(counts, reverse=True)
        self.count = np.asarray([c for c, _ in counts], np.int64)
        number = np.asarray([n for _, n in counts], np.int64)
        self.first = np.cumsum(number) - number
        self.words, self.tokens = int(number.sum()), int((self.count * number).sum())
        d = discounts(dict(counts))
        factor = np.where(self.count < len(d), d[np.minimum(self.count, len(d) - 1)], 1.0)
        self.p = factor * self.count / (self.tokens + 1)
        self.p_unknown = 1 - float((self.p * number).sum())

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and probabilities of word ids."""
        if not len(self.first):
            return np.zeros(len(ids), np.int64), np.full(len(ids), self.p_unknown)
        at = np.searchsorted(self.first, ids, side="right") - 1
        known = ids < UNKNOWN
        return np.where(known, self.count[at], 0), np.where(known, self.p[at], self.p_unknown)

    def frequent(self, share: float) -> int:
        """How many words have a count over ``share``: the ids below that number."""
        return int(np.searchsorted(self.first, 0)) if not len(self.first) else int(
            np.append(self.first, self.words)[np.searchsorted(-self.count, -share, side="left")])


_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("held", "u1"), ("words", "<i8")])


def _read(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a slice: documents, row of each word, distinct words with the end
    token (the empty word) last, and the word index of each word."""
    rows, words = word_lists(part.column("text"), lower=True)
    docs = np.zeros(part.num_rows, _DOC)
    ids = part.column("doc_id")
    docs["null"] = ids.is_null().to_numpy(zero_copy_only=False)
    docs["doc_id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
    docs["held"] = [(zlib.crc32(b"" if d is None else str(d).encode()) % FOLDS) == HELD_OUT for d in ids.to_pylist()]
    docs["words"] = np.bincount(rows, minlength=part.num_rows)
    coded = words.dictionary_encode()
    distinct = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([b""], pa.binary())])
    return docs, rows, distinct, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _halves(x: np.ndarray) -> bytes:
    """32-bit numbers as all lower, then all upper halves: the upper ones are
    mostly small and alike, which the shuffle's compression then sees."""
    x = x.astype("<u4")
    return (x & np.uint32(0xFFFF)).astype("<u2").tobytes() + (x >> np.uint32(16)).astype("<u2").tobytes()


def _whole(blob: bytes, n: int, at: int = 0) -> np.ndarray:
    low, high = np.frombuffer(blob, "<u2", n, at), np.frombuffer(blob, "<u2", n, at + 2 * n)
    return low.astype(np.uint32) | high.astype(np.uint32) << np.uint32(16)


def _parts(words: list[bytes], parts: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return shared.part_of(np.fromiter((digest(w) for w in words), np.uint64, len(words)), parts)


def _send_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            docs, rows, distinct, at = _read(part)
            words = distinct.to_pylist()
            train = docs["held"] == 0
            counts = np.bincount(at, weights=train[rows], minlength=len(words)).astype(np.int64)
            counts[-1] = train.sum()
            home = _parts(words, parts)
            order = np.argsort(home, kind="stable")
            ends = np.searchsorted(home[order], np.arange(parts + 1))
            out = []
            for p in range(parts):
                own = order[ends[p]:ends[p + 1]]
                if len(own):
                    out.append((shared.slice_key(part), p, counts[own].astype("<u4").tobytes(),
                                b" ".join([words[k] for k in own.tolist()])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shared.MESSAGE)],
                                             schema=shared.MESSAGE)
    return run


def _totals(table: pa.Table) -> tuple[pa.Table, list[int]]:
    """Words of a partition in first-seen order of each slice, with their total
    counts; and the number of words of each slice."""
    lists = [b.split(b" ") for b in table["hashes"].to_pylist()]
    flat = pa.table({"w": pa.array([w for x in lists for w in x], pa.binary()),
                     "c": pa.array(np.concatenate([np.frombuffer(b, "<u4") for b in table["counts"].to_pylist()]))})
    coded = flat["w"].combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    total = np.bincount(at, weights=flat["c"].to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
    return pa.table({"w": coded.dictionary, "c": total}), [at, [len(x) for x in lists]]


def _count_words(table: pa.Table) -> pa.Table:
    total, _ = _totals(table)
    c, n = np.unique(total["c"].to_numpy(), return_counts=True)
    return pa.table({"part": pa.array([table["part"][0].as_py()] * int((c > 0).sum()), pa.int64()),
                     "c": pa.array(c[c > 0]), "n": pa.array(n[c > 0])})


def _rank_words(table: pa.Table, starts: pa.Table) -> pa.Table:
    """Answers: word ids, by falling count (then partition, then word); UNKNOWN
    for words that training does not have."""
    if not table.num_rows:
        return shared.MESSAGE.empty_table()
    total, (at, sizes) = _totals(table)
    c = total["c"].to_numpy()
    order = pc.sort_indices(total, [("c", "ascending"), ("w", "ascending")]).to_numpy()
    ids = np.full(len(c), UNKNOWN, np.int64)
    first = dict(zip(starts["c"].to_pylist(), starts["first"].to_pylist()))
    values, begin = np.unique(c[order], return_index=True)
    for value, a, b in zip(values.tolist(), begin.tolist(), [*begin[1:].tolist(), len(c)]):
        if value:
            ids[order[a:b]] = first[value] + np.arange(b - a)
    out = [x.astype("<u4").tobytes() for x in np.split(ids[at], np.cumsum(sizes)[:-1])]
    return pa.table([table["slice"], table["part"], pa.array([b""] * len(out), pa.binary()),
                     pa.array(out, pa.binary())], schema=shared.MESSAGE)


def _send_stream(parts: int):
    """The slices again: documents, and their words as indices of the slice's distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            docs, _, distinct, at = _read(part)
            home = _parts(distinct.to_pylist(), parts)
            head = np.asarray([len(docs), len(home)], "<i8").tobytes() + docs.tobytes() + home.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shared.slice_key(part)]), pa.array([-1]), pa.array([head], pa.binary()),
                 pa.array([_halves(at)], pa.binary())], schema=shared.MESSAGE)
    return run


_STATS = pa.schema([("kind", pa.int32()), ("slice", pa.int64()), ("blob", pa.binary()), ("v", pa.int64()),
                    ("numbers", pa.list_(pa.int64())), ("mass", pa.float64())])
_STATS_DDL = "kind int, slice long, blob binary, v long, numbers array<long>, mass double"
DOCS, COUNTS, SUMS, BACKOFFS, FREQUENT = range(5)
_BASE = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("held", "u1"), ("tokens", "<i8"), ("known", "<i8"),
                  ("base", "<f8"), ("score", "<f8")])


def _pairs(model, parts: int):
    uni, hot = model

    def run(table: pa.Table) -> pa.Table:
        """Of a slice: base scores, and its word pairs by partition."""
        at = table["part"].to_pylist().index(-1)
        head = table["counts"][at].as_py()
        m, n = np.frombuffer(head, "<i8", 2).tolist()
        docs = np.frombuffer(head, _DOC, m, 16)
        home = np.frombuffer(head, "<u4", n, 16 + m * _DOC.itemsize)
        blob = table["hashes"][at].as_py()
        stream = _whole(blob, len(blob) // 4)
        ids = np.empty(n, np.uint32)
        order = np.argsort(home, kind="stable")
        ends = np.searchsorted(home[order], np.arange(parts + 1))
        for p, blob in zip(table["part"].to_pylist(), table["hashes"].to_pylist()):
            if p >= 0:
                ids[order[ends[p]:ends[p + 1]]] = np.frombuffer(blob, "<u4")
        # the tokens of every text: its words, then the end
        tokens = docs["words"] + 1
        stop = np.cumsum(tokens)
        w = np.empty(int(stop[-1]) if m else 0, np.uint32)
        is_end = np.zeros(len(w), bool)
        is_end[stop - 1] = True
        w[is_end], w[~is_end] = ids[-1], ids[stream]
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[stop - tokens] = START
        doc = np.repeat(np.arange(m), tokens)
        count, p = uni.of(w)
        out = np.zeros(m, _BASE)
        for name in ("doc_id", "null", "held"):
            out[name] = docs[name]
        out["tokens"] = tokens
        out["known"] = np.bincount(doc, weights=count > 0, minlength=m)
        out["base"] = np.bincount(doc, weights=np.log10((count + 1) / (uni.tokens + uni.words + 1)), minlength=m)
        alone = v == UNKNOWN
        out["score"] = np.bincount(doc[alone], weights=np.log10(p[alone]), minlength=m)
        key = table["slice"][0].as_py()
        v, w, doc = v[~alone], w[~alone], doc[~alone]
        train = docs["held"][doc] == 0
        # frequent pairs: a document m, m + 1, ... for each, with the training count
        pair, back, each = np.unique(v.astype(np.uint64) << np.uint64(32) | w, return_inverse=True, return_counts=True)
        many = np.flatnonzero(each >= OFTEN)
        once = each[back] < OFTEN
        weight = np.bincount(back, weights=train, minlength=len(pair)).astype(np.int64)[many]
        place = np.searchsorted(many, back[~once])
        spot, times = np.unique(doc[~once].astype(np.int64) << 32 | place, return_counts=True)
        rows = [(key, -1 - key % parts, np.asarray([len(many), len(spot)], "<i8").tobytes() + spot.astype("<i8").tobytes()
                 + times.astype("<u4").tobytes(), out.tobytes())]
        v = np.concatenate([v[once], (pair[many] >> np.uint64(32)).astype(np.uint32)])
        w = np.concatenate([w[once], (pair[many] & np.uint64(0xFFFFFFFF)).astype(np.uint32)])
        mark = np.concatenate([doc[once] * 2 + train[once], (m + np.arange(len(many))) * 2 + (weight > 0)]).astype(np.uint32)
        weight = np.concatenate([np.ones(int(once.sum()), np.int64), weight])
        mixed = mix64(v.astype(np.uint64) * np.uint64(3) + np.uint64(1))
        often = (v < hot) | (v == START)
        mixed[often] = mix64(mixed[often] ^ w[often])
        home = shared.part_of(mixed, parts)
        order = np.lexsort((w, v, home))
        ends = np.searchsorted(home[order], np.arange(parts + 1))
        for k in range(parts):
            own = order[ends[k]:ends[k + 1]]
            if len(own):
                vs, size = np.unique(v[own], return_counts=True)
                kind = "<u2" if 2 * (m + len(many)) < 1 << 16 else "<u4"
                counted = weight[own[mark[own] >> 1 >= m]]
                rows.append((key, k, np.asarray([len(vs), len(own), int(kind[-1]), m], "<i8").tobytes()
                             + counted.astype("<u4").tobytes(),
                             vs.astype("<u4").tobytes() + size.astype("<u4").tobytes() + _halves(w[own])
                             + mark[own].astype(kind).tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), shared.MESSAGE)], schema=shared.MESSAGE)
    return run


def _pack_sums(docs: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> bytes:
    """Documents of a slice (16 bits where they fit) with their sums, and how
    many of their pairs have each discounted count: a bit for each that is not
    zero, and those numbers alone (8 bits where they fit)."""
    some = counts > 0
    values = counts[some]
    narrow, small = docs.max(initial=0) < 1 << 16, values.max(initial=0) < 1 << 8
    head = np.asarray([len(docs), len(values), narrow, small], "<i4").tobytes()
    return (head + sums.astype("<f8").tobytes() + docs.astype("<u2" if narrow else "<u4").tobytes()
            + np.packbits(some, axis=1).tobytes() + values.astype("<u1" if small else "<u4").tobytes())


def _unpack_sums(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, narrow, small = np.frombuffer(blob, "<i4", 4).tolist()
    sums, at = np.frombuffer(blob, "<f8", n, 16), 16 + 8 * n
    docs = np.frombuffer(blob, "<u2" if narrow else "<u4", n, at)
    at += n * (2 if narrow else 4)
    some = np.unpackbits(np.frombuffer(blob, np.uint8, n, at).reshape(n, 1), axis=1, count=K).astype(bool)
    counts = np.zeros((n, K))
    counts[some] = np.frombuffer(blob, "<u1" if small else "<u4", m, at + n)
    return docs, sums, counts


def _score(model, starts: int):
    """Counting and scoring of a partition of word pairs; ``starts``: training texts."""
    uni, hot = model

    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table["part"][0].as_py() < 0:
            rows = [(DOCS, s, c + b, None, None, None) for s, c, b in
                    zip(*(table[x].to_pylist() for x in ("slice", "counts", "hashes")))]
            return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _STATS)], schema=_STATS)
        v, w, mark, piece, counted = [], [], [], [], []
        for k, (head, blob) in enumerate(zip(table["counts"].to_pylist(), table["hashes"].to_pylist())):
            a, n, width, m = np.frombuffer(head, "<i8", 4).tolist()
            v.append(np.repeat(np.frombuffer(blob, "<u4", a), np.frombuffer(blob, "<u4", a, 4 * a)))
            w.append(_whole(blob, n, 8 * a))
            mark.append(np.frombuffer(blob, f"<u{width}", n, 8 * a + 4 * n).astype(np.uint32))
            piece.append(np.full(n, k, np.int64))
            sent = np.flatnonzero(mark[-1] >> 1 >= m)
            counted.append((v[-1][sent].astype(np.uint64) << np.uint64(32) | w[-1][sent],
                            np.frombuffer(head, "<u4", -1, 32).astype(np.int64)))
        v, w, mark, piece = map(np.concatenate, (v, w, mark, piece))
        key = v.astype(np.uint64) << np.uint64(32) | w
        pair, number = np.unique(key[mark & 1 == 1], return_counts=True)
        for keys, times in counted:         # one of them is in already
            own = times > 0
            np.add.at(number, np.searchsorted(pair, keys[own]), times[own] - 1)
        at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
        c = np.where(pair[at] == key, number[at], 0) if len(pair) else np.zeros(len(key), np.int64)
        del key
        rows.append((COUNTS, 0, None, None, np.bincount(number[number <= K + 1], minlength=K + 2)[1:].tolist(), None))

        # what is known of every context that was seen here: discounted pairs, mass of the words after it
        context = (pair >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(pair) else np.zeros(0, int)
        seen = context[first]
        slot = np.repeat(np.arange(len(seen)), np.diff(np.r_[first, len(pair)]))
        few = np.zeros((len(seen), K), np.int64)
        low = number <= K
        np.add.at(few, (slot[low], number[low] - 1), 1)
        mass = np.bincount(slot, weights=uni.of((pair & np.uint64(0xFFFFFFFF)).astype(np.int64))[1], minlength=len(seen))
        shared_context = (seen < hot) | (seen == START)
        for k in np.flatnonzero(shared_context).tolist():
            rows.append((FREQUENT, 0, None, int(seen[k]), few[k].tolist(), float(mass[k])))

        # seen pairs: score without discount, and how many of each discounted count; others: p(w), alpha later
        total = np.where(v == START, starts, uni.of(v.astype(np.int64))[0]) + 1
        found = c > 0
        part = np.where(found, np.log10(np.maximum(c, 1) / total), np.log10(uni.of(w.astype(np.int64))[1]))
        doc = piece << 32 | (mark >> 1)
        places, slot = np.unique(doc, return_inverse=True)
        sums = np.bincount(slot, weights=part)
        counts = np.zeros((len(places), K), np.uint32)
        low = found & (c <= K)
        np.add.at(counts, (slot[low], c[low] - 1), 1)
        ends = np.searchsorted(places, np.arange(table.num_rows + 1) << 32)
        for k, s in enumerate(table["slice"].to_pylist()):
            a, b = ends[k], ends[k + 1]
            rows.append((SUMS, s, _pack_sums(places[a:b] & 0xFFFFFFFF, sums[a:b], counts[a:b]), None, None, None))
        # contexts of unseen pairs by document
        lost = np.flatnonzero(~found)
        if len(lost):
            where = np.minimum(np.searchsorted(seen, v[lost]), max(len(seen) - 1, 0))
            known = (seen[where] == v[lost]) if len(seen) else np.zeros(len(lost), bool)
            own = ~((v[lost] < hot) | (v[lost] == START))
            lv, back = np.unique(v[lost], return_inverse=True)
            table_few, table_mass = np.zeros((len(lv), K), np.int64), np.zeros(len(lv))
            pick = known & own
            table_few[back[pick]], table_mass[back[pick]] = few[where[pick]], mass[where[pick]]
            slices = np.asarray(table["slice"].to_pylist(), np.int64)
            rows.append((BACKOFFS, 0, np.asarray([len(lv), len(lost)], "<i8").tobytes() + lv.astype("<u4").tobytes()
                         + table_few.astype("<u4").tobytes() + table_mass.tobytes() + back.astype("<u4").tobytes()
                         + slices[piece[lost]].tobytes() + (mark[lost] >> 1).astype("<u4").tobytes(), None, None, None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _STATS)], schema=_STATS)
    return run


def backoff_weight(few: np.ndarray, mass: np.ndarray, total: np.ndarray, d: np.ndarray, least: float) -> np.ndarray:
    """alpha of contexts: ``few`` has how many of their pairs have each count
    up to K, ``mass`` the probability of the words seen after them, ``total``
    their own count."""
    r = np.arange(1, K + 1)
    gap = np.zeros(K)
    gap[:len(d) - 1] = (1 - d[1:]) * r[:len(d) - 1]
    return (1 + few @ gap) / (total + 1) / np.maximum(1 - mass, least)


def _back_off(model, starts: int, d: np.ndarray, frequent: dict[int, tuple[list[int], float]]):
    uni, _ = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                nv, n = np.frombuffer(blob, "<i8", 2).tolist()
                v = np.frombuffer(blob, "<u4", nv, 16)
                few = np.frombuffer(blob, "<u4", nv * K, 16 + 4 * nv).reshape(nv, K).astype(np.int64)
                mass = np.frombuffer(blob, "<f8", nv, 16 + (4 + 4 * K) * nv).copy()
                at = 16 + (12 + 4 * K) * nv
                back = np.frombuffer(blob, "<u4", n, at)
                slices = np.frombuffer(blob, "<i8", n, at + 4 * n)
                doc = np.frombuffer(blob, "<u4", n, at + 12 * n)
                for k, x in enumerate(v.tolist()):
                    if x in frequent:
                        few[k], mass[k] = frequent[x]
                total = np.where(v == START, starts, uni.of(v.astype(np.int64))[0])
                log = np.log10(backoff_weight(few, mass, total, d, uni.p_unknown))[back]
                order = np.argsort(slices, kind="stable")
                values, begin = np.unique(slices[order], return_index=True)
                out = []
                for s, a, b in zip(values.tolist(), begin.tolist(), [*begin[1:].tolist(), n]):
                    own = order[a:b]
                    docs, slot = np.unique(doc[own], return_inverse=True)
                    out.append((SUMS, s, _pack_sums(docs, np.bincount(slot, weights=log[own]),
                                                    np.zeros((len(docs), K), np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in
                                                  enumerate((pa.int32(), pa.int64(), pa.binary()))],
                                                 names=["kind", "slice", "blob"])
    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_RESULT_DDL = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
               "score double")


def _finish(tokens: int, d: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        blob = table["blob"][kinds.index(DOCS)].as_py()
        many, n = np.frombuffer(blob, "<i8", 2).tolist()
        spot, times = np.frombuffer(blob, "<i8", n, 16), np.frombuffer(blob, "<u4", n, 16 + 8 * n)
        docs = np.frombuffer(blob, _BASE, -1, 16 + 12 * n)
        score, gap = np.concatenate([docs["score"], np.zeros(many)]), np.zeros(K)
        gap[:len(d) - 1] = np.log10(d[1:])
        for kind, blob in zip(kinds, table["blob"].to_pylist()):
            if kind == SUMS:
                doc, sums, counts = _unpack_sums(blob)
                score[doc] += sums + counts @ gap
        np.add.at(score, spot >> 32, times * score[len(docs) + (spot & 0xFFFFFFFF)])
        score = score[:len(docs)]
        return pa.table([pa.array(docs["doc_id"], mask=docs["null"].astype(bool)), pa.array(docs["held"].astype(bool)),
                         pa.array(docs["tokens"]), pa.array(docs["known"]),
                         pa.array(np.full(len(docs), tokens, np.int64)), pa.array(docs["base"]), pa.array(score)],
                        schema=_RESULT)
    return run


def katz_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Needs ``doc_id`` and ``text``; other columns are not read. Learns from all
    documents whose CRC-32 of the doc_id is not HELD_OUT modulo FOLDS (a null
    doc_id counts as empty text there and is learned from). A null, empty or
    blank text is the end token alone. Repeated rows count each time. Without
    training tokens the unknown word has probability 1; an empty table gives an
    empty result. A word's count is exact (words are compared, not hashes).
    """
    spark = docs.sparkSession
    parts = 2 * shuffle_partitions(spark)
    slim = docs.select(F.monotonically_increasing_id().alias("row_key"),
                       docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))

    words, words_path = stored(slim.mapInArrow(_send_words(parts), shared.MESSAGE_DDL), "words")
    by_part = words.groupBy("part")
    counts = reliable_checkpoint(by_part.applyInArrow(_count_words, "part long, c long, n long"))
    # distinct counts: fewer than sqrt(2 N) of N tokens
    steps = [(r["c"], r["n"]) for r in counts.groupBy("c").agg(F.sum("n").alias("n")).collect()]
    uni = Unigrams(steps)
    if uni.words >= UNKNOWN:
        raise ValueError("more distinct words than 32-bit ids")
    starts = slim.agg(F.sum((F.coalesce(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast(
        "binary")), F.lit(FOLDS)), F.lit(0)) != HELD_OUT).cast("long"))).first()[0] or 0
    model = (uni, uni.frequent(uni.tokens / (2 * parts)))       # fewer than 2 * parts frequent contexts

    base = spark.createDataFrame([(int(c), int(f)) for c, f in zip(uni.count, uni.first)], "c long, base long")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.join(base, "c").select("part", "c", (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
                                          .alias("first"))
    ranked = by_part.cogroup(first.groupBy("part")).applyInArrow(_rank_words, shared.MESSAGE_DDL)
    stream = slim.mapInArrow(_send_stream(parts), shared.MESSAGE_DDL)
    pairs = ranked.unionByName(stream).groupBy("slice").applyInArrow(_pairs(model, parts), shared.MESSAGE_DDL)
    stats = through_table(pairs.groupBy("part").applyInArrow(_score(model, starts), _STATS_DDL), "pairs")
    discard(spark, words_path)

    sums = [F.sum(F.element_at("numbers", r)).alias(f"n{r}") for r in range(1, K + 2)]
    row = stats.where(F.col("kind") == COUNTS).agg(*sums).first()
    d = discounts({r: row[f"n{r}"] or 0 for r in range(1, K + 2)})
    frequent = {r["v"]: ([r[f"n{k}"] for k in range(1, K + 1)], r["mass"]) for r in
                stats.where(F.col("kind") == FREQUENT).groupBy("v").agg(*sums[:K], F.sum("mass").alias("mass")).collect()}
    slim_stats = ["kind", "slice", "blob"]
    later = stats.where(F.col("kind") == BACKOFFS).select(*slim_stats).mapInArrow(
        _back_off(model, starts, d, frequent), "kind int, slice long, blob binary")
    return (stats.where(F.col("kind").isin(DOCS, SUMS)).select(*slim_stats).unionByName(later)
            .groupBy("slice").applyInArrow(_finish(uni.tokens, d), _RESULT_DDL))
