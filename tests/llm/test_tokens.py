"""Repetition rules, tokenizing, packing and sharding against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlens.llm import bpe, packing, repetition, sharding, token_output
from llm.corpora import words_of


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


# --- repetition rules --------------------------------------------------------------------------

def plain_rules(text):
    w, text = words_of(text), text or ""
    chars = [len(x) for x in w]

    def windows(n, first):
        seen, cover = collections.Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)), set()
        met = set()
        for i in range(len(w) - n + 1):
            x = tuple(w[i:i + n])
            if seen[x] > 1 and (first or x in met):
                cover.update(range(i, i + n))
            met.add(x)
        return cover

    lines = [x for x in text.split("\n") if words_of(x)]
    met, dup_chars = set(), 0
    for x in lines:
        if x in met:
            dup_chars += sum(map(len, words_of(x)))
        met.add(x)
    out = {"n_words": len(w), "word_chars": sum(chars), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
           "n_dup_lines": len(lines) - len(met), "n_repeat_words": len(windows(3, True)), "n_lines": len(lines),
           "dup_line_chars": dup_chars}
    for n in repetition.WINDOW_LIMITS:
        out[f"dup_chars_{n}"] = sum(chars[i] for i in windows(n, False))
    out["base_failed"] = len(w) < 50 or 100 * out["n_repeat_words"] > 50 * len(w)
    bad = (out["n_dup_lines"] > 0.3 * len(lines) or dup_chars > 0.2 * sum(chars) or out["n_symbols"] > 0.1 * len(w)
           or any(100 * out[f"dup_chars_{n}"] > round(100 * x) * sum(chars) for n, x in repetition.WINDOW_LIMITS.items()))
    out["kept"] = not out["base_failed"] and not bad
    return out


def test_repetition_rules(docs, rows, none):
    got = key([tuple(r) for r in repetition.repetition_rules(docs).collect()])
    names = repetition.SCHEMA.names
    exp = key([(d, *[plain_rules(t)[c] for c in names[1:]]) for d, t, *_ in rows])
    assert got == exp
    assert len({r[names.index("kept")] for r in got}) == 2
    assert repetition.repetition_rules(none).count() == 0


def test_windows_survive_equal_hashes():
    ids = np.asarray([1, 2, 3, 1, 2, 4, 1, 2, 3])
    at = np.arange(7)
    again, later = repetition.repeated_windows(ids, np.zeros(7, np.uint64), at, 3)
    assert np.flatnonzero(again).tolist() == [0, 6] and np.flatnonzero(later).tolist() == [6]


def test_keep_good_keeps_columns(wide, rows):
    got = repetition.keep_good(wide)
    assert got.columns == wide.columns
    assert got.count() == sum(plain_rules(t)["kept"] for _, t, *_ in rows)


# --- BPE ---------------------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digest(library, doc, text):
    ids = ids_of(library, text)
    return doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("leaf,long_text", [(bpe.LEAF, bpe.LONG_TEXT), (64, 300)])
def test_digests_match_the_library(docs, rows, library, leaf, long_text):
    """The second case sends most texts through pieces, leaves and tree joins in several tasks."""
    got = key([tuple(r) for r in bpe.encode_digests(docs, leaf=leaf, long_text=long_text).collect()])
    assert got == key([plain_digest(library, d, t) for d, t, *_ in rows])


def test_empty_table(none):
    assert bpe.encode_digests(none).count() == 0 and packing.pack_documents(none).count() == 0
    assert sharding.feistel_shards(none).count() == 0 and token_output.packed_rows(none).count() == 0


@pytest.mark.parametrize("letters", ["ab", "aaaaab", "éàüß", "日本語", "01234", "!?.$", "abcdefghijklmnop's", "İΣςſK"])
def test_tree_concatenation_is_exact(library, letters):
    rnd = random.Random(letters)
    coder = bpe.WordBpe(bpe.vocabulary(), leaf=8)
    for n in (1, 7, 30, 100, 300):
        for text in ("".join(rnd.choice(letters) for _ in range(n)), letters * n):
            for whole in (text, text + "<|endoftext|>" + text, text + " " + text):
                exp = ids_of(library, whole)
                assert [i for w in whole.split(" ") for i in coder.long_word(w)] == exp
                assert coder.encode(whole).tolist() == exp
                pieces = [(k, coder.encode(x).tolist() if k == bpe.WORDS else [int(x)] if k == bpe.SPECIAL
                           else coder._model(x, k == bpe.LEAF_LAST)) for k, x in bpe.cut_text(coder, whole, 12)]
                assert bpe.assemble(coder, pieces) == exp
                assert coder.decode(exp) == library.decode(exp, skip_special_tokens=False)


# --- packing -----------------------------------------------------------------------------------

def check_pieces(got, rows, library, size):
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    exp = collections.defaultdict(collections.Counter)
    for d, t, *_ in rows:
        ids = np.asarray([*ids_of(library, t), 1], "<u4")
        for at in range(0, len(ids), size):
            exp[d][(at, len(ids[at:at + size]), zlib.crc32(ids[at:at + size].tobytes()), len(ids))] += 1
    for d, found in by_doc.items():
        assert collections.Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == exp[d]
    assert set(by_doc) == set(exp)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("size", [2048, 64])
def test_shortest_pack_first_documents(docs, rows, library, size):
    got = packing.pack_documents(docs, size=size).collect()
    n = check_pieces(got, rows, library, size)
    total = sum(len(ids_of(library, t)) + 1 for _, t, *_ in rows)
    assert n <= 1.1 * total / size + 2


def test_shortest_pack_first_histograms():
    rnd = random.Random(2)
    for _ in range(100):
        size = rnd.choice([8, 64, 2048])
        h = {k: rnd.choice([1, 2, 3, 50, 10**9]) for k in rnd.sample(range(1, size + 1), min(size, rnd.choice([1, 5, 200])))}
        got = collections.Counter()
        for pattern, count in packing.shortest_pack_first(h, size):
            assert count > 0 and sum(a * b for a, b in pattern) <= size
            for length, each in pattern:
                got[length] += each * count
        assert got == h


def test_best_fit_decreasing_matches_a_plain_search():
    rnd = random.Random(4)
    for _ in range(60):
        size = rnd.choice([10, 64, 100])
        lengths = [rnd.randint(1, size) for _ in range(rnd.choice([1, 5, 80]))]
        rows = token_output.best_fit_decreasing(lengths, size)
        assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
        assert all(sum(lengths[k] for k in r) <= size for r in rows)
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = min((x for x in rooms if x >= n), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((size if fit is None else fit) - n)
        assert sorted(rooms) == sorted(size - sum(lengths[k] for k in r) for r in rows)


def test_packed_rows_round_trip(wide, rows, library):
    got = collections.defaultdict(list)
    for r in token_output.packed_rows(wide, size=128, block_bytes=4000).collect():
        ids, pos, cu = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2"), r.cu_seqlens
        assert len(ids) == len(pos) == 128 and cu[0] == 0 and cu[-1] == r.n_tokens
        assert (ids[r.n_tokens:] == 49407).all() and not pos[r.n_tokens:].any()
        for k, (d, s) in enumerate(zip(r.doc_ids, r.starts)):
            assert pos[cu[k]:cu[k + 1]].tolist() == list(range(cu[k + 1] - cu[k]))
            got[d].append((s, tuple(ids[cu[k]:cu[k + 1]].tolist())))
    exp = collections.defaultdict(list)
    for d, t, *_ in rows:
        ids = [*ids_of(library, t), 49407]
        exp[d] += [(at, tuple(ids[at:at + 128])) for at in range(0, len(ids), 128)]
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in exp.items()}


def test_blocks_of_empty_texts_are_bounded(spark):
    df = spark.createDataFrame([(k, None if k % 2 else "") for k in range(600)], "doc_id long, text string")
    pieces = collections.Counter()
    for r in token_output.packed_rows(df, size=128, block_bytes=4000).collect():
        pieces[r.block] += len(r.doc_ids)
    assert sum(pieces.values()) == 600 and max(pieces.values()) <= 3 * 4000 // token_output.PIECE_BYTES


# --- sharding ----------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n, seed=9)
    place = f.place(np.arange(n))
    assert sorted(place) == list(range(n)) and (f.number(place) == np.arange(n)).all()
    assert (f.at(place % 24, place // 24, 24) == np.arange(n)).all()


def test_shards(wide, rows):
    got = sharding.feistel_shards(wide, shards=7).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    raw = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows]
    assert key([(r.doc_id, r.size, r.text_crc32) for r in got]) == key(raw)
    f = sharding.Feistel(len(rows))
    assert all(f.at(r.shard, r.slot, 7) == r.row_number for r in got)
    numbers = sorted(got, key=lambda r: r.row_number)
    assert [r.row_number for r in numbers] == list(range(len(rows)))
    ids = [r.doc_id for r in numbers]
    assert ids == sorted(ids, key=lambda d: (d is None, d))
