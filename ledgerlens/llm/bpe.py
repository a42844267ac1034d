"""BPE encoding and decoding with tree concatenation.

Ordinary pre-tokens are encoded by the tokenizers library's model, each
distinct one about once per task. A pre-token too long for that (text without any split point) is cut
in halves down to leaves; leaves are encoded on their own, and at every join
the tokens around it are encoded again in a window that grows until its outer
tokens are those which both sides already had.

Why that is exact: byte-pair merging takes the lowest rank first, leftmost
first. A sequence of tokens is the encoding of its text if and only if every
two neighbours are the encoding of theirs, as the first merge to cross a
border would cross it in the pair alone, too. Inside either side all
neighbours agree; a window whose first and last token are unchanged agrees
with what lies beyond it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import released, released_group, text_slices

LEAF = 4096                 # symbols of a leaf
LONG_TEXT = 1 << 18         # code points; longer texts are spread over tasks
PIECE = 1 << 16             # code points of a piece of a long text
CACHED_KEYS = 500_000       # per worker process; the cache is emptied beyond it
CACHED_LENGTH = 64

#: Fixed values. In texts of these Latin-1 characters alone, normalisation is lower-casing,
#: and the vocabulary's pre-token pattern is this one (letters, digits, other signs).
SAFE = bytes(range(9, 14)) + bytes(range(32, 127)) + bytes(range(0xC0, 0xD7)) + bytes(range(0xD8, 0xF7)) + bytes(
    range(0xF8, 0x100))
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff\s]+")
#: The public byte-level alphabet: printable bytes stand for themselves, the others for 256, 257 and so on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}

RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                    ("decoded_sha256", pa.string())])
RESULT_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file, as the installed package names it."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBpe:
    """Encoder for a BPE vocabulary whose pre-tokenizer drops white space and
    whose words end in a suffix, so that texts can be encoded part by part
    (words are runs of anything but ASCII white space; no normalisation and no
    pre-token reaches over that)."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf = leaf
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: for text that ends a pre-token, and for text inside one
        self.last = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"])
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.token = [self.tok.id_to_token(i) for i in range(vocab)]

    # one pre-token, in the byte-level alphabet -------------------------------------------------
    def _model(self, text: str, ends: bool) -> list[int]:
        return [t.id for t in (self.last if ends else self.inner).tokenize(text)] if text else []

    def _text(self, ids: list[int], ends: bool) -> str:
        text = "".join(self.token[i] for i in ids)
        return text[:-len("</w>")] if ends else text

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """Tokens of the concatenation of two encoded neighbours; ``ends``:
        the right one ends its pre-token."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            at_end = ends and j == len(right)
            mid = self._model(self._text(left[-i:], False) + self._text(right[:j], at_end), at_end)
            good_left = i == len(left) or mid[0] == left[-i]
            good_right = j == len(right) or mid[-1] == right[j - 1]
            if good_left and good_right:
                return left[:-i] + mid + right[j:]
            i, j = (i if good_left else 2 * i), (j if good_right else 2 * j)

    def tree(self, parts: list[list[int]], ends: bool) -> list[int]:
        """Join encoded neighbours pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1], ends and k + 2 >= len(parts)) if k + 1 < len(parts)
                     else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def leaves(self, text: str) -> list[str]:
        """Halves of halves of a pre-token, down to ``leaf`` symbols."""
        n = 1
        while len(text) > n * self.leaf:
            n *= 2
        cuts = [len(text) * k // n for k in range(n + 1)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]

    def pre_tokens(self, word: str) -> Iterator[str | int]:
        """Pre-tokens of a word as the library makes them; ids for special tokens."""
        for part in (self.special_re.split(word) if self.special_re else [word]):
            if part in self.special:
                yield self.special[part]
            elif part:
                norm = self.tok.normalizer.normalize_str(part)
                yield from (p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm))

    def long_word(self, word: str) -> list[int]:
        ids: list[int] = []
        for p in self.pre_tokens(word):
            if isinstance(p, int):
                ids.append(p)
            else:
                cut = self.leaves(p)
                ids += self.tree([self._model(x, k + 1 == len(cut)) for k, x in enumerate(cut)], True)
        return ids

    # texts -------------------------------------------------------------------------------------
    def split(self, text: str) -> list:
        """Keys of a text's parts in order, for ``ids_for``: pre-tokens (str)
        where every character is in SAFE, else words (bytes)."""
        try:
            plain = not text.encode("latin-1").translate(None, SAFE) and "<|" not in text
        except UnicodeEncodeError:
            plain = False
        if plain and len(text) <= self.leaf:
            return PRE_TOKEN.findall(text.lower())
        if plain:
            cut = PRE_TOKEN.findall(text.lower())
            if max(map(len, cut), default=0) <= self.leaf // 2:
                return cut
        return text.encode().split()

    def ids_for(self, key) -> list[int]:
        if isinstance(key, bytes):
            return self.long_word(key.decode())
        return self._model(key if key.isascii() else key.encode().decode("latin-1").translate(BYTE_LEVEL), True)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return np.asarray([i for key in self.split(text) for i in self.ids_for(key)], np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """As decode(ids, skip_special_tokens=False): the vocabulary names no
        decoder, and then the library puts one space between tokens."""
        return " ".join([self.token[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str, leaf: int = LEAF) -> WordBpe:
    """One encoder per worker process and vocabulary file."""
    return WordBpe(path, leaf)


class Cache(dict):
    """What ``make`` gives for a key of ``WordBpe.split``, kept until it holds
    CACHED_KEYS of them (longer keys are not kept)."""

    def __init__(self, bpe: WordBpe, make):
        super().__init__()
        self.bpe, self.make = bpe, make

    def __missing__(self, key):
        value = self.make(self.bpe.ids_for(key))
        if len(key) <= CACHED_LENGTH:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > CACHED_KEYS:
            self.clear()


@lru_cache(maxsize=2)
def _digest_cache(path: str, leaf: int) -> Cache:
    bpe = encoder(path, leaf)
    return Cache(bpe, lambda ids: (" ".join(map(str, ids)), bpe.decode(ids)) if ids else None)


@lru_cache(maxsize=2)
def _bytes_cache(path: str, leaf: int) -> Cache:
    return Cache(encoder(path, leaf), lambda ids: np.asarray(ids, "<u4").tobytes())


def id_bytes(text: str | None, path: str, leaf: int = LEAF) -> bytes:
    """Ids of a whole text as little-endian 32-bit numbers (null: none)."""
    cache = _bytes_cache(path, leaf)
    out = b"".join(map(cache.__getitem__, cache.bpe.split(text or "")))
    cache.trim()
    return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _short_task(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            bpe, both = encoder(path, leaf), _digest_cache(path, leaf)
            n, ids, dec = [], [], []
            for text in part.column("text").to_pylist():
                found = list(filter(None, map(both.__getitem__, bpe.split(text or ""))))
                joined = " ".join([x[0] for x in found])
                n.append(joined.count(" ") + 1 if joined else 0)
                ids.append(_sha(joined))
                dec.append(_sha(" ".join([x[1] for x in found])))
                both.trim()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(dec)], schema=RESULT)
    return run


WORDS, SPECIAL, LEAF_INNER, LEAF_LAST = range(4)
_PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("kind", pa.int8()),
                     ("text", pa.string())])
_PIECES_DDL = "row long, doc_id long, seq long, kind byte, text string"
_CODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("kind", pa.int8()),
                    ("ids", pa.binary())])
_CODED_DDL = "row long, doc_id long, seq long, kind byte, ids binary"


def cut_text(bpe: WordBpe, text: str, piece: int = PIECE) -> Iterator[tuple[int, str]]:
    """Pieces of a long text in order: stretches of whole words, and the
    leaves of each pre-token of words that are longer than a piece."""
    raw, at, limit = text.encode(), 0, piece
    held: list[bytes] = []
    size = 0
    for w in raw.split():
        if len(w) <= limit:
            held.append(w)
            size += len(w) + 1
            if size > limit:
                yield WORDS, b" ".join(held).decode()
                held, size = [], 0
            continue
        if held:
            yield WORDS, b" ".join(held).decode()
            held, size = [], 0
        for p in bpe.pre_tokens(w.decode()):
            if isinstance(p, int):
                yield SPECIAL, str(p)
                continue
            cut = bpe.leaves(p)
            for k, x in enumerate(cut):
                yield (LEAF_LAST if k + 1 == len(cut) else LEAF_INNER), x
    if held:
        yield WORDS, b" ".join(held).decode()


def _cut_task(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                out, size = [], 0
                for seq, (kind, piece) in enumerate(cut_text(encoder(path, leaf), text)):
                    out.append((row, doc, seq, kind, piece))
                    size += len(piece)
                    if size > 1 << 22 or len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)],
                                                         schema=_PIECES)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)],
                                                     schema=_PIECES)
    return run


def _code_task(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpe, ids = encoder(path, leaf), []
            for kind, text in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist()):
                if kind == WORDS:
                    x = bpe.encode(text)
                elif kind == SPECIAL:
                    x = np.asarray([int(text)], np.uint32)
                else:
                    x = np.asarray(bpe._model(text, kind == LEAF_LAST), np.uint32)
                ids.append(x.astype("<u4").tobytes())
            cols = [batch.column(c) for c in ("row", "doc_id", "seq", "kind")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())], schema=_CODED)
    return run


def assemble(bpe: WordBpe, pieces: list[tuple[int, list[int]]]) -> list[int]:
    """Ids of a text from its encoded pieces in order; runs of leaves are joined by the tree."""
    out: list[int] = []
    run: list[list[int]] = []
    for kind, ids in pieces:
        if kind in (LEAF_INNER, LEAF_LAST):
            run.append(ids)
            if kind == LEAF_LAST:
                out += bpe.tree(run, True)
                run = []
        else:
            out += ids
    return out


def _join_task(path: str, leaf: int):
    def run(table: pa.Table) -> pa.Table:
        bpe = encoder(path, leaf)
        table = table.sort_by("seq")
        pieces = [(k, np.frombuffer(b, "<u4").tolist())
                  for k, b in zip(table["kind"].to_pylist(), table["ids"].to_pylist())]
        ids = assemble(bpe, pieces)
        return pa.table([table["doc_id"].slice(0, 1), pa.array([np.asarray(ids, "<u4").tobytes()], pa.binary())],
                        schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))
    return run


def long_text_ids(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids: little-endian 32-bit) of the rows of ``docs`` (doc_id,
    text), whose texts are cut into pieces that other tasks encode. A row is
    known by its place in the scan, so repeated doc_ids stay apart; the pieces
    of one text meet again in one task, as the text itself did."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    pieces = rows.mapInArrow(released(_cut_task(path, leaf)), _PIECES_DDL)
    coded = (pieces.repartition("row", "seq").mapInArrow(released(_code_task(path, leaf)), _CODED_DDL))
    return coded.groupBy("row").applyInArrow(released_group(_join_task(path, leaf)), "doc_id long, ids binary")


def split_by_length(docs: DataFrame, long_text: int = LONG_TEXT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of the texts up to ``long_text`` code points (null ones too), and of the others."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > long_text
    return slim.where(~is_long), slim.where(is_long)


def _digest_task(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpe = encoder(path, leaf)
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(raw, "<u4").tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc], pa.int64()), pa.array([len(ids)], pa.int64()),
                     pa.array([_sha(" ".join(map(str, ids)))]), pa.array([_sha(bpe.decode(ids))])], schema=RESULT)
    return run


def encode_digests(docs: DataFrame, path: str | None = None, leaf: int = LEAF,
                   long_text: int = LONG_TEXT) -> DataFrame:
    """Encode and decode every whole text; count of ids and the digests.

    Reads ``doc_id`` and ``text`` only. A null or empty text has no ids (the
    digests are those of the empty string); null doc_ids and repeated rows are
    kept as they are; an empty table gives an empty one. Texts up to
    ``long_text`` code points are encoded where they are read, without a
    shuffle; those beyond it are cut into pieces that are encoded in parallel.
    Inside either, a pre-token over ``leaf`` symbols goes through the tree.
    """
    path = path or vocabulary()
    short, long_ = split_by_length(docs, long_text)
    return (short.mapInArrow(released(_short_task(path, leaf)), RESULT_DDL)
            .unionByName(long_text_ids(long_, path, leaf).mapInArrow(released(_digest_task(path, leaf)), RESULT_DDL)))
