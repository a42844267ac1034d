"""Words of Arrow texts as numpy arrays: places, lines and xxh64 hashes, without a Python object a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
                             0x27D4EB2F165667C5)]
_LONG = 32              # from so many bytes on xxh64 has another form: such words are hashed one at a time
_BLOCK = 1 << 15        # elements that are mixed at a time: they stay in the processor's cache

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """``mix64(x ^ salt)``, some elements at a time."""
    out = np.bitwise_xor(x, np.uint64(salt))
    held = np.empty(min(_BLOCK, len(out)), np.uint64)
    for at in range(0, len(out), _BLOCK):
        own = out[at:at + _BLOCK]
        t = held[:len(own)]
        own ^= np.right_shift(own, np.uint64(30), out=t)
        own *= np.uint64(0xBF58476D1CE4E5B9)
        own ^= np.right_shift(own, np.uint64(27), out=t)
        own *= np.uint64(0x94D049BB133111EB)
        own ^= np.right_shift(own, np.uint64(31), out=t)
    return out


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (and the last one ends). A null text has none."""
    text = pc.fill_null(text, "").cast(pa.string())
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word (runs of anything but ASCII white space inside a text), and the byte behind it."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= ~word[:-1]
    begin = np.flatnonzero(word & edge[:-1])
    edge[:] = False
    edge[offsets] = True
    edge[1:-1] |= ~word[1:]
    return begin, np.flatnonzero(word & edge[1:]) + 1


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxh64(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The public xxh64 (seed 0) of the bytes [begin, end), words of one length at a time."""
    import xxhash

    p1, p2, p3, p4, p5 = _P
    length = end - begin
    out = np.empty(len(begin), np.uint64)
    order = np.argsort(np.minimum(length, _LONG).astype(np.uint8), kind="stable")
    ends = np.searchsorted(length[order], np.arange(_LONG + 1)) if len(order) else np.zeros(_LONG + 1, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    halves = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    for size in range(_LONG):
        of = order[ends[size]:ends[size + 1]]
        if not len(of):
            continue
        at, done = begin[of], 0
        h = np.full(len(of), p5 + np.uint64(size), np.uint64)
        while size - done >= 8:
            h ^= _rotated(lanes[at + done] * p2, 31) * p1
            h = _rotated(h, 27) * p1 + p4
            done += 8
        if size - done >= 4:
            h ^= halves[at + done].astype(np.uint64) * p1
            h = _rotated(h, 23) * p2 + p3
            done += 4
        for k in range(done, size):
            h ^= data[at + k].astype(np.uint64) * p5
            h = _rotated(h, 11) * p1
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        out[of] = h ^ h >> np.uint64(32)
    for k in order[ends[_LONG]:].tolist():
        out[k] = xxhash.xxh64_intdigest(data[begin[k]:end[k]].tobytes())
    return out


def scanned(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of the texts, A-Z lower-cased: row, line (numbered over
    all texts, blank ones too, so that next ones differ by one), hash."""
    data, offsets = text_bytes(text)
    data = _LOWER[data]
    begin, end = word_places(data, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(begin, offsets)))
    lines = np.searchsorted(np.flatnonzero(data == 10), begin) + rows
    return rows, lines, xxh64(data, begin, end)
