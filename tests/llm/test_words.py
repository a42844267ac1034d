"""Words, units and merged stretches of op10 as arrays, against plain versions."""

import random

import numpy as np
import pyarrow as pa

from ledgerlens.llm import substring
from ledgerlens.llm.common import word_hashes, word_lists

_CHARS = "abAZ \n\t\x0b\x0c\r\x85\xa0é漢\U0001F600"


def odd_texts(seed=4):
    rng = random.Random(seed)
    longer = ["w" * n for n in (*range(1, 36), 5000)]
    return [None, "", " \n", " ".join(longer), *longer,
            *("".join(rng.choice(_CHARS) for _ in range(rng.randint(0, 90))) for _ in range(300))]


def test_scanned_words_are_the_listed_ones():
    import pyarrow.compute as pc

    from ledgerlens.llm.words import scanned

    for text in (pa.array(odd_texts(), pa.string()), pa.array(odd_texts(), pa.string()).slice(3, 90), pa.array([], pa.string()),
                 pa.array([None, ""], pa.string()), pa.array(odd_texts(), pa.large_string())):
        rows, line, hashes = scanned(text)
        want_rows, words = word_lists(pc.ascii_lower(text))
        assert rows.tolist() == want_rows.tolist() and hashes.tolist() == word_hashes(words).tolist()
        want = [k for t in text.to_pylist() for k, x in enumerate((t or "").split("\n"))
                for _ in range(len(word_lists(pa.array([x]))[1]))]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])[np.cumsum(np.r_[True, rows[1:] != rows[:-1]]) - 1] if len(rows) else []
        base = [line[f] - want[f] for f in first]
        assert (line - np.asarray(base, np.int64)).tolist() == want


def test_a_word_is_mixed_once_for_a_band_value(monkeypatch):
    """Lines, paragraphs and chunks over the same words share what is computed a shingle (they were mixed apart)."""
    rng = random.Random(1)
    text = ["\n".join(" ".join(f"v{rng.randrange(9999)}" for _ in range(20)) for _ in range(50)) for _ in range(20)]
    done = []

    def counted(mix):
        return lambda x, *salt: done.append(len(x)) or mix(x, *salt)
    for name in ("mix64", "mixed"):
        if hasattr(substring, name):
            monkeypatch.setattr(substring, name, counted(getattr(substring, name)))
    units = substring.Units(pa.array(text), 16)
    units.entries()
    n = 20 * 50 * 20
    assert set(units.forms.tolist()) >= {0, substring.LINE, substring.PARAGRAPH} and sum(units.length[units.forms > 0]) > 2 * n
    assert sum(done) < 1.5 * n * substring.BANDS * substring.BAND_ROWS


def test_sets_and_digests_of_spans_that_repeat_inside():
    rng = random.Random(2)
    text = ["\n".join(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(9)) for _ in range(40)]
    units = substring.Units(pa.array([*text, *text]), 3)
    own, digests, seen = np.flatnonzero(units.kind == substring.SPAN), units.digest(2), {}
    bands = units.bands(own)
    for k, u in enumerate(own.tolist()):
        words = text[units.row[u] % len(text)].split()[units.start[u]:units.start[u] + units.length[u]]
        sets = frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))
        assert units.size[u] == len(sets) == len(set(units.set_of(u).tolist()))
        assert seen.setdefault(sets, (int(digests[u]), bands[k].tolist())) == (int(digests[u]), bands[k].tolist())
    assert len({d for d, _ in seen.values()}) == len(seen)
    runs, known = units.digest(1), {}
    for u in np.flatnonzero(units.kind == substring.RUN).tolist():
        words = text[units.row[u] % len(text)].split()[units.start[u]:units.start[u] + units.length[u]]
        assert known.setdefault(tuple(words), int(runs[u])) == int(runs[u])
    assert len(set(known.values())) == len(known)


def test_stretches_are_the_painted_words():
    rng = random.Random(3)
    rows, packed, want = [], [], []
    for row in range(60):
        units = [(rng.randrange(2), rng.randrange(80), rng.randint(1, 30), rng.random() < 0.4) for _ in range(rng.randint(1, 12))]
        gone = [0] * 120
        for run, keeps, value in ((False, False, 1), (False, True, -1), (True, False, 1), (True, True, -1)):
            for kind, s, n, stays in units:
                if (kind == substring.RUN) == run and stays == keeps:
                    gone[s + 1:s + n + 1] = [value] * n
        begin = [k for k in range(1, 120) if gone[k] == 1 != gone[k - 1]]
        end = [k for k in range(1, 120) if gone[k] != 1 == gone[k - 1]]
        want += [(row, a - 1, b - 1) for a, b in zip(begin, end) if b - a >= 16 or (gone[a - 1] >= 0 and gone[b] >= 0)]
        rows += [row] * len(units)
        packed += [s << 33 | n << 2 | kind << 1 | stays for kind, s, n, stays in units]
    got = substring._stretches(np.asarray(rows), np.asarray(packed, np.int64), 16)
    assert want and list(zip(*(x.tolist() for x in got))) == want
    lists = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([[p for r, p in zip(rows, packed) if r == row] for row in range(60)])],
                                       names=["row_key", "units"])
    for limit in (1, 300, 1 << 21):
        substring_words, substring.WORDS = substring.WORDS, limit
        try:
            out = [(key, *x) for b in substring._merge(16)(iter([lists])) for key, blob in zip(b["row_key"].to_pylist(), b["bits"].to_pylist())
                   for x in np.frombuffer(blob, "<i4").reshape(-1, 2).tolist()]
        finally:
            substring.WORDS = substring_words
        assert out == want


def test_cut_texts_and_offsets():
    texts = ["é one  two \t three\nfour", None, "a b", "", "漢 x y z \nq"]
    blobs = [np.array([[1, 3]], "<i4").tobytes(), None, None, None, np.array([[0, 1], [2, 3]], "<i4").tobytes()]
    text, spans, words = substring._cut(pa.array(texts, pa.string()), pa.array(blobs, pa.binary()))
    assert text.to_pylist() == ["é three\nfour", None, "a b", "", "x y \nq"]
    assert spans.to_pylist() == [[[2, 13]], [], [], [], [[0, 2], [6, 8]]] and words.to_pylist() == [2, 0, 0, 0, 2]
    nothing = substring._cut(pa.array([], pa.string()), pa.array([], pa.binary()))
    assert [len(x) for x in nothing] == [0, 0, 0]
