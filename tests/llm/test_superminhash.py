"""SuperMinHash signatures and near-duplicate groups against plain versions."""

import collections
import random

import numpy as np
import pytest

from ledgerlens.llm import components, superminhash
from ledgerlens.llm.common import mix64
from llm.corpora import frame
from llm.test_corpus import Union, shingles


def plain_signature(elements, m):
    """The published loop, one element after the other, with its permutation in full."""
    out = [None] * m
    for e in elements:
        p = list(range(m))
        for i in range(m):
            x = int(mix64(np.array([(int(e) + (i + 1) * 0x9E3779B97F4A7C15) % 2 ** 64], np.uint64))[0])
            k = i + ((x & 0xFFFFFF) * (m - i) >> 24)
            p[i], p[k] = p[k], p[i]
            value = (i << 40) | (x >> 24)
            if out[p[i]] is None or value < out[p[i]]:
                out[p[i]] = value
    return out


@pytest.mark.parametrize("m", [1, 8, 32])
def test_signatures(m):
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 3, 17, 150)]
    rows = np.concatenate([np.full(len(s), k) for k, s in enumerate(sets)])
    got = superminhash.signatures(rows, np.concatenate(sets), len(sets) + 1, m)
    assert [r.tolist() for r in got[:-1]] == [plain_signature(s, m) for s in sets]
    assert (got[-1] == np.iinfo(np.uint64).max).all()
    twice = superminhash.signatures(np.r_[rows, rows], np.concatenate(sets * 2), len(sets) + 1, m)
    assert (twice == got).all()


def test_estimate_varies_less_than_independent_hashes():
    rng = np.random.default_rng(9)
    m, n, same = 64, 90, 60
    errors = []
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 2 * n - same).astype(np.uint64)
        rows = np.r_[np.zeros(n, int), np.ones(n, int)]
        sig = superminhash.signatures(rows, np.r_[x[:n], x[n - same:]], 2, m)
        errors.append((sig[0] == sig[1]).mean() - same / (2 * n - same))
    j = same / (2 * n - same)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.85 * j * (1 - j) / m


def test_spanning_forest():
    rnd = random.Random(3)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    node, root = superminhash.spanning_forest(*map(np.array, zip(*links)))
    u = Union()
    for a, b in links:
        u.join(a, b)
    assert dict(zip(node.tolist(), root.tolist())) == {x: u.find(x) for x in {x for l in links for x in l} if u.find(x) != x}


def plain(rows, width=2):
    sets, u = [shingles(t, width) for _, t, *_ in rows], Union()
    for a in range(len(rows)):
        u.find(a)
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                u.join(a, b)
    names = collections.defaultdict(list)
    for k, (d, *_) in enumerate(rows):
        names[u.find(k)].append(d)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in names.items()}
    return collections.Counter((d, len(sets[k]), name[u.find(k)]) for k, (d, *_) in enumerate(rows))


def of(df):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in superminhash.near_duplicates(df).collect())


def test_groups(docs, wide, rows, none):
    assert of(docs) == plain(rows) and of(wide) == plain(rows)
    assert superminhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("rounds,one_task", [(0, 1 << 20), (1, 0), (10, 1 << 20)])
def test_chains_hot_buckets_and_short_texts(spark, tmp_path, monkeypatch, rounds, one_task):
    """A chain of edits whose ends are not alike, a large family of near copies, and texts of one to six words; with
    the prefix filter alone, one round of pivots (and components by star steps), or as many as it takes."""
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    plain_groups = superminhash.grouped_nodes
    monkeypatch.setattr(superminhash, "grouped_nodes", lambda *a: plain_groups(*a, rounds))
    monkeypatch.setattr(superminhash, "BLOCK", 4)
    monkeypatch.setattr("ledgerlens.llm.common.HOT_LEAST", 1)
    monkeypatch.setattr("ledgerlens.llm.common.HOT_PARTS", 4)
    rnd = random.Random(8)
    vocab = [f"w{k}" for k in range(400)]
    base = [rnd.choice(vocab) for _ in range(120)]
    rows, chain = [], list(base)
    for k in range(25):
        rows.append((100 - k, " ".join(chain), "en", "s", 0))
        for at in rnd.sample(range(120), 5):
            chain[at] = rnd.choice(vocab)
    family = [rnd.choice(vocab) for _ in range(150)]
    for k in range(60):
        copy = list(family)
        for at in rnd.sample(range(150), rnd.randint(0, 12)):
            copy[at] = rnd.choice(vocab)
        rows.append((200 + k, " ".join(copy), "en", "s", 0))
    short = ["a", "a", "A b", "a b c", "a b c d e f", "a b c d e f g", "a b", "b a"]
    rows += [(300 + k, t, "en", "s", 0) for k, t in enumerate(short)]
    got, want = of(frame(spark, rows, tmp_path)), plain(rows)
    assert got == want and len({c for _, _, c in want}) < len(rows) - 60
