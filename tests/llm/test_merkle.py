"""Merkle manifest against a plain tree."""

import collections
import zlib
from hashlib import sha256

from ledgerlens.llm import merkle
from llm.corpora import corpus, frame, lowered


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    d, text, lang, source, n = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def fold(levels, at, digest):
    """Root with another leaf, and the siblings on the way."""
    seen = []
    for level in levels[:-1]:
        low = at // 16 * 16
        run = level[low:low + 16]
        seen += run[:at - low] + run[at - low + 1:]
        run[at - low] = digest
        digest, at = h(*run), at // 16
    return digest, seen


def plain(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(by[s], key=lambda r: (r[0] is None, r[0] or 0, leaf_of(r)))
        trees.append((own, levels_of([leaf_of(r) for r in own])))
    top = levels_of([t[-1][0] for _, t in trees])
    out = []
    for k, (own, tree) in enumerate(trees):
        for at, row in enumerate(own):
            d, text, lang, source, n = row
            leaf = leaf_of(row)
            hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
            now = leaf_of((d, None if text is None else lowered(text), lang, source, n)) if hit else leaf
            sub, first = fold(tree, at, now)
            root, second = fold(top, k, sub)
            out.append((d, leaf, tree[-1][0], top[-1][0], h(*first, *second), root, root == top[-1][0]))
    return collections.Counter(out)


def of(df, **settings):
    return collections.Counter(tuple(r) for r in merkle.audit(merkle.manifest(df, **settings)).collect())


def test_manifest(docs, wide, rows, none):
    assert of(docs) == plain(rows) and of(wide) == plain(rows)
    assert merkle.manifest(none).count() == 0


def test_manifest_of_one_row(spark, tmp_path):
    for row in ((1, "One Text", "en", "s", 8), (None, None, None, None, None)):
        folder = tmp_path / str(row[0])
        folder.mkdir()
        assert of(frame(spark, [row], folder)) == plain([row])


def test_manifest_of_several_passes(spark, tmp_path, monkeypatch):
    """Blocks of one level: a large source, more sources than a run holds, and source names that sort bytewise."""
    monkeypatch.setattr(merkle, "GROUP", 0.5)
    rows = [(k, f"Text {k}", "en", "hot", k) for k in range(600)]
    rows += [(1000 + k, f"Other {k}", None, f"s{k % 290}", None) for k in range(310)]
    rows += [(2000 + k, "x", "en", s, 1) for k, s in enumerate(["", None, "é", "z", "Z", "\U0001F600", "�"])]
    df = frame(spark, rows, tmp_path)
    want = plain(rows)
    assert of(df, height=1) == want
    assert sum(c for r, c in want.items() if not r[-1]) > 100


def test_versions_share_untouched_nodes(spark, rows, docs):
    found = merkle.manifest(docs)
    nodes = collections.defaultdict(dict)
    for r in merkle.version_nodes(found).collect():
        nodes[r.tree, r.idx][r.height] = r.digest
    tampered = [r for r in found.collect() if r.tampered]
    assert len(nodes) == len(tampered) > 5
    for r in tampered:
        assert list(nodes[r.tree, r.idx].values()) == r.version and (r.version[0] != r.leaf) == (r.version[-1] != r.root)
