"""Dedup, language model, classifier and the pipeline against plain versions."""

import collections
import math
import re
import zlib

import pytest

import corpus_pipeline
from ledgerlens.llm import classifier, components, exact, jaccard, katz, repetition, substring
from llm.corpora import corpus, frame, lowered, words_of


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


# --- exact dedup -------------------------------------------------------------------------------

def plain_exact(rows):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[bare(t)].append((d, t))
    out = []
    for g in groups.values():
        best = min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0]))
        out += [(d, best[0], len(g)) for d, t in g]
    return collections.Counter(out)


def test_exact_groups(docs, wide, rows, none):
    for df in (docs, wide):
        got = exact.progressive_groups(df).collect()
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == plain_exact(rows)
        kept = [r for r in got if r.kept]
        assert len(kept) == len({bare(t) for _, t, *_ in rows})
        assert all(r.doc_id == r.keep_id for r in kept)
    assert exact.keep_one(wide).columns == wide.columns
    assert exact.keep_one(wide).count() == len({bare(t) for _, t, *_ in rows})
    assert exact.progressive_groups(none).count() == 0


def test_exact_groups_with_hot_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ledgerlens.llm.common.HOT_LEAST", 1)
    monkeypatch.setattr("ledgerlens.llm.common.HOT_PARTS", 4)
    monkeypatch.setattr(exact, "BROADCAST_BYTES", 0)
    rows = [(k, "same text" if k % 2 else f"other {k % 8}", "en", "s", 1) for k in range(200)]
    got = exact.progressive_groups(frame(spark, rows, tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == plain_exact(rows)


# --- n-gram Jaccard join -----------------------------------------------------------------------

def shingles(text, width=5):
    w = words_of(lowered(text))
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def plain_components(rows):
    sets, u = [shingles(t) for _, t, *_ in rows], Union()
    for a in range(len(rows)):
        u.find(a)
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                u.join(a, b)
    names = {}
    for k, (d, *_) in enumerate(rows):
        names.setdefault(u.find(k), []).append(d)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in names.items()}
    return collections.Counter((d, len(sets[k]), name[u.find(k)]) for k, (d, *_) in enumerate(rows))


def test_jaccard_components(docs, wide, rows, none):
    for df in (docs, wide):
        got = jaccard.jaccard_components(df).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)
    assert jaccard.keep_one(wide).columns == wide.columns
    assert jaccard.jaccard_components(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_keep_one_tells_components_apart(spark, tmp_path):
    """One doc_id on unrelated texts, and near copies that have no doc_id."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    near = lambda c: text(c).replace(f"{c}59", "other")
    rows = [(1, text("a"), "en", "s", 0), (1, text("b"), "en", "s", 0), (2, near("b"), "en", "s", 0),
            (None, text("c"), "en", "s", 0), (None, near("c"), "en", "s", 0), (None, text("d"), "en", "s", 0)]
    got = collections.Counter((r.doc_id, r.text[0]) for r in jaccard.keep_one(frame(spark, rows, tmp_path)).collect())
    assert got == collections.Counter([(1, "a"), (1, "b"), (None, "c"), (None, "d")])


def test_intersections(monkeypatch):
    import numpy as np

    monkeypatch.setattr(components, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(25)]
    assert components.intersections(sets).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]


@pytest.mark.parametrize("rounds,block,as_pairs", [(0, 2, True), (0, 2, False), (1, 1000, False)])
def test_jaccard_chains_and_large_groups(spark, tmp_path, monkeypatch, rounds, block, as_pairs):
    """Chains of near copies whose ends are not alike, hot buckets, and blocks of two rows."""
    plain = jaccard.linked_components
    monkeypatch.setattr(jaccard, "linked_components", lambda *a: plain(*a[:-2], rounds, as_pairs))
    monkeypatch.setattr(components, "BLOCK", block)
    monkeypatch.setattr("ledgerlens.llm.common.HOT_LEAST", 1)
    monkeypatch.setattr("ledgerlens.llm.common.HOT_PARTS", 5)
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(24):
        text = base[2 * k:2 * k + 60]
        rows.append((100 - k, " ".join(text), "en", "s", 1))
    rows += [(200 + k, " ".join([*base[:59], f"z{k}"]), "en", "s", 1) for k in range(12)]
    got = jaccard.jaccard_components(frame(spark, rows, tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    exp = {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 200: 200, 201: 200}
    assert got == exp
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- substring dedup ---------------------------------------------------------------------------

def test_repeated_passages_go(spark, rows, wide, none):
    got = substring.remove_repeats(wide).collect()
    assert substring.without_repeats(wide).columns == wide.columns
    assert len(got) == len(rows) and substring.remove_repeats(none).count() == 0
    text = {(d, t): None for d, t, *_ in rows}
    window = 50

    def windows(t):
        w = words_of(lowered(t))
        return {tuple(w[k:k + window]) for k in range(len(w) - window + 1)}

    before, after = collections.Counter(), collections.Counter()
    for _, t, *_ in rows:
        before.update(windows(t))
    for r in got:
        after.update(windows(r.text))
    assert any(n > 1 for n in before.values()) and all(n == 1 for w, n in after.items())
    # every segment of 16 words that was there is still somewhere
    small = lambda t: {tuple(words_of(lowered(t))[k:k + 5]) for k in range(len(words_of(t)) - 4)}
    kept = set().union(*[small(r.text) for r in got])
    lost = set().union(*[small(t) for _, t, *_ in rows]) - kept
    assert len(lost) < 0.02 * len(kept)
    # texts without any repeated run stay as they are
    run = collections.Counter()
    for _, t, *_ in rows:
        w = words_of(lowered(t))
        run.update(tuple(w[k:k + 10]) for k in range(len(w) - 9))
    for r in got:
        if r._ll_removed == 0:
            assert (r.doc_id, r.text) in text and not r._ll_spans
        else:
            assert r._ll_spans and r._ll_removed >= substring.MIN_LINE


def test_near_equal_lines_and_clean_texts(spark, tmp_path):
    line = " ".join(f"w{k}" for k in range(100))
    edit = line.replace("w50 ", "other ")
    rows = [(1, "first\n" + line, "en", "s", 0), (2, edit + "\nsecond", "en", "s", 0),
            (3, " ".join(f"v{k}" for k in range(100)), "en", "s", 0), (4, "short line said often", "en", "s", 0),
            (5, "short line said often", "en", "s", 0)]
    got = {r.doc_id: r.text for r in substring.remove_repeats(frame(spark, rows, tmp_path)).collect()}
    assert got[1] == rows[0][1] and got[2].strip() == "second"
    assert got[3] == rows[2][1] and got[4] == got[5] == "short line said often"


def junk(d, n=40):
    return " ".join(f"j{d}x{k}" for k in range(n))


def test_phrases_of_different_texts_stay(spark, tmp_path):
    """Every 15 words of a clean text are in some earlier text, 16 words in none."""
    w = [f"w{k}" for k in range(60)]
    rows = [(k, f"{junk(k)} {' '.join(w[k:k + 15])} {junk(k + 100)}", "en", "s", 0) for k in range(46)]
    rows.append((500, f"{junk(500)} {' '.join(w)} {junk(501)}", "en", "s", 0))
    assert {r._ll_removed for r in substring.remove_repeats(frame(spark, rows, tmp_path)).collect()} == {0}


def test_what_stays_for_another_text_stays_whole(spark, tmp_path):
    """Halves of a passage are in earlier texts; their joint has to stay in one of the two texts that have it."""
    w = [f"w{k}" for k in range(60)]
    rows = [(d, f"{junk(d)} {' '.join(x)} {junk(d + 100)}", "en", "s", 0) for d, x in
            enumerate([w[:34], w[26:], w, w])]
    got = {r.doc_id: r for r in substring.remove_repeats(frame(spark, rows, tmp_path)).collect()}
    assert got[3]._ll_removed >= 40 and sum(" ".join(w[25:36]) in r.text for r in got.values()) == 1


def test_wrapped_paragraphs_and_short_lines(spark, tmp_path):
    """Near-equal paragraphs over short lines, near-equal chunks inside long lines, lines of 5 to 15 words."""
    w = [f"w{k}" for k in range(40)]
    wrap = lambda x, n: "\n".join(" ".join(x[k:k + n]) for k in range(0, len(x), n))
    edit = ["other" if k == 2 else x for k, x in enumerate(w)]
    rows = [(1, f"{junk(1)}\n\n{wrap(w, 10)}\n\n{junk(2)}", "en", "s", 0),
            (2, f"{junk(3)}\n\n{wrap(edit, 7)}\n\n{junk(4)}", "en", "s", 0),
            (3, junk(5) + "\nsix words of one short line", "en", "s", 0),
            (4, junk(6) + "\nsix words of one short line", "en", "s", 0)]
    got = {r.doc_id: r.text for r in substring.remove_repeats(frame(spark, rows, tmp_path)).collect()}
    assert got[1] == rows[0][1] and got[2].split() == f"{junk(3)} {junk(4)}".split()
    assert got[3] == rows[2][1] and got[4].strip() == junk(6)


def test_a_slice_sends_a_hash_once():
    import pyarrow as pa

    part = pa.RecordBatch.from_pydict({"row_key": list(range(50)), "text": [junk(1, 100)] * 50})
    message = next(substring._send(4, 16)(iter([part]))).to_pydict()
    sent = sum(len(b) // 4 for p, b in zip(message["part"], message["hashes"]) if p >= 0)
    assert sent == len(set(substring.Units(part.column("text"), 16).entries()[1].tolist()))


def test_bands_reach_the_recall():
    for rows in (1, 2, 4, 6):
        bands = substring.tuned_bands(0.8, rows, 0.99)
        assert 1 - (1 - 0.8 ** rows) ** bands >= 0.99 and (bands == 1 or 1 - (1 - 0.8 ** rows) ** (bands - 1) < 0.99)


# --- Katz --------------------------------------------------------------------------------------

def plain_katz(rows):
    texts = [(d, zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2, [*words_of(lowered(t)), "</s>"])
             for d, t, *_ in rows]
    one, two, starts = collections.Counter(), collections.defaultdict(collections.Counter), 0
    for _, held, w in texts:
        if not held:
            starts += 1
            one.update(w)
            for a, b in zip(["<s>", *w[:-1]], w):
                two[a][b] += 1
    n, v = sum(one.values()), len(one)
    d1 = katz.discounts(collections.Counter(one.values()))
    d2 = katz.discounts(collections.Counter(x for f in two.values() for x in f.values()))
    cut = lambda d, r: d[r] if r < len(d) else 1.0
    p1 = {w: cut(d1, c) * c / (n + 1) for w, c in one.items()}
    unknown = 1 - math.fsum(p1.values())
    total = lambda a: starts if a == "<s>" else one[a]

    def p(a, b):
        if a != "<s>" and a not in one:
            return p1.get(b, unknown)
        c = two[a][b] if a in two else 0
        if c:
            return cut(d2, c) * c / (total(a) + 1)
        seen = two.get(a, {})
        over = 1 - math.fsum(cut(d2, c) * c / (total(a) + 1) for c in seen.values())
        return over / (1 - math.fsum(p1[w] for w in seen)) * p1.get(b, unknown)

    for a in [*list(two)[:25], "never seen"]:
        assert abs(math.fsum(p(a, b) for b in [*one, "never seen"]) - 1) < 1e-9
    return [(d, held, len(w), sum(x in one for x in w), n,
             math.fsum(math.log10((one[x] + 1) / (n + v + 1)) for x in w),
             math.fsum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w))) for d, held, w in texts]


def test_katz_scores(wide, rows, none):
    order = lambda x: (x[0] is None, x[0] or 0, x[2], round(x[6], 6))
    got = sorted([tuple(r) for r in katz.katz_scores(wide).collect()], key=order)
    exp = sorted(plain_katz(rows), key=order)
    assert len({x[1] for x in exp}) == 2
    for a, b in zip(got, exp, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6
    assert katz.katz_scores(none).count() == 0


def test_katz_tiny_tables(spark, tmp_path):
    rows = [(2, "a b a b a b a b", "en", "s", 0), (4, None, "en", "s", 0), (4, "", "en", "s", 0), (9, "a q a q", "en", "s", 0)]
    got = sorted(tuple(r) for r in katz.katz_scores(frame(spark, rows, tmp_path)).collect())
    for a, b in zip(got, sorted(plain_katz(rows)), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 and abs(a[6] - b[6]) < 1e-9


def test_katz_sends_a_frequent_pair_once(spark, tmp_path):
    """A pair that is most of the corpus, in training and held-out texts, and one that held-out texts alone have."""
    sizes, plain = [], katz._pairs

    def pairs(model, parts):
        def run(table):
            out = plain(model, parts)(table)
            for head, part in zip(out["counts"].to_pylist(), out["part"].to_pylist()):
                if part >= 0:
                    sizes.append(int.from_bytes(head[8:16], "little"))
            return out
        return run

    held = [d for d in range(40) if zlib.crc32(str(d).encode()) % 7 == 2]
    rows = [(d, "junk " * 300 + f"a{d} b c", "en", "s", 0) for d in range(40)]
    rows += [(held[0], "only here " * 1200, "en", "s", 0), (held[1], "b a1 " * 100, "en", "s", 0)]
    got = sorted(tuple(r) for r in katz.katz_scores(frame(spark, rows, tmp_path)).collect())
    for a, b in zip(got, sorted(plain_katz(rows)), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6
    # a slice of the same kind, by hand: all occurrences of the pair are one entry
    import numpy as np
    import pyarrow as pa

    docs = np.zeros(3, katz._DOC)
    docs["words"] = 1000
    head = np.asarray([3, 2], "<i8").tobytes() + docs.tobytes() + np.zeros(2, "<u4").tobytes()
    table = pa.table({"slice": [0, 0], "part": [-1, 0], "counts": pa.array([head, b""], pa.binary()),
                      "hashes": pa.array([np.zeros(3000, "<u4").tobytes(), np.asarray([0, 1], "<u4").tobytes()],
                                         pa.binary())})
    pairs((katz.Unigrams([(3000, 1), (3, 1)]), 0), 1)(table)
    assert sum(sizes) < 3 * 3


# --- classifier --------------------------------------------------------------------------------

def test_classifier(spark, tmp_path, none):
    rows = [(d, t if d % 3 else "*** ".join(words_of(t)), s, s, n) for d, t, s, _, n in corpus(300)[:300]]
    df = frame(spark, rows + [(None, None, None, None, None), (5000, "", "x", "x", 0)], tmp_path)
    labels = spark.createDataFrame([(d, 1 if d % 3 else 0) for d, *_ in rows] + [(None, 1), (7000, None)],
                                   "doc_id long, quality int")
    got = classifier.quality_scores(df, labels).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {
        d: zlib.crc32(str(d).encode()) % 5 == 0 for d in [*range(300), 5000]}
    held = [(r.score, r.doc_id % 3 > 0) for r in got if r.held_out and r.doc_id < 300]
    assert min(s for s, good in held if good) > max(s for s, good in held if not good)
    assert classifier.quality_scores(none, labels).count() == 0
    assert {r.score for r in classifier.quality_scores(df, labels.where("false")).collect()} == {0.5}


# --- pipeline ----------------------------------------------------------------------------------

def test_pipeline_stages(spark, rows, wide, tmp_path):
    docs, seen = wide, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, "").write.parquet(out)
        seen[name] = spark.read.parquet(out)
        if k < 4:
            assert seen[name].columns == wide.columns
        docs = seen[name]
    ids = lambda name: collections.Counter(r.doc_id for r in seen[name].collect())
    good = [(d, t) for d, t, *_ in rows if repetition_kept(t)]
    assert ids("quality rules") == collections.Counter(d for d, _ in good)
    kept = [r for r in exact_survivors(good)]
    assert ids("exact dedup") == collections.Counter(d for d, _ in kept)
    comps = {}
    for (d, n, c), times in plain_components([(d, t) for d, t in kept]).items():
        comps.setdefault(c if c is not None else object(), []).append(d)
    assert sum(ids("n-gram Jaccard join").values()) == len(comps)
    assert ids("substring dedup") == ids("n-gram Jaccard join")
    last = seen["packing"].groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in last) <= 2048
    assert {r.doc_id for r in seen["packing"].collect()} == set(ids("substring dedup"))


def repetition_kept(text):
    import pyarrow as pa

    return bool(repetition.verdict(repetition.measure(pa.array([text], pa.string())))[1][0])


def exact_survivors(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[bare(t)].append((d, t))
    return [min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0])) for g in groups.values()]


def test_pipeline_of_nothing(spark, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
