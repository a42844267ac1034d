"""Plain versions of the paragraph dedup and of the classifier, and of what components are made of."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import classifier, components, exact, jaccard, substring
from ledgerlens.llm.common import mix64, word_hashes
from llm.corpora import SCHEMA, corpus, frame, lowered, words_of
from llm.test_corpus import Union


# --- paragraph dedup ---------------------------------------------------------------------------

def plain_borders(words, reach):
    h = [int(x) for x in word_hashes(pa.array(words))] if words else []
    value = [int(mix64(np.array([(a * 3 % 2 ** 64) ^ b], np.uint64))[0]) for a, b in zip(h, h[1:])] + [None]
    out = []
    for i in range(len(words)):
        near = [value[i] is not None]
        for k in range(1, reach + 1):
            if value[i] is not None and i - k >= 0:
                near.append(value[i] < value[i - k])
            if value[i] is not None and i + k < len(words):
                near.append(value[i + k] is None or value[i] <= value[i + k])
        if i == 0 or all(near):
            out.append(i)
    return out


def plain_units(text, min_run):
    """(kind, start, length, key, forms): key is the run's words, or the span's set of 5-word shingles."""
    words = words_of(lowered(text))
    cuts = [*plain_borders(words, substring.REACH), len(words)]
    runs = []
    for i, a in enumerate(cuts[:-1]):
        end = next((b for b in cuts[i + 1:] if b - a >= min_run), None)
        if end is not None:
            runs.append((0, a, end - a, tuple(words[a:end])))
    lines, at = [], 0
    for line in lowered(text).split("\n"):
        lines.append((at, at + len(words_of(line))))
        at = lines[-1][1]
    forms, tops, begin = collections.defaultdict(set), set(), None
    for a, b in lines:
        if 5 <= b - a < substring.WRAPPED:
            forms[a, b].add("line")
    for a, b in [*lines, (at, at)]:         # a blank, a long line or the end closes what is open
        if 0 < b - a < substring.WRAPPED:
            begin = a if begin is None else begin
            continue
        for x, y in ([(begin, a)] if begin is not None else []) + ([(a, b)] if b > a else []):
            tops.add(x)
            if y - x >= 5:
                forms[x, y].add("paragraph")
        begin = None
    cuts = sorted({*plain_borders(words, substring.FAR), *tops, len(words)})
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= min_run:
            forms[a, b].add("chunk")
    shingles = lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    runs = [(0, a, n, key, {"run"}) for _, a, n, key in runs]
    return runs + [(1, a, b - a, shingles(words[a:b]), f) for (a, b), f in sorted(forms.items())]


def plain_without_repeats(rows, min_run=16):
    units = [(k, u) for k, row in enumerate(rows) for u in plain_units(row[1], min_run)]
    u = Union()
    linked = set()
    for x, (_, (kind, _, _, key, form)) in enumerate(units):
        u.find(x)
        for y in range(x):
            _, (other, _, _, key2, form2) = units[y]
            # spans of one form; small sets have no form
            if kind != other or not (form & form2 or (kind and len(key) <= substring.SMALL)):
                continue
            if key == key2 if kind == 0 else 100 * len(key & key2) >= 80 * len(key | key2):
                u.join(x, y)
                linked |= {x, y}
    equal = {}
    for x in linked:                        # repeated spans with equal sets are one class, whatever their forms
        kind, key = units[x][1][0], units[x][1][3]
        u.join(x, equal.setdefault((kind, key if kind == 0 else frozenset(key)), x))
    groups = collections.defaultdict(list)
    for x in range(len(units)):
        groups[u.find(x)].append(x)
    found = collections.defaultdict(list)
    for members in groups.values():
        place = lambda x: (rows[units[x][0]][0] is None, rows[units[x][0]][0] or 0, units[x][0], units[x][1][1], -units[x][1][2])
        low = max(units[x][1][1] for x in members)
        end = min(units[x][1][1] + units[x][1][2] for x in members)
        if len(members) < 2 or (len({units[x][0] for x in members}) == 1 and low < end):
            continue
        first = min(members, key=place)
        for x in members:
            k, (kind, a, n, _, _) = units[x]
            found[k].append((kind, a, n, x == first))
    out = []
    for k, row in enumerate(rows):
        words = words_of(row[1])
        mark = [0] * (len(words) + 1)
        for kind, keeps, value in ((1, False, 1), (1, True, -1), (0, False, 1), (0, True, -1)):
            for kd, a, n, stays in found[k]:
                if (kd, stays) == (kind, keeps):
                    mark[a:a + n] = [value] * n
        left, i = [], 0
        while i < len(words):
            j = i
            while j < len(words) and mark[j] == 1:
                j += 1
            beside = (i and mark[i - 1] == -1) or mark[j] == -1
            if j > i and (j - i >= min_run or not beside):
                i = j
                continue
            left += words[i:max(j, i + 1)]
            i = max(j, i + 1)
        out.append((row[0], tuple(left)))
    return collections.Counter(out)


@pytest.mark.parametrize("seed", [5, 23])
def test_paragraph_dedup_against_all_pairs(spark, tmp_path, seed):
    """Units, exact Jaccard of all pairs, union-find and cutting in plain Python give the same texts."""
    rows = corpus(40, seed)
    got = substring.remove_repeats(frame(spark, rows, tmp_path)).collect()
    assert collections.Counter((r.doc_id, tuple(words_of(r.text))) for r in got) == plain_without_repeats(rows)
    assert sum(r._ll_removed > 0 for r in got) > 8


def test_spans_over_each_other_are_no_repeat(spark, tmp_path):
    """A line that is nearly its paragraph, and a chunk that is nearly its line, in one text alone: nothing goes."""
    w = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(w[:23]) + "\ntwo words\n\n" + " ".join(w[30:]), "en", "s", 0)]
    assert [r._ll_removed for r in substring.remove_repeats(frame(spark, rows, tmp_path)).collect()] == [0]


# --- names that clash, and ids at the ends of the range -----------------------------------------

def test_names_of_their_own(spark, tmp_path):
    rows = corpus(12)[:14] + [(-2 ** 63, "the same text twice over", "en", "s", 1), (2 ** 63 - 1, "the same text twice over", "en", "s", 1)]
    df = frame(spark, rows, tmp_path).selectExpr("*", "1 as _ll_row", "2 as _ll_row_", "3 as _LL_removed", "4 as _ll_spans", "5 as _ll_stretches")
    for keep in (exact.keep_one, jaccard.keep_one, substring.without_repeats):
        out = keep(df)
        assert out.columns == df.columns and {r._ll_row_ for r in out.collect()} == {2}
    kept = {r.doc_id for r in exact.keep_one(df).collect()}
    assert -2 ** 63 in kept and 2 ** 63 - 1 not in kept


# --- components ----------------------------------------------------------------------------------

@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components(spark, monkeypatch, one_task):
    import random

    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rnd = random.Random(2)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(40)]
    links += [(5000, 5001 + k) for k in range(50)] + [(7, 7)]
    u = Union()
    for a, b in links:
        u.join(a, b)
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in {x for a, b in links if a != b for x in (a, b)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- classifier ----------------------------------------------------------------------------------

def test_ftrl_against_the_plain_loop():
    """Follow-the-regularised-leader with its sums written out, one feature after the other."""
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(40, rng.integers(1, 9), replace=False)), int(rng.random() < 0.4)) for _ in range(300)]
    model = classifier.Ftrl(64)
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    bias = 64

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == bias else (classifier.L1, classifier.L2)      # the constant has no penalty
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((classifier.BETA + math.sqrt(n[i])) / classifier.ALPHA + l2)

    for cols, label in rows:
        vals = np.full(len(cols), 1 / math.sqrt(len(cols)), np.float32)
        model.learn(cols.astype(np.int64), vals, label)
        x = [*zip(cols.tolist(), vals.tolist()), (bias, 1.0)]
        w = {i: weight(i) for i, _ in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
        for i, v in x:
            g = (p - label) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / classifier.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
    got = model.weights(np.arange(65))
    assert np.allclose(got, [weight(i) for i in range(65)], atol=1e-6) and np.abs(got).max() > 0.1


def test_one_text_of_a_doc_id_teaches(spark, tmp_path):
    """A labelled doc_id on many rows weighs as one."""
    word = lambda c, k: " ".join(f"{c}{(k * 7 + j) % 50}" for j in range(30))
    rows = [(k, word("good" if k % 2 else "bad", k), "en", "s", 0) for k in range(1, 120)]
    marks = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 120)], "doc_id long, quality int, toxic int")
    folder = lambda n: (tmp_path / n).mkdir() or tmp_path / n
    once = frame(spark, rows, folder("a"))
    more = frame(spark, rows + [rows[1]] * 300, folder("b"))
    a = {r.doc_id: r.score for r in classifier.quality_scores(once, marks).collect()}
    b = {r.doc_id: r.score for r in classifier.quality_scores(more, marks).collect()}
    assert a == pytest.approx(b)


def test_distinct_pairs_in_their_order():
    from ledgerlens.llm.common import distinct_in_row, distinct_of_rows

    rng = np.random.default_rng(8)
    rows = np.sort(rng.integers(0, 50, 4000))
    hashes = rng.integers(0, 60, 4000).astype(np.uint64) << np.uint64(20)      # equal in the shortened form
    hashes[2000:] = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
    a, b = distinct_of_rows(rows, hashes)
    assert (np.diff(a) >= 0).all() and len(a) == len(set(zip(rows.tolist(), hashes.tolist())))
    order = np.lexsort((b, a))
    assert all((x == y).all() for x, y in zip((a[order], b[order]), distinct_in_row(rows, hashes)))
    assert [len(x) for x in distinct_of_rows(rows[:0], hashes[:0])] == [0, 0]
