import itertools
import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from dittograph.llm import line_crf as C

from .conftest import prose


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    model = C.Model(np.zeros(C.FEATURES), r.normal(size=(2, 2)), r.normal(size=2))
    doc = np.repeat(np.arange(4), [1, 5, 3, 7])
    score = r.normal(size=16) * 2
    got, pairs, _, logz = C.marginals(score, doc, model, True)
    want, want_pairs, want_z = np.zeros(16), np.zeros((2, 2)), 0.0
    for d in range(4):
        at = np.flatnonzero(doc == d)
        weights = {}
        for y in itertools.product((0, 1), repeat=len(at)):
            weights[y] = np.exp(model.start[y[0]] + sum(score[k] * v for k, v in zip(at, y)) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        want_z += np.log(z)
        for y, w in weights.items():
            want[at] += np.array(y) * w / z
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / z
    assert got == pytest.approx(want) and pairs.sum(0) == pytest.approx(want_pairs) and logz == pytest.approx(want_z)


def sample(n, start):
    good = [(start + k, prose(start + k, 40 + k % 50)) for k in range(n)]
    bad = []
    for k in range(n):
        t = prose(start + 5000 + k, 40 + k % 50)
        bad.append((start + 100_000 + k, [" | ".join(t.split()), t.upper().replace(" ", "!! "), t.replace(" ", "*** "), "\n".join([t.split("\n")[0]] * 9)][k % 4]))
    return good, bad


@pytest.fixture(scope="module")
def model(spark, make):
    good, bad = sample(120, 0)
    labels = spark.createDataFrame([*((i, 1) for i, _ in good), *((i, 0) for i, _ in bad), (None, 1), (77_777, None)], "doc_id long, quality int")
    return C.train(make([*good, *bad, (None, "x"), (999, None)]), labels)


def test_held_out_accuracy(make, model):
    good, bad = sample(80, 20_000)
    rows = C.scored(make([*good, *bad]), model).select("doc_id", "quality").collect()
    assert np.mean([(r.quality >= C.THRESHOLD) == (r.doc_id < 100_000) for r in rows]) >= 0.95
    kept = {r.doc_id for r in C.kept(make([*good, *bad]), model).collect()}
    assert len(kept & {i for i, _ in good}) >= 79


def test_odd_rows(odd, nothing, model):
    out = C.scored(odd, model)
    assert set(out.columns) == {*odd.columns, "lines", "bad_lines"}
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        if not (r.text or "").strip():
            assert (r.quality, r.lines, r.bad_lines) == (0, 0, 0)
        else:
            assert 0 <= r.quality <= 1 and r.lines == sum(bool(x.strip(" \t\r")) for x in r.text.split("\n"))
    assert C.kept(odd, model).columns == odd.columns
    assert C.scored(nothing, model).collect() == []


def test_without_both_classes_the_model_is_neutral(spark, make, nothing):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for m in (C.train(make([(1, "good text")]), labels), C.train(nothing, labels.limit(0))):
        assert C.scored(make([(1, "any text")]), m).first().quality == pytest.approx(0.5)


def test_scores_do_not_depend_on_the_batch(make, model):
    texts = [t for _, t in sample(10, 40_000)[0]]
    def one(part):
        x, doc, n = C.line_features(pa.array(part))
        p = C.marginals(x @ model.weights, doc, model)
        return np.bincount(doc, p * n) / np.bincount(doc, n)
    assert one(texts) == pytest.approx(np.concatenate([one([t]) for t in texts]))


def measures(text):
    """Measures of each line that isn't blank, character by character."""
    out, had = [], set()
    for line in re.split("[\n\r]", text or ""):
        tokens = re.findall("[^ \t]+", line)
        if not tokens:
            continue
        n, words = len(line), len(tokens)
        letters = sum(c.isalnum() for c in line)
        upper = sum(c.isalnum() and len(c.lower()) == 1 and c.lower() != c for c in line)
        marks = sum(c.isascii() and not c.isalnum() and c not in " \t.,;:'\"()-?" for c in line)
        again = sum(a.lower() == b.lower() for a, b in itertools.pairwise(tokens))
        solid = sum(map(len, tokens))
        out.append([
            min(1, 5 * marks / n), min(1, 2 * line.count("|") / words), min(1, 2 * line.count("!") / words), upper / letters if letters >= 8 else 0, min(1, 3 * again / words),
            float(line in had), min(1, sum(c in "0123456789" for c in line) / n), 1 - max(1, letters) / max(1, solid), min(1, n / words / 40), min(1, math.log1p(n) / 8),
        ])
        had.add(line)
    return out


def odd_texts():
    return [prose(1, 200), None, "", " \t\n\r\n ", "a\na\nA a a B\n\na", "HÉLLO WÖRLD 12 | x !! *** \r tab\tand  two", "日本語 日本語 x", "İstanbul ǅ ß", "one\n" * 5, "12 12 12 34?"]


def test_features_equal_counting_by_hand():
    texts = odd_texts()
    x, doc, n = C.line_features(pa.array(texts))
    at = 0
    for k, text in enumerate(texts):
        rows = np.array(measures(text)).reshape(-1, 10)
        none = np.zeros((1, 10))
        m = len(rows)
        want = np.concatenate([np.ones((m, 1)), rows, np.concatenate([none, rows])[:m], np.concatenate([rows[1:], none])[:m]], 1)
        assert x[at : at + m] == pytest.approx(want) and (doc[at : at + m] == k).all()
        assert n[at : at + m].tolist() == [len(line) for line in re.split("[\n\r]", text or "") if line.strip(" \t")]
        at += m
    assert at == len(x)


def test_a_long_text_in_windows_has_the_same_features(monkeypatch):
    text = prose(3, 3000) + "\rone\n" * 40 + prose(3, 500)
    whole = C.line_features(pa.array([text]))
    for window in (1, 100, 5000):
        monkeypatch.setattr(C, "_WINDOW", window)
        for a, b in zip(whole, C.line_features(pa.array([text]))):
            assert a == pytest.approx(b)


def test_memory_of_a_very_long_text():
    text = pa.array([prose(3, 20_000) * (64_000_000 // len(prose(3, 20_000)))], pa.large_string())
    tracemalloc.start()
    C.line_features(pa.array(["warm up"]))
    x, doc, n = C.line_features(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) == len(doc) == len(n) > 100_000 and peak < 5e8, peak


def test_the_fit_is_where_the_likelihood_by_enumeration_is_flat():
    texts = ["Good line here.\nNext one is fine.", "*** | *** |\nGood line here.\n!!! x", "A fine line.", "|| ** ||", "Good words | here"]
    good = np.array([True, False, True, False, True])
    model = C.fit([pa.array(texts[:2]), pa.array(texts[2:])], good, 4000, 0.05, 0.05)
    x, doc, _ = C.line_features(pa.array(texts))
    theta = np.r_[model.weights, model.moves.ravel(), model.start]

    def loss(v):
        w, m, s = v[: C.FEATURES], v[C.FEATURES : -2].reshape(2, 2), v[-2:]
        total = 0.0
        for d in range(len(texts)):
            rows = x[doc == d]
            def score(y):
                return s[y[0]] + sum(r @ w * b for r, b in zip(rows, y)) + sum(m[a, b] for a, b in itertools.pairwise(y))
            z = np.logaddexp.reduce([score(y) for y in itertools.product((0, 1), repeat=len(rows))])
            share = 0.5 / (good == good[d]).sum() / len(rows)
            total += share * (score((int(good[d]),) * len(rows)) - z)
        return total - 0.025 * (v**2).sum()

    best = loss(theta)
    r = np.random.default_rng(0)
    for _ in range(40):
        step = r.normal(size=len(theta))
        slope = (loss(theta + 1e-4 * step) - loss(theta - 1e-4 * step)) / 2e-4
        assert abs(slope) < 1e-3 * np.linalg.norm(step) and loss(theta + 0.1 * step) < best


def test_quality_is_the_mean_marginal_weighted_by_length(make, model):
    texts = odd_texts()[4:] + ["*** | *** |\nGood line here.\n!!! x"]
    got = {r.doc_id: (r.quality, r.lines) for r in C.scored(make(list(enumerate(texts))), model).collect()}
    for k, text in enumerate(texts):
        x, _, n = C.line_features(pa.array([text]))
        p, total = np.zeros(len(x)), 0.0
        for y in itertools.product((0, 1), repeat=len(x)):
            w = np.exp(model.start[y[0]] + sum(row @ model.weights * b for row, b in zip(x, y)) + sum(model.moves[a, b] for a, b in itertools.pairwise(y)))
            p, total = p + w * np.array(y), total + w
        assert got[k] == (pytest.approx((p / total) @ n / n.sum()), len(x))


def test_the_sample_is_bounded_and_an_id_counts_once(spark, make):
    good, bad = sample(30, 0)
    labels = spark.createDataFrame([*((i, 1) for i, _ in good), *((i, 0) for i, _ in bad)], "doc_id long, quality int")
    once = C.train(make([*good, *bad]), labels)
    again = C.train(make([*good, *bad, *[good[0]] * 500]), labels)
    assert again.weights == pytest.approx(once.weights)
    huge = (good[1][0], "x" * 300_000)
    assert C.train(make([*good[:1], *good[2:], huge, *bad]), labels, most_bytes=200_000).weights == pytest.approx(C.train(make([*good[:1], *good[2:], *bad]), labels).weights)
    assert not C.train(make([*good, *bad]), labels, most_bytes=10).weights.any()


def test_kept_sends_each_column_to_python_once(spark, model):
    """A copy of the text beside it doubled what the pipeline's classifier held at a time."""
    schema = "doc_id long, text string, quality string, Lines int, _quality int, bad_lines int"
    docs = spark.createDataFrame([(1, prose(1, 60), "q", 1, 2, 3), (2, None, "q", 4, 5, 6)], schema)
    out = C.kept(docs, model)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, prose(1, 60), "q", 1, 2, 3)]
    node = out._jdf.queryExecution().analyzed()
    while node.nodeName() != "MapInArrow":
        node = node.children().head()
    sent = node.children().head().schema()
    assert sent.simpleString() == docs._jdf.schema().simpleString()
