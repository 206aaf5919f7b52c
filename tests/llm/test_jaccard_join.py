import random
import re
import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from dittograph.llm import flat
from dittograph.llm import jaccard_join as J

from .conftest import prose


def brute(texts, n=J.N, t=J.THRESHOLD):
    """(doc_id, rep_id) of all groups, from all pairs of sets."""
    sets = {}
    for i, text in texts:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        if w:
            sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if Fraction(common, len(sets[a]) + len(sets[b]) - common) >= Fraction(str(t)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {(i, g) for g, m in groups.items() if len(m) > 1 for i in m}


def edited(seed, text, rate):
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < rate else w for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    texts, k = [], 0
    for base in range(12):
        origin = prose(base, 40 + 15 * base)
        for copy in range(base % 5 + 1):
            texts.append((k, edited(k, origin, 0.03 * copy)))
            k += 1
    passage = prose(99, 55)
    for m in range(12):
        texts.append((k, prose(200 + m, 60) + " " + passage))
        k += 1
    hub = prose(500, 120)
    for m in range(20):  # chains: each copy from the one before
        texts.append((k, hub))
        hub = edited(m, hub, 0.04)
        k += 1
    texts += [(k + m, "short one") for m in range(3)] + [(k + 5, "short two"), (k + 6, "a b c d e f"), (k + 7, "a b c d e f g")]
    return texts


@pytest.mark.parametrize(("n", "t"), [(5, 0.4), (3, 0.5), (2, 0.6), (1, 0.8)])
def test_groups_equal_brute_force(make, corpus, n, t):
    got = {tuple(r) for r in J.ngram_jaccard_groups(make(corpus), n, t).collect()}
    assert got == brute(corpus, n, t)


@pytest.mark.parametrize("cap", [300, 3000])
def test_large_regions_split_without_loss(make, corpus, cap):
    got = {tuple(r) for r in J.ngram_jaccard_groups(make(corpus), region_tokens=cap).collect()}
    assert got == brute(corpus)


def test_blocks_are_paired_where_pivots_would_be_too_large(make, corpus, monkeypatch):
    monkeypatch.setattr(J, "PIVOT_BYTES", 0)
    got = {tuple(r) for r in J.ngram_jaccard_groups(make(corpus), region_tokens=1000).collect()}
    assert got == brute(corpus)


def test_odd_rows(odd, nothing):
    got = {tuple(r) for r in J.ngram_jaccard_groups(odd).collect()}
    # 12 has two texts, of which one is a copy
    assert {(4, 4), (5, 4), (6, 6), (7, 6), (9, 9), (10, 9), (12, -13), (-13, -13)} <= got
    assert not {i for i, _ in got} & {None, 1, 2, 3, 8, 11}
    assert J.ngram_jaccard_groups(nothing).collect() == []


def test_dropping_keeps_one_of_each_group_and_all_columns(odd):
    left = J.near_duplicates_dropped(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(None) == 2 and ids.count(4) == 1 and [r.text for r in left.collect() if r.doc_id == 12] == [prose(4, 80)]
    assert not {5, 7, 10} & set(ids) and {1, 2, 3, 6, 8, 9, 11} <= set(ids)


def test_texts_that_only_share_an_id_stay(make):
    texts = [(7, prose(1, 60)), (7, prose(2, 60)), (7, prose(2, 60)), (7, prose(1, 60) + " more"), (3, prose(3, 60)), (9, prose(2, 60)), (-1, prose(4, 60)), (-1, prose(5, 60)), (-1, None)]
    groups = sorted(tuple(r) for r in J.ngram_jaccard_groups(make(texts)).collect())
    assert groups == [(7, 7), (7, 7), (7, 7), (9, 7)]
    left = [(r.doc_id, r.text) for r in J.near_duplicates_dropped(make(texts)).collect()]
    assert len(left) == 6 and {(3, texts[4][1]), (7, prose(2, 60)), (-1, prose(4, 60)), (-1, prose(5, 60)), (-1, None)} <= set(left)


def test_hot_group_of_equal_texts(make):
    texts = [(k, prose(1, 50)) for k in range(400)] + [(1000, prose(2, 50))]
    assert {tuple(r) for r in J.ngram_jaccard_groups(make(texts)).collect()} == {(k, 0) for k in range(400)}


def test_threshold_is_checked(make):
    with pytest.raises(ValueError):
        J.ngram_jaccard_groups(make([]), threshold=0.3)


def test_short_and_edited_copies_match_by_default(make):
    """One inner word of 11 to 15 substituted (3-grams at 0.50 or more), and every tenth word of a long text."""
    texts = []
    for size in range(11, 16):
        words = [f"w{size}x{k}" for k in range(size)]
        texts += [(2 * size, " ".join(words)), (2 * size + 1, " ".join([*words[:5], "other", *words[6:]]))]
    words = [f"long{k}" for k in range(900)]
    texts += [(100, " ".join(words)), (101, " ".join("other" + w if k % 10 == 4 else w for k, w in enumerate(words)))]
    got = {tuple(r) for r in J.ngram_jaccard_groups(make(texts)).collect()}
    assert got == {(k, k // 2 * 2) for k, _ in texts}


def test_survivors_do_not_depend_on_the_number_of_buckets(make, corpus):
    def found(bucket_bytes):
        rows = J.survivors(make(corpus), bucket_bytes=bucket_bytes).collect()
        return {r.doc_id: (r.size, len(r.grams) // 8) for r in rows}

    few = found(J.BUCKET_BYTES)
    assert few and found(100) == few and found(0.05) == few  # of 4, about 10 and about 20 bits


def test_words_of_a_long_text_in_parts():
    text = prose(3, 3000) + " " + "x" * 9000 + " é日本 " * 400
    whole = flat.words(pa.array([text]))
    for most in (1, 77, 5000):
        for a, b in zip(whole, flat.words(pa.array([text]), most)):
            assert (a == b).all()


def test_memory_of_a_very_long_text():
    text = prose(3, 20_000)
    batch = pa.record_batch({"doc_id": [1], "text": pa.array([text * (64_000_000 // len(text))])})
    tracemalloc.start()
    rows = sum(b.num_rows for b in J._emit(3, 4)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 16 and peak < 5e8, peak
