import itertools
import random
import re

import pytest

from dittograph.llm import decontaminate as D

from .conftest import prose


def test_masks_miss_no_window():
    for w in range(D.MIN_WORDS, D.WINDOW + 1):
        masks = [(m, s) for m in D.MASKS for s in range(w - len(m) + 1)]
        bits = [sum(1 << (s + j) for j, b in enumerate(m) if b == "1") for m, s in masks]
        for gone in itertools.combinations(range(w), w // 5):
            hole = sum(1 << g for g in gone)
            assert any(not b & hole for b in bits), (w, gone)


def brute(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = {}
    for (i, text), (k, item) in itertools.product(docs, items):
        if text is None or i is None or item is None or k is None:
            continue
        d, m = words(text), words(item)
        w = min(D.WINDOW, len(m))
        if not m:
            continue
        need = w if len(m) < 8 else w - w // 5
        for start in range(-len(m), len(d)):
            same = [0 <= start + j < len(d) and d[start + j] == m[j] for j in range(len(m))]
            best = max(sum(same[a : a + w]) for a in range(len(m) - w + 1))
            if best >= need:
                out[i, k] = max(out.get((i, k), (0, 0)), (best, w))
    return {(i, k, *v) for (i, k), v in out.items()}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(0)
    items = [(k, prose(1000 + k, n)) for k, n in enumerate((8, 9, 12, 16, 20, 21, 35, 59, 7, 3))] + [(50, None), (None, prose(1, 30)), (7, prose(1007, 59))]
    docs = []
    for k in range(60):
        item = r.choice([t for i, t in items[:10]]).split()
        item = [f"zz{r.randrange(999)}" if r.random() < 0.04 * (k % 8) else w for w in item]
        cut = item if k % 3 else item[: r.randrange(len(item)) + 1]
        docs.append((k, " ".join([*prose(k, 25).split(), *cut, *prose(k + 99, 5 * (k % 2)).split()])))
    docs += [(100 + k, prose(300 + k, 80)) for k in range(20)]
    docs += [(None, items[5][1]), (200, None), (201, ""), (5, docs[5][1]), (202, items[3][1].upper())]
    return docs, items, spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id long, words string"), spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id long")


@pytest.mark.parametrize("limit", [D.BROADCAST_WORDS, 0])
def test_leaks_equal_brute_force(tables, limit):
    docs, items, d, b = tables
    assert {tuple(r) for r in D.leaks(d, b, limit).collect()} == brute(docs, items)


def test_short_items_need_all_their_words(spark):
    items = spark.createDataFrame([(1, "Seven words in a row count here"), (2, "two words"), (3, "..."), (4, "solo")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so SEVEN words, in a row count here!"), (2, "seven words in the row count here"), (3, "two other words"), (4, "x two words y"), (5, "... solo")], "doc_id long, text string")
    for limit in (100, 0):
        assert {tuple(r) for r in D.leaks(docs, items, limit).collect()} == {(1, 1, 7, 7), (4, 2, 2, 2), (5, 4, 1, 1)}


def test_clean_documents_stay(tables):
    docs, items, d, b = tables
    gone = {x[0] for x in brute(docs, items)}
    left = D.decontaminated(d, b)
    assert left.columns == d.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in gone)


@pytest.mark.parametrize("limit", [D.BROADCAST_WORDS, 0])
def test_empty_tables(tables, limit):
    _, _, d, b = tables
    assert D.leaks(d.limit(0), b, limit).collect() == []
    # below its bound an empty benchmark is sent; with a bound of less than nothing it is shuffled
    assert D.leaks(d, b.limit(0), limit).collect() == [] == D.leaks(d, b.limit(0), limit - 1).collect()
    assert D.leaks(d.limit(0), b.limit(0), -1).collect() == []


def test_odd_rows(odd, spark):
    items = spark.createDataFrame([(1, prose(7, 30)), (2, prose(3, 80))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(odd, items).collect()} == {(6, 1), (7, 1), (12, 2), (-13, 2)}
