import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dittograph.llm import context_mixing as M

from .conftest import prose

FULL = (1 << 64) - 1
RANGE = 0


def mixed(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & FULL
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & FULL
    return h ^ h >> 33


def context(before, k):
    """Hash of a context, in plain integers."""
    own = before[-k:] if k else b""
    c = sum(b << 8 * j for j, b in enumerate(reversed(own)))
    if len(own) < k:
        c |= (len(own) + 1) << 56
    c = c * (0x9E3779B97F4A7C15 + 2 * k) & FULL
    c ^= c >> 31
    return (c * 0xD6E8FEB86659FD93 & FULL) >> 24


def row_name(h, high):
    low = (h * 32 + (0 if high is None else high + 1)) * 0xBF58476D1CE4E5B9 & FULL
    low ^= low >> 29
    return low * 0x94D049BB133111EB & FULL


class Table:
    """One order's rows for one half, from the texts of the other one."""

    def __init__(self, texts, k, rows):
        upper, lower = defaultdict(lambda: [0] * 16), defaultdict(lambda: [0] * 16)
        for raw in texts:
            for i, byte in enumerate(raw):
                h = context(raw[:i][-k:], k)
                upper[row_name(h, None)][byte >> 4] += 1
                lower[row_name(h, byte >> 4)][byte & 15] += 1
        self.n, self.slots = len(upper) + len(lower), {}
        self.all = sorted([*sorted(upper.items()), *sorted(lower.items())], key=lambda x: sum(x[1]))
        self.size(rows)

    def size(self, rows):
        self.rows = rows
        self.slots = {(name >> 32) * rows >> 32: (name, counts) for name, counts in self.all}

    def logit(self, h, high, half, depth):
        name = row_name(h, high)
        found, c = self.slots.get((name >> 32) * self.rows >> 32, (None, None))
        if found is None or (found ^ name) >> 4 & 255:
            return 0.0
        width, prefix = 8 >> depth, half >> (4 - depth)
        zero, one = (sum(c[(2 * prefix + b) * width : (2 * prefix + b + 1) * width]) for b in (0, 1))
        return max(-127, min(127, round(M.SCALE * math.log((one + M.PRIOR) / (zero + M.PRIOR)))))


def byte_bits(raw, tables, orders):
    """Bits of each byte, one bit after the other."""
    weights = {(o, b): float(M.START) * 2 / len(orders) / M.SCALE * M._FINE for o in orders for b in range(8)}
    logistic = lambda q: 1 / (1 + math.exp(-(q / M._FINE - M._CLIP)))
    cells = {(b, c): logistic(min((c << M._SHARED) + (1 << M._SHARED - 1), 2 * M._CLIP * M._FINE)) for b in range(8) for c in range(M._CELLS)}
    out = []
    for begin in range(0, len(raw), M.STEP):
        dw, dc = Counter(), Counter()
        for i in range(begin, min(len(raw), begin + M.STEP)):
            cost, byte = 0.0, raw[i]
            for place in range(8):
                half, high, depth = (byte >> 4, None, place) if place < 4 else (byte & 15, byte >> 4, place - 4)
                bit = byte >> (7 - place) & 1
                x = {o: tables[o].logit(context(raw[max(0, i - 8) : i], o), high, half, depth) for o in orders}
                q = int(max(0.0, min(2.0 * M._CLIP * M._FINE, sum(weights[o, place] * x[o] for o in orders) + M._CLIP * M._FINE + 0.5)))
                p, cell = logistic(q), (place, q >> M._SHARED)
                mean = (p + cells[cell]) / 2
                cost -= math.log2(max(1e-4, mean if bit else 1 - mean))
                dc[cell] += (bit - cells[cell]) * float(M._MAP_RATE)
                for o in orders:
                    dw[o, place] += float(M.RATE) / M.SCALE**2 * M._FINE * (bit - p) * x[o]
            out.append(cost)
        for d, to in ((dw, weights), (dc, cells)):
            for key, v in d.items():
                to[key] += v
    return out


def segments(raw):
    """(16 bytes before or None, segment, whether the text ends there, begin, end)."""
    one = [(b + 1) * 0x9E3779B97F4A7C15 & FULL for b in raw]
    one = [x ^ x >> 32 for x in one]
    begins = [0]
    for i in range(M.LONG, len(raw)):
        h = sum(one[i - 1 - j] * pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(M.LONG)) & FULL
        if mixed(h) % M.DENSITY == 0:
            begins.append(i)
    ends = [*begins[1:], len(raw)]
    return [(raw[i - M.LONG : i] if i else None, raw[i:j], j == len(raw), i, j) for i, j in zip(begins, ends) if j > i]


def brute(rows, orders):
    """Bits of each (half, text): counts of the other half, long contexts of all other texts."""
    rows = [(h, t.encode()) for h, t in rows]
    tables = {}
    for half in (0, 1):
        tables[half] = {o: Table([t for h, t in rows if h != half], o, 1) for o in orders}
    for o in orders:
        n = max(tables[h][o].n for h in (0, 1))
        for h in (0, 1):
            tables[h][o].size(M.ROOM * n // 2 + 16)
    cut = [segments(t) for _, t in rows]
    follow = [{x[:3] for x in s} for s in cut]
    some = sum(bool(t) for _, t in rows)
    out = []
    for k, (half, raw) in enumerate(rows):
        each, total = byte_bits(raw, tables[half], orders), 0.0
        for a, seg, end, i, j in cut[k]:
            b = sum(each[i:j])
            others = [f for n, f in enumerate(follow) if n != k]
            n = sum((a, seg, end) in f for f in others)
            m = some - 1 if a is None else sum(x[0] == a for f in others for x in f)
            w = 0.5 if a is None else m / (m + M.UNSEEN)
            total += b if not m else -math.log2(w * n / m + (1 - w) * 2**-b) if n or b < 900 else b - math.log2(1 - w)
        out.append(total)
    return out


def test_bits_equal_brute_force(spark, make):
    twin = prose(3, 120)
    texts = [prose(k, 30 + 25 * k) for k in range(6)] + [twin, twin, twin[:500] + prose(9, 40), "", "x", "aaaaaaaaaaaaaaaaaaaaaaaa", "é日本", "x"]
    docs = make(list(enumerate(texts)))
    halves = dict(docs.select("doc_id", M.fold()).collect())
    got = {r.doc_id: r.bits for r in M.score(docs).collect()}
    want = brute([(halves[k], t) for k, t in enumerate(texts)], M.ORDERS)
    assert [got[k] for k in range(len(texts))] == pytest.approx(want, rel=3e-3, abs=0.3)


def test_result_does_not_depend_on_partitions(make):
    rows = [(k, prose(k % 30, 60)) for k in range(40)]
    a, b = (sorted(map(tuple, M.score(make(rows).repartition(n)).select("doc_id", "bytes", "bits").collect())) for n in (1, 7))
    assert [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b], abs=0.02)


def test_odd_rows(odd, nothing):
    out = M.score(odd)
    assert set(out.columns) == {*odd.columns, "bytes", "bits_per_byte"} - {"text"}
    rows, texts = out.collect(), odd.select("doc_id", F.octet_length("text").alias("n")).collect()
    assert sorted((r.doc_id or 0, r.bytes or 0) for r in rows) == sorted((r.doc_id or 0, r.n or 0) for r in texts)
    for r in rows:
        if r.bytes is None:
            assert r.bits is r.bits_per_byte is None
        else:
            assert r.bits > 0 if r.bytes else (r.bits == 0 and r.bits_per_byte is None)
    twice = [r.bits for r in rows if r.doc_id == 5]
    assert twice[0] == twice[1]
    assert M.score(nothing).collect() == []


def test_twins_and_predictable_texts_cost_less(make):
    noise = "".join(chr(33 + int(x)) for x in np.random.default_rng(0).integers(0, 90, 3000))
    texts = [*((k, prose(k, 300)) for k in range(40)), (99, noise), (100, prose(5, 300)), (101, "Before it. " + prose(6, 300) + " And after.")]
    got = {r.doc_id: r.bits_per_byte for r in M.score(make(texts)).collect()}
    alone = [v for k, v in got.items() if k < 40 and k not in (5, 6)]
    assert max(got[k] for k in (5, 6, 100, 101)) < 0.3 * min(alone) and max(alone) < got[99]


def test_a_long_text_goes_on_through_its_windows(monkeypatch, make):
    """In windows or as a whole: the same state, so nearly the same bits; only a cut is added."""
    texts = [*((k, prose(k, 200)) for k in range(9)), (50, prose(50, 4000))]
    whole = {r.doc_id: r.bits for r in M.score(make(texts)).collect()}
    cost = {}
    pool = pa.RecordBatch.from_arrays([pa.array([prose(50, 4000)])], ["text"])
    table = M.Tables("", (1,), (16,), 0)
    maps = [np.zeros(32, np.complex128)]
    for window in (1 << 20, 4096):
        state, out = None, []
        for _, _, raw, at, before in M.pieces(pool, window, 16):
            state = state if before else M.State(1, 1)
            out.append(M.mixed_bits(raw, at, np.zeros(1, np.int64), maps, table, state, min(16, before), before > 0)[min(16, before) :])
        cost[window] = np.concatenate(out)
    assert np.allclose(cost[1 << 20], cost[4096], atol=1e-3) and whole[50] > 0


def test_tables_grow_with_the_corpus(make):
    """At least as many rows as distinct contexts, however many, in one or in several ranges."""
    noise = ["".join(map(chr, np.random.default_rng(k).integers(33, 123, 40_000))) for k in range(8)]
    small, large = (M.gathered(make([*enumerate(noise[:n]), (98, ""), (99, None)])) for n in (2, 8))
    assert large.rows[-1] > 2.5 * small.rows[-1]
    halves = dict(make(list(enumerate(noise))).select("doc_id", M.fold()).collect())
    distinct = [len({(t[max(0, k - 5) : k], u) for n, t in enumerate(noise) if halves[n] == h for k in range(len(t)) for u in (None, ord(t[k]) >> 4)}) for h in (0, 1)]
    assert large.rows[-1] >= 2 * max(distinct)


def test_ranges_give_the_same_predictions(monkeypatch, make):
    rows = [(k, prose(k, 150)) for k in range(30)]
    one = {r.doc_id: r.bits for r in M.score(make(rows)).collect()}
    monkeypatch.setattr(M, "RANGE_BYTES", 4000)
    many = {r.doc_id: r.bits for r in M.score(make(rows)).collect()}
    # in small tables other rows meet
    assert [many[k] for k in one] == pytest.approx(list(one.values()), rel=0.05)
    assert sum(many.values()) == pytest.approx(sum(one.values()), rel=0.01)


def test_tables_are_placed_by_one_job_however_many_ranges(spark, monkeypatch, make):
    docs = make([(k, prose(k, 150)) for k in range(30)])

    def jobs(name):
        spark.sparkContext.setJobGroup(name, name)
        M.gathered(docs)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    one = jobs("one range")
    monkeypatch.setattr(M, "RANGE_BYTES", 4000)
    assert jobs("many ranges") == one
