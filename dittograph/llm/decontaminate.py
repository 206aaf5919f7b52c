"""Benchmark decontamination by spaced seeds: overlaps that survive substituted words.

A seed mask looks at six of up to ten consecutive words and ignores the rest, so
a substituted word spoils few of the seeds around it. The hashes under the six
masks of all texts are joined with those of the benchmark; around each hit the
aligned words are compared. An item counts as leaked where, in some window of
``min(WINDOW, its words)`` of its words, at least 80 % stand in the text in the
same alignment. The masks miss no such window of 8 to 20 words: every pattern
of substitutions was enumerated (a test repeats it), so the search is exact.
Items of fewer than 8 words count as leaked where all their words stand in a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dittograph.llm import flat
from dittograph.storage import written

MASKS = ("1111011", "10101111", "101100111", "110010111", "11011101", "1110100011")
WINDOW, MIN_WORDS = 20, 8
#: Words of the benchmark up to which its text goes to every executor, where each makes an index of some 120 bytes a word; beyond it hashes are joined by a shuffle.
BROADCAST_WORDS = 500_000
#: Bits of the filter of benchmark hashes that tasks have before that shuffle, as a power of two.
FILTER_BITS = 28
_WORD = r"[\\p{L}\\p{N}]+"
_FOUND = "doc_id long, item_id long, matched int, words int"


def least_matches(words):
    """Matches that a window of so many words needs: at most a fifth may differ; of short items none."""
    return words - words // 5 if words >= MIN_WORDS else words


def masks_for(lengths) -> tuple[str, ...]:
    """The spaced masks, and a plain one for each length of short items."""
    return MASKS + tuple("1" * w for w in sorted({int(x) for x in lengths if 0 < x < MIN_WORDS}))


def _fits(mask: str, size: np.ndarray) -> np.ndarray:
    """Whether items of ``size`` words are looked for by this mask."""
    return size >= MIN_WORDS if "0" in mask else size == len(mask)


def seed_hashes(h: np.ndarray, masks: tuple[str, ...] = MASKS) -> Iterator[tuple[str, np.ndarray]]:
    """For each mask itself and the hash at every position where it fits."""
    for mask in masks:
        number = MASKS.index(mask) if mask in MASKS else 100 + len(mask)
        n = len(h) - len(mask) + 1
        if n <= 0:
            yield mask, np.empty(0, np.uint64)
            continue
        total = np.full(n, number + 1, np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                total += h[j : j + n] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        yield mask, flat.mixed(total)


class _Items:
    """Words of the benchmark's items as hashes, one after the other."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        h, item = flat.words(texts)
        size = np.bincount(item, minlength=len(ids))
        keep = size > 0
        self.ids, self.h = np.asarray(ids, np.int64)[keep], h[keep[item]] if len(h) else h
        self.at = np.r_[0, np.cumsum(size[keep])]
        self.masks = masks_for(size[keep])

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted seed hashes and the position of each in ``h``; none crosses two items."""
        keys, places = [], []
        size = np.diff(self.at)
        end, own = np.repeat(self.at[1:], size), np.repeat(size, size)
        for mask, k in seed_hashes(self.h, self.masks):
            ok = (np.arange(len(k)) + len(mask) <= end[: len(k)]) & _fits(mask, own[: len(k)])
            keys.append(k[ok])
            places.append(np.flatnonzero(ok))
        keys, places = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(keys, kind="stable")
        return keys[order], places[order]


def best_window(text: np.ndarray, start: int, item: np.ndarray) -> int:
    """Most matches in a window of the item laid on the text with its first word at ``start``."""
    a, b = max(0, -start), min(len(item), len(text) - start)
    same = np.zeros(len(item) + 1, np.int64)
    if b > a:
        same[a + 1 : b + 1] = text[start + a : start + b] == item[a:b]
    total = np.cumsum(same)
    w = min(WINDOW, len(item))
    return int((total[w:] - total[:-w]).max())


def _verified(ids, h, doc, items: _Items, diagonals: np.ndarray, which: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Leaks among candidate alignments: ``diagonals`` are text positions of items' first words, ``which`` (document, item)."""
    begin = np.searchsorted(doc, np.arange(len(ids) + 1))
    best: dict[tuple[int, int], int] = {}
    for start, (d, i) in zip(diagonals, which):
        item = items.h[items.at[i] : items.at[i + 1]]
        got = best_window(h[begin[d] : begin[d + 1]], int(start - begin[d]), item)
        if got >= least_matches(min(WINDOW, len(item))):
            best[d, i] = max(best.get((d, i), 0), got)
    return [(int(ids[d]), int(items.ids[i]), m, int(min(WINDOW, items.at[i + 1] - items.at[i]))) for (d, i), m in best.items()]


def _rows(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "matched", "words"])


class _Index:
    """The benchmark's seeds, sorted, and a bitmap that rules out nearly all others."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        self.items = _Items(ids, texts)
        self.keys, self.places = self.items.seeds()
        self.of = np.searchsorted(self.items.at, self.places, "right") - 1
        bits = max(16, min(26, 6 + len(self.keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[(self.keys >> self.shift).astype(np.int64)] = True


_made: dict[int, _Index] = {}


def _scan(sent, name: int):
    """Search with the benchmark's text at hand, which each worker indexes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _made:
            _made.clear()
            _made[name] = _Index(*sent.value)
        x = _made[name]
        for batch in batches:
            for part in flat.chunks(batch, "text"):
                names = np.asarray(part.column("doc_id"), np.int64)
                h, doc = flat.words(part.column("text"))
                starts, owners, found = [], [], []
                for _, k in seed_hashes(h, x.items.masks):
                    at = np.flatnonzero(x.bitmap[(k >> x.shift).astype(np.int64)])
                    lo, hi = np.searchsorted(x.keys, k[at]), np.searchsorted(x.keys, k[at], "right")
                    many = hi - lo
                    hit = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    at = np.repeat(at, many)
                    item = x.of[hit]
                    starts.append(at - (x.places[hit] - x.items.at[item]))
                    owners.append(doc[at])
                    found.append(item)
                start, owner, item = np.concatenate(starts), np.concatenate(owners), np.concatenate(found)
                if len(start):
                    one = np.unique(np.stack([owner, item, start]), axis=1)
                    yield _rows(_verified(names, h, doc, x.items, one[2], [tuple(y) for y in one[:2].T.tolist()]))

    return run


def _seeds_of(part: pa.RecordBatch, masks: tuple[str, ...], items: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask the hashes, and of each the row and the word, that don't cross two texts; of items those that they are looked for by."""
    h, doc = flat.words(part.column("text"))
    begin = np.searchsorted(doc, np.arange(part.num_rows))
    end = np.searchsorted(doc, np.arange(part.num_rows), "right")
    for mask, k in seed_hashes(h, masks):
        d = doc[: len(k)]
        ok = np.arange(len(k)) + len(mask) <= end[d]
        if items:
            ok &= _fits(mask, (end - begin)[d])
        yield k[ok], d[ok], (np.arange(len(k)) - begin[d])[ok].astype(np.int32)


def _bits(masks: tuple[str, ...], bits: int):
    """The filter's bits of a task's items, in slices of 2 ** 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.int64)
        for batch in batches:
            for part in flat.chunks(batch, "text", 1 << 20):
                new = [(k >> np.uint64(64 - bits)).astype(np.int64) for k, _, _ in _seeds_of(part, masks, True)]
                seen = np.unique(np.concatenate([seen, *new]))
        slices, first = np.unique(seen >> 16, return_index=True)
        data = []
        for x in np.split(seen & 0xFFFF, first[1:]) if len(seen) else []:
            one = np.zeros(1 << 16, bool)
            one[x] = True
            data.append(np.packbits(one).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int32)), pa.array(data, pa.binary())], ["slice", "bits"])

    return run


def _united(table: pa.Table) -> pa.Table:
    """All bits that any task found in a slice."""
    out = np.zeros(1 << 13, np.uint8)
    for x in table.column("bits").to_pylist():
        out |= np.frombuffer(x, np.uint8)
    return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([out.tobytes()], pa.binary())})


def _blobs(kind: str, buckets: int, masks: tuple[str, ...], sent=None, bits: int = 0):
    """Seed hashes of texts or items with their places, packed by bucket; with a filter only those that pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.frombuffer(sent.value, np.uint8) if sent else None
        for batch in batches:
            for part in flat.chunks(batch, "text", 1 << 20):
                names = np.asarray(part.column(kind), np.int64)
                keys, ids, places = [], [], []
                for k, d, place in _seeds_of(part, masks, kind == "item_id"):
                    if keep is not None:
                        x = (k >> np.uint64(64 - bits)).astype(np.int64)
                        ok = (keep[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1).astype(bool)
                        k, d, place = k[ok], d[ok], place[ok]
                    keys.append(k)
                    ids.append(names[d])
                    places.append(place)
                key, ident, place = np.concatenate(keys), np.concatenate(ids), np.concatenate(places)
                to = (key % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                edge = np.searchsorted(to[order], np.arange(buckets + 1))
                rows = [(b, key[o].tobytes(), ident[o].tobytes(), place[o].tobytes()) for b in np.flatnonzero(np.diff(edge)).tolist() if len(o := order[edge[b] : edge[b + 1]])]
                columns = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "keys", "ids", "places"])

    return run


def _matched(left: pa.Table, right: pa.Table) -> pa.Table:
    """Alignments of a bucket: hashes that a text and an item share."""
    get = lambda t, c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    key, order = get(right, "keys", np.uint64), np.argsort(get(right, "keys", np.uint64), kind="stable")
    mine = get(left, "keys", np.uint64)
    lo, hi = np.searchsorted(key[order], mine), np.searchsorted(key[order], mine, "right")
    many = hi - lo
    at = np.repeat(np.arange(len(mine)), many)
    hit = order[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))] if len(order) else np.empty(0, np.int64)
    start = get(left, "places", np.int32)[at].astype(np.int64) - get(right, "places", np.int32)[hit]
    rows = np.unique(np.stack([get(left, "ids", np.int64)[at], get(right, "ids", np.int64)[hit], start]), axis=1)
    return pa.table({"doc_id": rows[0], "item_id": rows[1], "start": rows[2]})


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, item, starts, text, passage in zip(*(batch.column(c) for c in ("doc_id", "item_id", "starts", "text", "passage"))):
            h, i = flat.words(pa.array([text.as_py()]))[0], flat.words(pa.array([passage.as_py()]))[0]
            w = min(WINDOW, len(i))
            got = max(best_window(h, s, i) for s in starts.as_py())
            if got >= least_matches(w):
                rows.append((doc.as_py(), item.as_py(), got, w))
        yield _rows(rows)


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``(doc_id, item_id, matched, words)``: every document with a leaked item, and the best window's matches.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Words are runs of
    letters and digits in lower case. An item of fewer than 8 words is leaked
    where all of them stand in a row. Where the benchmark has at most
    ``broadcast_words`` words (they are counted first), its text goes to all
    executors and the texts are read once without a shuffle. Beyond that the
    hashes of both sides are joined by a shuffle, with the same result; of the texts' only
    those are sent that pass a filter of the benchmark's, made before.

    Nulls: rows of either table without id or text are ignored, as are items without words. Repeated ids: the
    best match of all rows with an id counts. Ties can't arise. Empty tables, on
    either side, give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    lengths = tests.select(F.expr(f"regexp_count(text, '{_WORD}')").alias("n")).groupBy(F.least("n", F.lit(MIN_WORDS)).alias("w")).agg(F.sum("n").alias("n")).collect()
    words, best = sum(r.n for r in lengths), lambda x: x.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("words").alias("words"))
    if words <= broadcast_words:
        table = tests.orderBy("item_id", "text").toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((np.asarray(table.column("item_id"), np.int64), table.column("text").combine_chunks()))
        return best(texts.mapInArrow(_scan(sent, uuid.uuid4().int), _FOUND))
    masks = masks_for(r.w for r in lengths)
    seeds = len(masks) * words
    bits = min(FILTER_BITS, max(16, 4 + seeds.bit_length()))
    slices = tests.mapInArrow(_bits(masks, bits), "slice int, bits binary").groupBy("slice").applyInArrow(_united, "slice int, bits binary")
    keep = bytearray(1 << bits - 3)
    for r in slices.toLocalIterator():
        keep[r["slice"] << 13 : (r["slice"] + 1) << 13] = r.bits
    sent = spark.sparkContext.broadcast(bytes(keep))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, 20 * seeds >> 25, size >> 28)
    blob = "bucket int, keys binary, ids binary, places binary"
    mine = texts.mapInArrow(_blobs("doc_id", buckets, masks, sent, bits), blob)
    theirs = tests.mapInArrow(_blobs("item_id", buckets, masks), blob)
    hits = mine.groupBy("bucket").cogroup(theirs.groupBy("bucket")).applyInArrow(_matched, "doc_id long, item_id long, start long")
    pairs = written(hits.distinct().groupBy("doc_id", "item_id").agg(F.collect_set(F.col("start").cast("int")).alias("starts")), "alignments")
    full = pairs.join(texts, "doc_id").join(tests.withColumnRenamed("text", "passage"), "item_id")
    return best(full.select("doc_id", "item_id", "starts", "text", "passage").mapInArrow(_check, _FOUND))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which an item of ``benchmark`` leaked; rows without id or text stay."""
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["leaked_id"], "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
bw AS (SELECT item_id, least(20, len(w)) AS words, unnest(w) AS word, unnest(range(len(w))) AS q FROM b),
hits AS (SELECT doc_id, item_id, words, q, p - q AS diagonal FROM dw JOIN bw USING (word)),
win AS (SELECT doc_id, item_id, words, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM hits)
SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS matched, CAST(max(words) AS INTEGER) AS words
FROM win WHERE n >= CASE WHEN words < 8 THEN words ELSE words - words // 5 END GROUP BY doc_id, item_id
"""
