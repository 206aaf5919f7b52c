"""N-gram Jaccard join: exact groups of near copies in the Jaccard metric space.

``d(x, y) = 1 - |x & y| / |x | y|`` over the sets of word n-grams is a metric.
Documents of a web corpus are nearly all at distance 1 from any document that
could serve as a pivot, so pivots over the whole corpus would copy every
document into every region. Coarse regions therefore come first, from n-grams,
and the Voronoi work is done inside them; both halves are exact:

1. *Bound.* One pass counts in how many documents each n-gram occurs. N-grams
   of one document can't be shared: a document of which too few are left
   (``shared < t * size``) is farther than ``r = 1 - t`` from every other one.
   What is left is the survivors, each with its shared n-grams.
2. *Coarse regions.* Two survivors within ``r`` have an n-gram in common among
   the rarest ``shared - ceil(t * size) + 1`` of each. Survivors that meet at
   such an n-gram, and whose sizes allow it, fall into one region (connected
   components); no pair within ``r`` is cut, no document is in two regions.
3. *Pivots.* In a region a document ``p`` serves as pivot. All within ``r / 2``
   of it are its cell: by the triangle inequality they are within ``r`` of each
   other and need no comparison. Those between ``r / 2`` and ``3r / 2`` are the
   window, the only ones that the cell's members can still match. Then the cell
   goes and the rest of the region is joined in the same way.
4. *Large regions* beyond ``region_tokens`` are first split over the cluster by
   several pivots: a cell with a copy of its window, for each pivot, and the
   rest, which recurs with new pivots; what no pivot splits is joined by pairs
   of blocks. The work is exact at any depth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dittograph.llm import flat
from dittograph.operators.components import connected_components
from dittograph.storage import dropped, shuffles_released, written

N, THRESHOLD = 3, 0.5
#: Most n-grams that one task joins in memory; larger regions are split first.
REGION_TOKENS = 4_000_000
#: Bytes of pivots that a split may send to all executors; beyond it pairs of blocks are joined at once.
PIVOT_BYTES = 64 << 20
#: Documents of 16 bytes up to which their regions are sent to all executors; they are counted first.
BROADCAST_ROWS = 1_000_000
#: N-grams of small regions that one task is given.
TASK_TOKENS = 1_000_000
#: Bytes of text whose n-grams one bucket has; what 24 bits name is 400 TB of text.
BUCKET_BYTES, _MOST_BITS = 24 << 20, 24
_LOW = np.uint64(0xFFFFFFFF)
_B32 = np.uint64(32)
_BLOB = "bucket int, ids binary, counts binary, grams binary, sizes binary"
_SEEN = "part int, bucket int, ids binary, counts binary, grams binary, ranks binary, sized binary, sizes binary"
_SET = "doc_id long, size int, grams binary"


def _need(size, t: float):
    """Least overlap that a document of ``size`` n-grams needs with any partner: ceil(t * size), in integers."""
    f = Fraction(str(t))
    return -(-(np.asarray(size, np.int64) * f.numerator) // f.denominator)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of what ascends, and how often each is there."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    return x[first], np.diff(np.r_[first, len(x)])


def _emit(n: int, bits: int):
    """Map side of the count: per chunk and bucket one row with the packed n-grams of all its documents.

    One row of a chunk also has the sizes, and so names all documents; others name those with n-grams there.
    """
    most = min(60_000, 1 << (32 - bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.chunks(batch, "text", max_rows=most):
                ids = np.asarray(part.column("doc_id"), np.int64)
                key, doc = flat.ngrams(*flat.words(part.column("text")), n)
                # from the highest bit: bucket, document, the n-gram's lowest 32 bits
                key &= ~(np.uint64((1 << (32 - bits)) - 1) << _B32)
                key |= doc.astype(np.uint64) << _B32
                key.sort()
                key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
                local = ((key >> _B32) & np.uint64((1 << (32 - bits)) - 1)).astype(np.int32)
                sizes = np.bincount(local, minlength=len(ids)).astype(np.uint32)
                low = (key & _LOW).astype(np.uint32)
                bucket = (key >> np.uint64(64 - bits)).astype(np.int32)
                carrier = int(ids[0]) % (1 << bits)
                names = np.union1d(_runs(bucket)[0], np.int32(carrier))
                rows = []
                for b, i, j in zip(names.tolist(), np.searchsorted(bucket, names).tolist(), np.searchsorted(bucket, names, "right").tolist()):
                    grams = low[i:j].tobytes()
                    docs, counts = _runs(local[i:j])
                    if b == carrier:
                        rows.append((b, np.diff(ids, prepend=0).tobytes(), np.bincount(docs, counts, len(ids)).astype(np.uint32).tobytes(), grams, sizes.tobytes()))
                    else:
                        rows.append((b, np.diff(ids[docs], prepend=0).tobytes(), counts.astype(np.uint32).tobytes(), grams, b""))
                yield _batch(rows, [pa.int32()] + [pa.binary()] * 4, ["bucket", "ids", "counts", "grams", "sizes"])

    return run


def _batch(rows: list, types: list, names: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (flat.mixed(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _count(parts: int):
    """Reduce side: n-grams of a bucket that at least two documents have, sent on to the documents' parts."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        ids = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in table.column("ids").to_pylist()])
        counts = _joined(table.column("counts"), np.uint32)
        sized, sizes = [], []
        for x, s in zip(table.column("ids").to_pylist(), table.column("sizes").to_pylist()):
            if s:
                sized.append(np.cumsum(np.frombuffer(x, np.int64)))
                sizes.append(np.frombuffer(s, np.uint32))
        here = np.flatnonzero(counts)
        ids, counts = ids[here], counts[here]
        key = (_joined(table.column("grams"), np.uint32).astype(np.uint64) << _B32) | np.repeat(np.arange(len(ids), dtype=np.uint64), counts)
        key.sort()
        gram = key >> _B32
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, np.int64)
        del gram
        many = np.diff(np.r_[first, len(key)])
        rank = np.minimum(15, np.log2(np.maximum(1, many))).astype(np.uint8)
        key, rank = key[np.repeat(many >= 2, many)], np.repeat(rank[many >= 2], many[many >= 2])
        # by document, then n-gram; the rank goes along in the lowest bits
        back = (key & _LOW) << np.uint64(36)
        key >>= _B32
        key <<= np.uint64(4)
        back |= key
        del key
        back |= rank
        back.sort()
        counts = np.bincount((back >> np.uint64(36)).astype(np.int64), minlength=len(ids)).astype(np.uint32)
        rank = (back & np.uint64(15)).astype(np.uint8)
        grams = (back >> np.uint64(4)).astype(np.uint32)
        del back
        part = _part(ids, parts)
        by = np.lexsort((ids, part))  # ids ascend, so that their differences compress well
        by = by[counts[by] > 0]
        begin = np.cumsum(counts) - counts
        sized = np.concatenate(sized) if sized else np.empty(0, np.int64)
        sizes = np.concatenate(sizes) if sizes else np.empty(0, np.uint32)
        apart = _part(sized, parts)
        so = np.argsort(apart, kind="stable")
        part, apart, rows = part[by], apart[so], []
        names = np.union1d(part, apart)
        edges = [np.searchsorted(x, names, side).tolist() for x in (part, apart) for side in ("left", "right")]
        for p, i, j, si, sj in zip(names.tolist(), *edges):
            docs, has = by[i:j], so[si:sj]
            take = _ranges(begin[docs], counts[docs])
            ranks = np.append(rank[take], np.zeros(len(take) % 2, np.uint8))  # two to a byte
            rows.append((p, bucket, np.diff(ids[docs], prepend=0).tobytes(), counts[docs].tobytes(), grams[take].tobytes(), (ranks[::2] << 4 | ranks[1::2]).tobytes(), sized[has].tobytes(), sizes[has].tobytes()))
        return pa.Table.from_batches([_batch(rows, [pa.int32(), pa.int32()] + [pa.binary()] * 6, ["part", "bucket", "ids", "counts", "grams", "ranks", "sized", "sizes"])])

    return run


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices begin..begin+count of every range, one after the other."""
    count = np.asarray(count, np.int64)
    total = int(count.sum())
    shift = np.repeat(np.asarray(begin, np.int64) - (np.cumsum(count) - count), count)
    return shift + np.arange(total)


def _survive(t: float):
    """Documents with enough shared n-grams, which are ordered from rare to frequent."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in table.column("ids").to_pylist()])
        counts = _joined(table.column("counts"), np.uint32)
        low, many = _joined(table.column("grams"), np.uint32), [len(x) // 4 for x in table.column("grams").to_pylist()]
        two = [np.frombuffer(x, np.uint8) for x in table.column("ranks").to_pylist()]
        rank = np.concatenate([np.stack([x >> 4, x & 15], 1).ravel()[:n] for x, n in zip(two, many)])
        bucket = np.repeat(np.asarray(table.column("bucket"), np.uint64), many)
        sized, sizes = _joined(table.column("sized"), np.int64), _joined(table.column("sizes"), np.uint32)
        names, at = np.unique(sized, return_index=True)
        size = sizes[at].astype(np.int64)
        doc = np.searchsorted(names, ids)
        shared = np.bincount(doc, counts, minlength=len(names)).astype(np.int64)
        alive = (shared > 0) & (shared >= _need(size, t))
        entry = np.repeat(doc, counts)
        keep = alive[entry]
        gram, entry, rank = ((bucket << _B32) | low)[keep], entry[keep], rank[keep]
        order = np.lexsort((gram, rank, entry))
        gram = gram[order]
        alive = np.flatnonzero(alive)
        edge = np.r_[0, np.cumsum(shared[alive])]
        data = pa.Array.from_buffers(pa.large_binary(), len(alive), [None, pa.py_buffer((edge * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(gram))])
        return pa.table({"doc_id": pa.array(names[alive]), "size": pa.array(size[alive].astype(np.int32)), "grams": data.cast(pa.binary())})

    return run


def _sets(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sizes, n-grams of all sets one after the other, and how many each has."""
    grams = batch.column("grams").to_pylist()
    return np.asarray(batch.column("doc_id"), np.int64), np.asarray(batch.column("size"), np.int64), np.frombuffer(b"".join(grams), np.uint64), np.array([len(g) // 8 for g in grams], np.int64)


def _prefixes(t: float, buckets: int):
    """The n-grams at which a survivor can meet a partner, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, grams, has = _sets(batch)
            least = has - _need(size, t) + 1
            take = _ranges(np.cumsum(has) - has, least)
            gram, doc = grams[take], np.repeat(np.arange(len(ids)), least)
            to = (flat.mixed(gram) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            names, many = _runs(to[order])
            rows = [(b, gram[o].tobytes(), ids[doc[o]].tobytes(), size[doc[o]].astype(np.int32).tobytes()) for b, o in zip(names.tolist(), np.split(order, np.cumsum(many)[:-1]))]
            yield _batch(rows, [pa.int32()] + [pa.binary()] * 3, ["bucket", "grams", "ids", "sizes"])

    return run


def _meet(t: float):
    """Edges between survivors that meet at an n-gram, neighbours by size: they link all pairs whose sizes allow a match."""

    def run(table: pa.Table) -> pa.Table:
        gram, ids, size = _joined(table.column("grams"), np.uint64), _joined(table.column("ids"), np.int64), _joined(table.column("sizes"), np.int32).astype(np.int64)
        order = np.lexsort((ids, size, gram))
        gram, ids, size = gram[order], ids[order], size[order]
        link = (gram[1:] == gram[:-1]) & (size[:-1] >= _need(size[1:], t))
        a, b = ids[:-1][link], ids[1:][link]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.int64)
        return pa.table({"src": pa.array(pairs[1]), "dst": pa.array(pairs[0])})

    return run


class _Index:
    """Inverted index over the sets of one task; distances from one set to all."""

    def __init__(self, size: np.ndarray, grams: np.ndarray, has: np.ndarray):
        self.size, self.has, self.begin = size, has, np.cumsum(has) - has
        names, self.gram = np.unique(grams, return_inverse=True)
        doc = np.repeat(np.arange(len(size)), has)
        self.doc = doc[np.argsort(self.gram, kind="stable")]
        self.many = np.bincount(self.gram, minlength=len(names))
        self.at = np.cumsum(self.many) - self.many

    def overlaps(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets that have an n-gram in common with ``x``, and how many."""
        g = self.gram[self.begin[x] : self.begin[x] + self.has[x]]
        return np.unique(self.doc[_ranges(self.at[g], self.many[g])], return_counts=True)

    def within(self, x: int, others: np.ndarray, common: np.ndarray, times: int, f: Fraction) -> np.ndarray:
        """Whether d(x, other) <= (1 - f) * times / 2, in integers: 2 * (union - common) * den <= times * (den - num) * union."""
        union = self.size[x] + self.size[others] - common
        return 2 * (union - common) * f.denominator <= times * (f.denominator - f.numerator) * union


def cells(ids: np.ndarray, size: np.ndarray, grams: np.ndarray, has: np.ndarray, t: float) -> np.ndarray:
    """Exact groups of one task's sets: for each the position of its group's first set."""
    f, index = Fraction(str(t)), _Index(size, grams, has)
    parent = np.arange(len(ids))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def unite(x: int, others) -> None:
        for y in others:
            a, b = root(x), root(int(y))
            parent[max(a, b)] = min(a, b)

    gone = np.zeros(len(ids), bool)
    for p in np.argsort(flat.mixed(ids.astype(np.uint64)), kind="stable"):
        if gone[p]:
            continue
        other, common = index.overlaps(p)
        live = ~gone[other]
        other, common = other[live], common[live]
        near, cell, window = (index.within(p, other, common, k, f) for k in (2, 1, 3))
        unite(p, other[near & (other != p)])
        inside = other[cell]
        gone[inside] = True
        gone[p] = True
        if len(inside) > 1:
            # the cell is one group by now: only other groups' documents in the window can still add to it
            open_ = np.array([y for y in other[window & ~near].tolist() if root(y) != root(p)], np.int64)
            by_cell = len(inside) <= len(open_)
            for m in (inside if by_cell else open_).tolist():
                if by_cell and not len(open_):
                    break
                o, c = index.overlaps(m)
                hit = o[index.within(m, o, c, 2, f) & np.isin(o, open_ if by_cell else inside)]
                if len(hit):
                    unite(m, hit)
                    if by_cell:
                        open_ = np.array([y for y in open_.tolist() if root(y) != root(p)], np.int64)
    return np.array([root(int(x)) for x in range(len(ids))], np.int64)


def _join_groups(t: float):
    def run(table: pa.Table) -> pa.Table:
        ids, size, grams, has = _sets(table)
        out_a, out_b = [], []
        if len(ids):
            names, at = np.unique(ids, return_index=True)  # a document may come as a member and as part of a window
            take = _ranges((np.cumsum(has) - has)[at], has[at])
            first = cells(names, size[at], grams[take], has[at], t)
            linked = first != np.arange(len(names))
            out_a, out_b = names[linked], names[first[linked]]
        return pa.table({"src": pa.array(out_a, pa.int64()), "dst": pa.array(out_b, pa.int64())})

    return run


def _measure(pivots: list[tuple[int, int, np.ndarray]], t: float):
    """Split of large regions: a row for the nearest pivot's cell or the rest, and one for each other window."""
    f = Fraction(str(t))
    regions: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for region, size, grams in pivots:
        regions.setdefault(region, []).append((len(regions.get(region, [])), size, np.sort(grams)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, grams, has = _sets(batch)
            region = np.asarray(batch.column("region"), np.int64)
            raw, begin, rows = batch.column("grams").to_pylist(), np.cumsum(has) - has, []
            for k in range(len(ids)):
                own, cell, windows = grams[begin[k] : begin[k] + has[k]], None, []
                for number, psize, pgrams in regions[int(region[k])]:
                    place = np.minimum(np.searchsorted(pgrams, own), len(pgrams) - 1)
                    common = int((pgrams[place] == own).sum())
                    union = int(size[k]) + psize - common
                    if 2 * (union - common) * f.denominator <= (f.denominator - f.numerator) * union and (cell is None or Fraction(common, union) > cell[0]):
                        cell = (Fraction(common, union), number)
                    if 2 * (union - common) * f.denominator <= 3 * (f.denominator - f.numerator) * union:
                        windows.append(number)
                home = cell[1] if cell else -1
                rows.append((int(region[k]), home, True, int(ids[k]), int(size[k]), raw[k]))
                rows += [(int(region[k]), w, False, int(ids[k]), int(size[k]), raw[k]) for w in windows if w != home]
            yield _batch(rows, [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()], ["region", "cell", "home", "doc_id", "size", "grams"])

    return run


def _by_task(sets: DataFrame, tokens: int, cap: int) -> DataFrame:
    return sets.withColumn("task", F.pmod(F.xxhash64("region"), F.lit(max(1, math.ceil(tokens / cap)))).cast("int"))


def _regions_joined(sets: DataFrame, t: float, cap: int, depth: int = 0) -> list[DataFrame]:
    """Edges (src, dst) inside regions; ``sets`` is a written table (region, doc_id, size, grams)."""
    weight = F.octet_length("grams") / 8
    sums = written(sets.groupBy("region").agg(F.sum(weight).cast("long").alias("w"), F.count(F.lit(1)).alias("n")), "regions")
    total, large = sums.agg(F.sum(F.when(F.col("w") <= cap, F.col("w"))), F.count_if(F.col("w") > cap)).first()
    edge = "src long, dst long"
    small = sets
    if large:
        small = sets.join(sums.filter(F.col("w") <= cap).select("region"), "region", "left_semi")
    out = [_by_task(small, total or 1, min(cap, TASK_TOKENS)).groupBy("task").applyInArrow(_join_groups(t), edge)] if total else []
    if not large:
        return out
    heavy = written(sets.join(sums.filter(F.col("w") > cap), "region"), "large")
    blocks = F.greatest(F.lit(2), F.ceil(2 * F.col("w") / cap)).cast("int")
    order = "row_number() over (partition by region order by xxhash64(doc_id), doc_id)"
    pivots = heavy.selectExpr("*", f"{order} as k").filter(F.col("k") <= F.least(F.lit(16), blocks)).select("region", "size", "grams")
    if depth >= 4 or pivots.agg(F.sum(F.octet_length("grams"))).first()[0] > PIVOT_BYTES:
        # what pivots don't split: each document goes to the pairs of blocks with its own
        mine = F.pmod(F.xxhash64("doc_id", F.lit(depth)), blocks).cast("int")
        paired = heavy.select("region", "doc_id", "size", "grams", mine.alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("c"))
        return [*out, paired.groupBy("region", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi")).applyInArrow(_join_groups(t), edge)]
    held = [(r.region, r.size, np.frombuffer(r.grams, np.uint64)) for r in pivots.toLocalIterator()]
    split = written(heavy.select("region", "doc_id", "size", "grams").mapInArrow(_measure(held, t), "region long, cell int, home boolean, doc_id long, size int, grams binary"), "split")
    again = split.select(F.xxhash64("region", "cell", F.lit(depth)).alias("region"), "doc_id", "size", "grams", "cell", F.col("region").alias("was"))
    cell, rest = again.filter("cell >= 0").drop("cell", "was"), again.filter("cell < 0").drop("cell", "was")
    return [*out, *_regions_joined(written(cell.unionByName(rest), "level"), t, cap, depth + 1)]


#: Bit that tells the keys of rows with repeated ids from ids.
_OWN = -(1 << 63)


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ``_key``, which equal rows alone share, and whether it differs from doc_id.

    The key is the id where no other row has it, else a hash of id and text. Null where id or text is.
    """
    twice = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id is not null and n > 1").select(F.col("doc_id").alias("_twice")), "twice")
    n = twice.count()
    known = F.col("text").isNotNull()
    if not n:
        return docs.withColumn("_key", F.when(known, F.col("doc_id").cast("long"))), False
    joined = docs.join(F.broadcast(twice) if n <= BROADCAST_ROWS else twice, docs["doc_id"] == twice["_twice"], "left")
    own = F.xxhash64("doc_id", "text").bitwiseOR(F.lit(_OWN))
    return joined.withColumn("_key", F.when(known & F.col("doc_id").isNotNull(), F.when(F.col("_twice").isNull(), F.col("doc_id").cast("long")).otherwise(own))).drop("_twice"), True


def _distinct(texts: DataFrame) -> DataFrame:
    """One row for each (doc_id, text) of keys; only keys of repeated ids are shuffled."""
    mine = F.col("doc_id") < F.lit(0)
    return texts.filter(~mine).unionByName(texts.filter(mine).groupBy("doc_id").agg(F.min("text").alias("text")))


def survivors(docs: DataFrame, n: int = N, t: float = THRESHOLD, bucket_bytes: float = BUCKET_BYTES) -> DataFrame:
    """Step 1: documents that may have a partner, with the n-grams that others have too, rarest first.

    Buckets and parts are as many as the text's bytes ask for; n-grams are told apart by the bucket's bits and 32 more.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(_MOST_BITS, max(4, int(size // bucket_bytes).bit_length()))
    parts = 1 << bits
    blobs = texts.mapInArrow(_emit(n, bits), _BLOB)
    seen = blobs.groupBy("bucket").applyInArrow(_count(parts), _SEEN)
    return written(seen.groupBy("part").applyInArrow(_survive(t), _SET), "survivors")


def ngram_jaccard_groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, region_tokens: int = REGION_TOKENS) -> DataFrame:
    """``(doc_id, rep_id)``: every document that has a near copy, and the least id of its group.

    A group is a connected component of the graph that links documents whose
    sets of word ``n``-grams (letters and digits, lower case) have a Jaccard
    similarity of at least ``threshold`` (0.34 to 1). A text of fewer than ``n`` words is
    one gram of all of them.

    Nulls: rows without id or text, and texts without any word, are in no group.
    Repeated ids: rows with the same id and text are one document, those with the same id and
    another text are documents of their own, each with its row. Ties don't arise: similarity is compared in integers.
    An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    keyed, differs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = _groups(_texts(keyed, differs), n, threshold, region_tokens)
    return _members(found, keyed).select("doc_id", "rep_id") if differs else found.select(F.col("key").alias("doc_id"), F.col("rep").alias("rep_id"))


def _texts(keyed: DataFrame, differs: bool) -> DataFrame:
    texts = keyed.select(F.col("_key").alias("doc_id"), "text")
    return _distinct(texts) if differs else texts


def _members(found: DataFrame, keyed: DataFrame) -> DataFrame:
    """``(_key, doc_id, rep_id, first)`` of grouped documents; the first has the least (id, key) of its group."""
    ids = keyed.filter("_key is not null").select("_key", "doc_id").distinct()
    rows = written(found.select(F.col("key").alias("_key"), "rep").join(ids, "_key"), "members")
    least = rows.groupBy("rep").agg(F.min(F.struct("doc_id", "_key")).alias("least"))
    return rows.join(least, "rep").select("_key", "doc_id", F.col("least.doc_id").alias("rep_id"), (F.col("least._key") == F.col("_key")).alias("first"))


def _groups(docs: DataFrame, n: int, threshold: float, region_tokens: int) -> DataFrame:
    """``(key, rep)`` of documents (doc_id, text) with distinct ids."""
    if not 1 / 3 < threshold <= 1:
        raise ValueError("threshold must be above 1/3 and at most 1: beyond d = 2/3 windows hold everything")
    found = survivors(docs, n, threshold)
    shuffles_released(docs.sparkSession)
    # equal sets: one stands for all, so copies by the thousand cost no comparison
    # (a set with n-grams of its own, which aren't listed, equals no other)
    whole = found.filter(F.octet_length("grams") == 8 * F.col("size"))
    digest = whole.select("doc_id", F.sha2("grams", 256).alias("digest"), "size")
    least = digest.groupBy("digest", "size").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n"))
    same = digest.join(least.filter("n > 1"), ["digest", "size"]).select("doc_id", "rep_id").filter("doc_id <> rep_id")
    same = written(same, "same")
    sets = found.join(same.select("doc_id"), "doc_id", "left_anti")
    buckets = max(16, (sets.agg(F.sum(F.octet_length("grams"))).first()[0] or 0) >> 22)
    edges = sets.mapInArrow(_prefixes(threshold, buckets), "bucket int, grams binary, ids binary, sizes binary").groupBy("bucket").applyInArrow(_meet(threshold), "src long, dst long")
    region = written(connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("region")), "region")
    if region.count() <= BROADCAST_ROWS:
        region = F.broadcast(region)
    placed = written(sets.join(region, "doc_id").select("region", "doc_id", "size", "grams"), "placed")
    dropped(found)
    parts = _regions_joined(placed, threshold, region_tokens)
    links = same.select(F.col("doc_id").alias("src"), F.col("rep_id").alias("dst"))
    for p in parts:
        links = links.unionByName(p)
    return connected_components(links).select(F.col("node").alias("key"), F.col("component").alias("rep"))


def near_duplicates_dropped(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that are near copies of one with a lower id.

    Rows without id or text stay. Of rows equal in id and text one stays; rows that only share an id are
    documents of their own, and of a group of them the one with the least hash. Ties, other columns and an empty table
    are as in :func:`ngram_jaccard_groups`; all columns are kept.
    """
    keyed, differs = _keyed(docs)
    found = _groups(_texts(keyed, differs), n, threshold, REGION_TOKENS)
    if not differs:
        gone = found.filter("key <> rep").select(F.col("key").alias("_gone"))
        return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    again = F.col("_key") < 0
    once = keyed.filter(~F.coalesce(again, F.lit(False))).unionByName(keyed.filter(again).dropDuplicates(["_key"]))
    gone = _members(found, keyed).filter(~F.col("first")).select(F.col("_key").alias("_gone"))
    return once.join(gone, once["_key"] == gone["_gone"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
