"""Language-model scores by online logistic context mixing: total bits per byte.

*Counts.* Every text falls into one of two halves by a hash of its row. One pass
counts, for each half and context order, which byte follows which hashed context;
the counts are summed by a shuffle, range by range of the hash, and become rows
of bit predictions in one file in the shared folder, with twice as many rows
as there are distinct contexts, so the file grows with the corpus. A row
carries a check byte, so that a context that was never seen isn't taken for
another one. Executors map the file into memory; it is not copied to workers.

*Mixing.* A text is coded bit by bit with the counts of the *other* half, which
can't hold the text itself. The predictions of all orders are combined in the
logistic domain by weights that are gated by the bit's place in its byte and learn
online, every ``STEP`` bytes, from the bits coded; an adaptive probability map
refines the result, and its logarithm is the cost. Weights and map are carried
through a text from its first byte to its last, however long it is.

*Long contexts.* Content decides where a text is cut: where a hash of the 16
bytes before is a multiple of ``DENSITY``. How often, in all *other* texts, the same
segment follows the same 16 bytes is counted over the whole corpus, and a segment's
probability is a mixture of that share and the one found bit by bit. So a
passage that other texts have too costs next to nothing.
"""

from __future__ import annotations

import fcntl
import os
import shutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dittograph.llm import flat
from dittograph.storage import deleted, dropped, fresh, written

#: Bytes of context of each predictor, at most 7.
ORDERS = (1, 2, 3, 5)
#: Bytes between two updates of the weights and the map.
STEP = 32
RATE, START, SCALE, PRIOR = np.float32(0.01), np.float32(0.5), 12, 0.4
#: Steps of a logit in the table of the logistic function, the logit's bound, and how many steps share a cell of the map.
_FINE, _CLIP, _SHARED = 32, 11, 5
_MAP_RATE, _LEAST = np.float32(0.02), np.float32(1e-4)
_CELLS = (2 * _CLIP * _FINE >> _SHARED) + 1
_LOGISTIC = (1 / (1 + np.exp(-(np.arange(2 * _CLIP * _FINE + 1) / _FINE - _CLIP)))).astype(np.float32)
#: Bytes of context before a segment, one cut in so many bytes, and how many unseen continuations a context counts for.
LONG, DENSITY, UNSEEN = 16, 128, 0.5
#: Bytes of text counted at once.
SLAB = 8 << 20
#: Bytes of texts that are sorted by length, so that those of like length are coded side by side.
#: A longer text is coded in windows, and a cut falls between them.
POOL, WINDOW = 4 << 20, 1 << 20
#: Rows of a table for every two distinct contexts.
ROOM = 4
#: Bytes of text for each range of hashes that one reducing task sums.
RANGE_BYTES = 64 << 20
_LANES = 64
_BLOCK = 1 << 16
_HASH = 40  # bits of a context's hash that are counted by
_SCORED = "_rid long, bytes long, _bits double, _segments array<struct<a:bigint,s:bigint,first:boolean,own:int,bits:float>>"


def _hashed(c: np.ndarray, k: int) -> np.ndarray:
    """Hash, in its highest bits, of a context of ``k`` bytes given as an integer; works in place."""
    c *= np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    c ^= c >> np.uint64(31)
    c *= np.uint64(0xD6E8FEB86659FD93)
    c &= np.uint64(((1 << _HASH) - 1) << (64 - _HASH))
    return c


def _short(c, t):
    """A context of which the text has only ``t`` bytes."""
    return c & np.uint64((1 << 8 * t) - 1) | np.uint64((t + 1) << 56)


def contexts(raw: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes before each byte in its text, worked out in blocks that stay in the cache."""
    out = np.zeros(len(raw), np.uint64)
    for i in range(0, len(raw), _BLOCK):
        c = out[i : i + _BLOCK]
        for j in range(1, k + 1):
            first = max(0, j - i)
            c[first:] |= raw[max(0, i - j) : i + len(c) - j].astype(np.uint64) << np.uint64(8 * (j - 1))
        begin = at[:-1][np.searchsorted(at[:-1], i - k) : np.searchsorted(at[:-1], i + len(c))] - i
        for t in range(k - 1, -1, -1):  # of empty texts at the same place the next one counts
            here = begin + t
            here = here[(here >= 0) & (here < len(c))]
            c[here] = _short(c[here], t)
        _hashed(c, k)
    return out


def _spread(low: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Hash with the ``bits`` highest bits of ``h``, so that a range's rows stay in its range."""
    low *= np.uint64(0xBF58476D1CE4E5B9)
    low ^= low >> np.uint64(29)
    low *= np.uint64(0x94D049BB133111EB)
    if bits:
        low >>= np.uint64(bits)
        low |= h & np.uint64(((1 << bits) - 1) << (64 - bits))
    return low


def lower_rows(h: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of the rows for lower half-bytes, of contexts and the upper half-byte."""
    return _spread((h >> np.uint64(64 - _HASH)) * np.uint64(32) + high + np.uint64(1), h, bits)


def upper_rows(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of the rows for upper half-bytes."""
    return _spread((h >> np.uint64(64 - _HASH)) * np.uint64(32), h, bits)


def _slots(name: np.ndarray, rows: int) -> np.ndarray:
    """Row of a table of ``rows`` rows for each hash, in the order of hashes."""
    return ((name >> np.uint64(32)) * np.uint64(rows) >> np.uint64(32)).astype(np.int64)


def pieces(batch: pa.RecordBatch, most: int, back: int, window: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Texts in groups of about ``most`` bytes: first row, rows, bytes, offsets, bytes of the same text left out before.

    A longer text comes alone, in windows of ``window`` bytes (``most`` by default) with up to ``back`` bytes before each.
    """
    start, window = 0, window or most
    for part in flat.chunks(batch, "text", most):
        raw, at = flat.utf8(part.column("text"))
        if part.num_rows > 1 or len(raw) <= most:
            yield start, part.num_rows, raw, at, 0
        else:
            for begin in range(0, len(raw), window):
                piece = raw[max(0, begin - back) : begin + window]
                yield start, 1, piece, np.array([0, len(piece)]), begin
        start += part.num_rows


def fold() -> Column:
    """Half that a row is in: 0 or 1."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int")


def _sums(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` of each; without ``n`` how often each is there, and ``keys`` get sorted."""
    if n is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)]) if n is None else np.add.reduceat(n, first) if len(first) else n


def _planes(x: np.ndarray, kind: str) -> bytes:
    """All lowest bytes, then the next ones: zeros and what varies slowly lie together."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _counted(orders: tuple[int, ...], bits: int):
    """Counts of each slab's texts by order and range: contexts, how many bytes follow each, the bytes, the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = np.asarray(batch.column("fold"), np.uint16)
            for start, count, raw, at, before in pieces(batch, SLAB, 7):
                skip = min(7, before)
                if not len(raw):
                    continue
                low = np.repeat(folds[start : start + count] << np.uint16(8), np.diff(at))
                low |= raw
                rows = []
                for k, order in enumerate(orders):
                    keys = contexts(raw, at, order)[skip:]
                    keys |= low[skip:]
                    keys, n = _sums(keys)
                    ctx = keys >> np.uint64(8)
                    new = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
                    many = (np.diff(np.r_[new, len(ctx)]) - 1).astype(np.uint8)
                    hashed = keys[new]
                    edge = np.searchsorted(hashed, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
                    edge = np.r_[0, edge, len(new)]
                    ends = np.r_[new, len(keys)]
                    byte = keys.astype(np.uint8)
                    for b in np.flatnonzero(np.diff(edge)).tolist():
                        i, j = edge[b], edge[b + 1]
                        x, y = ends[i], ends[j]
                        head = (hashed[i:j] >> np.uint64(64 - _HASH) << np.uint64(1)) | (hashed[i:j] >> np.uint64(8)) & np.uint64(1)
                        rows.append(((k << bits) + b, k, b, _planes(head, "<u8"), many[i:j].tobytes(), byte[x:y].tobytes(), _planes(n[x:y], "<u4")))
                types = [pa.int32()] * 3 + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["to", "predictor", "range", "heads", "many", "next", "n"])

    return run


def predictions(counts: np.ndarray) -> np.ndarray:
    """Bit predictions, logits times ``SCALE`` in one byte, from counts of 16 half-bytes a row."""
    c = counts.reshape(-1, 16).astype(np.float64)
    out = np.zeros_like(c)
    for depth in range(4):
        width = 8 >> depth
        halves = c.reshape(len(c), 1 << depth, 2, width).sum(3)
        out[:, 1 << depth : 2 << depth] = np.log((halves[:, :, 1] + PRIOR) / (halves[:, :, 0] + PRIOR))
    return np.clip(np.round(out * SCALE), -127, 127).astype(np.int8)


def _rows(keys: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and predictions of the rows of one half's counts, the least frequent rows first."""
    h, byte = keys & ~np.uint64(0x1FF), keys & np.uint64(0xFF)
    out = []
    for row, half in ((upper_rows(h, bits), byte >> np.uint64(4)), (lower_rows(h, byte >> np.uint64(4), bits), byte & np.uint64(15))):
        names, which = np.unique(row, return_inverse=True)
        counts = np.bincount(which * 16 + half.astype(np.int64), n, minlength=16 * len(names)).reshape(-1, 16)
        logits = predictions(counts)
        logits[:, 0] = (names >> np.uint64(4)).astype(np.uint8).view(np.int8)
        out.append((names, logits, counts.sum(1)))
    names, logits, total = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(total, kind="stable")
    return names[order], logits[order]


def _summed(bits: int):
    """Rows of predictions for each half, from the counts of the other one; slabs' counts are merged as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for k, b, heads, many, follow, n in zip(*(batch.column(c).to_pylist() for c in ("predictor", "range", "heads", "many", "next", "n"))):
                head = _unplaned(heads, "<u8")
                key = (head >> np.uint64(1) << np.uint64(64 - _HASH)) | (head & np.uint64(1)) << np.uint64(8)
                key = np.repeat(key, np.frombuffer(many, np.uint8).astype(np.int64) + 1) | np.frombuffer(follow, np.uint8)
                n = _unplaned(n, "<u4").astype(np.int64)
                runs = held.setdefault((k, b), [])
                runs.append((key, n))
                if len(runs) > 1 and sum(len(x) for x, _ in runs[1:]) > max(1 << 20, len(runs[0][0])):
                    runs[:] = [_sums(*(np.concatenate(x) for x in zip(*runs)))]
        for (k, b), runs in held.items():
            keys, n = _sums(*(np.concatenate(x) for x in zip(*runs)))
            which, rows = (keys >> np.uint64(8)) & np.uint64(1), []
            for half in (0, 1):
                other = which != half
                names, logits = _rows(keys[other], n[other], bits)
                rows.append((k, half, b, len(names), names.tobytes(), logits.tobytes()))
            types = [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["predictor", "half", "range", "n", "names", "logits"])

    return run


def _placed(uri: str, sizes: tuple[int, ...], bits: int):
    """Write each range of each table as a file; where rows meet, the most frequent one stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            done = []
            for k, half, b, names, logits in zip(*(batch.column(c).to_pylist() for c in ("predictor", "half", "range", "names", "logits"))):
                own = sizes[k] >> bits
                table = np.zeros((own, 16), np.int8)
                table[_slots(np.frombuffer(names, np.uint64), sizes[k]) - b * own] = np.frombuffer(logits, np.int8).reshape(-1, 16)
                name = f"{k}-{half}-{b}"
                tmp = f"{root}/.tmp-{name}-{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(tmp) as out:
                    out.write(table)
                fs.move(tmp, f"{root}/{name}")
                done.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["name"])

    return run


class Tables:
    """Predictions of all orders in one file: for each order so many ``rows`` for one half, then for the other."""

    def __init__(self, uri: str, orders: tuple[int, ...], rows: tuple[int, ...], bits: int):
        self.uri, self.orders, self.rows, self.bits = uri, orders, rows, bits

    def _local(self) -> str:
        """Path of the file; from a folder that can't be mapped it is copied, once for each executor, to Spark's own folder."""
        fs, path = pafs.FileSystem.from_uri(self.uri)
        if isinstance(fs, pafs.LocalFileSystem):
            return path
        here = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(path))
        with open(f"{here}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not os.path.exists(here):
                with fs.open_input_stream(path) as source, open(f"{here}.part", "wb") as to:
                    shutil.copyfileobj(source, to, 16 << 20)
                os.rename(f"{here}.part", here)
        return here

    def mapped(self) -> list[np.ndarray]:
        """The rows of each order, as items of 16 bytes."""
        whole, out, begin = np.asarray(np.memmap(self._local(), np.complex128, "r")), [], 0
        for rows in self.rows:
            out.append(whole[begin : begin + 2 * rows])
            begin += 2 * rows
        return out


def gathered(docs: DataFrame, orders: tuple[int, ...] = ORDERS) -> Tables:
    """Tables of bit predictions for each half of ``docs`` (doc_id, text) from the texts of the other half."""
    if not 1 <= min(orders) <= max(orders) <= 7:
        raise ValueError("orders must be from 1 to 7")
    texts = docs.select(F.col("text").cast("string").alias("text"), fold().alias("fold"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(16, max(0, (size // RANGE_BYTES).bit_length()))
    parts = texts.mapInArrow(_counted(orders, bits), "to int, predictor int, range int, heads binary, many binary, next binary, n binary")
    sums = written(parts.repartitionById(len(orders) << bits, "to").mapInArrow(_summed(bits), "predictor int, half int, range int, n long, names binary, logits binary"), "sums")
    rows = {r.predictor: r.n for r in sums.groupBy("predictor", "half").agg(F.sum("n").alias("n")).groupBy("predictor").agg(F.max("n").alias("n")).collect()}
    sizes = tuple((ROOM * rows.get(k, 0) // 2 >> bits) + 16 << bits for k in range(len(orders)))
    spark = docs.sparkSession
    uri = fresh(spark, "tables")
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(f"{root}/ranges", recursive=True)
    # one job for all ranges: an iterator over its rows would run a job for each partition, one after the other
    there = {r.name for r in sums.mapInArrow(_placed(f"{uri}/ranges", sizes, bits), "name string").collect()}
    with fs.open_output_stream(f"{root}/tables.bin") as out:
        for k, n in enumerate(sizes):
            for name in (f"{k}-{half}-{r}" for half in (0, 1) for r in range(1 << bits)):
                if name in there:
                    with fs.open_input_stream(f"{root}/ranges/{name}") as source:
                        shutil.copyfileobj(source, out, 8 << 20)
                    fs.delete_file(f"{root}/ranges/{name}")
                else:
                    out.write(bytes(16 * (n >> bits)))
    deleted(spark, f"{uri}/ranges")
    dropped(sums)
    return Tables(f"{uri}/tables.bin", orders, sizes, bits)


class State:
    """Weights (order, bit, text) and maps (bit, text, cell) of texts side by side; fresh ones know nothing."""

    def __init__(self, k: int, lanes: int):
        # in such units that a weighted sum of inputs is a place in the table of the logistic function
        self.weights = np.full((k, 8, lanes), START * 2 / k / SCALE * _FINE, np.float32)
        middle = np.minimum(((np.arange(_CELLS) << _SHARED) + (1 << _SHARED - 1)), len(_LOGISTIC) - 1)
        self.cells = np.tile(_LOGISTIC[middle], (8, lanes, 1))


def _inputs(rows: np.ndarray, check: np.ndarray, nodes: list[np.ndarray], out: np.ndarray) -> None:
    """Fill ``out`` (4, byte) with the predictions on the way to a half-byte, 0 where the row is of another context."""
    x = rows.view(np.int8).reshape(-1, 16)
    known, every = (x[:, 0] == check).view(np.int8), x.ravel()
    np.multiply(x[:, 1], known, out=out[0])
    for d, at in enumerate(nodes):
        every.take(at, out=out[d + 1], mode="clip")
        out[d + 1] *= known


def mixed_bits(raw: np.ndarray, at: np.ndarray, folds: np.ndarray, maps: list[np.ndarray], tables: Tables, state: State | None = None, skip: int = 0, begun: bool = False) -> np.ndarray:
    """Bits that each byte costs. With ``state`` a single text is coded; it goes on, where ``begun``, after ``skip`` bytes that only are context.

    Texts of like length advance side by side, a block of bytes after the other, so that all arrays of a block stay in the cache.
    """
    cost, orders = np.zeros(len(raw), np.float32), tables.orders
    size, k, back = np.diff(at) - skip, len(orders), max(orders)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    for g in range(0, len(order), _LANES):
        lanes = order[g : g + _LANES]
        start, length, s = at[lanes] + skip, size[lanes], state or State(k, len(lanes))
        t0 = 0
        while t0 < length[0]:
            m = int(np.searchsorted(-length, -t0))  # texts that still have a byte
            rows = min(-(-(int(length[0]) - t0) // STEP) * STEP, max(STEP, _BLOCK // 2 // m // STEP * STEP))
            place = start[:m] + np.arange(t0 - back, t0 + rows)[:, None]
            real = place[back:] < (start + length)[:m]
            block = raw.take(place, mode="clip")
            mine, wide = block[back:].ravel(), block.astype(np.uint64)
            high = mine >> 4
            low = mine & 15
            six = np.arange(len(mine)) * 16
            nodes = [[six + (2 | x >> 3), six + (4 | x >> 2), six + (8 | x >> 1)] for x in (high, low)]
            logits = np.empty((k, 8, len(mine)), np.int8)
            c = np.zeros((rows, m), np.uint64)
            for b in range(1, back + 1):
                c |= wide[back - b : back - b + rows] << np.uint64(8 * (b - 1))
                if b not in orders:
                    continue
                j, h = orders.index(b), c.copy()
                if not begun:
                    for t in range(t0, min(b, t0 + rows)):
                        h[t - t0] = _short(h[t - t0], t)
                h = _hashed(h, b).ravel()
                for part, name in ((0, upper_rows(h, tables.bits)), (1, lower_rows(h, high, tables.bits))):
                    check = (name >> np.uint64(4)).astype(np.uint8).view(np.int8)
                    where = _slots(name, tables.rows[j]).reshape(rows, m)
                    where += folds[lanes[:m]] * tables.rows[j]
                    _inputs(maps[j].take(where.ravel(), mode="clip"), check, nodes[part], logits[j, 4 * part : 4 * part + 4])
            whole = bool(real.all())
            if not whole:
                logits *= real.ravel().view(np.int8)
            bits = ((mine >> np.arange(7, -1, -1, dtype=np.uint8)[:, None]) & 1).astype(np.float32)
            p = _stepped(s, logits, bits, None if whole else real, rows, m)
            np.log2(p, out=p)
            if whole:
                cost[place[back:]] = -p.reshape(rows, m)
            else:
                cost[place[back:][real]] = -p.reshape(rows, m)[real]
            t0 += rows
    return cost


def _stepped(s: State, logits: np.ndarray, bits: np.ndarray, real: np.ndarray | None, rows: int, m: int) -> np.ndarray:
    """Probability of each byte of a block, row by row of ``m`` texts; weights and maps are updated every ``STEP`` rows."""
    k, out, n = len(logits), np.empty((rows, m), np.float32), 8 * m
    rate, half, top = np.float32(RATE / SCALE / SCALE * _FINE), np.float32(_CLIP * _FINE + 0.5), np.float32(2 * _CLIP * _FINE)
    x = np.empty((k, STEP, n), np.float32)
    bit, dot, p, a, mean = (np.empty((STEP, n), np.float32) for _ in range(5))
    cell, first = np.empty((STEP, n), np.int64), np.arange(n) * _CELLS
    # the texts that are left lie together while the block lasts
    w, cells = s.weights[:, :, :m].reshape(k, n).copy(), s.cells[:, :m].ravel()
    logits, bits = logits.reshape(k, 8, rows, m).swapaxes(1, 2), bits.reshape(8, rows, m).swapaxes(0, 1)
    for t in range(0, rows, STEP):
        np.copyto(x.reshape(k, STEP, 8, m), logits[:, t : t + STEP])
        np.copyto(bit.reshape(STEP, 8, m), bits[t : t + STEP])
        np.einsum("ktn,kn->tn", x, w, out=dot)
        dot += half
        np.minimum(dot, top, out=dot)
        np.maximum(dot, 0, out=dot)
        np.copyto(cell, dot, casting="unsafe")
        _LOGISTIC.take(cell, out=p, mode="clip")
        cell >>= _SHARED
        cell += first
        cells.take(cell, out=a, mode="clip")
        # of the bit that came: 1 - |bit - (p + a) / 2|
        np.add(a, p, out=mean)
        mean *= np.float32(-0.5)
        mean += bit
        np.abs(mean, out=mean)
        np.subtract(1, mean, out=mean)
        np.maximum(mean, _LEAST, out=mean)
        np.multiply.reduce(mean.reshape(STEP, 8, m), 1, out=out[t : t + STEP])
        # updates, from real bytes only
        np.subtract(bit, a, out=a)
        a *= _MAP_RATE
        if real is not None:
            a.reshape(STEP, 8, m)[:] *= real[t : t + STEP, None]
        np.add.at(cells, cell.ravel(), a.ravel())
        np.subtract(bit, p, out=p)
        p *= rate
        w += np.einsum("ktn,tn->kn", x, p)
    s.weights[:, :, :m], s.cells[:, :m] = w.reshape(k, 8, m), cells.reshape(8, m, _CELLS)
    return out.ravel()


def cuts(raw: np.ndarray, at: np.ndarray, before: int = 0, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all texts: first byte, end, key of the 16 bytes before (0 at a text's begin), key of segment and these.

    ``raw`` begins ``before`` bytes into a text, with ``skip`` bytes of it in front.
    """
    h = raw.astype(np.uint64) + np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    for width in (1, 2, 4, 8):  # from 1 to 16 bytes
        more = h[: len(h) - width] * np.uint64(pow(0xD6E8FEB86659FD93, width, 1 << 64))
        h = h.copy()
        h[width:] += more
    before16 = np.zeros(len(raw), np.uint64)
    before16[1:] = h[:-1]
    before16 = flat.mixed(before16)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    cut = (before16 % np.uint64(DENSITY)) == 0
    for t in range(LONG):  # too near to the begin
        near = at[:-1] + t
        cut[near[near < at[1:]]] = False
    first = at[:-1][np.diff(at) > 0]
    if before:
        cut[: skip + 1] = False
        cut[skip] = True
        first = first[:0]
    cut[first] = True
    start = np.flatnonzero(cut)
    if not len(start):
        none = np.empty(0, np.int64)
        return none, none, none, none
    end = np.minimum(np.r_[start[1:], len(raw)], at[1:][text[start]])
    a = before16[start] | np.uint64(1)
    fresh_ = np.isin(start, first)
    a[fresh_] = 0
    # the key also says whether the text ends there
    key = flat.span_hashes(raw, np.where(fresh_, start, np.maximum(start - LONG, 0)), end)
    key = flat.mixed(key ^ (a * np.uint64(0xBF58476D1CE4E5B9)) ^ (end == at[1:][text[start]]).astype(np.uint64))
    return start, end, a.view(np.int64), key.view(np.int64)


def _scored(tables: Tables):
    """For each text its bytes, its bits without long contexts, and its segments with theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, serial = tables.mapped(), TaskContext.get().partitionId() << 40
        for batch in batches:
            folds, size, state = np.asarray(batch.column("_fold"), np.int64), batch.num_rows, None
            found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))]
            for start, count, raw, at, before in pieces(batch, POOL, LONG, WINDOW):
                skip = min(LONG, before)
                if not before:
                    state = State(len(tables.orders), 1) if count == 1 else None
                cost = mixed_bits(raw, at, folds[start : start + count], maps, tables, state, skip, before > 0)
                first = 0
                while first < count:  # texts of about a window at a time
                    last = max(first + 1, int(np.searchsorted(at, at[first] + WINDOW, "right")) - 1)
                    own = at[first : last + 1] - at[first]
                    i, j, a, key = cuts(raw[at[first] : at[last]], own, before, skip)
                    sums = np.r_[0, np.cumsum(cost[at[first] : at[last]], dtype=np.float64)]
                    found.append((start + first + np.searchsorted(own, i, "right") - 1, sums[j] - sums[i], a, key))
                    first = last
            of, bits, a, key = (np.concatenate(x) for x in zip(*found))
            # a segment that comes again in its text counts once; own: how many different ones follow the same bytes there
            order = np.lexsort((key, a, of))
            x = np.stack([of, a, key])[:, order]
            differs = np.ones((2, len(of)), bool)
            differs[0, 1:] = (x[:2, 1:] != x[:2, :-1]).any(0)
            differs[1, 1:] = (x[:, 1:] != x[:, :-1]).any(0)
            group = np.cumsum(differs[0]) - 1
            first, own = np.empty(len(of), bool), np.empty(len(of), np.int32)
            first[order] = differs[1]
            own[order] = np.bincount(group, differs[1])[group]
            items = pa.StructArray.from_arrays([pa.array(a), pa.array(key), pa.array(first), pa.array(own), pa.array(bits.astype(np.float32))], ["a", "s", "first", "own", "bits"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(size + 1)).astype(np.int32)), items)
            more = [pa.array(serial + np.arange(size)), pc.cast(pc.binary_length(batch.column("text")), pa.int64()), pa.array(np.bincount(of, bits, minlength=size)), lists]
            serial += size
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *more], names=["_row", "_rid", "bytes", "_bits", "_segments"])

    return run


def scored(docs: DataFrame, tables: Tables) -> DataFrame:
    """Columns of ``docs`` but text, with ``bytes``, ``bits`` and ``bits_per_byte`` under ``tables`` and the long contexts of ``docs``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("bytes", "bits", "bits_per_byte", "text")]).alias("_row")
    picked = docs.select(row, F.col("text").cast("string").alias("text"), fold().alias("_fold"))
    schema = StructType([picked.schema["_row"], *StructType.fromDDL(_SCORED).fields])
    # written once: the serial numbers are those of the tasks that wrote
    table = written(picked.mapInArrow(_scored(tables), schema), "scored")
    each = table.select("_rid", F.explode("_segments").alias("x")).select("_rid", "x.*")
    seen = each.filter("first").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"))
    inner = seen.filter("a <> 0")
    follow = inner.groupBy("a").agg(F.sum("n").alias("m")).filter("m > 1")
    texts = table.filter("bytes > 0").count()
    begin = seen.filter("a = 0 and n > 1").select("s", "n", F.lit(texts).cast("long").alias("m"))
    hit = each.join(inner.join(follow, "a").select("s", "n", "m").unionByName(begin), "s")
    n, m, b = F.col("n") - 1, F.col("m") - F.col("own"), F.col("bits").cast("double")
    weight = F.when(F.col("a") == 0, F.lit(0.5)).otherwise(m / (m + UNSEEN))
    known, new = F.log2(weight * n / m), F.log2(1 - weight) - b
    both = F.greatest(known, new) + F.log2(1 + F.pow(F.lit(2.0), -F.abs(known - new)))
    # every text but a lone one pays a bit for the chance that another begins like it
    gain = b + F.when(n > 0, both).otherwise(new) + F.when(F.col("a") == 0, 1).otherwise(0)
    gains = hit.filter(m > 0).select("_rid", gain.alias("gain")).groupBy("_rid").agg(F.sum("gain").alias("gain"))
    more = F.when((F.col("bytes") > 0) & F.lit(texts > 1), 1.0).otherwise(0.0)
    bits = F.when(F.col("bytes").isNotNull(), F.round(F.greatest(F.col("_bits") + more - F.coalesce("gain", F.lit(0.0)), F.lit(0.0)), 2))
    rate = F.when(F.col("bytes") > 0, F.round(F.col("bits") / F.col("bytes"), 4))
    out = table.select("_row", "_rid", "bytes", "_bits").join(gains, "_rid", "left").select("_row", "bytes", bits.alias("bits"))
    return out.select("_row.*", "bytes", "bits", rate.alias("bits_per_byte"))


def score(docs: DataFrame, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """Columns of ``docs`` but text, with ``bytes``, ``bits`` and ``bits_per_byte`` of each text, predicted from the other texts.

    A null text has nulls; an empty one 0 bytes, 0 bits and a null rate. Ids may be
    null or repeat, and ties can't arise: rows are scored one by one. A row that repeats another one is in the
    same half, so the counts of short contexts don't have it; its long
    contexts do. A very long text is coded whole, window after window, with one
    state. Columns of those three names are replaced, text is left out, all others stay. An empty table gives an empty one.
    """
    return scored(docs, gathered(docs, orders))
