"""Token-id output: documents packed into rows of one length by best-fit decreasing.

Documents fall into groups by a hash of their id, as many as the text's size
asks for. In a group every document is tokenised; one longer than a row is split
losslessly into full rows and a rest. The pieces, longest first, go each into the
open row with the least room that still holds it. A segment tree over room
finds that row in O(log length), so packing a group costs O(pieces * log length).
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
#: How the vocabulary's texts were cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text in a group: what one task packs.
GROUP_BYTES = 16 << 20
_ROW = "grp int, row int, ids binary, n_tokens int, cu_seqlens array<int>, positions binary, doc_ids array<long>, doc_starts array<long>"
_INDEX = "grp int, row int, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_READ_ROWS = 256


class RoomTree:
    """Segment tree over the room left in rows: the least room of at least a size, and a row that has it."""

    def __init__(self, length: int):
        self.leaves = 1 << max(1, length.bit_length())
        self.tree = [False] * (2 * self.leaves)  # whether a row with such room is below
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        k = room + self.leaves
        while k and not self.tree[k]:
            self.tree[k] = True
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return a row (row, room) of the least room that holds ``size``; of equal ones the latest."""
        tree, k = self.tree, size + self.leaves
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        room = k - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            tree[k] = False
            k >>= 1
            while k and not (tree[2 * k] or tree[2 * k + 1]):
                tree[k] = False
                k >>= 1
        return row, room


def best_fit_decreasing(sizes: np.ndarray, length: int) -> np.ndarray:
    """Row of each piece: pieces from the longest, ties in the given order, each into the fullest row that holds it."""
    rooms, out, used = RoomTree(length), np.empty(len(sizes), np.int64), 0
    for piece in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size = int(sizes[piece])
        found = rooms.take(size)
        row, room = found if found else (used, length)
        used += found is None
        out[piece] = row
        if room > size:
            rooms.add(row, room - size)
    return out


_encodings: dict[str, object] = {}


def _encoding(ranks: bytes):
    """tiktoken's byte-pair encoder for a vocabulary file's content, kept for the worker's life."""
    import tiktoken

    key = str(hash(ranks))
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def pack(ids: list[int], tokens: list[np.ndarray], length: int) -> list[tuple]:
    """Rows of one group: (ids, cu_seqlens, positions, doc_ids, doc_starts) of all documents."""
    docs, begins, sizes = [], [], []
    for k, t in enumerate(tokens):
        for at in range(0, len(t), length):
            docs.append(k)
            begins.append(at)
            sizes.append(min(length, len(t) - at))
    if not sizes:
        return []
    where = best_fit_decreasing(np.array(sizes), length)
    order = np.lexsort((np.arange(len(where)), -np.array(sizes), where))
    rows = []
    for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        flat = np.concatenate([tokens[docs[p]][begins[p] : begins[p] + sizes[p]] for p in part])
        cut = np.r_[0, np.cumsum([sizes[p] for p in part])]
        places = np.arange(len(flat)) - np.repeat(cut[:-1], np.diff(cut))
        rows.append((flat.astype("<u4"), cut.tolist(), places.astype("<u4"), [ids[docs[p]] for p in part], [begins[p] for p in part]))
    return rows


def _packed(ranks: bytes, length: int, end: int):
    def run(table: pa.Table) -> pa.Table:
        encoding = _encoding(ranks)
        grp = table.column("grp")[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids, tokens = table.column("doc_id").to_pylist(), []
        for text in table.column("text"):
            tokens.append(np.array([*encoding.encode_ordinary(text.as_py()), end], np.uint32))
        rows = pack(ids, tokens, length)
        columns = [
            pa.array([grp] * len(rows), pa.int32()),
            pa.array(range(len(rows)), pa.int32()),
            pa.array([r[0].tobytes() for r in rows], pa.binary()),
            pa.array([len(r[0]) for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.list_(pa.int32())),
            pa.array([r[2].tobytes() for r in rows], pa.binary()),
            pa.array([r[3] for r in rows], pa.list_(pa.int64())),
            pa.array([r[4] for r in rows], pa.list_(pa.int64())),
        ]
        return pa.Table.from_arrays(columns, ["grp", "row", "ids", "n_tokens", "cu_seqlens", "positions", "doc_ids", "doc_starts"])

    return run


def packed(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end: int = END, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Packed rows (grp, row, ids, n_tokens, cu_seqlens, positions, doc_ids, doc_starts).

    ``ids`` are the row's token ids, at most ``length``, as little-endian uint32;
    ``cu_seqlens`` the ends of its segments, from 0; ``positions`` count from 0 in
    each segment, also uint32; ``doc_ids`` and ``doc_starts`` say of which document
    each segment is, and from which of its tokens on. Every document ends with ``end``.

    Rows with a null id or text are left out; an empty text is ``end`` alone. Rows
    with equal ids are packed each; ties in length go by id, then text, so the
    result is the same for any partitioning. A very long text is split over
    rows without loss. Other columns are not read; an empty table gives no rows.
    One shuffle, of the texts.
    """
    return _by_group(docs, group_bytes).applyInArrow(_packed(_ranks(vocabulary), length, end), _ROW)


def _ranks(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as f:
        return f.read()


def _by_group(docs: DataFrame, group_bytes: int):
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    grp = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")
    return texts.withColumn("grp", grp).groupBy("grp")


def _kind(most: int) -> str:
    """The least unsigned type that holds numbers up to ``most``."""
    return "<u2" if most < 1 << 16 else "<u4"


def _saved(table: pa.Table, uri: str, length: int, pad: int, most_id: int) -> None:
    """Write the files of one group, whose rows are in order."""
    fs, root = pafs.FileSystem.from_uri(uri)
    grp = table.column("grp")[0].as_py()
    kinds = {"ids": _kind(max(most_id, pad)), "positions": _kind(length)}
    ids, places = np.full((table.num_rows, length), pad, kinds["ids"]), np.zeros((table.num_rows, length), kinds["positions"])
    for k, (a, b) in enumerate(zip(table.column("ids"), table.column("positions"))):
        a, b = np.frombuffer(a.as_py(), "<u4"), np.frombuffer(b.as_py(), "<u4")
        ids[k, : len(a)], places[k, : len(b)] = a, b
    cuts = table.column("cu_seqlens").combine_chunks()
    shape = {"rows": table.num_rows, "length": length, "types": kinds, "segments": [len(c) - 1 for c in table.column("cu_seqlens").to_pylist()]}
    files = {f"ids-{grp:06d}.bin": ids, f"positions-{grp:06d}.bin.zst": pa.compress(places.tobytes(), "zstd"), f"cu-{grp:06d}.bin": np.asarray(cuts.flatten(), "<u4").tobytes(), f"{grp:06d}.json": json.dumps(shape).encode()}
    for name, data in files.items():
        tmp = f"{root}/.tmp-{name}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        with fs.open_output_stream(tmp) as out:
            out.write(data)
        fs.move(tmp, f"{root}/{name}")


def write_matrices(rows: DataFrame, uri: str, length: int = LENGTH, pad: int = END, most_id: int = END) -> DataFrame:
    """Write packed rows as binary files at ``uri`` and return (file, grp, n_rows, n_tokens).

    For each group ``g``: ``ids-g.bin``, a matrix (rows x ``length``) padded with ``pad``, and ``positions-g.bin.zst``,
    one padded with 0 and compressed, for ramps take next to no room then; both of uint16 where ``most_id`` or ``length``
    allows, else uint32. ``cu-g.bin`` has all rows' cumulative segment lengths (uint32), ``g.json`` shapes and types. Each file
    has a temporary name until it is whole; a repeated task writes the same bytes. An empty table gives no files and no rows.
    """

    def run(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        _saved(table.sort_by("row"), uri, length, pad, most_id)
        return pa.table({"file": [f"ids-{grp:06d}.bin"], "grp": pa.array([grp], pa.int32()), "n_rows": pa.array([table.num_rows], pa.int64()), "n_tokens": pa.array([sum(table.column("n_tokens").to_pylist())], pa.int64())})

    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    return rows.groupBy("grp").applyInArrow(run, "file string, grp int, n_rows long, n_tokens long")


def _read_back(uri: str, length: int, most_id: int):
    """Rows of the index with their ids and positions, from the matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        held, places = None, np.empty((0, length), _kind(length))
        for batch in batches:
            for at in range(0, batch.num_rows, _READ_ROWS):
                part = batch.slice(at, _READ_ROWS)
                out: dict[str, list[bytes]] = {"ids": [], "positions": []}
                grps = np.asarray(part.column("grp"))
                rows, tokens = np.asarray(part.column("row")), np.asarray(part.column("n_tokens"))
                for begin, end in pairwise([0, *(np.flatnonzero(np.diff(grps)) + 1).tolist(), len(grps)]):
                    if held != grps[begin]:
                        held = int(grps[begin])
                        with fs.open_input_file(f"{root}/positions-{held:06d}.bin.zst") as f:
                            raw = pa.input_stream(f, compression="zstd").read()
                        places = np.frombuffer(raw, _kind(length)).reshape(-1, length)
                    with fs.open_input_file(f"{root}/ids-{held:06d}.bin") as f:
                        wide = np.dtype(_kind(most_id))
                        for row, n in zip(rows[begin:end].tolist(), tokens[begin:end].tolist()):
                            ids = np.frombuffer(f.read_at(wide.itemsize * n, wide.itemsize * length * row), wide)
                            out["ids"].append(ids.astype("<u4").tobytes())
                            out["positions"].append(places[row, :n].astype("<u4").tobytes())
                columns = {name: part.column(name) for name in part.schema.names} | {k: pa.array(v, pa.binary()) for k, v in out.items()}
                yield pa.RecordBatch.from_arrays([columns[name] for name in _NAMES], names=_NAMES)

    return run


def write(docs: DataFrame, uri: str, length: int = LENGTH, vocabulary: str = VOCABULARY, end: int = END, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pack ``docs`` and write the matrices of :func:`write_matrices` at ``uri``; returns the rows of :func:`packed`.

    Each group's files are written by the task that packs it, so nothing more is shuffled.
    ``index`` below ``uri`` has the rows without ids and positions, which are read
    from the matrices when the result is. All is written before this returns. Nulls, long and repeated texts, ties and
    other columns are as in :func:`packed`; an empty table gives an empty index and no files.
    """
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    ranks = _ranks(vocabulary)
    pack_group, most = _packed(ranks, length, end), max(end, len(ranks.splitlines()) - 1)

    def run(table: pa.Table) -> pa.Table:
        rows = pack_group(table)
        if rows.num_rows:
            _saved(rows, uri, length, end, most)
        return rows.drop_columns(["ids", "positions"])

    _by_group(docs, group_bytes).applyInArrow(run, _INDEX).write.mode("overwrite").parquet(f"{uri}/index")
    return docs.sparkSession.read.schema(_INDEX).parquet(f"{uri}/index").mapInArrow(_read_back(uri, length, most), _ROW)
