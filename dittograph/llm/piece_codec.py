"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a chunk lie in one flat symbol array. A round finds the
rank of every adjacent pair, the least rank of each word by a segmented minimum,
merges all its occurrences at once (of overlapping ones the leftmost first), and
compacts the array. Words without a pair left leave it. Nothing is done per
word or per character in Python, and no tokenizer library runs on executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from dittograph.llm import flat

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE, _NONE = 0x2581, np.int32(2**31 - 1)


@dataclass
class Pieces:
    """A BPE model with byte fallback as arrays: single characters, pairs, bytes of the pieces."""

    chars: np.ndarray  # id by code point, or -1
    slots: np.ndarray  # open addressing: pair key + 1, or 0
    ranks: np.ndarray  # by slot: rank of the merge; equal scores have equal ranks
    merged: np.ndarray  # by slot: id of the merged piece
    probes: int
    data: np.ndarray  # bytes of all pieces, the space mark as a space
    at: np.ndarray
    first_byte: int

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; ``_NONE`` where the two don't merge."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        key += np.uint64(1)
        bits = np.uint64(64 - (len(self.slots) - 1).bit_length())
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> bits).astype(np.int64)
        here = self.slots[slot]
        found = here == key
        rank = np.where(found, self.ranks[slot], _NONE)
        merged = np.where(found, self.merged[slot], 0)
        todo = np.flatnonzero(~found & (here != 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            here = self.slots[slot[todo]]
            hit = here == key[todo]
            rank[todo[hit]] = self.ranks[slot[todo[hit]]]
            merged[todo[hit]] = self.merged[slot[todo[hit]]]
            todo = todo[~hit & (here != 0)]
        return rank, merged


def load(path: str = MODEL) -> Pieces:
    """Arrays of a SentencePiece BPE model file that has byte fallback and no normalisation but the space mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = list(range(model.get_piece_size()))
    pieces, score, is_byte = model.id_to_piece(every), model.get_score(every), model.is_byte(every)
    plain = [i for i, no in enumerate(zip(is_byte, model.is_control(every), model.is_unknown(every), model.is_unused(every))) if not any(no)]
    bytes_ = [i for i in every if is_byte[i]]
    if len(bytes_) != 256 or any("▁" in pieces[i].lstrip("▁") for i in plain):
        raise ValueError("the model needs byte fallback and pieces that have the space mark only in front")
    ids = {pieces[i]: i for i in plain}
    ranked = {s: k for k, s in enumerate(sorted({score[i] for i in plain}, reverse=True))}
    chars = np.full(0x110000, -1, np.int32)
    table = []
    for i in plain:
        s = pieces[i]
        if len(s) == 1:
            chars[ord(s)] = i
        for k in range(1, len(s)):
            a, b = ids.get(s[:k]), ids.get(s[k:])
            if a is not None and b is not None:
                table.append(((a << 32) + b + 1, ranked[score[i]], i))
    size = 1 << (4 * len(table)).bit_length()
    slots, ranks, merged, probes = [0] * size, np.zeros(size, np.int32), np.zeros(size, np.int32), 0
    for key, rank, i in table:
        slot, n = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - (size - 1).bit_length()), 0
        while slots[slot]:
            slot, n = (slot + 1) & (size - 1), n + 1
        slots[slot], ranks[slot], merged[slot], probes = key, rank, i, max(probes, n)
    slots = np.array(slots, np.uint64)
    raw = [bytes([i - bytes_[0]]) if is_byte[i] else b"" for i in every]
    for i in plain:
        raw[i] = pieces[i].replace("▁", " ").encode()
    raw[0] = " ⁇ ".encode()
    return Pieces(chars, slots, ranks, merged, probes, np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])], bytes_[0])


def merge(sym: np.ndarray, word: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words after all merges, and the word of each; ``word`` ascends."""
    done_sym, done_word = [], []
    while len(sym):
        rank, merged = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            rank[:-1], merged[:-1] = pieces.pairs(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = _NONE
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.minimum.reduceat(rank, start)
        spread = np.repeat(least, np.diff(np.r_[start, len(word)]))
        open_ = spread != _NONE
        done_sym.append(sym[~open_])
        done_word.append(word[~open_])
        take = np.flatnonzero((rank == spread) & open_)
        if not len(take):
            break
        # leftmost first: of adjacent candidates every other one
        fresh = np.r_[True, np.diff(take) != 1]
        begin = take[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        take = take[(take - begin) % 2 == 0]
        sym = sym.copy()
        sym[take] = merged[take]
        open_[take + 1] = False
        sym, word = sym[open_], word[open_]
    if not done_sym:
        return sym, word
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], word[order]


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    shift = np.repeat(begin - (np.cumsum(count) - count), count)
    return shift + np.arange(int(count.sum()))


def _symbols(cp: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Initial symbols: a known character's id, else its UTF-8 bytes; and how many each character gives."""
    known = pieces.chars[cp]
    width = np.where(known >= 0, 1, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)).astype(np.int64)
    out = np.repeat(known, width)
    odd = np.flatnonzero(known < 0)
    if len(odd):
        raw = np.frombuffer(cp[odd].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out[_ranges((np.cumsum(width) - width)[odd], width[odd])] = raw.astype(np.int32) + pieces.first_byte
    return out, width


def encode_chunk(texts: pa.Array, pieces: Pieces, begun: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the offsets between them; where ``begun``, of a text's later part."""
    cp, at = flat.codepoints(texts)
    count = len(at) - 1
    # the mark goes before each text that isn't empty
    full = np.flatnonzero(np.diff(at) > 0)
    cp = np.where(cp == 0x20, np.uint32(_SPACE), cp)
    if not begun:
        cp = np.insert(cp, at[full], np.uint32(_SPACE))
        at = at + np.r_[0, np.cumsum(np.diff(at) > 0)]
    if not len(cp):
        return np.empty(0, np.int32), np.zeros(count + 1, np.int64)
    mark = cp == _SPACE
    begin = mark & np.r_[True, ~mark[:-1]]
    begin[at[:-1][full]] = True
    start = np.flatnonzero(begin)
    end = np.r_[start[1:], len(cp)]
    _, first, which = np.unique(flat.span_hashes(cp, start, end), return_index=True, return_inverse=True)
    size = (end - start)[first]
    sym, width = _symbols(cp[_ranges(start[first], size)], pieces)
    word = np.repeat(np.repeat(np.arange(len(first)), size), width)
    sym, word = merge(sym, word, pieces)
    many = np.bincount(word, minlength=len(first))
    ids = sym[_ranges((np.cumsum(many) - many)[which], many[which])]
    total = np.r_[0, np.cumsum(many[which])]
    return ids, total[np.searchsorted(start, at)]


def _parts(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in parts of about ``most`` bytes, each from a word's begin: a space after what is no space mark."""
    begin, space = 0, np.flatnonzero(raw == 0x20)
    first = space[(space > 0) & (raw[space - 1] != 0x20)]
    first = first[(first < 3) | (raw[first - 1] != 0x81) | (raw[first - 2] != 0x96) | (raw[first - 3] != 0xE2)]
    while begin < len(raw):
        k = np.searchsorted(first, begin + most)
        end = int(first[k]) if k < len(first) else len(raw)
        yield raw[begin:end]
        begin = end


def encode_long(raw: np.ndarray, pieces: Pieces, most: int = 2 << 20) -> tuple[np.ndarray, bool]:
    """Ids of one text part by part, and whether they decode to it."""
    found, exact, begun = [], True, False
    for part in _parts(raw, most):
        ids, _ = encode_chunk(pa.array([part.tobytes().decode(errors="replace")], pa.large_string()), pieces, begun)
        back, _ = decode_chunk(ids, np.array([0, len(ids)]), pieces, begun)
        found.append(ids)
        exact, begun = exact and np.array_equal(back, part), True
    return np.concatenate(found), exact


def decode_chunk(ids: np.ndarray, at: np.ndarray, pieces: Pieces, begun: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the offsets between them; where ``begun``, of a text's later part."""
    size = pieces.at[ids + 1] - pieces.at[ids]
    raw = pieces.data[_ranges(pieces.at[ids], size)]
    to = np.r_[0, np.cumsum(size)][at]
    if begun:
        return raw, to
    lead = to[:-1][(np.diff(to) > 0)]
    lead = lead[raw[lead] == 0x20] if len(lead) else lead
    keep = np.ones(len(raw), bool)
    keep[lead] = False
    return raw[keep], np.r_[0, np.cumsum(keep)][to]


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), ``n_ids`` and ``exact``: whether decoding the ids gives the text back.

    The ids are those of the SentencePiece library for the same model. Columns of
    ``docs`` stay; those named ids, n_ids or exact are replaced. A null text has
    null ids, n_ids and exact; an empty text has no ids. A text with the mark U+2581 decodes to
    one with a space there, and ``exact`` says so. Rows are independent: ids,
    repeated rows and other columns don't matter. A very long text is encoded part by part, cut before
    words, with the same ids. A map without any shuffle; an empty table gives an empty one.
    """
    pieces = load(path)
    names = [c for c in docs.columns if c not in ("ids", "n_ids", "exact")]
    schema = StructType(list(docs.select([F.col(f"`{c}`") for c in names]).schema.fields)).add("ids", ArrayType(IntegerType())).add("n_ids", "integer").add("exact", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.chunks(batch, "text"):
                texts = part.column("text")
                raw, where = flat.utf8(texts)
                if part.num_rows == 1 and len(raw) > 2 << 20:
                    ids, same = encode_long(raw, pieces)
                    more = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int32())), pa.array([len(ids)], pa.int32()), pa.array([same])]
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*names, "ids", "n_ids", "exact"])
                    continue
                ids, at = encode_chunk(texts, pieces)
                back, to = decode_chunk(ids, at, pieces)
                null = np.asarray(texts.is_null())
                exact = np.diff(to) == np.diff(where)
                if exact.all():
                    wrong = np.searchsorted(to, np.flatnonzero(back != raw), "right") - 1
                    exact[wrong] = False
                else:
                    for k in np.flatnonzero(exact):
                        exact[k] = bool((back[to[k] : to[k + 1]] == raw[where[k] : where[k + 1]]).all())
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null))
                more = [lists, pa.array(np.diff(at).astype(np.int32), mask=null), pa.array(exact, mask=null)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*names, "ids", "n_ids", "exact"])

    return docs.select([F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = MODEL, column: str = "ids", to: str = "text") -> DataFrame:
    """``encoded`` with the column ``to``: the text of each id list; null for a null list, empty for an empty one.

    An id that the model doesn't have, or a null in a list, is the unknown piece, 0. Rows are independent; other columns stay but
    one named ``to``, which is replaced. Lists of any length are decoded whole; an empty table gives an empty one.
    """
    pieces = load(path)
    names = [c for c in encoded.columns if c != to]
    schema = StructType(list(encoded.select([F.col(f"`{c}`") for c in names]).schema.fields)).add(to, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            ids = np.asarray(pc.fill_null(lists.flatten(), 0), np.int64)
            ids = np.where((ids >= 0) & (ids < len(pieces.at) - 1), ids, 0)
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            raw, at = decode_chunk(ids, np.r_[0, np.cumsum(size)], pieces)
            null = np.asarray(lists.is_null())
            texts = [None if n else raw[a:b].tobytes().decode(errors="replace") for n, a, b in zip(null, at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, to])

    return encoded.select([F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
