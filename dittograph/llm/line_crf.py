"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its features are measures of its own text and of the
lines before and after it. Weights are fitted on a bounded sample of labelled
documents, whose lines take the document's label. Forward and backward passes
give each line's marginal of being good, and a document's quality is their
mean weighted by line length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from dittograph.llm import flat
from dittograph.storage import dropped, written

#: Labelled documents that the model is fitted on at most, chosen by a hash of their id.
TRAIN_DOCUMENTS = 2000
#: Bytes of text that the model is fitted on at most: they go to the driver.
TRAIN_BYTES = 64 << 20
#: Quality from which a document is kept. Junk scores below 0.1 as a rule; a lower bar than 0.5 keeps clean texts with a few odd lines.
THRESHOLD = 0.15
_MEASURES = 10
_SEEN = 5  # the measure that says whether the text had the line before
#: Bytes of a long text whose lines are measured at once.
_WINDOW = 2 << 20
_SCORES = ("quality", "lines", "bad_lines")


@dataclass
class Model:
    """Weights of the line features for good against bad, and scores of good and bad, before and after each."""

    weights: np.ndarray
    moves: np.ndarray  # 2 x 2, from row to column; 0 is bad, 1 good
    start: np.ndarray


def _sum(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[end] - total[start]


def _windows(texts: pa.Array) -> Iterator[pa.Array]:
    """A long text that is alone in parts that end with a line, all else as it is."""
    raw, at = flat.utf8(texts)
    if len(at) != 2 or len(raw) <= _WINDOW:
        yield texts
        return
    breaks = np.flatnonzero((raw == 0x0A) | (raw == 0x0D)) + 1
    begin = 0
    while begin < len(raw):
        k = np.searchsorted(breaks, begin + _WINDOW)
        end = int(breaks[k]) if k < len(breaks) else len(raw)
        yield pa.array([raw[begin:end].tobytes().decode(errors="replace")], pa.large_string())
        begin = end


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that aren't blank, the text of each, and its length in characters."""
    base, doc, n, lh = (np.concatenate(x) for x in zip(*map(_measured, _windows(texts))))
    # a line that its text has had before
    order = np.argsort(lh, kind="stable")
    seen = np.zeros(len(lh), bool)
    seen[order[1:]] = lh[order][1:] == lh[order][:-1]
    base[:, _SEEN] = seen
    before, after = np.zeros_like(base), np.zeros_like(base)
    if len(base) > 1:
        same = doc[1:] == doc[:-1]
        before[1:][same] = base[:-1][same]
        after[:-1][same] = base[1:][same]
    return np.concatenate([np.ones((len(base), 1)), base, before, after], 1), doc, n


def _measured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each line but ``_SEEN``, its text, its length, and a hash of text and line."""
    cp, at = flat.codepoints(texts)
    line = (cp != 0x0A) & (cp != 0x0D)
    start, end, doc = flat.runs(line, at)
    space = (cp == 0x20) | (cp == 0x09) | ~line
    full = _sum(~space, start, end) > 0
    start, end, doc = start[full], end[full], doc[full]
    n = end - start
    word = flat.is_word(cp)
    low = flat.lowered(cp)
    ascii_ = cp < 0x80
    mark = ascii_ & ~word & ~space
    plain = mark & np.isin(cp, np.frombuffer(b".,;:'\"()-?", np.uint8))
    upper, digit = word & (low != cp), ascii_ & (cp >= 0x30) & (cp <= 0x39)
    tokens, token_end, token_line = flat.runs(~space, np.r_[start, end[-1:]] if len(start) else np.zeros(1, np.int64))
    h = flat.span_hashes(low, tokens, token_end)
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (token_line[1:] == token_line[:-1])
    count = np.maximum(1, np.bincount(token_line, minlength=len(start)))
    repeats = np.bincount(token_line, again, minlength=len(start)) / count
    lh = flat.span_hashes(cp, start, end) ^ flat.mixed(doc.astype(np.uint64))
    letters = np.maximum(1, _sum(word, start, end))
    odd = _sum(mark & ~plain, start, end) / n
    base = np.stack(
        [
            np.minimum(1, 5 * odd),
            np.minimum(1, 2 * _sum(cp == 0x7C, start, end) / count),
            np.minimum(1, 2 * _sum(cp == 0x21, start, end) / count),
            np.where(letters >= 8, _sum(upper, start, end) / letters, 0),
            np.minimum(1, 3 * repeats),
            np.zeros(len(start)),
            np.minimum(1, _sum(digit, start, end) / n),
            1 - letters / np.maximum(1, _sum(~space, start, end)),
            np.minimum(1, n / count / 40),
            np.minimum(1, np.log1p(n) / 8),
        ],
        1,
    ) if len(start) else np.zeros((0, _MEASURES))
    return base, doc, n, lh


FEATURES = 1 + 3 * _MEASURES


def _chains(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' first lines and numbers of lines, longest text first; and how many texts have a k-th line."""
    names, begin, count = np.unique(doc, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    count = count[order]
    alive = len(count) - np.searchsorted(count[::-1], np.arange(count[0] if len(count) else 0), "right")
    return begin[order], count, alive


def marginals(score: np.ndarray, doc: np.ndarray, model: Model, moves: bool = False):
    """P(good) of each line, from scores of good against bad; with ``moves`` also P(move into it), the lines that have one, and log Z.

    Texts run in step: the k-th step handles the k-th line of all texts that have one.
    """
    if not len(score):
        return np.zeros(0)
    begin, count, alive = _chains(doc)
    e = np.exp(np.clip(np.stack([np.zeros(len(score)), score], 1), -40, 40))
    m, s = np.exp(model.moves), np.exp(model.start)
    forward, scale = np.empty((len(score), 2)), np.empty(len(score))
    for k, n in enumerate(alive):
        i = begin[:n] + k
        a = (s if k == 0 else forward[i - 1] @ m) * e[i]
        z = a.sum(1)
        forward[i], scale[i] = a / z[:, None], z
    backward = np.ones((len(score), 2))
    for k in range(len(alive) - 2, -1, -1):
        i = begin[: alive[k + 1]] + k
        b = (e[i + 1] * backward[i + 1]) @ m.T
        backward[i] = b / scale[i + 1][:, None]
    both = forward * backward
    good = both[:, 1] / both.sum(1)
    if not moves:
        return good
    link = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    pair = forward[link - 1][:, :, None] * m * (e[link] * backward[link])[:, None, :]
    pair /= pair.sum((1, 2))[:, None, None]
    return good, pair, link, np.log(scale).sum()


def fit(texts: list[pa.Array], good: np.ndarray, rounds: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Weights of greatest regularised likelihood, by Adam on the full sample.

    Both classes weigh alike, and in a class all documents, whatever their length.
    """
    x, doc, before = [], [], 0
    for part in texts:
        features, of, _ = line_features(part)
        x.append(features)
        doc.append(of + before)
        before += len(part)
    x, doc = np.concatenate(x), np.concatenate(doc)
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2))
    y = good[doc].astype(np.int64)
    if len(set(y.tolist())) < 2:
        return model
    share = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    weight = (share / np.maximum(1, np.bincount(doc, minlength=len(good))))[doc]
    first = np.r_[True, doc[1:] != doc[:-1]]
    link = np.flatnonzero(~first)
    seen = np.bincount(y[link - 1] * 2 + y[link], weight[link], minlength=4).reshape(2, 2)
    theta = np.zeros(FEATURES + 6)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        model = Model(theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[-2:])
        p, pairs, at, _ = marginals(x @ model.weights, doc, model, True)
        start = ((y - p) * weight)[first].sum()
        g = np.concatenate([x.T @ (weight * (y - p)), (seen - np.einsum("k,kij->ij", weight[at], pairs)).ravel(), [-start, start]])
        g -= ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return Model(theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[-2:])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Model from the documents of at most ``most`` labelled rows (doc_id, quality), half of them of each class.

    The rows are those of least hash of their id, so the sample doesn't depend on
    partitions. Documents in that order count as long as they fit into ``most_bytes``; a longer one is passed over. Of rows
    with the same id the least text counts, of labels the least quality; rows with a null in doc_id, quality or text
    don't count. Without both classes, or with an empty table, the model is neutral: every line is as likely good as bad.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [rows.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for c in ("quality > 0", "quality <= 0")]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    found = written(texts.join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")), "labelled")
    fits, left = [], most_bytes
    for r in found.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.n <= left:
            fits.append(r.doc_id)
            left -= r.n
    table = found.filter(F.col("doc_id").isin(fits)).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow() if fits else None
    dropped(found)
    if not table:
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2))
    batch = table.select(["text"]).combine_chunks().to_batches()[0]
    return fit([part.column("text") for part in flat.chunks(batch, "text", 1 << 20)], np.asarray(table.column("quality")) > 0)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``quality`` in 0..1, and ``lines`` and ``bad_lines``, the lines that are likelier bad.

    A null text, and one without any line that isn't blank, has quality 0 and no
    lines. Ids may be null or repeat: rows are scored one by one. Columns quality,
    lines and bad_lines are replaced, all others stay. A very long text is scored
    whole, its lines measured window by window. A map without any shuffle; an empty table gives an empty one.
    """
    return _with_scores(docs.select([F.col(f"`{c}`") for c in docs.columns if c not in _SCORES]), model, _SCORES)


def _with_scores(docs: DataFrame, model: Model, scores: tuple[str, str, str]) -> DataFrame:
    """``docs`` with quality, lines and bad lines in columns named ``scores``, which it doesn't have; each column goes to Python once."""
    names = docs.columns
    schema = StructType(list(docs.schema.fields)).add(scores[0], DoubleType()).add(scores[1], IntegerType()).add(scores[2], IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.chunks(batch, "text", 2 << 20):
                x, doc, n = line_features(part.column("text"))
                p = marginals(x @ model.weights, doc, model)
                count = part.num_rows
                total = np.bincount(doc, n, minlength=count)
                quality = np.bincount(doc, p * n, minlength=count) / np.maximum(1, total)
                lines, bad = np.bincount(doc, minlength=count), np.bincount(doc, p < 0.5, minlength=count)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(quality), pa.array(lines, pa.int32()), pa.array(bad.astype(np.int32))], names=[*names, *scores])

    return docs.mapInArrow(run, schema)


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose quality is at least ``threshold``, with the columns they came with.

    Nulls, blank and very long texts, repeated rows and an empty table are as in :func:`scored`: texts without lines have quality 0 and
    go. A tie with the threshold stays. Columns named quality, lines or bad_lines are kept as they came.
    """
    scores = _SCORES
    while any(c.lower() in scores for c in docs.columns):
        scores = tuple(f"_{c}" for c in scores)
    return _with_scores(docs, model, scores).filter(F.col(scores[0]) >= threshold).select([F.col(f"`{c}`") for c in docs.columns])
