"""Document quality from a linear-chain conditional random field over lines.

Every line gets statistics of its own bytes, cut into bins; its state score is a sum of
weights chosen by its own bins and by those of the line before and the line after it.
Forward-backward gives each line's probability of being good, and a document's quality is
their mean, weighted by line length. The weights are fitted by gradient ascent of the
conditional likelihood on a bounded sample of labelled documents, whose lines all carry the
document's label; scoring covers all texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import in_pieces, table_of, text_bytes

CLASSES = ["control", "lower", "upper", "digit", "space", ".", ",", "!", "|", "symbol", "quote", "bracket", "mark", "lead", "tail"]
STATISTICS = 16
BINS = 8


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    groups = {
        "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": b" \t\r\x0b\x0c",
        ".": b".", ",": b",", "!": b"!", "|": b"|", "symbol": b"*#$%&@~^+=_", "quote": b"'\"`",
        "bracket": b"<>{}[]()/\\", "mark": b"?:;-", "lead": range(192, 256), "tail": range(128, 192),
    }
    for name, members in groups.items():
        table[list(members)] = CLASSES.index(name)
    return table


BYTE_CLASSES = _byte_classes()


def line_statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics of each line, bytes of each line with its end, lines of each text)."""
    joined = b"\n".join(texts) + b"\n"
    lines = joined[:-1].split(b"\n")
    per_text = np.asarray([t.count(b"\n") + 1 for t in texts], np.int64)
    length = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    data = np.frombuffer(joined, np.uint8)
    row = np.repeat(np.arange(len(lines)), length)
    kinds = BYTE_CLASSES[data]
    k = len(CLASSES)
    counts = np.bincount(row * k + kinds, minlength=len(lines) * k).reshape(-1, k).astype(float)
    of = {c: counts[:, i] for i, c in enumerate(CLASSES)}
    inside = (row[1:] == row[:-1]) & (kinds[1:] != CLASSES.index("space"))
    same = np.bincount(row[1:][inside & (data[1:] == data[:-1])], minlength=len(lines))
    words, distinct, repeated = np.empty(len(lines)), np.empty(len(lines)), np.zeros(len(lines))
    at = 0
    for n in per_text.tolist():
        seen = set()
        for i in range(at, at + n):
            line = lines[i]
            w = line.split()
            words[i], distinct[i] = len(w), len(set(w))
            if w:
                repeated[i] = line in seen
                seen.add(line)
        at += n
    letters = of["lower"] + of["upper"] + of["lead"]
    w1, n1 = words + 1, length.astype(float)
    out = np.column_stack(
        [
            np.log(n1), np.log(w1), of["upper"] / (letters + 1), of["digit"] / n1, of["!"] / w1, of["|"] / w1,
            of["symbol"] / w1, of["."] / w1, of[","] / w1, of["bracket"] / n1, (of["mark"] + of["quote"]) / w1,
            of["lead"] / n1, same / n1, distinct / w1, letters / w1, repeated,
        ]
    )
    return out.astype(np.float32), length, per_text


@dataclass
class LineCrf:
    """``edges``: inner bin bounds of each statistic. ``weights``: for the line itself, the one before and the one
    after, by statistic and bin, the last bin standing for no line. ``transitions``: from label to label."""

    edges: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray

    def bins(self, statistics: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, s, side="right") for e, s in zip(self.edges, statistics.T)])


def _cells(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flat positions in ``weights`` of each line's features; ``first``: the lines that begin a document."""
    none = np.full((1, bins.shape[1]), BINS)
    before = np.concatenate([none, bins[:-1]])
    before[first] = BINS
    after = np.concatenate([bins[1:], none])
    after[first[1:] - 1] = BINS
    step = (BINS + 1) * np.arange(bins.shape[1])
    size = (BINS + 1) * bins.shape[1]
    return np.concatenate([bins + step, before + step + size, after + step + 2 * size], axis=1)


def marginals(scores: np.ndarray, per_text: np.ndarray, transitions: np.ndarray):
    """Forward-backward over all documents at once: P(good) of each line, expected transitions of each kind,
    and the log normaliser of each document. ``scores`` is the state score of label 1; that of 0 is 0."""
    starts = np.cumsum(per_text) - per_text
    order = np.argsort(-per_text, kind="stable")
    lengths = per_text[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # documents with a line t
    state = np.zeros((len(scores), 2))
    state[:, 1] = scores
    alpha, beta = np.empty_like(state), np.zeros_like(state)
    for t in range(longest):
        i = starts[order[: active[t]]] + t
        if t == 0:
            alpha[i] = state[i]
        else:
            step = alpha[i - 1][:, :, None] + transitions
            alpha[i] = np.logaddexp(step[:, 0], step[:, 1]) + state[i]
    for t in range(longest - 2, -1, -1):
        i = starts[order[: active[t + 1]]] + t
        step = transitions + (state[i + 1] + beta[i + 1])[:, None, :]
        beta[i] = np.logaddexp(step[:, :, 0], step[:, :, 1])
    last = starts + per_text - 1
    z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    each = np.repeat(z, per_text)
    good = np.exp(np.minimum(0, alpha[:, 1] + beta[:, 1] - each))
    inner = np.ones(len(scores), bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    pair = alpha[i][:, :, None] + transitions + (state[i + 1] + beta[i + 1])[:, None, :] - each[i][:, None, None]
    return good, np.exp(np.minimum(0, pair)).sum(0), z


def fit(statistics: np.ndarray, per_text: np.ndarray, labels: np.ndarray, rounds: int = 120, decay: float = 2.0) -> LineCrf:
    """Gradient ascent with momentum-scaled steps on the mean conditional log likelihood, L2-regularised."""
    at = np.arange(1, BINS) / BINS
    model = LineCrf(
        np.quantile(statistics, at, axis=0).T, np.zeros(3 * STATISTICS * (BINS + 1)), np.zeros((2, 2))
    )
    first = np.cumsum(per_text) - per_text
    cells = _cells(model.bins(statistics), first)
    y = np.repeat(labels, per_text).astype(float)
    same = np.zeros((2, 2))
    for label in (0, 1):
        same[label, label] = (per_text[labels == label] - 1).sum()
    n = len(labels)
    weights = np.concatenate([model.weights, model.transitions.ravel()])
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for k in range(1, rounds + 1):
        scores = weights[:-4][cells].sum(1)
        good, pairs, _ = marginals(scores, per_text, weights[-4:].reshape(2, 2))
        slope = np.bincount(cells.ravel(), np.repeat(y - good, cells.shape[1]), minlength=len(weights) - 4)
        g = np.concatenate([slope, (same - pairs).ravel()]) / n - decay * weights / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights + 0.08 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return LineCrf(model.edges, weights[:-4], weights[-4:].reshape(2, 2))


def score_texts(texts: list[bytes], model: LineCrf) -> tuple[np.ndarray, list[np.ndarray]]:
    """Quality of each text and P(good) of its lines."""
    statistics, length, per_text = line_statistics(texts)
    first = np.cumsum(per_text) - per_text
    scores = model.weights[_cells(model.bins(statistics), first)].sum(1)
    good, _, _ = marginals(scores, per_text, model.transitions)
    total = np.add.reduceat(good * length, first) / np.add.reduceat(length, first)
    return np.clip(total, 0, 1), np.split(good, first[1:])


def fold(doc_id: str | Column = "doc_id", of: int = 3) -> Column:
    """Remainder of the id's checksum; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of


def _sampled_statistics():
    out = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("lines", pa.int64()), ("statistics", pa.binary())])

    def run(batches):
        for batch in in_pieces(batches, "text", 2 << 20):
            s, _, per_text = line_statistics(batch.column("text").to_pylist())
            parts = np.split(s, np.cumsum(per_text)[:-1])
            yield table_of(
                out, doc_id=batch.column("doc_id"), quality=batch.column("quality"), lines=per_text,
                statistics=[np.ascontiguousarray(p).tobytes() for p in parts],
            )

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> LineCrf:
    """A model from at most ``sample`` labelled documents: those whose ids have the smallest hashes.

    ``labels`` (doc_id, quality 0/1); rows with other or null labels are left out, repeated ids count once.
    Only the sample's line statistics reach the driver. Without any label the model scores 0.5.
    """
    chosen = (
        labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # ``sample`` rows of two numbers, so the other side need not be shuffled
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(
        F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")), "doc_id"
    )
    rows = found.select("doc_id", "quality", "text").mapInArrow(
        _sampled_statistics(), "doc_id long, quality int, lines long, statistics binary"
    ).collect()
    if not rows:
        return LineCrf(np.zeros((STATISTICS, BINS - 1)), np.zeros(3 * STATISTICS * (BINS + 1)), np.zeros((2, 2)))
    rows.sort(key=lambda r: (r.doc_id, r.lines, bytes(r.statistics)))
    statistics = np.concatenate([np.frombuffer(r.statistics, np.float32).reshape(-1, STATISTICS) for r in rows])
    return fit(statistics, np.asarray([r.lines for r in rows]), np.asarray([r.quality for r in rows]))


SCORED = "doc_id long, score double, lines long, bad_lines long"


def _score(model: LineCrf, keep: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "_text", 1 << 20):
            score, good = score_texts(batch.column("_text").to_pylist(), model)
            arrays = [batch.column(c) for c in keep]
            arrays += [pa.array(score), pa.array([len(g) for g in good], pa.int64()), pa.array([int((g < 0.5).sum()) for g in good], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "score", "lines", "bad_lines"])

    return run


def score_quality(docs: DataFrame, model: LineCrf) -> DataFrame:
    """``(doc_id, score, lines, bad_lines)`` for each row of ``docs`` (doc_id, text).

    The score is between 0 and 1, higher for good; a null or empty text is one empty line. ``bad_lines`` are
    those more likely bad than good.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_text"))
    return texts.mapInArrow(_score(model, ["doc_id"]), SCORED)
