"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.common import byte_texts, held_out, need, sliced
from siftline.llm.profile import Profile, byte_table, labelled, odds, platt, sigmoid

THRESHOLD = 0.7
TRAIN_ROWS = 20_000
BINS = 32
COARSE = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.1
LEAST = 8
UPPER, DIGIT = byte_table(bytes(range(65, 91))), byte_table(bytes(range(48, 58)))
STOPS, ODD = byte_table(b".,;:?"), byte_table(b"!\"'()[]{}=+/\\_-~^@`")
NAMES = (
    "log_words", "word_length", "symbols", "duplicate_lines", "repeated_words", "upper", "digits",
    "stops", "odd", "exclamations", "bars", "not_ascii", "distinct", "capitals", "line_length", "short_words",
)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of numbers for each text, none of them missing."""
    p = Profile(texts)
    d = p.data
    chars = np.maximum(p.bytes_where(d & 0xC0 != 0x80), 1)
    words = np.maximum(p.n_words, 1)
    lines = p.lines()
    upper = UPPER[d]
    size = p.end - p.first
    return np.column_stack([
        np.log1p(p.n_words),
        p.word_chars() / words,
        p.symbols() / chars,
        p.duplicate_lines() / lines,
        p.repeated_words() / words,
        p.bytes_where(upper) / chars,
        p.bytes_where(DIGIT[d]) / chars,
        p.bytes_where(STOPS[d]) / words,
        p.bytes_where(ODD[d]) / words,
        p.bytes_where(d == 33) / words,
        p.bytes_where(d == 124) / words,
        p.bytes_where(d >= 0xC0) / chars,
        p.distinct_words() / words,
        p.words_where(upper[p.first]) / words,
        chars / lines,
        p.words_where(size <= 2) / words,
    ])


@dataclass(frozen=True)
class Model:
    """Log-odds of a text: a start, a table over the bins of each feature, and one over the coarse
    bins of each chosen pair; then the calibration."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    start: float
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray
    slope: float
    shift: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        for j, edge in enumerate(self.edges):
            margin += self.tables[j][np.searchsorted(edge, x[:, j], side="right")]
        low = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for k, (i, j) in enumerate(self.pairs):
            margin += self.pair_tables[k][low[i], low[j]]
        return sigmoid(self.slope * margin + self.shift)


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A step for each bin: the tree of up to three leaves over the bins that gains most."""

    def best(a: int, b: int) -> tuple[float, int]:
        cg, ch, cn = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
        if b - a < 2:
            return 0.0, a
        gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
        gain = np.where((cn[:-1] >= LEAST) & (cn[-1] - cn[:-1] >= LEAST), gain, 0)
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    m = len(g)
    gain, cut = best(0, m)
    if gain <= 0:
        return np.zeros(m)
    left, right = best(0, cut), best(cut, m)
    cuts = sorted({0, cut, m} | ({left[1]} if left[0] >= right[0] and left[0] > 0 else {right[1]} if right[0] > 0 else set()))
    step = np.zeros(m)
    for a, b in zip(cuts, cuts[1:]):
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return step


def _grid_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same over the cells of two features: one cut of the first, one of the second on each side."""
    best, step = 0.0, np.zeros_like(g)
    for axis in (0, 1):
        gg, hh, nn = (x if axis == 0 else x.T for x in (g, h, n))
        for cut in range(1, len(gg)):
            out, gain = np.zeros_like(gg), 0.0
            for a, b in ((0, cut), (cut, len(gg))):
                part = _tree(gg[a:b].sum(0), hh[a:b].sum(0), nn[a:b].sum(0))
                out[a:b] = part
                gain -= float((gg[a:b].sum(0) * part).sum())
            if gain > best:
                best, step = gain, out if axis == 0 else out.T
    return step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting: in each round every feature takes one small tree on what is left; then the
    pairs that explain most of the rest do. A fifth of the rows calibrates."""
    k = x.shape[1]
    if len(set(y.tolist())) < 2:
        start = odds(y.mean() if len(y) else 0.5, len(y))
        none = [np.zeros(0)] * k
        return Model(none, none, start, np.zeros((k, 1)), [], np.zeros((0, 1, 1)), 1.0, 0.0)
    order = np.random.default_rng(0).permutation(len(y))
    part, rest = order[: max(1, len(y) * 4 // 5)], order[len(y) * 4 // 5 :]
    edges, coarse = [_cuts(x[part, j], BINS) for j in range(k)], [_cuts(x[part, j], COARSE) for j in range(k)]
    fine = [np.searchsorted(edges[j], x[part, j], side="right") for j in range(k)]
    low = [np.searchsorted(coarse[j], x[part, j], side="right") for j in range(k)]
    target = y[part].astype(float)
    start = odds(target.mean(), len(target))
    margin = np.full(len(part), start)
    tables = np.zeros((k, BINS + 1))
    counts = [np.bincount(b, minlength=len(edges[j]) + 1) for j, b in enumerate(fine)]
    for _ in range(ROUNDS):
        for j in range(k):
            p = sigmoid(margin)
            m = len(edges[j]) + 1
            step = RATE * _tree(np.bincount(fine[j], p - target, m), np.bincount(fine[j], p * (1 - p), m), counts[j])
            tables[j, :m] += step
            margin += step[fine[j]]
    p = sigmoid(margin)
    cells = {}
    for i, j in combinations(range(k), 2):
        cell, shape = low[i] * (len(coarse[j]) + 1) + low[j], (len(coarse[i]) + 1, len(coarse[j]) + 1)
        size = shape[0] * shape[1]
        g, h = np.bincount(cell, p - target, size), np.bincount(cell, p * (1 - p), size)
        cells[i, j] = (float((g**2 / (h + 5)).sum()), cell, shape)
    pairs = sorted(cells, key=lambda c: (-cells[c][0], c))[:PAIRS]
    pair_tables = np.zeros((len(pairs), COARSE + 1, COARSE + 1))
    for _ in range(PAIR_ROUNDS):
        for q, pair in enumerate(pairs):
            _, cell, shape = cells[pair]
            p = sigmoid(margin)
            size = shape[0] * shape[1]
            g, h, n = (np.bincount(cell, v, size).reshape(shape) for v in (p - target, p * (1 - p), np.ones(len(p))))
            step = RATE * _grid_tree(g, h, n)
            pair_tables[q, : shape[0], : shape[1]] += step
            margin += step.ravel()[cell]
    model = Model(edges, coarse, start, tables, pairs, pair_tables, 1.0, 0.0)
    rest = rest if len(set(y[rest].tolist())) == 2 else part
    p = np.clip(model.probability(x[rest]), 1e-9, 1 - 1e-9)
    slope, shift = platt(np.log(p / (1 - p)), y[rest])
    return Model(edges, coarse, start, tables, pairs, pair_tables, slope, shift)


def _sample(batches):
    for batch in sliced(batches):
        x = features(byte_texts(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "x"]
        )


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of ``labels.quality`` from about ``rows`` labelled rows, of which only the features
    come to the driver."""
    found = labelled(docs, labels, "quality", rows).mapInArrow(_sample, "label int, x array<double>").collect()
    found = sorted((list(r["x"]), r["label"]) for r in found)
    x = np.array([r[0] for r in found]).reshape(-1, len(NAMES))
    return fit(x, np.array([r[1] for r in found], np.int64))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``).

    The score is the calibrated probability of quality 1 from counts of the text alone. A null
    text is empty; an empty one is scored by its counts, all zero. ``held_out`` is null without a
    doc_id. Repeated rows stay; an empty table gives an empty one. Without labelled rows every
    score is 0.5, with one class it is near that class.
    """
    model = train(docs, labels)

    def score(batches):
        for batch in sliced(batches):
            p = model.probability(features(byte_texts(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return need(docs.withColumn("held_out", held_out("doc_id")), "doc_id", "held_out", "text").mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int"
    )
