"""Quality rules: fixed counts, then logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import GOLDEN, byte_texts, mix, need, sliced
from siftline.llm.profile import Profile, labelled, odds, platt, sigmoid

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
THRESHOLD = 0.5
TRAIN_ROWS = 3_000
EXCERPT = 8192
BITS = 16
SIZE = 1 << BITS
EPOCHS = 12
STEPS = 1_000
BATCH = 32
CHARS = (2, 4)
FAMILIES = 2 + len(CHARS)
SPREAD = np.uint32(2654435769)


def _families(p: Profile):
    """(hashed n-grams, where each text's start) for words, word pairs and runs of bytes.

    Runs of bytes and word pairs never reach from one text into the next. All pairs of a word with
    itself are one n-gram.
    """
    fold = np.uint64(64 - BITS)
    yield ((p.hash * GOLDEN) >> fold).astype(np.int64), p.word_starts
    room = np.maximum(p.n_words - 1, 0)
    starts = np.concatenate([[0], np.cumsum(room)])
    at = np.arange(starts[-1]) + np.repeat(p.word_starts[:-1] - starts[:-1], room)
    pair = (mix(p.hash[at] * GOLDEN + p.hash[at + 1]) >> fold).astype(np.int64)
    pair[p.hash[at] == p.hash[at + 1]] = 0
    yield pair, starts
    size = np.diff(p.starts)
    for n in CHARS:
        code = np.zeros(max(0, len(p.data) - n + 1), np.uint32)
        for j in range(n):
            code = (code << np.uint32(8)) | p.data[j : j + len(code)]
        code = (code + np.uint32(n)) * SPREAD >> np.uint32(32 - BITS)
        room = np.maximum(size - n + 1, 0)
        starts = np.concatenate([[0], np.cumsum(room)])
        if (room == size - n + 1).all():
            # All but the last few of each text: cheaper than a gather.
            keep = np.ones(len(p.data), bool)
            for j in range(1, n):
                keep[p.starts[1:] - j] = False
            yield code[keep[: len(code)]].astype(np.int64), starts
        else:
            at = np.arange(starts[-1]) + np.repeat(p.starts[:-1] - starts[:-1], room)
            yield code[at].astype(np.int64), starts


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, p: Profile) -> np.ndarray:
        margin = np.zeros(len(p.texts))
        for k, (code, starts) in enumerate(_families(p)):
            margin += p.means(self.weights[k][code], starts)
        return sigmoid(self.slope * margin + self.shift)


def _features(batches):
    """Each text as the different n-grams it has and their shares of its family."""
    for batch in sliced(batches):
        p = Profile(byte_texts(batch.column("text")))
        idx: list[list[np.ndarray]] = [[] for _ in p.texts]
        val: list[list[np.ndarray]] = [[] for _ in p.texts]
        for k, (code, starts) in enumerate(_families(p)):
            for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
                if b > a:
                    found, n = np.unique(code[a:b], return_counts=True)
                    idx[i].append((found + k * SIZE).astype("<i4"))
                    val[i].append((n / (b - a)).astype("<f4"))
        join = lambda parts: b"".join(x.tobytes() for x in parts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(map(join, idx), pa.binary()), pa.array(map(join, val), pa.binary())],
            names=["label", "idx", "val"],
        )


def _excerpt() -> Column:
    spare = F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1
    return F.substring(F.col("text"), (F.pmod(F.xxhash64("text"), spare) + 1).cast("int"), F.lit(EXCERPT))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of ``labels.quality`` from about ``rows`` labelled rows, of each an excerpt of
    ``EXCERPT`` letters at most, at a hashed place. A row comes to the driver as the different hashed
    n-grams of that, so what the driver holds does not depend on how long texts are. Texts are judged whole.

    Four fifths of the rows fit the weights (AdaGrad, both classes weighing the same, ``EPOCHS`` rounds
    and ``STEPS`` steps at the least), the rest calibrate them. Without rows of both classes the score is their smoothed share.
    """
    found = labelled(docs, labels, "quality", rows).withColumn("text", _excerpt()).mapInArrow(_features, "label int, idx binary, val binary").collect()
    found.sort(key=lambda r: (r["idx"], r["val"], r["label"]))
    y = np.array([r["label"] for r in found], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((FAMILIES, SIZE), np.float32), 1.0, odds(y.mean() if len(y) else 0.5, len(y)))
    idx = [np.frombuffer(r["idx"], "<i4") for r in found]
    val = [np.frombuffer(r["val"], "<f4") for r in found]
    rng = np.random.default_rng(0)
    order = rng.permutation(len(y))
    fit, rest = order[: max(1, len(y) * 4 // 5)], order[len(y) * 4 // 5 :]
    balance = np.where(y > 0, 0.5 / max(y[fit].mean(), 1e-3), 0.5 / max(1 - y[fit].mean(), 1e-3))
    w, seen = np.zeros(FAMILIES * SIZE), np.full(FAMILIES * SIZE, 1e-8)
    bias, bias_seen = 0.0, 1e-8

    def margins(pick):
        size = np.array([len(idx[i]) for i in pick])
        at = np.concatenate([idx[i] for i in pick]) if len(pick) else np.zeros(0, np.int32)
        x = np.concatenate([val[i] for i in pick]) if len(pick) else np.zeros(0, np.float32)
        row = np.repeat(np.arange(len(pick)), size)
        return at, x, row, np.bincount(row, w[at] * x, minlength=len(pick)) + bias

    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(fit)))):
        rng.shuffle(fit)
        for a in range(0, len(fit), BATCH):
            pick = fit[a : a + BATCH]
            at, x, row, m = margins(pick)
            g = (sigmoid(m) - y[pick]) * balance[pick] / len(pick)
            there, place = np.unique(at, return_inverse=True)
            step = np.bincount(place, g[row] * x)
            seen[there] += step**2
            w[there] -= 0.5 * step / np.sqrt(seen[there])
            bias_seen += g.sum() ** 2
            bias -= 0.1 * g.sum() / np.sqrt(bias_seen)
    rest = rest if len(set(y[rest].tolist())) == 2 else order
    slope, shift = platt(margins(rest)[3], y[rest])
    return Model(w.reshape(FAMILIES, SIZE).astype(np.float32), slope, shift + slope * bias)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    score`` for every row of ``docs`` (``doc_id, text``).

    Base rules: fewer than 10 words, or over 20 percent of the words in repeated 5-word windows,
    fail. Others stay if the calibrated probability of label 1 is at least ``threshold``. A null or
    empty text has no words and fails. Repeated rows and rows without doc_id are judged like
    others; an empty table gives an empty one.
    """
    model = train(docs, labels)

    def score(batches):
        for batch in sliced(batches):
            p = Profile(byte_texts(batch.column("text")))
            repeats = p.repeated_words()
            failed = (p.n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * p.n_words)
            quality = model.probability(p)
            counts = [p.n_words, p.word_chars(), p.symbols(), p.duplicate_lines(), repeats]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(x.astype(np.int64)) for x in counts),
                    pa.array(failed), pa.array(~failed & (quality >= threshold)), pa.array(quality),
                ],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    return need(docs, "doc_id", "text").mapInArrow(
        score,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, score double",
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, judged row by row in the scan: nothing is joined."""
    model = train(docs, labels)

    def keep(batches):
        for batch in sliced(batches):
            p = Profile(byte_texts(batch.column("text")))
            failed = (p.n_words < MIN_WORDS) | (100 * p.repeated_words() > MAX_REPEAT_PERCENT * p.n_words)
            yield batch.filter(pa.array(~failed & (model.probability(p) >= threshold)))

    return docs.mapInArrow(keep, docs.schema)
