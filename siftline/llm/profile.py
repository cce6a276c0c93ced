"""Counts of a text that quality rules and classifiers share, for many texts at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import GOLDEN, flat, held_out, mix, rolling, word_bounds, word_hashes, written

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
WINDOW_STEP = np.uint64(0x8CB92BA72F3D8DD7)


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


IS_SYMBOL = byte_table(SYMBOLS)


class Profile:
    """Words of a few texts, found once: ``first`` and ``end`` byte, hash and text of every word."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.data, self.starts = flat(texts)
        self.first, self.end = word_bounds(self.data, self.starts)
        self.hash = word_hashes(self.data, self.first, self.end)
        self.word_starts = np.searchsorted(self.first, self.starts)
        self.n_words = np.diff(self.word_starts)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)

    def bytes_where(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask holds."""
        before = np.concatenate([[0], np.cumsum(mask)])
        return before[self.starts[1:]] - before[self.starts[:-1]]

    def words_where(self, mask: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(mask)])
        return before[self.word_starts[1:]] - before[self.word_starts[:-1]]

    def word_chars(self) -> np.ndarray:
        """Code points in words: bytes of words that continue no other."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.first] = 1
        np.subtract.at(inside, self.end, 1)
        return self.bytes_where((np.cumsum(inside[:-1], dtype=np.int8) > 0) & (self.data & 0xC0 != 0x80))

    def symbols(self) -> np.ndarray:
        return self.bytes_where(IS_SYMBOL[self.data])

    def duplicate_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        out = np.zeros(len(self.texts), np.int64)
        for i, text in enumerate(self.texts):
            lines = [x for x in text.split(b"\n") if x.strip()]
            out[i] = len(lines) - len(set(lines))
        return out

    def lines(self) -> np.ndarray:
        return self.bytes_where(self.data == 10) + 1

    def repeated_words(self, width: int = WINDOW) -> np.ndarray:
        """Words in windows of ``width`` words that their text has twice or more."""
        room = np.maximum(self.n_words - width + 1, 0)
        doc = np.repeat(np.arange(len(room)), room)
        place = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room - self.word_starts[:-1], room)
        if not len(place):
            return np.zeros(len(self.texts), np.int64)
        name = mix(rolling(self.hash, width, WINDOW_STEP)[place] + doc.astype(np.uint64) * GOLDEN)
        order = np.argsort(name)
        name = name[order]
        same = np.zeros(len(name) + 1, bool)
        same[1:-1] = name[1:] == name[:-1]
        hit = place[order[same[1:] | same[:-1]]]
        cover = np.zeros(len(self.hash) + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + width, -1)
        return self.words_where(np.cumsum(cover)[:-1] > 0)

    def distinct_words(self) -> np.ndarray:
        name = mix(self.hash + self.doc.astype(np.uint64) * GOLDEN)
        _, at = np.unique(name, return_index=True)
        return np.bincount(self.doc[at], minlength=len(self.texts))

    def means(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean of the values from each start to the next; 0 of none."""
        before = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        n = np.diff(starts)
        return (before[starts[1:]] - before[starts[:-1]]) / np.maximum(n, 1)


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``text, label`` of about ``rows`` labelled documents a model may learn from, by the hash of
    their id: all of them if there are fewer, twice as many at the most. Held-out rows and null labels are out.

    An id counts once, however often it stands in either table: with its smallest label, and the text of
    the smallest hash. Only drawn texts are grouped, those of a task by themselves first.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.min(F.col(label).cast("int")).alias("label"))
        .transform(written, "labels")
    )
    n = known.count()
    share = min(1 << 30, int((1 << 30) * rows / max(1, n)))
    some = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < share).limit(2 * rows).collect()
    # At most 2 * rows ids and labels, sent to the texts instead of shuffling all texts to them.
    drawn = F.broadcast(docs.sparkSession.createDataFrame(some, "label_id long, label int"))
    rows_drawn = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("label_id"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    return rows_drawn.groupBy("label_id", "label").agg(one.alias("one")).select(F.col("one.text").alias("text"), "label")


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift that turn margins into calibrated log-odds (Newton steps, smoothed targets)."""
    n1, n0 = float(label.sum()), float((1 - label).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, w = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, [(g * margin).sum() + 1e-3 * (a - 1), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(np.clip(b, -30, 30))


def odds(share: float, n: int) -> float:
    p = (share * n + 1) / (n + 2)
    return float(np.log(p / (1 - p)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
