"""Token counts of a byte-level BPE by merging arrays of symbols, all sequences at once."""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from siftline.llm.common import need, sliced

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
KNOWN = 400_000
NO_RANK = np.int32(2**31 - 1)
TABLE_BITS = 18
SPREAD = np.uint32(2654435769)


def _byte_letters() -> dict[str, int]:
    """The letter by which the vocabulary file writes each byte: printable Latin-1 ones stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """The merges of a vocabulary file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in _byte_letters().items():
            self.byte_ids[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.keys = np.full(1 << TABLE_BITS, -1, np.int64)
        self.ranks = np.full(1 << TABLE_BITS, NO_RANK, np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.keys[slot] >= 0 and self.keys[slot] != key:
                slot = (slot + 1) & ((1 << TABLE_BITS) - 1)
            if self.keys[slot] < 0:
                self.keys[slot], self.ranks[slot] = key, rank
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint32) * SPREAD >> np.uint32(32 - TABLE_BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, ``NO_RANK`` if it never merges."""
        keys = left.astype(np.int64) << 16 | right
        out = np.full(len(keys), NO_RANK, np.int32)
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            go = ~hit & (there >= 0)
            open_, slot = open_[go], (slot[go] + 1) & ((1 << TABLE_BITS) - 1)
        return out

    def sizes(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty piece when nothing merges any more."""
        size = np.array([len(p) for p in pieces], np.int64)
        done = size.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        row = np.arange(len(pieces))
        while len(row):
            start = np.cumsum(size) - size
            rank = np.full(len(symbols), NO_RANK, np.int32)
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[start + size - 1] = NO_RANK
            low = np.minimum.reduceat(rank, start)
            done[row] = size
            going = low < NO_RANK
            keep = np.repeat(going, size)
            symbols, rank, low = symbols[keep], rank[keep], np.repeat(low, size)[keep]
            row, size = row[going], size[going]
            if not len(row):
                break
            hit = rank == low
            # Of touching occurrences (aaa) the first, third, ... merge.
            place = np.arange(len(hit))
            last_miss = np.maximum.accumulate(np.where(hit, -1, place))
            hit &= (place - last_miss) % 2 == 1
            symbols[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbols), bool)
            stay[np.flatnonzero(hit) + 1] = False
            owner = np.repeat(np.arange(len(size)), size)
            size = size - np.bincount(owner[hit], minlength=len(size))
            symbols = symbols[stay]
        return done

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        found = []
        for text in texts:
            specials, parts = 0, [text]
            if self.special:
                parts = self.special.split(text)
                specials = len(parts) - 1
            words: list[str] = []
            for part in parts:
                words += self.pattern.findall(part)
            found.append((specials, words))
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        new = [w for w in {w for _, words in found for w in words} if w not in known]
        for a in range(0, len(new), 100_000):
            part = new[a : a + 100_000]
            known.update(zip(part, self.sizes([w.encode() for w in part]).tolist()))
        return [specials + sum(map(known.__getitem__, words)) for specials, words in found]


@functools.lru_cache(1)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (``doc_id, text``).

    Counts are those of the vocabulary's own tokenizer with nothing added; a special string in a
    text is one token. A null or empty text has none. Every row stays, repeated or without id; an
    empty table gives an empty one. Each task merges the different pre-tokens it has not met
    yet; how many it remembers is bounded and does not change any count.
    """

    def count(batches):
        bpe = merger(public_tokenizers.path(vocabulary))
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = np.array(bpe.count(texts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens),
                    pa.array(tokens > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return need(docs, "doc_id", "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
