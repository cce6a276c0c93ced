"""Language identification by cross-parsing with suffix automata."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import GOLDEN, held_out, need, sliced, written

UNKNOWN = "und"
SAMPLE_DOCS = 100
LANGUAGE_CHARS = 20_000
LANGUAGES_SENT = 100_000
BLOCK = 256
# Letters are their code points; two numbers beyond those, and a state that no letter leads out of.
GAP, PAD = 0x110000, 0x110001
BITS = 21
VOID = 0
EMPTY = -1
SPARE = 2.5
STEP_STATES = 1 << 15


def _shares(lengths: list[int], room: int) -> list[int]:
    """Letters of each text, as even as their lengths let them be, ``room`` in all or fewer."""
    out = [0] * len(lengths)
    for k, i in enumerate(sorted(range(len(lengths)), key=lengths.__getitem__)):
        out[i] = min(lengths[i], room // (len(lengths) - k))
        room -= out[i]
    return out


def _excerpt(text: str, size: int) -> str:
    start = zlib.crc32(text.encode("utf-8", "surrogatepass")) % (len(text) - size + 1)
    return text[start : start + size]


def sample_texts(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> tuple[tuple[str, str], ...]:
    """(language, text) to learn from: about ``per_language`` labelled rows of each language that are
    not held out, by the hash of their id, of any length. Of each an excerpt of ``LANGUAGE_CHARS``
    letters at most, at a hashed place, comes to the driver; nothing else does. There the rows of a
    language share ``LANGUAGE_CHARS`` letters evenly."""
    known = docs.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")
    ).where(F.length("text") > 0)
    # Drawn from ids and languages alone; only then are excerpts of the few drawn rows fetched.
    narrow = known.select("doc_id", "lang")
    counts = narrow.groupBy("lang").count().transform(written, "languages")
    # One row a language: sent to the rows, so that a language of most rows is not one task's.
    if counts.count() <= LANGUAGES_SENT:
        counts = F.broadcast(counts)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit((1 << 30) * per_language) / F.col("count")
    drawn = narrow.join(counts, "lang").where(part).select("doc_id", "lang").distinct().collect()
    ids = docs.sparkSession.createDataFrame(drawn, "doc_id long, lang string")
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - LANGUAGE_CHARS, F.lit(0)) + 1) + 1
    excerpt = F.substring(F.col("text"), place.cast("int"), F.lit(LANGUAGE_CHARS))
    rows = (
        known.select("doc_id", "lang", excerpt.alias("text")).join(F.broadcast(ids), ["doc_id", "lang"])
        .groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    )
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return tuple(
        (k, "\n".join(_excerpt(t, n) for t, n in zip(v, _shares([len(t) for t in v], max(1, LANGUAGE_CHARS - len(v))))))
        for k, v in texts.items()
    )


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that reads exactly the substrings of ``codes``; 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        new, p = len(moves) - 1, last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                copy = len(moves) - 1
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Moves:
    """Moves of many states as one table of (state, letter), open-addressed, looked up for many at once.

    It holds the moves that exist and no others, so its size follows the samples and not the
    alphabets: every letter of every language keeps its own number.
    """

    def __init__(self, keys: np.ndarray, to: np.ndarray):
        bits = max(1, int(len(keys) * SPARE).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, EMPTY, np.int64), np.zeros(1 << bits, np.int32)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[at] == EMPTY
            self.keys[at[free]] = keys[left[free]]
            # Of several keys that wrote to one slot the last stays, the others go on.
            there = self.keys[at] == keys[left]
            self.to[at[there]] = to[left[there]]
            left, at = left[~there], (at[~there] + 1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * GOLDEN) >> self.shift).view(np.int64)

    def __call__(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each (VOID if there is none), and which have none."""
        keys = state << BITS
        keys |= letter
        at = self._slots(keys)
        out = self.to.take(at).astype(np.int64)
        left = np.flatnonzero(self.keys.take(at) != keys)
        none = [left[:0]]
        at, keys = at[left], keys[left]
        while len(left):
            found = self.keys[at]
            hit, end = found == keys, found == EMPTY
            out[left[hit]] = self.to[at[hit]]
            none.append(left[end])
            on = ~(hit | end)
            left, at, keys = left[on], (at[on] + 1) & self.last, keys[on]
        none = np.concatenate(none)
        out[none] = VOID
        return out, none


class Parser:
    """The automata of all languages in one table of moves, run over blocks of many texts in step.

    Where no move fits, a phrase has ended and a new one starts with this letter. A letter that a
    language lacks is two phrases, an empty match and the letter itself, so that it costs more than one
    that the language has.
    """

    def __init__(self, sample: tuple[tuple[str, str], ...]):
        self.languages = [k for k, _ in sample]
        self.letter = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
        keys, to, roots, base = [], [], [], VOID + 1
        self.size = []
        for _, text in sample:
            codes = self._codes(text)
            moves = suffix_automaton(codes.tolist())
            n = np.array([len(m) for m in moves])
            state = np.repeat(np.arange(len(moves), dtype=np.int64) + base, n)
            keys.append(state << BITS | np.fromiter((c for m in moves for c in m), np.int64, int(n.sum())))
            to.append((np.fromiter((x for m in moves for x in m.values()), np.int64, int(n.sum())) + base).astype(np.int32))
            roots.append(base)
            self.size.append(max(2, len(codes)))
            base += len(moves)
        self.roots = np.array(roots, np.int64)
        none = np.zeros(0, np.int64)
        self.moves = Moves(np.concatenate(keys or [none]), np.concatenate(to or [none.astype(np.int32)]))

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)

    def _codes(self, text: str) -> np.ndarray:
        """Letters by number; runs of anything else are one gap."""
        points = self._points(text)
        codes = np.where(self.letter[points], points, GAP).astype(np.int32)
        gap = codes == GAP
        gap[1:] &= gap[:-1].copy()
        if len(gap):
            gap[0] = codes[0] == GAP
        return codes[~gap]

    def phrases(self, blocks: np.ndarray) -> np.ndarray:
        """Phrases that each language (rows) needs for each block (columns); a block ends at its first PAD."""
        n = len(blocks)
        state = np.full(len(self.languages) * n, VOID, np.int64)
        count = np.zeros(len(state), np.int32)
        for letters in np.ascontiguousarray(blocks.T).astype(np.int64):
            on = letters != PAD
            if not on.any():
                break
            state, ended = self.moves(state, np.tile(letters, len(self.languages)))
            ended = ended[on[ended % n]]
            state[ended], lacking = self.moves(self.roots[ended // n], letters[ended % n])
            count[ended] += 1
            count[ended[lacking]] += 1
        return count.reshape(-1, n)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language that parses each text into the fewest phrases, each weighted by the bits that
        point into its sample; and how clearly, from 0 to 1. Blocks of a text are parsed apart
        and their phrases added."""
        found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        codes = [self._codes(t) for t in texts]
        has = np.array([bool((c != GAP).any()) for c in codes], bool)
        if not has.any() or not self.languages:
            return found, scores
        blocks = np.array([-(-len(c) // BLOCK) for c in codes])
        grid = np.full((int(blocks.sum()), BLOCK), PAD, np.int32)
        starts = np.cumsum(blocks) - blocks
        lines = grid.reshape(-1)
        for c, a in zip(codes, starts.tolist()):
            lines[a * BLOCK : a * BLOCK + len(c)] = c
        owner = np.repeat(np.arange(len(texts)), blocks)
        cost = np.zeros((len(self.languages), len(texts)))
        # A few blocks at a time where there are many languages.
        width = max(1, STEP_STATES // len(self.languages))
        for a in range(0, len(grid), width):
            part = self.phrases(grid[a : a + width])
            cost += np.stack([np.bincount(owner[a : a + width], p, minlength=len(texts)) for p in part])
        cost *= np.log2(np.array(self.size))[:, None]
        order = np.argsort(cost, axis=0, kind="stable")
        best = np.take_along_axis(cost, order[:1], 0)[0]
        next_ = np.take_along_axis(cost, order[min(1, len(cost) - 1)][None], 0)[0]
        clear = next_ / np.maximum(best + next_, 1e-9) if len(cost) > 1 else np.ones(len(texts))
        for i in np.flatnonzero(has):
            found[i], scores[i] = self.languages[order[0, i]], clear[i]
        return found, scores


@functools.lru_cache(1)
def parser(sample: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(sample)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text, lang``).

    ``lang_pred`` is a language of the rows learned from; ``und`` with score 0 if the text is null or
    has no letter, or if there was nothing to learn. Ties go to the language that sorts first.
    ``held_out`` is null without a doc_id. Repeated rows stay; an empty table gives an empty one.
    """
    sample = sample_texts(docs)

    def label(batches):
        parse = parser(sample)
        for batch in sliced(batches):
            langs, scores = parse.predict([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return need(docs.withColumn("held_out", held_out("doc_id")), "doc_id", "held_out", "text").mapInArrow(
        label, "doc_id long, held_out boolean, lang_pred string, score double"
    )
