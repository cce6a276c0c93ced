"""Best-fit packing of documents into sequences by linear grouping."""

from __future__ import annotations

import functools
import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import byte_texts, flat, need, shuffle_partitions, sliced, word_bounds, written
from siftline.llm.known import Known, distinct, gathered, packed
from siftline.llm.tokens import _byte_letters

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END = 1
# Group counts and smallest large share of the capacity that are tried, in this order.
TRIALS = ((16, 4), (16, 2), (8, 2), (8, 8), (24, 3))
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True
# Second bytes of letters of Latin-1, of which the times and division signs are none.
LATIN = np.zeros(256, bool)
LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
LETTERS = {b: letter for letter, b in _byte_letters().items()}
SLICE = 6 << 20
BORDER = "<|startoftext|>"
TOGETHER = 100
RANK_ROWS = 100_000


class Encoder:
    """Ids of words, which are looked up if met before. White space is no part of any token, so a
    text's ids are those of its words in turn; only spaces of one byte cut words here, others are
    left to the tokenizer. A mark after a letter starts a word as well, and ASCII words are asked in
    lower case: the vocabulary parts and folds them so itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = self.tokenizer.token_to_id(BORDER)
        self.known = Known(self._ids)

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """A word of Latin letters is one pre-token, which the model parts; others go all the way, many a
        call, with a special string between them, or alone if they might complete such a string."""
        split, out = self.tokenizer.model.tokenize, [b""] * len(words)
        joined, odd = [], []
        for k, w in enumerate(words):
            if w.isascii():
                text = w.decode() if w.isalpha() and w.islower() else ""
            else:
                text = w.decode().lower()
                text = text.encode().decode("latin-1").translate(LETTERS) if text.isalpha() and max(text) < "\u0250" else ""
            if text:
                out[k] = packed([t.id for t in split(text)])
            elif b"<" in w or b">" in w:
                odd.append(k)
            else:
                joined.append(k)
        parts = [joined[a : a + TOGETHER] for a in range(0, len(joined), TOGETHER)]
        calls = [BORDER.join(words[k].decode() for k in part) for part in parts]
        calls += [words[k].decode() for k in odd]
        found = self.tokenizer.encode_batch_fast(calls, add_special_tokens=False)
        for part, encoded in zip(parts, found):
            ids, a = encoded.ids, 0
            for k in part[:-1]:
                b = ids.index(self.special, a)
                out[k], a = packed(ids[a:b]), b + 1
            out[part[-1]] = packed(ids[a:])
        for k, encoded in zip(odd, found[len(parts) :]):
            out[k] = packed(encoded.ids)
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids start (one more entry)."""
        data, starts = flat(texts)
        first, end = word_bounds(data, starts)
        letter = LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & LATIN[data[1:]]
        mark = np.flatnonzero(letter[:-1] & MARK[data[1:]]) + 1
        mark = mark[~np.isin(mark, starts)]
        first, end = np.sort(np.append(first, mark)), np.sort(np.append(end, mark))
        words, which = distinct(data, first, end)
        # "<" may open a special string, which is told by its case.
        words = [w.lower() if w.isascii() and b"<" not in w else w for w in words]
        ids, at = self.known.ids(words)
        places, before = gathered(at, which)
        return ids[places], before[np.searchsorted(first, starts)]


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut every
    ``capacity`` tokens."""

    def cut(batches):
        codec = encoder(public_tokenizers.path(vocabulary))
        for batch in sliced(batches, limit=SLICE):
            ids, starts = codec.encode(byte_texts(batch.column("text")))
            rows, out = [], []
            for row, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
                own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                for piece, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append(row)
                    out.append((piece, at, len(part), zlib.crc32(part.tobytes())))
            columns = [pa.array(x, pa.int64()) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), *columns],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return need(docs, "doc_id", "text").mapInArrow(
        cut, "doc_id long, piece long, start long, length long, ids_crc32 long"
    )


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """A cheapest fractional set of (how many of each size, times) that covers the demand.

    Column generation: the linear program over the patterns met so far is kept at a basis, and
    a knapsack over the capacity finds the pattern that its prices would gain most from.
    """
    k = len(sizes)
    basis = [[capacity // sizes[i] if j == i else 0 for j in range(k)] for i in range(k)]
    need_ = np.array(demand, float)
    for _ in range(60 * k):
        matrix = np.array(basis, float).T
        amount = np.linalg.solve(matrix, need_)
        price = np.linalg.solve(matrix.T, np.ones(k))
        worth, pattern = _knapsack(sizes, price, capacity)
        if worth <= 1 + 1e-9:
            break
        column = np.linalg.solve(matrix, np.array(pattern, float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(column > 1e-12, np.maximum(amount, 0) / column, np.inf)
        basis[int(np.argmin(ratio))] = pattern
    amount = np.linalg.solve(np.array(basis, float).T, need_)
    return [(p, float(x)) for p, x in zip(basis, amount) if x > 0]


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    order = np.array(sizes)
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = order <= room
        gain = np.where(fits, price + best[np.where(fits, room - order, 0)], -1.0)
        i = int(np.argmax(gain))
        if gain[i] > best[room - 1]:
            best[room], took[room] = gain[i], i
        else:
            best[room] = best[room - 1]
    pattern, room = [0] * len(sizes), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), pattern


def plan(counts: dict[int, int], capacity: int = CAPACITY, trials: tuple = TRIALS) -> list[tuple]:
    """Where the pieces go, given how many there are of each length.

    Rows (length, first rank, how many, first sequence, pieces a sequence, offset): of the pieces of
    that length, numbered from 0, these stand side by side at that offset, so many in each
    of consecutive sequences. The work and the rows depend on the number of different
    lengths (``capacity`` at most) and of groups, not on the number of documents.

    Lengths over a share of the capacity are dealt, largest first, into groups of equally many
    pieces and rounded up to the longest of their group; configurations of rounded lengths are
    optimised and used a whole number of times, each place taking an actual piece of its group.
    What is left and all small pieces go, longest first, to the fullest sequence that takes them.
    A few numbers of groups and shares are tried until a plan needs no more sequences than the tokens
    fill; else the best one is taken.
    """
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    best: tuple[int, list[tuple]] | None = None
    for groups, small in trials:
        found = _plan(counts, capacity, groups, capacity // small)
        best = found if best is None or found[0] < best[0] else best
        if best[0] <= least:
            break
    return best[1] if best else []


def _plan(counts: dict[int, int], capacity: int, groups: int, small: int) -> tuple[int, list[tuple]]:
    """(sequences, rows)"""
    left = dict(counts)
    rank = dict.fromkeys(left, 0)
    rows: list[tuple] = []
    sequences = 0
    spaces: list[tuple[int, int, int]] = []

    def take(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        rows.append((length, rank[length], n, sequence, each, offset))
        rank[length] += n
        left[length] -= n

    if full := left.get(capacity, 0):
        take(capacity, full, 0, 1, 0)
        sequences = full
    large = sorted((x for x in left if small < x < capacity), reverse=True)
    total = sum(left[x] for x in large)
    if total:
        share = -(-total // groups)
        queues: list[list[list[int]]] = [[]]
        room = share
        for x in large:
            n = left[x]
            while n:
                if not room:
                    queues.append([])
                    room = share
                m = min(n, room)
                queues[-1].append([x, m])
                n, room = n - m, room - m
        # A length that closes one group and opens the next would give two equal sizes.
        merged: dict[int, list[list[int]]] = {}
        for q in queues:
            merged.setdefault(q[0][0], []).extend(q)
        sizes = list(merged)
        demand = [sum(n for _, n in merged[s]) for s in sizes]
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [sizes[i] for i, a in enumerate(pattern) for _ in range(a)]
            per = {s: slots.count(s) for s in set(slots)}
            times = min([int(times + 1e-9), *(sum(n for _, n in merged[s]) // a for s, a in per.items())])
            if not times or not slots:
                continue
            runs = [(sequences, times, 0)]
            for s in slots:
                runs = _place(runs, merged[s], take)
            sequences += times
            spaces += [(capacity - used, at, n) for at, n, used in runs]
    by_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def offer(space: int, at: int, n: int) -> None:
        if space and n:
            if space not in by_room:
                by_room[space] = []
                insort(rooms, space)
            by_room[space].append((at, n))

    for space, at, n in spaces:
        offer(space, at, n)
    for x in sorted((x for x in left if left[x]), reverse=True):
        while n := left[x]:
            k = bisect_left(rooms, x)
            if k < len(rooms):
                space = rooms[k]
                at, many = by_room[space].pop()
                if not by_room[space]:
                    del by_room[space]
                    rooms.pop(k)
            else:
                space, at, many = capacity, sequences, -(-n // (capacity // x))
                sequences += many
            each = min(space // x, n)
            used = min(many, n // each)
            take(x, used * each, at, each, capacity - space)
            offer(space - each * x, at, used)
            offer(space, at + used, many - used)
    return sequences, rows


def _place(runs, queue, take):
    """One more piece of the queue in every sequence of the runs; runs part where its length does."""
    out = []
    for at, n, used in runs:
        while n:
            x, there = queue[0]
            m = min(n, there)
            take(x, m, at, 1, used)
            out.append((at, m, used + x))
            queue[0][1] -= m
            if not queue[0][1]:
                queue.pop(0)
            at, n = at + m, n - m
    return out


def ranked(table: DataFrame, rows: int) -> DataFrame:
    """Each row's ``rank`` among the rows of its length, from 0.

    Rows of a length are dealt over salts by the hash of their document, numbered in each, and
    moved up by the count of the salts before: a length that a third of all rows have is spread.
    """
    salts = max(shuffle_partitions(table.sparkSession), -(-rows // RANK_ROWS))
    salted = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = (
        salted.groupBy("length", "salt")
        .count()
        .select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    )
    inside = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        salted.withColumn("within", F.row_number().over(inside) - 1)
        .join(base, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("within"))
        .drop("salt", "base", "within")
    )


def pack_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of ``docs``
    (``doc_id, text``).

    A document is its ids and the end id; only one longer than ``capacity`` is cut. A null or
    empty text is the end id alone. Repeated rows and rows without doc_id are packed like others;
    which of several equal pieces stands where is not told. An empty table gives an empty one.

    The pieces are written once. Only the count of each length, at most ``capacity`` numbers, comes
    to the driver; the plan made of it goes back to the tasks, which find each piece's place
    by its rank among those of its length.
    """
    table = written(pieces(docs, vocabulary, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    rows = sorted(plan(counts, capacity))
    length, first, _, sequence, each, offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 6

    def place(batches):
        # Lengths and ranks as one ascending number.
        span = np.int64(1) << np.int64(48)
        starts = length * span + first
        for batch in batches:
            x, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(starts, x * span + rank, side="right") - 1
            nth = rank - first[k]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(sequence[k] + nth // each[k]),
                    pa.array(offset[k] + nth % each[k] * x),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked(table, sum(counts.values())).mapInArrow(
        place,
        "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
