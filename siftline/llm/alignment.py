"""Alignment of the tokens of two tokenizers by interval coalescing, and how often ids go together."""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import byte_texts, flat, need, sliced, written
from siftline.llm.known import distinct, gathered
from siftline.llm.tokens import _byte_letters

FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
# Bytes of text whose documents share one list of id pairs.
SLICE = 4 << 20
SPACE = 0x20
BLANK = "▁"
# Words to a call, and calls whose tokens are held at once.
JOINED = 200
CALLS = 50
AT_ONCE = 30_000


class Tokenizers:
    """Tokens of stretches of text, and the bytes that each token stands for."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = _byte_letters()
        added = {t.content.encode() for t in self.a.get_added_tokens_decoder().values()}
        a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, k in self.a.get_vocab(with_added_tokens=True).items():
            plain = all(c in letters for c in token)
            a_bytes[k] = bytes(letters[c] for c in token) if plain else token.encode()
        b_pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(BLANK, " ").encode()
            for k, p in enumerate(b_pieces)
        ]
        self.a_table, self.b_table = Table(a_bytes), Table(b_bytes)
        # No piece goes on over a blank and no special string holds one, so that both tokenizers may
        # be given a text in stretches.
        self.parted = not any(BLANK in p.lstrip(BLANK) for p in b_pieces) and not any(b" " in t for t in added)

    def first(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of A of all ``words``, and where those of each start (one more entry)."""

        def encode(texts):
            found = self.a.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [e.ids for e in found]

        return self._tokens(words, encode, self.a_table)

    def second(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of B, which adds the blank that a word begins with."""
        return self._tokens(words, lambda texts: self.b.encode([t[1:].decode() for t in texts], num_threads=1), self.b_table)

    def _tokens(self, words, encode, table):
        """Many words a call: the lengths of the tokens tell where each ends, or else it is asked alone."""
        joined = JOINED if self.parted else 1
        calls = [words[k : k + joined] for k in range(0, len(words), joined)]
        ids, sizes = [], []
        found = (x for k in range(0, len(calls), CALLS) for x in encode([b"".join(c) for c in calls[k : k + CALLS]]))
        for call, found_ids in zip(calls, found):
            own = np.array(found_ids, np.uint32)
            stop = np.append(0, np.cumsum(table.size[own]))
            ends = np.cumsum([len(w) for w in call])
            at = np.searchsorted(stop, ends, side="right") - 1
            if stop[-1] != ends[-1] or not np.array_equal(stop[at], ends):
                alone = encode(call)
                own, at = np.array([k for x in alone for k in x], np.uint32), np.cumsum([len(x) for x in alone])
            ids.append(own)
            sizes.append(np.diff(at, prepend=0))
        starts = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), starts


class Table:
    """Bytes and decimal digits of every id."""

    def __init__(self, values: list[bytes]):
        self.bytes, self.starts = flat(values)
        self.size = self.starts[1:] - self.starts[:-1]
        self.digits, self.digit_starts = flat([str(k).encode() for k in range(len(values))])

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[gathered(self.starts, ids)[0]]


@functools.lru_cache(1)
def tokenizers(first: str, second: str) -> Tokenizers:
    return Tokenizers(first, second)


def _plain() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that are a character other than white space, and first bytes of such characters only."""
    ascii_ = np.zeros(256, bool)
    ascii_[0x21:0x7F] = True
    lead = np.zeros(256, bool)
    lead[0xC3:0xE0] = True
    lead[0xE4:0xF5] = True
    return ascii_, lead


ASCII, LEAD = _plain()


def stretches(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where texts that start at ``starts`` (and end with the data) are cut: at each text's first byte, and at blanks between two characters of which
    neither is white space. There both tokenizers start anew. (Characters that share their first
    byte with some white space count as such.)"""
    n = len(data)
    at = np.flatnonzero(data == SPACE)
    at = at[(at > 0) & (at < n - 1)]
    after = data[at + 1]
    at = at[ASCII[after] | LEAD[after]]
    before = ASCII[data[at - 1]]
    tail = (data[at - 1] >= 0x80) & (data[at - 1] < 0xC0)
    for back in (2, 3, 4):
        place = np.maximum(at - back, 0)
        before |= tail & LEAD[data[place]]
        tail &= (data[place] >= 0x80) & (data[place] < 0xC0)
    cut = np.zeros(n + 1, bool)
    cut[at[before]] = True
    cut[starts] = True
    return np.flatnonzero(cut[:n])


def coalesce(a_end: np.ndarray, a_start: np.ndarray, b_end: np.ndarray, b_start: np.ndarray):
    """Groups and overlaps of two lists of intervals.

    All are sorted by start; a group begins where a start has reached the greatest end so far. Gives
    the group of each interval of A and of B, and the overlapping pairs (place in A, in B).
    """
    start = np.concatenate([a_start, b_start])
    end = np.concatenate([a_end, b_end])
    side = np.repeat([0, 1], [len(a_start), len(b_start)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    opens = np.ones(len(order), bool)
    opens[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    low = np.searchsorted(b_end, a_start, side="right")
    high = np.searchsorted(b_start, a_end, side="left")
    many = np.maximum(high - low, 0)
    left = np.repeat(np.arange(len(a_start)), many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many - low, many)
    return group[: len(a_start)], group[len(a_start) :], left, right


class Aligned:
    """Alignment of many stretches at once, all of which both tokenizers cut alike at the border."""

    def __init__(self, words: list[bytes], codec: Tokenizers):
        ids_a, at_a = codec.first(words)
        ids_b, at_b = codec.second(words)
        data, starts = flat(words)
        size_a, size_b = codec.a_table.size[ids_a], codec.b_table.size[ids_b]
        n = len(words)
        own_a = np.repeat(np.arange(n), np.diff(at_a))
        own_b = np.repeat(np.arange(n), np.diff(at_b))
        #: Stretches that both lists of tokens spell out.
        self.right = _spells(codec.a_table, ids_a, own_a, size_a, data, starts) & _spells(
            codec.b_table, ids_b, own_b, size_b, data, starts
        )
        ids_a, size_a, own_a = (x[self.right[own_a]] for x in (ids_a, size_a, own_a))
        ids_b, size_b, own_b = (x[self.right[own_b]] for x in (ids_b, size_b, own_b))
        a_end, b_end = np.cumsum(size_a), np.cumsum(size_b)
        group_a, group_b, left, right = coalesce(a_end, a_end - size_a, b_end, b_end - size_b)
        self.n_a, self.n_b = np.bincount(own_a, minlength=n), np.bincount(own_b, minlength=n)
        first_of_group = np.flatnonzero(np.diff(group_a, prepend=-1))
        self.n_groups = np.bincount(own_a[first_of_group], minlength=n)
        self.links = ids_a[left].astype(np.int64) << 32 | ids_b[right]
        self.n_links = np.bincount(own_a[left], minlength=n)
        self.groups = _written(codec, ids_a, ids_b, own_a, own_b, group_a, group_b, n)


class AlignedParts:
    """The same of any number of stretches, some thousands at a time."""

    def __init__(self, words: list[bytes], codec: Tokenizers):
        parts = [Aligned(words[k : k + AT_ONCE], codec) for k in range(0, max(len(words), 1), AT_ONCE)]
        self.right, self.n_a, self.n_b, self.n_groups, self.n_links, self.links = (
            np.concatenate([getattr(p, name) for p in parts])
            for name in ("right", "n_a", "n_b", "n_groups", "n_links", "links")
        )
        self.groups = [g for p in parts for g in p.groups]
        self.link_starts = np.append(0, np.cumsum(self.n_links))


def _spells(table: Table, ids, own, size, data, starts) -> np.ndarray:
    """Which stretches the tokens give back byte by byte."""
    n = len(starts) - 1
    total = np.bincount(own, weights=size, minlength=n).astype(np.int64)
    right = total == np.diff(starts)
    spelt = table.spell(ids[right[own]])
    same = spelt == data[gathered(starts, np.flatnonzero(right))[0]]
    wrong = np.repeat(np.flatnonzero(right), np.diff(starts)[right])[~same]
    right[wrong] = False
    return right


def _written(codec, ids_a, ids_b, own_a, own_b, group_a, group_b, n) -> list[bytes]:
    """The groups of each stretch as text: ids by comma, A and B by bar, groups by semicolon."""
    group = np.concatenate([group_a, group_b])
    side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
    order = np.argsort(group * 2 + side, kind="stable")
    group, side, own = group[order], side[order], np.concatenate([own_a, own_b])[order]
    digits = np.concatenate([codec.a_table.digits, codec.b_table.digits])
    starts = np.concatenate([codec.a_table.digit_starts[:-1], codec.b_table.digit_starts + len(codec.a_table.digits)])
    entry = np.concatenate([ids_a, ids_b.astype(np.int64) + len(codec.a_table.size)])[order].astype(np.int64)
    places, before = gathered(starts, entry)
    after = np.full(len(entry), ord(","), np.uint8)
    if len(entry):
        last_of_side = np.append((np.diff(group) != 0) | (np.diff(side) != 0), True)
        after[last_of_side & (side == 0)] = ord("|")
        after[last_of_side & (side == 1)] = ord(";")
    text = np.empty(len(places) + len(entry), np.uint8)
    ends = before[1:] + np.arange(len(entry))
    digit = np.ones(len(text), bool)
    digit[ends] = False
    text[digit], text[ends] = digits[places], after
    size = np.bincount(own, weights=np.diff(before) + 1, minlength=n).astype(np.int64)
    stop = np.cumsum(size)
    whole = text.tobytes()
    # Without the semicolon at the end.
    return [whole[e - s : max(e - 1, 0)] if s else b"" for s, e in zip(size.tolist(), stop.tolist())]


STORED = (
    "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "words array<int>, pairs array<long>, times array<long>, word_pairs array<int>, word_starts array<long>"
)


def _align(first: str, second: str):
    """Rows of documents (with their stretches as numbers), and one row a slice with the pairs of ids
    that are linked in it, how often, and which of them each stretch has."""
    schema = pa.schema(
        [("slice", pa.int64()), ("doc_id", pa.int64())]
        + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
        + [("groups_sha256", pa.string()), ("words", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64()))]
        + [("times", pa.list_(pa.int64())), ("word_pairs", pa.list_(pa.int32())), ("word_starts", pa.list_(pa.int64()))]
    )

    def align(batches):
        codec = tokenizers(public_tokenizers.path(first), public_tokenizers.path(second))
        number = TaskContext.get().partitionId() << 32
        for batch in _gathered(batches, SLICE):
            ids = batch.column("doc_id")
            texts = [b" " + t if t else b"" for t in byte_texts(batch.column("text"))]
            data, starts = flat(texts)
            begin = stretches(data, starts) if codec.parted else starts[:-1][np.diff(starts) > 0]
            words, which = distinct(data, begin, np.append(begin[1:], len(data)))
            found = AlignedParts(words, codec)
            at = np.searchsorted(begin, starts)
            own = np.repeat(np.arange(len(texts)), np.diff(at))
            right = np.bincount(own[~found.right[which]], minlength=len(texts)) == 0
            sums = [
                np.where(right, np.bincount(own, weights=x[which], minlength=len(texts)), 0).astype(np.int64)
                for x in (found.n_a, found.n_b, found.n_groups, found.n_links)
            ]
            right &= np.diff(starts) > 0
            kept = right[own]
            which_list = which.tolist()
            digests = [
                hashlib.sha256(b";".join([found.groups[w] for w in which_list[a:b]])).hexdigest() if ok else ""
                for ok, a, b in zip(right.tolist(), at.tolist(), at[1:].tolist())
            ]
            met = np.bincount(which[kept], minlength=len(words))
            link_word = np.repeat(np.arange(len(words)), found.n_links)
            pairs, slots = np.unique(found.links, return_inverse=True)
            times = np.bincount(slots, weights=met[link_word], minlength=len(pairs)).astype(np.int64)
            per_doc = np.append(0, np.cumsum(np.bincount(own[kept], minlength=len(texts))))
            listed = pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), pa.array(which[kept], pa.int32()))
            nothing = [pa.nulls(len(texts), schema.field(c).type) for c in ("pairs", "times", "word_pairs", "word_starts")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(texts), number)), ids, *map(pa.array, sums), pa.array(digests, pa.string()), listed, *nothing],
                schema=schema,
            )
            one = {
                "slice": number,
                "pairs": pairs,
                "times": times,
                "word_pairs": slots.astype(np.int32),
                "word_starts": found.link_starts,
            }
            yield pa.RecordBatch.from_arrays([pa.array([one.get(f.name)], f.type) for f in schema], schema=schema)
            number += 1

    return align


def _gathered(batches, limit: int):
    """Batches of about ``limit`` bytes of text, or one row."""
    held, size = [], 0
    for batch in sliced(batches, limit=limit):
        own = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _tell(stored: pa.Table, answers: pa.Table) -> pa.Table:
    """The rows of the documents of a slice, from the corpus-wide counts of its pairs."""
    about = pc.is_valid(stored.column("word_starts"))
    one = stored.filter(about)
    docs = stored.filter(pc.invert(about)).combine_chunks()
    n_pairs = len(one.column("pairs")[0])
    total, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
    slots = answers.column("slot").to_numpy()
    total[slots], best[slots] = answers.column("total").to_numpy(), answers.column("best").to_numpy()
    pair = np.asarray(one.column("word_pairs")[0].values, np.int64)
    starts = np.asarray(one.column("word_starts")[0].values, np.int64)
    words = docs.column("words").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    word = words.flatten().to_numpy()
    stop = np.cumsum(sizes)
    out = {}
    for name, value in (("n_best", best), ("count_sum", total)):
        each = np.append(0, np.cumsum(value[pair]))
        each = np.append(0, np.cumsum((each[starts[1:]] - each[starts[:-1]])[word]))
        out[name] = pa.array(each[stop] - each[stop - sizes], pa.int64())
    columns = [out[c] if c in out else docs.column(c) for c in (x.split()[0] for x in RESULT.split(", "))]
    return pa.table(columns, names=[x.split()[0] for x in RESULT.split(", ")])


def align_tokens(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of
    ``docs`` (``doc_id, text``): a blank and the text by the tokenizer of file ``first`` (A, which gives
    byte-level tokens) and the text by the model ``second`` (B, which adds the blank).

    A text that is null or empty, or that one of the two cannot give back byte by byte, has no tokens: zeros
    and an empty digest. Repeated rows and rows without doc_id count like others; columns other than the
    two are left alone; an empty table gives an empty one.

    A slice of texts is cut at blanks where both tokenizers start anew; its different stretches are
    aligned, all at once, by sorted intervals. A slice sends each of its id pairs once, with a number
    of links; the sums over all slices come back to it, where they are added up for each document. So
    a pair that is everywhere is one row a slice, and nothing is broadcast.
    """
    stored = written(need(docs, "doc_id", "text").mapInArrow(_align(first, second), STORED), "aligned")
    pairs = stored.where(F.col("word_starts").isNotNull()).select(
        "slice", F.posexplode(F.arrays_zip("pairs", "times")).alias("slot", "x")
    ).select("slice", "slot", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    totals = pairs.groupBy("pair").agg(F.sum("times").alias("total"))
    right = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    totals = totals.withColumn("right", right)
    highest = totals.groupBy("right").agg(F.max("total").alias("highest"))
    totals = totals.join(highest, "right").select(
        "pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best")
    )
    answers = pairs.select("slice", "slot", "pair").join(totals, "pair").select(
        F.col("slice").alias("of"), "slot", "total", "best"
    )
    return (
        stored.groupBy("slice")
        .cogroup(answers.groupBy("of"))
        .applyInArrow(_tell, RESULT)
    )
