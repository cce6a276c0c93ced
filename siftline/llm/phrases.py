"""Phrases that stand together more often than their parts make likely, counted in burst tries of
word numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import (
    GOLDEN,
    byte_texts,
    flat,
    mix,
    need,
    shuffle_partitions,
    sliced,
    word_hashes,
    written,
)
from siftline.llm.known import distinct, gathered

LONGEST = 3
LEAST = 10
COVERED = 50
TOP = 2000
NO_LANG = "und"
# Phrases that a task holds, entries of a container before it bursts, and bytes of text to a partition.
HELD = 1_000_000
BURST = 1 << 17
PART_BYTES = 8 << 20
MERGE_BYTES = 32 << 20
DIGIT = 7
# Bytes of text that are counted at once, and phrases that are written out at once.
SLICE = 4 << 20
AT_ONCE = 100_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
NEWLINE = 10
GAP = BREAK.copy()
GAP[[9, 32]] = True


class Container:
    """A hash table from phrases to counts: open addressing, many phrases at a time."""

    def __init__(self, size: int = 256):
        self.keys, self.counts, self.n = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Count the phrases, which differ from each other."""
        size = len(self.keys)
        while 2 * (self.n + len(keys)) > size:
            size *= 2
        if size > len(self.keys):
            old = self.entries()
            self.__init__(size)
            self._put(*old)
        self._put(keys, counts)

    def _put(self, keys, counts) -> None:
        last = np.uint64(len(self.keys) - 1)
        slot = (mix(keys.astype(np.uint64)) & last).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several that want a slot, one gets it
            mine = self.keys[slot] == keys
            self.n += int(np.count_nonzero(mine & free))
            self.counts[slot[mine]] += counts[mine]
            keys, counts = keys[~mine], counts[~mine]
            slot = slot[~mine] + 1 & np.int64(last)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.keys >= 0
        return self.keys[used], self.counts[used]


class Trie:
    """Counts of phrases of word numbers, packed into one number with the first word highest.

    A node parts its phrases by the next digit of their words; where it has no child yet, a
    container holds them, until it bursts into a node with containers of its own. Only the words
    before the last one make nodes, so the trie stays shallow, and phrases of a subtree share their first word(s).
    """

    def __init__(self, bits: int, longest: int):
        self.low = bits
        self.root = Node(bits * longest - DIGIT)
        self.n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Count the phrases, sorted and different."""
        self.n += self.root.add(keys, counts, self.low)

    def spill(self, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Take whole subtrees out, the largest first, until ``least`` phrases have gone."""
        runs = []
        kids = sorted(self.root.kids.items(), key=lambda x: -x[1].n)
        for digit, kid in kids:
            if least <= 0:
                break
            runs.append(kid.entries())
            del self.root.kids[digit]
            self.n -= kid.n
            least -= kid.n
        return runs


class Node:
    def __init__(self, shift: int):
        self.shift, self.kids, self.n = shift, {}, 0

    def add(self, keys, counts, low) -> int:
        digit = keys >> np.int64(self.shift) & np.int64((1 << DIGIT) - 1)
        cuts = np.flatnonzero(np.diff(digit)) + 1
        before = self.n
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(keys)).tolist()):
            d = int(digit[a])
            kid = self.kids.get(d) or self.kids.setdefault(d, Container())
            had = kid.n
            if isinstance(kid, Node):
                kid.add(keys[a:b], counts[a:b], low)
            else:
                kid.add(keys[a:b], counts[a:b])
                if kid.n > BURST and self.shift - DIGIT >= low:
                    node = Node(self.shift - DIGIT)
                    held, times = kid.entries()
                    order = np.argsort(held)
                    node.add(held[order], times[order], low)
                    self.kids[d] = kid = node
            self.n += kid.n - had
        return self.n - before

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        found = [kid.entries() for kid in self.kids.values()]
        return np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])


class Counter:
    """Phrases of one language: its words by number, and their trie."""

    def __init__(self, longest: int):
        self.longest = longest
        self.bits = 63 // longest // DIGIT * DIGIT
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.spelt, self.spelt_words = (), -1
        self.bytes = 0
        self.trie = Trie(self.bits, self.longest)

    def count(self, words: list[bytes], which: np.ndarray, piece: np.ndarray) -> None:
        """Count the phrases of 1 to ``longest`` words that lie in one piece. Words count from 1."""
        numbers = self.numbers
        for w in words:
            if w not in numbers:
                self.words.append(w)
                numbers[w] = len(self.words)
                self.bytes += len(w) + 150
        number = np.array([numbers[w] for w in words], np.int64)[which]
        keys, phrase = [], np.zeros(len(number), np.int64)
        for k in range(self.longest):
            n = len(number) - k
            if n <= 0:
                break
            inside = piece[k:] == piece[:n]
            phrase = phrase[:n] | number[k:] << np.int64(self.bits * (self.longest - 1 - k))
            keys.append(phrase[inside])
        found, times = np.unique(np.concatenate(keys), return_counts=True)
        self.trie.add(found, times)

    @property
    def full(self) -> bool:
        """No number is left for one batch more of new words."""
        return len(self.words) + (1 << self.bits) // 4 > (1 << self.bits)

    def _spelt(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all words, each with a blank after it, where they start, their rank and their hash."""
        if len(self.words) != self.spelt_words:
            words = [b"", *self.words]
            data, starts = flat([w + b" " for w in words])
            rank = np.empty(len(words), np.int64)
            rank[pc.sort_indices(pa.array(words, pa.binary())).to_numpy()] = np.arange(len(words))
            codes = word_hashes(data, starts[:-1], starts[1:])
            self.spelt, self.spelt_words = (data, starts, rank, codes), len(self.words)
        return self.spelt

    def run(self, keys: np.ndarray, counts: np.ndarray, parts: int):
        """A sorted run cut by prefix partition, of the first two words: (partition, phrases one a line,
        counts). Phrases are in the order of their words."""
        data, starts, rank, codes = self._spelt()
        shifts = [np.int64(self.bits * (self.longest - 1 - k)) for k in range(self.longest)]
        last = np.int64((1 << self.bits) - 1)
        order = np.zeros(len(keys), np.int64)
        for k in shifts:
            order |= rank[keys >> k & last] << k
        order = np.argsort(order)
        keys, counts = keys[order], counts[order]
        prefix = codes[keys >> shifts[0] & last] * GOLDEN + codes[keys >> shifts[1] & last]
        part = (mix(prefix) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        part, keys, counts = part[order], keys[order], counts[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        cuts = np.union1d(cuts, np.arange(0, len(keys), AT_ONCE))
        for a in range(0, len(keys), AT_ONCE):
            some = keys[a : a + AT_ONCE]
            number = np.stack([some >> k & last for k in shifts], 1)
            used = number > 0
            places, before = gathered(starts, number[used])
            text = data[places]
            stop = before[np.cumsum(used.sum(1))]
            text[stop - 1] = NEWLINE
            stop, text = np.append(0, stop), text.tobytes()
            own = cuts[(cuts >= a) & (cuts < a + len(some))].tolist()
            for x, y in zip(own, [*own[1:], a + len(some)]):
                yield int(part[x]), text[stop[x - a] : stop[y - a]], counts[x:y]


RUNS = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.list_(pa.int64()))])


def _count(longest: int, parts: int, held: int):
    """Sorted runs of counted phrases from each task."""

    def count(batches):
        counters: dict[str, Counter] = {}

        def rows(lang, keys, counts):
            if not len(keys):
                return
            made = list(zip(*counters[lang].run(keys, counts, parts)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[0], pa.int32()), pa.array([lang] * len(made[0])), pa.array(made[1], pa.binary()), pa.array(made[2], pa.list_(pa.int64()))],
                schema=RUNS,
            )

        def spilt(least):
            """Subtrees of the largest tries, until ``least`` phrases have gone."""
            for lang in sorted(counters, key=lambda x: -counters[x].trie.n):
                if least <= 0:
                    break
                had = counters[lang].trie.n
                for keys, counts in counters[lang].trie.spill(least):
                    yield from rows(lang, keys, counts)
                least -= had - counters[lang].trie.n

        for batch in sliced(batches, limit=SLICE):
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                own = batch.filter(pc.equal(langs, lang))
                data, starts = flat(byte_texts(own.column("text")))
                data = LOWER[data]
                first, end, piece = word_pieces(data, starts)
                if not len(first):
                    continue
                counter = counters.setdefault(lang, Counter(longest))
                words, which = distinct(data, first, end)
                if len(counter.words) + len(words) >= (1 << counter.bits):
                    for keys, counts in counter.trie.spill(1 << 62):
                        yield from rows(lang, keys, counts)
                    counter.clear()
                counter.count(words, which, piece)
            total = sum(c.trie.n for c in counters.values())
            if total > held:
                yield from spilt(total - held // 2)
            if sum(c.bytes for c in counters.values()) > 32 * held:
                yield from spilt(1 << 62)
                counters.clear()
        yield from spilt(1 << 62)

    return count


def word_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the number of the piece of text that it is in."""
    inside = ~GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    piece = np.cumsum(BREAK[data] | edge[:-1])
    return first, end, piece[first]


def _lines(text: bytes) -> pa.Array:
    """The lines of ``text``, all of which end with a line end."""
    data = np.frombuffer(text, np.uint8)
    end = np.flatnonzero(data == NEWLINE)
    offsets = np.append(0, end + 1 - np.arange(1, len(end) + 1))
    data = np.ascontiguousarray(data[data != NEWLINE])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(end), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


def _merge(least: int, limit: int):
    """The runs of a partition merged: phrases with ``least`` or more, and each language's words in
    all (as the phrase of no words)."""

    def merge(batches):
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        size = {}
        total: dict[str, int] = {}

        def merged(lang):
            phrases = pa.concat_arrays([p for p, _ in held[lang]])
            order = pc.sort_indices(phrases)
            phrases = phrases.take(order)
            counts = np.concatenate([c for _, c in held[lang]])[order.to_numpy()]
            first = np.ones(len(phrases), bool)
            first[1:] = pc.not_equal(phrases[1:], phrases[:-1]).to_numpy(zero_copy_only=False)
            return phrases.filter(pa.array(first)), np.add.reduceat(counts, np.flatnonzero(first))

        for batch in batches:
            for lang, phrases, counts in zip(
                batch.column("lang").to_pylist(), batch.column("phrases").to_pylist(), batch.column("counts")
            ):
                counts = counts.values.to_numpy()
                lines = _lines(phrases)
                held.setdefault(lang, []).append((lines, counts))
                size[lang] = size.get(lang, 0) + len(phrases) + 16 * len(counts)
                if size[lang] > limit:
                    held[lang] = [merged(lang)]
                    # At least as much again before the next time.
                    size[lang] = min(size[lang], held[lang][0][0].nbytes) - limit // 2
        for lang in held:
            phrases, f = merged(lang)
            words = pc.count_substring(phrases.cast(pa.large_string()), " ").to_numpy() + 1
            total[lang] = int(f[words == 1].sum())
            often = f >= least
            n = int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (n + 1)),
                    pa.array(phrases.filter(pa.array(often)).to_pylist() + [b""], pa.binary()).cast(pa.string()),
                    pa.array(np.append(words[often], 0), pa.int32()),
                    pa.array(np.append(f[often], total[lang]), pa.int64()),
                ],
                names=["lang", "phrase", "size", "f"],
            )

    return merge


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, held: int = HELD) -> DataFrame:
    """``lang, phrase, size, f``: phrases of 1 to ``longest`` words that occur ``least`` times or more, and
    rows of size 0, whose ``f`` add up to all words of the language.

    Each task counts in a trie and sends sorted runs, whole subtrees at a time; the runs of a prefix
    partition (a language, and the first two words) are merged.
    """
    table = need(docs, "text", "lang").select("text", F.coalesce("lang", F.lit(NO_LANG)).alias("lang"))
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-size // PART_BYTES))
    runs = table.mapInArrow(_count(longest, parts, held), "part int, lang string, phrases binary, counts array<long>")
    return runs.repartitionById(parts, F.col("part")).mapInArrow(
        _merge(least, MERGE_BYTES), "lang string, phrase string, size int, f long"
    )


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    covered: int = COVERED,
    top: int = TOP,
    held: int = HELD,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language of ``docs``
    (``text, lang``).

    ASCII letters are lower-cased, texts cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    blanks and tabs. A phrase of 2 to ``longest`` words that occurs ``a`` times, ``least`` or more, is cut in
    two parts, which occur ``l`` and ``r`` times: 1,000,000 a a / (l r), rounded down, is its
    score, by the cut that gives the lowest, the first one of ties. A phrase is left out if a longer one that
    holds it has ``covered`` hundredths of its occurrences. ``n`` counts the words of the language.
    Ties in rank go to the larger ``a``, then to the phrase that comes first by its bytes.

    Null texts and texts without words count nothing, a null language is ``und``; repeated rows count
    each; other columns are left alone; an empty table gives an empty one.
    """
    counts = written(phrase_counts(docs, longest, least, held), "phrases")
    spoken = counts.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    often = counts.where("size > 0").select("lang", "phrase", "size", "f")
    words = F.split("phrase", " ")
    candidates = often.where("size > 1").withColumn("words", words)

    def part(a, n):
        return F.array_join(F.slice("words", a, n), " ")

    cuts = candidates.select(
        "lang", "phrase", "words", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"),
        part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    known = often.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000000) div (cast(l as decimal(19,0)) * r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    covers = candidates.where("size > 2").select(
        "lang", "words", "size", "f", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")
    )
    covers = covers.select(
        "lang", "words", "f", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at")
    ).select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "f")
    covers = covers.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(covers, ["lang", "phrase"], "left").where(
        f"longer is null or 100 * longer < {covered} * a"
    )
    flat_ = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salts = shuffle_partitions(docs.sparkSession)
    salted = flat_.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order)))
    first = first.where(f"rank <= {top}").drop("rank", "salt")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(f"rank <= {top}").join(spoken, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
