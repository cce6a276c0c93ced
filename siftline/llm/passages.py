"""Removal of repeated passages by fixed-block anchors."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import (
    byte_texts, flat, mix, need, rolling, shuffle_partitions, word_bounds, word_hashes,
)

WINDOW = 13
SHARD_BYTES = 4 << 20
PARTITION_BYTES = 32 << 20
BUCKET_ENTRIES = 2_000_000
ANCHOR_BITS = 44
KEY_BITS = 60
PIECE_BYTES = 1 << 20
ANCHOR_STEP = np.uint64(0x9FB21C651E98DF25)
KEY_STEP = np.uint64(0xA0761D6478BD642F)
CHECK_STEP = np.uint64(0xE7037ED1A0B428DB)


def block_size(window: int) -> int:
    """Words of an anchor: the largest block of which every window holds a whole aligned one."""
    return (window + 1) // 2


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences, one byte plane after the other."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(planes[:, :width].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def low_bytes(values: np.ndarray) -> bytes:
    """Any 64-bit numbers, as byte planes; the empty high ones compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_low_bytes(data: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Shard:
    """The words of some documents as hashes: where each document's words start, and its anchors."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.block = window, block_size(window)
        parts, counts = [], []
        for a, b in _pieces(texts):
            data, starts = flat(texts[a:b])
            first, end = word_bounds(data, starts)
            counts.append(np.diff(np.searchsorted(first, starts)))
            parts.append(word_hashes(data, first, end))
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, document) of every run of ``width`` words inside one document."""
        room = np.maximum(np.diff(self.starts) - width + 1, 0)
        doc = np.repeat(np.arange(len(room)), room)
        before = np.cumsum(room) - room
        return np.arange(room.sum()) - np.repeat(before - self.starts[:-1], room), doc

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place, document, hash and "is an indexed block" of every run of block length."""
        place, doc = self.runs(self.block)
        value = rolling(self.words, self.block, ANCHOR_STEP) >> np.uint64(64 - ANCHOR_BITS)
        indexed = (place - self.starts[doc]) % self.block == 0
        return place, doc, value[place], indexed

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place, document, key and check of every window that holds a shared anchor."""
        place, _, value, _ = self.anchors()
        hit = np.zeros(len(self.words) + 1, np.int32)
        hit[place] = _isin(value, shared)
        before = np.concatenate([[0], np.cumsum(hit)])
        place, doc = self.runs(self.window)
        reach = self.window - self.block + 1
        near = before[place + reach] > before[place]
        place, doc = place[near], doc[near]
        key = rolling(self.words, self.window, KEY_STEP) >> np.uint64(64 - KEY_BITS)
        check = rolling(self.words, self.window, CHECK_STEP) >> np.uint64(32)
        return place, doc, key[place], check[place]


def _pieces(texts: list[bytes]):
    a = size = 0
    for b, text in enumerate(texts):
        size += len(text)
        if size >= PIECE_BYTES:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _isin(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(found, values), len(found) - 1)
    return found[at] == values


def _shard(table: pa.Table, window: int) -> Shard:
    texts: list[bytes] = []
    for chunk in table.column("text").chunks:
        texts += byte_texts(chunk)
    return Shard(texts, window)


def _by_bucket(bucket: np.ndarray):
    """(bucket, from, to) of the runs of equal, ascending bucket numbers."""
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(bucket[a]), a, b


def _buckets(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Equal ranges of the hash space, numbered upwards. (The product stays below 2**64.)"""
    high = values >> np.uint64(max(0, bits - 36))
    return ((high * np.uint64(buckets)) >> np.uint64(min(36, bits))).astype(np.int32)


def _ids(table: pa.Table) -> np.ndarray:
    """Ids as int64; a missing id is less than none and greater than none, see ``missing``."""
    return table.column("doc_id").combine_chunks().fill_null(0).to_numpy()


def repeated_passages(
    docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` for every row of ``docs`` (``doc_id, text``).

    A word is removed if a window of ``window`` words over it also starts in a document of smaller
    doc_id; ``kept`` is the rest, one space between words. Documents of equal doc_id do not
    remove each other's words. A null text is empty; a row without doc_id neither loses words nor
    makes others lose any. Rows shorter than a window stay whole. An empty table gives an empty one.

    Documents are dealt into shards of about ``shard_bytes`` by the hash of their row. Each shard
    gives the different hashes of its rolling blocks, packed by range, and says which of them are
    aligned blocks (the index). A range returns to a shard those that are indexed anywhere and
    occur in two documents. Around these anchors the shard takes every whole window, asks in
    the same way for the least document of each, and joins hit windows to the longest repeats.
    A passage of any number of documents gives one entry a shard.
    """
    spark = docs.sparkSession
    docs = need(docs, "doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    shards = max(1, -(-size // shard_bytes))
    buckets = max(shuffle_partitions(spark), -(-size // (6 * BUCKET_ENTRIES)))
    # Partitions follow the texts, so that none outgrows a task where the session names too few.
    parts = max(shuffle_partitions(spark), -(-size // PARTITION_BYTES))
    dealt = docs.withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))
    ).repartition(parts, "shard")

    def anchor_lists(table: pa.Table) -> pa.Table:
        """What a shard asks: (hash, occurs in two documents, is indexed), ascending, by range."""
        shard = table.column("shard")[0].as_py()
        _, doc, value, indexed = _shard(table, window).anchors()
        order = np.argsort(value, kind="stable")
        value, doc, indexed = value[order], doc[order], indexed[order]
        head = np.flatnonzero(np.diff(value, prepend=value[:1] + np.uint64(1)) != 0)
        if not len(head):
            return pa.table({"bucket": pa.array([], pa.int32()), "shard": pa.array([], pa.int64()), "list": pa.array([], pa.binary())})
        ids = _ids(table)[doc]
        many = np.maximum.reduceat(ids, head) != np.minimum.reduceat(ids, head)
        many |= np.maximum.reduceat(doc, head) != np.minimum.reduceat(doc, head)
        kept = np.maximum.reduceat(indexed, head)
        value = value[head]
        coded = (value << np.uint64(2)) | (many.astype(np.uint64) << np.uint64(1)) | kept.astype(np.uint64)
        rows = list(_by_bucket(_buckets(value, ANCHOR_BITS, buckets)))
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int32()),
            "shard": pa.array([shard] * len(rows), pa.int64()),
            "list": pa.array([pack(coded[a:b]) for _, a, b in rows], pa.binary()),
        })

    def shared_anchors(table: pa.Table) -> pa.Table:
        """Which hashes of a range are indexed by one shard or more and occur in two documents."""
        lists = [unpack(x) for x in table.column("list").to_pylist()]
        owner = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
        coded = np.concatenate(lists)
        order = np.argsort(coded >> np.uint64(2), kind="stable")
        coded, owner = coded[order], owner[order]
        value = coded >> np.uint64(2)
        head = np.flatnonzero(np.diff(value, prepend=value[:1] + np.uint64(1)) != 0)
        size = np.diff(np.append(head, len(value)))
        many = np.bitwise_or.reduceat((coded >> np.uint64(1)) & np.uint64(1), head) > 0
        kept = np.bitwise_or.reduceat(coded & np.uint64(1), head) > 0
        shared = np.repeat(kept & (many | (size > 1)), size)
        value, owner = value[shared], owner[shared]
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
        names = table.column("shard").to_numpy()
        rows = list(_by_bucket(owner))
        return pa.table({
            "shard": pa.array([int(names[o]) for o, _, _ in rows], pa.int64()),
            "list": pa.array([pack(value[a:b]) for _, a, b in rows], pa.binary()),
        })

    def window_lists(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        """The windows of a shard that hold a shared anchor, each once, with its least document."""
        empty = {"bucket": pa.int32(), "shard": pa.int64(), "keys": pa.binary(), "checks": pa.binary(), "lows": pa.binary(), "many": pa.binary()}
        if not table.num_rows or not answers.num_rows:
            return pa.table({k: pa.array([], v) for k, v in empty.items()})
        shared = np.sort(np.concatenate([unpack(x) for x in answers.column("list").to_pylist()]))
        place, doc, value, check = _shard(table, window).windows(shared)
        real = table.column("doc_id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)[doc]
        ids, value, check = _ids(table)[doc][real], value[real], check[real]
        if not len(value):
            return pa.table({k: pa.array([], v) for k, v in empty.items()})
        value, check, low, many = _least(value, check, ids, np.zeros(len(ids), bool))
        rows = list(_by_bucket(_buckets(value, KEY_BITS, buckets)))
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int32()),
            "shard": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "keys": pa.array([pack(value[a:b]) for _, a, b in rows], pa.binary()),
            "checks": pa.array([check[a:b].astype("<u4").tobytes() for _, a, b in rows], pa.binary()),
            "lows": pa.array([low_bytes(low[a:b]) for _, a, b in rows], pa.binary()),
            "many": pa.array([np.packbits(many[a:b]).tobytes() for _, a, b in rows], pa.binary()),
        })

    def least_documents(table: pa.Table) -> pa.Table:
        """To each shard: its windows that more than one document has, with the least of all."""
        keys = [unpack(x) for x in table.column("keys").to_pylist()]
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(x) for x in keys])
        checks = np.frombuffer(b"".join(table.column("checks").to_pylist()), "<u4").astype(np.uint64)
        lows = np.concatenate([from_low_bytes(x) for x in table.column("lows").to_pylist()])
        many = np.concatenate([
            np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool)
            for x, k in zip(table.column("many").to_pylist(), keys)
        ])
        value = np.concatenate(keys)
        order = np.lexsort((checks, value))
        value, checks, owner, lows, many = (x[order] for x in (value, checks, owner, lows, many))
        head = np.flatnonzero(_changes(value, checks))
        size = np.diff(np.append(head, len(value)))
        low = np.repeat(np.minimum.reduceat(lows, head), size)
        told = np.repeat(np.maximum.reduceat(many, head) | (size > 1), size)
        value, checks, low, owner = value[told], checks[told], low[told], owner[told]
        order = np.argsort(owner, kind="stable")
        value, checks, low, owner = (x[order] for x in (value, checks, low, owner))
        names, rows = table.column("shard").to_numpy(), list(_by_bucket(owner))
        return pa.table({
            "shard": pa.array([int(names[o]) for o, _, _ in rows], pa.int64()),
            "keys": pa.array([pack(value[a:b]) for _, a, b in rows], pa.binary()),
            "checks": pa.array([checks[a:b].astype("<u4").tobytes() for _, a, b in rows], pa.binary()),
            "lows": pa.array([low_bytes(low[a:b]) for _, a, b in rows], pa.binary()),
        })

    def removal(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Each document without the words of windows that an earlier document has."""
        texts: list[bytes] = []
        for chunk in table.column("text").chunks:
            texts += byte_texts(chunk)
        drop = _drops(texts, table, answers, window) if table.num_rows and answers.num_rows else None
        at, rows = 0, []
        for text in texts:
            words = text.split()
            n, gone = len(words), 0
            if drop is not None:
                mine = drop[at : at + n]
                if gone := int(mine.sum()):
                    words = list(compress(words, (~mine).tolist()))
            at += n
            kept = b" ".join(words)
            rows.append((n, gone, hashlib.sha256(kept).hexdigest(), kept))
        n, gone, sha, kept = zip(*rows) if rows else ((), (), (), ())
        return pa.table({
            "doc_id": table.column("doc_id"),
            "n_words": pa.array(n, pa.int64()),
            "n_removed": pa.array(gone, pa.int64()),
            "kept_sha256": pa.array(sha, pa.string()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    asked = dealt.groupBy("shard").applyInArrow(anchor_lists, "bucket int, shard long, list binary")
    anchors = asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(shared_anchors, "shard long, list binary")
    windows = dealt.groupBy("shard").cogroup(anchors.groupBy("shard")).applyInArrow(
        window_lists, "bucket int, shard long, keys binary, checks binary, lows binary, many binary"
    )
    lows = windows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(
        least_documents, "shard long, keys binary, checks binary, lows binary"
    )
    return dealt.groupBy("shard").cogroup(lows.groupBy("shard")).applyInArrow(
        removal, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )


def _changes(value: np.ndarray, check: np.ndarray) -> np.ndarray:
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (check[1:] != check[:-1])
    return new


def _least(value, check, ids, many):
    """Each (value, check) once, ascending, with its least id and whether ids differ."""
    order = np.lexsort((check, value))
    value, check, ids, many = value[order], check[order], ids[order], many[order]
    head = np.flatnonzero(_changes(value, check))
    low, high = np.minimum.reduceat(ids, head), np.maximum.reduceat(ids, head)
    return value[head], check[head], low, np.maximum.reduceat(many, head) | (low != high)


def _drops(texts: list[bytes], table: pa.Table, answers: pa.Table, window: int) -> np.ndarray:
    """For every word of the shard: is it in a window that a smaller document has?"""
    keys = np.concatenate([unpack(x) for x in answers.column("keys").to_pylist()])
    checks = np.frombuffer(b"".join(answers.column("checks").to_pylist()), "<u4").astype(np.uint64)
    lows = np.concatenate([from_low_bytes(x) for x in answers.column("lows").to_pylist()])
    order = np.lexsort((checks, keys))
    # One number for key and check: windows are looked up by both.
    name = mix(keys[order]) + checks[order]
    order = order[np.argsort(name)]
    name, lows = np.sort(name), lows[order]
    shard = Shard(texts, window)
    place, doc = shard.runs(window)
    key = rolling(shard.words, window, KEY_STEP) >> np.uint64(64 - KEY_BITS)
    check = rolling(shard.words, window, CHECK_STEP) >> np.uint64(32)
    mine = mix(key[place]) + check[place]
    at = np.minimum(np.searchsorted(name, mine), len(name) - 1)
    ids = table.column("doc_id").combine_chunks()
    real = ids.is_valid().to_numpy(zero_copy_only=False)[doc]
    gone = (name[at] == mine) & real & (lows[at] < _ids(table)[doc])
    cover = np.zeros(len(shard.words) + 1, np.int32)
    np.add.at(cover, place[gone], 1)
    np.add.at(cover, place[gone] + window, -1)
    return np.cumsum(cover)[:-1] > 0
