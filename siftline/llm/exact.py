"""Exact deduplication by Grace hashing: records go to spill files by hash, recursively, until each
bucket fits an open-addressing table that compares whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import byte_texts, need, shuffle_partitions, sliced, written

# Bytes of different texts that one table holds, and bytes of text whose copies are counted as one
# record before anything moves.
BUCKET_BYTES = 64 << 20
SLICE = 16 << 20
RECORD_BYTES = 100
# A crowded text is not dealt over more buckets than leave each so many copies.
LEAST_COPIES = 8


class Table:
    """Open addressing over whole texts: a slot holds the place of a text; a probe that meets another
    text goes on to the next slot, even if the hashes are equal."""

    def __init__(self, room: int):
        self.room, self.used = room, 0
        self.texts: list[bytes] = []
        self.hashes: list[int] = []
        self.mask = 1023
        self.slots = [-1] * (self.mask + 1)

    def place(self, hash_: int, text: bytes) -> int:
        """Where ``text`` stands among the different texts; -1 if it is new and there is no room.

        An empty table takes a text of any length.
        """
        slot = hash_ & self.mask
        while (k := self.slots[slot]) >= 0:
            if self.hashes[k] == hash_ and self.texts[k] == text:
                return k
            slot = (slot + 1) & self.mask
        if self.texts and self.used + len(text) + RECORD_BYTES > self.room:
            return -1
        self.slots[slot] = len(self.texts)
        self.texts.append(text)
        self.hashes.append(hash_)
        self.used += len(text) + RECORD_BYTES
        if 2 * len(self.texts) > self.mask:
            self._grow()
        return len(self.texts) - 1

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for k, hash_ in enumerate(self.hashes):
            slot = hash_ & self.mask
            while self.slots[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.slots[slot] = k


RECORDS = pa.schema(
    [("key", pa.int64()), ("sha", pa.binary()), ("size", pa.int64()), ("text", pa.binary()), ("ids", pa.list_(pa.int64()))]
)


def _condense(slice_bytes: int):
    """One record for the equal texts of a slice: text, hash, and the ids of its rows."""

    def condense(batches):
        for batch in sliced(batches, limit=slice_bytes):
            texts, ids = byte_texts(batch.column("text")), batch.column("doc_id").to_pylist()
            table, own = Table(1 << 62), []
            for text, doc_id in zip(texts, ids):
                k = table.place(hash(text) & (1 << 62) - 1, text)
                if k == len(own):
                    own.append([])
                own[k].append(doc_id)
            digests = [hashlib.sha256(t).digest() for t in table.texts]
            keys = np.frombuffer(b"".join(d[:8] for d in digests), "<i8")
            sizes = [len(t) + RECORD_BYTES for t in table.texts]
            columns = (keys, digests, sizes, table.texts, own)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, RECORDS)], schema=RECORDS)

    return condense


def _match(room: int):
    """Equal texts of a bucket, as they stream by: each record's ``root`` (the first record of its text),
    or null for those that the table has no room for."""

    def match(batches):
        table, roots = Table(room), []
        for batch in batches:
            found = []
            for record, key, text in zip(*(batch.column(c).to_pylist() for c in ("record", "key", "text"))):
                k = table.place(key & (1 << 62) - 1, text)
                if k == len(roots):
                    roots.append(record)
                found.append(roots[k] if k >= 0 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("record"), pa.array(found, pa.int64())], names=["record", "root"]
            )

    return match


def _roots(records: DataFrame, bucket_bytes: int, level: int = 0) -> DataFrame:
    """``record, root`` for every record, equal texts under one root.

    A level deals the records to buckets by their hash and the level. Copies of one text that are more
    than a bucket are dealt over several, whose roots meet again on the next level, as do records for
    which a table had no room. Every level ends at least one text of each bucket.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    buckets = max(shuffle_partitions(records.sparkSession), -(-2 * total // bucket_bytes))
    crowded = (
        records.groupBy("key", "sha").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .withColumn("parts", F.expr(f"cast(least(bytes div {bucket_bytes} + 1, n div {LEAST_COPIES}) as int)"))
        .where("parts > 1")
        .select("key", "sha", "parts")
    )
    crowded = written(crowded, "crowded")
    dealt = records.select("record", "key", "sha", "text")
    split = not crowded.isEmpty()
    if split:
        dealt = dealt.join(crowded, ["key", "sha"], "left").withColumn(
            "salt", F.pmod(F.xxhash64("record", F.lit(level)), F.coalesce("parts", F.lit(1)))
        )
    else:
        dealt = dealt.withColumns({"salt": F.lit(0), "parts": F.lit(None).cast("int")})
    bucket = F.pmod(F.xxhash64("key", "salt", F.lit(level)), F.lit(buckets)).cast("int")
    found = dealt.select("record", "key", "text", bucket.alias("bucket")).repartitionById(buckets, "bucket")
    found = written(found.mapInArrow(_match(bucket_bytes), "record long, root long"), "roots")
    again = found.where("root is null").select("record")
    if split:
        heads = found.where("root = record").join(
            dealt.where("parts is not null").select("record"), "record", "left_semi"
        ).select("record")
        again = again.unionAll(heads)
    again = written(again, "again")
    if again.isEmpty():
        return found
    rest = records.join(again, "record", "left_semi").select("record", "key", "sha", "size", "text")
    upper = _roots(rest, bucket_bytes, level + 1).select(F.col("record").alias("root"), F.col("root").alias("upper"))
    return written(
        found.withColumn("root", F.coalesce("root", "record"))
        .join(upper, "root", "left")
        .select("record", F.coalesce("upper", "root").alias("root")),
        "roots",
    )


def exact_duplicates(
    docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, slice_bytes: int = SLICE
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` (``doc_id, text``).

    Texts are equal when all their bytes are; null is the empty text. Of equal texts the row with the
    largest doc_id is kept, rows without doc_id last; of several rows of that id one is. Every row stays,
    dropped ones too, ``kept`` tells; other columns are left alone; an empty table gives an empty one.

    Copies within a slice of texts become one record, which is written as a spill file. Records go to
    buckets by hash; a bucket's table compares whole texts and sends on what it has no room for
    (see ``_roots``). A text that a third of all rows have is one record a slice, and if these are
    still more than a bucket, several buckets. Ids never move with the texts.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    condensed = need(docs, "doc_id", "text").select("doc_id", text).mapInArrow(
        _condense(slice_bytes), "key long, sha binary, size long, text binary, ids array<long>"
    )
    records = written(condensed.withColumn("record", F.monotonically_increasing_id()), "records")
    roots = _roots(records, bucket_bytes)
    ids = records.select("record", "sha", "ids", F.array_max("ids").alias("best")).join(roots, "record")
    # The keeper: the largest id, null before all; of equal ones the record with the smallest number.
    groups = ids.groupBy("root").agg(
        F.sum(F.size("ids").cast("long")).alias("group_size"),
        F.max(F.struct("best", (-F.col("record")).alias("last"))).alias("top"),
    )
    told = ids.join(groups, "root").select(
        F.posexplode("ids").alias("at", "doc_id"),
        F.array_position("ids", F.col("best")).alias("first"),
        F.col("top.best").alias("keep_id"),
        "group_size",
        (F.col("top.last") == -F.col("record")).alias("keeper"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    place = F.coalesce(F.col("first"), F.lit(1)) - 1
    return told.select(
        "doc_id", "keep_id", "group_size", (F.col("keeper") & (F.col("at") == place)).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Rows are told apart by id and text; of rows equal in both, one stays, whichever.
    """
    kept = exact_duplicates(docs, bucket_bytes).where("kept").select(
        F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_sha")
    )
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("row.text").cast("binary"), F.lit(b"")), 256))
    one = whole.groupBy(F.col("row.doc_id").alias("kept_id"), digest.alias("kept_sha")).agg(F.first("row").alias("row"))
    same = one["kept_id"].eqNullSafe(kept["kept_id"]) & (one["kept_sha"] == kept["kept_sha"])
    return one.join(kept, same, "left_semi").select("row.*")
