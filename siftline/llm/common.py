"""Helpers shared by the operators: batches, words, hashes, written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources.store import materialize, shared_dir

SLICE_BYTES = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def sliced(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text starts (one more entry than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), np.uint8), starts


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEP = np.uint64(0xD6E8FEB86659FD93)
NEAR = 64


def placed(place: np.ndarray) -> np.ndarray:
    """A 64-bit code of a byte at a place, numbered ``256 * place + byte``."""
    return mix((place.astype(np.uint64) + np.uint64(1)) * GOLDEN)


PLACED = placed(np.arange(256 * NEAR))


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word (run of bytes that are no space), and its end. Words end with
    their text."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    last = np.flatnonzero(inside & (~after | edge[1:]))
    return first, last + 1


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: the sum of its bytes' codes, each of which depends on the byte and its place."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = end - first
    stop = np.cumsum(size)
    within = np.arange(stop[-1]) - np.repeat(stop - size, size)
    place = within * 256 + data[within + np.repeat(first, size)]
    if size.max() <= NEAR:
        value = PLACED[place]
    else:
        far = np.flatnonzero(within >= NEAR)
        value = PLACED[np.minimum(place, len(PLACED) - 1)]
        value[far] = placed(place[far])
    return mix(np.add.reduceat(value, stop - size) + size.astype(np.uint64) * GOLDEN)


def rolling(values: np.ndarray, width: int, step: np.uint64) -> np.ndarray:
    """Hash of every ``width`` consecutive values, whatever text they belong to."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * step + values[j : j + n]
    return mix(out)


def held_out(doc_id: str | Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2


def need(table: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns of any name do no harm."""
    return table.select(*names)


def written(table: DataFrame, name: str) -> DataFrame:
    """The table stored in the shared folder and read back."""
    return materialize(table, name=name)


def cut(table: DataFrame) -> DataFrame:
    """The table with its lineage cut by ``checkpoint()``, in the folder that the session names."""
    context = table.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(table.sparkSession))
    return table.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
