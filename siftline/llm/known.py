"""What a tokenizer says of words, remembered for words met before, within a number of bytes."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

MEMORY_BYTES = 64 << 20
ENTRY_BYTES = 180
LONGEST = 64
AT_ONCE = 50_000


def packed(ids: Iterable[int]) -> bytes:
    """Ids as 32-bit numbers."""
    return array("I", ids).tobytes()


class Known:
    """Ids of words. ``encode`` is asked for those that are not remembered, and gives them packed.

    Two generations: when the younger one is full it becomes the older one, whose words come back
    when they are met again; so frequent words stay, and both together hold ``memory`` bytes
    or so whatever the texts are. Words of more than ``LONGEST`` bytes (texts without blanks) are not kept.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], memory: int = MEMORY_BYTES):
        self.encode, self.room = encode, memory // 2
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.used = 0

    def _keep(self, word: bytes, ids: bytes) -> None:
        if len(word) > LONGEST:
            return
        if self.used > self.room:
            self.old, self.young, self.used = self.young, {}, 0
        self.young[word] = ids
        self.used += len(word) + len(ids) + ENTRY_BYTES

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``words`` in turn, and where those of each start (one more entry)."""
        found = list(map(self.young.get, words))
        new = []
        for k in [k for k, x in enumerate(found) if x is None]:
            found[k] = self.old.get(words[k])
            if found[k] is None:
                new.append(k)
            else:
                self._keep(words[k], found[k])
        for a in range(0, len(new), AT_ONCE):
            part = new[a : a + AT_ONCE]
            for k, ids in zip(part, self.encode([words[k] for k in part])):
                found[k] = ids
                self._keep(words[k], found[k])
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in found], out=starts[1:])
        return np.frombuffer(b"".join(found), np.uint32), starts


def distinct(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different stretches ``data[first:end]``, and which of them each one is."""
    size = end - first
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[first] += 1
    inside[end] -= 1
    kept = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8) > 0])
    array = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]
    ).dictionary_encode()
    return array.dictionary.to_pylist(), array.indices.to_numpy()


def gathered(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of lists ``which`` in turn, where list k is ``starts[k]:starts[k + 1]``; and
    where those of each start (one more entry)."""
    size = (starts[1:] - starts[:-1])[which]
    before = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=before[1:])
    return np.arange(before[-1]) + np.repeat(starts[which] - before[:-1], size), before
