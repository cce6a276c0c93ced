"""SimHash near-duplicates by vantage-point trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from siftline.llm.common import byte_texts, cut, need, sliced, written
from siftline.llm.components import components
from siftline.sources.store import fresh

SEED = 42
WORDS = 3
RADIUS = 3
SHARD_ROWS = 40_000
PART_SHARDS = 4
SAMPLE_ROWS = 20_000
LEAF_ROWS = 256
SHIFT = 1 << 63
INNER_SHARE = 0.2
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, width: int = WORDS) -> int:
    """Bit k is 1 if it is set in over half of the hashes of the text's shingles. No word: 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    rows = zip(*(words[j:] for j in range(width))) if len(words) > width else (words,)
    hashes = b"".join([xxh64_digest(b" ".join(r), SEED) for r in rows])
    bits = np.zeros(64, np.int64)
    n = len(hashes) // 8
    for a in range(0, n, 4096):
        part = np.frombuffer(hashes[8 * a : 8 * (a + 4096)], np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def _fingerprints(batches):
    for batch in sliced(batches):
        prints = [fingerprint(t) - SHIFT for t in byte_texts(batch.column("text"))]
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in others), pa.array(prints, pa.int64())], names=[*others, "print"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print``: the fingerprint less 2**63, so that it orders as a signed long."""
    return need(docs, "doc_id", "text").mapInArrow(_fingerprints, "doc_id long, print long")


def far(prints: np.ndarray, point: int) -> np.ndarray:
    """Differing bits."""
    return np.bitwise_count(prints ^ np.uint64(point))


def _split(prints: np.ndarray, seed: int, share: float = INNER_SHARE) -> tuple[int, int] | None:
    """A vantage point and a distance that puts about ``share`` inside; None if all are alike.

    Of a few candidate points the one whose distances spread most is taken. A small inside ball
    is crossed by fewer queries than a half would be.
    """
    pick = np.random.default_rng(seed).integers(0, len(prints), 8)
    some = prints[:: max(1, len(prints) // 2048)]
    spread = [float(np.var(far(some, prints[i]).astype(np.float64))) for i in pick]
    point = int(prints[pick[int(np.argmax(spread))]])
    d = np.sort(far(prints, point))
    edge = int(d[int(share * (len(d) - 1))])
    if edge == d[-1]:
        edge = int(d[-1]) - 1
    return None if edge < d[0] else (point, edge)


def shard_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (point, edge, inner, outer) of the tree over shards; children below zero are shard
    ``-1 - child``. Grown from a sample, widest shard first; any tree gives exact results."""
    nodes: list[list[int]] = []
    parts: list[tuple[np.ndarray, tuple[int, int] | None]] = [(sample, None)]
    final: list[tuple[int, int] | None] = []
    while parts and len(parts) + len(final) < leaves:
        parts.sort(key=lambda x: len(x[0]))
        part, where = parts.pop()
        cut = _split(part, len(nodes), 0.5) if len(part) >= 64 else None
        if cut is None:
            final.append(where)
            continue
        nodes.append([*cut, 0, 0])
        if where:
            nodes[where[0]][where[1]] = len(nodes) - 1
        inside = far(part, cut[0]) <= cut[1]
        parts += [(part[inside], (len(nodes) - 1, 2)), (part[~inside], (len(nodes) - 1, 3))]
    for k, where in enumerate([*final, *(p[1] for p in parts)]):
        if where:
            nodes[where[0]][where[1]] = -1 - k
    return [tuple(n) for n in nodes]


def _deal(prints: np.ndarray, tree, radius: int):
    """(shard, row, own) of every print in its shard, and of its copies as a query in the shards
    outside of its own ball that the triangle bound cannot rule out.

    A pair whose home shards differ parts at one node, one inside, one outside; the inner one is
    copied outwards, so each pair meets once.
    """
    work = [(0 if tree else -1, np.arange(len(prints)), np.ones(len(prints), bool))]
    while work:
        node, rows, own = work.pop()
        if not len(rows):
            continue
        if node < 0:
            yield -1 - node, rows, own
            continue
        point, edge, inner, outer = tree[node]
        d = far(prints[rows], point).astype(np.int64)
        goes_in = np.where(own, d <= edge, d <= edge + radius)
        copied = own & (d <= edge) & (d > edge - radius)
        goes_out = np.where(own, d > edge, d > edge - radius) | copied
        work.append((inner, rows[goes_in], own[goes_in]))
        work.append((outer, rows[goes_out], (own & ~copied)[goes_out]))


def _link(home, query, radius: int, parent: np.ndarray, prints, among: bool) -> None:
    """Joins in ``parent`` every home row with each query row, and ``among`` themselves with each home
    row, within the radius."""
    work = [(home, query, 0)]
    while work:
        rows, asks, depth = work.pop()
        if not len(rows) or not (among or len(asks)):
            continue
        cut = _split(prints[rows], depth) if len(rows) > LEAF_ROWS else None
        if cut is None:
            _brute(rows, np.concatenate([rows, asks]) if among else asks, radius, parent, prints)
            continue
        point, edge = cut
        d = far(prints[rows], point).astype(np.int64)
        e = far(prints[asks], point).astype(np.int64)
        inside = d <= edge
        near = rows[inside & (d > edge - radius)] if among else rows[:0]
        work.append((rows[inside], asks[e <= edge + radius], depth + 1))
        work.append((rows[~inside], np.concatenate([asks[e > edge - radius], near]), depth + 1))


def _brute(rows: np.ndarray, others: np.ndarray, radius: int, parent: np.ndarray, prints) -> None:
    for a in range(0, len(others), 4096):
        part = others[a : a + 4096]
        for b in range(0, len(rows), 1024):
            mine = rows[b : b + 1024]
            close = np.bitwise_count(prints[part][:, None] ^ prints[mine][None, :]) <= radius
            i, j = np.nonzero(close)
            _join(parent, part[i], mine[j])


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        a, b = _root(parent, a), _root(parent, b)
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        parent[x] = parent[up]
        x = parent[x]


def _unsigned(prints: np.ndarray) -> np.ndarray:
    return prints.astype(np.uint64) ^ np.uint64(SHIFT)


def print_edges(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges ``a, b`` that connect all distinct ``print`` values within the radius, by any path.

    A shard of the tree holds about ``shard_rows`` values; the values on the inner rim of a ball are
    also sent as queries to the shards outside that the bound leaves open. Each shard is searched
    with a tree of its own and gives at most one edge for each of its rows, however many pairs
    a group of near copies has. A shard that very many queries visit is searched in parts, each with
    all of its own values and ``PART_SHARDS * shard_rows`` or so of the queries.
    """
    n = prints.count()
    leaves = max(1, -(-n // shard_rows))
    fraction = min(1.0, SAMPLE_ROWS / max(1, n))
    sample = prints if fraction == 1 else prints.where(
        F.pmod(F.xxhash64("print"), F.lit(1 << 20)) < int(fraction * (1 << 20))
    )
    picked = np.array([r[0] for r in sample.limit(2 * SAMPLE_ROWS).collect()], np.int64)
    tree = shard_tree(np.sort(_unsigned(picked)), leaves) if leaves > 1 else []

    def deal(batches):
        for batch in batches:
            values = batch.column("print").to_numpy()
            for shard, rows, own in _deal(_unsigned(values), tree, radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), shard, np.int32)), pa.array(values[rows]), pa.array(own)],
                    names=["shard", "print", "own"],
                )

    def search(table: pa.Table) -> pa.Table:
        values, own = table.column("print").to_numpy(), table.column("own").to_numpy()
        among = table.column("part")[0].as_py() == 0
        order = np.lexsort((values, ~own))
        values, own = values[order], own[order]
        parent = np.arange(len(values))
        homes = int(own.sum())
        _link(np.arange(homes), np.arange(homes, len(values)), radius, parent, _unsigned(values), among)
        root = _root(parent, np.arange(len(values)))
        hung = np.flatnonzero(root != np.arange(len(values)))
        return pa.table({"a": pa.array(values[hung]), "b": pa.array(values[root[hung]])})

    dealt = prints.mapInArrow(deal, "shard int, print long, own boolean")
    asked = dealt.where("not own").groupBy("shard").count()
    parts = asked.select(F.col("shard").alias("asked"), F.ceil(F.col("count") / (PART_SHARDS * shard_rows)).alias("parts"))
    split = dealt.join(parts, F.col("shard") == F.col("asked"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    mine = F.when(F.col("own"), every).otherwise(F.array(F.pmod(F.xxhash64("print"), F.col("parts"))))
    split = split.select("shard", F.explode(mine).alias("part"), "print", "own")
    return split.groupBy("shard", "part").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id, text``).

    Fingerprints link at ``radius`` or fewer differing bits; the component is the smallest doc_id
    reachable. Texts of no word (null, empty, blank) have fingerprint zero and link like others. Rows
    without doc_id link too, but give no component its id (null if no member has one). Repeated rows
    stay. An empty table gives an empty table; other columns are not read.
    """
    rows = written(fingerprints(docs), "fingerprints")
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("first")).transform(written, "prints")
    linked = cut(components(print_edges(prints.select("print"), radius)))
    groups = linked.join(prints, linked.node == prints.print).select("component", "print", "first")
    lows = groups.groupBy("component").agg(F.min("first").alias("low"))
    named = groups.join(lows, "component").select("print", "low")
    ids = prints.join(named, "print", "left").select(
        "print", F.coalesce("low", "first").alias("component_id")
    ).transform(written, "ids")
    return rows.join(ids, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex(F.col("print").bitwiseXOR(F.lit(-SHIFT))), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each component the row with the smallest doc_id
    stays, once (repeated rows of it too are copies; of different texts of that id in one component the
    one of the smallest hash stays); rows without doc_id stay. A doc_id of several components stays
    once in each where it is the smallest. Columns as given."""
    kept_id, kept_hash, own_hash = fresh(docs, "kept_id", "kept_hash", "hash")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    rows = hashed.mapInArrow(_fingerprints, "doc_id long, hash long, print long")
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "hash"))
    prints = rows.groupBy("print").agg(F.min(known).alias("first")).transform(written, "prints")
    linked = cut(components(print_edges(prints.select("print"), radius)))
    # A component's key is its smallest print, so that an id in several components stays apart.
    kept = (
        prints.join(linked, linked.node == prints.print, "left")
        .groupBy(F.coalesce("component", "print").alias("component"))
        .agg(F.min("first").alias("first"))
        .where("first is not null")
        .select(F.col("first.doc_id").alias(kept_id), F.col("first.hash").alias(kept_hash))
    )
    own = docs.where("doc_id is not null").withColumn(own_hash, F.xxhash64("text"))
    one = own.join(kept, (F.col("doc_id") == F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash)), "left_semi")
    return one.dropDuplicates(["doc_id", own_hash]).drop(own_hash).unionByName(docs.where("doc_id is null"))
