"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import GOLDEN, mix, need, written
from siftline.llm.components import components

COSINE = 0.98
BLOCK = 8
GRID = 3
CELL_ROWS = 4096
SLICE_ROWS = 512
SCALE = 20
SIDE = 3.0
KEYS = ["k1", "k2"]
ROOT = ["r1", "r2"]
REP = "label long, dim int, k1 long, k2 long, n long, embedding array<float>"


class Rotation:
    """Unit vectors as whole numbers, turned by random signs and a Hadamard matrix.

    Whole numbers make every block distance exact and the same in every task. Dimensions are
    filled up with zeros to a power of two.
    """

    def __init__(self, dim: int, cosine: float):
        self.size = max(BLOCK, 1 << (dim - 1).bit_length())
        signs = np.random.default_rng(dim).integers(0, 2, self.size) * 2 - 1
        h = np.ones((1, 1))
        while len(h) < self.size:
            h = np.block([[h, h], [h, -h]])
        self.matrix = (h * signs)[:dim]
        self.blocks = self.size // BLOCK
        # Distance of linked unit vectors, with room for rounding: at most half a step a coordinate.
        self.reach = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 << SCALE) + math.sqrt(dim) + 4
        # Squared distances grow by the number of dimensions in the turn; each block may have its share.
        self.budget = self.reach**2 * BLOCK
        self.radius = math.sqrt(self.budget)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
        return np.rint(unit * (1 << SCALE)) @ self.matrix


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _cells(turned: np.ndarray, rotation: Rotation, block: int):
    """(row, cell, own) in the grid over the first coordinates of a block: each row's own cell, and
    as a query every greater cell that its ball may reach."""
    side = SIDE * rotation.radius
    at = turned[:, block * BLOCK : block * BLOCK + GRID]
    home = np.floor(at / side).astype(np.int64)
    low = np.floor((at - rotation.radius) / side).astype(np.int64)
    high = np.floor((at + rotation.radius) / side).astype(np.int64)
    for move in itertools.product((-1, 0, 1), repeat=GRID):
        if move < (0,) * GRID:
            continue
        cell = home + move
        rows = np.flatnonzero(((cell >= low) & (cell <= high)).all(1))
        if len(rows):
            yield rows, cell[rows], not any(move)


def _cell_names(label: np.ndarray, dim: int, block: int, cell: np.ndarray) -> np.ndarray:
    name = mix(label.astype(np.int64).view(np.uint64))
    for part in (np.uint64(dim), np.uint64(block), *(cell[:, j].astype(np.int64).view(np.uint64) for j in range(GRID))):
        name = mix(name * GOLDEN + part)
    return name.view(np.int64)


def _emit(batch: pa.RecordBatch, cosine: float):
    """(rows, cell names, block, own) for each block and neighbour of a batch's vectors."""
    sizes = np.diff(batch.column("embedding").offsets.to_numpy())
    for dim in np.unique(sizes):
        where = np.flatnonzero(sizes == dim)
        part = batch.take(pa.array(where))
        rotation = Rotation(int(dim), cosine)
        turned = rotation(_matrix(part.column("embedding")))
        label = part.column("label").to_numpy()
        for block in range(rotation.blocks):
            for rows, cell, own in _cells(turned, rotation, block):
                yield where[rows], _cell_names(label[rows], int(dim), block, cell), block, own


def _pieces(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(a, SLICE_ROWS)


def representatives(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a key of two hashes, one row for each different vector of a label).

    The key is null for vectors that link with nothing.
    """
    part = F.transform("embedding", lambda x: x.cast("double"))
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & ~F.exists(part, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(part, lambda x: x != 0)
    )
    vectors = need(vectors, "vec_id", "embedding", "label").withColumn("sound", F.coalesce(sound, F.lit(False)))
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("float"))
    keyed = vectors.select(
        "vec_id",
        F.when(F.col("sound"), F.xxhash64(F.lit(1), "label", plain)).alias("k1"),
        F.when(F.col("sound"), F.xxhash64(F.lit(2), "label", plain)).alias("k2"),
        "label", plain.alias("embedding"),
    )
    different = (
        keyed.where("k1 is not null").groupBy("k1", "k2", "label", "embedding")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
        .select("k1", "k2", "first", "n", "embedding", F.xxhash64("label").alias("label"))
    )
    return keyed.select("vec_id", "k1", "k2"), different


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding, label``).

    Rows link if their labels are equal and their cosine, in double precision, is ``cosine`` or more.
    Vectors that are null, empty, all zero or hold a null, a NaN or an infinity link with
    nothing, nor do rows without label or vec_id, nor vectors of different length; their component is
    their own vec_id. Repeated rows link with each other. Different vectors of one vec_id are each
    linked on their own, and join no components through their id. Labels are of any type. An empty table gives an empty one.

    Equal vectors are first counted as one. The rest is turned and cut into blocks of ``BLOCK``
    coordinates. If the squared distance of two vectors is within the bound, that of some block is
    within its share; so each block is range-joined by itself, over a grid of its first
    coordinates. A pair is counted in the first block that finds it, after an exact check. A cell
    of over ``cell_rows`` rows is cut into tiles, which meet in pairs. Cells give sums and at most
    one edge a row, never pairs.
    """
    keyed, different = representatives(vectors)
    reps = written(different, "vectors")

    def name_cells(batches):
        for batch in _pieces(batches):
            for _, names, _, _ in _emit(batch, cosine):
                yield pa.RecordBatch.from_arrays([pa.array(names)], names=["cell"])

    hot = (
        reps.mapInArrow(name_cells, "cell long").groupBy("cell").count().where(F.col("count") > cell_rows)
        .select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("tiles"))
    )

    def deal(batches):
        for batch in _pieces(batches):
            for rows, names, block, own in _emit(batch, cosine):
                part = batch.take(pa.array(rows))
                dim = np.diff(part.column("embedding").offsets.to_numpy()).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(np.full(len(rows), block, np.int32)), pa.array(np.full(len(rows), own)), part.column("label"), pa.array(dim)]
                    + [part.column(c) for c in ("k1", "k2", "n", "embedding")],
                    names=["cell", "block", "own", "label", "dim", "k1", "k2", "n", "embedding"],
                )

    dealt = reps.mapInArrow(deal, f"cell long, block int, own boolean, {REP}").join(hot, "cell", "left")
    tiles = F.coalesce("tiles", F.lit(1))
    tile = F.pmod("k2", tiles).cast("int")
    tiled = dealt.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    tiled = tiled.select(
        "cell", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"),
        "tile", "block", "own", "label", "dim", "k1", "k2", "n", "embedding",
    )

    def search(table: pa.Table) -> pa.Table:
        order = np.lexsort(tuple(table.column(c).to_numpy() for c in ("k2", "k1")))
        table = table.take(pa.array(order)).combine_chunks()
        own, tile = table.column("own").to_numpy(), table.column("tile").to_numpy()
        x = _matrix(table.column("embedding").combine_chunks())
        rotation, block = Rotation(x.shape[1], cosine), table.column("block")[0].as_py()
        turned = rotation(x)
        n = table.column("n").to_numpy()
        links, parent = np.zeros(len(x), np.int64), np.arange(len(x))
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        for i, j in _candidates(turned, rotation, block, own, None if same else tile):
            a, b = x[i], x[j]
            cos = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            i, j = i[cos >= cosine], j[cos >= cosine]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            _union(parent, i, j)
        hit = np.flatnonzero(links)
        root = pa.array(_find(parent, hit))
        return pa.table({
            "k1": table.column("k1").take(pa.array(hit)), "k2": table.column("k2").take(pa.array(hit)),
            "more": pa.array(links[hit]), "r1": table.column("k1").take(root), "r2": table.column("k2").take(root),
        })

    found = written(
        tiled.groupBy("cell", "label", "dim", "block", "a", "b")
        .applyInArrow(search, "k1 long, k2 long, more long, r1 long, r2 long"), "links"
    )
    # A vector is a node by its own key, so that an id on several vectors joins nothing.
    groups = written(
        components(found.select(F.struct(*KEYS).alias("a"), F.struct(*(F.col(r).alias(k) for r, k in zip(ROOT, KEYS))).alias("b")))
        .select("node.*", "component").join(reps.select(*KEYS, "first"), KEYS),
        "groups",
    )
    lows = groups.groupBy("component").agg(F.min("first").alias("low"))
    named = groups.join(lows, "component").select(*KEYS, "low")
    more = found.groupBy("k1", "k2").agg(F.sum("more").alias("more"))
    answers = (
        reps.select("k1", "k2", "first", "n").join(more, KEYS, "left").join(named, KEYS, "left")
        .select("k1", "k2", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("low", "first").alias("component_id"))
        .transform(written, "answers")
    )
    return (
        keyed.join(answers, KEYS, "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def _candidates(turned: np.ndarray, rotation: Rotation, block: int, own: np.ndarray, tile: np.ndarray | None):
    """Pairs (i, j) of a cell, one of them at home, that this block is the first to find."""
    part = turned[:, block * BLOCK : (block + 1) * BLOCK]
    square = (part * part).sum(1)
    rows = np.arange(len(part))
    for a in range(0, len(part), 512):
        for b in range(a, len(part), 2048):
            left, right = rows[a : a + 512], rows[b : b + 2048]
            near = square[left][:, None] + square[right][None, :] - 2 * (part[left] @ part[right].T) <= rotation.budget
            near &= left[:, None] < right[None, :]
            near &= own[left][:, None] | own[right][None, :]
            if tile is not None:
                near &= tile[left][:, None] != tile[right][None, :]
            i, j = np.nonzero(near)
            for c in range(0, len(i), 65536):
                p, q = left[i[c : c + 65536]], right[j[c : c + 65536]]
                gap = (turned[p] - turned[q]) ** 2
                whole = gap.sum(1) <= rotation.reach**2 * rotation.size
                before = gap[:, : block * BLOCK].reshape(len(p), -1, BLOCK).sum(2) if block else np.zeros((len(p), 0))
                new = whole & ~(before <= rotation.budget).any(1)
                if new.any():
                    yield p[new], q[new]


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        parent[x] = parent[up]
        x = parent[x]


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while True:
        i, j = _find(parent, i), _find(parent, j)
        differ = i != j
        if not differ.any():
            return
        i, j = i[differ], j[differ]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
