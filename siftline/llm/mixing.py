"""Mixing sources to target weights by temperature.

Everything here is DataFrame operations; the driver sees a few sums for each exponent it tries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import need, written
from siftline.sources.store import fresh

WORD = r"[^\x20\x09-\x0D]+"
ENTROPY = 0.95
MAX_REPEATS = 4.0
SEED = 7
BLOCK_ROWS = 1024
TRIES = 33
ROUNDS = 6


def source_key(source: Column) -> Column:
    """A key that is never null and that no other source has; rows without source are one source."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def place(seed: int) -> Column:
    """Where a row stands in the permutation of its source."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def n_tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Measure:
    """Of the weights at one exponent: entropy in nats, and the most often a source is repeated."""

    exponent: float
    entropy: float
    repeats: float


def measures(sources: DataFrame, exponents: list[float], ratio: float) -> list[Measure]:
    """One row a source goes in (``share``), three sums an exponent come out."""
    tried = sources.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("x"))
    power = F.exp(F.col("x") * F.log("share"))
    sums = tried.groupBy("x").agg(
        F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("l"), F.max(power / F.col("share")).alias("m")
    )
    return sorted(
        (Measure(r["x"], math.log(r["z"]) - r["x"] * r["l"] / r["z"], ratio * r["m"] / r["z"]) for r in sums.collect()),
        key=lambda m: m.exponent,
    )


def exponent(sources: DataFrame, n_sources: int, ratio: float, entropy: float, max_repeats: float) -> float:
    """The largest exponent in 0..1 whose weights have ``entropy`` times the largest possible entropy,
    or the least at which no source is repeated more than ``max_repeats`` times, if that is greater.

    Both are met from one side only, so the bracket is cut by trying many exponents at once.
    """
    target = entropy * math.log(n_sources) if n_sources > 1 else 0.0

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        tried = measures(sources, [low + (high - low) * k / (TRIES - 1) for k in range(TRIES)], ratio)
        # Entropy falls and repeats fall as the exponent grows: first all that repeat too often, then
        # those that are even enough, then the rest.
        over = [m for m in tried if m.repeats > max_repeats]
        even = [m for m in tried if m.entropy >= target]
        if over and over[-1].exponent >= (even[-1].exponent if even else -1.0):
            edge = over[-1].exponent
            if edge == tried[-1].exponent:
                return edge
            low, high = edge, min(m.exponent for m in tried if m.exponent > edge)
            settled = high
        else:
            edge = even[-1].exponent if even else tried[0].exponent
            if not even or edge == tried[-1].exponent:
                return edge
            low, high = edge, min(m.exponent for m in tried if m.exponent > edge)
            settled = low
    return settled


def quotas(
    docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, seed: int = SEED
) -> DataFrame:
    """For each source: ``key, weight, passes, cut``. A row of it is taken ``passes`` times, and once
    more if its place is ``cut`` or less (null: never).

    ``budget`` is in tokens (words), by default as many as there are. A source's quota is its weight
    times the budget. The part after the whole passes goes to the first rows of the source's
    permutation, by hash: blocks of about ``BLOCK_ROWS`` rows are summed, then the rows in
    each block, so that no task holds a whole source. Rows that do not fit as a whole are not taken.
    """
    rows = written(
        docs.select(source_key(F.col("source")).alias("key"), place(seed).alias("place"), n_tokens().alias("n")), "places"
    )
    totals = rows.groupBy("key").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows"))
    every = totals.agg(F.sum("tokens").alias("t"), F.count(F.when(F.col("tokens") > 0, 1)).alias("s")).first()
    tokens, n_sources = every["t"] or 0, every["s"]
    budget = tokens if budget is None else budget
    ratio = budget / tokens if tokens else 1.0
    if tokens:
        shares = totals.where("tokens > 0").select((F.col("tokens") / F.lit(tokens)).alias("share"))
        power = exponent(shares.transform(written, "shares"), n_sources, ratio, entropy, max_repeats)
    else:
        power = 1.0
    raw = F.when(F.col("tokens") > 0, F.exp(F.lit(power) * F.log(F.col("tokens") / F.lit(max(1, tokens))))).otherwise(0.0)
    weighed = totals.withColumn("raw", raw)
    norm = weighed.agg(F.sum("raw").alias("z")).first()["z"] or 1.0
    weighed = (
        weighed.withColumn("weight", F.col("raw") / F.lit(norm))
        .withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(1e-6)))
        .withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
        .withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / F.lit(BLOCK_ROWS)))).cast("int"))
        .select("key", "weight", "passes", "rest", "bits")
        .transform(written, "quotas")
    )
    blocks = rows.join(weighed.select("key", "bits"), "key").select(
        "key", "place", "n", F.when(F.col("bits") > 0, F.expr("shiftright(place, 64 - bits)")).otherwise(F.lit(0)).alias("block")
    )
    sums = blocks.groupBy("key", "block").agg(F.sum("n").alias("sum"), F.max("place").alias("top"))
    before = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).join(weighed, "key")
    # The block in which the rest of the quota runs out, of each source.
    part = base.where("base <= rest and base + sum > rest").select("key", "block", "base", "rest")
    inside = W.partitionBy("key", "block").orderBy("place").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = (
        blocks.join(part, ["key", "block"])
        # Equal rows have one place: their sum is made before the rows of a block meet.
        .groupBy("key", "block", "base", "rest", "place").agg(F.sum("n").alias("n"))
        .withColumn("upto", F.col("base") + F.sum("n").over(inside))
        .where("upto <= rest")
        .groupBy("key")
        .agg(F.max("place").alias("inner_cut"))
    )
    # The last place of the last whole block, if no row of the next one fits.
    whole = base.where("base + sum <= rest").groupBy("key").agg(F.max("top").alias("outer_cut"))
    return (
        weighed.join(last, "key", "left")
        .join(whole, "key", "left")
        .select("key", "weight", "passes", F.coalesce("inner_cut", "outer_cut").alias("cut"))
    )


def mixture(docs: DataFrame, budget: int | None = None, seed: int = SEED, **targets: float) -> DataFrame:
    """``doc_id, source, n_tokens, weight, copies`` for every row of ``docs`` (``doc_id, source, text``):
    how often it comes in the mixture, with the weight of its source.

    Weights are token shares to the power found by ``exponent``, made to sum to 1. Rows without
    source are a source of their own; a null text has no token. A source without any token has
    weight 0 and each of its rows one copy. Equal rows get equal numbers of copies, and are
    left out together where the budget ends. An empty table gives an empty one. No row is
    dropped here, ``copies`` may be 0.
    """
    docs = need(docs, "doc_id", "source", "text")
    quota = quotas(docs, budget, seed=seed, **targets)
    marked = _marked(docs, quota, seed, "weight", "copies")
    return marked.select("doc_id", "source", n_tokens().alias("n_tokens"), "weight", "copies")


def _marked(docs: DataFrame, quota: DataFrame, seed: int, weight: str, copies: str) -> DataFrame:
    """One row a source on the other side, and a comparison of hashes: no row is ranked again."""
    key, passes, cut = fresh(docs, "key", "passes", "cut")
    quota = quota.select(
        F.col("key").alias(key), F.col("passes").alias(passes), F.col("cut").alias(cut), F.col("weight").alias(weight)
    ).transform(written, "cuts")
    more = F.coalesce((place(seed) <= F.col(cut)).cast("long"), F.lit(0))
    marked = docs.join(quota, source_key(F.col("source")) == F.col(key))
    return marked.select(*(F.col(c) for c in (*docs.columns, weight)), (F.col(passes) + more).alias(copies))


def mixed(docs: DataFrame, budget: int | None = None, seed: int = SEED, **targets: float) -> DataFrame:
    """``docs`` with every row as often as the mixture has it; columns as given, whatever their names.

    Nulls, empty texts and repeated rows count as in ``mixture``; an empty table gives an empty one.
    """
    weight, copies, copy = fresh(docs, "weight", "copies", "copy")
    marked = _marked(docs, quotas(docs, budget, seed=seed, **targets), seed, weight, copies)
    often = F.when(F.col(copies) > 0, F.sequence(F.lit(1), F.col(copies)))
    return marked.withColumn(copy, F.explode(often)).select(*docs.columns)
