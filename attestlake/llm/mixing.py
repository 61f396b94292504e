"""Mixing sources to target weights by temperature.

The token share of each source is raised to an exponent; the exponent is found by bisection so that the
mixture has a given entropy or repeats no source more often than a limit allows. The normalised weights
times the budget are the quotas. A source's documents are dealt into blocks; each pass over the source is
a fresh permutation of its blocks, the last pass ends where the quota does, to within one document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, scratch, unpacked

BLOCK_TOKENS = 1 << 20
# Blocks whose order and running sums are one task's work.
STRETCH = 4096
STEPS = 80
# With up to this many sources (a few MB) their plan is broadcast; with more, Spark chooses the join.
BROADCAST_SOURCES = 50_000


def tokens_of(text: Column) -> Column:
    """Words of a text and one end mark."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


@dataclass(frozen=True)
class Mixture:
    exponent: float
    budget: int
    weights: list[float]
    quotas: list[int]


def _weights(tokens: list[int], exponent: float) -> list[float]:
    top = math.log(max(tokens))
    raised = [math.exp(exponent * (math.log(t) - top)) for t in tokens]
    return [r / sum(raised) for r in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def solve(
    tokens: list[int],
    budget: int | None = None,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
) -> Mixture:
    """The flattest mixture (smallest exponent) of positive token counts that meets the target.

    Exactly one target: `target_entropy` in nats, or `max_repeats`, the most passes over any source.
    Without a budget it is the smallest one that passes over every source once. Targets out of reach are
    met as nearly as exponents from 0 (even weights) to 1 (natural shares) allow.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give one of target_entropy and max_repeats")
    if not tokens:
        return Mixture(1.0, 0, [], [])
    if min(tokens) < 1:
        raise ValueError("every source needs at least one token")

    def spent(weights: list[float]) -> float:
        return budget if budget is not None else max(t / w for t, w in zip(tokens, weights, strict=True))

    def too_flat(exponent: float) -> bool:
        weights = _weights(tokens, exponent)
        if target_entropy is not None:
            return entropy(weights) > target_entropy
        return max(w * spent(weights) / t for t, w in zip(tokens, weights, strict=True)) > max_repeats

    low, high = 0.0, 1.0
    if not too_flat(low):
        high = low
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    weights = _weights(tokens, high)
    total = round(spent(weights))
    return Mixture(high, total, weights, [round(w * total) for w in weights])


def mix_sources(
    docs: DataFrame,
    budget: int | None = None,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    seed: int = 0,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """All columns of the rows of `docs` (doc_id, text, source, ...) that the mixture takes, once for each time they are taken.

    Adds `_tokens`, `_epoch` (pass over the source, from 0), `_block` and `_mix_at`: how far the source's
    quota is used when the block begins, from 0 to 1. Read in the order of `_mix_at`, every stretch has
    about the target weights. Null text counts as empty, null is a source of its own, rows that repeat a
    doc_id are taken together, an empty table gives no rows.

    The driver receives one row for each source. Blocks hold the documents of one source by a hash of the
    id, so a source with a third of all rows is as evenly dealt as the rest; a larger source has more blocks, not
    larger ones. Columns named like the added ones give way; other names are never in the way.
    """
    names, docs = docs.columns, packed(docs, "doc_id", "source")
    counted = scratch(docs.select("doc_id", "source", tokens_of(F.col("_own")["text"]).alias("tokens")), "mix-tokens")
    sources = counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy("source").collect()
    mixture = solve([r["tokens"] for r in sources], budget, target_entropy, max_repeats)
    rows = []
    for r, quota in zip(sources, mixture.quotas, strict=True):
        rows.append((r["source"], max(1, -(-r["tokens"] // block_tokens)), quota // r["tokens"], quota % r["tokens"], quota, r["tokens"]))
    plan = docs.sparkSession.createDataFrame(
        rows, "plan_source string, n_blocks bigint, full bigint, rest bigint, quota bigint, source_tokens bigint"
    )
    if len(rows) <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    with_plan = F.col("source").eqNullSafe(F.col("plan_source"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks")).alias("block")

    dealt = counted.join(plan, with_plan).select("doc_id", "plan_source", "tokens", block)
    blocks = dealt.groupBy("plan_source", "block").agg(F.sum("tokens").alias("block_tokens"))
    passes = blocks.join(
        plan.withColumnRenamed("plan_source", "own"), F.col("plan_source").eqNullSafe(F.col("own"))
    ).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full"))))
    # The blocks of a pass in hashed order, in stretches of about STRETCH blocks: sums within each stretch, and then
    # over the stretches, one row for each.
    place = F.xxhash64("plan_source", "epoch", "block", F.lit(seed))
    stretches = F.ceil(F.col("n_blocks") / STRETCH)
    stretch = F.least(F.floor((place / F.lit(2.0**64) + 0.5) * stretches), stretches - 1)
    passes = passes.withColumn("place", place).withColumn("stretch", stretch)
    totals = passes.groupBy("plan_source", "epoch", "stretch").agg(F.sum("block_tokens").alias("stretch_tokens"))
    along = Window.partitionBy("plan_source", "epoch").orderBy("stretch")
    totals = totals.select(
        F.col("plan_source").alias("total_source"),
        F.col("epoch").alias("total_epoch"),
        F.col("stretch").alias("total_stretch"),
        (F.sum("stretch_tokens").over(along) - F.col("stretch_tokens")).alias("stretch_before"),
    )
    inside = Window.partitionBy("plan_source", "epoch", "stretch").orderBy("place", "block")
    before = F.sum("block_tokens").over(inside) - F.col("block_tokens")
    summed = passes.withColumn("within", before).join(
        totals,
        F.col("plan_source").eqNullSafe(F.col("total_source"))
        & (F.col("epoch") == F.col("total_epoch"))
        & (F.col("stretch") == F.col("total_stretch")),
    )
    chosen = summed.withColumn("before", F.col("within") + F.col("stretch_before")).withColumn(
        "room", F.when(F.col("epoch") < F.col("full"), F.col("block_tokens")).otherwise(F.col("rest") - F.col("before"))
    )
    chosen = scratch(
        chosen.filter("room > 0").select(
            "plan_source",
            "n_blocks",
            "block",
            "epoch",
            "room",
            "block_tokens",
            ((F.col("epoch") * F.col("source_tokens") + F.col("before")) / F.col("quota")).alias("mix_at"),
        ),
        "mix-blocks",
    )

    # In the one block of a source that is taken in part: the last document, in hashed order, that begins within the quota.
    in_block = Window.partitionBy("source_key", "epoch").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.xxhash64("doc_id", "epoch", F.lit(seed + 1))
    cut = chosen.filter("room < block_tokens").withColumnRenamed("plan_source", "source_key").withColumnRenamed("block", "cut_block")
    cuts = (
        dealt.join(cut, F.col("plan_source").eqNullSafe(F.col("source_key")) & (F.col("block") == F.col("cut_block")))
        .withColumn("rank", rank)
        .withColumn("begins", F.coalesce(F.sum("tokens").over(in_block), F.lit(0)))
        .filter("begins < room")
        .groupBy("source_key", "epoch")
        .agg(F.max("rank").alias("last_rank"))
        .withColumnRenamed("epoch", "cut_epoch")
    )
    takes = chosen.join(
        cuts,
        F.col("plan_source").eqNullSafe(F.col("source_key"))
        & (F.col("epoch") == F.col("cut_epoch"))
        & (F.col("room") < F.col("block_tokens")),
        "left",
    ).select(
        F.col("plan_source").alias("_source"),
        F.col("block").alias("_block"),
        F.col("epoch").alias("_epoch"),
        F.col("mix_at").alias("_mix_at"),
        "last_rank",
    )
    numbers = plan.select(F.col("plan_source").alias("_of"), "n_blocks")
    if len(rows) <= BROADCAST_SOURCES:
        numbers = F.broadcast(numbers)
    out = docs.join(numbers, docs["source"].eqNullSafe(F.col("_of"))).withColumn(
        "_own_block", F.pmod(F.xxhash64(docs["doc_id"], F.lit(seed)), F.col("n_blocks"))
    )
    taken = out.join(takes, F.col("_of").eqNullSafe(F.col("_source")) & (F.col("_own_block") == F.col("_block")))
    taken = taken.filter(
        F.col("last_rank").isNull() | (F.xxhash64(docs["doc_id"], "_epoch", F.lit(seed + 1)) <= F.col("last_rank"))
    )
    return unpacked(taken, names, tokens_of(F.col("_own")["text"]).alias("_tokens"), F.col("_epoch"), F.col("_block"), F.col("_mix_at"))
