"""The chain of receipts within a run: linking at mint, checking later.

A receipt's content id is the digest of its header without the link; `prev` is the content id of the
receipt before it in the run, and `receipt_id` the digest of the whole header, link included. So a link
depends on one neighbour only, and a chain of any length is linked by one `lag`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import digest, each_digest, packed, unpacked
from ..session import scratch_table, written
from .blocks import with_previous
from .receipts import header_halves, header_id, prev_json

BLOCK = 1 << 21


def content_id(df: DataFrame) -> Column:
    head, tail = header_halves(df)
    return digest(F.concat(head, prev_json(F.lit(None)), tail))


def link_chain(receipts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds `prev` and `receipt_id`. Needs `seq`, the position in the run.

    Positions may be sparse, negative or as large as an epoch value. Receipts with the same
    position are ordered by their content; those without one are not linked. `verify_chain`
    reports both. Nothing runs before the caller's own action, and no task gets more than
    `block` positions of a run. Digests are shuffled as bytes.
    """
    levels = 1
    while block ** (levels + 1) < 1 << 63:  # the last window then holds a few blocks for any 64-bit positions
        levels += 1
    rows = receipts.drop("prev", "receipt_id").withColumn("_content", F.unhex(content_id(receipts)))
    linked = with_previous(
        each_digest(rows, packed), ["run_id"], "seq", ["_content"], block, "_prev_", ("_content",), levels
    )
    linked = each_digest(linked, unpacked)
    prev = F.when(F.col("seq").isNotNull(), F.lower(F.hex("_prev__content")))
    named = linked.withColumn("prev", prev).drop("_content", "_prev_seq", "_prev__content")
    return named.withColumn("receipt_id", header_id(named))


def verify_chain(receipts: DataFrame) -> DataFrame:
    """Problems of the chains, one row each; nothing for sound runs.

    Needs no order: altered members by their recomputed id, dangling links by an anti join
    on the recomputed content id, the rest by counting: forks (different receipts after the
    same one), duplicates (the same receipt again), roots, and positions missing or used by
    different receipts. Headers are hashed once: their digests are written as a table, which this
    function does when it is called, and all checks read that.
    """
    hashed = receipts.select(
        "run_id", "receipt_id", "prev", "seq",
        header_id(receipts).alias("actual"), content_id(receipts).alias("content"),
    )
    seen = written(hashed, scratch_table(receipts.sparkSession, "chain"))
    named = lambda df, key, problem: df.select(
        "run_id", F.col(key).alias("receipt_id"), F.lit(problem).alias("problem")
    )
    altered = seen.where(~F.col("receipt_id").eqNullSafe(F.col("actual")))
    linked = seen.where(F.col("prev").isNotNull())
    known = seen.select("run_id", F.col("content").alias("prev"))
    dangling = linked.join(known, ["run_id", "prev"], "left_anti")
    apart = seen.groupBy("run_id", "receipt_id", "prev", "seq").agg(F.count("*").alias("n"))
    duplicates = apart.where("n > 1")
    forks = apart.where("prev IS NOT NULL").groupBy("run_id", "prev").agg(F.count("*").alias("n")).where("n > 1")
    places = apart.where("seq IS NOT NULL").groupBy("run_id", "seq").agg(
        F.count("*").alias("n"), F.min("receipt_id").alias("receipt_id")
    )
    roots = (
        apart.groupBy("run_id")
        .agg(F.count_if(F.col("prev").isNull()).alias("n"))
        .where("n <> 1")
        .select(
            "run_id",
            F.lit(None).cast("string").alias("receipt_id"),
            F.when(F.col("n") == 0, "no root").otherwise("extra root").alias("problem"),
        )
    )
    parts = (
        named(dangling, "receipt_id", "dangling"),
        named(duplicates, "receipt_id", "duplicate"),
        named(forks, "prev", "fork"),
        named(seen.where("seq IS NULL"), "receipt_id", "no position"),
        named(places.where("n > 1"), "receipt_id", "repeated position"),
        roots,
    )
    found = named(altered, "receipt_id", "altered")
    for part in parts:
        found = found.unionByName(part)
    return found
