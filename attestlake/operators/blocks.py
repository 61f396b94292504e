"""Order-dependent work cut into blocks, so no key has to fit one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: str,
    carried: list[str],
    width: int = 100_000,
    prefix: str = "prev_",
    ties: tuple[str, ...] = (),
    levels: int = 1,
) -> DataFrame:
    """`lag` of some columns along an integer order, per key.

    A block holds at most `width` different order values, so a hot key is spread over
    many tasks. Rows at a block's start take their values from the last row of the
    block before, found in a table of one row per block; with more `levels` that table is
    cut into blocks in turn, so that four levels cover all 63-bit values with sparse rows.
    Rows with equal order are ordered by `ties`.
    """
    blocks = df.withColumn("_block", F.floor(F.col(order) / width))
    block_keys = [*keys, "_block"]
    inside = Window.partitionBy(*block_keys).orderBy(order, *ties)
    taken = F.struct(order, *[name for name in carried if name != order])

    last = F.max_by(taken, F.struct(order, *ties))
    ends = blocks.groupBy(*block_keys).agg(last.alias("_end"))
    if levels > 1:
        upper = ends.withColumnRenamed("_block", "_of").where(F.col("_of").isNotNull())
        upper = with_previous(upper, keys, "_of", ["_end"], width, "_up", (), levels - 1)
        starts = upper.select(*keys, F.col("_of").alias("_block"), F.col("_up_end").alias("_before"))
    else:
        across = Window.partitionBy(*keys).orderBy("_block")
        starts = ends.select(*block_keys, F.lag("_end").over(across).alias("_before"))

    lagged = blocks.withColumn("_inside", F.lag(taken).over(inside))
    joined = lagged.join(starts, block_keys, "left")
    value = F.coalesce("_inside", "_before")
    names = [order, *[name for name in carried if name != order]]
    return joined.select(
        *[F.col(name) for name in df.columns],
        *[value[name].alias(prefix + name) for name in names],
    )
