"""Reproducible shuffling and sharding by a permutation of global row numbers.

Rows are numbered 0 to n - 1 in an order that depends on their content only. A Feistel network over
a grid of a x b >= n cells permutes the cells; a cell outside 0..n-1 is sent through the network
again until it lands inside (cycle walking), which makes it a permutation of the row numbers. The
permuted number p gives shard p mod k and slot p div k: counts of shards differ by one at most, slots
have no gaps, and both follow from n, the seed and the row number without looking at any other row.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_numbers, unpacked

ROUNDS = 6
PRIME = (1 << 31) - 1


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with at least n cells; fewer than one side of it stay empty."""
    a = max(1, isqrt(max(0, n - 1)) + 1) if n else 1
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    state, keys = seed % (1 << 64), []
    for _ in range(ROUNDS):
        drawn = []
        for _ in range(3):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            drawn.append((state >> 33) % (PRIME - 1) + 1)
        keys.append(tuple(drawn))
    return keys


def _scatter(half: np.ndarray, key: tuple[int, int, int]) -> np.ndarray:
    """Values from 0 to PRIME - 1; products stay below 2 ** 62."""
    h = (half + key[0]) % PRIME
    h = h * key[1] % PRIME
    h ^= h >> 15
    h = (h + key[2]) * 48271 % PRIME
    h ^= h >> 13
    return h * key[1] % PRIME


def _network(cells: np.ndarray, a: int, b: int, keys: list) -> np.ndarray:
    left, right = cells // b, cells % b
    for i, key in enumerate(keys):  # each round moves one half by a function of the other
        if i % 2:
            right = (right + _scatter(left, key)) % b
        else:
            left = (left + _scatter(right, key)) % a
    return left * b + right


def _network_back(cells: np.ndarray, a: int, b: int, keys: list) -> np.ndarray:
    left, right = cells // b, cells % b
    for i in reversed(range(len(keys))):
        if i % 2:
            right = (right - _scatter(left, keys[i])) % b
        else:
            left = (left - _scatter(right, keys[i])) % a
    return left * b + right


def _walk(step, numbers, n: int, seed: int) -> np.ndarray:
    (a, b), keys = grid(n), round_keys(seed)
    out = step(np.asarray(numbers, dtype=np.int64), a, b, keys)
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = step(out[far], a, b, keys)
    return out


def permute(numbers, n: int, seed: int) -> np.ndarray:
    """Permuted row numbers of rows `numbers` out of n."""
    return _walk(_network, numbers, n, seed)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that stands at a slot of a shard."""
    return int(_walk(_network_back, [slot * shards + shard], n, seed)[0])


def shard_rows(rows: DataFrame, order: list[Column], shards: int, seed: int) -> DataFrame:
    """`rows` with `_row` (global number in `order`), `_shard` and `_slot`.

    Rows that tie in `order` take neighbouring numbers. Nulls in the order come first. An empty input
    gives an empty output. Extra columns pass through, whatever their names; only columns named `_row`, `_shard` or
    `_slot` give way to the new ones.
    """
    keys = [f"key{i}" for i in range(len(order))]
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_own")
    keyed = rows.select(own, *[o.alias(k) for o, k in zip(order, keys, strict=True)])
    # The last key spreads rows that tie over ranges.
    numbered, n = row_numbers(keyed.withColumn("tie", F.monotonically_increasing_id()), [*keys, "tie"], "row")

    @F.pandas_udf(T.LongType())
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    moved = numbered.select("_own", "row", permuted("row").alias("moved"))
    return unpacked(
        moved,
        rows.columns,
        F.col("row").alias("_row"),
        (F.col("moved") % shards).cast("int").alias("_shard"),
        F.expr(f"moved div {shards}").alias("_slot"),
    )
