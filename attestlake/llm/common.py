"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_table, written

# One Arrow batch must fit a Python worker many times over, however long its texts are.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def batch_settings(spark: SparkSession) -> None:
    for name, value in BATCH_SETTINGS.items():
        spark.conf.set(name, value)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table in the shared folder."""
    return written(df, scratch_table(df.sparkSession, name))


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """`df` as the columns `needed` and `_own`, a struct of all its columns: no other name of a caller is in the way."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_own"), *[F.col(f"`{c}`") for c in needed])


def unpacked(df: DataFrame, names: list[str], *added: Column) -> DataFrame:
    """The caller's columns `names` out of `_own` and the columns `added`; a caller's column of the name of an added one gives way."""
    out = df.select("_own", *added)
    new = [c for c in out.columns if c != "_own"]
    return out.select(*[F.col("_own")[c].alias(c) for c in names if c not in new], *new)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def per_process(name: str, make: Callable[[], object]) -> object:
    """An object made once in each Python worker and kept for its later tasks."""
    kept = pa.__dict__.setdefault("_attestlake_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def running_total(df: DataFrame, order: list, value: str, name: str = "before") -> tuple[DataFrame, DataFrame]:
    """The rows in the order of `order`, each with the sum of `value` over all rows before it.

    Sorted by ranges, summed within each range as the rows pass, and written; the totals of the
    ranges (one row for each) are then added up. Returns the rows and a one-row frame `total`.
    `value` must not be null. Rows that tie in `order` are ordered as the sort leaves them.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_before", T.LongType())])

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)) + so_far
            starts = np.concatenate([[so_far], ends[:-1]]).astype(np.int64)
            so_far = int(ends[-1])
            columns = [*batch.columns, pa.array(np.full(len(ends), part, np.int32)), pa.array(starts)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = scratch(df.orderBy(*order).mapInArrow(pass_on, schema), "running-total")
    ranges = rows.groupBy("_range").agg(F.sum(value).alias("_sum"))
    # One row for each sorted range, so this window holds as many rows as the sort had partitions.
    ranges = ranges.select(
        "_range",
        (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_range_before"),
    )
    out = rows.join(ranges, "_range").withColumn(name, F.col("_range_before") + F.col("_before"))
    total = rows.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total"))
    return out.drop("_range", "_before", "_range_before"), total


def row_numbers(df: DataFrame, order: list, name: str) -> tuple[DataFrame, int]:
    """The rows with their number (from 0) in the order of `order`, as a written table, and how many there are.

    Sorted by ranges and numbered within each range; the sizes of the ranges, one row for each, are then added up.
    """
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch(placed, "row-numbers").withColumn("_range", F.shiftright("_at", 33))
    ranges = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # One row for each sorted range, so this window holds as many rows as the sort had partitions.
    before = F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")
    ranges = ranges.select("_range", before.alias("_range_before"))
    in_range = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.join(ranges, "_range").withColumn(name, F.col("_range_before") + in_range)
    return out.drop("_at", "_range", "_range_before"), rows.count()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column and the offsets of the texts in them; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts (first, after last) of about `size` bytes; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[0x41:0x5B] += 0x20


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the capitals U+00C0 to U+00DE; all other bytes, and all lengths, stay."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all runs without ASCII white space, and the index of the text of each."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACE[data]
    cut = np.zeros(len(data) + 2, bool)
    cut[offsets] = True  # the byte before position i + 1 is position i of the padded array
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-2])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:-1])) + 1 if len(data) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, from the running sums of one polynomial over all the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = len(data)
    powers = np.full(size, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[data] * powers, out=sums[1:])
    back = np.full(size, _INVERSE, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    value = (sums[ends] - sums[starts]) * back[starts]
    return mix(value ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))
