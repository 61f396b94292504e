"""Check receipts while they are appended: the store is a folder of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import keyed_seal
from ..operators.receipts import header_id, header_json
from ..sources.stores import receipt_lines


def receipt_stream(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """Receipts of all stores under `root`, as a stream over newly written files."""
    reader = spark.readStream.option("pathGlobFilter", "*.jsonl")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(f"{root.rstrip('/')}/*")
    return receipt_lines(lines, F.col("_metadata.file_path"))


def header_checks(receipts: DataFrame, key: bytes) -> DataFrame:
    """Row by row: does the id fit the header, and the seal the key. No state, no shuffle."""
    sealed = F.col("seal") == keyed_seal(header_json(receipts), key)
    return receipts.select(
        "scope",
        "run_id",
        "seq",
        "receipt_id",
        "prev",
        (F.col("receipt_id") == header_id(receipts)).alias("id_ok"),
        F.coalesce(sealed, F.lit(False)).alias("seal_ok"),
    )


def watch(
    spark: SparkSession, root: str, out: str, checkpoint: str, key: bytes, **options
) -> StreamingQuery:
    """Writes the checks of new receipts to `out` and stops when all present files are done."""
    checked = header_checks(receipt_stream(spark, root, **options), key)
    return (
        checked.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
