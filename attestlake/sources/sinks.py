"""Writers. Spark's commit protocol makes each write all-or-nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import each_digest, packed, unpacked

RUN_BUCKETS = 64


def run_bucket(run_id="run_id", buckets: int = RUN_BUCKETS):
    """The folder a run's receipts lie in: a fixed number of folders for any number of runs."""
    return F.pmod(F.xxhash64(run_id), F.lit(buckets)).cast("int")


def append_receipts(
    receipts: DataFrame, path: str, records: DataFrame | None = None, buckets: int = RUN_BUCKETS
) -> None:
    """Append receipts not stored yet; ids are content-addressed, so a rerun adds nothing.

    The store is two Parquet tables, `receipts` and `records` (receipt_id, record_idx, record), both by
    `run_bucket`; keep to one number of buckets in a store. Before writing, rows are rebalanced by folder:
    adaptive execution joins small pieces and splits the folder of a hot run into several files. Records go
    first, so a receipt that is stored has its records. Only one writer at a time is safe: two could store
    an id twice. Digests are shuffled as bytes, and stored ids and copies are dropped on the same shuffle.
    """
    spark = receipts.sparkSession
    fresh = each_digest(receipts.withColumn("run_bucket", run_bucket("run_id", buckets)), packed)
    stored = _stored(spark, f"{path}/receipts")
    if stored is not None:
        fresh = fresh.join(each_digest(stored.select("receipt_id"), packed), "receipt_id", "left_anti")
    fresh = fresh.dropDuplicates(["receipt_id"])
    if records is not None:
        mine = fresh.select("receipt_id", "run_bucket")
        rows = each_digest(records.select("receipt_id", "record_idx", "record"), packed)
        _append(rows.join(mine, "receipt_id"), f"{path}/records")
    _append(fresh, f"{path}/receipts")


def _append(rows: DataFrame, path: str) -> None:
    spread = each_digest(rows.hint("rebalance", "run_bucket"), unpacked)
    spread.write.mode("append").option("compression", "zstd").partitionBy("run_bucket").parquet(path)


def _stored(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_receipt_lines(receipts: DataFrame, records: DataFrame, path: str, fan: int = 10_000):
    """Receipts as JSON lines with their records inside, for exchange; `read_receipts` reads them back.

    A receipt with more than `fan` records takes several lines, each with the number of its first record.
    """
    header = [
        "tool_name", "tool_version", "args_canonical", "image_sha256", "raw_digest",
        "data_digest", "offsets", "ts", "prev", "run_id", "seq", "model_id", "prompt_hash",
    ]
    line = F.floor(F.col("record_idx") / fan)
    data = records.groupBy("receipt_id", line.alias("line")).agg(
        F.min("record_idx").cast("bigint").alias("first_record"),
        F.sort_array(
            F.collect_list(F.struct("record_idx", F.map_entries("record").alias("entries")))
        ).alias("rs"),
    )
    lines = receipts.join(data, "receipt_id", "left").select(
        "receipt_id",
        F.struct(*header).alias("header"),
        F.coalesce("first_record", F.lit(0)).alias("first_record"),
        F.coalesce(
            F.transform("rs", lambda r: F.map_from_entries(r["entries"])),
            F.array().cast("array<map<string,string>>"),
        ).alias("data"),
        "seal",
    )
    lines.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "append"
    ).text(path)


def append_attempts(attempts: DataFrame, path: str) -> None:
    """One JSON line per attempt; `seq` keeps the order of writing."""
    attempts.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def write_scorecard(card: DataFrame, folder: str, run_id: str, module: str, k: int) -> str:
    """The one-row scorecard as JSON with sorted keys, in a folder named after the run."""
    target = f"{folder.rstrip('/')}/{run_id}_{module}_tus{k}.json"
    ordered = F.to_json(F.struct(*sorted(card.columns)), {"ignoreNullFields": "false"})
    card.select(ordered.alias("value")).write.mode("overwrite").text(target)
    return target
