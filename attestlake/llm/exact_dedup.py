"""Exact deduplication of a stream of documents with disk-backed keyed state.

The state lives in RocksDB, is keyed by the digest of the normalised text and never expires. For each
digest it retains the stable identifier of the row that stays, the content locator of the first row
(file and row number within the whole file, however a read splits it), and the number of rows. It is a streaming aggregate, so rows of a hot digest are
combined before the shuffle. Every further row of a digest is a hit: its full bytes are compared with
those of the row the locator names. Rows of a digest with unlike bytes are classed by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table
from .common import scratch

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Many small stores: no disk space ahead of need, and only changes are uploaded with each batch.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# Hits of one digest meet its content in groups of at most about this many rows.
HITS_PER_GROUP = 4096


def normalised(text: Column) -> Column:
    """Text without the six ASCII white-space characters; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def full_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def _rows(source: DataFrame, digest) -> DataFrame:
    content = normalised(F.col("text"))
    return source.select(
        "doc_id",
        content.alias("content"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("locator"),
    ).withColumn("digest", digest(F.col("content")))


def _preferred() -> Column:
    """Orders the rows of a group: most code points, then smallest doc_id (null last), then place."""
    return F.struct(
        (-F.col("length")).alias("less"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.col("doc_id"),
        F.col("locator"),
    )


def stream_state(spark: SparkSession, source: DataFrame, digest, checkpoint: str, out: str) -> DataFrame:
    """Run the streaming pass until all input present is read; the ledger of digests afterwards.

    A later call with the same folders continues from the retained state with the files that are new.
    """
    ledger = _rows(source, digest).groupBy("digest").agg(
        F.min(_preferred()).alias("keep"),
        F.min("locator").alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    )

    def append(changed: DataFrame, batch: int) -> None:
        # Overwriting the folder of the batch makes a repeated batch harmless.
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        query = (
            ledger.writeStream.outputMode("update")
            .foreachBatch(append)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    changes = spark.read.schema(
        ledger.select("*", F.lit(0).alias("batch")).schema
    ).option("basePath", out).parquet(out)
    last = changes.groupBy("digest").agg(F.max_by(F.struct("keep", "first", "group_size"), "batch").alias("state"))
    return last.select("digest", "state.*")


def only(path: str) -> str:
    """A pattern that matches `path` and nothing else: a stream takes a table that is a single file only by a pattern."""
    plain = path.rstrip("/")
    return f"{plain[:-1]}[{plain[-1]}]"


def exact_dedup(
    spark: SparkSession,
    path: str,
    digest=full_digest,
    files_per_batch: int = 64,
    checkpoint: str | None = None,
) -> DataFrame:
    """One row per row of the Parquet table at `path`, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are; null text counts as empty, and all empty texts are
    equal. The longest original text stays (in code points), then the smallest doc_id, a null doc_id
    last; of rows that repeat both, exactly one is kept, by its place in the table. An empty table gives
    no rows. Other columns are not read. `checkpoint` names a folder for the state of a job that goes on.
    """
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(only(path))
    place = checkpoint or scratch_table(spark, "exact-dedup")
    ledger = stream_state(spark, source, digest, f"{place}/state", f"{place}/ledger")

    rows = _rows(spark.read.parquet(path), digest)
    copied = F.col("group_size") > 1
    classed = scratch(
        rows.join(ledger, "digest").select(
            "digest",
            "doc_id",
            "locator",
            "length",
            "group_size",
            F.col("keep.doc_id").alias("keep_id"),
            (F.col("keep.locator") == F.col("locator")).alias("kept"),
            (F.col("first") == F.col("locator")).alias("is_first"),
            F.when(copied, F.col("content")).alias("content"),
            F.sha2("content", 256).alias("text_sha256"),
        ),
        "exact-classes",
    )
    unlike = _unlike_digests(classed)
    if unlike.isEmpty():
        return classed.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return _by_bytes(classed, unlike)


def _unlike_digests(classed: DataFrame) -> DataFrame:
    """Digests of which some hit has other bytes than the located first row."""
    copied = classed.filter(F.col("group_size") > 1)
    groups = (F.col("group_size") / HITS_PER_GROUP).cast("int")
    first = copied.filter("is_first").select(
        "digest", F.explode(F.sequence(F.lit(0), groups)).alias("part"), F.col("content").alias("first_content")
    )
    hits = copied.filter("not is_first").select(
        "digest",
        F.pmod(F.xxhash64("locator"), F.lit(1) + groups).cast("int").alias("part"),
        "content",
    )
    return hits.join(first, ["digest", "part"]).filter("content != first_content").select("digest").distinct()


def _by_bytes(classed: DataFrame, unlike: DataFrame) -> DataFrame:
    """Classes of the colliding digests by full bytes; the others as they are."""
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    apart = classed.join(unlike, "digest", "left_semi")
    groups = apart.groupBy("digest", "content").agg(
        F.min(_preferred()).alias("keep"), F.count(F.lit(1)).alias("size")
    )
    apart = apart.drop("keep_id", "group_size", "kept").join(groups, ["digest", "content"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("keep.locator") == F.col("locator")).alias("kept"),
        "text_sha256",
    )
    return classed.join(unlike, "digest", "left_anti").select(out).unionByName(apart.select(out))
