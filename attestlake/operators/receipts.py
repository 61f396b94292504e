"""Receipts: who ran what on which evidence, and digests of what came out.

A receipt is one row with its header fields, id and seal. Its records are rows of
their own: `receipt_key columns, ordinal, record`, where `ordinal` is an integer that
is unique within the receipt and gives the order (a record number, a position in the
export). Nothing here puts all records of a receipt into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import canonical_json, digest, keyed_seal, lanes, sums_digest, unordered_digest

FAN = 10_000
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

# Header fields, sorted by name. `prev` is added when the chain is linked.
HEADER = (
    "args_canonical",
    "data_digest",
    "image_sha256",
    "model_id",
    "offsets",
    "prev",
    "prompt_hash",
    "raw_digest",
    "run_id",
    "seq",
    "tool_name",
    "tool_version",
    "ts",
)
NO_OFFSETS = "array<struct<start:bigint,length:bigint,artifact_label:string>>"


def canonical_records(df: DataFrame, columns: list[str], name: str = "canonical") -> DataFrame:
    return df.withColumn(name, canonical_json(df, columns))


def data_fingerprint(
    records: DataFrame,
    by: list[str],
    ordinal: str = "ordinal",
    canonical: str = "canonical",
    fan: int = FAN,
    levels: int = 3,
) -> DataFrame:
    """Order-keeping digest of all records per key, as a tree.

    A leaf is the digest of a record's canonical JSON; a node is the digest of its
    children's digests in order, and has at most `fan` of them. Three levels of ten
    thousand reach 10^12 ordinals. The first shuffle carries leaves as 32 bytes each; later ones one row
    per node, which for keys of up to `fan` ordinals is one row per key.
    """
    level = records.select(
        *by, F.col(ordinal).cast("bigint").alias("_at"), F.unhex(digest(F.col(canonical))).alias("_h"),
        F.lit(1).cast("bigint").alias("_n"),
    )
    for step in range(levels):
        last = step == levels - 1
        ordered = F.sort_array(F.collect_list(F.struct("_at", "_h")))
        # the root is grouped by the key alone: a constant beside it would cost joins on the key a shuffle more
        up = [] if last else [F.floor(F.col("_at") / fan).alias("_up")]
        level = level.groupBy(*by, *up).agg(
            F.unhex(digest(F.array_join(F.transform(ordered, lambda x: F.lower(F.hex(x["_h"]))), ""))).alias("_h"),
            F.sum("_n").alias("_n"),
        )
        level = level if last else level.withColumnRenamed("_up", "_at")
    return level.select(*by, F.lower(F.hex("_h")).alias("data_digest"), F.col("_n").alias("row_count"))


def raw_fingerprint(rows: DataFrame, by: list[str], raw: Column) -> DataFrame:
    """Order-free digest of raw source rows; combines on the map side."""
    return rows.select(*by, digest(raw).alias("_h")).groupBy(*by).agg(
        unordered_digest(F.col("_h")).alias("raw_digest")
    )


def fingerprints(
    rows: DataFrame,
    by: list[str],
    canonical: Column,
    raw: Column,
    ordinal: str = "ordinal",
    is_record: Column | None = None,
    is_source: Column | None = None,
    fan: int = FAN,
) -> DataFrame:
    """data_digest, row_count and raw_digest per key: those of `data_fingerprint` and `raw_fingerprint`, in one pass.

    Rows that are not `is_record` do not count for the first, rows that are not `is_source` for the last; a key without any
    has null there. `canonical` and `raw` are expressions: rows are shuffled as they are, by key and stretch of `fan`
    ordinals, and hashed after, as digests do not compress. One more shuffle by the key carries a row per stretch, of
    which a task gets one for up to `fan` records.
    """
    at = F.col(ordinal).cast("bigint")
    spread = rows.withColumn("_up", F.floor(at / fan)).repartition(*by, "_up")
    record, source = (F.lit(True) if c is None else F.coalesce(c, F.lit(False)) for c in (is_record, is_source))
    leaves = spread.select(
        *by, "_up", at.alias("_at"), record.alias("_is"), F.when(record, F.unhex(digest(canonical))).alias("_h"),
        F.when(source, digest(raw)).alias("_raw"), source.alias("_is_source"),
    )
    sums = [f"_s{i}" for i in range(4)]
    listed = F.sort_array(F.collect_list(F.when(F.col("_is"), F.struct("_at", "_h"))))
    node = F.unhex(digest(F.array_join(F.transform(listed, lambda x: F.lower(F.hex(x["_h"]))), "")))
    level = leaves.groupBy(*by, "_up").agg(
        node.alias("_h"), F.count_if("_is").alias("_n"), F.count_if("_is_source").alias("_sources"), F.count("_raw").alias("_m"),
        *[F.sum(lane).alias(s) for s, lane in zip(sums, lanes(F.col("_raw")), strict=True)],
    )
    level = level.withColumnRenamed("_up", "_at").withColumn("_is", F.col("_n") > 0).repartition(*by)
    for up in ([F.floor(F.col("_at") / fan).alias("_up")], []):
        level = level.groupBy(*by, *up).agg(
            node.alias("_h"), *[F.sum(c).alias(c) for c in ("_n", "_sources", "_m", *sums)]
        ).withColumn("_is", F.col("_n") > 0)
        level = level.withColumnRenamed("_up", "_at") if up else level
    return level.select(
        *by,
        F.when(F.col("_is"), F.lower(F.hex("_h"))).alias("data_digest"),
        F.col("_n").alias("row_count"),
        F.when(F.col("_sources") > 0, sums_digest(F.col("_m"), [F.col(s) for s in sums])).alias("raw_digest"),
    )


def mint(meta: DataFrame, fingerprints: DataFrame | None, by: list[str]) -> DataFrame:
    """Header rows before linking: one per row of `meta`.

    `meta` carries run_id, seq, tool_name, tool_version, args_canonical, image_sha256 and
    ts; `fingerprints` the two digests (None: `meta` has them). Runs without records get the digest of nothing.
    `ts` is data, never the clock, so a rerun mints the same ids. Rows whose image hash
    is not 64 lower-case hex digits come out with a `reject_reason`.
    """
    rows = meta if fingerprints is None else meta.join(fingerprints, by, "left")
    for name, kind in (("model_id", "string"), ("prompt_hash", "string"), ("offsets", NO_OFFSETS)):
        if name not in rows.columns:
            empty = F.lit(None).cast(kind) if name != "offsets" else F.array().cast(kind)
            rows = rows.withColumn(name, empty)
    return (
        rows.withColumn("data_digest", F.coalesce("data_digest", F.lit(EMPTY)))
        .withColumn("raw_digest", F.coalesce("raw_digest", F.lit(EMPTY)))
        .withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("bigint")))
        .withColumn(
            "reject_reason",
            F.when(
                F.coalesce(~F.col("image_sha256").rlike("^[0-9a-f]{64}$"), F.lit(True)),
                F.lit("image hash is not 64 hex digits"),
            ).when(F.col("args_canonical").isNull(), F.lit("arguments hold a non-finite number")),
        )
    )


def header_halves(df: DataFrame) -> tuple[Column, Column]:
    """Canonical header text before and after the value of `prev`."""
    place = HEADER.index("prev")
    before = canonical_json(df, list(HEADER[:place]))
    after = canonical_json(df, list(HEADER[place + 1 :]))
    head = F.concat(F.left(before, F.length(before) - 1), F.lit(',"prev":'))
    tail = F.concat(F.lit(","), F.substring(after, 2, 2147483647))
    return head, tail


def prev_json(prev: Column) -> Column:
    return F.when(prev.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), prev, F.lit('"')))


def header_json(df: DataFrame) -> Column:
    head, tail = header_halves(df)
    return F.concat(head, prev_json(F.col("prev")), tail)


def header_id(df: DataFrame) -> Column:
    return digest(header_json(df))


def seal(receipts: DataFrame, key: bytes) -> DataFrame:
    """Adds the keyed seal over the canonical header. The key is part of the plan text."""
    return receipts.withColumn("seal", keyed_seal(header_json(receipts), key))


def seal_fits(receipts: DataFrame, key: bytes) -> Column:
    return F.coalesce(F.col("seal") == keyed_seal(header_json(receipts), key), F.lit(False))


def verify_seal(receipts: DataFrame, key: bytes) -> DataFrame:
    return receipts.select("receipt_id", seal_fits(receipts, key).alias("seal_ok"))


def verify_data(
    receipts: DataFrame, fingerprints: DataFrame, by: list[str]
) -> DataFrame:
    """Recomputed data digest against the one in the header."""
    now = fingerprints.select(*by, F.col("data_digest").alias("_now"))
    return receipts.join(now, by, "left").select(
        "receipt_id",
        (F.coalesce("_now", F.lit(EMPTY)) == F.col("data_digest")).alias("data_ok"),
    )


def list_receipts(receipts: DataFrame, counts: DataFrame | None = None, by=("receipt_id",)) -> DataFrame:
    """Summary of each receipt. `counts`: keys and `row_count`."""
    rows = receipts if counts is None else receipts.join(counts, list(by), "left")
    scope = F.col("scope") if "scope" in receipts.columns else F.col("run_id")
    return rows.select(
        "receipt_id",
        scope.alias("scope"),
        "tool_name",
        "tool_version",
        F.left("image_sha256", F.lit(16)).alias("image_prefix"),
        F.left("raw_digest", F.lit(16)).alias("raw_prefix"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        "prev",
    )


def receipt_sample(
    records: DataFrame, by: list[str], ordinal: str = "ordinal", n: int = 5
) -> DataFrame:
    """The first n records per receipt and its record count.

    The rank filter is applied per task before the shuffle, so a huge receipt sends n
    rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(ordinal))
    firsts = records.withColumn("rank", rank).where(F.col("rank") <= n)
    return firsts.join(records.groupBy(*by).agg(F.count("*").alias("row_count")), by)


def lookup(receipts: DataFrame, ids: DataFrame) -> DataFrame:
    """Receipts by id over all stores; of copies the one in the first store."""
    fields = [n for n in receipts.columns if n != "receipt_id"]
    wanted = receipts.join(ids.select("receipt_id").distinct(), "receipt_id", "left_semi")
    return (
        wanted.groupBy("receipt_id")
        .agg(F.min_by(F.struct(*fields), F.struct("store_rank", "store")).alias("r"))
        .select("receipt_id", "r.*")
    )


def placed_digest(
    rows: DataFrame, key: str, canonical: Column, fan: int = FAN, by: list[str] | None = None
) -> DataFrame:
    """Digest of a whole table, or of each group of it, whatever its order.

    Rows are placed by the hash of their key, so the tree is the same however the table
    was read, and no node holds more than a small share of it.
    """
    place = F.conv(F.substring(F.sha2(F.col(key).cast("binary"), 256), 1, 10), 16, 10)
    groups = [F.col(n) for n in by] if by else [F.lit(0).alias("_table")]
    placed = rows.select(
        *groups, place.cast("bigint").alias("ordinal"), canonical.alias("canonical")
    )
    return data_fingerprint(placed, by or ["_table"], fan=fan).drop("_table")


def pack_digest(files: DataFrame, root: str = "", by: list[str] | None = None) -> DataFrame:
    """Digest of a rule or plugin pack (one per group) from the path and digest of each file."""
    name = F.replace("path", F.lit(root), F.lit("")) if root else F.col("path")
    named = files.withColumn("path", name)
    tree = placed_digest(named, "path", F.concat("path", F.lit("\0"), "sha256"), by=by)
    return tree.select(*(by or []), F.col("data_digest").alias("pack_digest"))


def pack_drift(receipts: DataFrame, packs: DataFrame, argument: str) -> DataFrame:
    """Receipts whose recorded pack digest is not the present one (packs: tool_name, pack_digest)."""
    recorded = F.get_json_object("args_canonical", f"$.{argument}")
    return receipts.join(packs, "tool_name").select(
        "receipt_id",
        "tool_name",
        recorded.alias("recorded"),
        F.col("pack_digest").alias("present"),
        (~recorded.eqNullSafe(F.col("pack_digest"))).alias("drifted"),
    )
