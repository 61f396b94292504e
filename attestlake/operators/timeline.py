"""One timeline over all artifact tables, and correlation in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import micros
from ..sources.artifacts import FILE_TIMES
from .filters import timeline_filter

COLUMNS = (
    "host",
    "ts",
    "timestamp_desc",
    "source_short",
    "parser_name",
    "description",
    "artifact_path",
    "record_key",
)


SALT_TYPES = ("string", "long", "integer", "timestamp", "timestamp_ntz", "boolean")


def _shape(df: DataFrame, ts, desc, source, parser, description, path, key) -> DataFrame:
    host = F.col("host") if "host" in df.columns else F.lit(None).cast("string")
    values = (host, ts, F.lit(desc) if isinstance(desc, str) else desc, F.lit(source),
              F.lit(parser), description, path, key.cast("string"))
    return df.select(*[v.alias(n) for v, n in zip(values, COLUMNS)]).where(F.col("ts").isNotNull())


def from_event_log(df: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", F.lit("event"), F.col("event_id").cast("string"), "user_name")
    return _shape(df, F.col("ts"), "Event", "EVT", "event_log", text,
                  F.lit(None).cast("string"), F.col("record_number"))


def from_file_entries(df: DataFrame) -> DataFrame:
    """One row per file time."""
    pairs = F.array(*[F.struct(F.lit(n).alias("d"), F.col(n).alias("t")) for n in FILE_TIMES])
    stacked = df.select("*", F.inline(pairs))
    return _shape(stacked, F.col("t"), F.col("d"), "FILE", "file_entries",
                  F.col("full_path"), F.col("full_path"), F.col("entry_number"))


def from_change_journal(df: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "file_name", F.array_join("update_reasons", "|"))
    return _shape(df, F.col("ts"), "Change", "FILE", "change_journal", text,
                  F.col("full_path"), F.col("usn"))


def from_execution_history(df: DataFrame) -> DataFrame:
    return _shape(df, F.col("last_run"), "Last run", "LOG", "execution_history",
                  F.col("executable_name"), F.col("source_filename"), F.col("hash"))


def from_registry(df: DataFrame) -> DataFrame:
    return _shape(df, F.col("last_write_ts"), "Last write", "REG", "registry_findings",
                  F.concat_ws(" ", "plugin", "value_name"), F.col("key_path"),
                  F.col("value_name"))


def from_rule_hits(df: DataFrame) -> DataFrame:
    return _shape(df, F.col("ts"), "Rule hit", "EVT", "rule_hits", F.col("rule_title"),
                  F.lit(None).cast("string"), F.col("record_id"))


def supertimeline(*parts: DataFrame) -> DataFrame:
    """All parts as one table. Not sorted: order it by (ts, parser_name) when writing,
    where Spark range-partitions."""
    return reduce(DataFrame.unionByName, parts)


def write_sorted(timeline: DataFrame, path: str, partitions: int | None = None) -> None:
    order = ["ts", "parser_name"]
    spread = (
        timeline.repartitionByRange(partitions, *order)
        if partitions
        else timeline.repartitionByRange(*order)
    )
    spread.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def events_in_window(df: DataFrame, start, end) -> DataFrame:
    return timeline_filter(df, start, end)


def correlate_around(df: DataFrame, anchor: str, before_s: int = 30, after_s: int = 30) -> DataFrame:
    """Events within the window of one anchor time; an unreadable anchor gives no rows."""
    at = F.try_to_timestamp(F.lit(anchor)).cast(df.schema["ts"].dataType)
    low = at - F.make_dt_interval(secs=F.lit(before_s))
    high = at + F.make_dt_interval(secs=F.lit(after_s))
    return df.where(F.col("ts").between(low, high))


def correlate_anchors(
    events: DataFrame,
    anchors: DataFrame,
    before_s: int = 30,
    after_s: int = 30,
    same: list[str] | None = None,
    salt: int = 1,
) -> DataFrame:
    """Pairs of anchor and event within the anchor's window, per anchor in a table.

    Time is cut into buckets at least one window wide: an event lies in one bucket, an
    anchor reaches into two or three, and the join is an equality on the bucket. `salt`
    spreads a crowded bucket: events draw one of `salt` values from their own content,
    anchors are repeated for each. Anchor columns come out with the prefix `anchor_`.
    """
    same = same or []
    width = max(before_s + after_s, 1) * 1_000_000
    at, t = micros(F.col("anchor_ts")), micros(F.col("ts"))
    renamed = anchors.select(
        *[F.col(n).alias(n if n in same else f"anchor_{n}") for n in anchors.columns]
    )
    reach = F.sequence(
        F.floor((at - before_s * 1_000_000) / width), F.floor((at + after_s * 1_000_000) / width)
    )
    left = (
        renamed.where(at.isNotNull())
        .withColumn("_bucket", F.explode(reach))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    )
    plain = [f.name for f in events.schema.fields if f.dataType.typeName() in SALT_TYPES]
    spread: Column = F.pmod(F.xxhash64(*plain), F.lit(salt)).cast("int")
    right = events.withColumn("_bucket", F.floor(t / width)).withColumn(
        "_salt", spread if salt > 1 else F.lit(0)
    )
    inside = (t >= at - before_s * 1_000_000) & (t <= at + after_s * 1_000_000)
    return right.join(left, [*same, "_bucket", "_salt"]).where(inside).drop("_bucket", "_salt")
