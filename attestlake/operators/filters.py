"""Filters per artifact table. Options that are not given do not filter."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import contains_ci, severity_rank
from ..functions.fixed import SEVERITIES
from ..sources.artifacts import FILE_TIMES


def _all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    given = [cond for cond in conditions if cond is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def _one_of(column: str, values: Iterable | None) -> Column | None:
    return None if values is None else F.col(column).isin(*values)


def _any_of(column: str, values: Iterable | None) -> Column | None:
    """As `_one_of`, but an empty list is no condition."""
    values = None if values is None else list(values)
    return _one_of(column, values) if values else None


def _overlaps(column: str, values: Iterable[str] | None) -> Column | None:
    if not values:
        return None
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values]))


def moment(df: DataFrame, column: str, value) -> Column:
    """The literal in the column's own type, so that the comparison reaches the scan."""
    return F.lit(value).cast(df.schema[column].dataType)


def _from(df: DataFrame, column: str, start) -> Column | None:
    return None if start is None else F.col(column) >= moment(df, column, start)


def _until(df: DataFrame, column: str, end) -> Column | None:
    return None if end is None else F.col(column) <= moment(df, column, end)


def event_filter(
    df: DataFrame, event_ids=None, start=None, end=None, channel=None, user_sid=None
) -> DataFrame:
    return _all(
        df,
        _one_of("event_id", event_ids),
        _from(df, "ts", start),
        _until(df, "ts", end),
        None if channel is None else F.col("channel") == channel,
        None if user_sid is None else F.col("user_sid") == user_sid,
    )


def path_contains(df: DataFrame, text: str, column: str = "full_path") -> DataFrame:
    return df.where(contains_ci(F.col(column), text))


def active_since(df: DataFrame, since) -> DataFrame:
    """Newest of the eight file times at or after `since`; files without times drop out."""
    return df.where(F.greatest(*FILE_TIMES) >= moment(df, "si_created", since))


def journal_filter(df: DataFrame, reasons=None, since=None, path=None) -> DataFrame:
    """Rows without a timestamp pass the time condition."""
    recent = None if since is None else F.col("ts").isNull() | _from(df, "ts", since)
    inside = None if path is None else contains_ci(F.col("full_path"), path)
    return _all(df, _overlaps("update_reasons", reasons), recent, inside)


def program_filter(df: DataFrame, sha1s=None, name: str | None = None) -> DataFrame:
    """`sha1s`: a list, or a DataFrame with a `sha1` column; a list is made one, of whatever length.

    An empty list is no condition, an empty DataFrame matches nothing.
    """
    if sha1s is not None and not isinstance(sha1s, DataFrame):
        rows = [(s,) for s in sha1s if s.strip()]
        sha1s = df.sparkSession.createDataFrame(rows, "sha1 string") if rows else None
    if sha1s is not None:
        wanted = sha1s.select(F.lower(F.trim("sha1")).alias("sha1")).distinct()
        df = df.join(wanted, "sha1", "left_semi").select(df.columns)
    return df if name is None else df.where(contains_ci(F.col("name"), name))


def execution_filter(df: DataFrame, name: str) -> DataFrame:
    either = contains_ci(F.col("executable_name"), name) | contains_ci(
        F.col("source_filename"), name
    )
    return df.where(either)


def plugin_filter(df: DataFrame, plugins) -> DataFrame:
    return _all(df, _any_of("plugin", plugins))


def severity_technique(df: DataFrame, min_level: str | None = None, techniques=None) -> DataFrame:
    floor = None
    if min_level is not None:
        floor = severity_rank(F.col("level")) >= SEVERITIES.index(min_level.lower())
    return _all(df, floor, _overlaps("mitre_techniques", techniques))


def timeline_filter(
    df: DataFrame, start=None, end=None, sources=None, parsers=None, text: str | None = None
) -> DataFrame:
    return _all(
        df,
        _from(df, "ts", start),
        _until(df, "ts", end),
        _any_of("source_short", sources),
        _any_of("parser_name", parsers),
        None if text is None else contains_ci(F.col("description"), text),
    )


def search_prefilter(
    df: DataFrame,
    name: str | None = None,
    include_deleted: bool = True,
    max_bytes: int | None = None,
) -> DataFrame:
    """Runs on the listing, so content of files that drop out is never read.

    There is no size limit unless `max_bytes` gives one; `search_skipped` lists what it leaves out.
    """
    return _all(
        df,
        None if include_deleted else ~F.col("deleted"),
        None if name is None else contains_ci(F.col("filename"), name),
        F.col("file_size_bytes") > 0,
        None if max_bytes is None else F.col("file_size_bytes") <= max_bytes,
    )


def search_skipped(
    df: DataFrame, max_bytes: int, name: str | None = None, include_deleted: bool = True
) -> DataFrame:
    """The files that only the size limit keeps out of a search, with the reason."""
    rows = search_prefilter(df, name, include_deleted).where(F.col("file_size_bytes") > max_bytes)
    return rows.withColumn("skipped", F.lit(f"larger than {max_bytes} bytes"))


def question_filter(df: DataFrame, image_sha256: str | None = None, techniques=None) -> DataFrame:
    """Questions bound to an image, and tagged with any of the techniques (none given: all)."""
    bound = None
    if image_sha256 is not None:
        bound = F.lower("image_sha256") == image_sha256.lower()
    return _all(df, bound, _overlaps("mitre_techniques", techniques))
