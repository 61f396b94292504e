"""Receipts of filtered tool calls, replayed by their recorded arguments on a source that has changed since."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import severity_rank
from ..functions.fixed import SEARCH_ENCODINGS, SEVERITIES
from ..operators import replay
from ..operators.receipts import EMPTY
from ..operators.replay import Parameter
from ..session import scratch_table, written
from ..sources.artifacts import FILE_TIMES
from . import adapters as ad
from .adapters import text, with_ctes
from .registry import Tables, query
from .search_queries import patterns


def calls(rows: DataFrame, scope: list[str], *kinds: tuple[str, list, dict]) -> DataFrame:
    """A receipt for each distinct call: receipt_id of a letter and key columns, scope, args_canonical.

    `kinds`: letter, key columns, arguments by name.
    """
    out = None
    for letter, keys, args in kinds:
        each = rows.select(F.array(*[k.cast("string") for k in keys]).alias("_keys"), *scope, F.struct(*[v.alias(n) for n, v in args.items()]).alias("_args"))
        named = F.array_join(F.concat(F.array(F.lit(letter)), "_keys"), "/")
        recorded = F.to_json("_args", {"ignoreNullFields": "false"})
        made = each.distinct().select(named.alias("receipt_id"), *scope, recorded.alias("args_canonical")).distinct()
        out = made if out is None else out.unionByName(made)
    return out


def stored(receipts: DataFrame) -> DataFrame:
    """Receipts that are used several times, as a written table."""
    return written(receipts, scratch_table(receipts.sparkSession, "receipts"))


def drifted(receipts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What was minted, and how it compares with the present source."""
    minted = stored(receipts.join(before.where("problem is null").select("receipt_id", "raw_digest"), "receipt_id"))
    found = replay.replay_drift(minted, after, ["receipt_id"])
    return found.join(minted.select("receipt_id", "raw_digest"), "receipt_id")


def _digests_sql(rows: str, raw: str, kinds: tuple[tuple[str, str, str], ...]) -> str:
    lanes = " || '|' || ".join(
        f"CAST(sum(CAST(CAST('0x' || substr(sha256({raw}), {s}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for s in (1, 16, 31, 46)
    )
    return " UNION ALL ".join(
        f"SELECT concat_ws('/', '{letter}', {keys}) AS receipt_id, sha256(count(*) || '|' || {lanes}) AS d FROM {rows}"
        f"{' WHERE ' + where if where else ''} GROUP BY 1"
        for letter, keys, where in kinds
    )


def replay_sql(*needs: str, rows: str, gone: str, raw: str, kinds: tuple[tuple[str, str, str], ...]) -> str:
    """`kinds`: letter, key expressions, condition; `gone` are the rows that the present source lacks."""
    before = _digests_sql(f"({rows})", raw, kinds)
    after = _digests_sql(f"(SELECT * FROM ({rows}) WHERE NOT ({gone}))", raw, kinds)
    now = f"coalesce(a.d, '{EMPTY}')"
    return with_ctes(
        *needs,
        select=f"SELECT b.receipt_id, b.d AS raw_digest, {now} = b.d AS replay_ok, CASE WHEN {now} <> b.d THEN "
        f"'raw digest changed: was ' || substr(b.d, 1, 16) || ', is ' || substr({now}, 1, 16) END AS replay_reason "
        f"FROM ({before}) b LEFT JOIN ({after}) a USING (receipt_id)",
    )


def nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


EVENT_PARAMETERS = [
    Parameter("user_sid", "is", "user_sid"),
    Parameter("event_ids", "one of", "event_id"),
    Parameter("channel", "is", "channel"),
    Parameter("time_range", "start", "ts"),
    Parameter("time_range", "end", "ts"),
]


@query(
    "rcp08_replay_event_log",
    replay_sql(
        "event_log",
        rows="SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM event_log",
        gone="hash_key % 11 = 0 AND record_number % 2 = 0".replace("hash_key", "CAST(substr(user_sid, 10) AS BIGINT)"),
        raw="concat_ws('|', record_number, event_id, channel, user_sid)",
        kinds=(
            ("ids-in-day", "host, event_id, day", ""),
            ("day", "host, day", ""),
            ("sid-and-channel", "host, user_sid, channel", ""),
            ("all", "host", ""),
        ),
    ),
)
def replay_event_log(t: Tables):
    """Event ids within a day, a day alone, one user's events in a channel, and no filter at all."""
    log = ad.event_log(t).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    day = F.array(text(F.col("day"), " 00:00:00"), text(F.col("day"), " 23:59:59.999999"))
    host, ids, sid, channel = F.col("host"), F.array("event_id"), F.col("user_sid"), F.col("channel")
    no_ids = F.array().cast("array<int>")
    receipts = calls(
        log,
        ["host"],
        ("ids-in-day", [host, F.col("event_id"), F.col("day")], {"event_ids": ids, "time_range": day}),
        ("day", [host, F.col("day")], {"event_ids": no_ids, "time_range": day, "channel": F.lit("")}),
        ("sid-and-channel", [host, sid, channel], {"user_sid": sid, "channel": channel, "time_range": nothing("array<string>")}),
        ("all", [host], {"event_ids": no_ids}),
    )
    raw = F.concat_ws("|", "record_number", "event_id", "channel", "user_sid")
    left = log.where(~((F.substring("user_sid", 10, 20).cast("bigint") % 11 == 0) & (F.col("record_number") % 2 == 0)))
    receipts = stored(receipts)
    again = lambda source: replay.replay_filtered(receipts, source, EVENT_PARAMETERS, ["host"], raw)
    return drifted(receipts, again(log), again(left))


JOURNAL_PARAMETERS = [
    Parameter("reasons", "overlaps", "update_reasons"),
    Parameter("path", "text", "full_path"),
    Parameter("since", "from", "ts", nulls_pass=True),
]


@query(
    "rcp08_replay_journal",
    replay_sql(
        "change_journal",
        rows="SELECT * FROM (SELECT *, unnest(update_reasons) AS reason FROM change_journal)",
        gone="usn % 97 = 5 AND file_record_number % 3 = 0",
        raw="concat_ws('|', usn, full_path)",
        kinds=(
            ("reasons-since", "host, reason", "ts >= TIMESTAMP '2024-01-10'"),
            ("reasons-and-path", "host, reason", "contains(lower(full_path), 'prog7')"),
        ),
    ),
)
def replay_journal(t: Tables):
    """Reasons since a day, and reasons within a path; a reason is also asked for together with one that never occurs."""
    journal = ad.change_journal(t)
    each = journal.withColumn("reason", F.explode("update_reasons"))
    reason, reasons = F.col("reason"), F.array("reason", F.lit("NoSuchReason"))
    since = each.where("ts >= timestamp'2024-01-10'")
    in_path = each.where("contains(lower(full_path), 'prog7')")
    receipts = calls(
        since, ["host"], ("reasons-since", [F.col("host"), reason], {"reasons": reasons, "since": F.lit("2024-01-10 00:00:00")})
    ).unionByName(calls(in_path, ["host"], ("reasons-and-path", [F.col("host"), reason], {"reasons": reasons, "path": F.lit("PROG7")})))
    left = journal.where("NOT (usn % 97 = 5 AND file_record_number % 3 = 0)")
    raw = F.concat_ws("|", "usn", "full_path")
    receipts = stored(receipts)
    again = lambda source: replay.replay_filtered(receipts, source, JOURNAL_PARAMETERS, ["host"], raw)
    return drifted(receipts, again(journal), again(left))


@query(
    "rcp08_replay_file_table",
    replay_sql(
        "file_entries",
        rows="SELECT *, string_split(full_path, '\\')[2] AS folder, greatest(si_created, si_modified, fn_created, "
        "fn_modified) AS newest FROM file_entries",
        gone="entry_number % 1000 = 7",
        raw="concat_ws('|', entry_number, full_path)",
        kinds=(
            ("path-since", "folder", "newest >= TIMESTAMP '1996-06-01'"),
            ("path", "folder", ""),
        ),
    ),
)
def replay_file_table(t: Tables):
    """Files of a folder, and those of them that were active since a day."""
    files = ad.file_entries(t).withColumn("newest", F.greatest(*FILE_TIMES)).withColumn("scope", F.lit("image"))
    named = files.withColumn("folder", F.get(F.split("full_path", r"\\"), F.lit(1)))
    folder, path = F.col("folder"), text("\\", F.upper("folder"), "\\")
    recent = named.where("newest >= timestamp'1996-06-01'")
    receipts = calls(named, ["scope"], ("path", [folder], {"path": path, "since": nothing("string")})).unionByName(
        calls(recent, ["scope"], ("path-since", [folder], {"path": path, "since": F.lit("1996-06-01")}))
    )
    parameters = [Parameter("path", "text", "full_path"), Parameter("since", "from", "newest")]
    raw = F.concat_ws("|", "entry_number", "full_path")
    receipts = stored(receipts)
    again = lambda source: replay.replay_filtered(receipts, source, parameters, ["scope"], raw)
    return drifted(receipts, again(files), again(files.where("entry_number % 1000 <> 7")))


def severity(level: Column) -> Column:
    return severity_rank(level)


RULE_PARAMETERS = [
    Parameter("techniques", "overlaps", "mitre_techniques"),
    Parameter("min_level", "from", "severity", severity),
]


@query(
    "rcp08_replay_rule_hits",
    replay_sql(
        "rule_hits",
        rows="SELECT *, list_position(['" + "', '".join(SEVERITIES) + "'], level) - 1 AS severity FROM rule_hits",
        gone="record_id % 501 = 3",
        raw="concat_ws('|', record_id, level, rule_title)",
        kinds=(
            ("lateral-high", "host", "severity >= 3 AND list_has_any(mitre_techniques, ['T1550.002', 'T1021.002', 'T1110'])"),
            ("low", "host", "severity >= 1"),
        ),
    ),
)
def replay_rule_hits(t: Tables):
    """Rules of some techniques from a severity on (several of them in one row), and a severity alone."""
    rules = ad.rule_hits(t).withColumn("severity", severity_rank(F.col("level")))
    techniques = F.array(*map(F.lit, ("T1550.002", "T1021.002", "T1110")))
    high = rules.where((F.col("severity") >= 3) & F.arrays_overlap("mitre_techniques", techniques))
    low = rules.where("severity >= 1")
    receipts = calls(high, ["host"], ("lateral-high", [F.col("host")], {"techniques": techniques, "min_level": F.lit("High")})).unionByName(
        calls(low, ["host"], ("low", [F.col("host")], {"techniques": nothing("array<string>"), "min_level": F.lit("low")}))
    )
    raw = F.concat_ws("|", "record_id", "level", "rule_title")
    receipts = stored(receipts)
    again = lambda source: replay.replay_filtered(receipts, source, RULE_PARAMETERS, ["host"], raw)
    return drifted(receipts, again(rules), again(rules.where("record_id % 501 <> 3")))


_HIT_JSON = (
    "'{\"deleted\":' || deleted || ',\"file_size_bytes\":' || file_size_bytes || ',\"filename\":\"' || filename || "
    "'\",\"first_match_offset\":' || first_match_offset || ',\"image\":\"' || image || '\",\"inode\":' || inode || "
    "',\"total_match_count\":' || total_match_count || '}'"
)


@query(
    "rcp08_replay_search",
    replay_sql(
        "hits",
        rows="SELECT * REPLACE (least(total_match_count, CASE WHEN kind = 'live' THEN 3 ELSE 1000000 END) AS total_match_count) "
        "FROM hits, (VALUES ('live'), ('named')) AS v(kind) WHERE pattern_id IN ('p1', 'p4', 'p6') AND CASE WHEN "
        "kind = 'live' THEN NOT deleted ELSE contains(lower(filename), '.html') END",
        gone="inode % 13 = 4",
        raw=_HIT_JSON,
        kinds=(("live", "pattern_id, image", "kind = 'live'"), ("named", "pattern_id, image", "kind = 'named'")),
    ),
)
def replay_search(t: Tables):
    """Searches in live files, counts cut, and in files by name, in other encodings; some files are gone since."""
    files = ad.files(t)
    live = F.to_json(F.struct(F.col("text").alias("pattern"), F.lit(False).alias("include_deleted"), F.lit(3).alias("max_matches_per_file")))
    named = F.to_json(
        F.struct(F.col("text").alias("pattern"), F.lit(".HTML").alias("name_substring"), F.array(*map(F.lit, SEARCH_ENCODINGS)).alias("encodings"))
    )
    images = F.explode(F.array(F.lit("ss-win"), F.lit("ss-unix")))
    asked = patterns(t, "p1", "p4", "p6").withColumn("image", images)
    each = asked.select("pattern_id", "image", F.explode(F.array(F.struct(F.lit("live").alias("kind"), live.alias("args")), F.struct(F.lit("named").alias("kind"), named.alias("args")))).alias("c"))
    receipts = each.select(
        F.concat_ws("/", "c.kind", "pattern_id", "image").alias("receipt_id"), "image", F.col("c.args").alias("args_canonical")
    )
    before, after = replay.replay_search(receipts, files), replay.replay_search(receipts, files.where("inode % 13 <> 4"))
    # Searches without any hit have the digest of nothing; the others are compared.
    return drifted(receipts, before.where(F.col("raw_digest") != EMPTY), after)


@query(
    "rcp14_failures_while_running",
    with_ctes(
        "meta",
        select="SELECT receipt_id, reason IS NULL AS replay_ok, reason AS replay_reason FROM (SELECT run_id || '/' || seq "
        "AS receipt_id, CASE WHEN seq % 6 = 5 THEN 'replay failed: ValueError: no day ' || seq WHEN seq % 6 = 4 THEN "
        "'raw digest changed: was ' || substr(sha256('?' || args_canonical), 1, 16) || ', is ' || "
        "substr(sha256(args_canonical), 1, 16) END AS reason FROM meta WHERE tool_name IN ('parse_evtx', 'parse_mft')) "
        "UNION ALL SELECT run_id || '/' || seq, false, CASE tool_name WHEN 'run_hayabusa' THEN 'replay failed: "
        "ArithmeticException' ELSE 'no replay for this tool' END FROM meta WHERE tool_name NOT IN ('parse_evtx', 'parse_mft')",
    ),
)
def failures_while_running(t: Tables):
    """Two tools replayed by a function of one receipt that fails for some days, and one whose plan fails as it runs."""
    recorded = F.sha2(F.concat(F.when(F.col("seq") % 6 == 4, "?").otherwise(""), "args_canonical").cast("binary"), 256)
    made = ad.short_chain(t).withColumn("raw_digest", recorded)

    def again(receipt: dict) -> str:
        day = json.loads(receipt["args_canonical"])["day"]
        if day % 6 == 5:
            raise ValueError(f"no day {day}")
        return hashlib.sha256(receipt["args_canonical"].encode()).hexdigest()

    def breaks(receipts: DataFrame) -> DataFrame:
        ratio = F.lit(1) / (F.length("run_id") - F.length("run_id"))  # an error that only running it shows
        return receipts.select("receipt_id", (ratio > 0).alias("replay_ok"), F.lit("never").alias("replay_reason"))

    table = replay.ReplayTable()
    table.register_each("parse_evtx", again)
    table.register_each("parse_mft", again)
    table.register("run_hayabusa", breaks)
    return table.check(made, apart=True)
