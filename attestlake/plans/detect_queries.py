"""Detectors and timelines over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as c
from ..operators import detectors as det
from ..operators import timeline as tml
from . import adapters as ad
from .adapters import cte, with_ctes
from .registry import Tables, query


def us(name: str, alias: str):
    return c.micros(F.col(name)).alias(alias)


def sql_us(name: str, alias: str) -> str:
    return f"CAST(epoch_us({name}) AS BIGINT) AS {alias}"


@query(
    "det01_timestomp",
    with_ctes(
        "file_entries",
        select=f"SELECT entry_number, {sql_us('fn_created', 'fn_us')} FROM file_entries WHERE "
        "epoch_us(fn_created) - epoch_us(si_created) > 5000000",
    ),
)
def det01(t: Tables):
    return det.timestomp(ad.file_entries(t)).select("entry_number", us("fn_created", "fn_us"))


@query(
    "det02_deletions",
    with_ctes(
        "change_journal",
        select="SELECT usn, list_contains(update_reasons, 'FileDelete') AS is_deletion FROM change_journal "
        "WHERE list_has_any(update_reasons, ['FileDelete', 'RenameNewName', 'RenameOldName', "
        "'DataOverwrite', 'NamedDataOverwrite'])",
    ),
)
def det02(t: Tables):
    rows = det.anti_forensic(ad.change_journal(t))
    deleted = det.deletions(rows).select("usn", F.lit(True).alias("is_deletion"))
    others = rows.where(~F.array_contains("update_reasons", "FileDelete"))
    return deleted.unionByName(others.select("usn", F.lit(False).alias("is_deletion")))


@query(
    "det03_rename_pairs",
    with_ctes(
        "change_journal",
        select="SELECT host, file_record_number, arg_min(file_name, (ts, usn)) FILTER (o) AS old_name, "
        "arg_min(file_name, (ts, usn)) FILTER (n) AS new_name, arg_min(usn, (ts, usn)) FILTER (o) AS "
        "old_usn, arg_min(usn, (ts, usn)) FILTER (n) AS new_usn FROM (SELECT *, "
        "list_contains(update_reasons, 'RenameOldName') AS o, list_contains(update_reasons, "
        "'RenameNewName') AS n FROM change_journal) GROUP BY host, file_record_number, "
        "file_record_sequence_number HAVING bool_or(o) AND bool_or(n)",
    ),
)
def det03(t: Tables):
    return det.rename_pairs(ad.change_journal(t)).select(
        "host", "file_record_number", "old_name", "new_name", "old_usn", "new_usn"
    )


@query(
    "det04_persistence",
    with_ctes(
        "registry",
        select="SELECT host, plugin, value_name FROM registry WHERE plugin IN ('RunKeys', 'RunOnce', "
        "'Services', 'TaskCache', 'UserAssist', 'ShimCache', 'AppCompatCache', 'BAM', "
        "'WinlogonShellRunOnce')",
    ),
)
def det04(t: Tables):
    return det.persistence(ad.registry(t)).select("host", "plugin", "value_name")


@query(
    "det05_hidden_tasks",
    with_ctes(
        "registry",
        select="SELECT host, value_name, value_data FROM registry WHERE plugin = 'TaskCache' AND "
        "regexp_matches(lower(value_data), 'orphan|missing|no-sd')",
    ),
)
def det05(t: Tables):
    return det.hidden_tasks(ad.registry(t)).select("host", "value_name", "value_data")


@query(
    "det06_lateral_rule_hits",
    with_ctes(
        "rule_hits",
        select="SELECT record_id, level, rule_title FROM rule_hits WHERE level IN ('medium', 'high', "
        "'critical') AND list_has_any(mitre_techniques, ['T1550.002', 'T1021.002', 'T1110'])",
    ),
)
def det06(t: Tables):
    return det.lateral_hits(ad.rule_hits(t)).select("record_id", "level", "rule_title")


CREDENTIAL_NAMES = (
    "C:\\Windows\\System32\\config\\SAM",
    "C:\\Windows\\NTDS\\ntds.dit",
    "C:\\Users\\u\\AppData\\Roaming\\Microsoft\\Protect\\S-1\\0a1b2c3d-0000-1111-2222-0123456789ab",
    "C:\\Users\\u\\AppData\\Chrome\\Login Data",
    "C:\\Temp\\lsass_1.DMP",
    "C:\\hiberfil.sys",
    "C:\\pagefile.sys",
    "C:\\Windows\\MEMORY.DMP",
    "/home/u/.ssh/id_rsa",
    "/home/u/.ssh/known_hosts",
    "/etc/ssh/ssh_host_rsa_key",
    "C:\\Users\\u\\NTUSER.DAT",
)
CREDENTIAL_HITS = (
    "registry_hive", "ntds_dit", "dpapi_master_key", "browser_credential_db", "lsass_dump",
    "hibernation_file", "pagefile", "kernel_crash_dump", "ssh_private_key", "ssh_known_hosts",
    "ssh_host_key", "registry_hive",
)


@query(
    "det07_credential_files",
    "SELECT doc_id AS inode, "
    + ad.pick_sql("doc_id % 13", dict(enumerate(CREDENTIAL_HITS)))
    + " AS artifact_class, sha256(text) AS sha256 FROM documents WHERE doc_id % 13 < 12",
)
def det07(t: Tables):
    listing = t.documents.select(
        F.col("doc_id").alias("inode"),
        ad.pick(F.col("doc_id") % 13, dict(enumerate(CREDENTIAL_NAMES)), "notes.txt").alias(
            "filename"
        ),
    )
    # As on a disk, names are digested as often as they occur; host stands for the directory.
    listing = listing.withColumn("host", F.col("inode").cast("string"))
    digests = t.documents.select(
        F.col("doc_id").cast("string").alias("host"),
        ad.pick(F.col("doc_id") % 13, dict(enumerate(CREDENTIAL_NAMES)), "notes.txt").alias("filename"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
    )
    return det.credential_files(listing, digests).select("inode", "artifact_class", "sha256")


MEMORY = (
    "SELECT event_id, 'windows.' || CASE event_id % 3 WHEN 0 THEN 'pslist.PsList' WHEN 1 THEN "
    "'lsadump.Lsadump' ELSE 'handles.Handles' END AS plugin, user_id, event_type, k, host FROM ev"
)
cte("memory", MEMORY, "ev")


def memory(t: Tables):
    row = F.struct(
        F.col("user_id").alias("PID"),
        F.col("k").alias("PPID"),
        F.col("event_type").alias("ImageFileName"),
        F.concat(F.lit("K"), F.col("event_id").cast("string")).alias("Key"),
        F.col("props").alias("Secret"),
        F.when(F.col("k") % 2 == 0, "\\Device\\LSASS.exe").otherwise("other").alias("Name"),
        F.when(F.col("k") % 3 == 0, "PROCESS_VM_READ | PROCESS_QUERY_INFORMATION")
        .otherwise("SYNCHRONIZE")
        .alias("GrantedAccess"),
        F.when(F.col("event_type") == "click", "MsMpEng.exe").otherwise("Tool.exe").alias("Process"),
    )
    plugin = ad.pick(
        F.col("event_id") % 3,
        {0: "windows.pslist.PsList", 1: "windows.lsadump.Lsadump", 2: "windows.handles.Handles"},
    )
    return ad.events(t).select(
        "host", plugin.alias("plugin"), F.to_variant_object(row).alias("data")
    )


@query(
    "det08_plugin_rows",
    with_ctes(
        "memory",
        select="SELECT host, user_id AS pid, k AS ppid, event_type AS image_file_name FROM memory "
        "WHERE plugin = 'windows.pslist.PsList'",
    ),
)
def det08(t: Tables):
    return det.processes(memory(t)).select("host", "pid", "ppid", "image_file_name")


@query(
    "det08_secrets",
    with_ctes(
        "memory",
        select="SELECT host, plugin, 'K' || event_id AS key, '{\"k\": ' || k || '}' AS secret FROM memory "
        "WHERE plugin = 'windows.lsadump.Lsadump'",
    ),
)
def det08_secrets(t: Tables):
    return det.secrets(memory(t))


@query(
    "det09_network_logon_without_interactive",
    with_ctes(
        "event_log",
        "inventory",
        select=f"SELECT record_number, user_name, host, {sql_us('ts', 'ts_us')} FROM event_log e WHERE "
        "event_id = 4624 AND logon_type = 3 AND auth_package = 'NTLM' AND NOT EXISTS (SELECT 1 FROM "
        "event_log i WHERE i.event_id = 4624 AND i.logon_type = 2 AND i.user_name = e.user_name AND "
        "i.host = e.host AND i.ts < e.ts) AND host IN (SELECT host FROM inventory WHERE "
        "regexp_matches(name, '[\\\\]prog(1|11|21|3|13|5|15)[.]exe$'))",
    ),
)
def det09(t: Tables):
    tools = [f"prog{i}.exe" for i in (1, 11, 21, 3, 13, 5, 15)]
    hits = det.network_logon_without_interactive(ad.event_log(t), ad.inventory(t), tools)
    return hits.select("record_number", "user_name", "host", us("ts", "ts_us"))


@query(
    "det10_log_clearing",
    with_ctes(
        "event_log",
        select=f"SELECT host, record_number, {sql_us('ts', 'ts_us')} FROM event_log WHERE event_id = 1102",
    ),
)
def det10(t: Tables):
    return det.log_clear(ad.event_log(t)).select("host", "record_number", us("ts", "ts_us"))


@query(
    "det10_record_gaps",
    with_ctes(
        "event_log",
        select="SELECT host, channel, prev AS prev_record_number, record_number, record_number - prev - 1 "
        "AS missing, coalesce(ts < prev_ts, false) AS time_goes_back FROM (SELECT host, channel, ts, "
        "record_number, lag(record_number) OVER w AS prev, lag(ts) OVER w AS prev_ts FROM (SELECT "
        "host, channel, record_number, CASE WHEN record_number % 50 = 0 THEN ts - INTERVAL 40 DAY ELSE ts "
        "END AS ts FROM event_log) WINDOW w AS (PARTITION BY host, channel ORDER BY record_number)) "
        "WHERE record_number - prev > 1 OR ts < prev_ts",
    ),
)
def det10_gaps(t: Tables):
    moved = F.when(
        F.col("record_number") % 50 == 0, F.timestamp_add("DAY", F.lit(-40), F.col("ts"))
    ).otherwise(F.col("ts"))
    return det.record_gaps(ad.event_log(t).withColumn("ts", moved), width=1000)


@query(
    "det11_lsass_handles",
    with_ctes(
        "memory",
        select="SELECT host, user_id AS pid, 'tool.exe' AS process FROM memory WHERE "
        "plugin = 'windows.handles.Handles' AND k % 2 = 0 AND k % 3 = 0 AND event_type <> 'click'",
    ),
)
def det11(t: Tables):
    return det.lsass_handles(memory(t)).select("host", "pid", "process")


@query(
    "det12_run_keys",
    with_ctes(
        "registry",
        "inventory",
        select="SELECT r.host, value_name, k3 AS user_writable, coalesce(NOT signed, false) AS unsigned "
        "FROM (SELECT *, contains(value_data, 'AppData') AS k3, lower(regexp_extract(value_data, "
        "'[A-Z]:[^\"]*[.]exe')) AS program_path FROM registry WHERE plugin = 'RunKeys') r LEFT JOIN "
        "(SELECT host, lower(full_path) AS program_path, bool_or(is_os_component) AS signed FROM "
        "inventory GROUP BY 1, 2) p ON r.host = p.host AND r.program_path = p.program_path "
        "WHERE k3 OR NOT signed",
    ),
)
def det12(t: Tables):
    programs = ad.inventory(t)
    return det.run_keys(ad.registry(t), programs).select(
        "host", "value_name", "user_writable", "unsigned"
    )


@query(
    "det13_existed_ran_deleted",
    with_ctes(
        "inventory",
        "executions",
        "change_journal",
        select="SELECT i.host, i.program, sha1, run_count, " + sql_us("last_run", "last_run_us") + ", "
        + sql_us("deleted_at", "deleted_us") + " FROM (SELECT host, "
        "lower(regexp_extract(name, '([^\\\\]*)$', 1)) AS program, min(sha1) AS sha1 FROM inventory "
        "GROUP BY 1, 2) i JOIN (SELECT host, executable_name AS program, max(last_run) AS last_run, "
        "CAST(sum(run_count) AS BIGINT) AS run_count FROM executions GROUP BY 1, 2) x USING (host, "
        "program) JOIN (SELECT host, file_name AS program, max(ts) AS deleted_at FROM change_journal "
        "WHERE list_contains(update_reasons, 'FileDelete') GROUP BY 1, 2) j USING (host, program) "
        "WHERE deleted_at >= last_run",
    ),
)
def det13(t: Tables):
    rows = det.existed_ran_deleted(ad.inventory(t), ad.executions(t), ad.change_journal(t))
    return rows.select(
        "host", "program", "sha1", "run_count", us("last_run", "last_run_us"),
        us("deleted_at", "deleted_us"),
    )


# --- timelines ------------------------------------------------------------------------


@query(
    "tml01_supertimeline",
    with_ctes(
        "event_log",
        "change_journal",
        "file_entries",
        "executions",
        "registry",
        "rule_hits",
        select="SELECT host, parser_name, timestamp_desc, source_short, description, artifact_path, record_key, "
        + sql_us("ts", "ts_us") + " FROM ("
        "SELECT host, 'event_log' AS parser_name, 'Event' AS timestamp_desc, 'EVT' AS source_short, 'event ' || event_id || "
        "' ' || user_name AS description, NULL AS artifact_path, CAST(record_number AS VARCHAR) AS record_key, ts FROM event_log UNION ALL "
        "SELECT host, 'change_journal', 'Change', 'FILE', file_name || ' ' || array_to_string(update_reasons, '|'), full_path, "
        "CAST(usn AS VARCHAR), ts FROM change_journal UNION ALL "
        + " UNION ALL ".join(
            f"SELECT NULL, 'file_entries', '{x}', 'FILE', full_path, full_path, CAST(entry_number AS VARCHAR), {x} FROM file_entries"
            for x in ("si_created", "si_modified", "fn_created", "fn_modified")
        )
        + " UNION ALL SELECT host, 'execution_history', 'Last run', 'LOG', executable_name, source_filename, hash, last_run "
        "FROM executions UNION ALL "
        "SELECT host, 'registry_findings', 'Last write', 'REG', plugin || ' ' || value_name, key_path, value_name, last_write_ts "
        "FROM registry UNION ALL "
        "SELECT host, 'rule_hits', 'Rule hit', 'EVT', rule_title, NULL, CAST(record_id AS VARCHAR), ts FROM rule_hits) "
        "WHERE ts IS NOT NULL",
    ),
)
def tml01(t: Tables):
    """Every row of the timeline of six sources."""
    line = tml.supertimeline(
        tml.from_event_log(ad.event_log(t)),
        tml.from_change_journal(ad.change_journal(t)),
        tml.from_file_entries(ad.file_entries(t)),
        tml.from_execution_history(ad.executions(t)),
        tml.from_registry(ad.registry(t)),
        tml.from_rule_hits(ad.rule_hits(t)),
    )
    return line.select(
        "host", "parser_name", "timestamp_desc", "source_short", "description", "artifact_path", "record_key", us("ts", "ts_us")
    )


@query(
    "tml02_events_in_window",
    with_ctes(
        "timeline_rows",
        select=f"SELECT record_key, {sql_us('ts', 'ts_us')} FROM timeline_rows WHERE ts BETWEEN "
        "TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-11 06:00:00'",
    ),
)
def tml02(t: Tables):
    rows = tml.events_in_window(ad.timeline_rows(t), "2024-01-10 06:00:00", "2024-01-11 06:00:00")
    return rows.select("record_key", us("ts", "ts_us"))


@query(
    "tml03_correlate_around",
    with_ctes(
        "timeline_rows",
        select=f"SELECT record_key, {sql_us('ts', 'ts_us')} FROM timeline_rows WHERE ts BETWEEN "
        "TIMESTAMP '2024-01-15 11:30:00' AND TIMESTAMP '2024-01-15 14:00:00'",
    ),
)
def tml03(t: Tables):
    rows = tml.correlate_around(ad.timeline_rows(t), "2024-01-15T12:00:00Z", 1800, 7200)
    return rows.select("record_key", us("ts", "ts_us"))


@query(
    "tml03_correlate_anchors",
    with_ctes(
        "timeline_rows",
        select="SELECT a.record_key AS anchor_key, e.record_key, e.host FROM timeline_rows a JOIN "
        "timeline_rows e ON e.host = a.host AND e.ts BETWEEN a.ts - INTERVAL 600 SECOND AND "
        "a.ts + INTERVAL 1800 SECOND WHERE a.source_short = 'FILE' AND a.parser_name = 'parser1'",
    ),
)
def tml03_anchors(t: Tables):
    rows = ad.timeline_rows(t)
    anchors = rows.where("source_short = 'FILE' AND parser_name = 'parser1'").select(
        "host", "ts", F.col("record_key").alias("key")
    )
    pairs = tml.correlate_anchors(
        rows.select("host", "ts", "record_key"), anchors, 600, 1800, same=["host"]
    )
    return pairs.select("anchor_key", "record_key", "host")
