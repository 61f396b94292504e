"""Deterministic detectors over artifact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import base_name, micros, normalize_path
from ..functions.fixed import (
    ANTI_FORENSIC_REASONS,
    HANDLE_PLUGINS,
    LATERAL_TECHNIQUES,
    PERSISTENCE_PLUGINS,
    PROCESS_PLUGINS,
    SECRET_PLUGINS,
)
from .blocks import with_previous
from .filters import plugin_filter, severity_technique


def _host(df: DataFrame) -> list[str]:
    return [name for name in ("case_id", "host") if name in df.columns]


def timestomp(df: DataFrame, tolerance_s: float = 5) -> DataFrame:
    """Creation time in the settable attribute earlier than in the kernel one by more than
    the tolerance."""
    ahead = micros(F.col("fn_created")) - micros(F.col("si_created"))
    return df.where(ahead > int(tolerance_s * 1_000_000))


def deletions(df: DataFrame) -> DataFrame:
    return df.where(F.array_contains("update_reasons", "FileDelete"))


def anti_forensic(df: DataFrame) -> DataFrame:
    named = F.array(*[F.lit(r) for r in ANTI_FORENSIC_REASONS])
    return df.where(F.arrays_overlap("update_reasons", named))


def rename_pairs(df: DataFrame) -> DataFrame:
    """Per file record its first old-name and first new-name row, when both exist.

    `min_by` keeps one row per key and task before the shuffle, so a busy file costs
    no more than a quiet one.
    """
    old = F.array_contains("update_reasons", "RenameOldName")
    new = F.array_contains("update_reasons", "RenameNewName")
    when = F.struct(F.col("ts"), F.col("usn"))
    seen = F.struct("file_name", "full_path", "ts", "usn")
    keys = [*_host(df), "file_record_number", "file_record_sequence_number"]
    firsts = (
        df.where(old | new)
        .groupBy(*keys)
        .agg(
            F.min_by(seen, F.when(old, when)).alias("o"),
            F.min_by(seen, F.when(new, when)).alias("n"),
            F.count_if(old).alias("_olds"),
            F.count_if(new).alias("_news"),
        )
    )
    return firsts.where((F.col("_olds") > 0) & (F.col("_news") > 0)).select(
        *keys,
        F.col("o.file_name").alias("old_name"),
        F.col("n.file_name").alias("new_name"),
        F.col("o.ts").alias("old_ts"),
        F.col("n.ts").alias("new_ts"),
        F.col("o.usn").alias("old_usn"),
        F.col("n.usn").alias("new_usn"),
    )


def persistence(df: DataFrame) -> DataFrame:
    return plugin_filter(df, PERSISTENCE_PLUGINS)


def hidden_tasks(df: DataFrame) -> DataFrame:
    """Scheduled tasks whose tree entry points nowhere or lacks its security descriptor."""
    marked = F.col("value_data").rlike("(?i)orphan|missing|no-sd")
    return df.where((F.col("plugin") == "TaskCache") & marked)


def lateral_hits(df: DataFrame, min_level: str = "medium") -> DataFrame:
    return severity_technique(df, min_level, LATERAL_TECHNIQUES)


# Where credential material lies, by lower-cased path with forward slashes. First rule wins.
CREDENTIAL_PATHS = (
    ("registry_hive", r"/config/(sam|security|system|software|default)$|/(ntuser|usrclass)\.dat$"),
    ("ntds_dit", r"(^|/)ntds\.dit$"),
    ("dpapi_master_key", r"/microsoft/protect/.*/[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"),
    ("browser_credential_db", r"/(login data|logins\.json|key[34]\.db|cookies|web data)$"),
    ("lsass_dump", r"lsass[^/]*\.dmp$"),
    ("hibernation_file", r"(^|/)hiberfil\.sys$"),
    ("pagefile", r"(^|/)(pagefile|swapfile)\.sys$"),
    ("kernel_crash_dump", r"(^|/)memory\.dmp$|/minidump/[^/]*\.dmp$"),
    ("ssh_private_key", r"/\.ssh/(id_(rsa|dsa|ecdsa|ed25519)|identity)$"),
    ("ssh_known_hosts", r"/\.ssh/known_hosts$"),
    ("ssh_host_key", r"/ssh/ssh_host_[a-z0-9]+_key$"),
)


def credential_class(path: Column) -> Column:
    flat = F.translate(F.lower(path), "\\", "/")
    found = F.lit(None).cast("string")
    for name, pattern in reversed(CREDENTIAL_PATHS):
        found = F.when(flat.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def credential_files(
    listing: DataFrame,
    digests: DataFrame | None = None,
    classes=None,
    max_files: int | None = None,
    path: str = "filename",
) -> DataFrame:
    """Files that hold credentials, with class and, where known, SHA-256.

    Only files with a class reach the join with the digests.
    """
    found = listing.withColumn("artifact_class", credential_class(F.col(path)))
    found = found.where(
        F.col("artifact_class").isNotNull()
        if classes is None
        else F.col("artifact_class").isin(*classes)
    )
    if digests is not None:
        found = found.join(digests, [*_host(digests), path], "left")
    return found if max_files is None else found.orderBy(path).limit(max_files)


def plugin_rows(df: DataFrame, plugins) -> DataFrame:
    return plugin_filter(df, plugins)


def _field(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("data", f"$.{name}", kind)


def processes(df: DataFrame) -> DataFrame:
    return plugin_rows(df, PROCESS_PLUGINS).select(
        *_host(df),
        _field("PID", "bigint").alias("pid"),
        _field("PPID", "bigint").alias("ppid"),
        _field("ImageFileName").alias("image_file_name"),
        _field("CreateTime").alias("create_time"),
        _field("ExitTime").alias("exit_time"),
    )


def secrets(df: DataFrame) -> DataFrame:
    return plugin_rows(df, SECRET_PLUGINS).select(
        *_host(df), "plugin", _field("Key").alias("key"), _field("Secret").alias("secret")
    )


# Processes that may hold such handles.
LSASS_READERS = ("msmpeng.exe", "werfault.exe", "wermgr.exe")


def lsass_handles(df: DataFrame, allowed=LSASS_READERS) -> DataFrame:
    """Handles to the security process with read and query rights, held by others."""
    granted = F.upper(_field("GrantedAccess"))
    holder = F.lower(_field("Process"))
    return (
        plugin_rows(df, HANDLE_PLUGINS)
        .where(F.lower(_field("Name")).contains("lsass.exe"))
        .where(granted.contains("VM_READ") & granted.contains("QUERY"))
        .where(~F.coalesce(holder.isin(*allowed), F.lit(False)))
        .select(
            *_host(df),
            _field("PID", "bigint").alias("pid"),
            holder.alias("process"),
            granted.alias("granted_access"),
        )
    )


def network_logon_without_interactive(
    events: DataFrame, programs: DataFrame | None = None, tools=("psexesvc.exe", "mimikatz.exe", "rubeus.exe")
) -> DataFrame:
    """NTLM network logons with no earlier interactive logon of that user on that host.

    The earliest interactive logon per user and host decides, so this is one grouped
    aggregation and one join on its key. With `programs`, only hosts where one of the
    tools was seen are kept.
    """
    logons = events.where(F.col("event_id") == 4624)
    keys = [*_host(events), "user_name"]
    first = logons.where(F.col("logon_type") == 2).groupBy(*keys).agg(
        F.min("ts").alias("first_interactive")
    )
    network = logons.where((F.col("logon_type") == 3) & (F.col("auth_package") == "NTLM"))
    hits = network.join(first, keys, "left").where(
        F.col("first_interactive").isNull() | (F.col("first_interactive") >= F.col("ts"))
    )
    if programs is not None:
        seen = programs.where(F.lower(base_name(F.col("name"))).isin(*tools))
        hits = hits.join(seen.select(*_host(programs)).distinct(), _host(programs), "left_semi")
    return hits


def log_clear(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_id") == 1102)


def record_gaps(events: DataFrame, width: int = 100_000) -> DataFrame:
    """Holes in the record numbers of a channel, and records older than the one before them."""
    keys = [*_host(events), "channel"]
    stepped = with_previous(events, keys, "record_number", ["ts"], width)
    missing = F.col("record_number") - F.col("prev_record_number") - 1
    backwards = F.col("ts") < F.col("prev_ts")
    return stepped.where((missing > 0) | backwards).select(
        *keys,
        "prev_record_number",
        "record_number",
        missing.alias("missing"),
        F.coalesce(backwards, F.lit(False)).alias("time_goes_back"),
    )


USER_WRITABLE = r"\\users\\|\\temp\\|\\programdata\\|\\appdata\\|\\public\\|%temp%|%appdata%"


def run_keys(registry: DataFrame, programs: DataFrame | None = None) -> DataFrame:
    """Run and RunOnce values that start something user-writable or not part of the system."""
    command = normalize_path(
        F.regexp_extract(F.col("value_data"), r'^\s*"?([^"]*?\.[A-Za-z0-9]{2,4})(?:"|\s|$)', 1)
    )
    keyed = registry.where(
        F.col("plugin").isin("RunKeys", "RunOnce")
        | F.col("key_path").rlike(r"(?i)\\currentversion\\run(once)?$")
    ).withColumn("program_path", F.nullif(command, F.lit("")))
    writable = F.coalesce(F.lower("value_data").rlike(USER_WRITABLE), F.lit(False))
    if programs is None:
        return keyed.withColumn("user_writable", writable).where("user_writable")
    hosts = [h for h in _host(registry) if h in programs.columns]
    known = (
        programs.select(
            *hosts,
            normalize_path(F.col("full_path")).alias("program_path"),
            F.coalesce("is_os_component", F.lit(False)).alias("is_os_component"),
        )
        .groupBy(*hosts, "program_path")
        .agg(F.bool_or("is_os_component").alias("signed"))
    )
    return (
        keyed.join(known, [*hosts, "program_path"], "left")
        .withColumn("user_writable", writable)
        .withColumn("unsigned", F.coalesce(~F.col("signed"), F.lit(False)))
        .where("user_writable OR unsigned")
        .drop("signed")
    )


def existed_ran_deleted(
    inventory: DataFrame, executions: DataFrame, journal: DataFrame
) -> DataFrame:
    """Programs seen, run, and deleted after their last run; keyed by host and file name.

    Each side is reduced to one row per name before the joins.
    """
    hosts = _host(inventory)
    keys = [*hosts, "program"]
    seen = inventory.groupBy(*hosts, F.lower(base_name(F.col("name"))).alias("program")).agg(
        F.min("sha1").alias("sha1")
    )
    ran = executions.groupBy(*hosts, F.lower("executable_name").alias("program")).agg(
        F.max("last_run").alias("last_run"), F.sum("run_count").alias("run_count")
    )
    gone = deletions(journal).groupBy(*hosts, F.lower("file_name").alias("program")).agg(
        F.max("ts").alias("deleted_at")
    )
    return (
        seen.join(ran, keys).join(gone, keys).where(F.col("deleted_at") >= F.col("last_run"))
    )
