"""Exported artifact rows (all text) to typed tables.

Each `read_*` loads files lazily; each `typed_*` works on any DataFrame with the
export's column names, so rows landed once as Parquet take the same route.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import cells as c
from ..functions.fixed import SEVERITIES
from .exports import column_names, first_lines, read_split_csv

CONTEXT = ("case_id", "host", "source_file")


def read_rows(
    spark: SparkSession,
    path,
    *,
    multi_line: bool = False,
    single_line: bool = False,
    names: list[str] | None = None,
    **context: str,
) -> DataFrame:
    """CSV cells as text, each file by the names in its own header.

    Files are grouped by header and the groups united by name, so exports with other columns or another
    order lie next to each other; a column that a file lacks is null for its rows. To find the headers the
    driver reads the first line of each file, and no more, when the reader is called; with `names`, which
    all files then have, it opens none.

    Large files are split among tasks, and cells may hold line breaks (see `exports`; files are read twice for
    that). `single_line` is for exports whose cells hold none and reads them once. With `multi_line` a file is one
    task's work.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    if names is None:
        for file, header in first_lines(spark, path).items():
            groups.setdefault(tuple(column_names(header)), []).append(unquote(file))
    else:
        groups[tuple(names)] = [path]
    parts = []
    for columns, files in groups.items() or [((), [])]:
        files = path if len(groups) < 2 else files
        if multi_line or single_line or not columns:
            reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
            parts.append(reader.csv(files).withColumn("source_file", F.col("_metadata.file_path")))
        else:
            parts.append(read_split_csv(spark, files, list(columns)))
    raw = parts[0]
    for part in parts[1:]:
        raw = raw.unionByName(part, allowMissingColumns=True)
    for name, value in context.items():
        raw = raw.withColumn(name, F.lit(value))
    return raw


def _cell(raw: DataFrame):
    present = {name.strip(): name for name in raw.columns}

    def get(name: str) -> Column:
        return F.col(f"`{present[name]}`") if name in present else F.lit(None).cast("string")

    return get


def _context(raw: DataFrame) -> list[Column]:
    return [F.col(name) for name in CONTEXT if name in raw.columns]


def _zero(col: Column) -> Column:
    return F.coalesce(c.int_or_null(col), F.lit(0).cast("bigint"))


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def typed_event_log(raw: DataFrame) -> DataFrame:
    get = _cell(raw)
    event_id = F.when(c.stripped(get("EventId")).isNull(), F.lit(0).cast("bigint")).otherwise(
        c.int_or_null(get("EventId"))
    )
    rows = raw.withColumn("_data", c.event_data(get("Payload"))).withColumn("_event_id", event_id)
    data = F.col("_data")
    return rows.where(F.col("_event_id").isNotNull()).select(
        *_context(raw),
        _zero(get("RecordNumber")).alias("record_number"),
        get("TimeCreated").alias("ts_raw"),
        c.instant(get("TimeCreated")).alias("ts"),
        F.col("_event_id").cast("int").alias("event_id"),
        _text(get("Level")).alias("level"),
        _text(get("Provider")).alias("provider"),
        _text(get("Channel")).alias("channel"),
        c.filled(get("Computer")).alias("computer"),
        c.first_filled(data["TargetUserName"], data["SubjectUserName"], get("UserName")).alias(
            "user_name"
        ),
        c.first_filled(data["TargetUserSid"], data["SubjectUserSid"], get("UserId")).alias(
            "user_sid"
        ),
        F.coalesce(
            c.logon_type(data["LogonType"]),
            c.logon_type(get("PayloadData2")),
            c.logon_type(get("PayloadData1")),
        ).alias("logon_type"),
        c.first_filled(data["AuthenticationPackageName"], data["PackageName"]).alias(
            "auth_package"
        ),
        c.first_filled(data["IpAddress"], get("RemoteHost")).alias("source_ip"),
        c.filled(get("Payload")).alias("payload_summary"),
    )


# Fixed column names of the file-table export: attribute times by our name.
FILE_TIMES = {
    "si_created": "Created0x10",
    "si_modified": "LastModified0x10",
    "si_accessed": "LastAccess0x10",
    "si_record_modified": "LastRecordChange0x10",
    "fn_created": "Created0x30",
    "fn_modified": "LastModified0x30",
    "fn_accessed": "LastAccess0x30",
    "fn_record_modified": "LastRecordChange0x30",
}


def typed_file_entries(raw: DataFrame) -> DataFrame:
    get = _cell(raw)
    entry = c.int_or_null(get("EntryNumber"))
    return raw.where(entry.isNotNull()).select(
        *_context(raw),
        entry.alias("entry_number"),
        _zero(get("SequenceNumber")).alias("sequence_number"),
        c.int_or_null(get("ParentEntryNumber")).alias("parent_entry_number"),
        c.int_or_null(get("ParentSequenceNumber")).alias("parent_sequence_number"),
        c.truthy(get("InUse")).alias("in_use"),
        c.truthy(get("IsDirectory")).alias("is_directory"),
        _text(get("FileName")).alias("file_name"),
        c.filled(get("Extension")).alias("file_extension"),
        c.filled(c.full_path(get("ParentPath"), get("FileName"))).alias("full_path"),
        c.size_or_null(get("FileSize")).alias("file_size"),
        *[c.instant(get(source)).alias(name) for name, source in FILE_TIMES.items()],
        c.truthy(get("HasAds")).alias("has_alternate_data_streams"),
        c.truthy(get("HasObjectId")).alias("has_object_id"),
        c.truthy(get("HasReparsePoint")).alias("has_reparse_point"),
        (entry * 1024).alias("entry_offset"),
    )


def typed_change_journal(raw: DataFrame) -> DataFrame:
    get = _cell(raw)
    usn = c.int_or_null(get("UpdateSequenceNumber"))
    return raw.where(usn.isNotNull()).select(
        *_context(raw),
        get("UpdateTimestamp").alias("ts_raw"),
        c.instant(get("UpdateTimestamp")).alias("ts"),
        usn.alias("usn"),
        c.reasons(get("UpdateReasons")).alias("update_reasons"),
        _text(get("Name")).alias("file_name"),
        c.filled(get("Extension")).alias("file_extension"),
        c.filled(c.full_path(get("ParentPath"), get("Name"))).alias("full_path"),
        _zero(get("EntryNumber")).alias("file_record_number"),
        _zero(get("SequenceNumber")).alias("file_record_sequence_number"),
        _zero(get("ParentEntryNumber")).alias("parent_file_record_number"),
        _zero(get("ParentSequenceNumber")).alias("parent_file_record_sequence_number"),
        c.filled(get("SourceInfo")).alias("source_info"),
        c.int_or_null(get("SecurityId")).alias("security_id"),
    )


def typed_program_inventory(raw: DataFrame) -> DataFrame:
    get = _cell(raw)
    file_id = c.stripped(get("FileId"))
    return raw.where(file_id.isNotNull()).select(
        *_context(raw),
        file_id.alias("file_id"),
        c.sha1_of_file_id(get("FileId")).alias("sha1"),
        _text(c.strip(c.first_filled(get("ApplicationName"), get("Path")))).alias("name"),
        c.filled(get("Path")).alias("full_path"),
        c.filled(get("Publisher")).alias("publisher"),
        c.truthy_or_null(get("IsPeFile")).alias("is_pe_file"),
        c.truthy_or_null(get("IsOsComponent")).alias("is_os_component"),
        c.filled(get("BinaryType")).alias("binary_type"),
        c.int_or_null(get("Size")).alias("size"),
        c.filled(get("ProductName")).alias("product_name"),
        c.filled(get("ProductVersion")).alias("product_version"),
        c.first_filled(get("Version"), get("FileVersionString")).alias("file_version"),
        c.filled(get("Description")).alias("description"),
        c.instant(get("FileKeyLastWriteTimestamp")).alias("first_seen"),
        c.instant(get("LinkDate")).alias("link_date"),
    )


def typed_execution_history(raw: DataFrame) -> DataFrame:
    get = _cell(raw)
    source = c.stripped(get("SourceFilename"))
    runs = c.run_times(get("LastRun"), *[get(f"PreviousRun{i}") for i in range(7)])
    return raw.where(source.isNotNull()).select(
        *_context(raw),
        source.alias("source_filename"),
        F.lower(_text(c.strip(get("ExecutableName")))).alias("executable_name"),
        _text(c.strip(get("Hash"))).alias("hash"),
        _zero(get("RunCount")).alias("run_count"),
        c.instant(get("LastRun")).alias("last_run"),
        runs.alias("all_run_times"),
        c.int_or_null(get("Size")).alias("size"),
        c.filled(get("Volume0Info")).alias("volume_information"),
        c.int_or_null(get("FilesCount")).alias("files_count"),
        c.int_or_null(get("Directories")).alias("directories_count"),
        c.filled(get("Files")).alias("referenced_files_summary"),
    )


def typed_registry_findings(raw: DataFrame, hive: str | None = None) -> DataFrame:
    """The whole row is kept in `raw`, without the column that names a run folder."""
    get = _cell(raw)
    names = [n for n in raw.columns if n not in CONTEXT and n.strip() != "PluginDetailFile"]
    cells = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`") for n in names])
    )
    return raw.select(
        *_context(raw),
        _text(c.strip(c.first_filled(get("Description"), get("Category")))).alias("plugin"),
        (F.lit(hive) if hive else c.filled(get("HiveType"))).alias("hive"),
        _text(c.strip(get("KeyPath"))).alias("key_path"),
        c.filled(get("ValueName")).alias("value_name"),
        c.filled(get("ValueData")).alias("value_data"),
        c.instant(get("LastWriteTimestamp")).alias("last_write_ts"),
        F.map_filter(cells, lambda k, v: F.coalesce(v, F.lit("")) != "").alias("raw"),
    )


def typed_rule_hits(raw: DataFrame) -> DataFrame:
    get = _cell(raw)
    level = F.lower(c.strip(get("Level")))
    return raw.where(level.isin(*SEVERITIES)).select(
        *_context(raw),
        _text(c.strip(get("Timestamp"))).alias("ts_raw"),
        c.instant(get("Timestamp")).alias("ts"),
        _text(c.strip(get("Computer"))).alias("computer"),
        _text(c.strip(get("Channel"))).alias("channel"),
        _zero(get("EventID")).cast("int").alias("event_id"),
        level.alias("level"),
        _text(c.strip(get("RuleID"))).alias("rule_id"),
        _text(c.strip(get("RuleTitle"))).alias("rule_title"),
        c.filled(get("RuleAuthor")).alias("rule_author"),
        c.split_list(get("MitreTactics")).alias("mitre_tactics"),
        c.split_list(c.first_filled(get("MitreTags"), get("MitreTechniques"))).alias(
            "mitre_techniques"
        ),
        c.strip(F.coalesce(c.filled(get("Status")), F.lit("stable"))).alias("status"),
        c.int_or_null(get("RecordID")).alias("record_id"),
        c.filled(get("Details")).alias("details"),
    )


def typed_timeline(raw: DataFrame) -> DataFrame:
    get = _cell(raw)
    dated = c.stripped(get("date")).isNotNull() | c.stripped(get("time")).isNotNull()
    return raw.where(dated).select(
        *_context(raw),
        c.zoned_instant(get("date"), get("time"), get("timezone")).alias("ts"),
        _text(c.strip(c.first_filled(get("type"), get("MACB")))).alias("timestamp_desc"),
        c.strip(F.coalesce(c.filled(get("source")), F.lit("?"))).alias("source_short"),
        _text(c.strip(get("sourcetype"))).alias("source_long"),
        _text(c.strip(get("format"))).alias("parser_name"),
        _text(c.strip(get("desc"))).alias("description"),
        c.stripped(get("user")).alias("user"),
        c.stripped(get("host")).alias("hostname"),
        c.stripped(get("filename")).alias("artifact_path"),
        c.int_or_null(get("inode")).alias("inode"),
        c.extra_map(c.scrub_addresses(get("extra"))).alias("extra"),
    )


def typed_listing(lines: DataFrame) -> DataFrame:
    """Body-file lines (column `value`) to one row per file."""
    line = c.strip(F.col("value"))
    cols = F.split(line, "\\|")
    rows = lines.where((line != "") & ~line.startswith("#") & (F.size(cols) >= 8)).select(
        *_context(lines),
        c.listing_inode(cols[2]).alias("inode"),
        c.listing_name(cols[1]).alias("filename"),
        c.listing_deleted(cols[1], cols[2]).alias("deleted"),
        F.coalesce(c.int_or_null(cols[6]), F.lit(0).cast("bigint")).alias("file_size_bytes"),
    )
    return rows.where(F.col("inode").isNotNull() & (F.col("filename") != ""))


def read_event_log(spark, path, **options) -> DataFrame:
    return typed_event_log(read_rows(spark, path, **options))


def read_file_entries(spark, path, **options) -> DataFrame:
    return typed_file_entries(read_rows(spark, path, **options))


def read_change_journal(spark, path, **options) -> DataFrame:
    return typed_change_journal(read_rows(spark, path, **options))


def read_program_inventory(spark, path, **options) -> DataFrame:
    return typed_program_inventory(read_rows(spark, path, **options))


def read_execution_history(spark, path, **options) -> DataFrame:
    return typed_execution_history(read_rows(spark, path, **options))


def read_registry_findings(spark, path, hive: str | None = None, **options) -> DataFrame:
    return typed_registry_findings(read_rows(spark, path, **options), hive)


def read_rule_hits(spark, path, **options) -> DataFrame:
    return typed_rule_hits(read_rows(spark, path, **options))


def read_timeline(spark, path, **options) -> DataFrame:
    """The `host` column of this export is its own, so no host is attached here."""
    options.pop("host", None)
    raw = read_rows(spark, path, **options)
    return typed_timeline(raw.withColumnRenamed("host", "host "))


def read_body_file(spark, path) -> DataFrame:
    """Lines are split by hand: a CSV reader would take quotes in names as quoting."""
    lines = spark.read.text(path).withColumn("source_file", F.col("_metadata.file_path"))
    return typed_listing(lines)


def read_memory_rows(spark, path, plugin: str, fmt: str | None = None) -> DataFrame:
    """Plugin output as variants. Each file is taken as JSON lines, a JSON array or CSV by
    what it holds; whatever cannot be read becomes one row with the whole text as
    banner. `fmt="jsonl"` reads big line files without ever holding a file in one row; the
    position in the file is then not known.
    """
    if fmt == "jsonl":
        row = F.try_parse_json("value")
        return spark.read.text(path).where(c.strip(F.col("value")) != "").select(
            F.col("_metadata.file_path").alias("source_file"),
            F.lit(plugin).alias("plugin"),
            F.lit(None).cast("int").alias("row_index"),
            row.alias("data"),
            F.when(row.isNull(), F.col("value")).alias("banner"),
        )
    whole = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text")
    )
    return memory_rows_of_files(whole, plugin)


def _csv_cells(line: Column) -> Column:
    found = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(
        found,
        lambda s: F.when(
            s.startswith('"') & (F.length(s) >= 2),
            F.replace(F.substr(s, F.lit(2), F.length(s) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(s),
    )


def memory_rows_of_files(files: DataFrame, plugin: str) -> DataFrame:
    """One row per plugin row from whole plugin outputs (columns `source_file`, `text`).

    Each step reads the columns of the one before, so every text is parsed once.
    """
    blank = lambda s: c.strip(s) == ""
    is_object = lambda v: F.coalesce(
        F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)
    )
    text, lines = F.col("_text"), F.col("_lines")
    split = files.select("source_file", c.strip(F.col("text")).alias("_text")).withColumn(
        "_lines", F.split("_text", "\r?\n")
    )
    parsed = split.select(
        "*",
        F.when(
            text.startswith("{") & (F.size(lines) > 1), F.transform(lines, F.try_parse_json)
        ).alias("_objects"),
        F.when(
            text.startswith("["), F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
        ).alias("_array"),
    )
    unread = F.size(F.filter("_objects", F.isnull)) - F.size(F.filter(lines, blank))
    header = _csv_cells(lines[0])
    body = F.filter(F.slice(lines, 2, F.size(lines)), lambda s: ~blank(s))

    def csv_row(line: Column) -> Column:
        pairs = F.arrays_zip(header.alias("key"), _csv_cells(line).alias("value"))
        named = F.filter(pairs, lambda e: e["key"].isNotNull())
        return F.parse_json(F.to_json(F.map_from_entries(named)))

    items = (
        F.when(
            F.col("_objects").isNotNull() & (unread == 0) & F.exists("_objects", is_object),
            F.transform("_objects", lambda v: F.when(is_object(v), v)),
        )
        .when(
            F.col("_array").isNotNull(),
            F.transform(
                "_array",
                lambda v: F.when(is_object(v), v).otherwise(
                    F.to_variant_object(F.struct(v.alias("value")))
                ),
            ),
        )
        .when(F.exists(F.slice(lines, 2, F.size(lines)), lambda s: ~blank(s)), F.transform(body, csv_row))
    )
    rows = parsed.select("source_file", "_text", items.alias("_items"))
    exploded = rows.select(
        "source_file",
        F.lit(plugin).alias("plugin"),
        F.when(F.col("_items").isNull() & (text != ""), text).alias("banner"),
        F.posexplode_outer("_items").alias("row_index", "data"),
    )
    return exploded.where(F.col("data").isNotNull() | F.col("banner").isNotNull()).select(
        "source_file", "plugin", "row_index", "data", "banner"
    )
