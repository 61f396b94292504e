"""Sources, normalizers and filters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as c
from ..operators import filters as flt
from ..session import scratch_table
from ..sources import artifacts as src
from ..sources.stores import digest_files, digest_segments, evidence_manifest
from . import adapters as ad
from .adapters import cte, with_ctes
from .registry import Tables, query

MICROS = "CAST(epoch_us(ts) AS BIGINT) AS ts_us"


def _us(name: str = "ts", alias: str = "ts_us"):
    return c.micros(F.col(name)).alias(alias)


# --- sources: the typed side of each reader over rows in the export's own text form ----


@query(
    "src01_event_log",
    with_ctes(
        "ev",
        select="SELECT host, event_id AS record_number, " + MICROS + ", CAST(CASE WHEN k % 19 = 0 "
        f"THEN 0 ELSE {ad.pick_sql('event_type', ad.EVENT_CODES)} END AS INTEGER) AS event_code, "
        "event_type AS provider, "
        "CASE WHEN k % 11 = 0 THEN 'row' || user_id WHEN k % 4 = 0 THEN 'svc' || (user_id % 3) "
        "ELSE 'user' || user_id END AS user_name, 'S-1-5-21-' || user_id AS user_sid, "
        "CAST(CASE WHEN k % 11 = 0 AND k % 2 = 1 AND k % 13 = 0 THEN NULL WHEN k % 3 = 0 THEN 2 "
        "ELSE 3 END AS INTEGER) AS logon_type, "
        "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 2 = 0 THEN 'NTLM' ELSE 'Kerberos' END AS auth_package, "
        "CASE WHEN k % 11 <> 0 AND k % 7 = 0 THEN '192.168.0.' || k WHEN k % 5 = 0 THEN NULL "
        "ELSE '10.0.0.' || user_id END AS source_ip FROM ev WHERE k % 17 <> 0",
    ),
)
def src01(t: Tables):
    rows = src.typed_event_log(ad.raw_event_rows(t))
    return rows.select(
        "host", "record_number", _us(), F.col("event_id").alias("event_code"), "provider",
        "user_name", "user_sid", "logon_type", "auth_package", "source_ip",
    )


@query(
    "src01_event_log_files",
    with_ctes(
        "ev",
        select="SELECT host, event_id AS record_number, " + MICROS + ", CASE WHEN k % 11 = 0 THEN NULL WHEN k % "
        "3 = 0 THEN '2' ELSE '3' END AS logon FROM ev WHERE k % 17 <> 0",
    ),
)
def src01_files(t: Tables):
    """The export written as CSV files and read back."""
    path = scratch_table(t.spark, "export")
    ad.raw_event_rows(t).withColumnRenamed("host", "Host").write.option("header", True).option(
        "quote", '"'
    ).option("escape", '"').csv(path)
    log = src.read_event_log(t.spark, path)
    return log.select(
        F.col("computer").alias("host"), "record_number", _us(),
        c.event_data(F.col("payload_summary"))["LogonType"].alias("logon"),
    )


@query(
    "src01_mixed_headers",
    with_ctes(
        "ev",
        select="SELECT host, event_id AS record_number, event_id % 2 = 0 AS has_channel FROM ev WHERE k % 17 <> 0",
    ),
)
def src01_mixed(t: Tables):
    """Two exports in one folder: the second with reversed columns, one of them missing."""
    path = scratch_table(t.spark, "export")
    raw = ad.raw_event_rows(t).withColumnRenamed("host", "Host").withColumn("Channel", F.lit("c"))
    even = F.col("RecordNumber").cast("bigint") % 2 == 0
    other = raw.where(~even).select(*[c for c in reversed(raw.columns) if c != "Channel"])
    for part in (raw.where(even), other):
        part.write.mode("append").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    log = src.read_event_log(t.spark, path)
    return log.select(
        F.col("computer").alias("host"), "record_number", (F.col("channel") == "c").alias("has_channel")
    )


@query(
    "src02_file_entries",
    "SELECT o_orderkey AS entry_number, o_orderkey * 1024 AS entry_offset, "
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS parent_entry_number, "
    "o_orderstatus = 'O' AS in_use, 'f' || o_orderkey AS file_name, "
    "CASE WHEN o_orderkey % 4 = 0 THEN 'f' || o_orderkey ELSE 'C:\\' || o_orderpriority || '\\f' || "
    "o_orderkey END AS full_path, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS file_size, "
    "CAST(epoch_us(o_orderdate) AS BIGINT) AS created_us FROM orders WHERE o_orderkey % 7 <> 0",
)
def src02(t: Tables):
    key = F.col("o_orderkey")
    text = key.cast("string")
    raw = t.orders.select(
        F.when(key % 7 == 0, "7.0").otherwise(F.concat(F.lit(" "), text)).alias("EntryNumber"),
        F.when(key % 3 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias(
            "ParentEntryNumber"
        ),
        F.when(F.col("o_orderstatus") == "O", " YES").otherwise("no").alias("InUse"),
        F.concat(F.lit("f"), text).alias("FileName"),
        F.when(key % 4 == 0, "\\/").otherwise(
            F.concat(F.lit("C:\\"), F.col("o_orderpriority"), F.lit("\\"))
        ).alias("ParentPath"),
        F.when(key % 5 == 0, "-1").otherwise(F.col("o_custkey").cast("string")).alias("FileSize"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSSS").alias("Created0x10"),
    )
    return src.typed_file_entries(raw).select(
        "entry_number", "entry_offset", "parent_entry_number", "in_use", "file_name",
        "full_path", "file_size", _us("si_created", "created_us"),
    )


@query(
    "src03_change_journal",
    with_ctes(
        "ev",
        select="SELECT host, event_id AS usn, CASE WHEN k % 29 = 0 THEN NULL ELSE "
        "CAST(epoch_us(ts) AS BIGINT) END AS ts_us, replace("
        + ad.pick_sql("event_type", ad.journal_reasons())
        + ", '| ', '|') AS reasons, 'prog' || k || '.exe' AS file_name, CASE WHEN k % 4 = 0 THEN '' "
        "ELSE 'C:\\Users\\u' || k || '\\' END || 'prog' || k || '.exe' AS full_path, "
        "user_id AS file_record_number, CAST(0 AS BIGINT) AS parent_file_record_number, "
        "k AS security_id FROM ev WHERE k % 23 <> 0",
    ),
)
def src03(t: Tables):
    return src.typed_change_journal(ad.raw_journal_rows(t)).select(
        "host", "usn", _us(), F.array_join("update_reasons", "|").alias("reasons"), "file_name",
        "full_path", "file_record_number", "parent_file_record_number", "security_id",
    )


@query(
    "src04_program_inventory",
    "SELECT p_partkey % 10 AS part_digit, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE "
    "substr(sha256(p_name), 1, 40) END AS sha1, CASE WHEN p_partkey % 4 = 0 THEN 'C:\\' || p_name "
    "ELSE p_name END AS name, CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size % 2 = 0 END "
    "AS BOOLEAN) AS is_pe_file, CAST(p_size AS BIGINT) AS size, p_brand AS publisher FROM part "
    "WHERE p_partkey % 9 <> 0",
)
def src04(t: Tables):
    key = F.col("p_partkey")
    sha = F.upper(F.substring(F.sha2(F.col("p_name").cast("binary"), 256), 1, 40))
    raw = t.part.select(
        (key % 10).alias("source_file"),
        F.when(key % 9 == 0, "  ")
        .when(key % 6 == 0, sha)
        .otherwise(F.concat(F.lit("0000"), sha))
        .alias("FileId"),
        F.when(key % 4 == 0, "").otherwise(F.col("p_name")).alias("ApplicationName"),
        F.concat(F.lit("C:\\"), "p_name").alias("Path"),
        F.when(key % 3 == 0, "").when(F.col("p_size") % 2 == 0, "True").otherwise("False").alias(
            "IsPeFile"
        ),
        F.col("p_size").cast("string").alias("Size"),
        F.col("p_brand").alias("Publisher"),
    )
    return src.typed_program_inventory(raw).select(
        F.col("source_file").alias("part_digit"), "sha1", "name", "is_pe_file", "size", "publisher"
    )


@query(
    "src05_execution_history",
    "SELECT 'X' || l_orderkey AS source_filename, 'prog' || l_partkey || '.exe' AS executable_name, "
    "CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END AS BIGINT) AS run_count, "
    "CAST(epoch_us(l_shipdate) AS BIGINT) AS last_run_us, CAST(CASE WHEN l_quantity > 25 THEN 2 "
    "ELSE 1 END AS INTEGER) AS n_runs FROM lineitem WHERE l_linenumber <> 7",
)
def src05(t: Tables):
    line = F.col("l_linenumber")
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    raw = t.lineitem.select(
        F.when(line == 7, " ").otherwise(F.concat(F.lit("X"), F.col("l_orderkey").cast("string")))
        .alias("SourceFilename"),
        F.concat(F.lit(" PROG"), F.col("l_partkey").cast("string"), F.lit(".EXE ")).alias(
            "ExecutableName"
        ),
        F.when(line == 1, "many").otherwise(line.cast("string")).alias("RunCount"),
        stamp.alias("LastRun"),
        F.lit(" ").alias("PreviousRun0"),
        F.when(F.col("l_quantity") > 25, stamp).otherwise("").alias("PreviousRun1"),
    )
    return src.typed_execution_history(raw).select(
        "source_filename", "executable_name", "run_count", _us("last_run", "last_run_us"),
        F.size("all_run_times").alias("n_runs"),
    )


@query(
    "src06_registry_findings",
    with_ctes(
        "ev",
        select="SELECT host, CASE WHEN k % 2 = 0 THEN event_type ELSE 'cat' END AS plugin, "
        "'key ' || k AS key_path, CASE WHEN k % 3 = 0 THEN NULL ELSE props END AS value_data, "
        "CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END + 3 AS "
        "INTEGER) AS n_cells, " + MICROS + " FROM ev",
    ),
)
def src06(t: Tables):
    k = F.col("k")
    raw = ad.events(t).select(
        "host",
        F.when(k % 2 == 0, F.col("event_type")).otherwise("").alias("Description"),
        F.lit("cat").alias("Category"),
        F.concat(F.lit(" key "), k.cast("string")).alias("KeyPath"),
        F.when(k % 3 == 0, "").otherwise(F.col("props")).alias("ValueData"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("LastWriteTimestamp"),
        F.col("event_id").cast("string").alias("PluginDetailFile"),
    )
    return src.typed_registry_findings(raw, hive="SOFTWARE").select(
        "host", "plugin", "key_path", "value_data", F.size("raw").alias("n_cells"),
        _us("last_write_ts"),
    )


@query(
    "src07_rule_hits",
    with_ctes(
        "ev",
        select=f"SELECT host, {MICROS}, {ad.pick_sql('k % 5', ad.LEVELS)} AS level, "
        "CAST(k AS INTEGER) AS event_code, 'TA1+TA2' AS tactics, "
        "CASE k % 4 WHEN 0 THEN 'T1550.002+T1021.002' WHEN 1 THEN 'T1110+T9999' WHEN 2 THEN 'T9998' "
        "ELSE '' END AS techniques, 'stable' AS status, event_id AS record_id FROM ev WHERE k % 31 <> 0",
    ),
)
def src07(t: Tables):
    return src.typed_rule_hits(ad.raw_rule_rows(t)).select(
        "host", _us(), "level", F.col("event_id").alias("event_code"),
        F.array_join("mitre_tactics", "+").alias("tactics"),
        F.array_join("mitre_techniques", "+").alias("techniques"), "status", "record_id",
    )


@query(
    "src08_timeline",
    with_ctes(
        "ev",
        select="SELECT event_id AS inode, CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) + "
        "CASE WHEN k % 2 = 0 THEN 18000000000 ELSE 0 END AS ts_us, CASE WHEN k % 3 = 0 THEN '?' ELSE "
        "event_type END AS source_short, 'M' AS timestamp_desc, 'a: b' || k AS extra_path, "
        "'<x.Y object at 0xMEMADDR>' AS extra_obj, CAST(2 AS INTEGER) AS n_extra FROM ev",
    ),
)
def src08(t: Tables):
    k = F.col("k")
    raw = ad.events(t).select(
        F.date_format("ts", "MM/dd/yyyy").alias("date"),
        F.date_format("ts", "HH:mm:ss").alias("time"),
        F.when(k % 2 == 0, "EST").otherwise("UTC").alias("timezone"),
        F.lit("M").alias("MACB"),
        F.when(k % 3 == 0, "").otherwise(F.col("event_type")).alias("source"),
        F.lit("d").alias("desc"),
        F.col("event_id").cast("string").alias("inode"),
        F.concat(
            F.lit("path: first; nothing ;obj: <x.Y object at 0x"), F.hex("event_id"),
            F.lit(">; path: a: b"), k.cast("string"),
        ).alias("extra"),
    )
    return src.typed_timeline(raw).select(
        "inode", _us(), "source_short", "timestamp_desc",
        F.col("extra")["path"].alias("extra_path"), F.col("extra")["obj"].alias("extra_obj"),
        F.size("extra").alias("n_extra"),
    )


@query(
    "src09_file_listing",
    "SELECT doc_id AS inode, source || '/d' || doc_id || '.txt' AS filename, doc_id % 5 <= 1 AS deleted, "
    "CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS file_size_bytes FROM documents "
    "WHERE doc_id % 11 <> 0",
)
def src09(t: Tables):
    doc = F.col("doc_id")
    text = doc.cast("string")
    name = F.concat(F.lit("//"), "source", F.lit("/d"), text, F.lit(".txt"))
    lines = t.documents.select(
        F.concat_ws(
            "|",
            F.when(doc % 11 == 0, "#0").otherwise("0"),
            F.when(doc % 5 == 1, F.concat(name, F.lit(" (realloc)"))).otherwise(name),
            F.concat(F.when(doc % 5 == 0, "*").otherwise(""), text, F.lit("-128-4")),
            F.lit("r/rrwx"),
            F.lit("0"),
            F.lit("0"),
            F.when(doc % 7 == 0, "?").otherwise(F.col("n_chars").cast("string")),
            F.lit("0|0|0|0"),
        ).alias("value")
    )
    return src.typed_listing(lines)


@query(
    "src10_memory_rows",
    "SELECT user_id AS pid, event_id AS row_key, event_type AS name, "
    "CASE WHEN event_id % 10 = 9 THEN 'broken ' || event_id ELSE NULL END AS banner FROM events "
    "WHERE event_id % 10 <> 9 UNION ALL SELECT NULL, NULL, NULL, 'broken ' || event_id FROM events "
    "WHERE event_id % 10 = 9",
)
def src10(t: Tables):
    """Plugin outputs of one row each, as line pairs, arrays or CSV; every tenth is unreadable."""
    row = F.to_json(F.struct(F.col("user_id").alias("PID"), F.col("event_id").alias("Key"),
                             F.col("event_type").alias("ImageFileName")))
    csv = F.concat(
        F.lit('PID,Key,ImageFileName\n'), F.concat_ws(",", "user_id", "event_id"),
        F.lit(',"'), "event_type", F.lit('"\n'),
    )
    kind = F.col("event_id") % 10
    files = t.events.select(
        F.col("event_id").cast("string").alias("source_file"),
        F.when(kind == 9, F.concat(F.lit("broken "), F.col("event_id").cast("string")))
        .when(kind < 3, F.concat(row, F.lit("\n\n5\n")))
        .when(kind < 6, F.concat(F.lit(" ["), row, F.lit("]")))
        .otherwise(csv)
        .alias("text"),
    )
    get = lambda path, kind: F.try_variant_get("data", path, kind)
    return src.memory_rows_of_files(files, "windows.pslist.PsList").select(
        get("$.PID", "bigint").alias("pid"), get("$.Key", "bigint").alias("row_key"),
        get("$.ImageFileName", "string").alias("name"), "banner",
    )


SEGMENTS = (
    "SELECT o_orderpriority AS image, o_orderkey % 4 AS segment, string_agg(o_orderkey || chr(10), '' ORDER BY "
    "o_orderkey) AS content FROM orders GROUP BY 1, 2"
)
cte("segments", f"SELECT image, segment, strlen(content) AS size_bytes, sha256(content) AS sha256 FROM ({SEGMENTS})")


def segment_files(t: Tables):
    """Orders written as text files, one for each priority and part, and digested from the files."""
    path = scratch_table(t.spark, "evidence")
    part = (F.col("o_orderkey") % 4).alias("segment")
    rows = t.orders.select(F.col("o_orderpriority").alias("image"), part, F.col("o_orderkey").alias("key"))
    lines = rows.repartition("image", "segment").sortWithinPartitions("image", "segment", "key")
    lines.select("image", "segment", F.col("key").cast("string").alias("value")).write.partitionBy(
        "image", "segment"
    ).text(path)
    found = digest_files(t.spark, path, "part-*")
    image = F.url_decode(F.regexp_extract("path", "image=([^/]+)", 1))
    return found.select(
        F.url_decode(image).alias("image"),
        F.regexp_extract("path", "segment=([0-9]+)", 1).cast("bigint").alias("segment"),
        "size_bytes",
        "sha256",
    )


@query("src14_evidence_digest", with_ctes("segments", select="SELECT * FROM segments"))
def src14(t: Tables):
    return segment_files(t)


@query(
    "src14_image_of_segments",
    with_ctes(
        "segments",
        select="SELECT image, count(*) AS n_segments, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, "
        "sha256(string_agg(segment || ':' || size_bytes || ':' || sha256, chr(10) ORDER BY segment)) AS sha256 "
        "FROM segments GROUP BY image",
    ),
)
def src14_image(t: Tables):
    return digest_segments(segment_files(t))


@query(
    "snk04_evidence_manifest",
    "SELECT doc_id, substr(sha256(sha256(text) || 'run-' || (doc_id % 10)), 1, 16) AS handle_id "
    "FROM documents",
)
def snk04(t: Tables):
    evidence = t.documents.select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("image_sha256"),
        F.concat(F.lit("run-"), (F.col("doc_id") % 10).cast("string")).alias("run_id"),
    )
    return evidence_manifest(evidence).select("doc_id", "handle_id")


# --- normalizers ----------------------------------------------------------------------


@query(
    "prj01_eventdata_map",
    with_ctes(
        "ev",
        select="SELECT event_id, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN '2' ELSE '3' END "
        "AS logon, CAST(CASE WHEN k % 11 = 0 THEN 0 WHEN k % 7 = 0 THEN 5 ELSE 4 END AS INTEGER) "
        "AS n_names FROM ev",
    ),
)
def prj01(t: Tables):
    data = c.event_data(F.col("Payload"))
    return ad.raw_event_rows(t).select(
        F.col("RecordNumber").cast("bigint").alias("event_id"),
        data["LogonType"].alias("logon"),
        F.size(data).alias("n_names"),
    )


@query(
    "prj02_auth_columns",
    with_ctes(
        "ev",
        select="SELECT event_id, CASE WHEN k % 2 = 0 THEN event_type WHEN k % 3 = 0 THEN props ELSE "
        "NULL END AS chosen FROM ev",
    ),
)
def prj02(t: Tables):
    k = F.col("k")
    first = F.when(k % 2 == 0, F.col("event_type")).otherwise("")
    second = F.when(k % 3 == 0, F.col("props"))
    return ad.events(t).select("event_id", c.first_filled(first, second).alias("chosen"))


@query(
    "prj03_logon_type",
    with_ctes(
        "ev",
        select="SELECT event_id, CAST(CASE WHEN k % 5 = 4 THEN NULL ELSE k END AS INTEGER) AS logon_type "
        "FROM ev",
    ),
)
def prj03(t: Tables):
    k = F.col("k").cast("string")
    text = (
        F.when(F.col("k") % 5 == 0, k)
        .when(F.col("k") % 5 == 1, F.concat(F.lit(" "), k, F.lit("\t")))
        .when(F.col("k") % 5 == 2, F.concat(F.lit("LogonType "), k))
        .when(F.col("k") % 5 == 3, F.concat(F.lit("the logontype  "), k, F.lit(" x")))
        .otherwise(F.concat(F.lit("type "), k))
    )
    return ad.events(t).select("event_id", c.logon_type(text).alias("logon_type"))


@query(
    "prj04_null_tolerant_casts",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN NULL ELSE l_suppkey END AS n, "
    "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_suppkey END AS size, l_linestatus = 'O' AS flag, "
    "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linestatus = 'O' END AS maybe FROM lineitem",
)
def prj04(t: Tables):
    key = F.col("l_suppkey").cast("string")
    flag = F.when(F.col("l_linestatus") == "O", " Yes ").otherwise("nope")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        c.int_or_null(F.when(F.col("l_quantity") > 25, F.concat(key, F.lit(".0"))).otherwise(key))
        .alias("n"),
        c.size_or_null(F.when(F.col("l_linenumber") == 2, "-3").otherwise(key)).alias("size"),
        c.truthy(flag).alias("flag"),
        c.truthy_or_null(F.when(F.col("l_returnflag") == "N", " ").otherwise(flag)).alias("maybe"),
    )


@query(
    "prj05_full_path",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'C:\\' || o_orderpriority "
    "|| '\\' || o_orderstatus END AS path FROM orders",
)
def prj05(t: Tables):
    parent = F.when(F.col("o_orderkey") % 3 == 0, "\\/\\").otherwise(
        F.concat(F.lit("C:\\"), "o_orderpriority", F.lit("/\\"))
    )
    return t.orders.select(
        "o_orderkey", c.full_path(parent, F.col("o_orderstatus")).alias("path")
    )


@query(
    "prj06_split_list",
    with_ctes(
        "ev",
        select="SELECT event_id, CASE k % 4 WHEN 0 THEN 'a,b+' || k WHEN 1 THEN 'a,c+' || k "
        "WHEN 2 THEN 'a+' || k ELSE CAST(k AS VARCHAR) END AS items FROM ev",
    ),
)
def prj06(t: Tables):
    k = F.col("k").cast("string")
    text = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit(" a,b ;; "), k))
        .when(F.col("k") % 4 == 1, F.concat(F.lit("a,c| "), k, F.lit("|")))
        .when(F.col("k") % 4 == 2, F.concat(F.lit("a , ,"), k))
        .otherwise(F.concat(F.lit(" "), k, F.lit(" ")))
    )
    return ad.events(t).select("event_id", F.array_join(c.split_list(text), "+").alias("items"))


@query(
    "prj07_reasons",
    with_ctes(
        "change_journal",
        select="SELECT usn, array_to_string(update_reasons, '+') AS reasons FROM change_journal",
    ),
)
def prj07(t: Tables):
    text = ad.pick(F.col("event_type"), ad.journal_reasons())
    return t.events.select(
        F.col("event_id").alias("usn"), F.array_join(c.reasons(text), "+").alias("reasons")
    )


@query(
    "prj08_extra_map",
    with_ctes(
        "ev",
        select="SELECT event_id, event_type AS kind, 'C:\\x:' || k AS path, CAST(2 AS INTEGER) AS n FROM ev",
    ),
)
def prj08(t: Tables):
    text = F.concat(
        F.lit("kind: old; none; path : C:\\x:"), F.col("k").cast("string"), F.lit(" ; kind:"), "event_type"
    )
    extra = c.extra_map(text)
    return ad.events(t).select(
        "event_id", extra["kind"].alias("kind"), extra["path"].alias("path"), F.size(extra).alias("n")
    )


@query(
    "prj09_l2t_timestamp",
    "SELECT event_id, CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) + CASE event_id % 4 WHEN 0 THEN 0 "
    "WHEN 1 THEN 18000000000 WHEN 2 THEN -7200000000 ELSE 0 END AS ts_us FROM events",
)
def prj09(t: Tables):
    kind = F.col("event_id") % 4
    date = F.when(kind == 3, F.date_format("ts", "yyyy-MM-dd")).otherwise(
        F.date_format("ts", "M/d/yyyy")
    )
    zone = F.when(kind == 0, "UTC").when(kind == 1, "EST").when(kind == 2, "+02:00").otherwise("")
    at = c.zoned_instant(date, F.date_format("ts", "HH:mm:ss"), zone)
    return t.events.select("event_id", c.micros(at).alias("ts_us"))


@query(
    "prj10_sha1_strip",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN substr(sha256(p_name), 1, 40) ELSE NULL END "
    "AS sha1 FROM part",
)
def prj10(t: Tables):
    sha = F.upper(F.sha2(F.col("p_name").cast("binary"), 256))
    cell = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("0000"), F.substring(sha, 1, 40)))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("1000"), F.substring(sha, 1, 40)))
        .otherwise(F.concat(F.lit("0000"), F.substring(sha, 1, 39)))
    )
    return t.part.select("p_partkey", c.sha1_of_file_id(cell).alias("sha1"))


@query(
    "prj11_run_times",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN l_linestatus ELSE "
    "l_returnflag || '+' || l_linestatus END AS times FROM lineitem",
)
def prj11(t: Tables):
    first = F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag"))
    times = c.run_times(first, F.lit(None).cast("string"), F.col("l_linestatus"), F.lit(""))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_join(times, "+").alias("times")
    )


@query(
    "prj12_listing_normalize",
    "SELECT doc_id, source || '/' || lang AS filename, doc_id % 4 <> 0 AS deleted, doc_id AS inode "
    "FROM documents",
)
def prj12(t: Tables):
    doc = F.col("doc_id")
    name = F.concat(F.lit("/"), "source", F.lit("/"), "lang")
    shown = (
        F.when(doc % 4 == 1, F.concat(name, F.lit("  (realloc)")))
        .when(doc % 4 == 2, F.concat(name, F.lit("(deleted)")))
        .otherwise(name)
    )
    inode = F.concat(F.when(doc % 4 == 3, "*").otherwise(""), doc.cast("string"), F.lit("-144-2"))
    return t.documents.select(
        "doc_id",
        c.listing_name(shown).alias("filename"),
        c.listing_deleted(shown, inode).alias("deleted"),
        c.listing_inode(inode).alias("inode"),
    )


@query(
    "prj13_inode_name",
    with_ctes(
        "files",
        select="SELECT inode, inode || ':' || replace(regexp_extract(filename, '([^/]*)$', 1), "
        "' ($FILE_NAME)', '') AS item FROM files",
    ),
)
def prj13(t: Tables):
    return ad.file_listing(t).select(
        "inode", c.inode_name(F.col("inode"), F.col("filename")).alias("item")
    )


@query(
    "prj14_scrub_volatile",
    "SELECT doc_id, sha256(text || '<a.B object at 0xMEMADDR>' || lang) AS digest FROM documents",
)
def prj14(t: Tables):
    """The volatile column is dropped and addresses are replaced before hashing."""
    rows = t.documents.select(
        "doc_id",
        F.concat("text", F.lit("<a.B object at 0x"), F.hex("n_chars"), F.lit(">"), "lang").alias("cell"),
        F.uuid().alias("PluginDetailFile"),
    ).drop("PluginDetailFile")
    return rows.select(
        "doc_id", F.sha2(c.scrub_addresses(F.col("cell")).cast("binary"), 256).alias("digest")
    )


@query(
    "prj15_normalize_path",
    "SELECT page_id, rtrim(regexp_replace(replace(lower(trim(url)), '/', '\\'), '\\\\+', '\\\\', 'g'), '\\') "
    "AS path FROM pages",
)
def prj15(t: Tables):
    return t.pages.select("page_id", c.normalize_path(F.col("url")).alias("path"))


# --- filters --------------------------------------------------------------------------


@query(
    "flt01_event_filter",
    with_ctes(
        "event_log",
        select=f"SELECT host, record_number, {MICROS}, event_id AS event_code, user_name FROM event_log "
        "WHERE event_id IN (4624, 4625) AND ts BETWEEN TIMESTAMP '2024-01-05' AND "
        "TIMESTAMP '2024-01-20 12:00:00' AND channel = 'Security' AND user_sid = 'S-1-5-21-8'",
    ),
)
def flt01(t: Tables):
    rows = flt.event_filter(
        ad.event_log(t), [4624, 4625], "2024-01-05 00:00:00", "2024-01-20 12:00:00", "Security",
        "S-1-5-21-8",
    )
    return rows.select(
        "host", "record_number", _us(), F.col("event_id").alias("event_code"), "user_name"
    )


@query(
    "flt02_path_contains",
    with_ctes(
        "file_entries",
        select="SELECT entry_number, full_path FROM file_entries WHERE "
        "contains(lower(full_path), '9_100%')",
    ),
)
def flt02(t: Tables):
    return flt.path_contains(ad.file_entries(t), "9_100%").select("entry_number", "full_path")


@query(
    "flt03_active_since",
    with_ctes(
        "file_entries",
        select="SELECT entry_number FROM file_entries WHERE "
        "greatest(si_created, si_modified, fn_created, fn_modified) >= TIMESTAMP '2000-06-01'",
    ),
)
def flt03(t: Tables):
    return flt.active_since(ad.file_entries(t), "2000-06-01 00:00:00").select("entry_number")


@query(
    "flt04_journal_filter",
    with_ctes(
        "change_journal",
        select="SELECT usn, file_name FROM change_journal WHERE (list_contains(update_reasons, "
        "'FileDelete') OR list_contains(update_reasons, 'DataOverwrite')) AND (usn % 7 = 0 OR "
        "ts >= TIMESTAMP '2024-01-10')",
    ),
)
def flt04(t: Tables):
    rows = ad.change_journal(t).withColumn("ts", F.when(F.col("usn") % 7 != 0, F.col("ts")))
    kept = flt.journal_filter(rows, ["FileDelete", "DataOverwrite"], "2024-01-10 00:00:00")
    return kept.select("usn", "file_name")


@query(
    "flt05_program_filter",
    with_ctes(
        "inventory",
        select="SELECT sha1, name FROM inventory WHERE sha1 IN (SELECT substr(sha256(p_name || "
        "p_partkey), 1, 40) FROM part WHERE p_size > 25) AND contains(lower(name), 'prog1')",
    ),
)
def flt05(t: Tables):
    wanted = t.part.where("p_size > 25").select(
        F.upper(
            F.substring(
                F.sha2(F.concat("p_name", F.col("p_partkey").cast("string")).cast("binary"), 256), 1, 40
            )
        ).alias("sha1")
    )
    return flt.program_filter(ad.inventory(t), wanted, "PROG1").select("sha1", "name")


@query(
    "flt06_exec_filter",
    with_ctes(
        "executions",
        select="SELECT source_filename, run_count FROM executions WHERE contains(lower(executable_name), "
        "'og7') OR contains(lower(source_filename), 'og7')",
    ),
)
def flt06(t: Tables):
    return flt.execution_filter(ad.executions(t), "OG7").select("source_filename", "run_count")


@query(
    "flt07_plugin_filter",
    with_ctes(
        "registry",
        select="SELECT host, plugin, value_name FROM registry WHERE plugin IN ('RunKeys', 'Services')",
    ),
)
def flt07(t: Tables):
    return flt.plugin_filter(ad.registry(t), ["RunKeys", "Services"]).select(
        "host", "plugin", "value_name"
    )


@query(
    "flt08_severity_technique",
    with_ctes(
        "rule_hits",
        select="SELECT record_id, level FROM rule_hits WHERE level IN ('medium', 'high', 'critical') AND "
        "(list_contains(mitre_techniques, 'T1550.002') OR list_contains(mitre_techniques, 'T9998'))",
    ),
)
def flt08(t: Tables):
    return flt.severity_technique(ad.rule_hits(t), "Medium", ["T1550.002", "T9998"]).select(
        "record_id", "level"
    )


@query(
    "flt09_timeline_filter",
    with_ctes(
        "timeline_rows",
        select=f"SELECT record_key, {MICROS} FROM timeline_rows WHERE ts BETWEEN TIMESTAMP '2024-01-03' "
        "AND TIMESTAMP '2024-01-25' AND source_short IN ('EVT', 'LOG') AND parser_name IN ('parser1', "
        "'parser2') AND contains(lower(description), 'r 1')",
    ),
)
def flt09(t: Tables):
    rows = flt.timeline_filter(
        ad.timeline_rows(t), "2024-01-03 00:00:00", "2024-01-25 00:00:00", ["EVT", "LOG"],
        ["parser1", "parser2"], "R 1",
    )
    return rows.select("record_key", _us())


@query(
    "flt10_search_prefilter",
    with_ctes(
        "files",
        select="SELECT inode, filename FROM files WHERE NOT deleted AND contains(lower(filename), 'en-1') "
        "AND file_size_bytes > 0 AND file_size_bytes <= 3000",
    ),
)
def flt10(t: Tables):
    return flt.search_prefilter(ad.file_listing(t), "EN-1", False, 3000).select("inode", "filename")


@query(
    "flt11_question_filter",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey % 5 = 2 AND o_orderkey % 3 <> 0 "
    "AND o_orderstatus IN ('F', 'P')",
)
def flt11(t: Tables):
    digit = (F.col("o_custkey") % 5).cast("string")
    image = F.when(F.col("o_orderkey") % 3 != 0, F.upper(F.repeat(F.concat(F.lit("a"), digit), F.lit(32))))
    rows = t.orders.withColumn("image_sha256", image).withColumn(
        "mitre_techniques", F.array(F.concat(F.lit("T"), "o_orderstatus"), F.lit("T0"))
    )
    return flt.question_filter(rows, "a2" * 32, ["TF", "TP"]).select("o_orderkey", "o_orderpriority")
