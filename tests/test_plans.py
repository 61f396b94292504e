"""What the physical plans may not hold, and work cut by blocks against the plain form."""

import pytest
from conftest import SF
from pyspark.sql import Window, functions as F

from attestlake.plans import catalog
from attestlake.operators import blocks, detectors as det, filters as flt, timeline as tml
from attestlake.plans import adapters as ad

BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "SinglePartition")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Global results (one row, or a top-k) end in one partition by what they are, and so does the list of
# images that a search takes as a one-row subquery.
GLOBAL = ("ben06", "ben09", "ben18", "ben10", "rcp02_table", "sch01", "sch03", "sch04", "sch05", "sch07")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_plan(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    for word in BANNED:
        if word == "SinglePartition" and name.startswith(GLOBAL):
            continue
        assert word not in text, word
    for line in text.splitlines():
        if "Window [" in line or "Window(" in line:
            assert "[]" not in line.split("],", 1)[-1][:4], line


def test_filters_reach_the_scan(spark, tables):
    text = plan(flt.event_filter(ad.event_log(tables), [4624], "2024-01-05 00:00:00").select("record_number"))
    assert "GreaterThanOrEqual(ts,2024-01-05" in text
    scan = [line for line in text.splitlines() if "FileScan" in line][0]
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,props:string>" in scan
    text = plan(tml.correlate_around(ad.timeline_rows(tables), "2024-01-15T12:00:00Z", 5, 5).select("record_key"))
    assert "GreaterThanOrEqual(ts,2024-01-15T11:59:55" in text and "LessThanOrEqual(ts" in text


def test_content_is_not_read_for_a_listing(spark, tables):
    text = plan(flt.search_prefilter(ad.file_listing(tables), "en-1", False).select("inode"))
    assert "cast(text" not in text


def test_previous_row_by_blocks_is_lag(spark):
    rows = [("hot" if i % 10 else "cold", i * 7 % 5000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, n bigint, v int").dropDuplicates(["k", "n"])
    w = Window.partitionBy("k").orderBy("n")
    plain = df.select("k", "n", "v", F.lag("n").over(w).alias("prev_n"), F.lag("v").over(w).alias("prev_v"))
    for width in (1, 13, 1000, 100000):
        got = blocks.with_previous(df, ["k"], "n", ["v"], width)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_gaps_do_not_depend_on_block_width(spark, tables):
    log = ad.event_log(tables)
    one = sorted(map(tuple, det.record_gaps(log, 10).collect()), key=repr)
    assert one == sorted(map(tuple, det.record_gaps(log, 10**9).collect()), key=repr)


@pytest.mark.parametrize("salt", [1, 4])
def test_interval_join_is_the_plain_join(spark, tables, salt):
    events = ad.timeline_rows(tables).select("host", "ts", "record_key")
    # A third of all rows at one moment.
    events = events.withColumn(
        "ts", F.when(F.col("record_key") % 3 == 0, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts"))
    )
    anchors = events.where("record_key % 40 = 0").select("host", "ts", F.col("record_key").alias("key"))
    got = tml.correlate_anchors(events, anchors, 600, 30, salt=salt).select("anchor_key", "record_key")
    low, high = F.expr("a.ts - interval 600 seconds"), F.expr("a.ts + interval 30 seconds")
    want = events.alias("e").join(anchors.alias("a"), F.col("e.ts").between(low, high)).select("a.key", "e.record_key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_supertimeline_is_sorted_when_written(spark, tables, folder):
    line = tml.supertimeline(tml.from_event_log(ad.event_log(tables)), tml.from_rule_hits(ad.rule_hits(tables)))
    path = str(folder / "timeline")
    tml.write_sorted(line, path, 4)
    import pyarrow.parquet as pq

    files = sorted(p for p in (folder / "timeline").iterdir() if p.name.startswith("part-"))
    stamps = [v for f in files for v in pq.read_table(f).column("ts").to_pylist()]
    assert stamps == sorted(stamps) and len(stamps) == line.count()


def test_memory_and_credentials(spark):
    rows = [
        ("h", "windows.handles.Handles", '{"PID":1,"Process":"evil.exe","Name":"\\\\Device\\\\lsass.exe","GrantedAccess":"PROCESS_VM_READ|PROCESS_QUERY_LIMITED"}'),
        ("h", "windows.handles.Handles", '{"PID":2,"Process":"MsMpEng.exe","Name":"lsass.exe","GrantedAccess":"PROCESS_VM_READ|PROCESS_QUERY"}'),
        ("h", "windows.handles.Handles", '{"PID":3,"Process":"x.exe","Name":"lsass.exe","GrantedAccess":"SYNCHRONIZE"}'),
        ("h", "windows.lsadump.Cachedump", '{"Key":"NL$KM","Secret":"aa"}'),
    ]
    df = spark.createDataFrame(rows, "host string, plugin string, json string").select(
        "host", "plugin", F.parse_json("json").alias("data")
    )
    assert [r.pid for r in det.lsass_handles(df).collect()] == [1]
    assert [r.key for r in det.secrets(df).collect()] == ["NL$KM"]
    names = ["C:\\Windows\\System32\\config\\SAM", "a/NTUSER.DAT", "notes.txt", "/root/.ssh/id_ed25519", "c:\\pagefile.sys"]
    listing = spark.createDataFrame([(n,) for n in names], "filename string")
    got = {r.filename: r.artifact_class for r in det.credential_files(listing).collect()}
    assert got == {
        names[0]: "registry_hive", names[1]: "registry_hive", names[3]: "ssh_private_key", names[4]: "pagefile",
    }
    assert det.credential_files(listing, classes=["pagefile"]).count() == 1
    assert det.credential_files(listing, max_files=2).count() == 2
