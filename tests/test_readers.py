"""Readers on small export files."""

import json

import pytest
from pyspark.sql import functions as F

from attestlake.operators import detectors as det, filters as flt, timeline as tml
from attestlake.sources import artifacts as src, stores


def write(folder, name, *lines, bom=False):
    path = folder / name
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + "\n".join(lines).encode() + b"\n")
    return str(path)


def event_file(folder):
    def payload(**data):
        items = [{"@Name": k, "#text": v} for k, v in data.items()]
        return json.dumps({"EventData": {"Data": items}}).replace('"', '""')

    net = payload(LogonType="3", AuthenticationPackageName="NTLM", IpAddress="10.0.0.42",
                  TargetUserName="alice")
    desk = payload(LogonType="2", AuthenticationPackageName="Kerberos")
    return write(
        folder,
        "events.csv",
        "RecordNumber,TimeCreated,EventId,Level,Provider,Channel,Computer,UserId,UserName,RemoteHost,"
        "PayloadData1,PayloadData2,Payload",
        f'17,2026-04-12T14:32:01.1234567Z,4624,Info,Audit,Security,WS01,S-1-5-21,,,,LogonType 9,"{net}"',
        f'18,2026-04-12T15:00:00Z,4624,Info,Audit,Security,WS01,S-1-5-18,bob,1.2.3.4,,,"{desk}"',
        "19,2026-04-12T15:00:00Z,oops,Info,Audit,Security,WS01,,,,,,",
        '20,,,Info,Audit,System,,,,,3,"two\nlines",',
        bom=True,
    )


def test_event_log(spark, folder):
    df = src.read_event_log(spark, event_file(folder), host="WS01", multi_line=True)
    rows = {r.record_number: r for r in df.collect()}
    assert set(rows) == {17, 18, 20}
    assert (rows[17].logon_type, rows[17].auth_package, rows[17].source_ip) == (3, "NTLM", "10.0.0.42")
    assert rows[17].user_name == "alice" and rows[17].user_sid == "S-1-5-21"
    assert rows[17].ts.microsecond == 123456
    assert (rows[18].logon_type, rows[18].auth_package, rows[18].user_name) == (2, "Kerberos", "bob")
    assert rows[20].event_id == 0 and rows[20].logon_type == 3 and rows[20].computer is None
    kept = flt.event_filter(df, [4624], "2026-04-12 14:32:02", None, "Security", "S-1-5-18")
    assert [r.record_number for r in kept.collect()] == [18]


FILE_HEADER = (
    "EntryNumber,SequenceNumber,ParentEntryNumber,InUse,IsDirectory,FileName,Extension,ParentPath,"
    "FileSize,Created0x10,LastModified0x10,Created0x30,LastModified0x30,HasAds"
)


def test_file_entries(spark, folder):
    path = write(
        folder,
        "mft.csv",
        FILE_HEADER,
        "5,5,,True,True,.,,,0,2020-01-01 00:00:00,2020-01-01 00:00:00,2020-01-01 00:00:00,,no",
        "100,1,5,1,False,psexesvc.exe,.exe,C:\\Windows\\,1024,2018-01-01 00:00:00,2018-01-01 00:00:00,"
        "2026-04-12 14:32:01,2026-04-12 14:32:01,yes",
        "101,x,5,0,False,notes.txt,.txt,C:\\Users/,-7,2026-04-01 00:00:05,,2026-04-01 00:00:10,,",
        "bad,1,5,0,False,skip.txt,.txt,C:\\,1,,,,,",
    )
    df = src.read_file_entries(spark, path)
    rows = {r.entry_number: r for r in df.collect()}
    assert set(rows) == {5, 100, 101}
    assert rows[100].full_path == "C:\\Windows\\psexesvc.exe" and rows[100].in_use
    assert rows[100].has_alternate_data_streams and rows[100].entry_offset == 102400
    assert rows[101].file_size is None and rows[101].sequence_number == 0
    assert [r.entry_number for r in det.timestomp(df).collect()] == [100]
    assert [r.entry_number for r in flt.path_contains(df, "PSEXE").collect()] == [100]
    since = flt.active_since(df, "2026-04-01 00:00:10")
    assert sorted(r.entry_number for r in since.collect()) == [100, 101]


def test_change_journal(spark, folder):
    head = "Name,Extension,EntryNumber,SequenceNumber,ParentPath,UpdateSequenceNumber,UpdateTimestamp,UpdateReasons"
    path = write(
        folder,
        "usn.csv",
        head,
        "mimi.exe,.exe,12340,2,C:\\Temp,1,2026-04-12 14:00:00,RenameOldName",
        "svchost-helper.exe,.exe,12340,2,C:\\Temp,2,2026-04-12 14:00:00,RenameNewName|Close",
        "a.txt,.txt,1,1,,3,2026-04-12 14:01:00,FileDelete| Close",
        "b.txt,.txt,2,1,,4,,FileCreate",
        "c.txt,.txt,3,1,,none,2026-04-12 14:01:00,FileDelete",
    )
    df = src.read_change_journal(spark, path)
    assert df.count() == 4
    assert [r.file_name for r in det.deletions(df).collect()] == ["a.txt"]
    pairs = det.rename_pairs(df).collect()
    assert [(r.file_record_number, r.old_name, r.new_name) for r in pairs] == [
        (12340, "mimi.exe", "svchost-helper.exe")
    ]
    late = flt.journal_filter(df, since="2026-04-12 14:00:30")
    assert sorted(r.usn for r in late.collect()) == [3, 4]


def test_program_inventory(spark, folder):
    sha = "AB" * 20
    path = write(
        folder,
        "amcache.csv",
        "ApplicationName,FileId,Path,Size,IsPeFile,IsOsComponent",
        f"tool.exe,0000{sha},C:\\t\\tool.exe,12,True,",
        ",0001short,C:\\x.exe,,False,1",
        "none, ,C:\\y.exe,1,,",
    )
    df = src.read_program_inventory(spark, path)
    rows = {r.name: r for r in df.collect()}
    assert set(rows) == {"tool.exe", "C:\\x.exe"}
    assert rows["tool.exe"].sha1 == sha.lower() and rows["tool.exe"].is_os_component is None
    assert rows["C:\\x.exe"].sha1 is None and rows["C:\\x.exe"].is_os_component is True
    assert [r.name for r in flt.program_filter(df, [" " + sha]).collect()] == ["tool.exe"]
    many = [f"{i:040x}" for i in range(1500)] + [sha]
    assert [r.name for r in flt.program_filter(df, many).collect()] == ["tool.exe"]


def test_execution_history(spark, folder):
    path = write(
        folder,
        "pf.csv",
        "SourceFilename,ExecutableName,Hash,RunCount,LastRun,PreviousRun0,PreviousRun1,Files",
        "PSEXESVC.EXE-1.pf,PSEXESVC.EXE,1,3,2026-04-12 14:32:01,2026-04-12 14:00:00, ,a|b",
        "CMD.EXE-2.pf,CMD.EXE,2,,2026-04-11 00:00:00,,,",
        ",x,3,1,,,,",
    )
    df = src.read_execution_history(spark, path)
    rows = {r.executable_name: r for r in df.collect()}
    assert rows["psexesvc.exe"].all_run_times == ["2026-04-12 14:32:01", "2026-04-12 14:00:00"]
    assert rows["cmd.exe"].run_count == 0 and len(rows) == 2
    assert [r.hash for r in flt.execution_filter(df, "psexe").collect()] == ["1"]


def test_registry(spark, folder):
    lines = [
        "HiveType,Description,Category,KeyPath,ValueName,ValueData,LastWriteTimestamp",
        "SOFTWARE,RunKeys,Autoruns,HKLM\\Run,upd,C:\\Users\\Public\\u.exe,2026-04-12 00:00:00",
        "SOFTWARE,TaskCache,Tasks,HKLM\\Tasks,x,Orphaned tree entry,2026-04-12 00:00:00",
        "SYSTEM,Services,Services,HKLM\\Services,svc,C:\\svc.exe,",
        "NTUSER,,UserAssist,HKCU\\UA,ua,,",
        "NTUSER,RecentDocs,Docs,HKCU\\Recent,doc,readme.txt,",
    ]
    plain = src.read_registry_findings(spark, write(folder, "r.csv", *lines))
    more = [line + ("," + ("PluginDetailFile" if i == 0 else f"/tmp/{i}/out.csv")) for i, line in enumerate(lines)]
    with_path = src.read_registry_findings(spark, write(folder, "r2.csv", *more))
    assert sorted(r.plugin for r in det.persistence(plain).collect()) == [
        "RunKeys", "Services", "TaskCache", "UserAssist",
    ]
    assert [r.value_name for r in det.hidden_tasks(plain).collect()] == ["x"]
    assert [r.value_name for r in det.run_keys(plain).collect()] == ["upd"]
    same = [df.drop("source_file").orderBy("value_name").collect() for df in (plain, with_path)]
    assert same[0] == same[1]


def test_rule_hits(spark, folder):
    path = write(
        folder,
        "hits.csv",
        "Timestamp,Computer,Channel,EventID,Level,RuleTitle,RuleID,MitreTactics,MitreTechniques,Status,RecordID",
        "2026-04-12 14:32:01,WS01,Security,4624,HIGH,pth,r1,TA0008,T1550.002;T1078,,17",
        "2026-04-12 14:33:01,WS01,Security,7045,medium,svc,r2,TA0002,T1021.002,test,18",
        "2026-04-12 14:34:01,WS01,Security,1,low,noise,r3,,,,19",
        "2026-04-12 14:34:01,WS01,Security,1,weird,drop,r4,,,,20",
    )
    df = src.read_rule_hits(spark, path)
    assert df.count() == 3
    assert flt.severity_technique(df, "medium").count() == 2
    assert [r.rule_id for r in flt.severity_technique(df, None, ["T1550.002"]).collect()] == ["r1"]
    assert det.lateral_hits(df).count() == 2


def test_timeline(spark, folder):
    head = "date,time,timezone,MACB,source,sourcetype,type,user,host,short,desc,version,filename,inode,notes,format,extra"
    at = lambda time, zone="UTC", extra="": (
        f"04/12/2026,{time},{zone},M...,EVT,Log,Logon,alice,WS01,s,logon,2,C:\\x,5,-,winevtx,{extra}"
    )
    path = write(
        folder,
        "l2t.csv",
        head,
        at("14:31:56"),
        at("14:32:01", extra="logon_type: 3; authentication_package: NTLM; path: C:\\a:b"),
        at("14:32:05"),
        at("10:32:10", "EDT"),
        at("14:32:11"),
        at("14:31:55"),
        ",,UTC,M...,EVT,Log,Logon,a,b,s,none,2,f,5,-,p,",
    )
    df = src.read_timeline(spark, path)
    assert df.count() == 6
    near = tml.correlate_around(df, "2026-04-12T14:32:01Z", 5, 10)
    assert sorted(r.ts.strftime("%M:%S") for r in near.collect()) == ["31:56", "32:01", "32:05", "32:11"]
    assert tml.correlate_around(df, "2026-04-12T10:32:10-04:00", 9, 10).count() == 3
    assert tml.correlate_around(df, "not a time").count() == 0
    extra = df.where(F.size("extra") > 0).first().extra
    assert extra == {"logon_type": "3", "authentication_package": "NTLM", "path": "C:\\a:b"}


def test_memory_rows(spark, folder):
    (folder / "a.jsonl").write_text('{"PID": 4, "ImageFileName": "System"}\n\n{"PID": 8, "ImageFileName": "lsass.exe"}\n')
    (folder / "b.json").write_text('[{"PID": 5}, 7]')
    (folder / "c.csv").write_text('PID,ImageFileName\n9,"a, ""b"".exe"\n')
    (folder / "d.txt").write_text("Volatile framework banner only")
    (folder / "e.txt").write_text("")
    df = src.read_memory_rows(spark, str(folder), "windows.pslist.PsList")
    got = df.select(
        F.regexp_extract("source_file", "([^/]*)$", 1).alias("f"), "row_index",
        F.to_json("data").alias("d"), "banner",
    )
    rows = {(r.f, r.row_index): (r.d, r.banner) for r in got.collect()}
    assert rows[("a.jsonl", 0)][0] == '{"ImageFileName":"System","PID":4}'
    assert rows[("a.jsonl", 2)][0] == '{"ImageFileName":"lsass.exe","PID":8}'
    assert rows[("b.json", 1)][0] == '{"value":7}'
    assert rows[("c.csv", 0)][0] == '{"ImageFileName":"a, \\"b\\".exe","PID":"9"}'
    assert rows[("d.txt", None)] == (None, "Volatile framework banner only")
    assert len(rows) == 6
    lines = src.read_memory_rows(spark, str(folder / "a.jsonl"), "windows.pslist.PsList", "jsonl")
    assert sorted(r.pid for r in det.processes(lines).collect()) == [4, 8]


def test_body_file(spark, folder):
    path = write(
        folder,
        "body.txt",
        "# comment",
        '0|/docs/"quoted".txt|122155-128-1|r|0|0|40|1|1|1|1',
        "0|/gone.txt (deleted)|122160|r|0|0|41|1|1|1|1",
        "0|/old.txt|*122161-144-2|r|0|0|x|1|1|1|1",
        "0|short|1",
        "0|/|5|r|0|0|0|1|1|1|1",
    )
    rows = {r.inode: r for r in src.read_body_file(spark, path).collect()}
    assert set(rows) == {122155, 122160, 122161}
    assert rows[122155].filename == 'docs/"quoted".txt' and not rows[122155].deleted
    assert rows[122160].filename == "gone.txt" and rows[122160].deleted
    assert rows[122161].deleted and rows[122161].file_size_bytes == 0


def test_questions_in_three_shapes(spark, folder):
    nested = {"questions": [{"question": "q?", "answer": ["2:b", "1:a"]}, {"question": "n?", "answer": " 42 "}]}
    (folder / "nss.json").write_text(json.dumps(nested))
    native = {"question_id": "x", "question_text": "t", "answer_type": "sid", "expected_answer": "S-1"}
    (folder / "array.json").write_text(json.dumps([native]))
    (folder / "lines.jsonl").write_text(json.dumps(native) + "\n\n" + json.dumps(native | {"question_id": "y"}) + "\n")
    read = lambda name: stores.read_questions(spark, str(folder / name)).orderBy("question_id").collect()
    first = read("nss.json")
    assert [(r.question_id, r.answer_type, r.expected_answer) for r in first] == [
        ("nss-0000", "nss_inode_filename_list", '["1:a","2:b"]'),
        ("nss-0001", "numeric", "42"),
    ]
    assert [r.question_id for r in read("array.json")] == ["x"]
    assert [r.question_id for r in read("lines.jsonl")] == ["x", "y"]


def test_digest_files(spark, folder):
    import hashlib

    (folder / "seg.000").write_bytes(b"\x00\xff" * 100)
    row = stores.digest_files(spark, str(folder)).first()
    assert row.sha256 == hashlib.sha256(b"\x00\xff" * 100).hexdigest() and row.size_bytes == 200


def headed(folder, second, cells):
    """Two exports of one kind: the columns reversed in the second, which has a BOM and lacks one column."""
    names = list(cells)
    kept = [n for n in reversed(names) if n != second]
    (folder / "a b").mkdir()
    write(folder / "a b", "one.csv", ",".join(names), ",".join(cells[n] for n in names))
    write(folder / "a b", "two.csv", ",".join(kept), ",".join(cells[n] for n in kept), bom=True)
    write(folder / "a b", "three.csv", ",".join(names))


def test_each_file_is_read_by_its_own_header(spark, folder):
    kinds = {
        "event_log": {"RecordNumber": "7", "EventId": "4624", "Level": "Info", "Channel": "Security", "Computer": "W"},
        "file_entries": {"EntryNumber": "7", "SequenceNumber": "1", "InUse": "True", "FileName": "f", "ParentPath": "p"},
        "change_journal": {"Name": "n", "EntryNumber": "7", "SequenceNumber": "2", "UpdateSequenceNumber": "9", "UpdateReasons": "FileDelete"},
        "program_inventory": {"ApplicationName": "a", "FileId": "0000" + "a" * 40, "Path": "p", "Size": "3", "Publisher": "x"},
        "execution_history": {"SourceFilename": "s", "ExecutableName": "e", "Hash": "H", "RunCount": "7", "Size": "1"},
        "registry_findings": {"HivePath": "h", "Category": "c", "KeyPath": "k", "ValueName": "v", "ValueData": "7"},
        "rule_hits": {"Timestamp": "2024-01-01T00:00:00Z", "RuleTitle": "r", "EventID": "7", "Level": "high", "Channel": "c"},
        "timeline": {"date": "01/02/2024", "time": "00:00:01", "timezone": "UTC", "desc": "d", "filename": "f", "version": "2"},
    }
    for kind, cells in kinds.items():
        place = folder / kind
        place.mkdir()
        headed(place, list(cells)[-1], cells)
        rows = getattr(src, f"read_{kind}")(spark, str(place / "a b")).collect()
        assert len(rows) == 2, kind
        one, two = (r.asDict() for r in sorted(rows, key=lambda r: "two.csv" in r.source_file))
        differing = {n for n in one if n != "source_file" and one[n] != two[n]}
        assert len(differing) <= 2, (kind, differing)  # only what the missing column feeds


def test_plain_exports_are_splittable(spark, folder):
    rows = [f'{i},2024-01-01T00:00:00Z,4624,"a ""b"", c"' for i in range(2000)]
    path = write(folder, "big.csv", "RecordNumber,TimeCreated,EventId,Channel", *rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        log = src.read_event_log(spark, path)
        assert log.rdd.getNumPartitions() > 2
        assert log.count() == 2000 and log.where("channel = 'a \"b\", c'").count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def csv_text(rng, rows):
    """Cells with breaks, quotes, commas, blanks and quotes in the middle of plain cells."""
    parts = ["a", "b,c", '"', "\n", "\r\n", "é😀", " ", '""', ",", "x\ny", "", "\n\n"]
    out = ["n,first,second,last"]
    for n in range(rows):
        cells = [str(n)]
        for _ in range(3):
            cell = "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
            if rng.random() < 0.2:
                cell = rng.choice(['5" disk', 'say "hi" now', "plain"])  # quotes within a plain cell are text
            elif rng.random() < 0.9 or any(c in cell for c in '",\n\r'):
                cell = '"' + cell.replace('"', '""') + '"'
            cells.append(cell)
        out.append(",".join(cells))
        if rng.random() < 0.05:
            out.append("")
    return "\n".join(out) + "\n"


def test_files_are_split_within_cells(spark, folder):
    """Files cut into parts of a few bytes give the rows of whole files, line breaks in cells included."""
    import random

    from attestlake.sources import exports

    rng = random.Random(5)
    for i in range(3):
        (folder / f"part{i}.csv").write_bytes(csv_text(rng, 60).encode())
    (folder / "empty.csv").write_bytes(b"")
    (folder / "head.csv").write_bytes(b"n,first,second,last\n")
    (folder / "open.csv").write_bytes(b'n,first,second,last\n1,"never, closed\n2,a,b,c')
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    want = sorted(map(str, src.read_rows(spark, str(folder), multi_line=True).drop("source_file").collect()))
    assert len(want) > 170 and any("\\n" in w for w in want)
    try:
        for size in ("37", "300", "100000"):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], "0")
            found = src.read_rows(spark, str(folder))
            assert sorted(map(str, found.drop("source_file").collect())) == want, size
            assert found.select("source_file").distinct().count() == 4
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    given = src.read_rows(spark, str(folder), names=["n", "first", "second", "last"]).drop("source_file")
    assert sorted(map(str, given.collect())) == want
    assert exports.column_names('a,"b ,c",,A') == ["a0", "b ,c", "_c2", "A3"]


@pytest.mark.parametrize(
    "line, outside, inside",
    [
        ("", False, True),
        ("a,b", False, True),
        ('"a', True, False),
        ('a"', False, False),
        ('"a""', True, False),
        ('"a"",b', True, False),
        ('a,"b', True, False),
        ('x" , "y",z', False, False),
        ('""', False, True),
        ('5" disk,"open', True, True),
        ('"","', True, False),
    ],
)
def test_lines_that_end_inside_quotes(line, outside, inside):
    from attestlake.sources.exports import ends_open

    assert (ends_open(line, False), ends_open(line, True)) == (outside, inside)


def test_lines_are_followed_as_bytes():
    """Bytes that are no UTF-8 are followed too, and a long line takes time in proportion to its length."""
    import pyarrow as pa

    from attestlake.sources.exports import _followed

    lines = [b'1,"\xff', b'\xfe"', b'2,\xff"', b'3,"' + b'x""' * 300_000 + b'"']
    value = pa.array(lines, pa.binary()).view(pa.string())
    given = [pa.array(["f"] * 4), pa.array([0] * 4, pa.int64()), pa.array(range(4), pa.int64()), value]
    batch = pa.RecordBatch.from_arrays(given, names=["file", "block", "at", "value"])
    found = list(_followed(iter([batch])))[0]
    assert found.column("open").to_pylist() == [True, False, False, False]
    assert found.column("start").to_pylist() == [0, 0, 2, 3]


def test_lines_of_exports_are_not_shuffled(spark, folder):
    """Lines meet what is known of their part of a file where they are, and their cells are read in one place."""
    headed(folder, "Channel", {"RecordNumber": "1", "EventId": "4624", "Channel": "c"})
    log = src.read_event_log(spark, str(folder / "a b"))
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == plan.count("Join ") > 0
    assert all("from_csv" not in line for line in plan.splitlines() if "Filter" in line)
    assert log.count() == 2
