"""Replays by recorded arguments, against plain Python."""

import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attestlake.operators import replay
from attestlake.operators.receipts import EMPTY
from attestlake.operators.replay import Parameter

START = datetime(2024, 3, 1)
SOURCE = "host string, n bigint, code int, user string, tags array<string>, path string, at timestamp_ntz"
PARAMETERS = [
    Parameter("user", "is", "user"),
    Parameter("codes", "one of", "code"),
    Parameter("tags", "overlaps", "tags"),
    Parameter("path", "text", "path"),
    Parameter("range", "start", "at"),
    Parameter("range", "end", "at"),
    Parameter("since", "from", "at", nulls_pass=True),
]


def unordered(leaves):
    lanes = [sum(int(h[s : s + 15], 16) for h in leaves) for s in (0, 15, 30, 45)]
    return hashlib.sha256("|".join(map(str, [len(leaves), *lanes])).encode()).hexdigest()


def sources(rng, n):
    rows = []
    for i in range(n):
        rows.append(
            (
                rng.choice(["h1", "h2", None]),
                i,
                rng.choice([1, 2, 3, None]),
                rng.choice(["ann", "bob", None]),
                rng.choice([[], ["a"], ["a", "b"], ["b", "c", "b"], None, [None, "c"]]),
                rng.choice(["C:\\Users\\Ann", "C:\\tmp", "100%_x", None]),
                rng.choice([None, START + timedelta(hours=rng.randint(0, 2000))]),
            )
        )
    return rows


def keeps(args, row):
    host, _, code, user, tags, path, at = row
    time = lambda s: datetime.fromisoformat(s)
    if args.get("user") and user != args["user"]:
        return False
    if args.get("codes") and code not in args["codes"]:
        return False
    if args.get("tags") and not set(args["tags"]) & {t for t in tags or [] if t is not None}:
        return False
    if args.get("path") and (path is None or args["path"].lower() not in path.lower()):
        return False
    low, high = args.get("range") or (None, None)
    if low and not (at is not None and at >= time(low)) or high and not (at is not None and at <= time(high)):
        return False
    return not args.get("since") or at is None or at >= time(args["since"])


def some_args(rng):
    def hours(n):
        return str(START + timedelta(hours=n))

    low = rng.randint(0, 1800)
    options = {
        "user": [None, "", "ann", "bob", "nobody"],
        "codes": [None, [], [1], [1, 3, 3], [9]],
        "tags": [None, [], ["a"], ["b", "c"], ["c", "b", "a"], ["z"]],
        "path": [None, "", "users", "100%_", "tMP"],
        "range": [None, [], [hours(low), hours(low + 3)], [hours(low), hours(low + 200)], [hours(0), hours(9000)], [hours(low + 5), hours(low)]],
        "since": [None, "", hours(low)],
    }
    args = {k: rng.choice(v if rng.random() < 0.5 else v[:1]) for k, v in options.items()}
    return {k: v for k, v in args.items() if v is not None or rng.random() < 0.5}


def test_filters_are_those_that_were_recorded(spark):
    rng = random.Random(12)
    rows = sources(rng, 400)
    calls = [(i, rng.choice(["h1", "h2", None, "h3"]), some_args(rng)) for i in range(160)]
    calls += [(1000 + i, h, a) for i, (_, h, a) in enumerate(calls[:10])]  # the same calls by other receipts
    made = [(i, h, json.dumps(a), "x") for i, h, a in calls]
    made += [(2001, "h1", "{not json", "x"), (2002, "h1", json.dumps({"codes": ["many"]}), "x"), (2003, "h1", json.dumps({"since": "never"}), "x"), (2004, "h1", None, "x")]
    receipts = spark.createDataFrame(made, "receipt_id bigint, host string, args_canonical string, raw_digest string")
    raw = F.concat_ws("|", F.col("n").cast("string"), "path")
    found = {r.receipt_id: r for r in replay.replay_filtered(receipts, spark.createDataFrame(rows, SOURCE), PARAMETERS, ["host"], raw).collect()}
    assert len(found) == len(made)
    for i, host, args in calls:
        leaves = [hashlib.sha256("|".join(x for x in (str(r[1]), r[5]) if x is not None).encode()).hexdigest() for r in rows if r[0] == host and keeps(args, r)]
        assert found[i].problem is None
        assert found[i].raw_digest == (unordered(leaves) if leaves else EMPTY), (host, args)
    problems = {i: found[i].problem for i in (2001, 2002, 2003, 2004)}
    assert problems == {
        2001: "arguments are not valid JSON",
        2002: "argument codes cannot be read",
        2003: "argument since cannot be read",
        2004: "arguments are not valid JSON",
    }
    assert all(found[i].raw_digest is None for i in problems)
    drift = {r.receipt_id: r for r in replay.replay_drift(receipts, replay.replay_filtered(receipts, spark.createDataFrame(rows, SOURCE), PARAMETERS, ["host"], raw), ["receipt_id"]).collect()}
    assert drift[2002].replay_reason == "argument codes cannot be read" and not drift[2002].replay_ok


def test_overlapping_lists_count_a_row_once(spark):
    source = spark.createDataFrame([("h", 1, None, None, ["b", "a", "b"], "p", None)], SOURCE)
    receipts = spark.createDataFrame([(1, "h", '{"tags":["a","b","c"]}')], "receipt_id bigint, host string, args_canonical string")
    (row,) = replay.replay_filtered(receipts, source, PARAMETERS, ["host"], F.col("path")).collect()
    assert row.raw_digest == unordered([hashlib.sha256(b"p").hexdigest()])


def test_searches(spark):
    files = spark.createDataFrame(
        [("i1", 1, "a/One.txt", False, 9, bytearray(b"needle needle")), ("i1", 2, "b", True, 9, bytearray(b"NEEDLE")), ("i2", 3, "c", False, 9, bytearray("needle".encode("utf-16-le")))],
        "image string, inode bigint, filename string, deleted boolean, file_size_bytes bigint, content binary",
    )
    calls = [
        ("i1", {"pattern": "needle"}, [(1, 0, 2), (2, 0, 1)]),
        ("i1", {"pattern": "needle", "case_sensitive": True}, [(1, 0, 2)]),
        ("i1", {"pattern": "needle", "include_deleted": False, "max_matches_per_file": 1}, [(1, 0, 1)]),
        (None, {"pattern": "needle", "encodings": ["utf-16-le"]}, [(3, 0, 1)]),
        (None, {"pattern": "needle", "encodings": []}, [(1, 0, 2), (2, 0, 1), (3, 0, 1)]),
        ("i1", {"pattern": "needle", "name_substring": "ONE"}, [(1, 0, 2)]),
        ("i1", {"pattern": "needle", "max_file_size_bytes": 8}, []),
        ("i1", {"pattern": ""}, None),
        ("i1", {}, None),
    ]
    made = [(i, image, json.dumps(a)) for i, (image, a, _) in enumerate(calls)]
    receipts = spark.createDataFrame(made, "receipt_id bigint, image string, args_canonical string")
    found = {r.receipt_id: r for r in replay.replay_search(receipts, files).collect()}
    fields = {r.inode: r.asDict() for r in files.drop("content").collect()}
    for i, (_, _, hits) in enumerate(calls):
        if hits is None:
            assert found[i].raw_digest is None and found[i].problem == "argument pattern cannot be read"
            continue
        leaves = []
        for inode, at, n in hits:
            record = fields[inode] | {"first_match_offset": at, "total_match_count": n}
            leaves.append(hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest())
        assert found[i].raw_digest == (unordered(leaves) if leaves else EMPTY), i
    nothing = replay.replay_search(receipts.where("receipt_id = 8"), files).collect()
    assert [r.problem for r in nothing] == ["argument pattern cannot be read"]


def test_failures_are_reasons(spark):
    rows = [(f"r{i}", "each" if i % 2 else "frame", f"{i}", "9") for i in range(10)]
    receipts = spark.createDataFrame(rows, "receipt_id string, tool_name string, args_canonical string, raw_digest string")
    table = replay.ReplayTable()
    table.register_each("each", lambda r: str(9 // (int(r["args_canonical"]) - 3)))
    table.register("frame", lambda receipts: receipts.select("receipt_id", F.raise_error(F.lit("no")).cast("boolean").alias("replay_ok"), F.lit("x").alias("replay_reason")))
    found = {r.receipt_id: (r.replay_ok, r.replay_reason) for r in table.check(receipts, apart=True).collect()}
    assert found["r3"] == (False, "replay failed: ZeroDivisionError: integer division or modulo by zero")
    assert found["r1"][1].startswith("raw digest changed: was 9, is -5")
    assert all(not found[f"r{i}"][0] and found[f"r{i}"][1].startswith("replay failed: ") for i in range(0, 10, 2))
    with pytest.raises(Exception, match="no"):
        table.check(receipts).collect()


def test_calls_for_a_whole_scope_and_ranges_without_a_time(spark):
    """A call without a key goes through its scope in parts; rows without a time meet ranges that let them pass."""
    source = spark.createDataFrame([("h", 1, None), ("h", 2, "2024-01-01 10:00:00"), ("h", 3, "2025-01-01 00:00:00")], "host string, n bigint, at string")
    source = source.withColumn("at", F.col("at").cast("timestamp"))
    within = [replay.Parameter("within", "start", "at", nulls_pass=True), replay.Parameter("within", "end", "at", nulls_pass=True)]
    calls = [("range", '{"within":["2024-01-01 00:00:00","2024-01-02 00:00:00"]}'), ("all", "{}")]
    receipts = spark.createDataFrame([(i, "h", a) for i, a in calls], "receipt_id string, host string, args_canonical string")
    answered = replay.replay_filtered(receipts, source, within, ["host"], F.col("n").cast("string"))
    leaf = lambda n: hashlib.sha256(str(n).encode()).hexdigest()
    assert {r.receipt_id: r.raw_digest for r in answered.collect()} == {"range": unordered([leaf(1), leaf(2)]), "all": unordered([leaf(1), leaf(2), leaf(3)])}
    assert "pmod(xxhash64(_leaf" in answered._jdf.queryExecution().optimizedPlan().toString()
