"""Claims: validation, predicates, verdicts, revisions, proposals."""

from pyspark.sql import functions as F

from attestlake.functions.hashing import record_map
from attestlake.operators import claims as cl, replay

EVIDENCE = "claim_id string, evidence_idx int, receipt_id string, predicate map<string,array<string>>"


def records(spark):
    df = spark.createDataFrame(
        [("r1", 0, 4624, "alice", None, {"k": "v"}, 1.0, True),
         ("r1", 1, 4624, "bob", "NTLM", {}, 2.5, False),
         ("r2", 0, 1102, None, None, {}, 3.0, True)],
        "receipt_id string, ordinal int, event_id int, user string, auth string, extra map<string,string>, "
        "score double, flag boolean",
    )
    fields = ["event_id", "user", "auth", "extra", "score", "flag"]
    return df.select("receipt_id", "ordinal", record_map(df, fields).alias("record"))


def match(spark, receipt, predicate):
    df = spark.createDataFrame([("c", 0, receipt, predicate)], EVIDENCE)
    row = cl.match_predicate(df, records(spark)).first()
    hits = {r.ordinal for r in cl.predicate_hits(df, records(spark)).collect()}
    assert len(hits) == row.n_matches
    assert (min(hits) if hits else None) == row.first_match
    return hits


def test_predicates(spark):
    assert match(spark, "r1", {"event_id": ["4624"]}) == {0, 1}
    assert match(spark, "r1", {"event_id": ["4624"], "user": ['"bob"']}) == {1}
    assert match(spark, "r1", {"user": ['"bob"', '"alice"', '"bob"']}) == {0, 1}
    assert match(spark, "r1", {"event_id": ['"4624"']}) == set()  # text is not a number
    assert match(spark, "r1", {"auth": ["null"]}) == {0}  # null is a value
    assert match(spark, "r1", {"missing": ["null"]}) == set()  # a missing field is not
    assert match(spark, "r1", {"extra.k": ['"v"']}) == {0}
    assert match(spark, "r1", {"score": ["1"]}) == {0}  # 1.0 and 1 are one number
    assert match(spark, "r1", {"flag": ["true"], "score": ["1", "2.5"]}) == {0}
    assert match(spark, "r2", {"event_id": ["4624"]}) == set()
    assert match(spark, "r9", {"event_id": ["4624"]}) == set()
    assert match(spark, "r1", {"user": []}) == set()


def test_verdicts(spark):
    checks = spark.createDataFrame(
        [("r1", None), ("r2", None), ("bad", "seal does not fit the header")],
        "receipt_id string, failure string",
    )
    hit, miss = {"event_id": ["4624"]}, {"event_id": ["1"]}
    cited = {
        "ok": [("r1", hit)],
        "both": [("r1", hit), ("r2", {"event_id": ["1102"]})],
        "unproven": [("r1", hit), ("r2", miss)],
        "same_receipt": [("r1", miss), ("r1", hit)],
        "drifted": [("r1", miss), ("bad", hit)],
        "unknown": [("nope", hit)],
    }
    claims = spark.createDataFrame(
        [(c, "narrative_inference", 0.5, 0.0, [(r, p) for r, p in ev]) for c, ev in cited.items()]
        + [("reject", "made_up", 0.5, 0.0, [("r1", hit)])],
        "claim_id string, finding_type string, confidence double, temperature double, "
        "evidence array<struct<receipt_id:string,predicate:map<string,array<string>>>>",
    )
    rows = {r.claim_id: r for r in cl.verify(claims, checks, records(spark)).collect()}
    assert {c: r.verdict for c, r in rows.items()} == {
        "ok": "verified", "both": "verified", "unproven": "quarantined", "same_receipt": "quarantined",
        "drifted": "drift", "unknown": "drift", "reject": None,
    }
    assert rows["reject"].reject_reason == "unknown finding type"
    assert rows["drifted"].failed_receipts == ["bad"] and rows["unproven"].unmatched_receipts == ["r2"]
    texts = {r.claim_id: r.constraint for r in cl.constraint_text(cl.verify(claims, checks, records(spark)).where("verdict is not null")).collect()}
    assert set(texts) == {"unproven", "same_receipt", "drifted", "unknown"}
    assert "bad" in texts["drifted"] and "r2" in texts["unproven"]


def test_check_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "receipt_id string")
    flag = lambda name, bad: df.select("receipt_id", (~F.col("receipt_id").isin(*bad)).alias(name))
    rows = cl.receipt_checks(
        df, seal=flag("seal_ok", ["a"]), data=flag("data_ok", ["a", "b"]), version=flag("version_ok", ["c"])
    ).collect()
    assert {r.receipt_id: r.failure for r in rows} == {
        "a": "seal does not fit the header", "b": "records do not fit the data digest", "c": "version drift",
    }


def test_revisions(spark):
    series = {
        "first": ["verified"],
        "second": ["drift", "quarantined", "verified"],
        "never": ["drift"] * 6,
        "stopped": ["drift", "drift"],
        "gap": ["drift", None, "verified"],
        "none": [None, "verified"],
    }
    rows = [("run", h, i, f"{h}{i}", v) for h, vs in series.items() for i, v in enumerate(vs) if v]
    df = spark.createDataFrame(rows, "run_id string, hypothesis string, attempt int, claim_id string, verdict string")
    out = cl.revision_outcome(df, max_revisions=2)
    got = {r.hypothesis: (r.final_claim_id, r.final_verdict, r.n_events, r.gave_up) for r in out.collect()}
    assert got == {
        "first": ("first0", "verified", 0, False),
        "second": ("second1", "quarantined", 1, False),
        "never": ("never2", "drift", 3, True),
        "stopped": ("stopped1", "drift", 2, True),
        "gap": ("gap0", "drift", 1, True),
        "none": (None, None, 0, True),
    }
    assert cl.revision_events(df, out).count() == 7
    report = cl.triage_report(out).first()
    assert (report.hypotheses, report.verified, report.quarantined, report.gave_up, report.events) == (6, 1, 1, 4, 7)


def test_replay_table(spark):
    df = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("c", "t3"), ("d", None)], "receipt_id string, tool_name string")
    table = replay.ReplayTable()
    table.register("t1", lambda receipts: receipts.select("receipt_id", F.lit(True).alias("replay_ok"), F.lit(None).cast("string").alias("replay_reason")))
    table.register("t2", lambda receipts, disk: receipts, ["disk"])
    rows = {r.receipt_id: (r.replay_ok, r.replay_reason) for r in table.check(df).collect()}
    assert rows == {
        "a": (True, None), "b": (False, "missing input: disk"),
        "c": (False, "no replay for this tool"), "d": (False, "no replay for this tool"),
    }


def test_version_and_pack_drift(spark):
    df = spark.createDataFrame([("a", "t", "1.0"), ("b", "t", "0.9"), ("c", "u", "1.0")], "receipt_id string, tool_name string, tool_version string")
    installed = spark.createDataFrame([("t", "1.0")], "tool_name string, version string")
    assert {r.receipt_id: r.version_ok for r in replay.version_drift(df, installed).collect()} == {"a": True, "b": False, "c": False}


def shuffled_rows(spark, run):
    context = spark.sparkContext
    context.setJobGroup("shuffled", "rows that are shuffled")
    try:
        run()
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
        stages = {s for job in tracker.getJobIdsForGroup("shuffled") for s in tracker.getJobInfo(job).stageIds}
        done = [store.lastStageAttempt(s) for s in stages]
        return sum(s.shuffleWriteRecords() for s in done)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_value_lists_of_rarely_cited_receipts_are_not_shuffled_as_rows(spark, monkeypatch):
    """A list of 61 values is one row of evidence, unless its receipt is cited by many; either way the matches are the same."""
    values = [str(i) for i in range(61)]
    rows = [(f"c{i}", 0, f"r{i}", {"k": values}) for i in range(200)]
    rows += [(f"h{i}", i % 2, "r0", {"k": values[i:]} if i % 3 else {"k": values[:i], "u": ['"a"', '"b"']}) for i in range(40)]
    rows += [("none", 0, None, {"k": ["1"]}), ("all", 0, "r1", {}), ("bare", 0, "r1", {"k": []}), ("null", 0, "r1", {"k": None})]
    evidence = spark.createDataFrame(rows, EVIDENCE)
    records = spark.range(400).selectExpr(
        "concat('r', id % 200) AS receipt_id", "id AS ordinal", "map('k', cast(id % 70 as string), 'u', if(id % 3 = 0, '\"a\"', '\"c\"')) AS record"
    )
    found = lambda: sorted(map(tuple, cl.match_predicate(evidence, records).collect()), key=repr)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rare = evidence.where("claim_id like 'c%'")
        assert 400 < shuffled_rows(spark, lambda: cl.match_predicate(rare, records).collect()) < 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    usual = found()
    own = {r[0]: r[3:] for r in usual}
    assert len(usual) == 244 and own["all"] == (2, 1) and own["none"] == own["bare"] == own["null"] == (0, None)
    assert own["c0"] == (2, 0) and own["c65"] == (1, 265) and own["h0"] == (0, None) and own["h1"] == (1, 200)
    for most in (0, 1000):
        monkeypatch.setattr(cl, "MOST_CITED", most)
        assert found() == usual


def test_only_sound_receipts_meet_their_records(spark):
    """Receipts may go by other columns, and records come as columns; failed and unknown ones have no matches."""
    rows = spark.createDataFrame([("a", 1, 0, "x"), ("a", 1, 1, "y"), ("a", 2, 2, "x")], "run string, seq int, ordinal int, f string")
    checks = spark.createDataFrame([("a", 1, "r1", None), ("a", 2, "r2", "version drift"), ("a", 3, "r3", None)], "run string, seq int, receipt_id string, failure string")
    entry = lambda rid: [(rid, {"f": ['"x"']})]
    claims = spark.createDataFrame(
        [(rid, "narrative_inference", 0.5, 0.0, entry(rid)) for rid in ("r1", "r2", "r3", "r4")],
        "claim_id string, finding_type string, confidence double, temperature double, "
        "evidence array<struct<receipt_id:string,predicate:map<string,array<string>>>>",
    )
    found = cl.verify(claims, checks, rows, by=("run", "seq"), record=record_map(rows, ["f"])).collect()
    assert {r.claim_id: (r.verdict, r.reason) for r in found} == {
        "r1": ("verified", "all receipts hold and all predicates match"), "r2": ("drift", "receipt r2: version drift"),
        "r3": ("quarantined", "no record fits in: r3"), "r4": ("drift", "receipt r4: unknown receipt"),
    }
    flags = spark.createDataFrame([(a, b, c, d) for a in (True, None) for b in (True, False) for c in (True, None) for d in (True, False)], "a boolean, b boolean, c boolean, d boolean")
    first = cl.first_failure({n: F.col(c) for (n, _), c in zip(cl.CHECKS, "abcd", strict=True)})
    texts = [text for _, text in cl.CHECKS]
    for r in flags.withColumn("first", first).collect():
        assert r["first"] == next((text for flag, text in zip(r, texts, strict=False) if not flag), None)
