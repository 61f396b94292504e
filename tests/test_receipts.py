"""Receipts: digests, ids, chains, seals, stores."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from attestlake.functions import hashing as h
from attestlake.operators import chain, receipts as rc, replay
from attestlake.plans import adapters as ad
from attestlake.sources import sinks, stores
from attestlake.streaming import receipt_watch

KEY = b"k" * 80


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_canonical_json(spark):
    df = spark.createDataFrame(
        [(1, 'a"é\n', 1.0, {"z": 1, "a": 2}, None), (2, "x", float("nan"), {}, "y"),
         (3, "x", 12345678.5, {}, None), (4, "x", 0.00001234, {}, None)],
        "n int, b string, d double, m map<string,int>, u string",
    )
    rows = rc.canonical_records(df, ["n", "b", "d", "m", "u"]).orderBy("n").collect()
    assert rows[0].canonical == '{"b":"a\\"é\\n","d":1,"m":{"a":2,"z":1},"n":1,"u":null}'
    assert rows[1].canonical is None
    assert json.loads(rows[2].canonical)["d"] == 12345678.5 and "12345678.5" in rows[2].canonical
    assert '"d":0.00001234' in rows[3].canonical


def test_prompt_hash_keeps_the_boundary(spark):
    df = spark.createDataFrame([("ab", "cé"), ("a", "bcé")], "a string, b string")
    got = [r[0] for r in df.select(h.length_prefixed_digest(F.col("a"), F.col("b"))).collect()]
    want = hashlib.sha256((2).to_bytes(8, "big") + b"ab" + (3).to_bytes(8, "big") + "cé".encode())
    assert got[0] == want.hexdigest() and got[0] != got[1]


@pytest.mark.parametrize("key", [b"short", KEY])
def test_seal_is_hmac(spark, key):
    df = spark.createDataFrame([("héader",)], "m string")
    assert df.select(h.keyed_seal(F.col("m"), key)).first()[0] == hmac.new(
        key, "héader".encode(), "sha256"
    ).hexdigest()


def records(spark, n=60):
    rows = [("r1" if i % 3 else "r2", i, f'{{"i":{i}}}') for i in range(n)]
    return spark.createDataFrame(rows, "receipt_id string, ordinal bigint, canonical string")


def test_fingerprint_ignores_partitioning_but_not_order(spark):
    df = records(spark)
    one = {r.receipt_id: r for r in rc.data_fingerprint(df, ["receipt_id"], fan=7).collect()}
    two = rc.data_fingerprint(df.repartition(5, "canonical"), ["receipt_id"], fan=7).collect()
    assert {r.receipt_id: r for r in two} == one and one["r1"].row_count == 40
    swapped = df.withColumn(
        "ordinal", F.when(F.col("ordinal") == 1, 2).when(F.col("ordinal") == 2, 1).otherwise(F.col("ordinal"))
    )
    changed = {r.receipt_id: r for r in rc.data_fingerprint(swapped, ["receipt_id"], fan=7).collect()}
    assert changed["r1"] != one["r1"] and changed["r2"] == one["r2"]
    # A tree over chunks, as it is defined.
    leaves = {}
    for i in range(0, 60, 3):
        leaves.setdefault(i // 7, []).append(sha(f'{{"i":{i}}}'))
    mids = {}
    for at in sorted(leaves):
        mids.setdefault(at // 7, []).append(sha("".join(leaves[at])))
    assert one["r2"].data_digest == sha("".join(sha("".join(mids[at])) for at in sorted(mids)))


def test_one_flipped_record_fails_one_receipt(spark):
    df = records(spark)
    made = rc.data_fingerprint(df, ["receipt_id"])
    flipped = df.withColumn(
        "canonical", F.when(F.col("ordinal") == 30, '{"i":-1}').otherwise(F.col("canonical"))
    )
    checked = rc.verify_data(made, rc.data_fingerprint(flipped, ["receipt_id"]), ["receipt_id"])
    assert {r.receipt_id: r.data_ok for r in checked.collect()} == {"r1": True, "r2": False}
    gone = rc.verify_data(made, rc.data_fingerprint(df.where("receipt_id = 'r1'"), ["receipt_id"]), ["receipt_id"])
    assert {r.receipt_id: r.data_ok for r in gone.collect()} == {"r1": True, "r2": False}


def headers(spark, runs=(("a", 3),)):
    rows = [
        (run, i, "parse_evtx", "1.0", "{}", "0" * 64, "1" * 64, "2" * 64)
        for run, n in runs
        for i in range(n)
    ]
    df = spark.createDataFrame(
        rows,
        "run_id string, seq bigint, tool_name string, tool_version string, args_canonical string, "
        "image_sha256 string, data_digest string, raw_digest string",
    )
    return df.select(
        "*",
        F.timestamp_seconds(F.lit(1700000000)).alias("ts"),
        F.lit(None).cast("string").alias("model_id"),
        F.lit(None).cast("string").alias("prompt_hash"),
        F.array().cast(rc.NO_OFFSETS).alias("offsets"),
    )


def test_links_are_content_ids_of_the_receipt_before(spark):
    df = headers(spark, (("a", 11), ("b", 2), ("c", 7)))
    linked = chain.link_chain(df)
    whole = {(r.run_id, r.seq): (r.prev, r.receipt_id) for r in linked.collect()}
    cut = {(r.run_id, r.seq): (r.prev, r.receipt_id) for r in chain.link_chain(df, block=50_000).collect()}
    assert whole == cut and len(cut) == 20
    texts = {(r.run_id, r.seq): r.t for r in linked.select("run_id", "seq", rc.header_json(linked).alias("t")).collect()}
    prev = None
    for i in range(11):
        assert json.loads(texts["a", i])["prev"] == prev
        assert whole["a", i][1] == sha(texts["a", i])
        prev = sha(texts["a", i].replace(json.dumps({"prev": prev})[1:-1].replace(": ", ":"), '"prev":null'))


def test_positions_sparse_negative_and_huge(spark):
    df = headers(spark, (("a", 9),))
    at = F.element_at(F.array(*map(F.lit, [-(2**62), -5, -4, 0, 7, 10**9, 1_700_000_000_000_000, 2**62, 2**63 - 1])), F.col("seq").cast("int") + 1)
    moved = df.withColumn("seq", at.cast("bigint"))
    for block in (100_000, chain.BLOCK):
        rows = sorted(chain.link_chain(moved, block=block).collect(), key=lambda r: r.seq)
        ids = {r.seq: r.c for r in moved.select("seq", chain.content_id(moved.withColumn("prev", F.lit(None).cast("string"))).alias("c")).collect()}
        assert [r.prev for r in rows] == [None] + [ids[r.seq] for r in rows[:-1]]
    assert problems(chain.link_chain(moved)) == []
    odd = headers(spark, (("a", 4),)).withColumn("seq", F.when(F.col("seq") == 3, None).otherwise(F.least("seq", F.lit(1))))
    odd = odd.withColumn("model_id", F.monotonically_increasing_id().cast("string"))
    assert {p for _, p in problems(chain.link_chain(odd))} == {"extra root", "no position", "repeated position"}


def problems(df):
    return sorted((r.run_id, r.problem) for r in chain.verify_chain(df).collect())


def test_chain_problems(spark):
    linked = chain.link_chain(headers(spark, (("a", 3), ("b", 3)))).persist()
    assert problems(linked) == []
    middle = (F.col("run_id") == "a") & (F.col("seq") == 1)
    edited = linked.withColumn("tool_version", F.when(middle, "6.6").otherwise(F.col("tool_version")))
    assert problems(edited) == [("a", "altered"), ("a", "dangling")]
    assert problems(linked.where(~middle)) == [("a", "dangling")]
    assert problems(linked.where("NOT (run_id = 'b' AND seq = 0)")) == [("b", "dangling"), ("b", "no root")]
    copy = linked.where(middle)
    assert problems(linked.unionByName(copy)) == [("a", "duplicate")]
    forged = copy.withColumn("receipt_id", F.lit("other"))
    assert problems(linked.unionByName(forged)) == [("a", "altered"), ("a", "fork"), ("a", "repeated position")]


def test_seal_guards_every_header_field(spark):
    sealed = rc.seal(chain.link_chain(headers(spark)), KEY)
    good = lambda df, key=KEY: [r.seal_ok for r in rc.verify_seal(df, key).collect()]
    assert good(sealed) == [True] * 3
    assert good(sealed, b"other") == [False] * 3
    for name in ("args_canonical", "data_digest", "model_id", "prev", "run_id", "tool_name"):
        assert good(sealed.withColumn(name, F.lit("x"))) == [False] * 3


def test_mint_rejects_bad_image_hash(spark):
    meta = headers(spark).drop("data_digest", "raw_digest").withColumn(
        "image_sha256", F.when(F.col("seq") == 1, "ABC").otherwise(F.col("image_sha256"))
    )
    none = spark.createDataFrame([], "run_id string, seq bigint, data_digest string, raw_digest string, row_count bigint")
    rows = {r.seq: r for r in rc.mint(meta, none, ["run_id", "seq"]).collect()}
    assert rows[0].reject_reason is None and rows[1].reject_reason and rows[0].row_count == 0
    assert rows[0].data_digest == hashlib.sha256(b"").hexdigest()


def test_store_round_trip_and_watch(spark, folder):
    made = rc.seal(chain.link_chain(headers(spark)), KEY).persist()
    recs = made.select(
        "receipt_id", F.lit(0).alias("record_idx"), F.create_map(F.lit("event_id"), F.lit("4624")).alias("record")
    )
    staging = str(folder / "staging")
    sinks.write_receipt_lines(made, recs, staging)
    (folder / "logs" / "envelopes").mkdir(parents=True)
    (folder / "logs" / "sample").mkdir()
    (folder / "logs" / "handles").mkdir()
    lines = [r.value for r in spark.read.text(staging).collect()]
    for place in ("envelopes", "sample", "handles"):
        (folder / "logs" / place / "run1.jsonl").write_text("\n".join([*lines, "{broken", "[]"]))
    df = stores.read_receipts(spark, str(folder / "logs"))
    assert sorted({r.scope for r in df.collect()}) == ["run1", "sample"] and df.count() == 6
    assert [r.seal_ok for r in rc.verify_seal(df, KEY).collect()] == [True] * 6
    found = rc.lookup(df, made.select("receipt_id")).collect()
    assert {r.scope for r in found} == {"run1"} and len(found) == 3
    assert stores.receipt_records(df).first().record == {"event_id": "4624"}

    out, state = str(folder / "out"), str(folder / "state")
    for expected in (6, 9):
        query = receipt_watch.watch(spark, str(folder / "logs"), out, state, KEY)
        query.awaitTermination(120)
        rows = spark.read.parquet(out).collect()
        assert len(rows) == expected and all(r.id_ok and r.seal_ok for r in rows)
        (folder / "logs" / "envelopes" / "run2.jsonl").write_text("\n".join(lines))


def test_appending_twice_adds_nothing(spark, folder):
    made = chain.link_chain(headers(spark, (("a", 3), ("b", 2)))).persist()
    records = made.select(
        "receipt_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("record_idx"), F.create_map(F.lit("k"), F.col("run_id")).alias("record")
    )
    path = str(folder / "store")
    sinks.append_receipts(made.where("run_id = 'a'"), path, records, buckets=8)
    sinks.append_receipts(made, path, records, buckets=8)
    sinks.append_receipts(made, path, records, buckets=8)
    receipts, rows = stores.read_receipt_store(spark, path)
    assert sorted(receipts.columns) == sorted(made.columns)
    assert sorted(map(str, receipts.select("receipt_id", "prev", "seq").collect())) == sorted(
        map(str, made.select("receipt_id", "prev", "seq").collect())
    )
    assert rows.count() == 10 and rows.select("receipt_id", "record_idx").distinct().count() == 10
    assert problems(receipts) == []


def test_lines_read_back_whatever_the_number_of_records(spark, folder):
    made = chain.link_chain(headers(spark, (("a", 2),))).withColumn("seal", F.lit("s")).persist()
    records = made.select(
        "receipt_id", F.explode(F.sequence(F.lit(0), F.lit(24) * F.col("seq"))).alias("record_idx")
    ).withColumn("record", F.create_map(F.lit("n"), F.col("record_idx").cast("string")))
    sinks.write_receipt_lines(made, records, str(folder / "logs" / "sample"), fan=10)
    back = stores.read_receipts(spark, str(folder / "logs"))
    assert {r.receipt_id for r in back.collect()} == {r.receipt_id for r in made.collect()} and back.count() == 4
    got = {(r.receipt_id, r.record_idx, r.record["n"]) for r in stores.receipt_records(back).collect()}
    assert got == {(r.receipt_id, r.record_idx, r.record["n"]) for r in records.collect()}


def test_replay_names_what_changed(spark):
    a = spark.createDataFrame([("r1", "x"), ("r2", "y")], "receipt_id string, raw_digest string")
    b = spark.createDataFrame([("r1", "x"), ("r2", "z")], "receipt_id string, raw_digest string")
    rows = {r.receipt_id: r for r in replay.replay_drift(a, b, ["receipt_id"]).collect()}
    assert rows["r1"].replay_ok and rows["r1"].replay_reason is None
    assert not rows["r2"].replay_ok and "was y, is z" in rows["r2"].replay_reason


def test_pack_digest_depends_on_content_not_order(spark):
    rows = [(f"/p/{i}.yml", sha(str(i))) for i in range(9)]
    one = spark.createDataFrame(rows, "path string, sha256 string")
    two = spark.createDataFrame([(p.replace("/p", "/q"), s) for p, s in rows[::-1]], "path string, sha256 string")
    get = lambda df, root: rc.pack_digest(df, root).first().pack_digest
    assert get(one, "/p") == get(two, "/q") != get(one.limit(8), "/p")


def test_unordered_digest(tables):
    rows = ad.record_rows(tables)
    raw = F.col("raw")
    one = {tuple(r) for r in rc.raw_fingerprint(rows, ad.BY, raw).collect()}
    two = {tuple(r) for r in rc.raw_fingerprint(rows.orderBy("value"), ad.BY, raw).collect()}
    three = {tuple(r) for r in rc.raw_fingerprint(rows.unionByName(rows.limit(1)), ad.BY, raw).collect()}
    assert one == two and len(one - three) == 1


def test_leaves_are_shuffled_as_bytes(spark):
    """A record's digest goes through the first shuffle of a fingerprint as 32 bytes, not as hex text."""
    from attestlake.operators import receipts

    rows = spark.range(3).selectExpr("'r' AS run", "id AS ordinal", "cast(id as string) AS canonical")
    plan = receipts.data_fingerprint(rows, ["run"])._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex(sha2(" in plan.lower()


def test_digests_are_shuffled_as_bytes(spark, folder):
    from attestlake.functions.hashing import packed, unpacked

    texts = ["00ff" * 16, "0" * 63, "AB", "ab", "not hex", "", "é", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", packed(F.col("t")))
    got = rows.repartition(3, "p").select("t", unpacked(F.col("p")).alias("back"), F.octet_length("p").alias("n")).collect()
    assert {r.t: r.back for r in got} == {t: t for t in texts}
    assert {r.t: r.n for r in got}["00ff" * 16] == 33

    made = chain.link_chain(headers(spark, (("a", 3), ("b", 2))))
    sinks.append_receipts(made, str(folder / "store"))
    stored = spark.read.parquet(str(folder / "store" / "receipts")).drop("run_bucket")
    assert rows_as_set(stored.select(*made.columns)) == rows_as_set(made)
    assert all(".zstd." in f for f in stored.inputFiles())


def rows_as_set(df):
    return {repr(r) for r in df.collect()}


def test_fingerprints_meet_on_their_key_without_another_shuffle(spark):
    """The two digests of a receipt are both grouped by its key, so their join shuffles neither again."""
    rows = spark.range(30).selectExpr("'r' AS run_id", "id % 3 AS seq", "id AS ordinal", "cast(id as string) AS canonical", "'x' AS raw")
    joined = ad.fingerprints(rows)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4  # three levels of the tree, and the order-free sums


def test_linking_reads_written_fingerprints(spark, tables):
    """However often linking reads the minted receipts, their records are not read again."""
    plan = ad.receipts(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "props" not in plan and "event_type" not in plan


def test_one_pass_gives_both_digests(spark):
    """Rows are shuffled as they are and hashed after: two shuffles, and the digests of the two separate functions."""
    from attestlake.operators import receipts as rc

    rows = spark.range(600).selectExpr(
        "concat('run', id % 3) AS run", "if(id % 3 = 2, null, id % 7) AS seq", "id * id AS ordinal", "id AS v", "id % 5 > 0 AS kept", "id % 7 <> 3 AS read"
    )
    canonical, raw = F.concat(F.lit("c"), F.col("v").cast("string")), F.when(F.col("v") % 11 > 0, F.concat(F.lit("r"), F.col("v").cast("string")))
    by = ["run", "seq"]
    for fan in (4, 10_000):
        for record, source in ((None, None), (F.col("kept"), F.col("read"))):
            some = lambda c: rows if c is None else rows.where(c)
            data = rc.data_fingerprint(some(record).withColumn("canonical", canonical), by, fan=fan)
            sums = rc.raw_fingerprint(some(source), by, raw)
            want = {(r.run, r.seq): (r.data_digest, r.row_count) for r in data.collect()}
            also = {(r.run, r.seq): r.raw_digest for r in sums.collect()}
            made = rc.fingerprints(rows, by, canonical, raw, is_record=record, is_source=source, fan=fan)
            got = {(r.run, r.seq): (r.data_digest, r.row_count, r.raw_digest) for r in made.collect()}
            assert got == {k: (*want.get(k, (None, 0)), also.get(k)) for k in {(r.run, r.seq) for r in rows.collect()}}
    plan = rc.fingerprints(rows, by, canonical, raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    shuffled = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "sha2" not in shuffled


def test_minting_shuffles_records_and_stretches_only(spark, tables):
    """Receipts are minted on the rows of their written fingerprints, which have each key once."""
    plan = ad.minted(tables)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
