"""Receipts over events: one per user and day, events as its records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import length_prefixed_digest, packed, unpacked
from ..operators import chain, receipts as rc, replay
from ..session import scratch_table, written
from ..sources.sinks import append_receipts
from ..sources.stores import read_receipt_store
from . import adapters as ad
from .adapters import cte, with_ctes
from .registry import Tables, query


@query(
    "rcp01_canonical_json",
    with_ctes("record_rows", select="SELECT event_id, canonical FROM record_rows"),
)
def rcp01(t: Tables):
    return ad.record_rows(t).select("event_id", "canonical")


@query(
    "rcp02_data_fingerprint",
    with_ctes("print", select="SELECT run_id, seq, data_digest, row_count FROM print"),
)
def rcp02(t: Tables):
    return rc.data_fingerprint(ad.record_rows(t), ad.BY)


@query(
    "rcp02_order_free_fingerprint",
    with_ctes("print_raw", select="SELECT run_id, seq, raw_digest FROM print_raw"),
)
def rcp02_raw(t: Tables):
    return rc.raw_fingerprint(ad.record_rows(t), ad.BY, F.col("raw"))


@query(
    "rcp02_table_fingerprint",
    with_ctes(
        "record_rows",
        select="SELECT sha256(string_agg(h, '' ORDER BY b)) AS data_digest, CAST(sum(n) AS BIGINT) AS "
        "row_count FROM (SELECT a // 100 AS b, sha256(string_agg(h, '' ORDER BY a)) AS h, sum(n) AS n FROM "
        "(SELECT ordinal // 100 AS a, sha256(string_agg(sha256(canonical), '' ORDER BY ordinal)) AS h, "
        "count(*) AS n FROM record_rows GROUP BY 1) GROUP BY 1)",
    ),
)
def rcp02_table(t: Tables):
    """The whole table as one receipt: one key, many nodes."""
    rows = ad.record_rows(t).withColumn("whole", F.lit(1))
    return rc.data_fingerprint(rows, ["whole"], fan=100).select("data_digest", "row_count")


@query(
    "rcp03_prompt_hash",
    "SELECT conv_id, turn, sha256(unhex(lpad(upper(to_hex(strlen(role))), 16, '0')) || encode(role) || "
    "unhex(lpad(upper(to_hex(strlen(text))), 16, '0')) || encode(text)) AS prompt_hash FROM conversations",
)
def rcp03(t: Tables):
    return t.conversations.select(
        "conv_id", "turn", length_prefixed_digest(F.col("role"), F.col("text")).alias("prompt_hash")
    )


MINTED = "run_id, seq, tool_name, args_canonical, image_sha256, data_digest, raw_digest, row_count"


@query("rcp04_mint", with_ctes("minted", select=f"SELECT {MINTED} FROM minted"))
def rcp04(t: Tables):
    return ad.minted(t).select(*MINTED.split(", "))


@query(
    "rcp05_link_chain",
    with_ctes("receipts", select="SELECT run_id, seq, prev, receipt_id FROM receipts"),
)
def rcp05(t: Tables):
    return ad.receipts(t).select("run_id", "seq", "prev", "receipt_id")


def spoiled(receipts):
    """Receipts with edited, removed, repeated and forged members."""
    user = F.substring_index("run_id", "-", -1).cast("bigint")
    place = lambda u, s: (user % 10 == u) & (F.col("seq") == s)
    edited = receipts.withColumn(
        "tool_version", F.when(place(1, 3), "9.9").otherwise(F.col("tool_version"))
    )
    forged = receipts.where(place(4, 2)).withColumn("receipt_id", F.concat(F.lit("forged-"), "receipt_id"))
    return edited.where(~place(2, 4)).unionByName(receipts.where(place(3, 5))).unionByName(forged)


cte(
    "spoiled",
    "SELECT run_id, seq, receipt_id, prev, sha256(CASE WHEN edit THEN replace(header, '\"tool_version\":\"' || "
    "tool_version, '\"tool_version\":\"9.9') ELSE header END) AS actual, sha256(CASE WHEN edit THEN "
    "replace(plain, '\"tool_version\":\"' || tool_version, '\"tool_version\":\"9.9') ELSE plain END) AS content "
    "FROM (SELECT *, head || 'null' || tail AS plain, usr % 10 = 1 AND seq = 3 AS edit FROM "
    "(SELECT *, CAST(substr(run_id, 5) AS BIGINT) AS usr FROM receipts)) WHERE NOT (usr % 10 = 2 AND "
    "seq = 4) UNION ALL SELECT run_id, seq, CASE WHEN usr % 10 = 4 THEN 'forged-' ELSE '' END || receipt_id, prev, "
    "receipt_id, sha256(head || 'null' || tail) FROM (SELECT *, CAST(substr(run_id, 5) AS BIGINT) AS usr FROM "
    "receipts) WHERE (usr % 10 = 3 AND seq = 5) OR (usr % 10 = 4 AND seq = 2)",
    "receipts",
)


@query(
    "rcp06_verify_chain",
    with_ctes(
        "spoiled",
        select="SELECT run_id, receipt_id, 'altered' AS problem FROM spoiled WHERE receipt_id <> actual "
        "UNION ALL SELECT run_id, receipt_id, 'dangling' FROM spoiled s WHERE prev IS NOT NULL AND NOT "
        "EXISTS (SELECT 1 FROM spoiled o WHERE o.run_id = s.run_id AND o.content = s.prev) "
        "UNION ALL SELECT run_id, receipt_id, 'duplicate' FROM spoiled GROUP BY run_id, receipt_id "
        "HAVING count(*) > 1 UNION ALL SELECT run_id, prev, 'fork' FROM spoiled WHERE prev IS NOT NULL "
        "GROUP BY run_id, prev HAVING count(DISTINCT receipt_id) > 1 UNION ALL SELECT run_id, "
        "min(receipt_id), 'repeated position' FROM spoiled GROUP BY run_id, seq HAVING "
        "count(DISTINCT receipt_id) > 1 UNION ALL SELECT run_id, NULL, CASE WHEN count(DISTINCT receipt_id) "
        "FILTER (prev IS NULL) = 0 THEN 'no root' ELSE 'extra root' END FROM spoiled GROUP BY run_id HAVING "
        "count(DISTINCT receipt_id) FILTER (prev IS NULL) <> 1",
    ),
)
def rcp06(t: Tables):
    return chain.verify_chain(spoiled(ad.stored_receipts(t)))


@query(
    "rcp07_verify_data",
    with_ctes(
        "print",
        "tampered_print",
        select="SELECT p.run_id, p.seq, coalesce(t.data_digest, 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649"
        "b934ca495991b7852b855') = p.data_digest AS data_ok FROM print p LEFT JOIN tampered_print t "
        "USING (run_id, seq)",
    ),
)
def rcp07(t: Tables):
    rows = ad.record_rows(t)
    named = rc.data_fingerprint(rows, ad.BY).withColumn(
        "receipt_id", F.struct("run_id", "seq")
    )
    checked = rc.verify_data(named, rc.data_fingerprint(ad.tampered(rows), ad.BY), ad.BY)
    return checked.select("receipt_id.run_id", "receipt_id.seq", "data_ok")


ARGS = "day bigint, run string"


@query(
    "rcp08_replay_drift",
    with_ctes(
        "print_raw",
        "tampered_print_raw",
        select="SELECT p.run_id, p.seq, coalesce(t.raw_digest = p.raw_digest, false) AS replay_ok, CASE WHEN "
        "t.raw_digest IS NULL THEN 'no source rows to replay' WHEN t.raw_digest <> p.raw_digest THEN "
        "'raw digest changed: was ' || substr(p.raw_digest, 1, 16) || ', is ' || substr(t.raw_digest, 1, 16) "
        "END AS replay_reason FROM print_raw p LEFT JOIN tampered_print_raw t USING (run_id, seq)",
    ),
)
def rcp08(t: Tables):
    """Arguments come from the receipts; the source has lost some rows since."""
    rows = ad.record_rows(t)
    meta = ad.receipt_meta(rows).join(rc.raw_fingerprint(rows, ad.BY, F.col("raw")), ad.BY)
    made = meta.withColumn("receipt_id", F.concat_ws("/", "run_id", F.col("seq").cast("string")))
    source = ad.tampered(rows).select(F.col("run_id").alias("run"), F.col("seq").alias("day"), "raw")
    again = replay.replay_by_arguments(
        made, source, ARGS, ["run", "day"], lambda args: F.lit(True), F.col("raw")
    )
    drift = replay.replay_drift(made, again, ["receipt_id"])
    return drift.select(
        F.substring_index("receipt_id", "/", 1).alias("run_id"),
        F.substring_index("receipt_id", "/", -1).cast("bigint").alias("seq"),
        "replay_ok",
        "replay_reason",
    )


@query(
    "rcp08_row_diff",
    with_ctes(
        "record_rows",
        select="SELECT event_id, event_type, 'removed' AS change FROM record_rows WHERE seq % 7 = 0 AND "
        "ordinal % 2 = 0",
    ),
)
def rcp08_diff(t: Tables):
    rows = ad.record_rows(t)
    keep = ("event_id", "event_type")
    return replay.row_diff(rows.select(*keep), ad.tampered(rows).select(*keep))


@query(
    "rcp09_pack_drift",
    "WITH leaf AS (SELECT 'tool' || (item_id % 3) AS tool_name, CAST('0x' || substr(sha256('/' || item_id || "
    "'.yml'), 1, 10) AS BIGINT) AS pl, sha256('/' || item_id || '.yml' || chr(0) || sha256(text)) AS h FROM "
    "benchmark), a AS (SELECT tool_name, pl // 10000 AS pl, sha256(string_agg(h, '' ORDER BY pl, h)) AS h FROM "
    "leaf GROUP BY 1, 2), b AS (SELECT tool_name, pl // 10000 AS pl, sha256(string_agg(h, '' ORDER BY pl)) AS h "
    "FROM a GROUP BY 1, 2) SELECT conv_id, turn, turn % 2 = 0 AS drifted, present FROM conversations JOIN "
    "(SELECT tool_name, sha256(string_agg(h, '' ORDER BY pl)) AS present FROM b GROUP BY 1) ON tool_name = "
    "'tool' || (conv_id % 3)",
)
def rcp09(t: Tables):
    """Passages as the files of three packs; receipts that recorded the digest, or another one."""
    tool = lambda name: ad.text("tool", (F.col(name) % 3).cast("string"))
    packed = t.benchmark.select(
        tool("item_id").alias("tool_name"),
        F.concat(F.lit("/"), F.col("item_id").cast("string"), F.lit(".yml")).alias("path"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
    )
    packs = rc.pack_digest(packed, by=["tool_name"])
    recorded = F.when(F.col("turn") % 2 == 0, F.lit("0" * 64)).otherwise(F.col("pack_digest"))
    made = t.conversations.withColumn("tool_name", tool("conv_id")).join(packs, "tool_name")
    made = made.select(
        F.struct("conv_id", "turn").alias("receipt_id"),
        "tool_name",
        F.to_json(F.struct(recorded.alias("rules_sha256"))).alias("args_canonical"),
    )
    return rc.pack_drift(made, packs, "rules_sha256").select(
        "receipt_id.conv_id", "receipt_id.turn", "drifted", "present"
    )


def _hmac_sql(message: str, key: bytes) -> str:
    block = key.ljust(64, b"\0")
    pad = lambda x: bytes(b ^ x for b in block).hex()
    inner = f"unhex('{pad(0x36)}') || encode({message})"
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256({inner})))"


@query(
    "rcp10_seal",
    with_ctes(
        "receipts",
        select="SELECT receipt_id, CASE WHEN seq % 11 = 4 THEN NULL WHEN seq % 7 = 2 THEN "
        + _hmac_sql("header", b"another key")
        + " ELSE "
        + _hmac_sql("header", ad.KEY)
        + " END AS seal, NOT (seq % 11 = 4 OR seq % 7 = 2 OR seq % 5 = 3) AS seal_ok FROM receipts",
    ),
)
def rcp10(t: Tables):
    """Of sealed receipts some have an edited header since, some the seal of another key, some none."""
    made, seq = ad.receipts(t), F.col("seq")
    good, other = (rc.seal(made, key) for key in (ad.KEY, b"another key"))
    sealed = good.where(seq % 7 != 2).unionByName(other.where(seq % 7 == 2))
    stored = written(sealed.withColumn("seal", F.when(seq % 11 != 4, F.col("seal"))), scratch_table(t.spark, "sealed"))
    edited = stored.withColumn("raw_digest", F.when(seq % 5 == 3, F.reverse("raw_digest")).otherwise(F.col("raw_digest")))
    return stored.select("receipt_id", "seal").join(rc.verify_seal(edited, ad.KEY), "receipt_id")


@query(
    "rcp11_list_receipts",
    with_ctes(
        "receipts",
        select="SELECT receipt_id, run_id AS scope, tool_name, tool_version, substr(image_sha256, 1, 16) AS "
        "image_prefix, substr(raw_digest, 1, 16) AS raw_prefix, row_count, prev FROM receipts",
    ),
)
def rcp11(t: Tables):
    return rc.list_receipts(ad.receipts(t))


@query(
    "rcp12_receipt_sample",
    with_ctes(
        "record_rows",
        select="SELECT run_id, seq, canonical, CAST(rank AS INTEGER) AS rank, row_count FROM (SELECT *, "
        "row_number() OVER (PARTITION BY run_id, seq ORDER BY ordinal) AS rank, count(*) OVER (PARTITION BY "
        "run_id, seq) AS row_count FROM record_rows) WHERE rank <= 5",
    ),
)
def rcp12(t: Tables):
    return rc.receipt_sample(ad.record_rows(t), ad.BY).select(
        *ad.BY, "canonical", "rank", "row_count"
    )


@query(
    "rcp13_lookup",
    with_ctes(
        "meta",
        select="SELECT run_id || '/' || seq AS receipt_id, CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END AS "
        "store_rank, tool_name FROM meta WHERE seq % 2 = 0",
    ),
)
def rcp13(t: Tables):
    """Every third receipt is also in the canonical store, which comes first."""
    made = ad.short_chain(t)
    stores = made.select("*", F.lit(1).alias("store_rank"), F.lit("b").alias("store")).unionByName(
        made.where("seq % 3 = 0").select("*", F.lit(0).alias("store_rank"), F.lit("a").alias("store"))
    )
    found = rc.lookup(stores, made.where("seq % 2 = 0"))
    return found.select("receipt_id", "store_rank", "tool_name")


@query(
    "rcp14_check_registry",
    with_ctes(
        "meta",
        select="SELECT run_id || '/' || seq AS receipt_id, tool_name = 'parse_evtx' AS replay_ok, CASE "
        "tool_name WHEN 'parse_evtx' THEN NULL WHEN 'parse_mft' THEN 'missing input: listing' WHEN "
        "'run_hayabusa' THEN 'replay failed: ValueError' ELSE 'no replay for this tool' END AS replay_reason "
        "FROM meta",
    ),
)
def rcp14(t: Tables):
    rows = ad.record_rows(t)
    prints = rc.raw_fingerprint(rows, ad.BY, F.col("raw"))
    made = ad.short_chain(t).join(prints, ad.BY)

    def evtx(receipts, source):
        again = rc.raw_fingerprint(source, ad.BY, F.col("raw"))
        return replay.replay_drift(receipts, again, ad.BY)

    def broken(receipts):
        raise ValueError("not available")

    table = replay.ReplayTable()
    table.register("parse_evtx", evtx, ["source"])
    table.register("parse_mft", evtx, ["listing"])
    table.register("run_hayabusa", broken)
    return table.check(made, {"source": rows})


@query(
    "snk01_append_receipts",
    with_ctes(
        "meta",
        select="SELECT run_id, count(*) AS n, min(seq) AS first, max(seq) AS last FROM meta GROUP BY 1",
    ),
)
def snk01(t: Tables):
    """Half of the receipts appended, then all of them: the store holds each once."""
    made = ad.short_chain(t)
    path = scratch_table(t.spark, "receipts")
    append_receipts(made.where("seq % 2 = 0"), path)
    append_receipts(made, path)
    return t.spark.read.parquet(f"{path}/receipts").groupBy("run_id").agg(
        F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")
    )


@query(
    "snk01_src11_round_trip",
    with_ctes(
        "receipts",
        "record_rows",
        select="SELECT c.receipt_id, c.prev, r.ordinal, r.k FROM receipts c JOIN record_rows r USING (run_id, seq)",
    ),
)
def snk01_round_trip(t: Tables):
    """Chained receipts and their records stored in two goes, then read back and joined."""
    made = ad.stored_receipts(t)
    named = made.select("run_id", "seq", packed(F.col("receipt_id")).alias("packed_id"))
    rows = ad.record_rows(t).join(named, ["run_id", "seq"])
    records = rows.select(
        unpacked(F.col("packed_id")).alias("receipt_id"), F.col("ordinal").alias("record_idx"), F.create_map(F.lit("k"), F.col("k").cast("string")).alias("record")
    )
    path = scratch_table(t.spark, "store")
    append_receipts(made.where("seq % 2 = 0"), path, records)
    append_receipts(made, path, records)
    receipts, stored = read_receipt_store(t.spark, path)
    return receipts.join(stored, "receipt_id").select(
        "receipt_id", "prev", F.col("record_idx").alias("ordinal"), F.col("record")["k"].cast("bigint").alias("k")
    )


@query(
    "src11_receipt_lines",
    with_ctes(
        "meta",
        select="SELECT run_id || '/' || seq AS receipt_id, CASE WHEN seq % 2 = 0 THEN run_id ELSE 'sample' "
        "END AS scope, CAST(seq % 2 AS INTEGER) AS store_rank, tool_name, seq, CAST(1 AS INTEGER) AS "
        "n_records FROM meta WHERE seq % 5 <> 0 AND seq % 7 <> 6",
    ),
)
def src11(t: Tables):
    """Receipts as stored lines in several folders; some lines and folders do not count."""
    from ..sources.stores import receipt_lines

    seq = F.col("seq")
    made = ad.short_chain(t)
    line = F.to_json(
        F.struct(
            "receipt_id",
            F.struct("tool_name", "tool_version", "args_canonical", "run_id", "seq").alias("header"),
            F.array(F.create_map(F.lit("a"), F.lit("1"))).alias("data"),
        )
    )
    folder = F.when(seq % 7 == 6, "handles").when(seq % 2 == 0, "envelopes").otherwise("sample")
    lines = made.select(
        F.when(seq % 5 == 0, F.lit("{not json")).otherwise(line).alias("value"),
        F.concat(F.lit("file:/logs/"), folder, F.lit("/"), "run_id", F.lit(".jsonl")).alias("path"),
    )
    return receipt_lines(lines, F.col("path")).select(
        "receipt_id", "scope", "store_rank", "tool_name", "seq", F.size("data").alias("n_records")
    )
