"""Claims over receipts: one claim per user and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import each_digest, packed, unpacked
from ..operators import claims as cl, receipts as rc, replay
from ..session import scratch_table, written
from . import adapters as ad
from .adapters import cte, with_ctes
from .registry import Tables, query


@query(
    "clm01_validate_claims",
    "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'no evidence' WHEN 1 THEN 'empty predicate' WHEN 2 THEN "
    "'unknown finding type' WHEN 3 THEN 'confidence outside 0..1' WHEN 4 THEN 'temperature outside 0..2' END "
    "AS reject_reason FROM orders",
)
def clm01(t: Tables):
    kind = F.col("o_orderkey") % 6
    none = F.create_map().cast("map<string,array<string>>")
    some = F.create_map(F.lit("a"), F.array(F.lit("1")))
    entry = lambda pred: F.array(F.struct(F.lit("r").alias("receipt_id"), pred.alias("predicate")))
    claims = t.orders.select(
        "o_orderkey",
        F.when(kind == 2, "T0000_made_up").otherwise("T1070.001_log_clearing").alias("finding_type"),
        F.when(kind == 3, 1.5).otherwise(0.5).alias("confidence"),
        F.when(kind == 4, -0.1).otherwise(2.0).alias("temperature"),
        F.when(kind == 1, F.concat(entry(some), entry(none)))
        .when(kind != 0, entry(some))
        .otherwise(F.slice(entry(some), 1, 0))
        .alias("evidence"),
    )
    return cl.validate_claims(claims).select("o_orderkey", "reject_reason")


def usable_evidence(t: Tables):
    valid = cl.validate_claims(ad.claims(t)).where("reject_reason IS NULL")
    return cl.claim_evidence(valid)


def checks_of(t: Tables):
    """Data digests against records of which every seventh receipt lost some."""
    rows = ad.record_rows(t)
    made = ad.short_chain(t).join(rc.data_fingerprint(rows, ad.BY), ad.BY)
    data = rc.verify_data(made, rc.data_fingerprint(ad.tampered(rows), ad.BY), ad.BY)
    installed = t.spark.createDataFrame(
        [(name, "1.0") for name in sorted(set(ad.TOOL.values()))], "tool_name string, version string"
    )
    return cl.receipt_checks(made, data=data, version=replay.version_drift(made, installed))


cte(
    "checks",
    "SELECT m.run_id || '/' || m.seq AS receipt_id, CASE WHEN coalesce(t.data_digest, '') <> p.data_digest "
    "THEN 'records do not fit the data digest' WHEN tool_version <> '1.0' THEN 'version drift' END AS failure "
    "FROM meta m JOIN print p USING (run_id, seq) LEFT JOIN tampered_print t USING (run_id, seq)",
    "meta",
    "print",
    "tampered_print",
)
cte(
    "judged",
    "SELECT e.claim_id, e.evidence_idx, e.receipt_id, CASE WHEN k.receipt_id IS NULL THEN 'unknown receipt' "
    "ELSE failure END AS failure, n_matches, first_match FROM evidence e LEFT JOIN checks k USING (receipt_id) "
    "JOIN matches m USING (claim_id, evidence_idx)",
    "evidence",
    "checks",
    "matches",
)
cte(
    "verdicts",
    "SELECT claim_id, CASE WHEN count(failure) > 0 THEN 'drift' WHEN min(n_matches) = 0 THEN 'quarantined' "
    "ELSE 'verified' END AS verdict, count(*) AS n_evidence, "
    "string_agg(receipt_id, ', ' ORDER BY evidence_idx) FILTER (failure IS NOT NULL) AS failed, "
    "string_agg(receipt_id, ', ' ORDER BY evidence_idx) FILTER (failure IS NULL AND n_matches = 0) AS unmatched, "
    "arg_min(receipt_id || ': ' || failure, evidence_idx) FILTER (failure IS NOT NULL) AS first_failure "
    "FROM judged GROUP BY claim_id",
    "judged",
)


@query(
    "clm02_unknown_receipt",
    with_ctes(
        "judged",
        select="SELECT claim_id, evidence_idx, receipt_id FROM judged WHERE failure = 'unknown receipt'",
    ),
)
def clm02(t: Tables):
    evidence = usable_evidence(t)
    known = cl.receipt_checks(ad.short_chain(t))
    none = evidence.select(
        "claim_id", "evidence_idx", F.lit(0).alias("n_matches"), F.lit(0).alias("first_match")
    )
    judged = cl.judge_evidence(evidence, known, none)
    return judged.where("failure = 'unknown receipt'").select("claim_id", "evidence_idx", "receipt_id")


@query(
    "clm03_match_predicate",
    with_ctes(
        "matches",
        select="SELECT claim_id, evidence_idx, receipt_id, n_matches, first_match FROM matches",
    ),
)
def clm03(t: Tables):
    return cl.match_predicate(usable_evidence(t), ad.claim_records(ad.record_rows(t)))


@query(
    "clm03_predicate_hits",
    with_ctes(
        "evidence",
        "record_rows",
        select="SELECT e.claim_id, e.evidence_idx, e.receipt_id, r.ordinal FROM evidence e JOIN record_rows r "
        "ON e.receipt_id = r.run_id || '/' || r.seq AND CASE WHEN e.evidence_idx = 0 THEN "
        "list_contains(e.kinds, r.event_type) ELSE list_contains(e.ks, r.k) END",
    ),
)
def clm03_hits(t: Tables):
    return cl.predicate_hits(usable_evidence(t), ad.claim_records(ad.record_rows(t)))


@query(
    "clm04_verdict",
    with_ctes(
        "verdicts",
        select="SELECT claim_id, verdict, n_evidence, CASE verdict WHEN 'drift' THEN 'receipt ' || "
        "first_failure WHEN 'quarantined' THEN 'no record fits in: ' || unmatched ELSE "
        "'all receipts hold and all predicates match' END AS reason FROM verdicts",
    ),
)
def clm04(t: Tables):
    evidence = usable_evidence(t)
    matches = cl.match_predicate(evidence, ad.claim_records(ad.record_rows(t)))
    judged = cl.judge_evidence(evidence, checks_of(t), matches)
    return cl.verdicts(judged).select("claim_id", "verdict", "n_evidence", "reason")


def verified(t: Tables):
    return cl.verify(ad.claims(t), checks_of(t), ad.claim_records(ad.record_rows(t)))


@query(
    "clm05_verify_batch",
    with_ctes(
        "verdicts",
        "claims",
        select="SELECT claim_id, CASE WHEN NOT valid THEN 'confidence outside 0..1' END AS reject_reason, "
        "verdict FROM claims LEFT JOIN verdicts USING (claim_id)",
    ),
)
def clm05(t: Tables):
    return verified(t).select("claim_id", "reject_reason", "verdict")


cte(
    "full_checks",
    "SELECT m.run_id || '/' || m.seq AS receipt_id, CASE WHEN m.seq % 17 = 3 THEN 'seal does not fit the header' WHEN "
    "coalesce(t.data_digest, '') <> m.data_digest THEN 'records do not fit the data digest' WHEN m.tool_version <> '1.0' "
    "THEN 'version drift' WHEN coalesce(s.raw_digest, '') <> m.raw_digest THEN 'replay gives other results' END AS failure "
    "FROM receipts m LEFT JOIN tampered_print t USING (run_id, seq) LEFT JOIN source_raw s USING (run_id, seq)",
    "receipts",
    "tampered_print",
    "source_raw",
)
# Matches for each kind of evidence apart: DuckDB loses some of `matches` where `record_rows` has this many uses.
cte(
    "full_matches",
    "SELECT e.claim_id, e.evidence_idx, count(r.ordinal) AS n_matches FROM evidence e LEFT JOIN record_rows r ON e.receipt_id = "
    "r.run_id || '/' || r.seq AND list_contains(e.kinds, r.event_type) AND r.\"user\" = 'user' || e.usr WHERE "
    "e.evidence_idx = 0 GROUP BY ALL UNION ALL SELECT e.claim_id, e.evidence_idx, count(r.ordinal) FROM evidence e LEFT JOIN "
    "record_rows r ON e.receipt_id = r.run_id || '/' || r.seq AND r.k BETWEEN 0 AND 60 WHERE e.evidence_idx = 1 GROUP BY ALL",
    "evidence",
    "record_rows",
)
cte(
    "full_judged",
    "SELECT e.claim_id, e.evidence_idx, CASE WHEN k.receipt_id IS NULL THEN 'unknown receipt' ELSE failure END AS failure, "
    "n_matches FROM evidence e LEFT JOIN full_checks k USING (receipt_id) JOIN full_matches m USING (claim_id, evidence_idx)",
    "evidence",
    "full_checks",
    "full_matches",
)


@query(
    "clm05_full_order",
    with_ctes(
        "full_judged",
        "claims",
        select="SELECT claim_id, CASE WHEN NOT valid THEN 'confidence outside 0..1' END AS reject_reason, verdict, failure "
        "FROM claims LEFT JOIN (SELECT claim_id, CASE WHEN count(failure) > 0 THEN 'drift' WHEN min(n_matches) = 0 THEN "
        "'quarantined' ELSE 'verified' END AS verdict, coalesce(arg_min(failure, evidence_idx) FILTER (failure IS NOT NULL), '') "
        "AS failure FROM full_judged GROUP BY claim_id) USING (claim_id)",
    ),
)
def clm05_full(t: Tables):
    """Claims on minted, chained and sealed receipts: unknown, seal, data, version, replay, predicate, in this order.

    Some seals are of another key, some records and some source rows are gone since, some versions are old, and
    receipts of evidence without a proper hash were never minted.
    """
    rows, seq = ad.plain_records(t), F.col("seq")
    good = ad.stored_receipts(t)
    sealed = rc.seal(good, ad.KEY).where(seq % 17 != 3).unionByName(rc.seal(good, b"another key").where(seq % 17 == 3))
    installed = t.spark.createDataFrame(
        [(name, "1.0") for name in sorted(set(ad.TOOL.values()))], "tool_name string, version string"
    )
    # Checks that need the header alone are made on the receipts' own rows; then these meet one pass over what is left of the
    # records and of the source.
    own = sealed.join(F.broadcast(installed), "tool_name", "left").select(
        *ad.BY, "receipt_id", "data_digest", "raw_digest",
        rc.seal_fits(sealed, ad.KEY).alias("seal_ok"), (F.col("tool_version") == F.col("version")).alias("version_ok"),
    )
    now = ad.prints(t, is_record=ad.is_left(), is_source=~((seq % 19 == 5) & (F.col("ordinal") % 2 == 1))).select(
        *ad.BY, F.col("data_digest").alias("data_now"), F.col("raw_digest").alias("raw_now")
    )
    both = each_digest(own, packed).join(now.withColumns({n: packed(F.col(n)) for n in ("data_now", "raw_now")}), ad.BY, "left")
    same = {
        "data_ok": F.coalesce("data_now", packed(F.lit(rc.EMPTY))) == F.col("data_digest"),
        "replay_ok": F.col("raw_now") == F.col("raw_digest"),
    }
    failure = cl.first_failure({"seal_ok": F.col("seal_ok"), "version_ok": F.col("version_ok"), **same})
    checks = both.select(*ad.BY, unpacked(F.col("receipt_id")).alias("receipt_id"), failure.alias("failure"))
    named = ad.short_chain(t).select(*ad.BY, F.col("receipt_id").alias("name"))
    ids = each_digest(good.select(*ad.BY, "receipt_id"), packed)
    made = each_digest(named.join(ids, ad.BY, "left"), unpacked).withColumn("receipt_id", F.coalesce("receipt_id", "name"))
    made = written(made, scratch_table(t.spark, "cited"))
    found = cl.verify(ad.claims_over(made), checks, rows, by=tuple(ad.BY), record=ad.record_map(rows, ad.RECORD_FIELDS))
    failure = F.when(F.col("verdict").isNotNull(), F.regexp_extract("reason", r"^receipt \S+: (.*)$", 1))
    return found.select("claim_id", "reject_reason", "verdict", failure.alias("failure"))


@query(
    "clm06_constraint_text",
    with_ctes(
        "verdicts",
        select="SELECT claim_id, verdict, 'Claim ' || claim_id || ' (narrative_inference) ' || CASE WHEN "
        "failed IS NOT NULL THEN 'rests on receipts that did not hold: ' || failed || '. Leave them out, or "
        "run the tool again first.' ELSE 'found no fitting record in: ' || unmatched || '. Choose another "
        "predicate or receipt, or state it as narrative.' END AS \"constraint\" FROM verdicts "
        "WHERE verdict <> 'verified'",
    ),
)
def clm06(t: Tables):
    return cl.constraint_text(verified(t).where("reject_reason IS NULL"))


# Attempts: hypotheses per order, one attempt per line number.
cte(
    "tries",
    "SELECT 'run' || (l_orderkey % 20) AS run_id, l_orderkey AS hypothesis, l_linenumber - 1 AS attempt, "
    "max(l_partkey || '') AS claim_id, CASE WHEN max(l_partkey) % 4 = 0 THEN 'verified' WHEN "
    "max(l_partkey) % 4 = 1 THEN 'quarantined' ELSE 'drift' END AS verdict FROM lineitem GROUP BY 1, 2, 3",
)
cte(
    "spans",
    "SELECT run_id, hypothesis, (SELECT min(n) FROM range(0, 5) r(n) WHERE n NOT IN (SELECT attempt FROM tries "
    "b WHERE b.hypothesis = a.hypothesis AND attempt <= 3)) AS gap, min(attempt) FILTER (verdict <> 'drift' "
    "AND attempt <= 3) AS e FROM tries a GROUP BY 1, 2",
    "tries",
)
cte(
    "outcomes",
    "SELECT s.run_id, s.hypothesis, t.claim_id AS final_claim_id, t.verdict AS final_verdict, "
    "CAST(CASE WHEN e < gap THEN e ELSE gap END AS INTEGER) AS n_events, NOT coalesce(e < gap, false) AS "
    "gave_up FROM spans s LEFT JOIN tries t ON t.hypothesis = s.hypothesis AND t.attempt = CASE WHEN e < gap "
    "THEN e ELSE gap - 1 END",
    "spans",
)


def tries(t: Tables):
    key = F.max("l_partkey")
    verdict = F.when(key % 4 == 0, "verified").when(key % 4 == 1, "quarantined").otherwise("drift")
    return t.lineitem.groupBy(
        F.concat(F.lit("run"), (F.col("l_orderkey") % 20).cast("string")).alias("run_id"),
        F.col("l_orderkey").alias("hypothesis"),
        (F.col("l_linenumber") - 1).alias("attempt"),
    ).agg(F.max(F.col("l_partkey").cast("string")).alias("claim_id"), verdict.alias("verdict"))


@query(
    "clm07_revision_outcome",
    with_ctes(
        "outcomes",
        select="SELECT run_id, hypothesis, final_claim_id, final_verdict, n_events, gave_up FROM outcomes",
    ),
)
def clm07(t: Tables):
    return cl.revision_outcome(tries(t))


@query(
    "clm07_revision_events",
    with_ctes(
        "outcomes",
        "tries",
        select="SELECT t.run_id, t.hypothesis, CAST(t.attempt AS INTEGER) AS attempt, t.claim_id FROM tries t "
        "JOIN outcomes o USING (hypothesis) WHERE t.attempt < n_events",
    ),
)
def clm07_events(t: Tables):
    attempts = tries(t)
    events = cl.revision_events(attempts, cl.revision_outcome(attempts))
    return events.select("run_id", "hypothesis", "attempt", "claim_id")


@query(
    "clm08_triage_report",
    with_ctes(
        "outcomes",
        select="SELECT run_id, count(*) AS hypotheses, count(*) FILTER (final_verdict = 'verified') AS "
        "verified, count(*) FILTER (final_verdict = 'quarantined') AS quarantined, count(*) FILTER (gave_up) "
        "AS gave_up, CAST(sum(n_events) AS BIGINT) AS events FROM outcomes GROUP BY run_id",
    ),
)
def clm08(t: Tables):
    return cl.triage_report(cl.revision_outcome(tries(t)))


@query(
    "clm09_propose_from_scan",
    with_ctes(
        "meta",
        "record_rows",
        select="SELECT m.run_id, kind AS finding_type, arg_min(m.run_id || '/' || m.seq, m.seq) AS receipt_id, "
        "arg_min(CASE WHEN tool_name = 'parse_evtx' THEN 'event_id=' || code || '+' ELSE '' END || "
        "'record_number=' || r.first, m.seq) AS predicate FROM meta m JOIN (SELECT run_id, seq, min(ordinal) "
        "AS first FROM record_rows GROUP BY 1, 2) r USING (run_id, seq) JOIN (VALUES "
        "('T1550.002_pass_the_hash_candidate', 'parse_evtx', '4624'), ('T1070.001_log_clearing', "
        "'run_hayabusa', ''), ('T1070.006_timestomp_candidate', 'parse_mft', ''), "
        "('T1547.001_registry_run_key', 'parse_registry', ''), ('T1053.005_scheduled_task', 'parse_evtx', "
        "'4698')) h(kind, tool, code) ON tool = tool_name WHERE m.seq % 6 <> 0 GROUP BY 1, 2",
    ),
)
def clm09(t: Tables):
    rows = ad.record_rows(t).withColumn("record_number", F.col("ordinal"))
    records = rows.select(
        F.concat_ws("/", "run_id", F.col("seq").cast("string")).alias("receipt_id"),
        "ordinal",
        F.create_map(F.lit("record_number"), F.col("record_number").cast("string"),
                     F.lit("sha1"), F.lit("null")).alias("record"),
    )
    made = ad.short_chain(t)
    banned = made.where("seq % 6 = 0").select("receipt_id")
    claims = cl.propose(made, records, ["seq"], banned)
    shown = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("predicate")),
            lambda e: F.concat(e["key"], F.lit("="), e["value"][0]),
        ),
        "+",
    )
    return claims.select("run_id", "finding_type", "receipt_id", shown.alias("predicate"))
