"""Claims that cite receipts, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import (
    DRIFT,
    FINDING_TYPES,
    HYPOTHESES,
    IDENTIFIER_FIELDS,
    QUARANTINED,
    VERIFIED,
)
from ..session import scratch_table, written


def validate_claims(claims: DataFrame) -> DataFrame:
    """Adds `reject_reason`, null for usable claims.

    Columns: claim_id, finding_type, confidence, temperature and
    evidence array<struct<receipt_id, predicate map<string, array<string>>>>.
    """
    evidence = F.col("evidence")
    empty = F.coalesce(F.size(evidence) < 1, F.lit(True))
    bare = F.exists(evidence, lambda e: F.coalesce(F.size(e["predicate"]) < 1, F.lit(True)))
    return claims.withColumn(
        "reject_reason",
        F.when(empty, "no evidence")
        .when(bare, "empty predicate")
        .when(
            ~F.coalesce(F.col("finding_type").isin(*FINDING_TYPES), F.lit(False)),
            "unknown finding type",
        )
        .when(
            ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)),
            "confidence outside 0..1",
        )
        .when(
            ~F.coalesce(F.col("temperature").between(0.0, 2.0), F.lit(False)),
            "temperature outside 0..2",
        ),
    )


def claim_evidence(claims: DataFrame) -> DataFrame:
    """One row per cited receipt of each claim."""
    return claims.select(
        "claim_id", F.posexplode("evidence").alias("evidence_idx", "e")
    ).select("claim_id", "evidence_idx", "e.receipt_id", "e.predicate")


def _keyed(evidence: DataFrame) -> DataFrame:
    """Adds the sorted field list of the predicate, the values each field allows, and those of the first field."""
    keyed = evidence.withColumn("_fields", F.sort_array(F.map_keys("predicate")))
    allowed = F.transform("_fields", lambda name: F.array_distinct(F.element_at("predicate", name)))
    first = F.when(F.size("_fields") == 0, F.array(F.lit(""))).otherwise(F.get("_allowed", F.lit(0)))
    return keyed.withColumn("_allowed", allowed).withColumn("_firsts", first)


def _record_values(record: Column, fields: Column) -> Column:
    """A record's values of some fields; null when it lacks one of them."""
    values = F.transform(fields, lambda name: F.try_element_at(record, name))
    return F.when(~F.exists(values, F.isnull), values)


def _first_value(values: Column) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def _all_allowed(allowed: Column, values: Column) -> Column:
    one = F.zip_with(allowed, values, lambda a, v: F.coalesce(F.array_contains(a, v), F.lit(False)))
    return F.forall(one, lambda ok: ok)


# Citations of a receipt up to which each meets all tallies of it; more meet only those of the values that they allow.
MOST_CITED = 16


def match_predicate(
    evidence: DataFrame,
    records: DataFrame,
    ordinal: str = "ordinal",
    by: tuple[str, ...] = ("receipt_id",),
    record: Column | None = None,
) -> DataFrame:
    """Per evidence row the number of matching records and the first of them.

    Evidence: claim_id, evidence_idx, receipt_id, predicate map<string, array<string>>.
    Records: receipt_id, `ordinal`, record map<string, string>. A record matches when it
    has every field and its value is among the allowed ones; values are JSON text, so a
    JSON null is a value and a missing field is not.

    Receipts may go by other columns `by`, which evidence and records then have; other columns of the evidence are kept.
    `record` gives the map of a record as an expression, so that records are shuffled as they are.

    Records are reduced to counts per (receipt, fields, values) for the field lists cited
    for their receipt, and meet the evidence on the receipt; values are tested on the pair. Where more than MOST_CITED
    pieces of evidence cite a receipt, which are few receipts and are written when this is called, they meet on the value
    of the first field as well. So a receipt cited by many claims costs one pass over its records, value lists are
    never multiplied, and those of other receipts are not even made into rows.
    """
    keys, spark = list(by), evidence.sparkSession
    others = [n for n in evidence.columns if n not in keys and n != "predicate"]
    fields = F.sort_array(F.map_keys("predicate"))
    hot = evidence.groupBy(*keys).agg(F.count("*").alias("_cited")).where(F.col("_cited") > MOST_CITED)
    hot = written(hot.select(*keys), scratch_table(spark, "hot-receipts"))
    shapes = evidence.groupBy(*keys).agg(F.collect_set(fields).alias("_shapes"))
    record = F.col("record") if record is None else record
    tallies = (
        records.join(shapes, keys)
        .withColumn("_fields", F.explode("_shapes"))
        .withColumn("_values", _record_values(record, F.col("_fields")))
        .where(F.col("_values").isNotNull())
        .groupBy(*keys, "_fields", "_values")
        .agg(F.count("*").alias("_n"), F.min(ordinal).alias("_first"))
    )

    def met(pairs: DataFrame, fits: Column) -> DataFrame:
        n, first = F.when(fits, F.col("_n")), F.when(fits, F.col("_first"))
        return pairs.groupBy(*keys, *others).agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_matches"), F.min(first).alias("first_match"))

    # On the receipt alone, so that nothing is shuffled by the fields or by the claim: a list of fields fits a predicate of
    # the same length that has them all.
    allowed = F.transform("_fields", lambda name: F.try_element_at("predicate", name))
    same = F.size("predicate") == F.size("_fields")
    cold = met(evidence.join(hot, keys, "left_anti").join(tallies, keys, "left"), same & _all_allowed(allowed, F.col("_values")))
    asked = _keyed(evidence.join(hot, keys, "left_semi"))
    asked = asked.select(*keys, *others, "_fields", "_allowed", F.explode_outer("_firsts").alias("_value"))
    valued = tallies.join(hot, keys, "left_semi").withColumn("_value", _first_value(F.col("_values")))
    warm = met(asked.join(valued, [*keys, "_fields", "_value"], "left"), _all_allowed(F.col("_allowed"), F.col("_values")))
    names = [*[n for n in ("claim_id", "evidence_idx", "receipt_id") if n in cold.columns], "n_matches", "first_match"]
    names = [*names, *[n for n in cold.columns if n not in names]]
    return cold.unionByName(warm).select(*names)


def predicate_hits(evidence: DataFrame, records: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """All matching records, one row per (evidence, record)."""
    keyed = _keyed(evidence)
    shapes = keyed.select("receipt_id", "_fields").distinct()
    valued = records.join(shapes, "receipt_id").withColumn(
        "_values", _record_values(F.col("record"), F.col("_fields"))
    )
    valued = valued.where(F.col("_values").isNotNull()).withColumn("_value", _first_value(F.col("_values")))
    asked = keyed.withColumn("_value", F.explode("_firsts"))
    met = asked.join(valued, ["receipt_id", "_fields", "_value"])
    return met.where(_all_allowed(F.col("_allowed"), F.col("_values"))).select(
        "claim_id", "evidence_idx", "receipt_id", ordinal
    )


# Checks in their order, and what it means when one fails.
CHECKS = (
    ("seal_ok", "seal does not fit the header"),
    ("data_ok", "records do not fit the data digest"),
    ("version_ok", "version drift"),
    ("replay_ok", "replay gives other results"),
)


def first_failure(flags: dict[str, Column]) -> Column:
    """First failing check of a receipt whose row has all of its checks, as `receipt_checks` gives it."""
    failed = [F.when(~F.coalesce(flags[name], F.lit(False)), F.lit(text)) for name, text in CHECKS if name in flags]
    return F.coalesce(*failed, F.lit(None).cast("string"))


def receipt_checks(
    receipts: DataFrame,
    seal: DataFrame | None = None,
    data: DataFrame | None = None,
    replay: DataFrame | None = None,
    version: DataFrame | None = None,
) -> DataFrame:
    """First failing check per receipt, in the order seal, data, version, replay.

    Each input is computed once per receipt, whatever the number of citations.
    """
    rows = receipts.select("receipt_id").distinct()
    reason = F.lit(None).cast("string")
    for part, (flag, text) in zip((replay, version, data, seal), reversed(CHECKS), strict=True):
        if part is not None:
            rows = rows.join(part, "receipt_id", "left")
            stated = F.lit(text)
            if "replay_reason" in part.columns:
                stated = F.coalesce("replay_reason", F.lit(text))
            reason = F.when(~F.coalesce(flag, F.lit(False)), stated).otherwise(reason)
    return rows.select("receipt_id", reason.alias("failure"))


def judge_evidence(evidence: DataFrame, checks: DataFrame, matches: DataFrame) -> DataFrame:
    """Every citation with its failure, if any, and its number of matches.

    Unknown receipts fail first; a failed citation counts no matches.
    """
    known = checks.withColumn("_known", F.lit(True))
    found = matches.select("claim_id", "evidence_idx", "n_matches", "first_match")
    joined = evidence.join(known, "receipt_id", "left").join(
        found, ["claim_id", "evidence_idx"], "left"
    )
    failure = F.when(F.col("_known").isNull(), F.lit("unknown receipt")).otherwise(F.col("failure"))
    return joined.select(
        "claim_id",
        "evidence_idx",
        "receipt_id",
        failure.alias("failure"),
        F.when(failure.isNull(), F.coalesce("n_matches", F.lit(0))).otherwise(0).alias("n_matches"),
        F.when(failure.isNull(), F.col("first_match")).alias("first_match"),
    )


def verdicts(judged: DataFrame) -> DataFrame:
    """One verdict per claim: drift, else quarantined, else verified."""
    failed = F.col("failure").isNotNull()
    unmatched = ~failed & (F.col("n_matches") == 0)
    listed = F.struct("evidence_idx", "receipt_id")
    totals = judged.groupBy("claim_id").agg(
        F.count("*").alias("n_evidence"),
        F.min_by(F.struct("receipt_id", "failure"), F.when(failed, F.col("evidence_idx"))).alias("_f"),
        F.sort_array(F.collect_list(F.when(failed, listed))).alias("_failed"),
        F.sort_array(F.collect_list(F.when(unmatched, listed))).alias("_unmatched"),
    )
    ids = lambda name: F.transform(name, lambda x: x["receipt_id"])
    verdict = (
        F.when(F.size("_failed") > 0, DRIFT)
        .when(F.size("_unmatched") > 0, QUARANTINED)
        .otherwise(VERIFIED)
    )
    return totals.select(
        "claim_id",
        verdict.alias("verdict"),
        F.when(
            F.size("_failed") > 0,
            F.concat(F.lit("receipt "), F.col("_f.receipt_id"), F.lit(": "), F.col("_f.failure")),
        )
        .when(
            F.size("_unmatched") > 0,
            F.concat(F.lit("no record fits in: "), F.array_join(ids("_unmatched"), ", ")),
        )
        .otherwise("all receipts hold and all predicates match")
        .alias("reason"),
        "n_evidence",
        ids("_failed").alias("failed_receipts"),
        ids("_unmatched").alias("unmatched_receipts"),
    )


def verify(
    claims: DataFrame,
    checks: DataFrame,
    records: DataFrame,
    ordinal: str = "ordinal",
    by: tuple[str, ...] = ("receipt_id",),
    record: Column | None = None,
) -> DataFrame:
    """All claims at once: usable ones get a verdict, others their reject reason.

    Only evidence whose receipt holds meets the records; evidence is written with its failures when this is called. `by` and `record` are those of `match_predicate`; `checks` has
    the columns `by` too, so records need not be named by receipt.
    """
    valid = validate_claims(claims)
    evidence = claim_evidence(valid.where(F.col("reject_reason").isNull()))
    known = evidence.join(checks.withColumn("_known", F.lit(True)), "receipt_id", "left")
    failure = F.when(F.col("_known").isNull(), F.lit("unknown receipt")).otherwise(F.col("failure"))
    known = written(known.withColumn("failure", failure).drop("_known"), scratch_table(claims.sparkSession, "evidence"))
    columns = ["claim_id", "evidence_idx", "receipt_id", "failure", "n_matches", "first_match"]
    failed = known.where("failure is not null").withColumn("n_matches", F.lit(0).cast("bigint")).withColumn(
        "first_match", F.lit(None).cast(records.schema[ordinal].dataType)
    )
    found = match_predicate(known.where("failure is null"), records, ordinal, by, record)
    judged = failed.select(*columns).unionByName(found.select(*columns))
    return (
        valid.select("claim_id", "finding_type", "reject_reason")
        .join(verdicts(judged), "claim_id", "left")
    )


def constraint_text(results: DataFrame) -> DataFrame:
    """What the next attempt has to respect, for claims that were not verified."""
    failed = F.array_join("failed_receipts", ", ")
    unmatched = F.array_join("unmatched_receipts", ", ")
    start = F.concat(F.lit("Claim "), F.col("claim_id"), F.lit(" ("), F.col("finding_type"), F.lit(") "))
    text = (
        F.when(
            F.size("failed_receipts") > 0,
            F.concat(start, F.lit("rests on receipts that did not hold: "), failed,
                     F.lit(". Leave them out, or run the tool again first.")),
        )
        .when(
            F.size("unmatched_receipts") > 0,
            F.concat(start, F.lit("found no fitting record in: "), unmatched,
                     F.lit(". Choose another predicate or receipt, or state it as narrative.")),
        )
        .otherwise(F.concat(start, F.lit("was not accepted: "), F.col("reason"), F.lit(".")))
    )
    return results.where(F.col("verdict") != VERIFIED).select(
        "claim_id", "verdict", text.alias("constraint")
    )


def revision_outcome(attempts: DataFrame, max_revisions: int = 3) -> DataFrame:
    """Where the attempts of each hypothesis end.

    Attempts: run_id, hypothesis, attempt (from 0), claim_id, verdict. They are tried in
    order, up to `max_revisions` repeats; the first that is not drift ends the series. A
    missing number means that nothing was proposed any more.
    """
    keys = ["run_id", "hypothesis"]
    allowed = attempts.where(F.col("attempt") <= max_revisions)
    # Attempts beyond the limit do not count, but their hypothesis does: it is given up.
    counted = F.when(F.col("attempt") <= max_revisions, F.col("attempt"))
    terminal = F.when(F.col("verdict") != DRIFT, counted)
    # The first missing number: attempts present without a break from 0.
    spans = attempts.groupBy(*keys).agg(
        F.collect_set(counted).alias("_seen"), F.min(terminal).alias("_end")
    )
    numbers = F.sequence(F.lit(0), F.lit(max_revisions + 1))
    gap = F.array_min(F.filter(numbers, lambda n: ~F.array_contains("_seen", n)))
    ends = spans.select(
        *keys, gap.alias("_gap"), F.when(F.col("_end") < gap, F.col("_end")).alias("_end")
    )
    last = F.coalesce("_end", F.col("_gap") - 1)
    final = allowed.select(*keys, F.col("attempt").alias("_last"), "claim_id", "verdict")
    return (
        ends.withColumn("_last", last)
        .join(final, [*keys, "_last"], "left")
        .select(
            *keys,
            F.col("claim_id").alias("final_claim_id"),
            F.col("verdict").alias("final_verdict"),
            F.coalesce("_end", "_gap").cast("int").alias("n_events"),
            F.col("_end").isNull().alias("gave_up"),
        )
    )


def revision_events(attempts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The abandoned attempts, one event each."""
    keys = ["run_id", "hypothesis"]
    return attempts.join(outcomes.select(*keys, "n_events"), keys).where(
        F.col("attempt") < F.col("n_events")
    ).drop("n_events")


def triage_report(outcomes: DataFrame) -> DataFrame:
    """Counts per run."""
    return outcomes.groupBy("run_id").agg(
        F.count("*").alias("hypotheses"),
        F.count_if(F.col("final_verdict") == VERIFIED).alias("verified"),
        F.count_if(F.col("final_verdict") == QUARANTINED).alias("quarantined"),
        F.count_if("gave_up").alias("gave_up"),
        F.sum("n_events").alias("events"),
    )


def propose(
    receipts: DataFrame,
    records: DataFrame,
    order: list[str],
    banned: DataFrame | None = None,
    ordinal: str = "ordinal",
    hypotheses=HYPOTHESES,
) -> DataFrame:
    """Per run and hypothesis a claim from the first receipt of its tool that has a usable
    first record: the base predicate plus the first identifying field of that record."""
    usable = receipts
    if banned is not None:
        usable = usable.join(banned.select("receipt_id").distinct(), "receipt_id", "left_anti")
    first = records.groupBy("receipt_id").agg(F.min_by("record", ordinal).alias("record"))
    named = F.filter(
        F.transform(
            F.array(*[F.lit(n) for n in IDENTIFIER_FIELDS]),
            lambda n: F.struct(n.alias("key"), F.try_element_at("record", n).alias("value")),
        ),
        lambda e: e["value"].isNotNull() & ~e["value"].isin("null", '""'),
    )
    spread = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("rank"), F.lit(kind).alias("finding_type"),
                    F.lit(tool).alias("tool"),
                    F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
                              for k, v in base.items()])
                    .cast("array<struct<key:string,value:string>>").alias("base"),
                )
                for i, (kind, tool, base) in enumerate(hypotheses)
            ]
        )
    )
    candidates = (
        usable.join(first, "receipt_id")
        .withColumn("_id", F.try_element_at(named, F.lit(1)))
        .withColumn("_h", spread)
        .where(F.col("_h.tool") == F.col("tool_name"))
    )
    entries = F.concat("_h.base", F.when(F.col("_id").isNotNull(), F.array("_id")).otherwise(
        F.array().cast("array<struct<key:string,value:string>>")))
    proposed = candidates.withColumn("_entries", entries).where(F.size("_entries") > 0)
    return (
        proposed.groupBy("run_id", F.col("_h.finding_type").alias("finding_type"))
        .agg(F.min_by(F.struct("receipt_id", "_entries"), F.struct(*order)).alias("p"))
        .select(
            "run_id",
            "finding_type",
            F.col("p.receipt_id").alias("receipt_id"),
            F.transform_values(
                F.map_from_entries("p._entries"), lambda k, v: F.array(v)
            ).alias("predicate"),
        )
    )
