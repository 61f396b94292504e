"""Score ranked answers to questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.answers import first_match, list_payload
from ..functions.cells import strip
from ..functions.fixed import ANSWER_TYPES, LIST_ANSWER_TYPES
from ..functions.hashing import canonical_json
from ..functions.prose import bucket_question
from .receipts import placed_digest


def validate_questions(questions: DataFrame) -> DataFrame:
    """Adds `reject_reason`, null for usable questions."""
    answer = F.lower(strip(F.col("expected_answer")))
    no = lambda cond: ~F.coalesce(cond, F.lit(False))
    is_hash = F.col("answer_type") == "hex_hash"
    is_list = F.col("answer_type").isin(*LIST_ANSWER_TYPES)
    return questions.withColumn(
        "reject_reason",
        F.when(no(F.length("question_id") > 0), "no question id")
        .when(no(F.length("question_text") > 0), "no question text")
        .when(no(F.length("expected_answer") > 0), "no expected answer")
        .when(no(F.col("answer_type").isin(*ANSWER_TYPES)), "unknown answer type")
        .when(is_hash & no(answer.rlike("^[0-9a-f]+$")), "hash is not hex")
        .when(is_hash & no(F.length(answer).isin(32, 40, 64)), "hash length is not 32, 40 or 64")
        .when(
            is_list & list_payload(F.col("expected_answer")).isNull(),
            "list answer is not an array of strings",
        )
        .when(
            F.col("image_sha256").isNotNull()
            & no(F.lower(strip(F.col("image_sha256"))).rlike("^[0-9a-f]{64}$")),
            "image hash is not 64 hex digits",
        ),
    )


def score_attempts(attempts: DataFrame, k: int = 4) -> DataFrame:
    """Adds the first matching candidate among the first k; all candidates stay. Row by row."""
    index = first_match(F.col("answer_type"), F.col("expected_answer"), F.col("candidates"), k)
    return attempts.withColumn("matched_candidate_index", index).withColumn(
        "matched", F.col("matched_candidate_index").isNotNull()
    )


def tus_at_k(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of matched questions, with totals; 0 for no questions."""
    totals = (
        F.count("*").alias("total_questions"),
        F.count_if("matched").alias("matched_count"),
        F.coalesce(F.avg(F.col("matched").cast("int")), F.lit(0.0)).alias("tus_at_k"),
    )
    return scored.groupBy(*by).agg(*totals) if by else scored.agg(*totals)


def hard_subset(scored: DataFrame) -> DataFrame:
    """Only questions whose expected answer is not the empty list."""
    return scored.where(strip(F.col("expected_answer")) != "[]")


def with_buckets(questions: DataFrame, text: str = "question_text") -> DataFrame:
    return questions.select("*", bucket_question(F.col(text)).alias("_b")).select(
        *questions.columns, "_b.*"
    )


def breakdown(scored: DataFrame, dimensions: list[str]) -> DataFrame:
    """Matched, total and share per value of each dimension, in one pass."""
    sets = [[F.col(d)] for d in dimensions]
    grouped = scored.groupingSets(sets, *dimensions).agg(
        F.count("*").alias("total"),
        F.count_if("matched").alias("matched"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dimensions],
    )
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dimensions:
        mine = F.col(f"_g_{d}") == 0
        dimension = F.when(mine, F.lit(d)).otherwise(dimension)
        value = F.when(mine, F.col(d).cast("string")).otherwise(value)
    return grouped.select(
        dimension.alias("dimension"),
        value.alias("value"),
        "matched",
        "total",
        (F.col("matched") / F.col("total")).alias("pct"),
    )


def corpus_hash(questions: DataFrame, columns: list[str], fan: int = 10_000) -> DataFrame:
    """Digest of a corpus, whatever the order of its files and questions."""
    tree = placed_digest(questions, "question_id", canonical_json(questions, columns), fan)
    return tree.select(
        F.col("data_digest").alias("corpus_digest"), F.col("row_count").alias("n_questions")
    )


def pending(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Questions without a recorded attempt."""
    return questions.join(attempts.select("question_id").distinct(), "question_id", "left_anti")


def resume(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Prior attempts and those newly made for pending questions."""
    return prior.unionByName(fresh, allowMissingColumns=True)


def usage_rollup(attempts: DataFrame) -> DataFrame:
    """Tokens and seconds per model."""
    tokens = [c for c in attempts.columns if c.endswith("token_count")]
    return attempts.groupBy("model_id").agg(
        F.count("*").alias("attempts"),
        *[F.sum(c).alias(f"sum_{c}") for c in tokens],
        *[F.avg(c).alias(f"avg_{c}") for c in tokens],
        F.sum("wall_clock_seconds").alias("sum_seconds"),
        F.avg("wall_clock_seconds").alias("avg_seconds"),
    )


def failure_sample(scored: DataFrame, order: str = "question_id", n: int = 6) -> DataFrame:
    """The first n questions that were missed, texts cut for display."""
    cut = lambda c: F.left(c, F.lit(200))
    return (
        scored.where(~F.col("matched"))
        .orderBy(order)
        .limit(n)
        .select(
            "question_id",
            "answer_type",
            cut(F.col("expected_answer")).alias("expected"),
            cut(F.coalesce(F.try_element_at("candidates", F.lit(1)), F.lit("(none)"))).alias(
                "top_candidate"
            ),
        )
    )
