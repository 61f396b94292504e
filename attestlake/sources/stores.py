"""Receipt stores, question corpora, recorded attempts and evidence digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.answers import infer_answer_type
from ..functions.cells import strip
from ..functions.fixed import CANONICAL_FOLDER, RESERVED_FOLDERS

OFFSETS = "array<struct<start:bigint,length:bigint,artifact_label:string>>"
HEADER = (
    "struct<tool_name:string,tool_version:string,args_canonical:string,image_sha256:string,"
    "raw_digest:string,data_digest:string,offsets:" + OFFSETS + ",ts:timestamp,prev:string,"
    "run_id:string,seq:bigint,model_id:string,prompt_hash:string>"
)
STORED = (
    f"receipt_id string, header {HEADER}, first_record bigint, "
    "data array<map<string,string>>, seal string"
)


def receipt_lines(lines: DataFrame, path: Column) -> DataFrame:
    """Parse stored receipt lines; `path` is the file each came from.

    The scope is the run for the canonical folder and the folder name for any other
    one; lines that are no receipt are skipped.
    """
    parts = F.split(path, "/")
    folder = F.try_element_at(parts, F.lit(-2))
    stem = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\.[^.]*$", "")
    canonical = folder == CANONICAL_FOLDER
    parsed = lines.select(
        F.when(canonical, stem).otherwise(folder).alias("scope"),
        F.when(canonical, 0).otherwise(1).alias("store_rank"),
        path.alias("store"),
        F.from_json("value", STORED, {"mode": "PERMISSIVE"}).alias("r"),
    )
    reserved = [name for name in RESERVED_FOLDERS if name != CANONICAL_FOLDER]
    kept = parsed.where(~folder_of(F.col("store")).isin(*reserved))
    return kept.where(F.col("r.header.tool_name").isNotNull()).select(
        "scope", "store_rank", "store", "r.receipt_id", "r.header.*",
        F.coalesce("r.first_record", F.lit(0)).alias("first_record"), "r.data", "r.seal",
    )


def folder_of(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def read_receipts(spark: SparkSession, root: str) -> DataFrame:
    """Every store of receipt lines directly under `root`; one row per line.

    A receipt with very many records may take several lines with the same id (`write_receipt_lines`).
    """
    lines = spark.read.option("pathGlobFilter", "{*.jsonl,part-*}").text(f"{root.rstrip('/')}/*")
    return receipt_lines(lines, F.col("_metadata.file_path"))


def receipt_records(receipts: DataFrame) -> DataFrame:
    """Records of stored receipts, one row each."""
    rows = receipts.select("receipt_id", "first_record", F.posexplode("data").alias("at", "record"))
    return rows.select("receipt_id", (F.col("first_record") + F.col("at")).alias("record_idx"), "record")


def read_receipt_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(receipts, records) of a store that `append_receipts` wrote with records."""
    receipts, records = (spark.read.parquet(f"{path}/{name}") for name in ("receipts", "records"))
    return receipts.drop("run_bucket"), records.drop("run_bucket")


def corpus_questions(
    files: DataFrame, prefix: str = "nss", image_sha256: str | None = None, keep: list[str] = ()
) -> DataFrame:
    """Questions of whole corpus files (column `text`) in the `{"questions": [...]}` shape.

    The id is the position in the array, so a corpus file is one row until exploded.
    """
    doc = F.try_parse_json(strip(F.col("text")))
    entries = F.try_variant_get(doc, "$.questions", "array<variant>")
    rows = files.select(*keep, F.posexplode(entries).alias("pos", "q"))
    answer = F.try_variant_get("q", "$.answer", "variant")
    is_list = F.schema_of_variant(answer).startswith("ARRAY")
    items = F.sort_array(F.try_variant_get(answer, "$", "array<string>"))
    scalar = strip(F.try_variant_get(answer, "$", "string"))
    return rows.select(
        *keep,
        F.concat(F.lit(prefix + "-"), F.lpad(F.col("pos").cast("string"), 4, "0")).alias(
            "question_id"
        ),
        F.lit(image_sha256).cast("string").alias("image_sha256"),
        F.try_variant_get("q", "$.question", "string").alias("question_text"),
        infer_answer_type(is_list, scalar).alias("answer_type"),
        F.when(is_list, F.to_json(items)).otherwise(scalar).alias("expected_answer"),
        F.lit("III").alias("module"),
        F.array().cast("array<string>").alias("mitre_techniques"),
    )


NATIVE_QUESTION = (
    "question_id string, image_sha256 string, question_text string, answer_type string, "
    "expected_answer string, module string, mitre_techniques array<string>"
)


def _native(texts: DataFrame) -> DataFrame:
    row = texts.select(F.from_json("value", NATIVE_QUESTION).alias("q")).select("q.*")
    return row.where(F.col("question_id").isNotNull()).select(
        "question_id",
        "image_sha256",
        "question_text",
        "answer_type",
        "expected_answer",
        F.coalesce("module", F.lit("III")).alias("module"),
        F.coalesce("mitre_techniques", F.array().cast("array<string>")).alias("mitre_techniques"),
    )


def read_questions(
    spark: SparkSession, path: str, prefix: str = "nss", image_sha256: str | None = None
) -> DataFrame:
    """Corpus in any of its three shapes: lines, one array, or `{"questions": [...]}`."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    doc = F.try_parse_json(strip(F.col("text")))
    shape = F.coalesce(F.schema_of_variant(doc), F.lit(""))
    has_questions = F.coalesce(
        F.schema_of_variant(F.try_variant_get(doc, "$.questions", "variant")).startswith("ARRAY"),
        F.lit(False),
    )
    array = whole.where(shape.startswith("ARRAY")).select(
        F.explode(F.try_variant_get(doc, "$", "array<variant>")).alias("v")
    )
    lines = whole.where(~shape.startswith("ARRAY") & ~has_questions).select(
        F.explode(F.split("text", "\r?\n")).alias("value")
    )
    return (
        corpus_questions(whole.where(has_questions), prefix, image_sha256)
        .unionByName(_native(array.select(F.to_json("v").alias("value"))))
        .unionByName(_native(lines))
    )


ATTEMPT = (
    "seq bigint, question_id string, image_sha256 string, answer_type string, "
    "expected_answer string, candidates array<string>, matched boolean, "
    "matched_candidate_index int, wall_clock_seconds double, model_id string, "
    "prompt_token_count bigint, candidates_token_count bigint, total_token_count bigint, "
    "thoughts_token_count bigint"
)


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """The last written attempt per question; `seq` is the order of writing."""
    fields = [F.col(name) for name in attempts.columns if name != "question_id"]
    best = attempts.groupBy("question_id").agg(F.max_by(F.struct(*fields), "seq").alias("a"))
    return best.select("question_id", "a.*")


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Recorded attempts, one JSON object per line; unreadable lines are skipped."""
    parsed = spark.read.text(path).select(F.from_json("value", ATTEMPT).alias("a")).select("a.*")
    return latest_attempts(parsed.where(F.col("question_id").isNotNull()))


def digest_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Size and SHA-256 of evidence files. Big images arrive as segments, a row each."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")
    )


def digest_segments(segments: DataFrame, image: str = "image", order: str = "segment") -> DataFrame:
    """One digest for an image that arrives in segments (from `digest_files`, with image and segment number).

    It covers the number, sizes and digests of the segments in their order, so a segment that is missing,
    changed or out of place changes it. A row per image: image, n_segments, size_bytes, sha256.
    """
    line = F.concat_ws(":", F.col(order).cast("string"), F.col("size_bytes").cast("string"), "sha256")
    return segments.groupBy(image).agg(
        F.count("*").alias("n_segments"),
        F.sum("size_bytes").alias("size_bytes"),
        F.sort_array(F.collect_list(F.struct(order, line.alias("line")))).alias("_lines"),
    ).select(
        image,
        "n_segments",
        "size_bytes",
        F.sha2(F.concat_ws("\n", F.transform("_lines", lambda x: x["line"])).cast("binary"), 256).alias("sha256"),
    )


def evidence_manifest(evidence: DataFrame) -> DataFrame:
    """Adds the short handle id of an (image, run) pair."""
    joined = F.concat("image_sha256", "run_id")
    return evidence.withColumn(
        "handle_id", F.substring(F.sha2(joined.cast("binary"), 256), 1, 16)
    )
