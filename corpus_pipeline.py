"""A corpus pipeline: language, near-duplicates, benchmark passages, source mixture, shards.

Each stage takes the documents that the stage before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestlake.llm import common
from attestlake.llm.decontaminate import contaminated_passages
from attestlake.llm.language_id import UNDETERMINED, identify, train
from attestlake.llm.mixing import mix_sources
from attestlake.llm.near_dedup import near_duplicates
from attestlake.llm.queries import held_out
from attestlake.llm.sharding import shard_rows
from attestlake.session import apply_settings

# A text goes if less than this share of its letters is in its main language.
LEAST_LANGUAGE_SHARE = 0.5
MAX_REPEATS = 1.25
SHARDS = 16
SEED = 2024


def _ready(spark: SparkSession) -> None:
    apply_settings(spark)
    common.batch_settings(spark)


def _row(docs: DataFrame, *needed: str) -> DataFrame:
    """Whole documents in one column `row`, and the columns that are needed beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *needed)


def _apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """Documents whose columns have numbers for names but for the `needed` ones, and what gives them their names back."""
    names = {c: c if c in needed else f"column {i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters and those without a main language go."""
    _ready(spark)
    model = train(docs.filter(~held_out(docs) & docs["doc_id"].isNotNull()))
    renamed, back = _apart(docs, "text")
    found = identify(renamed, model, renamed.columns)
    kept = (found["lang_pred"] != UNDETERMINED) & (found["lang_score"] >= LEAST_LANGUAGE_SHARE)
    return found.filter(kept).select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays.

    Rows that share an id are one document: of them the one with the longest text stays, then the one with the
    greatest text, then the greatest of the row as JSON. Documents without an id all stay.
    """
    _ready(spark)
    found = common.scratch(near_duplicates(docs), "pipeline-groups")
    gone = found.filter("not kept").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    several = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if several.isEmpty():
        return out
    repeated = _row(out.join(several, "doc_id", "left_semi").select(docs.columns), "doc_id", "text")
    best = F.struct(F.char_length("text"), "text", F.to_json("row"))
    chosen = repeated.groupBy("doc_id").agg(F.max_by("row", best).alias("row")).select("row.*")
    return out.join(several, "doc_id", "left_anti").select(docs.columns).unionByName(chosen)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    _ready(spark)
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    clean = _clean(docs.filter("doc_id is not null"), F.col("doc_id"), F.col("text"), items).select(docs.columns)
    nameless = docs.filter("doc_id is null")
    if nameless.isEmpty():
        return clean
    # Documents without an id are told apart by a number that is written before it is used.
    numbered = common.scratch(_row(nameless).withColumn("number", F.monotonically_increasing_id()), "pipeline-nameless")
    return clean.unionByName(_clean(numbered, F.col("number"), F.col("row.text"), items).select("row.*"))


def _clean(docs: DataFrame, key: Column, text: Column, items: DataFrame) -> DataFrame:
    found = contaminated_passages(docs.select(key.alias("doc_id"), text.alias("text")), items)
    hits = common.scratch(found.select(F.col("doc_id").alias("hit")).distinct(), "pipeline-hits")
    return docs.join(hits, key == hits["hit"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of smaller sources repeated as far as the limit allows."""
    _ready(spark)
    renamed, back = _apart(docs, "doc_id", "source", "text")
    return mix_sources(renamed, max_repeats=MAX_REPEATS, seed=SEED).select(*back)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; a column of documents of one of these names goes on as `shard_in` or `slot_in`."""
    _ready(spark)
    own = docs.withColumnsRenamed({c: f"{c}_in" for c in ("shard", "slot")})
    renamed, back = _apart(own, "doc_id", "text")
    placed = shard_rows(renamed, [F.col("doc_id"), F.xxhash64("text")], SHARDS, SEED)
    return placed.select(*back, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; the result of each is a written table that the next one reads."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
