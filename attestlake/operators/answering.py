"""From question prose to scored answers, all questions as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import prose
from ..functions.cells import inode_name
from ..session import scratch_table, written
from .search import answer_items, answer_variants, extension_counts, held_patterns, search


def asked_for(questions: DataFrame) -> DataFrame:
    """question_id, image, kind, pattern, extensions: what each question (question_id, question_text) asks for.

    A question about extensions is a `count`, one with a search text a `list`; others are `unclear`.
    """
    text = F.col("question_text")
    read = questions.select(
        "question_id",
        prose.image_of(text).alias("image"),
        prose.extract_pattern(text).alias("pattern"),
        prose.extract_extensions(text).alias("extensions"),
    )
    kind = F.when(F.size("extensions") > 0, "count").when(F.col("pattern").isNotNull(), "list").otherwise("unclear")
    return read.withColumn("kind", kind)


def _search_key() -> Column:
    """What a question searches for: questions of the same image and pattern have the same hits."""
    return F.concat("image", F.lit("\0"), "pattern")


def shared_items(asked: DataFrame, files: DataFrame) -> DataFrame:
    """pattern_id, item, in_deleted, in_live: the answer items of each search that list questions ask for, once for all of them."""
    lists = asked.where("kind = 'list'")
    patterns = lists.select(_search_key().alias("pattern_id"), F.col("pattern").alias("text"), "image").distinct()
    return answer_items(search(files, patterns), ["pattern_id"])


def found_items(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Answer items of all list questions, those of a shared search for each question that asks for it."""
    lists = asked.where("kind = 'list'").select("question_id", _search_key().alias("pattern_id")).distinct()
    return lists.join(shared_items(asked, files), "pattern_id").select("question_id", "item", "in_deleted", "in_live")


def found_counts(asked: DataFrame, files: DataFrame) -> DataFrame:
    """total, deleted and live of all count questions."""
    listing = files.select("image", "filename", "deleted")
    each = asked.where("kind = 'count'").select("question_id", "image", F.explode("extensions").alias("extension"))
    return extension_counts(listing, each, ["image"])


def ranked_answers(questions: DataFrame, files: DataFrame) -> DataFrame:
    """question_id, candidate_index, item: ranked answers as rows; counts are items too."""
    asked = written(asked_for(questions), scratch_table(questions.sparkSession, "asked"))
    counts = found_counts(asked, files)
    numbers = F.array(F.col("total"), F.col("deleted"), F.col("live"))
    counted = counts.select("question_id", F.posexplode(numbers).alias("candidate_index", "n"))
    return answer_variants(found_items(asked, files), ["question_id"]).unionByName(
        counted.select("question_id", "candidate_index", F.col("n").cast("string").alias("item"))
    )


def held_items(searches: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which answer items hold which searches (number, text, image), as two tables that are written when this is called.

    The first has the items of one file, with the `numbers` that it holds, those of each part of the searches in a row:
    image, item, in_deleted, in_live, numbers. Items of several files, and those of files that hold a great many, have a row
    for each number in the second, in which `number` is in the place of `numbers`.
    """
    spark = files.sparkSession
    listed = files.select("image", inode_name(F.col("inode"), F.col("filename")).alias("item"), "deleted", "content")
    held = held_patterns(listed, searches)
    sides = [F.coalesce(side, F.lit(False)).alias(name) for name, side in (("in_deleted", F.col("deleted")), ("in_live", ~F.col("deleted")))]
    held = held.select("image", "item", *sides, "numbers", "part")
    again = held.groupBy("image", "item", "part").agg(F.count("*").alias("n")).where("n > 1").select("image", "item").distinct()
    again = written(again, scratch_table(spark, "repeated-items")).withColumnsRenamed({"image": "_image", "item": "_item"})
    same = F.col("image").eqNullSafe(F.col("_image")) & F.col("item").eqNullSafe(F.col("_item"))
    several = held.join(again, same, "left_semi").withColumn("number", F.explode("numbers")).groupBy("image", "item", "number")
    several = several.agg(*[F.bool_or(n).alias(n) for n in ("in_deleted", "in_live")])
    return held.join(again, same, "left_anti"), written(several, scratch_table(spark, "items"))


def score_questions(questions: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """question_id, kind, matched_candidate_index: the first candidate that is the expected answer, null if none is.

    `expected`: question_id, item; a question without rows there expects nothing. Candidates of a list are all
    hits, those in deleted files, those in live ones, and nothing; of a count the three numbers. An answer is right if
    it is the whole expected set, which is compared by counting, so no answer has to fit a cell. Questions that search for
    the same share its items: only expected items meet them, and of two sets that have n and m items, k of them common,
    n + m - 2k are in one alone. Items of a search are only counted, in the tasks that find them, and expected items meet
    the files that they name, so no hit is shuffled as a row of its own unless its item has several files.
    """
    spark = questions.sparkSession
    asked = written(asked_for(questions), scratch_table(spark, "asked"))
    lists = asked.where("kind = 'list'").select("question_id", "image", F.col("pattern").alias("text"))
    searches = lists.select("image", "text").distinct().withColumn("number", F.monotonically_increasing_id())
    searches = written(searches, scratch_table(spark, "searches"))
    single, several = held_items(searches, files)
    d, v = F.col("in_deleted"), F.col("in_live")
    sides = {"all": d | v, "deleted": d, "live": v}
    items = single.select(F.explode("numbers").alias("number"), d, v).unionByName(several.select("number", d, v))
    totals = items.groupBy("number").agg(*[F.count_if(side).alias(f"n_{name}") for name, side in sides.items()])
    wanted = expected.select("question_id", "item").distinct()
    lists = lists.join(searches, ["image", "text"]).select("question_id", "image", "number")
    hoped = wanted.join(lists.distinct(), "question_id").join(single, ["image", "item"], "left")
    hoped = hoped.join(several.withColumnsRenamed({"in_deleted": "_d", "in_live": "_v"}), ["image", "item", "number"], "left")
    holds = F.coalesce(F.array_contains("numbers", F.col("number")), F.lit(False))
    one_of = lambda own, other: (holds & F.coalesce(own, F.lit(False))) | F.coalesce(other, F.lit(False))
    hoped = hoped.groupBy("question_id", "number", "image", "item").agg(
        F.bool_or(one_of(d, F.col("_d"))).alias("in_deleted"), F.bool_or(one_of(v, F.col("_v"))).alias("in_live")
    )
    common = hoped.groupBy("question_id", "number").agg(
        F.count("*").alias("hoped"), *[F.count_if(side).alias(f"k_{name}") for name, side in sides.items()]
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    wrong = F.array(*[n("hoped") + n(f"n_{s}") - 2 * n(f"k_{s}") for s in sides], n("hoped"))
    # A question that neither finds nor expects anything: its first candidate, the empty list, is right.
    right = F.array_position(wrong, F.lit(0).cast("bigint"))
    scored = lists.join(common, ["question_id", "number"], "left").join(totals, "number", "left").select(
        "question_id", F.lit("list").alias("kind"), right.alias("at")
    )

    numbers = F.transform(F.array("total", "deleted", "live"), lambda n: n.cast("string"))
    answers = wanted.groupBy("question_id").agg(F.min("item").alias("answer"), F.count("*").alias("n")).where("n = 1")
    counted = found_counts(asked, files).join(answers, "question_id", "left").select(
        "question_id", F.lit("count").alias("kind"), F.coalesce(F.array_position(numbers, F.col("answer")), F.lit(0)).alias("at")
    )
    unclear = asked.where("kind = 'unclear'").select("question_id", "kind", F.lit(0).cast("bigint").alias("at"))
    return scored.unionByName(counted).unionByName(unclear).select(
        "question_id", "kind", F.when(F.col("at") > 0, (F.col("at") - 1).cast("int")).alias("matched_candidate_index")
    )
