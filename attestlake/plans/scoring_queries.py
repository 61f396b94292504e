"""Questions and ranked answers: orders as questions, their line items as candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as ans, prose
from ..functions.hashing import json_text
from ..operators import scoring as sco
from ..session import scratch_table, written
from ..sources.sinks import append_attempts, write_scorecard
from ..sources.stores import corpus_questions, latest_attempts, read_attempts
from . import adapters as ad
from .adapters import cte, pick, text, with_ctes
from .registry import Tables, query

KINDS = {
    0: "exact_string",
    1: "string_ci",
    2: "hex_hash",
    3: "numeric",
    4: "timestamp",
    5: "path",
    6: "sid",
    7: "nss_inode_filename_list",
    8: "list_of_strings",
}


def pairs(t: Tables):
    """One row per line item: the order's expected answer and the item's candidate."""
    kind = F.col("o_orderkey") % 9
    status, line = F.col("o_orderstatus"), F.col("l_linestatus")
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    expected = (
        F.when(kind.isin(0, 1), text(status, " "))
        .when(kind == 2, F.sha2(status.cast("binary"), 256))
        .when(kind == 3, text((F.col("o_orderkey") % 50).cast("string"), ".0"))
        .when(kind == 4, F.date_format("o_orderdate", iso))
        .when(kind == 5, text("C:\\Data\\", status))
        .when(kind == 6, text("s-1-5-", F.lower(status)))
        .otherwise(text('["a"," ', status, '"]'))
    )
    later = F.timestamp_add("SECOND", (F.col("l_partkey") % 5).cast("int"), F.col("o_orderdate"))
    given = (
        F.when(kind == 0, text(" ", line))
        .when(kind == 1, F.lower(line))
        .when(kind == 2, F.upper(F.sha2(line.cast("binary"), 256)))
        .when(kind == 3, F.col("l_quantity").cast("bigint").cast("string"))
        .when(kind == 4, text(F.date_format(later, iso), "Z"))
        .when(kind == 5, text("c://data\\\\", F.lower(line), "/"))
        .when(kind == 6, text("S-1-5-", line))
        .when(F.col("l_partkey") % 10 == 0, "[1]")
        .when(F.col("l_partkey") % 10 == 1, "not a list")
        .otherwise(text('["', line, '", "a", "a"]'))
    )
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey",
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        pick(kind, KINDS).alias("answer_type"),
        expected.alias("expected_answer"),
        given.alias("candidate"),
    )


cte(
    "pairs",
    f"SELECT o_orderkey, l_linenumber AS line, l_partkey AS part, {ad.pick_sql('o_orderkey % 9', KINDS)} AS "
    "answer_type, CASE o_orderkey % 9 WHEN 0 THEN o_orderstatus || ' ' WHEN 1 THEN o_orderstatus || ' ' "
    "WHEN 2 THEN sha256(o_orderstatus) WHEN 3 THEN (o_orderkey % 50) || '.0' WHEN 4 THEN "
    "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 5 THEN 'C:\\Data\\' || o_orderstatus WHEN 6 THEN "
    "'s-1-5-' || lower(o_orderstatus) ELSE '[\"a\",\" ' || o_orderstatus || '\"]' END AS expected_answer, "
    "CASE WHEN o_orderkey % 9 = 0 THEN ' ' || l_linestatus WHEN o_orderkey % 9 = 1 THEN lower(l_linestatus) "
    "WHEN o_orderkey % 9 = 2 THEN upper(sha256(l_linestatus)) WHEN o_orderkey % 9 = 3 THEN "
    "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN o_orderkey % 9 = 4 THEN strftime(o_orderdate + "
    "to_seconds(l_partkey % 5), '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN o_orderkey % 9 = 5 THEN 'c://data\\\\' || "
    "lower(l_linestatus) || '/' WHEN o_orderkey % 9 = 6 THEN 'S-1-5-' || l_linestatus WHEN l_partkey % 10 = 0 "
    "THEN '[1]' WHEN l_partkey % 10 = 1 THEN 'not a list' ELSE '[\"' || l_linestatus || '\", \"a\", \"a\"]' END "
    "AS candidate, CASE WHEN o_orderkey % 9 = 3 THEN o_orderkey % 50 = l_quantity WHEN o_orderkey % 9 = 4 "
    "THEN l_partkey % 5 <= 2 WHEN o_orderkey % 9 >= 7 THEN o_orderstatus = l_linestatus AND l_partkey % 10 > 1 "
    "ELSE o_orderstatus = l_linestatus END AS matched FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
)


def attempts(t: Tables):
    """Ranked candidates per order, by line number; an order has a handful of lines."""
    ranked = F.array_sort(F.collect_list(F.struct("line", "part", "candidate")))
    return pairs(t).groupBy("o_orderkey", "answer_type", "expected_answer").agg(
        F.transform(ranked, lambda c: c["candidate"]).alias("candidates"),
        F.sum("part").alias("prompt_token_count"),
        (F.sum("line") / 8).alias("wall_clock_seconds"),
    ).withColumn("question_id", text("q-", F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))).withColumn(
        "model_id", text("m", (F.col("o_orderkey") % 3).cast("string"))
    )


cte(
    "scored",
    "SELECT o_orderkey, answer_type, expected_answer, 'q-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS "
    "question_id, 'm' || (o_orderkey % 3) AS model_id, min(CASE WHEN matched AND rk <= 4 THEN rk - 1 END) AS "
    "first_index, sum(part) AS tokens, sum(line) / 8 AS seconds, arg_min(candidate, rk) AS top, "
    "o_orderkey % 2 AS half FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY line, part, "
    "candidate) AS rk FROM pairs) GROUP BY ALL",
    "pairs",
)


@query(
    "ben01_infer_answer_type",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'nss_inode_filename_list' "
    "WHEN 1 THEN 'numeric' ELSE 'string_ci' END AS answer_type FROM lineitem",
)
def ben01(t: Tables):
    kind = F.col("l_linenumber") % 3
    number = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    scalar = F.when(kind == 1, text(" -", number)).otherwise(text(number, "%"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        ans.infer_answer_type(kind == 0, scalar).alias("answer_type"),
    )


@query(
    "ben02_validate_questions",
    "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'no question text' WHEN 1 THEN 'unknown answer type' "
    "WHEN 2 THEN 'hash is not hex' WHEN 3 THEN 'hash length is not 32, 40 or 64' WHEN 4 THEN 'list answer is "
    "not an array of strings' WHEN 5 THEN 'image hash is not 64 hex digits' END AS reject_reason FROM orders",
)
def ben02(t: Tables):
    kind = F.col("o_orderkey") % 8
    key = F.col("o_orderkey").cast("string")
    rows = t.orders.select(
        "o_orderkey",
        text("q", key).alias("question_id"),
        F.when(kind == 0, "").otherwise(F.col("o_orderpriority")).alias("question_text"),
        F.when(kind == 1, "essay").when(kind.isin(2, 3), "hex_hash").when(kind == 4, "list_of_strings")
        .otherwise("string_ci").alias("answer_type"),
        F.when(kind == 2, text("xyz", key)).when(kind == 3, "abc").when(kind == 4, text('["a",', key, "]"))
        .otherwise(key).alias("expected_answer"),
        F.when(kind == 5, key).when(kind == 6, F.upper(F.sha2(key.cast("binary"), 256)))
        .alias("image_sha256"),
    )
    return sco.validate_questions(rows).select("o_orderkey", "reject_reason")


@query(
    "ben03_match_answer",
    with_ctes("pairs", select="SELECT o_orderkey, line, part, answer_type, matched FROM pairs"),
)
def ben03(t: Tables):
    hit = ans.match_answer(F.col("answer_type"), F.col("expected_answer"), F.col("candidate"))
    return pairs(t).select("o_orderkey", "line", "part", "answer_type", hit.alias("matched"))


@query(
    "ben04_list_stats",
    with_ctes(
        "pairs",
        select="SELECT o_orderkey, line, part, CASE WHEN part % 10 > 1 THEN CASE WHEN matched THEN 1.0 ELSE 0.5 "
        "END END AS prec, CASE WHEN part % 10 > 1 THEN CASE WHEN matched THEN 1.0 ELSE 0.5 END END AS f1, "
        "CASE WHEN part % 10 > 1 THEN CASE WHEN matched THEN 1.0 ELSE 0.0 END END AS exact FROM pairs WHERE "
        "answer_type IN ('list_of_strings', 'nss_inode_filename_list')",
    ),
)
def ben04(t: Tables):
    rows = pairs(t).where(F.col("answer_type").isin("list_of_strings", "nss_inode_filename_list"))
    stats = ans.list_stats(F.col("expected_answer"), F.col("candidate"))
    return rows.select("o_orderkey", "line", "part", stats.alias("s")).select(
        "o_orderkey", "line", "part", F.col("s.precision").alias("prec"), "s.f1", "s.exact"
    )


@query(
    "ben05_score_attempt",
    with_ctes(
        "scored",
        select="SELECT question_id, CAST(first_index AS INTEGER) AS matched_candidate_index, first_index IS NOT "
        "NULL AS matched FROM scored",
    ),
)
def ben05(t: Tables):
    return sco.score_attempts(attempts(t)).select("question_id", "matched_candidate_index", "matched")


@query(
    "ben06_tus_at_k",
    with_ctes(
        "scored",
        select="SELECT count(*) AS total_questions, count(first_index) AS matched_count, "
        "round(count(first_index) / count(*), 12) AS tus_at_k FROM scored",
    ),
)
def ben06(t: Tables):
    return sco.tus_at_k(sco.score_attempts(attempts(t))).withColumn(
        "tus_at_k", F.round("tus_at_k", 12)
    )


@query(
    "ben07_breakdowns",
    with_ctes(
        "scored",
        select="SELECT dimension, value, count(first_index) AS matched, count(*) AS total, "
        "round(count(first_index) / count(*), 12) AS pct FROM (SELECT 'answer_type' AS dimension, answer_type "
        "AS value, first_index FROM scored UNION ALL SELECT 'model_id', model_id, first_index FROM scored) "
        "GROUP BY 1, 2",
    ),
)
def ben07(t: Tables):
    rows = sco.breakdown(sco.score_attempts(attempts(t)), ["answer_type", "model_id"])
    return rows.withColumn("pct", F.round("pct", 12))


HEAD = "Which files hold "


def questions(t: Tables):
    """Documents as question prose: several shapes, then the partition dump, then the text."""
    doc = F.col("doc_id")
    ask = (
        F.when(doc % 6 == 0, text("the email user", doc.cast("string"), ".x@example.com in the first Windows data partition?"))
        .when(doc % 6 == 1, text("the phone number \\(901\\)555-", F.lpad(doc.cast("string"), 4, "0"), ". in the HFS+ volume"))
        .when(doc % 6 == 2, text("the word/words \"été", doc.cast("string"), '" in  the second HFS volume'))
        .when(doc % 6 == 3, text("'inode:filename' and 'needle", doc.cast("string"), "' on linux"))
        .when(doc % 18 == 4, "extension(s) .TXT and .html in the NTFS area")
        .when(doc % 18 == 10, "extensions .html,.txt, and .TXT in the NTFS area")
        .when(doc % 18 == 16, "extensions .txt, and .html in the NTFS area")
        .otherwise("\"count\" or \"hay\" in exFAT")
    )
    return t.documents.select(
        "doc_id",
        text(
            HEAD, ask, F.when(doc % 2 == 0, " ss-unix").otherwise(" ss-win"),
            ". The mmls output is ntfs fat. ", F.col("text"),
        ).alias("question_text"),
    )


@query(
    "ben08_bucket_question",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ss-unix' ELSE 'ss-win' END AS image, CASE doc_id % 6 WHEN 0 "
    "THEN 'first windows data' WHEN 1 THEN 'hfs' WHEN 2 THEN 'hfs' WHEN 3 THEN 'linux' WHEN 4 THEN 'ntfs' ELSE "
    "'exfat' END AS filesystem, CASE doc_id % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 4 THEN 'count' "
    "ELSE 'other' END AS shape FROM documents",
)
def ben08(t: Tables):
    return sco.with_buckets(questions(t)).select("doc_id", "image", "filesystem", "shape")


@query(
    "ben09_hard_subset",
    with_ctes(
        "scored",
        select="SELECT count(*) AS total_questions, count(first_index) AS matched_count FROM scored "
        "WHERE o_orderkey % 4 <> 0",
    ),
)
def ben09(t: Tables):
    scored = sco.score_attempts(attempts(t)).withColumn(
        "expected_answer",
        F.when(F.col("o_orderkey") % 4 == 0, " [] ").otherwise(F.col("expected_answer")),
    )
    return sco.tus_at_k(sco.hard_subset(scored)).drop("tus_at_k")


@query(
    "ben10_corpus_hash",
    "WITH leaf AS (SELECT CAST('0x' || substr(sha256('q' || o_orderkey), 1, 10) AS BIGINT) AS pl, "
    "sha256('{\"answer\":\"' || o_orderstatus || '\",\"question_id\":\"q' || o_orderkey || '\"}') AS h FROM "
    "orders), a AS (SELECT pl // 10000 AS pl, sha256(string_agg(h, '' ORDER BY pl, h)) AS h FROM leaf GROUP BY "
    "1), b AS (SELECT pl // 10000 AS pl, sha256(string_agg(h, '' ORDER BY pl)) AS h FROM a GROUP BY 1) SELECT "
    "sha256(string_agg(h, '' ORDER BY pl)) AS corpus_digest, (SELECT count(*) FROM orders) AS n_questions FROM b",
)
def ben10(t: Tables):
    rows = t.orders.select(
        text("q", F.col("o_orderkey").cast("string")).alias("question_id"),
        F.col("o_orderstatus").alias("answer"),
    )
    return sco.corpus_hash(rows, ["question_id", "answer"])


@query(
    "ben11_resume",
    "SELECT o_orderkey AS question_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE "
    "l_orderkey = o_orderkey)",
)
def ben11(t: Tables):
    asked = t.orders.select(F.col("o_orderkey").alias("question_id"))
    return sco.pending(asked, t.lineitem.select(F.col("l_orderkey").alias("question_id")))


@query(
    "src13_attempts",
    "SELECT l_orderkey AS question_id, max(l_linenumber) AS seq FROM lineitem GROUP BY 1",
)
def src13(t: Tables):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("seq"), "l_quantity"
    )
    return latest_attempts(rows).select("question_id", "seq")


@query(
    "snk03_append_attempts",
    "SELECT CAST(l_orderkey AS VARCHAR) AS question_id, max(l_linenumber) AS seq FROM lineitem GROUP BY 1",
)
def snk03(t: Tables):
    """Attempts written as lines in two goes and read back: the last one per question counts."""
    rows = t.lineitem.select(
        F.col("l_linenumber").cast("bigint").alias("seq"),
        F.col("l_orderkey").cast("string").alias("question_id"),
        F.array("l_linestatus").alias("candidates"),
    )
    path = scratch_table(t.spark, "attempts")
    append_attempts(rows.where("seq > 2"), path)
    append_attempts(rows.where("seq <= 2"), path)
    return read_attempts(t.spark, path).select("question_id", "seq")


@query(
    "src12_questions",
    "SELECT page_id, 'nss-0000' AS question_id, url AS question_text, CASE page_id % 3 WHEN 0 THEN "
    "'nss_inode_filename_list' WHEN 1 THEN 'numeric' ELSE 'string_ci' END AS answer_type, CASE page_id % 3 WHEN "
    "0 THEN '[\"1:a\",\"2:b' || page_id || '\"]' WHEN 1 THEN page_id || '.5' ELSE 'x' || page_id END AS "
    "expected_answer FROM pages UNION ALL SELECT page_id, 'nss-0001', 'second', 'numeric', "
    "CAST(page_id AS VARCHAR) FROM pages",
)
def src12(t: Tables):
    """Each page as a corpus file of two questions."""
    key = F.col("page_id").cast("string")
    answer = (
        F.when(F.col("page_id") % 3 == 0, text('["2:b', key, '","1:a"]'))
        .when(F.col("page_id") % 3 == 1, text(key, ".5"))
        .otherwise(text('" x', key, ' "'))
    )
    files = t.pages.select(
        text(
            '{"questions":[{"question":', json_text(F.col("url")),
            ',"answer":', answer, '},{"question":"second","answer":', key, "}]}",
        ).alias("text"),
        "page_id",
    )
    return corpus_questions(files, keep=["page_id"]).select(
        "page_id", "question_id", "question_text", "answer_type", "expected_answer"
    )


def replies(t: Tables):
    """Conversation turns with an answer block behind their text."""
    turn = F.col("turn")
    body = F.to_json(
        F.struct(F.array(F.col("role"), turn.cast("string"), F.lit("z")).alias("candidates"))
    )
    fence = lambda inner, tag="json": text("\n```" + tag + "\n", inner, "\n```\n")
    tail = (
        F.when(turn % 4 == 0, text(fence(F.lit('{"candidates":["draft"]}')), fence(body, ""), "done"))
        .when(turn % 4 == 1, text(" so ", body, " it is"))
        .when(turn % 4 == 2, text(fence(F.lit('{"candidates":[]}')), " ", body))
        .otherwise("no answer")
    )
    return t.conversations.select("conv_id", "turn", "role", text(F.col("text"), tail).alias("reply"))


@query(
    "ben12_parse_candidates",
    "SELECT conv_id, turn, CASE WHEN turn % 4 >= 2 THEN '' ELSE role || '+' || turn END AS candidates "
    "FROM conversations",
)
def ben12(t: Tables):
    return replies(t).select(
        "conv_id", "turn",
        F.array_join(prose.parse_candidates(F.col("reply"), 2), "+").alias("candidates"),
    )


@query(
    "ben13_parse_search_args",
    "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE 'ss-win' END AS image, CASE turn % 3 WHEN 0 "
    "THEN 'count' WHEN 1 THEN 'list' END AS answer_type, CASE WHEN turn % 3 = 0 THEN role END AS pattern, "
    "CASE turn % 3 WHEN 0 THEN 'txt+gz' WHEN 1 THEN '' END AS extensions, CASE WHEN turn % 3 < 2 THEN turn % 3 "
    "= 1 END AS include_deleted FROM conversations",
)
def ben13(t: Tables):
    turn = F.col("turn")
    full = text(
        '{"image":"ss-win","answer_type":"COUNT","pattern":"', F.col("role"),
        '","extensions":[".TXT"," ","gz"],"include_deleted":false}',
    )
    tail = (
        F.when(turn % 3 == 0, text("\n```JSON\n{broken}\n```\n```\n", full, "\n```"))
        .when(turn % 3 == 1, ' {"image": "ss-win", "pattern": ""} ')
        .otherwise("nothing")
    )
    args = prose.parse_search_args(text(F.col("text"), tail))
    return t.conversations.select("conv_id", "turn", args.alias("a")).select(
        "conv_id", "turn", "a.image", "a.answer_type", "a.pattern",
        F.array_join("a.extensions", "+").alias("extensions"), "a.include_deleted",
    )


@query(
    "ben14_extract_pattern",
    "SELECT doc_id, CASE WHEN doc_id % 6 <> 0 AND email <> '' THEN email ELSE pattern END AS pattern FROM (SELECT doc_id, "
    "regexp_extract(text, '[\\pL\\pN_+-][\\pL\\pN_.+-]*@[\\pL\\pN_-]+[.][a-z]{2,}\\b') AS email, "
    "CASE doc_id % 6 WHEN 0 THEN 'user' || doc_id || '.x@example.com' WHEN 1 THEN '(901)555-' || "
    "lpad(CAST(doc_id AS VARCHAR), 4, '0') WHEN 2 THEN 'été' || doc_id WHEN 3 THEN coalesce(nullif("
    "regexp_extract(text, '\"([^\":]+)\"', 1), ''), 'needle' || doc_id) WHEN 4 THEN nullif(regexp_extract(text, "
    "'\"([^\":]+)\"', 1), '') ELSE 'hay' END AS pattern FROM documents)",
)
def ben14(t: Tables):
    return questions(t).select("doc_id", prose.extract_pattern(F.col("question_text")).alias("pattern"))


@query(
    "ben14_email_in_text",
    "SELECT doc_id, nullif(regexp_extract(text, '[\\pL\\pN_+-][\\pL\\pN_.+-]*@[\\pL\\pN_-]+[.][a-z]{2,}\\b'), '') AS email "
    "FROM documents",
)
def ben14_email(t: Tables):
    return t.documents.select("doc_id", prose.email_in(F.col("text")).alias("email"))


@query(
    "ben15_extract_extensions",
    "SELECT doc_id, CASE WHEN doc_id % 6 = 4 THEN 'html+txt' ELSE '' END AS extensions FROM documents",
)
def ben15(t: Tables):
    found = prose.extract_extensions(F.col("question_text"))
    return questions(t).select("doc_id", F.array_join(found, "+").alias("extensions"))


# Start sectors in two sample images, by phrase.
PARTITION_RULES = [
    ("ss-unix", "first windows data", 1, 2048),
    ("ss-unix", "second hfs", 2, 1955840),
    ("ss-unix", "2nd hfs", 3, 1955840),
    ("ss-unix", "hfs", 4, 2048),
    ("ss-unix", "linux", 5, 978944),
    ("ss-unix", "exfat", 6, None),
    ("ss-unix", "ntfs", 7, None),
    ("ss-unix", "", 8, 2048),
    ("ss-win", "first windows data", 1, 34),
    ("ss-win", "second windows data", 2, 1953124),
    ("ss-win", "hfs", 3, None),
    ("ss-win", "linux", 4, None),
    ("ss-win", "exfat", 5, 1953124),
    ("ss-win", "ntfs", 6, 2929686),
    ("ss-win", "", 7, 34),
]


@query(
    "ben16_resolve_partition",
    "SELECT doc_id, CAST(CASE doc_id % 6 WHEN 0 THEN 2048 WHEN 1 THEN NULL WHEN 2 THEN 1955840 WHEN 3 THEN NULL "
    "WHEN 4 THEN NULL ELSE 1953124 END AS BIGINT) AS sector FROM documents",
)
def ben16(t: Tables):
    rules = t.spark.createDataFrame(PARTITION_RULES, "image string, phrase string, rank int, sector bigint")
    return prose.resolve_partitions(questions(t), rules).select("doc_id", "sector")


@query(
    "ben17_usage_rollup",
    with_ctes(
        "scored",
        select="SELECT model_id, count(*) AS attempts, CAST(sum(tokens) AS BIGINT) AS sum_prompt_token_count, "
        "round(avg(tokens), 6) AS avg_prompt_token_count, sum(seconds) AS sum_seconds, round(avg(seconds), 6) "
        "AS avg_seconds FROM scored GROUP BY 1",
    ),
)
def ben17(t: Tables):
    rows = sco.usage_rollup(attempts(t))
    return rows.withColumn("avg_seconds", F.round("avg_seconds", 6)).withColumn(
        "avg_prompt_token_count", F.round("avg_prompt_token_count", 6)
    )


@query(
    "ben18_failure_sample",
    with_ctes(
        "scored",
        select="SELECT question_id, answer_type, expected_answer AS expected, top AS top_candidate FROM scored "
        "WHERE first_index IS NULL ORDER BY question_id LIMIT 6",
    ),
)
def ben18(t: Tables):
    return sco.failure_sample(sco.score_attempts(attempts(t)))


@query(
    "snk02_scorecard",
    with_ctes(
        "scored",
        select="SELECT answer_type, count(*) AS total_questions, count(first_index) AS matched_count, "
        "round(count(first_index) / count(*), 12) AS tus_at_k FROM scored GROUP BY 1",
    ),
)
def snk02(t: Tables):
    """A scorecard for each answer type, written and read back."""
    card = written(
        sco.tus_at_k(sco.score_attempts(attempts(t)), ["answer_type"]), scratch_table(t.spark, "card")
    )
    folder = scratch_table(t.spark, "scorecards")
    kinds = sorted(r["answer_type"] for r in card.select("answer_type").collect())  # a closed vocabulary
    paths = [
        write_scorecard(card.where(F.col("answer_type") == kind), folder, f"run-{kind}", "nss", 4)
        for kind in kinds
    ]
    back = t.spark.read.schema(card.schema).json(paths)
    return back.withColumn("tus_at_k", F.round("tus_at_k", 12))


cte(
    "prose_asked",
    "SELECT 'q' || doc_id AS question_id, doc_id, CASE WHEN lang = 'en' THEN 'ss-win' ELSE 'ss-unix' END AS image, "
    "regexp_extract(text, '[A-Za-z]{7,}') AS word, doc_id % 7 = 3 AS counts FROM documents",
)
cte(
    "prose_items",
    "SELECT DISTINCT question_id, doc_id, inode || ':' || replace(regexp_extract(filename, '([^/]*)$', 1), ' ($FILE_NAME)', '') "
    "AS item, deleted FROM prose_asked q JOIN files f ON q.image = f.image AND contains(translate(f.text, "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), lower(q.word)) WHERE NOT counts AND word <> ''",
    "prose_asked",
    "files",
)


@query(
    "ben05_question_to_score",
    with_ctes(
        "prose_items",
        select="SELECT question_id, 'list' AS kind, CAST(CASE WHEN count(*) = 1 THEN 0 WHEN count(*) FILTER (deleted) = 1 "
        "AND doc_id % 5 = 0 THEN 1 WHEN count(*) FILTER (NOT deleted) = 1 AND doc_id % 5 <> 0 THEN 2 END AS INTEGER) AS "
        "matched_candidate_index FROM prose_items GROUP BY question_id, doc_id UNION ALL "
        "SELECT question_id, 'unclear', NULL FROM prose_asked WHERE NOT counts AND word = '' UNION ALL "
        "SELECT question_id, 'count', CAST(CASE WHEN n = d THEN 0 ELSE 1 END AS INTEGER) FROM prose_asked JOIN (SELECT image, "
        "count(*) AS n, count(*) FILTER (deleted) AS d FROM files WHERE inode < 1000000 GROUP BY image) USING (image) WHERE counts",
    ),
)
def question_to_score(t: Tables):
    """A question for each document: in which files one of its words stands, or how many files have a suffix.

    Expected is the document's own file, or the number of deleted files.
    """
    from ..operators import answering

    word = F.regexp_extract("text", "[A-Za-z]{7,}", 0)
    image = F.when(F.col("lang") == "en", "ss-win").otherwise("ss-unix")
    counts = F.col("doc_id") % 7 == 3
    ask = F.when(counts, "How many files have the extension(s) .TXT or .htm").when(
        word != "", text("Which files hold the word ", word)
    ).otherwise("Which files are these")
    docs = t.documents.select(
        text("q", F.col("doc_id").cast("string")).alias("question_id"),
        text(ask, " in the partition of ", image, ". The mmls output is ntfs.").alias("question_text"),
        counts.alias("counts"),
        image.alias("image"),
        text(F.col("doc_id").cast("string"), ":", F.col("lang"), "-", F.col("doc_id").cast("string"), ".txt").alias("own"),
        (F.col("doc_id") % 5 == 0).alias("deleted"),
    )
    deleted = docs.groupBy("image").agg(F.count_if("deleted").cast("string").alias("n_deleted"))
    expected = docs.where("not counts").select("question_id", F.col("own").alias("item")).unionByName(
        docs.where("counts").join(deleted, "image").select("question_id", F.col("n_deleted").alias("item"))
    )
    return answering.score_questions(docs.select("question_id", "question_text"), expected, ad.files(t))
