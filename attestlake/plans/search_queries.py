"""Content search over documents and pages as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as sch
from ..session import scratch_table, written
from . import adapters as ad
from .adapters import cte, with_ctes
from .registry import Tables, query

# pattern id, text, image
PATTERNS = (
    ("p1", "example.COM", None),
    ("p2", "The", "ss-win"),
    ("p3", "eaux", "ss-unix"),
    ("p4", "token = ", None),
    ("p5", "<script>", "ss-win"),
    ("p6", "aa", None),
    ("p7", "über", "ss-unix"),
    ("p8", "no such text anywhere", None),
)


def patterns(t: Tables, *ids: str):
    """The patterns as a table; with `ids` only those."""
    chosen = [p for p in PATTERNS if not ids or p[0] in ids]
    return t.spark.createDataFrame(chosen, "pattern_id string, text string, image string")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Byte offsets and A-Z folding, on the hex form of the UTF-8 bytes.
cte(
    "patterns",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({_literal(i)}, {_literal(x)}, {'NULL' if im is None else _literal(im)})"
        for i, x, im in PATTERNS
    )
    + ") AS v(pattern_id, pattern, p_image)",
)
cte(
    "hits",
    "SELECT pattern_id, f.image, inode, filename, deleted, file_size_bytes, "
    "CAST(strlen(split_part(folded, p, 1)) AS INTEGER) AS first_match_offset, "
    "CAST((strlen(folded) - strlen(replace(folded, p, ''))) // strlen(p) AS INTEGER) "
    "AS total_match_count FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz') AS folded FROM files) f JOIN (SELECT *, translate(pattern, "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS p FROM patterns) ON "
    "(p_image IS NULL OR p_image = f.image) AND contains(folded, p)",
    "files",
    "patterns",
)
HITS = (
    "SELECT pattern_id, image, inode, filename, deleted, file_size_bytes, first_match_offset, "
    "total_match_count FROM hits"
)


@query("sch01_literal_search", with_ctes("hits", select=HITS + " WHERE pattern_id = 'p1'"))
def sch01(t: Tables):
    return sch.search(ad.files(t), patterns(t, "p1"))


@query(
    "sch02_regex_search",
    with_ctes(
        "files",
        select="SELECT image, inode, filename, deleted, file_size_bytes, CAST(length(split_part(text, "
        "regexp_extract(text, '[a-z0-9.]+@mail[0-9]+[.]example[.]com', 0, 'i'), 1)) AS INTEGER) AS "
        "first_match_offset, CAST(len(regexp_extract_all(text, "
        "'[a-z0-9.]+@mail[0-9]+[.]example[.]com', 0, 'i')) AS INTEGER) AS total_match_count FROM files "
        "WHERE regexp_matches(text, '[a-z0-9.]+@mail[0-9]+[.]example[.]com', 'i')",
    ),
)
def sch02(t: Tables):
    return sch.regex_search(ad.files(t), "[a-z0-9.]+@mail[0-9]+[.]example[.]com")


@query("sch03_multi_pattern", with_ctes("hits", select=HITS))
def sch03(t: Tables):
    return sch.search(ad.files(t), patterns(t))


cte(
    "asked_words",
    "SELECT DISTINCT 'w-' || lang || '-' || n_chars AS pattern_id, substr(text, 1, 24) AS pattern, CASE WHEN "
    "n_chars % 2 = 0 THEN 'ss-win' END AS p_image FROM documents WHERE doc_id % 20 = 0",
)


@query(
    "sch03_pattern_table",
    with_ctes(
        "files",
        "asked_words",
        select="SELECT pattern_id, f.image, inode, filename, deleted, file_size_bytes, "
        "CAST(strlen(split_part(folded, p, 1)) AS INTEGER) AS first_match_offset, "
        "CAST((strlen(folded) - strlen(replace(folded, p, ''))) // strlen(p) AS INTEGER) AS total_match_count "
        "FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded "
        "FROM files) f JOIN (SELECT *, translate(pattern, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz') AS p FROM asked_words) ON (p_image IS NULL OR p_image = f.image) AND "
        "contains(folded, p)",
    ),
)
def sch03_table(t: Tables):
    """Patterns taken from documents whose id is divisible by 20, against all files."""
    asked = t.documents.where("doc_id % 20 = 0").select(
        F.concat_ws("-", F.lit("w"), "lang", F.col("n_chars").cast("string")).alias("pattern_id"),
        F.substring("text", 1, 24).alias("text"),
        F.when(F.col("n_chars") % 2 == 0, F.lit("ss-win")).alias("image"),
    )
    return sch.search(ad.files(t), asked.distinct())


ITEM = "inode || ':' || replace(regexp_extract(filename, '([^/]*)$', 1), ' ($FILE_NAME)', '')"
cte("items", f"SELECT DISTINCT pattern_id, {ITEM} AS item, deleted FROM hits", "hits")


STATES = "SELECT pattern_id, item, bool_or(deleted) AS in_deleted, bool_or(NOT deleted) AS in_live FROM items GROUP BY 1, 2"


cte("states", STATES, "items")


@query("sch04_answer_set", with_ctes("states", select="SELECT * FROM states"))
def sch04(t: Tables):
    return sch.answer_items(sch.search(ad.files(t), patterns(t)), ["pattern_id"])


@query(
    "sch05_answer_variants",
    with_ctes(
        "states",
        select="SELECT pattern_id, CAST(0 AS INTEGER) AS candidate_index, item FROM states "
        "UNION ALL SELECT pattern_id, 1, item FROM states WHERE in_deleted "
        "UNION ALL SELECT pattern_id, 2, item FROM states WHERE in_live",
    ),
)
def sch05(t: Tables):
    items = sch.answer_items(sch.search(ad.files(t), patterns(t)), ["pattern_id"])
    return sch.answer_variants(items, ["pattern_id"])


@query(
    "sch05_variant_scores",
    with_ctes(
        "items",
        select="SELECT pattern_id, CAST(CASE WHEN bool_and(deleted) THEN 0 WHEN bool_or(deleted) THEN 1 ELSE 3 END "
        "AS INTEGER) AS matched_candidate_index FROM items GROUP BY pattern_id",
    ),
)
def sch05_scores(t: Tables):
    """Expected: the deleted hits. So the second candidate fits, or the first when all are deleted."""
    found = sch.answer_items(sch.search(ad.files(t), patterns(t)), ["pattern_id"])
    items = written(found, scratch_table(t.spark, "answers"))
    return sch.variant_scores(items.where("in_deleted"), items, ["pattern_id"])


@query(
    "sch06_extension_counts",
    with_ctes(
        "files",
        select="SELECT 'q-' || image AS question_id, image, count(*) FILTER (x) AS total, count(*) FILTER "
        "(x AND deleted) AS deleted, count(*) FILTER (x AND NOT deleted) AS live FROM (SELECT image, "
        "deleted, NOT contains(filename, '($FILE_NAME)') AND (lower(filename) LIKE '%.txt' OR "
        "lower(filename) LIKE '%.html') AS x FROM files) GROUP BY image",
    ),
)
def sch06(t: Tables):
    listing = ad.file_listing(t)
    asked = listing.select("image").distinct().select(
        F.concat(F.lit("q-"), "image").alias("question_id"),
        "image",
        F.explode(F.array(F.lit(".TXT"), F.lit("html"))).alias("extension"),
    )
    return sch.extension_counts(listing, asked, ["image"])


@query("sch07_hit_order", with_ctes("hits", select=HITS + " WHERE pattern_id = 'p4'"))
def sch07(t: Tables):
    return sch.hit_order(sch.search(ad.files(t), patterns(t, "p4")))


@query(
    "sch01_chunked_search",
    with_ctes(
        "hits",
        select="SELECT pattern_id, image, inode, filename, deleted, file_size_bytes, CAST(first_match_offset AS "
        "BIGINT) AS first_match_offset, CAST(total_match_count AS BIGINT) AS total_match_count FROM hits",
    ),
)
def sch01_chunked(t: Tables):
    """All files in chunks of 1 KB give the rows of the uncut ones, also for patterns that overlap themselves."""
    return sch.search_chunks(sch.cut(ad.files(t), 1024), patterns(t))
