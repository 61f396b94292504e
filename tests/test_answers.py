"""Answer matching, list statistics, prose."""

import json
import time

import pytest
from pyspark.sql import functions as F

from attestlake.functions import answers as ans, prose
from attestlake.operators import scoring as sco
from attestlake.plans.scoring_queries import PARTITION_RULES
from attestlake.sources import sinks, stores

CASES = [
    ("exact_string", "abc", " abc ", True),
    ("exact_string", "abc", "ABC", False),
    ("string_ci", "Straße", "straße ", True),
    ("hex_hash", "AB" * 16, "ab" * 16, True),
    ("hex_hash", "zz", "ZZ", False),
    ("numeric", "5", "5.0", True),
    ("numeric", "1e3", "1000", True),
    ("numeric", "0", "-0.0", True),
    ("numeric", "1", "1d", False),
    ("numeric", "nan", "nan", False),
    ("numeric", "five", "five", False),
    ("timestamp", "2026-04-12T14:32:01Z", "2026-04-12 14:32:03", True),
    ("timestamp", "2026-04-12T14:32:01Z", "2026-04-12T14:32:03.000001Z", False),
    ("timestamp", "2026-04-12T14:32:01Z", "2026-04-12T16:32:01+02:00", True),
    ("timestamp", "soon", "soon", False),
    ("path", "C:\\Windows\\\\System32\\", "c:/windows/system32", True),
    ("path", "C:\\a", "C:\\b", False),
    ("sid", "s-1-5-21", "S-1-5-21", True),
    ("list_of_strings", '["a","b"]', '[" b","a","a"]', True),
    ("nss_inode_filename_list", "[]", "[]", True),
    ("nss_inode_filename_list", '["1:a"]', '["1:A"]', False),
    ("list_of_strings", '["1"]', "[1]", False),
    ("list_of_strings", '["a"]', '["a", null]', False),
    ("list_of_strings", "a", "a", False),
    ("essay", "a", "a", False),
    ("string_ci", "a", None, False),
]


def test_match_table(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, k string, e string, g string, want boolean")
    hit = ans.match_answer(F.col("k"), F.col("e"), F.col("g"))
    first = ans.first_match(F.col("k"), F.col("e"), F.array(F.lit("?"), F.col("g")), 2)
    for r in df.select("*", hit.alias("hit"), first.alias("first")).collect():
        assert (r.hit, r.first) == (r.want, 1 if r.want else None), CASES[r.i]


def test_only_the_first_k_are_scored(spark):
    df = spark.createDataFrame([("q", "numeric", "5", ["1", "2", "5", "5.0"])], "question_id string, answer_type string, expected_answer string, candidates array<string>")
    get = lambda k: sco.score_attempts(df, k).first()
    assert get(4).matched_candidate_index == 2 and get(2).matched is False and len(get(2).candidates) == 4
    with pytest.raises(ValueError):
        sco.score_attempts(df, 0)


@pytest.mark.parametrize(
    "expected, given, want",
    [
        ('["a","b"]', '["b","c"]', (0.5, 0.5, 0.5, 0.0)),
        ("[]", "[]", (1.0, 1.0, 1.0, 1.0)),
        ('["a"]', "[]", (0.0, 0.0, 0.0, 0.0)),
        ('["a","b"]', '["a"]', (1.0, 0.5, 2 / 3, 0.0)),
        ('["a"]', "junk", None),
    ],
)
def test_list_stats(spark, expected, given, want):
    df = spark.createDataFrame([(expected, given)], "e string, g string")
    got = df.select(ans.list_stats(F.col("e"), F.col("g")).alias("s")).first().s
    assert (tuple(got) if got else None) == (pytest.approx(want) if want else None)


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ('```json\n{"candidates":["a"]}\n``` then ```\n{"candidates":["b","c","d"]}\n```', ["b", "c"]),
        ('```json\n{"candidates":["a"]}\n``` then ```json\n{oops}\n```', ["a"]),
        ('final {"candidates": ["x", 5]} .', ["x", "5"]),
        ('{"answer": 1}', []),
        ("", []),
    ],
)
def test_parse_candidates(spark, text, want):
    assert one(spark, text, lambda c: prose.parse_candidates(c, 2)) == want


def test_parse_search_args(spark):
    got = one(spark, '```json\n{"image":"i","pattern":"p","extensions":[".TXT",""],"include_live":false}\n```', prose.parse_search_args)
    assert (got.image, got.answer_type, got.pattern, got.extensions) == ("i", "list", "p", ["txt"])
    assert got.include_deleted is True and got.include_live is False and got.partition is None
    assert one(spark, 'so {"extensions": ["doc"], "answer_type": "Count"} ok', prose.parse_search_args).answer_type == "count"
    assert one(spark, "no json", prose.parse_search_args) is None


@pytest.mark.parametrize(
    "text, want",
    [
        ('email iron.man@marvel.com and "other"', "iron.man@marvel.com"),
        ("the phone number \\(901\\)555-1111. in", "(901)555-1111"),
        ("the word/words 'été' in the files", "été"),
        ("the word café in the files", "café"),
        ('like "inode:filename" or "DELETED-x" the text "needle here"', "needle here"),
        ("only 'count' and 'single'", "single"),
        ("nothing", None),
    ],
)
def test_extract_pattern(spark, text, want):
    assert one(spark, text, prose.extract_pattern) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("with the extension(s) .TXT and .html in the partition", ["html", "txt"]),
        ("extensions .doc and .docx on it", ["doc", "docx"]),
        ("no ext", []),
    ],
)
def test_extract_extensions(spark, text, want):
    assert one(spark, text, prose.extract_extensions) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("extensions .jpg, .gif, and .png in the", ["gif", "jpg", "png"]),
        (".a extension .doc,.docx on it", ["doc", "docx"]),
        ("extensions .jpg/.png, or .gif,and/or .BMP .zip and the .exe", ["bmp", "gif", "jpg", "png", "zip"]),
        ("extension .doc , , and or\n.odt and order .x", ["doc", "odt"]),
    ],
)
def test_extension_lists_with_any_separators(spark, text, want):
    assert one(spark, text, prose.extract_extensions) == want


def test_long_extension_list_is_whole(spark):
    listed = ", and/or ".join(f".x{i}" for i in range(20_000))
    assert len(one(spark, f"extensions {listed} in", prose.extract_extensions)) == 20_000
    assert one(spark, "extension " + ", and " * 20_000, prose.extract_extensions) == []


@pytest.mark.parametrize(
    "text, want",
    [
        ("the Second Windows data partition. The mmls exFAT", 1953124),
        ("exFAT volume", 1953124),
        ("hfs volume", None),
        ("anything", 34),
        ("ss-unix second HFS+", 1955840),
        ("ss-unix HFS+ linux", 2048),
        ("ss-unix Linux. the MMLS hfs", 978944),
        ("ss-unix ntfs", None),
    ],
)
def test_resolve_partition(spark, text, want):
    rules = spark.createDataFrame(PARTITION_RULES, "image string, phrase string, rank int, sector bigint")
    asked = spark.createDataFrame([(text,)], "question_text string")
    assert prose.resolve_partitions(asked, rules).first().sector == want


def test_hostile_extension_list_is_fast(spark):
    start = time.time()
    assert one(spark, "extension " + ".abcdefgh" * 20_000 + "…)", prose.extract_extensions) in ([], ["abcdefgh"])
    assert time.time() - start < 20


def test_corpus_hash_ignores_order(spark):
    rows = [(f"q{i}", str(i)) for i in range(50)]
    make = lambda rs: spark.createDataFrame(rs, "question_id string, a string")
    get = lambda df: sco.corpus_hash(df, ["question_id", "a"]).first()
    assert get(make(rows)) == get(make(rows[::-1]).repartition(7))
    assert get(make(rows)).corpus_digest != get(make(rows[:-1] + [("q49", "x")])).corpus_digest


def test_resume_and_scorecard(spark, folder):
    attempts = spark.createDataFrame(
        [(0, "q1", "numeric", "1", ["2"], False), (1, "q1", "numeric", "1", ["1"], True), (2, "q2", "sid", "a", [], False)],
        "seq bigint, question_id string, answer_type string, expected_answer string, candidates array<string>, matched boolean",
    )
    path = str(folder / "attempts")
    sinks.append_attempts(attempts, path)
    (folder / "attempts" / "junk.txt").write_text("{half\n\n")
    back = stores.read_attempts(spark, path)
    assert {r.question_id: r.matched for r in back.collect()} == {"q1": True, "q2": False}
    asked = spark.createDataFrame([("q1",), ("q3",)], "question_id string")
    assert [r.question_id for r in sco.pending(asked, back).collect()] == ["q3"]
    card = sco.tus_at_k(back)
    assert card.first().tus_at_k == 0.5 and sco.tus_at_k(back.where("false")).first().tus_at_k == 0.0
    target = sinks.write_scorecard(card, str(folder), "run1", "III", 4)
    assert target.endswith("run1_III_tus4.json")
    text = spark.read.text(target).first().value
    assert list(json.loads(text)) == sorted(json.loads(text)) and json.loads(text)["matched_count"] == 1


@pytest.mark.parametrize(
    "text, phone, word",
    [
        ("phone number 301.555-9009 and", "301.555-9009", None),
        ("the Phone  number 1", None, None),
        ("the phone numbers\t800-555-1122, or", "800-555-1122", None),
        ("phone number (901)555-1111; the word x in y", "(901)555-1111", "x"),
        ("phone number +1 800 555", None, None),
        ("phone number 12345", None, None),
        ("THE WORDS \"a'b\", in it", None, "a'b"),
        ("the word/words سلام \n in the", None, "سلام"),
        ("the word in in the", None, "in"),
        ("the word '' in the", None, None),
        ("the word two terms in the", None, None),
        ("the words first of all, the word second in the", None, "second"),
        ("bathe word x in the", None, None),
        ("the", None, None),
        ("", None, None),
        (None, None, None),
        ("the word ' in the", None, "'"),
        ("the word " * 20_000 + "end in", None, "end"),
    ],
)
def test_telephones_and_announced_words(spark, text, phone, word):
    assert (one(spark, text, prose.phone_in), one(spark, text, prose.word_in)) == (phone, word)
