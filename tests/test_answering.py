"""From question prose to scored answers, on a few files."""

from attestlake.operators import answering

FILES = "image string, inode bigint, filename string, deleted boolean, file_size_bytes bigint, content binary"


def tables(spark):
    rows = [
        ("ss-win", 1, "a/one.txt", False, b"apple and pear"),
        ("ss-win", 2, "two.txt", True, b"PEAR"),
        ("ss-win", 3, "three.doc", True, b"plum"),
        ("ss-unix", 4, "four.txt", False, b"pear"),
    ]
    files = spark.createDataFrame([(*r[:4], len(r[4]), bytearray(r[4])) for r in rows], FILES)
    asked = [
        ("all", "Which files hold the word pear in ss-win?"),
        ("deleted", "Which files hold the word pear in ss-win?"),
        ("live", "Which files hold the word pear in ss-win?"),
        ("none", "Which files hold the word pear in ss-win?"),
        ("wrong", "Which files hold the word pear in ss-win?"),
        ("nothing", "Which files hold the word cherry in ss-win?"),
        ("missed", "Which files hold the word cherry in ss-win?"),
        ("unix", "Which files hold the word pear in ss-unix?"),
        ("count", "How many with extension .txt or .doc in ss-win?"),
        ("count-deleted", "How many with extension .txt or .doc in ss-win?"),
        ("count-wrong", "How many with extension .txt or .doc in ss-win?"),
        ("count-unknown", "How many with extension .txt or .doc in ss-win?"),
        ("unclear", "Why?"),
        (None, None),
    ]
    expected = [
        ("all", "1:one.txt"), ("all", "2:two.txt"), ("all", "2:two.txt"), ("deleted", "2:two.txt"), ("live", "1:one.txt"),
        ("wrong", "3:three.doc"), ("missed", "9:x"), ("unix", "4:four.txt"), ("count", "3"), ("count-deleted", "2"),
        ("count-wrong", "7"), ("unclear", "1"), ("other", "1"),
    ]
    return (
        spark.createDataFrame(asked, "question_id string, question_text string"),
        spark.createDataFrame(expected, "question_id string, item string"),
        files,
    )


def test_scores(spark):
    found = {r.question_id: (r.kind, r.matched_candidate_index) for r in answering.score_questions(*tables(spark)).collect()}
    assert found == {
        "all": ("list", 0), "deleted": ("list", 1), "live": ("list", 2), "none": ("list", 3), "wrong": ("list", None),
        "nothing": ("list", 0), "missed": ("list", None), "unix": ("list", 0), "count": ("count", 0),
        "count-deleted": ("count", 1), "count-wrong": ("count", None), "count-unknown": ("count", None),
        "unclear": ("unclear", None), None: ("unclear", None),
    }


def test_ranked_answers(spark):
    questions, _, files = tables(spark)
    rows = answering.ranked_answers(questions.where("question_id in ('all', 'count')"), files).collect()
    assert sorted((r.question_id, r.candidate_index, r.item) for r in rows) == [
        ("all", 0, "1:one.txt"), ("all", 0, "2:two.txt"), ("all", 1, "2:two.txt"), ("all", 2, "1:one.txt"),
        ("count", 0, "3"), ("count", 1, "2"), ("count", 2, "1"),
    ]


def test_questions_that_search_for_the_same_share_its_items(spark):
    _, _, files = tables(spark)
    asked = answering.asked_for(
        spark.range(500).selectExpr("cast(id as string) AS question_id", "'Which files hold the word pear in ss-win?' AS question_text")
    )
    assert sorted(r.item for r in answering.shared_items(asked, files).collect()) == ["1:one.txt", "2:two.txt"]
    assert answering.found_items(asked, files).count() == 1000


def test_hits_are_numbers_in_their_files_rows_however_many_patterns(spark, monkeypatch):
    """Neither contents nor hits are shuffled to meet patterns: those that are too many to travel with the tasks go in parts."""
    import random

    from attestlake.operators import routing, search

    rng = random.Random(4)
    words = ["".join(rng.choice("abAB") for _ in range(rng.choice((1, 2, 3, 5, 8, 9, 17, 30)))) for _ in range(60)] + ["a" * 40, "été"]
    rows = []
    for i in range(40):
        content = "".join(rng.choice([*words, "\n", "\0"]) for _ in range(rng.choice((0, 1, 3, 400)))).encode(rng.choice(("utf-8", "utf-16-le")))
        rows.append((rng.choice(("ss-win", "ss-unix", None)), i, f"f{i}", False, len(content), bytearray(content)))
    files = spark.createDataFrame(rows, FILES)
    asked = sorted({(w, image) for w in words for image in ("ss-win", None)}, key=repr)
    patterns = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "number bigint, text string, image string")
    known = search.search(files, patterns.selectExpr("cast(number as string) AS pattern_id", "text", "image"))
    known = sorted((r.inode, int(r.pattern_id)) for r in known.select("inode", "pattern_id").collect())
    assert len(known) > 500
    monkeypatch.setattr(search, "index_of", None)
    for local, batch in ((routing.LOCAL_BYTES, 200), (routing.LOCAL_BYTES, search.HITS_PER_BATCH), (4000, 7)):
        monkeypatch.setattr(routing, "LOCAL_BYTES", local)
        monkeypatch.setattr(search, "HITS_PER_BATCH", batch)
        held = search.held_patterns(files.select("image", "inode", "content"), patterns).collect()
        assert sorted((r.inode, n) for r in held for n in r.numbers) == known
        assert (len(held) == len({r.inode for r in held})) == (batch > len(asked))
    questions, expected, files = tables(spark)
    monkeypatch.setattr(routing, "LOCAL_BYTES", 150)
    found = {r.question_id: r.matched_candidate_index for r in answering.score_questions(questions, expected, files).collect()}
    assert (found["all"], found["deleted"], found["live"], found["none"], found["wrong"], found["unix"]) == (0, 1, 2, 3, None, 0)
    words = [(i, w, "ss-win") for i, w in enumerate(("pear", "apple", "plum", "and", "nothing"))]
    single, several = answering.held_items(spark.createDataFrame(words, "number bigint, text string, image string"), files)
    assert sorted((r.item, n) for r in single.collect() for n in r.numbers) == [("1:one.txt", 0), ("1:one.txt", 1), ("1:one.txt", 3), ("2:two.txt", 0), ("3:three.doc", 2)]
    assert single.select("part").distinct().count() > 1 and several.count() == 0


def test_items_of_several_files_count_once(spark):
    rows = [
        ("ss-win", 1, "a/one.txt", False, b"pear"), ("ss-win", 1, "b/one.txt", True, b"PEAR plum"), ("ss-win", 1, "c/one.txt", True, b"plum"),
        ("ss-win", 2, "two.txt", True, b"pear"), ("ss-unix", 2, "two.txt", False, b"pear"), ("ss-win", None, None, False, b"cherry"),
    ]
    files = spark.createDataFrame([(*r[:4], len(r[4]), bytearray(r[4])) for r in rows], FILES)
    ask = "Which files hold the word {} in ss-win?"
    asked = [("both", "pear"), ("live", "pear"), ("plum", "plum"), ("no name", "cherry")]
    questions = spark.createDataFrame([(q, ask.format(w)) for q, w in asked], "question_id string, question_text string")
    expected = [("both", "1:one.txt"), ("both", "2:two.txt"), ("live", "1:one.txt"), ("plum", "1:one.txt"), ("no name", "1:one.txt")]
    expected = spark.createDataFrame(expected, "question_id string, item string")
    found = {r.question_id: r.matched_candidate_index for r in answering.score_questions(questions, expected, files).collect()}
    assert found == {"both": 0, "live": 2, "plum": 0, "no name": None}
