import numpy as np
from llm_fixtures import SF, make_docs, ready, real_docs  # noqa: F401

from attestlake.llm.language_id import SCRIPTS, identify, letter_scripts, train, viterbi
from attestlake.llm.queries import QUERIES


def brute_viterbi(scores, penalty):
    best, paths = list(scores[0]), [[s] for s in range(scores.shape[1])]
    for row in scores[1:]:
        options = [
            max(range(len(best)), key=lambda p: best[p] - penalty * (p != s)) for s in range(len(best))
        ]
        paths = [paths[p] + [s] for s, p in enumerate(options)]
        best = [best[p] - penalty * (p != s) + row[s] for s, p in enumerate(options)]
    return max(best), paths[int(np.argmax(best))]


def path_score(scores, path, penalty):
    changes = sum(a != b for a, b in zip(path, path[1:], strict=False))
    return sum(scores[i][s] for i, s in enumerate(path)) - penalty * changes


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 7, 30, 0, 12]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(offsets[-1], 3)) * 2
    labels = viterbi(scores, offsets, 1.5)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b > a:
            want, _ = brute_viterbi(scores[a:b], 1.5)
            assert abs(path_score(scores[a:b], list(labels[a:b]), 1.5) - want) < 1e-9


def test_scripts_of_letters():
    text = "aé×Ж東1あ"
    bits = letter_scripts(np.frombuffer(text.encode(), np.uint8))
    names = [list(SCRIPTS)[int(b).bit_length() - 1] for b in bits if b]
    assert names == ["Latin", "Latin", "Cyrillic", "Han", "Hiragana"]


TRAINING = [
    (i, text, lang)
    for i, (text, lang) in enumerate(
        [
            ("the quick brown fox jumps over the lazy dog while the children watch with wonder", "en"),
            ("there is nothing that they would rather have than the other thing over there", "en"),
            ("der schnelle braune fuchs springt über den faulen hund und die kinder schauen zu", "de"),
            ("es gibt nichts was sie lieber hätten als das andere ding dort drüben auf der straße", "de"),
            ("быстрая коричневая лиса прыгает через ленивую собаку пока дети смотрят", "ru"),
            (None, "en"),
            ("text without a language", None),
        ]
    )
]


def test_mixed_text_spans(ready, make_docs):
    model = train(make_docs(TRAINING))
    assert model.languages == ["de", "en", "ru"]
    mixed = "the children watch the lazy dog there. und die kinder schauen über den faulen hund. собаку пока дети смотрят"
    rows = [(1, mixed), (2, None), (3, ""), (4, "123 --- !"), (5, "東京 東京"), (6, "дети смотрят"), (6, "дети смотрят")]
    found = identify(make_docs(rows), model, ["doc_id", "text", "kept"]).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 7 and by_id[1].kept == "k"
    spans = [(mixed[s.start : s.end], s.lang) for s in by_id[1].lang_spans]
    assert [lang for _, lang in spans] == ["en", "de", "ru"]
    assert spans[2][0].startswith("собаку")
    assert [by_id[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3
    assert by_id[5].lang_pred in model.languages and by_id[5].lang_score == 0.0
    assert by_id[6].lang_pred == "ru" and by_id[6].lang_score == 1.0


def test_nothing_to_learn_from(ready, make_docs):
    model = train(make_docs([]))
    rows = identify(make_docs([(1, "some text")]), model, ["doc_id"]).collect()
    assert [(r.lang_pred, r.lang_score) for r in rows] == [("und", 0.0)]
    assert identify(make_docs([]), model, ["doc_id"]).count() == 0


def test_held_out_accuracy(spark, real_docs):
    found = QUERIES["op3_language_id"](spark, SF).join(real_docs.select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out").collect()
    assert len(rows) > 30
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
