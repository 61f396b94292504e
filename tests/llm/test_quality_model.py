import math
import random

import numpy as np
import pyarrow as pa
from llm_fixtures import SF, make_docs, ready, real_docs  # noqa: F401
from pyspark.sql import functions as F

from attestlake.llm import quality_model as qm
from attestlake.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


def plain_signals(text):
    """The signals of one text, character by character."""
    words, word = [], ""
    for c in text + " ":
        if c in WHITE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    letters = [c for c in text if c.isascii() and c.isalpha() or ord(c) >= 0xC0]
    upper = [c for c in letters if "A" <= c <= "Z" or "\xc0" <= c <= "\xde" and c != "\xd7"]
    mark = lambda c: "\x20" < c < "\x7f" and not c.isalnum()
    symbol = lambda c: mark(c) and c not in ".,;:'\"-()?"
    solid = [c for c in text if c not in WHITE]
    runs, best = 0, 0
    for i, w in enumerate(words):
        runs = runs + 1 if i and w == words[i - 1] else 1
        best = max(best, runs)
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    whole = [x + "\n" for x in lines]
    if lines and not text.endswith("\n"):
        whole[-1] = lines[-1]
    long = [x for x in whole if len(x.encode()) >= qm.LEAST_LINE]

    def ratio(a, b):
        return a / max(b, 1)

    def of_line(line):
        own = [c for c in line if c not in WHITE]
        let = [c for c in line if c.isascii() and c.isalpha() or ord(c) >= 0xC0]
        up = [c for c in let if "A" <= c <= "Z" or "\xc0" <= c <= "\xde" and c != "\xd7"]
        return ratio(sum(map(symbol, own)), len(own)), ratio(len(up), len(let))

    data = text.encode()
    p = [data.count(b) / len(data) for b in set(data)] if data else []
    return [
        math.log1p(len(words)),
        ratio(len(solid), len(words)),
        ratio(len(upper), len(letters)),
        ratio(sum("0" <= c <= "9" for c in text), len(solid)),
        ratio(sum(map(symbol, text)), len(solid)),
        ratio(sum(mark(b) and a == b for a, b in zip(text, text[1:], strict=False)), len(solid)),
        ratio(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)),
        ratio(best, len(words)),
        math.log1p(len(set(words))) / max(math.log1p(len(words)), 1e-9),
        ratio(len(lines) - len(set(lines)), len(lines)),
        ratio(sum(w[-1] in "!.?" for w in words), len(words)),
        max([of_line(x)[0] for x in long], default=0),
        max([of_line(x)[1] for x in long], default=0),
        ratio(sum(not any(c.isascii() and c.isalpha() or ord(c) >= 0xC0 for c in w) for w in words), len(words)),
        math.log1p(ratio(len(words), len(lines))),
        -sum(x * math.log2(x) for x in p),
    ]


def test_signals():
    rng = random.Random(6)
    parts = ["the", "The", "ÉTÉ", "ça", " ", " ", "\n", "!!", "*", "12", ".", "A", "\t", "word", "|", "😀", "--"]
    texts = ["", " \n", "a", "x\n" * 40, "THE END. " * 30, None, "no newline at the end of this", "é"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    found = qm.signals_of(pa.array(texts))
    want = np.array([plain_signals(t or "") for t in texts])
    assert np.isfinite(found).all()
    assert np.abs(found - want).max() < 1e-9, np.argwhere(np.abs(found - want) > 1e-9)[:5]
    assert not found[0].any() and qm.signals_of(pa.array([], pa.string())).shape == (0, 16)


def gain(groups, b):
    return sum(g * g / (h + b.ridge) for g, h in groups)


def test_trees_against_all_cuts():
    rng = np.random.default_rng(3)
    b = qm.Boosting(least=0.0, rate=1.0)
    for size in (2, 3, 7, 12):
        g, h = rng.standard_normal(size), rng.random(size) + 0.1
        best = max(range(1, size), key=lambda at: gain([(g[:at].sum(), h[:at].sum()), (g[at:].sum(), h[at:].sum())], b))
        value, at = qm._best_cut(g, h, b)
        assert at == best and value >= -1e-12
        step = qm.one_way_tree(g, h, b)
        if step is not None:
            leaves = np.split(np.arange(size), np.flatnonzero(np.diff(step)) + 1)
            assert len(leaves) <= 3
            assert np.allclose(step, np.concatenate([[g[x].sum() / (h[x].sum() + b.ridge)] * len(x) for x in leaves]))
        g2, h2 = rng.standard_normal((size, 4)), rng.random((size, 4)) + 0.1
        found, step = qm.two_way_tree(g2, h2, b)
        cuts = [(i, j) for i in range(1, size) for j in range(1, 4)]
        quarters = lambda m, i, j: (m[:i, :j].sum(), m[:i, j:].sum(), m[i:, :j].sum(), m[i:, j:].sum())
        values = [gain(zip(quarters(g2, *c), quarters(h2, *c), strict=True), b) for c in cuts]
        assert abs(found - (max(values) - gain([(g2.sum(), h2.sum())], b))) < 1e-9
        assert len(np.unique(step)) <= 4


def test_pairs_learn_what_single_signals_cannot():
    rng = np.random.default_rng(8)
    values = rng.random((4000, 4))
    labels = ((values[:, 0] > 0.5) ^ (values[:, 2] > 0.5)).astype(float)
    with_pairs = qm.fit_tables(values, labels, qm.Boosting(pairs=1))
    without = qm.fit_tables(values, labels, qm.Boosting(pairs=0))
    assert list(with_pairs.pair_tables) == [(0, 2)]
    right = lambda m: ((m.score(values) >= 0.5) == labels).mean()
    assert right(with_pairs) > 0.95 > 0.7 > right(without)
    bins = with_pairs.bins(values[:20])
    for row, logit in zip(bins, with_pairs.logit(bins), strict=True):
        want = with_pairs.intercept + sum(t[x] for t, x in zip(with_pairs.tables, row, strict=True)) + with_pairs.pair_tables[0, 2][row[0], row[2]]
        assert abs(logit - want) < 1e-12


def test_few_labels(ready, make_docs):
    docs = make_docs([(1, "one"), (1, "one"), (2, None), (None, "x"), (3, "")])
    labels = ready.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (9, 0), (3, 5)], "doc_id bigint, quality int")
    for model in (qm.train(docs, labels), qm.train(docs, labels.limit(0)), qm.train(make_docs([]), labels)):
        rows = docs.select("doc_id", "kept", qm.quality_score(docs["text"], model).alias("score")).collect()
        assert len(rows) == 5 and all(0 < r.score < 1 for r in rows)
        assert all(not t.any() for t in model.tables)
    assert make_docs([]).select(qm.quality_score(F.col("text"), model)).count() == 0


def test_query(spark, real_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    found = QUERIES["op11_quality_model"](spark, SF)
    assert found.count() == real_docs.count()
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) >= 15
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
