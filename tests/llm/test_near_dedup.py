import random
import re

import numpy as np
from llm_fixtures import SF, make_docs, ready, real_docs  # noqa: F401

from attestlake.llm import near_dedup
from attestlake.llm.near_dedup import connected_components, near_duplicates, shingle_sets, word_digests


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles_of(text):
    words = words_of(text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """doc_id -> (n_shingles, component) for unique ids."""
    sets = {d: shingles_of(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(sets[d]), root(d)) for d in ids}


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def fixture():
    rng = random.Random(11)
    rows, base = [], [text_of(rng, 120) for _ in range(30)]
    for text in base:
        rows.append(text)
        rows += [edited(rng, text, rng.randint(0, 6)) for _ in range(rng.randint(0, 5))]
    chain = text_of(rng, 150)  # every link of the chain holds, its ends are far apart
    for _ in range(12):
        rows.append(chain)
        chain = edited(rng, chain, 3)
    passage = text_of(rng, 60)
    rows += [f"{text_of(rng, 40)} {passage} {text_of(rng, 30)}" for _ in range(40)]
    rows += [base[0]] * 25 + [base[0].upper() + "\n"] * 5
    rows += ["one two", "One  TWO", "one two three", "", None, " \t", "É é", "é É", text_of(rng, 6000)]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_against_all_pairs(ready, make_docs):
    rows = fixture()
    want = brute(rows)
    got = near_duplicates(make_docs(rows).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_real_documents_against_all_pairs(ready, real_docs):
    rows = [(r.doc_id, r.text) for r in real_docs.collect()]
    got = near_duplicates(real_docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_small_buckets_still_give_all_links(ready, make_docs, monkeypatch):
    """With one band of one minimum, buckets mix components and the rest pairs matter."""
    rng = random.Random(2)
    base = [text_of(rng, 30) for _ in range(6)]
    rows = [(i, edited(rng, t, 1)) for i, t in enumerate(base * 6)]
    want = brute(rows)
    got = near_duplicates(make_docs(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_ids_null_and_repeated(ready, make_docs):
    same = "a b c d e f g h i j"
    rows = [(4, same), (4, same), (2, same + " "), (None, same), (7, "other words than the rest of them"), (7, same)]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept, r.n_shingles) for r in near_duplicates(make_docs(rows)).collect())
    assert got[0] == (0, 0, True, 6)
    assert [g[:3] for g in got if g[0] == 4] == [(4, 2, False)] * 2
    assert [g[:3] for g in got if g[0] == 2] == [(2, 2, True)]
    assert {g[1] for g in got if g[0] == 7 and g[3] == 6} == {2}


def test_empty_table(ready, make_docs):
    assert near_duplicates(make_docs([])).count() == 0


def test_components(ready):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 400)] + [(500, 501), (501, 500), (501, 500)]
    edges += [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(80)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    shuffled = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = connected_components(ready.createDataFrame(shuffled, "a bigint, b bigint")).collect()
    found = {r.node: r.component for r in got}
    assert {n: found.get(n, n) for n in parent} == {n: root(n) for n in parent}
    assert connected_components(ready.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hashes_follow_words():
    texts = ["A b  c d e f", "a B c d\te F ", "a b c d e g", "", "x", " X\n"]
    blob = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blob])]).astype(np.int64)
    data = np.frombuffer(b"".join(blob), np.uint8)
    sets, digests = shingle_sets(data, offsets), word_digests(data, offsets)
    assert sets[0].tolist() == sets[1].tolist() and digests[0] == digests[1]
    assert len(set(sets[0].tolist()) & set(sets[2].tolist())) == 1 and digests[0] != digests[2]
    assert sets[4].tolist() == sets[5].tolist() and digests[4] == digests[5] and len(sets[3]) == 0
    assert near_dedup.LEAST_AGREEING < near_dedup.HASHES * 0.75


def test_query_on_small_tables(spark):
    from compare import compare, duck

    from attestlake.llm.queries import QUERIES, SQL

    for name in sorted(SQL):
        problem, count, _ = compare(spark, duck(SF), SF, name, QUERIES[name], SQL[name])
        assert problem is None and count > 0, name
