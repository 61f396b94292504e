import math
from collections import Counter, defaultdict

import pytest
from llm_fixtures import SF, make_docs, ready, real_docs  # noqa: F401

from attestlake.llm.mixing import entropy, mix_sources, solve
from attestlake.llm.queries import QUERIES


def test_entropy_target():
    tokens = [900, 60, 40]
    mixture = solve(tokens, budget=1000, target_entropy=0.9)
    assert abs(entropy(mixture.weights) - 0.9) < 1e-9 and 0 < mixture.exponent < 1
    assert solve(tokens, 1000, target_entropy=5.0).weights == pytest.approx([1 / 3] * 3)
    assert solve(tokens, 1000, target_entropy=0.01).weights == pytest.approx([0.9, 0.06, 0.04])


def test_repetition_target():
    tokens = [900, 60, 40]
    mixture = solve(tokens, budget=1000, max_repeats=2.0)
    repeats = [q / t for q, t in zip(mixture.quotas, tokens, strict=True)]
    assert max(mixture.weights[i] * 1000 / tokens[i] for i in range(3)) == pytest.approx(2.0)
    assert repeats[0] < 1
    once = solve(tokens, max_repeats=1.5)
    shares = [w * once.budget / t for w, t in zip(once.weights, tokens, strict=True)]
    assert min(shares) == pytest.approx(1, abs=1e-2) and max(shares) == pytest.approx(1.5, abs=1e-2)
    assert solve([5], max_repeats=2).quotas == [5]
    assert solve([], max_repeats=2).budget == 0
    for wrong in ({}, {"target_entropy": 1.0, "max_repeats": 2}):
        with pytest.raises(ValueError):
            solve(tokens, **wrong)


def check_quotas(rows, tokens, budget=None, **target):
    """Every quota is met to within one document, full passes hold every document once."""
    sources = defaultdict(Counter)
    for doc_id, source in tokens:
        sources[source][doc_id] = tokens[doc_id, source]
    names = sorted(sources, key=lambda s: (s is not None, s or ""))
    mixture = solve([sum(sources[n].values()) for n in names], budget, **target)
    for name, quota in zip(names, mixture.quotas, strict=True):
        mine, size = [r for r in rows if r.source == name], sum(sources[name].values())
        spent = sum(r._tokens for r in mine)
        assert quota <= spent < quota + max(sources[name].values()) or spent == quota
        passes = Counter(r._epoch for r in mine)
        for epoch in range(quota // size):
            assert passes[epoch] == len(sources[name])
        assert all(len({r.doc_id for r in mine if r._epoch == e}) == n for e, n in passes.items())
        assert all(0 <= r._mix_at < 1 for r in mine)


@pytest.mark.parametrize("target", [{"budget": 9000, "target_entropy": 1.2}, {"max_repeats": 2.6}])
def test_quotas(ready, make_docs, target):
    rows = [(i, "w " * (1 + i % 13), "en", "big" if i % 3 else f"s{i % 4}") for i in range(1, 900)]
    rows += [(2000 + i, None, None, None) for i in range(40)] + [(3000, "word " * 300, None, "long")]
    tokens = {(d, s): len((t or "").split()) + 1 for d, t, _, s in rows}
    docs = make_docs(rows).repartition(5)
    got = mix_sources(docs, seed=4, block_tokens=100, **target).collect()
    check_quotas(got, tokens, **target)
    assert got[0].tokens == "t" and got[0].kept == "k"
    again = mix_sources(make_docs(rows[::-1]), seed=4, block_tokens=100, **target).collect()
    key = lambda r: (r.doc_id, r._epoch, r._block, round(r._mix_at, 9))
    assert sorted(map(key, got)) == sorted(map(key, again))
    # blocks of all sources are spread alike over the stream
    early = sum(r._tokens for r in got if r._mix_at < 0.5) / sum(r._tokens for r in got)
    assert math.isclose(early, 0.5, abs_tol=0.1)


def test_repeated_ids_and_empty_table(ready, make_docs):
    rows = [(1, "a b", None, "s"), (1, "a b", None, "s"), (None, "c", None, "s")]
    assert Counter(r.doc_id for r in mix_sources(make_docs(rows), max_repeats=1).collect()) == {1: 2, None: 1}
    assert mix_sources(make_docs([]), max_repeats=2).count() == 0


def test_query(spark, real_docs):
    rows = QUERIES["op8_mix_sources"](spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in real_docs.collect()}
    totals = Counter()
    for r in rows:
        totals[r.source] += r.tokens
    own = Counter()
    for r in real_docs.collect():
        own[r.source] += len(r.text.split()) + 1
    assert all(0.999 <= totals[s] / own[s] < 2.6 for s in own)


def test_stretches_of_blocks_do_not_matter(ready, make_docs, monkeypatch):
    """A source of many blocks is taken alike however its blocks are summed up, and by hand."""
    from attestlake.llm import mixing

    rows = [(i, " ".join("w" * (i % 7 + 1)), "en", "ab"[i % 5 == 0]) for i in range(400)]
    taken = []
    for stretch in (4096, 7):
        monkeypatch.setattr(mixing, "STRETCH", stretch)
        out = mixing.mix_sources(make_docs(rows), max_repeats=1.4, seed=3, block_tokens=20).collect()
        taken.append(sorted((r.doc_id, r._tokens, r._epoch, r._block, round(r._mix_at, 12)) for r in out))
    assert taken[0] == taken[1] and len({(r[3]) for r in taken[0]}) > 40
    # By hand: every pass but the last takes each document once, the last as many tokens as are left of the quota.
    tokens = {}
    for doc_id, text, _, source in rows:
        tokens.setdefault(source, {})[doc_id] = len(text.split()) + 1
    names = sorted(tokens)
    mixture = mixing.solve([sum(tokens[s].values()) for s in names], None, None, 1.4)
    for source, quota in zip(names, mixture.quotas, strict=True):
        own, whole = tokens[source], sum(tokens[source].values())
        passes = {}
        for doc_id, n, epoch, block, mix_at in taken[0]:
            if doc_id in own:
                assert n == own[doc_id] and 0 <= mix_at <= 1
                passes.setdefault(epoch, []).append(doc_id)
        for epoch in range(quota // whole):
            assert sorted(passes[epoch]) == sorted(own)
        rest = passes.get(quota // whole, [])
        assert len(set(rest)) == len(rest)
        spent = sum(own[d] for d in rest)
        assert quota % whole <= spent + max(own.values()) and spent <= quota % whole + max(own.values())
