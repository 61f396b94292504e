import numpy as np
import pytest
from llm_fixtures import SF, make_docs, ready, real_docs  # noqa: F401
from test_decontaminate import nearest
from test_near_dedup import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def by_hand(spark, docs):
    """Ids kept by the first three stages, by brute force from the stages' own inputs."""
    from attestlake.llm.decontaminate import EDIT_SHARE

    stages = dict(corpus_pipeline.STAGES)
    labelled = stages["language"](spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in labelled.collect()]
    components = brute(rows)
    unique = [(d, t) for d, t in rows if components[d][1] == d]
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for doc_id, text in unique:
        words = text.lower().split()
        if not any(nearest(i, words) <= int(len(i) * EDIT_SHARE) for i in items if set(i) & set(words)):
            clean.add(doc_id)
    return clean


def test_run(spark, real_docs):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == by_hand(spark, real_docs)
    shards = [[r.slot for r in rows if r.shard == s] for s in range(corpus_pipeline.SHARDS)]
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards)
    assert max(map(len, shards)) - min(map(len, shards)) <= 1
    spent, own = {}, {}
    texts = {r.doc_id: r.text for r in rows}
    for r in rows:
        spent[r.source] = spent.get(r.source, 0) + len(r.text.split()) + 1
    sources = {r.doc_id: r.source for r in rows}
    for d, s in sources.items():
        own[s] = own.get(s, 0) + len(texts[d].split()) + 1
    longest = max(len(t.split()) + 1 for t in texts.values())
    assert all(own[s] <= spent[s] <= corpus_pipeline.MAX_REPEATS * own[s] + longest for s in own)


def test_stages_keep_the_columns_and_clean_documents(spark, real_docs):
    docs, kept = real_docs, real_docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == kept, name
    lost = real_docs.join(dict(corpus_pipeline.STAGES)["language"](spark, real_docs, SF), "doc_id", "left_anti").count()
    assert lost <= 0.01 * real_docs.count()


def test_odd_tables(ready, make_docs):
    text = "the words of a text that is long enough to have shingles and a language of its own"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text + "!", "en", None), (None, text, None, "b"), (3, None), (4, ""), (5, "1 2 3")]
    rows += [(10 + i, f"{text} " + " ".join(f"word{i}x{j}" for j in range(40)), "en", "a") for i in range(6)]
    docs = make_docs(rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(ready, docs, SF)
        docs = ready.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
    ids = [r.doc_id for r in docs.collect()]
    assert set(ids) == {1, None, *range(10, 16)} and sorted(docs.columns[-2:]) == ["shard", "slot"]
    assert np.unique([r.shard * 1000 + r.slot for r in docs.collect()]).size == len(ids)
    empty = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(ready, empty, SF)
        assert empty.count() == 0


def test_contaminated_documents_without_an_id_go(ready, make_docs):
    item = ready.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, "a clean text"), (2, f"before {item} after"), (None, "a clean text"), (None, "a clean text"), (None, f"so {item}")]
    left = corpus_pipeline.decontaminate(ready, make_docs(rows), SF)
    assert left.columns == make_docs(rows).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1]
    assert {r.text for r in left.collect()} == {"a clean text"}


CLASHES = (
    "lang_pred lang_score lang_spans _lang_found found n_blocks last_rank _at _range _range_before _row row _own own _tie tie _moved moved "
    "_tokens tokens _epoch epoch _block block _mix_at _source plan_source _of _own_block place stretch before number _shard _slot shard slot "
    "_base base _secrets key digest kept component_id count"
).split()


def clashing(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])


def test_columns_of_any_name_stay_as_they_are(ready):
    text = "the words of a text that is long enough to have shingles and a language of its own"
    rows = [(i, f"{text} {' '.join(f'word{i}x{j}' for j in range(40))}", "en", "ab"[i % 2], 1) for i in range(8)]
    rows += [(None, text, "en", None, 1), (20, "short", "en", "a", 1)]
    docs = clashing(ready, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(ready, docs, SF)
        kept = {"shard": "shard_in", "slot": "slot_in"} if name == "shard" else {}
        assert out.columns == [kept.get(c, c) for c in docs.columns] + ["shard", "slot"] * (name == "shard"), name
        for r in out.collect():
            assert all(r[kept.get(c, c)] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for c in CLASHES), name


def test_operators_keep_columns_of_other_names(ready):
    from attestlake.llm import language_id, mixing, secret_scan, sharding

    docs = clashing(ready, [(1, "password=abcdefgh", "en", "a", 1), (2, "plain words", "en", "b", 1)])
    never = secret_scan.MarkovModels("[" + ",".join(["-1.0"] * 128 * 128) + "]")
    outputs = {
        ("_secrets",): secret_scan.find_secrets(docs, never),
        ("_tokens", "_epoch", "_block", "_mix_at"): mixing.mix_sources(docs, max_repeats=1.5),
        ("_row", "_shard", "_slot"): sharding.shard_rows(docs, [docs["doc_id"]], 2, 1),
        ("lang_pred", "lang_score", "lang_spans"): language_id.identify(docs, language_id.train(docs), docs.columns),
    }
    for new, out in outputs.items():
        assert out.columns == [c for c in docs.columns if c not in new] + list(new)
        for r in out.collect():
            assert all(r[c] == f"{c}-{r.doc_id}" for c in CLASHES if c not in new), new


def test_of_rows_that_share_an_id_the_longest_text_stays(ready, make_docs):
    words = [" ".join(f"w{i}x{j}" for j in range(30 + i)) for i in range(3)]
    rows = [(1, words[0]), (1, words[2]), (1, words[1]), (1, words[2]), (2, None), (2, "b"), (2, "c")]
    for order in (rows, rows[::-1]):
        left = dict(corpus_pipeline.STAGES)["near_dedup"](ready, make_docs(order), SF).collect()
        assert sorted((r.doc_id, r.text) for r in left) == [(1, words[2]), (2, "c")]
