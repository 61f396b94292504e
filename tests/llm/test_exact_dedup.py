import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from llm_fixtures import make_docs, ready  # noqa: F401

from attestlake.llm.exact_dedup import exact_dedup

ROWS = [
    (5, "a b"),
    (3, "a  b"),  # longer, so it stays
    (4, "\ta\nb"),  # as long, larger id
    (1, "ab"),
    (9, None),
    (8, ""),
    (7, " \n"),
    (10, "a b"),  # no-break space is no ASCII white space
    (11, "é"),
    (11, "é"),  # a repeated row
    (None, "é"),
    (12, "x" * 50_000),
    (13, "x" * 49_999 + " x"),
]


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        text = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc_id is None, doc_id or 0))
    return {
        content: (min(members)[2] if not min(members)[1] else None, len(members)) for content, members in groups.items()
    }


def run(spark, docs, folder, **options):
    docs.repartition(3).write.parquet(f"{folder}/docs.parquet")
    return exact_dedup(spark, f"{folder}/docs.parquet", **options).collect()


@pytest.mark.parametrize("digest", ["full", "weak"])
def test_groups(ready, make_docs, folder, digest):
    options = {"digest": lambda c: F.substring(F.sha2(c, 256), 1, 1)} if digest == "weak" else {}
    rows = run(ready, make_docs(ROWS), folder, files_per_batch=1, **options)
    want = expected(ROWS)
    texts = {hashlib.sha256(c.encode()).hexdigest(): c for c in want}
    assert len(rows) == len(ROWS)
    for content, (keep, size) in want.items():
        mine = [r for r in rows if texts[r.text_sha256] == content]
        assert {(r.keep_id, r.group_size) for r in mine} == {(keep, size)}
        assert sum(r.kept for r in mine) == 1


def test_empty_table(ready, make_docs, folder):
    assert run(ready, make_docs([]), folder) == []


def test_state_goes_on(ready, make_docs, folder):
    path, state = f"{folder}/docs.parquet", f"{folder}/state"
    make_docs([(1, "a"), (2, "b")]).coalesce(1).write.parquet(path)
    exact_dedup(ready, path, checkpoint=state).collect()
    make_docs([(3, " a"), (4, "c")]).coalesce(1).write.mode("append").parquet(path)
    rows = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(ready, path, checkpoint=state).collect()}
    assert rows == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 1, True), 4: (4, 1, True)}


@pytest.mark.parametrize("digest", ["full", "weak"])
def test_result_does_not_hang_on_how_files_are_split(ready, make_docs, folder, digest):
    # Three files of several row groups each, in batches of two and one that split unlike the batch pass does.
    path, rng = f"{folder}/docs.parquet", random.Random(4)
    rows = [(i, "".join(rng.choices("abcdefghij", k=600))) for i in range(27_000)]
    rows += [(30_000 + i, rows[i * 9][1] + " ") for i in range(300)]
    rng.shuffle(rows)
    docs = make_docs(rows).select("doc_id", "text")
    docs.repartition(3).write.option("parquet.block.size", 1 << 20).parquet(path)
    assert all(f.stat().st_size > 4 << 20 for f in Path(path).glob("*.parquet"))
    options = {"digest": lambda c: F.substring(F.sha2(c, 256), 1, 3)} if digest == "weak" else {}
    setting, before = "spark.sql.files.maxPartitionBytes", ready.conf.get("spark.sql.files.maxPartitionBytes")
    ready.conf.set(setting, str(1 << 20))
    try:
        found = exact_dedup(ready, path, files_per_batch=2, checkpoint=f"{folder}/state", **options).collect()
        ready.conf.set(setting, str(3 << 20))
        again = exact_dedup(ready, path, files_per_batch=2, checkpoint=f"{folder}/state", **options).collect()
    finally:
        ready.conf.set(setting, before)
    assert sorted(found) == sorted(again)
    copies = {doc_id: text.strip() for doc_id, text in rows}
    keeper = {text: doc_id for doc_id, text in sorted(copies.items())}  # the copy is longer by a blank
    assert {r.doc_id: (r.keep_id, r.kept) for r in found} == {i: (keeper[t], keeper[t] == i) for i, t in copies.items()}


def test_neighbouring_tables_are_not_read(ready, make_docs, folder):
    from attestlake.llm.exact_dedup import exact_dedup

    docs = make_docs([(1, "a b"), (2, "ab"), (3, "c")])
    for name in ("documents.parquet", "documents.parquet_old", "documents.parquet.0", "documents.parque"):
        docs.write.parquet(f"{folder}/{name}")
    found = sorted(exact_dedup(ready, f"{folder}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept").collect())
    assert found == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)]
