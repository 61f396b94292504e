import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_fixtures import SF, make_docs, ready, real_docs  # noqa: F401

from attestlake.llm.queries import QUERIES
from attestlake.llm.sharding import grid, permute, row_at, shard_rows


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 1000, 4097])
def test_permutation(n):
    a, b = grid(n)
    assert 0 <= a * b - n < a
    moved = permute(np.arange(n), n, seed=5)
    assert sorted(moved) == list(range(n))
    if n > 90:
        assert (moved == np.arange(n)).sum() < 12
        assert (moved != permute(np.arange(n), n, seed=6)).any()
    for row in range(0, n, max(1, n // 20)):
        assert row_at(int(moved[row]) % 4, int(moved[row]) // 4, n, 4, seed=5) == row


def test_large_numbers():
    n = 10**13 + 7
    rows = np.array([0, 1, n // 2, n - 1])
    moved = permute(rows, n, seed=1)
    assert ((moved >= 0) & (moved < n)).all() and len(set(moved)) == 4
    assert [row_at(int(m) % 7, int(m) // 7, n, 7, 1) for m in moved] == rows.tolist()


def test_rows_law(ready, make_docs):
    rows = [(i % 40, f"text {i}") for i in range(101)] + [(None, None)] * 6
    placed = shard_rows(make_docs(rows).repartition(7), [F.col("doc_id"), F.col("text")], 16, 3).collect()
    assert len(placed) == 107 and placed[0].shard == "s"
    counts = Counter(r._shard for r in placed)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard, count in counts.items():
        assert sorted(r._slot for r in placed if r._shard == shard) == list(range(count))
    in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [(r.doc_id, r.text) for r in sorted(placed, key=lambda r: r._row)] == in_order
    again = shard_rows(make_docs(rows[::-1]).repartition(3), [F.col("doc_id"), F.col("text")], 16, 3).collect()
    key = lambda r: (r.doc_id or -1, r.text or "", r._shard, r._slot)
    assert sorted(map(key, again)) == sorted(map(key, placed))


def test_empty_table(ready, make_docs):
    assert shard_rows(make_docs([]), [F.col("doc_id")], 16, 3).count() == 0


def test_query(spark, real_docs):
    rows = QUERIES["op4_feistel_shards"](spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in real_docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        d: (len(t) + 1, zlib.crc32(t)) for d, t in texts.items()
    }
    order = {d: i for i, d in enumerate(sorted(texts))}
    moved = permute(np.arange(len(order)), len(order), 2024)
    assert all(moved[order[r.doc_id]] == r.slot * 16 + r.shard and r.law == "rows" for r in rows)
