import random

import numpy as np
import pytest
from llm_fixtures import SF, make_docs, ready, real_docs  # noqa: F401

from attestlake.llm import decontaminate
from attestlake.llm.decontaminate import EDIT_SHARE, contaminated_passages, within


def nearest(item, text):
    """Fewest word edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        before, row = row, [i]
        for j, other in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (word != other)))
    return min(row)


def test_edit_distance_is_exact():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.randint(0, 4) for _ in range(rng.randint(1, 80))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(0, 40))]
        edits, start, end = within(a, b, 99)
        assert edits == nearest(a, b) == nearest(a, b[start:end])


def changed(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, rng.choice(vocabulary))
    return words


def test_recall_and_precision_against_brute_force(ready, make_docs, real_docs):
    rng = random.Random(9)
    texts = [r.text.split() for r in real_docs.orderBy("doc_id").limit(120).collect()]
    vocabulary = [w for t in texts for w in t]
    items = [(i, " ".join(r.text.split())) for i, r in enumerate(ready.read.parquet(f"{SF}/benchmark.parquet").collect())]
    rows = []
    for k in range(240):
        words = items[k % len(items)][1].split()
        edits = rng.randint(0, int(len(words) * EDIT_SHARE * 1.6))
        base = rng.choice(texts)[: rng.randint(0, 60)]
        at = rng.randint(0, len(base))
        rows.append((k, "  ".join(base[:at] + changed(rng, words, edits, vocabulary) + base[at:]).upper()))
    rows += [(1000 + i, " ".join(t)) for i, t in enumerate(texts)]
    want = set()
    for doc_id, text in rows:
        low = text.lower().split()
        for item_id, item in items:
            words = item.lower().split()
            if set(words) & set(low) and nearest(words, low) <= int(len(words) * EDIT_SHARE):
                want.add((doc_id, item_id))
    table = ready.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    found = contaminated_passages(make_docs(rows), table).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= want and len(got & want) >= 0.97 * len(want)
    for r in found:
        item = dict(items)[r.item_id].lower().split()
        text = dict(rows)[r.doc_id][r.start : r.end].lower().split()
        assert nearest(item, text) <= r.edits <= int(len(item) * EDIT_SHARE)


def test_edges(ready, make_docs, monkeypatch):
    item = "one two three four five six seven eight"
    items = [(1, item), (2, item), (3, None), (4, ""), (5, "solo"), (None, "a b c d e f g h i j k l")]
    table = ready.createDataFrame(items, "item_id bigint, text string")
    rows = [
        (1, item),
        (1, item),
        (2, None),
        (3, ""),
        (4, f"é {item.upper()} {item}"),
        (5, "SOLO"),
        (None, item),
        (6, "one two three four five six seven"),
        (7, "a b c d e f g h i j k l"),
        (8, "ordinary " * 30_000 + item),
    ]
    want = sorted(
        [(1, 1, 0, len(item)), (1, 2, 0, len(item))] * 2
        + [(4, i, s, s + len(item)) for i in (1, 2) for s in (2, 3 + len(item))]
        + [(5, 5, 0, 4), (0, 1, 0, len(item)), (0, 2, 0, len(item)), (7, 0, 0, 23)]
        + [(6, 1, 0, 33), (6, 2, 0, 33)]
        + [(8, i, 270_000, 270_000 + len(item)) for i in (1, 2)]
    )
    for block_bytes in (1 << 20, 60):  # the second makes several passes
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
        found = contaminated_passages(make_docs(rows), table).collect()
        assert sorted((r.doc_id or 0, r.item_id or 0, r.start, r.end) for r in found) == want
    assert contaminated_passages(make_docs([]), table).count() == 0
    assert contaminated_passages(make_docs(rows), table.limit(0)).count() == 0


def test_windows_are_those_of_one_text(ready):
    item = "one two three four five six seven eight"
    halves = [item[:18].encode(), item[18:].encode()]
    data = np.frombuffer(b"".join(halves), np.uint8)
    offsets = np.array([0, len(halves[0]), len(data)], np.int64)
    assert decontaminate.find_items(data, offsets, decontaminate.ItemIndex([(1, item)])) == []


def within_brute(item, text):
    """As `nearest`, for long items."""
    row = np.zeros(len(text) + 1, np.int64)
    steps, text = np.arange(len(text) + 1), np.array(text)
    for i, word in enumerate(item, 1):
        best = np.append(i, np.minimum(row[:-1] + (text != word), row[1:] + 1))
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


@pytest.mark.parametrize("place", ["start", "middle", "end", "spread", "cut"])
def test_items_of_any_length_are_found_wherever_the_edits_lie(ready, make_docs, place):
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(300)]
    sizes = [*range(1, 60), *(100 + 20 * i for i in range(16)), 17, 120]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate(sizes)]
    rows, want = [], set()
    for k, (item_id, text) in enumerate(items * 3):
        words = text.split()
        most = int(len(words) * EDIT_SHARE)
        edits = most + (k >= 2 * len(items))  # the last third has one edit too many
        at = {"middle": (len(words) - edits) // 2, "end": len(words) - edits}.get(place, 0)
        if place == "cut":
            words = words[edits:]
        elif place == "spread":
            words = changed(rng, words, edits, vocabulary)
        else:
            words[at : at + edits] = rng.choices(["new", "other"], k=edits)
        around = [rng.choices(vocabulary, k=rng.randint(0, 40)) for _ in range(2)]
        rows.append((k, " ".join([*around[0], *words, *around[1]])))
    for doc_id, text in rows:
        low = text.split()
        for item_id, item in items:
            words = item.split()
            if len(set(words) & set(low)) * 2 >= len(set(words)) and within_brute(words, low) <= int(len(words) * EDIT_SHARE):
                want.add((doc_id, item_id))
    table = ready.createDataFrame(items, "item_id bigint, text string")
    found = contaminated_passages(make_docs(rows), table).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 2 * len(items) - 2
    for r in found:
        item, text = items[r.item_id][1].split(), rows[r.doc_id][1][r.start : r.end].split()
        assert within_brute(item, text) <= r.edits <= int(len(item) * EDIT_SHARE)


@pytest.mark.parametrize("size_class", range(0, 10))
def test_recall_of_the_repeats(size_class):
    """Passages with all the edits that are allowed, at random places, of random items of a class."""
    rng = random.Random(size_class)
    n = 300 if size_class < 8 else 60
    vocabulary = [f"w{i}" for i in range(5000)]
    items, texts = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(1 << size_class, 2 << size_class))
        items.append((i, " ".join(words)))
        passage = changed(rng, words, int(len(words) * EDIT_SHARE), vocabulary)
        around = [rng.choices(vocabulary, k=rng.randint(0, 30)) for _ in range(2)]
        texts.append(" ".join([*around[0], *passage, *around[1]]).encode())
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = {(text, item) for text, item, *_ in decontaminate.find_items(data, offsets, decontaminate.ItemIndex(items))}
    lost = [i for i in range(n) if (i, i) not in found]
    assert len(lost) <= 1 + n * (1 - decontaminate.RECALL), lost


def test_walks_of_equal_words_write_the_same(ready):
    rng = np.random.default_rng(5)
    words = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    moved = np.append(rng.integers(1, 1 << 62, 7).astype(np.uint64), words)
    for repeat in range(3):
        own, other = (decontaminate.walk_bits(w, repeat) for w in (words, moved))
        starts = np.arange(0, 200, 3)
        a = decontaminate.written(words, own, starts, 64)
        assert (a == decontaminate.written(moved, other, starts + 7, 64)).all()
        at = starts.copy()  # step by step: write, then move on if the step's bit of the word is set
        for step in range(64):
            assert (a[:, step] == words[at]).all()
            at += ((own[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
