"""Passages of benchmark items inside documents, found through the CGK embedding.

The CGK random walk reads a word sequence with one pointer: at each step it writes the word under the pointer and
then moves on or stays, by a random bit that depends on the step and the word. Two walks with the same bits that
have fallen out of step after an edit fall into step again, so a small edit distance becomes a small Hamming
distance of what they write.

Items are told apart by size, in classes of a power of two. A class has walks of as many steps as its smallest item
has words (64 at most), which pass over about half of it; an item has one from each of its words from which the
walk stays inside, so all of it is covered, and a document one from each of its windows, `stride` words apart.
Bit sampling compares one random step of each quarter of a walk. It is repeated with fresh walks as often as it
takes to reach RECALL for passages with all the edits that are allowed; an unedited passage is found by the first
walk. Candidates whose walks agree in few
steps go. The others are ranges of the text, as wide as the allowed edits need; overlapping ranges of one item
become one, and each is searched for the item by exact edit distance in words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_latin, mix, text_buffer, text_chunks, word_hashes, word_spans

# An item counts as found with at most this share of its words inserted, deleted or replaced.
EDIT_SHARE = 0.15
# Repeats for each class of sizes, the last for all larger ones: as many as it takes to make a candidate of at least
# RECALL of the passages with all the edits that are allowed, spread evenly over random items of the class
# (tests/llm/test_decontaminate.py measures it), and some more.
RECALL = 0.999
REPEATS = (2, 2, 2, 6, 7, 7, 12, 6, 4)
SAMPLED, LONGEST_WALK = 4, 64
# Of the steps of two walks, the share that must write the same word.
LEAST_AGREEMENT = 0.2
CHUNK = 1 << 20
# Bytes of item text that one pass over the documents carries to every task.
BLOCK_BYTES = 8 << 20
# Slots of the tables that keys are looked up in before the sorted keys.
LEAST_SLOTS, MOST_SLOTS = 1 << 12, 1 << 20
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (case of ASCII and Latin-1 letters folded), starts, ends and text numbers of all words."""
    starts, ends, text_of = word_spans(data, offsets)
    return word_hashes(lower_latin(data), starts, ends), starts, ends, text_of


def within(item: list, text: list, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of `text` that is nearest to `item`, if it needs at most `most` edits.

    Myers' bit-parallel rule over words with a free start; the start is found by running it backwards.
    """
    best = _nearest_end(item, text, free_start=True)
    if best[0] > most:
        return None
    edits, end = best
    back = _nearest_end(item[::-1], text[:end][::-1], free_start=False)
    return edits, end - back[1], end


def passages(item: list, text: list, most: int) -> Iterator[tuple[int, int, int]]:
    """(edits, start, end) of parts of `text` within `most` edits of `item`, from left to right without overlap."""
    size, begin = len(item), 0
    while True:
        rest = map(text.__getitem__, range(begin, len(text)))
        ends = enumerate(_scores(item, rest, free_start=True), begin + 1)
        end = next((j for j, score in ends if score <= most), None)
        if end is None:
            return
        # The first end that is near enough comes up to `most` words before that of the best part.
        low = max(begin, end - size - most)
        edits, a, b = within(item, text[low : end + 2 * most], most)
        yield edits, low + a, low + b
        begin = low + b


def _nearest_end(item: list, text: list, free_start: bool) -> tuple[int, int]:
    best, at = len(item), 0
    for j, score in enumerate(_scores(item, text, free_start), 1):
        if score < best:
            best, at = score, j
    return best, at


def _scores(item: list, text: Iterable, free_start: bool) -> Iterator[int]:
    """Edits from `item` to the text up to each of its words."""
    size = len(item)
    if not size:
        return
    full, top = (1 << size) - 1, 1 << (size - 1)
    masks: dict = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    plus, minus, score = full, 0, size
    for word in text:
        eq = masks.get(word, 0)
        cross = eq | minus
        eq |= ((eq & plus) + plus) ^ plus
        up = minus | ~(eq | plus) & full
        down = plus & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full | (0 if free_start else 1)
        down = down << 1 & full
        plus = down | ~(cross | up) & full
        minus = up & cross
        yield score


def size_class(n: int) -> int:
    return n.bit_length() - 1


def walk_steps(size_class: int) -> int:
    return min(1 << size_class, LONGEST_WALK)


def stride(size_class: int) -> int:
    """Words from one window of a document to the next: there are four windows or more in the first half of an item."""
    return min(max(1, (1 << size_class) // 8), 8)


def walk_bits(words: np.ndarray, repeat: int) -> np.ndarray:
    """64 random bits of each word, one for each step of a walk; `words` are hashes."""
    odd = mix(np.array([2 * repeat + 1], np.uint64))[0] | np.uint64(1)
    bits = words * odd
    return bits ^ (bits >> np.uint64(32))


def sampled_steps(size_class: int, repeat: int) -> np.ndarray:
    """One step of each quarter of a walk; all steps of a walk that has no more than that."""
    steps = walk_steps(size_class)
    edges = np.arange(SAMPLED + 1) * steps // SAMPLED if steps > SAMPLED else np.arange(steps + 1)
    rng = np.random.default_rng([size_class, repeat])
    return rng.integers(edges[:-1], edges[1:])


def _on(at: np.ndarray, bits: np.ndarray, first: int, last: int) -> None:
    """Move pointers on through the steps from `first` up to `last`."""
    for step in range(first, last):
        at += ((bits[at] >> np.uint64(step)) & np.uint64(1)).view(np.int64)


def _joined(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    key = (key ^ words) * SPREAD
    return key ^ (key >> np.uint64(29))


def written(words: np.ndarray, bits: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """The words that the walks write from each start, a row each; `words` ends with as much padding as steps."""
    out, at = np.empty((len(starts), steps), np.uint64), starts.copy()
    for step in range(steps):
        out[:, step] = words[at]
        _on(at, bits, step, step + 1)
    return out


class Walks:
    """The sampled walks of one class and repeat from all places of its items, sorted by key."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray, offsets: np.ndarray, size_class: int, repeat: int):
        """Walks over `words` from `starts`, in the item numbered `items` at the word `offsets`; they must stay before `ends`."""
        self.repeat, self.steps, self.stride = repeat, walk_steps(size_class), stride(size_class)
        self.samples = sampled_steps(size_class, repeat).tolist()
        bits, at = walk_bits(words, repeat), starts.copy()
        key, step, keys = np.zeros(len(starts), np.uint64), 0, []
        for sample in self.samples:
            _on(at, bits, step, sample)
            step, key = sample, _joined(key, words[at])
            keys.append(key)
        _on(at, bits, step, self.steps - 1)
        inside = np.flatnonzero(at < ends)
        inside = inside[np.argsort(key[inside], kind="stable")]
        self.keys, self.items, self.offsets, self.starts = key[inside], items[inside], offsets[inside], starts[inside]
        slots = min(max(LEAST_SLOTS, 1 << (16 * len(inside)).bit_length()), MOST_SLOTS)
        self.tables = [np.zeros(slots, bool) for _ in self.samples]
        for table, partial in zip(self.tables, keys, strict=True):
            table[partial[inside] & np.uint64(slots - 1)] = True

    def candidates(self, words: np.ndarray, bits: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, walk) numbers whose sampled steps write the same words."""
        at, live, key, step = windows.copy(), windows, np.zeros(len(windows), np.uint64), 0
        slots = np.uint64(len(self.tables[0]) - 1)
        for sample, table in zip(self.samples, self.tables, strict=True):
            _on(at, bits, step, sample)
            step, key = sample, _joined(key, words[at])
            keep = np.flatnonzero(table[(key & slots).view(np.int64)])
            at, live, key = at[keep], live[keep], key[keep]
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        many = high - low
        walk = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        return np.repeat(live, many), walk


class ItemIndex:
    """The items' words and their walks for each class and repeat."""

    def __init__(self, items: list[tuple[int, str]]):
        blob = [(text or "").encode() for _, text in items]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in blob])]).astype(np.int64)
        words, _, _, text_of = hashed_words(np.frombuffer(b"".join(blob), np.uint8), offsets)
        bounds = np.searchsorted(text_of, np.arange(len(items) + 1))
        chosen = [(item_id, a, b) for (item_id, _), a, b in zip(items, bounds[:-1], bounds[1:], strict=True) if b > a]
        self.ids = [item_id for item_id, _, _ in chosen]
        self.words = [words[a:b].tolist() for _, a, b in chosen]
        self.sizes = np.array([b - a for _, a, b in chosen], np.int64)
        self.most = (self.sizes * EDIT_SHARE).astype(np.int64)
        self.flat = np.append(words, np.zeros(LONGEST_WALK + 1, np.uint64))
        classes = np.array([size_class(int(n)) for n in self.sizes], np.int64)
        self.walks: list[Walks] = []
        for c in np.unique(classes).tolist():
            of = np.flatnonzero(classes == c)
            sizes = self.sizes[of]
            item = np.repeat(of, sizes)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = np.array([chosen[i][1] for i in of], np.int64)
            start, end = np.repeat(first, sizes) + place, np.repeat(first + sizes, sizes)
            self.walks += [Walks(self.flat, start, end, item, place, c, r) for r in range(REPEATS[min(c, len(REPEATS) - 1)])]
        self.walks.sort(key=lambda w: w.repeat)


def _ranges(index: ItemIndex, words: np.ndarray, text_of: np.ndarray, first_word: np.ndarray) -> np.ndarray:
    """(text, item, first, after last word) of the ranges that may hold an item; those of one item do not overlap."""
    found, repeat = [np.zeros((0, 4), np.int64)], None
    padded = np.append(words, np.zeros(LONGEST_WALK + 1, np.uint64))
    for walks in index.walks:
        if walks.repeat != repeat:
            repeat = walks.repeat
            bits, item_bits = walk_bits(padded, repeat), walk_bits(index.flat, repeat)
        window, walk = walks.candidates(padded, bits, np.arange(0, len(words), walks.stride))
        for a in range(0, len(window), 1 << 14):
            at, w = window[a : a + (1 << 14)], walk[a : a + (1 << 14)]
            alike = written(padded, bits, at, walks.steps) == written(index.flat, item_bits, walks.starts[w], walks.steps)
            near = alike.sum(axis=1) >= LEAST_AGREEMENT * walks.steps
            at, item, place = at[near], walks.items[w[near]], walks.offsets[w[near]]
            text = text_of[at]
            start = np.maximum(at - place - index.most[item], first_word[text])
            end = np.minimum(at - place + index.sizes[item] + index.most[item], first_word[text + 1])
            found.append(np.stack([text, item, start, end], axis=1))
    pairs = np.concatenate(found)
    if not len(pairs):
        return pairs
    text, item, start, end = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))].T
    group = np.cumsum(np.append(True, (np.diff(text) != 0) | (np.diff(item) != 0)))
    # The furthest end so far within the group: groups are set apart by more than any position.
    apart = group * (len(words) + 1)
    furthest = np.maximum.accumulate(end + apart) - apart
    new = np.append(True, (np.diff(group) != 0) | (start[1:] > furthest[:-1]))
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    return np.stack([text[new], item[new], start[new], furthest[last]], axis=1)


def find_items(data: np.ndarray, offsets: np.ndarray, index: ItemIndex) -> list[tuple[int, int, int, int, int]]:
    """(text, item number, edits, start, end in code points) of all verified passages, none over another of its item."""
    words, starts, ends, text_of = hashed_words(data, offsets)
    if not len(words) or not index.walks:
        return []
    first_word = np.searchsorted(text_of, np.arange(len(offsets)))
    ranges = _ranges(index, words, text_of, first_word)
    if not len(ranges):
        return []
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = []
    for text, item, low, high in ranges.tolist():
        own, most, part = index.words[item], int(index.most[item]), words[low:high].tolist()
        # A passage keeps all words of the item but `most`.
        held = set(own)
        if sum(word in held for word in part) < len(own) - most:
            continue
        base = points[offsets[text]]
        for edits, a, b in passages(own, part, most):
            out.append((text, item, edits, int(points[starts[low + a]] - base), int(points[ends[low + b - 1]] - base)))
    return out


def contaminated_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per passage: doc_id, item_id, item_words, edits, start, end (code points of the text).

    `docs` has doc_id and text, `items` item_id and text. An item is found where some part of a text is
    within EDIT_SHARE of the item's words of it, in word edits; case of ASCII and Latin-1 letters and ASCII white
    space do not count. A passage without edits is always found, one with edits with the probability RECALL or more.
    Null, empty and wordless texts match nothing on either side; equal items are each reported; rows of
    `docs` that repeat are each searched; a null id is passed on. Other columns are not read.

    Items are handed to the tasks in blocks of at most about BLOCK_BYTES of text, with one pass over the
    documents for each block, so what a task holds does not grow with the benchmark.
    """
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = _search_block(docs, [(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()])
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_buffer(batch.column(1))
            rows = []
            for first, last in text_chunks(offsets, CHUNK):
                own = offsets[first : last + 1]
                for text, item, edits, start, end in find_items(data[own[0] : own[-1]], own - own[0], index):
                    rows.append((ids[first + text], index.ids[item], int(index.sizes[item]), edits, start, end))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                    names=["doc_id", "item_id", "item_words", "edits", "start", "end"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        search, "doc_id bigint, item_id bigint, item_words bigint, edits bigint, start bigint, end bigint"
    )
