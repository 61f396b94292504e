"""Quality of texts by a generalised additive model with pairwise interactions.

A text becomes SIGNALS numbers, each put into a bin by cut points. The score's logit is an intercept, one entry
of a lookup table for each signal and one of a two-way table for each chosen pair. The tables are sums of shallow
trees: boosting goes round the signals, and each step adds one tree of up to three leaves over one signal's bins,
so no signal can take what another explains as well. Pairs are chosen by how much one cut in each of two signals
still explains, and their tables are boosted in the same way, with trees of four leaves. Scoring adds up table
entries for a whole batch of texts at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_buffer, text_chunks, word_hashes, word_spans

SIGNALS = (
    "log_words",
    "mean_word_length",
    "upper_share",
    "digit_share",
    "symbol_share",
    "doubled_mark_share",
    "repeated_word_share",
    "longest_run_share",
    "distinct_words",
    "repeated_line_share",
    "sentence_end_share",
    "worst_line_symbols",
    "worst_line_upper",
    "letterless_word_share",
    "log_words_per_line",
    "byte_entropy",
)
CHUNK = 1 << 20
# Lines of fewer bytes are not judged alone.
LEAST_LINE = 20

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
_LETTER = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0xC3)
_MARK = (_BYTES > 0x20) & (_BYTES < 0x7F) & ~_LETTER & ~_DIGIT
_SYMBOL = _MARK.copy()
_SYMBOL[[ord(c) for c in ".,;:'\"-()?"]] = False
_START = (_BYTES & 0xC0) != 0x80


def _per(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `flags` between neighbouring offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _largest(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, owner, values)
    return out


def signals(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of SIGNALS for each text of a buffer; all are finite, and an empty text has zeros."""
    n = len(offsets) - 1
    upper = _UPPER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        upper[:-1] |= capital
    letter, symbol, point = _LETTER[data], _SYMBOL[data], _START[data]
    doubled = np.zeros(len(data), bool)
    doubled[1:] = _MARK[data[1:]] & (data[1:] == data[:-1])
    doubled[offsets[:-1][np.diff(offsets) > 0]] = False  # the first byte of a text has none before it
    solid = _per(point & ~SPACE[data], offsets)
    letters = _per(letter, offsets)

    starts, ends, owner = word_spans(data, offsets)
    words = np.bincount(owner, minlength=n)
    hashes = word_hashes(data, starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    heads = np.flatnonzero(~again)
    runs = np.diff(np.append(heads, len(starts)))
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    closing = np.isin(data[ends - 1], [0x21, 0x2E, 0x3F]) if len(ends) else np.zeros(0, bool)
    letter_sum = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    letterless = letter_sum[ends] == letter_sum[starts]

    breaks = np.flatnonzero(data == 0x0A) + 1
    edges = np.unique(np.concatenate([offsets, breaks]))
    from_, to = edges[:-1], edges[1:]
    line_owner = np.searchsorted(offsets, from_, "right") - 1
    line_hash = word_hashes(data, from_, np.where(data[to - 1] == 0x0A, to - 1, to)) if len(from_) else np.zeros(0, np.uint64)
    line_order = np.lexsort((line_hash, line_owner))
    line_new = np.ones(len(line_order), bool)
    line_new[1:] = (line_hash[line_order][1:] != line_hash[line_order][:-1]) | (line_owner[line_order][1:] != line_owner[line_order][:-1])
    lines = np.bincount(line_owner, minlength=n)
    distinct_lines = np.bincount(line_owner[line_order][line_new], minlength=n)
    long = (to - from_) >= LEAST_LINE
    line_letters = _per(letter, edges)
    line_symbols = np.where(long, _share(_per(symbol, edges), _per(point & ~SPACE[data], edges)), 0)
    line_upper = np.where(long, _share(_per(upper, edges), line_letters), 0)

    text_of = np.repeat(np.arange(n), np.diff(offsets))
    histogram = np.bincount(text_of * 256 + data, minlength=n * 256).reshape(n, 256)
    p = histogram / np.maximum(histogram.sum(1, keepdims=True), 1)
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)

    columns = [
        np.log1p(words),
        _share(solid, words),
        _share(_per(upper, offsets), letters),
        _share(_per(_DIGIT[data], offsets), solid),
        _share(_per(symbol, offsets), solid),
        _share(_per(doubled, offsets), solid),
        _share(np.bincount(owner[again], minlength=n), words),
        _share(_largest(runs, owner[heads], n), words),
        np.log1p(distinct) / np.maximum(np.log1p(words), 1e-9),
        _share(lines - distinct_lines, lines),
        _share(np.bincount(owner[closing], minlength=n), words),
        _largest(line_symbols, line_owner, n),
        _largest(line_upper, line_owner, n),
        _share(np.bincount(owner[letterless], minlength=n), words),
        np.log1p(_share(words, lines)),
        entropy,
    ]
    return np.stack(columns, axis=1)


def signals_of(text: pa.Array) -> np.ndarray:
    data, offsets = text_buffer(text)
    found = [np.zeros((0, len(SIGNALS)))]
    for first, last in text_chunks(offsets, CHUNK):
        own = offsets[first : last + 1]
        found.append(signals(data[own[0] : own[-1]], own - own[0]))
    return np.concatenate(found)


@dataclass
class AdditiveModel:
    """Lookup tables: `tables[k]` by the bin of signal k, `pair_tables[(i, j)]` by the bins of two signals."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, values[:, k], "right") for k, c in enumerate(self.cuts)], axis=1)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[bins[:, k]]
        for (i, j), table in self.pair_tables.items():
            total += table[bins[:, i], bins[:, j]]
        return total

    def score(self, values: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(self.bins(values)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Boosting:
    """How tables are learnt; `ridge` and `least` are in units of the second derivative (rows times p times 1 - p)."""

    bins: int = 32
    rounds: int = 120
    rate: float = 0.1
    ridge: float = 1.0
    least: float = 2.0
    pairs: int = 8
    pair_rounds: int = 40


def _gain(g: np.ndarray, h: np.ndarray, b: Boosting) -> np.ndarray:
    return np.where(h >= b.least, g * g / (h + b.ridge), -np.inf)


def _best_cut(g: np.ndarray, h: np.ndarray, b: Boosting) -> tuple[float, int]:
    """The gain and the place (bins before it go left) of the best cut of neighbouring bins."""
    if len(g) < 2:
        return -np.inf, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h, b) + _gain(g.sum() - left_g, h.sum() - left_h, b)
    at = int(gains.argmax())
    return float(gains[at]) - float(g.sum() ** 2 / (h.sum() + b.ridge)), at + 1


def one_way_tree(g: np.ndarray, h: np.ndarray, b: Boosting) -> np.ndarray | None:
    """A step for each bin from a tree of two or three leaves over gradients and second derivatives by bin."""
    gain, at = _best_cut(g, h, b)
    if not gain > 0:
        return None
    edges = [0, at, len(g)]
    more = [(*_best_cut(g[x:y], h[x:y], b), x) for x, y in ((0, at), (at, len(g)))]
    gain, place, x = max(more)
    if gain > 0:
        edges = sorted([*edges, x + place])
    step = np.zeros(len(g))
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        step[x:y] = g[x:y].sum() / (h[x:y].sum() + b.ridge)
    return b.rate * step


def two_way_tree(g: np.ndarray, h: np.ndarray, b: Boosting) -> tuple[float, np.ndarray | None]:
    """The gain and the steps of the best tree with one cut in each of two signals, four leaves in all."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return -np.inf, None
    quarters = [
        (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
        for c in (cg, ch)
    ]
    gains = sum(np.where(qh > 0, qg * qg / (qh + b.ridge), 0) for qg, qh in zip(*quarters, strict=True))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    step = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for columns in (slice(0, j + 1), slice(j + 1, None)):
            step[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + b.ridge)
    return float(gains[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + b.ridge)), b.rate * step


def fit_tables(values: np.ndarray, labels: np.ndarray, b: Boosting = Boosting()) -> AdditiveModel:
    """The model of labelled rows of signals. Without rows of both labels all tables are zero."""
    positive = float(labels.sum())
    width = values.shape[1]
    # Quantiles of the values that occur; equal ones are one cut.
    quantiles = np.linspace(0, 1, b.bins + 1)[1:-1]
    cuts = [np.unique(np.quantile(values[:, k], quantiles, method="higher")) if len(values) else np.zeros(0) for k in range(width)]
    model = AdditiveModel(
        float(np.log((positive + 0.5) / (len(labels) - positive + 0.5))), cuts, [np.zeros(len(c) + 1) for c in cuts]
    )
    if not 0 < positive < len(labels):
        return model
    bins = model.bins(values)
    logit = np.full(len(labels), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(logit)
        return labels - p, p * (1 - p)

    for _ in range(b.rounds):
        for k in range(width):
            g, h = slopes()
            size = len(model.tables[k])
            step = one_way_tree(np.bincount(bins[:, k], g, size), np.bincount(bins[:, k], h, size), b)
            if step is not None:
                model.tables[k] += step
                logit += step[bins[:, k]]

    def grid(i: int, j: int, weights: np.ndarray) -> np.ndarray:
        shape = len(model.tables[i]), len(model.tables[j])
        return np.bincount(bins[:, i] * shape[1] + bins[:, j], weights, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((two_way_tree(grid(i, j, g), grid(i, j, h), b)[0], i, j) for i, j in combinations(range(width), 2)), reverse=True)
    for gain, i, j in ranked[: b.pairs]:
        if gain > 0:
            model.pair_tables[i, j] = np.zeros((len(model.tables[i]), len(model.tables[j])))
    for _ in range(b.pair_rounds):
        for (i, j), table in model.pair_tables.items():
            g, h = slopes()
            gain, step = two_way_tree(grid(i, j, g), grid(i, j, h), b)
            if gain > 0:
                table += step
                logit += step[bins[:, i], bins[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 20_000, boosting: Boosting = Boosting()) -> AdditiveModel:
    """Learn from the texts of `docs` (doc_id, text) that `labels` (doc_id and `label`, 0 or 1) marks.

    At most `most_rows` labels are used, those with the smallest hashes of their ids; so many rows of signals come
    to the driver, which builds the tables. Rows without id, label or document are left out; a document with
    several labels counts with each.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    drawn = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most_rows)

    @F.arrow_udf("array<double>")
    def measured(text: pa.Array) -> pa.Array:
        return pa.array(list(signals_of(text)), pa.list_(pa.float64()))

    # `drawn` has `most_rows` rows at most, so copies of it are small on any cluster.
    met = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = met.select("doc_id", "label", measured("text").alias("values")).orderBy("doc_id", "label", "values").collect()
    values = np.array([r["values"] for r in rows]).reshape(len(rows), len(SIGNALS))
    return fit_tables(values, np.array([r["label"] for r in rows], float), boosting)


def quality_score(text: Column, model: AdditiveModel) -> Column:
    """Probability of label 1 of each text, from the text alone; null counts as empty, and an empty text has a score too."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(signals_of(text)))

    return score(text)
