"""Language identification of mixed-language text.

Each word is scored for every learned language by the log-likelihood of its byte trigrams. The scripts of
its letters narrow the candidates: a language counts only for words in scripts that its training text
uses. A Viterbi pass over the words of a text, in which a change of language costs a fixed penalty, then
labels spans. The language of a text is the one whose spans hold the most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_latin, text_buffer, text_chunks, unpacked, word_spans

UNDETERMINED = "und"
BUCKETS = 1 << 16
# Log-likelihood that a change of language must gain.
SWITCH_PENALTY = 12.0
# What a word costs a language that does not use its script.
WRONG_SCRIPT = 40.0
# Share of a language's training letters from which on a script counts as used by it.
SCRIPT_SHARE = 0.001
SMOOTHING = 0.1
CHUNK = 2 << 20

# First and last code points of scripts (Unicode blocks).
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x531, 0x58F)],
    "Hebrew": [(0x5D0, 0x5F4)],
    "Arabic": [(0x620, 0x65F), (0x66E, 0x6D3), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "Devanagari": [(0x900, 0x965)],
    "Bengali": [(0x980, 0x9E3)],
    "Gurmukhi": [(0xA00, 0xA65)],
    "Gujarati": [(0xA80, 0xAE3)],
    "Tamil": [(0xB80, 0xBD7)],
    "Telugu": [(0xC00, 0xC63)],
    "Kannada": [(0xC80, 0xCE3)],
    "Malayalam": [(0xD00, 0xD63)],
    "Thai": [(0xE01, 0xE4E)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x137F)],
    "Khmer": [(0x1780, 0x17D3)],
    "Hiragana": [(0x3041, 0x309F)],
    "Katakana": [(0x30A0, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}


def _script_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Range starts, range ends, and the bit of the script of each range, by start."""
    rows = sorted((a, b, 1 << i) for i, ranges in enumerate(SCRIPTS.values()) for a, b in ranges)
    starts, ends, bits = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    return starts, ends, bits


def letter_scripts(data: np.ndarray) -> np.ndarray:
    """For each byte, the script bit of the letter that starts there; 0 elsewhere."""
    starts, ends, bits = _script_table()
    out = (((data >= 0x41) & (data <= 0x5A)) | ((data >= 0x61) & (data <= 0x7A))).astype(np.int32)
    lead = np.flatnonzero(data >= 0xC0)
    if lead.size:
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        first, second, third, fourth = (padded[lead + i].astype(np.int64) for i in range(4))
        two = (first & 0x1F) << 6 | second & 0x3F
        three = (first & 0x0F) << 12 | (second & 0x3F) << 6 | third & 0x3F
        four = (first & 7) << 18 | (second & 0x3F) << 12 | (third & 0x3F) << 6 | fourth & 0x3F
        point = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
        at = np.maximum(np.searchsorted(starts, point, "right") - 1, 0)
        inside = (point >= starts[at]) & (point <= ends[at]) & (point != 0xD7) & (point != 0xF7)
        out[lead] = np.where(inside, bits[at], 0)
    return out


def trigram_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte of a word the bucket of the trigram around it, with a blank before and after each word; BUCKETS elsewhere."""
    n = len(data)
    low = np.full(n + 2, 0x20, np.uint32)
    low[1:-1] = lower_latin(data)
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    before, after = low[:-2].copy(), low[2:].copy()
    before[starts] = 0x20  # a word at the start of a text follows another text's last byte
    after[ends - 1] = 0x20
    code = (before << np.uint32(16) | low[1:-1] << np.uint32(8) | after) * np.uint32(2654435761)
    return np.where(inside, code >> np.uint32(16), np.uint32(BUCKETS)).astype(np.int32)


@dataclass(frozen=True)
class LanguageModel:
    """`weights`: log-probability of each bucket by language, last row zero; `scripts`: script bits each language uses."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray


def train(labelled: DataFrame) -> LanguageModel:
    """Learn from all rows of `labelled` (text, lang) with neither null.

    Trigrams and scripts are counted on the executors; the driver receives sums only: at most 65,536
    trigram buckets and 22 scripts a language, whatever the number of rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            data, offsets = text_buffer(batch.column(0))
            for first, last in text_chunks(offsets, CHUNK):
                part = data[offsets[first] : offsets[last]]
                own = offsets[first : last + 1] - offsets[first]
                starts, ends, text_of = word_spans(part, own)
                buckets, letters = trigram_buckets(part, starts, ends), letter_scripts(part)
                byte_text = np.repeat(np.arange(last - first), np.diff(own))
                for lang in set(langs[first:last]):
                    mine = (langs[first:last] == lang)[byte_text]
                    grams, scripts = sums.setdefault(lang, (np.zeros(BUCKETS + 1, np.int64), np.zeros(len(SCRIPTS), np.int64)))
                    grams += np.bincount(buckets[mine], minlength=BUCKETS + 1)
                    seen = letters[mine]
                    scripts += np.array([np.count_nonzero(seen == 1 << i) for i in range(len(SCRIPTS))])
        for lang, (grams, scripts) in sums.items():
            for kind, counts in (("gram", grams[:BUCKETS]), ("script", scripts)):
                key = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key), pa.string()), pa.array([kind] * len(key), pa.string()), pa.array(key.astype(np.int32)), pa.array(counts[key])],
                    names=["lang", "kind", "key", "n"],
                )

    counted = labelled.select("text", "lang").dropna().mapInArrow(count, "lang string, kind string, key int, n bigint")
    rows = counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    at = {lang: i for i, lang in enumerate(languages)}
    grams = np.zeros((BUCKETS + 1, len(languages)))
    scripts = np.zeros((len(SCRIPTS), len(languages)))
    for r in rows:
        (grams if r["kind"] == "gram" else scripts)[r["key"], at[r["lang"]]] += r["n"]
    weights = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS))
    weights[BUCKETS] = 0
    used = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    bits = (used * (1 << np.arange(len(SCRIPTS)))[:, None]).sum(axis=0).astype(np.int64)
    return LanguageModel(languages, weights.astype(np.float32), bits)


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of each word when each change of state within a text costs `penalty`.

    `scores` has a row for each word and `offsets` the first word of each text. All texts advance
    together, one word a step, longest first.
    """
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    sizes, firsts = sizes[order], offsets[:-1][order]
    words, states = scores.shape
    labels = np.zeros(words, np.int16)
    if not len(order):
        return labels
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t words
    came = np.empty((words, states), np.int16)  # the state before, for each state of each word
    own = np.arange(states, dtype=np.int16)
    best = scores[firsts].astype(np.float64)
    final = best.copy()
    for t in range(1, longest):
        m = active[t]
        at = firsts[:m] + t
        reached = best[:m]
        top = reached.argmax(axis=1)
        changed = reached[np.arange(m), top][:, None] - penalty
        change = changed > reached
        came[at] = np.where(change, top[:, None].astype(np.int16), own)
        best = np.where(change, changed, reached) + scores[at]
        final[:m] = best
    state = final.argmax(axis=1).astype(np.int16)
    labels[firsts + sizes - 1] = state
    for t in range(longest - 1, 0, -1):
        m = active[t]
        at = firsts[:m] + t
        state[:m] = came[at, state[:m]]
        labels[at - 1] = state[:m]
    return labels


def _label_chunk(data: np.ndarray, offsets: np.ndarray, model: LanguageModel) -> list[tuple]:
    """(language, score, spans) of each text."""
    texts, known = len(offsets) - 1, len(model.languages)
    starts, ends, text_of = word_spans(data, offsets)
    letters = letter_scripts(data)
    if not known or not len(starts):
        return [(UNDETERMINED, 0.0, [])] * texts
    buckets = trigram_buckets(data, starts, ends)
    scores = np.stack(
        [np.add.reduceat(model.weights[:, k][buckets], starts) for k in range(known)], axis=1
    )
    seen = np.bitwise_or.reduceat(letters, starts)
    size = np.add.reduceat((letters > 0).astype(np.int64), starts)
    scores[size == 0] = 0
    fits = (seen[:, None] & ~model.scripts[None, :]) == 0
    scores -= WRONG_SCRIPT * ~fits
    strange = ~fits.any(axis=1)  # a word of no learned language's script takes the label of its neighbours
    scores[strange] = 0
    first_word = np.searchsorted(text_of, np.arange(texts + 1))
    labels = viterbi(scores, first_word, SWITCH_PENALTY)
    # letters by text and language
    claimed = np.where(strange, 0, size)
    held = np.bincount(text_of * known + labels, weights=claimed, minlength=texts * known).reshape(texts, known)
    total = np.bincount(text_of, weights=size, minlength=texts)
    winner = held.argmax(axis=1)
    # spans: runs of one label within a text, in code points
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (text_of[1:] != text_of[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(labels)) - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text_start = points[offsets[:-1]][text_of[heads]]
    span_start, span_end = points[starts[heads]] - text_start, points[ends[tails]] - text_start
    span_text = np.searchsorted(text_of[heads], np.arange(texts + 1))
    out = []
    for i in range(texts):
        if not held[i].any():
            out.append((UNDETERMINED, 0.0, []))
            continue
        spans = [
            {"start": int(span_start[j]), "end": int(span_end[j]), "lang": model.languages[labels[heads[j]]]}
            for j in range(span_text[i], span_text[i + 1])
        ]
        out.append((model.languages[winner[i]], float(held[i, winner[i]] / total[i]), spans))
    return out


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` with `lang_pred`, `lang_score` and `lang_spans` from the column `text` alone.

    `lang_score` is the share of the text's letters in spans of the predicted language; letters in scripts of
    no learned language count for none. Kept columns of these three names give way to them. A null text and a text without a letter are `und` with score 0 and no
    spans; a text with letters of such scripts only gets the first learned language with score 0. Spans are in code points. Rows that repeat are
    each labelled; an empty table gives an empty result. A text is worked on as a whole, at about a hundred
    bytes of memory for each of its bytes.
    """
    fallback = model.languages[0] if model.languages else UNDETERMINED

    # Only the text goes to Python and only the labels come back; the other columns stay where they are.
    @F.arrow_udf(FOUND_DDL)
    def label(text: pa.Array, letter: pa.Array) -> pa.Array:
        data, offsets = text_buffer(text)
        found: list[tuple] = []
        for first, last in text_chunks(offsets, CHUNK):
            own = offsets[first : last + 1]
            found += _label_chunk(data[own[0] : own[-1]], own - own[0], model)
        rows = []
        for (lang, score, spans), has in zip(found, letter.to_pylist(), strict=True):
            if not has:
                lang, score = UNDETERMINED, 0.0
            elif lang == UNDETERMINED:
                lang = fallback
            rows.append({"lang": lang, "score": score, "spans": spans})
        return pa.array(rows, FOUND)

    own = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_own")
    found = docs.select(own, label(docs["text"], docs["text"].rlike(r"\p{L}")).alias("found"))
    return unpacked(found, keep, *[F.col("found")[name].alias(f"lang_{new}") for name, new in (("lang", "pred"), ("score", "score"), ("spans", "spans"))])


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
FOUND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", SPANS)])
FOUND_DDL = "struct<lang:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>"
