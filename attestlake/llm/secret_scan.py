"""Secrets in texts: fixed patterns, and character Markov models for everything else that looks random.

Two first-order models over ASCII characters, one of random strings and one of ordinary identifiers, are
trained from labelled samples. A candidate token is a secret if the log-likelihood ratio of the models,
summed over its characters, is high enough. All of it is DataFrame expressions; the driver receives one
row with the table of ratios (128 x 128 numbers).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

SYMBOLS = 128
SMOOTHING = 0.05
# Tokens that the models judge: this many characters of the usual encodings.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Log-likelihood ratio (nats a character transition) from which a token counts as random.
LEAST_RATIO = 1.0

# The base patterns, with the number of characters that the last group must have.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ORDER = ("assign", "access", "hex", "markov")


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, rank, end, kind, value>> of all leftmost non-overlapping matches, in code points.

    The gaps between matches and the matches themselves alternate, so their lengths add up to the starts.
    """
    p = F.lit(pattern)
    found, values = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("own")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    placed = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda state, x: F.struct(
            (state["at"] + x["gap"] + x["own"]).alias("at"),
            F.array_append(
                state["out"],
                F.struct((state["at"] + x["gap"]).alias("start"), (state["at"] + x["gap"] + x["own"]).alias("end")),
            ).alias("out"),
        ),
    )["out"]
    full = F.zip_with(
        placed,
        values,
        lambda s, v: F.struct(
            s["start"].alias("start"),
            F.lit(ORDER.index(kind)).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            v.alias("value"),
        ),
    )
    kept = F.filter(full, lambda s: F.char_length(s["value"]) >= least)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    return F.when(text.rlike(pattern), kept).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[spans(text, *one) for one in BASE]))


def _transitions(token: Column) -> Column:
    """Numbers (before * 128 + after) of the neighbouring characters of an ASCII token."""
    codes = F.transform(F.split(token, "(?!^)(?!$)"), lambda c: F.ascii(c))
    return F.zip_with(
        F.slice(codes, 1, F.size(codes) - 1),
        F.slice(codes, 2, F.size(codes) - 1),
        lambda a, b: a * SYMBOLS + b,
    )


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratio of each transition, random over ordinary, as the JSON text of an array of 128 * 128 numbers."""

    table: str

    def ratio(self, token: Column) -> Column:
        """Mean ratio over the transitions of an ASCII token of two or more characters."""
        table = F.from_json(F.lit(self.table), "array<double>")
        steps = _transitions(token)
        total = F.aggregate(steps, F.lit(0.0), lambda acc, t: acc + F.get(table, t.cast("int")))
        return total / F.greatest(F.size(steps), F.lit(1))


def train(samples: DataFrame) -> MarkovModels:
    """Learn from `samples` (token, is_random); other rows and characters than ASCII are left out.

    The alphabet of the smoothed models is the 128 ASCII characters; a label without samples gives even
    probabilities.
    """
    pairs = (
        samples.filter(F.col("token").rlike(r"^[\x21-\x7E]{2,}$") & F.col("is_random").isNotNull())
        .select("is_random", F.explode(_transitions(F.col("token"))).alias("pair"))
        .groupBy("pair")
        .agg(
            F.count(F.when(F.col("is_random"), 1)).alias("random"),
            F.count(F.when(~F.col("is_random"), 1)).alias("ordinary"),
        )
    )
    counts = pairs.select("pair", "random", "ordinary").collect()  # at most 128 * 128 rows
    from math import log

    table = [[0, 0] for _ in range(SYMBOLS * SYMBOLS)]
    for row in counts:
        table[row["pair"]] = [row["random"], row["ordinary"]]
    ratios = []
    for before in range(SYMBOLS):
        line = table[before * SYMBOLS : (before + 1) * SYMBOLS]
        sums = [sum(cell[i] for cell in line) + SMOOTHING * SYMBOLS for i in (0, 1)]
        for random, ordinary in line:
            value = log((random + SMOOTHING) / sums[0]) - log((ordinary + SMOOTHING) / sums[1])
            ratios.append(round(value, 6))
    return MarkovModels("[" + ",".join(map(str, ratios)) + "]")


def labelled_samples(docs: DataFrame, bound: int = 2000) -> DataFrame:
    """Samples (token, is_random) from the `bound` documents with the smallest hashed ids.

    Random: the values that base patterns catch, in those documents. Ordinary: the words of letters,
    digits, `_` and `-` outside them. The bound holds for any size of the table.
    """
    drawn = docs.select("doc_id").filter("doc_id is not null").distinct()
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    chosen = docs.select("doc_id", F.col("text").alias("text")).join(drawn, "doc_id", "left_semi")
    secret = chosen.select(F.explode(base_spans(F.coalesce("text", F.lit("")))).alias("span"))
    secret = secret.select(F.col("span.value").alias("token"), F.lit(True).alias("is_random"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[A-Za-z][A-Za-z0-9_-]{3,}"), F.lit(0))
    plain = chosen.select(F.explode(words).alias("token"))
    plain = plain.filter(~F.col("token").rlike(r"^[0-9a-f]{24,}$|^AKIA[A-Z0-9]{16}"))
    return secret.unionByName(plain.select("token", F.lit(False).alias("is_random")))


def find_secrets(docs: DataFrame, models: MarkovModels) -> DataFrame:
    """All columns of `docs` and `_secrets`: array<struct<start, rank, end, kind, value>> by start, then kind.

    Spans are in code points with the end exclusive. Base spans are always there; a `markov` span is a
    candidate token that no base span touches and that the models find random. Null and empty texts have
    none; rows that repeat are each scanned; an empty table gives no rows. A column `_secrets` of `docs` gives way;
    other names are never in the way.
    """
    text = F.coalesce("text", F.lit(""))
    scanned = packed(docs, "text").select("_own", base_spans(text).alias("base"), spans(text, "markov", CANDIDATE, 0, 1).alias("tokens"))
    apart = F.filter(
        F.col("tokens"),
        lambda t: ~F.exists(F.col("base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        & (models.ratio(t["value"]) >= LEAST_RATIO),
    )
    return unpacked(scanned, docs.columns, F.array_sort(F.concat("base", apart)).alias("_secrets"))


def rendered(found: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
