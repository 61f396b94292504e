"""Answer matching: one boolean expression per pair of expected and given answer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .cells import let, normalize_path, strip
from .fixed import LIST_ANSWER_TYPES

NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
INFINITE = r"(?i)^[+-]?inf(?:inity)?$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
TOLERANCE_MICROS = 2_000_000


def list_payload(c: Column) -> Column:
    """Distinct trimmed items of a JSON array of strings; null for anything else."""

    def read(v: Column) -> Column:
        strings = F.schema_of_variant(v).isin("ARRAY<STRING>", "ARRAY<VOID>")
        items = F.try_variant_get(v, "$", "array<string>")
        return F.when(strings & ~F.exists(items, F.isnull), F.array_distinct(F.transform(items, strip)))

    return let(F.try_parse_json(strip(c)), read)


def number(c: Column) -> Column:
    text = strip(c)
    return F.when(text.rlike(NUMBER) | text.rlike(INFINITE), text.try_cast("double"))


def answer_micros(c: Column) -> Column:
    text = strip(c)
    return F.when(text.rlike(ISO_TIME), F.unix_micros(F.try_to_timestamp(text)))


def answer_key(kind: Column, answer: Column) -> Column:
    """Text that two answers of a kind share exactly when they match; null when unreadable.

    Times have none, as they match within a tolerance.
    """
    text = strip(answer)
    return (
        F.when(kind.isin(*LIST_ANSWER_TYPES), F.to_json(F.sort_array(list_payload(answer))))
        .when(kind == "exact_string", text)
        .when(kind == "string_ci", F.lower(text))
        .when(kind == "hex_hash", F.when(text.rlike("^[0-9a-fA-F]+$"), F.lower(text)))
        .when(kind == "numeric", (number(answer) + 0.0).cast("string"))
        .when(kind == "path", normalize_path(answer))
        .when(kind == "sid", F.upper(text))
    )


def _near(kind: Column, wanted: Column, given: Column) -> Column:
    """`wanted`: struct of key and micros of the expected answer."""
    close = F.abs(wanted["micros"] - answer_micros(given)) <= TOLERANCE_MICROS
    hit = F.when(kind == "timestamp", close).otherwise(wanted["key"] == answer_key(kind, given))
    return F.coalesce(hit, F.lit(False))


def _wanted(kind: Column, expected: Column) -> Column:
    return F.struct(
        answer_key(kind, expected).alias("key"),
        F.when(kind == "timestamp", answer_micros(expected)).alias("micros"),
    )


def match_answer(kind: Column, expected: Column, given: Column) -> Column:
    return _near(kind, _wanted(kind, expected), given)


def list_stats(expected: Column, given: Column) -> Column:
    """Precision, recall, F1 and exactness of two list answers; null when one is unreadable."""

    def measure(p: Column) -> Column:
        size_e, size_g = F.size(p["e"]), F.size(p["g"])
        return F.struct(
            F.size(F.array_intersect(p["e"], p["g"])).alias("hits"),
            size_e.alias("e"),
            size_g.alias("g"),
        )

    def rate(n: Column) -> Column:
        both_empty = (n["e"] == 0) & (n["g"] == 0)
        precision = F.when(both_empty, 1.0).when(n["g"] > 0, n["hits"] / n["g"]).otherwise(0.0)
        recall = F.when(both_empty, 1.0).when(n["e"] > 0, n["hits"] / n["e"]).otherwise(0.0)
        f1 = F.when(both_empty, 1.0).when(
            n["hits"] > 0, 2 * precision * recall / (precision + recall)
        )
        exact = (n["hits"] == n["e"]) & (n["hits"] == n["g"])
        return F.struct(
            precision.alias("precision"),
            recall.alias("recall"),
            F.coalesce(f1, F.lit(0.0)).alias("f1"),
            F.when(exact, 1.0).otherwise(0.0).alias("exact"),
        )

    pair = F.struct(list_payload(expected).alias("e"), list_payload(given).alias("g"))
    return let(
        pair,
        lambda p: F.when(
            p["e"].isNotNull() & p["g"].isNotNull(), let(measure(p), rate)
        ),
    )


def first_match(kind: Column, expected: Column, candidates: Column, k: int) -> Column:
    """0-based position of the first matching candidate among the first k, else null."""
    if k < 1:
        raise ValueError("k must be at least 1")
    position = let(
        _wanted(kind, expected),
        lambda w: F.array_position(
            F.transform(F.slice(candidates, 1, k), lambda c: _near(kind, w, c)), F.lit(True)
        ),
    )
    return F.when(position > 0, (position - 1).cast("int"))


def infer_answer_type(is_list: Column, scalar: Column) -> Column:
    return (
        F.when(is_list, F.lit("nss_inode_filename_list"))
        .when(strip(scalar).rlike(r"^-?\d+(?:\.\d+)?$"), F.lit("numeric"))
        .otherwise(F.lit("string_ci"))
    )
