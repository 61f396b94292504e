"""Canonical JSON and the digests built on it."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

NULL_JSON = {"ignoreNullFields": "false"}
# Columns of receipts and their records that hold hex digests.
DIGESTS = ("receipt_id", "prev", "image_sha256", "raw_digest", "data_digest", "prompt_hash", "seal")
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _plain(col: Column, kind: T.DataType) -> Column:
    """Rewrite a value so that its JSON text does not depend on settings."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, STAMP)
    if isinstance(kind, T.DateType):
        return col.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(col))
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[_plain(col[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(col.isNotNull(), rebuilt)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(
            F.transform(
                F.sort_array(F.map_entries(col)),
                lambda e: F.struct(e["key"], _plain(e["value"], kind.valueType)),
            )
        )
    return col


def _not_finite(col: Column, kind: T.DataType) -> Column | None:
    """Whether a value holds NaN or an infinity at any depth; null for types that cannot."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.isnan(col) | (F.abs(col) == float("inf"))
    if isinstance(kind, T.ArrayType):
        if _not_finite(F.lit(None), kind.elementType) is None:
            return None
        return F.exists(col, lambda x: F.coalesce(_not_finite(x, kind.elementType), F.lit(False)))
    if isinstance(kind, T.MapType):
        return _not_finite(F.map_values(col), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        checks = [_not_finite(col[f.name], f.dataType) for f in kind.fields]
        checks = [F.coalesce(c, F.lit(False)) for c in checks if c is not None]
        return reduce(lambda x, y: x | y, checks) if checks else None
    return None


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """Sorted keys, no blanks, nulls kept. Null when a number at any depth is NaN or infinite."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields, bad = [], F.lit(False)
    for name in sorted(columns):
        fields.append(
            F.concat(F.lit(json.dumps(name) + ":"), json_scalar(F.col(name), kinds[name]))
        )
        check = _not_finite(F.col(name), kinds[name])
        if check is not None:
            bad = bad | F.coalesce(check, F.lit(False))
    return F.when(~bad, F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))


def number_text(d: Column) -> Column:
    """Shortest decimal text of a double: no exponent from 1e-6 up to 1e15, whole
    numbers without a fraction."""
    size = F.abs(d)
    whole = (d == F.floor(d)) & (size < 1e15)
    fixed = F.regexp_replace(
        d.cast("string").try_cast("decimal(38,18)").cast("string"), r"0+$", ""
    )
    return (
        F.when(whole, d.cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), d.cast("string"))
        .when((size >= 1e-6) & (size < 1e15), fixed)
        .otherwise(F.lower(d.cast("string")))
    )


def json_text(c: Column) -> Column:
    """A string as a JSON string literal; it ends in quotes, so only the brackets go."""
    return F.btrim(F.to_json(F.array(c)), F.lit("[]"))


def json_scalar(col: Column, kind: T.DataType) -> Column:
    """One value as JSON text; numbers are written alike at every depth."""
    if isinstance(kind, T.StringType):
        text = json_text(col)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number_text(col.cast("double"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        text = F.concat(F.lit('"'), _plain(col, kind), F.lit('"'))
    elif isinstance(kind, T.ArrayType) and _holds_double(kind):
        items = F.transform(col, lambda x: json_scalar(x, kind.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    elif isinstance(kind, T.StructType) and _holds_double(kind):
        fields = [
            F.concat(F.lit(json.dumps(f.name) + ":"), json_scalar(col[f.name], f.dataType))
            for f in sorted(kind.fields, key=lambda f: f.name)
        ]
        text = F.when(col.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    elif isinstance(kind, T.MapType) and _holds_double(kind):
        entries = F.transform(
            F.sort_array(F.map_entries(col)),
            lambda e: F.concat(json_text(e["key"].cast("string")), F.lit(":"), json_scalar(e["value"], kind.valueType)),
        )
        text = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(_plain(col, kind), NULL_JSON)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit("null"))


def _holds_double(kind: T.DataType) -> bool:
    return _not_finite(F.lit(None), kind) is not None


def record_map(df: DataFrame, columns: list[str]) -> Column:
    """Field -> JSON text of its value. Entries of a string map are also reachable as `map.key`."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    flat = F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]),
        F.array(*[json_scalar(F.col(c), kinds[c]) for c in columns]),
    )
    for name in columns:
        if isinstance(kinds[name], T.MapType):
            flat = F.map_concat(flat, _dotted(name, kinds[name]))
    return flat


def _dotted(name: str, kind: T.MapType) -> Column:
    """Entries of a map column as `name.key`; none for a null map."""
    entries = F.transform(
        F.map_entries(name),
        lambda e: F.struct(
            F.concat(F.lit(name + "."), e["key"].cast("string")).alias("key"),
            json_scalar(e["value"], kind.valueType).alias("value"),
        ),
    )
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(F.coalesce(entries, none))


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def packed(c: Column) -> Column:
    """Text in a form for shuffles: lower-case hex takes half its bytes, any other text one byte more."""
    bare = F.unhex(c)
    is_hex = F.coalesce(F.lower(F.hex(bare)) == c, F.lit(False))
    return F.when(is_hex, F.concat(F.lit(b"\1"), bare)).otherwise(F.concat(F.lit(b"\0"), c.cast("binary")))


def unpacked(c: Column) -> Column:
    rest = F.substring(c, 2, 2147483647)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def each_digest(df: DataFrame, form) -> DataFrame:
    """`packed` or `unpacked` for the columns of a receipt that hold digests."""
    return df.withColumns({n: form(F.col(n)) for n in df.columns if n in DIGESTS})


def length_prefixed_digest(first: Column, second: Column) -> Column:
    """Digest of two strings; eight-byte lengths keep their boundary fixed."""

    def framed(c: Column) -> list[Column]:
        size = F.unhex(F.lpad(F.hex(F.octet_length(c)), 16, "0"))
        return [size, c.cast("binary")]

    return F.sha2(F.concat(*framed(first), *framed(second)), 256)


def keyed_seal(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a string under a shared key."""
    import hashlib

    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner_pad = F.unhex(F.lit(bytes(b ^ 0x36 for b in block).hex()))
    outer_pad = F.unhex(F.lit(bytes(b ^ 0x5C for b in block).hex()))
    inner = F.unhex(F.sha2(F.concat(inner_pad, message.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def unordered_digest(leaf: Column) -> Column:
    """Order-free digest of a group of hex leaves, as an aggregate.

    Four sums over the leaf hash plus the count. Sums combine on the map side,
    so a group of any size costs one small row per task.
    """
    return sums_digest(F.count(leaf), [F.sum(lane) for lane in lanes(leaf)])


def lanes(leaf: Column) -> list[Column]:
    """What a hex leaf adds to each of the four sums of `unordered_digest`."""
    return [F.conv(F.substring(leaf, start, 15), 16, 10).cast("decimal(38,0)") for start in (1, 16, 31, 46)]


def sums_digest(count: Column, sums: list[Column]) -> Column:
    """`unordered_digest` from the count of leaves and the sums of their lanes."""
    return F.sha2(F.concat_ws("|", count.cast("string"), *[s.cast("string") for s in sums]), 256)
