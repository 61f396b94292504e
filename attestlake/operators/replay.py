"""Re-derive what receipts claim, and the per-tool table of how to do that."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.fixed import SEARCH_ENCODINGS
from ..functions.hashing import canonical_json, digest, unordered_digest
from ..session import scratch_table, written
from .receipts import EMPTY
from .search import CHARSETS, search


def replay_drift(receipts: DataFrame, rederived: DataFrame, by: list[str]) -> DataFrame:
    """Raw digest of re-derived source rows against the header.

    `rederived`: keys and `raw_digest`, for all receipts of a tool at once, and maybe a `problem`, which is then
    the reason.
    """
    problem = F.col("problem") if "problem" in rederived.columns else F.lit(None).cast("string")
    now = rederived.select(*by, F.col("raw_digest").alias("_now"), problem.alias("_problem"))
    same = F.col("_now") == F.col("raw_digest")
    return receipts.join(now, by, "left").select(
        "receipt_id",
        F.coalesce(same, F.lit(False)).alias("replay_ok"),
        F.when(F.col("_problem").isNotNull(), F.col("_problem"))
        .when(F.col("_now").isNull(), F.lit("no source rows to replay"))
        .when(~same, F.concat(
            F.lit("raw digest changed: was "), F.left("raw_digest", F.lit(16)),
            F.lit(", is "), F.left("_now", F.lit(16)),
        ))
        .alias("replay_reason"),
    )


def replay_by_arguments(
    receipts: DataFrame,
    source: DataFrame,
    arguments: str,
    same: list[str],
    matches: Callable,
    raw,
) -> DataFrame:
    """Raw digest per receipt from the source, with the arguments recorded in its header.

    `arguments` is the DDL of the recorded arguments; `same` names those that equal a
    source column and carry the join; `matches(args)` is the rest of the condition.
    One join replays every receipt of the tool.
    """
    parsed = receipts.select("receipt_id", F.from_json("args_canonical", arguments).alias("_args"))
    keyed = parsed.select("receipt_id", "_args", *[F.col(f"_args.{n}").alias(n) for n in same])
    rows = source.join(keyed, same).where(matches(F.col("_args")))
    return rows.groupBy("receipt_id").agg(unordered_digest(digest(raw)).alias("raw_digest"))


@dataclass(frozen=True)
class Parameter:
    """An argument of a tool and what it says about a source row.

    `kind`: `one of` (a list; the column is in it), `overlaps` (a list; the column, an array, shares a member),
    `is`, `text` (the column contains it, case-blind), `from`, `until`, `start` and `end` (the two ends of one
    list argument). `read` turns the recorded text into a value that compares with the column. A null, empty or
    missing argument is no condition. With `nulls_pass` rows without a value meet any condition.
    """

    argument: str
    kind: str
    column: str
    read: Callable[[Column], Column] | None = None
    nulls_pass: bool = False

    @property
    def is_list(self) -> bool:
        return self.kind in ("one of", "overlaps", "start", "end")


# Widths of the time buckets, and the longest range (in seconds) that each serves.
BUCKETS = ((3_600, 21_600), (86_400, 1_728_000), (2_764_800, None))
# Values times time buckets up to which a receipt with both an argument as key and a time range meets the source on both.
MOST_KEYS = 256
# Parts in which a receipt that meets the source on the scope alone goes through it.
PARTS = 64


def replay_filtered(
    receipts: DataFrame, source: DataFrame, parameters: list[Parameter], scope: list[str], raw: Column
) -> DataFrame:
    """receipt_id, raw_digest, problem: each receipt's rows taken from the source anew by its recorded arguments.

    `receipts`: receipt_id, args_canonical and the columns `scope`, which name the part of the source that the tool
    was run on. `parameters` come with the most selective first. Receipts with the same arguments are replayed
    once. A receipt meets the source on the first of its arguments that can be a join key (`one of`, `overlaps`,
    `is`), together with time buckets of a width that suits the range if it has both ends of one; else on the time
    buckets; else on the scope alone, whose rows are then dealt out in PARTS parts. All its other arguments are checked on the
    pairs. One equality join serves all of them, so the source is read once, and rows are given out only for the ways of
    meeting that some receipt has: the calls are written when this is called, and these ways (a few numbers) are read. A receipt without rows gets the digest of nothing; arguments that are not a JSON object, or
    hold a value that cannot be read, are a `problem`, and such a receipt has no digest.
    """
    ddl = {p.argument: "array<string>" if p.is_list else "string" for p in parameters}
    asked = receipts.select(*scope, "args_canonical").distinct()
    args = F.from_json("args_canonical", ", ".join(f"`{n}` {kind}" for n, kind in ddl.items()))
    kinds = {p: source.schema[p.column].dataType for p in parameters}
    columns, problems = [], [F.when(F.try_parse_json("args_canonical").isNull(), F.lit("arguments are not valid JSON"))]
    for i, p in enumerate(parameters):
        given = F.col(f"_args.{p.argument}")
        if p.kind in ("start", "end"):
            given = F.get(given, F.lit(0 if p.kind == "start" else 1))
        element = kinds[p].elementType if isinstance(kinds[p], T.ArrayType) else kinds[p]
        read = p.read or _reader(element)
        if p.kind in ("one of", "overlaps"):
            values = F.transform(F.array_compact(given), read)
            bad = F.exists(values, lambda v: v.isNull())
            value = F.when(F.size(values) > 0, F.array_distinct(values))
        else:
            given = F.when(given != "", given)
            value = given if p.kind == "text" else read(given)
            bad = given.isNotNull() & value.isNull()
        columns.append(value.alias(f"_p{i}"))
        problems.append(F.when(bad, F.lit(f"argument {p.argument} cannot be read")))
    parsed = asked.withColumn("_args", args).select(*scope, "args_canonical", F.coalesce(*problems).alias("problem"), *columns)

    # Where receipts and rows meet: (class, key). A class is -1 for all rows, else the number of an argument (the number of
    # arguments: of none) times the ways with a time bucket, plus which bucket (0: none).
    keyed = [i for i, p in enumerate(parameters) if p.kind in ("one of", "overlaps", "is") and not p.nulls_pass]
    start, end = (
        next((i for i, p in enumerate(parameters) if p.kind in kind and _is_time(kinds[p]) and not p.nulls_pass), None)
        for kind in (("from", "start"), ("until", "end"))
    )
    timed = start is not None and end is not None and parameters[start].column == parameters[end].column
    text = lambda c: c.cast("string")
    cls = lambda i, number: i * (len(BUCKETS) + 1) + number
    whole = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), _each(-1))
    fits, spans, own_bucket = [], [], []
    if timed:
        low, high = (_seconds(F.col(f"_p{i}")) for i in (start, end))
        for width, longest in BUCKETS:
            fits.append(low.isNotNull() & high.isNotNull() & (F.lit(longest is None) | (high - low <= F.lit(longest))))
            spans.append(F.sequence(F.floor(low / width), F.greatest(F.floor(low / width), F.floor(high / width))))
            own_bucket.append(lambda column, width=width: F.floor(_seconds(column) / width))
    ways, emitted = F.when(F.lit(False), whole), {-1: lambda leaf: F.array(_meeting(-1, text(F.pmod(F.xxhash64(leaf), F.lit(PARTS)))))}
    for i in keyed:
        p, value = parameters[i], F.col(f"_p{i}")
        values = F.transform(value, text) if p.is_list else F.array(text(value))
        own = F.transform(F.array_distinct(F.array_compact(F.col(p.column))), text) if p.kind == "overlaps" else F.array_compact(F.array(text(F.col(p.column))))
        for number, (fit, span) in enumerate(zip(fits, spans, strict=True), 1):
            few = F.size(values) * F.size(span) <= MOST_KEYS
            both = F.flatten(F.transform(values, _with_buckets(cls(i, number), span)))
            ways = ways.when(value.isNotNull() & fit & few, both)
            at = own_bucket[number - 1](F.col(parameters[start].column))
            met = F.transform(own, _with_bucket(cls(i, number), at))
            emitted[cls(i, number)] = lambda _, met=met, at=at: F.when(at.isNotNull(), met)
        ways = ways.when(value.isNotNull(), F.transform(values, _each(cls(i, 0))))
        emitted[cls(i, 0)] = lambda _, own=own, i=i: F.transform(own, _each(cls(i, 0)))
    for number, (fit, span) in enumerate(zip(fits, spans, strict=True), 1):
        own_class = cls(len(parameters), number)
        ways = ways.when(fit, F.transform(span, _each(own_class)))
        at = own_bucket[number - 1](F.col(parameters[start].column))
        emitted[own_class] = lambda _, c=own_class, at=at: F.when(at.isNotNull(), F.array(_meeting(c, text(at))))

    parsed = written(parsed.withColumn("_ways", F.when(F.col("problem").isNull(), ways.otherwise(whole))), scratch_table(receipts.sparkSession, "calls"))
    classes = [r[0] for r in parsed.select(F.explode("_ways.cls").alias("cls")).distinct().collect()]
    sought = parsed.where("problem is null").withColumn("_at", F.explode("_ways")).drop("_ways")
    used = {p.column for p in parameters}
    none = F.array().cast("array<struct<cls:int,key:string>>")
    leaf = F.unhex(digest(raw))
    given_out = [F.coalesce(emitted[c](F.col("_leaf")), none) for c in sorted(classes)]
    rows = source.select(*scope, *used, leaf.alias("_leaf")).withColumn("_at", F.explode(F.concat(*given_out, none)))
    left = rows.select(*[F.col(c).alias(f"_s_{c}") for c in scope], *[F.col(c).alias(f"_c_{c}") for c in used], "_leaf", F.col("_at.cls").alias("_cls"), F.col("_at.key").alias("_key"))
    meets = [F.col(f"_s_{c}").eqNullSafe(F.col(c)) for c in scope] + [F.col("_cls") == F.col("_at.cls"), F.col("_key") == F.col("_at.key")]
    conditions = [_meets(p, F.col(f"_c_{p.column}"), F.col(f"_p{i}")) for i, p in enumerate(parameters)]
    # Lists that overlap in several members meet several times; the first common member counts.
    for i in keyed:
        if parameters[i].kind == "overlaps":
            first = text(F.array_min(F.array_intersect(F.col(f"_c_{parameters[i].column}"), F.col(f"_p{i}"))))
            conditions.append((F.col("_cls") != cls(i, 0)) | (F.col("_key") == first))
            for number, bucket in enumerate(own_bucket, 1):
                at = bucket(F.col(f"_c_{parameters[start].column}"))
                conditions.append((F.col("_cls") != cls(i, number)) | (F.col("_key") == _joined(first, at)))
    met = left.join(sought, reduce(lambda a, b: a & b, meets)).where(reduce(lambda a, b: a & b, conditions, F.lit(True)))
    digests = met.groupBy(*scope, "args_canonical").agg(unordered_digest(F.hex("_leaf")).alias("raw_digest"))
    return _answered(receipts, parsed, digests, scope)


def _answered(receipts: DataFrame, parsed: DataFrame, digests: DataFrame, scope: list[str]) -> DataFrame:
    """The digest of each distinct call, or its problem, for every receipt that made it."""
    keys = [*scope, "args_canonical"]
    named = parsed.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "problem")
    found = digests.select(*[F.col(k).alias(f"_d_{k}") for k in keys], "raw_digest")
    same = lambda prefix: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])
    both = receipts.select("receipt_id", *keys).join(named, same("_k_")).join(found, same("_d_"), "left")
    return both.select(
        "receipt_id",
        F.when(F.col("problem").isNull(), F.coalesce("raw_digest", F.lit(EMPTY))).alias("raw_digest"),
        "problem",
    )


def _meeting(number: int, key: Column) -> Column:
    return F.struct(F.lit(number).alias("cls"), key.alias("key"))


def _joined(value: Column, bucket: Column) -> Column:
    return F.concat(bucket.cast("string"), F.lit("@"), value)


def _with_bucket(number: int, bucket: Column) -> Callable[[Column], Column]:
    return lambda value: _meeting(number, _joined(value, bucket))


def _with_buckets(number: int, buckets: Column) -> Callable[[Column], Column]:
    return lambda value: F.transform(buckets, lambda bucket: _meeting(number, _joined(value, bucket)))


def _each(number: int) -> Callable[[Column], Column]:
    return lambda value: _meeting(number, value.cast("string"))


def _reader(kind: T.DataType) -> Callable[[Column], Column]:
    return lambda recorded: recorded.try_cast(kind)


def _is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _seconds(moment: Column) -> Column:
    return F.unix_seconds(moment.cast("timestamp"))


def _meets(p: Parameter, column: Column, value: Column) -> Column:
    if p.kind == "one of":
        fits = F.array_contains(value, column)
    elif p.kind == "overlaps":
        fits = F.arrays_overlap(column, value)
    elif p.kind == "is":
        fits = column == value
    elif p.kind == "text":
        fits = F.contains(F.lower(column), F.lower(value))
    else:
        fits = column >= value if p.kind in ("from", "start") else column <= value
    if p.nulls_pass:
        fits = column.isNull() | fits
    return value.isNull() | F.coalesce(fits, F.lit(False))


SEARCH_ARGS = (
    "pattern string, encodings array<string>, case_sensitive boolean, name_substring string, include_deleted boolean, "
    "max_file_size_bytes bigint, max_matches_per_file bigint"
)
HIT_FIELDS = ["image", "inode", "filename", "deleted", "file_size_bytes", "first_match_offset", "total_match_count"]


def replay_search(receipts: DataFrame, files: DataFrame) -> DataFrame:
    """receipt_id, raw_digest, problem: each receipt's search done anew with its recorded arguments.

    `receipts`: receipt_id, args_canonical and `image`; null: all images. All receipts that search in the same
    encodings, with or without case, are one search by a table of patterns; there are at most 64 such groups.
    The digest is that of the hits' canonical JSON in any order.
    """
    asked = receipts.select("image", "args_canonical").distinct().withColumn("_args", F.from_json("args_canonical", SEARCH_ARGS))
    names = F.filter(F.transform(F.col("_args.encodings"), lambda e: F.lower(F.trim(e))), lambda e: e.isin(*CHARSETS))
    default = F.array_sort(F.array(*map(F.lit, SEARCH_ENCODINGS)))
    encodings = F.when(F.size("_args.encodings") > 0, F.array_sort(F.array_distinct(names))).otherwise(default)
    problem = F.when(F.try_parse_json("args_canonical").isNull(), F.lit("arguments are not valid JSON")).when(
        F.coalesce(F.col("_args.pattern"), F.lit("")) == "", F.lit("argument pattern cannot be read")
    )
    parsed = asked.select(
        "image",
        "args_canonical",
        problem.alias("problem"),
        F.sha2(F.concat_ws("\0", F.coalesce("image", F.lit("")), F.col("image").isNull().cast("string"), "args_canonical"), 256).alias("pattern_id"),
        F.array_join(encodings, ",").alias("_encodings"),
        F.coalesce("_args.case_sensitive", F.lit(False)).alias("_case"),
        "_args",
    )
    good = parsed.where("problem is null")
    hits = None
    for group in good.select("_encodings", "_case").distinct().orderBy("_encodings", "_case").collect():
        own = good.where((F.col("_encodings") == group["_encodings"]) & (F.col("_case") == group["_case"]))
        patterns = own.select("pattern_id", F.col("_args.pattern").alias("text"), "image")
        found = search(files, patterns, group["_encodings"].split(","), group["_case"])
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return _answered(receipts, parsed, parsed.where("false").withColumn("raw_digest", F.lit(EMPTY)), ["image"])
    calls = good.select("pattern_id", F.col("image").alias("_image"), "args_canonical", "_args")
    kept = hits.join(calls, "pattern_id").where(
        (F.coalesce("_args.include_deleted", F.lit(True)) | ~F.col("deleted"))
        & (F.col("file_size_bytes") > 0)
        & F.coalesce(F.col("file_size_bytes") <= F.col("_args.max_file_size_bytes"), F.lit(True))
        & F.coalesce(F.contains(F.lower("filename"), F.lower("_args.name_substring")), F.lit(True))
    )
    count = F.least(F.col("total_match_count").cast("bigint"), F.col("_args.max_matches_per_file"))  # least skips nulls
    kept = kept.withColumn("total_match_count", count)
    leaves = kept.select(F.col("_image").alias("image"), "args_canonical", digest(canonical_json(kept, HIT_FIELDS)).alias("_leaf"))
    digests = leaves.groupBy("image", "args_canonical").agg(unordered_digest(F.col("_leaf")).alias("raw_digest"))
    return _answered(receipts, parsed, digests, ["image"])


def row_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that went and rows that came, as a multiset difference."""
    gone = before.exceptAll(after).withColumn("change", F.lit("removed"))
    new = after.exceptAll(before).withColumn("change", F.lit("added"))
    return gone.unionByName(new)


def version_drift(receipts: DataFrame, installed: DataFrame) -> DataFrame:
    """Receipts minted by another version than the installed one (tool_name, version)."""
    return receipts.join(F.broadcast(installed), "tool_name", "left").select(  # a row per tool
        "receipt_id",
        F.coalesce(F.col("tool_version") == F.col("version"), F.lit(False)).alias("version_ok"),
    )


@dataclass
class ReplayTable:
    """How to replay each tool: a function from its receipts to receipt_id, replay_ok, replay_reason."""

    functions: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    inputs: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def register(self, tool: str, function: Callable[..., DataFrame], inputs=()) -> None:
        self.functions[tool] = function
        self.inputs[tool] = tuple(inputs)

    def register_each(self, tool: str, function: Callable[[dict], str | None]) -> None:
        """A function of one receipt, given as a dict, to its raw digest now. It runs in the tasks.

        What it raises is that receipt's reason; other receipts and tools go on.
        """
        self.register(tool, lambda receipts: replay_each(receipts, function))

    def check(self, receipts: DataFrame, tables: dict[str, DataFrame] | None = None, apart: bool = False) -> DataFrame:
        """Replays every receipt; unknown tools and missing inputs are failures with a reason.

        A function that raises when it is called fails its tool's receipts. With `apart` each tool is a job of its
        own, whose result is written, so that an error while running fails that tool's receipts and no others.
        """
        tables = tables or {}
        usable, results = [], []
        for tool, function in self.functions.items():
            mine = receipts.where(F.col("tool_name") == tool)
            missing = [n for n in self.inputs[tool] if n not in tables]
            usable.append(tool)
            if missing:
                results.append(_failed(mine, f"missing input: {', '.join(missing)}"))
                continue
            try:
                done = function(mine, **{n: tables[n] for n in self.inputs[tool]})
                done = done.select("receipt_id", "replay_ok", "replay_reason")
                results.append(written(done, scratch_table(receipts.sparkSession, "replay")) if apart else done)
            except Exception as error:  # a broken function must not stop the other tools
                results.append(_failed(mine, f"replay failed: {type(error).__name__}"))
        known = F.coalesce(F.col("tool_name").isin(*usable), F.lit(False))
        combined = _failed(receipts.where(~known), "no replay for this tool")
        for part in results:
            combined = combined.unionByName(part)
        return combined


def replay_each(receipts: DataFrame, function: Callable[[dict], str | None]) -> DataFrame:
    """receipt_id, replay_ok, replay_reason from a function of one receipt that gives its raw digest, or raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, problems = [], []
            for row in batch.to_pylist():
                try:
                    digests.append(function(row))
                    problems.append(None)
                except Exception as error:  # the reason is the result
                    digests.append(None)
                    problems.append(f"replay failed: {type(error).__name__}: {error}")
            columns = [batch.column("receipt_id"), pa.array(digests, pa.string()), pa.array(problems, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["receipt_id", "raw_digest", "problem"])

    schema = T.StructType([receipts.schema["receipt_id"]]).add("raw_digest", T.StringType()).add("problem", T.StringType())
    return replay_drift(receipts, receipts.mapInArrow(run, schema), ["receipt_id"])


def _failed(receipts: DataFrame, reason: str) -> DataFrame:
    return receipts.select(
        "receipt_id", F.lit(False).alias("replay_ok"), F.lit(reason).alias("replay_reason")
    )
