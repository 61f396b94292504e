"""CSV exports as rows of text, in parts of files.

A cell in quotes may hold line breaks, so a part of a file cannot tell by itself where its first record begins. Each
line is a function of whether it begins inside quotes; a part of a file follows both cases, the parts of a file
are put together in order (a few numbers for each), and every line then knows the line its record began on. Only
records of several lines are gathered; the others never leave their task.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

# Lines that end outside quotes, of those that begin outside and inside. A quote opens a cell only at its beginning; two
# quotes are one inside. Over bytes, in time linear in the line: these are RE2, and there is one way to match.
_CELL = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|)'
_ENDS_OUTSIDE = (rf"\A{_CELL}(?:,{_CELL})*\z", rf'\A(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{_CELL})*\z')


def lines_end_open(value: pa.Array, begins_open: bool) -> np.ndarray:
    """Whether lines of CSV end inside quotes."""
    quoted = pc.match_substring(value, '"')
    ends = np.full(len(value), begins_open)
    asked = np.flatnonzero(quoted.to_numpy(zero_copy_only=False).astype(bool))
    if len(asked):
        lines = pc.replace_substring_regex(value.filter(quoted).cast(pa.binary()), r"\r+\z", "")
        ends[asked] = ~pc.match_substring_regex(lines, _ENDS_OUTSIDE[begins_open]).to_numpy(zero_copy_only=False).astype(bool)
    return ends


def ends_open(line: str, begins_open: bool) -> bool:
    return bool(lines_end_open(pa.array([line]), begins_open)[0])


def first_lines(spark: SparkSession, path) -> dict[str, str]:
    """The first line that is not blank of each file; the driver opens the files, 16 at a time, and reads no further."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def first(file: str) -> str:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream = place.getFileSystem(conf).open(place)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
            text = codec.createInputStream(stream) if codec else stream
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8"))
            line = lines.readLine()
            while line is not None and not line.strip("﻿ \t\r"):
                line = lines.readLine()
            return line or ""
        finally:
            stream.close()

    files = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(16) as pool:
        return {f: line.strip("﻿\r ") for f, line in zip(files, pool.map(first, files), strict=True) if line}


def column_names(header: str) -> list[str]:
    """Names in a header line, as Spark's own CSV reader gives them."""
    found = next(csv.reader([header]))
    low = [n.lower() for n in found]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(found)]


LINE = "file string, block bigint, at bigint, value string, open boolean, start bigint, open_inside boolean, start_inside bigint"


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line with, for a part of a file that begins outside and inside quotes: is the line's end open, where its record began.

    `start` is the number (`at`) of the line on which the record began, -1 if that is before this part.
    """
    here, states, starts = None, [False, True], [-1, -1]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block, at, value = (batch.column(c) for c in ("file", "block", "at", "value"))
        other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False).astype(bool)
        edges = [0, *(np.flatnonzero(other) + 1).tolist(), n]
        numbers = at.to_numpy()
        after = [lines_end_open(value, h) for h in (False, True)]
        ends, begun = np.zeros((2, n), bool), np.zeros((2, n), np.int64)
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            place = (file[first].as_py(), block[first].as_py())
            if place != here:
                here, states, starts = place, [False, True], [-1, -1]
            out, inside = (a[first:last] for a in after)
            # a line sets the state, leaves it or turns it: known from the last line that sets it and the turns since
            sets, turned = out == inside, np.cumsum(out & ~inside) & 1
            setter = np.maximum.accumulate(np.where(sets, np.arange(last - first), -1))
            since = turned ^ np.where(setter < 0, 0, turned[setter])
            for h in (0, 1):
                ends[h, first:last] = np.where(setter < 0, states[h], out[setter]) ^ since.astype(bool)
                before = np.concatenate([[states[h]], ends[h, first : last - 1]])
                place_of = np.maximum.accumulate(np.where(before, -1, np.arange(last - first)))
                begun[h, first:last] = np.where(place_of < 0, starts[h], numbers[first:last][place_of])
                states[h], starts[h] = bool(ends[h, last - 1]), int(begun[h, last - 1])
        columns = [file, block, at, value, pa.array(ends[0]), pa.array(begun[0]), pa.array(ends[1]), pa.array(begun[1])]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "at", "value", "open", "start", "open_inside", "start_inside"])


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, inside (does the part begin in quotes), carried (where the record it begins in began), head (the header's line)."""
    for batch in batches:
        rows = []
        for file, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            inside, carried = False, -1
            head = next((p["head"] for p in parts if p["head"] is not None), None)
            for part in parts:
                rows.append((file, part["block"], inside, carried, head))
                last = part["last_inside"] if inside else part["last"]
                carried = carried if last["start"] < 0 else last["start"]
                inside = last["open"]
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["part_file", "part_block", "inside", "carried", "head"])


def records(spark: SparkSession, path) -> DataFrame:
    """file, record, is_first: the records of CSV files, in any number of tasks for a file; blank lines are left out.

    A quote that is never closed takes in the rest of its file, but for the last line break, as any reader of such files would.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    followed = lines.mapInArrow(_followed, LINE)
    last = [F.max_by(F.struct(F.col(f"open{h}").alias("open"), F.col(f"start{h}").alias("start")), "at").alias(f"last{h}") for h in ("", "_inside")]
    first = F.min(F.when(~F.trim("value").isin("", "\r"), F.col("at")))
    parts = followed.groupBy("file", "block").agg(*last, first.alias("head"))
    whole = parts.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "last", "last_inside", "head"))).alias("parts"))
    known = whole.mapInArrow(_put_together, "part_file string, part_block bigint, inside boolean, carried bigint, head bigint")
    # a row for each part of a file, for which the driver holds a larger entry anyway; lines are not shuffled to meet it
    met = followed.join(F.broadcast(known), (F.col("file") == F.col("part_file")) & (F.col("block") == F.col("part_block")))
    began = F.when(F.col("inside"), F.col("start_inside")).otherwise(F.col("start"))
    placed = met.select(
        "file",
        "at",
        "value",
        F.when(began < 0, F.col("carried")).otherwise(began).alias("began"),
        F.when(F.col("inside"), F.col("open_inside")).otherwise(F.col("open")).alias("goes_on"),
        "head",
    )
    alone = (F.col("at") == F.col("began")) & ~F.col("goes_on")
    single = placed.where(alone).select("file", F.col("at").alias("began"), F.col("value").alias("record"), "head")
    ordered = F.sort_array(F.collect_list(F.struct("at", "value")))
    several = placed.where(~alone).groupBy("file", "began").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("record"), F.first("head").alias("head"))
    both = single.unionByName(several).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return both.where(F.trim("record") != "").select("file", "record", (F.col("began") == F.col("head")).alias("is_first"))


def read_split_csv(spark: SparkSession, path, names: list[str]) -> DataFrame:
    """Cells as text under `names`, and `source_file`, of files with one header; the header's own line is left out."""
    ddl = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    rows = records(spark, path).where("not is_first")
    cells = F.from_csv("record", ddl, {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    # as rows of a generator, so that cells are not read once more for each condition on them
    return rows.select(F.inline(F.array(cells)), F.col("file").alias("source_file"))
