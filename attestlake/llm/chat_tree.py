"""Chat formatting as prefix trees: turns that conversations share at their start are written once.

Each turn is a segment: `<|im_start|>role\n`, the text, `<|im_end|>\n`, encoded separately, so a segment has
the same token ids wherever it stands. A path is a conversation's sequence of segments; equal beginnings of
paths are one tree node. Paths are put in one sorted order, in which all paths through a node are
neighbours, so writing each path's new nodes in that order is a depth-first walk. The new nodes of one path
are a run: token ids that stand together in the layout.

A run carries the position of its first token within its conversation (positions go on by one in a run) and
the layout intervals of its ancestors: a token may attend to these and to the tokens before it in its run.

Control strings inside texts are escaped: `<`, any number of backslashes and `|` gets one more backslash,
and reading takes one away. Roles escape backslashes and line ends too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_process, running_total, scratch

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


SEGMENT = pa.struct([("head", pa.int32()), ("body", pa.int32()), ("ids", pa.list_(pa.int32())), ("learned", pa.bool_())])
SEGMENT_DDL = "array<struct<head:int,body:int,ids:array<int>,learned:boolean>>"


def _segments(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation: conv_id, path (a digest for each beginning of it), segments."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = per_process(f"tokenizer {tokenizer}", lambda: _tokenizer(tokenizer))
        for batch in batches:
            turns = batch.column(1).to_pylist()
            parts = [
                piece
                for conversation in turns
                for turn in conversation
                for piece in (f"{START}{escape_role(turn['role'] or '')}\n", escape(turn["text"] or ""), f"{END}\n")
            ]
            ids = [e.ids for e in model.encode_batch_fast(parts, add_special_tokens=False)]
            paths, segments, at = [], [], 0
            for conversation in turns:
                digest, path, own = b"", [], []
                for turn in conversation:
                    head, body, foot = ids[at : at + 3]
                    text = "\x00".join(parts[at : at + 3]).encode()
                    digest = hashlib.blake2b(digest + text, digest_size=16).digest()
                    path.append(digest)
                    own.append({"head": len(head), "body": len(body), "ids": head + body + foot, "learned": turn["role"] == LEARNED_ROLE})
                    at += 3
                paths.append(path)
                segments.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(paths, pa.list_(pa.binary())), pa.array(segments, pa.list_(SEGMENT))],
                names=["conv_id", "path", "segments"],
            )

    turn = F.struct("turn", "role", "text")
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(encode, f"conv_id bigint, path array<binary>, segments {SEGMENT_DDL}")


def format_conversations(turns: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """(runs, members) of all conversations in `turns` (conv_id, turn, role, text).

    runs: run, start (layout position of the first token), position (within the conversation), ids, learned
    (array of [begin, end) in the run whose tokens are under the loss mask), ancestors (array of [start, end) in
    the layout). members: conv_id, run and end of its last segment, tokens, and the intervals of all its tokens.

    Rows are ordered by turn, then role, then text, a null turn first; null role and text count as empty; a
    null conv_id is a conversation; an empty table gives empty results. Each conversation is worked on as one
    row; conversations that share turns are never gathered.
    """
    formatted = scratch(_segments(turns.select("conv_id", "turn", "role", "text"), tokenizer), "chat-segments")
    # One row for each distinct path, numbered in sorted order.
    last = F.element_at("path", -1)
    named = formatted.select(last.alias("leaf"), "path", "segments", F.lit(1).alias("one"))
    distinct = named.dropDuplicates(["leaf"])
    ranked, _ = running_total(distinct, [F.col("path")], "one", "run")
    ranked = scratch(ranked.drop("one"), "chat-paths")

    nodes = ranked.select("run", F.posexplode("path").alias("depth", "node"))
    owners = scratch(nodes.groupBy("node").agg(F.min("run").alias("owner")), "chat-nodes")
    new = owners.groupBy("owner").agg(F.count(F.lit(1)).alias("new"))
    lengths = F.transform("segments", lambda s: F.size(s["ids"]))
    total = F.aggregate(lengths, F.lit(0), lambda a, b: a + b)
    sized = ranked.join(new, ranked["run"] == new["owner"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    kept = F.size("segments") - F.col("new").cast("int")
    sized = sized.select(
        "run",
        kept.alias("inherited"),
        F.aggregate(F.slice(lengths, 1, kept), F.lit(0), lambda a, b: a + b).alias("position"),
        total.alias("tokens"),
        F.expr("slice(segments, size(segments) - cast(new AS int) + 1, cast(new AS int))").alias("segments"),
    ).withColumn("size", F.col("tokens") - F.col("position"))
    laid, _ = running_total(sized, [F.col("run")], "size", "start")
    laid = scratch(laid, "chat-layout")

    # Of each path the last node it has in each run it passes through.
    passed = (
        nodes.join(owners, "node").groupBy("run", "owner").agg(F.max("depth").alias("depth"))
    )
    ends = F.transform(
        F.sequence(F.lit(1), F.size("segments")),
        lambda i: F.aggregate(F.slice("segments", F.lit(1), i), F.lit(0), lambda a, s: a + F.size(s["ids"])),
    )
    places = laid.filter(F.size("segments") > 0).select(
        F.col("run").alias("owner"), "inherited", F.col("start").alias("owner_start"), ends.alias("ends")
    )
    intervals = (
        passed.join(places, "owner")
        .select(
            "run",
            F.struct(
                F.col("owner_start").alias("start"),
                (F.col("owner_start") + F.get("ends", F.col("depth") - F.col("inherited"))).alias("end"),
                F.col("owner").alias("run"),
            ).alias("interval"),
        )
        .groupBy("run")
        .agg(F.sort_array(F.collect_list("interval")).alias("intervals"))
    )
    learned = F.transform(
        F.filter(F.transform("segments", lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"]["learned"]),
        lambda x: F.struct(
            (F.aggregate(F.slice("segments", F.lit(1), x["i"]), F.lit(0), lambda a, s: a + F.size(s["ids"])) + x["s"]["head"]).alias("begin"),
            (
                F.aggregate(F.slice("segments", F.lit(1), x["i"]), F.lit(0), lambda a, s: a + F.size(s["ids"]))
                + x["s"]["head"]
                + x["s"]["body"]
            ).alias("end"),
        ),
    )
    runs = laid.join(intervals, "run").select(
        "run",
        "start",
        F.col("position").alias("position"),
        F.flatten(F.transform("segments", lambda s: s["ids"])).alias("ids"),
        learned.alias("learned"),
        F.filter("intervals", lambda i: i["run"] != F.col("run")).alias("ancestors"),
    )
    leaves = formatted.select("conv_id", last.alias("leaf"))
    of_leaf = ranked.select(last.alias("leaf"), "run").join(intervals, "run")
    members = leaves.join(of_leaf, "leaf").select("conv_id", "run", "intervals")
    return scratch(runs, "chat-runs"), scratch(members, "chat-members")


def read_back(runs: DataFrame, members: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turns (role, text, learned), learned_text and formatted_chars, decoded from the written runs alone.

    The tokens of a conversation are those of its intervals, in the order of their positions.
    """
    paths = members.select("run", "intervals").dropDuplicates(["run"])
    pieces = paths.select(F.col("run").alias("path"), F.explode("intervals").alias("i")).select(
        "path", F.col("i.run").alias("run"), (F.col("i.end") - F.col("i.start")).cast("int").alias("n")
    )
    part = F.struct(
        "position",
        F.slice("ids", F.lit(1), F.col("n")).alias("ids"),
        F.filter("learned", lambda x: x["end"] <= F.col("n")).alias("learned"),
    )
    whole = pieces.join(runs, "run").groupBy("path").agg(F.sort_array(F.collect_list(part)).alias("parts"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = per_process(f"tokenizer {tokenizer}", lambda: _tokenizer(tokenizer))
        turn = re.compile(re.escape(START) + r"(.*)\n(?s:(.*?))" + re.escape(END) + "\n")
        for batch in batches:
            rows = []
            for path, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces, masked = [], []
                for p in parts:
                    pieces += p["ids"]
                    masked += [p["ids"][x["begin"] : x["end"]] for x in p["learned"]]
                text = model.decode(pieces, skip_special_tokens=False)
                learned = "".join(map(unescape, model.decode_batch(masked, skip_special_tokens=False))) if masked else ""
                found = turn.findall(text)
                digest = hashlib.sha256()
                for role, body in found:
                    digest.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                rows.append(
                    (path, len(found), digest.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text))
                )
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
                )

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    read = whole.mapInArrow(
        decode,
        "path bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
    return members.select("conv_id", F.col("run").alias("path")).join(read, "path").drop("path")
