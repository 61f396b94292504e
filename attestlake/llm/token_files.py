"""Token ids in binary files that can be read document by document.

A file holds the ids of a run of documents, in ascending doc_id order:

- one or more independent zstandard frames for each document (at most `frame_ids` ids in each), little
  endian, two bytes an id where the vocabulary allows it and else four;
- a skippable frame (magic 0x184D2A5D) with the documents: byte `width`, u64 count, then for all of them
  i64 doc_id, u8 doc_id is null, u64 number of ids, u32 first frame, u32 number of frames;
- a skippable frame (magic 0x184D2A5E) that is the seek table of zstandard's public seekable format:
  u32 compressed size, u32 decompressed size and u32 checksum (low half of XXH64 of the decompressed
  bytes) of each frame before it, then u32 number of frames, u8 0x80 and the magic 0x8F92EAB1.

A reader takes the last bytes, the seek table and the document table, and then decompresses the frames of
the documents it is asked for and no others.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_table, written
from .common import per_process, text_buffer

ROWS_PER_BATCH = 20_000
DOCUMENTS_MAGIC, SEEK_FRAME_MAGIC, SEEKABLE_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
INDEX_SCHEMA = (
    "doc_id bigint, path string, file_no int, position bigint, offset_in_file bigint, n_tokens bigint, "
    "first_frame int, n_frames int"
)


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class TokenFileWriter:
    """Writes one file front to back; keeps only its tables in memory."""

    def __init__(self, stream, width: int, frame_ids: int, level: int = 3):
        self.stream, self.frame_ids = stream, frame_ids
        self.kind = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> tuple[int, int]:
        first = len(self.frames)
        for at in range(0, max(1, len(ids)), self.frame_ids):
            raw = ids[at : at + self.frame_ids].astype(self.kind).tobytes()
            packed = self.compressor.compress(raw)
            self.stream.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs.append((doc_id or 0, doc_id is None, len(ids), first, len(self.frames) - first))
        return first, len(self.frames) - first

    def close(self) -> None:
        table = np.array(self.docs, dtype="<i8").reshape(len(self.docs), 5)
        body = struct.pack("<BQ", self.kind.itemsize, len(table)) + b"".join(
            table[:, i].astype(kind).tobytes() for i, kind in enumerate(("<i8", "u1", "<u8", "<u4", "<u4"))
        )
        self.stream.write(struct.pack("<II", DOCUMENTS_MAGIC, len(body)) + body)
        self.frames.append((8 + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        seek = np.array(self.frames, dtype="<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_FRAME_MAGIC, len(seek)) + seek)


class TokenFile:
    """Reads the documents of one file; `file` is a seekable binary stream of `size` bytes."""

    def __init__(self, file, size: int):
        self.file = file
        count, flags, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError("not a token file: its seek table is missing or has no checksums")
        self.frames = np.frombuffer(self._bytes(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        body = self._bytes(int(self.starts[-2]), int(self.frames[-1, 0]))
        kind, length, width, n = struct.unpack_from("<IIBQ", body)
        if kind != DOCUMENTS_MAGIC or length != len(body) - 8:
            raise ValueError("not a token file: its document table is missing")
        self.kind, at, columns = np.dtype(f"<u{width}"), 17, []
        for one in ("<i8", "u1", "<u8", "<u4", "<u4"):
            columns.append(np.frombuffer(body, one, n, at))
            at += n * np.dtype(one).itemsize
        self.doc_ids, self.nameless, self.n_ids, self.first, self.n_frames = columns
        self.decompressor = zstandard.ZstdDecompressor()

    def _bytes(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("the file ends too early")
        return data

    def read(self, index: int) -> np.ndarray:
        """Ids of the document at a position of the file; frames of other documents are not read."""
        parts = []
        for f in range(int(self.first[index]), int(self.first[index] + self.n_frames[index])):
            raw = self.decompressor.decompress(self._bytes(int(self.starts[f]), int(self.frames[f, 0])))
            if len(raw) != self.frames[f, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[f, 2]:
                raise ValueError(f"frame {f} does not match its checksum")
            parts.append(np.frombuffer(raw, self.kind))
        return np.concatenate(parts).astype(np.uint32)


# Bytes between which no token of a byte-level vocabulary with the usual word pattern can span.
_LETTER_END = np.zeros(256, bool)
_LETTER_END[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[:0x80] = ~_LETTER_END[:0x80]


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Whether a text can be cut before each byte without changing its tokens.

    The usual word pattern always starts a new piece at a space before a letter and at an ASCII character
    that is no letter after a letter. Letters are taken to be those of ASCII and of the two Latin blocks
    up to U+017F; around any other character no cut is made.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, bool)
    before, after = data[:-1], data[1:]
    wide = (before == 0xC3) & (after >= 0x80) & (after != 0x97) & (after != 0xB7)
    wide |= ((before == 0xC4) | (before == 0xC5)) & (after >= 0x80)
    ends = _LETTER_END[data]
    ends[1:] |= wide
    begins = _LETTER_END[data]
    begins[:-1] |= wide
    cut = np.zeros(n, bool)
    cut[1:] = ends[:-1] & _PLAIN[after]
    cut[:-1] |= (data[:-1] == 0x20) & begins[1:]
    return cut


class PieceCache:
    """Ids of pieces that were encoded before, as bytes; emptied when it holds `limit` pieces (about 200 bytes each).

    With `spell_special` the special tokens of the vocabulary count as ordinary text; without it a text has
    the ids of the tokenizer's own `encode(text, add_special_tokens=False)`.
    """

    def __init__(self, path: str, limit: int = 600_000, spell_special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.tokenizer.encode_special_tokens = spell_special
        self.known: dict[bytes, bytes] = {}
        held = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (spell_special and t.special)]
        # Beside tokens that take blanks with them or are matched in changed text no cut is safe: texts stay whole.
        self.whole = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in held)
        contents = sorted((t.content.encode() for t in held), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, contents))) if contents else None

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bounds of the pieces: safe cuts, but none inside the content of an added token, which is a piece of its own."""
        if self.whole:
            return np.unique(offsets)
        cut = np.append(safe_cuts(data), False)
        if self.added is not None:
            blob = data.tobytes()
            if self.added.search(blob):
                spans = [m.span() for a, b in zip(offsets[:-1], offsets[1:], strict=True) for m in self.added.finditer(blob, a, b)]
                for a, b in spans:
                    cut[a + 1 : b] = False
                    cut[[a, b]] = True
        cut[offsets] = True
        return np.flatnonzero(cut)

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        missing = [p for p in pieces if p not in self.known]
        if missing:
            encoded = self.tokenizer.encode_batch_fast([p.decode() for p in missing], add_special_tokens=False)
            self.known.update((p, array("I", e.ids).tobytes()) for p, e in zip(missing, encoded, strict=True))
        return list(map(self.known.__getitem__, pieces))


def encode_texts(column: pa.Array, cache: PieceCache, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text and `end_id`: every distinct piece of the batch goes through the tokenizer once."""
    data, offsets = text_buffer(column)
    cuts = cache.cuts(data, offsets)
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]
    ).dictionary_encode()
    which = pieces.indices.to_numpy()
    tables = cache.ids(pieces.dictionary.to_pylist())
    lengths = np.fromiter(map(len, tables), np.int64, len(tables)) // 4
    flat = np.frombuffer(b"".join(tables), np.uint32)
    begins = np.cumsum(lengths) - lengths
    size = lengths[which]
    ends = np.cumsum(size)
    ids = flat[np.arange(size.sum()) + np.repeat(begins[which] - (ends - size), size)]
    # Ids up to the first piece of each text, and up to the end of the last.
    bounds = np.append(0, ends)[np.searchsorted(cuts, offsets)]
    end = np.array([end_id], np.uint32)
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.concatenate([ids[first:last], end])


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int = 65536, frame_ids: int = 1 << 18
) -> DataFrame:
    """Encode `text` of each row of `docs` and write the ids in ascending doc_id order; returns the index of the documents.

    The ids are those of the tokenizer's `encode(text, add_special_tokens=False)` and `end_id`: the content of an
    added token inside a text is that token.
    Each sorted range of documents becomes one file, written front to back by its task under a name of
    its own; only files that the index (a table written with Spark's commit protocol) names count, so a
    repeated or lost task leaves no trace. Null text counts as empty; a null doc_id comes first; rows with
    equal doc_id are ordered by text. An empty table gives an empty index. Other columns are not written.
    """
    width = 2 if vocabulary <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, filesystem, stream = TaskContext.get().partitionId(), None, None
        cache = per_process(f"pieces of {tokenizer}", lambda: PieceCache(tokenizer, spell_special=False))
        position = offset = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                filesystem, root = open_folder(folder)
                filesystem.create_dir(root, recursive=True)
                name = f"{root}/ids-{part:06d}-{uuid.uuid4().hex}.zst"
                stream = filesystem.open_output_stream(name, compression=None)
                writer = TokenFileWriter(stream, width, frame_ids)
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1), cache, end_id), strict=True):
                frame, frames = writer.add(doc_id, ids)
                rows.append((doc_id, name, part, position, offset, len(ids), frame, frames))
                position, offset = position + 1, offset + len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
            )
        if stream is not None:
            writer.close()
            stream.close()

    names = ["doc_id", "path", "file_no", "position", "offset_in_file", "n_tokens", "first_frame", "n_frames"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    rows = docs.select("doc_id", F.col("text").alias("text")).orderBy("doc_id", F.xxhash64("text"))
    # Distinct pieces are looked up once for each batch, so only its bytes should bound it.
    spark, most = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    spark.conf.set(most, str(ROWS_PER_BATCH))
    try:
        return written(rows.mapInArrow(write, INDEX_SCHEMA), f"{folder}/index")
    finally:
        spark.conf.set(most, before)


def file_starts(index: DataFrame) -> DataFrame:
    """One row for each file: path, file_no, and the number of ids in all files before it."""
    files = index.groupBy("path", "file_no").agg(F.sum("n_tokens").alias("_ids"))
    # As many rows as there are files.
    before = F.sum("_ids").over(Window.orderBy("file_no")) - F.col("_ids")
    return files.select("path", "file_no", before.alias("start"))


def read_token_files(spark: SparkSession, files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens and ids (little-endian u32 bytes).

    `files` has path and start. `wanted` (path, position) restricts the frames that are decompressed to
    those of the documents it names.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, name = open_folder(row["path"]) if "://" in row["path"] else open_folder(f"file://{row['path']}")
                with filesystem.open_input_file(name) as file:
                    tokens = TokenFile(file, file.size())
                    chosen = sorted(row["positions"]) if row.get("positions") is not None else range(len(tokens.n_ids))
                    starts = row["start"] + np.cumsum(tokens.n_ids).astype(np.int64) - tokens.n_ids.astype(np.int64)
                    held, size = [], 0
                    for i in chosen:
                        ids = tokens.read(i).astype("<u4").tobytes()
                        doc_id = None if tokens.nameless[i] else int(tokens.doc_ids[i])
                        held.append((doc_id, int(starts[i]), len(ids) // 4, ids))
                        size += len(ids)
                        if size > 4 << 20:
                            yield packed(held)
                            held, size = [], 0
                    if held:
                        yield packed(held)

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)],
            names=["doc_id", "start", "n_tokens", "ids"],
        )

    if wanted is not None:
        chosen = wanted.groupBy("path").agg(F.collect_list("position").alias("positions"))
        files = files.join(chosen, "path")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(spread, "path").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_folder(spark: SparkSession) -> str:
    return scratch_table(spark, "token-files")
