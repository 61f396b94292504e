"""Byte patterns routed to the contents that may hold them, whatever the number of patterns.

A pattern stands in an index under one gram, a run of 8, 4, 3, 2 or 1 of its bytes (the longest that fits), and
of all its grams under the one that is least common among the patterns. A content gives out only those of its
grams that some pattern asks for; bit maps of a fixed size tell which.
An equality join on (image, gram) then pairs contents with patterns, and the pairs are verified on the bytes. An
index of a bounded size (it is checked) travels with the tasks instead, and contents are not shuffled at all.

A form is known by its text and the image it is for: patterns of the same two are looked for once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import scratch_table, written

# Lengths of grams, and what keeps grams of different lengths apart (a clash only costs a verification).
SIZES = (8, 4, 3, 2, 1)
_TAG = {8: 0, 4: 4 << 40, 3: 3 << 40, 2: 2 << 40, 1: 1 << 40}
# A byte of a content is first looked up in a small table for its size of grams, then, if that lets it through, in
# a bit map for all sizes. Both have a fixed size, whatever the number of patterns.
FIRST_BITS, SECOND_BITS = 20, 26
SKETCH_BITS = 16
# Forms of up to so many bytes in all travel with the tasks.
LOCAL_BYTES = 64 << 20
# Bytes of a form's numbers in such a table.
FORM_BYTES = 32
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
# Bytes of contents whose grams are in memory at once, about 60 bytes for each.
RUN = 1 << 17
# A gram that occurs more often in a run of a content pairs it with the gram's forms unseen.
MOST_PLACES = 16
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def fold(content: bytes, case_sensitive: bool) -> bytes:
    """A-Z folded, all other bytes as they are."""
    return content if case_sensitive else content.lower()


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The gram that starts at each byte of a contiguous array, as 64-bit words."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size == 3:
        found = data[:n].astype(np.uint64) | data[1 : n + 1].astype(np.uint64) << np.uint64(8) | data[2 : n + 2].astype(np.uint64) << np.uint64(16)
    else:
        found = np.ndarray((n,), f"<u{size}", data, 0, (1,)).astype(np.uint64)
    return found | np.uint64(_TAG[size])


def _grams_at(data: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """`grams` at some places only."""
    if size == 3:
        found = sum(data[places + i].astype(np.uint64) << np.uint64(8 * i) for i in range(3))
    else:
        found = np.ndarray((max(len(data) - size + 1, 0),), f"<u{size}", data, 0, (1,))[places].astype(np.uint64)
    return found | np.uint64(_TAG[size])


def _hashed(codes: np.ndarray, factor: int, bits: int) -> np.ndarray:
    return ((codes * np.uint64(_FACTORS[factor])) >> np.uint64(64 - bits)).view(np.int64)


def _grams_of(forms: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, forms, grams): for each size of grams the numbers of its forms and all their grams, in the order of the forms."""
    lengths = np.array([len(f) for f in forms], np.int64)
    bounds = np.array(SIZES)
    sizes = bounds[np.searchsorted(-bounds, -lengths)]
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        data = np.frombuffer(b"".join(forms[i] for i in of), np.uint8)
        ends = np.cumsum(lengths[of])
        owner = np.repeat(np.arange(len(of)), lengths[of])[: len(data) - size + 1]
        whole = np.arange(len(owner)) + size <= ends[owner]
        yield size, of[owner[whole]], grams(data, size)[whole]


def _counted(forms: list[bytes]) -> np.ndarray:
    """How often grams of each hash bucket occur in some forms."""
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for _, _, codes in _grams_of(forms):
        total += np.bincount(_hashed(codes, 2, SKETCH_BITS), minlength=len(total))
    return total


def _least_common(forms: list[bytes], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each form whose bucket has the smallest count, and its size."""
    chosen, sizes = np.zeros(len(forms), np.uint64), np.zeros(len(forms), np.int64)
    for size, owner, codes in _grams_of(forms):
        order = np.lexsort((common[_hashed(codes, 2, SKETCH_BITS)], owner))
        owner, codes = owner[order], codes[order]
        first = np.append(True, owner[1:] != owner[:-1])
        chosen[owner[first]], sizes[owner[first]] = codes[first], size
    return chosen, sizes


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        total += _counted(batch.column(0).to_pylist())
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])


def index_of(forms: DataFrame, most_bytes: int) -> PatternTable | PatternIndex:
    """An index of `forms` (text, image, form; `form` binary and not empty).

    Forms of up to `most_bytes` in all (LOCAL_BYTES in practice) travel with the tasks, more stay a table.
    """
    return PatternTable(forms.select("text", "image", "form").toArrow()) if bytes_of(forms) <= most_bytes else PatternIndex(forms)


def bytes_of(forms: DataFrame) -> int:
    """Bytes that forms take in a table that travels with the tasks."""
    each = F.octet_length("form") + F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + FORM_BYTES
    return forms.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def _first_table(codes: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << FIRST_BITS, bool)
    table[_hashed(codes, 0, FIRST_BITS)] = True
    return table


def _bit_map(codes: np.ndarray) -> np.ndarray:
    bits = _hashed(codes, 1, SECOND_BITS)
    table = np.zeros(1 << (SECOND_BITS - 3), np.uint8)
    np.bitwise_or.at(table, bits >> 3, np.left_shift(1, bits & 7).astype(np.uint8))
    return table


def _in_bit_map(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    bits = _hashed(codes, 1, SECOND_BITS)
    return ((table[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).astype(bool)


class PatternTable:
    """Forms that travel with the tasks, as a few arrays: a content is looked through and verified in one pass."""

    def __init__(self, forms: pa.Table):
        each = forms.column("form").to_pylist()
        self.longest = max(map(len, each), default=0)
        codes, sizes = _least_common(each, _counted(each))
        order = np.argsort(codes, kind="stable")
        self.codes, self.sizes = codes[order], sizes[order].astype(np.int8)
        each = [each[i] for i in order.tolist()]
        self.bytes, self.ends = b"".join(each), np.cumsum([0, *map(len, each)])
        # Where the gram stands in the form, and the form's first and last grams of that size.
        grams_of = ((int(c) & ((1 << 8 * int(s)) - 1)).to_bytes(int(s), "little") for c, s in zip(self.codes, self.sizes, strict=True))
        self.at = np.array([f.find(g) for f, g in zip(each, grams_of, strict=True)], np.int64)
        self.heads, self.tails = np.zeros(len(each), np.uint64), np.zeros(len(each), np.uint64)
        data = np.frombuffer(self.bytes, np.uint8)
        for size in np.unique(self.sizes).tolist():
            of = np.flatnonzero(self.sizes == size)
            self.heads[of] = _grams_at(data, self.ends[of], size)
            self.tails[of] = _grams_at(data, self.ends[of + 1] - size, size)
        taken = pa.array(order)
        self.texts, self.images = (forms.column(c).combine_chunks().take(taken) for c in ("text", "image"))

    def __len__(self) -> int:
        return len(self.codes)

    def form(self, i: int) -> bytes:
        return self.bytes[self.ends[i] : self.ends[i + 1]]

    def _placed(self, case_sensitive: bool):
        """A function from (data, offsets, images) to where forms may stand: (size, data folded, contents, forms, begins, often).

        The gram of each of these forms stands in its place. Where `often` is set the places are left out, and any of the
        content may be meant.
        """
        tables = {s: _first_table(self.codes[self.sizes == s]) for s in np.unique(self.sizes).tolist()}
        known, begins = np.unique(self.codes, return_index=True)
        counts = np.diff(np.append(begins, len(self.codes)))
        second = _bit_map(known)
        scopes = {image: i for i, image in enumerate(self.images.unique().to_pylist())}
        scope_of = np.array([scopes[i] for i in self.images.to_pylist()], np.int64)
        everywhere = scopes.get(None, -1)

        def asked(codes: np.ndarray) -> np.ndarray:
            found = _in_bit_map(second, codes)
            found[found] = known[np.minimum(np.searchsorted(known, codes[found]), len(known) - 1)] == codes[found]
            return found

        lengths = np.diff(self.ends)

        def placed(data: np.ndarray, offsets: np.ndarray, images: list) -> Iterator[tuple]:
            folded = np.ascontiguousarray(data if case_sensitive else _FOLD[data])
            own = np.array([-1 if i is None else scopes.get(i, -1) for i in images], np.int64)
            for size, owner, codes, at, new in _places_in(data, offsets, tables, asked, case_sensitive):
                group = np.cumsum(new) - 1
                often = np.bincount(group)[group] > MOST_PLACES
                taken = new | ~often
                owner, at, often, place = owner[taken], at[taken], often[taken], np.searchsorted(known, codes[taken])
                n = counts[place]
                form = np.repeat(begins[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
                owner, begin, often = np.repeat(owner, n), np.repeat(at, n) - self.at[form], np.repeat(often, n)
                fits = (scope_of[form] == everywhere) | (scope_of[form] == own[owner])
                fits &= often | ((begin >= offsets[owner]) & (begin + lengths[form] <= offsets[owner + 1]))
                yield size, folded, owner[fits], form[fits], begin[fits], often[fits]

        return placed

    def _ends_fit(self, size: int, folded: np.ndarray, form: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Whether the first and last grams of forms stand where the forms would."""
        same = _grams_at(folded, begin, size) == self.heads[form]
        return same & (_grams_at(folded, begin + np.diff(self.ends)[form] - size, size) == self.tails[form])

    def matcher(self, case_sensitive: bool):
        """A function from (data, offsets, images) to pairs (content, numbers of the forms it may hold)."""
        placed = self._placed(case_sensitive)

        def pairs(data: np.ndarray, offsets: np.ndarray, images: list) -> Iterator[tuple[int, np.ndarray]]:
            met = [np.zeros(0, np.int64)]
            for size, folded, owner, form, begin, often in placed(data, offsets, images):
                seen = np.flatnonzero(~often)
                often[seen] = self._ends_fit(size, folded, form[seen], begin[seen])
                met.append(np.unique(owner[often] * len(self) + form[often]))
            content, form = np.divmod(np.unique(np.concatenate(met)), len(self))
            starts = np.flatnonzero(np.append(True, content[1:] != content[:-1])) if len(content) else content
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(content)], strict=False):
                yield int(content[at]), form[at:end]

        return pairs

    def finder(self, case_sensitive: bool):
        """A function from (data, offsets, images) to the contents and the forms that they hold, as two arrays, each pair once.

        Forms are compared in their places, a gram at a time for all of them; only those of grams that stand too often are
        looked for one by one.
        """
        placed, lengths, own = self._placed(case_sensitive), np.diff(self.ends), np.frombuffer(self.bytes, np.uint8)

        def finds(data: np.ndarray, offsets: np.ndarray, images: list) -> tuple[np.ndarray, np.ndarray]:
            met, unseen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size, folded, owner, form, begin, often in placed(data, offsets, images):
                unseen.append(np.unique(owner[often] * len(self) + form[often]))
                owner, form, begin = owner[~often], form[~often], begin[~often]
                left = np.flatnonzero(self._ends_fit(size, folded, form, begin))
                at = size
                while len(left):
                    done = lengths[form[left]] <= at + size
                    met.append(owner[left[done]] * len(self) + form[left[done]])
                    left = left[~done]
                    same = _grams_at(folded, begin[left] + at, size) == _grams_at(own, self.ends[form[left]] + at, size)
                    left, at = left[same], at + size
            found = np.unique(np.concatenate(met))
            whole, last = b"", -1
            also = []
            for pair in np.setdiff1d(np.concatenate(unseen), found).tolist():
                content, form = divmod(pair, len(self))
                if content != last:
                    whole, last = fold(data[offsets[content] : offsets[content + 1]].tobytes(), case_sensitive), content
                if self.form(form) in whole:
                    also.append(pair)
            return np.divmod(np.union1d(found, np.array(also, np.int64)), len(self))

        return finds


class PatternIndex:
    """Forms as a written table of their columns and `gram`, met by joins."""

    def __init__(self, forms: DataFrame):
        spark = forms.sparkSession
        summed = forms.select("form").mapInArrow(_sketch, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        # At most 65,536 counters, whatever the number of patterns.
        common = np.zeros(1 << SKETCH_BITS, np.int64)
        common[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
        schema = T.StructType([*forms.schema.fields])
        schema = schema.add("gram", T.LongType()).add("size", T.IntegerType()).add("first", T.IntegerType()).add("second", T.IntegerType())

        def least_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                forms = batch.column("form").to_pylist()
                codes, sizes = _least_common(forms, common)
                sizes = pa.array(sizes.astype(np.int32))
                hashed = [pa.array(_hashed(codes, f, bits).astype(np.int32)) for f, bits in ((0, FIRST_BITS), (1, SECOND_BITS))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.view(np.int64)), sizes, *hashed], names=schema.names)

        index = written(forms.mapInArrow(least_common, schema), scratch_table(spark, "pattern-index"))
        self.table = index.select("text", "image", "form", "gram")
        # Bytes of the bit maps that are not zero: two for each pattern at most, and never more than 9 MB. The bit map
        # for all sizes has size 0 here.
        marks = F.explode(F.array(F.struct("size", F.col("first").alias("bit")), F.struct(F.lit(0).alias("size"), F.col("second").alias("bit"))))
        words = (
            index.select(marks.alias("mark"), F.octet_length("form").alias("length"))
            .groupBy("mark.size", F.shiftright("mark.bit", 3).alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1, mark.bit % 8)")).alias("byte"), F.max("length").alias("longest"))
            .toArrow()
        )
        size, at, byte = (words.column(c).to_numpy() for c in ("size", "at", "byte"))
        self._maps = {int(s): (at[size == s], byte[size == s].astype(np.uint8)) for s in np.unique(size)}
        self.longest = max(words.column("longest").to_pylist(), default=0)

    def candidates(self, contents: DataFrame, case_sensitive: bool) -> DataFrame:
        """key, image, text, scope and form, for each content (key, image, content) and form that share a gram.

        `scope` is the form's own image. A pattern whose `image` is null is for all images. `key` should tell contents apart: rows of the same
        key and image count as one content.
        """
        maps = self._maps

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = {}
            for size, (at, values) in maps.items():
                tables[size] = np.zeros(1 << ((FIRST_BITS if size else SECOND_BITS) - 3), np.uint8)
                tables[size][at] = values
            second = tables.pop(0, None)
            tables = {size: np.unpackbits(t, bitorder="little").view(bool) for size, t in tables.items()}

            def passes(codes: np.ndarray) -> np.ndarray:
                return _in_bit_map(second, codes)

            for batch in batches:
                if not batch.num_rows:
                    continue
                data, offsets = buffer(batch.column(2))
                for owner, codes in _asked_in(data, offsets, tables, passes, case_sensitive):
                    taken = pa.array(owner)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(codes.view(np.int64))], names=["key", "image", "gram"]
                    )

        found = contents.select("key", "image", "content").mapInArrow(asked, "key binary, image string, gram bigint")
        # Each gram asks for the patterns of its own image and for those of all images.
        scopes = F.array(F.struct(F.lit(None).cast("string").alias("only")), F.struct(F.col("image").alias("only")))
        each = found.select("key", "image", "gram", F.explode(F.array_distinct(scopes)).alias("scope")).select("key", "image", "gram", "scope.only")
        index = self.table.withColumnsRenamed({"image": "scope", "gram": "_gram"})
        # A gram at several places of one content is given out once for each run of it.
        met = each.distinct().join(index, (F.col("gram") == F.col("_gram")) & F.col("only").eqNullSafe(F.col("scope")))
        return met.select("key", "image", "text", "scope", "form")


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all contents of a column and their offsets; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _places_in(
    data: np.ndarray, offsets: np.ndarray, tables: dict[int, np.ndarray], passes: Callable, case_sensitive: bool
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, contents, grams, places, new) of the grams that the first tables and `passes` let through, run by run.

    They are ordered by content and gram; `new` marks the first place of each. A run takes in what its grams need
    beyond its end.
    """
    for first in range(0, len(data), RUN):
        last = min(len(data), first + RUN)
        part = data[first : min(len(data), last + max(SIZES) - 1)]
        part = np.ascontiguousarray(part if case_sensitive else _FOLD[part])
        for size in tables:
            codes = grams(part, size)[: last - first]
            at = np.flatnonzero(tables[size][_hashed(codes, 0, FIRST_BITS)])
            found = codes[at]
            owner = np.searchsorted(offsets, at + first, "right") - 1
            asked = passes(found) & (at + first + size <= offsets[owner + 1])
            owner, found, at = owner[asked], found[asked], at[asked] + first
            if not len(owner):
                continue
            order = np.lexsort((found, owner))
            owner, found, at = owner[order], found[order], at[order]
            new = np.ones(len(order), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
            yield size, owner, found, at, new


def _asked_in(*args) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (content, gram) of `_places_in`."""
    for _, owner, found, _, new in _places_in(*args):
        yield owner[new], found[new]


def content_key(content: Column) -> Column:
    """A digest of the content: equal contents are looked through alike."""
    return F.unhex(F.sha2(content, 256))


def has_border(form: bytes) -> bool:
    """Whether occurrences of `form` can overlap: some beginning of it is also an end."""
    longest = [0] * len(form)
    at = 0
    for i in range(1, len(form)):
        while at and form[i] != form[at]:
            at = longest[at - 1]
        at += form[i] == form[at]
        longest[i] = at
    return at > 0


def starts_of(data: bytes, form: bytes) -> np.ndarray:
    """All places of `form`, overlapping ones too."""
    found, at = [], data.find(form)
    while at >= 0:
        found.append(at)
        at = data.find(form, at + 1)
    return np.array(found, np.int64)


def steps(starts: np.ndarray, length: int, entry: int) -> list[tuple[int, int, int]]:
    """What a scan for the next free occurrence does here, by the place from which it is free.

    Of (start, count, free): a scan that is free from a place up to `start`, and beyond the `start` before, counts
    `count` occurrences and is then free from `free`. Only places up to `entry` can come in.
    """
    n = len(starts)
    following = np.searchsorted(starts, starts + length)
    count, free = np.ones(n, np.int64), starts + length
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            count[i] += count[following[i]]
            free[i] = free[following[i]]
    return [(int(starts[i]), int(count[i]), int(free[i])) for i in range(n) if i == 0 or starts[i - 1] < entry]
