"""Near-duplicate documents by MinHash, banding and connected components.

1. Sketch: every document's word shingles are hashed and put through many multiply-add hashes; the minima
   are the signature. Bands of `ROWS` minima become bucket keys.
2. Documents with the same words are one class and only its smallest id goes on.
3. Shared shingles: how many shingles of a document occur in any other document that is in a bucket. The
   intersection of two sets is at most that number of either, which rules out most pairs of a group of
   copies with many edits each before they are formed, and loses none that links.
4. Star pairs: each member of a bucket with the bucket's pivot, the member with the smallest share of
   shingles of its own. Pairs pass the signature check and are then confirmed on the full shingle sets.
5. Components of the confirmed links by alternating large-star and small-star.
6. Rest pairs: in buckets whose members are still in different components, all pairs across components
   are checked in the same way. So no link that a bucket shows is lost, although members of one component
   are not paired with each other.

With 48 bands of 5, two documents at the threshold of 0.75 share no bucket with probability 2e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, SPACE, mix, scratch, text_buffer, text_chunks, word_hashes, word_spans

SHINGLE_WORDS, PERCENT = 5, 75
ROWS, BANDS = 5, 48
HASHES = ROWS * BANDS
CHUNK = 1 << 20
# Slices of the hash space in which shared shingles are counted.
SLICES = 32
# A pair goes on if this many minima agree: five standard deviations below what is expected at the threshold.
LEAST_AGREEING = int(HASHES * 0.75 - 5 * (HASHES * 0.75 * 0.25) ** 0.5)

_ODD = np.uint64(0xD6E8FEB86659FD93)


def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    drawn = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    drawn = (drawn >> np.uint64(32)).astype(np.uint32)
    return drawn[:HASHES] | np.uint32(1), drawn[HASHES:]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (white space and ASCII case do not matter).

    A text with fewer words than a shingle has its whole word sequence as one; without words the set is empty.
    """
    data = LOWER_ASCII[data]
    starts, ends, text_of = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    firsts = np.searchsorted(text_of, np.arange(len(offsets)))
    n = len(hashes) - SHINGLE_WORDS + 1
    rolled = np.zeros(max(0, n), np.uint64)
    for j in range(SHINGLE_WORDS):
        if n > 0:
            rolled = rolled * _ODD + hashes[j : j + n]
    rolled = mix(rolled)
    sets = []
    for first, last in zip(firsts[:-1], firsts[1:], strict=True):
        if last - first >= SHINGLE_WORDS:
            sets.append(np.unique(rolled[first : last - SHINGLE_WORDS + 1]))
        elif last > first:
            whole = np.full(1, last - first, np.uint64)
            for h in hashes[first:last]:
                whole = mix(whole * _ODD + h)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def word_digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Digests of the word sequences, ASCII case folded."""
    space = SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    squeezed = np.where(space, np.uint8(0x20), LOWER_ASCII[data])[keep].tobytes()
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return [
        hashlib.blake2b(squeezed[a:b].strip(b" "), digest_size=16).digest()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
    ]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of all hashes for each non-empty set: one row for each hash."""
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    values = (values >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    factors, terms = _hash_family()
    out = np.empty((HASHES, len(sets)), np.uint32)
    hashed = np.empty(len(values), np.uint32)
    for i in range(HASHES):
        np.multiply(values, factors[i], out=hashed)
        np.add(hashed, terms[i], out=hashed)
        np.minimum.reduceat(hashed, starts, out=out[i])
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band (rows of the result: documents)."""
    keys = np.empty((minima.shape[1], BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(minima.shape[1], band + 1, np.uint64)
        for row in minima[band * ROWS : (band + 1) * ROWS]:
            key = mix(key * _ODD + row.astype(np.uint64))
        keys[:, band] = key
    return keys.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for first, last in text_chunks(offsets, CHUNK):
            own = offsets[first : last + 1]
            part, own = data[own[0] : own[-1]], own - own[0]
            sets = shingle_sets(part, own)
            full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            lists = np.zeros(len(sets) + 1, np.int32)
            lists[full + 1] = BANDS
            checks: list = [None] * len(sets)
            keys = np.zeros(0, np.int64)
            if len(full):
                minima = signatures([sets[i] for i in full])
                keys = band_keys(minima).ravel()
                low = np.ascontiguousarray((minima & np.uint32(0xFF)).astype(np.uint8).T)
                for row, i in enumerate(full):
                    checks[i] = low[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array(word_digests(part, own), pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(lists, dtype=np.int32)), pa.array(keys)),
                    pa.array(checks, pa.binary()),
                ],
                names=["doc_id", "digest", "n_shingles", "keys", "minima"],
            )


SKETCH_SCHEMA = "doc_id bigint, digest binary, n_shingles bigint, keys array<bigint>, minima binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for first, last in text_chunks(offsets, CHUNK):
            own = offsets[first : last + 1]
            sets = shingle_sets(data[own[0] : own[-1]], own - own[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), _lists(sets)],
                names=["doc_id", "shingles"],
            )


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))


def _signature_check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
        agree = (left == right).sum(axis=1) >= LEAST_AGREEING
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(agree))


def _set_check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for i in range(batch.num_rows):
            x, y = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))


def confirm(pairs: DataFrame, sketch: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the threshold, as a written table."""
    minima = sketch.select("doc_id", "minima").filter("minima is not null")
    for side in ("a", "b"):
        pairs = pairs.join(minima.select(F.col("doc_id").alias(side), F.col("minima").alias(f"minima_{side}")), side)
    checked = pairs.select("a", "b", "minima_a", "minima_b").mapInArrow(_signature_check, "a bigint, b bigint")
    likely = scratch(checked, "likely-pairs")
    for side in ("a", "b"):
        likely = likely.join(sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    linked = likely.select("a", "b", "set_a", "set_b").mapInArrow(_set_check, "a bigint, b bigint")
    return scratch(linked.distinct(), "links")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """doc_id, size (of the set) and shared (by slice of the hash space, the number of shingles that another row has).

    Only documents with which a link is possible at all.
    """
    each = sets.select("doc_id", F.explode("shingles").alias("shingle"))
    twice = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shingle")
    part = F.pmod("shingle", F.lit(SLICES))
    counts = [F.count_if(part == i).cast("int") for i in range(SLICES)]
    shared = each.join(twice, "shingle", "left_semi").groupBy("doc_id").agg(F.array(*counts).alias("shared"))
    sizes = sets.select("doc_id", F.size("shingles").alias("size"))
    return sizes.join(shared, "doc_id").filter(f"100 * {_sum('shared')} >= {PERCENT} * size")


def _sum(counts: str) -> str:
    return f"aggregate({counts}, 0, (total, n) -> total + n)"


def _possible(a: str, b: str) -> str:
    """Whether the intersection can be as large as the threshold asks: in each slice it is at most what either side shares."""
    common = _sum(f"zip_with({a}.shared, {b}.shared, (m, n) -> least(m, n))")
    return f"{100 + PERCENT} * {common} >= {PERCENT} * ({a}.size + {b}.size)"


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its smallest node.

    Edges (a, b) may be in any direction and repeated. Each round is a written table, so that a lost
    executor never repeats the rounds before; the rounds end when the edges do not change.
    """
    mark = None
    while True:
        edges = scratch(_small_star(_large_star(edges)), "star-edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Links: 5-word shingle sets with 100 * intersection >= 75 * union. `component_id` is the smallest doc_id
    reachable over links, `kept` tells whether it is the document's own. Null, empty and wordless texts have
    no shingles and link with nothing. Rows that share a doc_id count as one document with several texts.
    A null doc_id is linked with nothing: its component is null and it is kept. An empty table gives no
    rows. Other columns are not read.
    """
    sketch = scratch(docs.select("doc_id", "text").mapInArrow(_sketch, SKETCH_SCHEMA), "sketch")
    named = sketch.filter("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("representative"))
    alone = named.join(classes.select(F.col("representative").alias("doc_id")).distinct(), "doc_id", "left_semi")
    keys = scratch(alone.select("doc_id", F.explode("keys").alias("key")), "band-keys")
    crowded = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    members = scratch(keys.join(crowded.filter("first != last").select("key"), "key"), "bucket-members")

    ids = members.select("doc_id").distinct()
    needed = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    sets = scratch(needed.mapInArrow(_sets, "doc_id bigint, shingles array<bigint>"), "shingle-sets")
    bounds = shared_shingles(sets).select("doc_id", F.struct("doc_id", "size", "shared").alias("bound"))
    members = scratch(members.join(bounds, "doc_id").select("key", "bound"), "possible-members")

    own = (F.col("bound.size") - F.expr(_sum("bound.shared"))) / F.col("bound.size")
    pivots = members.groupBy("key").agg(F.min(F.struct(own, "bound")).alias("least"))
    pivots = pivots.select("key", F.col("least.bound").alias("pivot"))
    ends = F.least("bound.doc_id", "pivot.doc_id").alias("a"), F.greatest("bound.doc_id", "pivot.doc_id").alias("b")
    stars = members.join(pivots, "key").filter("bound.doc_id != pivot.doc_id").filter(_possible("bound", "pivot"))
    stars = scratch(stars.select(*ends).distinct(), "star-pairs")
    links = confirm(stars, sketch, sets)
    components = connected_components(links)

    placed = members.join(components, F.col("bound.doc_id") == components["node"], "left").select(
        "key", "bound", F.coalesce("component", "bound.doc_id").alias("component")
    )
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rest = scratch(placed.join(mixed.filter("low != high").select("key"), "key"), "mixed-buckets")
    left = rest.select("key", F.col("bound").alias("x"), F.col("component").alias("component_x"))
    right = rest.select("key", F.col("bound").alias("y"), F.col("component").alias("component_y"))
    across = (
        left.join(right, "key")
        .filter("x.doc_id < y.doc_id and component_x != component_y")
        .filter(_possible("x", "y"))
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    more = confirm(across, sketch, sets)
    if not more.isEmpty():
        components = connected_components(links.unionByName(more))

    own = sketch.select("doc_id", "digest", "n_shingles")
    found = own.join(classes, "digest", "left").join(
        components, F.col("representative") == components["node"], "left"
    )
    component = F.when(
        F.col("doc_id").isNotNull(),
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "representative")).otherwise(F.col("doc_id")),
    )
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
