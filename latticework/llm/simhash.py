"""SimHash near-duplicates through segment popcounts.

A 64-bit fingerprint maps to 32 counts, one per 2-bit segment.  The Manhattan distance of two such vectors is at most the
Hamming distance of the fingerprints, so linked fingerprints lie within ``radius`` of each other in that space.  The grid: the
32 segments are dealt to 8 axes of 4 segments, and a cell is the counts on 4 of the 8 axes.  Two vectors within a distance of 4
differ on at most 4 axes, so they share a cell of at least one of the 70 choices of axes: joining on cells finds every candidate,
the Manhattan distance drops most others, and the Hamming distance decides.  More axes make smaller cells and more of them: 10
axes (210 cells of some 29 bits each) suit tens of billions of fingerprints.

Only distinct fingerprints enter the grid, so exact copies cost one row.  A cell's candidates are compared block by block inside
a task, and a task reports a spanning forest of the links it found, never all pairs of a group; cells that hold more than
``cell_limit`` fingerprints are first dealt out as pairs of chunks, so that no task compares one whole.  Components come from
rounds of star contraction over those forests, checkpointed as they go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.operators.network import components

from . import text as tx
from .common import cut, free_name, join_hot, table

SEGMENTS = 32
_PAIRS = np.uint64(0x5555555555555555)
COMPARE_BLOCK = 2048


def cell_masks(axes: int, radius: int) -> list[int]:
    """For each choice of axes - radius axes, the bits of their segments; the axes share the segments out evenly."""
    edges = [SEGMENTS * a // axes for a in range(axes + 1)]
    axis = [sum(3 << (2 * s) for s in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(axis[a] for a in chosen) for chosen in combinations(range(axes), axes - radius)]


def fingerprints(texts: pa.Array, shingle: int = 4) -> np.ndarray:
    """Fingerprints of whole texts: a bit is set if over half the shingles' hashes have it."""
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=42)
    out = []
    for piece in tx.pieces(texts):
        data = tx.LOWER[piece.data]
        w = tx.words(piece, tx.SPACE_FREE)
        text, begin, end = tx.joined(data, w)
        raw, begins, stops, bounds = text.tobytes(), begin.tolist(), end.tolist(), w.bounds.tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                out.append(0)
                continue
            last = max(a + 1, b - shingle + 1)
            total = np.zeros(64, np.int64)
            for at in range(a, last, 65536):
                to = min(last, at + 65536)
                stop = stops[b - 1 : b] if b - a < shingle else stops[at + shingle - 1 : to + shingle - 1]
                h = np.fromiter((digest(raw[s:e]) for s, e in zip(begins[at:to], stop, strict=True)), np.uint64, to - at)
                total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            bits = total * 2 > last - a
            out.append(int(np.packbits(bits, bitorder="little").view(np.uint64)[0]))
    return np.array(out, np.uint64)


def _add_fingerprint(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fingerprints(batch.column(1), shingle).view(np.int64))], names=["id", "text_hash", "fp"])

    return run


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The 32 counts of set bits per 2-bit segment, packed two bits each."""
    return (fp & _PAIRS) + ((fp >> np.uint64(1)) & _PAIRS)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed counts, without unpacking: per segment the larger less the smaller, which are 0, 1 or 2."""
    ahi, alo, bhi, blo = (a >> np.uint64(1)) & _PAIRS, a & _PAIRS, (b >> np.uint64(1)) & _PAIRS, b & _PAIRS
    two = (ahi & ~(bhi | blo)) | (bhi & ~(ahi | alo))
    one = ((ahi ^ bhi) | (alo ^ blo)) & ~two & _PAIRS
    return np.bitwise_count(one) + 2 * np.bitwise_count(two & _PAIRS)


def _linked(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    near = manhattan(segment_counts(a), segment_counts(b)) <= radius
    return near & (np.bitwise_count(a ^ b) <= radius)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links a-b: each member with its component's smallest."""
    if not len(a):
        return a, b
    names, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(step := new[new], new):
            new = step
        if np.array_equal(new, root):
            break
        root = new
    member = np.flatnonzero(root != np.arange(len(names)))
    return names[member], names[root[member]]


def _cells(masks: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            counts = segment_counts(fp)
            for k, mask in enumerate(masks):
                cell = tx.mix((counts & np.uint64(mask)) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp.view(np.int64))], names=["cell", "fp"])

    return run


def _compare(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by cell: links inside each cell, as a forest per some thousands of rows."""

    def links(cell: np.ndarray, fp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """side: 0 and 1 mark the two chunks of a hot cell (only pairs across count), 2 rows of a whole cell."""
        a, b = [], []
        n = len(cell)
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.concatenate([edge, [n]]))
        small = np.repeat((size > 1) & (size <= 64), size)
        index = np.flatnonzero(small)
        for d in range(1, int(size[size <= 64].max(initial=1))):
            index = index[index + d < n]
            index = index[cell[index] == cell[index + d]]
            if not len(index):
                break
            x, y = fp[index], fp[index + d]
            ok = _linked(x, y, radius) & ((side[index] == 2) | (side[index] != side[index + d]))
            a.append(x[ok])
            b.append(y[ok])
        for s, m in zip(edge[size > 64].tolist(), size[size > 64].tolist(), strict=True):
            for i in range(s, s + m, COMPARE_BLOCK):
                x = fp[i : min(i + COMPARE_BLOCK, s + m)]
                for j in range(i, s + m, COMPARE_BLOCK):
                    y = fp[j : min(j + COMPARE_BLOCK, s + m)]
                    p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
                    ok = (x[p] != y[q]) & _linked(x[p], y[q], radius)
                    u, v = forest(x[p[ok]], y[q[ok]])
                    a.append(u)
                    b.append(v)
        return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def take(parts: list[np.ndarray]) -> None:
            nonlocal a, b
            x, y = links(*parts)
            a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            parts = [np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False).view(k.dtype)]) for i, k in enumerate(kept)]
            ended = np.flatnonzero(parts[0] != parts[0][-1])
            whole = int(ended[-1]) + 1 if len(ended) else 0
            if whole:
                take([p[:whole] for p in parts])
            kept = [p[whole:] for p in parts]
            if len(a) > 200_000:
                yield flush()
                a, b = a[:0], b[:0]
        if len(kept[0]):
            take(kept)
        yield flush()

    return run


def links(distinct: DataFrame, radius: int = 4, axes: int = 8, cell_limit: int = 20_000) -> DataFrame:
    """Links a-b that connect all distinct fingerprints (column fp) within ``radius`` bits; a forest per task, not all pairs."""
    if axes <= radius:
        raise ValueError("the grid needs more axes than the radius has bits")
    cells = distinct.select("fp").mapInArrow(_cells(cell_masks(axes, radius)), "cell long, fp long")
    crowded = cut(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_limit).select("cell", F.ceil(F.col("n") / F.lit(cell_limit)).cast("int").alias("chunks")))
    n_crowded = crowded.count()
    whole = F.lit(2).cast("long").alias("side")
    if not n_crowded:
        ready = cells.select("cell", "fp", whole)
    else:
        dealt = cells.join(F.broadcast(crowded) if n_crowded <= 50_000 else crowded, "cell", "left")
        chunk = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("chunks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")
        hot = dealt.filter(F.col("chunks").isNotNull()).select("cell", "fp", chunk.alias("c"), other)
        side = F.when(F.col("c") == F.col("o"), 2).when(F.col("c") < F.col("o"), 0).otherwise(1).cast("long").alias("side")
        hot = hot.select(F.xxhash64("cell", F.least("c", "o"), F.greatest("c", "o")).alias("cell"), "fp", side)
        ready = dealt.filter(F.col("chunks").isNull()).select("cell", "fp", whole).unionByName(hot)
    return ready.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint (16 hex digits), component_id (smallest id reachable), class_id (a bigint naming the component)
    and text_hash (xxhash64 of the text).

    Fingerprints within ``radius`` bits are linked.  Null and empty texts have fingerprint zero, linked like any other.  Repeated
    rows repeat in the result and share a component; a null id is kept, and is a component's id only where it has no other.  Texts are
    read whole, the shingles of a very long one in blocks; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    schema = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])
    marked = cut(own.mapInArrow(_add_fingerprint(shingle), schema))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = components(links(distinct, radius))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("class_id"))
    named = cut(named)
    smallest = cut(named.groupBy("class_id").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    by_fp = join_hot(named.select("fp", "class_id"), smallest, ["class_id"], "members", named.count()).drop("members")
    rows = marked.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"))
    out = join_hot(marked, by_fp.join(rows, "fp"), ["fp"], "rows", marked.count())
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_id", "text_hash")


def keep_smallest(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One document of each class_id of found (id, text_hash, class_id): the one with the smallest id (null last).

    Of rows with that id and that text one stays, the first by the hash of all its columns (maps as text), so reruns keep the same.
    """
    best = found.groupBy("class_id").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_hash")).alias("k"))
    key, hashed, rank = (free_name(docs, f"near_dup_{x}") for x in ("key", "hash", "rank"))
    rows = found.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("n"))
    best = best.select(F.col("k.id").alias(key), F.col("k.text_hash").alias(hashed))
    best = cut(best.join(rows, F.col(key).eqNullSafe(F.col("_id")) & (F.col(hashed) == F.col("_hash"))).select(key, hashed, "n"))
    own = docs.withColumn(rank, F.xxhash64(F.col(text_col).cast("string")))

    def kept(which: DataFrame) -> DataFrame:
        return own.join(which.select(key, hashed), F.col(id_col).eqNullSafe(F.col(key)) & (F.col(rank) == F.col(hashed)), "left_semi")

    out = kept(best.filter("n = 1")).select(*docs.columns)
    twice = best.filter("n > 1")
    if twice.isEmpty():
        return out
    whole = [F.to_json(F.struct(F.col(f.name))) if "map" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields]
    one = Window.partitionBy(id_col, rank).orderBy(F.xxhash64(*whole), F.xxhash64(F.lit(3), *whole))
    return out.unionByName(kept(twice).withColumn(key, F.row_number().over(one)).filter(F.col(key) == 1).select(*docs.columns))


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id (null last, of repeats of it one).

    Without ``similarity`` fingerprints within ``radius`` bits link.  With it they only propose: texts link if the Jaccard similarity of
    their shingle sets is that high, and pairs too far apart for fingerprints are found through set prefixes, so that none is lost.
    Null and empty texts are one component; an empty table gives an empty result; the working columns take names that docs doesn't have.
    """
    own = docs.select(id_col, text_col)
    if similarity is None:
        found = near_duplicates(own, shingle, radius, id_col, text_col)
    else:
        from .jaccard import similar_texts  # it builds on this module's grid

        found = similar_texts(own, shingle, similarity, id_col, text_col)
    return keep_smallest(docs, found, id_col, text_col)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
