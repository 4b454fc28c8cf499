"""Substring de-duplication with prefix-partitioned suffix trees.

Suffixes of the corpus are read from sampled places: the content-defined minimisers of every window of ``window`` words (equal
windows are sampled at equal places, so no repeat is missed, and about one suffix in 18 is kept).  Frequent runs of words, as a sketch
of the corpus counts them, are sampled only where a window has no other, so a common line or passage isn't met with all that stands
around it; a suffix' context is what the windows sampled there cover, so a passage is one context.  A suffix' first ``prefix`` words
decide its group.  Prefixes that only one document holds are dropped; equal contexts are merged before they travel.

Prefixes are of variable length: a group with more contexts than ``group_limit`` is split by longer ones, step by step.  A group
stands for the windows whose sampled place has lo to hi words before it in the window; these windows share all words from lo before
the place to window - hi after it, which is the group's prefix.  Halving the range lengthens the prefix: 16 words, then 33, 41, 45 and so
on to the whole window, where a subtree is a single node whose smallest document is a minimum.  Groups are gathered into trees of
bounded memory.  A tree is a sorted array of suffixes with the lengths of neighbours' common prefixes: its
internal nodes at a depth are the runs not broken by a shorter common prefix.  Two trees per group, over the words right and left of
the sampled place, give every repeated window as a pair of nodes whose depths sum to the window, with the smallest document that
holds it.  Exact copies of a text enter once, with their smallest document (they are equal in all windows): copies of a later document
lose every word that a window covers.

A run shuffles the texts twice, compressed (to cut contexts where prefixes repeat, and to write the result); all other shuffles carry
hashes, places and the contexts of repeated prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .common import HOT_KEYS, cut, join_hot, table
from .sketch import counter, hash_counts

#: Context bytes of one tree.
TREE_BYTES = 2 << 20
#: Occurrences from which a run of words is frequent.
FREQUENT = 64
NO_ID = 2**63 - 1
#: End of the range of a text that goes whole.
WHOLE = 2**31 - 1
PACKED = "id long, d1 long, packed binary"


def _sliding(a: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over each stretch of ``width`` values."""
    n, step = len(a) - width + 1, 1
    if n <= 0:
        return a[:0]
    while 2 * step <= width:
        a = best(a[:-step], a[step:])
        step *= 2
    return best(a[:n], a[width - step : width - step + n])


def _prefix_hashes(window: int, prefix: int) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """The hashes of all runs of ``prefix`` words of texts that have a window, by pieces."""

    def run(texts: pa.Array) -> Iterator[np.ndarray]:
        for piece in tx.pieces(texts):
            w = tx.words(piece, tx.SPACE_FREE)
            grams = tx.gram_hashes(tx.word_hashes(piece.data, w), prefix)
            counts = w.counts()
            yield grams[tx.ranges(w.bounds[:-1], np.where(counts >= window, counts - prefix + 1, 0))]

    return run


def frequent_prefixes(texts: DataFrame, window: int, prefix: int) -> np.ndarray:
    """A flag per counter of the sketch: it counts more than FREQUENT runs of words of the texts (id, text) beyond twice the mean."""
    counts = hash_counts(texts, _prefix_hashes(window, prefix))
    return counts > FREQUENT + 2 * counts.mean()


def sampled_suffixes(w: tx.Words, hashes: np.ndarray, window: int, prefix: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a piece where a suffix is sampled, the hashes of the suffixes' first ``prefix`` words, and how many words the windows
    that are sampled there have left and right of the place at most.

    A window is sampled at the lowest of its hashes; those whose counters are ``frequent`` come after all others."""
    grams = tx.gram_hashes(hashes, prefix)
    width = window - prefix + 1
    value = grams
    if frequent is not None:
        value = (grams >> np.uint64(1)) | (frequent[counter(grams)].astype(np.uint64) << np.uint64(63))
    lowest = _sliding(value, width, np.minimum)
    if not len(lowest):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(lowest))
    end = np.repeat(w.bounds[1:], w.counts())[: len(at)]
    lowest[at + window > end] = 0  # windows that cross the end of a text
    pad = np.zeros(width - 1, np.uint64)
    padded = np.concatenate([pad, lowest, pad])
    place = np.flatnonzero(_sliding(padded, width, np.maximum) == value)
    # Column o: the window with o words left of the place; those sampled there follow one another.
    own = padded[place[:, None] + np.arange(width - 1, -1, -1)[None, :]] == value[place][:, None]
    left, least = width - 1 - np.argmax(own[:, ::-1], axis=1), np.argmax(own, axis=1)
    return place, grams[place], left, window - least


def _sample(window: int, prefix: int, frequent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.pieces(batch.column(3)):
                w = tx.words(piece, tx.SPACE_FREE)
                place, key, left, right = sampled_suffixes(w, tx.word_hashes(piece.data, w), window, prefix, frequent.value)
                bounds = np.searchsorted(place, w.bounds).astype(np.int32)
                own = place - w.bounds[np.searchsorted(w.bounds, place, side="right") - 1]
                n = piece.last - piece.first
                spots = pa.array((own << 32) | (left << 16) | right)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(piece.first, n) for i in range(3)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(key.view(np.int64))), pa.ListArray.from_arrays(pa.array(bounds), spots)],
                    names=["id", "d1", "d2", "keys", "places"],
                )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, d1 and the compressed text: what travels between stages."""
    codec = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            texts = part.column(2).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([codec.compress(x) for x in texts], pa.binary())], names=["id", "d1", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, column ``at`` as text."""
    codec = zstandard.ZstdDecompressor()
    for batch in batches:
        for first in range(0, len(batch), 512):
            part = batch.slice(first, 512)
            texts = pa.array([codec.decompress(x) for x in part.column(at).to_pylist()], pa.large_binary()).cast(pa.large_string())
            yield part.set_column(at, part.schema.names[at], texts)


def _contexts(prefix: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches, 2):
            places = batch.column(3)
            for piece in tx.pieces(batch.column(2)):
                w = tx.words(piece, tx.SPACE_FREE)
                text, begin, end = tx.joined(piece.data, w)
                grams = tx.gram_hashes(tx.word_hashes(piece.data, w), prefix)
                raw = text.tobytes()
                own = places.slice(piece.first, piece.last - piece.first)
                doc = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
                spots = own.flatten().to_numpy(zero_copy_only=False)
                at = spots >> 32
                place = at + w.bounds[doc]
                low, high = place - ((spots >> 16) & 0xFFFF), place + (spots & 0xFFFF)
                for a in range(0, len(at), 4096):
                    s = slice(a, a + 4096)
                    take = pa.array(doc[s] + piece.first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(at[s], pa.int32()), pa.array(grams[place[s]].view(np.int64)), pa.array(place[s] - low[s], pa.int32()), pa.array([raw[x:y] for x, y in zip(begin[low[s]].tolist(), end[high[s] - 1].tolist(), strict=True)], pa.binary())],
                        names=["id", "d1", "place", "key", "n_left", "context"],
                    )

    return run


def _tree_nodes(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows (arrays of word hashes), and the common prefix in words of each with the one before."""
    n, width = suffixes.shape
    packed = np.ascontiguousarray(suffixes.astype(">u8")).view(np.dtype((np.void, 8 * width))).ravel()
    order = np.argsort(packed)
    ordered = suffixes[order]
    common = np.zeros(n, np.int64)
    common[1:] = np.cumprod(ordered[1:] == ordered[:-1], axis=1, dtype=np.int8).sum(axis=1)
    return order, common


def _nodes_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The node at ``depth`` above each suffix."""
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(common < depth)
    return node


def repeated_windows(contexts: list[bytes], n_left: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """Per context and offset (words of the window left of the sampled place, lo to hi) the smallest id that holds the window; NO_ID: none."""
    n, reach = len(contexts), window - prefix
    piece = next(tx.pieces(pa.array(contexts, pa.large_binary()).cast(pa.large_string()), 1 << 40))
    w = tx.words(piece, tx.SPACE_FREE)
    hashes = np.concatenate([tx.word_hashes(piece.data, w), np.zeros(1, np.uint64)])
    size = w.counts()
    n_right = size - n_left
    centre = w.bounds[:-1] + n_left

    def side(steps: np.ndarray, have: np.ndarray) -> np.ndarray:
        k = np.arange(len(steps))
        return hashes[np.where(k[None, :] < have[:, None], centre[:, None] + steps[None, :], len(hashes) - 1)]

    right = _tree_nodes(side(np.arange(window), n_right))
    left = _tree_nodes(side(-1 - np.arange(reach), n_left)) if reach else None
    best = np.full((n, reach + 1), NO_ID, np.int64)
    for offset in range(reach + 1):
        rows = np.flatnonzero((n_left >= offset) & (n_right >= window - offset) & (lo <= offset) & (offset <= hi))
        if not len(rows):
            continue
        node = _nodes_at(*right, window - offset)[rows] * (n + 1)
        if offset:
            node += _nodes_at(*left, offset)[rows]
        order = np.argsort(node, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]]))
        low = np.minimum.reduceat(ids[rows][order], edge)
        best[rows[order], offset] = np.repeat(low, np.diff(np.concatenate([edge, [len(rows)]])))
    return best


RUNS = "array<struct<low:int,high:int,first_id:long>>"
_RUN = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("first_id", pa.int64())]))


def _runs(best: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The rows that have runs of offsets with the same smallest id, where some holder has a larger one, and those runs."""
    n, width = best.shape
    flat = best.ravel()
    new = np.concatenate([np.ones((n, 1), bool), best[:, 1:] != best[:, :-1]], axis=1).ravel()
    start = np.flatnonzero(new)
    end = np.append(start[1:], flat.size)[: len(start)] - 1
    held = flat[start] < most[start // width]
    start, end = start[held], end[held]
    rows, counts = np.unique(start // width, return_counts=True)
    runs = pa.StructArray.from_arrays([pa.array(start % width, pa.int32()), pa.array(end % width, pa.int32()), pa.array(flat[start])], fields=list(_RUN.value_type))
    return rows, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), runs, type=_RUN)


def _grow_trees(window: int, prefix: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over contexts sorted by their group's prefix (columns of GROUPS): the runs of each."""

    def tree(rows: pa.Table) -> pa.RecordBatch:
        ids, most = (rows.column(k).to_numpy() for k in (3, 4))
        n_left, lo, hi = (rows.column(k).to_numpy().astype(np.int64) for k in (5, 9, 10))
        best = repeated_windows(rows.column(6).to_pylist(), n_left, ids, lo, hi, window, prefix)
        kept, found = _runs(best, most)
        take = pa.array(kept)
        return pa.RecordBatch.from_arrays([*(rows.column(k).combine_chunks().take(take) for k in range(3)), found], names=["key", "c1", "c2", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                kept.append(part)
                size += 500 * len(part)
                if size < TREE_BYTES:
                    continue
                rows = pa.Table.from_batches(kept)
                keys = rows.column(7).to_numpy()
                other = np.flatnonzero(keys != keys[-1])
                whole = int(other[-1]) + 1 if len(other) else 0
                if whole:
                    yield tree(rows.slice(0, whole))
                kept = rows.slice(whole).combine_chunks().to_batches()
                size = 500 * (len(rows) - whole)
        if kept:
            yield tree(pa.Table.from_batches(kept))

    return run


def _extend(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of GROUPS dealt to the two halves of their range, each with the hashes of that half's longer prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                n_left, lo, hi = (batch.column(k).to_numpy().astype(np.int64) for k in (5, 9, 10))
                piece = next(tx.pieces(batch.column(6).cast(pa.large_string()), 1 << 40))
                w = tx.words(piece, tx.SPACE_FREE)
                hashes = tx.word_hashes(piece.data, w)
                n_right = w.counts() - n_left
                middle = (lo + hi) // 2
                for first, last in ((lo, middle), (middle + 1, hi)):
                    for a, b in np.unique(np.stack([first, last], axis=1), axis=0).tolist():
                        rows = np.flatnonzero((first == a) & (last == b) & (n_left >= a) & (n_right >= window - b))
                        start = w.bounds[rows] + n_left[rows] - a
                        one, two = (tx.gram_hashes(hashes, window - b + a, kind)[start] if len(rows) else np.zeros(0, np.uint64) for kind in ("word", "word2"))
                        take = pa.array(rows)
                        ends = (pa.array(np.full(len(rows), x), pa.int32()) for x in (a, b))
                        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(7)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *ends], names=batch.schema.names)

    return run


#: A context in a group: its names and holders, the group's prefix (two hashes) and its range.
GROUPS = "key long, c1 long, c2 long, low_id long, high_id long, n_left int, context binary, part long, part2 long, lo int, hi int"
GROUP = ["part", "part2", "lo", "hi"]


def prefix_groups(distinct: DataFrame, sizes: DataFrame, window: int, prefix: int, group_limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of GROUPS with ``group_limit`` contexts a group at most, and tables (with n) of larger groups that hold one window each.

    sizes: key and n, the contexts of each.  Prefixes grow until no group is too large; every step halves the ranges, so a window of 50
    words takes six steps at most.
    """
    level = distinct.select("*", F.col("key").alias("part"), F.lit(0).cast("long").alias("part2"), F.lit(0).alias("lo"), F.lit(window - prefix).alias("hi"))
    counted = sizes.select(F.col("key").alias("part"), F.lit(0).cast("long").alias("part2"), F.lit(0).alias("lo"), F.lit(window - prefix).alias("hi"), "n")
    columns = [x.split()[0] for x in GROUPS.split(", ")]
    trees, leaves = [], []
    while True:
        total, large = counted.agg(F.sum("n"), F.max("n")).first()
        if (large or 0) <= group_limit:
            return [*trees, level], leaves
        crowded = cut(counted.filter(F.col("n") > group_limit))
        hot, rest = crowded.filter(F.col("n") * HOT_KEYS > total), crowded.filter(F.col("n") * HOT_KEYS <= total)
        trees.append(level.join(F.broadcast(hot.select(*GROUP)), GROUP, "left_anti").join(rest.select(*GROUP), GROUP, "left_anti").select(*columns))
        busy = cut(join_hot(level, crowded, GROUP, "n", total))
        leaves.append(busy.filter("lo = hi"))
        longer = cut(busy.filter("lo < hi").select(*columns).mapInArrow(_extend(window), GROUPS))
        counted = longer.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("low_id").alias("low"), F.max("high_id").alias("high"))
        counted = cut(counted.filter(F.col("low") < F.col("high")).select(*GROUP, "n"))
        level = join_hot(longer, counted, GROUP, "n", counted.agg(F.sum("n")).first()[0] or 0, "left_semi").select(*columns)


def find_repeats(docs: DataFrame, window: int = 50, prefix: int = 16, group_limit: int = 4_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, d1 (a hash of the text) and ranges (first word, end) of the words to remove; only documents that may lose words have a row.

    A word goes if a window of ``window`` consecutive words covers it whose words also start in a document with a smaller id.  Ids are
    integers; a null id counts as the largest (it is NO_ID here).  Repeated rows of one document don't remove each other's words.
    Null and empty texts have no windows; a very long text is read whole in one task; an empty table gives an empty result.
    """
    own = _keyed(docs, id_col, text_col)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_prefixes(own.select("id", "text"), window, prefix))
    marked = own.mapInArrow(_sample(window, prefix, frequent), "id long, d1 long, d2 long, keys array<long>, places array<long>")
    texts = cut(marked.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("places").alias("places")))
    suffixes = texts.select("id", "d1", F.explode(F.arrays_zip("keys", "places")).alias("s")).select("id", "d1", F.col("s.keys").alias("key"), F.col("s.places").alias("place"))
    shared = suffixes.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).filter(F.col("low") < F.col("high"))
    n_suffixes = texts.agg(F.sum(F.size("keys"))).first()[0] or 0
    places = join_hot(suffixes, cut(shared.select("key", "n")), ["key"], "n", n_suffixes, "left_semi").groupBy("id", "d1").agg(F.collect_list("place").alias("places"))
    packed = own.select("id", "d1", "text").mapInArrow(_pack, PACKED)
    cuts = packed.join(places, ["id", "d1"]).select("id", "d1", "packed", "places").mapInArrow(_contexts(prefix), "id long, d1 long, place int, key long, n_left int, context binary")
    cuts = cut(cuts.select("*", F.xxhash64("context", "n_left").alias("c1"), F.xxhash64(F.lit(7), "n_left", "context").alias("c2")))
    distinct = cuts.groupBy("key", "c1", "c2").agg(F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.first("n_left").alias("n_left"), F.first("context").alias("context"))
    sizes = cuts.select("key", "c1", "c2").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    trees, leaves = prefix_groups(distinct, cut(sizes.filter(F.col("n") > group_limit)), window, prefix, group_limit)
    runs = reduce(DataFrame.unionByName, trees).repartition("part").sortWithinPartitions(*GROUP).mapInArrow(_grow_trees(window, prefix), f"key long, c1 long, c2 long, runs {RUNS}")
    for leaf in leaves:
        first = cut(leaf.groupBy(*GROUP).agg(F.min("low_id").alias("first_id"), F.count(F.lit(1)).alias("rows")))
        run = F.array(F.struct(F.col("lo").alias("low"), F.col("lo").alias("high"), "first_id"))
        hits = join_hot(leaf.drop("n"), first, GROUP, "rows", leaf.count()).filter(F.col("first_id") < F.col("high_id"))
        runs = runs.unionByName(hits.select("key", "c1", "c2", run.alias("runs")))
    hit = cuts.select("id", "d1", "place", "key", "c1", "c2").join(runs, ["key", "c1", "c2"]).select("id", "d1", "place", F.explode("runs").alias("r")).filter(F.col("r.first_id") < F.col("id"))
    ranges = hit.select("id", "d1", F.struct((F.col("place") - F.col("r.high")).alias("first"), (F.col("place") - F.col("r.low") + window).alias("end")).alias("range"))
    # A later copy goes whole; a text shorter than the window has no window, which the reader of the ranges sees to.
    first = texts.select("d1", "d2", F.col("id").alias("first_id"))
    copies = own.select("id", "d1", "d2").join(first, ["d1", "d2"]).filter(F.col("id") > F.col("first_id"))
    copies = copies.select("id", "d1", F.struct(F.lit(0).alias("first"), F.lit(WHOLE).alias("end")).alias("range"))
    return ranges.unionByName(copies).groupBy("id", "d1").agg(F.collect_set("range").alias("ranges"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(3), text).alias("d2"), text.alias("text"))


def _kept(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words left (space-joined) of each text (id, packed text, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches, 1):
            ranges = batch.column(2)
            for piece in tx.pieces(batch.column(1)):
                w = tx.words(piece, tx.SPACE_FREE)
                text, begin, end = tx.joined(piece.data, w)
                raw, bounds, counts = text.tobytes(), w.bounds.tolist(), w.counts()
                removed, kept = [], []
                for k, own in enumerate(ranges.slice(piece.first, piece.last - piece.first).to_pylist()):
                    at, stop, parts, gone = bounds[k], bounds[k + 1], [], 0
                    for r in sorted(own or (), key=lambda r: r["first"]) if stop - at >= window else ():
                        a, b = max(bounds[k] + r["first"], at), min(bounds[k] + r["end"], stop)
                        if b <= at:
                            continue
                        if a > at:
                            parts.append(raw[begin[at] : end[a - 1]])
                        gone += b - a
                        at = b
                    if at < stop:
                        parts.append(raw[begin[at] : end[stop - 1]])
                    removed.append(gone)
                    kept.append(b" ".join(parts))
                n = piece.last - piece.first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, n), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], names=["id", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, window: int = 50, prefix: int = 16, group_limit: int = 4_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: id, n_words, n_removed, kept (its remaining words, space-joined) and kept_sha256.

    Null and empty texts have no words.  Repeats within one document stay.  Windows are judged on the input, not on what is left.
    """
    found = find_repeats(docs, window, prefix, group_limit, id_col, text_col)
    packed = _keyed(docs, id_col, text_col).select("id", "d1", "text").mapInArrow(_pack, PACKED)
    joined = packed.join(found, ["id", "d1"], "left").select("id", "packed", "ranges")
    out = joined.mapInArrow(_kept(window), "id long, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.select(F.nullif("id", F.lit(NO_ID)).cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept", "kept_sha256")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Every window by the digest of its words, with the smallest document that holds it.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 48 AS BIGINT))) AS a FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, a, md5(array_to_string(w[a : a + 49], ' ')) AS h FROM v),
f AS (SELECT h, min(doc_id) AS first_id FROM h GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(a, a + 50)) AS p FROM (SELECT h.doc_id, h.a FROM h JOIN f ON f.h = h.h WHERE f.first_id < h.doc_id)),
k AS (SELECT d.doc_id, unnest(d.w) AS word, unnest(range(1, CAST(len(d.w) + 1 AS BIGINT))) AS p FROM d),
g AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) AS kept, count(*) AS n FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.p = k.p WHERE r.p IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
