"""Near-duplicates by the exact Jaccard similarity of word shingles: fingerprints propose, set prefixes find the rest.

Similarity of fingerprints can't find all pairs of a similarity of 0.8 (those differ in some ten bits of 64), so it comes first and not
alone: sets whose 64-bit fingerprints lie within RADIUS bits in the grid of segment popcounts are candidates, and the whole sets decide.

In any common order of the shingles, two sets of similarity t or more share a shingle among the first n - ceil(t * n) + 1 of each,
so joining on those prefixes finds every pair.  Sizes and the number c of shared shingles in both prefixes drop most others: beyond
the prefix that ends first the sets share no more than its rest, so they share c + ceil(t * n) - 1 at most, of the larger n.  Parity
signatures drop the rest of the pairs that have only common shingles, and the whole sets decide.  The order is by frequency in the corpus,
the rarest first, as a sketch of fixed size counts it: shingles of one counter share their count, which bears on the work only.

Equal sets are one.  Each shared shingle proposes links of its sets to one of them, then, in rounds, of each set to the one whose signature
is nearest: a row per set and shingle.  Shingles whose sets are all in one component by then drop out.  Only sets still in different components after the rounds are paired with each other,
and of the links between two components one goes on, so a group of near copies costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .common import cut, join_hot
from .simhash import components, links
from .sketch import counter, hash_counts

#: Candidates up to which their table is broadcast.
BROADCAST_SETS = 100_000
PAIR_BLOCK = 1 << 20
#: Words of 64 bits in a set's parity signature.
SIGNATURE = 8
#: Bits that fingerprints may differ in, and axes of their grid: 15 cells each.
RADIUS, AXES = 2, 6
#: Rounds of links between nearest sets of a shingle, at most; they end when one finds nothing.
ROUNDS = 3


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingles' hashes of each text, ascending; a text of fewer words is one shingle, one without words has none."""
    for piece in tx.pieces(texts):
        data = tx.LOWER[piece.data]
        w = tx.words(piece, tx.SPACE_FREE)
        hashes = tx.word_hashes(data, w)
        grams = tx.gram_hashes(hashes, shingle)
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            yield np.unique(grams[a : b - shingle + 1] if b - a >= shingle else tx.gram_hashes(hashes[a:b], b - a) if b > a else grams[:0])


def _set_name(grams: np.ndarray) -> int:
    return int(np.add.reduce(tx.mix(grams ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)) if len(grams) else 0


def fingerprint(grams: np.ndarray) -> int:
    """A bit is set if over half the shingles' hashes have it."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(grams), 65536):
        part = np.ascontiguousarray(grams[a : a + 65536])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(grams), bitorder="little").view(np.uint64)[0]) if len(grams) else 0


def signature(grams: np.ndarray) -> np.ndarray:
    """How many shingles fall on each of 512 bits, modulo 2: two sets differ in no fewer shingles than their signatures in bits."""
    bits = np.bincount((tx.mix(grams) >> np.uint64(55)).astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _needed(n: int, similarity: float) -> int:
    """Shingles of a set of n that one as similar as asked must share at least."""
    return int(np.ceil(similarity * n - 1e-9))


def shingle_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many texts (id, text) hold a shingle of each counter."""
    return hash_counts(texts, lambda column: shingle_sets(column, shingle))


def _prefixes(shingle: int, similarity: float, frequency) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, first, prints, signs = [], [], [], [], []
            for grams in shingle_sets(batch.column(1), shingle):
                n = len(grams)
                names.append(_signed(_set_name(grams)))
                sizes.append(n)
                prints.append(_signed(fingerprint(grams)))
                signs.append(signature(grams))
                grams = grams[np.argsort(frequency.value[counter(grams)], kind="stable")]
                first.append(grams[: n - _needed(n, similarity) + 1 if n else 0].view(np.int64))
            lengths = np.cumsum([0, *map(len, first)])
            prefix = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
            sign = pa.ListArray.from_arrays(pa.array(np.arange(len(signs) + 1) * SIGNATURE, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *signs])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), sign, prefix], names=["id", "text_hash", "set", "n", "fp", "sign", "prefix"])

    return run


def _grams(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1), shingle))
            lengths = np.cumsum([0, *map(len, found)])
            grams = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([_signed(_set_name(x)) for x in found], pa.int64()), grams], names=["set", "grams"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram, those whose gram another row has too."""
    kept: pa.RecordBatch | None = None
    for batch in batches:
        if not len(batch):
            continue
        whole = pa.Table.from_batches([*([kept] if kept is not None else []), batch]).combine_chunks()
        gram = whole.column(0).to_numpy()
        same = np.concatenate([[False], gram[1:] == gram[:-1]])
        # The last row waits for the next batch; the row before it goes along, to tell whether it is shared.
        keep = same | np.concatenate([same[1:], [False]])
        keep[-1] = False
        if kept is not None and len(gram) > 1 and len(kept) == 2:
            keep[0] = False
        yield from whole.filter(pa.array(keep)).to_batches()
        kept = whole.slice(max(0, len(gram) - 2)).combine_chunks().to_batches()[0]
    if kept is not None and len(kept) == 2 and kept.column(0)[0] == kept.column(0)[1]:
        yield kept.slice(1)


def _counted(pairs: DataFrame, similarity: float) -> DataFrame:
    """a, b of pairs (a, b, sizes na and nb, c shared shingles of the prefixes in parts) that can be similar enough."""
    most = F.col("c") + F.ceil(F.greatest("na", "nb") * similarity - 1e-9) - 1
    summed = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    return summed.filter(most * (1 + similarity) >= (F.col("na") + F.col("nb")) * similarity - 1e-6).select("a", "b")


def _cross(similarity: float, nearest: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (gram, root, set, n, sign) sorted by gram, then root: pairs of one gram, two roots and fitting sizes, counted in parts.

    Pairs whose signatures lie too far apart to be similar enough are left out here, so sets with nothing but a common line in common
    make no rows, however many they are.  With ``nearest`` a row makes one pair of a gram, with the nearest signature among larger roots."""

    def apart(i: np.ndarray, j: np.ndarray, sign: np.ndarray) -> np.ndarray:
        bits = np.zeros(len(i), np.int64)
        for k in range(SIGNATURE):
            bits += np.bitwise_count(sign[i, k] ^ sign[j, k])
        return bits

    def pairs(rows_of: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, root, name, n, sign = rows_of
        size = len(gram)
        new = np.concatenate([[True], gram[1:] != gram[:-1]])
        part = new | np.concatenate([[True], root[1:] != root[:-1]])
        ends, parts = np.append(np.flatnonzero(new)[1:], size), np.append(np.flatnonzero(part)[1:], size)
        start, stop = parts[np.cumsum(part) - 1], ends[np.cumsum(new) - 1]
        number = stop - start
        rows = np.flatnonzero(number)
        total = np.cumsum(number[rows])
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIR_BLOCK, side="right")))
            i = np.repeat(rows[lo:hi], number[rows[lo:hi]])
            j = tx.ranges(start[rows[lo:hi]], number[rows[lo:hi]])
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = small >= large * similarity - 1e-6
            i, j = i[ok], j[ok]
            bits = apart(i, j, sign)
            ok = bits * (1 + similarity) <= (n[i] + n[j]) * (1 - similarity) + 1e-6
            i, j = i[ok], j[ok]
            if nearest and len(i):
                order = np.lexsort((bits[ok], i))
                i, j = i[order], j[order]
                best = np.append(True, i[1:] != i[:-1])
                i, j = i[best], j[best]
            low = name[i] < name[j]
            i, j = np.where(low, i, j), np.where(low, j, i)
            both, c = np.unique(np.stack([name[i], name[j], n[i], n[j]]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, both), pa.array(c.astype(np.int64))], names=["a", "b", "na", "nb", "c"])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 4 + [np.zeros((0, SIGNATURE), np.uint64)]
        for batch in batches:
            if not len(batch):
                continue
            sign = batch.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SIGNATURE)
            own = [*(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)), sign]
            c = [np.concatenate(x) for x in zip(kept, own, strict=True)]
            ended = np.flatnonzero(c[0] != c[0][-1])
            whole = int(ended[-1]) + 1 if len(ended) else 0
            if whole:
                yield from pairs([x[:whole] for x in c])
            kept = [x[whole:] for x in c]
        if len(kept[0]):
            yield from pairs(kept)

    return run


def _similar(pairs: DataFrame, first: DataFrame, own: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs a-b whose whole sets are as similar as asked; texts of sets in a pair are read again."""
    pairs = cut(pairs)
    asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(first, "set").select(F.col("k.id").alias("_id"), F.col("k.text_hash").alias("_hash")))
    side = F.broadcast(asked) if asked.count() <= BROADCAST_SETS else asked
    texts = own.join(side, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi")
    sets = cut(texts.select("id", "text").mapInArrow(_grams(shingle), "set long, grams array<long>").dropDuplicates(["set"]))
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return cut(both.filter(shared / (F.size("x") + F.size("y") - shared) >= similarity).select("a", "b"))


def fingerprint_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """a, b of sets (set, n, fp) that equal or near fingerprints propose and whose sizes fit: a star per fingerprint, links between them."""
    heads = cut(sets.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("m"), F.count(F.lit(1)).alias("rows")))
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-6
    stars = join_hot(sets, heads, ["fp"], "rows", sets.count()).select(F.col("m.set").alias("a"), F.col("set").alias("b"), F.col("m.n").alias("na"), F.col("n").alias("nb"))
    one, two = (heads.select(F.col("fp").alias(k), F.col("m.set").alias(f"set_{k}"), F.col("m.n").alias(f"n{k}")) for k in "ab")
    near = links(heads.select("fp"), RADIUS, AXES).join(one, "a").join(two, "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "na", "nb")
    return stars.unionByName(near).filter((F.col("a") != F.col("b")) & fits).select("a", "b")


def _named(rows: DataFrame, roots: DataFrame, key: str, name: str = "root") -> DataFrame:
    """rows with the root of their set ``key``, itself where roots (node, root) doesn't hold it."""
    return rows.join(roots.select(F.col("node").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))


def _parted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Of rows (gram, set, n) those of grams with two roots or more, with their root and the gram's smallest set: hub, hub_n, hub_root."""
    named = _named(shared.select("gram", "set", "n"), roots, "set")
    grams = named.groupBy("gram").agg(F.min(F.struct("set", "n", "root")).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    return cut(named.join(grams.select("gram", F.col("m.set").alias("hub"), F.col("m.n").alias("hub_n"), F.col("m.root").alias("hub_root")), "gram"))


def _to_hubs(rows: DataFrame, signs: DataFrame, similarity: float) -> DataFrame:
    """Pairs a-b of each of the rows and its gram's hub, if roots, sizes and signatures let them."""
    fits = F.least("n", "hub_n") >= F.greatest("n", "hub_n") * similarity - 1e-6
    pairs = rows.filter((F.col("root") != F.col("hub_root")) & fits).select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct()
    one, two = (signs.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("sign").alias(f"sign_{x}")) for x in "ab")
    apart = F.aggregate(F.zip_with("sign_a", "sign_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = apart * (1 + similarity) <= (F.col("na") + F.col("nb")) * (1 - similarity) + 1e-6
    return pairs.join(one, "a").join(two, "b").filter(near).select("a", "b")


def _crossed(rows: DataFrame, signs: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    signed = rows.join(signs.select("set", "sign"), "set").select("gram", "root", "set", "n", "sign")
    return signed.repartition("gram").sortWithinPartitions("gram", "root").mapInArrow(_cross(similarity, nearest), "a long, b long, na long, nb long, c long")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after more links a-b, one of them between any two roots."""
    between = _named(_named(links, roots, "a", "root_a"), roots, "b", "root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(between))


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, text_hash (xxhash64 of the text) and class_id, a bigint naming its component.

    Texts are linked if the Jaccard similarity of their sets of lower-case word shingles is ``similarity`` or more.  Null and empty
    texts have the empty set and are one class.  Repeated rows repeat in the result.  A very long text is read whole, in one task.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    frequency = docs.sparkSession.sparkContext.broadcast(shingle_counts(own.select("id", "text"), shingle))
    schema = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("set", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("sign", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))])
    marked = cut(own.mapInArrow(_prefixes(shingle, similarity, frequency), schema))
    first = cut(marked.groupBy("set").agg(F.min(F.struct(F.col("id"), F.col("text_hash"))).alias("k")))
    held = marked.groupBy("set", "n").agg(F.first("prefix").alias("prefix"))
    close = _similar(fingerprint_pairs(marked.select("set", "n", "fp").distinct(), similarity), first, own, shingle, similarity)
    grams = held.select(F.explode("prefix").alias("gram"), "set", "n")
    shared = cut(grams.repartition("gram").sortWithinPartitions("gram").mapInArrow(_shared, "gram long, set long, n int"))
    signs = cut(marked.groupBy("set").agg(F.first("n").alias("n"), F.first("sign").alias("sign")))
    roots = components(close)
    rows = _parted(shared, roots)
    roots = _joined(roots, _similar(_to_hubs(rows, signs, similarity), first, own, shingle, similarity))
    for _ in range(ROUNDS):
        rows = _parted(rows, roots)
        more = _similar(_crossed(rows, signs, similarity, True).select("a", "b").distinct(), first, own, shingle, similarity)
        if more.isEmpty():
            break
        roots = _joined(roots, more)
    rest = _crossed(_parted(rows, roots), signs, similarity, False)
    more = _similar(_counted(rest, similarity), first, own, shingle, similarity)
    roots = _joined(roots, more) if not more.isEmpty() else roots
    return marked.join(roots, marked["set"] == roots["node"], "left").select(F.col("id").alias(id_col), "text_hash", F.coalesce("root", "set").alias("class_id"))
