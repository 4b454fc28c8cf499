"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each task cuts its documents into shards of bounded size and builds a word-level suffix array per shard.  Only suffixes that
can begin a match are sorted: a word that no benchmark item holds can't be part of one, so stretches of known words shorter than
the shortest window are left out, which changes no result.  Every benchmark suffix is then binary-searched; ranges of equal
prefixes give all places of its window, and neighbouring windows join to the longest verbatim matches.  Equal windows of different items
are searched once.

Benchmark items travel to the tasks in blocks of bounded size, and a worker builds each block's index once.  As long as they fit one
batch of blocks, the job is one map over the documents without a shuffle; a larger benchmark takes a map per batch, so that what is
broadcast at a time stays bounded, and only the matches are shuffled.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .common import cut, table

#: Bytes of item texts in one broadcast block, and blocks that are broadcast at a time.
BLOCK_BYTES = 8 << 20
BATCH_BLOCKS = 4
SHARD_BYTES = 4 << 20
#: Pairs of an item's window and a place that are listed at a time, but for one document's.
PAIRS = 1 << 20

MATCH = "array<struct<item_id:string,item_word:long,doc_word:long,length:long>>"


class ItemIndex:
    """Words, suffixes and windows of one block of items."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        whole = list(tx.pieces(pa.array(texts, pa.large_string()), 1 << 40))
        hashes, bounds = np.zeros(0, np.uint64), np.zeros(len(ids) + 1, np.int64)
        for piece in whole:
            piece.data = tx.LOWER[piece.data]
            w = tx.words(piece, tx.LETTER_DIGIT)
            hashes, bounds = tx.word_hashes(piece.data, w), w.bounds
        self.ids = ids
        self.vocabulary, sequence = np.unique(hashes, return_inverse=True)
        self.longest = int(np.diff(bounds).max(initial=0))
        #: Word numbers from 1; the padding after each end is -1 and equals nothing.
        self.sequence = np.concatenate([sequence.astype(np.int64) + 1, np.full(self.longest + 1, -1)])
        item = np.repeat(np.arange(len(ids)), np.diff(bounds))
        at = np.arange(len(sequence))
        left = bounds[item + 1] - at
        length = np.minimum(window, np.diff(bounds)[item])
        starts = left >= length
        self.suffix, self.item, self.need, self.left = at[starts], item[starts], length[starts], left[starts]
        self.offset = self.suffix - bounds[self.item]
        self.shortest = int(self.need.min(initial=window))
        # Equal windows are a class: its first suffix is searched for all of them.
        name = np.zeros(len(self.suffix), np.uint64)
        for k in np.unique(self.need).tolist():
            of = self.need == k
            name[of] = tx.mix(tx.gram_hashes(hashes, k)[self.suffix[of]] ^ np.uint64(k))
        _, self.first, self.cls = np.unique(name, return_index=True, return_inverse=True)
        self.by_class = np.argsort(self.cls, kind="stable")
        self.size = np.bincount(self.cls, minlength=len(self.first))
        self.begin = np.cumsum(self.size) - self.size

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of hashes, 0 for words of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the suffixes that begin there, to ``depth`` words at least, by doubling."""
    rank, step = np.unique(sequence, return_inverse=True)[1].astype(np.int64), 1
    while step < depth:
        after = np.zeros_like(rank)
        after[: max(0, len(rank) - step)] = rank[step:] + 1
        values, rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)
        if len(values) == len(rank):
            break
        step *= 2
    return np.argsort(rank, kind="stable")


def _order(sequence: np.ndarray, at: np.ndarray, query: np.ndarray, q: np.ndarray, need: np.ndarray, depth: int) -> np.ndarray:
    """-1, 0 or 1 as the suffix at ``at`` sorts before, begins with, or sorts after the first ``need`` words of query[q:]."""
    out, todo = np.zeros(len(at), np.int8), np.arange(len(at))
    for k in range(depth):
        todo = todo[(need[todo] > k)]
        if not len(todo):
            break
        sign = np.sign(sequence[at[todo] + k] - query[q[todo] + k]).astype(np.int8)
        out[todo] = sign
        todo = todo[sign == 0]
    return out


def search(sequence: np.ndarray, array: np.ndarray, query: np.ndarray, q: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query suffix, the range of the suffix array whose suffixes begin with its first ``need`` words."""
    depth = int(need.max(initial=0))
    padded = np.concatenate([sequence, np.zeros(depth + 1, sequence.dtype)])
    found = []
    for upper in (0, 1):
        low, high = np.zeros(len(q), np.int64), np.full(len(q), len(array), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            right = _order(padded, array[mid], query, q[open_], need[open_], depth) < upper
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)
        found.append(low)
    return found[0], found[1]


def shard_places(numbers: np.ndarray, bounds: np.ndarray, index: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """Classes of item windows and the words of the shard where they begin, in order of place."""
    none = (np.zeros(0, np.int64),) * 2
    known = numbers > 0
    n = len(known)
    if not n or not len(index.suffix):
        return none
    new_doc = np.zeros(n + 1, bool)
    new_doc[bounds] = True
    begin = known & (new_doc[:-1] | np.concatenate([[True], ~known[:-1]]))
    end = known & (new_doc[1:] | np.concatenate([~known[1:], [True]]))
    first, length = np.flatnonzero(begin), np.flatnonzero(end) + 1 - np.flatnonzero(begin)
    keep = length >= index.shortest
    first, length = first[keep], length[keep]
    if not len(first):
        return none
    places = tx.ranges(first, length + 1)
    ends = np.cumsum(length + 1) - 1
    sequence = numbers[np.minimum(places, n - 1)]
    sequence[ends] = 0
    array = suffix_array(sequence, index.longest)
    low, high = search(sequence, array, index.sequence, index.suffix[index.first], index.need[index.first])
    count = high - low
    cls = np.repeat(np.arange(len(count)), count)
    place = places[array[tx.ranges(low, count)]]
    order = np.argsort(place, kind="stable")
    return cls[order], place[order]


def longest_matches(cls: np.ndarray, place: np.ndarray, index: ItemIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest verbatim matches: item, item word, shard word, length; every match spans a window at least."""
    if not len(cls):
        return (np.zeros(0, np.int64),) * 4
    size = index.size[cls]
    hit = index.by_class[tx.ranges(index.begin[cls], size)]
    item, word, need, place = index.item[hit], index.offset[hit], index.need[hit], np.repeat(place, size)
    order = np.lexsort((place, place - word, item))
    item, word, need, place = item[order], word[order], need[order], place[order]
    fresh = np.ones(len(item), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (place[1:] - word[1:] != place[:-1] - word[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(fresh)
    last = np.concatenate([head[1:], [len(item)]]) - 1
    return item[head], word[head], place[head], place[last] + need[last] - place[head]


def _shards(texts: pa.Array) -> Iterator[tuple[tx.Piece, tx.Words, np.ndarray]]:
    for piece in tx.pieces(texts, SHARD_BYTES):
        piece.data = tx.LOWER[piece.data]
        w = tx.words(piece, tx.LETTER_DIGIT)
        yield piece, w, tx.word_hashes(piece.data, w)


_INDEXES: dict[tuple[str, int], ItemIndex] = {}


def _indexes(blocks: list, window: int) -> list[ItemIndex]:
    """The indexes of a batch of blocks; a worker builds each once and keeps those of the latest batch."""
    wanted = [(name, window) for name, _ in blocks]
    for key in [k for k in _INDEXES if k not in wanted]:
        del _INDEXES[key]
    for key, (_, block) in zip(wanted, blocks, strict=True):
        if key not in _INDEXES:
            _INDEXES[key] = ItemIndex(*block.value, window)
    return [_INDEXES[k] for k in wanted]


def _scan(blocks: list, window: int, texts: pa.Array) -> Iterator[tuple[int, int, list[list[tuple]], np.ndarray]]:
    """Words and matches per text, for some texts of a shard at a time."""
    indexes = _indexes(blocks, window)
    for piece, w, hashes in _shards(texts):
        n = piece.last - piece.first
        pairs, seen = np.zeros(n, np.int64), []
        for index in indexes:
            cls, place = shard_places(index.numbers(hashes), w.bounds, index)
            doc = np.searchsorted(w.bounds, place, side="right") - 1
            pairs += np.bincount(doc, index.size[cls], minlength=n).astype(np.int64)
            seen.append((index, cls, place, doc))
        upto, a, counts = np.cumsum(pairs), 0, w.counts()
        while a < n:
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
            found: list[list[tuple]] = [[] for _ in range(b - a)]
            for index, cls, place, doc in seen:
                of = slice(*np.searchsorted(doc, [a, b]))
                item, word, at, length = longest_matches(cls[of], place[of], index)
                own = np.searchsorted(w.bounds, at, side="right") - 1
                for d, i, iw, p, k in zip((own - a).tolist(), item.tolist(), word.tolist(), (at - w.bounds[own]).tolist(), length.tolist(), strict=True):
                    found[d].append((index.ids[i], iw, p, k))
            yield piece.first + a, piece.first + b, found, counts[a:b]
            a = b


def _hits(matches: list[tuple]) -> int:
    """Words inside any match."""
    covered = end = 0
    for start, stop in sorted((p, p + k) for _, _, p, k in matches):
        covered += max(0, stop - max(start, end))
        end = max(end, stop)
    return covered


def _report(blocks: list, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, found, n_words in _scan(blocks, window, batch.column(1)):
                items = [sorted({m[0] for m in x}) for x in found]
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(first, last - first),
                    "text_hash": batch.column(2).slice(first, last - first),
                    "n_words": pa.array(n_words, pa.int64()),
                    "n_hit": pa.array([_hits(x) for x in found], pa.int64()),
                    "items": pa.array(items, pa.list_(pa.string())),
                    "matches": pa.array([[dict(zip(("item_id", "item_word", "doc_word", "length"), m, strict=True)) for m in x] for x in found], pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("length", pa.int64())]))),
                })

    return run


def _remove(blocks: list, window: int, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, found, _ in _scan(blocks, window, batch.column(at)):
                yield batch.slice(first, last - first).filter(pa.array([not x for x in found], pa.bool_()))

    return run


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """Batches of named broadcasts of at most about ``block_bytes`` of text each, BATCH_BLOCKS a batch; the driver holds one block at a time."""
    spark = items.sparkSession
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, name = max(1, math.ceil(total / block_bytes)), uuid.uuid4().hex
    for first in range(0, n, BATCH_BLOCKS):
        batch = []
        for b in range(first, min(n, first + BATCH_BLOCKS)):
            part = own if n == 1 else own.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
            rows = part.orderBy("id", "text").collect()
            batch.append((f"{name}-{b}", spark.sparkContext.broadcast(([r["id"] for r in rows], [r["text"] for r in rows]))))
        yield batch


def covered_words(matches: Column) -> Column:
    """Words of a document inside any match."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["length"]).alias("b"))))
    zero = F.lit(0).cast("long")
    state = F.struct(zero.alias("n"), zero.alias("end"))
    return F.aggregate(spans, state, lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), zero)).alias("n"), F.greatest(s["end"], x["b"]).alias("end")), lambda s: s["n"])


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Verbatim benchmark matches of every document: id, text_hash, n_words, n_hit, items (ids as strings) and matches.

    A match is a longest verbatim stretch that holds a window: ``window`` consecutive words of an item, or a whole shorter item.
    Null texts have no words; items without words match nothing; a null item id is listed as "null"; repeated rows are judged
    alike, and repeated items count once in items.  An empty table on either side gives no rows or no matches.  A very long text is a
    shard of its own, read whole.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    schema = T.StructType([T.StructField("id", own.schema["id"].dataType)])
    for name, kind in (("text_hash", "long"), ("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"), ("matches", MATCH)):
        schema.add(name, T.DataType.fromDDL(kind))
    batches = item_blocks(items, item_id_col, item_text_col, block_bytes)
    out = own.mapInArrow(_report(next(batches), window), schema)
    more = [cut(own.mapInArrow(_report(batch, window), schema).filter("n_hit > 0").dropDuplicates(["id", "text_hash"])) for batch in batches]
    if more:
        extra = reduce(DataFrame.unionByName, more).groupBy("id", "text_hash").agg(F.flatten(F.collect_list("items")).alias("i"), F.flatten(F.collect_list("matches")).alias("m"))
        extra = extra.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "i", "m")
        out = out.join(extra, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
        both = F.concat("matches", F.coalesce("m", F.slice("matches", 1, 0)))
        out = out.select("id", "text_hash", "n_words", F.array_sort(F.array_union("items", F.coalesce("i", F.slice("items", 1, 0)))).alias("items"), both.alias("matches")).withColumn("n_hit", covered_words(F.col("matches")))
    return out.select(F.col("id").alias(id_col), "text_hash", "n_words", "n_hit", "items", "matches")


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item.

    Null and empty texts stay; repeated rows are judged alike; an empty table on either side leaves docs as they are; texts are read
    whole, however long, and no column of docs is renamed or read but the text.
    """
    batches = item_blocks(items, item_id_col, item_text_col, block_bytes)
    at, out = docs.columns.index(text_col), docs
    for k, batch in enumerate(batches):
        out = (cut(out) if k else out).mapInArrow(_remove(batch, window, at), docs.schema)
    return out


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Windows of items and documents joined on their words; a short item's only window is the whole item.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
v AS (SELECT item_id, k, w, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS a FROM s),
x AS (SELECT DISTINCT item_id, k, array_to_string(w[a : a + k - 1], ' ') AS h FROM v),
k AS (SELECT DISTINCT k FROM x),
e AS (SELECT doc_id, k, w, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS a FROM d, k WHERE len(w) >= k),
m AS (SELECT e.doc_id, e.a, e.k, x.item_id FROM (SELECT doc_id, k, a, array_to_string(w[a : a + k - 1], ' ') AS h FROM e) e JOIN x ON x.k = e.k AND x.h = e.h),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
