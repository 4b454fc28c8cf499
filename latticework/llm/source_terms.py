"""How far the sources of a language diverge in their terms, by mergeable radix tries.

Every task counts the terms of its documents in a byte trie whose leaves have counters per language and source.  A full trie is walked in
byte order, which is UTF-8 order, and its leaves are written.  Tries merge by prefix range: leaves are dealt out by ranges of (language,
term), and the walks of all tries are merged leaf by leaf as they stream by in order, so a range needs no memory of its size and a term
costs one row per trie that has it, however frequent it is.  Terms that enough documents hold are kept.  A second walk over them, range by
range, adds up each pair of sources and keeps the best terms of each source, ties in UTF-8 order; only these partial sums and candidates
are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, table

#: Leaves of a task's trie before it is written and started anew: some 300 MB.
TRIE_LEAVES = 600_000
#: Keys of a trie's lowest nodes.
BUCKET = 64
#: Terms that are gathered before they are counted into leaves.
GATHERED_TERMS = 1_000_000
#: Bytes of a text that are split into terms at a time.
SLICE_BYTES = 1 << 22
#: Leaves or kept terms that are worked through at a time, cells of a block of terms by sources, sources of a square of pairs, and sums held.
BLOCK_TERMS, BLOCK_CELLS, SQUARE, HELD_SUMS = 8192, 1 << 20, 512, 1 << 22
#: Sources of all languages up to which their totals are broadcast: some 10 MB.
BROADCAST_SOURCES = 100_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(rb"[a-z\x80-\xff]+")
LEAVES = "lang string, term string, docs long, sources array<string>, counts array<long>"


class Node:
    """All keys below start with ``prefix``: a bucket of keys, or one child for each byte that may follow and the leaf of the prefix itself."""

    __slots__ = ("bucket", "children", "leaf", "prefix")

    def __init__(self, prefix: bytes) -> None:
        self.prefix, self.children, self.leaf = prefix, None, -1
        self.bucket: dict[bytes, int] = {}


def shared(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class RadixTrie:
    """Byte strings by their shared prefixes; a node skips all bytes that its keys share.  Leaves are numbered as they come.

    The lowest nodes are buckets of up to BUCKET keys, which burst into a node per next byte.  ``known`` leads from keys met before straight
    to their leaf.
    """

    __slots__ = ("known", "root")

    def __init__(self) -> None:
        self.root = Node(b"")
        self.known = Known(self)

    def __len__(self) -> int:
        return len(self.known)

    def add(self, key: bytes, leaf: int) -> None:
        node = self.root
        while node.children is not None:
            if len(key) == len(node.prefix):
                node.leaf = leaf
                return
            byte = key[len(node.prefix)]
            child = node.children.get(byte)
            if child is None:
                child = node.children[byte] = Node(key[: len(node.prefix) + 1])
            elif not key.startswith(child.prefix):
                upper = Node(key[: shared(key, child.prefix)])
                upper.children = {child.prefix[len(upper.prefix)]: child}
                child = node.children[byte] = upper
            node = child
        node.bucket[key] = leaf
        if len(node.bucket) > BUCKET:
            self.burst(node)

    def burst(self, node: Node) -> None:
        keys, low = node.bucket, min(node.bucket)
        node.prefix, node.children, node.bucket = low[: shared(low, max(keys))] if node is not self.root else b"", {}, {}
        for key, leaf in keys.items():
            if len(key) == len(node.prefix):
                node.leaf = leaf
            else:
                byte = key[len(node.prefix)]
                if byte not in node.children:
                    node.children[byte] = Node(key[: len(node.prefix) + 1])
                node.children[byte].bucket[key] = leaf

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Keys and leaves in byte order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.leaf >= 0:
                yield node.prefix, node.leaf
            if node.children is None:
                yield from sorted(node.bucket.items())
            else:
                stack += [node.children[b] for b in sorted(node.children, reverse=True)]


class Known(dict):
    """Leaf by key; a new key goes into the trie."""

    def __init__(self, trie: RadixTrie) -> None:
        self.trie = trie

    def __missing__(self, key: bytes) -> int:
        self[key] = leaf = len(self)
        self.trie.add(key, leaf)
        return leaf


def slices(text: bytes) -> Iterator[bytes]:
    """The text in slices that end where no term goes on."""
    at = 0
    while at < len(text):
        end = at + SLICE_BYTES
        if end < len(text):
            more = TERM.match(text, end)
            end = more.end() if more else end
        yield text[at:end]
        at = end


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], *[np.add.reduceat(v[order], starts) for v in values]


class TermCounter:
    """A task's trie, and what its leaves count: occurrences and documents by (language, source) and leaf, in arrays."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.trie, self.gathered, self.waiting = RadixTrie(), [], 0
        self.counters: list[tuple[np.ndarray, ...]] = []

    def add(self, lang: str, source: str, text: bytes) -> None:
        group = self.groups.setdefault((lang, source), len(self.groups))
        known = self.trie.known
        found = [np.fromiter(map(known.__getitem__, terms), np.int64, len(terms)) for terms in map(TERM.findall, slices(text.translate(LOWER)))]
        leaves, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
        self.gathered.append((leaves + (group << 32), n))
        self.waiting += len(leaves)
        if self.waiting >= GATHERED_TERMS:
            self.settle()

    def settle(self) -> None:
        keys, n = (np.concatenate([np.zeros(0, np.int64), *[g[k] for g in self.gathered]]) for k in (0, 1))
        self.counters.append(summed(keys, n, np.ones(len(keys), np.int64)))
        self.gathered, self.waiting = [], 0
        if len(self.counters) > 4:
            self.counters = [summed(*map(np.concatenate, zip(*self.counters, strict=True)))]

    def emit(self) -> Iterator[pa.RecordBatch]:
        """The leaves of each language in the order of the walk; the trie starts anew."""
        self.settle()
        keys, n, docs = summed(*map(np.concatenate, zip(*self.counters, strict=True)))
        walked = list(self.trie.walk())
        rank = np.zeros(len(walked), np.int64)
        rank[[leaf for _, leaf in walked]] = np.arange(len(walked))
        names = sorted({lang for lang, _ in self.groups})
        lang_of = np.array([names.index(lang) for lang, _ in self.groups], np.int64)
        sources = pa.array([source for _, source in self.groups], pa.string())
        terms = pa.array([key for key, _ in walked], pa.binary()).cast(pa.string())
        group, place = keys >> 32, rank[keys & 0xFFFFFFFF]
        order = np.lexsort((place, lang_of[group]))
        group, place, n, docs = group[order], place[order], n[order], docs[order]
        row = lang_of[group] << 32 | place
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(row))
        for at in range(0, len(starts), BLOCK_TERMS):
            s, e = starts[at : at + BLOCK_TERMS], ends[at : at + BLOCK_TERMS]
            part = slice(s[0], e[-1])
            yield leaf_batch(pa.array(names, pa.string()).take(pa.array(row[s] >> 32)), terms.take(pa.array(place[s])), np.add.reduceat(docs[part], s - s[0]), np.append(s, e[-1]) - s[0], sources.take(pa.array(group[part])), n[part])
        self.clear()


def leaf_batch(langs: pa.Array, terms: pa.Array, docs: np.ndarray, offsets: np.ndarray, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    cuts = pa.array(offsets, pa.int32())
    return pa.RecordBatch.from_arrays([langs, terms, pa.array(docs, pa.int64()), pa.ListArray.from_arrays(cuts, sources), pa.ListArray.from_arrays(cuts, pa.array(counts, pa.int64()))], names=["lang", "term", "docs", "sources", "counts"])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = TermCounter()
    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        for k in range(batch.num_rows):
            counter.add(langs[k], sources[k], texts[k].as_py())
            if len(counter.trie) >= TRIE_LEAVES:
                yield from counter.emit()
    yield from counter.emit()


def fold(leaves: pa.RecordBatch) -> pa.RecordBatch:
    """Neighbouring leaves of one language and term made one."""
    n = leaves.num_rows
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.logical_or(*[pc.not_equal(leaves.column(k).slice(1), leaves.column(k).slice(0, n - 1)).to_numpy(zero_copy_only=False) for k in (0, 1)])
    starts = np.flatnonzero(new)
    names = leaves.column(3).flatten().dictionary_encode()
    of = np.repeat(np.cumsum(new) - 1, np.diff(leaves.column(3).offsets.to_numpy()))
    width = max(1, len(names.dictionary))
    keys, counts = summed(of * width + names.indices.to_numpy(zero_copy_only=False), leaves.column(4).flatten().to_numpy(zero_copy_only=False))
    first = pa.array(starts)
    return leaf_batch(leaves.column(0).take(first), leaves.column(1).take(first), np.add.reduceat(leaves.column(2).to_numpy(zero_copy_only=False), starts), np.searchsorted(keys // width, np.arange(len(starts) + 1)), names.dictionary.take(pa.array(keys % width)), counts)


def folding(min_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folds equal leaves of a sorted range and keeps those of ``min_docs`` documents; the last leaf of a batch waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * BLOCK_TERMS):
                part = batch.slice(at, 4 * BLOCK_TERMS)
                part = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(part.columns, (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], names=["lang", "term", "docs", "sources", "counts"])
                folded = fold(part if last is None else pa.Table.from_batches([last, part]).combine_chunks().to_batches()[0])
                last = folded.slice(folded.num_rows - 1)
                done = folded.slice(0, folded.num_rows - 1)
                yield done.filter(pc.greater_equal(done.column(2), min_docs))
        if last is not None:
            yield last.filter(pc.greater_equal(last.column(2), min_docs))

    return run


def term_counts(docs: DataFrame, min_docs: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Terms that at least ``min_docs`` documents of their language hold: lang, term, docs, sources and counts (arrays alike in order).

    Both steps are written to the shared folder, so a lost executor costs its own part only.
    """
    spark = docs.sparkSession
    leaves, kept = fresh_path(spark, "term-leaves"), fresh_path(spark, "terms")
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    texts.mapInArrow(count_terms, LEAVES).write.option("compression", "zstd").parquet(leaves)
    ranged = spark.read.parquet(leaves).repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    ranged.mapInArrow(folding(min_docs), LEAVES).write.parquet(kept)
    return spark.read.parquet(kept)


def scaled(a: np.ndarray, total: np.ndarray | int, scale_thousands: int = 3) -> np.ndarray:
    """floor(1000**scale_thousands * a / total) for a <= total < 2**53, by long division, so nothing is rounded."""
    out, rest = a // total, a % total
    for _ in range(scale_thousands):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class LangSums:
    """Pair sums and best terms of one language in one range."""

    def __init__(self, sources: list[str], totals: list[int], terms: int, top: int) -> None:
        self.place = {s: k for k, s in enumerate(sources)}
        self.totals, self.terms, self.top = np.array(totals, np.int64), terms, top
        self.sums: dict[tuple[int, int], np.ndarray] = {}
        self.best: dict[int, list[tuple[int, str, int]]] = {}

    def held(self) -> int:
        return sum(x.size for x in self.sums.values())

    def add(self, terms: list[str], sources: list[list[str]], counts: list[list[int]]) -> None:
        step = max(1, min(BLOCK_TERMS, BLOCK_CELLS // len(self.place)))
        for at in range(0, len(terms), step):
            self._block(terms[at : at + step], sources[at : at + step], counts[at : at + step])

    def _block(self, terms: list[str], sources: list[list[str]], counts: list[list[int]]) -> None:
        c = np.zeros((len(terms), len(self.place)), np.int64)
        rows = np.repeat(np.arange(len(terms)), [len(s) for s in sources])
        c[rows, [self.place[s] for x in sources for s in x]] = [n for x in counts for n in x]
        p = 1 + scaled(c + 2, self.totals + 2 * self.terms)
        q = 1 + scaled(c.sum(1, keepdims=True) + 2, int(self.totals.sum()) + 2 * self.terms)
        width = len(self.place)
        for a in range(0, width, SQUARE):
            for b in range(a, width, SQUARE):
                left, right = p[:, a : a + SQUARE], p[:, b : b + SQUARE]
                held = self.sums.setdefault((a, b), np.zeros((left.shape[1], right.shape[1]), np.int64))
                for k in range(left.shape[1]):
                    held[k] += divergence(left[:, k : k + 1], right).sum(0)
        value = np.where((c > 0) & (p > q), divergence(p, q), -1)
        for k in np.flatnonzero((value >= 0).any(0)).tolist():
            v = value[:, k]
            at = np.flatnonzero(v >= 0)
            if len(at) > self.top:
                at = at[v[at] >= np.partition(v[at], -self.top)[-self.top]]
            found = [(-int(v[j]), terms[j], int(q[j, 0])) for j in at.tolist()]
            self.best[k] = sorted(self.best.get(k, []) + found, key=lambda x: (x[0], x[1].encode()))[: self.top]

    def emit(self, lang: str, best: bool) -> Iterator[pa.RecordBatch]:
        """Pair sums, emptied; at the end of a range also the best terms."""
        names = list(self.place)
        for (a, b), held in self.sums.items():
            i, j = np.nonzero(np.triu(held, 1) if a == b else held)
            yield _sum_batch(lang, "pair", [names[x] for x in a + i], [names[x] for x in b + j], held[i, j])
        self.sums = {}
        if best:
            flat = [(names[k], term, -v) for k, found in self.best.items() for v, term, _ in found]
            yield _sum_batch(lang, "term", [x[0] for x in flat], [x[1] for x in flat], np.array([x[2] for x in flat], np.int64))


def _sum_batch(lang: str, part: str, source: list[str], item: list[str], value: np.ndarray) -> pa.RecordBatch:
    n = len(source)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def summing(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial pair sums and best terms of a range of kept terms (lang, term, sources, counts, groups, totals, terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, LangSums] = {}
        for lang, same in groupby((r for b in batches for r in _slices(b)), key=lambda r: r[0]):
            for _, part in same:
                if lang not in known:
                    known[lang] = LangSums(part.column(4)[0].as_py(), part.column(5)[0].as_py(), part.column(6)[0].as_py(), top)
                known[lang].add(*(part.column(k).to_pylist() for k in (1, 2, 3)))
                if sum(x.held() for x in known.values()) > HELD_SUMS:
                    for name, sums in known.items():
                        yield from sums.emit(name, best=False)
        for name, sums in known.items():
            yield from sums.emit(name, best=True)

    return run


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Slices of one language each."""
    langs = batch.column(0).to_pylist()
    starts = [k for k in range(len(langs)) if not k or langs[k] != langs[k - 1]]
    for a, b in zip(starts, [*starts[1:], len(langs)], strict=True):
        for at in range(a, b, BLOCK_TERMS):
            yield langs[a], batch.slice(at, min(b - at, BLOCK_TERMS))


def audit_sources(docs: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Divergence of each source's terms from the other sources and from its language: lang, source, part, item, value, rank.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms by which the source exceeds its language.
    Shares are smoothed by 2 and counted in billionths; all arithmetic is on whole numbers, so reruns agree.

    Null language, source and text count as empty texts; a source without terms still has its pairs, at 0 if its language keeps no
    term.  Repeated rows count as often as they occur, ties rank by UTF-8 order, an empty table gives an empty result, other columns
    are ignored.  A very long text is counted whole, in slices.  The result has a row per pair of sources of a language; a task holds
    at most HELD_SUMS sums at a time.
    """
    kept = term_counts(docs, min_docs, lang_col, source_col, text_col)
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    held = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    groups = groups.join(held, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")).transform(_written)
    pack = F.sort_array(F.collect_list(F.struct("source", "total")))
    per_lang = groups.groupBy("lang").agg(pack.alias("x")).join(terms, "lang").select("lang", F.col("x.source").alias("groups"), F.col("x.total").alias("totals"), "terms")
    few = groups.count() <= BROADCAST_SOURCES
    rows = kept.join(F.broadcast(per_lang) if few else per_lang, "lang").select("lang", "term", "sources", "counts", "groups", "totals", "terms")
    sums = rows.mapInArrow(summing(top), "lang string, source string, part string, item string, value long").transform(_written)

    halves = sums.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = halves.union(halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    each = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = each.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(sums.filter("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select(F.col("lang").alias(lang_col), F.col("source").alias(source_col), "part", "item", "value", "rank")


def _written(df: DataFrame) -> DataFrame:
    path = fresh_path(df.sparkSession, "source-audit")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def op12_source_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
uses AS (SELECT doc, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term FROM uses GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
counted AS (SELECT u.lang, u.source, u.term, count(*) AS n FROM uses u JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
group_totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM groups g LEFT JOIN counted c USING (lang, source) GROUP BY ALL),
lang_totals AS (SELECT lang, sum(total) AS total FROM group_totals GROUP BY lang),
lang_counts AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL),
p AS (
  SELECT k.lang, k.term, t.source, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * s.v))::BIGINT AS p
  FROM kept k JOIN group_totals t USING (lang) JOIN sizes s USING (lang) LEFT JOIN counted c ON c.lang = k.lang AND c.term = k.term AND c.source = t.source),
q AS (
  SELECT c.lang, c.term, (1 + (1000000000::HUGEINT * (c.n + 2)) // (t.total + 2 * s.v))::BIGINT AS q
  FROM lang_counts c JOIN lang_totals t USING (lang) JOIN sizes s USING (lang)),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
