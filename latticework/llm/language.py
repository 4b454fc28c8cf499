"""Language identification with error-correcting output codes.

Each language has a binary codeword; for each bit a binary classifier over hashed character n-grams predicts it.  The classifiers
are log-odds of n-gram counts gathered over all training texts (one Spark aggregation; what returns to the driver has two vectors
per language, whatever the corpus' size).  A second pass measures how often each bit is right for each language, on each half of the
texts by classifiers fitted on the other half; these rates weight the decoding: the language whose codeword loses least against the weighted margins wins, and a small lead over the runner-up flags
the text as ambiguous.  Both passes and the prediction read whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

BITS = 13
BUCKETS = 1 << BITS
#: Lengths of character n-grams.
GRAMS = (1, 2, 3, 4)
PIECE_CHARS = 1 << 20
#: Languages a model may have; their vectors then take 64 MB on the driver.
MAX_LANGUAGES = 500


def codewords(n: int) -> np.ndarray:
    """Codewords (rows of 0 and 1) for n languages: all splits in two up to 6 languages, else rows of a seeded random code."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        others = range(1, n)
        splits = [chosen for size in range(1, n) for chosen in combinations(others, size)]
        return np.array([[i in chosen for chosen in splits] for i in range(n)], np.int8)
    bits = max(15, 4 * int(np.ceil(np.log2(n))))
    rng = np.random.default_rng(n)
    best, best_distance = None, -1
    for _ in range(64):
        code = rng.integers(0, 2, (n, bits), dtype=np.int8)
        code = code[:, (code.min(axis=0) != code.max(axis=0))]
        distance = min(int((a != b).sum()) for a, b in combinations(code, 2)) if n <= 60 else 0
        if distance > best_distance:
            best, best_distance = code, distance
    return best


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lower-cased texts as code points: first row, code points and offsets, in pieces of bounded size."""
    texts = column.to_pylist()
    first, size, part = 0, 0, []
    for i, text in enumerate(texts):
        low = (text or "").lower()
        part.append(low)
        size += len(low)
        if size >= PIECE_CHARS or i == len(texts) - 1:
            points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield first, points, np.concatenate([[0], np.cumsum([len(x) for x in part])])
            first, size, part = i + 1, 0, []


_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def features(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams per text, and letters per text.  Runs of other characters count as one boundary."""
    n = len(offsets) - 1
    letter = _LETTER[points]
    text = np.repeat(np.arange(n), np.diff(offsets))
    letters = np.bincount(text[letter], minlength=n)
    code = np.where(letter, points, 0).astype(np.uint64)
    keep = letter.copy()
    if len(keep):
        keep[1:] |= letter[:-1]  # of each run of non-letters the first stays, as a boundary
        keep[offsets[:-1][offsets[:-1] < len(keep)]] = True
    code, text = code[keep], text[keep]
    counts = np.zeros(n * BUCKETS, np.float32)
    for k in GRAMS:
        m = len(code) - k + 1
        if m <= 0:
            break
        h = np.full(m, k * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for j in range(k):
            h = (h ^ code[j : j + m]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        same = text[: m] == text[k - 1 :]
        counts += np.bincount(text[:m][same] * BUCKETS + ((h[same] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64), minlength=n * BUCKETS).astype(np.float32)
    return counts.reshape(n, BUCKETS), letters


def _chunks(column: pa.Array, rows: int = 128) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, points, offsets in _texts(column):
        for a in range(0, len(offsets) - 1, rows):
            part = offsets[a : a + rows + 1]
            counts, letters = features(points[part[0] : part[-1]], part - part[0])
            yield first + a, counts, letters


_PARTS = "lang string, half long, total binary"


def _as_parts(total: dict[tuple[str, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    if total:
        langs, halves = zip(*total, strict=True)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(langs), "half": pa.array(halves, pa.int64()), "total": pa.array([v.tobytes() for v in total.values()], pa.binary())})


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language and half of a partition, summed shares of n-grams (each text weighs as the root of its length)."""
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        names, number = np.unique([f"{h}{x}" for x, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], return_inverse=True)
        for first, counts, _ in _chunks(batch.column(0)):
            size = counts.sum(axis=1, keepdims=True)
            counts = counts / np.sqrt(np.maximum(size, 1))
            own = number[first : first + len(counts)]
            for k in np.unique(own).tolist():
                key = (str(names[k][1:]), int(names[k][0]))
                total[key] = total.get(key, 0) + counts[own == k].sum(axis=0, dtype=np.float64)
    yield from _as_parts(total)


def _sum_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for lang, half, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            total[lang, half] = total.get((lang, half), 0) + np.frombuffer(raw, np.float64)
    yield from _as_parts(total)


class Model:
    """Languages, their codewords, a weight vector per bit, and decoding weights per language and bit."""

    def __init__(self, langs: list[str], totals: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = totals / np.maximum(totals.sum(axis=1, keepdims=True), 1e-12)
        smooth = 0.5 / BUCKETS
        bits = [np.log(share[self.code[:, b] == 1].mean(axis=0) + smooth) - np.log(share[self.code[:, b] == 0].mean(axis=0) + smooth) for b in range(self.code.shape[1])]
        self.weights = np.stack(bits, axis=1).astype(np.float32) if bits else np.zeros((BUCKETS, 0), np.float32)
        self.rates = np.full(self.code.shape, 1.0)

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Per bit the mean log-odds of the text's n-grams, squashed to -1..1; sure for long texts, hesitant for short ones."""
        size = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return np.tanh(counts @ self.weights / size * np.minimum(np.sqrt(size), 20) / 2)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the nearest codeword's language, a score in 0..1 (softmax of negative losses) and its lead over the next."""
        n = len(counts)
        if len(self.langs) < 2:
            return np.zeros(n, np.int64), np.ones(n), np.ones(n)
        sign = 2.0 * self.code - 1
        weight = self.rates / self.rates.sum(axis=1, keepdims=True)
        # Loss of a margin m against sign s is exp(-s m); per language the weighted mean over bits.
        m = self.margins(counts)
        loss = np.exp(-m) @ (weight * (sign > 0)).T + np.exp(m) @ (weight * (sign < 0)).T
        likely = np.exp(-6 * (loss - loss.min(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        ordered = np.sort(likely, axis=1)
        return loss.argmin(axis=1), ordered[:, -1], ordered[:, -1] - ordered[:, -2]


def _rates(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: list[Model] = shared.value  # the h-th was fitted without half h
        code, langs = models[0].code, models[0].langs
        right, seen = np.zeros(code.shape), np.zeros(len(langs))
        number = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            half = batch.column(2).to_numpy()
            for first, counts, letters in _chunks(batch.column(0)):
                for h, model in enumerate(models):
                    of = np.flatnonzero((half[first : first + len(counts)] == h) & (letters > 0))
                    own = lang[first + of]
                    np.add.at(right, own, (model.margins(counts[of]) > 0) == (code[own] == 1))
                    seen += np.bincount(own, minlength=len(langs))
        at = np.argwhere(np.ones_like(right, bool))
        yield pa.RecordBatch.from_pydict({"l": at[:, 0], "b": at[:, 1], "right": right.ravel(), "seen": seen[at[:, 0]]})

    return run


def fit_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on all rows of docs that have a language and a text.  More than MAX_LANGUAGES languages are an error.

    Texts are dealt to two halves by their hash, so copies are on one side.  Without rows the model has no language.
    """
    text = F.col(text_col).cast("string")
    own = docs.select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(text), F.lit(2)).cast("long").alias("half")).filter("text IS NOT NULL AND lang IS NOT NULL")
    langs = sorted(r["lang"] for r in own.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    parts = own.mapInArrow(_totals, _PARTS).repartition(16, "lang", F.pmod(F.spark_partition_id(), F.lit(64))).mapInArrow(_sum_vectors, _PARTS)
    got = {(r["lang"], r["half"]): np.frombuffer(r["total"], np.float64) for r in parts.repartition(max(1, min(len(langs), 64)), "lang").mapInArrow(_sum_vectors, _PARTS).collect()}
    halves = [np.stack([got.get((x, h), np.zeros(BUCKETS)) for x in langs]) if langs else np.zeros((0, BUCKETS)) for h in (0, 1)]
    model = Model(langs, halves[0] + halves[1])
    if model.code.shape[1]:
        shared = docs.sparkSession.sparkContext.broadcast([Model(langs, halves[1]), Model(langs, halves[0])])
        rates = own.mapInArrow(_rates(shared), "l long, b long, right double, seen double").groupBy("l", "b").agg(F.sum("right").alias("right"), F.sum("seen").alias("seen")).collect()
        for r in rates:
            # A bit that is right no more often than chance counts next to nothing.
            model.rates[r["l"], r["b"]] = max(0.05, 2 * (r["right"] + 1) / (r["seen"] + 2) - 1)
    return model


def _predict(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for first, counts, letters in _chunks(batch.column(1)):
                best, score, lead = model.decode(counts)
                known = (letters > 0) & (len(model.langs) > 0)
                langs = [model.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                ids = batch.column(0).slice(first, len(counts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, lead, 0.0))], names=["id", "lang_pred", "score", "lead"])

    return run


def identify_language(docs: DataFrame, model: Model, ambiguous_below: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (0 to 1) and ambiguous (the lead over the second language is under ``ambiguous_below``).

    Null texts and texts without a letter are `und`, with score 0 and ambiguous.  A model without languages says `und` throughout.
    Repeated rows are judged alike; an empty table gives an empty result; a very long text is read whole, in pieces of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", own.schema["id"].dataType)])
    for name, kind in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("lead", T.DoubleType())):
        schema.add(name, kind)
    out = own.mapInArrow(_predict(shared), schema)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", (F.col("lead") < ambiguous_below).alias("ambiguous"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    model = fit_language(docs.filter(~held_out))
    return identify_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
