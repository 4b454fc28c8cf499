"""Token counts through a digest cache.

A text's count depends only on its content and on the tokenizer, so counts are stored under (content digest, tokenizer
digest).  A run joins the distinct digests of its contents to the stored counts; no text takes part in that.  Each distinct missing
content is then encoded once, the new counts are appended, and all are read back.  Where the missing digests are few (a warm cache)
they travel to the texts, and only texts that are missing are shuffled; where they are many, texts are shuffled after map-side
de-duplication.  Either way a content that fills a third of the table costs one row per input partition.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, join_hot, table

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Entries of a worker's word memo before it is emptied: some 60 MB.
MEMO_ENTRIES = 400_000
#: Missing digests up to which they are broadcast: some 10 MB.
BROADCAST_MISSES = 100_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenizer_digest(name: str) -> str:
    """Digest of the tokenizer's file: another vocabulary never meets this one's counts."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=2)
def counter(name: str) -> Callable[[list[str]], list[int]]:
    """A function from whole texts to token counts, without added tokens, truncation or padding."""
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")

    def encode(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    if not byte_level:
        return encode
    added = [t["content"] for t in spec.get("added_tokens", [])]
    twin = path.removesuffix(".json") + ".tiktoken"
    return _by_words(_twin(twin) if os.path.exists(twin) else encode, encode, added)


def _twin(path: str) -> Callable[[list[str]], list[int]]:
    """The same vocabulary and splitting as ranks, several times faster on single words."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(model.encode_ordinary(t)) for t in texts]


def _by_words(encode_word: Callable[[list[str]], list[int]], encode: Callable[[list[str]], list[int]], added: list[str]) -> Callable[[list[str]], list[int]]:
    """Counts by space-led words with a memo.

    The byte-level splitter never joins a character to a space after it, and a space before a non-space always opens a new
    piece, so a text cut before each such space is split the same way.  Texts where white space or the end follows a space, and
    those with the text of an added token, are encoded whole.
    """
    spaced = re.compile(r" (\s|$)")
    memo: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        out, whole = [0] * len(texts), []
        for i, text in enumerate(texts):
            if "\0" in text or spaced.search(text) or any(a in text for a in added):
                whole.append(i)
                continue
            parts = text.replace(" ", "\0 ").split("\0")
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            new = [p for p in dict.fromkeys(parts) if p not in memo]
            if new:
                memo.update(zip(new, encode_word(new), strict=True))
            out[i] = sum(map(memo.__getitem__, parts))
        for i in whole:
            out[i] = encode([texts[i]])[0]
        return out

    return count


def _encode(name: str, digest: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(keys), 256):
                n = count(texts.slice(at, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([keys.slice(at, 256), pa.array([digest] * len(n)), pa.array(n, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The stored counts, of one tokenizer or of all; none if nothing has been stored.  Two runs may have stored the same count: one row stays."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    stored = stored if version is None else stored.filter(F.col("tokenizer_digest") == version)
    return stored.groupBy("content_digest", "tokenizer_digest").agg(F.max("n_tokens").alias("n_tokens"))


def missing_texts(content: DataFrame, digests: DataFrame, stored: DataFrame) -> DataFrame | None:
    """_key and _text of each distinct content (_key, _text) without a stored count; None if there is none."""
    misses = cut(digests.join(stored.select(F.col("content_digest").alias("_key")), "_key", "left_anti"))
    n = misses.count()
    if not n:
        return None
    if n <= BROADCAST_MISSES:
        return content.join(F.broadcast(misses), "_key", "left_semi").groupBy("_key").agg(F.first("_text").alias("_text"))
    each = content.groupBy("_key").agg(F.first("_text").alias("_text"))
    return each if n == digests.count() else each.join(misses, "_key", "left_semi")


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Token counts of whole texts, one row per input row: id, n_bytes, n_tokens, over_limit, content_digest.

    The cache is a table partitioned by tokenizer digest, so other tokenizers' counts are not read.  Null text counts as empty (no
    bytes, no tokens).  Repeated rows stay repeated, and equal texts get equal counts; a null id is kept.  An empty table gives an empty
    result and leaves the cache as it is.  A very long text is encoded whole, in one task.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    content = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_key", F.unhex(F.sha2("_text", 256)))
    sized = cut(content.select("_id", "_key", F.octet_length("_text").cast("long").alias("n_bytes")))
    digests = cut(sized.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")))
    missing = missing_texts(content.select("_key", "_text"), digests.select("_key"), read_cache(spark, cache_path, version))
    if missing is not None:
        missing.mapInArrow(_encode(tokenizer, version), CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    counts = read_cache(spark, cache_path, version).select(F.col("content_digest").alias("_key"), "n_tokens")
    known = join_hot(sized, counts.join(digests, "_key"), ["_key"], "_rows", sized.count())
    return known.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("_key")).alias("content_digest"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's counts from a cold cache of this run's own."""
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", fresh_path(spark, "token-cache"))
