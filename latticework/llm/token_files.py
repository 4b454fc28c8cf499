"""Token ids as packed binary shards: a Spark data source that writes and reads them, and the step that orders and encodes texts.

A shard holds the ids of consecutive documents as one stream, packed by Simple-8b in blocks (``packing``), and at its end a table of the
documents and of the blocks' places, so any stretch of a shard can be read without the words before it.  Tasks write shards
under names of their own; the manifest, written once by the commit, names those of the tasks that count and how many ids stand before
each.  What lost or repeated tasks leave is in no manifest, and an aborted job's shards are deleted.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import fresh_path, table
from .packing import BLOCK, decode, encode
from .token_counts import MEMO_ENTRIES, tokenizer_path

MAGIC = b"S8BSHARD"
MANIFEST = "manifest.json"
#: Blocks that are packed at a time, and that a reading task takes.
PACK_BLOCKS, READ_BLOCKS = 256, 8192
#: Ids of the documents that are handed on in one batch (a longer document is a batch of its own).
BATCH_IDS = 1 << 20


@dataclass
class Shard(WriterCommitMessage):
    """What a task wrote."""

    partition: int
    name: str
    docs: int
    ids: int


class ShardWriter:
    """Streams ids into a file; only the tables of documents and blocks stay in memory."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.held, self.waiting = out, [], 0
        self.keys: list[np.ndarray] = []
        self.gone: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = [np.zeros(1, "<i8")]
        self.words = self.ids = self.docs = 0
        out.write(MAGIC)

    def add(self, keys: pa.Array, ids: pa.Array) -> None:
        self.keys.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.gone.append(keys.is_null().to_numpy(zero_copy_only=False).astype("u1"))
        self.docs += len(keys)
        sizes = np.zeros(len(ids), "<i8")
        for k, x in enumerate(ids):
            part = np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, "<u4")
            sizes[k] = len(part)
            self.held.append(part)
            self.waiting += len(part)
            if self.waiting >= PACK_BLOCKS * BLOCK:
                self._pack(self.waiting // BLOCK * BLOCK)
        self.lengths.append(sizes)

    def _pack(self, n: int) -> None:
        stream = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        self.held, self.waiting = [stream[n:]], len(stream) - n
        words, offsets = encode(stream[:n])
        self.out.write(words.astype("<u8").tobytes())
        self.offsets.append((offsets[1:] + self.words).astype("<i8"))
        self.words, self.ids = self.words + len(words), self.ids + n

    def close(self) -> None:
        self._pack(self.waiting)
        for part in (*self.keys, *self.gone, *self.lengths, *self.offsets):
            self.out.write(part.tobytes())
        self.out.write(np.array([self.docs, self.ids, self.words], "<i8").tobytes() + MAGIC)


class ShardReader:
    """The tables of a shard, and its ids by stretches."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, size = file, file.size()
        tail = self._at(size - 32, 32)
        if tail[24:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a shard of packed ids, or one that was cut off")
        docs, self.ids, words = np.frombuffer(tail[:24], "<i8").tolist()
        blocks = -(-self.ids // BLOCK)
        at = 8 + 8 * words
        self.keys = np.frombuffer(self._at(at, 8 * docs), "<i8")
        self.gone = np.frombuffer(self._at(at + 8 * docs, docs), "u1").astype(bool)
        self.lengths = np.frombuffer(self._at(at + 9 * docs, 8 * docs), "<i8")
        self.offsets = np.frombuffer(self._at(at + 17 * docs, 8 * (blocks + 1)), "<i8")
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def stretch(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) as 32-bit numbers; only their blocks are read."""
        a, b = start // BLOCK, -(-end // BLOCK)
        if start == end:
            return np.zeros(0, "<u4")
        offsets = self.offsets[a : b + 1]
        words = np.frombuffer(self._at(8 + 8 * int(offsets[0]), 8 * int(offsets[-1] - offsets[0])), "<u8")
        ids = decode(words, min(b * BLOCK, self.ids) - a * BLOCK)
        return ids[start - a * BLOCK : end - a * BLOCK].astype("<u4")

    def documents(self, first_block: int, last_block: int) -> Iterator[tuple[int, int]]:
        """Runs [i, j) of the documents that start in these blocks, of BATCH_IDS ids or of one document."""
        i, stop = (int(np.searchsorted(self.starts, b * BLOCK)) for b in (first_block, last_block))
        stop = len(self.starts) if last_block * BLOCK >= self.ids else stop
        while i < stop:
            j = max(i + 1, int(np.searchsorted(self.starts + self.lengths, self.starts[i] + BATCH_IDS, side="right")))
            yield i, min(j, stop, i + 10_000)
            i = min(j, stop, i + 10_000)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that Arrow knows, and the path in it."""
    return fs.FileSystem.from_uri(path)


class PackedIds(DataSource):
    """df.write.format("packed_ids").save(path) takes a key (long) and ids (binary, little-endian 32-bit numbers) and keeps partitions'
    order and the rows' order in them.  Reading gives key, start (ids of all rows before), n_ids and ids; option ``blocks`` sets how many
    blocks a reading task takes.  The path must be on a file system that all executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return "key long, start long, n_ids long, ids binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PackedIdsWriter(self.options["path"], overwrite)

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackedIdsReader(self.options["path"], int(self.options.get("blocks", READ_BLOCKS)))


class PackedIdsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.job = path, uuid.uuid4().hex
        files, at = store(path)
        if not overwrite and files.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{path} already holds packed ids")
        files.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        files, at = store(self.path)
        partition = TaskContext.get().partitionId()
        name = f"{self.job}-{partition:06d}-{uuid.uuid4().hex[:8]}.s8b"
        with files.open_output_stream(f"{at}/{name}") as out:
            shard = ShardWriter(out)
            for batch in iterator:
                shard.add(batch.column(0), batch.column(1))
            shard.close()
        return Shard(partition, name, shard.docs, shard.ids)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, at = store(self.path)
        shards = sorted((m for m in messages if isinstance(m, Shard)), key=lambda m: m.partition)
        before = np.cumsum([0, *[m.ids for m in shards]]).tolist()
        rows = [{"name": m.name, "docs": m.docs, "ids": m.ids, "start": s} for m, s in zip(shards, before, strict=False) if m.docs]
        old = self._shards(files, at)
        with files.open_output_stream(f"{at}/{self.job}.tmp") as out:
            out.write(json.dumps({"block": BLOCK, "shards": rows}).encode())
        files.move(f"{at}/{self.job}.tmp", f"{at}/{MANIFEST}")
        for path in old - {f"{at}/{r['name']}" for r in rows}:
            files.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, at = store(self.path)
        for path in self._shards(files, at):
            if os.path.basename(path).startswith(self.job):
                files.delete_file(path)

    def _shards(self, files: fs.FileSystem, at: str) -> set[str]:
        return {f.path for f in files.get_file_info(fs.FileSelector(at)) if f.path.endswith(".s8b")}


@dataclass
class Stretch(InputPartition):
    name: str
    start: int
    first_block: int
    last_block: int


class PackedIdsReader(DataSourceReader):
    def __init__(self, path: str, blocks: int) -> None:
        self.path, self.blocks = path, blocks

    def partitions(self) -> list[InputPartition]:
        files, at = store(self.path)
        with files.open_input_stream(f"{at}/{MANIFEST}") as f:
            shards = json.loads(f.read())["shards"]
        return [Stretch(s["name"], s["start"], a, a + self.blocks) for s in shards for a in range(0, max(1, -(-s["ids"] // BLOCK)), self.blocks)]

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no shard at all
            return
        files, at = store(self.path)
        with files.open_input_file(f"{at}/{partition.name}") as f:
            shard = ShardReader(f)
            for i, j in shard.documents(partition.first_block, partition.last_block):
                first = int(shard.starts[i])
                ids = shard.stretch(first, int(shard.starts[j - 1] + shard.lengths[j - 1]))
                edges = np.append(shard.starts[i:j], shard.starts[j - 1] + shard.lengths[j - 1]) - first
                binary = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((edges * 4).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys[i:j], mask=shard.gone[i:j]), pa.array(partition.start + shard.starts[i:j]), pa.array(shard.lengths[i:j]), binary], names=["key", "start", "n_ids", "ids"])


#: Texts in which the byte-level splitter's classes are these: letters of the Latin blocks, digits, white space, all else.
PLAIN = re.compile("[\t\n\x20-\x7e\u00c0-\u024f]*")
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: The splitter of byte-level vocabularies (a fixed public pattern) in these classes.
PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[^\t\n {_L}0-9]+|[\t\n ]+(?![^\t\n ])|[\t\n ]+")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: its own, or the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class Memo(dict):
    """What a function gave; emptied where it holds MEMO_ENTRIES."""

    def __init__(self, function: Callable[[str], bytes]) -> None:
        self.function = function

    def __missing__(self, key: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[key] = made = self.function(key)
        return made


def piece_encoder(model: object) -> Memo:
    """Ids of pieces by the library's model; the splitter, which takes longer than the model, is left out."""
    tokenize, letters = model.tokenize, byte_letters()
    return Memo(lambda piece: array("I", [t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))]).tobytes())


@lru_cache(maxsize=2)
def encoder(name: str) -> Callable[[str], bytes]:
    """A function from a whole text to its ids (little-endian 32-bit numbers), without added tokens, truncation or padding."""
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: np.array(pieces.encode(text), "<u4").tobytes()
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = lambda text: np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer"):
        return whole
    added = [t["content"] for t in spec.get("added_tokens", [])]
    spaced, piece_ids = re.compile(r" (\s|$)"), piece_encoder(model.model)
    words = Memo(whole)

    def by_words(text: str) -> bytes:
        """Plain texts by pieces.  Others by words: the splitter cuts before every single space that a word follows."""
        if any(a in text for a in added):
            return whole(text)
        if PLAIN.fullmatch(text):
            return b"".join(map(piece_ids.__getitem__, PIECES.findall(text)))
        if "\0" in text or spaced.search(text):
            return whole(text)
        return b"".join(map(words.__getitem__, text.replace(" ", "\0 ").split("\0")))

    return by_words


def encoding(tokenizer: str, end_id: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids = [to_ids(t) + end for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of whole texts, with ``end_id`` after each document, in ascending order of ids.

    Ids of documents are whole numbers.  Rows of one id follow in the order of their texts' hashes and then as they are read; a third of
    all rows may share an id, as ranges are cut between such rows too.  Null ids come first and stay null, a null text counts as empty (its
    only id is the end id), an empty table gives files without rows.  Other columns are ignored.  A very long text is encoded whole, by
    one task.
    """
    docs.sparkSession.dataSource.register(PackedIds)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["key", "tie", "at"]
    ranged = rows.withColumn("tie", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("key", "text").mapInArrow(encoding(tokenizer, end_id), "key long, ids binary").write.format("packed_ids").mode("append").save(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of such files: id, start (ids of all documents before it), n_tokens and ids (little-endian 32-bit numbers)."""
    spark.dataSource.register(PackedIds)
    return spark.read.format("packed_ids").load(path).select(F.col("key").alias(id_col), "start", F.col("n_ids").alias("n_tokens"), "ids")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
