"""The packed code against its input, files against the tokenizer library, and what a lost or aborted job leaves."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import packing, token_files
from latticework.llm.token_counts import tokenizer_path


@pytest.mark.parametrize("bits", [0, 1, 3, 8, 16, 31, 60, 61, 64])
@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_codes_give_the_numbers_back(bits, n):
    rng = np.random.default_rng(bits * 10_000 + n)
    v = rng.integers(0, (1 << bits) - 1, n, dtype=np.uint64, endpoint=True)
    v[rng.random(n) < 0.3] = 0
    words, offsets = packing.encode(v)
    assert packing.decode(words, n).tolist() == v.tolist()
    for b in range(len(offsets) - 1):  # every block alone
        part = v[b * packing.BLOCK : (b + 1) * packing.BLOCK]
        assert packing.decode(words[offsets[b] : offsets[b + 1]], len(part)).tolist() == part.tolist()


def test_words_hold_as_many_numbers_as_fit():
    assert [len(packing.encode(np.full(960, (1 << b) - 1, np.uint64))[0]) for b in (0, 1, 15, 16, 60)] == [8, 16, 240, 320, 960]
    assert len(packing.encode(np.full(10, 1 << 60, np.uint64))[0]) == 20


def rows():
    rng = random.Random(4)
    texts = ["", None, "<|endoftext|> in <|endoftext|>", "  two  spaces ", "tab\tand\nline", "naïve 一二三 \U0001f600", "a\0b c", "word " * 50_000, "don't we'll 123 4567"]
    texts += [" ".join("".join(rng.choices("abcdefgé,.", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    out = [(i * 3 - 30, t) for i, t in enumerate(texts)]
    return out + [(5, "same id"), (5, "same id"), (5, "another"), (None, "no id"), (None, None)] + [(9, "copy of a hot id")] * 40


def test_files_give_back_what_the_library_encodes(spark, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4).withColumn("key", F.lit("x")).withColumn("ids", F.lit(1))
    path = str(tmp_path / "files")
    token_files.write_token_files(df, path, "byte_bpe_50k.json")
    got = [tuple(r) for r in token_files.read_token_files(spark, path).collect()]
    want = sorted(((-(10**9) if i is None else i), np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in data)
    assert sorted((-(10**9) if r[0] is None else r[0], bytes(r[3])) for r in got) == want
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    keys = [-(10**9) if r[0] is None else r[0] for r in got]
    assert keys == sorted(keys) and all(len(r[3]) == 4 * r[2] for r in got)
    sums = token_files.read_token_files(spark, path).select(F.crc32("ids").alias("c"), "ids").collect()
    assert all(r.c == zlib.crc32(bytes(r.ids)) for r in sums)


def test_words_by_pieces_equal_the_library():
    from tokenizers import Tokenizer

    model, own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), token_files.encoder("byte_bpe_50k.json")
    rng = random.Random(8)
    every = [chr(c) for c in range(0x250)] + list("'''  \n\t\u00a0\u2028一é\U0001f600")
    common = list("abcDE 's't're 'll 12.,!?-\n\té×÷")
    for k in range(4000):
        text = "".join(rng.choices(every if k % 2 else common, k=rng.randint(1, 25)))
        assert np.frombuffer(own(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_small_stretches_read_the_same(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words here " * (i * 37 % 300)) for i in range(80)], "doc_id long, text string").repartition(3)
    path = str(tmp_path / "files")
    token_files.write_token_files(df, path, "byte_bpe_50k.json")
    whole = sorted(map(tuple, token_files.read_token_files(spark, path).collect()))
    spark.dataSource.register(token_files.PackedIds)
    parts = spark.read.format("packed_ids").option("blocks", 1).load(path)
    assert parts.rdd.getNumPartitions() > 10 and sorted(map(tuple, parts.collect())) == whole


def test_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(df, str(tmp_path / "e"), "byte_bpe_50k.json")
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_only_committed_shards_count(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    path = tmp_path / "files"
    token_files.write_token_files(df, str(path), "byte_bpe_50k.json")
    (path / "lost-000000-0.s8b").write_bytes(b"what a lost task left")
    assert token_files.read_token_files(spark, str(path)).count() == 20
    with pytest.raises(Exception, match="already holds"):
        token_files.write_token_files(df, str(path), "byte_bpe_50k.json")
    fails = df.select("doc_id", F.when(F.col("doc_id") < 19, F.col("text")).otherwise(F.raise_error(F.lit("broken"))).alias("text"))
    with pytest.raises(Exception, match="broken"):
        token_files.write_token_files(fails, str(tmp_path / "aborted"), "byte_bpe_50k.json")
    left = [p.name for p in (tmp_path / "aborted").iterdir()] if (tmp_path / "aborted").exists() else []
    assert "manifest.json" not in left


def test_a_shard_that_was_cut_off_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    token_files.write_token_files(df, str(tmp_path), "byte_bpe_50k.json")
    shard = tmp_path / json.loads((tmp_path / "manifest.json").read_text())["shards"][0]["name"]
    shard.write_bytes(shard.read_bytes()[:-9])
    with pytest.raises(Exception, match="cut off"):
        token_files.read_token_files(spark, str(tmp_path)).count()
