"""The pipeline's near duplicates against all pairs."""

import random

import pyarrow as pa
import pytest

from latticework.llm import jaccard

from .brute import SPACE_FREE, lower


def shingles(text, k=5):
    w = SPACE_FREE.findall(lower(text))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def smallest(rows, similarity=0.8):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and (x == y or len(x & y) >= similarity * len(x | y)):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {find(i) for i in sets}


def rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    frame = rng.choices(vocabulary, k=30)
    out = [None, "", " ", "one", "One", "a b c d", "a b c d e"]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(20, 150)) + (frame if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
            base = w if rng.random() < 0.5 else base
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_stage_drops_every_similar_text(spark, seed):
    import corpus_pipeline

    data = rows(seed)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == smallest(data)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_shared_rows_across_batches():
    rng = random.Random(4)
    grams = sorted(rng.choices(range(60), k=80))
    table = pa.table({"gram": grams, "set": list(range(80))})
    for size in (1, 2, 3, 7, 80):
        out = [r["set"] for b in jaccard._shared(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert out == [k for k, g in enumerate(grams) if grams.count(g) > 1], size
