"""A group of near copies makes pairs by its size, not its square, and loses none of its links."""

import random

from latticework.llm import jaccard

from .test_jaccard import smallest


def test_near_copies_make_few_pairs(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    base = rng.choices(vocabulary, k=160)
    data = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(160), 4):
            w[k] = rng.choice(vocabulary)
        data.append((i, " ".join(w)))
    seen = []
    real = jaccard._counted
    monkeypatch.setattr(jaccard, "_counted", lambda pairs, similarity: seen.append(pairs.select("a", "b").distinct().count()) or real(pairs, similarity))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string").repartition(3), "")
    assert {r.doc_id for r in kept.collect()} == smallest(data)
    assert seen[-1] < 4 * len(data)
