"""A passage that very many documents share is one context, whatever stands around it."""

import random

from latticework.llm import substrings

from . import brute


def test_common_passage_needs_no_longer_prefixes(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    passage, line = rng.choices(words, k=64), rng.choices(words, k=22)
    rows = []
    for k in range(300):
        a, b, c = (rng.choices(words, k=rng.randint(20, 60)) for _ in range(3))
        rows.append((k, " ".join(a + (passage if k % 3 else line) + b + line + c)))
    rows += [(1000 + k, " ".join(rng.choices(words, k=30) + rows[k][1].split()[:70])) for k in range(20)]
    seen = []
    groups = substrings.prefix_groups

    def counted(distinct, *rest):
        seen.append(distinct.count())
        trees, leaves = groups(distinct, *rest)
        seen.append(len(trees))
        return trees, leaves

    monkeypatch.setattr(substrings, "prefix_groups", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substrings.remove_repeats(docs, group_limit=50).select("doc_id", "n_words", "n_removed", "kept_sha256")
    want = sorted(map(tuple, brute.repeats(rows)))
    assert sorted(map(tuple, out.collect())) == want
    assert seen[1] == 1 and seen[0] < 300
