"""The audit of sources against plain counting, tries against dicts, sums in small squares and blocks."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import source_terms

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plainly(rows, min_docs=10, top=10):
    docs, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        docs.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [w for (x, w), n in docs.items() if x == lang and n >= min_docs]
        v = len(kept)
        total = {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        share = lambda c, n, v=v: 1 + 10**9 * (c + 2) // (n + 2 * v)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(f(share(counts[lang, s][w], total[s]), share(counts[lang, o][w], total[o])) for w in kept), o) for o in sources - {s}]
            terms = []
            for w in kept:
                p, q = share(counts[lang, s][w], total[s]), share(sum(counts[lang, o][w] for o in sources), sum(total.values()))
                if counts[lang, s][w] and p > q:
                    terms.append((f(p, q), w))
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def rows(seed=3, n=400):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("to", "Tor", "tÉ", "über", "x", "") for b in ("", "a", "Ab", "zz", "é", "一", "\U0001f600")]
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s0"] * 5 + ["s1", "s2", "é", None])
        out.append((lang, source, " 3-".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 30)))))
    return out + [("fr", "only", None), ("fr", "two", "rare words"), ("it", "alone", "a b"), (None, None, None), ("en", "empty", ""), ("en", "empty2", "12 34")]


def test_equals_plain_counting(spark):
    data = rows()
    df = spark.createDataFrame(data, "lang string, source string, text string").repartition(5)
    got = source_terms.audit_sources(df.withColumn("term", F.lit("x")).withColumn("counts", F.lit(1)))
    assert sorted(map(tuple, got.collect())) == plainly(data)
    assert source_terms.audit_sources(df.limit(0)).count() == 0


def test_small_limits_change_nothing(spark, monkeypatch):
    """Tries written early, small slices of texts, squares of two sources, sums given out often: in the counters themselves."""
    data = rows(9)
    for name, value in (("TRIE_LEAVES", 20), ("GATHERED_TERMS", 7), ("SLICE_BYTES", 5), ("BLOCK_TERMS", 3), ("SQUARE", 2), ("HELD_SUMS", 6)):
        monkeypatch.setattr(source_terms, name, value)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([(r[k] or "") for r in data], pa.string()) for k in range(3)], names=["lang", "source", "text"])
    leaves = [r for b in source_terms.count_terms(iter([batch])) for r in b.to_pylist()]
    assert len(leaves) > len({(r["lang"], r["term"]) for r in leaves})
    leaves.sort(key=lambda r: (r["lang"].encode(), r["term"].encode()))
    folded = pa.RecordBatch.from_pylist(leaves, schema=pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))
    kept = [r for b in source_terms.folding(10)(iter([folded])) for r in b.to_pylist()]
    sources, totals = defaultdict(set), Counter()
    for lang, source, _ in data:
        sources[lang or ""].add(source or "")
    for r in kept:
        totals.update({(r["lang"], s): n for s, n in zip(r["sources"], r["counts"], strict=True)})
    terms = Counter(r["lang"] for r in kept)
    for r in kept:
        names = sorted(sources[r["lang"]])
        r |= {"groups": names, "totals": [totals[r["lang"], s] for s in names], "terms": terms[r["lang"]]}
        r.pop("docs")
    found = Counter()
    best = defaultdict(list)
    for b in source_terms.summing(10)(iter([pa.RecordBatch.from_pylist(kept)])):
        for r in b.to_pylist():
            if r["part"] == "pair":
                found[r["lang"], r["source"], r["item"]] += r["value"]
            else:
                best[r["lang"], r["source"]].append((r["item"], r["value"]))
    want = plainly(data)
    assert {k: v for k, v in found.items() if v} == {(r[0], r[1], r[3]): r[4] for r in want if r[2] == "pair" and r[4] and r[1] < r[3]}
    assert {k: sorted(v) for k, v in best.items()} == {k: sorted((r[3], r[4]) for r in want if r[2] == "term" and r[:2] == k) for k in {r[:2] for r in want if r[2] == "term"}}


def test_trie_walks_in_byte_order():
    rng = random.Random(1)
    trie, plain = source_terms.RadixTrie(), {}
    for _ in range(5000):
        key = bytes(rng.choices(b"ab\xc3\xff", k=rng.randint(0, 9)))
        plain[key] = trie.known[key]
    assert list(trie.walk()) == sorted(plain.items()) and len(trie) == len(plain) == len(set(plain.values()))


@pytest.mark.parametrize("total", [1, 7, 10**9, 2**52])
def test_shares_are_exact(total):
    a = np.array(sorted({0, 1, total // 3, total - 1, total}), np.int64)
    assert source_terms.scaled(a, total).tolist() == [10**9 * int(x) // total for x in a]


def test_one_hot_source_and_a_very_long_text(spark):
    data = [("en", "hot", f"common w{chr(97 + i % 26)}") for i in range(900)] + [("en", f"s{i % 30}", "common other") for i in range(300)] + [("en", "long", "common " * 400_000)]
    df = spark.createDataFrame(data, "lang string, source string, text string").repartition(6)
    assert sorted(map(tuple, source_terms.audit_sources(df).collect())) == plainly(data)
