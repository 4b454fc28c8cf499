"""Language identification step by step against plain Python: n-grams, decoding, what is held out and what is learned from."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from latticework.llm import language

M = 2**64


def grams(text):
    """Hashed n-grams of the lower-cased text; a run of other characters is one boundary."""
    codes, before = [], True
    for c in text.lower():
        letter = c.isalpha()
        if letter or before:
            codes.append(ord(c) if letter else 0)
        before = letter
    out = [0.0] * language.BUCKETS
    for k in (1, 2, 3, 4):
        for i in range(len(codes) - k + 1):
            h = k * 0x9E3779B97F4A7C15 % M
            for c in codes[i : i + k]:
                h = (h ^ c) * 0x100000001B3 % M
                h ^= h >> 29
            out[(h * 0xD6E8FEB86659FD93 % M) >> (64 - language.BITS)] += 1
    return out


def test_features():
    rng = random.Random(3)
    texts = [None, "", "a", "  ..", "Straße 12 é", "x" * 3000, *("".join(rng.choices("abCé ß.1\n🙂中", k=rng.randint(0, 60))) for _ in range(60))]
    seen = 0
    for first, counts, letters in language._chunks(pa.array(texts, pa.string()), rows=7):
        for k, (row, n) in enumerate(zip(counts, letters, strict=True)):
            t = texts[first + k] or ""
            assert row.tolist() == grams(t) and n == sum(c.isalpha() for c in t.lower()), t
            seen += 1
    assert seen == len(texts)


def test_codewords_of_few_languages_are_all_splits():
    code = language.codewords(4)
    columns = {tuple(c) for c in code.T.tolist()}
    assert len(columns) == code.shape[1] == 7 and {tuple(1 - x for x in c) for c in columns}.isdisjoint(columns)


def test_decoding():
    rng = np.random.default_rng(4)
    model = language.Model(["a", "b", "c"], rng.random((3, language.BUCKETS)))
    model.rates = rng.uniform(0.1, 1, model.code.shape)
    counts = rng.integers(0, 3, (20, language.BUCKETS)).astype(np.float32)
    best, score, lead = model.decode(counts)
    margins = model.margins(counts)
    for i in range(20):
        loss = []
        for lang in range(3):
            w = model.rates[lang] / model.rates[lang].sum()
            loss.append(sum(w[b] * math.exp(-(1 if model.code[lang][b] else -1) * margins[i][b]) for b in range(model.code.shape[1])))
        p = sorted((math.exp(-6 * (x - min(loss))) for x in loss), reverse=True)
        assert best[i] == loss.index(min(loss)) and math.isclose(score[i], p[0] / sum(p), rel_tol=1e-5) and math.isclose(lead[i], (p[0] - p[1]) / sum(p), rel_tol=1e-4, abs_tol=1e-6)


def test_weights_and_rates(spark):
    """Totals of all rows make the weights; each half is rated by classifiers of the other."""
    rng = random.Random(6)
    stems = {"en": ["the", "ing", "wh"], "de": ["sch", "ung", "der"], "fr": ["eau", "que", "oi"]}
    rows = [(" ".join("".join(rng.choices(stems[x], k=2)) for _ in range(6)), x) for x in rng.choices(list(stems), k=90)] + [(None, "en"), ("the", None), ("12", "de")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    model = language.fit_language(docs)
    assert model.langs == ["de", "en", "fr"]
    half = {r.text: r.h for r in docs.selectExpr("text", "pmod(xxhash64(text), 2) AS h").collect()}
    total = {h: np.zeros((3, language.BUCKETS)) for h in (0, 1)}
    for t, x in rows:
        if t and x:
            g = np.array(grams(t), np.float32)
            total[half[t]][model.langs.index(x)] += g / np.sqrt(max(g.sum(), 1))
    plain = [language.Model(model.langs, total[1 - h]) for h in (0, 1)]
    assert np.allclose(model.weights, language.Model(model.langs, total[0] + total[1]).weights, atol=1e-4)
    right, seen = np.zeros(model.code.shape), np.zeros(3)
    for t, x in rows:
        if t and x and any(c.isalpha() for c in t):
            k = model.langs.index(x)
            right[k] += (plain[half[t]].margins(np.array([grams(t)], np.float32))[0] > 0) == (model.code[k] == 1)
            seen[k] += 1
    assert np.allclose(model.rates, np.maximum(0.05, 2 * (right + 1) / (seen[:, None] + 2) - 1), atol=0.06)


def test_the_query_learns_from_nothing_held_out(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held = {str(r.doc_id): zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs.select("doc_id").collect()}
    first = language.op1_language(spark, d).orderBy("doc_id").collect()
    assert all(r.held_out == held[str(r.doc_id)] and 0 <= r.score <= 1 for r in first)
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 'zz' ELSE lang END AS lang", "'s' AS source")
    other.write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in language.op1_language(spark, str(tmp_path)).orderBy("doc_id").collect()] == [tuple(r) for r in first]
    known = {r.doc_id: r.lang for r in docs.filter("lang IS NOT NULL AND text IS NOT NULL").collect()}
    judged = [r.lang_pred == known[r.doc_id] for r in first if r.held_out and r.doc_id in known]
    assert sum(judged) >= 0.85 * len(judged)


def test_letters_of_every_plane_count():
    import numpy as np

    from latticework.llm import language

    points = np.array([0x30000, 0x30010, 0x20, 0x10FFFF, ord("a")], np.uint32)
    _, letters = language.features(points, np.array([0, 2, 5]))
    assert letters.tolist() == [2, 1]
