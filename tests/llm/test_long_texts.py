"""Texts of millions of words and of many thousand spans: exact counts, and time in proportion."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from latticework.llm import pii, quality

from . import brute


def stats_of(spark, text):
    docs = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, stats string")
    return quality.judge(docs, quality.DecisionList(())).first().stats


@pytest.mark.parametrize("n", [70_000, 1_500_000])
def test_distinct_words_of_a_long_text_repeat_nothing(spark, n):
    s = stats_of(spark, " ".join(map(str, range(n))))
    assert (s.n_words, s.n_repeat_words, s.base_failed) == (n, 0, False)


def test_repeats_of_a_long_text(spark):
    rng = random.Random(9)
    text = " ".join(rng.choices([f"w{k}" for k in range(60)], k=200_000))
    s = stats_of(spark, text)
    assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute.statistics(text)


def addresses(n):
    return " ".join(f"person{k} at user{k}@host{k}.example" for k in range(n))


def test_many_addresses_take_time_in_proportion(spark):
    took = {}
    for n in (1_000, 1_000, 20_000):
        docs = spark.createDataFrame([(1, addresses(n))], "doc_id long, text string")
        start = time.perf_counter()
        out = pii.sanitise(docs).first().text
        took[n] = time.perf_counter() - start
        assert "@" not in out and out.count("[EMAIL]") == n
    assert took[20_000] < 12 * took[1_000] + 5


def test_redact_against_slices(spark):
    rng = random.Random(8)
    rows = []
    for n in (0, 1, 5, 127, 128, 129, 400, 17_000):
        text = "".join(rng.choices("abcü🙂 ", k=3 * n + 10))
        starts = sorted(rng.sample(range(len(text)), n))
        rows.append((text, [(a, rng.randint(0, 4), min(len(text), a + rng.choice([1, 1, 2, 30])), rng.choice(["replace", "remove", "generalise"])) for a in starts]))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:long,kind:int,end:long,action:string>>")

    def redacted(text, spans):
        out, at = [], 0
        for a, kind, b, action in spans:
            if a >= at:
                out += [text[at:a], f"[{pii.KINDS[kind].upper()}]" if action == "replace" else text[a] + "_" if action == "generalise" else "_"]
            at = max(at, b)
        return "".join(out) + text[at:]

    got = {r.text: r.out for r in df.select("text", pii.redact(F.col("text"), F.col("spans")).alias("out")).collect()}
    for text, spans in rows:
        assert got[text] == redacted(text, spans)


def disclosed(rows, least=4, generalise=0.8, remove=0.95):
    """Spans of disclosing terms per row, from all pairs of a term and an entity."""
    texts = {t or "" for _, t in rows}
    base = {t: brute.private(t) for t in texts}
    names = {t: {(k, t[a:b].lower()) for a, k, b in base[t]} for t in texts}
    words = {t: {w.lower() for w in re.findall(r"[^\W_]+", t)} for t in texts}
    df_t = Counter(w for t in texts for w in words[t])
    df_e = Counter(e for t in texts for e in names[t])
    near = {}
    for t in texts:
        marked = list(t)
        for a, _, b in base[t]:
            marked[a:b] = "x" * (b - a)
        taken = {p for a, _, b in base[t] for p in range(a, b)}
        near[t] = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", "".join(marked)) if m.end() - m.start() >= least and not taken & set(range(m.start(), m.end())) and re.search(r"[^\W\d_]", m[0])] if base[t] else []
    terms = {t: {t[a:b].lower() for a, b in near[t]} for t in texts}
    both = Counter((w, e) for t in texts for w in terms[t] for e in names[t])
    out = {}
    for i, t in rows:
        t, spans = t or "", []
        for a, b in near[t]:
            w, top = t[a:b].lower(), -1.0
            for e in names[t]:
                k = both[w, e]
                information = math.log2(len(texts) / df_e[e])
                if information > 0:
                    top = max(top, 1 - math.log2((max(df_t[w], k) + 1) / k) / information)
            if top >= generalise:
                spans.append((a, b, "remove" if top >= remove else "generalise"))
        out[i] = spans
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosing_terms_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(80)] + ["ab", "12345"]
    people = [f"p{k}@corp.example" for k in range(12)] + ["10.1.2.3", "+1 (456) 555-2186"]
    rows = [(0, None), (1, "")]
    for k in range(2, 260):
        parts = rng.choices(words, k=rng.randint(5, 40)) + rng.choices([f"rare{j}" for j in range(150)], k=2)
        if rng.random() < 0.25:
            who = rng.sample(range(len(people)), rng.randint(1, 3))
            parts += [people[w] for w in who] + [f"office{w}" for w in who if rng.random() < 0.9]
        rng.shuffle(parts)
        rows.append((k, " ".join(parts)))
    rows += [(1000 + k, rows[k][1]) for k in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = disclosed(rows)
    got = {r.doc_id: [(s.start, s.end, s.action) for s in r.spans if s.kind == 4] for r in pii.find_private(docs).collect()}
    assert got == want and any(want.values())
