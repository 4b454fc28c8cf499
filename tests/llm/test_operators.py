"""The corpus operators against brute force, on awkward rows: nulls, empty and long texts, repeats, ties, no rows, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from latticework.llm import decontaminate, language, licenses, mixing, pii, quality, secrets, simhash, substrings, token_counts

from . import brute

PIECES = ["the", "of", "Ünï", "a", "mit license", "Apache License", "x@y.org", "+1 (456) 555-2186", "4111 1111 1111 1111", "10.2.3.4", "password=abcdefgh1", "AKIA" + "A1" * 8, "de" * 20, "#", "|", "ok!", "\n", "\n\n", "  ", "🙂", "general public license", ".", "user: bob"]


def texts(n, seed=1):
    rng = random.Random(seed)
    common = [" ".join(rng.choices("abcdefghij", k=rng.randint(60, 90))) for _ in range(3)]
    out = [None, "", " \n\t", "one", "one", "the " * 400, "z" * 30000, "7 " * 9000]
    while len(out) < n:
        parts = rng.choices(PIECES, k=rng.randint(1, 30)) + rng.choices(common, k=rng.choice([0, 0, 1, 2]))
        rng.shuffle(parts)
        out.append(" ".join(parts))
        if rng.random() < 0.2:
            out.append(out[-1] + rng.choice(["", " the", ""]))
    return out[:n]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts(160)))


@pytest.fixture(scope="module")
def docs(spark, rows):
    langs, sources = ["en", "de", None], ["s1", "s2", "s2", None]
    data = [(i, t, langs[i % 3], sources[i % 4], 1, "x", 2) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, id string, fp int").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_decontaminate(spark, docs, rows, none):
    items = [(1, " ".join(rows[40][1].split()[:14])), (2, "Mit License"), (2, "mit license"), (3, None), (4, "..."), (None, rows[50][1]), (5, "not there at all ever")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 200, 40):  # one block, one batch of blocks, several batches
        found = decontaminate.find_contamination(docs, table, block_bytes=block)
        out = found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("s"))
        assert got(out, "doc_id", "n_words", "n_hit", "n", "s") == sorted(x[:5] for x in brute.contamination(rows, items))
    clean = {x[0] for x in brute.contamination(rows, items) if not x[5]}
    for block in (1 << 20, 40):
        kept = decontaminate.remove_contaminated(docs, table, block_bytes=block)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    assert decontaminate.find_contamination(none, table).count() == 0
    assert decontaminate.find_contamination(docs, table.limit(0)).filter("n_hit > 0").count() == 0


def test_a_worker_builds_each_index_once(monkeypatch):
    """Three blocks over five shards; pairs are listed in slices, and equal windows of many items once a place."""
    import pyarrow as pa

    class Held:
        def __init__(self, value):
            self.value = value

    passage = " ".join(f"p{i}" for i in range(25))
    blocks = [(f"b{k}", Held(([f"i{k}-{j}" for j in range(20)], [f"own{j} {passage} z{j}" for j in range(20)]))) for k in range(3)]
    texts_ = [f"{passage} tail{i}" if i % 3 else "nothing known here" for i in range(50)]
    built = []
    whole = decontaminate.ItemIndex
    monkeypatch.setattr(decontaminate, "ItemIndex", lambda *x: built.append(1) or whole(*x))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 1200)
    monkeypatch.setattr(decontaminate, "PAIRS", 1000)
    monkeypatch.setattr(decontaminate, "_INDEXES", {})
    for _ in range(2):
        found = [m for _, _, x, _ in decontaminate._scan(blocks, 10, pa.array(texts_)) for m in x]
    assert len(built) == 3 and len(found) == 50
    for i, m in enumerate(found):
        assert sorted(m) == (sorted((f"i{k}-{j}", 1, 0, 25) for k in range(3) for j in range(20)) if i % 3 else [])


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x x " + " ".join(f"w{i}" for i in range(5, 27)) + " y")], "doc_id long, text string")
    found = decontaminate.find_contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in found.matches] == [("9", 5, 2, 22)]


def test_simhash(docs, rows, none):
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(brute.near_duplicates(rows))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute.near_duplicates(rows)})
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_simhash_repeated_rows(spark):
    data = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r s t u v w"), (2, "other words here now")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e f"), (2, "other words here now"), (2, "q r s t u v w")]


def test_simhash_ties_do_not_depend_on_partitions(spark):
    data = [(1, "a b c d e f", x, {"k": x}) for x in "pqrstu"]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, extra map<string,string>")
    kept = [simhash.drop_near_duplicates(d).collect() for d in (docs.repartition(4), docs.coalesce(1), docs.repartition(2, "source"))]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2]


def test_simhash_links_in_crowded_cells(spark):
    """A crowded cell, dealt out in chunks, gives the same components as one compared whole; chains link through neighbours."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    base = rng.getrandbits(64)
    for a in range(0, 40):
        fps.add(base ^ (1 << a) ^ (1 << (a + 3)))
    chain = rng.getrandbits(64)
    for a in range(0, 60, 4):
        fps.add(chain)
        chain ^= 0b1111 << a
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 4:
                root[find(x)] = find(y)
    want = {frozenset(y for y in fps if find(y) == find(x)) for x in fps}
    for limit in (20_000, 5):
        found = simhash.components(simhash.links(distinct, cell_limit=limit)).collect()
        group = {}
        for r in found:
            group.setdefault(r.root % (1 << 64), {r.root % (1 << 64)}).add(r.node % (1 << 64))
        linked = {frozenset(v) for v in group.values()}
        assert linked == {x for x in want if len(x) > 1}


@pytest.mark.parametrize("limit", [50_000, 2])
def test_substrings(docs, rows, none, limit):
    out = substrings.remove_repeats(docs, group_limit=limit)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeats(rows))
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    out = substrings.remove_repeats(spark.createDataFrame([(5, t), (5, t), (None, t)], "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.n_removed) for r in out.collect()) == [(False, 0), (False, 0), (True, 60)]


def test_pii(docs, rows, none):
    found = {r.doc_id: r for r in pii.find_private(docs).collect()}
    for i, t in rows:
        assert [(s.start, s.kind, s.end) for s in found[i].spans if s.kind < 4] == brute.private(t or ""), t
    digest = {r.doc_id: r.d for r in pii.find_private(docs).select("doc_id", F.sha2(pii.spelled(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("d")).collect()}
    assert all(digest[i] == brute.sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute.private(t or ""))) for i, t in rows)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    after = {r.doc_id: r.text for r in clean.collect()}
    for i, t in rows:
        assert (after[i] == t) == (not found[i].spans)
        assert "x@y.org" not in (after[i] or "")
    assert pii.sanitise(none).count() == 0


def test_pii_terms_that_disclose(spark):
    """A word that stands by one address in several texts and hardly elsewhere goes; a common word stays."""
    rng = random.Random(2)
    noise = [f"word{k}" for k in range(300)]
    plain = [(k, "common " + " ".join(rng.choices(noise, k=30))) for k in range(200)]
    marked = [(1000 + k, f"common {' '.join(rng.choices(noise, k=20))} contact Zanzibarian ann@corp.example now {' '.join(rng.choices(noise, k=5))}") for k in range(5)]
    docs = spark.createDataFrame(plain + marked, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for k, t in plain:
        assert out[k] == t
    for k, _ in marked:
        assert "Zanzibarian" not in out[k] and "[EMAIL]" in out[k] and out[k].startswith("common ")


def test_secrets(docs, rows, none):
    found = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    digest = {r.doc_id: r.d for r in secrets.find_secrets(docs).select("doc_id", F.sha2(secrets.spelled(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("d")).collect()}
    for i, t in rows:
        assert [(s.start, s.kind, s.end) for s in found[i].spans if s.kind < 3] == brute.secrets(t or ""), t
        assert digest[i] == brute.sha(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in brute.secrets(t or "")))
    assert secrets.find_secrets(none).count() == 0


def test_secret_parts_link_within_scope(spark):
    key = "aB3dE5gH7jK9mN1pQ"
    data = [(1, f"login: bob\n{key}"), (2, f"login: bob\n\n{key}"), (3, key), (4, f"https://db.example/x {'-' * 10} {key}"), (5, f"login: bob{' .' * 300}\n{key}")]
    found = {r.doc_id: [secrets.KINDS[s.kind] for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found == {1: ["identifier", "secret"], 2: [], 3: [], 4: ["endpoint", "secret"], 5: []}


def test_token_counts(spark, docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))
    cache = str(tmp_path / "cache")
    want = sorted((i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for _ in range(2):
        out = token_counts.count_tokens(docs, "byte_bpe_50k.json", cache)
        assert got(out, "doc_id", "n_bytes", "n_tokens") == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in rows})
    for r in out.collect():
        assert r.over_limit == (r.n_tokens > 1024) and r.content_digest == brute.sha(rows[r.doc_id][1] or "")
    assert token_counts.count_tokens(none, "byte_bpe_50k.json", cache).count() == 0


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_only_missing_texts_are_encoded(spark, docs, rows, tmp_path, monkeypatch, broadcast):
    """A warm cache: misses alone are appended, a stored count is used as it is, and hits' texts stay where they are."""
    monkeypatch.setattr(token_counts, "BROADCAST_MISSES", broadcast)
    cache = str(tmp_path / "cache")
    first = {t or "" for i, t in rows if i % 2}
    token_counts.count_tokens(docs.filter("doc_id % 2 = 1"), "byte_bpe_50k.json", cache).collect()
    assert spark.read.parquet(cache).count() == len(first)
    version = token_counts.tokenizer_digest("byte_bpe_50k.json")
    content = docs.select(F.coalesce("text", F.lit("")).alias("_text")).withColumn("_key", F.unhex(F.sha2("_text", 256)))
    plan = token_counts.missing_texts(content, content.select("_key").distinct(), token_counts.read_cache(spark, cache, version))
    text = plan._jdf.queryExecution().executedPlan().toString()
    if broadcast:
        assert text.index("BroadcastHashJoin") > text.index("Exchange hashpartitioning(_key")  # the join is below the only shuffle of texts
    assert plan.count() == len({t or "" for _, t in rows} - first)
    out = token_counts.count_tokens(docs, "byte_bpe_50k.json", cache)
    assert out.filter("n_tokens IS NULL").count() == 0 and out.count() == len(rows)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})


def test_token_counts_of_random_text():
    from tokenizers import Tokenizer

    rng = random.Random(4)
    parts = ["a", "é", " ", "\n", "  ", "\t", "'s", "1", "!", "\xa0", "<|endoftext|>", "中", "B", "\0", "🙂", " \n"]
    texts_ = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(5000)]
    model = Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))
    assert token_counts.counter("byte_bpe_50k.json")(texts_) == [len(e.ids) for e in model.encode_batch(texts_, add_special_tokens=False)]


def test_mixing(docs, rows, none):
    out = mixing.mix_sources(docs).collect()
    assert sorted(r.doc_id for r in out) == [i for i, _ in rows]
    size = {i: len(brute.SPACE_FREE.findall(t or "")) for i, t in rows}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in out)
    total = sum(size.values())
    taken, target = {}, {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= 0.01 * total for s in target)
    assert mixing.mix_sources(none).count() == 0


def test_mixing_reruns_agree(docs):
    key = lambda df: sorted((r.doc_id, r.taken) for r in df.collect())
    assert key(mixing.mix_sources(docs)) == key(mixing.mix_sources(docs.repartition(5)))


def test_targets_share_the_excess(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), (None, 400), ("c", 0)], "source string, source_size long")
    out = {r.source: r.target for r in mixing.target_words(sources, 1410, (5.0, 2.0, 1.0), 3).collect()}
    # a (weight 5) stops at 30, c (weight 1) at 0; b (2) and null (5) share 1380 as 2 to 5, within their caps.
    assert out["a"] == 30 and out["c"] == 0
    assert out["b"] == pytest.approx(1380 * 2 / 7) and out[None] == pytest.approx(1380 * 5 / 7)


def test_quality(spark, docs, rows, none):
    out = {r.doc_id: r.stats for r in quality.judge(docs, quality.DecisionList(())).select("doc_id", "stats").collect()}
    for i, t in rows:
        s = brute.statistics(t)
        assert tuple(out[i][c] for c in quality.COUNTS) == s, t
        assert out[i].base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and out[i].kept == (not out[i].base_failed)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    assert quality.keep_good(none, labels).count() == 0
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in out if out[i].kept}


def test_quality_learns_planted_rules(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]

    def text(kind):
        w = rng.choices(words, k=120)
        return " ".join(x + "%%%" for x in w) if kind == 1 else " ".join(x.upper() + "!!" for x in w) if kind == 2 else " ".join(w)

    kinds = [rng.choice([0, 0, 0, 1, 2]) for _ in range(400)]
    docs = spark.createDataFrame([(i, text(k)) for i, k in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k == 0)) for i, k in enumerate(kinds) if i < 300], "doc_id long, quality int")
    rules = quality.fit_quality(docs, labels)
    assert rules.rules and rules.sql().startswith("CASE WHEN ")
    verdict = {r.doc_id: r.kept for r in quality.judge(docs, rules).select("doc_id", "stats.kept").collect()}
    assert all(verdict[i] == (k == 0) for i, k in enumerate(kinds))


def test_language(spark, none):
    rng = random.Random(1)
    stems = {"en": ["the", "ing", "tion", "wh"], "de": ["sch", "ung", "ß", "der"], "fr": ["eau", "oi", "é", "que"]}
    data = [(i, " ".join("".join(rng.choices(stems[x], k=3)) for _ in range(20)), x) for i, x in enumerate(rng.choices(list(stems), k=240))]
    data += [(900, None, "en"), (901, "123 !?", "de"), (902, "", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit_language(docs.filter("doc_id % 3 != 1"))
    out = {r.doc_id: r for r in language.identify_language(docs, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    held = [(i, x) for i, _, x in data[:240] if i % 3 == 1]
    assert sum(out[i].lang_pred == x for i, x in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())
    nothing = language.fit_language(docs.limit(0))
    assert {r.lang_pred for r in language.identify_language(docs, nothing).collect()} == {"und"}
    one = language.fit_language(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in language.identify_language(docs, one).collect()} == {"und", "en"}
    assert language.identify_language(none, model).count() == 0


@pytest.mark.parametrize("n", [2, 4, 6, 9, 40])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len({tuple(x) for x in code}) == n
    assert (code.min(axis=0) < code.max(axis=0)).all()


def test_licenses(docs, rows, none):
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in rows:
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == brute.phrases(t, licenses.PHRASES), t
    assert licenses.scan_licenses(none).count() == 0


def test_license_templates(spark):
    mit = licenses.TEMPLATES["mit-text"].replace("{{12}}", "THE AUTHORS").replace("[[(including the next paragraph)]]", "")
    texts_ = [f"x {mit} y", mit.replace("without restriction", "with restriction"), "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-ND."]
    found = {r.doc_id: [m.label for m in r.matches] for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")).collect()}
    assert found == {0: ["mit-text"], 1: [], 2: ["cc-by-nc"], 3: []}
    a = licenses.compile_template("t", "a b [[c d]] e {{2}} f")
    assert [a.accept(x.split()) for x in ("a b e f", "a b c d e x y f", "a b c e f", "a b e x y z f")] == [4, 8, -1, -1]
