"""Operators and pipeline stages on tables with nulls, no rows, repeated rows and columns whose names clash with working ones."""

import random

import pytest
from pyspark.sql import functions as F

from latticework.llm import common, decontaminate, infill, language, licenses, mixing, pii, quality, secrets, simhash, source_terms, substrings, token_counts, token_files

CLASHING = ["id", "text_hash", "spans", "stats", "key", "class_id", "fp", "_id", "_hash", "h", "terms", "told", "node", "root", "rows", "n", "quality_w", "quality_stats", "pii_key", "near_dup_key", "base", "chunk", "row"]


def rows():
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    out = []
    for i in range(60):
        t = " ".join(rng.choices(words, k=rng.randint(55, 120)))
        if i % 7 == 0:
            t += f" mail p{i}@corp.example user: bob{i} aB3dE5gH7jK9mN1pQ licensed under the MIT License"
        out.append((i, t, "en" if i % 3 else "de", ["s1", "s2", None][i % 3], len(t)))
    out += [(60, out[3][1], "en", "s1", 1), (61, out[4][1] + " tail", None, None, None), (62, None, None, None, None), (63, "", "en", "s2", 0), (None, out[5][1], "en", "s1", 5), (64, out[6][1], "en", "s1", 7), (64, out[6][1], "en", "s1", 7), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, plain):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, " ".join(rows()[8][1].split()[:15])), (None, None), (2, "")], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    plain.write.parquet(str(d / "documents.parquet"))
    return str(d)


def wide(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def as_set(df, columns):
    return sorted((tuple(map(str, r)) for r in df.select(*columns).collect()))


def test_stages_keep_clashing_columns(spark, plain, sf_dir):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        narrow, broad = stage(spark, plain, sf_dir), stage(spark, wide(plain), sf_dir)
        kept = [c for c in narrow.columns if c in plain.columns] if name != "source_mix" else narrow.columns
        assert as_set(broad, kept) == as_set(narrow, kept), name
        if name != "source_mix":
            assert broad.columns == wide(plain).columns and all(set(r) == {f"own {c}" for c in CLASHING} for r in broad.select(*CLASHING).collect()), name
            assert stage(spark, wide(plain).limit(0), sf_dir).count() == 0
            assert stage(spark, plain.filter("text IS NULL OR text = ''"), sf_dir).count() <= 3


def test_stages_without_other_tables(spark, plain, sf_dir, tmp_path):
    import corpus_pipeline

    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert stages["decontaminate"](spark, plain, str(tmp_path)).count() == plain.count()
    kept = quality.judge(plain, quality.DecisionList(())).filter("stats.kept").count()
    assert stages["quality_rules"](spark, plain, str(tmp_path)).count() == kept


def test_the_pipeline_runs_on_them(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= len(rows()) and out.filter("taken > 3 * size").count() == 0


def test_operators_with_clashing_columns(spark, plain, tmp_path, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    model = language.fit_language(plain)

    def token_files_of(d):
        path = common.fresh_path(spark, "token-files")
        token_files.write_token_files(d, path, "byte_bpe_50k.json")
        return token_files.read_token_files(spark, path).withColumn("ids", F.hex("ids"))

    runs = {
        "infill": lambda d: infill.restore_texts(infill.fill_in_middle(d)),
        "token_files": token_files_of,
        "language": lambda d: language.identify_language(d, model),
        "pii": lambda d: pii.find_private(d).withColumn("spans", F.to_json("spans")),
        "decontaminate": lambda d: decontaminate.find_contamination(d, items).withColumn("matches", F.to_json("matches")),
        "simhash": lambda d: simhash.near_duplicates(d).select("doc_id", "fingerprint", "component_id"),
        "secrets": lambda d: secrets.find_secrets(d).withColumn("spans", F.to_json("spans")),
        "tokens": lambda d: token_counts.count_tokens(d, "byte_bpe_50k.json", str(tmp_path / "cache")),
        "substrings": lambda d: substrings.remove_repeats(d),
        "mixing": lambda d: mixing.mix_sources(d),
        "licenses": lambda d: licenses.scan_licenses(d).withColumn("matches", F.to_json("matches")),
    }
    for name, run in runs.items():
        a, b = run(plain), run(wide(plain))
        assert a.columns == b.columns and as_set(a, a.columns) == as_set(b, a.columns), name
        assert a.count() == plain.count(), name
        assert run(wide(plain).limit(0)).count() == 0, name


def test_source_terms_with_clashing_columns(spark, plain):
    a, b = source_terms.audit_sources(plain), source_terms.audit_sources(wide(plain))
    assert a.columns == b.columns and as_set(a, a.columns) == as_set(b, a.columns) and a.count() > 0
    assert source_terms.audit_sources(wide(plain).limit(0)).count() == 0


def test_labelled_sample_is_bounded_and_repeatable(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, 0), (8, 1), (None, 1), (400, 5)], "doc_id long, quality int")
    got = [sorted(map(tuple, quality.labelled_sample(d, fit_rows=50).collect())) for d in (labels, labels.repartition(5), labels.orderBy(F.desc("doc_id")))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 50
    every = {r.label_id for r in quality.labelled_sample(labels).collect()}
    assert every == set(range(300)) - {7, 8}  # these have both labels
    hashes = {r.doc_id: r.h for r in labels.filter("doc_id < 300").selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    assert {x for x, _ in got[0]} == set(sorted(every, key=lambda x: (hashes[x], x))[:50])
