"""Terms that disclose rare entities go wherever they stand; redaction knows the end of every earlier span."""

import random

from pyspark.sql import functions as F

from latticework.llm import pii


def test_terms_of_an_entity_in_one_text(spark):
    rng = random.Random(3)
    noise = [f"word{k}" for k in range(40)]
    plain = [(k, "common " + " ".join(rng.choices(noise, k=60))) for k in range(400)]
    far = " ".join(rng.choices(noise, k=60))
    docs = spark.createDataFrame([*plain, (1000, f"common Zanzibarian {far} ann@corp.example {far} Zanzibarian common")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all(out[k] == t for k, t in plain)
    assert out[1000] == f"common Z_ {far} [EMAIL] {far} Z_ common"


def test_redact_inside_a_long_span(spark):
    spans = [(0, 0, 100, "replace")] + [(k, 4, k + 1, "remove") for k in range(1, 41)]
    df = spark.createDataFrame([("a" * 100 + "rest", spans)], "text string, spans array<struct<start:long,kind:int,end:long,action:string>>")
    assert df.select(pii.redact(F.col("text"), F.col("spans"))).first()[0] == "[EMAIL]rest"
