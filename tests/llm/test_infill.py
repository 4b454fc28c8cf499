"""Rope rearrangement against slicing, its inverse as an exact round trip, and odd tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from latticework.llm import infill


def plainly(doc_id, text, rate=90, spm=20):
    t = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(t)
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b])
    return (doc_id, n, "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b])


def texts(seed=5, n=120):
    rng = random.Random(seed)
    return [(i, "".join(rng.choices("ab é𝒳<>PSM \n", k=rng.choice([0, 1, 2, 30, 1024, 1025, 5000])))) for i in range(n)]


def test_rows_equal_plain_slicing(spark):
    rows = [*texts(), (200, None), (201, ""), (None, "no id"), (None, "no id"), (7, "tie"), (7, "tie"), (8, "x<P>y"), (9, "long " * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("key", F.lit("k")).withColumn("output", F.lit("o"))
    got = sorted(map(tuple, infill.fill_in_middle(df).collect()), key=repr)
    assert got == sorted((plainly(*r) for r in rows), key=repr)
    assert infill.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [None, r"\S+\s*", "[^b]*b"])
def test_round_trip_of_every_unit(spark, unit):
    rows = texts(6)
    filled = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, rate=100, spm_rate=50, sentinels=("«1»", "«2»", "«3»"))
    assert {r.form for r in filled.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = infill.restore_texts(filled, sentinels=("«1»", "«2»", "«3»"))
    assert {r.doc_id: r.restored for r in back.collect()} == dict(rows)


def test_units_end_where_matches_end():
    word = re.compile(r"\w+\s*")
    rope = infill.build("one two  three", word)
    assert rope.units == 3 and infill.flatten(infill.split(rope, 2)[0]) == "one two  "
    assert [infill.flatten(x) for x in infill.split(infill.build("ab!", re.compile("a")), 1)] == ["a", "b!"]


def test_splits_share_leaves_and_stay_low():
    text = "".join(random.Random(1).choices("abcdé", k=300_000))
    rope = infill.build(text)
    whole = {id(x) for x in infill.leaves(rope)}
    rng = random.Random(2)
    for _ in range(200):
        at = rng.randint(0, rope.units)
        a, b = infill.split(rope, at)
        assert a.units == at and b.units == len(text) - at
        rope = infill.concat(b, a)
        text = text[at:] + text[:at]
    assert infill.flatten(rope) == text
    assert rope.height <= 2 * len(list(infill.leaves(rope))).bit_length()
    assert len(whole & {id(x) for x in infill.leaves(rope)}) > len(whole) // 3


def test_sentinels_that_contain_each_other_are_refused(spark):
    with pytest.raises(ValueError):
        infill.fill_in_middle(spark.createDataFrame([(1, "x")], "doc_id long, text string"), sentinels=("<P>", "<P>", "<M>"))
