"""Fuzzy matching of the query against all pairs of a block."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from latticework.functions import scalar as S
from latticework.plans.tabular import QUERIES


def test_fuzzy_match_finds_the_best(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", S.normalise_text(F.col("p_name")).alias("name")).collect()
    want = {}
    for a in rows:
        if a.p_partkey % 2 == 0:
            other = [b for b in rows if b.p_partkey % 2 == 1 and b.p_partkey % 25 == a.p_partkey % 25 and b.name]
            want[a.p_partkey] = round(max((SequenceMatcher(None, a.name or "", b.name).ratio() for b in other), default=0.0), 6)
    got = {r.site: r.similarity for r in QUERIES["fuzzy_match"](spark, d).collect()}
    assert got == want and max(got.values()) > 0
