"""Long parts link with what follows them, and keep their whole length."""

import random

import pytest

from latticework.llm import secrets


def spans(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    return [[(secrets.KINDS[s.kind], texts[i][s.start : s.end]) for s in found[i]] for i in range(len(texts))]


@pytest.mark.parametrize("n", [600, 2000, 5000])
def test_endpoint_after_a_long_secret(spark, n):
    got = spans(spark, f"token={'aB3.' * (n // 4)} https://db.example/x", f"https://db.example/{'x' * n} token=abcdefgh1")
    assert [k for k, _ in got[0]] == ["assign", "endpoint"]
    assert [k for k, _ in got[1]] == ["endpoint", "assign"]


def test_whole_length_of_weak_parts(spark):
    rng = random.Random(6)
    key = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=900))
    lower = "q7w2e9r4t1y8u3i6o5p0"
    user, url = "u" * 90, "https://db.example/" + "x" * 300
    got = spans(spark, f"user: {user}\n{key}", f"{url} {key}", f"user: bob\n{lower}")
    assert got == [[("identifier", user), ("secret", key)], [("endpoint", url), ("secret", key)], [("identifier", "bob"), ("secret", lower)]]


def test_any_number_of_spaces_stands_around_the_sign(spark):
    gap = " " * 40
    text = f"user{gap}:{gap}alice99 then aB3dE5gH7jK9mN1pQ and jdbc:averylongdrivername://db.example/x"
    assert {"identifier", "secret", "endpoint"} <= {k for k, _ in spans(spark, text)[0]}
