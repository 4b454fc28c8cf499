"""Template markup against its expansion into regular expressions, with labels and scores of the query."""

import random
import re

from latticework.llm import licenses

from . import brute

TEMPLATES = {"one": "alpha beta [[gamma [[delta]] ]]end", "two": "alpha {{2}} omega", "three": "mit [[license ]]{{1}} beta"}


def pattern(template):
    """The template as a regular expression over words that end in a space."""
    out, at = "", 0
    for m in [*re.finditer(r"\[\[|\]\]|\{\{(\d+)\}\}", template), None]:
        out += "".join(re.escape(w) + " " for w in re.findall(r"\w+", template[at : m.start() if m else len(template)]))
        if m:
            out += "(?:" if m[0] == "[[" else ")?" if m[0] == "]]" else "(?:\\S+ ){0,%s}" % m[1]
            at = m.end()
    return out


def matches(words):
    """label, first word, end: longest matches of each template, from the left, without overlap."""
    found = []
    for label, template in TEMPLATES.items():
        at = 0
        while at < len(words):
            ends = [e for e in range(len(words), at, -1) if re.fullmatch(pattern(template), "".join(w + " " for w in words[at:e]))]
            found += [(label, at, ends[0])] if ends else []
            at = ends[0] if ends else at + 1
    return sorted(found)


def test_templates_phrases_labels_and_score(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "end", "omega", "mit", "license", "apache", "x"]
    rows = [(0, None), (1, ""), (2, "...")] + [(k, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for k in range(3, 220)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, labels int")
    out = {r.doc_id: r for r in licenses.scan_licenses(docs, TEMPLATES).collect()}
    hits = 0
    for i, t in rows:
        own = brute.LETTERS.findall(brute.lower(t))
        want = matches(own)
        hits += len(want)
        assert sorted((m.label, m.first, m.end) for m in out[i].matches) == want, t
        n_base = brute.phrases(t, licenses.PHRASES)[1]
        assert out[i].score == (1.0 if want else 0.5 if n_base else 0.0)
    assert hits > 50


def test_the_query_joins_labels(spark, tmp_path):
    texts = [None, "", "Released under the MIT License", "see the Apache license, the apache license", "This is free software", licenses.TEMPLATES["unlicense-text"]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in licenses.op10_licenses(spark, str(tmp_path)).collect()}
    assert [(out[i].base_labels, out[i].labels, out[i].score) for i in range(6)] == [
        ("", "", 0.0), ("", "", 0.0), ("mit", "mit,mit-released", 1.0), ("apache", "apache", 0.5), ("", "", 0.0), ("", "unlicense-text", 1.0),
    ]
