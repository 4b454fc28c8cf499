"""Sequential covering against the same rules found in plain Python over the rows themselves."""

import math
import random

import numpy as np
import pytest

from latticework.llm import quality

QUANTILES = [0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995]


def covering(rows, features, max_rules=8, max_conditions=3, min_precision=0.95, min_covered=5):
    """rows: (label, grow, {feature: value}); conditions are (feature, at least, threshold)."""
    edges, gaps = {}, {}
    for f in features:
        seen = set()
        for k in (0, 1):
            v = [r[2][f] for r in rows if r[0] == k]
            seen |= {float(x) for x in np.percentile(v, [100 * q for q in QUANTILES])} | {min(v), max(v)}
        s = sorted(seen)
        edges[f] = [(a + b) / 2 for a, b in zip(s[:-1], s[1:], strict=True)]
        gaps[f] = [(b - a) / (abs(a) + abs(b)) for a, b in zip(s[:-1], s[1:], strict=True)]

    def holds(conditions, r):
        return all((r[2][f] >= t) == up for f, up, t in conditions)

    left, rules = list(rows), []
    while len(rules) < max_rules:
        chosen = []
        while len(chosen) < max_conditions:
            own = [r for r in left if r[1] and holds(chosen, r)]
            p0, n0 = (sum(r[0] == k for r in own) for k in (0, 1))
            if not p0 or not n0:
                break
            best = (1e-9, 0.0, None)
            for f in features:
                for t, gap in zip(edges[f], gaps[f], strict=True):
                    for up in (True, False):
                        p, n = (sum(r[0] == k and (r[2][f] >= t) == up for r in own) for k in (0, 1))
                        gain = round(p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), 9) if p else 0.0
                        best = max(best, (gain, gap, (f, up, t)), key=lambda x: x[:2])
            if best[2] is None:
                break
            chosen.append(best[2])
        if not chosen:
            break
        scored = []
        for k in range(1, len(chosen) + 1):
            held = [r[0] for r in left if not r[1] and holds(chosen[:k], r)]
            p, n = held.count(0), held.count(1)
            scored.append(((p - n) / (p + n) if p + n else -1.0, -k, k, p, n))
        _, _, k, p, n = max(scored)
        if p + n < min_covered or p / (p + n) < min_precision:
            break
        rules.append((chosen[:k], p / (p + n), p + n))
        left = [r for r in left if not holds(chosen[:k], r)]
    return rules


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_are_those_of_plain_covering(spark, seed):
    rng = random.Random(seed)
    features = ["u", "v", "w"]
    rows = []
    for _ in range(500):
        s = {"u": rng.gauss(0, 1), "v": rng.uniform(0, 1), "w": float(rng.randint(0, 6))}
        bad = s["u"] > 1.0 or (s["v"] < 0.2 and s["w"] >= 4)
        rows.append((0 if bad and rng.random() < 0.98 else 1, rng.random() < 0.66, s))
    df = spark.createDataFrame([(a, b, tuple(s[f] for f in features)) for a, b, s in rows], "label int, grow boolean, stats struct<u:double,v:double,w:double>")
    got = [([(c.feature, c.at_least, c.threshold) for c in r.conditions], r.precision, r.covered) for r in quality.learn(df, features).rules]
    want = covering(rows, features)
    assert len(got) == len(want) and want
    for (conditions, precision, covered), (own, p, n) in zip(got, want, strict=True):
        assert [(f, up) for f, up, _ in conditions] == [(f, up) for f, up, _ in own]
        assert [t for _, _, t in conditions] == pytest.approx([t for _, _, t in own], abs=1e-9) and (precision, covered) == (p, n)
