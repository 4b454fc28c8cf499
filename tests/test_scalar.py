"""Scalar functions against the standard library."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from latticework.functions import scalar as S


def each(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i long, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def normal(x):
    t = unicodedata.normalize("NFKD", str(x or "").strip().lower().replace("ı", "i"))
    return " ".join(re.findall("[a-z0-9]+", "".join(c for c in t if not unicodedata.combining(c))))


def test_normalise_text(spark):
    rng = random.Random(1)
    alphabet = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x330), 0x1E9E, 0xFB01, 0x2460, 0xFF21, 0xFF41, 0xBD, 0x1D41A, 0x1F600, 0x2122, 0x24D0, 0x337A] if not 0x7F <= c < 0xA0]
    values = [None, "", "Straße Žižkov ő", "İzmir Çiğli ılık", "éa ﬁx x² ｱ①", "ŉ Ǆ ǆ", *("".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(600))]
    got = each(spark, S.normalise_text, values)
    # Spark trims spaces alone, which makes no difference to the words.
    assert [(v, g) for v, g in zip(values, got, strict=True) if g != normal(v)] == []


def test_stop_words_and_compound_keys(spark):
    assert each(spark, S.drop_stop_words, ["yesil park", "kent parki", "a b"]) == ["yesil park", "kent", "a b"]
    assert each(spark, S.compound_key, ["Çiğli|Yeşil Mahalle Ada", "x", None, "a|b|Park c"]) == ["cigli|ada", "", "", "a|b c"]


def test_short_number(spark):
    rng = random.Random(2)
    values = [0.0, 1.0, -1.5, 123456.789, 0.5, 1234567890.0, 12.3456789012345, *(rng.uniform(-1, 1) * 10 ** rng.randint(-6, 12) for _ in range(300))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")
    got = [r.y for r in df.select("i", S.short_number(F.col("x")).alias("y")).orderBy("i").collect()]
    assert [(v, g) for v, g in zip(values, got, strict=True) if g != f"{v:.10g}"] == []


def test_mend_encoding(spark):
    good = ["Çiğli – „İzmir“", "plain", "Ünï", None]
    broken = [x and x.encode().decode("cp1252", "ignore") if x != "Çiğli – „İzmir“" else "Ünï – ok".encode().decode("cp1252") for x in good]
    assert each(spark, S.mend_encoding, broken) == ["Ünï – ok", "plain", "Ünï", None]
    assert each(spark, S.mend_encoding, ["Ünï", "Ä b", "ÃœnÃ¯"]) == ["Ünï", "Ä b", "Ünï"]


def test_building_use(spark):
    assert each(spark, S.building_use, ["mesken", " KAMU", "işyeri", "İŞYERİ", None]) == ["residential", "public", None, "workplace", None]


def test_tag_match(spark):
    df = spark.createDataFrame([(1, {"landuse": "industrial", "shop": "x"}), (2, {"leisure": "park", "natural": "water"}), (3, {"natural": "water"}), (4, {"name": "x"}), (5, {"landuse": "railway"})], "i long, t map<string,string>")
    got = [tuple(r.m) for r in df.select("i", S.tag_match(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [("industrial_port", "landuse", "industrial"), ("green_open", "leisure", "park"), ("blue_water", "natural", "water"), ("other_context", None, None), ("construction_brownfield", "landuse", "railway")]


def test_tag_match_of_several_tags(spark):
    """The key that is reported is the rule's first that the element has, whatever its value."""
    cases = [
        ({"landuse": "forest", "natural": "wood"}, ("green_open", "landuse", "forest")),
        ({"landuse": "grass", "harbour": "yes"}, ("industrial_port", "landuse", "grass")),
        ({"amenity": "bench", "railway": "station"}, ("transport_terminal", "amenity", "bench")),
        ({"landuse": "residential", "shop": "bakery", "amenity": "parking"}, ("commercial_retail", "landuse", "residential")),
        ({"man_made": "silo", "aeroway": "apron"}, ("airport", "aeroway", "apron")),
        ({"man_made": "pier", "seamark:type": "harbour"}, ("industrial_port", "seamark:type", "harbour")),
        ({"natural": "water", "leisure": "marina"}, ("green_open", "leisure", "marina")),
        ({"amenity": "school", "landuse": "retail"}, ("commercial_retail", "landuse", "retail")),
        ({"landuse": "forest"}, ("other_context", None, None)),
        ({}, ("other_context", None, None)),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "i long, t map<string,string>")
    got = [tuple(r.m) for r in df.select("i", S.tag_match(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [want for _, want in cases]
    assert spark.createDataFrame([(None,)], "t map<string,string>").select(S.tag_match(F.col("t")).alias("m")).first().m.context_class == "other_context"


def test_retention_score(spark):
    def score(c):
        s = S.RETAINED.get(c, 0) + sum(2 for t in S.GOOD_TOKENS if t in c) - sum(1 for t in S.WEAK_TOKENS if t in c)
        return s + c.startswith(("osm_share_", "worldcover_share_", "dw_")) - 2 * c.endswith("_flag")

    names = [*S.RETAINED, "dw_trees_prob_mean", "osm_share_x_flag", "height_max_raw", "x"]
    assert each(spark, S.retention_score, names) == [score(c) for c in names]


def test_close_to(spark):
    rows = [(1.0, 1.0 + 1e-10, True), (1.0, 1.1, False), (None, None, True), (1.0, None, False), (0.0, 5e-10, True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a double, b double")
    assert [r.y for r in df.select(S.close_to(F.col("a"), F.col("b")).alias("y")).collect()] == [x for _, _, x in rows]


def test_names_are_folded_once_and_like_unicodedata(spark):
    import re
    import unicodedata

    from pyspark.sql import functions as F

    from latticework.functions import scalar

    marks = "".join(map(chr, (0x300, 0x345, 0x483, 0x20D0, 0x1D167)))
    texts = ["".join(map(chr, range(a, a + 40))) + "q" + marks + "z" for a in (0x20, 0x60, 0xA0, 0xE0, 0x120, 0x1C0, 0x1E00, 0x2070, 0x2100, 0x2460, 0x3380, 0xFB00, 0xFF20, 0x1D400)]

    def plain(x):
        low = x.strip(" ").lower().replace("\u0131", "i")
        bare = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
        return " ".join(re.findall("[a-z0-9]+", bare))

    df = spark.createDataFrame([(x,) for x in texts], "x string").repartition(2)
    out = df.select("x", scalar.normalise_text(F.col("x")).alias("y"))
    assert {r.x: r.y for r in out.collect()} == {x: plain(x) for x in texts}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
