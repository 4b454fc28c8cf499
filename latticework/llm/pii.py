"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them; DataFrame functions only.

The entities to protect are the values of the base spans.  A term that shares a text with an entity discloses it as far as knowing
the term removes the entity's information: PMI(t; e) / IC(e) = 1 - log2((df(t) + 1) / df(t, e)) / log2(N / df(e)), with document
frequencies over the distinct texts of the whole corpus.  The 1 is a text not seen yet that holds the term without the entity: it
makes little evidence count for less, and leaves no entity out, however rare.  Terms at or above ``generalise`` lose their content
but keep their initial; those at or above ``remove`` go; both wherever they stand in the entity's texts.

Every step is linear in a text's length and in its spans, or nearly so: prefix sums and running maxima go by three levels of blocks, and
texts are cut by blocks of spans.  A term that stands in one text with an entity is judged by that text's rarest entity alone; pairs are
counted only for terms and entities of two texts or more, by classes that stand in the same texts.

Patterns are applied in forms that neither backtrack nor recurse on long runs: a separator between two characters that may
hold it becomes one private-use character first, which leaves every position as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, join_hot, table

KINDS = ["email", "ip", "card", "phone", "term"]
MARK, OTHER = "\ue000", "\ue001"
#: Terms, and rewritten documents, up to which a table of them is broadcast: some 10 MB; and hashes alone, 8 MB of numbers.
BROADCAST_TERMS = 100_000
BROADCAST_HASHES = 1_000_000
TERM = r"[\p{L}\p{N}]+"
BLOCK = 128

LOCAL = rf"A-Za-z0-9._%+{MARK}-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]+{MARK}[A-Za-z0-9{MARK}-]+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{MARK}])[0-9][0-9{MARK}]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def bound(value: Column, body) -> Column:
    """body(value), with value computed once however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before_each(values: Column, fold) -> Column:
    """For each value of an array the fold (a sum or maximum of an array of longs, 0 of none) of all earlier ones, by blocks of blocks."""

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / BLOCK), F.lit(0)).cast("int")), lambda b: fold(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))

    def earlier(one: Column, two: Column, three: Column, i: Column) -> Column:
        b, c = F.floor(i / BLOCK).cast("int"), F.floor(i / BLOCK**2).cast("int")
        return fold(F.array(fold(F.slice(three, F.lit(1), c)), fold(F.slice(two, c * BLOCK + 1, b - c * BLOCK)), fold(F.slice(one, b * BLOCK + 1, i - b * BLOCK))))

    return bound(values, lambda one: bound(blocks(one), lambda two: bound(blocks(two), lambda three: F.transform(one, lambda x, i: earlier(one, two, three, i)))))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def _max(x: Column) -> Column:
    return F.coalesce(F.array_max(x), F.lit(0).cast("long"))


def starts_of(pieces: Column, matches: Column) -> Column:
    """Start of each match, from the lengths of what stands between and of the matches."""
    steps = F.zip_with(F.transform(matches, lambda m: F.length(m).cast("long")), F.transform(F.slice(pieces, 1, F.size(matches)), lambda p: F.length(p).cast("long")), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    return bound(steps, lambda s: F.zip_with(before_each(F.transform(s, lambda x: x["m"] + x["p"]), _sum), s, lambda a, x: a + x["p"]))


def _spans(df: DataFrame, text: str, kind: int, pattern: str, check: Column, valid) -> DataFrame:
    """Adds column ``_k<kind>``: spans of the pattern whose match is valid."""
    name, m, p, s = f"_k{kind}", f"_m{kind}", f"_p{kind}", f"_s{kind}"
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(check, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    df = df.withColumn(s, F.when(F.size(m) > 0, starts_of(F.col(p), F.col(m))).otherwise(F.array().cast("array<bigint>")))
    spans = F.zip_with(m, s, lambda v, a: F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + F.length(v)).alias("end"), v.alias("value")))
    return df.withColumn(name, F.filter(spans, lambda x: valid(x["value"]))).drop(m, p, s)


def clusters(spans: Column) -> Column:
    """Runs of overlapping spans (in order of start): before (the end of the run before), start, end, and the number of the first span."""
    heads = bound(spans, lambda sp: F.filter(
        F.transform(F.zip_with(before_each(F.transform(sp, lambda s: s["end"]), _max), sp, lambda b, s: F.struct(b.alias("before"), s["start"].alias("start"))), lambda z, i: F.struct(z["before"].alias("before"), z["start"].alias("start"), i.alias("first"))),
        lambda h: h["start"] >= h["before"],
    ))
    last = _max(F.transform(spans, lambda s: s["end"]))
    return bound(heads, lambda hs: bound(last, lambda top: F.transform(hs, lambda h, j: F.struct(h["before"].alias("before"), h["start"].alias("start"), F.coalesce(F.get(hs, j + 1)["before"], top).alias("end"), h["first"].alias("first")))))


def replaced(text: Column, runs: Column, word) -> Column:
    """The text with each run (before, start, end and more) replaced by word(run, its first character); runs must not be empty.

    Regions of 16,384 and of 128 runs are cut out of the text first, so that no run is counted off from the text's beginning.
    """

    def part(t: Column, first: Column, last: Column) -> Column:
        return F.substr(t, (first + 1).cast("int"), (last - first).cast("int"))

    def pieces(t: Column, origin: Column, items: Column, sizes: tuple[int, ...]) -> Column:
        if not sizes:
            return F.array_join(F.transform(items, lambda r: F.concat(part(t, r["before"] - origin, r["start"] - origin), word(r, part(t, r["start"] - origin, r["start"] - origin + 1)))), "")
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / sizes[0]).cast("int")), lambda b: F.slice(items, b * sizes[0] + 1, F.lit(sizes[0])))

        def region(g: Column) -> Column:
            return part(t, F.element_at(g, 1)["before"] - origin, F.element_at(g, -1)["start"] - origin + 1)

        return F.array_join(F.transform(groups, lambda g: bound(region(g), lambda r: pieces(r, F.element_at(g, 1)["before"], g, sizes[1:]))), "")

    def whole(rs: Column) -> Column:
        return F.concat(pieces(text, F.lit(0).cast("long"), rs, (BLOCK**2, BLOCK)), F.substr(text, (F.element_at(rs, -1)["end"] + 1).cast("int"), F.length(text)))

    return bound(runs, whole)


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, text_hash and base: spans (start, kind number, end, value) of the base patterns in order of start, then kind."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    plain = own.withColumn("_t", F.translate(F.col("text"), MARK, OTHER))
    has_at, has_card = F.contains(F.col("_t"), F.lit("@")), F.col("_t").rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")
    plain = plain.withColumn("_e", F.when(has_at, F.regexp_replace("_t", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)).otherwise(F.lit("")))
    plain = plain.withColumn("_c", F.when(has_card, F.regexp_replace("_t", r"(?<=[0-9])[\x20-](?=[0-9])", MARK)).otherwise(F.lit("")))

    def digits(v: Column) -> Column:
        return F.regexp_replace(v, "[^0-9]", "")

    def small(v: Column) -> Column:
        return F.forall(F.split(v, r"\."), lambda x: F.coalesce(x.try_cast("decimal(38,0)") <= 255, F.regexp_replace(x, "^0+", "") == ""))

    def card(v: Column) -> Column:
        return F.length(digits(v)).between(12, 19) & F.call_function("luhn_check", digits(v))

    df = _spans(plain, "_e", 0, EMAIL, F.length("_e") > 0, lambda v: F.lit(True))
    df = _spans(df, "_t", 1, IP, F.col("_t").rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), small)
    df = _spans(df, "_c", 2, CARD, F.length("_c") > 0, card)
    df = _spans(df, "_t", 3, PHONE, F.col("_t").rlike(r"\+[0-9]"), lambda v: F.length(digits(v)).between(9, 15))
    base = F.array_sort(F.concat("_k0", "_k1", "_k2", "_k3"))
    return df.select("id", "text", "text_hash", F.explode_outer(F.array(base)).alias("base"))


def entity_names(base: Column) -> Column:
    return F.transform(base, lambda b: F.concat(b["kind"].cast("string"), F.lit(":"), F.lower(F.regexp_replace(b["value"], MARK, "."))))


def context_terms(found: DataFrame, min_length: int) -> DataFrame:
    """A row per distinct text with an entity: text_hash and terms (h, a hash of the term in lower case, start, end).

    A term is a run of letters and digits with a letter, ``min_length`` long at least, that touches no base span: the spans become marks
    that continue a run, and runs with a mark are left out.
    """
    marked = rf"[\p{{L}}\p{{N}}{MARK}]+"
    texts = found.filter(F.size("base") > 0).select("text_hash", "base", F.translate("text", MARK, OTHER).alias("text")).dropDuplicates(["text_hash"])
    texts = texts.select("text_hash", replaced(F.col("text"), clusters(F.col("base")), lambda r, c: F.repeat(F.lit(MARK), (r["end"] - r["start"]).cast("int"))).alias("text"))
    texts = texts.withColumn("m", F.regexp_extract_all("text", F.lit(marked), F.lit(0)))
    texts = texts.withColumn("p", F.split("text", marked, -1)).filter(F.size("m") > 0)
    texts = texts.withColumn("at", starts_of(F.col("p"), F.col("m")))
    clear = F.filter(F.arrays_zip("m", "at"), lambda y: (F.length(y["m"]) >= min_length) & ~F.contains(y["m"], F.lit(MARK)) & y["m"].rlike(r"\p{L}"))
    return texts.select("text_hash", F.transform(clear, lambda y: F.struct(F.xxhash64(F.lower(y["m"])).alias("h"), y["at"].alias("start"), (y["at"] + F.length(y["m"])).alias("end"))).alias("terms"))


def _few(df: DataFrame, rows: int = BROADCAST_TERMS) -> DataFrame:
    """A checkpointed table, to be broadcast where it has so many rows (of some numbers each) at most."""
    return F.broadcast(df) if df.count() <= rows else df


def disclosing_terms(docs: DataFrame, near: DataFrame, found: DataFrame, text_col: str, generalise: float) -> DataFrame:
    """text_hash, h and disclosure (the highest of the text's entities) at or above ``generalise``; frequencies over all distinct texts.

    A pair reaches ``generalise`` only if df(t) + 1 is at most df(t, e) * (N / df(e)) ** (1 - generalise).  The texts with entities
    that hold the term bound df(t) from below, and df(t, e) is at most that and at most df(e); so common words leave before pairs are
    counted and before the corpus is, and no pair is lost.  With df(t, e) = 1 the text's rarest entity gives the most, so it alone is
    looked at; pairs of two texts or more are counted by classes of terms and of entities that stand in the same texts.
    """
    n = found.select("text_hash").distinct().count()
    if not n:
        return near.select("text_hash", F.lit(0).cast("long").alias("h"), F.lit(0.0).alias("disclosure")).limit(0)
    texts = F.lit(float(n))
    x1, x2 = F.bit_xor(F.xxhash64("text_hash")), F.bit_xor(F.xxhash64("text_hash", F.lit(5)))

    def gain(df_e) -> Column:
        return F.pow(texts / df_e, F.lit(1.0 - generalise)) * (1 + 1e-9)

    stands = cut(found.select(F.explode(F.transform(entity_names(F.col("base")), lambda x: F.xxhash64(x))).alias("entity"), "text_hash").distinct())
    entities = stands.groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"), x1.alias("e1"), x2.alias("e2"))
    held = cut(join_hot(stands, entities, ["entity"], "df_e", stands.count()).select("text_hash", "df_e", "e1", "e2").distinct())
    least, most = held.agg(F.min("df_e"), F.max("df_e")).first()
    if least is None:
        return near.select("text_hash", F.lit(0).cast("long").alias("h"), F.lit(0.0).alias("disclosure")).limit(0)
    terms = near.select(F.explode(F.array_distinct(F.transform("terms", lambda y: y["h"]))).alias("h"), "text_hash")
    lows = cut(terms.groupBy("h").agg(F.count(F.lit(1)).alias("df_low"), x1.alias("t1"), x2.alias("t2")).filter(F.col("df_low") + 1 <= F.least("df_low", F.lit(most)) * gain(F.lit(float(least)))))

    # Terms and entities of two texts or more: pairs of classes.
    shared = lows.filter("df_low >= 2")
    classes = terms.join(_few(shared), "h").select("t1", "t2", "df_low", "text_hash").distinct()
    able = F.col("df_low") + 1 <= F.least("df_low", "df_e") * gain(F.col("df_e"))
    both = classes.join(held.filter("df_e >= 2"), "text_hash").filter(able)
    pairs = both.groupBy("e1", "e2", "t1", "t2").agg(F.count(F.lit(1)).alias("df_te"), F.first("df_low").alias("df_low"), F.first("df_e").alias("df_e"))
    pairs = cut(pairs.filter((F.col("df_te") >= 2) & (F.col("df_low") + 1 <= F.col("df_te") * gain(F.col("df_e")))).drop("df_low"))
    named = shared.select("t1", "t2", "h").join(pairs, ["t1", "t2"])

    # How many texts of the corpus hold the terms that can disclose at all.
    rare = F.col("df_low") + 1 <= gain(F.lit(float(least)))
    asked = _few(cut(lows.filter(rare).select("h").union(named.select("h")).distinct()), BROADCAST_HASHES)
    words = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(TERM), F.lit(0)))).alias("term"))
    words = words.select("text_hash", F.xxhash64("term").alias("h"))
    # A row holds a term once, so rows are counted where they stand; only texts that occur again are told apart, and count once.
    copied = _few(cut(found.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("text_hash", F.lit(True).alias("copied"))), BROADCAST_HASHES)
    hits = words.join(asked, "h", "left_semi").join(copied, "text_hash", "left").withColumn("text", F.when(F.col("copied"), F.col("text_hash")))
    counts = hits.groupBy("h", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(1)).alias("df_t"))
    counts = cut(counts)

    def disclosure(df_te: Column) -> Column:
        information = F.log2(texts / F.col("df_e"))
        return F.when(information > 0, 1 - F.log2((F.greatest(F.col("df_t"), df_te) + 1) / df_te) / information).otherwise(F.lit(0.0)).alias("disclosure")

    rarest = held.groupBy("text_hash").agg(F.min("df_e").alias("df_e"))
    alone = _few(cut(counts.filter(F.col("df_t") + 1 <= gain(F.lit(float(least))))))
    told = terms.join(alone, "h").join(rarest, "text_hash").select("text_hash", "h", disclosure(F.lit(1)))
    rated = named.join(counts, "h").select("e1", "e2", "h", disclosure(F.col("df_te"))).filter(F.col("disclosure") >= generalise)
    told = told.unionByName(rated.join(held, ["e1", "e2"]).select("text_hash", "h", "disclosure"))
    return told.filter(F.col("disclosure") >= generalise).groupBy("text_hash", "h").agg(F.max("disclosure").alias("disclosure"))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 4, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """id, text_hash and spans (start, kind number, end, action) of every row: the base spans and the terms that disclose one of the
    row's entities.

    Actions: replace (a base span), remove or generalise (a term).  Null text has no spans.  Repeated rows get the same spans; rows
    with a null id are told apart by their text.  An empty table gives an empty result.  Texts are read whole; one with very many spans
    or words takes time in proportion to them, in one task.
    """
    found = cut(base_spans(docs, id_col, text_col).select("id", "text_hash", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")))
    near = cut(context_terms(found, min_length))
    told = cut(disclosing_terms(docs, near, found, text_col, generalise))
    touched = near.join(told.select("text_hash").distinct(), "text_hash", "left_semi").select("text_hash", F.explode("terms").alias("y")).select("text_hash", "y.*")
    action = F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")
    places = touched.join(told, ["text_hash", "h"]).select("text_hash", "start", "end", action.alias("action"))
    extra = places.groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "action"))).alias("extra"))
    whole = found.join(extra, "text_hash", "left")
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit("replace").alias("action")))
    spans = F.array_sort(F.concat(base, F.coalesce("extra", F.filter(base, lambda x: F.lit(False)))))
    return whole.select(F.col("id").alias(id_col), "text_hash", spans.alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (in order of start) replaced; of spans that overlap, the part after an earlier one's end is dropped with it."""
    labels = F.array(*[F.lit(k.upper()) for k in KINDS])

    def word(r: Column, first: Column) -> Column:
        out = F.when(r["action"] == "replace", F.concat(F.lit("["), F.element_at(labels, (r["kind"] + 1).cast("int")), F.lit("]")))
        return out.when(r["action"] == "generalise", F.concat(first, F.lit("_"))).otherwise(F.lit("_"))

    def runs(sp: Column) -> Column:
        return F.transform(clusters(sp), lambda r: F.struct(r["before"].alias("before"), r["start"].alias("start"), r["end"].alias("end"), F.get(sp, r["first"])["kind"].alias("kind"), F.get(sp, r["first"])["action"].alias("action")))

    return F.when(F.size(spans) > 0, replaced(text, bound(spans, runs), word)).otherwise(text)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents, with all their columns, their texts redacted; a text without spans stays as it is, null stays null.

    Repeated rows are redacted alike; an empty table gives an empty result; the working columns take names that docs doesn't have.
    """
    found = find_private(docs.select(id_col, text_col), id_col, text_col, **params)
    key, hashed, spans = (free_name(docs, f"pii_{x}") for x in ("key", "hash", "spans"))
    touched = cut(found.filter(F.size("spans") > 0).select(F.col(id_col).alias(key), F.col("text_hash").alias(hashed), F.col("spans").alias(spans)).dropDuplicates([key, hashed]))
    size = touched.agg(F.sum(F.size(spans) + 1)).first()[0] or 0
    side = F.broadcast(touched) if size <= BROADCAST_TERMS else touched
    joined = docs.join(side, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(hashed)), "left")
    return joined.select(*[F.when(F.col(spans).isNotNull(), redact(F.col(text_col), F.col(spans))).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, (s["kind"] + 1).cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)

    def number(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    return found.select("doc_id", *[number(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), number(4).alias("n_term"))
