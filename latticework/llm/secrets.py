"""Secret scans, with multipart credentials linked.

One pass over the texts finds base secrets and the parts of weaker candidates: access identifiers, secret-like strings and endpoints,
none of which says much alone.  Parts are then joined by intervals: within one scope of a document (text between blank lines) a
secret is paired with an identifier or endpoint that begins or ends within ``reach`` code points of it.  Only candidates whose
complementary parts co-occur are reported.  The join is an equi-join on document, scope and interval bin, each part held in all bins
that it covers, one side widened by the reach; parts are few, so its shuffle is small beside the texts, which are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9_])(?:[Uu]ser(?:name)?|[Ll]ogin|[Aa]ccount|[Cc]lient_?[Ii]d|[Aa]ccess_?[Kk]ey(?:_?[Ii]d)?)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9@._-]{3,}+)""")
ENDPOINT = re.compile(r"(?<![A-Za-z0-9])(?:https?|ftp|ssh|jdbc:[a-z]{2,}+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}+")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")
BLANK = re.compile(r"\n[\x20\t\r]*\n")
#: A run of one class (a lower-case word, a number) is no candidate: a secret mixes two classes or more, and varies.
MIN_ENTROPY = 3.5


def _entropy(s: str) -> float:
    _, n = np.unique(np.frombuffer(s.encode(), np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def _random_looking(s: str) -> bool:
    kinds = any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s)
    return kinds >= 2 and _entropy(s) >= MIN_ENTROPY


def base_secrets(text: str) -> list[tuple[int, int, int]]:
    """start, kind and end of the base spans, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """start, kind, end, scope and whether it is a candidate of its own.

    Base access keys serve as identifiers and other base spans as secrets, but they are reported already.
    """
    parts = [(a, 3 if k == 1 else 4, b, False) for a, k, b in base]
    parts += [(m.start(1), 3, m.end(1), True) for m in IDENTIFIER.finditer(text)]
    parts += [(m.start(), 5, m.end(), True) for m in ENDPOINT.finditer(text)] if "://" in text else []
    taken = sorted((a, b) for a, _, b, _ in parts)
    starts = np.array([a for a, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else np.zeros(0, np.int64)
    for m in TOKEN.finditer(text):
        k = int(np.searchsorted(starts, m.end())) - 1
        if (k < 0 or ends[k] <= m.start()) and _random_looking(m[0]):
            parts.append((m.start(), 4, m.end(), True))
    if not parts:
        return []
    breaks = np.array([m.end() for m in BLANK.finditer(text)], np.int64)
    return [(a, k, b, int(np.searchsorted(breaks, a, side="right")), own) for a, k, b, own in sorted(parts)]


_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_PARTS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("scope", pa.int64()), ("own", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            base, parts = [], []
            for text in part.column(2).to_pylist():
                found = base_secrets(text)
                weak = weak_parts(text, found)
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in found])
                # Identifiers and endpoints tell nothing without a secret in the document, nor a secret without them.
                both = {k for _, k, _, _, _ in weak}
                parts.append([dict(zip(("start", "kind", "end", "scope", "own"), x, strict=True)) for x in weak] if 4 in both and len(both) > 1 else [])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(base, _BASE), pa.array(parts, _PARTS)], names=["id", "text_hash", "base", "parts"])


def link_parts(parts: DataFrame, reach: int) -> DataFrame:
    """Candidates of their own (id, text_hash, start, kind, end) with a complementary part in their scope, ``reach`` or less away."""
    width = 2 * reach + 256
    keys = ["id", "text_hash", "scope"]

    def bins(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / width), F.floor(last / width))).alias("bin")

    near = parts.select(*keys, bins(F.col("start") - reach, F.col("end") + reach), F.col("start").alias("s"), F.col("end").alias("e"), (F.col("kind") == 4).alias("secret")).alias("n")
    mine = parts.filter("own").select("*", bins(F.col("start"), F.col("end"))).alias("m")
    same = F.col("m.bin") == F.col("n.bin")
    for k in keys:
        same = same & F.col(f"m.{k}").eqNullSafe(F.col(f"n.{k}"))
    close = (F.col("n.s") <= F.col("m.end") + reach) & (F.col("n.e") >= F.col("m.start") - reach)
    linked = mine.join(near, same & close & ((F.col("m.kind") == 4) != F.col("n.secret")), "left_semi")
    return linked.select("id", "text_hash", "start", "kind", "end").distinct()


def find_secrets(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash and spans (start, kind number, end) of every row: the base spans and the linked weak candidates.

    Null text has no spans.  Repeated rows get the same spans; rows with a null id are told apart by their text.  An empty table gives
    an empty result.  Texts are read whole; a part of any length is held in all interval bins that it covers.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", own.schema["id"].dataType)])
    for name, kind in (("text_hash", "long"), ("base", "array<struct<start:long,kind:int,end:long>>"), ("parts", "array<struct<start:long,kind:int,end:long,scope:long,own:boolean>>")):
        schema.add(name, T.DataType.fromDDL(kind))
    found = cut(own.mapInArrow(_scan, schema))
    parts = found.filter(F.size("parts") > 0).select("id", "text_hash", F.explode("parts").alias("p")).select("id", "text_hash", "p.*").distinct()
    linked = link_parts(parts, reach).groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))
    linked = linked.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "extra")
    both = found.join(linked, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.slice("base", 1, 0))))
    return both.select(F.col("id").alias(id_col), "text_hash", spans.alias("spans"))


def spelled(spans: Column | str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def number(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    weak = F.size(F.filter("spans", lambda s: s["kind"] >= 3)).cast("long")
    return found.select("doc_id", *[number(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(spelled(base), 256).alias("base_sha256"), spelled("spans").alias("spans"), weak.alias("n_linked"))
