"""Fill-in-the-middle rearrangement of texts held as ropes.

A text is a balanced tree of short leaves.  Every node caches how many units and how many code points stand below it, so a cut at
any rank of either kind walks one path.  Prefix, middle and suffix come from two cuts at unit ranks; the pieces are concatenated with
sentinels between them, which shares all untouched leaves.  The inverse cuts the output's tree at the code-point ranks of its
sentinels.  A text needs memory in proportion to its length, and every text stands alone: one map, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Union

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SENTINELS = ("<P>", "<S>", "<M>")
#: Code points of a leaf, about; units are never split, so a longer unit is a leaf of its own.
LEAF_POINTS = 1024
COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True, slots=True)
class Leaf:
    """text[start:end), cut into units by ``ends`` (positions in text; None if every code point is a unit)."""

    text: str
    start: int
    end: int
    ends: tuple[int, ...] | None = None
    height = 0

    @property
    def points(self) -> int:
        return self.end - self.start

    @property
    def units(self) -> int:
        return self.points if self.ends is None else len(self.ends)


@dataclass(frozen=True, slots=True)
class Branch:
    left: Rope
    right: Rope
    units: int
    points: int
    height: int


Rope = Union[Leaf, Branch]
EMPTY = Leaf("", 0, 0)


def branch(left: Rope, right: Rope) -> Branch:
    return Branch(left, right, left.units + right.units, left.points + right.points, 1 + max(left.height, right.height))


def concat(left: Rope, right: Rope) -> Rope:
    """Both ropes in order; the higher one is descended until heights meet, so heights stay logarithmic."""
    if not left.points:
        return right
    if not right.points:
        return left
    if left.height > right.height + 1:
        return balance(left.left, concat(left.right, right))
    if right.height > left.height + 1:
        return balance(concat(left, right.left), right.right)
    return branch(left, right)


def balance(left: Rope, right: Rope) -> Rope:
    """A branch of two ropes whose heights differ by two at most, rotated if they do."""
    if left.height > right.height + 1:
        if left.left.height < left.right.height:
            return branch(branch(left.left, left.right.left), branch(left.right.right, right))
        return branch(left.left, branch(left.right, right))
    if right.height > left.height + 1:
        if right.right.height < right.left.height:
            return branch(branch(left, right.left.left), branch(right.left.right, right.right))
        return branch(branch(left, right.left), right.right)
    return branch(left, right)


def split(rope: Rope, rank: int, kind: str = "units") -> tuple[Rope, Rope]:
    """The first ``rank`` units (or code points) and the rest."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= getattr(rope, kind):
        return rope, EMPTY
    if isinstance(rope, Leaf):
        text, ends = rope.text, rope.ends
        if ends is None:
            at = rope.start + rank
            return Leaf(text, rope.start, at), Leaf(text, at, rope.end)
        k = rank if kind == "units" else sum(e <= rope.start + rank for e in ends)
        at = ends[rank - 1] if kind == "units" else rope.start + rank
        head = ends[:k] if k and ends[k - 1] == at else (*ends[:k], at)
        return Leaf(text, rope.start, at, head), Leaf(text, at, rope.end, ends[k:])
    below = getattr(rope.left, kind)
    if rank < below:
        first, rest = split(rope.left, rank, kind)
        return first, concat(rest, rope.right)
    first, rest = split(rope.right, rank - below, kind)
    return concat(rope.left, first), rest


def leaves(rope: Rope) -> Iterator[Leaf]:
    stack = [rope]
    while stack:
        r = stack.pop()
        if isinstance(r, Leaf):
            yield r
        else:
            stack += [r.right, r.left]


def flatten(rope: Rope) -> str:
    return "".join(x.text[x.start : x.end] for x in leaves(rope))


def build(text: str, unit: re.Pattern[str] | None = None) -> Rope:
    """A balanced rope.  Units are code points, or end where matches of ``unit`` end; what follows the last match is a unit too."""
    if unit is None:
        row: list[Rope] = [Leaf(text, a, min(a + LEAF_POINTS, len(text))) for a in range(0, len(text), LEAF_POINTS)]
    else:
        ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
        if text and (not ends or ends[-1] < len(text)):
            ends.append(len(text))
        row, first, start = [], 0, 0
        for k, end in enumerate(ends):
            if end - start >= LEAF_POINTS or k == len(ends) - 1:
                row.append(Leaf(text, start, end, tuple(ends[first : k + 1])))
                first, start = k + 1, end
    while len(row) > 1:
        row = [branch(row[k], row[k + 1]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
    return row[0] if row else EMPTY


def ranks(key: str) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of a key's SHA-256."""
    digest = hashlib.sha256(key.encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))  # type: ignore[return-value]


@dataclass(frozen=True)
class Rearranged:
    units: int
    form: str
    prefix: int | None
    middle: int | None
    output: str


def rearrange(text: str, key: str, unit: re.Pattern[str] | None, rate: int, spm_rate: int, sentinels: tuple[str, str, str]) -> Rearranged:
    """The text by the draws of its key: plain, prefix-suffix-middle or suffix-prefix-middle."""
    rope = build(text, unit)
    h1, h2, h3, h4 = ranks(key)
    if not text or h3 % 100 >= rate or any(s in text for s in sentinels):
        return Rearranged(rope.units, "plain", None, None, text)
    a, b = sorted((h1 % (rope.units + 1), h2 % (rope.units + 1)))
    head, suffix = split(rope, b)
    prefix, middle = split(head, a)
    p, s, m = (Leaf(x, 0, len(x)) for x in sentinels)
    form = "spm" if h4 % 100 < spm_rate else "psm"
    parts = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    out: Rope = EMPTY
    for part in parts:
        out = concat(out, part)
    return Rearranged(rope.units, form, prefix.points, middle.points, flatten(out))


def restore(output: str, form: str, sentinels: tuple[str, str, str]) -> str:
    """The text that an output was made of: its rope is cut at the code-point ranks of its sentinels."""
    if form == "plain":
        return output
    p, s, m = sentinels
    first, second = (p, s) if form == "psm" else (s, p)
    at = output.index(second, len(first))
    end = output.index(m, at + len(second))
    rope = build(output)
    rest, middle = split(rope, end, "points")[0], split(rope, end + len(m), "points")[1]
    one, two = split(split(rest, at, "points")[0], len(first), "points")[1], split(rest, at + len(second), "points")[1]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return flatten(concat(concat(prefix, middle), suffix))


def _filling(unit: str | None, rate: int, spm_rate: int, sentinels: tuple[str, str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit) if unit else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                made = [rearrange(t, k, pattern, rate, spm_rate, sentinels) for t, k in zip(piece.column(2).to_pylist(), piece.column(1).to_pylist(), strict=True)]
                whole = [pa.array([getattr(r, c) for r in made], pa.int64()) for c in ("units", "prefix", "middle")]
                form, output = pa.array([r.form for r in made], pa.string()), pa.array([r.output for r in made], pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(0), whole[0], form, *whole[1:], output], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def _restoring(sentinels: tuple[str, str, str], kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                texts = [restore(o, f, sentinels) for o, f in zip(*(c.to_pylist() for c in piece.columns[-2:]), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-2], pa.array(texts, pa.string())], names=[*kept, "restored"])

    return run


def fill_in_middle(docs: DataFrame, unit: str | None = None, rate: int = 90, spm_rate: int = 20, salt: str = "1:", sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts rearranged for infilling: id, n (units), form, prefix_chars, middle_chars, output.

    ``rate`` percent of the texts are rearranged, ``spm_rate`` percent of these with the suffix first; the draws are those of
    SHA-256(salt + id), so a rerun gives the same rows.  Units are code points, or the matches of the regular expression ``unit``
    with what stands before each.  Texts that contain a sentinel stay plain, as they couldn't be restored.

    Null text counts as empty and stays plain with no units; a null id draws like an empty one.  Repeated rows give repeated
    results, an empty table an empty one.  Other columns are ignored.  A very long text is rearranged whole, by one task.
    """
    if len(set(sentinels)) < 3 or any(a != b and a in b for a in sentinels for b in sentinels) or not all(sentinels):
        raise ValueError("sentinels must be three texts of which none contains another")
    ident = F.col(id_col)
    key = F.concat(F.lit(salt), F.coalesce(ident.cast("string"), F.lit("")))
    rows = docs.select(ident.alias(id_col), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_filling(unit, rate, spm_rate, sentinels), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {COLUMNS}")


def restore_texts(filled: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """All other columns of the table with ``restored``, the text rebuilt from the output and its form alone.

    Columns keep their values; an output or form that is null counts as empty and plain.
    """
    kept = [c for c in filled.columns if c not in (output_col, form_col)]
    rows = filled.select(*kept, F.coalesce(output_col, F.lit("")).alias(output_col), F.coalesce(form_col, F.lit("plain")).alias(form_col))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(_restoring(sentinels, kept), f"{kinds}, restored string")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256)).withColumn("kept_form", F.col("form"))
    back = restore_texts(filled)
    return back.select("doc_id", "n", F.col("kept_form").alias("form"), "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS digest FROM documents),
drawn AS (
  SELECT doc_id, text, length(text) AS n, ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
    ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4
  FROM docs),
formed AS (
  SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM drawn),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text
      WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
      ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END AS output
  FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM made
"""
