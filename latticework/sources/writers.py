"""Writers: feature tables as CSV or Parquet, and small reports (Markdown, LaTeX, JSON manifests) from bounded tables."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_ROWS = 10_000


def write_features(df: DataFrame, path: str, key: str, kind: str = "parquet") -> None:
    """The table with its key first; CSV has a header and empty text for null."""
    out = df.select(key, *[c for c in df.columns if c != key])
    if kind == "csv":
        out.write.mode("overwrite").csv(path, header=True, nullValue="")
    else:
        out.write.mode("overwrite").parquet(path)


def split_by_kind(df: DataFrame, path: str, column: str = "kind", kinds: tuple[str, ...] = ("polygon", "line", "point")) -> None:
    """One layer per kind below path; a kind without rows still has its (empty) layer."""
    for k in kinds:
        df.filter(F.col(column) == k).write.mode("overwrite").parquet(f"{path}/{k}s")


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """One table per layer below path, empty layers too."""
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def marked_csv(df: DataFrame) -> bytes:
    """A small table as CSV in UTF-8 with a byte order mark, which spreadsheet programs need to see the encoding."""
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows([["" if x is None else x for x in r] for r in _rows(df)])
    return out.getvalue().encode("utf-8-sig")


# Letters and marks as classic bibliography files spell them.
BIBTEX = {
    "á": r"{\'a}", "é": r"{\'e}", "í": r"{\'i}", "ó": r"{\'o}", "ý": r"{\'y}", "ñ": r"{\~n}", "ö": r'{\"o}', "ü": r'{\"u}', "č": r"{\v{c}}",
    "Ç": r"{\c{C}}", "ş": r"{\c{s}}", "ğ": r"{\u{g}}", "ı": r"{\i}", "İ": r"{\.{I}}", "\u2010": "-", "\u2013": "--", "\u2018": "`", "\u2019": "'",
}


def bibtex_ascii(text: str) -> str:
    """The text in ASCII; a character without a spelling is an error."""
    out = "".join(BIBTEX.get(c, c) for c in text)
    if unknown := sorted({c for c in out if not c.isascii()}):
        raise ValueError(f"no spelling for {unknown}")
    return out


def _rows(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has {REPORT_ROWS} rows at most")
    return rows


def markdown_table(df: DataFrame) -> str:
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in _rows(df))]) + "\n"


def latex_table(df: DataFrame) -> str:
    marks = {c: f"\\{c}" for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    cell = lambda x: "" if x is None else "".join(marks.get(c, c) for c in str(x))
    body = [" & ".join(map(cell, r)) + r" \\" for r in [df.columns, *_rows(df)]]
    return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n" + "\n".join([body[0], r"\hline", *body[1:]]) + "\n\\end{tabular}\n"


def json_manifest(df: DataFrame, **parameters) -> str:
    """Parameters and the rows of a small summary as one JSON text."""
    return json.dumps({"parameters": parameters, "rows": [r.asDict(recursive=True) for r in _rows(df)]}, sort_keys=True, default=str)
