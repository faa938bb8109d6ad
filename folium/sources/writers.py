"""Writers. Large results are written by tasks; only small reports are put together on the driver."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_report(data: dict | list, path: str | None = None, sort_keys: bool = False) -> str:
    """A pretty JSON document of a small result, to a file or returned."""
    text = json.dumps(data, indent=2, ensure_ascii=False, sort_keys=sort_keys)
    if path:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def json_array(df: DataFrame, path: str) -> None:
    """One JSON document, a list of the rows of a small or moderate result, written row by row as they arrive."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        f.write("[\n")
        for k, r in enumerate(rows):
            f.write((",\n" if k else "") + json.dumps(json.loads(r["j"]), indent=2, ensure_ascii=False))
        f.write("\n]\n")


def text_report(lines: list[str], path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def csv(df: DataFrame, path: str, fields: list[str] | None = None, sep: str = ",", header: bool = True) -> None:
    """CSV with fixed fields in order; missing values are empty."""
    fields = fields or df.columns
    out = df.select(*(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields))
    out.write.mode("overwrite").option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def split_csv(df: DataFrame, category: str, path: str) -> None:
    """A folder of CSV files for each category that occurs."""
    df.write.mode("overwrite").partitionBy(category).option("header", True).option("emptyValue", "").csv(path)


def split_csv_always(df: DataFrame, category: Column, outputs: dict[str, str]) -> None:
    """Each category to its own path, with a header even where there are no rows."""
    for name, path in outputs.items():
        csv(df.where(category == name), path)


def split_lines(df: DataFrame, line: str, category: str, path: str) -> None:
    """The unchanged lines of each category in a folder of its own."""
    df.select(category, F.col(line).alias("value")).write.mode("overwrite").partitionBy(category).text(path)


def routed(df: DataFrame, conditions: dict[str, Column], path: str) -> None:
    """JSON lines of the rows that meet each condition, below path/name."""
    for name, when in conditions.items():
        jsonl(df.where(when), f"{path}/{name}", "overwrite")


def numbered_batches(df: DataFrame, batch: str, path: str, sep: str = "\t") -> None:
    """Batch manifests: a folder batch_NNN of lines for each number."""
    name = F.format_string("batch_%03d", F.col(batch))
    row = F.concat_ws(sep, *(F.col(c).cast("string") for c in df.columns if c != batch))
    df.select(name.alias("batch"), row.alias("value")).write.mode("overwrite").partitionBy("batch").text(path)


def one_file_each(df: DataFrame, name: str, columns: list[str], path: str, suffix: str, order: str | None = None, sep: str | None = None, header: bool = False) -> None:
    """One file path/<name><suffix> for each name, of its rows in order: CSV, or fields joined by sep. Many files a task; whole ones only."""
    from .named_files import named_files

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda c: F.when(text(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c))
    row = F.concat(F.concat_ws(",", *map(quoted, columns)) if sep is None else F.concat_ws(sep, *map(text, columns)), F.lit("\n"))
    rows = df.select(F.concat(file_name(F.col(name)), F.lit(suffix)).alias("name"), row.alias("text"), *([F.col(order).alias("_o")] if order else []))
    named_files(rows, "name", "text", path, "_o" if order else None, (sep or ",").join(columns) if header else "")


def documents(df: DataFrame, id_col: str, text_col: str, path: str, suffix: str = ".md") -> None:
    """A file path/<id><suffix> for each document, in one flat folder; many files a task, and whole ones only."""
    from .named_files import named_files

    named_files(df.select(F.concat(file_name(F.col(id_col)), F.lit(suffix)).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "name", "text", path)


def file_name(ident: Column) -> Column:
    """A name for a file: the id if it is one, else its plain signs and a hash, so that no two ids share a name."""
    ident = F.coalesce(ident.cast("string"), F.lit(""))
    plain = F.regexp_replace(ident, r"[^0-9A-Za-z._-]+", "_")
    safe = (plain == ident) & (ident != "") & ~ident.startswith(".") & ~ident.startswith("_")
    return F.when(safe, ident).otherwise(F.concat(F.lit("x"), plain, F.lit("-"), F.substring(F.md5(ident.cast("binary")), 1, 12)))


def markdown_files(df: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """A text file for each document, named after it, below a partition folder that tasks write.

    A name that has to be changed ends with a hash of the id, so that no two documents share a folder.
    """
    ident = F.col(id_col).cast("string")
    plain = F.regexp_replace(ident, r"[^0-9A-Za-z._-]+", "_")
    safe = F.when(plain == ident, ident).otherwise(F.concat(plain, F.lit("-"), F.substring(F.md5(ident.cast("binary")), 1, 12)))
    df.select(safe.alias("document"), F.col(text_col).alias("value")).write.mode("overwrite").partitionBy("document").text(path)
