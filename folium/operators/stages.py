"""Model calls as pluggable stages: the client is given, Spark deals out the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lookups import Busy

RESULT = "document_id string, page int, success boolean, content string, error string, attempts int, latency double"


def prompt(text: Column, template: str, most_chars: int = 6000) -> Column:
    """array<struct<role, content>>: the template as system message and the text's head."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", F.lit(template)), message("user", F.substring(text, 1, most_chars)))


def call_model(pages: DataFrame, client: Callable[[dict], str], tries: int = 3, busy_tries: int = 10, wait: float = 0.5, first: float = 0.1, step: float = 0.2) -> DataFrame:
    """Calls client(row with temperature) for every (document_id, page, ...) row; failures become rows.

    A Busy error, or one whose text tells of overload (429 or 5xx), waits ever longer and isn't
    counted as a try, up to busy_tries; other errors are, and raise the temperature. An empty answer
    is an error.
    """

    def run(batches):
        import re
        import time

        import pandas as pd

        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                began, used, busy, content, error = time.time(), 0, 0, None, None
                while used < tries and busy < busy_tries:
                    full = False
                    try:
                        content = client({**row, "temperature": first + used * step})
                        error = None if content else "empty answer"
                    except Exception as e:  # the client's own failures become the row's error
                        content, error, full = None, str(e) or type(e).__name__, isinstance(e, Busy)
                    if error is None:
                        break
                    if full or re.search(r"\b(429|5[0-9][0-9])\b", error):
                        busy += 1
                        time.sleep(min(30.0, wait * 2**busy))
                    else:
                        used += 1
                rows.append((str(row["document_id"]), int(row.get("page") or 0), error is None, content, error, used + busy + (error is None), time.time() - began))
            yield pd.DataFrame(rows, columns=["document_id", "page", "success", "content", "error", "attempts", "latency"])

    return pages.mapInPandas(run, RESULT)


def training_rows(df: DataFrame, template: str, text: str = "pdf_content", answer: str = "authors", drop: tuple[str, ...] = ("doi", "title", "filename"), most_chars: int = 28_000) -> DataFrame:
    """Rows for training: prompt (messages with the text's head) and answer take the place of the source columns."""
    own = [c for c in df.columns if c not in (text, answer, "prompt", "answer", *drop)]
    return df.select(*own, prompt(F.col(text), template, most_chars).alias("prompt"), F.col(answer).alias("answer"))


def failed_documents(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """A page-0 error row for each document of which no page came back."""
    none = documents.select(F.col("document_id").cast("string").alias("document_id")).join(pages.select("document_id").distinct(), "document_id", "left_anti")
    return none.select("document_id", F.lit(0).alias("page"), F.lit(False).alias("success"), F.lit(None).cast("string").alias("content"), F.lit("no pages").alias("error"), F.lit(0).alias("attempts"), F.lit(0.0).alias("latency"))
