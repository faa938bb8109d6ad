"""Lookups of keys at a service that allows so many requests a second, kept and resumed."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop_tables, table


class NotFound(Exception):
    """The service has no such key; it isn't asked again."""


class Busy(Exception):
    """The service is overloaded or refuses more requests for now (429 or 5xx)."""


def pace(per_second: float, workers: int) -> tuple[int, float]:
    """(workers, seconds between the requests of each) so that together they never make more than per_second requests in any second.

    A worker makes a whole number of requests a second, at least one; if that is too many, there are
    fewer workers.
    """
    if per_second <= 0 or workers < 1:
        raise ValueError("there must be requests and workers")
    if per_second < 1:
        return 1, 1 / per_second
    workers = min(workers, math.floor(per_second))
    return workers, 1 / math.floor(per_second / workers)


def ask(client: Callable[[str], dict], key: str, tries: int, wait: float, before: Callable[[], None] = lambda: None) -> tuple[dict | None, str | None]:
    """(answer, error) of client(key). Busy is tried again after wait times the number of tries so far, other failures after wait; NotFound never."""
    error = None
    for attempt in range(1, tries + 1):
        before()
        try:
            return client(key), None
        except NotFound:
            return None, "not found"
        except Exception as e:  # the client's own failures become the row's error
            error = str(e) or type(e).__name__
            if attempt < tries:
                time.sleep(wait * (attempt if isinstance(e, Busy) else 1))
    return None, error


def lookup(keys: DataFrame, column: str, client: Callable[[str], dict], schema: str, out: str, per_second: float = 8.0, workers: int = 4, tries: int = 3, wait: float = 2.0, round_keys: int = 2000) -> DataFrame:
    """Answers to all distinct keys, one row each: the column, the fields of schema and error. Kept as Parquet below out.

    client(key) -> dict runs in tasks; it raises NotFound or Busy where the service says so. Keys are
    asked in rounds of about round_keys, each of which ends in a folder of its own, so a run that was
    stopped goes on with the round it was in, and a key with an answer (or that isn't there) is
    never asked again. Keys whose error is another one are asked once more by the next run. In a
    round there are at most `workers` tasks, which share out the requests of a second (see pace).
    """
    spark = keys.sparkSession
    fields = f"{column} string, {schema}, error string"
    workers, gap = pace(per_second, workers)
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    answers = lambda: spark.read.schema(fields + ", _round string").parquet(out)
    todo = keys.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()
    if files.exists(where):
        todo = todo.join(answers().where("error is null or error = 'not found'").select(column), column, "left_anti")
    todo = table(todo)
    rounds = math.ceil(todo.count() / round_keys)

    def run(batches):
        names, last = [f.strip().split()[0] for f in fields.split(",")], [-math.inf]

        def turn():
            time.sleep(max(0.0, last[0] + gap - time.monotonic()))
            last[0] = time.monotonic()

        for pdf in batches:
            rows = []
            for key in pdf[column]:
                got, error = ask(client, key, tries, wait, turn)
                rows.append({**(got or {}), column: key, "error": error})
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    stamp = f"{time.time_ns():020d}"
    for k in range(rounds):
        own = todo.where(F.pmod(F.xxhash64(column), F.lit(rounds)) == k).repartition(workers, F.xxhash64(column, F.lit(1)))
        # of a round that breaks off nothing stays
        own.mapInPandas(run, fields).write.mode("overwrite").parquet(f"{out}/_round={stamp}-{k:06d}")
        # a task of the next round may begin at once
        time.sleep(gap)
    drop_tables(todo)
    if not rounds and not files.exists(where):
        return spark.createDataFrame([], fields)
    # of a key that failed and was asked again the last answer counts
    rank = F.max_by(F.struct(*(f.strip().split()[0] for f in fields.split(","))), "_round").alias("r")
    asked = keys.select(F.col(column).cast("string").alias(column)).distinct()
    return answers().join(asked, column, "left_semi").groupBy(F.col(column).alias("_k")).agg(rank).select("r.*")
