"""Figures of running jobs: counters of a query as it goes, and the highest load that log lines have told of so far."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ingest import server_load


def counted(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation of how many there are (`rows`) and how many meet each condition.

    The counts are taken as the rows pass by, in the action that uses them, not by reading again.
    """
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(name) for name, c in conditions.items())), seen


def progress(stream: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """Attaches counters to a stream, under a name that Counters finds them by: `rows` and how many meet each condition."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(key) for key, c in conditions.items()))


class Counters(StreamingQueryListener):
    """Sums up what progress() counts, batch by batch, for all queries of the session that it listens to.

        counters = Counters()
        spark.streams.addListener(counters)

    A batch counts when it is done, so one that fails and runs again counts once. say, if given, is
    called with the name, the batch's counts and the sums so far.
    """

    def __init__(self, say=None):
        self._lock, self._sums, self._last, self._say = threading.Lock(), {}, {}, say

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            for name, row in p.observedMetrics.items():
                if self._last.get((str(p.id), name), -1) >= p.batchId:
                    continue
                self._last[str(p.id), name] = p.batchId
                own = {k: v or 0 for k, v in row.asDict().items()}
                sums = self._sums.setdefault(name, {})
                for k, v in own.items():
                    sums[k] = sums.get(k, 0) + v
                if self._say:
                    self._say(name, own, dict(sums))

    def sums(self, name: str) -> dict[str, int]:
        with self._lock:
            return dict(self._sums.get(name, {}))

    def settled(self, query: StreamingQuery, name: str, seconds: float = 30.0) -> dict[str, int]:
        """The sums once all batches of a query that has ended are told of; they come a little after it."""
        last = query.lastProgress
        until = time.time() + seconds
        while last is not None and self._last.get((str(query.id), name), -1) < last["batchId"] and time.time() < until:
            time.sleep(0.05)
        return self.sums(name)


def running_peaks(lines: DataFrame, server: str | None = None) -> DataFrame:
    """(server, peak_running, peak_waiting, rose): for a stream of log lines (value), each server's new highest load.

    A row comes with each batch that raises a peak, and none with one that doesn't; rose says which
    (running, waiting or both). The peaks so far are state of the stream, kept in its checkpoint, so a
    restarted query goes on from them. Lines of a server pass by in chunks; their number doesn't
    matter. Without a server column all lines are of one.
    """
    name = F.col(server).cast("string") if server else F.lit("server")
    load = server_load(lines.select("value", name.alias("server")) if server is None else lines.withColumn("server", name), "server")

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (None, None)
        new = list(old)
        for chunk in chunks:
            for i, c in enumerate(("running", "waiting")):
                most = chunk[c].max()
                if pd.notna(most) and (new[i] is None or most > new[i]):
                    new[i] = int(most)
        rose = [c for c, a, b in zip(("running", "waiting"), old, new, strict=True) if a != b]
        if rose:
            state.update(tuple(new))
            yield pd.DataFrame({"server": [key[0]], "peak_running": pd.array([new[0]], "Int32"), "peak_waiting": pd.array([new[1]], "Int32"), "rose": [" and ".join(rose)]})

    return load.groupBy("server").applyInPandasWithState(
        step, "server string, peak_running int, peak_waiting int, rose string", "running int, waiting int", "append", GroupStateTimeout.NoTimeout
    )
