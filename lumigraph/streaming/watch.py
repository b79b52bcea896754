"""Change streams: which events matter, how they gather to flushes, and re-indexing on each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lumigraph.sources.repo import IGNORED_DIRS, STATE_DIR

LEAST_DEBOUNCE_MS, DEBOUNCE_MS = 50, 300


def relevant(events: DataFrame, path_col: str = "path") -> DataFrame:
    """Events of files in the repository whose first folder is neither an ignored one nor the state folder."""
    return events.where(~F.element_at(F.split(path_col, "/"), 1).isin(*IGNORED_DIRS, STATE_DIR))


def flushes(events: DataFrame, debounce_ms: int = DEBOUNCE_MS, key: str = "key", ts: str = "ts") -> DataFrame:
    """(key, first_ts, flush_ts, n_events) of events (key, ts): a flush gathers what comes within the debounce time of its first event.

    The deadline stands from the first event on; later ones do not move it. A key's events are folded in
    order of time within its row, and only what a flush needs is kept while folding.
    """
    wait = max(LEAST_DEBOUNCE_MS, debounce_ms) * 1000
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts)).alias("t")).groupBy("key", "t").agg(F.count(F.lit(1)).alias("n"))
    state = "struct<done:array<struct<a:bigint,n:bigint>>,a:bigint,n:bigint>"
    zero = F.struct(F.array().cast("array<struct<a:bigint,n:bigint>>").alias("done"), F.lit(None).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("n")).cast(state)

    def add(s, x):
        fresh = F.struct(s["done"].alias("done"), x["t"].alias("a"), x["n"].alias("n"))
        more = F.struct(s["done"].alias("done"), s["a"].alias("a"), (s["n"] + x["n"]).alias("n"))
        closed = F.struct(F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["n"].alias("n")))).alias("done"), x["t"].alias("a"), x["n"].alias("n"))
        return F.when(s["a"].isNull(), fresh.cast(state)).when(x["t"] < s["a"] + wait, more.cast(state)).otherwise(closed.cast(state))

    folded = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("t", "n"))).alias("xs"))
    done = folded.select("key", F.explode(F.aggregate("xs", zero, add, lambda s: F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["n"].alias("n")))))).alias("f"))
    return done.select("key", F.timestamp_micros("f.a").alias("first_ts"), F.timestamp_micros(F.col("f.a") + wait).alias("flush_ts"), F.col("f.n").alias("n_events"))


class Debounce(StatefulProcessor):
    """The stream form of flushes(): state is a flush's first event and its count; a timer closes it."""

    def __init__(self, debounce_ms: int = DEBOUNCE_MS):
        self.wait = max(LEAST_DEBOUNCE_MS, debounce_ms)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = pd.concat(rows)["ts"].sort_values()
        state = self.open.get() if self.open.exists() else None
        first, n, out = (*state, []) if state else (None, 0, [])
        for t in times.astype("datetime64[ms]").astype("int64"):
            if first is not None and t >= first + self.wait:
                self.handle.deleteTimer(first + self.wait)
                out.append((key[0], first, n))
                first = None
            if first is None:
                first, n = int(t), 0
                self.handle.registerTimer(first + self.wait)
            n += 1
        self.open.update((first, n))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, n = self.open.get()
        self.open.clear()
        yield self._rows([(key[0], first, n)])

    def close(self) -> None:
        pass

    def _rows(self, flushed: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(flushed, columns=["key", "first", "n_events"])
        stamp = lambda ms: pd.to_datetime(ms, unit="ms")
        return pd.DataFrame({"key": out["key"], "first_ts": stamp(out["first"]), "flush_ts": stamp(out["first"] + self.wait), "n_events": out["n_events"]})


def stream_flushes(events: DataFrame, debounce_ms: int = DEBOUNCE_MS, delay: str = "1 second") -> DataFrame:
    """flushes() of a stream (key, ts). Needs the RocksDB state store provider."""
    return events.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(Debounce(debounce_ms), "key string, first_ts timestamp, flush_ts timestamp, n_events bigint", "Append", "EventTime")


def watch(events: DataFrame, reindex, checkpoint: str, debounce_ms: int = DEBOUNCE_MS, path_col: str = "path") -> StreamingQuery:
    """Calls reindex(full) for each batch of a stream of file events that has a relevant one; full after a failure.

    The listing, not the events, tells reindex what has changed, so a lost or doubled event does no harm.
    """
    failed = {"last": False}

    def each(batch: DataFrame, _: int) -> None:
        if failed["last"] or not relevant(batch, path_col).isEmpty():
            full, failed["last"] = failed["last"], True
            reindex(full)
            failed["last"] = False

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(LEAST_DEBOUNCE_MS, debounce_ms)} milliseconds").start()
