"""Continuous ingestion: pages arrive as files or a stream, repeats go, prices are watched, failures are kept apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def page_stream(spark: SparkSession, folder: str, ddl: str = "page_id long, url string, html string, ts timestamp", files_per_trigger: int = 100) -> DataFrame:
    """Pages from Parquet files as they land in a folder."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_seen(pages: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first page of a URL within a watermark; state older than that is dropped."""
    return pages.withWatermark("ts", within).dropDuplicatesWithinWatermark(["url"])


def split_sink(pages: DataFrame, work: Callable[[DataFrame], tuple[DataFrame, DataFrame]], good: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Runs work over each micro-batch and writes what it gives, good rows and dead letters, in a folder for each batch: a batch that runs again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        fine, bad = work(batch)
        fine.write.mode("overwrite").parquet(f"{good}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        batch.unpersist()

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def price_changes(observed: DataFrame) -> DataFrame:
    """url, ts, before, price: rows whose price differs from the one before of the same url. observed: url, ts, price."""
    order = Window.partitionBy("url").orderBy("ts", "price")
    return observed.withColumn("before", F.lag("price").over(order)).filter(F.col("before").isNotNull() & (F.col("before") != F.col("price"))).select("url", "ts", "before", "price")


def price_change_stream(observed: DataFrame) -> DataFrame:
    """The same for a stream: the last price of each url is state that idles out after a day without a page."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for ts, price in frame.sort_values(["ts", "price"])[["ts", "price"]].itertuples(index=False):
                if last is not None and price != last:
                    out.append((key[0], ts, last, price))
                last = price
        if last is not None:
            state.update((last,))
        state.setTimeoutDuration(24 * 3600 * 1000)
        yield pd.DataFrame(out, columns=["url", "ts", "before", "price"])

    return observed.groupBy("url").applyInPandasWithState(step, "url string, ts timestamp, before double, price double", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


@dataclass(frozen=True)
class RetryPolicy:
    """Attempts that a page has, seconds before the second one (each further wait is twice as long), and how long an attempt may take."""

    most: int = 3
    wait: int = 60
    lease: int = 300


class _Tries:
    """The attempts of one page: at any time it has a timer, for the end of a lease or of a wait. Times are in milliseconds."""

    def __init__(self, policy: RetryPolicy, attempt: int = 0, timer: int = 0, leased: bool = False):
        self.policy, self.attempt, self.timer, self.leased = policy, attempt, timer, leased
        self.out: list[tuple[int, str, int]] = []

    def start(self, at: int) -> None:
        self.attempt, self.leased, self.timer = self.attempt + 1, True, at + self.policy.lease * 1000
        self.out.append((self.attempt, "try", at))

    def end(self, action: str, at: int) -> None:
        self.out.append((self.attempt, action, at))
        self.attempt, self.timer, self.leased = 0, 0, False

    def fail(self, at: int) -> None:
        if self.attempt >= self.policy.most:
            self.end("dead", at)
        else:
            self.leased, self.timer = False, at + self.policy.wait * 1000 * 2 ** (self.attempt - 1)

    def until(self, now: int) -> None:
        """All timers up to now, in their order: a wait that ends starts an attempt, a lease that ends has failed."""
        while self.attempt and self.timer <= now:
            (self.fail if self.leased else self.start)(self.timer)

    def hear(self, kind: str, at: int) -> None:
        self.until(at)
        if kind == "new" and not self.attempt:
            self.start(at)
        elif kind == "ok" and self.attempt:
            self.end("done", at)
        elif kind == "failed" and self.attempt and self.leased:
            self.fail(at)


def retry_stream(events: DataFrame, policy: RetryPolicy = RetryPolicy(), late: str = "0 seconds") -> DataFrame:
    """url, attempt, action, at: what a stream of requests and outcomes leads to over time.

    events: url, kind (`new`, `ok`, `failed`), ts. A new url is tried at once; an attempt that fails, or says nothing until its lease ends, is tried again
    after a wait that doubles, and the last failure makes a dead letter. Actions: `try`, `done`, `dead`. The clock is the stream's own
    (event time and its watermark), so a replay gives the same actions; a url's state ends with `done` or `dead`. News of a url that is being tried and
    outcomes of urls that aren't are ignored. With split_sink, actions are written once for each batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries = _Tries(policy, *(state.get if state.exists else ()))
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["ts", "kind"])
            for kind, ts in zip(rows["kind"], rows["ts"], strict=True):
                tries.hear(kind, ts.value // 1_000_000)
        now = state.getCurrentWatermarkMs()
        tries.until(now)
        if tries.attempt:
            state.update((tries.attempt, tries.timer, tries.leased))
            state.setTimeoutTimestamp(max(tries.timer, now + 1))
        elif state.exists:
            state.remove()
        found = [(key[0], n, action, pd.Timestamp(at, unit="ms")) for n, action, at in tries.out]
        yield pd.DataFrame(found, columns=["url", "attempt", "action", "at"]).astype({"attempt": "int32", "at": "datetime64[ns]"})

    shape = "url string, attempt int, action string, at timestamp"
    return events.withWatermark("ts", late).groupBy("url").applyInPandasWithState(step, shape, "attempt int, timer long, leased boolean", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, session (start, end), n: events with less than a gap between them."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))


def activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window, event_type, n, value: figures for each stretch of time; rows later than the watermark are dropped."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("window"), "event_type")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
