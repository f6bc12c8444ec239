"""Streams of use: daily counts without repeats; a rate limit, a breaker and a cache with their own state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(log: DataFrame, delay: str = "30 days") -> DataFrame:
    """``day, source_channel, n, helpful`` over ``logged_at``; entries sent again within ``delay`` count once, later ones are dropped by the watermark. ``delay`` must cover late arrivals (weeks)."""
    s = log.withColumn("logged_at", F.col("logged_at").cast("timestamp")).withWatermark("logged_at", delay).dropDuplicatesWithinWatermark(["log_id"])
    w = s.groupBy(F.window("logged_at", "1 day").alias("w"), "source_channel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("user_helpful"), 1).otherwise(0)).alias("helpful"))
    return w.select(F.col("w.start").alias("day"), "source_channel", "n", "helpful")


def _keyed(rows: DataFrame, extra: list[str], out: str, state: str, start: tuple, step: Callable, lasts: float | None, delay: str) -> DataFrame:
    """``user_id, event_id, out`` of a stream, by ``step(state, time in microseconds, *extra) -> (state, result)`` over each key's rows in order of time within a batch.

    A key's state is dropped when the watermark (``delay`` behind the latest row) has passed its last row by ``lasts`` seconds, or kept if that is None.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = tuple(held.get) if held.exists else start
        each = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        results, at = [], 0
        for t, *x in zip(each["ts"], *(each[c] for c in extra), strict=True):
            at = pd.Timestamp(t).value // 1000
            now, result = step(now, at, *x)
            results.append(result)
        held.update(now)
        if lasts is not None:
            held.setTimeoutTimestamp(max(int(at / 1000 + lasts * 1000), held.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"user_id": key[0], "event_id": each["event_id"].to_numpy(), out.split()[0]: results})

    marked = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return marked.groupBy("user_id").applyInPandasWithState(run, f"user_id long, event_id long, {out}", state, "append", "NoTimeout" if lasts is None else "EventTimeTimeout")


def rate_limited(requests: DataFrame, limit: int, seconds: float, delay: str = "1 hour") -> DataFrame:
    """``user_id, event_id, accepted`` of a stream of ``user_id, event_id, ts``: as the batch operator. A key's state is the times of its accepted rows in the window, ``limit`` at most."""
    span = seconds * 1e6

    def step(state: tuple, at: int) -> tuple[tuple, bool]:
        seen = [s for s in state[0] if at - s <= span]
        ok = len(seen) < limit
        return ([*seen, at] if ok else seen,), ok

    return _keyed(requests, [], "accepted boolean", "seen array<long>", ([],), step, seconds, delay)


def broken(calls: DataFrame, threshold: int, seconds: float, delay: str = "1 hour") -> DataFrame:
    """``user_id, event_id, outcome`` of a stream of ``user_id, event_id, ts, failed``: as the batch breaker. Two numbers are kept of each key for good, since failures in a row may be any time apart."""
    span = int(seconds * 1e6)

    def step(state: tuple, at: int, failed: bool) -> tuple[tuple, str]:
        fails, until = state
        if until and at < until:
            return state, "blocked"
        fails = 0 if until else fails
        if not failed:
            return (0, 0), "ok"
        return (fails + 1, at + span if fails + 1 >= threshold else 0), "failed"

    return _keyed(calls, ["failed"], "outcome string", "fails long, until long", (0, 0), step, None, delay)


def cached(lookups: DataFrame, seconds: float, delay: str = "1 hour") -> DataFrame:
    """``user_id, event_id, hit`` of a stream of ``user_id, event_id, ts``: as the batch cache; a value lives ``seconds`` from when it was put in."""
    span = int(seconds * 1e6)

    def step(state: tuple, at: int) -> tuple[tuple, bool]:
        hit = state[0] > 0 and at - state[0] < span
        return (state if hit else (at,)), hit

    return _keyed(lookups, [], "hit boolean", "put long", (0,), step, seconds, delay)
