"""Order-dependent folds over the rows of a key: rate limits, circuit breakers, caches.

Rows are hash-partitioned by key, sorted within the partition and streamed through Python in Arrow batches; what is kept is the
state of the key at hand, never its rows. A key's rows pass one after the other, as the semantics demand.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold(df: DataFrame, key: str, at: str, tie: str, extra: list[str], fresh: Callable[[], Callable], out: str, kind: str) -> DataFrame:
    """``key, tie, out``: the result of ``fresh()(at in microseconds, *extra)`` for each row in order; a fresh state for each key. Rows without key or time have none."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(_parse_datatype_string(kind))
    micros = F.unix_micros(F.col(at).cast("timestamp")).alias("_at")
    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, tie, micros, *extra)
    ordered = rows.repartition(F.col(key)).sortWithinPartitions(key, "_at", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            res = []
            for k, _, t, *x in zip(*cols, strict=True):
                if k != now:
                    now, step = k, fresh()
                res.append(step(t, *x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(res, arrow)], names=[key, tie, out])

    types = dict(df.dtypes)
    return ordered.mapInArrow(run, f"{key} {types[key]}, {tie} {types[tie]}, {out} {kind}")


def rate_limit(df: DataFrame, key: str, at: str, tie: str, limit: int, seconds: float) -> DataFrame:
    """``key, tie, accepted``: at most ``limit`` accepted rows in any window of ``seconds``; refused rows aren't counted. A row exactly ``seconds`` old still counts."""
    span = int(seconds * 1e6)

    def fresh():
        seen: deque[int] = deque()

        def step(t: int) -> bool:
            while seen and t - seen[0] > span:
                seen.popleft()
            if len(seen) >= limit:
                return False
            seen.append(t)
            return True

        return step

    return fold(df, key, at, tie, [], fresh, "accepted", "boolean")


def breaker(df: DataFrame, key: str, at: str, tie: str, failed: str, threshold: int, seconds: float) -> DataFrame:
    """``key, tie, outcome`` of calls through a circuit breaker: ``blocked`` while it is open, else ``ok`` or ``failed``.

    ``threshold`` failures in a row open it for ``seconds``; the first call after that goes through with the count reset.
    """
    span = int(seconds * 1e6)

    def fresh():
        state = [0, None]  # failures in a row, time until which it is open

        def step(t: int, bad: bool) -> str:
            if state[1] is not None:
                if t < state[1]:
                    return "blocked"
                state[0], state[1] = 0, None
            if not bad:
                state[0] = 0
                return "ok"
            state[0] += 1
            if state[0] >= threshold:
                state[1] = t + span
            return "failed"

        return step

    return fold(df, key, at, tie, [failed], fresh, "outcome", "string")


def ttl_cache(df: DataFrame, key: str, at: str, tie: str, seconds: float) -> DataFrame:
    """``key, tie, hit``: whether a value put in at the last miss of the key is still there; it lives ``seconds`` from when it was put in."""
    span = int(seconds * 1e6)

    def fresh():
        put: list[int | None] = [None]

        def step(t: int) -> bool:
            if put[0] is not None and t - put[0] < span:
                return True
            put[0] = t
            return False

        return step

    return fold(df, key, at, tie, [], fresh, "hit", "boolean")


def lru_cache(df: DataFrame, scope: str, key: str, at: str, tie: str, seconds: float, capacity: int = 200) -> DataFrame:
    """``scope, tie, hit`` of look-ups in caches of ``capacity`` keys, one for each ``scope``: a value lives ``seconds`` from when it was put in, and the key used longest ago makes room."""
    span = int(seconds * 1e6)

    def fresh():
        held: OrderedDict[object, int] = OrderedDict()

        def step(t: int, k: object) -> bool:
            put = held.get(k)
            if put is not None and t - put < span:
                held.move_to_end(k)
                return True
            held[k] = t
            held.move_to_end(k)
            if len(held) > capacity:
                held.popitem(last=False)
            return False

        return step

    return fold(df, scope, at, tie, [key], fresh, "hit", "boolean")


def sessions(df: DataFrame, user: str, at: str, tie: str, value: str, recent: int = 20) -> DataFrame:
    """``user, first_seen, last_seen, n_sessions, latest, recent_values``: what is remembered of each user; ``latest``: the last value that isn't null.

    ``recent_values`` holds the last ``recent`` values in order; the full history is the table itself. Rows without user or time don't count.
    """
    rows = df.where(F.col(user).isNotNull() & F.col(at).isNotNull()).select(F.col(user).alias("user"), F.col(at).alias("_at"), F.col(tie).alias("_tie"), F.col(value).alias("_v"))
    whole = rows.groupBy("user").agg(F.min("_at").alias("first_seen"), F.max("_at").alias("last_seen"), F.count(F.lit(1)).alias("n_sessions"), F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_at", "_tie"))).alias("latest"))
    last = rows.where("_v is not null").withColumn("_n", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("_at"), F.desc("_tie")))).where(F.col("_n") <= recent)
    some = last.groupBy("user").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_tie", "_v"))), lambda x: x["_v"]).alias("recent_values"))
    return whole.join(some, "user", "left").withColumn("recent_values", F.coalesce("recent_values", F.array().cast(f"array<{dict(rows.dtypes)['_v']}>")))
