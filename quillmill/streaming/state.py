"""Stateful operators: a sliding log of allowed requests, and a circuit breaker.

Both are small folds over one key's rows in order of time.  The batch forms first cut a
key's rows into islands where the state is known to be empty, and settle by built-in
functions every island that is too small for the limit to matter.  What is left is
dealt by key and island, sorted, and folded as it streams through a task, which holds
the state of one island only.  The streaming forms keep the state, and the rows that the
watermark has not passed yet, in Spark's state store, so late rows are folded in order.

Rows without a time are not judged: their result is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmill.plans.catalogue import register
from quillmill.sources.views import table

WINDOW_S = 3 * 3600
LIMIT = 2
BREAK_AFTER = 2
OPEN_S = 6 * 3600

#: A step takes the state (a list of numbers), a time and whether the call failed, and changes the state.
Step = Callable[[list[float], float, bool], bool]


def allow(times: Iterable[float], log: list[float], window: float = WINDOW_S, limit: int = LIMIT) -> Iterator[bool]:
    """Is each request allowed?  ``log`` has the times of allowed ones; what is refused leaves no trace."""
    for t in times:
        while log and log[0] <= t - window:
            log.pop(0)
        ok = len(log) < limit
        if ok:
            log.append(t)
        yield ok


def breaker(rows: Iterable[tuple[float, bool]], state: list[float], after: int = BREAK_AFTER, open_s: float = OPEN_S) -> Iterator[bool]:
    """Is the circuit closed when each call arrives?  ``state``: failures in a row, and open until."""
    for t, failed in rows:
        closed = t >= state[1]
        if closed:
            state[0] = state[0] + 1 if failed else 0.0
            if state[0] >= after:
                state[0], state[1] = 0.0, t + open_s
        yield closed


def rate_step(state: list[float], t: float, failed: bool) -> bool:
    return next(allow((t,), state))


def breaker_step(state: list[float], t: float, failed: bool) -> bool:
    if not state:
        state.extend((0.0, 0.0))
    return next(breaker(((t, failed),), state))


def _seconds(column: str = "ts") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def _islands(events: DataFrame, fresh: Column) -> DataFrame:
    """``events`` (user_id, event_id, t, failed) with the number of the island that each row of a key is in."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    gap = F.col("t") - F.lag("t").over(w)
    return events.withColumn("gap", gap).withColumn("island", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(w))


def _folded(rows: DataFrame, step: Step, name: str) -> DataFrame:
    """event_id and the step's answer, row after row of each island."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, []
        for b in batches:
            out = []
            for user, island, t, failed in zip(*[b.column(k).to_pylist() for k in ("user_id", "island", "t", "failed")], strict=True):
                if (user, island) != at:
                    at, state = (user, island), []
                out.append(step(state, t, bool(failed)))
            yield pa.record_batch([b.column("event_id"), pa.array(out, pa.bool_())], ["event_id", name])

    dealt = rows.select("user_id", "island", "t", "event_id", "failed").repartition("user_id", "island").sortWithinPartitions("user_id", "island", "t", "event_id")
    return dealt.mapInArrow(run, f"event_id long, {name} boolean")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", _seconds().alias("t"), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("failed"))


_ORDERED = "e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@register(
    "rate_limit_log",
    f"""WITH RECURSIVE {_ORDERED},
r AS (SELECT user_id, k, event_id, [t] AS log, true AS allowed FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, event_id, CASE WHEN len(kept) < {LIMIT} THEN list_append(kept, t) ELSE kept END, len(kept) < {LIMIT}
  FROM (SELECT e.user_id, e.k, e.event_id, e.t, list_filter(r.log, lambda x: x > e.t - {WINDOW_S * 1_000_000}) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) n)
SELECT event_id, allowed FROM r""",
)
def rate_limit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and whether the sliding log allows it; a pause of a window empties the log."""
    return sliding_log(calls(spark, sf_dir))


def sliding_log(events: DataFrame) -> DataFrame:
    """event_id and ``allowed``; an island of at most LIMIT requests is allowed whole."""
    rows = _islands(events.filter("t is not null"), F.col("gap") >= WINDOW_S)
    rows = rows.withColumn("harmless", F.count("*").over(Window.partitionBy("user_id", "island")) <= LIMIT)
    return _answers(events, rows, rate_step, "allowed")


def circuit_states(events: DataFrame) -> DataFrame:
    """event_id and ``closed``.

    A success after a pause that no open circuit outlasts finds the circuit closed and
    leaves no failure behind, so an island begins there; one of fewer failures than
    open a circuit stays closed.
    """
    rows = _islands(events.filter("t is not null"), (F.col("gap") >= OPEN_S) & ~F.col("failed"))
    rows = rows.withColumn("harmless", F.count_if("failed").over(Window.partitionBy("user_id", "island")) < BREAK_AFTER)
    return _answers(events, rows, breaker_step, "closed")


def _answers(events: DataFrame, rows: DataFrame, step: Step, name: str) -> DataFrame:
    settled = rows.filter("harmless").select("event_id", F.lit(True).alias(name))
    unknown = events.filter("t is null").select("event_id", F.lit(None).cast("boolean").alias(name))
    return settled.unionByName(_folded(rows.filter("not harmless"), step, name)).unionByName(unknown)


@register(
    "circuit_breaker",
    f"""WITH RECURSIVE {_ORDERED},
r AS (SELECT user_id, k, event_id, CASE WHEN failed AND {BREAK_AFTER} > 1 THEN 1 ELSE 0 END AS row_of, CASE WHEN failed AND {BREAK_AFTER} <= 1 THEN t + {OPEN_S * 1_000_000} ELSE 0 END AS until, true AS closed FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, event_id, CASE WHEN NOT shut THEN row_of WHEN NOT failed OR row_of + 1 >= {BREAK_AFTER} THEN 0 ELSE row_of + 1 END,
    CASE WHEN shut AND failed AND row_of + 1 >= {BREAK_AFTER} THEN t + {OPEN_S * 1_000_000} ELSE until END, shut
  FROM (SELECT e.user_id, e.k, e.event_id, e.t, e.failed, r.row_of, r.until, e.t >= r.until AS shut FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) n)
SELECT event_id, closed FROM r""",
)
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and whether the user's circuit is closed when the call arrives."""
    return circuit_states(calls(spark, sf_dir))


def _in_order(events: DataFrame, step: Step, name: str, late: str, horizon: float) -> DataFrame:
    """A fold over a stream of (user_id, event_id, ts, failed), each key in order of time.

    Rows wait in the state until the watermark has passed them; a key that has none
    waiting is forgotten ``horizon`` seconds after its last row.
    """
    state_schema = "state array<double>, times array<double>, ids array<long>, failed array<boolean>, last double"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, times, ids, failed, last = (list(x) if k < 4 else x for k, x in enumerate(held.get)) if held.exists else ([], [], [], [], 0.0)
        for rows in batches:
            times += [t.timestamp() for t in rows["ts"]]
            ids += rows["event_id"].tolist()
            failed += rows["failed"].tolist()
        mark = held.getCurrentWatermarkMs() / 1000
        waiting, out = [], []
        for t, i, f in sorted(zip(times, ids, failed, strict=True)):
            if t <= mark:
                out.append((i, step(state, t, f)))
                last = max(last, t)
            else:
                waiting.append((t, i, f))
        if out:
            yield pd.DataFrame(out, columns=["event_id", name])
        next_at = min(t for t, _, _ in waiting) if waiting else last + horizon
        if not waiting and next_at <= mark:
            held.remove()
            return
        held.update(([float(x) for x in state], [t for t, _, _ in waiting], [i for _, i, _ in waiting], [f for _, _, f in waiting], float(last)))
        held.setTimeoutTimestamp(max(int(next_at * 1000), int(mark * 1000)) + 1)

    keyed = events.withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(fold, f"event_id long, {name} boolean", state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The sliding log over a stream of (user_id, event_id, ts, failed)."""
    return _in_order(events, rate_step, "allowed", late, WINDOW_S)


def circuit_stream(events: DataFrame, late: str = "10 minutes", horizon: float = 7 * 24 * 3600) -> DataFrame:
    """The circuit breaker over a stream of (user_id, event_id, ts, failed); failures in a row are forgotten after ``horizon`` seconds."""
    return _in_order(events, breaker_step, "closed", late, max(horizon, OPEN_S))


def alarm_stream(events: DataFrame, period: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Error rates by period over a stream of events with a timestamp ``ts``."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", period).alias("w"))
    return w.agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed")).select(F.col("w.start").alias("period"), "total", "failed")


def deduplicated_stream(jobs: DataFrame, key: str = "job_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each job once, while its key may still come again."""
    return jobs.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
