"""Delivery of a stream in batches: flushed by size or by time, with retries of what a receiver refused.

``batched`` holds records by lane until there are enough of them or the first has waited long
enough.  ``delivered`` hands batches to a receiver and tries only the refused records again.
``write_batched`` runs both as a query and writes what was given up to a table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Records of a batch, seconds that its first one waits, tries, and seconds between tries (doubled each time) up to a most.
BATCH, WAIT_S, TRIES, BASE_S, MOST_S = 100, 2.0, 5, 0.2, 5.0

#: Takes payloads and returns for each what was wrong with it, or None.
Receiver = Callable[[list[str]], list[str | None]]


class Refused(Exception):
    """A whole call failed; ``again`` says whether it may work later."""

    def __init__(self, error: str, again: bool = True):
        super().__init__(error)
        self.again = again


def delay(attempt: int, base: float = BASE_S, most: float = MOST_S) -> float:
    """Seconds to wait after the try of this number (from 0)."""
    return min(base * 2**attempt, most)


def put(payloads: list[str], receiver: Receiver, tries: int = TRIES, base: float = BASE_S, most: float = MOST_S, sleep: Callable[[float], None] = time.sleep) -> tuple[list[tuple[str, str]], int]:
    """Deliver payloads; returns (payload, error) of those given up, and the number of calls.

    Only refused payloads are sent again.  A failed call is repeated whole, unless it
    can't work later.
    """
    left: list[tuple[str, str]] = [(p, "") for p in payloads]
    for attempt in range(max(1, tries)):
        try:
            errors = receiver([p for p, _ in left])
            left = [(p, e) for (p, _), e in zip(left, errors, strict=True) if e]
        except Refused as why:
            left = [(p, str(why)) for p, _ in left]
            if not why.again:
                return left, attempt + 1
        if not left:
            return [], attempt + 1
        if attempt + 1 < tries:
            sleep(delay(attempt, base, most))
    return left, max(1, tries)


def batched(records: DataFrame, size: int = BATCH, wait_s: float = WAIT_S) -> DataFrame:
    """A stream of (``lane``, ``payload``) as ``lane``, ``batch`` (a number), ``payloads`` and ``cause`` (size or time).

    Lanes are independent; a stream too large for one buffer has several, dealt by a hash.
    A buffer holds less than ``size`` records between micro-batches.
    """
    types = dict(records.dtypes)

    def fold(key: tuple, rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        kept, number, since = held.get if held.exists else ([], 0, 0.0)
        kept, now, out = list(kept), time.time(), []

        def flush(n: int, cause: str) -> None:
            nonlocal number
            out.append((key[0], number, kept[:n], cause))
            del kept[:n]
            number += 1

        if held.hasTimedOut:
            flush(len(kept), "time")
        for part in rows:
            for payload in part["payload"]:
                since = since if kept else now
                kept.append(payload)
                if len(kept) >= size:
                    flush(size, "size")
        if kept and now - since >= wait_s:
            flush(len(kept), "time")
        held.update((kept, number, since))
        if kept:
            held.setTimeoutDuration(max(1, int(1000 * (since + wait_s - now))))
        if out:
            yield pd.DataFrame(out, columns=["lane", "batch", "payloads", "cause"])

    state = "kept array<string>, number long, since double"
    return records.select("lane", "payload").groupBy("lane").applyInPandasWithState(fold, f"lane {types['lane']}, batch long, payloads array<string>, cause string", state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def delivered(batches: DataFrame, receiver: Receiver, tries: int = TRIES, base: float = BASE_S, most: float = MOST_S) -> DataFrame:
    """Hand batches to ``receiver`` in tasks; the rows are what was given up: ``lane``, ``batch``, ``payload``, ``error``, ``calls``."""
    types = dict(batches.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for lane, batch, payloads in zip(part["lane"], part["batch"], part["payloads"], strict=True):
                left, calls = put(list(payloads), receiver, tries, base, most)
                out += [(lane, batch, p, e, calls) for p, e in left]
            yield pd.DataFrame(out, columns=["lane", "batch", "payload", "error", "calls"])

    return batches.select("lane", "batch", "payloads").mapInPandas(run, f"lane {types['lane']}, batch long, payload string, error string, calls int")


def write_batched(records: DataFrame, receiver: Receiver, dead: str, checkpoint: str, size: int = BATCH, wait_s: float = WAIT_S, **retry) -> StreamingQuery:
    """Run the delivery; a micro-batch that is repeated replaces its own rows of the table ``dead``, and may deliver again."""

    def each(batches: DataFrame, number: int) -> None:
        delivered(batches, receiver, **retry).write.mode("overwrite").parquet(f"{dead}/micro={number}")

    return batched(records, size, wait_s).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).start()


def within_capacity(rows: DataFrame, capacity: int, lane: str = "lane", order: str = "at") -> DataFrame:
    """Rows with ``dropped``: of each lane's waiting rows those that come when ``capacity`` are there.

    Counts of whole blocks say where the limit falls, so that only the block in which it does is ranked.
    """
    from pyspark.sql import Window

    span = rows.groupBy(lane).agg(F.min(order).alias("_low"), F.max(order).alias("_high"), F.count("*").alias("_n"))
    blocks = F.when(F.col("_high") > F.col("_low"), F.floor((F.col(order) - F.col("_low")) * 1023 / (F.col("_high") - F.col("_low")))).otherwise(0)
    dealt = rows.join(span, lane).withColumn("_block", blocks)
    counts = dealt.groupBy(lane, "_block").agg(F.count("*").alias("_c"))  # 1,024 rows a lane at most
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(lane).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limits = counts.withColumn("_before", before).filter(F.col("_before") < capacity).select(lane, "_block", "_before", (F.col("_before") + F.col("_c") > capacity).alias("_cut"))
    placed = dealt.join(limits, [lane, "_block"], "left")
    key = F.when(F.col("_cut"), F.lit(0)).otherwise(F.pmod(F.xxhash64(order), F.lit(1024)) + 1)  # rows that need no rank are spread
    rank = F.row_number().over(Window.partitionBy(lane, "_block", key).orderBy(order))
    dropped = F.when(F.col("_before").isNull(), True).when(F.col("_cut"), F.col("_before") + rank > capacity).otherwise(False)
    return placed.select(*rows.columns, dropped.alias("dropped"))
