"""A static side that a stream follows: read again when it is older than some seconds."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

EVERY_S = 15.0


class Polled:
    """What ``load`` gave last, for ``every`` seconds; an empty table is asked for again at once.

    A load that fails gives an empty table, so that nothing of an unknown generation passes.
    Each load is counted, which runs it once per refresh.
    """

    def __init__(self, load: Callable[[], DataFrame], empty: DataFrame, every: float = EVERY_S, clock: Callable[[], float] = time.monotonic):
        self.load, self.empty, self.every, self.clock = load, empty, every, clock
        self.rows, self.at = None, 0.0

    def now(self) -> DataFrame:
        if self.rows is not None and self.clock() - self.at < self.every:
            return self.rows
        try:
            rows = self.load()
            some = not rows.isEmpty()
        except (PySparkException, OSError):
            self.rows = None
            return self.empty
        self.rows, self.at = (rows if some else None), self.clock()
        return rows


def active_only(rows: DataFrame, pointers: DataFrame, keys: tuple[str, ...] = ("country", "language")) -> DataFrame:
    """The rows whose generation the pointers of their locale name; a pointer without a name names none."""
    named = pointers.filter(F.coalesce("generation", F.lit("")) != "").select(*keys, "generation").distinct()
    return rows.join(named, [*keys, "generation"], "left_semi")


def follow(stream: DataFrame, pointers: Polled, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch with the pointers that hold when it begins."""

    def each(batch: DataFrame, number: int) -> None:
        write(active_only(batch, pointers.now()), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
