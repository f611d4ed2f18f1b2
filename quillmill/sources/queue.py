"""A queue of jobs as a streaming source: messages come again until they are done.

Messages are files of one JSON object in ``path/messages``; a job that is done has a file in
``path/done``.  A message that was delivered is hidden for ``visibility`` seconds; then, unless
it is done, it is delivered once more.  Offsets hold the time of each open message's last delivery,
so a micro-batch that is repeated has the same messages.  Workers claim a job before they work on it: a
claim is a file that only one of them can create, so that a message delivered twice is worked once.
The folder is one that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: The shortest time a message or claim is held, tries of a job, and the fields that a message must have.
LEAST_VISIBILITY_S, MOST_ATTEMPTS, MOST_BYTES = 30, 3, 16_384
REQUIRED = ("schemaVersion", "bucket", "key", "versionId", "etag")
MESSAGE = "message string, body string, receipt double"


def job_id(bucket: str, key: str, version: str, tag: str) -> str:
    """The same job for each delivery of one version of an object."""
    return "job-" + hashlib.sha256(":".join((bucket, key, version, tag)).encode()).hexdigest()[:32]


class _Message(InputPartition):
    def __init__(self, name: str, receipt: float):
        super().__init__((name, receipt))


class _QueueReader(DataSourceStreamReader):
    def __init__(self, path: str, visibility: float, most: int):
        self.path, self.visibility, self.most = path, visibility, most
        self.open: dict[str, float] = {}

    def initialOffset(self) -> dict:
        return {"open": {}}

    def _names(self, folder: str) -> list[str]:
        place = os.path.join(self.path, folder)
        return sorted(x for x in os.listdir(place) if not x.startswith((".", "_"))) if os.path.isdir(place) else []

    def latestOffset(self) -> dict:
        now, done = time.time(), set(self._names("done"))
        waiting = [x for x in self._names("messages") if x not in done]
        hidden = {x: self.open[x] for x in waiting if x in self.open and now < self.open[x] + self.visibility}
        seen = [x for x in waiting if x not in hidden][: self.most]
        # what was delivered and stays hidden keeps its time; what is done leaves the offset
        late = {x: self.open[x] for x in waiting if x in self.open and x not in hidden and x not in seen}
        changed = {**hidden, **late, **dict.fromkeys(seen, now)}
        if seen:
            self.open = changed
        return {"open": self.open}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, self.open = start["open"], self.open or dict(end["open"])
        return [_Message(x, t) for x, t in sorted(end["open"].items()) if before.get(x) != t]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, receipt = partition.value
        with open(os.path.join(self.path, "messages", name), encoding="utf-8") as f:
            yield name, f.read(), receipt


class JobQueue(DataSource):
    """``spark.readStream.format("job_queue").option("path", ...)``; options ``visibility`` (seconds) and ``most`` (messages at a time)."""

    @classmethod
    def name(cls) -> str:
        return "job_queue"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _QueueReader(self.options["path"], float(self.options.get("visibility", LEAST_VISIBILITY_S)), int(self.options.get("most", 10)))


def job_stream(spark: SparkSession, path: str, visibility: float = LEAST_VISIBILITY_S, most: int = 10) -> DataFrame:
    spark.dataSource.register(JobQueue)
    return spark.readStream.format("job_queue").option("path", path).option("visibility", str(visibility)).option("most", str(most)).load()


def jobs(messages: DataFrame) -> DataFrame:
    """``message``, ``job_id``, the fields, and ``error`` of a message that can't be a job."""
    kind = "schemaVersion int, bucket string, key string, versionId string, etag string"
    parsed = messages.withColumn("m", F.from_json("body", kind))
    missing = F.array_compact(F.array(*(F.when(F.col(f"m.{f}").isNull(), F.lit(f)) for f in REQUIRED[1:])))
    error = (
        F.when(F.octet_length("body") > MOST_BYTES, "too large")
        .when(F.col("m").isNull() | F.col("m.schemaVersion").isNull(), "not a job")
        .when(F.col("m.schemaVersion") != 1, "unknown version")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    )
    identity = F.concat(F.lit("job-"), F.substring(F.sha2(F.concat_ws(":", "m.bucket", "m.key", "m.versionId", "m.etag"), 256), 1, 32))
    return parsed.select("message", F.when(error.isNull(), identity).alias("job_id"), "m.bucket", "m.key", "m.versionId", "m.etag", error.alias("error"))


def claim(path: str, job: str, worker: str, lease_s: float, attempts: int = MOST_ATTEMPTS, now: float | None = None) -> str:
    """``claimed``, ``busy`` (another's lease runs), ``completed`` or ``terminal`` (no attempt is left).

    Each attempt is a file of its own, made only if it isn't there: of two workers one gets it.
    """
    now = time.time() if now is None else now
    folder = os.path.join(path, "claims", job)
    os.makedirs(folder, exist_ok=True)
    if os.path.exists(os.path.join(folder, "completed")):
        return "completed"
    if os.path.exists(os.path.join(folder, "failed")):
        return "terminal"
    taken = sorted(x for x in os.listdir(folder) if x.startswith("attempt-"))
    if taken:
        try:
            with open(os.path.join(folder, taken[-1]), encoding="utf-8") as f:
                lease = json.load(f)
        except ValueError:  # just being written
            return "busy"
        if lease["until"] > now and not os.path.exists(os.path.join(folder, f"released-{len(taken)}")):
            return "busy"
    if len(taken) >= attempts:
        return "terminal"
    try:
        with open(os.path.join(folder, f"attempt-{len(taken) + 1:04d}"), "x", encoding="utf-8") as f:
            json.dump({"worker": worker, "until": now + lease_s}, f)
    except FileExistsError:
        return "busy"
    return "claimed"


def _mark(path: str, *names: str) -> None:
    os.makedirs(os.path.dirname(os.path.join(path, *names)), exist_ok=True)
    with open(os.path.join(path, *names), "w", encoding="utf-8"):
        pass


class Retry(Exception):
    """Work failed and may succeed later."""


def worked(rows: DataFrame, path: str, work: Callable[[dict], None], worker: str, lease_s: float = LEAST_VISIBILITY_S, attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """Claim and work the jobs of a micro-batch in tasks: ``message``, ``job_id`` and ``outcome``.

    What is completed, failed for good or no job at all is done and isn't delivered again; a job
    that another worker holds, or that may succeed later, comes back after its time.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                job = row["job_id"]
                outcome = "rejected" if job is None or row["error"] is not None else claim(path, job, worker, lease_s, attempts)
                if outcome == "claimed":
                    number = sum(x.startswith("attempt-") for x in os.listdir(os.path.join(path, "claims", job)))
                    try:
                        work(row)
                        outcome = "worked"
                        _mark(path, "claims", job, "completed")
                    except Retry:
                        outcome = "terminal" if number >= attempts else "retry"
                        _mark(path, "claims", job, f"released-{number}")
                    except ValueError:
                        outcome = "terminal"
                    if outcome == "terminal":
                        _mark(path, "claims", job, "failed")
                if outcome not in ("busy", "retry"):
                    _mark(path, "done", row["message"])
                out.append((row["message"], job, outcome))
            yield pd.DataFrame(out, columns=["message", "job_id", "outcome"])

    return rows.mapInPandas(run, "message string, job_id string, outcome string")
