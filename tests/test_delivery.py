"""Batched delivery, the job queue and polled pointers."""

import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from quillmill.sources import queue
from quillmill.streaming import delivery, pointers


def test_only_refused_records_are_sent_again():
    calls, slept = [], []

    def receiver(payloads):
        calls.append(list(payloads))
        return [f"busy {len(calls)}" if p in ("b", "d") and len(calls) < 3 or p == "x" else None for p in payloads]

    assert delivery.put(["a", "b", "c", "d"], receiver, sleep=slept.append) == ([], 3)
    assert calls == [["a", "b", "c", "d"], ["b", "d"], ["b", "d"]] and slept == [0.2, 0.4]
    calls.clear()
    assert delivery.put(["a", "x"], receiver, tries=4, sleep=slept.append) == ([("x", "busy 4")], 4)
    assert [delivery.delay(k) for k in range(7)] == [0.2, 0.4, 0.8, 1.6, 3.2, 5.0, 5.0]


def test_failed_calls():
    tried = []

    def down(payloads):
        tried.append(1)
        raise delivery.Refused("throttled", again=len(tried) < 2)

    assert delivery.put(["a"], down, sleep=lambda s: None) == ([("a", "throttled")], 2)


def wait_for(check, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return
        time.sleep(0.3)
    raise AssertionError("it did not happen")


def test_stream_flushes_by_size_and_by_time(spark, tmp_path):
    src, sent, dead = tmp_path / "in", tmp_path / "sent", tmp_path / "dead"
    for p in (src, sent):
        p.mkdir()
    folder = str(sent)

    def receiver(payloads):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            json.dump(payloads, f)
        return ["never" if p == "bad" else None for p in payloads]

    (src / "a.json").write_text("\n".join(json.dumps({"lane": "x", "payload": f"p{i}"}) for i in range(25)))
    stream = spark.readStream.schema("lane string, payload string").json(str(src))
    q = delivery.write_batched(stream, receiver, str(dead), str(tmp_path / "c"), size=10, wait_s=1.5, tries=2, base=0.01)
    try:
        calls = lambda: [json.loads(p.read_text()) for p in sent.iterdir()]
        wait_for(lambda: sum(map(len, calls())) >= 25)
        assert sorted(map(len, calls())) == [5, 10, 10]  # two by size, the rest by time
        (src / "b.json").write_text(json.dumps({"lane": "y", "payload": "bad"}))
        wait_for(lambda: sum(c == ["bad"] for c in calls()) == 2)
        given_up = lambda: [r for p in dead.glob("micro=*") if (p / "_SUCCESS").exists() for r in spark.read.parquet(str(p)).collect()]
        wait_for(lambda: given_up() != [])
    finally:
        q.stop()
    rows = given_up()
    assert [(r["lane"], r["payload"], r["error"], r["calls"]) for r in rows] == [("y", "bad", "never", 2)]


@pytest.mark.parametrize("capacity", [0, 1, 7, 40, 5000])
def test_rows_beyond_capacity_are_dropped(spark, capacity):
    rows = [("a", i * i % 3001) for i in range(900)] + [("b", 5)] + [("c", i) for i in range(30)]
    rows = sorted(set(rows))
    got = delivery.within_capacity(spark.createDataFrame(rows, "lane string, at long").repartition(3), capacity).collect()
    assert len(got) == len(rows)
    for lane in "abc":
        order = sorted((r["at"], r["dropped"]) for r in got if r["lane"] == lane)
        assert [d for _, d in order] == [k >= capacity for k in range(len(order))]


def message(path, name, **changed):
    body = {"schemaVersion": 1, "bucket": "b", "key": "k", "versionId": "v1", "etag": "e"} | changed
    (path / "messages").mkdir(exist_ok=True)
    (path / "messages" / f".{name}").write_text(json.dumps(body))
    (path / "messages" / f".{name}").rename(path / "messages" / name)


def test_a_job_delivered_again_is_worked_once(spark, tmp_path):
    root, log = str(tmp_path), tmp_path / "log"
    log.mkdir()
    folder = str(log)
    message(tmp_path, "m1")
    message(tmp_path, "m2")  # the same job by another message
    message(tmp_path, "m3", key="slow")
    message(tmp_path, "m4", schemaVersion=2)
    message(tmp_path, "m5", key="wrong")

    def work(row):
        with open(os.path.join(folder, f"{row['key']}-{uuid.uuid4().hex}"), "w"):
            pass
        if row["key"] == "slow" and sum(x.startswith("slow") for x in os.listdir(folder)) < 2:
            raise queue.Retry("not yet")
        if row["key"] == "wrong":
            raise ValueError("no such document")

    def each(batch, number):
        done = queue.worked(queue.jobs(batch).coalesce(1).sortWithinPartitions("message"), root, work, "w1")
        done.withColumn("micro", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/micro={number}")

    q = queue.job_stream(spark, root, visibility=2.0).writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/c").start()
    try:
        wait_for(lambda: (tmp_path / "done").exists() and len(list((tmp_path / "done").iterdir())) == 5)
    finally:
        q.stop()
    worked = sorted(x.split("-")[0] for x in os.listdir(folder))
    assert worked == ["k", "slow", "slow", "wrong"]
    outcomes = {}
    for r in spark.read.parquet(f"{root}/out/*").collect():
        outcomes.setdefault(r["message"], []).append(r["outcome"])
    assert outcomes["m1"] == ["worked"] and outcomes["m2"] == ["completed"] and sorted(outcomes["m3"]) == ["retry", "worked"]
    assert outcomes["m4"] == ["rejected"] and outcomes["m5"] == ["terminal"]


def test_claims(tmp_path):
    path = str(tmp_path)
    take = lambda worker, now: queue.claim(path, "j", worker, 30, attempts=2, now=now)
    assert [take("a", 0), take("b", 10), take("b", 31), take("a", 40), take("a", 100)] == ["claimed", "busy", "claimed", "busy", "terminal"]


def test_messages_that_are_no_jobs(spark):
    good = {"schemaVersion": 1, "bucket": "b", "key": "k", "versionId": "v", "etag": "e"}
    bodies = [json.dumps(good), "{", json.dumps(good | {"etag": None}), json.dumps(good | {"schemaVersion": 3}), json.dumps(good | {"key": "x" * 17_000})]
    got = queue.jobs(spark.createDataFrame([(str(i), b, 0.0) for i, b in enumerate(bodies)], queue.MESSAGE)).orderBy("message").collect()
    assert [r["error"] for r in got] == [None, "not a job", "missing: etag", "unknown version", "too large"]
    assert got[0]["job_id"] == queue.job_id("b", "k", "v", "e") and got[1]["job_id"] is None


def test_stream_follows_a_pointer(spark, tmp_path):
    clock = [0.0]
    kind = "country string, language string, generation string"
    current = {"rows": [("DE", "de", "g1"), ("FR", "fr", "")]}

    def load():
        if current["rows"] is None:
            raise OSError("no pointers")
        return spark.createDataFrame(current["rows"], kind)

    polled = pointers.Polled(load, spark.createDataFrame([], kind), every=15, clock=lambda: clock[0])
    seen, src = {}, tmp_path / "in"
    src.mkdir()
    rows = [{"country": "DE", "language": "de", "generation": g, "id": i} for i, g in enumerate(("g1", "g2", "g1"))] + [{"country": "FR", "language": "fr", "generation": "", "id": 9}]

    def write(df, number):
        seen[number] = sorted(r["id"] for r in df.collect())

    q = pointers.follow(spark.readStream.schema(kind + ", id long").json(str(src)), polled, write, str(tmp_path / "c"))
    try:
        for k, (at, now) in enumerate(((0, current["rows"]), (10, [("DE", "de", "g2")]), (16, [("DE", "de", "g2")]), (40, None), (41, [("DE", "de", "g1")]))):
            clock[0], current["rows"] = at, now
            (src / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
            q.processAllAvailable()
    finally:
        q.stop()
    # the second batch still has the pointers of the first; a failed read lets nothing pass
    assert [seen[k] for k in sorted(seen)] == [[0, 2], [0, 2], [1], [], [0, 2]]
