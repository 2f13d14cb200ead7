"""Keyed state of a stream against the batch result: over restarts, in any order, with timers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docweave.streaming import keyed

EVENT = "region_id long, event_no long, decision string"


def plain(events):
    out = {}
    for k in {e[0] for e in events if None not in e}:
        own = [e for e in events if e[0] == k and None not in e]
        accepted = max([e[1] for e in own if e[2] == "accepted"], default=-1)
        latest = max(own, key=lambda e: e[1])
        out[k] = (len(own), latest[1], latest[2], sum(e[2] != "accepted" and e[1] > accepted for e in own))
    return out


def states(spark, path):
    rows = spark.read.parquet(path).where("kind = 'state'").groupBy("region_id").agg(F.max_by(F.struct("attempts", "event_no", "decision", "pending"), "version").alias("x"), F.count("*").alias("n"), F.max("version").alias("v")).collect()
    assert all(r["n"] == r["v"] for r in rows)  # each state was written once
    return {r["region_id"]: tuple(r["x"]) for r in rows}


def test_state_equals_the_batch_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    events = [(k, n, rng.choice(["accepted", "rejected", "rejected"])) for k in range(12) for n in range(rng.randrange(1, 9))] + [(None, 1, "accepted"), (1, None, "accepted"), (2, 99, None)]
    rng.shuffle(events)
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for part in range(3):
        for i in range(2):
            spark.createDataFrame(events[(2 * part + i) :: 6], EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/{part}-{i}"))
        q = keyed.run_decisions(spark, stream(), str(tmp_path / "out"), str(tmp_path / "state"))
        assert q.awaitTermination(120)
        seen = [e for j in range(2 * part + 2) for e in events[j::6]]
        assert states(spark, str(tmp_path / "out")) == plain(seen)
    q = keyed.run_decisions(spark, stream(), str(tmp_path / "out"), str(tmp_path / "state"))  # nothing new: nothing is written
    assert q.awaitTermination(120) and states(spark, str(tmp_path / "out")) == plain(events)


def test_what_is_rejected_is_due_again(spark, tmp_path):
    spark.createDataFrame([(1, 1, "rejected"), (2, 1, "rejected"), (2, 2, "accepted")], EVENT).write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in/*"))
    q = keyed.run_decisions(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"), backoff=200, processingTime="1 second")
    try:
        due, until = [], time.time() + 90
        while not due and time.time() < until:
            time.sleep(2)
            if (tmp_path / "out/_spark_metadata").exists():
                due = spark.read.schema(keyed.OUTPUT.format(key="long")).parquet(str(tmp_path / "out")).where("kind = 'retry'").collect()
    finally:
        q.stop()
    assert {(r["region_id"], r["attempts"], r["pending"]) for r in due} == {(1, 1, 1)}


@pytest.mark.parametrize("key", ["long", "string"])
def test_no_events(spark, tmp_path, key):
    spark.createDataFrame([], f"region_id {key}, event_no long, decision string").write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(f"region_id {key}, event_no long, decision string").parquet(str(tmp_path / "in/*"))
    assert keyed.run_decisions(spark, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
