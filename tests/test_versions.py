"""Versions kept by a stream: the judgement in order of arrival, whatever the batches that rows come in."""

import hashlib
import random

import pytest

from docloom.plans.pipeline import stream_accept
from docloom.streaming.versions import judged_rows, judged_stream

LOG = "object string, arrival string, version string, seq string, op string"


def _loop(log, state):
    out = set()
    for o, _, version, seq, op in sorted(log, key=lambda r: r[1]):
        top, seen = state.get(o, ("", False))
        reason = "delete_without_object" if op == "DELETE" and not seen else "stale" if seq <= top else "accepted"
        state[o] = (seq if reason == "accepted" else top, seen or op == "UPSERT")
        out.add((o, version, seq, op, reason))
    return out


@pytest.fixture
def small_frames(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 3)
    yield
    spark.conf.unset(key)


def test_hot_objects_are_judged_by_arrival_in_small_frames(spark, tmp_path, small_frames):
    rng = random.Random(3)
    events = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["error", "view", "click"])) for i in range(400)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    log = [(None if u is None else str(u), hashlib.md5(str(i).encode()).hexdigest(), str(i), f"{i:032X}", "DELETE" if t == "error" else "UPSERT") for i, u, t in events]
    rows = [tuple(r) for r in stream_accept(spark, str(tmp_path)).collect()]
    assert len(rows) == len(log)
    assert set(rows) == _loop(log, {})


def test_state_goes_from_batch_to_batch(spark, tmp_path, small_frames):
    rng = random.Random(4)
    want, state, n = set(), {}, 0
    for part in range(4):
        log = [(rng.choice(["a", "a", "a", "b", None]), f"{rng.random():.9f}", f"v{n + i}", f"{rng.randint(0, 90):04}", rng.choice(["DELETE", "UPSERT"])) for i in range(25)]
        log += [(f"c{part % 2}", "0", f"v{n + 25}", f"{9 - part:04}", "UPSERT" if part > 1 else "DELETE")]
        n += len(log)
        want |= _loop(log, state)
        spark.createDataFrame(log, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        source = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
        judged_stream(source, str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    rows = [tuple(r) for r in judged_rows(spark, str(tmp_path / "at")).collect()]
    assert len(rows) == n
    assert set(rows) == want
    assert judged_rows(spark, str(tmp_path / "nothing")).count() == 0
