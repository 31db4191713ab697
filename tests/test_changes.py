"""The change fold and the settling of repeated messages, against plain loops and at their edges."""

import datetime as dt
import itertools
import random

import pytest

from docloom.operators.changes import current_rows, fold_changes
from docloom.streaming.messages import repeated_deliveries

FEED = "op string, object_pk string, latest_version_id string, latest_sequencer string, is_deleted boolean, order string, gone int"
BASE = "object_pk string, latest_version_id string, latest_sequencer string, is_deleted boolean, updated_at timestamp"


def rows(df):
    return {r.object_pk: (r.latest_version_id, r.is_deleted) for r in df.collect()}


def test_order_and_repetition_do_not_matter(spark):
    feed = [("I", "a", "v1", "1", False, "x", 1), ("U", "a", "v2", " 0a", False, "x", 1), ("U", "a", "v3", "B", None, "x", 1), ("D", "b", "w2", "00ff", None, "x", 1), ("I", "b", "w1", "FE", False, "x", 1),
            ("U", "c", "k", None, False, "x", 1), ("U", "d", "k1", "", False, "x", 1), ("U", "d", "k2", "5", False, "x", 1)]
    base = spark.createDataFrame([("a", "v0", "0", False, None), ("e", "z", None, False, None)], BASE)
    want = {"a": ("v3", False), "b": ("w2", True), "c": ("k", False), "d": ("k2", False), "e": ("z", False)}
    for k in range(3):
        mixed = feed * 2
        random.Random(k).shuffle(mixed)
        assert rows(fold_changes(base, spark.createDataFrame(mixed, FEED))) == want


def test_removal_wins_at_the_deciding_sequencer_and_tombstones_hold(spark):
    first = fold_changes(spark.createDataFrame([("D", "a", None, "9", None, "", 0), ("U", "a", "v9", "09", False, "", 0)], FEED))
    assert rows(first) == {"a": (None, True)}
    late = spark.createDataFrame([("I", "a", "v1", "1", False, "", 0)], FEED)
    assert rows(current_rows(fold_changes(first, late))) == {}
    newer = spark.createDataFrame([("I", "a", "v10", "10", False, "", 0)], FEED)
    assert rows(current_rows(fold_changes(first, late, newer))) == {"a": ("v10", False)}


def test_folding_in_parts_equals_folding_at_once(spark):
    rng = random.Random(5)
    feed = [(rng.choice("IUD"), rng.choice("abc"), f"v{rng.randint(0, 5)}", rng.choice([None, "", f"{rng.randint(0, 30):x}", f"{rng.randint(0, 30):040X}"]), rng.choice([None, True, False]), "", 0) for _ in range(120)]
    at_once = rows(fold_changes(spark.createDataFrame(feed, FEED)))
    state = fold_changes(spark.createDataFrame(feed[:40], FEED))
    for k in (40, 80):
        state = fold_changes(state, spark.createDataFrame(feed[k : k + 40], FEED))
    got = rows(state)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in at_once.items()}
    assert {k: v for k, v in got.items() if not v[1]} == {k: v for k, v in at_once.items() if not v[1]}


def test_null_keys_nulls_and_empty_tables(spark):
    feed = spark.createDataFrame([(None,) * 7, ("U", "", "v", "1", False, None, None), ("U", "a", None, "2", None, None, None)], FEED)
    assert rows(fold_changes(feed)) == {"a": (None, False)}
    empty = spark.createDataFrame([], FEED)
    assert fold_changes(empty, spark.createDataFrame([], BASE)).count() == 0


JOBS = "delivery_id long, batch_no long, received_at timestamp, trace_id string, operation string, sequencer string, version_pk string, message string, repeats int"


def _job(i, day, trace="t", op="UPSERT", seq="1", pk="t#b#k%2Fx.md#v"):
    return (i, day, None if day is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=day), trace, op, seq, pk, "m", 3)


def _drop(jobs):
    best = {}
    def key(j):
        seq = (j[5] or "").strip().upper()
        trace = (j[3] or "").strip() or "s3://b/k/x.md?versionId=v"
        return (j[6], (j[4] or "").strip().upper(), seq.lstrip("0") or ("0" if seq else None), trace)
    for j in jobs:
        if j[0] is not None:
            best[key(j)] = min(best.get(key(j), (9e18, 9e18)), (j[2].timestamp() if j[2] else 8e18, j[0]))
    return sorted({j[0] for j in jobs if j[0] is not None and best[key(j)][1] != j[0]})


@pytest.mark.parametrize("files", [1, 3])
def test_messages_once_whatever_the_batches(spark, tmp_path, files):
    jobs = [_job(1, 0), _job(2, 1), _job(3, 90, seq="001"), _job(4, 0, trace="s3://b/k/x.md?versionId=v"), _job(5, 2, trace=" "), _job(6, 3, trace=None), _job(7, 0, op="delete"), _job(8, 200, op="DELETE "),
            _job(9, 150, seq=None), _job(10, 1, seq=" "), _job(11, None), _job(12, 0, seq="0"), _job(13, 0, seq="00"), _job(14, 400, trace="z"), _job(15, 399, trace="z"), _job(None, 0), _job(16, 0)]
    for part in range(files):
        spark.createDataFrame(jobs[part::files], JOBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "jobs.parquet"))
    got = sorted(r.delivery_id for r in repeated_deliveries(spark, str(tmp_path / "jobs.parquet"), files_per_batch=1, retention="30 days").collect())
    assert got == _drop(jobs)


def test_a_hot_message_and_an_empty_table(spark, tmp_path):
    jobs = [_job(i, i % 7) for i in range(3000)] + [_job(5000 + i, 1, trace=f"t{i}") for i in range(50)]
    spark.createDataFrame(jobs, JOBS).repartition(4).write.parquet(str(tmp_path / "hot"))
    assert sorted(r.delivery_id for r in repeated_deliveries(spark, str(tmp_path / "hot")).collect()) == _drop(jobs)
    spark.createDataFrame([], JOBS).write.parquet(str(tmp_path / "none"))
    assert repeated_deliveries(spark, str(tmp_path / "none")).count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    jobs = [_job(i, (i * 7) % 90, trace=f"t{i % 40}", seq=str(i % 3)) for i in range(300)]
    at = str(tmp_path / "jobs.parquet")
    go_on = {"ledger": str(tmp_path / "ledger"), "checkpoint": str(tmp_path / "checkpoint"), "retention": "20 days", "files_per_batch": 1}
    for part in range(3):
        spark.createDataFrame(jobs[part * 100 : part * 100 + 100], JOBS).coalesce(1).write.mode("append").parquet(at)
        got = sorted(r.delivery_id for r in repeated_deliveries(spark, at, **go_on).collect())
        assert got == _drop(jobs[: part * 100 + 100])
    held = spark.read.parquet(go_on["ledger"]).count()
    assert sorted(r.delivery_id for r in repeated_deliveries(spark, at, **go_on).collect()) == _drop(jobs)
    assert spark.read.parquet(go_on["ledger"]).count() == held


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from docloom import io

    class Cluster:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(spark.sparkContext.getConf)

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            io.shared_dir(Cluster)
