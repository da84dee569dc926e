"""Streams over several triggers give what the batch forms give."""

from datetime import datetime, timedelta

from histora.operators import journal
from histora.streaming import jobs


def files(df, path, parts):
    for i, some in enumerate(parts):
        df.where(some).coalesce(1).write.mode("append").parquet(path)


def test_batches_across_triggers(spark, tmp_path):
    events = spark.createDataFrame(
        [("r", 1, "begin", "b1", "m", None, "1", None, 0), ("r", 2, "recover", "b1", "m", None, None, "1", 0), ("r", 3, "begin", "b2", "m", "1", "2", None, 0), ("q", 4, "claim", "b1", "m", None, None, None, 1), ("r", 5, "begin", "b3", "m", "1", None, None, 0)],
        "repo string, sequence long, kind string, batch_id string, bookmark string, expected string, proposed string, observed string, fence int",
    )
    source = str(tmp_path / "in")
    files(events, source, ["sequence < 2", "sequence = 2", "sequence > 2"])
    got = jobs.run_to_end(jobs.batches_stream(jobs.tail(spark, source, events.schema, 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, journal.replay_batches(events).collect()))


def test_dedup_and_timeouts(spark, tmp_path):
    at = datetime(2024, 1, 1)
    requests = spark.createDataFrame([("k", at), ("k", at + timedelta(days=1)), ("n", at)], "key string, at timestamp")
    files(requests, str(tmp_path / "a"), ["at < '2024-01-02'", "at >= '2024-01-02'"])
    kept = jobs.run_to_end(jobs.dedup_stream(jobs.tail(spark, str(tmp_path / "a"), requests.schema, 1), ["key"], "at"), str(tmp_path / "a-out"), str(tmp_path / "a-cp"))
    assert sorted(r.key for r in kept.collect()) == ["k", "n"]
    events = spark.createDataFrame([(1, "provisioning", at), (2, "provisioning", at), (2, "active", at + timedelta(hours=2)), (3, "active", at + timedelta(days=9)), (4, "active", at + timedelta(days=10))], "repository_id long, status string, at timestamp")
    files(events, str(tmp_path / "b"), ["repository_id = 1 OR repository_id = 2", "repository_id = 3", "repository_id = 4"])
    gone = jobs.run_to_end(jobs.provisional_timeouts(jobs.tail(spark, str(tmp_path / "b"), events.schema, 1)), str(tmp_path / "b-out"), str(tmp_path / "b-cp"))
    assert [(r.repository_id, r.expired_at) for r in gone.collect()] == [(1, at + timedelta(hours=24))]


def test_heads_across_triggers(spark, tmp_path):
    log = spark.createDataFrame([("r", 1, "a", []), ("r", 2, "b", ["a"]), ("r", 3, "c", []), ("s", 1, "x", []), ("r", 4, "d", ["b", "c"])], "repo string, cursor long, new_head string, observed array<string>")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    files(log, source, ["cursor < 3", "cursor = 3", "cursor > 3"])
    stream = jobs.heads_stream(jobs.tail(spark, source, log.schema, 1))
    stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/n={n}")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).orderBy("cursor").collect()
    assert {r.repo: r.heads for r in rows} == {"r": ["d"], "s": ["x"]}
    assert {(r.repo, r["head"]) for r in journal.head_set(log, ["repo"], "cursor").collect()} == {("r", "d"), ("s", "x")}
