"""Streaming forms against their batch forms, over several micro-batches and restarts."""

from pyspark.sql import functions as F

from fleetbump.operators import status
from fleetbump.streaming import streams

SCHEMA = "repository_id string, iid string, state string, seen_at timestamp, ord bigint"


def _rows(spark, rows):
    return spark.createDataFrame(rows, "repository_id string, iid string, state string, at bigint, ord bigint").select(
        "repository_id", "iid", "state", F.timestamp_seconds("at").alias("seen_at"), "ord"
    )


def test_states_build_up_and_survive_restarts(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    batches = [
        [("1", "1", "opened", 10, 0), ("1", "2", "opened", 10, 1), ("2", "1", "merged", 10, 2)],
        [("1", "1", "merged", 20, 3), ("1", "1", "closed", 15, 4)],
        [("1", "2", "opened", 30, 5), ("3", "1", None, 5, 6)],
        [("1", "1", "opened", 12, 7), ("2", "1", "closed", 40, 8)],
    ]
    seen = []
    for n, rows in enumerate(batches):
        seen += rows
        _rows(spark, rows).coalesce(1).write.mode("append").parquet(source)
        updates = spark.readStream.schema(SCHEMA).parquet(source)
        # A new query each time: the folder and the progress log are all that is kept.
        query = streams.track_states(spark, updates, folder, str(tmp_path / "progress"), compact_every=3)
        query.awaitTermination()
        now = streams.current_states(spark, folder, n, compact_every=3).select("repository_id", "iid", "state")
        want = status.latest_snapshots(_rows(spark, seen)).select("repository_id", "iid", "state")
        assert sorted(map(tuple, now.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    changes = streams.transitions(spark, folder).orderBy("batch", "repository_id", "iid").collect()
    assert [tuple(r) for r in changes] == [
        (0, "1", "1", "unknown", "opened"),
        (0, "1", "2", "unknown", "opened"),
        (0, "2", "1", "unknown", "merged"),
        (1, "1", "1", "opened", "merged"),
        (3, "2", "1", "merged", "closed"),
    ]
    # Running a batch again gives the same table.
    before = sorted(map(str, spark.read.parquet(f"{folder}/batch=1").collect()))
    streams.advance(spark, _rows(spark, batches[1]), folder, 1, compact_every=3)
    assert sorted(map(str, spark.read.parquet(f"{folder}/batch=1").collect())) == before


def test_late_rows_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    for n, seconds in enumerate([[0, 10, 70], [1000], [20, 30], [2000]]):
        df = spark.createDataFrame([(s,) for s in seconds], "s bigint").select(F.lit("k").alias("key"), F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = streams.request_rates(spark.readStream.schema("key string, ts timestamp").parquet(source))
        out = str(tmp_path / "out")
        query = (
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "p"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    rows = spark.read.parquet(out).select(F.unix_seconds("window_start").alias("w"), "requests").collect()
    assert sorted(map(tuple, rows)) == [(0, 2), (60, 1), (960, 1)]
