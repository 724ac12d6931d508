"""Streaming forms, run to the end of the available files and read back from their sinks."""

from pyspark.sql import functions as F

from fleetbump.queries import standins as s
from fleetbump.queries.registry import query
from fleetbump.session import staged_path
from fleetbump.streaming import streams


def _run(spark, stream, name):
    """Append a stream to a new folder until its input is used up, then read the folder."""
    out = staged_path(spark, name)
    started = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", out + "-progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# A window is final once the watermark, two minutes behind the newest row, has passed its end.
_CLOSED = "(SELECT max(us) FROM request_log) - 120000000"


def _requests(spark, sf):
    return s.request_rows(s.table_stream(spark, sf, "events"))


@query(
    "streamed_request_rates",
    f"""SELECT key, start_us, count(*) AS requests FROM (
          SELECT key, us // 60000000 * 60000000 - 10000000 * i + (us % 60000000 // 10000000) * 10000000 AS start_us
          FROM request_log, range(6) AS r(i)) WHERE start_us + 60000000 <= {_CLOSED} GROUP BY ALL""",
)
def streamed_request_rates(spark, sf):
    rates = _run(spark, streams.request_rates(_requests(spark, sf), "10 seconds"), "rates")
    return rates.select("key", F.unix_micros("window_start").alias("start_us"), "requests")


@query(
    "streamed_tumbling_rates",
    f"""SELECT key, us // 60000000 * 60000000 AS start_us, count(*) AS requests FROM request_log
        WHERE us // 60000000 * 60000000 + 60000000 <= {_CLOSED} GROUP BY ALL""",
)
def streamed_tumbling_rates(spark, sf):
    rates = _run(spark, streams.request_rates(_requests(spark, sf)), "rates")
    return rates.select("key", F.unix_micros("window_start").alias("start_us"), "requests")


@query(
    "streamed_burst_sessions",
    f"""SELECT key, min(us) AS first_us, max(us) AS last_us, count(*) AS requests FROM (
          SELECT *, sum(CASE WHEN us - previous < 1000000 THEN 0 ELSE 1 END)
                    OVER (PARTITION BY key ORDER BY us, request_id ROWS UNBOUNDED PRECEDING) AS run
          FROM (SELECT *, lag(us) OVER (PARTITION BY key ORDER BY us, request_id) AS previous FROM request_log))
        GROUP BY key, run HAVING max(us) + 1000000 <= {_CLOSED}""",
)
def streamed_burst_sessions(spark, sf):
    sessions = _run(spark, streams.burst_sessions(_requests(spark, sf)), "sessions")
    return sessions.select(
        "key", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "requests"
    )


@query(
    "streamed_distinct_hits",
    "SELECT DISTINCT CAST(user_id AS VARCHAR) AS repo_id, 'src/' || event_type || '.cs' AS path FROM events",
)
def streamed_distinct_hits(spark, sf):
    hits = s.table_stream(spark, sf, "events").select(
        s.text("user_id").alias("repo_id"),
        F.concat(F.lit("src/"), "event_type", F.lit(".cs")).alias("path"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return _run(spark, streams.distinct_hits(hits), "hits").select("repo_id", "path")


@query("streamed_request_states", "SELECT repository_id, iid, nullif(state, '') AS state FROM latest")
def streamed_request_states(spark, sf):
    folder = staged_path(spark, "states")
    # Snapshot rows lie in many files, so the states are built up over several micro-batches.
    source = staged_path(spark, "snapshots")
    s.snapshots(spark, sf).repartition(6).write.parquet(source)
    updates = (
        spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", "2").parquet(source)
    )
    progress = streams.track_states(spark, updates, folder, folder + "-progress", compact_every=2)
    progress.awaitTermination()
    last = streams.last_batch(progress)
    return streams.current_states(spark, folder, last, compact_every=2).select("repository_id", "iid", "state")


# ---- several arrivals, some of them late -----------------------------------------------------------

# Time is cut into SLICES; a slice's rows arrive together, but one row in eleven an arrival later and one in seventeen two.
SLICES, ARRIVALS = 4, 6


def _arrival(at, id_, low, high):
    late = F.when(id_ % 17 == 0, 2).when(id_ % 11 == 0, 1).otherwise(0)
    return (F.floor((at - F.lit(low)) * SLICES / F.lit(high - low + 1)) + late).cast("int")


def _arrival_sql(at: str, id_: str, rows: str) -> str:
    late = f"CASE WHEN {id_} % 17 = 0 THEN 2 WHEN {id_} % 11 = 0 THEN 1 ELSE 0 END"
    return f"""SELECT r.*, low, high, CAST(({at} - low) * {SLICES} // (high - low + 1) + {late} AS INTEGER) AS arrival
               FROM {rows} r JOIN (SELECT min({at}) AS low, max({at}) AS high FROM {rows}) b ON true"""


def _arriving(rows, at, id_):
    ends = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    return rows.withColumn("arrival", _arrival(at, id_, ends["low"] or 0, ends["high"] or 0))


def _arrive(spark, rows, name, start):
    """Land ``rows`` arrival by arrival; after each, ``start(stream)`` takes up where it stopped and runs to the end."""
    source = staged_path(spark, name)
    for n in range(ARRIVALS):
        rows.filter(F.col("arrival") == n).drop("arrival").write.mode("append").parquet(source)
        start(spark.readStream.schema(rows.drop("arrival").schema).parquet(source)).awaitTermination()


def _appended(spark, rows, name, job):
    """All that ``job`` of the arriving rows appends to a folder, from one arrival to the next."""
    out = staged_path(spark, name)

    def start(stream):
        writer = job(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-progress")
        return writer.outputMode("append").trigger(availableNow=True).start()

    _arrive(spark, rows, name + "-landed", start)
    return spark.read.parquet(out)


def _late_requests(spark, sf):
    return _arriving(s.request_log(spark, sf), F.unix_micros("ts"), F.col("request_id")).select("key", "ts", "arrival")


s.SQL["arrived_requests"] = _arrival_sql("us", "request_id", "request_log")
# The watermark before each arrival: two minutes behind the newest of all earlier rows, in whole milliseconds.
s.SQL["watermarks"] = """
SELECT arrival, 1000 * (max(max(us)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - 120000) AS closed
FROM arrived_requests GROUP BY arrival"""
_END = "(SELECT 1000 * (max(us) // 1000 - 120000) FROM request_log)"


def _late_rates_sql(starts: str) -> str:
    """Rows of windows that were closed when they arrived are dropped; windows closed at the end are answered."""
    return f"""SELECT key, start_us, count(*) AS requests
               FROM (SELECT key, {starts} AS start_us, arrival FROM arrived_requests{", range(6) AS r(i)" if "i" in starts else ""})
               JOIN watermarks USING (arrival)
               WHERE (closed IS NULL OR start_us + 60000000 > closed) AND start_us + 60000000 <= {_END} GROUP BY ALL"""


def _rates(spark, sf, slide):
    rates = _appended(spark, _late_requests(spark, sf), "late-rates", lambda r: streams.request_rates(r, slide))
    return rates.select("key", F.unix_micros("window_start").alias("start_us"), "requests")


@query("late_tumbling_rates", _late_rates_sql("us // 60000000 * 60000000"))
def late_tumbling_rates(spark, sf):
    return _rates(spark, sf, None)


@query("late_sliding_rates", _late_rates_sql("us // 10000000 * 10000000 - 10000000 * i"))
def late_sliding_rates(spark, sf):
    return _rates(spark, sf, "10 seconds")


def _late_sessions_sql() -> str:
    """Arrival by arrival: sessions still open and new rows that are not late are merged where less than a second apart."""
    steps, told, open_ones = [], [], "SELECT key, us AS low, us AS high, 1 AS n FROM arrived_requests WHERE false"
    for n in range(ARRIVALS):
        before, after = (
            f"(SELECT 1000 * (max(us) // 1000 - 120000) FROM arrived_requests WHERE arrival < {m})" for m in (n, n + 1)
        )
        both = f"{open_ones} UNION ALL SELECT key, us, us, 1 FROM arrived_requests WHERE arrival = {n} AND us + 1000000 > coalesce({before}, 0)"
        apart = "CASE WHEN low - max(high) OVER (PARTITION BY key ORDER BY low, high, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1000000"
        steps.append(f"""merged{n} AS (SELECT key, min(low) AS low, max(high) AS high, sum(n) AS n, max(high) + 1000000 <= {after} AS closed FROM (
            SELECT *, sum(apart) OVER (PARTITION BY key ORDER BY low, high, n, apart ROWS UNBOUNDED PRECEDING) AS run
            FROM (SELECT *, {apart} THEN 0 ELSE 1 END AS apart FROM ({both}))) GROUP BY key, run)""")
        told.append(f"SELECT key, low AS first_us, high AS last_us, CAST(n AS BIGINT) AS requests FROM merged{n} WHERE closed")
        open_ones = f"SELECT key, low, high, n FROM merged{n} WHERE NOT closed"
    return f"SELECT * FROM (WITH {', '.join(steps)} {' UNION ALL '.join(told)})"


@query("late_burst_sessions", _late_sessions_sql())
def late_burst_sessions(spark, sf):
    sessions = _appended(spark, _late_requests(spark, sf), "late-sessions", streams.burst_sessions)
    return sessions.select(
        "key", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "requests"
    )


# Hits are stamped with their slice, HIT_MINUTES apart, and name a file of one of a few folders. A hit is told again once
# the watermark, ten minutes behind, has passed ten minutes after it was last told.
HIT_MINUTES = 15


def _told_sql() -> str:
    """One column an arrival: the slice a key was last told in, and whether it is told now."""
    step = "SELECT repo_id, path, " + ", ".join(
        f"max(CASE WHEN arrival = {n} THEN slice END) AS at{n}" for n in range(ARRIVALS)
    )
    step += " FROM arrived_hits WHERE watched IS NULL OR slice * 15 > watched - 10 GROUP BY ALL"
    last = "CAST(NULL AS BIGINT)"
    told = []
    for n in range(ARRIVALS):
        newest = min(n - 1, SLICES - 1)
        step = f"SELECT *, at{n} IS NOT NULL AND ({last} IS NULL OR {newest} * 15 - 10 >= {last} * 15 + 10) AS told{n} FROM ({step})"
        step = f"SELECT *, CASE WHEN told{n} THEN at{n} ELSE {last} END AS last{n} FROM ({step})"
        last = f"last{n}"
        told.append(f"told{n}::INT")
    return f"SELECT repo_id, path, CAST({' + '.join(told)} AS BIGINT) AS times FROM ({step})"


s.SQL["arrived_events"] = _arrival_sql("epoch_us(ts)", "event_id", "events")
# Rows that come late name files of their own, so a file has one stamp in each arrival.
s.SQL["arrived_hits"] = f"""
SELECT user_id % 40 || CASE WHEN arrival > slice THEN '/late' ELSE '' END AS repo_id, 'src/' || event_type || '.cs' AS path, arrival, slice,
       CASE WHEN arrival > 0 THEN least(arrival - 1, {SLICES - 1}) * 15 END AS watched
FROM (SELECT *, CAST((epoch_us(ts) - low) * {SLICES} // (high - low + 1) AS BIGINT) AS slice
      FROM arrived_events)"""


@query(
    "late_distinct_hits",
    f"SELECT repo_id, path, times FROM ({_told_sql()}) WHERE times > 0",
)
def late_distinct_hits(spark, sf):
    events = s.table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    arriving = _arriving(events, F.col("us"), F.col("event_id"))
    late = F.when(F.col("event_id") % 17 == 0, 2).when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    stamped = arriving.withColumn("slice", F.col("arrival") - late).select(
        F.concat((F.col("user_id") % 40).cast("string"), F.when(late > 0, F.lit("/late")).otherwise(F.lit(""))).alias("repo_id"),
        F.concat(F.lit("src/"), "event_type", F.lit(".cs")).alias("path"),
        F.timestamp_seconds(F.col("slice") * 60 * HIT_MINUTES + 86_400).alias("ts"),
        "arrival",
    )
    told = _appended(spark, stamped, "late-hits", streams.distinct_hits)
    return told.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("times"))


# Five requests a repository, so each has many snapshots.
s.SQL["arrived_snapshots"] = _arrival_sql(
    "us", "ord", "(SELECT repository_id, ord % 5 AS iid, coalesce(state, 'unknown') AS state, epoch_us(seen_at) AS us, ord FROM snapshots)"
)
s.SQL["state_changes"] = """
SELECT *, coalesce(lag(new_status) OVER (PARTITION BY repository_id, iid ORDER BY arrival), 'unknown') AS old_status FROM (
  SELECT repository_id, iid, arrival,
         arg_max(state, seen) OVER (PARTITION BY repository_id, iid ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS new_status FROM (
    SELECT repository_id, CAST(iid AS VARCHAR) AS iid, arrival, arg_max(state, us::HUGEINT * 1000000000 + ord) AS state,
           max(us::HUGEINT * 1000000000 + ord) AS seen FROM arrived_snapshots GROUP BY ALL))"""


def _tracked(spark, sf):
    """Folder of the state table after all arrivals."""
    folder = staged_path(spark, "transitions")
    rows = s.snapshots(spark, sf).withColumn("iid", (F.col("ord") % 5).cast("string"))
    arriving = _arriving(rows, F.unix_micros("seen_at"), F.col("ord"))
    _arrive(
        spark,
        arriving,
        "transitions-landed",
        lambda stream: streams.track_states(spark, stream, folder, folder + "-progress", compact_every=3),
    )
    return folder


@query(
    "streamed_transitions",
    """SELECT arrival AS batch, repository_id, iid, old_status, new_status FROM state_changes WHERE old_status <> new_status""",
)
def streamed_transitions(spark, sf):
    return streams.transitions(spark, _tracked(spark, sf))


@query(
    "streamed_transition_counters",
    """SELECT batch, requests, updated, errors, CAST(sum(opened) OVER w AS BIGINT) AS opened,
              CAST(sum(merged) OVER w AS BIGINT) AS merged, CAST(sum(closed) OVER w AS BIGINT) AS closed
       FROM (SELECT arrival AS batch, count(*) AS requests, count_if(old_status <> new_status) AS updated,
                    count_if(new_status = 'unknown') AS errors,
                    count_if(new_status = 'opened') - count_if(old_status = 'opened') AS opened,
                    count_if(new_status = 'merged') - count_if(old_status = 'merged') AS merged,
                    count_if(new_status = 'closed') - count_if(old_status = 'closed') AS closed
             FROM state_changes GROUP BY arrival)
       WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)""",
)
def streamed_transition_counters(spark, sf):
    return streams.transition_counters(spark, _tracked(spark, sf))
