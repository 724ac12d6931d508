"""Request-log audit, batch and streaming."""

from fleetbump.operators import audit
from fleetbump.queries import standins as s
from fleetbump.queries.registry import query


@query(
    "request_rates",
    """SELECT request_id, n AS trailing_requests, n >= 9 AS throttled, CASE WHEN n >= 9 THEN 60000000 - (us - oldest) END AS wait_us,
              us - previous AS gap_us, coalesce(us - previous < 6000000, false) AS below_min_gap
       FROM (SELECT *, CAST(seen - expired AS BIGINT) AS n FROM (
         SELECT request_id, us, row_number() OVER (PARTITION BY key ORDER BY us, request_id) - 1 AS seen,
                count(*) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 60000000 PRECEDING) AS expired,
                min(us) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS oldest,
                lag(us) OVER (PARTITION BY key ORDER BY us, request_id) AS previous FROM request_log))""",
)
def request_rates(spark, sf):
    # Ten a minute, in two-minute buckets: the log crosses many bucket borders.
    rates = audit.request_rates(s.request_log(spark, sf), per_minute=10, bucket_seconds=120)
    return rates.drop("key", "ts")


@query(
    "burst_runs",
    """SELECT key, CAST(run AS BIGINT) AS run, count(*) AS requests, min(us) AS first_us, max(us) AS last_us,
              (count(*) - 1) // 3 AS bursts
       FROM (SELECT *, sum(CASE WHEN us - previous < 1000000 THEN 0 ELSE 1 END)
                       OVER (PARTITION BY key ORDER BY us, request_id ROWS UNBOUNDED PRECEDING) AS run
             FROM (SELECT *, lag(us) OVER (PARTITION BY key ORDER BY us, request_id) AS previous FROM request_log))
       GROUP BY key, run""",
)
def burst_runs(spark, sf):
    return audit.burst_runs(s.request_log(spark, sf), burst_limit=3, bucket_seconds=60)


@query(
    "retry_delays",
    """SELECT request_id, outcome,
              CASE outcome WHEN 'rate_limited' THEN least(coalesce(hint, 2.0 ** attempt), 300.0)
                           WHEN 'retryable' THEN least(2.0 ** attempt, 300.0) END AS delay_seconds
       FROM (SELECT *, CAST(nullif(TRY_CAST(retry_after AS INTEGER), 0) AS DOUBLE) AS hint,
                    CASE WHEN status_code = 429 THEN 'rate_limited' WHEN status_code BETWEEN 500 AND 599 THEN 'retryable'
                         WHEN status_code >= 400 THEN 'not_retryable' ELSE 'ok' END AS outcome FROM request_log)""",
)
def retry_delays(spark, sf):
    return audit.retry_log(s.request_log(spark, sf)).select("request_id", "outcome", "delay_seconds")
