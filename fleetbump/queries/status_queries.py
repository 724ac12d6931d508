"""Merge-request tracking, its reports and dashboard."""

from pyspark.sql import functions as F

from fleetbump.functions.patterns import parse_instant, status_bucket
from fleetbump.operators import reports, status
from fleetbump.queries import standins as s
from fleetbump.queries.registry import query
from fleetbump.session import staged_path

s.SQL["refreshed"] = """
SELECT t.*, t.status AS before, nullif(l.state, '') AS seen,
       CASE WHEN t.merge_request_iid IS NULL THEN 'insufficient' WHEN nullif(l.state, '') IS NULL THEN 'error'
            WHEN coalesce(t.status, 'unknown') <> l.state THEN 'updated' ELSE 'unchanged' END AS refresh_outcome
FROM tracked t LEFT JOIN latest l ON l.repository_id = t.repository_id AND l.iid = t.merge_request_iid"""
s.SQL["now"] = """
SELECT * REPLACE (CASE WHEN refresh_outcome IN ('updated', 'unchanged') THEN seen ELSE status END AS status) FROM refreshed"""


def refreshed(spark, sf):
    latest = status.latest_snapshots(s.snapshots(spark, sf))
    return status.refresh(s.tracked(spark, sf), latest, F.lit("2024-02-01T00:00:00"))


@query("latest_snapshots", "SELECT repository_id, iid, nullif(state, '') AS state FROM latest")
def latest_snapshots(spark, sf):
    return status.latest_snapshots(s.snapshots(spark, sf))


@query(
    "refreshed_statuses",
    """SELECT merge_request_url, status, coalesce(before, 'unknown') AS old_status, refresh_outcome,
              CASE WHEN refresh_outcome IN ('updated', 'unchanged') THEN '2024-02-01T00:00:00' END AS last_checked FROM now""",
)
def refreshed_statuses(spark, sf):
    return refreshed(spark, sf).select("merge_request_url", "status", "old_status", "refresh_outcome", "last_checked")


@query(
    "refresh_counters",
    """SELECT count_if(refresh_outcome = 'updated') AS updated, count_if(refresh_outcome = 'error') AS errors,
              count_if(refresh_outcome = 'insufficient') AS insufficient FROM refreshed""",
)
def refresh_counters(spark, sf):
    return status.refresh_counters(refreshed(spark, sf))


@query(
    "status_counters",
    """SELECT count(*) AS total, count_if(status = 'opened') AS opened, count_if(status = 'merged') AS merged,
              count_if(status = 'closed') AS closed FROM now""",
)
def status_counters(spark, sf):
    return status.status_counters(refreshed(spark, sf))


@query(
    "requests_with_status",
    "SELECT merge_request_url, status FROM tracked WHERE lower(coalesce(status, '')) = 'merged'",
)
def requests_with_status(spark, sf):
    return status.with_status(s.tracked(spark, sf), "MERGED").select("merge_request_url", "status")


@query(
    "refreshable_requests",
    "SELECT merge_request_url, merge_request_iid IS NOT NULL AS can_refresh FROM tracked",
)
def refreshable_requests(spark, sf):
    rows = s.tracked(spark, sf)
    return rows.select("merge_request_url", status.can_refresh(rows).alias("can_refresh"))


@query(
    "ordered_requests",
    """SELECT merge_request_url, status FROM tracked ORDER BY coalesce(merge_request_url, ''), coalesce(status, '')""",
)
def ordered_requests(spark, sf):
    return status.canonical_order(s.tracked(spark, sf)).select("merge_request_url", "status")


s.SQL["bucketed"] = """
SELECT *, CASE WHEN status IN ('merged', 'opened', 'closed') THEN status ELSE 'unknown' END AS bucket FROM now"""


@query("status_buckets", "SELECT bucket, count(*) AS n, max(merge_request_url) AS last_url FROM bucketed GROUP BY bucket")
def status_buckets(spark, sf):
    rows = refreshed(spark, sf).withColumn("bucket", status_bucket(F.col("status")))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("merge_request_url").alias("last_url"))


@query(
    "dashboard_cards",
    """SELECT unnest(['Total MRs', 'Open', 'Merged', 'Closed', 'Errors']) AS label,
              unnest([count(*), count_if(status = 'opened'), count_if(status = 'merged'), count_if(status = 'closed'), 3]) AS value
       FROM now""",
)
def dashboard_cards(spark, sf):
    return status.dashboard_cards(refreshed(spark, sf), errors=3).select("label", "value")


@query(
    "dashboard_items",
    """SELECT bucket, repository_name, merge_request_url AS url,
              coalesce(package_name, 'Unknown') || ' → ' || coalesce(new_version, 'Unknown') AS package, target_branch,
              source_branch, existed AS pre_existing, coalesce(status, '') AS status FROM bucketed""",
)
def dashboard_items(spark, sf):
    return status.dashboard_items(refreshed(spark, sf))


@query(
    "status_report_lines",
    """SELECT CAST(section AS BIGINT) AS section, key, seq, line FROM (
       SELECT CASE bucket WHEN 'merged' THEN 2 WHEN 'opened' THEN 4 WHEN 'closed' THEN 6 ELSE 8 END AS section,
              merge_request_url AS key, coalesce(status, '') AS seq,
              '- **' || repository_name || '** (' || coalesce(package_name, 'Unknown') || ' → ' || coalesce(new_version, 'Unknown')
              || '): [' || merge_request_url || '](' || merge_request_url || ')' || chr(10) ||
              CASE WHEN bucket = 'unknown' THEN '  - Status: ' || coalesce(status, 'Unknown') || chr(10)
                   WHEN existed THEN '  - *(Pre-existing MR)*' || chr(10) ELSE '' END AS line
       FROM bucketed
       UNION ALL SELECT CASE bucket WHEN 'merged' THEN 1 WHEN 'opened' THEN 3 WHEN 'closed' THEN 5 ELSE 7 END, '', '',
              '### ' || CASE bucket WHEN 'merged' THEN 'Merged' WHEN 'opened' THEN 'Open' WHEN 'closed' THEN 'Closed'
                        ELSE 'Unknown Status' END || ' (' || count(*) || ')' || chr(10) FROM bucketed GROUP BY bucket
       UNION ALL SELECT 0, '', '', unnest(['', '# Merge Request Status Report', 'Generated: 2024-02-01 00:00:00', '', '## Summary',
              '- **Package**: click', '- **Version**: Various versions', '- **Total Merge Requests**: ' || count(*),
              '- **Opened**: ' || count_if(status = 'opened'), '- **Merged**: ' || count_if(status = 'merged'),
              '- **Closed**: ' || count_if(status = 'closed'), '- **Errors**: 0', '- **Updated This Run**: 0', '',
              '## Merge Request Details', '']) FROM now)""",
)
def status_report_lines(spark, sf):
    meta = s.table(spark, sf, "events").agg(F.min("event_type").alias("package_name"), F.lit(None).cast("string").alias("new_version"))
    lines = reports.status_report(refreshed(spark, sf), meta, "2024-02-01 00:00:00")
    return lines.select(F.col("section").cast("bigint").alias("section"), "key", "seq", "line")


@query(
    "readable_commit_dates",
    """SELECT ord, strftime(committed_at, '%Y-%m-%d %H:%M:%S') AS committed_at FROM branches""",
)
def readable_commit_dates(spark, sf):
    return s.branches(spark, sf).select(
        "ord", F.date_format(parse_instant(F.col("committed_date")), "yyyy-MM-dd HH:mm:ss").alias("committed_at")
    )


# ---- update report -------------------------------------------------------------------------------


def report_entries(spark, sf):
    """One entry per part; two of three carry migration information."""
    key = F.col("p_partkey")
    change = F.struct(
        F.col("p_type").alias("file"),
        F.lit("content_change").alias("type"),
        F.when(key % 2 == 0, F.lit("would change")).alias("description"),
        F.when(key % 4 == 0, F.lit(12)).alias("line"),
        F.when(key % 4 == 0, F.lit("Rename")).alias("rule"),
        F.when(key % 4 == 1, F.col("p_name")).alias("original"),
        F.when(key % 4 == 1, F.col("p_brand")).alias("replacement"),
    )
    migration = F.struct(
        F.array(F.concat(F.lit("a"), s.text("p_partkey")), F.lit("b.cs")).alias("would_modify_files"),
        F.array(change).alias("potential_changes"),
        F.array(F.lit("Rename"), F.lit("Remove")).alias("applicable_rules"),
        F.when(key % 5 == 0, F.array(F.lit("unreadable"))).otherwise(F.array().cast("array<string>")).alias("analysis_errors"),
        F.when(key % 2 == 1, F.lit("done")).alias("summary"),
    )
    return s.table(spark, sf, "part").select(
        key.alias("ord"),
        F.col("p_name").alias("repo_name"),
        F.col("p_brand").alias("package_name"),
        F.concat(s.text("p_size"), F.lit(".0")).alias("new_version"),
        F.when(key % 2 == 0, F.lit("Would Create MR")).otherwise(F.lit("No Changes")).alias("status"),
        F.when(key % 3 != 0, F.lit("details")).alias("details"),
        F.when(key % 2 == 0, F.lit("0.9, 1.0")).alias("old_version"),
        F.when(key % 3 == 0, F.lit("main")).alias("target_branch"),
        F.when(key % 3 != 1, migration).alias("migration"),
    )


@query(
    "report_summary",
    """SELECT count(DISTINCT p_name) AS repositories, count(*) AS entries,
              count(DISTINCT CASE WHEN p_partkey % 3 <> 1 THEN p_name END) AS with_migrations,
              CAST(sum(CASE WHEN p_partkey % 3 <> 1 THEN 2 ELSE 0 END) AS BIGINT) AS files FROM part""",
)
def report_summary(spark, sf):
    return reports.report_summary(report_entries(spark, sf))


_BLOCK = """list_filter([
  '## Repository: ' || p_name, CASE WHEN k % 3 = 0 THEN '- **Target Branch**: main' END, '- **Package**: ' || p_brand,
  '  - **Version**: ' || CASE WHEN k % 2 = 0 THEN '0.9, 1.0 → ' ELSE '' END || p_size || '.0',
  '  - **Status**: ' || CASE WHEN k % 2 = 0 THEN 'Would Create MR' ELSE 'No Changes' END,
  '  - **Details**: ' || CASE WHEN k % 3 <> 0 THEN 'details' ELSE 'N/A' END,
  CASE WHEN k % 3 <> 1 THEN concat_ws(chr(10), '  - **Migration Analysis**:', '    - **Files that would be modified** (2):',
    '      - `a' || k || '`', '      - `b.cs`', '    - **Applicable migration rules** (2):', '      - Rename', '      - Remove',
    '    - **Code Changes Preview** (1 changes):',
    '      **Change 1: ' || CASE WHEN k % 4 = 0 THEN 'Rename' ELSE 'Unknown rule' END || '**',
    '      - **File**: `' || p_type || '` (line ' || CASE WHEN k % 4 = 0 THEN '12' ELSE 'Unknown line' END || ')' || chr(10) ||
    CASE WHEN k % 4 = 1 THEN '      - **Before**:' || chr(10) || '        ```csharp' || chr(10) || '        ' || p_name || chr(10) ||
      '        ```' || chr(10) || '      - **After**:' || chr(10) || '        ```csharp' || chr(10) || '        ' || p_brand ||
      chr(10) || '        ```' || chr(10)
      WHEN k % 2 = 0 THEN '      - **Description**: would change' || chr(10) ELSE '' END,
    CASE WHEN k % 5 = 0 THEN '    - **Analysis errors** (1):' || chr(10) || '      - unreadable' END,
    CASE WHEN k % 2 = 1 THEN '    - **Summary**: done' END) END, ''], lambda x: x IS NOT NULL)"""


@query(
    "update_report_entries",
    f"SELECT k AS seq, array_to_string({_BLOCK}, chr(10)) AS entry FROM (SELECT *, p_partkey AS k FROM part)",
)
def update_report_entries(spark, sf):
    lines = reports.entry_lines(report_entries(spark, sf))
    # An entry is a bounded block of lines made from one row, so it can be put together again.
    block = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("seq").agg(F.array_join(F.transform(block, lambda b: b["line"]), "\n").alias("entry"))


@query(
    "version_changes_shown",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '0.9, 1.0 → ' ELSE '' END || p_size || '.0' AS shown FROM part",
)
def version_changes_shown(spark, sf):
    return report_entries(spark, sf).select(
        F.col("ord").alias("p_partkey"), reports.version_line(F.col("old_version"), F.col("new_version")).alias("shown")
    )


@query(
    "numbered_changes",
    """SELECT repo_id, package, path AS file, line, CAST(row_number() OVER (PARTITION BY repo_id, package ORDER BY path, line)
              AS BIGINT) AS change_no
       FROM (SELECT r.*, unnest([4, 9]) AS line FROM changed_files r)""",
)
def numbered_changes(spark, sf):
    from fleetbump.plans import upgrade

    decided = upgrade.file_decisions(s.project_files(spark, sf), s.TARGETS)
    rows = decided.filter(F.col("decision").isin("update", "update_unparsed")).select(
        "repo_id", "package", F.col("path").alias("file"), F.explode(F.array(F.lit(4), F.lit(9))).alias("line"), F.lit("r").alias("rule")
    )
    return reports.numbered_changes(rows).select("repo_id", "package", "file", "line", "change_no")


s.SQL["failed_actions"] = "SELECT * FROM action_log WHERE txn_id NOT IN (SELECT txn_id FROM succeeded_txns)"
s.SQL["failed_txns"] = "SELECT DISTINCT txn_id FROM failed_actions"


def _rollback(spark, sf):
    from fleetbump.operators import publish

    actions = s.action_log(spark, sf)
    open_ones = actions.join(s.succeeded_txns(spark, sf), "txn_id", "left_anti")
    # The section reads the failed ones several times: they are found once and written.
    path = staged_path(spark, "failed")
    open_ones.select(F.col("txn_id").alias("repo_id")).distinct().write.parquet(path)
    failed = spark.read.schema("repo_id string").parquet(path).withColumn("error", F.lit("no luck"))
    undo = publish.undo_report_lines(actions).withColumnRenamed("txn_id", "repo_id")
    return reports.rollback_section(failed, undo)


@query(
    "rollback_section_lines",
    """SELECT key, CAST(seq AS BIGINT) AS seq, line FROM (
         SELECT txn_id AS key, CAST(0 AS BIGINT) AS seq, '### Repository: ' || txn_id || chr(10) || chr(10) || '**Error:** no luck' || chr(10) ||
                chr(10) || '**Rollback Details:**' || chr(10) || '```' AS line FROM failed_txns
         UNION ALL SELECT txn_id, 100, '```' || chr(10) FROM failed_txns
         UNION ALL SELECT txn_id, 1, '=== ROLLBACK REPORT ===' FROM failed_txns
         UNION ALL SELECT txn_id, 2, CASE WHEN bool_and(error IS NULL) THEN 'Rollback completed successfully'
                   ELSE 'Rollback completed with errors' END FROM failed_actions GROUP BY txn_id
         UNION ALL SELECT txn_id, 3, chr(10) || 'Completed Actions:' FROM failed_actions WHERE error IS NULL GROUP BY txn_id
         UNION ALL SELECT txn_id, 5, chr(10) || 'Failed Actions:' FROM failed_actions WHERE error IS NOT NULL GROUP BY txn_id
         UNION ALL SELECT txn_id, 4, '  • ' || description FROM failed_actions WHERE error IS NULL
         UNION ALL SELECT txn_id, 6, '  • ' || description || ': ' || error FROM failed_actions WHERE error IS NOT NULL)""",
)
def rollback_section_lines(spark, sf):
    return _rollback(spark, sf).filter(F.col("section") == 3).select("key", "seq", "line")


@query(
    "rollback_section_whole",
    """SELECT key, CAST(seq AS BIGINT) AS seq, line, CASE WHEN key = '' THEN 2 ELSE 3 END AS section FROM (
         SELECT '' AS key, -1 AS seq, chr(10) || chr(10) || '## Rollback Information' || chr(10) || chr(10) ||
                'The following repositories required rollback due to failures:' || chr(10) AS line WHERE (SELECT count(*) FROM failed_txns) > 0
         UNION ALL
         SELECT txn_id AS key, CAST(0 AS BIGINT) AS seq, '### Repository: ' || txn_id || chr(10) || chr(10) || '**Error:** no luck' || chr(10) ||
                chr(10) || '**Rollback Details:**' || chr(10) || '```' AS line FROM failed_txns
         UNION ALL SELECT txn_id, 100, '```' || chr(10) FROM failed_txns
         UNION ALL SELECT txn_id, 1, '=== ROLLBACK REPORT ===' FROM failed_txns
         UNION ALL SELECT txn_id, 2, CASE WHEN bool_and(error IS NULL) THEN 'Rollback completed successfully'
                   ELSE 'Rollback completed with errors' END FROM failed_actions GROUP BY txn_id
         UNION ALL SELECT txn_id, 3, chr(10) || 'Completed Actions:' FROM failed_actions WHERE error IS NULL GROUP BY txn_id
         UNION ALL SELECT txn_id, 5, chr(10) || 'Failed Actions:' FROM failed_actions WHERE error IS NOT NULL GROUP BY txn_id
         UNION ALL SELECT txn_id, 4, '  • ' || description FROM failed_actions WHERE error IS NULL
         UNION ALL SELECT txn_id, 6, '  • ' || description || ': ' || error FROM failed_actions WHERE error IS NOT NULL)""",
)
def rollback_section_whole(spark, sf):
    return _rollback(spark, sf).select("key", F.when(F.col("section") == 2, -1).otherwise(F.col("seq")).alias("seq"), "line", "section")
