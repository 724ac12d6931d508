"""Scans and sinks, each over files Spark first writes from the given tables to the shared folder."""

from pyspark.sql import functions as F

from fleetbump.operators import reports, status
from fleetbump.queries import standins as s
from fleetbump.queries.registry import query
from fleetbump.queries.rule_queries import _catalogue
from fleetbump.queries.status_queries import refreshed, report_entries
from fleetbump.session import staged_path
from fleetbump.sources import landed, sinks


def _landed(spark, df, name, fmt="json"):
    path = staged_path(spark, name)
    sinks.write_table(df, path, fmt)
    return path


@query(
    "repository_key_file",
    """SELECT trim(key) AS key FROM (
         SELECT CASE o_orderkey % 4 WHEN 0 THEN '# ' || o_custkey WHEN 1 THEN '  ' WHEN 2 THEN '  ' || o_custkey || ' '
                     ELSE 'group/' || o_orderkey END AS key FROM orders) WHERE trim(key) <> '' AND NOT starts_with(key, '#')""",
)
def repository_key_file(spark, sf):
    key = F.col("o_orderkey")
    lines = s.table(spark, sf, "orders").select(
        F.when(key % 4 == 0, F.concat(F.lit("# "), s.text("o_custkey")))
        .when(key % 4 == 1, F.lit("  "))
        .when(key % 4 == 2, F.concat(F.lit("  "), s.text("o_custkey"), F.lit(" ")))
        .otherwise(F.concat(F.lit("group/"), s.text("o_orderkey")))
        .alias("value")
    )
    return landed.read_repository_keys(spark, _landed(spark, lines, "keys", "text")).select("key")


@query("repository_pages", "SELECT id, name, path_with_namespace, is_fork, archived, ord FROM repos")
def repository_pages(spark, sf):
    repos = landed.read_repositories(spark, _landed(spark, s.repos(spark, sf), "repos"))
    return repos.select("id", "name", "path_with_namespace", F.col("forked_from").isNotNull().alias("is_fork"), "archived", "ord")


@query(
    "tree_pages",
    "SELECT ref, count(*) AS n, count(DISTINCT path) AS paths, min(path) AS first_path FROM package_refs GROUP BY ref",
)
def tree_pages(spark, sf):
    tree = s.package_refs(spark, sf).select(
        "repo_id",
        "ref",
        F.lit("blob").alias("type"),
        F.substring_index("path", "/", -1).alias("name"),
        "path",
        F.lit(0).cast("bigint").alias("ord"),
    )
    path = staged_path(spark, "tree")
    sinks.write_table(tree, path, "json", ["ref"])
    read = landed.read_tree(spark, path)
    return read.groupBy("ref").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"), F.min("path").alias("first_path")
    )


@query("landed_file_contents", "SELECT 'D' || doc_id AS path, md5(text) AS content_md5 FROM documents")
def landed_file_contents(spark, sf):
    raw = s.table(spark, sf, "documents").select(
        F.lit("r").alias("repo_id"),
        F.lit("main").alias("ref"),
        F.concat(F.lit("D"), s.text("doc_id")).alias("path"),
        F.base64(F.encode("text", "UTF-8")).alias("content_base64"),
    )
    files = landed.read_files(spark, _landed(spark, raw, "files"))
    return files.select("path", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    "working_tree_files",
    """SELECT md5(line) AS line_md5, count(*) AS n FROM (
         SELECT unnest(string_split(text || chr(13) || chr(10) || role, chr(10))) AS line FROM conversations) GROUP BY 1""",
)
def working_tree_files(spark, sf):
    """Files of up to a thousand turns each, read as whole files; carriage returns must survive."""
    path = staged_path(spark, "tree")
    turns = s.table(spark, sf, "conversations").select(F.concat("text", F.lit("\r\n"), "role").alias("value"))
    turns.write.option("maxRecordsPerFile", "1000").text(path)
    files = landed.read_working_tree(spark, path, ".txt")
    # The text sink ends every file with a newline, which is no line of its own.
    lines = files.select(F.explode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy(F.md5(F.col("line").cast("binary")).alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("branch_pages", "SELECT repo_id, name, committed_date, ord FROM branches")
def branch_pages(spark, sf):
    raw = s.branches(spark, sf).select("repo_id", "name", F.struct("committed_date").alias("commit"), "ord")
    return landed.read_branches(spark, _landed(spark, raw, "branches"))


@query(
    "merge_requests_by_state",
    "SELECT repo_id, iid, title, web_url FROM merge_requests WHERE state = 'opened' AND target_branch = 'release'",
)
def merge_requests_by_state(spark, sf):
    path = _landed(spark, s.merge_requests(spark, sf), "requests", "parquet")
    found = landed.read_merge_requests(spark, path, state="opened", target_branch="release", fmt="parquet")
    return found.select("repo_id", "iid", "title", "web_url")


@query(
    "rule_files",
    """SELECT 'm' || (p_partkey % 1500) AS id, p_type AS description,
              CAST(CASE WHEN p_partkey % 10 = 7 THEN 0 ELSE 1 END AS BIGINT) AS conditions,
              CAST(CASE WHEN p_partkey % 10 = 8 THEN 0 ELSE 1 END AS BIGINT) AS rules FROM part""",
)
def rule_files(spark, sf):
    docs = _catalogue(spark, sf).drop("ord")
    path = _landed(spark, docs.select(F.array(F.struct(*docs.columns)).alias("migrations")), "rules")
    # Every line of this folder is a rule document of its own.
    read = spark.read.schema(landed.schemas.CATALOGUE_FILE).json(path)
    entries = landed.entries_of(read)
    return entries.select(
        "id",
        "description",
        F.size("version_conditions").cast("bigint").alias("conditions"),
        F.size("rules").cast("bigint").alias("rules"),
    )


@query(
    "tracking_documents",
    """SELECT merge_request_url, status, unnest([0, 1]) AS ord FROM tracked""",
)
def tracking_documents(spark, sf):
    rows = s.tracked(spark, sf).drop("ord")
    one = F.struct(*rows.columns)
    docs = rows.select(
        F.struct(F.lit("now").alias("generated_at"), F.col("package_name").alias("package_name")).alias("metadata"),
        F.array(one, one).alias("merge_requests"),
    )
    path = _landed(spark, docs, "tracking")
    read = landed.tracking_rows_of(spark.read.schema(landed.schemas.TRACKING).json(path))
    return read.select("merge_request_url", "status", "ord")


def _documents(spark, docs, name):
    """A file for each row."""
    path = staged_path(spark, name)
    docs.write.option("maxRecordsPerFile", 1).json(path)
    return path


@query(
    "rule_catalogue_read",
    """SELECT 'p' || p_partkey AS id, p_type AS description,
              CAST(CASE WHEN p_partkey % 10 = 7 THEN 0 ELSE 1 END AS BIGINT) AS conditions,
              CAST(CASE WHEN p_partkey % 10 = 8 THEN 0 ELSE 1 END AS BIGINT) AS rules FROM part""",
)
def rule_catalogue_read(spark, sf):
    """Rule documents of up to a hundred entries, a file each."""
    entries = _catalogue(spark, sf).withColumn("id", F.concat(F.lit("p"), F.col("ord").cast("string")))
    entry = F.struct(*[c for c in entries.columns if c != "ord"])
    docs = entries.groupBy(F.floor(F.col("ord") / 100).alias("g")).agg(F.collect_list(entry).alias("migrations")).drop("g")
    read = landed.read_migrations(spark, _documents(spark, docs, "catalogue"))
    return read.select(
        "id",
        "description",
        F.size("version_conditions").cast("bigint").alias("conditions"),
        F.size("rules").cast("bigint").alias("rules"),
    )


@query(
    "tracking_documents_read",
    """SELECT merge_request_url, status, row_number() OVER (PARTITION BY ord // 500 ORDER BY ord) - 1 AS place,
              (SELECT count(DISTINCT ord // 500) FROM tracked) AS documents FROM tracked""",
)
def tracking_documents_read(spark, sf):
    """Tracking documents of up to five hundred requests, a file each, in the order they were written."""
    rows = s.tracked(spark, sf)
    placed = F.struct("ord", F.struct(*[c for c in rows.columns if c != "ord"]).alias("mr"))
    docs = rows.groupBy(F.floor(F.col("ord") / 500).alias("g")).agg(F.sort_array(F.collect_list(placed)).alias("listed"))
    docs = docs.select(F.struct(F.col("g").cast("string").alias("generated_at")).alias("metadata"), F.col("listed.mr").alias("merge_requests"))
    tracked, meta = landed.read_tracking(spark, _documents(spark, docs, "tracking-read"))
    return tracked.select("merge_request_url", "status", F.col("ord").cast("bigint").alias("place")).withColumn(
        "documents", meta.agg(F.count_distinct("generated_at")).scalar()
    )


@query(
    "tracking_snapshot",
    "SELECT merge_request_url, status, existed, package_name, len(repository_id || '.csproj') > 0 AS has_files FROM now",
)
def tracking_snapshot(spark, sf):
    path = staged_path(spark, "snapshot")
    rows = refreshed(spark, sf).drop("refresh_outcome", "old_status")
    sinks.write_tracking_rows(rows, path)
    read = landed.read_tracking_rows(spark, path)
    return read.select(
        "merge_request_url", "status", "existed", "package_name", (F.size("modified_files") > 0).alias("has_files")
    )


@query(
    "tracking_document_lines",
    """SELECT merge_request_url, status FROM now""",
)
def tracking_document_lines(spark, sf):
    """The nested document read back line by line, brackets and commas taken off."""
    path = staged_path(spark, "document")
    rows = status.canonical_order(refreshed(spark, sf).drop("refresh_outcome", "old_status"))
    sinks.write_tracking_document(rows, {"generated_at": "now"}, path)
    lines = spark.read.text(path).filter(~F.col("value").startswith('{"metadata"') & (F.col("value") != "]}"))
    parsed = lines.select(F.from_json(F.regexp_replace("value", "^,", ""), landed.schemas.TRACKED).alias("r"))
    return parsed.select("r.merge_request_url", "r.status")


@query(
    "written_update_report",
    """SELECT count(*) AS lines, count(DISTINCT line) AS distinct_lines, max(line) AS last_line FROM (
         SELECT unnest(['# NuGet Package Update Report', 'Generated on: now', '', '## Summary',
                '- **Total Repositories**: ' || count(DISTINCT p_name), '- **Total Package Updates**: ' || count(*),
                '- **Repositories with Migrations**: 0', '- **Total Files with Migration Changes**: 0', '']) AS line FROM part
         UNION ALL SELECT unnest(['## Repository: ' || p_name, '- **Package**: ' || p_brand,
                '  - **Version**: ' || CASE WHEN p_partkey % 2 = 0 THEN '0.9, 1.0 → ' ELSE '' END || p_size || '.0',
                '  - **Status**: ' || CASE WHEN p_partkey % 2 = 0 THEN 'Would Create MR' ELSE 'No Changes' END,
                '  - **Details**: ' || CASE WHEN p_partkey % 3 <> 0 THEN 'details' ELSE 'N/A' END, '']) FROM part
         UNION ALL SELECT '- **Target Branch**: main' FROM part WHERE p_partkey % 3 = 0)""",
)
def written_update_report(spark, sf):
    entries = report_entries(spark, sf)
    entries = entries.withColumn("migration", F.lit(None).cast(entries.schema["migration"].dataType))
    path = staged_path(spark, "report")
    sinks.write_lines(reports.update_report(entries, "now"), path, reports.LINE_ORDER)
    lines = spark.read.text(path)
    return lines.agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("value").alias("distinct_lines"), F.max("value").alias("last_line")
    )
