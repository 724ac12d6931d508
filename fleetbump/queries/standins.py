"""Landed-table shapes projected from the given tables, once for Spark and once as SQL.

Each Spark projection has an SQL text of the same name in ``SQL``; both state the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbump.functions.references import Target

SQL: dict[str, str] = {}

SMALL_PER_CORE = 4 * 1024 * 1024


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Put the rows of a very small table on all cores before costly per-row work.

    Spark gives a table of less than 4 MiB (its cost of opening a file) per core fewer splits than cores, and a file of
    one row group a single one. Only such tables are shuffled here; larger ones are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if size < cores * SMALL_PER_CORE else df


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table read as a stream of its files, be it one file or a folder of them."""
    # A stream's path must be a folder or a pattern; this one matches just the table.
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def text(column: str) -> Column:
    return F.col(column).cast("string")


def with_tables(body: str) -> str:
    """SQL whose named projections (and what they rest on) are added as common table expressions."""
    needed: list[str] = []

    def add(sql: str, own: str = "") -> None:
        for name in SQL:
            if name != own and name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                add(SQL[name], name)
                needed.append(name)

    add(body)
    return ("WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in needed) + "\n" if needed else "") + body


# ---- repositories --------------------------------------------------------------------------------


def repos(spark: SparkSession, sf: str) -> DataFrame:
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    joined = s.join(n, s.s_nationkey == n.n_nationkey)
    path = F.concat(F.lower("n_name"), F.lit("/"), F.col("s_name"))
    key = F.col("s_suppkey")
    return joined.select(
        text("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        path.alias("path_with_namespace"),
        F.concat(F.lit("https://git.example.com/"), path).alias("web_url"),
        F.lit("main").alias("default_branch"),
        F.when(key % 5 == 0, F.struct((key + 1).cast("string").alias("id"))).alias("forked_from"),
        (key % 7 == 0).alias("archived"),
        (key % 2 == 0).alias("owned"),
        (key % 3 == 0).alias("member"),
        F.col("n_name").alias("description"),
        key.alias("ord"),
    )


SQL["repos"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, lower(n_name) || '/' || s_name AS path_with_namespace,
       'https://git.example.com/' || lower(n_name) || '/' || s_name AS web_url, 'main' AS default_branch,
       s_suppkey % 5 = 0 AS is_fork, s_suppkey % 7 = 0 AS archived, s_suppkey % 2 = 0 AS owned,
       s_suppkey % 3 = 0 AS member, n_name AS description, s_suppkey AS ord
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("unknown/"), text("o_custkey")))
        .otherwise(text("o_custkey"))
        .alias("key"),
        F.col("o_orderkey").alias("ord"),
    )
    r = repos(spark, sf).select(F.col("path_with_namespace").alias("key"), (-F.col("ord") - 1).alias("ord"))
    return o.unionByName(r)


SQL["requests"] = """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'unknown/' || CAST(o_custkey AS VARCHAR)
            ELSE CAST(o_custkey AS VARCHAR) END AS key, o_orderkey AS ord FROM orders
UNION ALL SELECT path_with_namespace, -ord - 1 FROM repos """


def branches(spark: SparkSession, sf: str) -> DataFrame:
    """One in ten commit dates cannot be read."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        text("o_custkey").alias("repo_id"),
        F.concat(F.when(key % 2 == 0, F.lit("release/")).otherwise(F.lit("dev/")), text("o_orderkey")).alias("name"),
        F.when(key % 10 == 9, F.lit("not a date"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .alias("committed_date"),
        key.alias("ord"),
    )


SQL["branches"] = """
SELECT CAST(o_custkey AS VARCHAR) AS repo_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'release/' ELSE 'dev/' END || CAST(o_orderkey AS VARCHAR) AS name,
       CASE WHEN o_orderkey % 10 = 9 THEN 'not a date'
            ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS committed_date,
       CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_orderdate END AS committed_at,
       o_orderkey AS ord
FROM orders"""


# ---- package references --------------------------------------------------------------------------

TARGETS = [
    Target("Red Plate", "25.4.0"),
    Target("small widget", "30.0.0-rc.1"),
    Target("HOT RING", "10.2"),
    Target("old rod", "1.0.0"),
]

# name, version and order key (release, release, pre rank, pre number, post, final, dev) of each target.
SQL["targets"] = """
SELECT * FROM (VALUES (0, 'Red Plate', '25.4.0', [25, 4, 9, 0, 0, 1, 0]),
                      (1, 'small widget', '30.0.0-rc.1', [30, 0, 3, 1, 0, 1, 0]),
                      (2, 'HOT RING', '10.2', [10, 2, 9, 0, 0, 1, 0]),
                      (3, 'old rod', '1.0.0', [1, 0, 9, 0, 0, 1, 0])) AS t(ord, name, version, key)"""


def package_refs(spark: SparkSession, sf: str) -> DataFrame:
    """One reference per order line: plain, short, pre-release, post, dev and unreadable versions."""
    lines, parts = spread(table(spark, sf, "lineitem"), "l_partkey"), table(spark, sf, "part")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 9
    short = F.concat_ws(".", text("p_size"), text("l_linenumber"))
    version = (
        F.when(kind == 0, F.concat(short, F.lit(".0-rc.1")))
        .when(kind == 1, F.lit("$(Version)"))
        .when(kind == 2, short)
        .when(kind == 3, F.concat(short, F.lit(".0-1")))
        .when(kind == 4, F.concat(F.lit("v"), short, F.lit(".0.dev3")))
        .otherwise(F.concat(short, F.lit(".0")))
    )
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        text("l_suppkey").alias("repo_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("release")).otherwise(F.lit("main")).alias("ref"),
        F.concat(
            F.lit("src/"), text("l_orderkey"), F.lit("/"), text("l_linenumber"), F.lit("-"), text("l_partkey"), F.lit(".csproj")
        ).alias("path"),
        F.col("p_name").alias("package"),
        version.alias("version"),
        (F.col("l_partkey") % 3).cast("int").alias("layout_kind"),
        (F.col("l_linestatus") == "F").alias("crlf"),
    )


SQL["package_refs"] = """
SELECT CAST(l_suppkey AS VARCHAR) AS repo_id, CASE WHEN l_linenumber % 2 = 0 THEN 'release' ELSE 'main' END AS ref,
       'src/' || l_orderkey || '/' || l_linenumber || '-' || l_partkey || '.csproj' AS path,
       p_name AS package,
       CASE kind WHEN 0 THEN short || '.0-rc.1' WHEN 1 THEN '$(Version)' WHEN 2 THEN short WHEN 3 THEN short || '.0-1'
                 WHEN 4 THEN 'v' || short || '.0.dev3' ELSE short || '.0' END AS version,
       CASE kind WHEN 0 THEN [p_size, l_linenumber, 3, 1, 0, 1, 0] WHEN 1 THEN NULL
                 WHEN 3 THEN [p_size, l_linenumber, 9, 0, 2, 1, 0] WHEN 4 THEN [p_size, l_linenumber, 0, 0, 0, 0, 3]
                 ELSE [p_size, l_linenumber, 9, 0, 0, 1, 0] END AS key,
       l_partkey % 3 AS layout_kind, l_linestatus = 'F' AS crlf
FROM (SELECT *, (l_orderkey + l_linenumber) % 9 AS kind, p_size || '.' || l_linenumber AS short
      FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _project_text(version: Column, package: Column, nl: Column, kind: Column) -> Column:
    single = F.concat(F.lit('    <PackageReference Include="'), package, F.lit('" Version="'), version, F.lit('" />'))
    multi_old = F.concat(
        F.lit('    <PackageReference Include="'), package, F.lit('">'), nl, F.lit("      <Version>"),
        F.when(kind == 2, F.lit("0.0.1")).otherwise(version), F.lit("</Version>"), nl, F.lit("    </PackageReference>"),
    )
    refs = F.when(kind == 0, single).when(kind == 1, multi_old).otherwise(F.concat(single, nl, multi_old))
    tools = F.concat(F.lit('    <PackageReference Include="'), package, F.lit('.Tools" Version="1.0.0" PrivateAssets="all" />'))
    return F.concat(
        F.lit("<Project>"), nl, F.lit("  <ItemGroup>"), nl, refs, nl, tools, nl, F.lit("  </ItemGroup>"), nl,
        F.lit("</Project>"), nl,
    )


def project_files(spark: SparkSession, sf: str) -> DataFrame:
    """One project file per reference: single-line (0), multi-line (1) or both layouts (2)."""
    nl = F.when(F.col("crlf"), F.lit("\r\n")).otherwise(F.lit("\n"))
    return package_refs(spark, sf).select(
        "repo_id",
        "ref",
        "path",
        _project_text(F.col("version"), F.col("package"), nl, F.col("layout_kind")).alias("content"),
    )


# ``shown``/``name`` are what stands in the file: the old version, or after a rewrite the target's.
PROJECT_TEXT = """
'<Project>' || nl || '  <ItemGroup>' || nl ||
CASE layout_kind
  WHEN 0 THEN '    <PackageReference Include="' || {name} || '" Version="' || {shown} || '" />'
  WHEN 1 THEN '    <PackageReference Include="' || {name} || '">' || nl || '      <Version>' || {shown} || '</Version>'
              || nl || '    </PackageReference>'
  ELSE '    <PackageReference Include="' || {name} || '" Version="' || {shown} || '" />' || nl ||
       '    <PackageReference Include="' || package || '">' || nl || '      <Version>0.0.1</Version>' || nl ||
       '    </PackageReference>' END
|| nl || '    <PackageReference Include="' || package || '.Tools" Version="1.0.0" PrivateAssets="all" />' || nl ||
'  </ItemGroup>' || nl || '</Project>' || nl"""

SQL["lined_refs"] = "SELECT *, CASE WHEN crlf THEN chr(13) || chr(10) ELSE chr(10) END AS nl FROM package_refs "
SQL["project_files"] = (
    "SELECT repo_id, ref, path, " + PROJECT_TEXT.format(name="package", shown="version") + " AS content FROM lined_refs "
)

# Decision of every (file, target): each file decides on its one reference of a target package.
SQL["decided"] = """
SELECT r.repo_id, r.ref, r.path, r.package, r.version, r.layout_kind, r.crlf, r.nl, t.ord AS target_ord,
       t.name AS target_name, t.version AS new_version,
       CASE WHEN r.version = t.version THEN 'current' WHEN r.key IS NULL THEN 'update_unparsed'
            WHEN t.key < r.key THEN 'downgrade_blocked' ELSE 'update' END AS decision
FROM lined_refs r JOIN targets t ON lower(r.package) = lower(t.name)"""


# ---- merge requests ------------------------------------------------------------------------------


def merge_requests(spark: SparkSession, sf: str) -> DataFrame:
    return request_states(table(spark, sf, "events")).drop("seen_at")


def request_states(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    state = (
        F.when(kind == "click", F.lit("opened"))
        .when(kind == "view", F.lit("merged"))
        .when(kind == "purchase", F.lit("closed"))
        .when(kind == "signup", F.lit("locked"))
    )
    key = F.col("event_id")
    return events.select(
        text("user_id").alias("repo_id"),
        text("event_id").alias("iid"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        F.when(key % 50 == 0, F.lit("Update 4 NuGet packages"))
        .when(key % 50 == 1, F.lit("Update 4 NuGet packages + Code Migrations"))
        .otherwise(F.concat(F.lit("Work "), text("event_id")))
        .alias("title"),
        state.alias("state"),
        F.concat(F.lit("https://git.example.com/mr/"), text("event_id")).alias("web_url"),
        F.concat(F.lit("topic/"), text("event_id")).alias("source_branch"),
        F.when(key % 3 == 0, F.lit("release")).otherwise(F.lit("main")).alias("target_branch"),
        key.alias("ord"),
    )


SQL["merge_requests"] = """
SELECT CAST(user_id AS VARCHAR) AS repo_id, CAST(event_id AS VARCHAR) AS iid,
       CASE WHEN event_id % 50 = 0 THEN 'Update 4 NuGet packages'
            WHEN event_id % 50 = 1 THEN 'Update 4 NuGet packages + Code Migrations'
            ELSE 'Work ' || event_id END AS title,
       CASE event_type WHEN 'click' THEN 'opened' WHEN 'view' THEN 'merged' WHEN 'purchase' THEN 'closed'
            WHEN 'signup' THEN 'locked' END AS state,
       'https://git.example.com/mr/' || event_id AS web_url, 'topic/' || event_id AS source_branch,
       CASE WHEN event_id % 3 = 0 THEN 'release' ELSE 'main' END AS target_branch, event_id AS ord
FROM events"""


def tracked(spark: SparkSession, sf: str) -> DataFrame:
    """Tracking rows per event; one in eleven lacks its request id, one in seven has no status yet."""
    key = F.col("event_id")
    return table(spark, sf, "events").select(
        text("user_id").alias("repository_id"),
        F.concat(F.lit("repo-"), text("user_id")).alias("repository_name"),
        F.concat(F.lit("https://git.example.com/mr/"), text("event_id")).alias("merge_request_url"),
        F.when(key % 11 != 0, text("event_id")).alias("merge_request_iid"),
        F.lit("2024-01-01T00:00:00").alias("created_at"),
        F.lit(None).cast("boolean").alias("was_existing"),
        (key % 4 == 0).alias("existed"),
        F.when(key % 7 == 0, F.lit(None).cast("string"))
        .when(key % 3 == 0, F.lit("opened"))
        .when(key % 3 == 1, F.lit("Merged"))
        .otherwise(F.lit("merged"))
        .alias("status"),
        F.lit(None).cast("string").alias("last_checked"),
        F.when(key % 5 != 0, F.col("event_type")).alias("package_name"),
        F.when(key % 5 != 0, F.concat(text("user_id"), F.lit(".0"))).alias("new_version"),
        F.lit("main").alias("target_branch"),
        F.concat(F.lit("topic/"), text("event_id")).alias("source_branch"),
        F.array(F.concat(text("event_id"), F.lit(".csproj"))).alias("modified_files"),
        key.alias("ord"),
    )


SQL["tracked"] = """
SELECT CAST(user_id AS VARCHAR) AS repository_id, 'repo-' || user_id AS repository_name,
       'https://git.example.com/mr/' || event_id AS merge_request_url,
       CASE WHEN event_id % 11 <> 0 THEN CAST(event_id AS VARCHAR) END AS merge_request_iid,
       event_id % 4 = 0 AS existed,
       CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'opened' WHEN event_id % 3 = 1 THEN 'Merged'
            ELSE 'merged' END AS status,
       CASE WHEN event_id % 5 <> 0 THEN event_type END AS package_name,
       CASE WHEN event_id % 5 <> 0 THEN user_id || '.0' END AS new_version,
       'main' AS target_branch, 'topic/' || event_id AS source_branch, event_id AS ord
FROM events"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Host states: one per event, plus one a day earlier."""
    return snapshot_rows(table(spark, sf, "events"))


def snapshot_rows(events: DataFrame) -> DataFrame:
    now = request_states(events).select(F.col("repo_id").alias("repository_id"), "iid", "state", "seen_at", "ord")
    before = now.withColumn("state", F.lit("opened")).withColumn(
        "seen_at", F.col("seen_at") - F.expr("INTERVAL 1 DAY")
    )
    return now.unionByName(before)


SQL["snapshots"] = """
SELECT m.repo_id AS repository_id, m.iid, m.state, e.ts AS seen_at, m.ord
FROM merge_requests m JOIN events e ON m.ord = e.event_id
UNION ALL
SELECT m.repo_id, m.iid, 'opened', e.ts - INTERVAL 1 DAY, m.ord
FROM merge_requests m JOIN events e ON m.ord = e.event_id"""

SQL["latest"] = """
SELECT repository_id, iid, arg_max(state, seen_at) AS state FROM
  (SELECT repository_id, iid, coalesce(state, '') AS state, seen_at FROM snapshots ) GROUP BY ALL"""


# ---- request log ---------------------------------------------------------------------------------


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    return request_rows(table(spark, sf, "events"))


def request_rows(events: DataFrame, squeeze: int = 1000) -> DataFrame:
    """Events as API requests; time runs ``squeeze`` times faster, so requests come within seconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")).alias("key"),
        F.timestamp_micros(F.floor(us / squeeze)).alias("ts"),
        F.when(F.col("event_type") == "error", F.lit(429))
        .when(F.col("event_type") == "signup", F.lit(503))
        .when(F.col("event_type") == "view", F.lit(404))
        .otherwise(F.lit(200))
        .alias("status_code"),
        F.when(F.col("event_id") % 4 == 0, F.lit("soon"))
        .when(F.col("event_id") % 4 == 1, (F.col("event_id") % 500).cast("string"))
        .alias("retry_after"),
        (F.col("event_id") % 12).cast("int").alias("attempt"),
    )


SQL["request_log"] = """
SELECT event_id AS request_id, 'k' || (user_id % 3) AS key, epoch_us(ts) // 1000 AS us,
       CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 503 WHEN 'view' THEN 404 ELSE 200 END AS status_code,
       CASE WHEN event_id % 4 = 0 THEN 'soon' WHEN event_id % 4 = 1 THEN CAST(event_id % 500 AS VARCHAR) END AS retry_after,
       event_id % 12 AS attempt
FROM events"""


# ---- undo log ------------------------------------------------------------------------------------


def action_log(spark: SparkSession, sf: str) -> DataFrame:
    """One action per order line; its place in the transaction is unique."""
    lines = table(spark, sf, "lineitem")
    return lines.select(
        text("l_orderkey").alias("txn_id"),
        (F.col("l_linenumber").cast("bigint") * 10_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("seq"),
        F.concat(F.lit("undo "), text("l_partkey")).alias("description"),
        F.when(F.col("l_returnflag") == "R", F.lit("failed")).otherwise(F.lit("ok")).alias("outcome"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("cannot undo "), text("l_suppkey"))).alias("error"),
    )


SQL["action_log"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS txn_id,
       CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey * 100 + l_suppkey % 100 AS seq,
       'undo ' || l_partkey AS description, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'ok' END AS outcome,
       CASE WHEN l_returnflag = 'R' THEN 'cannot undo ' || l_suppkey END AS error
FROM lineitem"""


def succeeded_txns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(text("o_orderkey").alias("txn_id"))


SQL["succeeded_txns"] = "SELECT CAST(o_orderkey AS VARCHAR) AS txn_id FROM orders WHERE o_orderstatus = 'F'"


# ---- rule catalogue ------------------------------------------------------------------------------


def _call(name: str, method: str, action: dict, **node) -> dict:
    return {
        "name": name,
        "target_nodes": [{"type": "InvocationExpression", "method_name": method, **node}],
        "action": action,
    }


MIGRATIONS = [
    {
        "id": "plates",
        "package_name": "red plate",
        "description": "Calls that went away",
        "version_conditions": [{"type": "greater_than_or_equal", "version": "20.0.0"}],
        "rules": [
            _call("Remove OldCall", "OldCall", {"type": "remove_invocation", "strategy": "smart_chain_aware"}),
            _call("Rename Renamed", "Renamed", {"type": "replace_invocation", "replacement_method": "Fresh"}),
        ],
    },
    {
        "id": "widgets",
        "package_name": "small widget",
        "description": "Flag is gone",
        "version_conditions": [
            {"type": "exact", "version": "31.0.0"},
            {"type": "greater_than", "version": "12.5"},
        ],
        "rules": [
            _call(
                "Drop isEnabled", "AddScan", {"type": "remove_argument", "argument_name": "isEnabled"},
                containing_type="Scanner", containing_namespace="Acme.Scan",
            ),
        ],
    },
    {
        "id": "rings",
        "package_name": "hot ring",
        "description": "Names by range",
        "version_conditions": [{"type": "range", "version": "10.0.0", "max_version": "10.9"}],
        "rules": [
            {
                "name": "Clock field",
                "target_nodes": [{"type": "FieldDeclaration", "identifier": "_clock"}],
                "action": {"type": "replace_field_type", "replacement_type": "ITime"},
            },
        ],
    },
    {
        "id": "plates-late",
        "package_name": "Red Plate",
        "description": "Broken condition ends the search",
        "version_conditions": [
            {"type": "exact", "version": "not.a.version"},
            {"type": "greater_than", "version": "1.0"},
        ],
        "rules": [_call("Never", "Never", {"type": "remove_invocation"})],
    },
]

# One row per usable condition, in the same order; the version keys are as in ``targets``.
SQL["conditions"] = """
SELECT * FROM (VALUES
  ('plates', 0, 'red plate', 'greater_than_or_equal', [20, 0, 9, 0, 0, 1, 0], NULL),
  ('widgets', 1, 'small widget', 'exact', [31, 0, 9, 0, 0, 1, 0], NULL),
  ('widgets', 1, 'small widget', 'greater_than', [12, 5, 9, 0, 0, 1, 0], NULL),
  ('rings', 2, 'hot ring', 'range', [10, 0, 9, 0, 0, 1, 0], [10, 9, 9, 0, 0, 1, 0]))
  AS c(migration_id, migration_ord, package, type, low, high)"""
