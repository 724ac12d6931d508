"""Extraction, rewriting, the upgrade plan and what it publishes."""

from pyspark.sql import functions as F

from fleetbump.functions import naming
from fleetbump.functions.references import rewrite_references
from fleetbump.operators import catalog, publish
from fleetbump.plans import upgrade
from fleetbump.queries import standins as s
from fleetbump.queries.registry import query

_EPOCH = 1_700_000_000


@query(
    "single_line_references",
    """SELECT repo_id, path, package, version, CAST(occurrence AS BIGINT) AS occurrence FROM (
         SELECT repo_id, path, package, version, 1 AS occurrence FROM package_refs WHERE layout_kind <> 1
         UNION ALL SELECT repo_id, path, package || '.Tools', '1.0.0', CASE WHEN layout_kind = 1 THEN 1 ELSE 2 END
         FROM package_refs )""",
)
def single_line_references(spark, sf):
    refs = upgrade.package_references(s.project_files(spark, sf)).filter(F.col("layout") == "single")
    return refs.select("repo_id", "path", "package", "version", F.col("occurrence").cast("bigint").alias("occurrence"))


@query(
    "multi_line_references",
    """SELECT repo_id, path, package, CASE WHEN layout_kind = 1 THEN version ELSE '0.0.1' END AS version
       FROM package_refs WHERE layout_kind <> 0""",
)
def multi_line_references(spark, sf):
    refs = upgrade.package_references(s.project_files(spark, sf)).filter(F.col("layout") == "multi")
    return refs.select("repo_id", "path", "package", "version")


_REWRITTEN = """
SELECT repo_id, ref, path, package, layout_kind, nl, target_ord, target_name, new_version,
       decision IN ('update', 'update_unparsed') AS changed,
       CASE WHEN decision IN ('update', 'update_unparsed') THEN new_version ELSE version END AS shown,
       CASE WHEN decision IN ('update', 'update_unparsed') THEN target_name ELSE package END AS name FROM decided"""


def _rewritten_text() -> str:
    return s.PROJECT_TEXT.format(name="name", shown="shown")


@query(
    "rewritten_project_files",
    f"SELECT repo_id, path, md5({_rewritten_text()}) AS content_md5, target_name || '@' || new_version AS updated "
    f"FROM ({_REWRITTEN}) WHERE changed",
)
def rewritten_project_files(spark, sf):
    done = publish.rewrite_project_files(s.project_files(spark, sf), s.TARGETS)
    names = F.transform("updated", lambda u: F.concat(u["name"], F.lit("@"), u["version"]))
    return done.select(
        "repo_id", "path", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.array_join(names, ",").alias("updated")
    )


@query(
    "rewritten_one_package",
    f"""SELECT repo_id, path, md5(CASE WHEN target_ord = 1 THEN {_rewritten_text()} ELSE
          {s.PROJECT_TEXT.format(name='package', shown='version')} END) AS content_md5
        FROM (SELECT w.*, d.version FROM ({_REWRITTEN}) w JOIN decided d USING (repo_id, path))""",
)
def rewritten_one_package(spark, sf):
    """Rewrite with a single target; files of the other targets stay as they are."""
    files = s.project_files(spark, sf)
    refs = upgrade.join_targets(s.package_refs(spark, sf), upgrade.targets_table(spark, s.TARGETS))
    wanted = refs.select("repo_id", "path")
    one = rewrite_references(F.col("content"), [s.TARGETS[1]])["content"]
    return files.join(wanted, ["repo_id", "path"], "left_semi").select(
        "repo_id", "path", F.md5(one.cast("binary")).alias("content_md5")
    )


_UPDATES = """
SELECT repo_id, ref, target_ord, target_name, new_version, count(*) AS project_files,
       string_agg(DISTINCT version, ', ' ORDER BY version) AS old_versions
FROM decided WHERE decision IN ('update', 'update_unparsed') GROUP BY ALL"""


@query(
    "repository_updates",
    f"SELECT repo_id, ref, target_name, new_version, project_files, old_versions FROM ({_UPDATES})",
)
def repository_updates(spark, sf):
    decided = upgrade.file_decisions(s.project_files(spark, sf), s.TARGETS)
    return upgrade.repository_updates(decided).drop("target_ord")


@query(
    "distinct_old_versions",
    "SELECT package, count(DISTINCT version) AS n, string_agg(DISTINCT version, ', ' ORDER BY version) AS versions "
    "FROM package_refs GROUP BY package",
)
def distinct_old_versions(spark, sf):
    # Duplicates go first, so what is collected per package is its list of released versions.
    distinct = s.package_refs(spark, sf).select("package", "version").distinct()
    return distinct.groupBy("package").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("version")), ", ").alias("versions")
    )


# ---- flagship ------------------------------------------------------------------------------------


def plan_files(spark, sf):
    """Project files of the order lines plus one code file per document."""
    code = s.spread(s.table(spark, sf, "documents"), "doc_id").select(
        (F.col("doc_id") % 97).cast("string").alias("repo_id"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("release")).otherwise(F.lit("main")).alias("ref"),
        F.concat(F.lit("src/D"), s.text("doc_id"), F.lit(".cs")).alias("path"),
        F.concat(
            F.lit("/* "),
            F.col("text"),
            F.lit(" */\n"),
            F.when(F.col("doc_id") % 3 == 0, F.lit("services.OldCall(1);\n"))
            .when(F.col("doc_id") % 3 == 1, F.lit("new Scanner().AddScan(isEnabled);\n"))
            .otherwise(F.lit("\n")),
        ).alias("content"),
    )
    return s.project_files(spark, sf).unionByName(code)


def plan_branches(spark, sf):
    key = F.col("o_orderkey")
    return s.table(spark, sf, "orders").select(
        s.text("o_custkey").alias("repo_id"),
        F.when((key % 2 == 0) & (F.col("o_custkey") % 4 == 0), F.lit("release")).otherwise(F.lit("dev")).alias("name"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("committed_date"),
        key.alias("ord"),
    )


def plan_packages(spark, sf):
    return upgrade.plan_packages(
        s.repos(spark, sf),
        plan_files(spark, sf),
        s.merge_requests(spark, sf),
        s.TARGETS,
        s.MIGRATIONS,
        branches=plan_branches(spark, sf),
        branch_glob="rel*",
    )


s.SQL["plan_repos"] = """
SELECT r.id, r.name, CASE WHEN r.id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders
         WHERE o_orderkey % 2 = 0 AND o_custkey % 4 = 0) THEN 'release' ELSE 'main' END AS target_branch FROM repos r"""
s.SQL["plan_code"] = """
SELECT CAST(doc_id % 97 AS VARCHAR) AS repo_id, CASE WHEN doc_id % 2 = 0 THEN 'release' ELSE 'main' END AS ref,
       doc_id % 3 AS kind, text FROM documents"""
# Rule count per target from version zero: the first two rule sets and the third apply, one each.
s.SQL["plan_rows"] = f"""
SELECT p.id, p.name, p.target_branch, t.ord AS target_ord, t.name AS package, t.version AS new_version,
       CASE t.ord WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS rules,
       coalesce(u.project_files, 0) AS project_files, u.old_versions,
       coalesce(c.code_files, 0) AS code_files,
       EXISTS (SELECT 1 FROM plan_code k WHERE k.repo_id = p.id AND k.ref = p.target_branch) AS has_code,
       EXISTS (SELECT 1 FROM package_refs k WHERE k.repo_id = p.id AND k.ref = p.target_branch) AS has_projects,
       EXISTS (SELECT 1 FROM merge_requests m WHERE m.repo_id = p.id AND m.target_branch = p.target_branch
               AND m.state = 'opened' AND m.title IN ('Update 4 NuGet packages', 'Update 4 NuGet packages + Code Migrations')
              ) AS has_request
FROM plan_repos p JOIN targets t ON true
LEFT JOIN ({_UPDATES}) u ON u.repo_id = p.id AND u.ref = p.target_branch AND u.target_ord = t.ord
LEFT JOIN (SELECT repo_id, ref, ord, count(*) AS code_files FROM (
             SELECT repo_id, ref, 0 AS ord FROM plan_code WHERE kind = 0 OR contains(text, 'OldCall') OR contains(text, 'Renamed')
             UNION ALL SELECT repo_id, ref, 1 FROM plan_code WHERE kind = 1 OR contains(text, 'AddScan') OR contains(text, 'Scanner'))
           GROUP BY ALL) c ON c.repo_id = p.id AND c.ref = p.target_branch AND c.ord = t.ord"""
s.SQL["plan_outcomes"] = """
SELECT id, name, target_branch, CAST(sum(project_files) AS BIGINT) AS project_files,
       CAST(sum(code_files) AS BIGINT) AS code_files, bool_or(rules > 0 AND has_code) AS has_migrations,
       CASE WHEN bool_or(has_request) THEN 'existing_request' WHEN NOT bool_or(has_projects) THEN 'no_projects'
            WHEN sum(project_files) > 0 OR bool_or(rules > 0 AND has_code) THEN 'would_create'
            ELSE 'no_changes' END AS outcome
FROM plan_rows GROUP BY id, name, target_branch"""


@query(
    "upgrade_plan",
    """SELECT id, name, target_branch, outcome, project_files, code_files, has_migrations,
              'update-plate-small widget-1700000000' AS source_branch, 'Update 4 NuGet packages' AS title
       FROM plan_outcomes""".replace("update-plate-small", "update-red plate-small"),
)
def upgrade_plan(spark, sf):
    return upgrade.plan_repositories(plan_packages(spark, sf), s.TARGETS, _EPOCH)


@query(
    "upgrade_plan_by_package",
    """SELECT id, package, new_version, CAST(project_files AS BIGINT) AS project_files, old_versions,
              CAST(code_files AS BIGINT) AS code_files, rules > 0 AND has_code AS has_migrations FROM plan_rows""",
)
def upgrade_plan_by_package(spark, sf):
    return plan_packages(spark, sf).select(
        "id", "package", "new_version", "project_files", "old_versions", "code_files", "has_migrations"
    )


@query(
    "preview_summary",
    """SELECT count(*) AS repositories, count_if(outcome = 'would_create') AS would_create,
              count_if(outcome = 'existing_request') AS existing_requests,
              count_if(outcome IN ('no_changes', 'no_projects')) AS no_changes,
              CAST(sum(CASE WHEN outcome = 'would_create' THEN project_files ELSE 0 END) AS BIGINT) AS project_files,
              CAST(sum(CASE WHEN outcome = 'would_create' THEN code_files ELSE 0 END) AS BIGINT) AS code_files
       FROM plan_outcomes""",
)
def preview_summary(spark, sf):
    return upgrade.preview_summary(upgrade.plan_repositories(plan_packages(spark, sf), s.TARGETS, _EPOCH))


@query(
    "preview_summary_errors",
    """SELECT count(*) AS repositories, count_if(outcome = 'would_create') AS would_create,
              (SELECT count(*) FROM requests WHERE key NOT IN (SELECT id FROM repos)
                 AND key NOT IN (SELECT path_with_namespace FROM repos)) AS errors
       FROM plan_outcomes""",
)
def preview_summary_errors(spark, sf):
    """Totals of a plan for requested repositories, some of which there are none of."""
    plan = upgrade.plan_repositories(plan_packages(spark, sf), s.TARGETS, _EPOCH)
    missing = catalog.unresolved_requests(s.requests(spark, sf), s.repos(spark, sf))
    return upgrade.preview_summary(plan, missing).select("repositories", "would_create", "errors")


@query(
    "existing_requests",
    """SELECT r.id, bool_or(m.iid IS NOT NULL) AS has_request FROM repos r LEFT JOIN merge_requests m
         ON m.repo_id = r.id AND m.target_branch = 'main' AND m.state = 'opened'
         AND m.title IN ('Update 4 NuGet packages', 'Update 4 NuGet packages + Code Migrations') GROUP BY r.id""",
)
def existing_requests(spark, sf):
    chosen = catalog.with_target_branch(s.repos(spark, sf), None).select("id", "target_branch")
    titles = upgrade.request_titles(s.TARGETS)
    return upgrade.without_existing_request(chosen, s.merge_requests(spark, sf), titles).select("id", "has_request")


@query(
    "changed_paths",
    """SELECT repo_id, path FROM decided WHERE decision IN ('update', 'update_unparsed')
       UNION SELECT CAST(doc_id % 97 AS VARCHAR), 'src/D' || doc_id || '.cs' FROM documents
       WHERE doc_id % 3 = 0 OR contains(text, 'OldCall')""",
)
def changed_paths(spark, sf):
    changed = publish.rewrite_project_files(s.project_files(spark, sf), s.TARGETS)
    code = plan_files(spark, sf).filter(F.col("path").endswith(".cs") & F.col("content").contains("OldCall"))
    return upgrade.changed_paths(changed, code)


@query(
    "preview_head",
    """SELECT repo_id, path, CAST(rank AS BIGINT) AS rank, greatest(total - 3, 0) AS more FROM (
         SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rank,
                count(*) OVER (PARTITION BY repo_id) AS total FROM decided
         WHERE decision IN ('update', 'update_unparsed')) WHERE rank <= 3""",
)
def preview_head(spark, sf):
    decided = upgrade.file_decisions(s.project_files(spark, sf), s.TARGETS)
    changed = decided.filter(F.col("decision").isin("update", "update_unparsed")).select("repo_id", "path")
    head = upgrade.preview_head(changed, ["repo_id"], F.col("path"), 3)
    return head.select("repo_id", "path", F.col("rank").cast("bigint").alias("rank"), "more")


# ---- names and messages --------------------------------------------------------------------------


def _packages(spark, sf):
    """Per part: one or two packages."""
    name = F.concat(F.lit("Acme."), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))
    one = F.struct(name.alias("name"), F.concat(s.text("p_size"), F.lit(".1.0")).alias("version"))
    two = F.struct(F.col("p_brand").alias("name"), s.text("p_size").alias("version"))
    return s.table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit("src/"), s.text("p_partkey"), F.lit(".csproj")).alias("path"),
        F.when(F.col("p_partkey") % 2 == 0, F.array(one)).otherwise(F.array(one, two)).alias("packages"),
    )


s.SQL["named_parts"] = """
SELECT p_partkey, 'src/' || p_partkey || '.csproj' AS path, p_partkey % 2 = 0 AS single,
       'Acme.' || replace(p_name, ' ', '.') AS n1, p_size || '.1.0' AS v1, p_brand AS n2, CAST(p_size AS VARCHAR) AS v2
FROM part"""


@query(
    "branch_names",
    """SELECT p_partkey, CASE WHEN single THEN 'update-' || replace(lower(n1), '.', '-') || '-to-' || replace(v1, '.', '_')
         ELSE 'update-' || lower(split_part(n1, '.', -1)) || '-' || lower(split_part(n2, '.', -1)) || '-1700000000' END
         AS branch FROM named_parts""",
)
def branch_names(spark, sf):
    return _packages(spark, sf).select("p_partkey", naming.branch_name(F.col("packages"), F.lit(_EPOCH)).alias("branch"))


@query(
    "request_titles",
    """SELECT p_partkey, CASE WHEN single THEN 'Update ' || n1 || ' to version ' || v1 ELSE 'Update 2 NuGet packages' END
         || CASE WHEN p_partkey % 3 = 0 THEN ' + Code Migrations' ELSE '' END AS title FROM named_parts""",
)
def request_titles(spark, sf):
    return _packages(spark, sf).select(
        "p_partkey", naming.request_title(F.col("packages"), F.col("p_partkey") % 3 == 0).alias("title")
    )


@query(
    "commit_messages",
    """SELECT p_partkey, base AS run_message,
              CASE WHEN single THEN base || ' in ' || path ELSE 'Update 2 packages in ' || path || ': ' || listed END
                AS file_message,
              'Apply code migration to ' || p_partkey || '.csproj' AS migrated_message
       FROM (SELECT *, n1 || ' to ' || v1 || ', ' || n2 || ' to ' || v2 AS listed,
                    CASE WHEN single THEN 'Update ' || n1 || ' to version ' || v1
                         ELSE 'Update 2 packages: ' || n1 || ' to ' || v1 || ', ' || n2 || ' to ' || v2 END AS base
             FROM named_parts)""",
)
def commit_messages(spark, sf):
    p = F.col("packages")
    return _packages(spark, sf).select(
        "p_partkey",
        naming.commit_message(p).alias("run_message"),
        naming.file_commit_message(p, F.col("path")).alias("file_message"),
        naming.migrated_file_message(F.col("path")).alias("migrated_message"),
    )


@query(
    "request_descriptions",
    """SELECT p_partkey, concat_ws(chr(10), '## Package Updates', '', 'Updated ' || CASE WHEN single THEN 1 ELSE 2 END || ' packages:', '',
         '- **' || n1 || '** → `' || v1 || '`', CASE WHEN NOT single THEN '- **' || n2 || '** → `' || v2 || '`' END, '',
         '**Modified Files:** 3 .csproj files', '',
         CASE WHEN p_partkey % 3 = 1 THEN concat_ws(chr(10), '## Code Migrations', '', 'Applied 1 migration rules:', '', '- Rule',
              '', '**Modified Files:** 5 C# files', '')
              WHEN p_partkey % 3 = 2 THEN concat_ws(chr(10), '## Code Migrations', '',
              'No migration rules were applicable to this update.', '') END,
         '---', '*This merge request was created automatically.*') AS description,
         concat_ws(chr(10), '## NuGet Package Update', '', 'This merge request updates the following NuGet package:',
           '- **Package**: ' || n1, '- **New Version**: ' || v1, '', '### Files Modified:', '- `' || path || '`') AS single_description
       FROM named_parts""",
)
def request_descriptions(spark, sf):
    kind = F.col("p_partkey") % 3
    rules = F.when(kind == 1, F.array(F.lit("Rule"))).otherwise(F.array().cast("array<string>"))
    first = F.col("packages")[0]
    return _packages(spark, sf).select(
        "p_partkey",
        naming.request_description(F.col("packages"), F.lit(3), rules, F.lit(5), kind != 0).alias("description"),
        naming.single_package_description(first["name"], first["version"], F.array("path")).alias("single_description"),
    )


# ---- publishing ----------------------------------------------------------------------------------


@query(
    "updated_packages",
    """SELECT repo_id, string_agg(name, ',' ORDER BY ord) AS packages, any_value(files) AS project_files FROM (
         SELECT repo_id, target_ord AS ord, target_name AS name, (SELECT count(*) FROM decided d2
           WHERE d2.repo_id = d.repo_id AND d2.decision IN ('update', 'update_unparsed')) AS files
         FROM decided d WHERE decision IN ('update', 'update_unparsed') GROUP BY ALL) GROUP BY repo_id""",
)
def updated_packages(spark, sf):
    done = publish.rewrite_project_files(s.project_files(spark, sf), s.TARGETS)
    listed = publish.updated_packages(done)
    return listed.select(
        "repo_id", F.array_join(F.transform("packages", lambda p: p["name"]), ",").alias("packages"), "project_files"
    )


def _migrated(spark, sf):
    """Stand-in for migrated code files: per document two possible rules."""
    key = F.col("doc_id")
    rule = lambda i, n: F.struct(F.lit(i).alias("rule_ord"), F.lit(n).alias("name"))
    return s.table(spark, sf, "documents").select(
        (key % 97).cast("string").alias("repo_id"),
        F.concat(F.lit("src/D"), s.text("doc_id"), F.lit(".cs")).alias("path"),
        F.when(key % 5 == 0, F.array(rule(0, "Zeta"), rule(1, "Alpha"))).otherwise(F.array(rule(1, "Alpha"))).alias("applied"),
    )


s.SQL["changed_files"] = "SELECT * FROM decided WHERE decision IN ('update', 'update_unparsed')"
s.SQL["migrated"] = """
SELECT CAST(doc_id % 97 AS VARCHAR) AS repo_id, 'src/D' || doc_id || '.cs' AS path, doc_id % 5 = 0 AS two_rules FROM documents"""


@query(
    "commit_files",
    """SELECT repo_id, CAST(1 AS BIGINT) AS commit_no, path FROM changed_files
       UNION ALL SELECT repo_id, 2, path FROM migrated WHERE repo_id IN (SELECT repo_id FROM changed_files)""",
)
def commit_files(spark, sf):
    done = publish.rewrite_project_files(s.project_files(spark, sf), s.TARGETS)
    return publish.commit_files(done, _migrated(spark, sf)).withColumn("commit_no", F.col("commit_no").cast("bigint"))


@query(
    "merge_request_plan",
    """SELECT c.repo_id, r.default_branch AS target_branch, 'update-red plate-small widget-1700000000' AS source_branch,
              CASE WHEN n = 1 THEN 'Update ' || one || ' to version ' || one_v ELSE 'Update ' || n || ' NuGet packages' END
              || CASE WHEN m.repo_id IS NOT NULL THEN ' + Code Migrations' ELSE '' END AS title,
              CASE WHEN n = 1 THEN 'Update ' || one || ' to version ' || one_v ELSE 'Update ' || n || ' packages: ' || listed END
                AS package_commit,
              CASE WHEN m.rules = 1 THEN 'Apply code migration: Alpha' WHEN m.rules = 2 THEN 'Apply code migrations: 2 rules' END
                AS migration_commit,
              c.project_files, coalesce(m.code_files, 0) AS code_files
       FROM (SELECT repo_id, count(*) AS n, min(target_name) AS one, min(new_version) AS one_v,
                    string_agg(target_name || ' to ' || new_version, ', ' ORDER BY target_ord) AS listed,
                    CAST(sum(files) AS BIGINT) AS project_files
             FROM (SELECT repo_id, target_ord, target_name, new_version, count(*) AS files FROM changed_files GROUP BY ALL)
             GROUP BY repo_id) c
       LEFT JOIN (SELECT repo_id, CASE WHEN bool_or(two_rules) THEN 2 ELSE 1 END AS rules, count(*) AS code_files
                  FROM migrated GROUP BY repo_id) m ON m.repo_id = c.repo_id
       LEFT JOIN repos r ON r.id = c.repo_id""",
)
def merge_request_plan(spark, sf):
    done = publish.rewrite_project_files(s.project_files(spark, sf), s.TARGETS)
    branches = s.repos(spark, sf).select(F.col("id").alias("repo_id"), F.col("default_branch").alias("target_branch"))
    plan = publish.merge_request_plan(done, _migrated(spark, sf), branches, _EPOCH, s.TARGETS)
    return plan.drop("description")


@query(
    "publishable_files",
    """SELECT repo_id, path FROM changed_files WHERE repo_id NOT IN
         (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error' AND event_id % 40 = 0)""",
)
def publishable_files(spark, sf):
    results = s.table(spark, sf, "events").select(
        s.text("user_id").alias("repo_id"),
        (~((F.col("event_type") == "error") & (F.col("event_id") % 40 == 0))).alias("ok"),
    )
    done = publish.rewrite_project_files(s.project_files(spark, sf), s.TARGETS).select("repo_id", "path")
    return publish.publishable(done, results)


@query(
    "failed_repositories",
    "SELECT id AS repo_id FROM repos WHERE id NOT IN (SELECT repo_id FROM changed_files)",
)
def failed_repositories(spark, sf):
    done = publish.rewrite_project_files(s.project_files(spark, sf), s.TARGETS).select("repo_id").distinct()
    return publish.requested_but_failed(s.repos(spark, sf).select(F.col("id").alias("repo_id")), done)


@query(
    "run_outcome",
    """SELECT count_if(ok) AS succeeded, count_if(NOT ok) AS failed, count(*) AS total, count_if(undone) AS rollbacks FROM (
         SELECT id IN (SELECT repo_id FROM changed_files) AS ok,
                id IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error') AS undone FROM repos)""",
)
def run_outcome(spark, sf):
    done = publish.rewrite_project_files(s.project_files(spark, sf), s.TARGETS)
    undone = s.table(spark, sf, "events").filter(F.col("event_type") == "error").select(s.text("user_id").alias("repo_id"))
    return publish.run_outcome(s.repos(spark, sf).select(F.col("id").alias("repo_id")), done, undone)


@query(
    "undo_plan",
    """SELECT txn_id, seq, description, row_number() OVER (PARTITION BY txn_id ORDER BY seq DESC) AS undo_order
       FROM action_log WHERE txn_id NOT IN (SELECT txn_id FROM succeeded_txns)""",
)
def undo_plan(spark, sf):
    plan = publish.undo_plan(s.action_log(spark, sf), s.succeeded_txns(spark, sf))
    return plan.select("txn_id", "seq", "description", "undo_order")


@query(
    "undo_outcomes",
    """SELECT txn_id, bool_and(error IS NULL) AS success, count_if(error IS NULL) AS completed,
              count_if(error IS NOT NULL) AS failed FROM action_log GROUP BY txn_id""",
)
def undo_outcomes(spark, sf):
    return publish.undo_outcomes(s.action_log(spark, sf))


@query(
    "undo_report_lines",
    """SELECT txn_id, CAST(section AS BIGINT) AS section, CAST(seq AS BIGINT) AS seq, line FROM (
         SELECT txn_id, 0 AS section, 0 AS seq, '=== ROLLBACK REPORT ===' AS line FROM action_log GROUP BY txn_id
         UNION ALL SELECT txn_id, 1, 0, CASE WHEN bool_and(error IS NULL) THEN 'Rollback completed successfully'
                   ELSE 'Rollback completed with errors' END FROM action_log GROUP BY txn_id
         UNION ALL SELECT txn_id, 2, 0, chr(10) || 'Completed Actions:' FROM action_log WHERE error IS NULL GROUP BY txn_id
         UNION ALL SELECT txn_id, 4, 0, chr(10) || 'Failed Actions:' FROM action_log WHERE error IS NOT NULL GROUP BY txn_id
         UNION ALL SELECT txn_id, 3, -seq, '  • ' || description FROM action_log WHERE error IS NULL
         UNION ALL SELECT txn_id, 5, -seq, '  • ' || description || ': ' || error FROM action_log WHERE error IS NOT NULL)""",
)
def undo_report_lines(spark, sf):
    lines = publish.undo_report_lines(s.action_log(spark, sf))
    return lines.withColumn("section", F.col("section").cast("bigint"))


s.SQL["result_batches"] = """
SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS batch, event_type <> 'error' AS ok, event_id % 13 = 0 AS broken,
       'f' || (event_id % 20) AS file, event_type AS rule FROM events"""


def result_batches(spark, sf):
    from fleetbump.sources.landed import parse_migration_results

    key = F.col("event_id")
    body = F.to_json(
        F.struct(
            (F.col("event_type") != "error").alias("success"),
            F.array(F.concat(F.lit("f"), (key % 20).cast("string"))).alias("modified_files"),
            F.array("event_type").alias("applied_rules"),
            F.array(F.concat(F.lit("bad "), (key % 3).cast("string"))).alias("errors"),
        )
    )
    raw = s.table(spark, sf, "events").select(
        s.text("user_id").alias("run_id"),
        key.alias("batch"),
        F.when(key % 13 == 0, F.lit("tool crashed {")).otherwise(body).alias("output"),
    )
    return parse_migration_results(raw)


@query(
    "parsed_results",
    """SELECT run_id, batch, ok AND NOT broken AS success, CASE WHEN ok AND NOT broken THEN file ELSE '' END AS files,
              CASE WHEN ok AND NOT broken THEN rule ELSE '' END AS rules,
              CASE WHEN broken THEN 'Failed to parse tool output' WHEN NOT ok THEN 'bad ' || (batch % 3) ELSE '' END AS errors
       FROM result_batches""",
)
def parsed_results(spark, sf):
    return result_batches(spark, sf).select(
        "run_id",
        "batch",
        "success",
        F.array_join("modified_files", ",").alias("files"),
        F.array_join("applied_rules", ",").alias("rules"),
        F.array_join("errors", ",").alias("errors"),
    )


@query(
    "merged_results",
    """SELECT run_id, success, files, rules, errors,
              CASE WHEN errors > 0 THEN 'Migration completed with ' || errors || ' errors.'
                   WHEN files > 0 THEN 'Successfully applied ' || rules || ' rules to ' || files || ' files.'
                   ELSE 'No changes were needed.' END AS summary
       FROM (SELECT run_id, bool_and(ok AND NOT broken) AS success,
                    count(DISTINCT CASE WHEN ok AND NOT broken THEN file END) AS files,
                    count(DISTINCT CASE WHEN ok AND NOT broken THEN rule END) AS rules,
                    count(DISTINCT CASE WHEN broken THEN 'x' WHEN NOT ok THEN 'bad ' || (batch % 3) END) AS errors
             FROM result_batches GROUP BY run_id)""",
)
def merged_results(spark, sf):
    return publish.merge_results(result_batches(spark, sf))[0]


@query(
    "merged_result_names",
    """SELECT run_id, kind, value, min(batch) AS batch, CAST(0 AS BIGINT) AS pos FROM (
         SELECT run_id, batch, 'file' AS kind, file AS value FROM result_batches WHERE ok AND NOT broken
         UNION ALL SELECT run_id, batch, 'rule', rule FROM result_batches WHERE ok AND NOT broken
         UNION ALL SELECT run_id, batch, 'error', CASE WHEN broken THEN 'Failed to parse tool output' ELSE 'bad ' || (batch % 3) END
         FROM result_batches WHERE broken OR NOT ok) GROUP BY run_id, kind, value""",
)
def merged_result_names(spark, sf):
    names = publish.merge_results(result_batches(spark, sf))[1]
    return names.select("run_id", "kind", "value", "place.batch", F.col("place.pos").cast("bigint").alias("pos"))
