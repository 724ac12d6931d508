"""Repository and branch selection."""

from pyspark.sql import functions as F

from fleetbump.functions.patterns import comma_list, is_valid_spec, percent_encode, spec_parts, truncate
from fleetbump.operators import catalog
from fleetbump.queries import standins as s
from fleetbump.queries.registry import query


@query(
    "files_by_extension",
    """SELECT repo_id, path FROM (
         SELECT CAST(l_suppkey AS VARCHAR) AS repo_id, l_orderkey || '/' || l_linenumber || '-' || l_partkey ||
                CASE l_partkey % 3 WHEN 0 THEN '.csproj' WHEN 1 THEN '.CSPROJ' ELSE '.cs' END AS path,
                l_returnflag <> 'R' AS is_file FROM lineitem)
       WHERE is_file AND suffix(path, '.csproj')""",
)
def files_by_extension(spark, sf):
    part = F.col("l_partkey") % 3
    name = F.concat(
        s.text("l_orderkey"),
        F.lit("/"),
        s.text("l_linenumber"),
        F.lit("-"),
        s.text("l_partkey"),
        F.when(part == 0, F.lit(".csproj")).when(part == 1, F.lit(".CSPROJ")).otherwise(F.lit(".cs")),
    )
    tree = s.table(spark, sf, "lineitem").select(
        s.text("l_suppkey").alias("repo_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("tree")).otherwise(F.lit("blob")).alias("type"),
        name.alias("name"),
        name.alias("path"),
    )
    return catalog.with_extension(tree, ".csproj").select("repo_id", "path")


@query(
    "repositories_not_ignored",
    """SELECT id, path_with_namespace FROM repos
       WHERE NOT (suffix(lower(name), '7') OR starts_with(lower(path_with_namespace), 'nation_1/')
                  OR regexp_matches(lower(name), '#0000000[4-6]3$'))""",
)
def repositories_not_ignored(spark, sf):
    globs = ["*7", "NATION_1/*", "*#0000000[4-6]3"]
    return catalog.drop_ignored(s.repos(spark, sf), globs).select("id", "path_with_namespace")


@query("repositories_without_forks", "SELECT id, name FROM repos WHERE NOT is_fork")
def repositories_without_forks(spark, sf):
    return catalog.drop_forks(s.repos(spark, sf)).select("id", "name")


@query(
    "repositories_in_group",
    "SELECT id, path_with_namespace FROM repos WHERE starts_with(path_with_namespace, 'nation_1/') AND NOT archived",
)
def repositories_in_group(spark, sf):
    # Ownership is asked for but does not count once a group is given.
    return catalog.in_scope(s.repos(spark, sf), group="nation_1", owned=True).select("id", "path_with_namespace")


@query("repositories_owned_by_members", "SELECT id, name FROM repos WHERE owned AND member")
def repositories_owned_by_members(spark, sf):
    found = catalog.in_scope(s.repos(spark, sf), owned=True, member=True, include_archived=True)
    return found.select("id", "name")


@query("branches_by_glob", "SELECT repo_id, name FROM branches WHERE regexp_matches(name, '^release/.*[13]..$')")
def branches_by_glob(spark, sf):
    return catalog.matching_branches(s.branches(spark, sf), "release/*[13]??").select("repo_id", "name")


_SPECS = """SELECT p_partkey AS ord, p_name || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '@' || p_size END
                   || CASE WHEN p_partkey % 7 = 0 THEN '@x' ELSE '' END AS spec FROM part"""


def _specs(spark, sf):
    key = F.col("p_partkey")
    return s.table(spark, sf, "part").select(
        key.alias("ord"),
        F.concat(
            "p_name",
            F.when(key % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("@"), s.text("p_size"))),
            F.when(key % 7 == 0, F.lit("@x")).otherwise(F.lit("")),
        ).alias("spec"),
    )


@query(
    "targets_from_specs",
    f"SELECT ord, split_part(spec, '@', 1) AS name, split_part(spec, '@', 2) AS version FROM ({_SPECS}) "
    "WHERE len(string_split(spec, '@')) = 2",
)
def targets_from_specs(spark, sf):
    return catalog.parse_specs(_specs(spark, sf))[0]


@query("rejected_specs", f"SELECT ord, spec FROM ({_SPECS}) WHERE len(string_split(spec, '@')) <> 2")
def rejected_specs(spark, sf):
    return catalog.parse_specs(_specs(spark, sf))[1]


@query(
    "requested_repositories",
    """SELECT q.key, q.ord, r.id, r.path_with_namespace FROM requests q
       LEFT JOIN repos r ON q.key = r.id OR q.key = r.path_with_namespace""",
)
def requested_repositories(spark, sf):
    found = catalog.resolve_requests(s.requests(spark, sf), s.repos(spark, sf))
    return found.select("key", "ord", "id", "path_with_namespace")


@query(
    "requests_not_found",
    """SELECT key, ord FROM requests WHERE key NOT IN (SELECT id FROM repos)
       AND key NOT IN (SELECT path_with_namespace FROM repos)""",
)
def requests_not_found(spark, sf):
    return catalog.unresolved_requests(s.requests(spark, sf), s.repos(spark, sf)).select("key", "ord")


@query(
    "most_recent_branch",
    """SELECT repo_id, name AS recent_branch FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, ord) AS n
         FROM branches WHERE committed_at IS NOT NULL) WHERE n = 1""",
)
def most_recent_branch(spark, sf):
    return catalog.most_recent_branch(s.branches(spark, sf))


@query(
    "target_branch_choice",
    """SELECT r.id, coalesce(b.name, r.default_branch) AS target_branch FROM repos r LEFT JOIN (
         SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, ord) AS n
         FROM branches WHERE committed_at IS NOT NULL AND starts_with(name, 'release/')) b
       ON r.id = b.repo_id AND b.n = 1""",
)
def target_branch_choice(spark, sf):
    chosen = catalog.with_target_branch(s.repos(spark, sf), s.branches(spark, sf), "release/*")
    return chosen.select("id", "target_branch")


@query("first_repositories", "SELECT id, name FROM repos ORDER BY ord LIMIT 25")
def first_repositories(spark, sf):
    return catalog.first_repositories(s.repos(spark, sf), 25).select("id", "name")


@query(
    "comma_separated_values",
    """SELECT doc_id, count(*) AS n, md5(string_agg(item, '|' ORDER BY i)) AS items_md5 FROM (
         SELECT doc_id, i, trim(parts[i], ' ' || chr(10)) AS item FROM (
           SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
             SELECT doc_id, string_split(text, ',') AS parts FROM documents)))
       WHERE item <> '' GROUP BY doc_id""",
)
def comma_separated_values(spark, sf):
    items = comma_list(F.col("text"))
    listed = s.table(spark, sf, "documents").select("doc_id", items.alias("items")).filter(F.size("items") > 0)
    return listed.select(
        "doc_id", F.size("items").cast("bigint").alias("n"), F.md5(F.array_join("items", "|").cast("binary")).alias("items_md5")
    )


@query(
    "spec_validity",
    f"SELECT len(string_split(spec, '@')) = 2 AS valid, count(*) AS n, min(split_part(spec, '@', 1)) AS first_name "
    f"FROM ({_SPECS}) GROUP BY 1",
)
def spec_validity(spark, sf):
    checked = _specs(spark, sf).withColumn("valid", is_valid_spec(F.col("spec")))
    return checked.groupBy("valid").agg(
        F.count(F.lit(1)).alias("n"), F.min(spec_parts(F.col("spec"))[0]).alias("first_name")
    )


@query(
    "short_descriptions",
    """SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short,
              CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS shorter FROM documents""",
)
def short_descriptions(spark, sf):
    return s.table(spark, sf, "documents").select(
        "doc_id", truncate(F.col("text"), 100).alias("short"), truncate(F.col("text"), 60).alias("shorter")
    )


@query(
    "encoded_paths",
    """SELECT page_id, replace(url_encode(url), '/', '%2F') AS encoded,
              url_encode(html || '*~-_. +') AS encoded_html FROM pages""",
)
def encoded_paths(spark, sf):
    return s.table(spark, sf, "pages").select(
        "page_id",
        percent_encode(F.col("url")).alias("encoded"),
        percent_encode(F.concat(F.col("html"), F.lit("*~-_. +"))).alias("encoded_html"),
    )
