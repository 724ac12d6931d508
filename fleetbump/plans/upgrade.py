"""The upgrade plan: what a fleet-wide version bump would change, without changing anything.

File contents are read once and reduced to a few values in the same stage as the scan; only
repository ids, paths, versions and counts are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetbump.functions.naming import TITLE_SUFFIX, branch_name, request_title
from fleetbump.functions.references import Target, all_references, deciding_references, mentions_any
from fleetbump.functions.versions import is_update, upgrade_decision, version_key
from fleetbump.operators.catalog import with_target_branch
from fleetbump.operators.rules import applicable, contains_any, migrations_table, preview_terms


def targets_table(spark: SparkSession, targets: list[Target]) -> DataFrame:
    return spark.createDataFrame(
        [(i, t.name, t.version) for i, t in enumerate(targets)], "ord int, name string, version string"
    )


def packages_literal(targets: list[Target]) -> Column:
    return F.array(*[F.struct(F.lit(t.name).alias("name"), F.lit(t.version).alias("version")) for t in targets])


def package_references(files: DataFrame) -> DataFrame:
    """Every reference in project files: (repo_id, ref, path, layout, occurrence, package, version)."""
    found = files.filter(F.col("path").endswith(".csproj")).select(
        "repo_id", "ref", "path", F.explode(all_references(F.col("content"))).alias("r")
    )
    return found.select("repo_id", "ref", "path", "r.*")


def join_targets(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References with the targets of the same package, whatever the case of the name."""
    side = targets.select(
        F.lower("name").alias("_name"),
        F.col("ord").alias("target_ord"),
        F.col("name").alias("target_name"),
        F.col("version").alias("new_version"),
        version_key("version").alias("_new"),
    )
    return references.withColumn("_name", F.lower("package")).join(side, "_name").drop("_name")


def reference_decisions(
    references: DataFrame, targets: DataFrame, allow_downgrade: bool = False
) -> DataFrame:
    joined = join_targets(references, targets)
    return joined.withColumn(
        "decision",
        upgrade_decision(
            F.col("version"), F.col("new_version"), version_key("version"), F.col("_new"), allow_downgrade
        ),
    ).drop("_new")


def file_decisions(files: DataFrame, targets: list[Target], allow_downgrade: bool = False) -> DataFrame:
    """One decision per (project file, target), taken on the reference that decides for the file."""
    held = F.col("path").endswith(".csproj") & mentions_any(F.col("content"), targets)
    deciding = files.filter(held).select(
        "repo_id", "ref", "path", F.explode(deciding_references(F.col("content"))).alias("r")
    )
    flat = deciding.select("repo_id", "ref", "path", "r.*")
    return reference_decisions(flat, targets_table(files.sparkSession, targets), allow_downgrade)


def repository_updates(decisions: DataFrame) -> DataFrame:
    """Per (repository, ref, target): files to change and the distinct old versions as one text."""
    return (
        decisions.filter(is_update(F.col("decision")))
        .groupBy("repo_id", "ref", "target_ord", "target_name", "new_version")
        .agg(
            F.count(F.lit(1)).alias("project_files"),
            F.array_join(F.array_sort(F.collect_set("version")), ", ").alias("old_versions"),
        )
    )


def triggered_rules(spark: SparkSession, targets: list[Target], migrations: list[dict]) -> dict[int, list[dict]]:
    """Rules each target triggers coming from version 0.0.0 (target position -> rules).

    Both sides are configuration, so this small join is resolved while the plan is built.
    """
    if not targets or not migrations:
        return {}
    moves = targets_table(spark, targets).select(
        F.col("ord").alias("target_ord"), F.col("name").alias("package"), F.col("version").alias("new_version")
    )
    hits = applicable(moves, migrations_table(spark, migrations), from_zero=True)
    out: dict[int, list[dict]] = {}
    for row in hits.select("target_ord", "migration_ord").orderBy("target_ord", "migration_ord").toLocalIterator():
        out.setdefault(row.target_ord, []).extend(migrations[row.migration_ord].get("rules") or [])
    return {k: rules for k, rules in out.items() if rules}


def code_hits(files: DataFrame, rules_by_target: dict[int, list[dict]]) -> DataFrame:
    """(repo_id, ref, path, target_ord) for code files that hold a name the target's rules look for."""
    tests = []
    for ord_, rules in rules_by_target.items():
        terms = preview_terms(rules)
        if terms:
            tests.append(F.when(contains_any(F.col("content"), terms), F.lit(ord_)))
    code = files.filter(F.col("path").endswith(".cs"))
    hit = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<int>")
    return code.select("repo_id", "ref", "path", F.explode(hit).alias("target_ord"))


def without_existing_request(chosen: DataFrame, merge_requests: DataFrame, titles: list[str]) -> DataFrame:
    """Flag repositories that already have an open request of this title for the target branch."""
    open_ones = (
        merge_requests.filter((F.col("state") == "opened") & F.col("title").isin(titles))
        .select(F.col("repo_id").alias("id"), "target_branch", F.lit(True).alias("has_request"))
        .distinct()
    )
    return chosen.join(open_ones, ["id", "target_branch"], "left").withColumn(
        "has_request", F.coalesce("has_request", F.lit(False))
    )


def request_titles(targets: list[Target]) -> list[str]:
    title = (
        f"Update {targets[0].name} to version {targets[0].version}"
        if len(targets) == 1
        else f"Update {len(targets)} NuGet packages"
    )
    # A request that carried migrations has the longer title; both count as the same update.
    return [title, title + TITLE_SUFFIX]


def plan_packages(
    repos: DataFrame,
    files: DataFrame,
    merge_requests: DataFrame,
    targets: list[Target],
    migrations: list[dict],
    branches: DataFrame | None = None,
    branch_glob: str | None = None,
    allow_downgrade: bool = False,
) -> DataFrame:
    """One row per (repository, target): files to change, old versions, code files, rules, outcome."""
    spark = repos.sparkSession
    rules = triggered_rules(spark, targets, migrations)
    chosen = without_existing_request(
        with_target_branch(repos, branches, branch_glob).select("id", "name", "target_branch", "ord"),
        merge_requests,
        request_titles(targets),
    )
    cells = file_cells(of_wanted(files, chosen.select(F.col("id").alias("repo_id"), F.col("target_branch").alias("ref"))), targets, rules, allow_downgrade)
    cells = cells.withColumnsRenamed({"repo_id": "id", "ref": "target_branch"})
    # One more cell a repository than there are targets: that of its file listing.
    each = F.array(
        F.struct(
            F.lit(_LISTING).alias("target_ord"),
            F.lit(None).cast("string").alias("package"),
            F.lit(None).cast("string").alias("new_version"),
            F.lit(0).alias("rules"),
        ),
        *[
            F.struct(
                F.lit(i).alias("target_ord"),
                F.lit(t.name).alias("package"),
                F.lit(t.version).alias("new_version"),
                F.lit(len(rules.get(i, []))).alias("rules"),
            )
            for i, t in enumerate(targets)
        ],
    )
    # Partitioned as ``plan_repositories`` groups, so its rows stay where they are.
    listed = Window.partitionBy("id", "name", "target_branch")
    rows = (
        chosen.withColumn("t", F.explode(each))
        .select("*", "t.*")
        .drop("t")
        .join(cells, ["id", "target_branch", "target_ord"], "left")
        .withColumn("has_projects", F.max("projects").over(listed))
        .withColumn("has_code", F.max("code").over(listed))
    )
    return (
        rows.filter(F.col("target_ord") != _LISTING)
        .drop("projects", "code")
        .withColumn("project_files", F.coalesce("project_files", F.lit(0)))
        .withColumn("code_files", F.coalesce("code_files", F.lit(0)))
        .withColumn("has_migrations", (F.col("rules") > 0) & (F.coalesce("has_code", F.lit(0)) > 0))
    )


# Words of 64 bits of the filter on (repository, ref): half a megabyte, whatever the size of the fleet.
_WORDS = 1 << 16
_LISTING = -1


def of_wanted(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files whose (repo_id, ref) may be among the wanted ones, without a shuffle.

    A bit for each wanted pair's hash is looked up in the scan's own stage, before any text is looked at. Few other files
    pass where there are far fewer pairs than bits; what passes is left to the join that follows.
    """

    def place(repo: str, ref: str) -> Column:
        return F.pmod(F.xxhash64(repo, ref), F.lit(_WORDS * 64))

    word = (place("repo_id", "ref") / 64).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place("repo_id", "ref"), F.lit(64)).cast("int"))
    spark = files.sparkSession
    set_bits = wanted.select(word.alias("w"), bit.alias("b"))
    words = spark.range(_WORDS).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b")).unionByName(set_bits)
    filled = words.groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = filled.agg(F.sort_array(F.collect_list(F.struct("w", "b")))["b"].alias("bits")).scalar()
    return files.filter(F.get(bits, word).bitwiseAND(bit) != 0)


def file_cells(files: DataFrame, targets: list[Target], rules_by_target: dict[int, list[dict]], allow_downgrade: bool) -> DataFrame:
    """Per (repo_id, ref, target_ord): project files to change, their old versions, code files that name what rules look for.

    The cell of no target counts the project and code files there are. Each file is looked at once and gives one array of
    entries; equal entries are added up before they cross a shuffle.
    """
    path, content = F.col("path"), F.col("content")
    project, code = path.endswith(".csproj"), path.endswith(".cs")

    def entry(kind: str, name: Column | None = None, version: Column | None = None, ord_: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"),
            (none if name is None else name).alias("_name"),
            (none if version is None else version).alias("version"),
            (F.lit(_LISTING) if ord_ is None else ord_).alias("target_ord"),
        )

    references = F.when(mentions_any(content, targets), deciding_references(content))
    of_project = F.concat(
        F.array(entry("projects")),
        F.coalesce(
            F.transform(references, lambda r: entry("reference", F.lower(r["package"]), r["version"])),
            F.array().cast("array<struct<kind:string,_name:string,version:string,target_ord:int>>"),
        ),
    )
    tests = [
        F.when(contains_any(content, terms), entry("hit", ord_=F.lit(ord_)))
        for ord_, rules in rules_by_target.items()
        if (terms := preview_terms(rules))
    ]
    of_code = F.array_compact(F.array(entry("code"), *tests))
    entries = files.filter(project | code).select(
        "repo_id", "ref", F.explode(F.when(project, of_project).otherwise(of_code)).alias("e")
    ).select("repo_id", "ref", "e.*")
    side = targets_table(files.sparkSession, targets).select(
        F.lower("name").alias("_name"), F.col("ord").alias("_ord"), F.col("version").alias("_version"), version_key("version").alias("_new")
    )
    decided = entries.join(side, "_name", "left")
    decision = upgrade_decision(
        F.col("version"), F.col("_version"), version_key("version"), F.col("_new"), allow_downgrade
    )
    is_reference = F.col("kind") == "reference"
    kept = decided.filter(~is_reference | (F.col("_ord").isNotNull() & is_update(decision))).select(
        "repo_id", "ref", F.coalesce("_ord", "target_ord").alias("target_ord"), "kind", F.when(is_reference, F.col("version")).alias("version")
    )
    added = kept.groupBy("repo_id", "ref", "target_ord", "kind", "version").agg(F.count(F.lit(1)).alias("n"))

    def of(kind: str, name: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("n"))).alias(name)

    versions = F.array_sort(F.collect_list(F.when(is_reference, F.col("version"))))
    return added.groupBy("repo_id", "ref", "target_ord").agg(
        of("projects", "projects"),
        of("code", "code"),
        of("reference", "project_files"),
        F.when(F.count_if(is_reference) > 0, F.array_join(versions, ", ")).alias("old_versions"),
        of("hit", "code_files"),
    )


def plan_repositories(packages: DataFrame, targets: list[Target], epoch_seconds: int = 0) -> DataFrame:
    """One row per repository: outcome, totals, branch name, title and, per target, what changes."""
    has_projects = F.coalesce(F.max("has_projects"), F.lit(0)) > 0
    total = F.sum("project_files")
    migrates = F.max("has_migrations")
    literal = packages_literal(targets)
    return packages.groupBy("id", "name", "target_branch").agg(
        F.when(F.max("has_request"), F.lit("existing_request"))
        .when(~has_projects, F.lit("no_projects"))
        .when((total > 0) | migrates, F.lit("would_create"))
        .otherwise(F.lit("no_changes"))
        .alias("outcome"),
        total.alias("project_files"),
        F.sum("code_files").alias("code_files"),
        migrates.alias("has_migrations"),
        F.first(branch_name(literal, F.lit(epoch_seconds))).alias("source_branch"),
        F.first(request_title(literal)).alias("title"),
    )


def preview_summary(plan: DataFrame, not_found: DataFrame | None = None) -> DataFrame:
    """Fleet totals of a plan, one row.

    ``errors`` counts the rows of ``not_found``, the requested repositories that there are none of; without it,
    there is no such column.
    """

    def outcome(*names: str) -> Column:
        return F.count_if(F.col("outcome").isin(*names))

    created = F.col("outcome") == "would_create"
    totals = [
        F.count(F.lit(1)).alias("repositories"),
        outcome("would_create").alias("would_create"),
        outcome("existing_request").alias("existing_requests"),
        outcome("no_changes", "no_projects").alias("no_changes"),
        F.coalesce(F.sum(F.when(created, F.col("project_files"))), F.lit(0)).alias("project_files"),
        F.coalesce(F.sum(F.when(created, F.col("code_files"))), F.lit(0)).alias("code_files"),
    ]
    summary = plan.agg(*totals)
    if not_found is None:
        return summary
    return summary.withColumn("errors", not_found.agg(F.count(F.lit(1))).scalar())


def changed_paths(package_files: DataFrame, migrated_files: DataFrame) -> DataFrame:
    """Distinct changed files of both commits, by repository and path."""
    return (
        package_files.select("repo_id", "path")
        .unionByName(migrated_files.select("repo_id", "path"))
        .distinct()
        .orderBy("repo_id", "path")
    )


def preview_head(rows: DataFrame, keys: list[str], order: Column, k: int) -> DataFrame:
    """First ``k`` rows per group and how many more there are.

    Spark cuts every group to ``k`` rows inside each input task before the shuffle (for ``k`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``), and groups are counted by an aggregate, so a
    large group never meets in one task.
    """
    first = Window.partitionBy(*keys).orderBy(order)
    head = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    return head.join(totals, keys).withColumn("more", F.greatest(F.col("_total") - k, F.lit(0))).drop("_total")
