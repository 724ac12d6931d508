"""Version order, upgrade decisions and the rules a move triggers."""

from pyspark.sql import functions as F

from fleetbump.functions.versions import version_eq, version_key, version_le, version_lt
from fleetbump.operators import rules
from fleetbump.plans import upgrade
from fleetbump.queries import standins as s
from fleetbump.queries.registry import query


@query(
    "version_order",
    """SELECT package, repo_id, first(version ORDER BY key, version) AS oldest, last(version ORDER BY key, version) AS newest,
              count(DISTINCT key) AS distinct_versions
       FROM package_refs WHERE key IS NOT NULL GROUP BY package, repo_id""",
)
def version_order(spark, sf):
    # A version of a repository is read once; a list of one key or none keeps its test from reading it again.
    different = s.package_refs(spark, sf).select("package", "repo_id", "version").distinct()
    keyed = different.select("package", "repo_id", "version", F.explode(F.array_compact(F.array(version_key("version")))).alias("key"))
    place = F.struct("key", "version")
    return keyed.groupBy("package", "repo_id").agg(
        F.min(place)["version"].alias("oldest"),
        F.max(place)["version"].alias("newest"),
        F.count_distinct("key").alias("distinct_versions"),
    )


@query(
    "unreadable_versions",
    "SELECT version, count(*) AS n FROM package_refs WHERE key IS NULL GROUP BY version",
)
def unreadable_versions(spark, sf):
    counted = s.package_refs(spark, sf).groupBy("version").agg(F.count(F.lit(1)).alias("n"))
    # A test that reads the count stays behind the grouping, so each version is read once.
    return counted.filter(F.when(version_key("version").isNull(), F.col("n")).isNotNull())


@query(
    "version_comparisons",
    """SELECT repo_id, count_if(key < [25, 4, 9, 0, 0, 1, 0]) AS older, count_if(key <= [25, 4, 9, 0, 0, 1, 0]) AS not_newer,
              count_if(key = [25, 4, 9, 0, 0, 1, 0]) AS same, count_if(key IS NULL) AS unreadable
       FROM package_refs GROUP BY repo_id""",
)
def version_comparisons(spark, sf):
    new = F.lit("25.4.0")
    refs = s.package_refs(spark, sf)
    # Each different version is compared once; what holds is joined back to the counts of its rows.
    compared = refs.select(F.col("version").alias("of")).distinct().select(
        "of",
        version_lt("of", new).alias("older"),
        version_le("of", new).alias("not_newer"),
        version_eq("of", new).alias("same"),
        version_key("of").isNull().alias("unreadable"),
    )
    counted = refs.groupBy("repo_id", "version").agg(F.count(F.lit(1)).alias("n"))
    found = counted.join(compared, F.col("version").eqNullSafe(F.col("of")))
    tests = ("older", "not_newer", "same", "unreadable")
    return found.groupBy("repo_id").agg(*[F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).alias(c) for c in tests])


@query(
    "upgrade_decisions",
    "SELECT repo_id, path, package, version, new_version, decision FROM decided",
)
def upgrade_decisions(spark, sf):
    refs = s.package_refs(spark, sf)
    targets = upgrade.targets_table(spark, s.TARGETS)
    return upgrade.reference_decisions(refs, targets).select(
        "repo_id", "path", "package", "version", "new_version", "decision"
    )


@query(
    "upgrade_decisions_with_downgrades",
    """SELECT new_version, CASE decision WHEN 'downgrade_blocked' THEN 'update' ELSE decision END AS decision,
              count(*) AS n FROM decided GROUP BY ALL""",
)
def upgrade_decisions_with_downgrades(spark, sf):
    refs = s.package_refs(spark, sf)
    targets = upgrade.targets_table(spark, s.TARGETS)
    decided = upgrade.reference_decisions(refs, targets, allow_downgrade=True)
    return decided.groupBy("new_version", "decision").agg(F.count(F.lit(1)).alias("n"))


@query(
    "references_of_targets",
    """SELECT r.repo_id, r.path, t.name AS target_name, t.version AS new_version
       FROM package_refs r JOIN targets t ON lower(r.package) = lower(t.name)""",
)
def references_of_targets(spark, sf):
    targets = upgrade.targets_table(spark, s.TARGETS)
    joined = upgrade.join_targets(s.package_refs(spark, sf), targets)
    return joined.select("repo_id", "path", "target_name", "new_version")


_HOLDS = """CASE c.type WHEN 'greater_than' THEN t.key > c.low AND {old} <= c.low
                        WHEN 'greater_than_or_equal' THEN t.key >= c.low AND {old} < c.low
                        WHEN 'exact' THEN t.key = c.low
                        ELSE t.key >= c.low AND t.key <= c.high END"""


def _moves(spark, sf):
    targets = upgrade.targets_table(spark, s.TARGETS)
    joined = upgrade.join_targets(s.package_refs(spark, sf), targets)
    return joined.select("repo_id", "path", "package", F.col("version").alias("old_version"), "new_version")


@query(
    "triggered_migrations",
    f"""SELECT DISTINCT r.repo_id, r.path, r.package, r.version AS old_version, t.version AS new_version, c.migration_id
        FROM package_refs r JOIN targets t ON lower(r.package) = lower(t.name)
        JOIN conditions c ON c.package = lower(r.package)
        WHERE r.key IS NOT NULL AND {_HOLDS.format(old='r.key')}""",
)
def triggered_migrations(spark, sf):
    found = rules.applicable(_moves(spark, sf), rules.migrations_table(spark, s.MIGRATIONS))
    return found.select("repo_id", "path", "package", "old_version", "new_version", "migration_id")


@query(
    "triggered_migrations_from_zero",
    f"""SELECT c.migration_id, count(DISTINCT r.path) AS files FROM package_refs r
        JOIN targets t ON lower(r.package) = lower(t.name) JOIN conditions c ON c.package = lower(r.package)
        WHERE {_HOLDS.format(old='[0, 0, 9, 0, 0, 1, 0]')} GROUP BY c.migration_id""",
)
def triggered_migrations_from_zero(spark, sf):
    found = rules.applicable(_moves(spark, sf), rules.migrations_table(spark, s.MIGRATIONS), from_zero=True)
    return found.groupBy("migration_id").agg(F.count_distinct("path").alias("files"))


@query(
    "version_conditions",
    f"""SELECT r.version AS old_version, count(*) AS n, count_if(m.hit) AS crossing FROM package_refs r JOIN
          (SELECT r2.path, r2.repo_id, bool_or({_HOLDS.format(old='r2.key')} AND r2.key IS NOT NULL) AS hit
           FROM package_refs r2 JOIN targets t ON t.ord = 0 JOIN conditions c ON c.migration_id = 'plates'
           GROUP BY ALL) m ON m.path = r.path AND m.repo_id = r.repo_id GROUP BY 1""",
)
def version_conditions(spark, sf):
    """Condition test on its own: every reference moved to the first target under the first rule set."""
    from fleetbump.functions.versions import crosses, usable_conditions

    conditions = rules.migrations_table(spark, s.MIGRATIONS[:1]).select(usable_conditions(F.col("version_conditions")).alias("c"))
    literal = conditions.first()["c"]  # one configuration row
    usable = F.array(
        *[
            F.struct(F.lit(c["type"]).alias("type"), F.lit(c["low"]).alias("low"), F.lit(c["high"]).cast("string").alias("high"))
            for c in literal
        ]
    )
    hit = crosses(usable, version_key("version"), version_key(F.lit(s.TARGETS[0].version)))
    # A version is tested once, not once for each reference to it.
    counted = s.package_refs(spark, sf).groupBy("version").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        F.col("version").alias("old_version"), "n", F.when(hit, F.col("n")).otherwise(F.lit(0)).alias("crossing")
    )


@query(
    "migrations_by_package_and_id",
    """SELECT r.path, 'plates' AS migration_id FROM package_refs r WHERE lower(r.package) = 'red plate'""",
)
def migrations_by_package_and_id(spark, sf):
    chosen = rules.by_package_and_id(rules.migrations_table(spark, s.MIGRATIONS), "RED PLATE", "plates")
    side = F.broadcast(chosen.select(F.lower("package_name").alias("_p"), F.col("id").alias("migration_id")))
    refs = s.package_refs(spark, sf)
    return refs.join(side, F.lower(refs.package) == F.col("_p")).select("path", "migration_id")
