"""From rewritten files to what may be published: gates, commits, undo plans, run outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbump.functions.naming import (
    branch_name,
    commit_message,
    migration_commit_message,
    request_description,
    request_title,
)
from fleetbump.functions.references import UPDATED, Target, mentions_any, rewrite_references
from fleetbump.operators.ranking import number_rows, range_chunks


def rewrite_project_files(files: DataFrame, targets: list[Target], allow_downgrade: bool = False) -> DataFrame:
    """Rewritten project files and the targets each one received; untouched files are dropped."""
    if not targets:
        return files.limit(0).select("repo_id", "ref", "path", "content", F.array().cast(UPDATED).alias("updated"))
    done = F.array(rewrite_references(F.col("content"), targets, allow_downgrade))
    # Exploding the kept results evaluates the rewrite once per file; a filter on its outcome would be
    # pushed below the projection and evaluate it twice.
    return (
        files.filter(F.col("path").endswith(".csproj") & mentions_any(F.col("content"), targets))
        .select("repo_id", "ref", "path", F.explode(F.filter(done, lambda r: F.size(r["updated"]) > 0)).alias("_r"))
        .select("repo_id", "ref", "path", F.col("_r.content").alias("content"), F.col("_r.updated").alias("updated"))
    )


def updated_packages(rewritten: DataFrame) -> DataFrame:
    """Per repository: targets really updated, in target order, and files modified.

    The set holds at most one entry per target, so it is bounded by the target list.
    """
    per_target = rewritten.select("repo_id", "path", F.explode("updated").alias("u"))
    return per_target.groupBy("repo_id").agg(
        F.array_sort(F.collect_set("u")).alias("packages"), F.count_distinct("path").alias("project_files")
    )


def failed_repositories(results: DataFrame) -> DataFrame:
    """Repositories any of whose results failed (an aggregate: combined before the shuffle)."""
    return results.groupBy("repo_id").agg(F.bool_and("ok").alias("_ok")).filter(~F.col("_ok")).select("repo_id")


def publishable(outputs: DataFrame, results: DataFrame) -> DataFrame:
    """All or nothing: outputs of repositories without any failed result.

    The failed list is left to Spark to broadcast or shuffle by its measured size.
    """
    return outputs.join(failed_repositories(results), "repo_id", "left_anti")


def requested_but_failed(requested: DataFrame, succeeded: DataFrame) -> DataFrame:
    return requested.join(succeeded.select("repo_id"), "repo_id", "left_anti")


def undo_plan(actions: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Registered actions of unsuccessful transactions, last registered first."""
    open_ones = actions.join(succeeded.select("txn_id"), "txn_id", "left_anti")
    return number_rows(
        range_chunks(open_ones, ["txn_id"], ["seq"], like=actions),
        ["txn_id"],
        [F.col("seq").desc()],
        F.col("_range"),
        "undo_order",
        chunk_descending=True,
    ).drop("_range")


def undo_outcomes(executed: DataFrame) -> DataFrame:
    """Per transaction: did every undo action work, and how many did or did not."""
    ok = F.col("error").isNull()
    return executed.groupBy("txn_id").agg(
        F.bool_and(ok).alias("success"),
        F.count_if(ok).alias("completed"),
        F.count_if(~ok).alias("failed"),
    )


def undo_report_lines(executed: DataFrame) -> DataFrame:
    """The text report of each transaction as ordered lines (txn_id, section, seq, line).

    Kept as rows: a transaction with very many actions never becomes one value. Sort by section and
    seq to read it; actions are listed in the order they were undone.
    """
    outcome = undo_outcomes(executed)
    name = F.when(F.coalesce("description", F.lit("")) == "", F.lit("Unnamed rollback action")).otherwise(
        F.col("description")
    )
    ok = F.col("error").isNull()
    items = executed.select(
        "txn_id",
        F.when(ok, F.lit(3)).otherwise(F.lit(5)).alias("section"),
        (-F.col("seq")).alias("seq"),
        F.when(ok, F.concat(F.lit("  • "), name))
        .otherwise(F.concat(F.lit("  • "), name, F.lit(": "), F.col("error")))
        .alias("line"),
    )

    def heading(section: int, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("seq"), text.alias("line"))

    verdict = F.when(F.col("success"), F.lit("Rollback completed successfully")).otherwise(
        F.lit("Rollback completed with errors")
    )
    # All headings of a transaction come from its one outcome row, so the actions are grouped once.
    headings = F.array(
        heading(0, F.lit("=== ROLLBACK REPORT ===")),
        heading(1, verdict),
        F.when(F.col("completed") > 0, heading(2, F.lit("\nCompleted Actions:"))),
        F.when(F.col("failed") > 0, heading(4, F.lit("\nFailed Actions:"))),
    )
    return outcome.select("txn_id", F.explode(F.array_compact(headings)).alias("h")).select("txn_id", "h.*").unionByName(items)


def run_outcome(requested: DataFrame, succeeded: DataFrame, rolled_back: DataFrame) -> DataFrame:
    """One row: succeeded, failed, total, rollbacks."""
    marked = requested.select("repo_id").join(
        succeeded.select("repo_id", F.lit(1).alias("_ok")).distinct(), "repo_id", "left"
    )
    marked = marked.join(rolled_back.select("repo_id", F.lit(1).alias("_undone")).distinct(), "repo_id", "left")
    return marked.agg(
        F.count("_ok").alias("succeeded"),
        (F.count(F.lit(1)) - F.count("_ok")).alias("failed"),
        F.count(F.lit(1)).alias("total"),
        F.count("_undone").alias("rollbacks"),
    )


def commit_files(rewritten: DataFrame, migrated: DataFrame) -> DataFrame:
    """(repo_id, commit_no, path): project files go into commit 1, migrated code into commit 2.

    Both tables are read twice at most; pass written tables, not the rewriting jobs themselves.
    """
    first = rewritten.select("repo_id", F.lit(1).alias("commit_no"), "path")
    second = migrated.select("repo_id", F.lit(2).alias("commit_no"), "path")
    return first.unionByName(second.join(rewritten.select("repo_id").distinct(), "repo_id", "left_semi"))


def applied_rules(migrated: DataFrame) -> DataFrame:
    """Per repository: rules that changed a file, in rule order, and files changed.

    The set is bounded by the rule list (entries are struct<rule_ord, name>).
    """
    spread = migrated.select("repo_id", "path", F.explode_outer("applied").alias("a"))
    return spread.groupBy("repo_id").agg(
        F.transform(F.array_sort(F.collect_set("a")), lambda a: a["name"]).alias("rules"),
        F.count_distinct("path").alias("code_files"),
    )


def merge_request_plan(
    rewritten: DataFrame, migrated: DataFrame, target_branches: DataFrame, epoch_seconds: int, requested: list[Target]
) -> DataFrame:
    """One row per repository with changes: branches, title, description, both commit messages."""
    from fleetbump.plans.upgrade import packages_literal

    none = F.array().cast("array<string>")
    per_repo = (
        updated_packages(rewritten)
        .join(applied_rules(migrated), "repo_id", "left")
        .join(target_branches, "repo_id", "left")
        .withColumn("migrated", F.col("rules").isNotNull())
        .withColumn("rules", F.coalesce("rules", none))
        .withColumn("code_files", F.coalesce("code_files", F.lit(0)))
        .withColumn(
            "packages",
            F.transform("packages", lambda p: F.struct(p["name"].alias("name"), p["version"].alias("version"))),
        )
    )
    return per_repo.select(
        "repo_id",
        "target_branch",
        branch_name(packages_literal(requested), F.lit(epoch_seconds)).alias("source_branch"),
        request_title(F.col("packages"), F.size("rules") > 0).alias("title"),
        request_description(
            F.col("packages"), F.col("project_files"), F.col("rules"), F.col("code_files"), F.col("migrated")
        ).alias("description"),
        commit_message(F.col("packages")).alias("package_commit"),
        F.when(F.size("rules") > 0, migration_commit_message(F.col("rules"))).alias("migration_commit"),
        "project_files",
        "code_files",
    )


def merge_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches of one run merged: (run_id, success, counts) and the distinct names as rows.

    Names stay rows (run_id, kind, value, first position) rather than one array per run.
    """
    spread = results.select(
        "run_id",
        "batch",
        F.explode(
            F.array(
                F.struct(F.lit("file").alias("kind"), F.col("modified_files").alias("items")),
                F.struct(F.lit("rule").alias("kind"), F.col("applied_rules").alias("items")),
                F.struct(F.lit("error").alias("kind"), F.col("errors").alias("items")),
            )
        ).alias("g"),
    ).select("run_id", "batch", "g.kind", F.posexplode("g.items").alias("pos", "value"))
    names = spread.groupBy("run_id", "kind", "value").agg(F.min(F.struct("batch", "pos")).alias("place"))
    counted = names.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "file").alias("files"),
        F.count_if(F.col("kind") == "rule").alias("rules"),
        F.count_if(F.col("kind") == "error").alias("errors"),
    )
    runs = results.groupBy("run_id").agg(F.bool_and("success").alias("success")).join(counted, "run_id", "left")
    runs = runs.select(
        "run_id",
        "success",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "rules", "errors")],
    )
    summary = (
        F.when(F.col("errors") > 0, F.format_string("Migration completed with %d errors.", "errors"))
        .when(F.col("files") > 0, F.format_string("Successfully applied %d rules to %d files.", "rules", "files"))
        .otherwise(F.lit("No changes were needed."))
    )
    return runs.withColumn("summary", summary), names
