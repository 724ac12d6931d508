"""Reports as ordered line tables, written by the text sink without passing through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbump.functions.patterns import status_bucket
from fleetbump.operators.ranking import number_rows, range_chunks
from fleetbump.operators.status import bucket_rank, status_counters

LINE_ORDER = ["section", "key", "seq", "pos"]


def _or(column: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def version_line(old: Column, new: Column) -> Column:
    """``old → new``, or the new version alone where no old one is known."""
    return F.when(F.coalesce(old, F.lit("")) != "", F.concat(old, F.lit(" → "), new)).otherwise(
        F.coalesce(new, F.lit("N/A"))
    )


def report_summary(entries: DataFrame) -> DataFrame:
    """Distinct repositories, entries, repositories with migration information, files to migrate."""
    migrated = F.col("migration").isNotNull()
    return entries.agg(
        F.count_distinct("repo_name").alias("repositories"),
        F.count(F.lit(1)).alias("entries"),
        F.count_distinct(F.when(migrated, F.col("repo_name"))).alias("with_migrations"),
        F.coalesce(
            F.sum(F.when(migrated, F.coalesce(F.size("migration.would_modify_files"), F.lit(0)))), F.lit(0)
        ).alias("files"),
    )


def _none() -> Column:
    return F.array().cast("array<string>")


def _block(items: Column, heading: str, unit: str, render) -> Column:
    size = F.coalesce(F.size(items), F.lit(0))
    return F.when(
        size > 0,
        F.concat(
            F.array(F.concat(F.lit(f"    - **{heading}** ("), size.cast("string"), F.lit(f"{unit}):"))),
            F.transform(items, render),
        ),
    ).otherwise(_none())


def _change_text(c: Column, i: Column) -> Column:
    both = (F.coalesce(c["original"], F.lit("")) != "") & (F.coalesce(c["replacement"], F.lit("")) != "")
    pad = "        "
    detail = F.when(
        both,
        F.concat(
            F.lit(f"      - **Before**:\n{pad}```csharp\n{pad}"),
            c["original"],
            F.lit(f"\n{pad}```\n      - **After**:\n{pad}```csharp\n{pad}"),
            c["replacement"],
            F.lit(f"\n{pad}```\n"),
        ),
    ).when(
        F.coalesce(c["description"], F.lit("")) != "",
        F.concat(F.lit("      - **Description**: "), c["description"], F.lit("\n")),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("      **Change "),
        (i + 1).cast("string"),
        F.lit(": "),
        F.coalesce(c["rule"], F.lit("Unknown rule")),
        F.lit("**\n      - **File**: `"),
        F.coalesce(c["file"], F.lit("Unknown file")),
        F.lit("` (line "),
        F.coalesce(c["line"].cast("string"), F.lit("Unknown line")),
        F.lit(")\n"),
        detail,
    )


def entry_lines(entries: DataFrame) -> DataFrame:
    """Lines of each report entry: (section 1, key, seq = entry order, pos, line)."""
    branch = F.when(
        F.coalesce("target_branch", F.lit("")) != "",
        F.array(F.concat(F.lit("- **Target Branch**: "), F.col("target_branch"))),
    ).otherwise(_none())
    m = F.col("migration")
    migration = F.when(
        m.isNotNull(),
        F.concat(
            F.array(F.lit("  - **Migration Analysis**:")),
            _block(
                m["would_modify_files"],
                "Files that would be modified",
                "",
                lambda f: F.concat(F.lit("      - `"), f, F.lit("`")),
            ),
            _block(m["applicable_rules"], "Applicable migration rules", "", lambda r: F.concat(F.lit("      - "), r)),
            _block(m["potential_changes"], "Code Changes Preview", " changes", _change_text),
            _block(m["analysis_errors"], "Analysis errors", "", lambda e: F.concat(F.lit("      - "), e)),
            F.when(
                F.coalesce(m["summary"], F.lit("")) != "",
                F.array(F.concat(F.lit("    - **Summary**: "), m["summary"])),
            ).otherwise(_none()),
        ),
    ).otherwise(_none())
    lines = F.concat(
        F.array(F.concat(F.lit("## Repository: "), F.col("repo_name"))),
        branch,
        F.array(
            F.concat(F.lit("- **Package**: "), _or("package_name", "N/A")),
            F.concat(F.lit("  - **Version**: "), version_line(F.col("old_version"), F.col("new_version"))),
            F.concat(F.lit("  - **Status**: "), _or("status", "N/A")),
            F.concat(F.lit("  - **Details**: "), _or("details", "N/A")),
        ),
        migration,
        F.array(F.lit("")),
    )
    return entries.select(
        F.lit(1).alias("section"), F.lit("").alias("key"), F.col("ord").cast("bigint").alias("seq"), F.posexplode(lines).alias("pos", "line")
    )


def update_report(entries: DataFrame, generated: str) -> DataFrame:
    """Whole update report as lines; sort by LINE_ORDER to read it."""
    s = report_summary(entries)
    head = F.array(
        F.lit("# NuGet Package Update Report"),
        F.lit(f"Generated on: {generated}"),
        F.lit(""),
        F.lit("## Summary"),
        F.format_string("- **Total Repositories**: %d", "repositories"),
        F.format_string("- **Total Package Updates**: %d", "entries"),
        F.format_string("- **Repositories with Migrations**: %d", "with_migrations"),
        F.format_string("- **Total Files with Migration Changes**: %d", "files"),
        F.lit(""),
    )
    header = s.select(
        F.lit(0).alias("section"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("seq"), F.posexplode(head).alias("pos", "line")
    )
    return header.unionByName(entry_lines(entries))


def rollback_section(failed: DataFrame, undo_lines: DataFrame) -> DataFrame:
    """Appendix: per failed repository (repo_id, error) its error and undo report.

    ``undo_lines`` are (repo_id, section, seq, line) as made by ``undo_report_lines``.
    """
    head = failed.limit(1).select(
        F.lit(2).alias("section"),
        F.lit("").alias("key"),
        F.lit(0).cast("bigint").alias("seq"),
        F.lit(0).alias("pos"),
        F.lit(
            "\n\n## Rollback Information\n\nThe following repositories required rollback due to failures:\n"
        ).alias("line"),
    )

    opening = F.concat(
        F.lit("### Repository: "),
        F.col("repo_id"),
        F.lit("\n\n**Error:** "),
        F.col("error"),
        F.lit("\n\n**Rollback Details:**\n```"),
    )
    # Section and seq of the undo report together order its lines inside the repository's block.
    body = undo_lines.join(failed.select("repo_id"), "repo_id", "left_semi").select(
        F.lit(3).alias("section"),
        F.col("repo_id").alias("key"),
        (F.col("section") + 1).cast("bigint").alias("seq"),
        F.col("seq").alias("pos"),
        "line",
    )
    # First and last line of a repository's block, from one reading of the failed ones.
    ends = [
        F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("pos"), line.alias("line"))
        for seq, line in ((0, opening), (100, F.lit("```\n")))
    ]
    around = failed.select(F.lit(3).alias("section"), F.col("repo_id").alias("key"), F.explode(F.array(*ends)).alias("e"))
    return (
        head.withColumn("pos", F.col("pos").cast("bigint"))
        .unionByName(around.select("section", "key", "e.*"))
        .unionByName(body)
    )


# Headings of the status report, by bucket.
_HEADINGS = {"merged": "Merged", "opened": "Open", "closed": "Closed", "unknown": "Unknown Status"}


def status_report(tracked: DataFrame, meta: DataFrame, generated: str, errors: int = 0, updated: int = 0) -> DataFrame:
    """Status report as lines (section, key, seq, pos, line); section 0 is the summary, then buckets."""
    counts = status_counters(tracked)
    # Over several tracking documents, a name stands only if they agree on it.
    agreed = meta.agg(*[F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in ("package_name", "new_version")])
    # One counter row, one metadata row: both sides are single rows by construction.
    one = counts.withColumn("_k", F.lit(1)).join(agreed.withColumn("_k", F.lit(1)), "_k", "left")
    head = F.array(
        F.lit(""),
        F.lit("# Merge Request Status Report"),
        F.lit(f"Generated: {generated}"),
        F.lit(""),
        F.lit("## Summary"),
        F.concat(F.lit("- **Package**: "), F.coalesce("package_name", F.lit("Multiple packages"))),
        F.concat(F.lit("- **Version**: "), F.coalesce("new_version", F.lit("Various versions"))),
        F.format_string("- **Total Merge Requests**: %d", "total"),
        F.format_string("- **Opened**: %d", "opened"),
        F.format_string("- **Merged**: %d", "merged"),
        F.format_string("- **Closed**: %d", "closed"),
        F.lit(f"- **Errors**: {errors}"),
        F.lit(f"- **Updated This Run**: {updated}"),
        F.lit(""),
        F.lit("## Merge Request Details"),
        F.lit(""),
    )
    header = one.select(
        F.lit(0).alias("section"), F.lit("").alias("key"), F.lit("").alias("seq"), F.posexplode(head).alias("pos", "line")
    )
    bucket = status_bucket(F.col("status"))
    in_bucket = tracked.withColumn("bucket", bucket)
    names = F.create_map(*[F.lit(x) for pair in _HEADINGS.items() for x in pair])
    headings = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select(
        (bucket_rank(F.col("bucket")) * 2 - 1).cast("int").alias("section"),
        F.lit("").alias("key"),
        F.lit("").alias("seq"),
        F.lit(0).alias("pos"),
        F.concat(F.lit("### "), names[F.col("bucket")], F.lit(" ("), F.col("n").cast("string"), F.lit(")\n")).alias("line"),
    )
    url = F.coalesce("merge_request_url", F.lit(""))
    unknown = F.col("bucket") == "unknown"
    body = F.concat(
        F.lit("- **"),
        F.coalesce("repository_name", F.lit("Unknown")),
        F.lit("** ("),
        F.coalesce("package_name", F.lit("Unknown")),
        F.lit(" → "),
        F.coalesce("new_version", F.lit("Unknown")),
        F.lit("): ["),
        url,
        F.lit("]("),
        url,
        F.lit(")\n"),
        F.when(unknown, F.concat(F.lit("  - Status: "), F.coalesce("status", F.lit("Unknown")), F.lit("\n")))
        .when(F.coalesce("existed", F.lit(False)), F.lit("  - *(Pre-existing MR)*\n"))
        .otherwise(F.lit("")),
    )
    items = in_bucket.select(
        (bucket_rank(F.col("bucket")) * 2).cast("int").alias("section"),
        url.alias("key"),
        F.coalesce("status", F.lit("")).alias("seq"),
        F.lit(0).alias("pos"),
        body.alias("line"),
    )
    return header.unionByName(headings).unionByName(items)


def numbered_changes(changes: DataFrame) -> DataFrame:
    """Changes numbered from 1 per (repository, package) in (file, line) order.

    Numbers come from counts of sampled ranges plus a running start, so one huge repository, or file, is spread.
    """
    order = ["file", "line", "rule"]
    keys = ["repo_id", "package"]
    chunked = range_chunks(changes, keys, order)
    return number_rows(chunked, keys, [F.col(c) for c in order], F.col("_range"), "change_no").drop("_range")
