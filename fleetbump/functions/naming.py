"""Branch names, titles, commit messages and descriptions, from arrays of struct<name, version>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_SUFFIX = " + Code Migrations"


def _only(packages: Column) -> Column:
    return F.get(packages, F.lit(0))


def branch_name(packages: Column, epoch_seconds: Column) -> Column:
    one = _only(packages)
    single = F.concat(
        F.lit("update-"),
        F.replace(F.lower(one["name"]), F.lit("."), F.lit("-")),
        F.lit("-to-"),
        F.replace(one["version"], F.lit("."), F.lit("_")),
    )
    tails = F.transform(F.slice(packages, 1, 2), lambda p: F.lower(F.substring_index(p["name"], ".", -1)))
    several = F.concat(F.lit("update-"), F.array_join(tails, "-"), F.lit("-"), epoch_seconds.cast("string"))
    return F.when(F.size(packages) == 1, single).otherwise(several)


def request_title(packages: Column, has_rules: Column | None = None) -> Column:
    one = _only(packages)
    title = F.when(
        F.size(packages) == 1, F.concat(F.lit("Update "), one["name"], F.lit(" to version "), one["version"])
    ).otherwise(F.concat(F.lit("Update "), F.size(packages).cast("string"), F.lit(" NuGet packages")))
    if has_rules is None:
        return title
    return F.concat(title, F.when(has_rules, F.lit(TITLE_SUFFIX)).otherwise(F.lit("")))


def _listed(packages: Column) -> Column:
    return F.array_join(F.transform(packages, lambda p: F.concat(p["name"], F.lit(" to "), p["version"])), ", ")


def commit_message(packages: Column) -> Column:
    return F.when(F.size(packages) == 1, request_title(packages)).otherwise(
        F.concat(F.lit("Update "), F.size(packages).cast("string"), F.lit(" packages: "), _listed(packages))
    )


def file_commit_message(packages: Column, path: Column) -> Column:
    return F.when(
        F.size(packages) == 1, F.concat(request_title(packages), F.lit(" in "), path)
    ).otherwise(
        F.concat(
            F.lit("Update "), F.size(packages).cast("string"), F.lit(" packages in "), path, F.lit(": "), _listed(packages)
        )
    )


def migrated_file_message(path: Column) -> Column:
    return F.concat(F.lit("Apply code migration to "), F.substring_index(path, "/", -1))


def migration_commit_message(rules: Column) -> Column:
    return F.when(
        F.size(rules) == 1, F.concat(F.lit("Apply code migration: "), F.get(rules, F.lit(0)))
    ).otherwise(F.concat(F.lit("Apply code migrations: "), F.size(rules).cast("string"), F.lit(" rules")))


def request_description(
    packages: Column,
    project_files: Column,
    rules: Column,
    code_files: Column,
    migrated: Column,
    footer: str = "*This merge request was created automatically.*",
) -> Column:
    """Text of a merge request. ``project_files``/``code_files`` are counts; ``migrated`` says a
    migration step ran and succeeded."""
    head = F.concat(
        F.array(F.lit("## Package Updates"), F.lit("")),
        F.array(F.concat(F.lit("Updated "), F.size(packages).cast("string"), F.lit(" packages:")), F.lit("")),
        F.transform(packages, lambda p: F.concat(F.lit("- **"), p["name"], F.lit("** → `"), p["version"], F.lit("`"))),
        F.array(
            F.lit(""),
            F.concat(F.lit("**Modified Files:** "), project_files.cast("string"), F.lit(" .csproj files")),
            F.lit(""),
        ),
    )
    applied = F.concat(
        F.array(F.concat(F.lit("Applied "), F.size(rules).cast("string"), F.lit(" migration rules:")), F.lit("")),
        F.transform(rules, lambda r: F.concat(F.lit("- "), r)),
        F.array(
            F.lit(""),
            F.concat(F.lit("**Modified Files:** "), code_files.cast("string"), F.lit(" C# files")),
            F.lit(""),
        ),
    )
    none = F.array(F.lit("No migration rules were applicable to this update."), F.lit(""))
    migration = F.when(
        migrated,
        F.concat(
            F.array(F.lit("## Code Migrations"), F.lit("")), F.when(F.size(rules) > 0, applied).otherwise(none)
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, migration, F.array(F.lit("---"), F.lit(footer))), "\n")


def single_package_description(name: Column, version: Column, files: Column) -> Column:
    """Text of a one-package merge request; ``files`` is the array of changed paths."""
    return F.array_join(
        F.concat(
            F.array(
                F.lit("## NuGet Package Update"),
                F.lit(""),
                F.lit("This merge request updates the following NuGet package:"),
                F.concat(F.lit("- **Package**: "), name),
                F.concat(F.lit("- **New Version**: "), version),
                F.lit(""),
                F.lit("### Files Modified:"),
            ),
            F.transform(files, lambda f: F.concat(F.lit("- `"), f, F.lit("`"))),
        ),
        "\n",
    )
