"""Choosing repositories and branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbump.functions.patterns import glob_match, is_valid_spec, parse_instant, spec_parts


def with_extension(tree: DataFrame, extension: str) -> DataFrame:
    """Files (not folders) whose name ends with the extension, case included."""
    return tree.filter((F.col("type") == "blob") & F.col("name").endswith(extension))


def drop_ignored(repos: DataFrame, globs: list[str] | str) -> DataFrame:
    """Drop repositories any glob matches by name or namespaced path; no globs keep everything.

    ``globs`` is a list, or one comma-separated text.
    """
    if isinstance(globs, str):
        globs = [g.strip() for g in globs.split(",") if g.strip()]
    if not globs:
        return repos
    name = F.col("name")
    path = F.coalesce(F.col("path_with_namespace"), F.lit(""))
    return repos.filter(~(glob_match(name, globs, True) | glob_match(path, globs, True)))


def drop_forks(repos: DataFrame) -> DataFrame:
    return repos.filter(F.col("forked_from").isNull())


def in_scope(
    repos: DataFrame,
    group: str | None = None,
    owned: bool | None = None,
    member: bool | None = None,
    include_archived: bool = False,
) -> DataFrame:
    """Group with its subgroups; ownership and membership only count when no group is given."""
    keep: Column = F.lit(True) if include_archived else ~F.coalesce(F.col("archived"), F.lit(False))
    if group:
        path = F.col("path_with_namespace")
        keep = keep & ((path == group) | path.startswith(group + "/"))
    else:
        if owned is not None:
            keep = keep & (F.col("owned") == owned)
        if member is not None:
            keep = keep & (F.col("member") == member)
    return repos.filter(keep)


def matching_branches(branches: DataFrame, glob: str | None) -> DataFrame:
    return branches.filter(glob_match(F.col("name"), [glob])) if glob else branches


def parse_specs(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``name@version`` rows into targets and rejects (anything without exactly one ``@``)."""
    parts = spec_parts(F.col("spec"))
    valid = is_valid_spec(F.col("spec"))
    good = specs.filter(valid).select("ord", parts[0].alias("name"), parts[1].alias("version"))
    return good, specs.filter(~valid)


def resolve_requests(requests: DataFrame, repos: DataFrame) -> DataFrame:
    """Requests with the repository whose id or path they name; ``id`` is null when none does."""
    keyed = repos.select(
        F.explode(F.array_distinct(F.array(F.col("id"), F.col("path_with_namespace")))).alias("key"),
        "id",
        "name",
        "path_with_namespace",
        "default_branch",
    )
    return requests.join(keyed, "key", "left")


def unresolved_requests(requests: DataFrame, repos: DataFrame) -> DataFrame:
    keyed = repos.select(F.explode(F.array(F.col("id"), F.col("path_with_namespace"))).alias("key"))
    return requests.join(keyed, "key", "left_anti")


def most_recent_branch(branches: DataFrame, glob: str | None = None) -> DataFrame:
    """Per repository the branch with the newest readable commit date; ties keep the first listed.

    An aggregate rather than a window: partial results are combined before the shuffle, so a
    repository with very many branches does not end up in one task.
    """
    dated = matching_branches(branches, glob).withColumn("_at", parse_instant(F.col("committed_date")))
    newest = dated.filter(F.col("_at").isNotNull()).groupBy("repo_id").agg(
        F.max_by("name", F.struct(F.col("_at"), -F.col("ord"))).alias("recent_branch")
    )
    return newest


def with_target_branch(repos: DataFrame, branches: DataFrame | None, glob: str | None = None) -> DataFrame:
    """Add ``target_branch``: the most recent matching branch, else the default branch."""
    if branches is None:
        return repos.withColumn("target_branch", F.col("default_branch"))
    recent = most_recent_branch(branches, glob).withColumnRenamed("repo_id", "id")
    return (
        repos.join(recent, "id", "left")
        .withColumn("target_branch", F.coalesce("recent_branch", "default_branch"))
        .drop("recent_branch")
    )


def first_repositories(repos: DataFrame, cap: int | None) -> DataFrame:
    """Prefix of the ordered repository list; no cap, zero or a negative one keep all."""
    return repos.orderBy("ord").limit(cap) if cap and cap > 0 else repos
