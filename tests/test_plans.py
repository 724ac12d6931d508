"""Physical plans: what is shuffled, what reaches the scan, what is broadcast."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from fleetbump.functions.references import Target
from fleetbump.operators import audit, catalog, corpus, publish, rules
from fleetbump.plans import upgrade
from fleetbump.queries.standins import spread
from fleetbump.sources import landed

RULES = [
    {
        "name": "r",
        "target_nodes": [{"type": "InvocationExpression", "method_name": "Old"}],
        "action": {"type": "remove_invocation"},
    }
]
MIGRATIONS = [
    {"id": "m", "package_name": "P", "version_conditions": [{"type": "greater_than", "version": "1"}], "rules": RULES}
]


def formatted(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def exchanges(plan: str) -> list[str]:
    return [b for b in re.split(r"\n\n+", plan) if re.match(r"\s*\(\d+\) Exchange\b", b)]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files")) + "/t"
    rows = [("1", "main", "a.csproj", '<PackageReference Include="P" Version="1.0" />'), ("1", "main", "b.cs", "s.Old();")]
    spark.createDataFrame(rows, "repo_id string, ref string, path string, content string").write.parquet(path)
    return spark.read.parquet(path)


def test_contents_stay_in_their_scan_stage(spark, files):
    repos = spark.createDataFrame([("1", "n", "main", 0)], "id string, name string, default_branch string, ord bigint")
    mrs = spark.createDataFrame([("1", "opened", "t", "main")], "repo_id string, state string, title string, target_branch string")
    plan = formatted(upgrade.plan_packages(repos, files, mrs, [Target("P", "2.0")], MIGRATIONS))
    found = exchanges(plan)
    assert found and not any("content#" in b for b in found)
    # One scan gives the listing, the references and the code files.
    assert plan.count("ReadSchema: struct<repo_id:string,ref:string,path:string,content:string>") == 1
    assert "Or(StringEndsWith(path,.csproj),StringEndsWith(path,.cs))" in plan


def test_rewrites_shuffle_nothing(files):
    assert not exchanges(formatted(corpus.apply_rules(files, RULES)))
    assert not exchanges(formatted(corpus.call_inventory(files)))
    assert not exchanges(formatted(corpus.declaration_inventory(files)))
    assert not exchanges(formatted(publish.rewrite_project_files(files, [Target("P", "2.0")])))


def test_rewrite_is_evaluated_once(files):
    plan = formatted(corpus.apply_rules(files, RULES))
    blocks = [b for b in re.split(r"\n\n+", plan) if "regexp_replace" in b]
    assert len(blocks) == 1


def test_equality_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "mrs")
    spark.createDataFrame([("1", "opened", "main")], "repo_id string, state string, target_branch string").write.parquet(path)
    plan = formatted(landed.read_merge_requests(spark, path, state="opened", target_branch="main", fmt="parquet"))
    assert "EqualTo(state,opened)" in plan and "EqualTo(target_branch,main)" in plan


def test_grouped_choices_combine_before_the_shuffle(spark):
    branches = spark.createDataFrame([("1", "b", "2024-01-01", 0)], "repo_id string, name string, committed_date string, ord bigint")
    plan = formatted(catalog.most_recent_branch(branches))
    assert plan.count("Aggregate (") >= 2 and "Window" not in plan


def test_top_rows_are_cut_before_the_shuffle(files):
    plan = formatted(upgrade.preview_head(files.select("repo_id", "path"), ["repo_id"], F.col("path"), 3))
    assert plan.count("WindowGroupLimit (") >= 2


def test_request_windows_use_time_chunks(spark):
    log = spark.createDataFrame([(1, "k", 5)], "request_id bigint, key string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    plan = formatted(audit.request_rates(log))
    assert re.search(r"Exchange[^\n]*\n.*\n.*hashpartitioning\(key#\d+, _at#", plan)


def test_join_kinds_are_left_to_spark(spark):
    """A rule or target list has no broadcast hint: where Spark may not broadcast, it does not."""
    refs = spark.createDataFrame([("r", "A", "1.0", "2.0")], "repo_id string, package string, old_version string, new_version string")
    entry = {"id": "m", "package_name": "a", "version_conditions": [{"type": "greater_than", "version": "1.0"}], "rules": []}
    hits = lambda: formatted(rules.applicable(refs, rules.migrations_table(spark, [entry])))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in hits()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_conditions_are_tried_once_for_each_different_move(spark):
    """A package with many references and many rules: the rows that meet rules are different moves, not references."""
    moves = spark.range(2000).select(
        F.concat(F.lit("r"), "id").alias("repo_id"), F.lit("Hot").alias("package"),
        F.concat(F.lit("1."), (F.col("id") % 5).cast("string")).alias("old_version"), F.lit("2.0").alias("new_version"),
    )
    catalogue = rules.migrations_table(
        spark,
        [{"id": f"m{i}", "package_name": "hot", "version_conditions": [{"type": "exact", "version": f"{i % 100}.0"}], "rules": []} for i in range(300)],
    )
    found = rules.applicable(moves, catalogue)
    assert found.count() == 2000 * 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    met = plan[plan.index("exists") :]
    assert "Aggregate" in met[: met.index("LogicalRDD") if "LogicalRDD" in met else len(met)]


def test_only_very_small_tables_are_spread(spark, files):
    assert exchanges(formatted(spread(files, "path")))
    assert not exchanges(formatted(spread(spark.range(200_000_000), "id")))
