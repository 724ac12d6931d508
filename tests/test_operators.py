"""Catalogue, rules, status, reports, publishing and audit on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from fleetbump import schemas
from fleetbump.functions.references import Target
from fleetbump.operators import audit, catalog, publish, ranking, reports, rules, status
from fleetbump.plans import upgrade
from fleetbump.sources import landed

REPOS = [
    ("1", "web-api", "group/web-api", None, False, True, False),
    ("2", "Old-Tool", "group/sub/Old-Tool", ("9",), False, False, True),
    ("3", "test-app", "other/test-app", None, True, True, True),
    ("4", "lib", "groupie/lib", None, False, None, None),
]


@pytest.fixture()
def repos(spark):
    rows = [
        {
            "id": i, "name": n, "path_with_namespace": p, "default_branch": "main", "forked_from": f, "archived": a,
            "owned": o, "member": m, "ord": int(i),
        }
        for i, n, p, f, a, o, m in REPOS
    ]
    return spark.createDataFrame([tuple(r.get(k) for k in _names(schemas.REPOS)) for r in rows], schemas.REPOS)


def _names(schema):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).names


def ids(df):
    return [r.id for r in df.orderBy("ord").collect()]


def test_repository_filters(repos):
    assert ids(catalog.drop_ignored(repos, ["OLD-*", "other/*"])) == ["1", "4"]
    assert ids(catalog.drop_ignored(repos, " old-* ,, *APP ")) == ["1", "4"]
    assert ids(catalog.drop_ignored(repos, [])) == ["1", "2", "3", "4"]
    assert ids(catalog.drop_forks(repos)) == ["1", "3", "4"]
    assert ids(catalog.in_scope(repos, group="group", owned=True)) == ["1", "2"]
    assert ids(catalog.in_scope(repos, owned=True)) == ["1"]
    assert ids(catalog.in_scope(repos, member=True, include_archived=True)) == ["2", "3"]
    assert ids(catalog.first_repositories(repos, 2)) == ["1", "2"]
    assert ids(catalog.first_repositories(repos, 0)) == ["1", "2", "3", "4"]


def test_requests_resolve_by_id_or_path(spark, repos):
    requests = spark.createDataFrame([("group/web-api", 0), ("3", 1), ("nope", 2), ("3", 3)], "key string, ord bigint")
    found = catalog.resolve_requests(requests, repos).orderBy("ord").collect()
    assert [(r.key, r.id) for r in found] == [("group/web-api", "1"), ("3", "3"), ("nope", None), ("3", "3")]
    assert [r.key for r in catalog.unresolved_requests(requests, repos).collect()] == ["nope"]


def test_most_recent_branch(spark, repos):
    rows = [
        ("1", "main", "2024-01-01T00:00:00Z", 0),
        ("1", "release/2", "2024-03-01T00:00:00+02:00", 1),
        ("1", "release/1", "2024-02-29T22:00:00.000Z", 2),
        ("1", "Release/9", "2024-12-01T00:00:00Z", 3),
        ("2", "release/x", "not a date", 0),
        ("3", "dev", "2024-01-01T00:00:00Z", 0),
    ]
    branches = spark.createDataFrame(rows, "repo_id string, name string, committed_date string, ord bigint")
    newest = {r.repo_id: r.recent_branch for r in catalog.most_recent_branch(branches).collect()}
    assert newest == {"1": "Release/9", "3": "dev"}
    chosen = catalog.with_target_branch(repos, branches, "release/*").orderBy("ord").collect()
    # equal instants keep the first listed; globs are case-sensitive; without a match the default stays
    assert [r.target_branch for r in chosen] == ["release/2", "main", "main", "main"]


def test_rule_catalogue(spark, tmp_path):
    entries = [
        {"id": "a", "package_name": "P", "version_conditions": [{"type": "exact", "version": 2}], "rules": []},
        {"id": "b", "package_name": "Q"},
        {
            "id": "a",
            "package_name": "p",
            "version_conditions": [{"type": "greater_than", "version": "1.0"}],
            "rules": [
                {
                    "name": "r",
                    "target_nodes": [{"type": "ParameterDeclaration", "parameter_type": "X", "method_name": "DoIt"}],
                    "action": {"type": "replace_invocation", "replacement_code": "Y"},
                }
            ],
        },
    ]
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"migrations": entries}))
    table = landed.read_migrations(spark, str(path))
    assert [(r.id, r.package_name) for r in table.orderBy("ord").collect()] == [("a", "p"), ("b", "Q")]
    assert [e["package_name"] for e in landed.read_migration_list(str(path))] == ["p", "Q"]
    assert landed.read_migrations(spark, str(tmp_path / "none.json")).count() == 0
    assert landed.read_migration_list(str(tmp_path / "none.yml")) == []
    found = {(r.id, r.problem) for r in rules.violations(table).collect()}
    assert found == {("b", "version_conditions is required"), ("b", "rules is required")}
    assert rules.warnings(entries) == [
        ("a", "unknown node key parameter_type"),
        ("a", "replace_invocation without replacement_method does nothing"),
    ]
    yaml = pytest.importorskip("yaml")
    other = tmp_path / "rules.yml"
    other.write_text(yaml.safe_dump({"migrations": entries}))
    assert landed.read_migrations(spark, str(other)).orderBy("ord").first().package_name == "p"
    moves = spark.createDataFrame([("P", "0.5", "2.0"), ("P", "1.5", "2.0"), ("Z", "0", "2")], "package string, old_version string, new_version string")
    assert [r.old_version for r in rules.applicable(moves, table).collect()] == ["0.5"]
    assert rules.applicable(moves, table, from_zero=True).count() == 2
    assert rules.by_package_and_id(table, "P", "a").count() == 1 and rules.by_id(table, "x").count() == 0


def test_rule_files_of_a_folder_follow_their_names(spark, tmp_path):
    for name, packages in (("b.json", ["late", "own"]), ("a.json", ["early", "first"])):
        ids = ["same", packages[1]]
        entries = [{"id": i, "package_name": p, "rules": []} for i, p in zip(ids, packages)]
        (tmp_path / name).write_text(json.dumps({"migrations": entries}))
    table = landed.read_migrations(spark, str(tmp_path))
    # A later definition takes the place of the first one of its id, as in the list that the driver reads.
    wanted = [("same", "late"), ("first", "first"), ("own", "own")]
    assert [(r.id, r.package_name) for r in table.orderBy("ord").collect()] == wanted
    listed = landed.read_migration_list(str(tmp_path) + "/*.json")
    assert [(e["id"], e["package_name"]) for e in listed] == wanted


def test_landed_rows_keep_order_and_bad_lines_fail(spark, tmp_path):
    keys = tmp_path / "keys"
    keys.mkdir()
    (keys / "1.txt").write_text("z/one\n# no\n\na/two\n")
    (keys / "2.txt").write_text("k/three\n" * 3)
    read = landed.read_repository_keys(spark, str(keys)).orderBy("ord")
    assert [r.key for r in read.collect()] == ["z/one", "a/two", "k/three", "k/three", "k/three"]
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"repo_id": "1", "name": "main", "ord": 0}\n')
    bad.write_text('{"repo_id": "1", "name": "main", "ord": 0}\n{"repo_id": \n')
    assert landed.read_branches(spark, str(good)).count() == 1
    for act in (lambda t: t.collect(), lambda t: t.count()):
        with pytest.raises(Exception, match="not a row of the landed table"):
            act(landed.read_branches(spark, str(bad)))


def test_search_terms(spark):
    nested = [
        {"name": "ignored name", "target_nodes": [{"method_name": "AddX", "deep": {"old_type": "Foo"}, "identifier": "no"}]},
        {"action": {"replacement_method": "AddY", "argument_name": "ab", "new_namespace": "has blank"}, "containing_type": "AddX"},
    ]
    more = [{"method_name": "AddX"}, {"note": 'the "method_name": "Fake" in a text', "type_name": "Caf\u00e9 \\ x"}, {"type_name": "Caf\u00e9"}]
    texts = [(0, json.dumps(nested)), (1, json.dumps(more)), (2, None), (3, "")]
    found = rules.terms_in_rules(spark.createDataFrame(texts, "ord long, json string"))
    assert [r.term for r in found.orderBy("place").collect()] == ["AddX", "Foo", "AddY", "Caf\u00e9"]


def test_prefilter_without_terms_keeps_all(spark):
    files = spark.createDataFrame([("a", "Hello"), ("b", "hello")], "path string, content string")
    assert rules.keep_files_with_terms(files, []).count() == 2
    assert [r.path for r in rules.keep_files_with_terms(files, ["Hell"]).collect()] == ["a"]


TRACKED = [
    ("1", "one", "https://x/2", "7", "opened"),
    ("1", "one", "https://x/1", "8", None),
    ("2", "two", None, "9", "merged"),
    ("2", "two", "https://x/3", None, "opened"),
    ("3", "three", "https://x/4", "5", "locked"),
]


@pytest.fixture()
def tracked(spark):
    names = _names(schemas.TRACKED)
    rows = []
    for i, (repo, name, url, iid, state) in enumerate(TRACKED):
        v = {"repository_id": repo, "repository_name": name, "merge_request_url": url, "merge_request_iid": iid, "status": state}
        rows.append(tuple(v.get(n) for n in names) + (i,))
    return spark.createDataFrame(rows, schemas.TRACKED + ", ord bigint")


def test_refresh(spark, tracked):
    latest = spark.createDataFrame(
        [("1", "7", "merged"), ("1", "8", "unknown"), ("2", "9", "merged"), ("9", "9", "closed")], "repository_id string, iid string, state string"
    )
    done = status.refresh(tracked, latest, F.lit("now"))
    rows = {r.ord: (r.status, r.refresh_outcome, r.last_checked) for r in done.collect()}
    assert rows == {
        0: ("merged", "updated", "now"),
        1: ("unknown", "unchanged", "now"),
        2: ("merged", "unchanged", "now"),
        3: ("opened", "insufficient", None),
        4: ("locked", "error", None),
    }
    assert tuple(status.refresh_counters(done).first()) == (1, 1, 1)
    assert tuple(status.status_counters(done).first()) == (5, 1, 2, 0)
    assert [r.merge_request_url for r in status.with_status(tracked, "OPENED").collect()] == ["https://x/2", "https://x/3"]
    assert [r.ord for r in status.canonical_order(tracked).collect()] == [2, 1, 0, 3, 4]


def test_tracking_document_round_trip(spark, tracked, tmp_path):
    from fleetbump.sources import landed, sinks

    sinks.write_tracking_document(tracked, {"package_name": "P"}, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    document = json.loads(text)
    assert document["metadata"] == {"package_name": "P"}
    assert [m.get("merge_request_url") for m in document["merge_requests"]] == [None, "https://x/1", "https://x/2", "https://x/3", "https://x/4"]
    (tmp_path / "one.json").write_text(text)
    rows, meta = landed.read_tracking(spark, str(tmp_path / "one.json"))
    assert rows.count() == 5 and meta.first().package_name == "P"
    (tmp_path / "bad.json").write_text("{ no json")
    with pytest.raises(landed.BadTrackingFile):
        landed.read_tracking(spark, str(tmp_path / "bad.json"))
    (tmp_path / "empty.json").write_text('{"metadata": {}, "merge_requests": []}')
    assert landed.read_tracking(spark, str(tmp_path / "empty.json"))[0].count() == 0
    sinks.write_tracking_document(tracked.limit(0), {}, str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))))["merge_requests"] == []


def test_status_report_text(spark, tracked, tmp_path):
    from fleetbump.sources import sinks

    meta = spark.createDataFrame([("P", None)], "package_name string, new_version string")
    sinks.write_lines(reports.status_report(tracked, meta, "T"), str(tmp_path / "r"), reports.LINE_ORDER)
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.startswith("\n# Merge Request Status Report\nGenerated: T\n\n## Summary\n- **Package**: P\n- **Version**: Various versions\n")
    assert [line for line in text.splitlines() if line.startswith("###")] == ["### Merged (1)", "### Open (2)", "### Unknown Status (2)"]
    assert text.index("x/2](") < text.index("x/3](") < text.index("### Unknown")
    assert "- **one** (Unknown → Unknown): [https://x/1](https://x/1)\n  - Status: Unknown\n" in text


def test_undo(spark):
    log = spark.createDataFrame(
        [("t", 1, "branch", None), ("t", 3, "", "gone"), ("t", 2, "file", None), ("u", 1, "branch", None)],
        "txn_id string, seq bigint, description string, error string",
    )
    ok = spark.createDataFrame([("u",)], "txn_id string")
    plan = publish.undo_plan(log, ok).orderBy("undo_order").collect()
    assert [(r.txn_id, r.seq, r.undo_order) for r in plan] == [("t", 3, 1), ("t", 2, 2), ("t", 1, 3)]
    lines = publish.undo_report_lines(log).filter("txn_id = 't'").orderBy("section", "seq").collect()
    assert "\n".join(r.line for r in lines) == (
        "=== ROLLBACK REPORT ===\nRollback completed with errors\n\nCompleted Actions:\n  • file\n  • branch\n"
        "\nFailed Actions:\n  • Unnamed rollback action: gone"
    )


def test_all_or_nothing(spark):
    out = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "repo_id string, path string")
    results = spark.createDataFrame([("1", True), ("1", False), ("2", True)], "repo_id string, ok boolean")
    assert [r.path for r in publish.publishable(out, results).collect()] == ["c"]


def test_numbering_in_chunks_equals_plain_numbering(spark):
    # One key holds most rows.
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.lit("k")).alias("k"), (F.col("id") * 7919 % 5003).alias("seq"))
    got = ranking.number_rows(df, ["k"], [F.col("seq")], F.floor(F.col("seq") / 100), total="n")
    from pyspark.sql import Window

    want = df.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("seq"))).withColumn(
        "c", F.count("*").over(Window.partitionBy("k"))
    )
    assert got.join(want, ["k", "seq"]).filter((F.col("position") != F.col("w")) | (F.col("n") != F.col("c"))).count() == 0
    assert got.count() == 5000


def test_sampled_ranges_split_a_hot_key_with_sparse_places(spark):
    from pyspark.sql import Window

    # A third of all rows is of one key; places lie 10,000,000 apart, one key and some places are null, places repeat.
    i = F.col("id")
    df = spark.range(30_000).select(
        F.when(i % 3 == 0, F.lit("hot")).when(i % 3 == 1, (i % 5000).cast("string")).alias("k"),
        F.when(i % 1000 != 7, F.pmod(i * 7919, F.lit(10_007)) * 10_000_000).alias("seq"),
        i.alias("id"),
    )
    chunked = ranking.range_chunks(df, ["k"], ["seq", "id"])
    sizes = chunked.filter("k = 'hot'").groupBy("_range").count().collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) >= 2 and max(r["count"] for r in sizes) < 10_000
    assert len(sizes) <= parts + 1
    known = chunked.filter("k IS NOT NULL")
    got = ranking.number_rows(known, ["k"], [F.col("seq").asc_nulls_first(), F.col("id")], F.col("_range"))
    want = df.filter("k IS NOT NULL").withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy(F.col("seq").asc_nulls_first(), "id")))
    assert got.join(want, "id").filter(F.col("position") == F.col("w")).count() == want.count() == got.count()
    assert ranking.range_chunks(df.limit(0), ["k"], ["seq"]).count() == 0


def test_rates_against_brute_force(spark):
    import random

    rng = random.Random(5)
    us, rows = 0, []
    for i in range(600):
        us += rng.choice([0, 10_000, 400_000, 1_000_000, 5_000_000, 59_999_999, 60_000_000, 200_000_000][: rng.choice([3, 5, 8])])
        rows.append((i, "hot" if i % 4 else "k", us))
    log = spark.createDataFrame(rows, "request_id bigint, key string, us bigint").withColumn("ts", F.timestamp_micros("us"))
    got = {r.request_id: r for r in audit.request_rates(log, per_minute=20, bucket_seconds=61).collect()}
    seen: dict[str, list[int]] = {}
    for i, key, t in rows:
        past = seen.setdefault(key, [])
        recent = [x for x in past if x > t - 60_000_000]
        r = got[i]
        assert r.trailing_requests == len(recent)
        assert r.throttled == (len(recent) >= 18)
        assert r.wait_us == (60_000_000 - (t - recent[0]) if r.throttled else None)
        assert r.gap_us == (t - past[-1] if past else None)
        assert r.below_min_gap == bool(past and t - past[-1] < 3_000_000)
        past.append(t)
    bursts: dict[str, int] = {"hot": 0, "k": 0}
    last: dict[str, int] = {}
    count: dict[str, int] = {}
    for _, key, t in rows:
        if key in last and t - last[key] < 1_000_000:
            count[key] += 1
            if count[key] >= 4:
                bursts[key] += 1
                count[key] = 0
        else:
            count[key] = 0
        last[key] = t
    runs = audit.burst_runs(log, burst_limit=4, bucket_seconds=7)
    assert {r.key: r.b for r in runs.groupBy("key").agg(F.sum("bursts").alias("b")).collect()} == bursts
    assert runs.agg(F.sum("requests")).first()[0] == 600


def test_plan_outcomes(spark, repos):
    files = spark.createDataFrame(
        [
            ("1", "main", "a.csproj", '<PackageReference Include="P" Version="1.0" />'),
            ("1", "main", "b.csproj", '<PackageReference Include="p" Version="0.9" />'),
            ("1", "dev", "c.csproj", '<PackageReference Include="P" Version="0.1" />'),
            ("1", "main", "x.cs", "s.Old();"),
            ("2", "main", "a.csproj", '<PackageReference Include="P" Version="2.0" />'),
            ("3", "main", "a.csproj", '<PackageReference Include="P" Version="1.0" />'),
            ("4", "main", "a.CSPROJ", '<PackageReference Include="P" Version="1.0" />'),
        ],
        "repo_id string, ref string, path string, content string",
    )
    mrs = spark.createDataFrame(
        [("3", "opened", "Update P to version 2.0", "main"), ("1", "merged", "Update P to version 2.0", "main")],
        "repo_id string, state string, title string, target_branch string",
    )
    migrations = [
        {
            "id": "m",
            "package_name": "p",
            "version_conditions": [{"type": "greater_than", "version": "1.5"}],
            "rules": [{"name": "r", "target_nodes": [{"type": "InvocationExpression", "method_name": "Old"}], "action": {"type": "remove_invocation"}}],
        }
    ]
    targets = [Target("P", "2.0")]
    packages = upgrade.plan_packages(repos, files, mrs, targets, migrations)
    rows = {r.id: r for r in upgrade.plan_repositories(packages, targets).collect()}
    assert {k: r.outcome for k, r in rows.items()} == {"1": "would_create", "2": "no_changes", "3": "existing_request", "4": "no_projects"}
    assert (rows["1"].project_files, rows["1"].code_files, rows["1"].has_migrations) == (2, 1, True)
    assert (rows["1"].title, rows["1"].source_branch) == ("Update P to version 2.0", "update-p-to-2_0")
    assert packages.filter("id = '1'").first().old_versions == "0.9, 1.0"
    summary = upgrade.preview_summary(upgrade.plan_repositories(packages, targets)).first()
    assert tuple(summary) == (4, 1, 1, 2, 2, 1)


def test_hot_repository(spark):
    """One repository holds most files; counts stay whole."""
    files = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise(F.lit("hot")).alias("repo_id"),
        F.lit("main").alias("ref"),
        F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(".csproj")).alias("path"),
        F.lit('<PackageReference Include="P" Version="1.0" />').alias("content"),
    )
    updates = upgrade.repository_updates(upgrade.file_decisions(files, [Target("P", "2.0")]))
    hot = updates.filter("repo_id = 'hot'").first()
    assert (hot.project_files, hot.old_versions) == (13_333, "1.0")
    head = upgrade.preview_head(files.select("repo_id", "path"), ["repo_id"], F.col("path"), 3)
    assert [(r.path, r.more) for r in head.filter("repo_id = 'hot'").orderBy("rank").collect()] == [
        ("p1.csproj", 13_330),
        ("p10.csproj", 13_330),
        ("p100.csproj", 13_330),
    ]


def test_report_headings_group_the_actions_once(spark):
    from fleetbump.operators import publish

    actions = spark.createDataFrame(
        [("t", 1, "a", None), ("t", 2, "", "no"), ("u", 1, "b", None), (None, 1, "c", "bad")],
        "txn_id string, seq long, description string, error string",
    )
    lines = publish.undo_report_lines(actions)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 1
    found = {(r.txn_id, r.section, r.seq): r.line for r in lines.collect()}
    assert found["t", 4, 0] == "\nFailed Actions:" and found["t", 2, 0] == "\nCompleted Actions:"
    assert ("u", 4, 0) not in found and (None, 2, 0) not in found and found[None, 4, 0] and len(found) == 14


def test_rows_of_any_name_are_dealt_over_shares(spark):
    from fleetbump.operators import corpus, rules

    rows = spark.range(500).selectExpr("'r' repo_id", "concat('p', id) path", "id line", "'' receiver", "'Run' method", "'' arguments", "'' chain")
    entry = {"id": "m", "package_name": "p", "version_conditions": [], "rules": [{"name": "any", "target_nodes": [{"type": "InvocationExpression"}], "action": {"type": "x"}}]}
    hits = corpus.rule_hits(rows, rules.rule_nodes(rules.migrations_table(spark, [entry])), declarations=False)
    assert hits.count() == 500 and "_share" not in hits.columns
    assert "_share" in hits._jdf.queryExecution().optimizedPlan().toString()


def test_catalogue_files_are_numbered_without_a_window_over_their_contents(spark, tmp_path):
    import json

    from fleetbump.sources import landed

    for i in range(12):
        entry = {"id": "same", "package_name": f"p{i:02}", "description": "d", "version_conditions": [], "rules": []}
        (tmp_path / f"f{i:02}.json").write_text(json.dumps({"migrations": [entry]}))
    table = landed.read_migrations(spark, str(tmp_path), last_only=False)
    assert [r.package_name for r in table.orderBy("ord").collect()] == [f"p{i:02}" for i in range(12)]
    assert [r.ord >> 32 for r in table.orderBy("ord").collect()] == list(range(12))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window" in line and "migrations" in line for line in plan.splitlines())
    assert landed.read_migrations(spark, str(tmp_path)).first().package_name == "p11"
