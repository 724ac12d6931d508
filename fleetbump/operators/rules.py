"""Migration rules: the catalogue, which rules a version move triggers, and which files they may touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbump import schemas
from fleetbump.functions.patterns import has_call, is_useful_term
from fleetbump.functions.versions import crosses, usable_conditions, version_key

# Rule keys whose text is worth searching files for.
TERM_KEYS = (
    "method_name",
    "replacement_method",
    "containing_type",
    "containing_namespace",
    "argument_name",
    "type_name",
    "namespace",
    "old_namespace",
    "new_namespace",
    "old_type",
    "new_type",
)


def migrations_table(spark: SparkSession, migrations: list[dict]) -> DataFrame:
    """Catalogue entries (as parsed from a rule file) with their list position."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(schemas.MIGRATIONS)
    rows = [_shape({**m, "ord": i}, schema) for i, m in enumerate(migrations)]
    return spark.createDataFrame(rows, schema)


def _shape(value, dtype):
    """Cut parsed JSON or YAML to the schema: unknown keys go, missing ones become null."""
    from pyspark.sql import types as T

    if value is None:
        return None
    if isinstance(dtype, T.StructType):
        return tuple(_shape(value.get(f.name), f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return [_shape(v, dtype.elementType) for v in value]
    return str(value) if isinstance(dtype, T.StringType) else value


def last_definitions(migrations: DataFrame) -> DataFrame:
    """One row per id: the last definition, at the place of the first."""
    fields = [c for c in migrations.columns if c not in ("id", "ord")]
    return (
        migrations.groupBy("id")
        .agg(F.max_by(F.struct(*fields), F.col("ord")).alias("m"), F.min("ord").alias("ord"))
        .select("id", *[F.col(f"m.{c}").alias(c) for c in fields], "ord")
    )


def by_id(migrations: DataFrame, migration_id: str) -> DataFrame:
    return migrations.filter(F.col("id") == migration_id)


def by_package_and_id(migrations: DataFrame, package: str, migration_id: str) -> DataFrame:
    return migrations.filter((F.lower("package_name") == package.lower()) & (F.col("id") == migration_id))


def applicable(moves: DataFrame, migrations: DataFrame, from_zero: bool = False) -> DataFrame:
    """Moves (package, old_version, new_version) with every migration they trigger.

    ``from_zero`` compares from version 0.0.0 whatever the old version is. Conditions are tried once for each
    different move of a package, so a package that has many references and many rules makes no product of the two;
    what holds is joined back to the references.
    """
    catalogue = migrations.select(
        F.lower("package_name").alias("_package"),
        F.col("id").alias("migration_id"),
        F.col("ord").alias("migration_ord"),
        usable_conditions(F.col("version_conditions")).alias("_conditions"),
    )
    named = moves.withColumn("_package", F.lower("package"))
    keys = ["_package", "new_version"] if from_zero else ["_package", "old_version", "new_version"]
    old = F.lit("0.0.0") if from_zero else F.col("old_version")
    different = named.select(*keys).distinct().withColumn("_old", version_key(old)).withColumn("_new", version_key("new_version"))
    hits = different.join(catalogue, "_package").filter(crosses(F.col("_conditions"), F.col("_old"), F.col("_new")))
    return named.join(hits.select(*keys, "migration_id", "migration_ord"), keys).select(*moves.columns, "migration_id", "migration_ord")


def rule_nodes(migrations: DataFrame) -> DataFrame:
    """One row per (migration, rule, target node), with both positions."""
    rules = migrations.select(
        F.col("id").alias("migration_id"),
        "package_name",
        F.posexplode("rules").alias("rule_ord", "rule"),
    )
    return rules.select(
        "migration_id",
        "package_name",
        "rule_ord",
        F.col("rule.name").alias("rule_name"),
        F.col("rule.action").alias("action"),
        F.posexplode("rule.target_nodes").alias("node_ord", "node"),
    )


def violations(migrations: DataFrame) -> DataFrame:
    """One row (id, rule_ord, problem) per failed check; a catalogue is valid when there are none."""

    def blank(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    def empty(c: Column) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) <= 0

    def at_top(test: Column, problem: str) -> DataFrame:
        return migrations.filter(test).select("id", F.lit(-1).alias("rule_ord"), F.lit(problem).alias("problem"))

    conditions = migrations.select("id", F.explode("version_conditions").alias("c"))
    rules = migrations.select("id", F.posexplode("rules").alias("rule_ord", "r"))

    def in_conditions(test: Column, problem: str) -> DataFrame:
        return conditions.filter(test).select("id", F.lit(-1).alias("rule_ord"), F.lit(problem).alias("problem"))

    def in_rules(test: Column, problem: str) -> DataFrame:
        return rules.filter(test).select("id", "rule_ord", F.lit(problem).alias("problem"))

    checks = [
        at_top(blank(F.col("package_name")), "package_name is required"),
        at_top(empty(F.col("version_conditions")), "version_conditions is required"),
        at_top(empty(F.col("rules")), "rules is required"),
        in_conditions(F.col("c.type").isNull() | F.col("c.version").isNull(), "condition lacks type or version"),
        in_conditions(
            F.col("c.version").isNotNull() & version_key(F.col("c.version")).isNull(), "condition version is invalid"
        ),
        in_rules(blank(F.col("r.name")), "name is required"),
        in_rules(empty(F.col("r.target_nodes")), "target_nodes is required"),
        in_rules(F.col("r.action").isNull() | F.col("r.action.type").isNull(), "action.type is required"),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def warnings(migrations: list[dict]) -> list[tuple[str, str]]:
    """(id, remark) for entries that are valid but will not do what they seem to: node keys the model
    does not know, and renames that carry only replacement text. Works on the parsed file, since the
    typed table no longer holds unknown keys."""
    found = []
    for migration in migrations:
        for rule in migration.get("rules") or []:
            for node in rule.get("target_nodes") or []:
                for key in node:
                    if key not in schemas.NODE_KEYS:
                        found.append((migration.get("id", ""), f"unknown node key {key}"))
            action = rule.get("action") or {}
            if action.get("type") == "replace_invocation" and not action.get("replacement_method"):
                found.append((migration.get("id", ""), "replace_invocation without replacement_method does nothing"))
    return found


def search_terms(migrations: DataFrame) -> DataFrame:
    """Distinct useful terms of a rule catalogue with their first position (term, ord)."""
    nodes = rule_nodes(migrations)
    ord_of = {"node": ["method_name", "containing_type", "containing_namespace"], "action": ["replacement_method", "argument_name"]}
    columns = [
        F.struct(F.lit(i).alias("slot"), F.col(f"{part}.{name}").alias("term"))
        for i, (part, name) in enumerate((p, n) for p in ("node", "action") for n in ord_of[p])
    ]
    # Node keys come before the action's, which follow the last node of the rule.
    spread = nodes.join(migrations.select(F.col("id").alias("migration_id"), "ord"), "migration_id").select(
        "ord", "rule_ord", "node_ord", F.explode(F.array(*columns)).alias("t")
    )
    placed = spread.select(
        F.col("t.term").alias("term"),
        F.struct(
            "ord",
            "rule_ord",
            (F.col("t.slot") >= 3).alias("of_action"),
            F.when(F.col("t.slot") < 3, F.col("node_ord")).alias("node_ord"),
            F.col("t.slot").alias("slot"),
        ).alias("place"),
    )
    return (
        placed.filter(F.col("term").isNotNull() & is_useful_term(F.col("term")))
        .groupBy("term")
        .agg(F.min("place").alias("place"))
    )


def terms_in_rules(documents: DataFrame) -> DataFrame:
    """Distinct useful terms of rule documents (``ord``, ``json`` text) with their first place: all keys, at any depth.

    A key that is followed by a colon cannot stand inside a JSON string, where its quotes are escaped, so the text's
    own order is the order in which a walk of the document meets the terms.
    """
    value = rf'"(?:{"|".join(TERM_KEYS)})"\s*:\s*("(?:[^"\\]|\\.)*+")'
    found = documents.select("ord", F.posexplode(F.regexp_extract_all("json", F.lit(value), 1)).alias("pos", "quoted"))
    # The quoted value is a JSON string; as the only member of a list it is decoded by the JSON reader.
    term = F.from_json(F.concat(F.lit("["), "quoted", F.lit("]")), "array<string>")[0]
    terms = found.select(term.alias("term"), F.struct("ord", "pos").alias("place"))
    return terms.filter(F.col("term").isNotNull() & is_useful_term(F.col("term"))).groupBy("term").agg(F.min("place").alias("place"))


def contains_any(content: Column, terms: list[str]) -> Column:
    """Fixed-string, case-sensitive test for any term; no terms means every file qualifies."""
    if not terms:
        return F.lit(True)
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(content, t))


def keep_files_with_terms(files: DataFrame, terms: list[str]) -> DataFrame:
    return files.filter(contains_any(F.col("content"), terms))


def preview_terms(rules: list[dict]) -> list[str]:
    """Method and containing-type names the rules look for."""
    out: dict[str, None] = {}
    for rule in rules:
        for node in rule.get("target_nodes") or []:
            for key in ("method_name", "containing_type"):
                if node.get(key):
                    out.setdefault(node[key])
    return list(out)


def affected_files(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Static preview: C# files that hold a method or type name of any rule, and whether one is called."""
    terms = preview_terms(rules)
    called = [n["method_name"] for r in rules for n in r.get("target_nodes") or [] if n.get("method_name")]
    call = F.lit(False)
    for name in dict.fromkeys(called):
        call = call | has_call(F.col("content"), name)
    code = files.filter(F.col("path").endswith(".cs"))
    hit = contains_any(F.col("content"), terms) if terms else F.lit(False)
    return code.filter(hit).select("repo_id", "path", call.alias("has_call"))


# What a previewed change of a file is called.
CHANGE_TYPE = "potential_change"
CHANGE_DESCRIPTION = "File contains patterns that may be affected by migration rules"


def potential_changes(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Change rows of the static preview: (repo_id, path, type, description, rules).

    ``rules`` names, in order, the rules that look for something the file holds. A rule without names to look for
    applies to no file; one without a name of its own is shown as such.
    """
    looked_for = [(rule.get("name") or "Unnamed rule", preview_terms([rule])) for rule in rules]
    tests = [F.when(contains_any(F.col("content"), terms), F.lit(name)) for name, terms in looked_for if terms]
    found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    # Exploding one entry for files with any rule keeps the tests to one evaluation per file.
    entry = F.transform(F.filter(F.array(found), lambda names: F.size(names) > 0), lambda names: F.struct(names.alias("rules")))
    return (
        files.filter(F.col("path").endswith(".cs"))
        .select("repo_id", "path", F.explode(entry).alias("e"))
        .select("repo_id", "path", F.lit(CHANGE_TYPE).alias("type"), F.lit(CHANGE_DESCRIPTION).alias("description"), "e.rules")
    )


def distinct_hits(hits: DataFrame) -> DataFrame:
    """Code-search hits as distinct paths per repository and term: path, else file name; first kept."""
    path = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.nullif(F.col("filename"), F.lit("")))
    return (
        hits.withColumn("path", path)
        .filter(F.col("path").isNotNull())
        .groupBy("repo_id", "term", "path")
        .agg(F.min("ord").alias("ord"))
    )


def hits_among(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Candidate files some search hit names."""
    found = hits.select("repo_id", "path").distinct()
    return candidates.join(found, ["repo_id", "path"], "left_semi")
