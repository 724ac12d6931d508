"""Jobs over whole code corpora: inventories, rule hits, rewriting, previews."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbump.functions import code
from fleetbump.functions.lines import changes
from fleetbump.functions.patterns import let, newline_of, normalize_newlines
from fleetbump.operators.rules import contains_any


def call_inventory(files: DataFrame) -> DataFrame:
    """One row per call: (repo_id, path, line, receiver, method, arguments, chain)."""
    found = files.select("repo_id", "path", F.explode(code.calls(code.mark_calls(F.col("content")))).alias("c"))
    return found.select("repo_id", "path", *code.call_fields(F.col("c")))


_PARAMETER = "struct<type:string,name:string,attributes:array<string>>"
_DECLARATION = (
    f"struct<kind:string,name:string,type:string,attributes:array<string>,parameters:array<{_PARAMETER}>>"
)


def _declaration(kind: str, name: Column, type_: Column, attributes: Column, params: Column | None = None) -> Column:
    none = F.array().cast(f"array<{_PARAMETER}>")
    return F.struct(
        F.lit(kind).alias("kind"),
        name.alias("name"),
        type_.alias("type"),
        attributes.alias("attributes"),
        (none if params is None else params).alias("parameters"),
    ).cast(_DECLARATION)


def _as_rows(params: Column) -> Column:
    return F.transform(
        params, lambda p: _declaration("parameter", p["name"], p["type"], p["attributes"], F.array(p))
    )


def _members(text: Column) -> Column:
    """Methods, fields and parameters of one piece of code; each pattern runs over it once."""

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def method(m: Column) -> Column:
        return _declaration(
            "method",
            F.regexp_extract(m, code.METHOD, 4),
            F.regexp_extract(m, code.METHOD, 3),
            code.attribute_names(F.regexp_extract(m, code.METHOD, 1)),
            code.parameters(F.regexp_extract(m, code.METHOD, 5)),
        )

    # Without a modifier, "Type Name(...);" may as well be a local variable: only bodies count there.
    real = F.filter(
        found(code.METHOD),
        lambda m: (F.regexp_extract(m, code.METHOD, 2) != "") | (F.regexp_extract(m, code.METHOD, 6) != ";"),
    )
    methods = let(
        F.transform(real, method),
        lambda rows: F.concat(rows, F.flatten(F.transform(rows, lambda r: _as_rows(r["parameters"])))),
    )
    built = F.flatten(
        F.transform(
            found(code.CONSTRUCTOR), lambda m: _as_rows(code.parameters(F.regexp_extract(m, code.CONSTRUCTOR, 3)))
        )
    )

    def variables(m: Column) -> Column:
        listed = F.split(F.regexp_replace(F.regexp_extract(m, code.FIELD, 4), r"=[^,]*", ""), ",")
        names = F.filter(F.transform(listed, lambda n: F.trim(n)), lambda n: n.rlike(f"^{code.ID}$"))
        return F.transform(
            names,
            lambda n: _declaration(
                "field",
                n,
                F.regexp_extract(m, code.FIELD, 3),
                code.attribute_names(F.regexp_extract(m, code.FIELD, 1)),
            ),
        )

    fields = F.flatten(F.transform(found(code.FIELD), variables))
    return F.concat(methods, built, fields)


def declaration_inventory(files: DataFrame) -> DataFrame:
    """Classes, methods, fields and parameters as one table.

    (repo_id, path, containing_class, kind, name, type, attributes, parameters). The containing class is
    the innermost class around the member; a struct, interface or record around it is passed over. A class
    contains itself. One scan, one stage.
    """
    pieces = files.select("repo_id", "path", F.explode(code.class_pieces(F.col("content"))).alias("text"))
    header = F.regexp_extract("text", rf"^\s*+{code.CLASS_HEADER}", 1)
    owner = F.when(header != "", F.regexp_extract(header, rf"({code.ID})$", 1))
    own = _declaration(
        "class",
        owner,
        F.lit(None).cast("string"),
        code.attribute_names(F.regexp_extract(header, r"^((?:\[[^\[\]]*+\]\s*+)*+)", 1)),
    )
    classes = F.when(owner.isNotNull(), F.array(own)).otherwise(F.array().cast(f"array<{_DECLARATION}>"))
    rows = pieces.select(
        "repo_id", "path", owner.alias("containing_class"), F.explode(F.concat(classes, _members(F.col("text")))).alias("d")
    )
    return rows.select("repo_id", "path", "containing_class", "d.*")


# Node types of rules and the inventory rows they look at.
_KINDS = {
    "invocationexpression": "call",
    "methoddeclaration": "method",
    "classdeclaration": "class",
    "fielddeclaration": "field",
    "parameterdeclaration": "parameter",
}


_ANY_NAME = "*"  # no C# name
_SHARES = 32  # Fixed value: rows of one kind and name, or of any name, are dealt to as many joins


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _targets(nodes: DataFrame) -> DataFrame:
    """Rule nodes with the inventory kind and the lower-cased name they ask for, or the sign for any."""
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.lower("node.type")]
    name = (
        F.when(kind.isin("call", "method"), F.col("node.method_name"))
        .when(kind == "class", F.col("node.class_name"))
        .otherwise(F.col("node.identifier"))
    )
    return nodes.select(
        "migration_id",
        "rule_ord",
        "rule_name",
        "node_ord",
        kind.alias("_kind"),
        F.coalesce(F.lower(F.nullif(name, F.lit(""))), F.lit(_ANY_NAME)).alias("_name"),
        F.lower("node.containing_type").alias("_class"),
        F.coalesce("node.attributes", F.array().cast("array<string>")).alias("_attributes"),
        F.coalesce("node.parameters", F.array().cast("array<struct<type:string,name:string>>")).alias("_parameters"),
    ).filter(F.col("_kind").isNotNull())


def _declaration_matches() -> Column:
    """Class, attribute and parameter demands of a node against one declaration."""
    in_class = ~_given(F.col("_class")) | F.coalesce(F.lower("containing_class") == F.col("_class"), F.lit(False))
    attributes = F.forall("_attributes", lambda wanted: F.exists("attributes", lambda a: F.contains(a, wanted)))

    def fits(actual: Column, wanted: Column) -> Column:
        type_ok = ~_given(wanted["type"]) | F.contains(actual["type"], wanted["type"])
        name_ok = ~_given(wanted["name"]) | (F.lower(actual["name"]) == F.lower(wanted["name"]))
        return type_ok & name_ok

    no_demand = F.size("_parameters") == 0
    all_fit = (F.size("_parameters") == F.size("parameters")) & F.forall(
        F.zip_with("parameters", "_parameters", fits), lambda ok: F.coalesce(ok, F.lit(False))
    )
    first_type = F.get("_parameters", F.lit(0))["type"]
    type_fits = ~_given(first_type) | F.contains(F.col("type"), first_type)
    return (
        F.when(F.col("kind") == "class", attributes)
        .when(F.col("kind") == "field", in_class & attributes)
        .when(F.col("kind") == "parameter", no_demand | type_fits)
        .otherwise(in_class & attributes & (no_demand | all_fit))
    )


def rule_hits(inventory: DataFrame, nodes: DataFrame, declarations: bool) -> DataFrame:
    """Inventory rows with every rule node that matches them.

    Nodes that name something join on (kind, name); those that do not apply to all rows of their kind.
    Type and namespace demands are not checked for calls: text alone cannot tell.
    """
    rows = inventory if declarations else inventory.withColumn("kind", F.lit("call")).withColumn("name", F.col("method"))
    # A row is looked up under its own name and under the sign for "any", so the inventory runs once. Half of all these rows
    # have the sign, so rows are dealt into shares, each of which meets the same nodes.
    keyed = (
        rows.withColumn("_kind", F.col("kind"))
        .withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.lit(_SHARES)).cast("int"))
        .withColumn("_name", F.explode(F.array(F.lower("name"), F.lit(_ANY_NAME))))
    )
    shares = F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1)))
    hits = keyed.join(_targets(nodes).withColumn("_share", shares), ["_kind", "_name", "_share"]).drop("_share")
    if declarations:
        hits = hits.filter(_declaration_matches())
    return hits.drop("_kind", "_name", "_class", "_attributes", "_parameters")


# ---- rewriting -----------------------------------------------------------------------------------

_CALL_ACTIONS = ("remove_invocation", "replace_invocation", "remove_argument")


def _call_steps(rules: list[dict]) -> list[tuple[int, str, dict, dict]]:
    """(rule position, rule name, node, action) of the nodes that rewrite calls, in order."""
    steps = []
    for i, rule in enumerate(rules):
        action = rule.get("action") or {}
        if str(action.get("type", "")).lower() in _CALL_ACTIONS:
            for node in rule.get("target_nodes") or []:
                if str(node.get("type", "")).lower() == "invocationexpression":
                    steps.append((i, rule.get("name", ""), node, action))
    return steps


def _rewrite(marked: Column, node: dict, action: dict) -> Column:
    method = node.get("method_name") or None
    kind = str(action["type"]).lower()
    if kind == "replace_invocation":
        return code.rename_call(marked, method, action.get("replacement_method"))
    if kind == "remove_invocation":
        return code.remove_call(marked, method)
    return code.remove_argument(marked, method, action.get("argument_name"))


def _mentions(text: Column, method: str | None) -> Column:
    return F.contains(F.lower(text), F.lit(method.lower())) if method else F.lit(True)


_NO_RULES = "array<struct<rule_ord:int,name:string>>"


def _candidates(files: DataFrame, steps: list[tuple[int, str, dict, dict]]) -> DataFrame:
    """Code files that name a method some rule looks for: a plain text test before any pattern runs."""
    wanted = F.lit(False)
    for name in dict.fromkeys(node.get("method_name") for _, _, node, _ in steps):
        wanted = wanted | _mentions(F.col("content"), name)
    return files.filter(F.col("path").endswith(".cs") & wanted)


def _next(before: Column, node: dict, action: dict) -> Column:
    rewritten = F.when(_mentions(before, node.get("method_name")), _rewrite(before, node, action)).otherwise(before)
    argument = action.get("argument_name")
    if str(action["type"]).lower() != "remove_argument" or not argument:
        return rewritten
    # The variable behind a dropped argument may have lost its last use.
    return let(rewritten, lambda t: F.when(t != before, code.remove_unused_local(t, argument)).otherwise(t))


def _folded(content: Column, steps: list[tuple[int, str, dict, dict]], finish) -> Column:
    """``finish`` of the marked text before the first step and after each one.

    Every state is computed once and one file is one expression: a single narrow stage, no shuffle.
    """

    def go(states: list[Column]) -> Column:
        done = len(states) - 1
        if done == len(steps):
            return finish(states)
        _, _, node, action = steps[done]
        return let(_next(states[-1], node, action), lambda t: go([*states, t]))

    return let(code.mark_calls(content), lambda t: go([t]))


def _needs_review(content: Column, states: list[Column], steps: list[tuple[int, str, dict, dict]]) -> list[tuple[str, Column]]:
    """(method, test) for names left in strings, comments or calls that could not be bounded."""
    tests = []
    for _, _, node, action in steps:
        method = node.get("method_name")
        if method:
            test = code.in_text(content, states[0], method)
            if str(action["type"]).lower() == "remove_invocation":
                test = test | code.left_over(states[-1], method)
            elif str(action["type"]).lower() == "remove_argument":
                test = test | code.unbounded(states[-1], method)
            tests.append((method, F.when(_mentions(content, method), test).otherwise(F.lit(False))))
    return tests


def existing_files(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Requested paths that exist, with their contents."""
    return files.join(requested.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")


def apply_rules(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Rewrite code files with call rules, in order; files that end unchanged are dropped.

    (repo_id, path, content, applied: array<struct<rule_ord, name>>, needs_review). Rules of other
    kinds are no-ops here. Line ends of the file are kept.
    """
    steps = _call_steps(rules)
    if not steps:
        return files.limit(0).select(
            "repo_id", "path", "content", F.array().cast(_NO_RULES).alias("applied"), F.lit(False).alias("needs_review")
        )
    content = F.col("content")
    names = {ord_: name for ord_, name, _, _ in steps}

    def finish(states: list[Column]) -> Column:
        changed: dict[int, Column] = {}
        for i, (ord_, _, _, _) in enumerate(steps):
            test = states[i] != states[i + 1]
            changed[ord_] = changed[ord_] | test if ord_ in changed else test
        entries = [
            F.when(test, F.struct(F.lit(o).alias("rule_ord"), F.lit(names[o]).alias("name"))) for o, test in changed.items()
        ]
        review = F.lit(False)
        for _, test in _needs_review(content, states, steps):
            review = review | test
        result = F.struct(
            let(code.unmark(states[-1]), lambda t: normalize_newlines(t, newline_of(content))).alias("content"),
            F.array_compact(F.array(*entries)).alias("applied"),
            review.alias("needs_review"),
        )
        return F.when(states[0] != states[-1], result)

    # Exploding what is left after dropping nulls keeps the whole rewrite to one evaluation per file.
    done = F.array_compact(F.array(_folded(content, steps, finish)))
    return (
        _candidates(files, steps)
        .select("repo_id", "path", F.explode(done).alias("r"))
        .select("repo_id", "path", "r.content", "r.applied", "r.needs_review")
    )


def files_to_review(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Files that name a rule's method where no safe rewrite is possible (repo_id, path, method)."""
    steps = _call_steps(rules)
    if not steps:
        return files.limit(0).select("repo_id", "path", F.lit("").alias("method"))
    content = F.col("content")

    def finish(states: list[Column]) -> Column:
        found = [F.when(test, F.lit(method)) for method, test in _needs_review(content, states, steps)]
        return F.array_distinct(F.array_compact(F.array(*found)))

    methods = _folded(content, steps, finish)
    return _candidates(files, steps).select("repo_id", "path", F.explode(methods).alias("method"))


_LINE = re.compile(r"\r?\n")
_CHANGE = ["repo_id", "path", "line", "rule", "original", "replacement"]


def preview_changes(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Line changes per file and rule: (repo_id, path, line, rule, original, replacement).

    The versions before and after each rule are aligned by lines (``functions.lines``), inside the task that
    rewrites them; only files that a rule changes leave the JVM.
    """
    steps = _call_steps(rules)
    if not steps:
        return files.limit(0).select(
            "repo_id", "path", F.lit(0).cast("bigint").alias("line"), *[F.lit("").alias(c) for c in ("rule", "original", "replacement")]
        )

    def finish(states: list[Column]) -> Column:
        pairs = [
            F.when(
                states[i] != states[i + 1],
                F.struct(F.lit(name).alias("rule"), code.unmark(states[i]).alias("b"), code.unmark(states[i + 1]).alias("a")),
            )
            for i, (_, name, _, _) in enumerate(steps)
        ]
        return F.array_compact(F.array(*pairs))

    each = (
        _candidates(files, steps)
        .select("repo_id", "path", F.explode(_folded(F.col("content"), steps, finish)).alias("p"))
        .select("repo_id", "path", "p.*")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: its lines and changes are all that is held
                repo_id, path, rule, b, a = (column[i] for column in batch.columns)
                found = changes(_LINE.split(b.as_py()), _LINE.split(a.as_py()))
                if found:
                    same = [pa.array([v.as_py()] * len(found), v.type) for v in (repo_id, path, rule)]
                    line, original, replacement = map(list, zip(*found))
                    columns = [same[0], same[1], pa.array(line, pa.int64()), same[2], pa.array(original), pa.array(replacement)]
                    yield pa.RecordBatch.from_arrays(columns, _CHANGE)

    kind = files.schema["repo_id"].dataType.simpleString()
    return each.mapInArrow(
        compared, f"repo_id {kind}, path string, line long, rule string, original string, replacement string"
    )


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of both tables whose content differs.

    Contents are compared by length and 128-bit digest, so only those cross the shuffle.
    """

    def digested(df: DataFrame) -> DataFrame:
        return df.select("repo_id", "path", F.struct(F.length("content"), F.md5(F.col("content").cast("binary"))).alias("d"))

    b, a = digested(before).alias("b"), digested(after).alias("a")
    return b.join(a, ["repo_id", "path"]).filter(F.col("b.d") != F.col("a.d")).select("repo_id", "path")


def back_to_repository(modified: DataFrame, mapping: DataFrame) -> DataFrame:
    """Working-copy paths of modified files as repository paths; paths without a mapping are dropped."""
    return modified.join(mapping, "local_path").select("repo_id", "path")


def ordered_matches(files: DataFrame, terms: list[str]) -> DataFrame:
    return files.filter(contains_any(F.col("content"), terms)).select("path").orderBy("path")
