"""Code-corpus jobs. Each document becomes a C# file that holds its whole text as a comment."""

import re

from pyspark.sql import functions as F

from fleetbump.functions.patterns import newline_of, normalize_newlines
from fleetbump.operators import corpus, rules
from fleetbump.queries import standins as s
from fleetbump.queries.registry import query

# The file before any rule. {more} is an extra use of scanFlag in even documents, {note} a comment
# that mentions a removed call in every third.
BEFORE = """using System;
namespace N{id}
{
    /* {text} */
    [Serializable, Table("t")]
    public class Startup{id}
    {
        private readonly IClock _clock, _spare{id} = Make({n});
        public void Configure{lang}(IServices services, [Bind] bool isEnabled)
        {
            // {note}
            var scanFlag = Read("a(b");
            #region Setup
            OldCall();
            services.Setup({n}).OldCall<{lang}>(f(g(1)), "x)").Next(isEnabled);
            #endregion
            var client = services.Make("{lang}").OldCall();
            services.Renamed(client, isEnabled);
            scanner.AddScan({n}, scanFlag);{more}
        }
    }
}
"""

_REMOVED = {
    "            OldCall();\n": "",
    '.OldCall<{lang}>(f(g(1)), "x)").Next': ".Next",
    '("{lang}").OldCall();': '("{lang}");',
}
_RENAMED = {"services.Renamed(": "services.Fresh("}
_DROPPED = {"AddScan({n}, scanFlag)": "AddScan({n})"}
_LOCAL = {'            // {note}\n            var scanFlag = Read("a(b");\n': ""}


def _after(*changes: dict[str, str]) -> str:
    text = BEFORE
    for change in changes:
        for old, new in change.items():
            assert text.count(old) == 1, old
            text = text.replace(old, new)
    return text


_VALUES = {
    "id": (lambda: s.text("doc_id"), "CAST(doc_id AS VARCHAR)"),
    "text": (lambda: F.col("text"), "text"),
    "lang": (lambda: F.col("lang"), "lang"),
    "n": (lambda: s.text("n_chars"), "CAST(n_chars AS VARCHAR)"),
    "more": (
        lambda: F.when(F.col("doc_id") % 2 == 0, F.lit("\n            Log(scanFlag);")).otherwise(F.lit("")),
        "CASE WHEN doc_id % 2 = 0 THEN chr(10) || '            Log(scanFlag);' ELSE '' END",
    ),
    "note": (
        lambda: F.when(F.col("doc_id") % 3 == 0, F.lit("OldCall() was here")).otherwise(F.lit("nothing")),
        "CASE WHEN doc_id % 3 = 0 THEN 'OldCall() was here' ELSE 'nothing' END",
    ),
}


def _pieces(template: str) -> list[str]:
    return re.split(r"(\{(?:" + "|".join(_VALUES) + r")\})", template)


def _spark_text(template: str):
    parts = [_VALUES[p[1:-1]][0]() if p[1:-1] in _VALUES and p[0] == "{" else F.lit(p) for p in _pieces(template) if p]
    content = F.concat(*parts)
    return F.when(F.col("doc_id") % 5 == 0, F.replace(content, F.lit("\n"), F.lit("\r\n"))).otherwise(content)


def _sql_text(template: str) -> str:
    def literal(p: str) -> str:
        return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in p.split("\n"))

    parts = [_VALUES[p[1:-1]][1] if p[1:-1] in _VALUES and p[0] == "{" else literal(p) for p in _pieces(template) if p]
    content = " || ".join(parts)
    return f"CASE WHEN doc_id % 5 = 0 THEN replace({content}, chr(10), chr(13) || chr(10)) ELSE {content} END"


def _files_of(documents, template):
    return documents.select(
        (F.col("doc_id") % 97).cast("string").alias("repo_id"),
        F.concat(F.lit("src/D"), s.text("doc_id"), F.lit(".cs")).alias("path"),
        _spark_text(template).alias("content"),
    )


def code_files(spark, sf):
    return _files_of(s.spread(s.table(spark, sf, "documents"), "doc_id"), BEFORE)


_PATH = "'src/D' || doc_id || '.cs'"
# Lines the document's own text adds above everything that follows it.
_BREAKS = "length(text) - length(replace(text, chr(10), ''))"

REMOVE = {
    "name": "Remove OldCall",
    "target_nodes": [{"type": "InvocationExpression", "method_name": "oldcall"}],
    "action": {"type": "remove_invocation", "strategy": "smart_chain_aware"},
}
RENAME = {
    "name": "Rename Renamed",
    "target_nodes": [{"type": "invocationexpression", "method_name": "Renamed"}],
    "action": {"type": "replace_invocation", "replacement_method": "Fresh"},
}
DROP = {
    "name": "Drop scanFlag",
    "target_nodes": [{"type": "InvocationExpression", "method_name": "AddScan"}],
    "action": {"type": "remove_argument", "argument_name": "scanFlag"},
}
NOTHING = {
    "name": "Absent",
    "target_nodes": [{"type": "InvocationExpression", "method_name": "NotThere"}, {"type": "Unknown", "method_name": "OldCall"}],
    "action": {"type": "remove_invocation"},
}


def _rewritten(spark, sf, chosen):
    done = corpus.apply_rules(code_files(spark, sf), chosen)
    return done.select(
        "path",
        F.md5(F.col("content").cast("binary")).alias("content_md5"),
        F.array_join(F.transform("applied", lambda a: a["name"]), ",").alias("rules"),
        "needs_review",
    )


@query(
    "calls_renamed",
    f"SELECT {_PATH} AS path, md5({_sql_text(_after(_RENAMED))}) AS content_md5, 'Rename Renamed' AS rules, "
    "false AS needs_review FROM documents",
)
def calls_renamed(spark, sf):
    return _rewritten(spark, sf, [RENAME])


@query(
    "calls_removed",
    f"SELECT {_PATH} AS path, md5({_sql_text(_after(_REMOVED))}) AS content_md5, 'Remove OldCall' AS rules, "
    "doc_id % 3 = 0 AS needs_review FROM documents",
)
def calls_removed(spark, sf):
    return _rewritten(spark, sf, [REMOVE])


_DROPPED_TEXT = f"""CASE WHEN doc_id % 2 = 0 THEN {_sql_text(_after(_DROPPED))} ELSE {_sql_text(_after(_DROPPED, _LOCAL))} END"""


@query(
    "arguments_removed",
    f"SELECT {_PATH} AS path, md5({_DROPPED_TEXT}) AS content_md5, 'Drop scanFlag' AS rules, false AS needs_review FROM documents",
)
def arguments_removed(spark, sf):
    return _rewritten(spark, sf, [DROP])


_ALL_TEXT = f"""CASE WHEN doc_id % 2 = 0 THEN {_sql_text(_after(_REMOVED, _RENAMED, _DROPPED))}
                     ELSE {_sql_text(_after(_REMOVED, _RENAMED, _DROPPED, _LOCAL))} END"""


@query(
    "rules_in_order",
    f"SELECT {_PATH} AS path, md5({_ALL_TEXT}) AS content_md5, 'Drop scanFlag,Remove OldCall,Rename Renamed' AS rules, "
    "doc_id % 3 = 0 AS needs_review FROM documents",
)
def rules_in_order(spark, sf):
    return _rewritten(spark, sf, [DROP, NOTHING, REMOVE, RENAME])


@query(
    "files_to_review",
    f"SELECT {_PATH} AS path, 'oldcall' AS method FROM documents WHERE doc_id % 3 = 0",
)
def files_to_review(spark, sf):
    return corpus.files_to_review(code_files(spark, sf), [REMOVE, RENAME]).select("path", "method")


@query(
    "region_lines_kept",
    "SELECT doc_id % 97 AS repo, count(*) AS files, 2 * count(*) AS region_lines FROM documents GROUP BY 1",
)
def region_lines_kept(spark, sf):
    done = corpus.apply_rules(code_files(spark, sf), [REMOVE])
    return done.groupBy(F.col("repo_id").cast("bigint").alias("repo")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.regexp_count("content", F.lit(r"(?m)^ {12}#(?:end)?region\b"))).alias("region_lines"),
    )


@query(
    "unused_locals_removed",
    "SELECT doc_id % 2 AS odd, count(*) AS files, count_if(doc_id % 2 = 0) AS with_local FROM documents GROUP BY 1",
)
def unused_locals_removed(spark, sf):
    done = corpus.apply_rules(code_files(spark, sf), [DROP])
    odd = F.regexp_extract("path", r"D(\d+)", 1).cast("bigint") % 2
    return done.groupBy(odd.alias("odd")).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.contains("content", F.lit("var scanFlag"))).alias("with_local")
    )


_CALLS = f"""
SELECT {_PATH} AS path, CAST(c.line + {_BREAKS} AS BIGINT) AS line, c.receiver, c.method,
       replace(replace(c.arguments, '@n', CAST(n_chars AS VARCHAR)), '@lang', lang) AS arguments, c.chain
FROM documents JOIN (VALUES
  (8, '', 'Make', '@n', 'single'), (12, '', 'Read', '"a(b"', 'single'), (14, '', 'OldCall', '', 'single'),
  (15, 'services', 'Setup', '@n', 'head'), (15, '', 'OldCall', 'f(g(1)), "x)"', 'middle'), (15, '', 'f', 'g(1)', 'single'),
  (15, '', 'g', '1', 'single'), (15, '', 'Next', 'isEnabled', 'tail'), (17, 'services', 'Make', '"@lang"', 'head'),
  (17, '', 'OldCall', '', 'tail'), (18, 'services', 'Renamed', 'client, isEnabled', 'single'),
  (19, 'scanner', 'AddScan', '@n, scanFlag', 'single'), (20, '', 'Log', 'scanFlag', 'single'))
  AS c(line, receiver, method, arguments, chain) ON c.method <> 'Log' OR doc_id % 2 = 0"""
s.SQL["call_rows"] = _CALLS


@query("call_inventory", "SELECT * FROM call_rows")
def call_inventory(spark, sf):
    return corpus.call_inventory(code_files(spark, sf)).drop("repo_id")


s.SQL["declaration_rows"] = f"""
SELECT {_PATH} AS path, doc_id, d.kind, replace(replace(d.name, '@id', CAST(doc_id AS VARCHAR)), '@lang', lang) AS name, d.type,
       d.attributes, 'Startup' || doc_id AS containing_class, d.params
FROM documents JOIN (VALUES
  ('class', 'Startup@id', NULL, 'Serializable,Table', ''), ('field', '_clock', 'IClock', '', ''),
  ('field', '_spare@id', 'IClock', '', ''), ('method', 'Configure@lang', 'void', '', 'IServices services,bool isEnabled'),
  ('parameter', 'services', 'IServices', '', 'IServices services'), ('parameter', 'isEnabled', 'bool', 'Bind', 'bool isEnabled'))
  AS d(kind, name, type, attributes, params) ON true"""


@query(
    "declaration_inventory",
    "SELECT path, kind, name, type, attributes, containing_class, params FROM declaration_rows",
)
def declaration_inventory(spark, sf):
    rows = corpus.declaration_inventory(code_files(spark, sf))
    return rows.select(
        "path",
        "kind",
        "name",
        "type",
        F.array_join("attributes", ",").alias("attributes"),
        "containing_class",
        F.array_join(F.transform("parameters", lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ",").alias("params"),
    )


def _nodes(spark, *targets):
    entry = {
        "id": "m",
        "package_name": "p",
        "version_conditions": [],
        "rules": [{"name": name, "target_nodes": [node], "action": {"type": "x"}} for name, node in targets],
    }
    return rules.rule_nodes(rules.migrations_table(spark, [entry]))


@query(
    "rule_call_hits",
    """SELECT path, line, method, 'old' AS rule_name FROM call_rows WHERE lower(method) = 'oldcall'
       UNION ALL SELECT path, line, method, 'make' FROM call_rows WHERE method = 'Make'
       UNION ALL SELECT path, line, method, 'any' FROM call_rows """,
)
def rule_call_hits(spark, sf):
    nodes = _nodes(
        spark,
        ("old", {"type": "InvocationExpression", "method_name": "OLDCALL", "containing_type": "Ignored"}),
        ("make", {"type": "invocationexpression", "method_name": "Make"}),
        ("any", {"type": "InvocationExpression"}),
        ("none", {"type": "Other", "method_name": "Make"}),
    )
    hits = corpus.rule_hits(corpus.call_inventory(code_files(spark, sf)), nodes, declarations=False)
    return hits.select("path", "line", "method", "rule_name")


@query(
    "rule_declaration_hits",
    """SELECT path, kind, name, rule_name FROM declaration_rows JOIN (VALUES ('field', '_clock', 'clock field'),
              ('method', 'Configurefr', 'configure'), ('parameter', 'isEnabled', 'bool parameter'), ('class', NULL, 'serializable'),
              ('method', NULL, 'two parameters')) AS r(k, n, rule_name)
       ON kind = k AND (n IS NULL OR lower(name) = lower(n))""",
)
def rule_declaration_hits(spark, sf):
    nodes = _nodes(
        spark,
        ("clock field", {"type": "FieldDeclaration", "identifier": "_CLOCK"}),
        ("wrong class", {"type": "FieldDeclaration", "identifier": "_clock", "containing_type": "Nowhere"}),
        ("configure", {"type": "MethodDeclaration", "method_name": "configureFR"}),
        ("bool parameter", {"type": "ParameterDeclaration", "identifier": "isEnabled", "parameters": [{"type": "boo"}]}),
        ("int parameter", {"type": "ParameterDeclaration", "identifier": "isEnabled", "parameters": [{"type": "int"}]}),
        ("serializable", {"type": "ClassDeclaration", "attributes": ["Serial", "Tab"]}),
        ("missing attribute", {"type": "ClassDeclaration", "attributes": ["Serial", "None"]}),
        (
            "two parameters",
            {"type": "MethodDeclaration", "parameters": [{"type": "IServ", "name": "SERVICES"}, {"type": "bool", "name": None}]},
        ),
        ("one parameter", {"type": "MethodDeclaration", "parameters": [{"type": "IServices", "name": None}]}),
    )
    hits = corpus.rule_hits(corpus.declaration_inventory(code_files(spark, sf)), nodes, declarations=True)
    return hits.select("path", "kind", "name", "rule_name")


@query(
    "previewed_changes",
    f"""SELECT {_PATH} AS path, CAST({_BREAKS} + v.line AS BIGINT) AS line, v.rule,
               replace(replace(v.original, '@n', CAST(n_chars AS VARCHAR)), '@lang', lang) AS original,
               replace(replace(v.replacement, '@n', CAST(n_chars AS VARCHAR)), '@lang', lang) AS replacement
        FROM documents JOIN (VALUES
          (18, 'Rename Renamed', '            services.Renamed(client, isEnabled);', '            services.Fresh(client, isEnabled);'),
          (14, 'Remove OldCall', '            OldCall();', ''),
          (15, 'Remove OldCall', '            services.Setup(@n).OldCall<@lang>(f(g(1)), "x)").Next(isEnabled);', ''),
          (14, 'Remove OldCall', '', '            services.Setup(@n).Next(isEnabled);'),
          (17, 'Remove OldCall', '            var client = services.Make("@lang").OldCall();', ''),
          (16, 'Remove OldCall', '', '            var client = services.Make("@lang");')) AS v(line, rule, original, replacement) ON true""",
)
def previewed_changes(spark, sf):
    return corpus.preview_changes(code_files(spark, sf), [RENAME, REMOVE]).drop("repo_id")


def _body(*lines: str) -> str:
    inner = "".join(f"        {line}\n" if not line.startswith("#") else f"{line}\n" for line in lines)
    return "class A{id}\n{\n    void M(IBuilder b)\n    {\n        Begin();\n" + inner + "        /* {text} */\n    }\n}\n"


# Pairs of a body before and after the three rules, one for each sixth of the documents.
TEMPLATES = [
    (
        _body("b.Start({n})", '    .OldCall("{lang}")', "    .Finish();", "b.OldCall().OldCall({n}).End();"),
        _body("b.Start({n})", "    .Finish();", "b.End();"),
    ),
    (
        _body('var x{n} = Make("{lang}").OldCall();', "return Wrap(x{n}.OldCall(), {n});"),
        _body('var x{n} = Make("{lang}");', "return Wrap(x{n}, {n});"),
    ),
    (
        _body('Renamed<List<int>>(Renamed({n}), "Renamed({lang})");', "// Renamed(1)", "b.Renamed2();", "b?.renamed( 1 );"),
        _body('Fresh<List<int>>(Fresh({n}), "Renamed({lang})");', "// Renamed(1)", "b.Renamed2();", "b?.Fresh( 1 );"),
    ),
    (
        _body(
            "b.AddScan(scanFlag);", 'b.AddScan({n}, scanFlag, mode: "{lang}");', "b.AddScan(scanFlag, {n});",
            "b.AddScan(flag: scanFlag, n: {n});", "b.Other(scanFlag);",
        ),
        _body(
            "b.AddScan();", 'b.AddScan({n}, mode: "{lang}");', "b.AddScan(scanFlag, {n});", "b.AddScan(n: {n});", "b.Other(scanFlag);"
        ),
    ),
    (
        _body("#if DEBUG_{lang}", "OldCall({n});", "#endif", "Keep();", "x.y.OldCall();", "", "// about the call", "OldCall();", "Keep();"),
        _body("#if DEBUG_{lang}", "#endif", "Keep();", "Keep();"),
    ),
    (
        _body(
            'b.OldCall(i => { i.Go({n}); return "a)"; }).Next(z => z.Renamed("{lang}"));', "if (ready) { OldCall(); Keep(); }", "b?.OldCall();"
        ),
        _body('b.Next(z => z.Fresh("{lang}"));', "if (ready) { Keep(); }", "b?.OldCall();"),
    ),
]


def _template_sql(place: int) -> str:
    cases = " ".join(f"WHEN {i} THEN {_sql_text(pair[place])}" for i, pair in enumerate(TEMPLATES))
    return f"CASE doc_id % {len(TEMPLATES)} {cases} END"


@query(
    "rewritten_templates",
    f"SELECT {_PATH} AS path, md5({_template_sql(1)}) AS content_md5, doc_id % {len(TEMPLATES)} AS template FROM documents",
)
def rewritten_templates(spark, sf):
    documents = s.table(spark, sf, "documents")
    files = None
    for i, (before, _) in enumerate(TEMPLATES):
        own = _files_of(documents.filter(F.col("doc_id") % len(TEMPLATES) == i), before)
        files = own if files is None else files.unionByName(own)
    done = corpus.apply_rules(files, [DROP, REMOVE, RENAME])
    number = F.regexp_extract("path", r"D(\d+)", 1).cast("bigint")
    return done.select(
        "path", F.md5(F.col("content").cast("binary")).alias("content_md5"), (number % len(TEMPLATES)).alias("template")
    )


# Types inside, beside and after each other; {text} stands inside the innermost but one.
NESTED = """using System;
namespace N{id}
{
    public class Outer{id}
    {
        struct Pair { public int Left{n}; }
        [Serializable]
        class Inner{lang}
        {
            /* {text} */
            private int _deep = Make(new T { X = {n} });
            void Run(int times) { if (times > 0) { Go(); } }
            class Core { void Turn(bool on) { } }
            void Late() { }
        }
        private IClock _clock;
        void After(int q) { }
    }
    class Sibling { int Plain(int a) => a; }
    struct Alone { public int Z; void Free() { } }
}
"""

s.SQL["nested_rows"] = f"""
SELECT {_PATH} AS path, lang, d.kind, replace(replace(replace(d.name, '@id', CAST(doc_id AS VARCHAR)), '@lang', lang), '@n',
       CAST(n_chars AS VARCHAR)) AS name, d.type,
       replace(replace(d.owner, '@id', CAST(doc_id AS VARCHAR)), '@lang', lang) AS containing_class
FROM documents JOIN (VALUES
  ('class', 'Outer@id', NULL, 'Outer@id'), ('class', 'Inner@lang', NULL, 'Inner@lang'), ('class', 'Core', NULL, 'Core'),
  ('class', 'Sibling', NULL, 'Sibling'), ('field', 'Left@n', 'int', 'Outer@id'), ('field', '_deep', 'int', 'Inner@lang'),
  ('method', 'Run', 'void', 'Inner@lang'), ('parameter', 'times', 'int', 'Inner@lang'), ('method', 'Turn', 'void', 'Core'),
  ('parameter', 'on', 'bool', 'Core'), ('method', 'Late', 'void', 'Inner@lang'), ('field', '_clock', 'IClock', 'Outer@id'),
  ('method', 'After', 'void', 'Outer@id'), ('parameter', 'q', 'int', 'Outer@id'), ('method', 'Plain', 'int', 'Sibling'),
  ('parameter', 'a', 'int', 'Sibling'), ('field', 'Z', 'int', NULL), ('method', 'Free', 'void', NULL))
  AS d(kind, name, type, owner) ON true"""


def _nested(spark, sf):
    return corpus.declaration_inventory(_files_of(s.table(spark, sf, "documents"), NESTED))


@query("nested_declarations", "SELECT path, kind, name, type, containing_class FROM nested_rows")
def nested_declarations(spark, sf):
    return _nested(spark, sf).select("path", "kind", "name", "type", "containing_class")


@query(
    "nested_rule_hits",
    """SELECT path, kind, name, 'in core' AS rule_name FROM nested_rows WHERE kind = 'method' AND containing_class = 'Core'
       UNION ALL SELECT path, kind, name, 'late' FROM nested_rows WHERE name = 'Late' AND lang = 'en'
       UNION ALL SELECT path, kind, name, 'sibling method' FROM nested_rows WHERE kind = 'method' AND containing_class = 'Sibling'""",
)
def nested_rule_hits(spark, sf):
    nodes = _nodes(
        spark,
        ("in core", {"type": "MethodDeclaration", "containing_type": "CORE"}),
        ("late", {"type": "MethodDeclaration", "method_name": "late", "containing_type": "InnerEn"}),
        ("sibling method", {"type": "MethodDeclaration", "containing_type": "Sibling"}),
        ("clock in core", {"type": "FieldDeclaration", "identifier": "_clock", "containing_type": "Core"}),
        ("method of a struct", {"type": "MethodDeclaration", "method_name": "Free", "containing_type": "Alone"}),
        ("field of a struct", {"type": "FieldDeclaration", "containing_type": "Pair"}),
    )
    return corpus.rule_hits(_nested(spark, sf), nodes, declarations=True).select("path", "kind", "name", "rule_name")


# The same lines before and after what a rule removes.
REPEATED = """class C{id}
{
    void M()
    {
        // setup {lang}
        Begin();
        // setup {lang}
        OldCall();
        /* {text} */
        // setup {lang}
        Begin();
        x.OldCall({n});
        Begin();
        // {lang}
        // setup {lang}
    }
}
"""


@query(
    "previewed_repeated_lines",
    f"""SELECT {_PATH} AS path, CAST(v.line + CASE WHEN v.line > 9 THEN {_BREAKS} ELSE 0 END AS BIGINT) AS line, 'Remove OldCall' AS rule,
               replace(replace(v.original, '@n', CAST(n_chars AS VARCHAR)), '@lang', lang) AS original, '' AS replacement
        FROM documents JOIN (VALUES (7, '        // setup @lang'), (8, '        OldCall();'), (12, '        x.OldCall(@n);')) AS v(line, original)
        ON true""",
)
def previewed_repeated_lines(spark, sf):
    files = _files_of(s.table(spark, sf, "documents"), REPEATED)
    return corpus.preview_changes(files, [REMOVE]).drop("repo_id")


@query(
    "requested_files_existing",
    f"SELECT {_PATH} AS path, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def requested_files_existing(spark, sf):
    wanted = s.table(spark, sf, "labels").filter(F.col("quality") == 1)
    names = F.concat(F.lit("src/D"), s.text("doc_id"), F.lit(".cs"))
    requested = wanted.select((F.col("doc_id") % 97).cast("string").alias("repo_id"), names.alias("path"))
    missing = requested.withColumn("path", F.concat("path", F.lit(".gone")))
    files = s.table(spark, sf, "documents").select(
        (F.col("doc_id") % 97).cast("string").alias("repo_id"), names.alias("path"), "n_chars"
    )
    return corpus.existing_files(requested.unionByName(missing), files).select("path", "n_chars")


@query(
    "changed_file_contents",
    f"SELECT {_PATH} AS path FROM documents WHERE contains(text, 'er')",
)
def changed_file_contents(spark, sf):
    before = s.table(spark, sf, "documents").select(
        F.lit("r").alias("repo_id"), F.concat(F.lit("src/D"), s.text("doc_id"), F.lit(".cs")).alias("path"), F.col("text").alias("content")
    )
    after = before.withColumn("content", F.replace("content", F.lit("er"), F.lit("ar")))
    return corpus.changed_files(before, after).select("path")


@query(
    "working_paths_mapped",
    """SELECT CAST(l_suppkey AS VARCHAR) AS repo_id, l_orderkey || '/' || l_linenumber || '-' || l_partkey AS path
       FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'""",
)
def working_paths_mapped(spark, sf):
    path = F.concat(s.text("l_orderkey"), F.lit("/"), s.text("l_linenumber"), F.lit("-"), s.text("l_partkey"))
    rows = s.table(spark, sf, "lineitem").withColumn("path", path)
    local = F.concat(F.lit("/work/"), s.text("l_suppkey"), F.lit("/"), F.col("path"))
    modified = rows.filter(F.col("l_returnflag") == "A").select(local.alias("local_path"))
    mapping = rows.filter(F.col("l_linestatus") == "F").select(
        local.alias("local_path"), s.text("l_suppkey").alias("repo_id"), "path"
    )
    return corpus.back_to_repository(modified, mapping)


@query(
    "ordered_matching_paths",
    "SELECT url AS path FROM pages WHERE contains(html, '<table') OR contains(html, 'script') ORDER BY url",
)
def ordered_matching_paths(spark, sf):
    files = s.table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))
    return corpus.ordered_matches(files, ["<table", "script"])


@query(
    "normalized_newlines",
    """SELECT page_id, crlf, md5(CASE WHEN crlf THEN replace(plain, chr(10), chr(13) || chr(10)) ELSE plain END) AS content_md5 FROM (
         SELECT page_id, contains(raw, chr(13) || chr(10)) AS crlf,
                replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS plain FROM (
           SELECT page_id, replace(CASE WHEN page_id % 2 = 0 THEN replace(html, '</p>', chr(13) || chr(10)) ELSE html END, ' the ',
                          chr(13) || 'x') AS raw FROM pages))""",
)
def normalized_newlines(spark, sf):
    html = F.col("html")
    mixed = F.when(F.col("page_id") % 2 == 0, F.replace(html, F.lit("</p>"), F.lit("\r\n"))).otherwise(html)
    raw = s.table(spark, sf, "pages").select("page_id", F.replace(mixed, F.lit(" the "), F.lit("\rx")).alias("raw"))
    nl = newline_of(F.col("raw"))
    return raw.select(
        "page_id",
        (nl == "\r\n").alias("crlf"),
        F.md5(normalize_newlines(F.col("raw"), nl).cast("binary")).alias("content_md5"),
    )


@query(
    "file_base_names",
    "SELECT page_id, split_part(url, '/', -1) AS base FROM pages",
)
def file_base_names(spark, sf):
    from fleetbump.functions.patterns import base_name

    return s.table(spark, sf, "pages").select("page_id", base_name(F.col("url")).alias("base"))
