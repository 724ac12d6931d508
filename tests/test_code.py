"""Code rewriting and inventories on literal C# files."""

import re

import pytest
from pyspark.sql import functions as F

from fleetbump.functions import code
from fleetbump.operators import corpus


def rule(kind, method, name="r", **action):
    return {
        "name": name,
        "target_nodes": [{"type": "InvocationExpression", "method_name": method}],
        "action": {"type": kind, **action},
    }


def apply(spark, content, *rules):
    df = spark.createDataFrame([("r", "a.cs", content)], "repo_id string, path string, content string")
    rows = corpus.apply_rules(df, list(rules)).collect()
    return rows[0] if rows else None


def removed(spark, content, method="Old"):
    row = apply(spark, content, rule("remove_invocation", method))
    return row.content if row else content


CHAIN = """void M() {
    s.A()
      .Config()
      .Old()
      .B();
    var x = s.A()
        .Old<T>(1, f(g(2)))
        .B();
    _ = s.A().Config().Old().B();
}
"""


def test_links_go_and_the_rest_of_the_chain_stays(spark):
    got = removed(spark, CHAIN)
    assert "Old" not in got
    assert got.count(".B()") == 3 and got.count(".Config()") == 2
    assert "var x = s.A()\n        .B();" in got


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ("{\n    Old();\n    Keep();\n}\n", "{\n    Keep();\n}\n"),
        ("{\n    a.b.Old(1);\n}\n", "{\n}\n"),
        ("{\n    Keep();\n\n    // about the call\n    Old();\n    Keep();\n}\n", "{\n    Keep();\n    Keep();\n}\n"),
        ("{ Old(); Keep(); }", "{ Keep(); }"),
        ("x = s.A().Old();", "x = s.A();"),
        ("s.A().Old();", "s.A();"),
        ("s.A().Old().Old().Old();", "s.A();"),
        ("{\n  s.Old().Old();\n}\n", "{\n}\n"),
        ("return s.Old();", "return s;"),
        ("F(s.Old(), 2);", "F(s, 2);"),
        ("y = Old().Next();", "y = Next();"),
        ("y = Old();", "y = Old();"),
        ("s?.Old();", "s?.Old();"),
        ("// Old();\nvar t = \"Old();\";", "// Old();\nvar t = \"Old();\";"),
        ("void Old() { }", "void Old() { }"),
        ("x = new Old();", "x = new Old();"),
        ("x = s.Older().B();", "x = s.Older().B();"),
        ('x = s.A().Old(")", \'(\', @"\\").B();', "x = s.A().B();"),
        ("x = s.A().Old(y => { y.Z(1); return 2; }).B();", "x = s.A().B();"),
        ("x =\n    s.Old();\n", "x =\n    s;\n"),
    ],
)
def test_removal_cases(spark, content, expected):
    assert removed(spark, content) == expected


def test_directives_stay(spark):
    content = (
        "{\n    #region One\n    Old();\n    Keep();\n    #endregion\n\n    #region Two\n    Old();\n    Keep();\n    #endregion\n"
        "    #if X\n    Old();\n    #endif\n}\nvoid Old() { }\n"
    )
    got = removed(spark, content)
    for mark in ("#region One", "#region Two", "#if X", "#endif"):
        assert mark in got
    assert got.count("#endregion") == 2 and got.count("Keep();") == 2 and got.count("Old()") == 1


@pytest.mark.parametrize("nl", ["\n", "\r\n"])
def test_newlines_are_kept(spark, nl):
    content = CHAIN.replace("\n", nl)
    got = removed(spark, content)
    assert (got.count("\r\n") > 0) == (nl == "\r\n")
    assert "\n" not in got.replace(nl, "")


def test_too_deep_is_left_for_review(spark):
    content = "x = s.Old(a(b(c(d(e(1)))))).B(); y = s.Old().B();"
    row = apply(spark, content, rule("remove_invocation", "Old"))
    assert row.content == "x = s.Old(a(b(c(d(e(1)))))).B(); y = s.B();"
    assert row.needs_review


def test_rename(spark):
    content = "a.Old<int>(1); old(2); Old (3); void Old() {} // Old()\nx.Older(); nameof(Old);"
    row = apply(spark, content, rule("replace_invocation", "Old", replacement_method="New$1"))
    assert row.content == "a.New$1<int>(1); New$1(2); New$1 (3); void Old() {} // Old()\nx.Older(); nameof(Old);"
    assert row.needs_review
    assert apply(spark, content, rule("replace_invocation", "Old", replacement_code="New")) is None


@pytest.mark.parametrize(
    ("call", "expected"),
    [
        ("s.Add(config, flag);", "s.Add(config);"),
        ("s.Add(flag);", "s.Add();"),
        ("s.Add(flag, 2);", "s.Add(flag, 2);"),
        ("s.Add(x: flag, y: 2);", "s.Add(y: 2);"),
        ("s.Add(1, x: flag, y: f(2, 3));", "s.Add(1, y: f(2, 3));"),
        ("s.Add(flag, y: 2);", "s.Add(y: 2);"),
        ("s.Add(1, flag, y: 2, z: g(1));", "s.Add(1, y: 2, z: g(1));"),
        ("s.Add(1, x: flag);", "s.Add(1);"),
        ("s.Add(flag, flag);", "s.Add();"),
        ("s.Add(f(flag), flag2);", "s.Add(f(flag), flag2);"),
        ("s.Add(Flag);", "s.Add(Flag);"),
        ("s.Other(flag);", "s.Other(flag);"),
        ("s.Add(\"a, flag\", new[] { 1, flag }, flag);", "s.Add(\"a, flag\", new[] { 1, flag });"),
    ],
)
def test_argument_removal(spark, call, expected):
    row = apply(spark, call, rule("remove_argument", "Add", argument_name="flag"))
    assert (row.content if row else call) == expected


LOCAL = """class E { public static void Add(this object s, object c, bool flag) { } }
class T {
    void M(object s) {
        var flag = Convert.ToBoolean("x");
        s.Add(s, flag);
%s    }
}
"""


def test_unused_local_goes(spark):
    row = apply(spark, LOCAL % "", rule("remove_argument", "Add", argument_name="flag"))
    assert row.content == (LOCAL % "").replace('        var flag = Convert.ToBoolean("x");\n', "").replace("(s, flag)", "(s)")


def test_used_local_stays(spark):
    text = LOCAL % "        if (flag) { Log(); }\n"
    row = apply(spark, text, rule("remove_argument", "Add", argument_name="flag"))
    assert row.content == text.replace("(s, flag)", "(s)")


def test_rules_apply_in_order(spark):
    rules = [
        rule("replace_invocation", "First", "one", replacement_method="Second"),
        rule("remove_invocation", "Second", "two"),
        rule("remove_invocation", "Never", "three"),
        {"name": "four", "target_nodes": [{"type": "ClassDeclaration"}], "action": {"type": "rename_class"}},
    ]
    row = apply(spark, "x = s.First().Last();", *rules)
    assert row.content == "x = s.Last();"
    assert [(a.rule_ord, a.name) for a in row.applied] == [(0, "one"), (1, "two")]
    assert apply(spark, "x = s.Last();", *rules) is None


def test_only_code_files(spark):
    df = spark.createDataFrame([("r", "a.txt", "s.Old();")], "repo_id string, path string, content string")
    assert corpus.apply_rules(df, [rule("remove_invocation", "Old")]).count() == 0
    assert corpus.apply_rules(df, []).count() == 0


FILE = """using System;
[Serializable, DataContract(Name = "x")]
public sealed class Startup
{
    [Key] private readonly Map<string, int> _map = new Map<string, int>(), _other;
    public const int A = 1;
    public event Action Changed;
    public int Size { get; set; }
    public int Twice => Size * 2;
    public Startup(IHost host) : base(host) { }
    [Obsolete("old")]
    public async Task<List<int>> Run([Bind] this IHost host, params string[] names, Map<int, string> m = null) { return await Go(1); }
    int Plain(int a) => a;
}
struct Point { public int X; }
"""


def test_declarations(spark):
    df = spark.createDataFrame([("r", "a.cs", FILE)], "repo_id string, path string, content string")
    rows = corpus.declaration_inventory(df).collect()
    found = {(r.kind, r.name, r.type, ",".join(r.attributes), r.containing_class) for r in rows}
    assert {f for f in found if f[0] == "class"} == {("class", "Startup", None, "Serializable,DataContract", "Startup")}
    assert {f for f in found if f[0] == "method"} == {
        ("method", "Run", "Task<List<int>>", "Obsolete", "Startup"),
        ("method", "Plain", "int", "", "Startup"),
    }
    assert {f[1:3] for f in found if f[0] == "field"} == {
        ("_map", "Map<string, int>"),
        ("_other", "Map<string, int>"),
        ("A", "int"),
        ("X", "int"),
    }
    assert {(f[1], f[2], f[3]) for f in found if f[0] == "parameter"} == {
        ("host", "IHost", ""),
        ("host", "IHost", "Bind"),
        ("names", "string[]", ""),
        ("m", "Map<int, string>", ""),
        ("a", "int", ""),
    }


def owners(spark, text):
    df = spark.createDataFrame([("r", "a.cs", text)], "repo_id string, path string, content string")
    rows = corpus.declaration_inventory(df).collect()
    return {(r.kind, r.name): r.containing_class for r in rows}, len(rows)


def test_members_belong_to_the_innermost_class(spark):
    text = "class Outer { class Inner { int a; void In(int p) { if (p > 0) { } } } private int _c; void After(int q) { Go(new T { X = 1 }); } }"
    found, rows = owners(spark, text.replace("int a;", "private int a;"))
    assert found == {
        ("class", "Outer"): "Outer", ("class", "Inner"): "Inner", ("field", "a"): "Inner", ("method", "In"): "Inner",
        ("parameter", "p"): "Inner", ("field", "_c"): "Outer", ("method", "After"): "Outer", ("parameter", "q"): "Outer",
    }
    assert rows == 8


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("class A { struct P { public int X; } public int Y; }", {"A": "A", "X": "A", "Y": "A"}),
        ("struct P { public int X; class A { public int Y; } public int Z; }", {"A": "A", "X": None, "Y": "A", "Z": None}),
        ("class A { public int X; } class B { public int Y; } struct C { public int Z; }", {"A": "A", "B": "B", "X": "A", "Y": "B", "Z": None}),
        ("class A; class B : A { public int Y; }", {"A": "A", "B": "B", "Y": "B"}),
        ("record R { public int X; } record class S { public int Y; } class T { public int Z; }", {"T": "T", "X": None, "Y": None, "Z": "T"}),
        ("class A<T> : B<T>, I where T : class, new() { public int X; class C { } }", {"A": "A", "C": "C", "X": "A"}),
        ("class A(int n) : B(new P { X = n }) { public int Y; }", {"A": "A", "Y": "A"}),
        ("class A { class B { class C { class D { public int X; } public int Y; } } public int Z; }",
         {"A": "A", "B": "B", "C": "C", "D": "D", "X": "D", "Y": "C", "Z": "A"}),
        ("class A { string s = \"} class Q {\"; /* } */ public int X; // }\n public int Y; }", {"A": "A", "X": "A", "Y": "A"}),
        ("class A { public int X; void M() { class B { public int Y; }", {"A": "A", "M": "A", "X": "A", "B": "B", "Y": "B"}),
        ("} } class A { public int X; } }", {"A": "A", "X": "A"}),
        ("", {}),
        ("class A {} class B{public int X;}", {"A": "A", "B": "B", "X": "B"}),
    ],
)
def test_enclosing_class(spark, text, expected):
    found, _ = owners(spark, text)
    assert {k[1]: v for k, v in found.items()} == expected


def test_many_braces(spark):
    flat = "class A { " + "".join(f"public int F{i}; void M{i}() {{ if (x) {{ }} }} " for i in range(4000)) + "}"
    found, rows = owners(spark, flat)
    assert rows == 8001 and set(found.values()) == {"A"}
    deep = "".join(f"class C{i} {{ public int F{i}; " for i in range(200)) + "}" * 200
    found, rows = owners(spark, deep)
    assert rows == 400 and all(found["field", f"F{i}"] == f"C{i}" for i in range(200))


def test_call_inventory_lines(spark):
    text = 'class T {\n  void M() {\n    a.b.C(1)\n     .D("(");\n    if (x) E(F(2));\n  }\n}\n'
    df = spark.createDataFrame([("r", "a.cs", text)], "repo_id string, path string, content string")
    rows = [tuple(r)[2:] for r in corpus.call_inventory(df).collect()]
    assert rows == [
        (3, "a.b", "C", "1", "head"),
        (4, "", "D", '"("', "tail"),
        (5, "", "E", "F(2)", "single"),
        (5, "", "F", "2", "single"),
    ]


def test_call_arguments_keep_mark_characters(spark):
    text = 'x.Go("\u0001\u0002\u0003\ufdd0\ufdd1", F(1));'
    df = spark.createDataFrame([("r", "a.cs", text)], "repo_id string, path string, content string")
    assert [r.arguments for r in corpus.call_inventory(df).collect()] == ['"\u0001\u0002\u0003\ufdd0\ufdd1", F(1)', "1"]


def test_long_file_does_not_overflow(spark):
    body = "".join(f"    s.Setup{i}(f({i}), \"x\").Old({i}).Next();\n" for i in range(20_000))
    got = removed(spark, "class T { void M() {\n" + body + "} }\n")
    assert ".Old(" not in got and got.count(".Next()") == 20_000
    wide = "x = s.Old(" + ", ".join(f"a{i}" for i in range(50_000)) + ").B();"
    assert removed(spark, wide) == "x = s.B();"
    df = spark.createDataFrame([("r", "a.cs", wide)], "repo_id string, path string, content string")
    assert corpus.call_inventory(df).agg(F.count(F.lit(1))).first()[0] == 2


FOUR = "class C {\n    void M() {\n        s.Add(flag, flag, flag, flag);\n    }\n}\n"


def test_every_argument_of_the_name_goes(spark):
    row = apply(spark, FOUR, rule("remove_argument", "Add", argument_name="flag"))
    assert "s.Add();" in row.content and not row.needs_review


def test_calls_that_cannot_be_followed_are_flagged(spark):
    text = "class C {\n    void M() {\n        s.Add(f(g(h(i(1)))), flag);\n        s.Add(1, flag);\n    }\n}\n"
    row = apply(spark, text, rule("remove_argument", "Add", argument_name="flag"))
    assert "s.Add(1);" in row.content and row.needs_review


def test_statements_that_take_turns_with_directives_all_go(spark):
    lines = ["#if A", "        s.Old();", "#endif", "        s.Old();", "#pragma x", "        s.Old();", "#region r", "        s.Old();", "#endregion"]
    text = "class C {\n    void M() {\n        Go();\n" + "\n".join(lines) + "\n    }\n}\n"
    row = apply(spark, text, rule("remove_invocation", "Old"))
    assert "Old" not in row.content and not row.needs_review
    assert [x for x in lines if x.startswith("#")] == [x for x in row.content.splitlines() if x.startswith("#")]


@pytest.mark.parametrize("odd", ["\u0001\u0002\u0003", "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4", "\ufdd0\u0001\ufdd0\ufdd0\ufdd4", "\ufdd1\u0003\ufdd2"])
def test_files_with_mark_characters_are_rewritten_and_keep_them(spark, odd):
    text = f"class C {{\n    string a = \"{odd}\";\n    void M() {{\n        Go();\n        s.Old();\n    }}\n}}\n"
    row = apply(spark, text, rule("remove_invocation", "Old"))
    assert row.content == text.replace("        s.Old();\n", "")


def test_preview_finds_lost_lines_that_stand_elsewhere_too(spark):
    text = "class C {\n    void M() {\n        Go();\n        // setup\n        s.Old();\n        Go();\n        // setup\n        Go();\n    }\n}\n"
    df = spark.createDataFrame([(7, "a.cs", text), (8, "b.cs", text.replace("Old", "New"))], "repo_id bigint, path string, content string")
    rows = corpus.preview_changes(df, [rule("remove_invocation", "Old")]).collect()
    assert sorted(tuple(r) for r in rows) == [(7, "a.cs", 4, "r", "        // setup", ""), (7, "a.cs", 5, "r", "        s.Old();", "")]
    both = [rule("replace_invocation", "Old", "one", replacement_method="Next"), rule("remove_invocation", "Next", "two")]
    rows = corpus.preview_changes(df, both).collect()
    assert sorted((r.line, r.rule, r.original, r.replacement) for r in rows) == [
        (4, "two", "        // setup", ""),
        (5, "one", "        s.Old();", "        s.Next();"),
        (5, "two", "        s.Next();", ""),
    ]
    assert corpus.preview_changes(df, []).count() == 0


def test_what_stands_before_a_call_is_cut_to_its_receiver(spark):
    text = "class A { void M() { /* " + "some words, and " * 500 + "*/ a.b\n  .Go(1); x?.Run(); } }"
    df = spark.createDataFrame([(text,)], "content string")
    found = df.select(F.explode(code.calls(code.mark_calls(F.col("content")))).alias("c"))
    rows = found.select("c.before", *code.call_fields(F.col("c"))).collect()
    assert [(r.receiver, r.method, r.line) for r in rows] == [("a.b", "Go", 2), ("x", "Run", 2)]
    assert max(len(r.before) for r in rows) < 20


@pytest.mark.parametrize("pattern", ["METHOD", "CONSTRUCTOR", "FIELD", "CLASS_HEADER"])
def test_first_characters_of_declarations_change_no_match(spark, pattern):
    text = """[A(1)] public class C : B<int> { [X] [Y(2)] private static int a = 1, _b; ~C() { } C() : base(1) { }
      protected internal C(int x) => Go(); async Task<List<int>> Run<T>([In] ref T é, int y = 2) where T : C { return new C(); }
      _T _m(int[] z); record class R(int Q); file sealed record\tclass S { volatile required Ü.V w; } (int, int) P() => x;
      xpublic class D { } 9class E { } public const string s = null; unsafe fixed (int* p = q) { } extern void W(); [Z]U V() { } }"""
    now = getattr(code, pattern)
    plain = re.sub(r"\(\?=\[[^()]*?_?\]\)", "", now, count=1)
    assert plain != now
    df = spark.createDataFrame([(text + "\n" + text.replace(" ", "\n\t"),)], "text string")
    found = df.select(*[F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)) for p in (now, plain)]).first()
    assert found[0] == found[1] and found[0]
