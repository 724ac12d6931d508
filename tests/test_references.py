"""Rewriting and extraction on literal project files."""

import pytest
from pyspark.sql import functions as F

from fleetbump.functions.references import Target, all_references, deciding_references, drops_attributes, rewrite_references


def rewrite(spark, content, *targets, allow=False):
    df = spark.createDataFrame([(content,)], "content string")
    r = df.select(rewrite_references(F.col("content"), [Target(*t) for t in targets], allow).alias("r")).first().r
    return r.content, [u.name for u in r.updated]


ONE = '<PackageReference Include="Acme.Json" Version="{}" />'


@pytest.mark.parametrize(
    ("content", "target", "expected"),
    [
        (ONE.format("1.0.0"), ("Acme.Json", "2.0.0"), ONE.format("2.0.0")),
        (ONE.format("1.0.0"), ("ACME.json", "2.0.0"), '<PackageReference Include="ACME.json" Version="2.0.0" />'),
        (ONE.format("2.0.0"), ("Acme.Json", "2.0.0"), None),
        (ONE.format("3.0.0"), ("Acme.Json", "2.0.0"), None),
        (ONE.format("$(Shared)"), ("Acme.Json", "2.0.0"), ONE.format("2.0.0")),
        (ONE.format(""), ("Acme.Json", "2.0.0"), ONE.format("2.0.0")),
        (ONE.format("1.0.0"), ("Acme", "2.0.0"), None),
        (ONE.format("1.0.0"), ("AcmeXJson", "2.0.0"), None),
        (ONE.format("1.0.0"), ("Acme.Json", "2.0.0-rc.1"), ONE.format("2.0.0-rc.1")),
        ("", ("Acme.Json", "2.0.0"), None),
        # extra white space; every occurrence changes once the first decides
        (
            '<PackageReference   Include="Acme.Json"\n Version="1.0"/>|' + ONE.format("9.0"),
            ("Acme.Json", "2.0.0"),
            ONE.format("2.0.0") + "|" + ONE.format("2.0.0"),
        ),
        # other attributes are lost; a tag that is not self-closed is accepted
        (
            '<PackageReference Include="Acme.Json" Version="1.0" PrivateAssets="all">',
            ("Acme.Json", "2.0.0"),
            ONE.format("2.0.0"),
        ),
        ('<PackageReference Version="1.0" Include="Acme.Json" />', ("Acme.Json", "2.0.0"), None),
    ],
)
def test_single_line(spark, content, target, expected):
    got, updated = rewrite(spark, content, target)
    assert got == (content if expected is None else expected)
    assert bool(updated) == (expected is not None)


@pytest.mark.parametrize("nl", ["\n", "\r\n"])
def test_multi_line_keeps_newlines(spark, nl):
    content = f'<PackageReference Include="Acme.Json">{nl}  <Version>1.0.0</Version>{nl}</PackageReference>{nl}'
    got, updated = rewrite(spark, content, ("Acme.Json", "2.0.0"))
    assert got == f'<PackageReference Include="Acme.Json">{nl}      <Version>2.0.0</Version>{nl}    </PackageReference>{nl}'
    assert updated == ["Acme.Json"]


def test_multi_line_with_other_child_stays(spark):
    content = '<PackageReference Include="A">\n<Version>1.0</Version>\n<Other>x</Other>\n</PackageReference>'
    assert rewrite(spark, content, ("A", "2.0")) == (content, [])


def test_single_line_hides_multi_line(spark):
    multi = '<PackageReference Include="A"><Version>1.0</Version></PackageReference>'
    content = multi + '<PackageReference Include="A" Version="1.0" />'
    got, _ = rewrite(spark, content, ("A", "2.0"))
    assert got == multi + '<PackageReference Include="A" Version="2.0" />'


def test_downgrades_and_order_of_targets(spark):
    content = '<PackageReference Include="A" Version="3.0" /><PackageReference Include="B" Version="1.0" />'
    got, updated = rewrite(spark, content, ("B", "2.0"), ("A", "2.0"), allow=True)
    assert got == content.replace('"3.0"', '"2.0"').replace('"1.0"', '"2.0"')
    assert updated == ["B", "A"]
    assert rewrite(spark, content, ("B", "2.0"), ("A", "2.0"))[1] == ["B"]
    # the same package twice: the second target sees what the first wrote
    assert rewrite(spark, content, ("B", "2.0"), ("B", "4.0"))[1] == ["B", "B"]


def test_special_signs(spark):
    content = '<PackageReference Include="A+(B)$" Version="1.0" />'
    got, _ = rewrite(spark, content, ("A+(B)$", "$1\\2"))
    assert got == '<PackageReference Include="A+(B)$" Version="$1\\2" />'


def test_extraction(spark):
    content = (
        '<PackageReference Include="M">\n<Version>0.1</Version></PackageReference>'
        '<packagereference include="S" version="1.0"/><PackageReference Include="s" Version="2.0" A="b">'
        '<PackageReference Include="M" Version="3.0" />'
    )
    df = spark.createDataFrame([(content,)], "c string")
    row = df.select(
        all_references(F.col("c")).alias("a"), deciding_references(F.col("c")).alias("d"), drops_attributes(F.col("c"), "S").alias("x")
    ).first()
    assert [(r.layout, r.occurrence, r.package, r.version) for r in row.a] == [
        ("single", 1, "S", "1.0"),
        ("single", 2, "s", "2.0"),
        ("single", 3, "M", "3.0"),
        ("multi", 1, "M", "0.1"),
    ]
    assert [(r.package, r.version) for r in row.d] == [("S", "1.0"), ("M", "3.0")]
    assert row.x is True
