"""Version keys against the public reference implementation, conditions, decisions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fleetbump import schemas
from fleetbump.functions.versions import crosses, upgrade_decision, usable_conditions, version_key

SPECIAL = [
    "1.0", "1.0.0", "1", "0.0.0", "0", "1.0-1", "1.0a", "1.0a-", "1.0.post1", "1.0-r4", "v1.2", "1!0.1", "1.0+abc.1",
    "1.0+abc.10", "1.0+abc", "1.0+1", "1.0rc.", "1.0.dev3", "1.0.post2.dev1", "$(V)", "*", "[1,2)", "", "1.0-preview.1",
    "6.0.0-rc.1.2", "20240101120000123456.1", "123456789012345678901234.2", "1.0+ABC-x", " 1.0 ", "1..0", "1.0.0.0.1",
    "1.0+a10", "1.0+a9", "1.0+10", "1.0+9", "01.02", "1.0.0-beta.2+build.5",
]


def _random_versions(n: int) -> list[str]:
    rng = random.Random(7)
    out = []
    for _ in range(n):
        v = ".".join(str(rng.choice([0, 0, 1, 2, 10, 11, 100])) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.3:
            v += rng.choice(["a", "b", "rc", "-beta", "-alpha.", "preview", "c", ".pre-"]) + rng.choice(["", "1", "02", "10"])
        if rng.random() < 0.2:
            v += rng.choice(["-1", ".post", "post3", "-r2", "rev"])
        if rng.random() < 0.2:
            v += rng.choice([".dev", "dev1", "-dev10"])
        if rng.random() < 0.1:
            v += "+" + rng.choice(["l", "l.1", "1", "10", "a.b"])
        out.append(v)
    return out


def test_keys_order_like_packaging(spark):
    packaging = pytest.importorskip("packaging.version")

    def parsed(v):
        try:
            return packaging.parse(v)
        except packaging.InvalidVersion:
            return None

    versions = sorted(set(SPECIAL + _random_versions(150)))
    rows = spark.createDataFrame([(v,) for v in versions], "v string").select("v", version_key("v").alias("k")).collect()
    keys = {r.v: r.k for r in rows}
    assert {v for v in versions if keys[v] is None} == {v for v in versions if parsed(v) is None}
    for a, b in itertools.combinations([v for v in versions if keys[v]], 2):
        assert (keys[a] < keys[b], keys[a] == keys[b]) == (parsed(a) < parsed(b), parsed(a) == parsed(b)), (a, b)


@pytest.mark.parametrize(
    ("conditions", "old", "new", "expected"),
    [
        ([("greater_than", "2.0", None)], "1.0", "2.0.1", True),
        ([("greater_than", "2.0", None)], "2.0", "2.0.1", True),
        ([("greater_than", "2.0", None)], "2.0.1", "3.0", False),
        ([("greater_than", "2.0", None)], "1.0", "2.0", False),
        ([("greater_than_or_equal", "2.0", None)], "1.9", "2.0", True),
        ([("greater_than_or_equal", "2.0", None)], "2.0", "2.1", False),
        ([("exact", "2.0", None)], "5.0", "2.0.0", True),
        ([("exact", "2.0", None)], "1.0", "2.0.1", False),
        ([("range", "1.0", "2.0")], "0.1", "1.5", True),
        ([("range", "1.0", None)], "0.1", "900.0", True),
        ([("range", "1.0", "2.0")], "0.1", "2.0.1", False),
        ([("exact", "9", None), ("exact", "2", None)], "1", "2", True),
        ([("exact", "bad version", None), ("exact", "2", None)], "1", "2", False),
        ([("exact", "2", None), ("exact", "bad version", None)], "1", "2", True),
        ([("other", "2", None)], "1", "2", False),
        ([("greater_than", None, None)], "0.0.0", "2", True),
        ([("greater_than", "1", None)], "$(V)", "2", False),
        ([("greater_than", "1", None)], "0", "junk!", False),
        ([], "0", "1", False),
    ],
)
def test_conditions(spark, conditions, old, new, expected):
    df = spark.createDataFrame([(conditions, old, new)], f"c {schemas.CONDITIONS}, o string, n string")
    hit = crosses(usable_conditions(F.col("c")), version_key("o"), version_key("n"))
    assert df.select(hit.alias("h")).first().h is expected


@pytest.mark.parametrize(
    ("old", "new", "allow", "expected"),
    [
        ("1.0.0", "1.0.0", False, "current"),
        ("1.0", "1.0.0", False, "update"),
        ("2.0", "1.0", False, "downgrade_blocked"),
        ("2.0", "1.0", True, "update"),
        ("$(V)", "1.0", False, "update_unparsed"),
        ("1.0", "[2,3)", False, "update_unparsed"),
    ],
)
def test_decisions(spark, old, new, allow, expected):
    df = spark.createDataFrame([(old, new)], "o string, n string")
    d = upgrade_decision(F.col("o"), F.col("n"), version_key("o"), version_key("n"), allow)
    assert df.select(d.alias("d")).first().d == expected


def test_a_version_is_read_with_few_patterns(spark):
    df = spark.createDataFrame([("1.0-rc.1",)], "v string")
    plan = df.select(version_key("v").alias("k"))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("regexp_replace(") + plan.count("rlike") <= 10
    assert df.select(version_key(F.lit("1.0\n")) == version_key(F.lit("1.0"))).first()[0]


def test_numbers_of_any_length_that_is_read(spark):
    lengths = [1, 19, 20, 21, 299, 300, 301, 302, 303, 3000, 4299, 4300]
    numbers = [d * n for n in lengths for d in ("1", "2")] + ["0" * 50 + "3" * 301]
    versions = [f"{n}.0" for n in numbers] + [f"1.{n}" for n in numbers] + [f"1.0rc{n}" for n in numbers] + [f"1.0+{n}" for n in numbers]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(versions)], "i int, v string")
    keys = [r.k for r in df.withColumn("k", version_key("v")).orderBy("i").collect()]
    for part in range(4):
        own = keys[part * len(numbers) : (part + 1) * len(numbers)]
        assert sorted(range(len(numbers)), key=lambda i: own[i]) == sorted(range(len(numbers)), key=lambda i: int(numbers[i]))
    too_long = spark.createDataFrame([("1" * 4301,), ("1." + "0" * 4301,), ("x" * 5000,)], "v string")
    assert [r.k for r in too_long.select(version_key("v").alias("k")).collect()] == [None, None, None]
