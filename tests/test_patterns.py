import fnmatch
import random
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from fleetbump.functions import patterns as p


def test_globs_like_fnmatch(spark):
    rng = random.Random(3)
    globs = ["*", "?", "a*b", "[ab]c", "[!ab]c", "[a-c]*", "[]x]y", "[!]x]y", "a.b", "a[", "[z-a]", "*[0-9]", "feature/*", "$(x)*", "a\\b"]
    globs += ["".join(rng.choice("ab*?[]!-c.") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    names = ["", "a", "ab", "abb", "ac", "bc", "cc", "]y", "xy", "a.b", "axb", "a[", "feature/x", "a\nb", "$(x)1", "a\\b", "A", "-", "!"]
    names += ["".join(rng.choice("abc.-![]") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    columns = [p.glob_match(F.col("n"), [g]).alias(f"g{i}") for i, g in enumerate(globs)]
    for row in rows.select("n", *columns).collect():
        for i, g in enumerate(globs):
            assert row[f"g{i}"] == fnmatch.fnmatchcase(row.n, g), (row.n, g)


def test_glob_case_and_empty(spark):
    df = spark.createDataFrame([("Repo-One",)], "n string")
    got = df.select(
        p.glob_match(F.col("n"), ["repo-*"], True).alias("a"),
        p.glob_match(F.col("n"), ["repo-*"]).alias("b"),
        p.glob_match(F.col("n"), []).alias("c"),
    ).first()
    assert tuple(got) == (True, False, False)


def test_percent_encoding(spark):
    texts = ["group/project", "a b+c*~-_.", "ü/é?&=%", "x:y@z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.e for r in df.select("t", p.percent_encode(F.col("t")).alias("e")).collect()} == {
        t: quote(t, safe="") for t in texts
    }


@pytest.mark.parametrize(
    ("hint", "attempt", "expected"),
    [("5", 0, 5.0), (" 7 ", 0, 7.0), ("soon", 2, 4.0), (None, 3, 8.0), ("0", 1, 2.0), ("9999", 0, 300.0), (None, 20, 300.0), ("1.5", 0, 1.0)],
)
def test_retry_delay(spark, hint, attempt, expected):
    df = spark.createDataFrame([(hint, attempt)], "h string, a int")
    assert df.select(p.retry_delay(F.col("h"), F.col("a")).alias("d")).first().d == expected


def test_text_helpers(spark):
    df = spark.createDataFrame([(" a, b ,,\tc\n",)], "t string")
    got = df.select(
        p.comma_list(F.col("t")).alias("items"),
        p.truncate(F.lit("x" * 61), 60).alias("cut"),
        p.truncate(F.lit("x" * 60), 60).alias("kept"),
        p.is_useful_term(F.lit("ab")).alias("short"),
        p.is_useful_term(F.lit("a b c")).alias("blank"),
        p.is_useful_term(F.lit("1234")).alias("digits"),
        p.is_useful_term(F.lit("Add")).alias("fine"),
        p.parse_instant(F.lit("2024-03-15T10:30:00.000Z")).isNotNull().alias("good"),
        p.parse_instant(F.lit("yesterday")).isNull().alias("bad"),
    ).first()
    assert got.items == ["a", "b", "c"]
    assert (got.cut, got.kept) == ("x" * 60 + "...", "x" * 60)
    assert (got.short, got.blank, got.digits, got.fine, got.good, got.bad) == (False, False, False, True, True, True)
