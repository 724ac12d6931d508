"""URL filter by a path-template tree (operator 7), in DataFrame operations only.

Rules judge the urls they fit. Their verdicts are the labels from which templates are judged for all other urls:

1. Per host, the tree of path segments is walked level by level over the distinct paths. A segment stays literal if it
   holds no digit and at least ``literal_share`` of the node's urls (so a node has at most ``1 / literal_share`` literal
   children); every other segment becomes ``*``. The last level holds the rest of the path.
2. Labelled sibling branches whose block rate does not differ from that of all their siblings by ``z`` standard errors
   are merged: their segment becomes ``*`` too. A branch without labels has nothing to be compared by and stays.
3. A template's purity is its labelled block rate, smoothed by ``weight`` pseudo-urls towards the rate of the same template
   over all hosts, and that towards the rate of all labelled urls. A template of ``reject`` or more is blocked.

A host with a third of all urls is counted by partial sums first, and its paths are joined by (host, prefix, segment).

Edge cases: a null url, or one without ``://``, has empty host and path and fits no rule; an empty path is the template
of its host; without any labelled url everything is allowed; repeated rows and null ids keep their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbump.llm.exact_dedup import ascii_lower
from fleetbump.llm.tables import written

# (host, path, verdict); a rule fits its host, all subdomains, and paths that start with its path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Settings:
    levels: int = 6
    literal_share: float = 0.02
    least: int = 2
    z: float = 2.0
    weight: float = 4.0
    reject: float = 0.9


def with_parts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host`` and ``path`` of each row."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        ascii_lower(F.regexp_extract(url, parts, 1)).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
    )


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _segment(path: Column, level: int, levels: int) -> Column:
    """The level-th part of the path, from 1, with its slash; the last level has all that is left; null past the end."""
    segments = F.split(path, "/")
    own = F.get(segments, F.lit(level))
    if level == levels:
        own = F.when(F.size(segments) > level, F.array_join(F.slice(segments, level + 1, 1 << 20), "/"))
    return F.concat(F.lit("/"), own)


def path_templates(paths: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``paths`` (host, path, n, labelled, blocked) with the ``template`` of each path."""
    s = settings
    now = paths.withColumn("prefix", F.lit(""))
    key = ["host", "prefix"]
    for level in range(1, s.levels + 1):
        now = written(now.withColumn("segment", _segment(F.col("path"), level, s.levels)), "paths")
        inner = now.where(F.col("segment").isNotNull())
        children = inner.groupBy(*key, "segment").agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")
        )
        nodes = children.groupBy(*key).agg(
            F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked")
        )
        rate = F.col("all_blocked") / F.col("all_labelled")
        error = F.sqrt(rate * (1 - rate) / F.col("labelled"))
        alike = (
            (F.col("labelled") > 0)
            & (F.col("labelled") < F.col("all_labelled"))
            & (F.abs(F.col("blocked") / F.col("labelled") - rate) <= s.z * error)
        )
        literal = (
            children.where(~F.col("segment").rlike("[0-9]"))
            .join(nodes, key)
            .where((F.col("n") >= s.least) & (F.col("n") >= s.literal_share * F.col("all_n")) & ~F.coalesce(alike, F.lit(False)))
            .select(*key, "segment", F.lit(True).alias("literal"))
        )
        now = now.join(literal, [*key, "segment"], "left").withColumn(
            "prefix",
            F.when(F.col("segment").isNull(), F.col("prefix")).otherwise(
                F.concat("prefix", F.when(F.col("literal"), F.col("segment")).otherwise(F.lit("/*")))
            ),
        ).drop("literal", "segment")
    return now.withColumnRenamed("prefix", "template")


def template_purity(templated: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, template, purity: the smoothed block rate of the labelled urls of each template."""
    weight = F.lit(settings.weight)
    sums = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    own = templated.groupBy("host", "template").agg(*sums)
    over_all = own.groupBy("template").agg(
        F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked")
    )
    total = own.agg(*sums).select(
        (F.coalesce(F.col("blocked") / F.nullif(F.col("labelled"), F.lit(0)), F.lit(0.0))).alias("base")
    )
    # One number: the block rate of all labelled urls.
    base = F.lit(float(total.first().base))
    shared = (F.col("all_blocked") + weight * base) / (F.col("all_labelled") + weight)
    purity = (F.col("blocked") + weight * shared) / (F.col("labelled") + weight)
    return own.join(over_all, "template").select("host", "template", purity.alias("purity"))


def judge(pages: DataFrame, rules=RULES, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, purity."""
    parted = with_parts(pages)
    ruled = parted.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    paths = ruled.groupBy("host", "path").agg(
        F.count("*").alias("n"),
        F.count("found").alias("labelled"),
        F.count(F.when(F.col("found.verdict") == "block", 1)).alias("blocked"),
    )
    templated = written(path_templates(paths, settings).select("host", "path", "template", "labelled", "blocked"), "paths")
    purity = template_purity(templated, settings)
    judged = templated.select("host", "path", "template").join(purity, ["host", "template"])
    found = ruled.join(judged, ["host", "path"], "left")
    own = F.when(F.col("purity") >= settings.reject, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), own).alias("verdict"),
        "template",
        "purity",
    )
