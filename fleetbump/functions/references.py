"""Package references inside project files: extraction and rewriting as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetbump.functions.patterns import (
    let,
    newline_of,
    quote_java,
    quote_replacement,
)
from fleetbump.functions.versions import may_update, version_key

# White space as the project-file patterns understand it (Unicode blanks included).
_WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Only the opening sign is consumed, so none of the references hides another. The captured text runs
# from the name to the version; it is cut into its two values afterwards.
_SINGLE_ANY = (
    rf'(?i)<(?=PackageReference{_WS}+Include="([^"]*"{_WS}+Version="[^"]*)"[^>]*>)'
)
_MULTI_ANY = (
    rf'(?i)<(?=PackageReference{_WS}+Include="([^"]*"{_WS}*>{_WS}*<Version>[^<]*)</Version>{_WS}*</PackageReference>)'
)


def _single_pattern(name: str) -> str:
    return rf'(?i)<PackageReference{_WS}+Include="{name}"{_WS}+Version="([^"]*)"[^>]*>'


def _multi_pattern(name: str) -> str:
    return (
        rf'(?i)<PackageReference{_WS}+Include="{name}"{_WS}*>{_WS}*<Version>([^<]*)</Version>{_WS}*</PackageReference>'
    )


def single_references(content: Column) -> Column:
    """All ``<PackageReference Include=".." Version=".."`` in order: array<struct<package, version>>."""
    return F.transform(
        F.regexp_extract_all(content, F.lit(_SINGLE_ANY), F.lit(1)),
        lambda m: F.struct(
            F.substring_index(m, '"', 1).alias("package"),
            F.substring_index(m, '"', -1).alias("version"),
        ),
    )


def multi_references(content: Column) -> Column:
    """References whose version is a ``<Version>`` child, in order."""
    return F.transform(
        F.regexp_extract_all(content, F.lit(_MULTI_ANY), F.lit(1)),
        lambda m: F.struct(
            F.substring_index(m, '"', 1).alias("package"),
            F.regexp_extract(m, rf'(?is)^[^"]*"{_WS}*>{_WS}*<Version>(.*)$', 1).alias("version"),
        ),
    )


def all_references(content: Column) -> Column:
    """Both layouts: array<struct<layout, occurrence, package, version>>, single-line ones first."""

    def tagged(refs: Column, layout: str) -> Column:
        return F.transform(
            refs,
            lambda r, i: F.struct(
                F.lit(layout).alias("layout"),
                (i + 1).cast("int").alias("occurrence"),
                r["package"].alias("package"),
                r["version"].alias("version"),
            ),
        )

    return F.concat(tagged(single_references(content), "single"), tagged(multi_references(content), "multi"))


def deciding_references(content: Column) -> Column:
    """One reference per package and file: the first single-line one, else the first multi-line one."""
    return F.aggregate(
        all_references(content),
        F.struct(
            F.array().cast("array<string>").alias("seen"),
            F.array().cast("array<struct<layout:string,occurrence:int,package:string,version:string>>").alias("kept"),
        ),
        lambda acc, r: F.when(F.array_contains(acc["seen"], F.lower(r["package"])), acc).otherwise(
            F.struct(
                F.array_append(acc["seen"], F.lower(r["package"])).alias("seen"),
                F.array_append(acc["kept"], r).alias("kept"),
            )
        ),
        lambda acc: acc["kept"],
    )


UPDATED = "array<struct<ord:int,name:string,version:string>>"


@dataclass(frozen=True)
class Target:
    name: str
    version: str


def _target_column(ord_: int, target: Target) -> Column:
    quoted = quote_java(target.name)
    single = f'<PackageReference Include="{target.name}" Version="{target.version}" />'
    multi = (
        f'<PackageReference Include="{target.name}">\u0000'
        f"      <Version>{target.version}</Version>\u0000"
        f"    </PackageReference>"
    )
    return F.struct(
        F.lit(ord_).alias("ord"),
        F.lit(target.name).alias("name"),
        F.lit(target.version).alias("version"),
        version_key(F.lit(target.version)).alias("key"),
        F.lit(target.name.lower()).alias("needle"),
        F.lit(_single_pattern(quoted)).alias("single"),
        F.lit(_multi_pattern(quoted)).alias("multi"),
        F.lit(quote_replacement(single)).alias("single_text"),
        F.lit(quote_replacement(multi)).alias("multi_text"),
    )


def mentions_any(content: Column, targets: list[Target]) -> Column:
    """Plain text test, ahead of any pattern, for files that may hold one of the target packages."""
    return let(
        F.lower(content),
        lambda text: F.exists(F.array(*[F.lit(t.name.lower()) for t in targets]), lambda name: F.contains(text, name)),
    )


def rewrite_references(content: Column, targets: list[Target], allow_downgrade: bool = False) -> Column:
    """Fold every target over a project file, in order.

    Gives struct<content, updated: array<struct<ord, name, version>>>. For each target the decision is
    taken on its first reference and, if it is an update, all its references of that layout change.
    """
    if not targets:
        return F.struct(
            content.alias("content"),
            F.array().cast(UPDATED).alias("updated"),
        )
    folded = F.array(*[_target_column(i, t) for i, t in enumerate(targets)])
    lowered = F.lower(content)
    # Most files hold few of the targets: a plain substring test keeps the patterns off the others.
    present = F.filter(folded, lambda t: F.contains(lowered, t["needle"]))

    def step(acc: Column, t: Column) -> Column:
        text = acc["content"]

        def allowed(pattern: Column) -> Column:
            old = F.call_function("regexp_extract", text, pattern, F.lit(1))
            return may_update(old, t["version"], t["key"], allow_downgrade)

        is_single = F.regexp_like(text, t["single"])
        is_multi = F.regexp_like(text, t["multi"])
        changes = F.when(is_single, allowed(t["single"])).when(is_multi, allowed(t["multi"])).otherwise(F.lit(False))
        changed_text = F.when(is_single, F.regexp_replace(text, t["single"], t["single_text"])).otherwise(
            F.regexp_replace(text, t["multi"], F.replace(t["multi_text"], F.lit("\u0000"), newline_of(text)))
        )
        entry = F.struct(t["ord"].alias("ord"), t["name"].alias("name"), t["version"].alias("version"))
        return F.when(
            changes,
            F.struct(changed_text.alias("content"), F.array_append(acc["updated"], entry).alias("updated")),
        ).otherwise(acc)

    start = F.struct(
        content.alias("content"),
        F.array().cast(UPDATED).alias("updated"),
    )
    return F.aggregate(present, start, step)


def drops_attributes(content: Column, name: str) -> Column:
    """Would rewriting this package lose extra attributes of its reference?"""
    return F.regexp_like(
        content,
        F.lit(rf'(?i)<PackageReference{_WS}+Include="{quote_java(name)}"{_WS}+Version="[^"]*"[^>]*[\w-]+{_WS}*=[^>]*>'),
    )
