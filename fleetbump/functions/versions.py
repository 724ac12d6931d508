"""Version ordering (PEP 440) as column expressions.

``version_key`` maps a version to one string whose plain binary order is the version order, so
comparisons, ``min``/``max``, sorting and joins on versions stay ordinary Spark operations. Versions
that do not parse give null.

Layout of a key: ``epoch!release <pre><post><dev>+local``. Numbers are padded to one width; release
parts lose trailing zeros and end at a blank, which sorts before the next part of a longer release.
The grammar is matched once and gives all its groups; the key is put together from them without further patterns, and
plain dotted numbers need no grammar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetbump.functions.patterns import let

_MARK = "\u0001"
_WIDTH = 20
_WIDE = 300
_WIDEST = 4300  # Fixed value: numbers of more digits are not read, so neither is a version that has one.

# The public grammar of PEP 440, appendix B; groups: epoch, release, pre word, pre number,
# implicit post number, post word, post number, dev word, dev number, local.
_GRAMMAR = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
# The groups one after the other, and what is left behind the version, if anything.
_GROUPS = "".join(f"{_MARK}${i}" for i in range(1, 11)) + _MARK

# Most versions are plain dotted numbers: a short cut to the same key.
_PLAIN = r"^\d{1,%d}(?:\.\d{1,%d})*\z" % (_WIDTH, _WIDTH)
_TRAILING_ZEROS = r"(?:\.0+)+$|^0+(?:\.0+)*$"


def _padded(digits: str) -> str:
    return digits.zfill(_WIDTH)


def _number(digits: Column) -> Column:
    """A number of one width. One that is longer is padded further and marked, which sorts it after all shorter ones; so
    again, with two marks."""
    significant = F.ltrim(digits, F.lit("0"))
    long = F.when(F.length(significant) <= _WIDE, F.concat(F.lit("}"), F.lpad(significant, _WIDE, "0"))).otherwise(
        F.concat(F.lit("}}"), F.lpad(significant, _WIDEST, "0"))
    )
    short = F.length(digits) <= _WIDTH
    return F.when(short, F.lpad(digits, _WIDTH, "0")).when(F.length(significant) <= _WIDTH, F.lpad(significant, _WIDTH, "0")).otherwise(long)


def _release(dotted: Column, number) -> Column:
    """Release parts without the trailing ones that are zero; nothing where all are."""
    kept = F.regexp_replace(dotted, _TRAILING_ZEROS, "")
    return F.when(kept == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(kept, r"\."), number), "."))


def _part(rank: str, digits: Column | None = None) -> Column:
    """One of pre, post and dev. Ranks are chosen so that text order is version order."""
    if digits is None:
        return F.lit(f"<{_padded(rank)}>")
    return F.concat(F.lit(f"<{_padded(rank)}:"), _number(digits), F.lit(">"))


def _of_groups(g: Column) -> Column:
    epoch, release, pre, pre_no, post_only, post, post_no, dev, dev_no, local, rest = (g[i] for i in range(1, 12))
    # Pre: development only 0, then a, b, rc, and 9 for none. Post: 0 none, 1 with a number. Dev: 0 with a number, 1 none.
    before = (
        F.when(pre.isin("alpha", "a"), _part("1", pre_no))
        .when(pre.isin("beta", "b"), _part("2", pre_no))
        .when(pre != "", _part("3", pre_no))
        .when((post_only == "") & (post == "") & (dev != ""), _part("0"))
        .otherwise(_part("9"))
    )
    after = F.when(post_only != "", _part("1", post_only)).when(post != "", _part("1", post_no)).otherwise(_part("0"))
    # Local part: one separator; a part that is a number sorts after any text, digits inside a text are left alone.
    named = F.transform(
        F.split(F.translate(local, "-_", ".."), r"\."),
        lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("|"), _number(p))).otherwise(p),
    )
    return F.concat(
        _number(epoch),
        F.lit("!"),
        _release(release, _number),
        F.lit(" "),
        before,
        after,
        F.when(dev != "", _part("0", dev_no)).otherwise(_part("1")),
        F.lit("+"),
        F.when(local == "", F.lit("")).otherwise(F.array_join(named, ".")),
        rest,
    )


def version_key(version: Column | str) -> Column:
    text = F.col(version) if isinstance(version, str) else version
    plain = F.concat(
        F.lit(_padded("0") + "!"),
        _release(text, lambda p: F.lpad(p, _WIDTH, "0")),
        F.lit(f" <{_padded('9')}><{_padded('0')}><{_padded('1')}>+"),
    )
    groups = F.split(
        F.regexp_replace(F.replace(F.lower(text), F.lit(_MARK), F.lit("?")), _GRAMMAR, _GROUPS), _MARK
    )
    # Only a version that parsed has marks; for others there is a single piece.
    general = let(groups, lambda g: F.when(F.size(g) > 1, _of_groups(g)))
    # The length is asked first, so the pattern runs on next to nothing.
    readable = (F.length(text) <= _WIDEST) | ~text.rlike(r"(?i)(?<![a-z\d])\d{%d}" % (_WIDEST + 1))
    return F.when(text.rlike(_PLAIN), plain).when(readable, general)


def version_lt(left: Column | str, right: Column | str) -> Column:
    """left < right; null when either does not parse."""
    return version_key(left) < version_key(right)


def version_le(left: Column | str, right: Column | str) -> Column:
    return version_key(left) <= version_key(right)


def version_eq(left: Column | str, right: Column | str) -> Column:
    return version_key(left) == version_key(right)


def upgrade_decision(old: Column, new: Column, old_key: Column, new_key: Column, allow_downgrade: bool) -> Column:
    """current / downgrade_blocked / update / update_unparsed for one reference.

    Equality is tested first and on the raw text; a version that does not parse is still updated.
    """
    unparsed = old_key.isNull() | new_key.isNull()
    decision = F.when(old == new, F.lit("current"))
    if allow_downgrade:
        return decision.when(unparsed, F.lit("update_unparsed")).otherwise(F.lit("update"))
    return (
        decision.when(unparsed, F.lit("update_unparsed"))
        .when(new_key < old_key, F.lit("downgrade_blocked"))
        .otherwise(F.lit("update"))
    )


def may_update(old: Column, new: Column, new_key: Column, allow_downgrade: bool) -> Column:
    """The same decision as a flag that reads the old version's key once."""
    differs = old != new
    return differs if allow_downgrade else differs & F.coalesce(new_key >= version_key(old), F.lit(True))


def is_update(decision: Column) -> Column:
    return decision.isin("update", "update_unparsed")


def usable_conditions(conditions: Column) -> Column:
    """Add order keys to version conditions and cut the list before the first unreadable one.

    Conditions are tried in order and the first version that does not parse ends the search, so
    only those ahead of it can ever hold.
    """
    keyed = F.transform(
        F.coalesce(conditions, F.array().cast(_CONDITIONS_TYPE)),
        lambda c: F.struct(
            c["type"].alias("type"),
            version_key(F.coalesce(c["version"], F.lit("0.0.0"))).alias("low"),
            F.when(
                c["type"] == "range", version_key(F.coalesce(c["max_version"], F.lit("999.999.999")))
            ).alias("high"),
        ),
    )
    broken = F.transform(keyed, lambda c: c["low"].isNull() | ((c["type"] == "range") & c["high"].isNull()))
    first = F.coalesce(F.array_position(F.transform(broken, lambda b: F.coalesce(b, F.lit(False))), True), F.lit(0))
    return F.when(first > 0, F.slice(keyed, F.lit(1), (first - 1).cast("int"))).otherwise(keyed)


_CONDITIONS_TYPE = "array<struct<type:string,version:string,max_version:string>>"


def crosses(usable: Column, old_key: Column, new_key: Column) -> Column:
    """Does the move old -> new meet any of the usable conditions? Unparsed versions: no."""
    # Each key is worked out once, however many conditions there are.
    return let(F.struct(old_key.alias("old"), new_key.alias("new")), lambda m: _crosses(usable, m["old"], m["new"]))


def _crosses(usable: Column, old_key: Column, new_key: Column) -> Column:
    def holds(c: Column) -> Column:
        return (
            F.when(c["type"] == "greater_than", (new_key > c["low"]) & (old_key <= c["low"]))
            .when(c["type"] == "greater_than_or_equal", (new_key >= c["low"]) & (old_key < c["low"]))
            .when(c["type"] == "exact", new_key == c["low"])
            .when(c["type"] == "range", (new_key >= c["low"]) & (new_key <= c["high"]))
            .otherwise(F.lit(False))
        )

    readable = old_key.isNotNull() & new_key.isNotNull()
    return F.coalesce(readable & F.exists(usable, holds), F.lit(False))
