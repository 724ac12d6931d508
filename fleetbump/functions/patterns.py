"""Shared scalar helpers: globs, delimited text, newlines, truncation, encoding, dates, retry rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_java(text: str) -> str:
    """Literal text inside a Java pattern."""
    return "".join("\\" + ch if re.match(r"[^\w\s]", ch, re.ASCII) else ch for ch in text)


def quote_replacement(text: str) -> str:
    """Literal text inside a Java replacement, where $ and \\ are special."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


# ---- globs -------------------------------------------------------------------------------------


def glob_to_regex(glob: str) -> str:
    """Whole-string Java pattern for a shell glob with ``*``, ``?``, ``[seq]`` and ``[!seq]``."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            # A "]" directly after the opening (or after "!") belongs to the set.
            end = glob.find("]", i + (2 if glob[i : i + 1] == "!" else 1))
            if end < 0:
                out.append(r"\[")
                continue
            out.append(_glob_set(glob[i:end]))
            i = end + 1
        else:
            out.append(quote_java(ch))
    return r"(?s)\A" + "".join(out) + r"\z"


def _glob_set(body: str) -> str:
    negated = body.startswith("!")
    body = body[1:] if negated else body
    pieces, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low <= high:
                pieces.append(f"{quote_java(low)}-{quote_java(high)}")
            i += 3
        else:
            pieces.append(quote_java(body[i]))
            i += 1
    if not pieces:  # only empty ranges: nothing (or, negated, any character)
        return "." if negated else "(?!)"
    return ("[^" if negated else "[") + "".join(pieces) + "]"


def glob_match(value: Column, globs: list[str], ignore_case: bool = False) -> Column:
    """True when any glob matches the whole value. One pattern, evaluated once per row."""
    if not globs:
        return F.lit(False)
    if ignore_case:
        value, globs = F.lower(value), [g.lower() for g in globs]
    return value.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs))


# ---- delimited text ----------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def spec_parts(spec: Column) -> Column:
    return F.split(spec, "@")


def is_valid_spec(spec: Column) -> Column:
    return F.size(spec_parts(spec)) == 2


# ---- text --------------------------------------------------------------------------------------


def newline_of(content: Column) -> Column:
    return F.when(F.contains(content, F.lit("\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))


def normalize_newlines(content: Column, newline: Column) -> Column:
    plain = F.regexp_replace(content, "\r\n?", "\n")
    return F.when(newline == "\r\n", F.replace(plain, F.lit("\n"), F.lit("\r\n"))).otherwise(plain)


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def percent_encode(path: Column) -> Column:
    """Encode every reserved character, slashes included (Spark's own form encoding, corrected)."""
    text = F.url_encode(path)
    for form, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        text = F.replace(text, F.lit(form), F.lit(wanted))
    return text


def decode_base64(text: Column) -> Column:
    return F.decode(F.unbase64(text), "UTF-8")


_INSTANT = r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?)?$"


def parse_instant(text: Column) -> Column:
    """ISO-8601 instant, null when it does not parse.

    The shape is checked first: Spark alone would also read bare years, months and words like "today".
    """
    return F.when(text.rlike(_INSTANT), F.try_to_timestamp(text))


def is_useful_term(term: Column) -> Column:
    """Terms worth searching for: 3 to 200 characters, no white space, at least one letter."""
    return (
        F.length(term).between(3, 200)
        & ~term.rlike(r"[\s\x1c-\x1f\u0085\p{Z}]")
        & term.rlike(r"\p{L}")
    )


def has_call(content: Column, name: str) -> Column:
    return content.rlike(r"(?U)\b" + quote_java(name) + r"\s*\(")


# ---- retries -----------------------------------------------------------------------------------


def retry_delay(retry_after: Column, attempt: Column, base: float = 1.0, cap: float = 300.0) -> Column:
    """Seconds to wait: the server's whole-number hint (0 counts as absent), else doubling, capped."""
    hint = F.when(strip(retry_after).rlike(r"^[+-]?\d+$"), strip(retry_after).try_cast("bigint")).cast("double")
    backoff = F.lit(base) * F.pow(F.lit(2.0), attempt)
    return F.least(F.coalesce(F.nullif(hint, F.lit(0.0)), backoff), F.lit(cap))


def request_outcome(status: Column) -> Column:
    return (
        F.when(status == 429, F.lit("rate_limited"))
        .when(status.between(500, 599), F.lit("retryable"))
        .when(status >= 400, F.lit("not_retryable"))
        .otherwise(F.lit("ok"))
    )


# ---- merge-request status ----------------------------------------------------------------------

# Known states, in report order.
BUCKETS = ("merged", "opened", "closed", "unknown")


def status_bucket(status: Column) -> Column:
    return F.when(status.isin(*BUCKETS[:3]), status).otherwise(F.lit("unknown"))
