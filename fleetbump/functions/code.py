"""C# text as column expressions: bounded patterns over whole files, no parser.

Call names are marked once per file (strings, comments, directives, attributes, declarations and
object creations are stepped over), and every later step works on the marks. Parentheses are followed
four deep; what lies deeper, or inside strings and comments, is left alone and flagged for review.
All repeated groups are possessive, so patterns run in one pass and do not recurse on long files.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetbump.functions.patterns import let, quote_java, quote_replacement

OPEN, CLOSE, TRIM = "\u0001", "\u0002", "\u0003"

WORD = _W = r"[\p{L}\p{Nd}_]"
ID = rf"[\p{{L}}_]{_W}*+"
_END = rf"(?!{_W})"

_STRING = (
    r'"""(?:[^"]++|"(?!""))*+"""'
    r'|(?:\$@|@\$|@)"(?:[^"]++|"")*+"'
    r'|\$?"(?:[^"\\\r\n]++|\\.)*+"'
    r"|'(?:[^'\\\r\n]|\\[^\r\n]{1,9}?)'"
)
_COMMENT = r"//[^\r\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"

_G = r"[\p{L}\p{Nd}_\s,.?\[\]]*+"
GENERIC = rf"<{_G}(?:<{_G}(?:<{_G}>{_G})*+>{_G})*+>"

# Words that may stand before a call without making it a declaration, words that look
# like calls but are not, and declaration modifiers.
_BEFORE_CALL = (
    "return await throw in is as case else do yield when and or not out ref goto select where orderby on equals by new"
).split()
_NOT_CALLS = (
    "if while for foreach switch catch using lock fixed return throw typeof sizeof default checked unchecked new this "
    "base await async in is as out ref params delegate operator when where select from var and or not get set"
).split()
_MODIFIERS = (
    "public private protected internal static async virtual override sealed abstract extern new partial unsafe "
    "readonly const volatile required file"
).split()

_TYPE = rf"{ID}(?:\s*+\.\s*+{ID})*+(?:{GENERIC})?+(?:\[[\s,]*+\])*+\??"


def _words(words: list[str]) -> str:
    return rf"(?:{'|'.join(words)}){_END}"


_CREATION = rf"(?<!{_W})new\s++{ID}(?:\s*+\.\s*+{ID})*+"
_DECLARED = (
    rf"(?<![\p{{L}}\p{{Nd}}_.])(?!{_words(_BEFORE_CALL)}){_TYPE}\s++(?!{_words(_NOT_CALLS)}){ID}(?=\s*+(?:{GENERIC})?+\s*+\()"
)
_HEAD = rf"(?<![\p{{L}}\p{{Nd}}_@])(?!{_words(_NOT_CALLS)})({ID})(?=\s*+(?:{GENERIC})?+\s*+\()"
# Alternatives are grouped by what they can start with, so most characters fail after a few tests.
_SKIPPED = (
    rf"(?=[\"'$@])(?:{_STRING})|(?=/)(?:{_COMMENT})|(?m:^)[ \t]*+(?:#[^\r\n]*+|\[[^\]\r\n]*+\])"
    rf"|(?<!{_W})(?=[\p{{L}}_])(?:{_CREATION}|{_DECLARED})"
)

_PLAIN = rf"""[^()"'/@$]++|{_STRING}|{_COMMENT}|[/'@$]"""


def _parens(depth: int) -> str:
    inner = _PLAIN if depth == 0 else f"{_PLAIN}|{_parens(depth - 1)}"
    return rf"\((?:{inner})*+\)"


ARGUMENTS = _parens(3)
_TAIL = rf"\s*+(?:{GENERIC})?+\s*+{ARGUMENTS}"


# What a mark that stands in a file is read as meanwhile, and the sign that leads these pairs: code points that Unicode
# keeps out of text. The sign itself becomes a pair too, so every pair can be read back.
_SIGN = "\ufdd0"
_HELD = {OPEN: _SIGN + "\ufdd1", CLOSE: _SIGN + "\ufdd2", TRIM: _SIGN + "\ufdd3"}
_SIGN_HELD = _SIGN + "\ufdd4"


def _hold(content: Column) -> Column:
    held = F.replace(content, F.lit(_SIGN), F.lit(_SIGN_HELD))
    for mark, pair in _HELD.items():
        held = F.replace(held, F.lit(mark), F.lit(pair))
    return held


def mark_calls(content: Column) -> Column:
    """Put marks around every name that is called; marks of the file itself are held aside until ``unmark``."""
    marked = F.regexp_replace(_hold(content), f"({_SKIPPED})|{_HEAD}", f"$1{OPEN}$2{CLOSE}")
    return F.replace(marked, F.lit(OPEN + CLOSE), F.lit(""))


def unmark(marked: Column) -> Column:
    plain = F.replace(F.replace(marked, F.lit(OPEN), F.lit("")), F.lit(CLOSE), F.lit(""))
    for mark, pair in _HELD.items():
        plain = F.replace(plain, F.lit(pair), F.lit(mark))
    return F.replace(plain, F.lit(_SIGN_HELD), F.lit(_SIGN))


def _until_stable(text: Column, step, most: Column) -> Column:
    """``step`` applied until nothing changes; ``most`` bounds how often it can change anything."""

    def go(state: Column, _: Column) -> Column:
        after = F.when(state["changed"], step(state["text"])).otherwise(state["text"])
        return let(after, lambda t: F.struct(t.alias("text"), (t != state["text"]).alias("changed")))

    start = F.struct(text.alias("text"), F.lit(True).alias("changed"))
    return F.aggregate(F.sequence(F.lit(0), most), start, go, lambda state: state["text"])


def code_only(content: Column) -> Column:
    """Content without comments and with empty strings."""
    return F.regexp_replace(content, rf"(?=[\"'$@/])(?:{_STRING}|{_COMMENT})", " ")


def skipped_tokens(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(f"({_STRING}|{_COMMENT})"), F.lit(1))


def _name(method: str | None) -> str:
    wanted = rf"(?iu:{quote_java(method)})" if method else f"[^{CLOSE}]++"
    return f"{OPEN}{wanted}{CLOSE}"


def calls(marked: Column) -> Column:
    """Calls in order: array<struct<line, before, text>>.

    ``text`` runs from the name over its arguments to a following dot; ``before`` is the end of what
    stands between the previous call's name and this one, as far as a receiver can reach.
    """
    text = F.regexp_extract_all(
        marked, F.lit(rf"{OPEN}(?=([^{CLOSE}]++{CLOSE}\s*+(?:{GENERIC})?+\s*+(?:{ARGUMENTS})?+(?:\s*+\??\.)?+))"), F.lit(1)
    )
    pieces = F.split(marked, OPEN)
    per_line = F.transform(F.split(marked, "\n"), lambda t: F.length(t) - F.length(F.replace(t, F.lit(OPEN), F.lit(""))))
    lines = F.flatten(F.transform(per_line, lambda n, i: F.array_repeat(i + 1, n)))
    # Receivers are read backwards from the name: names, dots and white space, and one sign before them.
    near = F.transform(pieces, lambda p: F.regexp_replace(p, r"(?s)\A.*(?=[^\p{L}\p{Nd}_\s?.\x{85}\x{2028}\x{2029}])", ""))
    return F.transform(
        F.arrays_zip(text.alias("text"), F.slice(near, F.lit(1), F.size(text)).alias("before"), lines.alias("line")),
        lambda c: F.struct(c["line"].alias("line"), c["before"].alias("before"), c["text"].alias("text")),
    )


def call_fields(call: Column) -> list[Column]:
    """Columns of one call: line, receiver, method, arguments, chain position."""
    before = F.regexp_extract(call["before"], rf"((?:[)\]>\"}}]\s*+\??\.\s*+)?(?:{ID}\s*+\??\.\s*+)*+)$", 1)
    after_call = before.rlike(r"^[)\]>\"}]")
    followed = call["text"].rlike(r"[)]\s*\??\.$")
    receiver = F.regexp_replace(F.regexp_replace(before, r"^[)\]>\"}]\s*+\??\.\s*+", ""), r"\s*\??\.\s*$", "")
    arguments = unmark(F.regexp_extract(call["text"], rf"^[^{CLOSE}]*+{CLOSE}\s*+(?:{GENERIC})?+\s*+({ARGUMENTS})", 1))
    return [
        call["line"].cast("bigint").alias("line"),
        receiver.alias("receiver"),
        F.substring_index(call["text"], CLOSE, 1).alias("method"),
        F.when(arguments != "", F.substring(arguments, 2, 1_000_000_000).substr(F.lit(1), F.length(arguments) - 2)).alias(
            "arguments"
        ),
        F.when(after_call & followed, F.lit("middle"))
        .when(after_call, F.lit("tail"))
        .when(followed, F.lit("head"))
        .otherwise(F.lit("single"))
        .alias("chain"),
    ]


# ---- rewriting marked text -----------------------------------------------------------------------


def rename_call(marked: Column, method: str | None, new_name: str | None) -> Column:
    if not new_name:
        return marked
    return F.regexp_replace(marked, _name(method), quote_replacement(f"{OPEN}{new_name}{CLOSE}"))


_LINE_END = r"[ \t]*+(?://[^\r\n]*+)?(?:\r?\n|\z)"
_IDLE_LINE = r"[ \t]*+(?://[^\r\n]*+)?\r?\n"
_DIRECTIVE_LINE = r"[ \t]*+#[^\r\n]*+\r?\n"


def remove_call(marked: Column, method: str | None) -> Column:
    """Remove calls of a method, keeping the rest of their chains.

    Between two links the link goes; a statement that is nothing but the call goes with its line (and
    the blank and comment lines right above it, never directive lines); at the end of a chain, or on
    the right of an expression, the receiver stays; a bare call at the head of a chain goes.
    """
    call = _name(method) + _TAIL
    path = rf"{ID}(?:\s*+\.\s*+{ID})*+"
    link = rf"\s*+\.\s*+{call}"
    text = F.regexp_replace(marked, rf"(?<![?\s]){link}(?=\s*+\??\.)", "")
    # The receiver of a statement call, if any, holds no call itself.
    statement = rf"(?:{_IDLE_LINE})*+[ \t]*+(?:{ID}\s*+\.\s*+)*+{call}\s*+;{_LINE_END}"
    start = rf"([;{{}}][ \t]*+(?://[^\r\n]*+)?\r?\n(?:(?:{_IDLE_LINE})*+{_DIRECTIVE_LINE})*+|\A)"
    # Statements that take turns with directive lines need as many passes as there are calls, at most.
    count = F.regexp_count(marked, F.lit(_name(method)))
    text = _until_stable(text, lambda t: F.regexp_replace(t, rf"{start}(?:{statement})++", "$1"), count)
    text = F.regexp_replace(text, rf"([;{{}}])[ \t]*+(?:{ID}\s*+\.\s*+)*+{call}\s*+;", "$1")
    text = F.regexp_replace(text, rf"(?<=[)]){link}", "")
    text = F.regexp_replace(text, rf"([=(,?:&|+!\[>]\s*+|(?<!{_W})return\s++)({path}){link}", "$1$2")
    # A name after a dot is stepped over, so only the first link of a chain is met.
    return F.regexp_replace(text, rf"(\.\s*+{OPEN})|{call}\s*+\.\s*+(?=[{OPEN}\p{{L}}_])", "$1")


_ARG_PLAIN = rf"""[^()"'/@$,\[\]{{}}]++|{_STRING}|{_COMMENT}|[/'@$]"""


def _arg_group(depth: int) -> str:
    inner = rf"""[^()"'/@$\[\]{{}}]++|{_STRING}|{_COMMENT}|[/'@$]"""
    if depth:
        inner += "|" + _arg_group(depth - 1)
    return "|".join(rf"{a}(?:{inner})*+{b}" for a, b in ((r"\(", r"\)"), (r"\[", r"\]"), (r"\{", r"\}")))


_ARG = rf"(?:{_ARG_PLAIN}|{_arg_group(1)})*+"


def remove_argument(marked: Column, method: str | None, argument: str | None) -> Column:
    """Drop an identifier argument where that is safe: named, last, or with only named ones after it."""
    if not argument or not argument.strip():
        return marked
    wanted = quote_java(argument)
    named = rf"{ID}\s*+:(?!:)\s*+"
    head = rf"{_name(method)}\s*+(?:{GENERIC})?+\s*+\("
    plain = rf"\s*+(?:{named})?+{wanted}{_END}\s*+"

    def step(text: Column) -> Column:
        # Last or only one: the comma before it is cut together with the mark.
        text = F.regexp_replace(text, rf"({head}(?:{_ARG},)*+){plain}\)", f"$1{TRIM})")
        text = F.replace(F.regexp_replace(text, rf"\s*+,\s*+{TRIM}", ""), F.lit(TRIM), F.lit(""))
        rest_named = rf"(?=\s*+{named}{_ARG}(?:,\s*+{named}{_ARG})*+\))"
        for going in (rf"{named}{wanted}{_END}\s*+,", rf"{wanted}{_END}\s*+,{rest_named}"):
            ahead = rf"(?:(?!\s*+{going}){_ARG},)*+"
            text = F.regexp_replace(text, rf"({head}{ahead}\s*+){going}\s*+", "$1")
        return text

    # Each pass drops one argument of a call, so there are as many as the name occurs, at most.
    return _until_stable(marked, step, F.regexp_count(marked, F.lit(rf"(?<!{_W}){wanted}{_END}")))


def unbounded(marked: Column, method: str) -> Column:
    """Is there a call of the method whose argument list could not be followed to its end?"""
    head = rf"{_name(method)}\s*+(?:{GENERIC})?+\s*+\("
    return marked.rlike(rf"{head}(?!(?:{_ARG},)*+{_ARG}\))")


def _local_declaration(name: str) -> str:
    return rf"{_TYPE}\s++{name}\s*+(?:=(?!=)(?:{_PLAIN_UNTIL_END}|{_parens(3)})*+)?;"


_PLAIN_UNTIL_END = rf"""[^()"'/@$;]++|{_STRING}|{_COMMENT}|[/'@$]"""


def uses_outside_declarators(content: Column, name: str) -> Column:
    """How often a name is used in code, uses inside declarations of variables not counted."""
    wanted = quote_java(name)
    code = F.regexp_replace(
        code_only(content),
        rf"(?<![\p{{L}}\p{{Nd}}_.])(?!{_words(_BEFORE_CALL)}){_local_declaration(ID)}",
        " ",
    )
    # A type before the name makes it a parameter or field of that name, not a use.
    declared = rf"(?<![\p{{L}}\p{{Nd}}_.])(?!{_words(_BEFORE_CALL)}){_TYPE}\s++{wanted}{_END}"
    rest = F.regexp_replace(code, declared, " ")
    return F.regexp_count(rest, F.lit(rf"(?<!{_W}){wanted}{_END}"))


def remove_unused_local(marked: Column, name: str) -> Column:
    """Remove the whole line of a local variable that is no longer used."""
    wanted = quote_java(name)
    line = (
        rf"([;{{}}][ \t]*+(?://[^\r\n]*+)?\r?\n(?:(?:{_IDLE_LINE})*+{_DIRECTIVE_LINE})*+)"
        rf"(?:{_IDLE_LINE})*+[ \t]*+(?!{_words([*_BEFORE_CALL, *_MODIFIERS])}){_local_declaration(wanted)}{_LINE_END}"
    )
    unused = uses_outside_declarators(unmark(marked), name) == 0
    return F.when(unused, F.regexp_replace(marked, line, "$1")).otherwise(marked)


def left_over(marked: Column, method: str) -> Column:
    """Does a call of the method remain that should have gone (its text could not be bounded)?"""
    head = _name(method)
    lines = r"\s*+(?:#[^\r\n]*+\s*+)*+"
    return marked.rlike(rf"(?<!\?)\.\s*+{head}|(?:[;{{}}):]|(?<!{_W})(?:else|do)){lines}{head}")


def in_text(content: Column, marked: Column, method: str) -> Column:
    """Does a string or comment hold what looks like a call of the method?

    Only where the marked text has the name unmarked are strings and comments looked at.
    """
    call = rf"(?iu)(?<![\p{{L}}\p{{Nd}}_{OPEN}]){quote_java(method)}\s*\("
    return F.when(marked.rlike(call), F.exists(skipped_tokens(content), lambda t: t.rlike(call))).otherwise(F.lit(False))


# ---- declarations --------------------------------------------------------------------------------

_ATTRIBUTES = r"(?:\[[^\[\]]*+\]\s*+)*+"
_MODS = rf"(?:{_words(_MODIFIERS)}\s++)"
_PARAMS = r"[^()]*+(?:\([^()]*+\)[^()]*+)*+"
_NOT_TYPES = [*_BEFORE_CALL, *_MODIFIERS, *_NOT_CALLS, "class", "struct", "interface", "record", "enum", "event", "namespace"]

# What a declaration can start with is looked at first: at most characters nothing else of a pattern is tried.
_FIRST = "".join(sorted({m[0] for m in _MODIFIERS}))
# A record is no class here, also where its header says "record class".
CLASS_HEADER = rf"((?=[\[c{_FIRST}]){_ATTRIBUTES}{_MODS}*+(?<!{_W})(?<!record\s{{1,9}})class{_END}\s++{ID})"
METHOD = (
    rf"(?=[\[\p{{L}}_])(?<![\p{{L}}\p{{Nd}}_.])({_ATTRIBUTES})({_MODS}*+)(?!{_words(_NOT_TYPES)})({_TYPE})\s++(?!{_words(_NOT_CALLS)})({ID})"
    rf"\s*+(?:{GENERIC})?+\s*+\(({_PARAMS})\)\s*+(\{{|=>|;|where{_END})"
)
CONSTRUCTOR = rf"(?=[{_FIRST}])(?<![\p{{L}}\p{{Nd}}_.])({_MODS}++)({ID})\s*+\(({_PARAMS})\)\s*+(?:\{{|:|=>)"
FIELD = (
    rf"(?=[\[{_FIRST}])(?<![\p{{L}}\p{{Nd}}_.])({_ATTRIBUTES})({_MODS}++)(?!{_words(_NOT_TYPES)})({_TYPE})\s++"
    rf"({ID}[^;{{}}()=]*+(?:=(?!>)[^;]*+)?);"
)


# Braces that are matched and hold no class: they are put aside while the braces around them are matched.
_INNER_OPEN, _INNER_CLOSE = CLOSE, TRIM
_CLASS_REST = rf"(?:[^{{}};(){OPEN}]++|\((?:[^(){{}};{OPEN}]++|\([^(){{}};{OPEN}]*+\))*+\))*+"
_WHOLE_CLASS = rf"{OPEN}{_CLASS_REST}(?:\{{[^{{}}]*+\}}|;)"


def class_pieces(content: Column) -> Column:
    """Code by innermost enclosing class: one text for each class, from its header on, and one for what is in none.

    Braces are matched from the inside: each pass takes the pairs that hold no other brace. A class whose body is such
    a pair leaves the text as a piece of its own, so what is left of an outer class are its own members; other pairs
    (method bodies, structs, namespaces) are put aside where they stand. There are as many passes as braces are deep. What
    stands between braces that do not match goes with the class header before it.
    """
    code = F.translate(code_only(content), OPEN + CLOSE + TRIM, "   ")
    marked = F.replace(F.regexp_replace(code, CLASS_HEADER, f"{OPEN}$1"), F.lit("{}"), F.lit("{ }"))

    def step(state: Column, _: Column) -> Column:
        # A class is put back as it stands; the marks of an empty pair next to it go.
        inner = F.regexp_replace(state["text"], rf"({_WHOLE_CLASS})|\{{([^{{}}]*+)\}}", f"$1{_INNER_OPEN}$2{_INNER_CLOSE}")
        inner = F.replace(inner, F.lit(_INNER_OPEN + _INNER_CLOSE), F.lit(""))
        done = let(
            inner,
            lambda t: F.struct(
                F.regexp_replace(t, _WHOLE_CLASS, " ; ").alias("text"),
                F.concat(state["pieces"], F.regexp_extract_all(t, F.lit(f"({_WHOLE_CLASS})"), F.lit(1))).alias("pieces"),
                ((t != state["text"]) | t.rlike(_WHOLE_CLASS)).alias("changed"),
            ),
        )
        return F.when(state["changed"], done).otherwise(state)

    start = F.struct(
        marked.alias("text"), F.array().cast("array<string>").alias("pieces"), F.lit(True).alias("changed")
    )
    most = F.length(marked) - F.length(F.translate(marked, "{;", ""))
    pieces = F.aggregate(
        F.sequence(F.lit(0), most),
        start,
        step,
        lambda state: F.concat(state["pieces"], F.split(F.concat(F.lit(" "), state["text"]), rf"(?={OPEN})")),
    )
    return F.transform(pieces, lambda t: F.translate(t, OPEN + _INNER_OPEN + _INNER_CLOSE, " {}"))


def attribute_names(text: Column) -> Column:
    """Names inside attribute brackets, arguments dropped."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)", ""), r"\]\s*\[", ",")
    return F.filter(F.split(F.regexp_replace(flat, r"[\[\]\s]", ""), ","), lambda n: n != "")


def parameters(text: Column) -> Column:
    """Parameter list as array<struct<type, name, attributes>>."""

    def one(p: Column) -> Column:
        attributes = F.regexp_extract(p, rf"^\s*({_ATTRIBUTES})", 1)
        plain = F.regexp_replace(
            F.regexp_replace(p, rf"^\s*{_ATTRIBUTES}(?:(?:this|ref|out|in|params|scoped|readonly){_END}\s*+)*+", ""),
            r"\s*=(?!>).*$|\s+$",
            "",
        )
        return F.struct(
            F.regexp_extract(plain, rf"^(.*?)\s+{ID}$", 1).alias("type"),
            F.regexp_extract(plain, rf"({ID})$", 1).alias("name"),
            attribute_names(attributes).alias("attributes"),
        )

    return F.filter(
        F.transform(F.split(text, r",(?![^<>]*>)"), one), lambda p: (p["name"] != "") & (p["type"] != "")
    )
