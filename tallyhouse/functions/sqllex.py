"""Comments, literals and quoted names of SQL text, told apart in one pass.

A fold over a text's pieces keeps the state a PostgreSQL scanner would: in code, in a literal
(plain, with backslash escapes, or between dollar tags), in a quoted name, in a line comment, or
in a block comment, which may hold others. It collects places only, so that the text is cut once.

The fold is one SQL expression: built call by call, it would take longer to build than to run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that may change the state stand alone, everything between them is one piece:
# quotes, dollar, backslash, slash, star, dash and line break.
PIECE = r"[\x27\x22$\x5c/*\x2d\n]|[^\x27\x22$\x5c/*\x2d\n]+"
QUOTE, NAME_QUOTE, BACKSLASH, BREAK = "char(39)", "char(34)", "char(92)", "char(10)"

CODE, LITERAL, ESCAPES, NAME, LINE, BLOCK, DOLLAR = range(7)

# Texts without these hold standard literals and quoted names only.
SPECIAL = r"--|/\*|[$\x5c]"

_WIDE = r"\x{80}-\x{10FFFF}"
_ESCAPE_PREFIX = rf"(?:^|[^A-Za-z0-9_{_WIDE}])[eE]$"
_IN_WORD = rf"[A-Za-z0-9_{_WIDE}]$"
_TAG = rf"^[A-Za-z_{_WIDE}][A-Za-z0-9_{_WIDE}]*$"

# Places count from 0. ``mark`` is what may become a dollar tag, from ``mark_at`` on; ``shut`` the
# place after a quote that closed a literal or name, where another one opens it again; ``prev`` the
# piece before, empty where it has been used up.
START = {
    "at": "0", "mode": str(CODE), "prev": "''", "mark": "''", "mark_at": "0", "tag": "''", "depth": "0", "escaped": "false",
    "shut": "-1", "shut_mode": str(CODE), "spans": f"array(named_struct('kind', {CODE}, 'begin', 0))",
}


def _struct(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in values.items()) + ")"


def _next(**changed: object) -> str:
    """The state after the piece p: as before but for the place and what is named."""
    kept = {name: f"s.{name}" for name in START} | {"at": "s.at + length(p)", "prev": "p", "mark": "''"}
    return _struct(kept | {name: str(value) for name, value in changed.items()})


def _begun(kind: int, begin: str) -> str:
    return f"concat(s.spans, array(named_struct('kind', {kind}, 'begin', {begin})))"


def _open(mode: int, begin: str, **changed: object) -> str:
    return _next(mode=mode, prev="''", spans=_begun(mode, begin), **changed)


def _close(begin: str = "s.at + 1", **changed: object) -> str:
    return _next(mode=CODE, prev="''", spans=_begun(CODE, begin), **changed)


def _closed_quote(mode: int) -> str:
    return _close(shut="s.at + 1", shut_mode=mode)


def _step() -> str:
    quote, again = f"p = {QUOTE}", "s.at = s.shut AND s.shut_mode"
    in_code = f"""CASE
        WHEN p = {QUOTE} AND {again} IN ({LITERAL}, {ESCAPES}) OR p = {NAME_QUOTE} AND {again} = {NAME}
          THEN {_next(mode="s.shut_mode", prev="''", spans="slice(s.spans, 1, size(s.spans) - 1)")}
        WHEN {quote} AND s.prev RLIKE r'{_ESCAPE_PREFIX}' THEN {_open(ESCAPES, "s.at - 1", escaped="false")}
        WHEN {quote} THEN {_open(LITERAL, "s.at")}
        WHEN p = {NAME_QUOTE} THEN {_open(NAME, "s.at")}
        WHEN p = '-' AND s.prev = '-' THEN {_open(LINE, "s.at - 1")}
        WHEN p = '*' AND s.prev = '/' THEN {_open(BLOCK, "s.at - 1", depth=1)}
        WHEN p = '$' AND s.mark <> '' THEN {_open(DOLLAR, "s.mark_at", tag="concat(s.mark, p)")}
        WHEN p = '$' AND s.prev <> '$' AND NOT s.prev RLIKE r'{_IN_WORD}' THEN {_next(mark="p", mark_at="s.at")}
        WHEN s.mark = '$' AND p RLIKE r'{_TAG}' THEN {_next(mark="concat(s.mark, p)")}
        ELSE {_next()} END"""
    # A line comment leaves its line break to the code after it.
    in_block = f"""CASE
        WHEN p = '*' AND s.prev = '/' THEN {_next(prev="''", depth="s.depth + 1")}
        WHEN p = '/' AND s.prev = '*' AND s.depth > 1 THEN {_next(prev="''", depth="s.depth - 1")}
        WHEN p = '/' AND s.prev = '*' THEN {_close()}
        ELSE {_next()} END"""
    in_dollar = f"""CASE
        WHEN p = '$' AND concat(s.mark, p) = s.tag THEN {_close()}
        WHEN p = '$' THEN {_next(mark="p")}
        WHEN s.mark = '$' THEN {_next(mark="concat(s.mark, p)")}
        ELSE {_next()} END"""
    return f"""CASE s.mode
      WHEN {CODE} THEN {in_code}
      WHEN {LITERAL} THEN CASE WHEN {quote} THEN {_closed_quote(LITERAL)} ELSE {_next()} END
      WHEN {ESCAPES} THEN CASE WHEN s.escaped THEN {_next(escaped="false")} WHEN p = {BACKSLASH} THEN {_next(escaped="true")}
                               WHEN {quote} THEN {_closed_quote(ESCAPES)} ELSE {_next()} END
      WHEN {NAME} THEN CASE WHEN p = {NAME_QUOTE} THEN {_closed_quote(NAME)} ELSE {_next()} END
      WHEN {LINE} THEN CASE WHEN p = {BREAK} THEN {_close("s.at")} ELSE {_next()} END
      WHEN {BLOCK} THEN {in_block}
      ELSE {in_dollar} END"""


def _standard(kind: str, text: str) -> str:
    """A span as standard SQL: comments as a blank, literals of all forms in single quotes."""
    def quoted(content: str) -> str:
        return f"concat({QUOTE}, replace({content}, {QUOTE}, concat({QUOTE}, {QUOTE})), {QUOTE})"

    tag = rf"length(regexp_extract({text}, r'^\$[^$]*\$', 0))"
    inside = f"substr({text}, {tag} + 1, length({text}) - 2 * {tag})"
    plain = rf"regexp_replace(substr({text}, 3, length({text}) - 3), r'(?s)\x5c(.)|(\x27)\x27', '$1$2')"
    return f"""CASE WHEN {kind} IN ({LINE}, {BLOCK}) THEN ' ' WHEN {kind} = {DOLLAR} THEN {quoted(inside)}
                    WHEN {kind} = {ESCAPES} THEN {quoted(plain)} ELSE {text} END"""


def standard_code(name: str) -> Column:
    """The text in the named column without comments, and with every literal in the standard's form.

    A literal, name or comment that is never closed ends the text, as a lone quote.
    """
    end = f"coalesce(get(s.spans, i + 1).begin, length({name}))"
    text = f"substr({name}, span.begin + 1, {end} - span.begin)"
    open_ended = f"i = size(s.spans) - 1 AND s.mode NOT IN ({CODE}, {LINE})"
    cut = f"CASE WHEN {open_ended} THEN {QUOTE} ELSE {_standard('span.kind', text)} END"
    folded = f"""aggregate(regexp_extract_all({name}, r'{PIECE}', 0), {_struct(START)}, (s, p) -> {_step()},
                           s -> array_join(transform(s.spans, (span, i) -> {cut}), ''))"""
    return F.expr(f"CASE WHEN {name} RLIKE r'{SPECIAL}' THEN {folded} ELSE {name} END")
