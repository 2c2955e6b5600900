"""Rules over SQL text as column expressions.

There is no parser here: names and clauses are found by token patterns and folds over a text's
tokens, row by row. Comments, literals and quoted names are told apart first (``sqllex``), and
literals are blanked before names are looked for, except where a rule is about the whole text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.sqllex import standard_code
from tallyhouse.functions.text import stripped
from tallyhouse.schema import TABLE_COLUMNS

# Forbidden words, whole-word form; and the gate's list, substring form.
FORBIDDEN_WORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE",
    "TRUNCATE", "GRANT", "REVOKE", "COPY", "VACUUM", "REINDEX",
]
GATE_WORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE",
    "ALTER", "TRUNCATE", "GRANT", "REVOKE",
]
DEFAULT_LIMIT = 1000
GATE_LIMIT = 10000
ALLOWED_TABLES = list(TABLE_COLUMNS)
TRAP_TABLE, SAFE_TABLE = "geolocation", "geolocation_by_zip"
LOOKUP_NAMES = ["product_category_translation", "pct"]
AGGREGATES = ["count", "sum", "avg", "min", "max", "stddev", "variance"]

# SQL words that are never a column or an alias.
WORDS = (
    "select from where group by having order limit offset as on using and or not in is null like ilike "
    "between case when then else end distinct all asc desc nulls first last join inner left right full "
    "outer cross natural union intersect except exists with interval date timestamp true false over "
    "partition rows range any some cast extract filter within delete insert update drop table into "
    "values set create alter truncate grant revoke"
).split()

NAME = "[a-z_][a-z0-9_]*"


def normalized(sql: Column) -> Column:
    """Lower case, quotes dropped, one blank, uniform spacing around ``, ( ) =``."""
    text = F.translate(F.lower(stripped(sql)), '`"', "")
    for pattern, replacement in (
        (r"\s+", " "),
        (r"\s*,\s*", ", "),
        (r"\s*\(\s*", "("),
        (r"\s*\)\s*", ")"),
        (r"\s*=\s*", " = "),
        (";+$", ""),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return stripped(text)


def code(name: str) -> Column:
    """The named column's text without comments, its literals in standard form."""
    return stripped(standard_code(name))


# Quoted names and standard literals as whole pieces, so that none is looked for inside another.
PIECE = r"""(?s)"[^"]*+(?:""[^"]*+)*+"|'[^']*+(?:''[^']*+)*+'|[^"']++|."""


# FROM where it introduces no table: inside these calls, and in a comparison.
NOT_A_TABLE_LIST = [
    (rf"\bextract\s*\(\s*{NAME}\s+from\b", "extract("),
    (rf"\btrim\s*\(\s*(?:(?:both|leading|trailing)\b\s*)?(?:''|{NAME}(?:\.{NAME})?)?\s*\bfrom\b", "trim("),
    (r"\b(substring|overlay)(\s*\((?:[^()]|\([^()]*\))*?)\bfrom\b((?:[^()]|\([^()]*\))*?)\bfor\b", "$1$2,$3,"),
    (r"\b(substring|overlay)(\s*\((?:[^()]|\([^()]*\))*?)\bfrom\b", "$1$2,"),
    (r"\bis\s+(?:not\s+)?distinct\s+from\b", "="),
]


def bare(code: Column) -> Column:
    """Lower-case code without literals and without quotes around names; ``extract(x from y)`` keeps only y."""

    def plain(piece: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(piece, '"', ""), r"[^a-z0-9_]", "_")
        return (
            F.when(F.startswith(piece, F.lit("'")) & (F.length(piece) > 1), "''")
            .when(F.startswith(piece, F.lit('"')) & (F.length(piece) > 2), name)
            .otherwise(piece)
        )

    pieces = F.regexp_extract_all(F.lower(code), F.lit(PIECE), F.lit(0))
    text = F.array_join(F.transform(pieces, plain), "")
    for pattern, replacement in NOT_A_TABLE_LIST:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def unfinished(text: Column) -> Column:
    """True for bare text with a literal, quoted name or comment that is never closed."""
    return F.replace(text, F.lit("''"), F.lit("")).rlike("[\"']")


def shape(text: Column) -> Column:
    """Bare text with every number as 0: texts that differ in literals only are of one shape."""
    return F.regexp_replace(text, r"(?<![a-z0-9_.$])\d+(?:\.\d+)?(?![a-z0-9_.])", "0")


SET_OPERATIONS = ["union", "intersect", "except"]


def set_operation(text: Column) -> Column:
    """The first set operation outside all parentheses of the first statement, or NULL."""
    parts = F.regexp_extract_all(text, F.lit(rf"[();]|\b(?:{'|'.join(SET_OPERATIONS)})\b"), F.lit(0))

    def step(state: Column, part: Column) -> Column:
        depth = state["depth"] + F.when(part == "(", 1).when(part == ")", -1).otherwise(0)
        hit = ~state["over"] & (state["depth"] == 0) & part.isin(SET_OPERATIONS) & state["found"].isNull()
        return F.struct(
            depth.alias("depth"),
            (state["over"] | ((part == ";") & (state["depth"] == 0))).alias("over"),
            F.when(hit, part).otherwise(state["found"]).alias("found"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("over"), F.lit(None).cast("string").alias("found"))
    return F.aggregate(parts, start, step, lambda s: s["found"])


def statement_kind(text: Column) -> Column:
    """First word in capitals, empty when there is none; the operation's name for a set operation."""
    word = F.upper(F.regexp_extract(text, "^([a-z]+)", 1))
    return F.when(word.isin("SELECT", "WITH"), F.coalesce(F.upper(set_operation(text)), word)).otherwise(word)


def forbidden_words(sql: Column) -> Column:
    found = F.regexp_extract_all(F.upper(sql), F.lit(rf"\b({'|'.join(FORBIDDEN_WORDS)})\b"), F.lit(1))
    return F.sort_array(F.array_distinct(found))


# Fixed value: the pattern of the usage count.
MENTIONED_TABLE = r"(?i)\b(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_]*)"


def mentioned_tables(sql: Column) -> Column:
    """Names after FROM and JOIN anywhere in the text, as a usage count wants them."""
    found = F.regexp_extract_all(sql, F.lit(MENTIONED_TABLE), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(found, F.lower)))


# Words that end a list of tables, and words that a table's name follows.
LIST_ENDS = (
    "select where group having order limit offset fetch union intersect except set values returning window when then"
).split()
TABLE_FOLLOWS = ["join", "into", "update", "table"]


_PATH = rf"{NAME}(?:\s*\.\s*{NAME})*"
_DERIVED = "("

# Kinds of a token for the fold below; any other is plain.
_PLAIN, _NAME, _PREFIXED, _STARRED, _CALL, _OPEN, _CLOSE, _COMMA, _END, _FROM, _TABLE, _SAME, _AS, _SELECT, _WITH, _SET = range(16)


def _quoted_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _token_kinds(parts: str) -> str:
    """``struct(t, k)`` per token."""
    ends = [w for w in LIST_ENDS if w not in SET_OPERATIONS and w != "select"]
    return f"""transform({parts}, t -> named_struct('t', t, 'k', CASE
        WHEN t = '(' THEN {_OPEN} WHEN t = ')' THEN {_CLOSE} WHEN t = ',' THEN {_COMMA} WHEN endswith(t, '(') THEN {_CALL}
        WHEN t = 'from' THEN {_FROM} WHEN t IN ({_quoted_list(TABLE_FOLLOWS)}) THEN {_TABLE}
        WHEN t = 'select' THEN {_SELECT} WHEN t = 'with' THEN {_WITH} WHEN t = 'as' THEN {_AS}
        WHEN t IN ({_quoted_list(SET_OPERATIONS)}) THEN {_SET} WHEN t IN ('lateral', 'only') THEN {_SAME}
        WHEN t IN ({_quoted_list([*ends, ";"])}) THEN {_END} WHEN t IN ({_quoted_list(WORDS)}) THEN {_PLAIN}
        WHEN endswith(t, '*') THEN {_STARRED} WHEN contains(t, '.') THEN {_PREFIXED} ELSE {_NAME} END))"""


def names_in_scope(name: str) -> Column:
    """``struct(refs, cols)`` of the named column's bare text: referenced tables (scope, name, alias)
    and prefixed columns (scope, prefix, column).

    One fold over the words and parentheses: a name is a table where a FROM list or a JOIN wants
    one, at any depth; a comma wants another one only inside a FROM list of its own depth. A
    table is there once under its name and once under its alias, a subquery in a FROM list under
    its alias and the name ``(``.

    Scopes are paths of numbers. A parenthesis that begins with SELECT or WITH is a scope below
    that around it, and each part of a set operation is a scope beside the others. What a scope
    knows is known in those whose paths begin with its own.
    """
    words = "|".join([*WORDS, *LIST_ENDS, "lateral", "only", "window", "returning", "offset", "fetch"])
    token = rf"\b(?:{words})\b(?!\s*\.)|{_PATH}\s*\(|{_PATH}(?:\s*\.\s*\*)?|[(),;]"
    parts = _token_kinds(f"regexp_extract_all({name}, r'{token}', 0)")
    top = "element_at(s.stack, -1)"

    def state(**changed: str) -> str:
        """Whatever comes, a table is wanted, an alias looked for and a parenthesis fresh for one token only."""
        values = {"stack": "s.stack", "wanted": "false", "fresh": "false", "last": "''", "next": "s.next + 1", "refs": "s.refs", "cols": "s.cols"}
        return "named_struct(" + ", ".join(f"'{field}', {value}" for field, value in (values | changed).items()) + ")"

    def level(listed: str, scope: str, derived: str) -> str:
        return f"array(named_struct('listed', {listed}, 'scope', {scope}, 'derived', {derived}))"

    def on_top(listed: str, scope: str = f"{top}.scope") -> str:
        return f"concat(slice(s.stack, 1, size(s.stack) - 1), {level(listed, scope, f'{top}.derived')})"

    def ref(table: str, alias: str) -> str:
        return f"concat(s.refs, array(named_struct('scope', {top}.scope, 'name', {table}, 'alias', {alias})))"

    own = rf"regexp_extract(x.t, r'({NAME})$', 1)"
    pair = [rf"regexp_extract(x.t, r'({NAME})\s*\.\s*({NAME}|\*)$', {i})" for i in (1, 2)]
    column = f"concat(s.cols, array(named_struct('scope', {top}.scope, 'prefix', {pair[0]}, 'column', {pair[1]})))"
    inner = f"concat({top}.scope, s.next, '.')"
    beside = rf"concat(regexp_extract({top}.scope, r'^(.*\.|)\d+\.$', 1), s.next, '.')"
    step = f"""CASE x.k
        WHEN {_PLAIN} THEN {state()}
        WHEN {_NAME} THEN CASE WHEN s.wanted THEN {state(refs=ref(own, own), last=own)}
                               WHEN s.last <> '' THEN {state(refs=ref("s.last", "x.t"))} ELSE {state()} END
        WHEN {_PREFIXED} THEN CASE WHEN s.wanted THEN {state(refs=ref(own, own), last=own)} ELSE {state(cols=column)} END
        WHEN {_STARRED} THEN {state(cols=column)}
        WHEN {_CALL} THEN {state(stack=f"concat(s.stack, {level('false', f'{top}.scope', 'false')})", fresh="true")}
        WHEN {_OPEN} THEN {state(stack=f"concat(s.stack, {level('s.wanted', f'{top}.scope', 's.wanted')})", wanted="s.wanted", fresh="true")}
        WHEN {_CLOSE} THEN CASE WHEN size(s.stack) > 1
            THEN {state(stack="slice(s.stack, 1, size(s.stack) - 1)", last=f"CASE WHEN {top}.derived THEN '{_DERIVED}' ELSE '' END")} ELSE {state()} END
        WHEN {_COMMA} THEN {state(wanted=f"{top}.listed")}
        WHEN {_END} THEN {state(stack=on_top("false"))}
        WHEN {_FROM} THEN {state(stack=on_top("true"), wanted="true")}
        WHEN {_TABLE} THEN {state(wanted="true")}
        WHEN {_SAME} THEN {state(wanted="s.wanted")}
        WHEN {_AS} THEN {state(last="s.last")}
        WHEN {_SELECT} THEN CASE WHEN s.fresh THEN {state(stack=on_top("false", inner))} ELSE {state(stack=on_top("false"))} END
        WHEN {_WITH} THEN CASE WHEN s.fresh THEN {state(stack=on_top("false", inner))} ELSE {state()} END
        ELSE {state(stack=on_top("false", beside))} END"""
    start = state(
        stack=level("false", "'0.'", "false"), next="1",
        refs="cast(array() as array<struct<scope:string,name:string,alias:string>>)",
        cols="cast(array() as array<struct<scope:string,prefix:string,column:string>>)",
    )
    found = "named_struct('refs', s.refs, 'cols', array_distinct(s.cols))"
    return F.expr(f"aggregate({parts}, {start}, (s, x) -> {step}, s -> {found})")


def table_names(references: Column) -> Column:
    """Unqualified names of the referenced tables."""
    named = F.filter(references, lambda r: r["name"] != _DERIVED)
    return F.sort_array(F.array_distinct(F.transform(named, lambda r: r["name"])))


def reads_catalog(sql: Column, tables: Column) -> Column:
    system = F.exists(tables, lambda t: t.rlike("^(pg_|information_schema)"))
    return system | sql.rlike(r"(?i)\binformation_schema\b")


def tables_not_allowed(tables: Column) -> Column:
    return F.array_except(tables, F.array(*[F.lit(t) for t in ALLOWED_TABLES]))


def uses_trap_table(tables: Column) -> Column:
    return F.array_contains(tables, TRAP_TABLE) & ~F.array_contains(tables, SAFE_TABLE)


def selects_star(text: Column) -> Column:
    without_counts = F.regexp_replace(text, r"\b(count|sum|avg|min|max)\s*\(\s*\*\s*\)", "agg()")
    return without_counts.rlike(r"(\bselect|\bdistinct|\ball|,|\.)\s*\*")


def has_aggregation(text: Column) -> Column:
    return text.rlike(rf"\bgroup\s+by\b|\b({'|'.join(AGGREGATES)})\s*\(")


def has_limit(sql: Column, text: Column) -> Column:
    return text.rlike(r"\blimit\b") | sql.rlike(r"(?i)\blimit\s+\d+")


def with_default_limit(sql: Column, unlimited: Column) -> Column:
    ended = stripped(F.regexp_replace(sql, ";+$", ""))
    return F.when(unlimited, F.concat(ended, F.lit(f" LIMIT {DEFAULT_LIMIT}"))).otherwise(sql)


CLAUSE_PART = r"""(?s)"[^"]*+(?:""[^"]*+)*+"|'[^']*+(?:''[^']*+)*+'|[A-Za-z_][A-Za-z0-9_]*|[();]|\s+|[^A-Za-z_"'();\s]+|."""
# What ends a WHERE at its own depth.
CLAUSE_ENDS = ["group", "having", "order", "limit", "union", "intersect", "except", "window", "offset", "fetch"]


def shallowest_clause(code: Column, word: str, ends: list[str]) -> Column:
    """Text after the first ``word`` at the least depth of parentheses, up to what ends it; NULL if absent."""
    parts = F.regexp_extract_all(code, F.lit(CLAUSE_PART), F.lit(0))
    far = F.lit(1 << 20)

    def step(s: Column, part: Column) -> Column:
        lower = F.lower(part)
        depth = s["depth"] + F.when(part == "(", 1).when(part == ")", -1).otherwise(0)
        starts = (lower == word) & (s["depth"] < s["best"])
        stops = s["open"] & ((depth < s["best"]) | ((s["depth"] == s["best"]) & ((part == ";") | lower.isin(ends))))
        text = F.when(starts, "").when(s["open"] & ~stops, F.concat(s["text"], part)).otherwise(s["text"])
        return F.struct(
            depth.alias("depth"), F.when(starts, s["depth"]).otherwise(s["best"]).alias("best"),
            (starts | (s["open"] & ~stops)).alias("open"), text.alias("text"),
        )

    start = F.struct(
        F.lit(0).alias("depth"), far.alias("best"), F.lit(False).alias("open"), F.lit(None).cast("string").alias("text")
    )
    return F.aggregate(parts, start, step, lambda s: s["text"])


def join_clauses(text: Column) -> Column:
    """``struct(side, right)`` per join; side is LEFT, RIGHT, FULL, CROSS or INNER."""
    pattern = F.lit(
        rf"(?:\b(left|right|full|inner|cross)\s+)?(?:\bouter\s+)?\bjoin\s+(?:{NAME}\.)*({NAME})"
    )

    def clause(word: Column, right: Column) -> Column:
        side = F.when(word == "", "INNER").otherwise(F.upper(word))
        return F.struct(side.alias("side"), right.alias("right"))

    return F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), clause
    )


def inner_joins_lookup(joins: Column) -> Column:
    return F.exists(
        joins, lambda j: ~j["side"].isin("LEFT", "RIGHT", "FULL") & j["right"].isin(LOOKUP_NAMES)
    )


# -- columns ----------------------------------------------------------------------------


def _is_word(name: Column) -> Column:
    return name.isin(WORDS)


# Words an aliased expression may end with.
VALUE_WORDS = ["end", "null", "true", "false"]


def select_aliases(text: Column) -> Column:
    """Names given to expressions: after AS, after a call, or as ``expression name`` before a comma or FROM."""
    after_as = F.regexp_extract_all(text, F.lit(rf"\bas\s+({NAME})"), F.lit(1))
    after_call = F.regexp_extract_all(text, F.lit(rf"\)\s+({NAME})"), F.lit(1))
    listed = F.lit(rf"(?:\b({NAME})|[')0-9])\s+({NAME})(?=\s*,|\s+from\b)")
    before, names = F.regexp_extract_all(text, listed, F.lit(1)), F.regexp_extract_all(text, listed, F.lit(2))
    after_value = F.array_compact(
        F.zip_with(before, names, lambda b, n: F.when(~_is_word(b) | b.isin(VALUE_WORDS), n))
    )
    return F.concat(after_as, F.filter(F.concat(after_call, after_value), lambda n: ~_is_word(n)))


def prefixed_columns(text: Column) -> Column:
    """``prefix.column`` references; ``prefix.*`` counts as a column of that name."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b({NAME}\.(?:{NAME}|\*))"), F.lit(1)))


# Words that are values, and word groups of operators, types, frames and clauses: no columns.
VALUE_KEYWORDS = (
    "current_date current_time current_timestamp localtime localtimestamp current_user session_user current_role "
    "current_catalog current_schema user default"
).split()
WORD_GROUPS = [
    r"\bat\s+time\s+zone\b",
    r"(?:\bas\s+|::\s*)?\b(?:(?:timestamp|time)\s+(?:with|without)\s+time\s+zone|double\s+precision|character\s+varying)\b",
    r"\bsimilar\s+to\b",
    r"\bescape\s+''",
    r"\barray\s*(?=\[)",
    r"\bfetch\s+(?:first|next)\b(?:\s+\d+)?\s+rows?\s+(?:only|with\s+ties)\b",
    r"\boffset\s+\d+\s+rows?\b",
    r"\b(?:unbounded|\d+)\s+(?:preceding|following)\b|\bcurrent\s+row\b",
    r"\bis\s+(?:not\s+)?unknown\b|\bbetween\s+symmetric\b",
    r"\bgrouping\s+sets\b|\bwith\s+(?:ordinality|recursive)\b",
    r"\binterval\s+''\s*(?:year|month|day|hour|minute|second)\b(?:\s+to\s+(?:month|hour|minute|second)\b)?",
    r"\b(?:u&|[bnx])''",
]
NOT_A_PLAIN_COLUMN = (
    "|".join(WORD_GROUPS)
    + rf"|\b(?:from|join|into|update|table)\s+(?:{NAME}\.)*{NAME}(?:\s+as\s+{NAME})?"
    rf"|\bas\s+{NAME}|::\s*{NAME}|\b{NAME}\.(?:{NAME}|\*)|\b{NAME}\s*\("
)


def plain_columns(text: Column) -> Column:
    """Identifiers that are neither qualified, nor a table, an alias declaration, a call or a SQL word."""
    rest = F.regexp_replace(text, NOT_A_PLAIN_COLUMN, " ")
    names = F.array_distinct(F.regexp_extract_all(rest, F.lit(rf"\b({NAME})\b"), F.lit(1)))
    return F.array_except(names, F.array(*[F.lit(w) for w in [*WORDS, *VALUE_KEYWORDS]]))


def unknown_columns(tables: Column, names: Column, ignored: Column, plain: Column) -> Column:
    """``table.column`` for references the declared columns do not have.

    A prefixed column is looked up in the innermost scope that knows the prefix (``names`` is
    that of ``names_in_scope``); a plain one is checked only when a single table is in the text.
    Names that cannot be resolved are left alone.
    """
    catalog = F.array(*[F.lit(f"{t}.{c}") for t, columns in TABLE_COLUMNS.items() for c in columns])
    refs = names["refs"]

    def resolved(column: Column) -> Column:
        known = F.filter(refs, lambda r: (r["alias"] == column["prefix"]) & F.startswith(column["scope"], r["scope"]))
        # The innermost scope; there, an alias before a table of that name.
        ranked = F.transform(known, lambda r: F.struct(
            F.length(r["scope"]).alias("depth"), (r["alias"] != r["name"]).alias("given"), r["name"].alias("name")
        ))
        owner = F.array_max(ranked)["name"]
        return F.when(~F.array_contains(ignored, column["column"]), F.concat(owner, F.lit("."), column["column"]))

    single = F.when(F.size(tables) == 1, F.get(tables, F.lit(0)))
    known_names = F.concat(F.transform(refs, lambda r: r["alias"]), F.transform(refs, lambda r: r["name"]))
    free = F.array_except(plain, F.concat(ignored, known_names))
    references = F.concat(
        F.transform(names["cols"], resolved), F.transform(free, lambda n: F.concat(single, F.lit("."), n))
    )
    absent = F.array_except(F.array_compact(references), catalog)
    return F.sort_array(F.filter(absent, lambda r: F.substring_index(r, ".", 1).isin(ALLOWED_TABLES)))


# -- verdicts ---------------------------------------------------------------------------


def rule_failures(
    sql: Column, code: Column, unfinished: Column, kind: Column, star: Column, tables: Column, unknown: Column
) -> Column:
    """Names of the blocking rules a text breaks, in rule order.

    Nothing else is judged on blank text, nor on one that ends inside a literal, name or comment.
    """
    broken = [
        ("R2", ~kind.isin("SELECT", "WITH")),
        ("R3", F.size(forbidden_words(sql)) > 0),
        ("R4", reads_catalog(sql, tables)),
        ("R5", F.size(tables_not_allowed(tables)) > 0),
        ("R6", uses_trap_table(tables)),
        ("R7", star),
        ("R10", F.size(unknown) > 0),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in broken]))
    return F.when((code == "") | unfinished, F.array(F.lit("R1"))).otherwise(found)


def rule_warnings(code: Column, unfinished: Column, unlimited: Column, inner_lookup: Column) -> Column:
    warned = [("R8", unlimited), ("R9", inner_lookup)]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in warned]))
    return F.when((code == "") | unfinished, F.array().cast("array<string>")).otherwise(found)


def gate_verdict(sql: Column) -> Column:
    """The light gate: ``empty``, ``not select``, ``forbidden <word>`` or ``ok``."""
    text = F.upper(stripped(sql))
    verdict = F.when(text == "", "empty").when(~F.startswith(text, F.lit("SELECT")), "not select")
    verdict = reduce(
        lambda chain, word: chain.when(F.contains(text, F.lit(word)), f"forbidden {word}"), GATE_WORDS, verdict
    )
    return verdict.otherwise("ok")


def gate_text(sql: Column, row_limit: int = GATE_LIMIT) -> Column:
    """Text the gate lets through: a limit is added unless ``LIMIT`` occurs anywhere in it."""
    text = stripped(sql)
    limited = F.concat(F.regexp_replace(text, ";+$", ""), F.lit(f" LIMIT {row_limit}"))
    return F.when(F.contains(F.upper(text), F.lit("LIMIT")), text).otherwise(limited)


# Fixed value: what counts as a fenced block.
FENCED = r"(?is)```(?:sql)?\s*\n(.*?)\n```"


def sql_in_fence(text: Column) -> Column:
    """Text inside the first fenced block, or the whole text."""
    return stripped(F.when(text.rlike(FENCED), F.regexp_extract(text, FENCED, 1)).otherwise(text))


def fences_removed(text: Column) -> Column:
    return stripped(F.replace(F.regexp_replace(text, r"```(?:sql)?\s*\n?", ""), F.lit("```"), F.lit("")))
