"""Rubric graders over SQL text: ``correct``, ``flag``, ``wrong`` or ``NA`` per dimension.

``items`` is the item list of a rubric cell, NULL when the dimension is not required.
``text`` is the SQL without comments and literals, see ``sqltext.bare``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.sqltext import AGGREGATES, NAME

DIMENSIONS = ["table", "filters", "aggregation", "join", "date_operator", "time_frame"]


def graded(n_missing: Column, n_items: Column) -> Column:
    return (
        F.when(F.coalesce(n_items, F.lit(0)) <= 0, "NA")
        .when(n_missing == 0, "correct")
        .when(n_missing < n_items, "flag")
        .otherwise("wrong")
    )


def _by_missing(items: Column, is_missing) -> Column:
    return graded(F.size(F.filter(items, is_missing)), F.size(items))


def grade_table(items: Column, tables: Column, qualified: Column, plain: Column) -> Column:
    """Every item occurs as a table, a column, or a column under its table's name."""
    columns = F.transform(qualified, lambda r: F.substring_index(r, ".", -1))
    seen = F.concat(tables, qualified, columns, plain)

    def is_missing(item: Column) -> Column:
        name = F.lower(F.translate(F.trim(item), '"`', ""))
        return ~F.array_contains(seen, name) & ~F.array_contains(seen, F.substring_index(name, ".", -1))

    return _by_missing(items, is_missing)


def grade_filters(items: Column, where: Column, code: Column) -> Column:
    """Every item occurs in the outermost WHERE's text (or in the whole text when there is none)."""
    searched = F.lower(F.regexp_replace(F.coalesce(where, code), r"\s+", " "))

    def is_missing(item: Column) -> Column:
        wanted = F.lower(F.regexp_replace(item, r"\s+", " "))
        unprefixed = F.regexp_replace(wanted, r"\b[a-z_]+\.", "")
        return ~F.contains(searched, wanted) & ~F.contains(searched, unprefixed)

    return _by_missing(items, is_missing)


def grade_aggregation(items: Column, text: Column, limit: Column) -> Column:
    """Aggregate names, DISTINCT, GROUP BY, ORDER BY and the outermost LIMIT n; other free text passes."""
    calls = F.regexp_extract_all(text, F.lit(rf"\b({'|'.join(AGGREGATES)})\s*\("), F.lit(1))
    limit = F.regexp_extract(F.coalesce(limit, F.lit("")), r"^\s*(\d+)", 1)

    def is_missing(raw: Column) -> Column:
        item = F.lower(F.trim(raw))
        called = F.regexp_extract(item, r"^(count|sum|avg|min|max)\(", 1)
        wanted = F.regexp_extract(item, r"limit\s+(\d+)", 1)
        return (
            F.when(item.isin(AGGREGATES), ~F.array_contains(calls, item))
            .when(F.contains(item, F.lit("distinct")), ~text.rlike(r"\bdistinct\b"))
            .when(F.startswith(item, F.lit("group by")), ~text.rlike(r"\bgroup\s+by\b"))
            .when(F.startswith(item, F.lit("order by")), ~text.rlike(r"\border\s+by\b"))
            .when(F.startswith(item, F.lit("limit")), (limit == "") | ~F.contains(limit, wanted))
            .when(called != "", ~F.array_contains(calls, called))
            .otherwise(False)
        )

    return _by_missing(items, is_missing)


def grade_join(items: Column, tables: Column, joins: Column) -> Column:
    """A stated join type differs from the one used: flag. Everything else is correct.

    The table an item is about is the one it names last; an item that names no table of the
    query is passed over.
    """
    def differs(raw: Column) -> Column:
        item = F.lower(raw)
        named = F.filter(tables, lambda t: F.contains(item, t))
        # Furthest into the text; of two ending there, the longer name.
        places = F.transform(
            named,
            lambda t: F.struct(
                (-F.length(F.call_function("substring_index", item, t, F.lit(-1)))).alias("place"),
                F.length(t).alias("size"),
                t.alias("name"),
            ),
        )
        target = F.array_max(places)["name"]
        expected = (
            F.when(F.contains(item, F.lit("left join")), "LEFT")
            .when(F.contains(item, F.lit("right join")), "RIGHT")
            .when(F.contains(item, F.lit("inner join")) | F.contains(item, F.lit(" join ")), "INNER")
        )
        used = F.get(F.filter(joins, lambda j: j["right"] == target), F.lit(0))["side"]
        return F.coalesce(used != expected, F.lit(False))

    return (
        F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "NA")
        .when(F.exists(items, differs), "flag")
        .otherwise("correct")
    )


COMPARISON = "<=|>=|<>|<|>"


def grade_date_operator(items: Column, text: Column) -> Column:
    """Comparison operators named by the items occur in the text; ``<>`` is none of them."""
    used = F.array_remove(F.regexp_extract_all(text, F.lit(f"({COMPARISON})"), F.lit(1)), F.lit("<>"))
    expected = F.array_distinct(
        F.array_remove(F.transform(items, lambda i: F.regexp_extract(i, "(<=|>=|<|>)", 1)), F.lit(""))
    )
    return graded(F.size(F.array_except(expected, used)), F.size(expected))


def grade_time_frame(spec: Column, sql: Column) -> Column:
    """Function hints like ``date_part(`` of the spec occur in the text."""
    text = F.lower(sql)
    for part in ("day", "year", "month"):
        text = F.replace(text, F.lit(f"extract({part} from "), F.lit(f"date_part('{part}', "))
    hints = F.regexp_extract_all(F.lower(spec), F.lit(r"([a-z_]+\()"), F.lit(1))
    return graded(F.size(F.filter(hints, lambda h: ~F.contains(text, h))), F.size(hints))
