"""Slugs, split lists and ground-truth JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of a case slug, words kept at most, words needed at least.
SLUG_STOPWORDS = [
    "the", "a", "an", "of", "for", "in", "on", "at", "to", "with", "and",
    "or", "is", "are", "what", "how", "many", "list", "top", "per",
]
SLUG_WORDS = 5
SLUG_MIN_WORDS = 2
EMPTY_SLUG = "case"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def run_slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def run_id(name: Column, stamp: Column) -> Column:
    """``slug_stamp``, or the stamp alone for a run without a usable name."""
    slug = run_slug(F.coalesce(name, F.lit("")))
    return F.when(slug != "", F.concat_ws("_", slug, stamp)).otherwise(stamp)


def question_slug(question: Column) -> Column:
    """First meaningful words of a question; stop words stay when too little else is left."""
    cleaned = F.regexp_replace(F.lower(question), r"[^a-z0-9\s]", " ")
    words = F.filter(F.split(cleaned, r"\s+"), lambda w: w != "")
    meaningful = F.filter(words, lambda w: ~w.isin(SLUG_STOPWORDS))
    chosen = F.when(F.size(meaningful) >= SLUG_MIN_WORDS, meaningful).otherwise(words)
    slug = F.array_join(F.slice(chosen, 1, SLUG_WORDS), "_")
    return F.when(slug == "", EMPTY_SLUG).otherwise(slug)


def case_id(letter: Column, number: Column, slug: Column) -> Column:
    """Letter, number with at least two digits, slug."""
    return F.concat(letter, F.format_string("%02d", number), F.lit("_"), slug)


def trimmed_parts(text: Column, separator: str) -> Column:
    parts = F.transform(F.split(text, separator), lambda p: stripped(p))
    return F.filter(parts, lambda p: p != "")


def rubric_block(cell: Column) -> Column:
    """``struct(required, spec, items)`` of a free-text rubric cell.

    Items are separated by ``;`` where the cell has one, else by ``,``. A blank cell is not
    required and has neither spec nor items.
    """
    spec = stripped(F.coalesce(cell, F.lit("")))
    items = F.when(F.contains(spec, F.lit(";")), trimmed_parts(spec, ";")).otherwise(trimmed_parts(spec, ","))
    present = spec != ""
    return F.struct(
        present.alias("required"),
        F.when(present, spec).alias("spec"),
        F.when(present, items).alias("items"),
    )


def label_tags(label: Column) -> Column:
    return F.transform(F.split(label, r"\+"), lambda t: stripped(t))


def ground_truth_shape(cell: Column) -> Column:
    """``struct(form, n_rows, n_cols, scalar)`` of a ground-truth JSON cell.

    Forms: ``rows`` (array of arrays), ``table`` (object with rows and perhaps columns),
    ``raw`` (other text) and ``none`` (blank). ``scalar`` is the value of a one-by-one result.
    """
    text = stripped(F.coalesce(cell, F.lit("")))
    is_json = F.try_parse_json(text).isNotNull()
    bare_rows = F.json_array_length(text)
    object_rows = F.get_json_object(text, "$.rows")
    form = (
        F.when(text == "", "none")
        .when(is_json & F.startswith(text, F.lit("{")) & object_rows.isNotNull(), "table")
        .when(is_json & F.startswith(text, F.lit("[")), "rows")
        .otherwise("raw")
    )
    rows = F.when(form == "table", object_rows).when(form == "rows", text)
    n_rows = F.when(form == "table", F.json_array_length(object_rows)).when(form == "rows", bare_rows)
    n_named = F.json_array_length(F.get_json_object(text, "$.columns"))
    n_cells = F.coalesce(F.json_array_length(F.get_json_object(rows, "$[0]")), F.lit(0))
    n_cols = F.when((form == "table") & (n_named > 0), n_named).when(rows.isNotNull(), n_cells)
    scalar = F.when((n_rows == 1) & (n_cells == 1), F.get_json_object(rows, "$[0][0]"))
    return F.struct(
        form.alias("form"), n_rows.alias("n_rows"), n_cols.alias("n_cols"), scalar.alias("scalar")
    )
