"""Row-level scoring rules of the evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.schema import MODEL_PRICES

# Severity order of a grade. NA is no grade.
SEVERITY = ["NA", "correct", "flag", "wrong"]
TOKENS_PER_PRICE = 1_000_000
EXCERPT_CHARS = 200


def worst_grade(*grades: Column) -> Column:
    """The most severe of several grades."""
    ladder = F.array(*[F.lit(s) for s in SEVERITY])
    rank = [F.coalesce(F.array_position(ladder, g), F.lit(1)) for g in grades]
    return F.element_at(ladder, F.greatest(*rank).cast("int"))


def any_grade(grades: list[Column], wanted: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(g == wanted, F.lit(False)) for g in grades])


def token_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """USD of one call; a model without a price costs nothing."""
    prices = F.create_map(
        *[F.lit(x) for name, pair in MODEL_PRICES.items() for x in (name, list(pair))]
    )
    price = F.try_element_at(prices, model)
    cost = tokens_in / TOKENS_PER_PRICE * price[0] + tokens_out / TOKENS_PER_PRICE * price[1]
    return F.coalesce(cost, F.lit(0.0))


def outcome(
    ex: Column, wrong: Column, flagged: Column, refused: Column, timed_out: Column, crashed: Column
) -> Column:
    """pass, review (a pass with a flag), fail (also after an unexpected exception), or error (refused, no rows)."""
    return (
        F.when(timed_out | crashed, "fail")
        .when(refused, "error")
        .when((ex == 1) & ~wrong, F.when(flagged, "review").otherwise("pass"))
        .otherwise("fail")
    )


def status(ex: Column, wrong: Column, refused: Column, timed_out: Column, crashed: Column) -> Column:
    return (
        F.when(timed_out, "timeout")
        .when(crashed | refused, "error")
        .when((ex == 1) & ~wrong, "pass")
        .otherwise("fail")
    )
