"""Referential audits: rows without a parent, rows lost or multiplied by a join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(tables: Mapping[str, DataFrame], relations: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Per relation (child, its key, parent, its key): child rows, and those whose non-NULL key has no parent.

    Every table is read once: a row gives a tagged key for each part it plays, as a child or as a
    parent. Keys are counted per tag before they move, and one exchange brings children and
    parents together, so a key that holds a third of a table is one row per task.
    """
    domains = {parent: i for i, parent in enumerate(dict.fromkeys(r[2:] for r in relations))}
    roles: dict[str, list] = {}
    for i, (child, child_key, parent, parent_key) in enumerate(relations):
        roles.setdefault(child, []).append((domains[parent, parent_key], child_key, i))
    for (parent, parent_key), domain in domains.items():
        roles.setdefault(parent, []).append((domain, parent_key, -1))
    tagged = [
        tables[name].select(F.inline(F.array(*[
            F.struct(F.lit(domain).alias("domain"), F.col(key).cast("string").alias("key"), F.lit(role).alias("role"))
            for domain, key, role in parts
        ])))
        for name, parts in roles.items()
    ]
    rows = [F.count_if(F.col("role") == i).alias(f"n_{i}") for i in range(len(relations))]
    known = F.bool_or(F.col("role") == -1) | F.col("key").isNull()
    per_key = reduce(DataFrame.unionAll, tagged).groupBy("domain", "key").agg(*rows, known.alias("known"))
    report = F.array(*[
        F.struct(
            F.lit(f"{child}.{key}").alias("relationship"), F.coalesce(F.sum(f"n_{i}"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.when(~F.col("known"), F.col(f"n_{i}"))), F.lit(0)).alias("n_orphans"),
        )
        for i, (child, key, _, _) in enumerate(relations)
    ])
    return per_key.agg(report.alias("report")).select(F.inline("report"))


def join_rows(left: DataFrame, left_key: str, right: DataFrame, right_key: str, name: str) -> DataFrame:
    """One row: how many rows the inner join would have, without forming them."""
    lefts = left.groupBy(F.col(left_key).alias("_key")).agg(F.count("*").alias("_left"))
    rights = right.groupBy(F.col(right_key).alias("_key")).agg(F.count("*").alias("_right"))
    product = F.col("_left") * F.col("_right")
    return lefts.join(rights, "_key").agg(F.coalesce(F.sum(product), F.lit(0)).alias(name))
