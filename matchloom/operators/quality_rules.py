"""Data-quality rules as data (Q1, E7, K8): checks, uniqueness and references."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Check(NamedTuple):
    """Rows of a table for which the condition is not true break the rule; an unknown condition passes, as in SQL."""

    rule: str
    table: str
    key: str
    condition: str


class Unique(NamedTuple):
    """Equal values of the columns on two rows break the rule; a row with a null among them equals none, as in SQL."""

    rule: str
    table: str
    columns: tuple[str, ...]
    where: str = "true"


class Reference(NamedTuple):
    """Rows whose columns, none of them null, are not in the other table break the rule; several columns keep to one tenant, say."""

    rule: str
    table: str
    column: str | tuple[str, ...]
    other: str
    other_column: str | tuple[str, ...]


def _columns(c: str | tuple[str, ...]) -> tuple[str, ...]:
    return (c,) if isinstance(c, str) else tuple(c)


def _key(columns: tuple[str, ...]) -> Column:
    """Values joined by bars, those within values escaped, so that unlike keys never look alike."""
    plain = lambda c: F.col(c).cast("string")
    if len(columns) == 1:
        return plain(columns[0])
    return F.concat_ws("|", *[F.regexp_replace(plain(c), r"([\\|])", r"\\$1") for c in columns])


def _whole(columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def run(tables: dict[str, DataFrame], rules: list) -> DataFrame:
    """(rule, key, count): what breaks each rule.  The checks of a table are one pass over it."""
    parts: list[DataFrame] = []
    by_table: dict[str, list[Check]] = {}
    for r in rules:
        if isinstance(r, Check):
            by_table.setdefault(r.table, []).append(r)
        elif isinstance(r, Unique):
            rows = tables[r.table].filter(r.where).filter(_whole(r.columns)).groupBy(*r.columns).agg(F.count("*").alias("count")).filter("count > 1")
            parts.append(rows.select(F.lit(r.rule).alias("rule"), _key(r.columns).alias("key"), "count"))
        else:
            own, other = _columns(r.column), _columns(r.other_column)
            keys = tables[r.other].select(*[F.col(o).alias(c) for c, o in zip(own, other, strict=True)]).distinct()
            rows = tables[r.table].filter(_whole(own)).hint("merge").join(keys.hint("merge"), list(own), "left_anti").groupBy(*own).agg(F.count("*").alias("count"))
            parts.append(rows.select(F.lit(r.rule).alias("rule"), _key(own).alias("key"), "count"))
    for table, checks in by_table.items():
        broken = F.array_compact(F.array(*[F.when(~F.expr(c.condition), F.struct(F.lit(c.rule).alias("rule"), F.expr(c.key).cast("string").alias("key"))) for c in checks]))
        rows = tables[table].select(F.explode(broken).alias("x")).groupBy("x.rule", "x.key").agg(F.count("*").alias("count"))
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)
