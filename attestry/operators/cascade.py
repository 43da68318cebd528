"""Deletion that follows declared keys between tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """Rows of `child` hang on the rows of `parent` that their column names."""

    child: str
    column: str
    parent: str
    parent_column: str


def in_order(root: str, keys: list[Key]) -> list[str]:
    """The tables that hang on root, each after all of its parents among them; a cycle is an error."""
    reached, grown = {root}, True
    while grown:
        more = {k.child for k in keys if k.parent in reached} - reached
        reached, grown = reached | more, bool(more)
    order: list[str] = []
    while len(order) < len(reached):
        ready = sorted(t for t in reached - set(order) if t == root or all(k.parent in order for k in keys if k.child == t and k.parent in reached))
        if not ready:
            raise ValueError(f"keys go round: {sorted(reached - set(order))}")
        order += ready
    return order


def deleted(tables: dict[str, DataFrame], keys: list[Key], root: str, doomed: DataFrame, busy: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of root that doomed names by its one column, and all that hangs on them; (name, deleted, kept).

    A row goes if any of its keys names a row that goes; a null key names none. All tables keep their columns; tables that
    don't hang on root are returned as they are and not counted. Rows of busy(its one column like doomed's) refuse the
    deletion of what they name: an error, and nothing is deleted. Each step is a semi and an anti join by a key, so tables are
    read once for each of their keys and large ones are never collected.
    """
    if busy is not None and not busy.join(doomed.toDF(busy.columns[0]), busy.columns[0], "left_semi").isEmpty():
        raise ValueError(f"rows of {root} are in use")
    kept, gone = dict(tables), {}
    for name in in_order(root, keys):
        rows = tables[name]
        ends = [(doomed.columns[0], doomed)] if name == root else [(k.column, gone[k.parent].select(F.col(k.parent_column).alias(k.column))) for k in keys if k.child == name and k.parent in gone]
        named = [(column, ids.where(F.col(column).isNotNull()).distinct()) for column, ids in ends]
        parts, left = [], rows
        for column, ids in named:
            parts.append(left.join(ids, column, "left_semi").select(rows.columns))
            left = left.join(ids, column, "left_anti").select(rows.columns)
        gone[name], kept[name] = reduce(DataFrame.unionByName, parts), left
    counts = [gone[name].agg(F.count("*").alias("deleted")).crossJoin(kept[name].agg(F.count("*").alias("kept"))).select(F.lit(name).alias("name"), "deleted", "kept") for name in gone]
    return kept, reduce(DataFrame.unionByName, counts)
