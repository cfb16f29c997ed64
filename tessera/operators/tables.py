"""Whole-table rewrites that stand for updates: upsert, cascade, exactly-one flags, renamed keys, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new")))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], root: str, gone: Column) -> dict[str, DataFrame]:
    """Delete rows of ``root`` and, along (child, child column, parent, parent column) links, what hangs on them."""
    removed = {root: tables[root].where(gone)}
    kept = dict(tables) | {root: tables[root].where(~F.coalesce(gone, F.lit(False)))}
    for child, column, parent, target in links:
        lost = removed[parent].select(F.col(target).alias("_gone")).distinct()
        removed[child] = tables[child].join(lost, tables[child][column] == lost["_gone"], "left_semi")
        kept[child] = tables[child].join(lost, tables[child][column] == lost["_gone"], "left_anti")
    return kept


def exactly_one(rows: DataFrame, group: str, key: str, flag: str, chosen: Column) -> DataFrame:
    """``flag`` is true for the chosen row of each group that has one, and unchanged in other groups."""
    there = F.max(F.when(chosen, 1).otherwise(0)).over(Window.partitionBy(group))
    return rows.withColumn(flag, F.when(there == 1, chosen).otherwise(F.col(flag)))


#: Fixed value: the JSON field that holds a key.
KEY_FIELD = "standardSection"


def rename_keys(rows: DataFrame, names: dict[str, str], columns: list[str], json: list[str] = (), comments: list[str] = ()) -> DataFrame:
    """Renamed keys, one after the other: in ``columns`` where they are the whole value, in ``json`` texts as the value of
    ``KEY_FIELD`` (with or without a space behind the colon), in ``comments`` wherever they stand."""
    new = {c: F.col(c) for c in (*columns, *json, *comments)}
    for old, name in names.items():
        for c in columns:
            new[c] = F.when(new[c] == old, F.lit(name)).otherwise(new[c])
        for c in json:
            for gap in ("", " "):
                new[c] = F.replace(new[c], *(F.lit(f'"{KEY_FIELD}":{gap}"{k}"') for k in (old, name)))
        for c in comments:
            new[c] = F.replace(new[c], F.lit(old), F.lit(name))
    return rows.withColumns(new)


def rename_counts(rows: DataFrame, names: dict[str, str], columns: list[str], json: list[str] = (), comments: list[str] = ()) -> DataFrame:
    """A dry run of ``rename_keys``: by field and old key, the rows that mention it (``json`` only as a value of ``KEY_FIELD``)."""
    tests = [(c, old, F.contains(F.col(c), F.lit(old))) for old in names for c in (*columns, *comments)]
    tests += [(c, old, F.contains(F.col(c), F.lit(f'"{KEY_FIELD}":"{old}"')) | F.contains(F.col(c), F.lit(f'"{KEY_FIELD}": "{old}"'))) for old in names for c in json]
    counted = rows.agg(*(F.count_if(test).alias(f"n{i}") for i, (_, _, test) in enumerate(tests)))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.lit(old).alias("old_key"), F.col(f"n{i}").alias("n")) for i, (c, old, _) in enumerate(tests)))))


def broken_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def for_tenant(rows: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant: those of others don't exist for it."""
    return rows.where(F.col(column) == tenant)


def matching(rows: DataFrame, equal: dict[str, object], contains: dict[str, str] | None = None, same_letters: dict[str, str] | None = None) -> DataFrame:
    """Rows that meet all given conditions: equal values, a contained text, or a text equal but for case.  A condition
    of None isn't asked for."""
    for name, value in equal.items():
        rows = rows if value is None else rows.where(F.col(name) == F.lit(value))
    for name, value in (contains or {}).items():
        rows = rows if value is None else rows.where(F.contains(F.col(name), F.lit(value)))
    for name, value in (same_letters or {}).items():
        rows = rows if value is None else rows.where(F.lower(name) == F.lower(F.lit(value)))
    return rows


def next_order(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """The order that a row appended to each group gets."""
    return rows.groupBy(*group).agg((F.max(order) + 1).alias("next_order"))


def with_counts(parents: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """Parents with how many rows of each child table (table, column) hang on them."""
    for name, (rows, column) in children.items():
        counts = rows.groupBy(F.col(column).alias(key)).agg(F.count("*").alias(name))
        parents = parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parents


def backfilled(rows: DataFrame, source: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows whose ``column`` is null take it from the row of ``source`` with the same keys."""
    found = source.select(*keys, F.col(column).alias("_found"))
    return rows.join(found, keys, "left").withColumn(column, F.coalesce(column, "_found")).drop("_found")
