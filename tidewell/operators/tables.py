"""Changes to keyed tables as joins: append, upsert, delete, trim and what has changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


class KeyConflict(ValueError):
    """An append brought a key that the table holds."""


def append(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Both; raises ``KeyConflict`` if a key is there already or comes twice."""
    if key:
        twice = rows.groupBy(*key).count().where("count > 1")
        if not rows.join(table.select(*key), list(key), "left_semi").isEmpty() or not twice.isEmpty():
            raise KeyConflict(f"a row to append has a {'/'.join(key)} that the table holds already")
    return table.unionByName(rows, allowMissingColumns=True)


def key_conflicts(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose key the table holds."""
    return rows.join(table.select(*key), list(key), "left_semi")


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows by key: new ones are added; of known ones only the columns that ``rows`` names change, nulls included.

    Null keys are equal. Raises ``KeyConflict`` if a key comes twice in ``rows``.
    """
    if not rows.groupBy(*key).count().where("count > 1").isEmpty():
        raise KeyConflict(f"two rows to write have the same {'/'.join(key)}")
    named = [c for c in rows.columns if c not in key]
    new = rows.select(*(F.col(c).alias(f"__new_{c}") for c in rows.columns), F.lit(True).alias("__is_new"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__new_{c}"))
    j = table.withColumn("__is_old", F.lit(True)).join(new, same, "full_outer")
    cols = [*table.columns, *(c for c in named if c not in table.columns)]

    def pick(c: str) -> Column:
        if c in key:
            return F.when(F.col("__is_old"), F.col(c)).otherwise(F.col(f"__new_{c}")).alias(c)
        kept = F.col(c) if c in table.columns else F.lit(None)
        return (F.when(F.col("__is_new"), F.col(f"__new_{c}")).otherwise(kept) if c in named else kept).alias(c)

    return j.select(*map(pick, cols))


def delete(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*key), list(key), "left_anti")


def trim(table: DataFrame, column: str, bound: Column) -> DataFrame:
    """Without rows older than the bound; rows without a time stay."""
    return table.where(F.col(column).isNull() | (F.col(column) >= bound))


def changes(base: DataFrame, current: DataFrame, key: Sequence[str]) -> DataFrame:
    """What turns ``base`` into ``current``: the rows with ``change`` insert, update or delete (with base's values)."""
    cols = [c for c in current.columns if c not in key]
    b = base.select(*key, F.struct(*cols).alias("__b"))
    c = current.select(*key, F.struct(*cols).alias("__c"))
    j = b.join(c, list(key), "full_outer").where(~F.col("__b").eqNullSafe(F.col("__c")))
    change = F.when(F.col("__b").isNull(), "insert").when(F.col("__c").isNull(), "delete").otherwise("update")
    row = F.coalesce("__c", "__b")
    return j.select(change.alias("change"), *key, *(row[n].alias(n) for n in cols))


def difference(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, change`` (new, gone, changed, same) and the columns of both sides, for reports before anything is written."""
    j = old.select(key, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(True).alias("__o")).join(new.select(key, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("__n")), key, "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "gone").when(same, "same").otherwise("changed")
    return j.withColumn("change", change).drop("__o", "__n")


def value_changes(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """``key, field, before, after`` of the keys on both sides whose value differs; absent counts as a value."""
    j = old.select(key, F.col(column).cast("string").alias("before")).join(new.select(key, F.col(column).cast("string").alias("after")), key)
    return j.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, F.lit(column).alias("field"), "before", "after")


def first_occurrences(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in order, as an aggregation and not a sort of each group."""
    cols = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in cols))
