"""numbers as identities.

A dictionary is a stored table ``(key columns, id)`` that gives every key one
number, once. :func:`extend` adds the keys that it lacks (a null-safe anti
join) and numbers them by ranges (each task sorts its own key range, the counts
of the ranges before it are added), from the last number on. So no hash
stands for a row: two keys never share a number, and a repeated run finds the numbers
that its failed attempt gave. Each extension is a flush of :mod:`leadspark.sources.sinks`,
named by its first number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sinks as K
from .grouping import row_number_per_group


def numbered(df: DataFrame, order: list[str], after: int, name: str) -> DataFrame:
    """Rows with the numbers ``after + 1, after + 2, ...`` in the order of
    ``order``; ties are numbered in any order. Computed once (checkpointed)."""
    return row_number_per_group(df, [], order, name).withColumn(name, F.col(name) + F.lit(after).cast("bigint"))


def same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    """Null-safe equality of the key columns."""
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in key])


def extend(keys: DataFrame, root: str, table: str, key: list[str], name: str = "id",
           floor: Callable[[], int] = lambda: 0, where: Column | None = None) -> DataFrame:
    """The dictionary ``table`` of the store at ``root`` with a number for each
    of ``keys``; ``(key columns, name)``. ``floor`` is asked once, for the last number in
    use before the dictionary was there. ``where`` is a condition that all ``keys``
    meet (a day, say): only that part of the dictionary is read and returned."""
    spark = keys.sparkSession

    def there() -> DataFrame | None:
        d = K.stored(spark, root, table)
        return d if d is None or where is None else d.filter(where)

    new, have = keys.select(*key).distinct(), there()
    if have is not None:
        new = new.join(have.select(*key).alias("have"), same(new, have, key), "left_anti")
    last = K.last_id(spark, root, table)
    last = floor() if last is None else last
    found = numbered(new, key, last, name).select(*key, name)
    n = found.count()  # of the checkpointed rows
    if n:
        K.flush(spark, root, f"{table}-{last + 1}", {table: found}, counter=table, last=last + n)
    return found if have is None else there().select(*key, name)


def attach(df: DataFrame, ids: DataFrame, key: list[str], name: str = "id") -> DataFrame:
    """Rows of ``df`` with their number."""
    return df.join(ids, same(df, ids, key), "left").select(*[df[c] for c in df.columns], ids[name])
