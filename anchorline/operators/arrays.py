"""Arrays rebuilt in order after joins, and set predicates on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(position: Column | str, value: Column) -> Column:
    """Aggregate: the values of a group as an array in the order of position."""
    p = F.col(position) if isinstance(position, str) else position
    return F.transform(F.array_sort(F.collect_list(F.struct(p.alias("p"), value.alias("v")))), lambda x: x["v"])


def lookup_list(df: DataFrame, keys: list[str], items: str, table: DataFrame, key: str, value: str, distinct: bool = False) -> DataFrame:
    """Replace each member of an array column by its value in table, dropping unknown members; order stays, repeats too unless distinct.

    table has unique keys. Rows whose array is null, empty or wholly unknown are left out.
    """
    rows = df.select(*keys, F.posexplode(items).alias("pos", "__item"))
    found = rows.join(table.select(F.col(key).alias("__item"), F.col(value).alias("__value")), "__item")
    if distinct:
        found = found.groupBy(*keys, "__value").agg(F.min("pos").alias("pos"))
    return found.groupBy(*keys).agg(in_order("pos", F.col("__value")).alias(items))


def have_repeat(names: Column) -> Column:
    """Whether two members are equal, nulls and empty texts aside."""
    known = F.filter(names, lambda x: F.coalesce(F.length(x) > 0, F.lit(False)))
    return F.size(known) != F.size(F.array_distinct(known))


def ordered_union(*arrays: Column) -> Column:
    """The members of the arrays in order, each at its first place; a null array counts as empty."""
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))
