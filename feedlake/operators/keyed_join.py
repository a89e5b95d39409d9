"""Joins by keys that may hold nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

#: So many parts rows without a key are dealt to; few, so that the number costs little where rows are moved.
DEALS = 1024


def join_by_key(rows: DataFrame, keyed: DataFrame, key: list[str], how: str) -> DataFrame:
    """rows.join(keyed, key, how) for `left` and `left_anti`. A row with a null in its key meets nothing: it is dealt by its other values,
    where a plain join sends all rows without a key to one task."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    plain = [F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]
    deal = lambda columns: F.pmod(F.hash(*columns), F.lit(DEALS))
    dealt = rows.withColumn("__dealt", F.when(whole, deal(key)).otherwise(deal(plain)))
    return dealt.join(keyed.withColumn("__dealt", deal(key)), [*key, "__dealt"], how).drop("__dealt")
