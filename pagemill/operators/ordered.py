"""Ordered operators over a book's rows without one task per book.

A book may hold any share of all rows, so nothing here sorts a whole book in one task. Rows are cut into stretches of
neighbouring pages; a window runs within each stretch, and what a stretch must know of the earlier ones comes from one
summary row a stretch, over which a second, small window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pages in a stretch.
STRETCH = 256
_S = "_stretch"


def stretched(rows: DataFrame, page: str = "page", size: int = STRETCH) -> DataFrame:
    return rows.withColumn(_S, F.floor(F.coalesce(F.col(page), F.lit(0)) / size).cast("int"))


def running_sums(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column], page: str = "page", size: int = STRETCH) -> DataFrame:
    """``rows`` with, per new column, the sum of its expression over the key's rows up to and including this one."""
    rows = stretched(rows, page, size).withColumns({f"_v_{c}": e for c, e in sums.items()})
    total = rows.groupBy(key, _S).agg(*(F.sum(f"_v_{c}").alias(f"_t_{c}") for c in sums))
    before = Window.partitionBy(key).orderBy(_S).rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(key, _S, *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums))
    own = Window.partitionBy(key, _S).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_w_{c}": F.sum(f"_v_{c}").over(own) for c in sums}).join(base, [key, _S])
    out = out.withColumns({c: F.col(f"_w_{c}") + F.col(f"_b_{c}") for c in sums})
    return out.drop(_S, *(f"_{p}_{c}" for p in "vwb" for c in sums))


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "n", page: str = "page", size: int = STRETCH) -> DataFrame:
    """``rows`` numbered 1, 2, ... within the key."""
    return running_sums(rows, key, order, {name: F.lit(1)}, page, size)


def with_previous(rows: DataFrame, key: str, order: list[str], value: Column, name: str, page: str = "page", size: int = STRETCH) -> DataFrame:
    """``rows`` with the value of the row before, across stretches; null on a key's first row."""
    rows = stretched(rows, page, size).withColumn("_v", value)
    own = Window.partitionBy(key, _S).orderBy(*order)
    last = rows.groupBy(key, _S).agg(F.max_by(F.struct(F.col("_v").alias("v")), F.struct(*order)).alias("_l"))
    prev = last.select(key, _S, F.lag("_l").over(Window.partitionBy(key).orderBy(_S))["v"].alias("_p"))
    out = rows.withColumns({"_w": F.lag("_v").over(own), "_r": F.row_number().over(own)}).join(prev, [key, _S])
    return out.withColumn(name, F.when(F.col("_r") == 1, F.col("_p")).otherwise(F.col("_w"))).drop(_S, "_v", "_w", "_r", "_p")


def running_max(rows: DataFrame, key: str, ord_: str, values: dict, page: str = "page", size: int = STRETCH) -> DataFrame:
    """``rows`` with ``last_<name>``: the largest value of each expression over the key's earlier rows."""
    rows = stretched(rows, page, size)
    last = rows.groupBy(key, _S).agg(*(F.max(e).alias(f"_m{i}") for i, e in values.items()))
    before = Window.partitionBy(key).orderBy(_S).rowsBetween(Window.unboundedPreceding, -1)
    base = last.select(key, _S, *(F.max(f"_m{i}").over(before).alias(f"_b{i}") for i in values))
    own = Window.partitionBy(key, _S).orderBy(ord_).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_o{i}": F.max(e).over(own) for i, e in values.items()}).join(base, [key, _S])
    return out.withColumns({f"last_{i}": F.greatest(f"_o{i}", f"_b{i}") for i in values}).drop(_S, *(f"_{p}{i}" for p in "ob" for i in values))


def nearest_smaller(rows: DataFrame, key: str, ord_: str, level: str, levels: int, name: str = "parent", page: str = "page", size: int = STRETCH) -> DataFrame:
    """``rows`` with the ``ord_`` of the nearest earlier row of a smaller level (1..levels); null at the top."""
    seen = {i: F.when(F.col(level) == i, F.col(ord_)) for i in range(1, levels)}
    out = running_max(rows, key, ord_, seen, page, size)
    none = F.lit(None).cast(dict(rows.dtypes)[ord_])
    found = F.greatest(none, none, *(F.when(F.col(level) > i, F.col(f"last_{i}")) for i in seen))
    return out.withColumn(name, found).drop(*(f"last_{i}" for i in seen))


def numbered_by(rows: DataFrame, key: str, order: list[str], stretch: Column, name: str) -> DataFrame:
    """``rows`` numbered 1, 2, ... within the key by ``order``. ``stretch`` cuts a key's rows into stretches whose own order
    is that of ``order``: a window runs inside each, and a second one over their sizes."""
    rows = rows.withColumn(_S, stretch)
    sizes = rows.groupBy(key, _S).agg(F.count("*").alias("_t"))
    before = Window.partitionBy(key).orderBy(_S).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(key, _S, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    out = rows.withColumn("_w", F.row_number().over(Window.partitionBy(key, _S).orderBy(*order))).join(base, [key, _S])
    return out.withColumn(name, F.col("_w") + F.col("_b")).drop(_S, "_w", "_b")
