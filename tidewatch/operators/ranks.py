"""Numbers in a total order without a window over one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut, shared_folder


def numbered(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with each row's place in ``order``, from 1.

    Rows are dealt by ranges and sorted within them; a place is that within the range and the number
    of rows in the ranges before, of which there is one row each. Rows alike in ``order`` lie in one
    range, so ``order`` should tell rows apart. What is sorted is written to the shared folder, since
    ranges drawn twice need not be the same.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # an id that counts up within a partition holds the partition's number in its upper bits
    ranges = cut(ranges.withColumn("_at", F.monotonically_increasing_id()), shared_folder(df, "ranks"), "sorted")
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    placed = ranges.join(F.broadcast(before), "_range")  # a row for each range
    return placed.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_range", "_before")


def numbered_within(df: DataFrame, by: list[str], order: list[Column], out: str = "rank", size: str = "size", counted: Column | None = None) -> DataFrame:
    """As ``numbered``, with places from 1 within each group of ``by``, and the group's number of rows (of those with ``counted`` not null).

    No task holds a group: groups lie over as many ranges as they need, and a range passes on two numbers for each
    group in it. Rows alike in ``order`` are told apart by chance, so ties may lie over ranges too; which of them
    comes first isn't said. A null in ``by`` is a group.
    """
    keys = [F.col(c) for c in by]
    dealt = df.withColumn("_any", F.rand(19))
    ranges = dealt.repartitionByRange(*keys, *order, F.col("_any")).sortWithinPartitions(*keys, *order, "_any").drop("_any")
    ranges = cut(ranges.withColumn("_at", F.monotonically_increasing_id()), shared_folder(df, "ranks"), "within").withColumn("_range", F.shiftright("_at", 33))
    parts = ranges.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"), F.count(F.lit(1) if counted is None else counted).alias("_c"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*by)  # over a row for each range and group
    parts = parts.withColumns({"_before": F.sum("_n").over(group.orderBy("_range")) - F.col("_n"), size: F.sum("_c").over(group)})
    there = parts.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(by)), F.col("_range").alias("_r"), "_first", "_before", size)
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return ranges.join(there, same).withColumn(out, F.col("_before") + F.col("_at") - F.col("_first") + 1).select(*df.columns, out, size)


def quantiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by..., n, one column for each of ``shares``): exact quantiles, linear between ranks, by picking ranks; nulls don't count.

    A group without values has n 0 and nulls.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("v_"))
    ranked = numbered_within(rows, by, [F.col("v_").asc_nulls_last()], "r_", "n_", F.col("v_"))
    at = {name: (F.col("n_") - 1) * share for name, share in shares.items()}
    place = F.col("r_") - 1
    picked = ranked.where((place == 0) | F.array_contains(F.array(*(f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil))), place))
    ends = {f"{name}_{k}": F.max(F.when(place == f(x).cast("long"), F.col("v_"))) for name, x in at.items() for k, f in enumerate((F.floor, F.ceil))}
    found = picked.groupBy(*by).agg(F.max("n_").alias("n_"), *(x.alias(f"_{c}") for c, x in ends.items()))
    line = lambda name, x: F.col(f"_{name}_0") + (x - F.floor(x)) * (F.col(f"_{name}_1") - F.col(f"_{name}_0"))
    return found.select(*by, F.col("n_").alias("n"), *(line(name, x).alias(name) for name, x in at.items()))
