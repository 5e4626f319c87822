"""Whole orders without one task for all rows: ranges are ordered in parallel, and only a number for each range is brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.lineage import cut

RANGE = "_range"


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt to as many ranges of the order as there are shuffle partitions, with the range's number, computed once."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()))


def numbered_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the number of each row in the order, from 1."""
    held = in_ranges(df, order)
    before = W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    counts = held.groupBy(RANGE).agg(F.count("*").alias("_n")).select(RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy(RANGE).orderBy(*order)) + F.col("_before")
    return held.join(F.broadcast(counts), RANGE).withColumn(name, nth).drop(RANGE, "_before")


def with_previous(df: DataFrame, order: list[str], column: str, name: str, first: Column) -> DataFrame:
    """df with the column's value in the row before, ``first`` in the first one."""
    held = in_ranges(df, order)
    ends = held.groupBy(RANGE).agg(F.max_by(column, F.struct(*order)).alias("_end"))
    ends = ends.select((F.lead(RANGE).over(W.orderBy(RANGE))).alias(RANGE), "_end")  # a row for each range that holds any
    own = F.lag(column).over(W.partitionBy(RANGE).orderBy(*order))
    return held.join(F.broadcast(ends), RANGE, "left").withColumn(name, F.coalesce(own, "_end", first)).drop(RANGE, "_end")


def value_at_rank(df: DataFrame, column: str, rank: int):
    """The value at a rank from 1 of a column in ascending order; None past the ends. Only the range that holds the rank is sorted."""
    held = in_ranges(df.select(column), [column])
    for r in held.groupBy(RANGE).count().orderBy(RANGE).collect():
        if 1 <= rank <= r["count"]:
            return held.filter(F.col(RANGE) == r[RANGE]).orderBy(column).offset(rank - 1).limit(1).first()[0]
        rank -= r["count"]
    return None


def nearest_ranks(df: DataFrame, key: str, value: str, names: dict[str, float], width: float) -> DataFrame:
    """key and a column for each quantile: the value at index int(q n), from 0 and at most n - 1, of the key's sorted values.

    Exact without gathering a key: counts by value ranges of ``width`` find the range of a rank, then only
    that range's distinct values are ordered.
    """
    per = df.groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("v") / width))
    ranges = per.groupBy("k", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.withColumn("upto", F.sum("n").over(W.partitionBy("k").orderBy("range"))).withColumn("total", F.sum("n").over(W.partitionBy("k")))
    wanted = ranges.select("*", F.explode(F.array(*[F.lit(float(q)) for q in names.values()])).alias("q")).withColumn("rank", F.least("total", F.floor(F.col("total") * F.col("q")) + 1))
    wanted = wanted.filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select("k", "range", "q", "rank", (F.col("upto") - F.col("n")).alias("before"))
    inside = per.join(wanted, ["k", "range"])
    inside = inside.withColumn("at", F.col("before") + F.sum("n").over(W.partitionBy("k", "q").orderBy("v"))).filter(F.col("at") >= F.col("rank"))
    found = inside.groupBy("k", "q").agg(F.min("v").alias("v"))
    return found.groupBy(F.col("k").alias(key)).agg(*[F.max(F.when(F.col("q") == float(q), F.col("v"))).alias(n) for n, q in names.items()])
