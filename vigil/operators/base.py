"""What detectors share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns of a detection, in order.
COLUMNS = (
    "threat_class sub_type entity host src dst dst_port proto flow_id event_start event_end confidence evidence factors summary action "
    "mitre model model_version asset_ip related"
).split()


def detections(df: DataFrame, **columns: Column | str | list) -> DataFrame:
    """df's rows as detections; texts are literals, lists are arrays of them, and related is empty unless given."""
    columns.setdefault("related", F.array().cast("array<string>"))
    out = []
    for name in COLUMNS:
        c = columns[name]
        if isinstance(c, list):
            c = F.array(*[x if isinstance(x, Column) else F.lit(x) for x in c])
        out.append((c if isinstance(c, Column) else F.lit(c)).alias(name))
    return df.select(*out)


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def tumbling(ts: Column, size: float) -> Column:
    """Start of the aligned window that holds a time."""
    return F.floor(ts / size) * F.lit(float(size))


def doubled(n: Column, threshold: int) -> Column:
    """Whether a counter that grows by one fires a doubling trigger: at threshold, 2 x threshold, 4 x threshold, ..."""
    return (n % threshold == 0) & (F.bit_count((n / threshold).cast("long")) == 1)


def first_values(df: DataFrame, key: str, value: str, seq: str, most: int, out: str) -> DataFrame:
    """key and the ``most`` earliest distinct values with their first seq, in order; hot keys are pre-aggregated and limited before the shuffle."""
    firsts = df.groupBy(key, value).agg(F.min(seq).alias("_first"))
    nth = F.row_number().over(W.partitionBy(key).orderBy("_first", value))
    few = firsts.withColumn("_nth", nth).filter(F.col("_nth") <= most)
    return few.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("_first").alias("first"), F.col(value).alias("value")))).alias(out))


def anchored(df: DataFrame, keys: list[str], size: float, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """df with the start of its window (column anchor): windows open at a key's first event past the last window's end."""
    from vigil.functions.stats import anchors

    starts = df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(ts).alias("t")))), lambda x: x["t"]).alias("_times"))
    starts = starts.select(*keys, F.explode(anchors(F.col("_times"), size)).alias("anchor"))
    marks = starts.select(*keys, F.col("anchor").alias("_t"), "anchor", F.lit(0).alias("_kind"), F.lit(None).alias("_row"))
    rows = df.select(*keys, F.col(ts).alias("_t"), F.lit(None).cast("double").alias("anchor"), F.lit(1).alias("_kind"), F.struct(*df.columns).alias("_row"))
    along = W.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = marks.unionByName(rows).withColumn("anchor", F.last("anchor", ignorenulls=True).over(along))
    return both.filter("_kind = 1").select("_row.*", "anchor")
