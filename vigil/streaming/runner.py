"""Streaming runs: micro-batches of events through the batch detectors into the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.lineage import cut
from vigil.operators.registry import Context, detect
from vigil.plans.fusion import fuse
from vigil.plans.ledger import Ledger


def replay(spark: SparkSession, folder: str, kind: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files (Parquet), a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{kind}")


def alert_stream(stream: DataFrame, kind: str, ledger: str, checkpoint: str, history: str, context: Context | None = None, keep_s: float | None = 900.0, on_alerts: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Alerts of a stream of one kind of events, written to a hash-chained ledger.

    A batch is looked at together with the events of the last ``keep_s`` seconds, which are
    kept as tables in ``history``; alerts already in the ledger are left out by a join with the table of
    their keys beside it, and a batch that comes again is written once. Baselines, first contacts and
    beacons see what ``keep_s`` holds: give None to look at the whole history, as a batch run does.
    ``trigger`` says when batches begin, as writeStream.trigger does; by default the stream ends with its input.
    """
    trigger = trigger or {"availableNow": True}

    def batch(new: DataFrame, n: int) -> None:
        spark = new.sparkSession
        ts = "last_ts" if kind == "flows" else "ts"
        new.write.mode("overwrite").parquet(f"{history}/batch={n}")
        newest = spark.read.parquet(f"{history}/batch={n}").agg(F.max(ts)).first()[0]
        if newest is None:
            return
        every = spark.read.option("basePath", history).parquet(history)
        every = every if keep_s is None else every.filter(F.col(ts) > newest - keep_s)  # files' own bounds leave old ones out
        alerts = fuse(detect({kind: every.select(*new.columns)}, context))
        book = Ledger(ledger)
        # Keys of earlier batches; a batch that comes again finds its own left out of them.
        spark.range(0).select(F.col("id").cast("string").alias("alert_key")).write.mode("ignore").parquet(f"{history}-told/batch=-1")
        told = spark.read.schema("alert_key string, batch int").option("basePath", f"{history}-told").parquet(f"{history}-told").filter(F.col("batch") < n)
        fresh = cut(alerts.join(told, "alert_key", "left_anti"))
        fresh.select("alert_key").write.mode("overwrite").parquet(f"{history}-told/batch={n}")
        book.write(fresh.select("alert_key", "threat_class", "sub_type", "entity", "event_start", "event_end", "confidence", "severity", "summary"), ["event_end", "alert_key"], batch=n)
        if on_alerts:
            on_alerts(fresh, n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()

