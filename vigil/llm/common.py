"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset and everything runs in one process is one made here; a
    cluster without the setting is an error, as its executors would not see a folder of the driver's.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        named = Path(tempfile.gettempdir(), f"vigil-shared-{os.getpid()}").as_uri()
        spark.conf.set("spark.checkpoint.dir", named) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Bound the bytes of an Arrow batch for this session, so that workers' memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


#: Folders of intermediate tables that this process has made and not deleted.
_MADE: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place for an intermediate table in the shared folder, until sweep() deletes it."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """df as a Parquet table in the shared folder; its known size lets Spark broadcast it only where it is small."""
    where = new_folder(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def made() -> frozenset[str]:
    """The folders of intermediate tables made so far."""
    return frozenset(_MADE)


def sweep(keep: DataFrame, before: frozenset[str]) -> None:
    """Delete the intermediate tables made since ``before`` but for those that ``keep`` reads; nothing else may read them any more."""
    spark, held = keep.sparkSession, keep.inputFiles()
    for where in [w for w in _MADE if w not in before and not any(f"/{w.rsplit('/', 1)[-1]}/" in f for f in held)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.remove(where)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of what is done; its cleaner acts when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key is hot if it holds more than one in so many rows, so there are fewer hot keys than this; but never with so few rows.
HOT_SHARE, COOL_ROWS = 2_000, 256


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows_of: str, total: int, spread: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which has a row for each key; only hot keys are salted.

    ``rows_of`` is right's column with the number of left's rows of a key, ``total`` the number of all of
    left's rows. There are fewer than HOT_SHARE hot keys whatever the size of the data, so their
    numbers of salts are broadcast, and right grows by less than twice HOT_SHARE rows. Left's rows of a hot key are dealt by a
    hash of the columns ``spread``. Keys must not be null.
    """
    salts, salt = unused(left, "_salts"), unused(left, "_salt")
    part = max(COOL_ROWS, total / HOT_SHARE)
    hot = F.broadcast(right.filter(F.col(rows_of) > part).select(*keys, F.ceil(F.col(rows_of) / part).cast("int").alias(salts)))
    kinds = dict(left.dtypes)
    by = F.xxhash64(*[c for c in spread if "map<" not in kinds[c] and "variant" not in kinds[c]])
    dealt = left.join(hot, keys, "left").withColumn(salt, F.pmod(by, F.coalesce(salts, F.lit(1))).cast("int")).drop(salts)
    copied = right.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
    return dealt.join(copied, [*keys, salt], how).drop(salt)


#: Bytes on disk up to which a table of stored() may be broadcast.
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A table of stored(), marked for broadcast only if its files hold at most ``most`` bytes."""
    held = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if held <= most else df


def unused(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Give freed memory back to the system after each batch, as workers are kept for later stages."""

    @functools.wraps(run)
    def wrapped(batches):
        for out in run(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped
