"""Mixing sources to target weights by a low-discrepancy source schedule (DataFrame functions only).

Slot i of the schedule is the golden-ratio point ``i * F45 mod F46`` (neighbouring
Fibonacci numbers); the source whose stretch of the cumulative targets holds the point
gets the slot. A source's slots are ranked; its documents, shuffled by a keyed hash, are
one stream of words cut into blocks of ``block_words``; the slot of rank k takes block
``k mod blocks`` in pass ``k div blocks``, until the source's target is met. The last slot
of a source is trimmed to its target; where rounding of blocks leaves a source short of
slots, make-up slots follow after the last one of the lattice, the sources taking turns.

Nothing is gathered by source in one task: documents are summed by (source, bucket of
the shuffle hash) first, slots by (source, stretch of the schedule), and both sums, like the sources
themselves, run on in order by ranges. Buckets and cells grow in number with the data, not in size.

Nulls: a null text has no words; a null source is a source of its own, ordered last; a
null id is kept. Documents without words take nothing. Repeated rows count as separate
documents. With no words at all every target is 0. Other columns of the input are not
looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm.common import cut, small_side, stored, unused, word_count

#: Golden-ratio lattice: the 46th and 45th Fibonacci numbers.
PERIOD, STEP = 1_836_311_903, 1_134_903_170
#: Slots in a stretch of the schedule and, about, in a cell of the lattice; documents in a bucket, about.
STRETCH = 4_096
LEAST_CELLS = 65_536


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with exclusive running sums (new name -> summed column) over the whole order, in parallel by ranges."""
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = cut(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = held.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    offsets = offsets.select("_range", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = held.join(offsets, "_range")
    return out.select(*df.columns, *[(F.col(f"_off_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()])


@dataclass
class Mix:
    """What the mixing makes: sizes and targets, the schedule, and which words of which document each slot takes."""

    documents: DataFrame  # key, id columns, size, bucket, at (place in the shuffled stream of its source), row
    sources: DataFrame  # key, nth (in order), source_size, target, take (whole words)
    schedule: DataFrame  # slot, key, rank, pass, block, from_word, to_word (of the source's stream)
    placements: DataFrame  # a row for each part of a document in a slot, with null slots for what isn't taken


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sizes (key, source_size) with weight and target: shares of all sizes by weight, capped at most times a source's size."""
    ranked = running(sizes.withColumn("_one", F.lit(1).cast("long")), ["key"], {"nth": "_one"}).drop("_one")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("nth") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = cut(running(ranked, ["ratio", "key"], {"caps": "cap", "weights": "weight"}))
    whole = filled.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    n, w = whole.n or 0, whole.w or 1
    level = (F.lit(n) - F.col("caps")) / (F.lit(w) - F.col("weights"))
    # Sources in order of cap by weight: the first that the level of the rest leaves below its cap fixes the level.
    found = filled.filter(level <= F.col("ratio")).agg(F.min_by(level, F.struct("ratio", "key")).alias("level")).first().level
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(found or 0.0)))
    return filled.select("key", "nth", "source_size", target.alias("target")).withColumn(
        "take", F.least(F.round("target").cast("long"), F.col("source_size") * most)
    )


def within(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """df with exclusive running sums within each key, along a column, in parallel by ranges of (key, order)."""
    ran = cut(running(df, ["key", order], sums))
    starts = ran.groupBy("key").agg(*[F.min(n).alias(f"_start_{n}") for n in sums])
    return ran.join(starts, "key").select(*df.columns, *[(F.col(n) - F.col(f"_start_{n}")).alias(n) for n in sums])


def _schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """slot, key, rank: golden-ratio points mapped through the cumulative targets and ranked by source."""
    placed = cut(running(sources.filter("take > 0"), ["key"], {"before": "take"}))
    total = placed.agg(F.sum("take").alias("n")).first().n or 0
    slots = -(-total // block_words)
    width = PERIOD // max(LEAST_CELLS, slots // STRETCH) + 1
    spot = lambda c: F.floor(c.cast("double") / F.lit(float(max(1, total))) * PERIOD).cast("long")
    placed = placed.withColumn("lo", spot(F.col("before"))).withColumn("hi", spot(F.col("before") + F.col("take")))
    cell = lambda c: F.expr(f"{c} div {width}L")
    own = placed.select(cell("lo").alias("cell"), F.col("lo").alias("x"), "key")
    carried = placed.select("key", F.explode(F.expr(f"CASE WHEN (hi - 1) div {width}L > lo div {width}L THEN sequence(lo div {width}L + 1, (hi - 1) div {width}L) ELSE array() END")).alias("cell"))
    marks = own.unionByName(carried.withColumn("x", F.col("cell") * width)).select("cell", "x", "key", F.lit(None).cast("long").alias("slot"))
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), F.expr(f"(id % {PERIOD}L) * {STEP}L % {PERIOD}L").alias("x"))
    points = points.select(cell("x").alias("cell"), "x", F.lit(None).cast("string").alias("key"), "slot")
    along = W.partitionBy("cell").orderBy("x", F.col("slot").asc_nulls_first(), "key")
    hit = marks.unionByName(points).withColumn("key", F.last("key", ignorenulls=True).over(along)).filter("slot IS NOT NULL")
    hit = cut(hit.select("slot", "key", F.expr(f"slot div {STRETCH}L").alias("stretch")))
    counts = cut(within(hit.groupBy("key", "stretch").agg(F.count("*").alias("n")), "stretch", {"off": "n"}))
    nth = F.row_number().over(W.partitionBy("key", "stretch").orderBy("slot")) - 1
    ranked = hit.withColumn("_nth", nth).join(counts, ["key", "stretch"]).select("slot", "key", (F.col("off") + F.col("_nth")).alias("rank"))

    # What a source needs, in ranks: full passes over its blocks, then blocks up to the rest of its target.
    have = counts.groupBy("key").agg(F.sum("n").alias("have"))
    need = placed.select("key", "nth", "source_size", "take").withColumn("blocks", F.expr(f"(source_size + {block_words - 1}L) div {block_words}L"))
    need = need.withColumn("passes", F.expr("take div source_size")).withColumn("rest", F.expr("take % source_size"))
    need = need.withColumn("ranks", F.col("passes") * F.col("blocks") + F.expr(f"(rest + {block_words - 1}L) div {block_words}L"))
    need = stored(need.join(have, "key", "left").withColumn("have", F.coalesce("have", F.lit(0))))
    n_sources = sources.agg(F.max("nth").alias("n")).first().n or 0
    extra = need.filter("have < ranks").select("key", "nth", "have", F.explode(F.expr("sequence(have, ranks - 1)")).alias("rank"))
    extra = extra.select((slots + (F.col("rank") - F.col("have")) * (n_sources + 1) + F.col("nth")).alias("slot"), "key", "rank")
    got = ranked.unionByName(extra).join(small_side(need.drop("nth", "have")), "key").filter("rank < ranks")
    got = got.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    end = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest"))
    return got.select("slot", "key", "rank", "pass", "block", (F.col("block") * block_words).alias("from_word"), F.least((F.col("block") + 1) * block_words, end).alias("to_word"))


def shuffle_key(id_col: str, text: str, seed: int) -> F.Column:
    """What a row's place in its source's stream depends on: its id and text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 4096, seed: int = 7) -> Mix:
    """Plan a mix of all of df's words to weights by source; see the module's notes.

    ``most`` bounds how often a document repeats. The result's ``documents`` carries the id
    column as ``id`` whatever its name is.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))
    shuffle = shuffle_key(id_col, text, seed)
    rows = cut(df.select(key.alias("key"), F.col(id_col).alias("id"), word_count(text).alias("size"), shuffle.alias("shuffle")))
    digits = max(3, math.ceil(math.log(max(1, rows.count() / STRETCH), 16)))
    rows = rows.withColumn("bucket", F.substring("shuffle", 1, digits))
    buckets = cut(rows.groupBy("key", "bucket").agg(F.sum("size").alias("words")))
    sources = cut(targets(buckets.groupBy("key").agg(F.sum("words").alias("source_size")), weights, most))

    offsets = within(buckets, "bucket", {"off": "words"}).join(small_side(stored(sources)).drop("nth"), "key").drop("words")
    inside = W.partitionBy("key", "bucket").orderBy("shuffle", "id")
    docs = rows.withColumn("row", F.row_number().over(inside)).withColumn("inner", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    docs = docs.join(offsets, ["key", "bucket"]).withColumn("at", F.col("off") + F.col("inner")).drop("off", "inner")

    schedule = _schedule(sources, block_words)
    span = f"sequence(at div {block_words}L, (at + size - 1) div {block_words}L)"
    none = "array(-1L - conv(bucket, 16, 10))"  # no block; spread over the buckets
    parts = docs.withColumn("block", F.explode(F.expr(f"CASE WHEN size > 0 THEN {span} ELSE {none} END")))
    placed = parts.join(schedule.drop("rank"), ["key", "block"], "left")
    words = F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), F.col("to_word")) - F.greatest("at", "from_word"))
    return Mix(docs, sources, schedule, placed.withColumn("words", F.when(F.col("slot").isNull(), F.lit(0)).otherwise(words)))


def taken(plan: Mix) -> DataFrame:
    """A row for each row of the input: id, size, source (null for the null source), source_size, target, taken, and its slots.

    ``first_slot`` is the first slot of the schedule that takes words of the row (null if none does), ``n_slots`` how many do.
    """
    held = ["key", "bucket", "row", "id", "size", "source_size", "target"]
    used = F.when(F.col("words") > 0, F.col("slot"))
    got = plan.placements.groupBy(*held).agg(F.sum("words").cast("long").alias("taken"), F.min(used).alias("first_slot"), F.count(used).alias("n_slots"))
    return got.select("id", "size", F.expr("CASE WHEN key <> '1' THEN substring(key, 2) END").alias("source"), "source_size", "target", "taken", "first_slot", "n_slots")


def repeated(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **how) -> DataFrame:
    """df's rows as often as the mix takes them, in whole documents.

    A row is given as often as its taken words fill it, to the nearest whole number; so rows that the mix
    does not take are left out. Rows that repeat id and text share what they take evenly.
    """
    plan = mix(df, id_col, text, source, seed=seed, **how)
    key, times, nth = unused(df, "_key"), unused(df, "_times"), unused(df, "_nth")
    got = plan.placements.groupBy("shuffle", "key", "bucket", "row", "size").agg(F.sum("words").alias("taken")).filter("size > 0 AND taken > 0")
    every = plan.documents.groupBy("shuffle").agg(F.count("*").alias("rows"))
    got = got.groupBy("shuffle").agg(F.sum(F.col("taken") / F.col("size")).alias("times")).join(every, "shuffle")
    got = got.select(F.col("shuffle").alias(key), F.round(F.col("times") / F.col("rows")).cast("int").alias(times)).filter(F.col(times) > 0)
    marked = df.withColumn(key, shuffle_key(id_col, text, seed)).join(got, key)
    return marked.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*df.columns)
