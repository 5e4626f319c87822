"""Training-order materialisation: every sequence gets a global slot, and shards hold the slots in order.

A text's tokens are cut into sequences of ``length`` tokens; an end token follows the last one and the
rest of its sequence is padding. Sequences are numbered in the order of the input's files (path, row), however
Spark packs files into partitions; rows that come from no file are numbered by (partition, row). A keyed Feistel
network over the least even number of bits that holds their count permutes the numbers, and walks its cycle
on while a value lies past the count, so slots are the numbers 0 to n - 1, each once. Ranges of slots go to
tasks by number (no sampling), are sorted, and become shards of ``shard_slots`` records of one size, so the
record of any slot is at a known offset and a reader can stop and go on anywhere.

Tokens here are the bytes of the UTF-8 text (0 to 255), 256 ends a text and 257 pads; token ids of another
vocabulary go in as a binary column of little-endian 16-bit numbers (``packed``) with ``bytes_per_token=2``.

The count of each part of a file comes from a first pass; the second one checks its own against it and
fails loudly if they differ, so no slot is given twice. Nulls: a null text is empty and is one sequence with
the end token only; a null id is kept as null. Ids that are no integers are kept as their 64-bit hash. Repeated rows are sequences of their own. An empty table has no
shards. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, frugal

END, PAD = 256, 257
#: A shard's head: magic, tokens and bytes of a record, first slot, records. A record's head: id, place in its text, tokens without padding.
MAGIC, HEADER, RECORD_HEAD = b"VGLSHRD1", "<8sIIQQ", "<qii"
HEADER_BYTES, RECORD_BYTES = struct.calcsize(HEADER), struct.calcsize(RECORD_HEAD)
#: Set in a record's count of tokens where its id is null.
NO_ID = 1 << 30
#: Modulus of the rounds: a prime below 2^31, so that squares stay within 63 bits.
PRIME = 2_147_483_647
ROUNDS = 6
SHARD = "shard long, first_slot long, n long, data binary"


@dataclass(frozen=True)
class Layout:
    length: int = 1024
    shard_slots: int = 4096
    seed: int = 17
    bytes_per_token: int = 1
    end: int = END
    pad: int = PAD
    shards_per_task: int = 2

    @property
    def stride(self) -> int:
        return RECORD_BYTES + 2 * self.length


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers for each round, from a hash of the seed."""
    out = []
    for i in range(ROUNDS):
        h = hashlib.sha256(f"{seed}/{i}".encode()).digest()
        out.append(tuple(int.from_bytes(h[4 * j : 4 * j + 4], "big") % (PRIME - 1) + 1 for j in range(3)))
    return out


def half_bits(n: int) -> int:
    """Bits of each half: the least with 4 ** bits >= n."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Slots of numbers below n: Feistel rounds, repeated where the value isn't below n."""
    bits = half_bits(n)
    mask, keys = (1 << bits) - 1, round_keys(seed)

    def rounds(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for a, b, c in keys:
            t = (right % PRIME * a + b) % PRIME
            left, right = right, left ^ ((t * t + c) % PRIME & mask)
        return left << bits | right

    out = rounds(numbers.astype(np.int64))
    past = np.flatnonzero(out >= n)
    while len(past):
        out[past] = rounds(out[past])
        past = past[out[past] >= n]
    return out


def _counts(size, layout: Layout):
    """Sequences of texts with so many bytes: their tokens and the end token."""
    return (size // layout.bytes_per_token + layout.length) // layout.length


def _place(df: DataFrame) -> list[F.Column]:
    """Columns that say which part of which file a row comes from; parts of a file are in the order of their starts."""
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return [F.lit("").alias("_file"), F.spark_partition_id().cast("long").alias("_start")]
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]


def packed(ids: str) -> F.Column:
    """A column of token ids below 65,536 as little-endian 16-bit numbers."""

    @F.arrow_udf("binary")
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array([None if r is None else np.array(r, "<u2").tobytes() for r in rows.to_pylist()], pa.binary())

    return run(F.col(ids))


def sequences(df: DataFrame, id_col: str = "doc_id", text: str = "text", layout: Layout = Layout()) -> tuple[DataFrame, int]:
    """(id, seq_no, slot, n_tokens, payload) of every sequence, and how many there are."""
    bounded_batches(df.sparkSession)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    n_of = F.floor((F.floor(size / layout.bytes_per_token) + layout.length) / layout.length)
    place = _place(df)
    per = {(r[0], r[1]): r[2] for r in df.select(*place, n_of.alias("n")).groupBy("_file", "_start").agg(F.sum("n")).collect()}
    base, total = {}, 0
    for p in sorted(per):
        base[p], total = total, total + per[p]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[str, int], int] = {}
        step = layout.length * layout.bytes_per_token
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            unknown = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            counts = _counts(sizes, layout)
            starts = np.asarray(batch.column(3))
            files = batch.column(2).to_pylist()
            edges = [0, *(i for i in range(1, len(raw)) if starts[i] != starts[i - 1] or files[i] != files[i - 1]), len(raw)]
            numbers = []
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    part, more = (files[a], int(starts[a])), int(counts[a:b].sum())
                    at = done.get(part, 0)
                    done[part] = at + more
                    if done[part] > per.get(part, 0):
                        raise ValueError("the input's partitions changed between two passes")
                    numbers.append(np.arange(base[part] + at, base[part] + at + more))
            slots = permute(np.concatenate(numbers) if numbers else np.zeros(0, np.int64), total, layout.seed)
            owner = np.repeat(np.arange(len(raw)), counts)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            parts = [raw[i][k * step : (k + 1) * step] for i, k in zip(owner.tolist(), nth.tolist(), strict=True)]
            used = np.fromiter(map(len, parts), np.int64, len(parts)) // layout.bytes_per_token + (nth == counts[owner] - 1)
            used |= np.where(unknown[owner], NO_ID, 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(nth.astype(np.int32)), pa.array(slots), pa.array(used.astype(np.int32)), pa.array(parts, pa.binary())], ["id", "seq_no", "slot", "n_tokens", "payload"])
        if any(n != per[part] for part, n in done.items()):
            raise ValueError("the input's partitions changed between two passes")

    whole = df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long", "void")
    key = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string")))
    rows = df.select(key.alias("id"), F.col(text).cast("binary").alias("text"), *place)
    return rows.mapInArrow(number, "id long, seq_no int, slot long, n_tokens int, payload binary"), total


def shards(df: DataFrame, id_col: str = "doc_id", text: str = "text", layout: Layout = Layout()) -> DataFrame:
    """Shards (shard, first_slot, n, data) of all sequences, ranges of them by task."""
    rows, total = sequences(df, id_col, text, layout)
    count = -(-total // layout.shard_slots)
    tasks = max(1, -(-count // layout.shards_per_task))
    task = F.floor(F.col("slot") / (layout.shard_slots * layout.shards_per_task)).cast("int")
    rows = rows.repartitionById(tasks, task).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, held = None, 0, []

        def out() -> pa.RecordBatch:
            head = struct.pack(HEADER, MAGIC, layout.length, layout.stride, first, len(held))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([first], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([head + b"".join(held)], pa.binary())], ["shard", "first_slot", "n", "data"])

        for batch in batches:
            for key, nth, slot, used, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slot // layout.shard_slots != shard:
                    if held:
                        yield out()
                    shard, first, held = slot // layout.shard_slots, slot, []
                held.append(struct.pack(RECORD_HEAD, key, nth, used) + record(payload, used & ~NO_ID, layout).tobytes())
        if held:
            yield out()

    return rows.mapInArrow(write, SHARD)


def record(payload: bytes, used: int, layout: Layout) -> np.ndarray:
    """The tokens of one sequence: the payload's, the end token if it is the last one, and padding."""
    ids = np.full(layout.length, layout.pad, "<u2")
    own = np.frombuffer(payload, np.uint8 if layout.bytes_per_token == 1 else "<u2")
    ids[: len(own)] = own
    if used > len(own):
        ids[len(own)] = layout.end
    return ids


_READ = "slot long, shard long, byte_offset long, id long, seq_no int, n_tokens int, tokens binary"


def read_slots(table: DataFrame, first: int = 0, stop: int | None = None) -> DataFrame:
    """Records of the slots from first up to stop, each from its place in its shard; other shards aren't read."""
    bounded_batches(table.sparkSession)
    some = table.filter(F.col("first_slot") + F.col("n") > first)
    some = some if stop is None else some.filter(F.col("first_slot") < stop)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                magic, length, stride, start, n = struct.unpack_from(HEADER, data)
                if magic != MAGIC or len(data) != HEADER_BYTES + stride * n:
                    raise ValueError("not a whole shard")
                lo, hi = max(0, first - start), n if stop is None else min(n, stop - start)
                for at in range(lo, hi, 2048):
                    rows = []
                    for i in range(at, min(at + 2048, hi)):
                        place = HEADER_BYTES + i * stride
                        key, nth, used = struct.unpack_from(RECORD_HEAD, data, place)
                        rows.append((start + i, shard, place, None if used & NO_ID else key, nth, used & ~NO_ID, data[place + RECORD_BYTES : place + stride]))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["slot", "shard", "byte_offset", "id", "seq_no", "n_tokens", "tokens"])

    return some.select("shard", "data").mapInArrow(read, _READ)
