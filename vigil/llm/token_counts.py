"""Token counts: batch encoding in an Arrow function that returns lengths only.

The texts of an Arrow batch are cut into units at safe boundaries, places where the
tokenizer's splitting always breaks: before plain white space that follows a
character which is no white space. So a long text is no long call. Units not yet in the
worker's memo are encoded in batches of about ``batch_bytes`` bytes each, whatever
their number, and only the length of an encoding is kept.

Nulls and empty texts have 0 tokens. Repeated rows give repeated results; an empty
table gives an empty table. The columns of the input stay as they are, beside the one
of the result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, frugal

BATCH_BYTES = 1 << 20
MEMO_ENTRIES = 500_000
#: Units longer than this are counted but not remembered.
MEMO_CHARS = 64

_UNIT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space that the tokenizers may join with the plain one; texts with it are cut only before plain white space after none.
_ODD = re.compile(r"[^\S \t\n\r]|[\x1c-\x1f\x85]")
_SAFE = re.compile(r"(?<=[^\s\x85\x1c-\x1f])(?=[ \t\n\r])")


class Counter:
    """Counts tokens with a ``tokenizers`` .json file or a ``sentencepiece`` .model file."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.batch_bytes = batch_bytes
        self.memo: dict[str, int] = {}
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()

    def lengths(self, units: list[str]) -> list[int]:
        if self.pieces:
            return [len(x) for x in self.model.encode(units, num_threads=1)]
        return [len(x.ids) for x in self.model.encode_batch_fast(units, add_special_tokens=False)]

    def units(self, text: str) -> list[str]:
        if self.pieces:  # its normalisation reaches over white space
            return [text]
        return _SAFE.split(text) if _ODD.search(text) else _UNIT.findall(text)

    def _learn(self, units: list[str]) -> dict[str, int]:
        """Lengths of the units, encoded in batches of about batch_bytes bytes."""
        out: dict[str, int] = {}
        batch, size = [], 0
        for u in units:
            batch.append(u)
            size += len(u.encode("utf-8", "surrogatepass"))
            if size >= self.batch_bytes:
                out.update(zip(batch, self.lengths(batch), strict=True))
                batch, size = [], 0
        if batch:
            out.update(zip(batch, self.lengths(batch), strict=True))
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Token counts of a batch of texts."""
        out: list[int] = []
        size, group = 0, []
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= 4 * self.batch_bytes:
                out += self._count(group)
                size, group = 0, []
        return out + self._count(group)

    def _count(self, texts: list[str]) -> list[int]:
        memo = self.memo
        cut = [self.units(t) for t in texts]
        new = {u for us in cut for u in us if u not in memo}
        if len(memo) + len(new) > MEMO_ENTRIES:
            memo.clear()
            new = {u for us in cut for u in us}
        got = self._learn(list(new))
        memo.update((u, n) for u, n in got.items() if len(u) <= MEMO_CHARS)
        return [sum(memo[u] if u in memo else got[u] for u in us) for us in cut]


_COUNTERS: dict[tuple, Counter] = {}


def counter(path: str, batch_bytes: int = BATCH_BYTES) -> Counter:
    key = (path, batch_bytes)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(path, batch_bytes)
    return _COUNTERS[key]


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """df with the number of tokens of each whole text as the long column ``out`` (an existing one is replaced)."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("bigint")

    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(path, batch_bytes)
        for texts in batches:
            yield pa.array(c.count(texts.to_pylist()), pa.int64())

    return df.withColumn(out, run(F.col(text)))
