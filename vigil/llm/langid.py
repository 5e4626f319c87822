"""Language identification by multilingual mixture inference.

A language is a distribution over hashed letter trigrams of words (with a space before and
after), learned from labelled documents. A document is a mixture: expectation-maximisation
estimates the share of each language from the likelihoods of its trigrams; then mixtures of
the one, two, ... strongest languages are fitted, as long as the likelihood less a penalty for each
further language rises, however many that are. The prediction is the largest share of the last set.

Training takes whole texts of at most about ``docs_per_language`` labelled documents of each
language (a documented bound, drawn by a hash of the row, whatever the input's size), adds
the counts up on the executors and holds one array of ``features`` numbers for each language.

Nulls: rows without label or text teach nothing; a null text, or one without a letter, is
``und`` with score 0. Very long texts are counted in blocks of words. With no labelled rows
every text is ``und``. Repeated rows get equal results. The columns of the input stay; the
result is one struct column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, frugal

FEATURES = 1 << 15
BLOCK_CHARS = 1 << 20
DENSE = 1 << 14
UNKNOWN = "und"
RESULT = "struct<lang:string,score:double,shares:array<struct<lang:string,share:double>>>"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _blocks(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = text.find(" ", at + BLOCK_CHARS) if len(text) - at > BLOCK_CHARS else -1
        yield text[at : end if end >= 0 else len(text)]
        at = end if end >= 0 else len(text)


def trigrams(text: str, features: int = FEATURES) -> np.ndarray:
    """Hashed trigrams around every letter of a block of text."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[chars]
    if not letter.any():
        return np.zeros(0, np.int64)
    chars = np.concatenate([[32], np.where(letter, chars, 32), [32]]).astype(np.uint64)
    letter = np.concatenate([[False], letter, [False]])
    at = np.flatnonzero(letter)
    code = chars[at - 1] * np.uint64(0x9E3779B97F4A7C15) ^ chars[at] * np.uint64(0xC2B2AE3D27D4EB4F) ^ chars[at + 1] * np.uint64(0x165667B19E3779F9)
    code ^= code >> np.uint64(29)
    return ((code * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) & (features - 1)


@dataclass
class Model:
    languages: list[str]
    chances: np.ndarray  # (features, languages), each column sums to 1

    def shares(self, text: str | None, penalty: float = 3.0) -> list[tuple[str, float]]:
        """Languages of the best set and their shares, largest first; empty without letters or languages."""
        if not text or not self.languages:
            return []
        parts = [trigrams(b, len(self.chances)) for b in _blocks(text)]
        n = sum(map(len, parts))
        if not n:
            return []
        if n <= DENSE:
            table, times = self.chances[np.concatenate(parts)], None
        else:
            counts = sum(np.bincount(p, minlength=len(self.chances)) for p in parts)
            found = np.flatnonzero(counts)
            table, times = self.chances[found], counts[found].astype(np.float32)
        weight, _ = mixture(table, times)
        order = np.argsort(-weight, kind="stable")
        best = None
        for k in range(1, len(order) + 1):
            share, fit = mixture(table[:, order[:k]], times)
            fit -= penalty * 0.5 * (k - 1) * np.log(n)
            if best is not None and fit <= best[0]:
                break
            best = (fit, share, order[:k])
        ranked = sorted(zip(best[1], best[2], strict=True), key=lambda x: (-x[0], x[1]))
        return [(self.languages[i], float(s)) for s, i in ranked]


def mixture(table: np.ndarray, times: np.ndarray | None, rounds: int = 25, still: float = 2e-3) -> tuple[np.ndarray, float]:
    """Shares of the columns that fit the rows best, and the log likelihood."""
    total = len(table) if times is None else float(times.sum())
    share = np.full(table.shape[1], 1 / table.shape[1], np.float32)
    if table.shape[1] == 1:
        logs = np.log(table[:, 0])
        return share, float(logs.sum(dtype=np.float64) if times is None else (logs * times).sum(dtype=np.float64))
    for _ in range(rounds):
        chance = table @ share
        new = share * ((1 / chance if times is None else times / chance) @ table) / np.float32(total)
        moved = np.abs(new - share).max()
        share = new / new.sum()
        if moved < still:
            break
    logs = np.log(table @ share)
    return share, float(logs.sum(dtype=np.float64) if times is None else (logs * times).sum(dtype=np.float64))


def train(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = 2000, features: int = FEATURES, smooth: float = 0.5, most_languages: int = 512) -> Model:
    """Learn from df's rows with a label and a text; the driver holds one array for each language."""
    bounded_batches(df.sparkSession)
    known = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    counts = {r[0]: r[1] for r in counts.collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((features, 0), np.float32))
    part = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / counts[k]))])
    drawn = known.filter(F.col(lang).isin(languages)).filter(F.pmod(F.xxhash64(F.lit(5), F.col(id_col), F.col(text)), F.lit(1_000_003)) < part[F.col(lang)] * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(k, np.zeros(features, np.int64))
                for b in _blocks(t):
                    own += np.bincount(trigrams(b, features), minlength=features)
        for k, own in held.items():
            found = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(own[found])], ["lang", "feature", "n"])

    sums = drawn.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, feature int, n bigint")
    sums = sums.groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = np.full((features, len(languages)), smooth, np.float64)
    rows = sums.toArrow()
    place = {k: i for i, k in enumerate(languages)}
    if rows.num_rows:
        table[rows["feature"].to_numpy(), [place[k] for k in rows["lang"].to_pylist()]] += rows["n"].to_numpy()
    return Model(languages, (table / table.sum(axis=0)).astype(np.float32))


def predict(df: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """df with a struct column ``out``: lang, score and the shares of the language set (an existing one is replaced)."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("shares", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])
        for texts in batches:
            rows = []
            for t in texts.to_pylist():
                got = m.shares(t)
                rows.append({"lang": got[0][0] if got else UNKNOWN, "score": min(1.0, got[0][1]) if got else 0.0, "shares": [{"lang": k, "share": s} for k, s in got]})
            yield pa.array(rows, kind)

    return df.withColumn(out, run(F.col(text)))
