"""Quality rules: measures of each text, and the frequency of lines across the documents of a host.

Base rules: a document fails with fewer than ``min_words`` words, or if more than
``max_repeat_pct`` percent of its words lie in 8-word windows that the text holds twice or
more.

Method: lines are normalised (ASCII lower case, runs of white space to one space, digits to
0) and hashed, whatever their length; the distinct documents of each host with a line are
counted, where copies of a text count once. A line that is in ``line_docs`` documents of its
host or more is above the limit, in hosts of any size. Such lines are removed: ``judge`` counts
their words, ``keep_good`` returns the texts without them. A document is rejected as depleted if
fewer than ``min_left_words`` words, or than ``min_left_pct`` percent of them, are left.

Lines that hold a large part of all lines, and texts that hold a large part of all rows, are
salted by their measured counts; no other row is copied.

Nulls: a null text has no words and fails the base rules; a null host is a host of its own.
Repeated rows get equal results; an empty table gives an empty table. The columns of the
input stay; results come in one struct column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, cut, frugal, spread_join, unused

WINDOW = 8
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")

MEASURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,lines:array<struct<line:bigint,words:int>>>"


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of eight that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mixed = (mixed ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def line_code(words: list[bytes]) -> int:
    """Hash of a normalised line."""
    return xxhash.xxh64_intdigest(b" ".join(words).lower().translate(_DIGITS)) - (1 << 63)


def without(text: str, gone: set[int]) -> str:
    """The text without the lines whose hashes are in ``gone``; lines without a word stay."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    left = [x for x in lines if not (words := x.split()) or line_code(words) not in gone]
    return b"\n".join(left).decode("utf-8", "surrogatepass")


def measure(text: str) -> dict:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines, held, seen, dups = raw.split(b"\n"), {}, set(), 0
    for line in lines:
        parts = line.split()
        if not parts:
            continue
        if line in seen:
            dups += 1
        seen.add(line)
        code = line_code(parts)
        held[code] = held.get(code, 0) + len(parts)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dups,
        "n_repeat_words": repeat_words(words),
        "lines": [{"line": k, "words": v} for k, v in held.items()],
    }


def measures(text: str) -> F.Column:
    """The base measures and hashed lines of a text column."""

    @F.arrow_udf(MEASURES)
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lines = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))
        kind = pa.struct([*((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("lines", lines)])
        for texts in batches:
            yield pa.array([measure(t or "") for t in texts.to_pylist()], kind)

    return run(F.col(text))


def _without(text: F.Column, gone: F.Column) -> F.Column:
    """Texts without the lines of ``gone``; null where either is null."""

    @F.arrow_udf("string")
    @frugal
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, codes in batches:
            pairs = zip(texts.to_pylist(), codes.to_pylist(), strict=True)
            yield pa.array([None if t is None or c is None else without(t, set(c)) for t, c in pairs], pa.string())

    return run(F.when(gone.isNotNull(), text), gone)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; see the module's notes."""

    min_words: int = 20
    max_repeat_pct: int = 30
    line_docs: int = 20
    min_left_pct: int = 30
    min_left_words: int = 8


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
IDENTITY = ["host", "h1", "h2"]


def _identity(text: str, host: str) -> list[F.Column]:
    key = F.coalesce(F.concat(F.lit("0"), F.col(host).cast("string")), F.lit("1"))
    return [key.alias("host"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(9), text).alias("h2")]


def judge(df: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of df (all but the text by default), the measures, base_failed and kept.

    What is kept is written to the shared folder once, with a few hashed lines for each
    row, so that the text is read and measured once. Existing columns named like a result are dropped.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != text and c not in RESULTS]
    rows, verdicts, n_rows = _verdicts(df, text, host, rules, [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    held = rows.columns[: len(keep)]
    judged = spread_join(rows.drop("m"), verdicts.drop("gone"), IDENTITY, "copies", n_rows, held or IDENTITY)
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *RESULTS)


def keep_good(df: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of df that the rules keep, their texts without the lines above the limit; other columns as they are."""
    _, verdicts, n_rows = _verdicts(df, text, host, rules, [])
    names = [unused(df, f"_k{i}") for i in range(3)]
    verdict, copies = unused(df, "_verdict"), unused(df, "_copies")
    changed = verdicts.filter("NOT kept OR gone IS NOT NULL")
    changed = changed.select(*[F.col(c).alias(n) for c, n in zip(IDENTITY, names, strict=True)], F.struct("kept", "gone").alias(verdict), F.col("copies").alias(copies))
    marked = df.select("*", *[c.alias(n) for c, n in zip(_identity(text, host), names, strict=True)])
    good = spread_join(marked, changed, names, copies, n_rows, df.columns, "left")
    good = good.filter(F.coalesce(F.col(f"{verdict}.kept"), F.lit(True)))
    clean = F.coalesce(_without(F.col(text), F.col(f"{verdict}.gone")), F.col(text))
    return good.select(*[clean.alias(c) if c == text else F.col(c) for c in df.columns])


def _verdicts(df: DataFrame, text: str, host: str, rules: Rules, held: list[F.Column]) -> tuple[DataFrame, DataFrame, int]:
    """The rows of df (``held``, identity, measures), a verdict for each distinct text of a host, and the number of rows.

    A verdict has the text's measures, what the rules say, its frequent lines and the number of rows with it.
    """
    bounded_batches(df.sparkSession)
    rows = cut(df.select(*held, *_identity(text, host), measures(text).alias("m")))
    texts = cut(rows.groupBy(*IDENTITY).agg(F.first("m").alias("m"), F.count("*").alias("copies")))
    n_rows, n_lines = texts.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.size("m.lines")), F.lit(0))).first()
    lines = texts.select(*IDENTITY, F.inline("m.lines"))
    often = cut(lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.line_docs))
    hits = spread_join(lines, often, ["host", "line"], "n", n_lines, ["h1", "h2"])
    removed = hits.groupBy(*IDENTITY).agg(F.sum("words").alias("removed"), F.collect_list("line").alias("gone"))
    n = F.col("m.n_words")
    base = (n < rules.min_words) | (F.col("m.n_repeat_words") * 100 > n * rules.max_repeat_pct)
    left = n - F.coalesce("removed", F.lit(0))
    good = ~base & (left >= rules.min_left_words) & (left * 100 >= n * rules.min_left_pct)
    out = texts.join(removed, IDENTITY, "left")
    out = out.select(*IDENTITY, "copies", *[F.col(f"m.{c}").alias(c) for c in RESULTS[:5]], base.alias("base_failed"), good.alias("kept"), "gone")
    return rows, cut(out), n_rows
