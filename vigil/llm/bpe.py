"""BPE encoding and decoding by tree concatenation.

A long text is halved until a leaf is small. Leaves are encoded independently (in
parallel tasks for texts above ``spread_chars``, where the halves of an unsplit run are rows of their
own too) and joined pairwise up the tree: at each join a window around the cut is encoded anew and
grown until its first tokens agree with the left side and its last tokens with the right side.

Two kinds of joins keep the result equal to the library's encoding of the whole text:

* *Text joins*. A window starts and ends at anchors, places where the tokenizer's own
  splitting always breaks (before plain white space, or between two characters of
  different classes that normalisation leaves alone). Beyond an anchor neither side can
  depend on the other.
* *Symbol joins*, inside one unsplit run that has no anchor. The run's symbols are
  halved; a left half is encoded without the end-of-word mark. A BPE sequence is the
  encoding of its text exactly if every two neighbouring tokens are, so a window whose
  first token ends where a left token ends (with the same id), and whose last token is
  the right side's, gives the sequence of the whole run.

Nulls: a null text is encoded as the empty text (no ids, empty decoding). Repeated rows
give repeated results; an empty table gives an empty table. All columns of the input
stay as they are; the result is one more column, whose name the caller chooses.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, frugal

LEAF_CHARS = 4_096
SPREAD_CHARS = 65_536
#: Kinds of units: a leaf of text, a special token, symbols up to the end of a piece, symbols before others, and a run's own text.
TEXT, SPECIAL, CLOSED, OPEN, RUN = range(5)
#: Entries of the memo of white-space-free chunks that a worker keeps; beyond it the memo starts again.
MEMO_ENTRIES = 200_000

PLAIN_SPACE = " \t\n\r"
_CHUNK = re.compile(r"[^ \t\n\r]+")
#: The same, with letters at a chunk's start apart where ASCII that is no letter follows: splitting breaks there too.
_HEADS = re.compile(r"(?<![^ \t\n\r])[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\x00-\x7f]|$)|[^ \t\n\r]+")
_OTHER_SPACE = re.compile(r"[^\S \t\n\r]|[\x1c-\x1f\x85]")


@lru_cache(maxsize=65_536)
def _class(c: str) -> str:
    """L letter, N digit, O other; empty for characters that normalisation may change or combine."""
    kind = unicodedata.category(c)
    if kind[0] in "MZC" or 0x1100 <= ord(c) <= 0x11FF or len(c.lower()) != 1 or unicodedata.normalize("NFC", c) != c:
        return ""
    return kind[0] if kind[0] in "LN" else "O"


class TreeEncoder:
    """Encodes and decodes with one tokenizer file of the ``tokenizers`` library.

    Holds for BPE files whose splitting pattern never joins a letter, digit or other
    character with one of another class except in the contractions after ``'``.
    """

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, memo_entries: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.leaf_chars = leaf_chars
        self.memo_entries = memo_entries
        self.memo: dict[str, bytes] = {}
        self.tok = Tokenizer.from_str(json.dumps(spec))
        self.tok.no_truncation()
        self.tok.no_padding()
        self.path = path
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self._units = _CHUNK if any(x[0].isalpha() for x in self.specials) else _HEADS
        self._strings = None if self.tok.decoder is not None else {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self._special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None

    @cached_property
    def open_model(self):
        """The same model without the mark for the end of a word; only unsplit runs need it."""
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["model"]["end_of_word_suffix"] = None
        return Tokenizer.from_str(json.dumps(spec)).model

    # ---- plain encoding of what is small

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def leaf(self, text: str) -> bytes:
        """Encoding of a short text as int32 bytes; its white-space-free chunks come from a memo."""
        if _OTHER_SPACE.search(text):
            return self._plain(text).tobytes()
        chunks = self._units.findall(text)
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, chunks))
        except KeyError:
            new = list({c for c in chunks if c not in memo})
            if len(memo) + len(new) > self.memo_entries:
                memo.clear()
                new = list(set(chunks))
            for c, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
                memo[c] = np.array(e.ids, dtype=np.int32).tobytes()
            return b"".join(map(memo.__getitem__, chunks))

    # ---- the tree over a text

    def anchor(self, text: str, p: int) -> bool:
        """Whether the whole text's encoding always breaks before text[p]."""
        if not 0 < p < len(text):
            return True
        c, b = text[p], text[p - 1]
        if c not in PLAIN_SPACE:
            x, y = _class(b), _class(c)
            if not x or not y or x == y != "N" or (b == "'" and y == "L"):
                return False
        for s in self.specials:
            if text.find(s, max(0, p - len(s) + 1), p + len(s) - 1) >= 0:
                return False
        return True

    def _seek(self, text: str, p: int, lo: int, hi: int, step: int) -> int | None:
        """The first anchor from p on in the given direction, strictly between lo and hi."""
        while lo < p < hi:
            if self.anchor(text, p):
                return p
            p += step
        return None

    def cuts(self, text: str) -> list[int]:
        """Ends of the leaves: halves of halves down to leaf_chars; a cut inside a long unsplit run moves to its edge."""
        out: list[int] = []
        stack = [(0, len(text))]
        while stack:
            lo, hi = stack.pop()
            mid = self._cut(text, lo, hi)
            if mid is None:
                out.append(hi)
            else:
                stack += [(mid, hi), (lo, mid)]
        return out

    def _cut(self, text: str, lo: int, hi: int) -> int | None:
        if hi - lo <= self.leaf_chars:
            return None
        mid = (lo + hi) // 2
        reach = self.leaf_chars // 4
        left = self._seek(text, mid, max(lo, mid - reach), hi, -1)
        right = self._seek(text, mid, lo, min(hi, mid + reach), 1)
        if left is not None and right is not None:
            return mid
        near = left if left is not None else right
        if near is not None:
            return near
        left, right = self._seek(text, mid, lo, hi, -1), self._seek(text, mid, lo, hi, 1)
        near = [p for p in (left, right) if p is not None]
        return min(near, key=lambda p: abs(p - mid)) if near else None

    def span(self, text: str, lo: int, hi: int) -> bytes:
        """Encoding of one of the spans of cuts(); beyond the leaf size it is an unsplit run."""
        part = text[lo:hi]
        return self.leaf(part) if len(part) <= self.leaf_chars else self.run(part)

    def encode(self, text: str) -> bytes:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        ends = self.cuts(text)
        starts = [0, *ends[:-1]]
        return self.join_all(text, ends, [self.span(text, a, b) for a, b in zip(starts, ends, strict=True)])

    def join_all(self, text: str, ends: list[int], parts: list[bytes]) -> bytes:
        """Join neighbouring leaves pairwise, level by level, up to the whole text."""
        row = [(a, b, [p]) for a, b, p in zip([0, *ends[:-1]], ends, parts, strict=True)]
        while len(row) > 1:
            row = [self._join(text, *row[i], *row[i + 1][1:]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return b"".join(row[0][2]) if row else b""

    def _join(self, text: str, lo: int, mid: int, left: list[bytes], hi: int, right: list[bytes]) -> tuple[int, int, list[bytes]]:
        """Encode a window around mid anew and grow it until both sides agree with it exactly.

        Where mid is an anchor the sides agree with no window at all; elsewhere mid lies
        in a short run, since cuts() moves the others.
        """
        if self.anchor(text, mid):
            return lo, hi, left + right
        reach = 32
        while True:
            a = self._seek(text, mid - reach, lo, hi, -1) if mid - reach > lo else None
            b = self._seek(text, mid + reach, lo, hi, 1) if mid + reach < hi else None
            a, b = lo if a is None else a, hi if b is None else b
            inner_a, inner_b = self._seek(text, mid, a, mid + 1, -1), self._seek(text, mid, mid - 1, b, 1)
            window, head, tail = self.leaf(text[a:b]), self.leaf(text[a:mid]), self.leaf(text[mid:b])
            agree_left = a == lo or (inner_a is not None and window.startswith(self.leaf(text[a:inner_a])) and _ends(left, head))
            agree_right = b == hi or (inner_b is not None and window.endswith(self.leaf(text[inner_b:b])) and _starts(right, tail))
            if agree_left and agree_right:
                return lo, hi, [*_drop_end(left, len(head) if a > lo else None), window, *_drop_start(right, len(tail) if b < hi else None)]
            reach *= 2

    # ---- the tree over one unsplit run

    def run(self, run: str) -> bytes:
        """Encoding of a run without anchors: special tokens, then normalisation, splitting and symbol joins."""
        out = []
        for special, piece in self.pieces(run):
            ids = [self.tok.token_to_id(piece)] if special else [i for i, _ in self._symbols(piece, 0, len(piece))]
            out.append(np.array(ids, np.int32).tobytes())
        return b"".join(out)

    def pieces(self, run: str) -> Iterator[tuple[bool, str]]:
        """The special tokens of a run (True) and its normalised pieces (False), in order."""
        at = 0
        for m in self._special.finditer(run) if self._special else ():
            yield from self._split(run[at : m.start()])
            yield True, m[0]
            at = m.end()
        yield from self._split(run[at:])

    def _split(self, run: str) -> Iterator[tuple[bool, str]]:
        if not run:
            return
        if self.tok.normalizer is not None:
            run = self.tok.normalizer.normalize_str(run)
        for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(run) if self.tok.pre_tokenizer else [(run, None)]:
            yield False, piece

    def tokens(self, symbols: str, closed: bool) -> list[tuple[int, int]]:
        """(id, length in symbols) of symbols alone; only a piece's own end (closed) gets the end-of-word mark."""
        got = [(t.id, len(t.value)) for t in (self.tok.model if closed else self.open_model).tokenize(symbols)]
        if closed and self.suffix and got:
            got[-1] = (got[-1][0], got[-1][1] - len(self.suffix))
        return got

    def _symbols(self, piece: str, lo: int, hi: int) -> list[tuple[int, int]]:
        if hi - lo <= self.leaf_chars:
            return self.tokens(piece[lo:hi], hi == len(piece))
        mid = (lo + hi) // 2
        return self._join_symbols(piece, mid, self._symbols(piece, lo, mid), self._symbols(piece, mid, hi))

    def _join_symbols(self, piece: str, mid: int, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Encode a window of tokens around mid anew and grow it until both sides agree with it."""
        take = 8
        while True:
            i, j = max(0, len(left) - take), min(len(right), take)
            a, b = mid - sum(n for _, n in left[i:]), mid + sum(n for _, n in right[:j])
            got = self.tokens(piece[a:b], b == len(piece))
            if (i == 0 or got[0] == left[i]) and (j == len(right) or got[-1] == right[j - 1]):
                return left[:i] + got + right[j:]
            take *= 2

    # ---- the tree with its leaves elsewhere

    def units(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """What may be encoded apart: (leaf, piece, half, kind, text) of every leaf of the text, and of the halves of its unsplit runs."""
        out, at = [], 0
        for no, end in enumerate(self.cuts(text)):
            part, at = text[at:end], end
            if len(part) <= self.leaf_chars:
                out.append((no, 0, 0, TEXT, part))
                continue
            out.append((no, -1, 0, RUN, part))
            for sub, (special, piece) in enumerate(self.pieces(part)):
                halves = 1
                while -(-len(piece) // halves) > self.leaf_chars:
                    halves *= 2
                edges = [len(piece) * i // halves for i in range(halves + 1)]
                for seg, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((no, sub, seg, SPECIAL if special else CLOSED if b == len(piece) else OPEN, piece[a:b]))
        return out

    def unit(self, kind: int, part: str) -> tuple[bytes, bytes]:
        """Ids of a unit taken alone, and the lengths of its tokens in symbols if it is part of a run."""
        if kind == TEXT:
            return self.leaf(part), b""
        got = [(self.tok.token_to_id(part), len(part))] if kind == SPECIAL else self.tokens(part, kind == CLOSED) if kind != RUN else []
        both = np.array(got, np.int32).reshape(-1, 2)
        return both[:, 0].tobytes(), both[:, 1].tobytes()

    def join_units(self, units: list[tuple[int, int, int, int, str, bytes, bytes]]) -> bytes:
        """Encoding of the whole text from its encoded units, in order."""
        text, ends, parts = [], [], []
        for _, leaf in groupby(units, lambda u: u[0]):
            leaf = list(leaf)
            text.append(leaf[0][4])
            ends.append((ends[-1] if ends else 0) + len(leaf[0][4]))
            if leaf[0][3] == TEXT:
                parts.append(leaf[0][5])
                continue
            parts.append(b"".join(self._join_halves(list(halves)) for _, halves in groupby(leaf[1:], lambda u: u[1])))
        return self.join_all("".join(text), ends, parts)

    def _join_halves(self, halves: list[tuple]) -> bytes:
        """Ids of one piece of a run from its halves, joined pairwise."""
        if len(halves) == 1:
            return halves[0][5]
        piece, at, row = "".join(u[4] for u in halves), 0, []
        for u in halves:
            at += len(u[4])
            row.append((at, list(zip(np.frombuffer(u[5], np.int32).tolist(), np.frombuffer(u[6], np.int32).tolist(), strict=True))))
        while len(row) > 1:
            row = [(row[i + 1][0], self._join_symbols(piece, row[i][0], row[i][1], row[i + 1][1])) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return np.array([i for i, _ in row[0][1]], np.int32).tobytes()

    # ---- decoding

    def decode(self, ids: np.ndarray) -> str:
        if self._strings is not None:  # without a decoder the library joins the tokens by spaces
            return " ".join(map(self._strings.__getitem__, ids.tolist()))
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)


def _ends(parts: list[bytes], tail: bytes) -> bool:
    got = b""
    for p in reversed(parts):
        if len(got) >= len(tail):
            break
        got = p + got
    return got.endswith(tail)


def _starts(parts: list[bytes], head: bytes) -> bool:
    got = b""
    for p in parts:
        if len(got) >= len(head):
            break
        got += p
    return got.startswith(head)


def _drop_end(parts: list[bytes], n: int | None) -> list[bytes]:
    """The parts without their last n bytes; without anything where n is None."""
    if n is None:
        return []
    parts = list(parts)
    while n and parts:
        last = parts.pop()
        if len(last) > n:
            parts.append(last[: len(last) - n])
            break
        n -= len(last)
    return parts


def _drop_start(parts: list[bytes], n: int | None) -> list[bytes]:
    if n is None:
        return []
    for i, p in enumerate(parts):
        if len(p) > n:
            return [p[n:], *parts[i + 1 :]]
        n -= len(p)
    return []


_ENCODERS: dict[tuple, TreeEncoder] = {}


def encoder(path: str, leaf_chars: int = LEAF_CHARS) -> TreeEncoder:
    """One encoder for each worker process and tokenizer file."""
    key = (path, leaf_chars)
    if key not in _ENCODERS:
        _ENCODERS[key] = TreeEncoder(path, leaf_chars)
    return _ENCODERS[key]


RESULT = "struct<ids:array<int>,decoded:string>"


def _id_lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _encode_udf(path: str, leaf_chars: int) -> Callable:
    @F.arrow_udf(RESULT)
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, leaf_chars)
        for texts in batches:
            ids = [enc.encode(t or "") for t in texts.to_pylist()]
            decoded = [enc.decode(np.frombuffer(x, np.int32)) for x in ids]
            yield pa.StructArray.from_arrays([_id_lists(ids), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return run


def encode(df: DataFrame, path: str, text: str = "text", out: str = "bpe", leaf_chars: int = LEAF_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """df with a column ``out`` of ids and their decoding; ``path`` is the tokenizer file on the executors.

    Texts above ``spread_chars`` are cut into leaves that other tasks encode; one task
    for each such text then joins its leaves. Shorter texts never leave their task. An
    existing column named ``out`` is replaced.
    """
    bounded_batches(df.sparkSession, "4m")
    df = df.drop(out) if out != text else df
    long = F.coalesce(F.length(text), F.lit(0)) > spread_chars
    near = df.filter(~long).withColumn(out, _encode_udf(path, leaf_chars)(F.col(text)))
    return near.unionByName(_encode_long(df.filter(long), path, text, out, leaf_chars))


UNITS = "array<struct<no:int,sub:int,seg:int,kind:int,part:string>>"


def spread_units(df: DataFrame, path: str, text: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """row, c0, c1, ... (df's other columns), no, sub, seg, kind, part, code of every unit of df's texts, encoded in parallel."""
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @F.arrow_udf(UNITS)
    @frugal
    def cut_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, leaf_chars)
        names = ("no", "sub", "seg", "kind", "part")
        kind = pa.list_(pa.struct([*((n, pa.int32()) for n in names[:4]), ("part", pa.string())]))
        for texts in batches:
            yield pa.array([[dict(zip(names, u, strict=True)) for u in enc.units(t)] for t in texts.to_pylist()], kind)

    @F.arrow_udf("struct<ids:binary,lens:binary>")
    @frugal
    def alone(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        enc = encoder(path, leaf_chars)
        for kinds, parts in batches:
            got = [enc.unit(k, p) for k, p in zip(kinds.to_pylist(), parts.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in got], pa.binary()) for i in range(2)], ["ids", "lens"])

    others = [F.col(c).alias(f"c{i}") for i, c in enumerate(c for c in df.columns if c != text)]
    rows = df.select(F.monotonically_increasing_id().alias("row"), *others, cut_up(F.col(text)).alias("units")).select("*", F.inline("units")).drop("units")
    return rows.repartition(width, "row", "no", "sub", "seg").withColumn("code", alone(F.col("kind"), F.col("part")))


def _encode_long(df: DataFrame, path: str, text: str, out: str, leaf_chars: int) -> DataFrame:
    """The halves of long texts as rows, encoded in parallel and joined by text."""

    @F.arrow_udf(RESULT)
    @frugal
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, leaf_chars)
        for rows in batches:
            ids = []
            for units in rows.to_pylist():
                units = [(u["no"], u["sub"], u["seg"], u["kind"], u["part"], u["code"]["ids"], u["code"]["lens"]) for u in units]
                ids.append(enc.join_units(sorted(units, key=lambda u: u[:3])))
            decoded = [enc.decode(np.frombuffer(x, np.int32)) for x in ids]
            yield pa.StructArray.from_arrays([_id_lists(ids), pa.array(decoded, pa.string())], ["ids", "decoded"])

    others = [c for c in df.columns if c != text]
    whole = spread_units(df, path, text, leaf_chars).groupBy("row").agg(
        *[F.first(f"c{i}").alias(f"c{i}") for i in range(len(others))],
        F.collect_list(F.struct("no", "sub", "seg", "kind", "part", "code")).alias("units"),
    )
    own = F.filter(F.array_sort(F.transform("units", lambda u: F.struct(u["no"], u["sub"], u["seg"], u["kind"], u["part"]))), lambda u: u["kind"].isin(TEXT, RUN))
    back = whole.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)],
        F.array_join(F.transform(own, lambda u: u["part"]), "").alias(text),
        joined(F.col("units")).alias(out),
    )
    return back.select(*df.columns, out)
