"""Near duplicates by MinHash and a multi-index Hamming join.

A text's set holds its distinct five-word shingles; equal sets are one node. A node's
signature has ``hashes`` symbols of 16 bits. Two sets of similarity s differ in about
``hashes * (1 - s)`` symbols; the distance threshold ``radius`` lies far above that at the wanted
similarity. By the pigeonhole principle a pair within the radius has a chunk of the
signature with at most ``errors`` wrong symbols, so every node is indexed under each chunk
with each choice of ``errors`` symbols left out: all pairs within the radius share a key.

The members of a key meet under the one of them that shares its keys with the most nodes, the centre, so
that near copies of one text meet under few centres, mostly the text that they are copies of. Every member whose signature lies within
the centre's radius is compared with the centre on full sets (a star, linear in the group's size),
and the links found give components. Members of one component need no pairs among themselves; only pairs
that join two components are left, and each of them has a member outside of its group's largest
component. Those outsiders are dealt to blocks, all members to others, and each pair of such blocks is
one unit of work: signatures first, to leave out nodes without a partner in the radius, then full
sets. A unit returns only links that join components, so a group costs no rows for its pairs, yet no
two texts that are linked fall apart. Components come from alternating large-star and small-star steps.

Keys, centres and sets that hold a large part of all rows are salted by their measured counts.

A link is missed only if a pair at the threshold differs in more than ``radius`` symbols: with
the defaults about 2 in 10,000 pairs of similarity exactly 0.75, and practically none from 0.8 up.

Nulls: a null text, or one without words, has an empty set and is linked with nothing. A
null id is never the smallest. Fewer words than five are one shingle. Repeated rows share
a node. An empty table gives an empty table. Further columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, cut, frugal, made, settle, small_side, spread_join, stored, sweep, unused

WORDS = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """Parameters of the join; see the module's notes."""

    similarity_pct: int = 75
    hashes: int = 48
    errors: int = 1
    deviations: float = 3.7
    signature_block: int = 128
    set_block_bytes: int = 4 << 20
    seed: int = 11

    @property
    def radius(self) -> int:
        s = self.similarity_pct / 100
        return min(self.hashes, round(self.hashes * (1 - s) + self.deviations * math.sqrt(self.hashes * s * (1 - s))))

    @property
    def chunks(self) -> list[np.ndarray]:
        n = min(self.hashes, -(-(self.radius + 1) // (self.errors + 1)))
        return np.array_split(np.arange(self.hashes), n)

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.integers(1, 2**63, self.hashes, np.uint64) | np.uint64(1), rng.integers(0, 2**63, self.hashes, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for i in range(WORDS):
        out = (out ^ codes[i : i + n]) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(held: np.ndarray, plan: Plan, factors: tuple[np.ndarray, np.ndarray]) -> bytes:
    a, b = factors
    least = np.full(plan.hashes, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(held), 1024):
        least = np.minimum(least, (held[i : i + 1024, None] * a + b).min(axis=0))
    return ((least * _MIX) >> np.uint64(48)).astype(np.uint16).tobytes()


def keys_of(sigs: np.ndarray, plan: Plan) -> np.ndarray:
    """Keys of each signature (rows): a hash of every chunk with every choice of symbols left out."""
    out = []
    for c, places in enumerate(plan.chunks):
        for gone in combinations(range(len(places)), min(plan.errors, len(places) - 1)):
            key = np.full(len(sigs), (c << 16) + sum(1 << g for g in gone), np.uint64) * _MIX
            for p in (p for i, p in enumerate(places) if i not in gone):
                key = (key ^ sigs[:, p].astype(np.uint64)) * _MIX
                key ^= key >> np.uint64(29)
            out.append(key.view(np.int64))
    return np.stack(out, axis=1)


def _profile(plan: Plan):
    @F.arrow_udf("struct<n:bigint,h1:bigint,h2:bigint,sig:binary>")
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        factors = plan.factors()
        for texts in batches:
            n, h, sigs = [], [], []
            for t in texts.to_pylist():
                held = shingles(t)
                n.append(len(held))
                h.append(xxhash.xxh3_128_digest(held.tobytes()))
                sigs.append(signature(held, plan, factors) if len(held) else b"")
            both = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(sigs, pa.binary())], ["n", "h1", "h2", "sig"])

    return run


def _index(plan: Plan):
    @F.arrow_udf("array<bigint>")
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sigs in batches:
            rows = np.frombuffer(b"".join(sigs.to_pylist()), np.uint16).reshape(-1, plan.hashes)
            keys = keys_of(rows, plan)
            ends = np.arange(0, keys.size + 1, max(1, keys.shape[1]), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))

    return run


def _sets():
    @F.arrow_udf("binary")
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shingles(t).tobytes() for t in texts.to_pylist()], pa.binary())

    return run


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[pa.Array]]:
    """Columns of each run of rows whose first ``width`` columns agree; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> list[pa.Array]:
        return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in pa.Table.from_batches(held).columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(i)) for i in range(width)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[a])
            if key != last and held:
                yield whole()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield whole()


def _fits(n: np.ndarray | int, m: np.ndarray | int, pct: int) -> np.ndarray:
    """Whether sets of n and m elements can be similar enough."""
    return 100 * np.minimum(n, m) >= pct * np.maximum(n, m)


def _within(plan: Plan):
    """Whether two signatures, of sets with so many elements, lie within the radius."""

    @F.arrow_udf("boolean")
    @frugal
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for sig, other, n, m in batches:
            a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, plan.hashes) for x in (sig, other))
            yield pa.array(((a != b).sum(axis=1) <= plan.radius) & _fits(np.asarray(n), np.asarray(m), plan.similarity_pct))

    return run


def similar(a: np.ndarray, b: np.ndarray, pct: int) -> bool:
    """Whether two sets (sorted arrays) are similar enough."""
    if not _fits(len(a), len(b), pct):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= pct * (len(a) + len(b) - both)


def _linked(plan: Plan):
    @F.arrow_udf("boolean")
    @frugal
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sets, others in batches:
            yield pa.array([similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), plan.similarity_pct) for x, y in zip(sets, others, strict=True)], pa.bool_())

    return run


def near_nodes(plan: Plan):
    """For sorted (centre, out, block, inner, node, root, n, sig): the (centre, node) of pairs in the radius that join two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in groups(batches, 3):
            inner, node, root, n = (np.asarray(c) for c in cols[3:7])
            sigs = np.frombuffer(b"".join(cols[7].to_pylist()), np.uint16).reshape(-1, plan.hashes)
            every, found = np.flatnonzero(inner), np.zeros(len(node), bool)
            for i in np.flatnonzero(inner == 0):
                others = every[root[every] != root[i]]
                others = others[(sigs[others] != sigs[i]).sum(axis=1) <= plan.radius]
                others = others[_fits(n[others], n[i], plan.similarity_pct)]
                found[i] = len(others) > 0
                found[others] = True
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(found.sum()), cols[0][0].as_py(), np.int64)), pa.array(node[found])], ["centre", "node"])

    return run


def links(sets: list[np.ndarray], inner: np.ndarray, root: np.ndarray, similarity_pct: int) -> list[tuple[int, int]]:
    """Pairs of a row with inner = 0 and one with inner = 1 whose sets are similar enough, as few as join the components ``root``.

    Counts of shared elements come from lists of owners by element, so memory is bounded by the elements of all sets together.
    """
    size = np.array([len(s) for s in sets])
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(where, kind="stable")
    starts = np.searchsorted(where[by], np.arange(len(every) + 1))
    owners, ends = owner[by], np.cumsum(size)
    root, forest = np.unique(root, return_inverse=True)[1], []
    for i in np.flatnonzero(inner == 0):
        if not ((root != root[i]) & (inner == 1)).any():
            continue
        own = where[ends[i] - size[i] : ends[i]]
        many = starts[own + 1] - starts[own]
        places = np.repeat(starts[own] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        both = np.bincount(owners[places], minlength=len(sets))
        good = (100 * both >= similarity_pct * (size + size[i] - both)) & (both > 0) & (inner == 1) & (root != root[i])
        for j in np.flatnonzero(good):
            if root[j] != root[i]:
                forest.append((int(i), int(j)))
                root[root == root[j]] = root[i]
    return forest


def forests(plan: Plan):
    """For sorted (centre, out, block, inner, node, root, set): links that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in groups(batches, 3):
            sets = [np.frombuffer(s, np.uint64) for s in cols[6].to_pylist()]
            found = links(sets, np.asarray(cols[3]), np.asarray(cols[5]), plan.similarity_pct)
            if found:
                pairs = np.asarray(cols[4])[np.array(found)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["u", "v"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (u, v): alternating large-star and small-star steps until nothing changes.

    Each step is a table, not a checkpoint, as a checkpoint hands its constraints on to the next step's plan.
    """
    e = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")))
    seen = e.agg(mark).first()[0]
    before = made()
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = spread_join(both.filter("v > u"), least, ["u"], "n", 2 * seen[0], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        sweep(e, before)
        settle(e.sparkSession)
        now = e.agg(mark).first()[0]
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _open_groups(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(centre, node, root, outside) of the groups that hold more than one component, without their centres.

    ``outside`` tells the members outside of the group's largest component; all pairs with the centre are done.
    """
    held = members.filter("node <> centre").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = held.groupBy("centre", "root").agg(F.count("*").alias("n"))
    most = parts.groupBy("centre").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    most = cut(most.filter("parts > 1"))
    total = members.count()
    return cut(spread_join(held, most, ["centre"], "n", total, ["node"]).select("centre", "node", "root", (F.col("root") != F.col("most")).alias("outside")))


def _units(members: DataFrame, weight: F.Column, limit: int) -> DataFrame:
    """members (centre, node, outside, ...) dealt to units (out, block): a block of outsiders (inner = 0) and one of all members (inner = 1)."""
    members = members.withColumn("weight", weight)
    blocks = lambda x: F.ceil(F.sum(x) / F.lit(limit)).cast("int")
    sizes = cut(members.groupBy("centre").agg(blocks(F.col("weight")).alias("blocks"), F.coalesce(blocks(F.when(F.col("outside"), F.col("weight"))), F.lit(0)).alias("outs"), F.count("*").alias("n_members")).filter("outs > 0"))
    total = sizes.agg(F.coalesce(F.sum("n_members"), F.lit(0))).first()[0]
    dealt = spread_join(members, sizes, ["centre"], "n_members", total, ["node"])
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    inner = dealt.withColumn("out", F.explode(F.expr("sequence(0, outs - 1)"))).withColumn("block", own("blocks")).withColumn("inner", F.lit(1))
    outer = dealt.filter("outside").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("out", own("outs")).withColumn("inner", F.lit(0))
    return inner.unionByName(outer).drop("weight", "blocks", "outs", "n_members", "outside")


def _by_unit(units: DataFrame, *cols: str) -> DataFrame:
    order = ["centre", "out", "block"]
    return units.select(*order, "inner", "node", "root", *cols).repartition(*order).sortWithinPartitions(*order)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """id, th (a hash of the text), n_shingles, component (smallest id reachable by links, itself included) for every row of df."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text, F.lit(3)).alias("th"))
    rows = cut(docs.select("id", "th", _profile(plan)(F.col("text")).alias("p")).select("id", "th", "p.*"))
    n_rows = rows.count()
    nodes = rows.filter("n > 0").groupBy("h1", "h2", "n", "sig").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    keyed = nodes.select("node", F.explode(_index(plan)(F.col("sig"))).alias("key"))
    buckets = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    n_shared = buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = cut(spread_join(keyed, buckets, ["key"], "n", n_shared, ["node"]).select("node", "key", "n"))
    fame = shared.groupBy("node").agg(F.sum("n").alias("fame"))
    centres = shared.join(fame, "node").groupBy("key").agg((-F.max(F.struct("fame", -F.col("node")))["col2"]).alias("centre"), F.count("*").alias("n"))
    members = cut(spread_join(shared.drop("n"), cut(centres), ["key"], "n", n_shared, ["node"]).select("centre", "node").distinct())

    settle(df.sparkSession)
    # Texts of the nodes that have a group, by one of their rows; further rows of the same id and text are repeats.
    wanted = members.select("node").distinct().join(nodes, "node").select("node", "id", "h1", "h2")
    first = rows.filter("n > 0").groupBy("h1", "h2", F.col("id").alias("rid")).agg(F.min("th").alias("th"))
    wanted = wanted.alias("w").join(first.alias("f"), F.expr("w.h1 = f.h1 AND w.h2 = f.h2 AND w.id <=> f.rid")).select("node", F.col("w.id").alias("wid"), F.col("f.th").alias("wth"))
    wanted = small_side(stored(wanted))
    texts = docs.join(wanted, F.expr("id <=> wid AND th = wth")).select("node", "text").dropDuplicates(["node"])
    sets = stored(texts.select("node", _sets()(F.col("text")).alias("set")))

    settle(df.sparkSession)
    # Stars: every member against its centre.
    star = members.filter("node <> centre").join(nodes.select("node", "n", "sig"), "node")
    counts = cut(members.groupBy("centre").agg(F.count("*").alias("rows")))
    n_members = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hubs = counts.join(nodes.select(F.col("node").alias("centre"), F.col("n").alias("m"), F.col("sig").alias("other")), "centre")
    star = spread_join(star, hubs, ["centre"], "rows", n_members, ["node"])
    star = cut(star.filter(_within(plan)(F.col("sig"), F.col("other"), F.col("n"), F.col("m"))).select("centre", "node"))
    hubs = counts.join(sets.select(F.col("node").alias("centre"), F.col("set").alias("other")), "centre")
    pairs = spread_join(star.join(sets, "node"), hubs, ["centre"], "rows", n_members, ["node"])
    near = cut(pairs.filter(_linked(plan)(F.col("set"), F.col("other"))).select(F.col("node").alias("u"), F.col("centre").alias("v")))
    settle(df.sparkSession)
    roots = cut(components(near))

    # What may still join two components.
    open_ = _open_groups(members, roots)
    units = _units(open_.join(nodes.select("node", "n", "sig"), "node"), F.lit(1), plan.signature_block)
    left = cut(_by_unit(units, "n", "sig").mapInArrow(near_nodes(plan), "centre long, node long").distinct())
    open_ = open_.join(left, ["centre", "node"]).join(nodes.select("node", "n"), "node")
    weight = F.greatest(F.col("n") * 8, F.lit(plan.set_block_bytes // plan.signature_block))  # a block is bounded in bytes and in rows
    units = _units(open_, weight, plan.set_block_bytes).join(sets, "node")
    more = cut(_by_unit(units, "set").mapInArrow(forests(plan), "u long, v long"))
    settle(df.sparkSession)
    if not more.isEmpty():
        roots = components(near.unionByName(more))

    named = roots.join(nodes.select("node", "h1", "h2", "id"), "node")
    smallest = named.groupBy("root").agg(F.min("id").alias("component"))
    named = stored(named.join(smallest, "root").select("h1", "h2", "component"))
    reach = nodes.select("h1", "h2", F.col("id").alias("own"), "copies").join(named, ["h1", "h2"], "left")
    reach = reach.select("h1", "h2", "copies", F.coalesce("component", "own").alias("component"))
    out = spread_join(rows.filter("n > 0"), reach, ["h1", "h2"], "copies", n_rows, ["id", "th"]).select("id", "th", "n", "component")
    out = out.unionByName(rows.filter("n = 0").select("id", "th", "n", F.col("id").alias("component")))
    return out.select("id", "th", F.col("n").alias("n_shingles"), "component")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """The rows of df with the smallest id of each component, once each.

    Rows that repeat id and text count as one. Rows without id give way to a linked row
    with one; among themselves only equal texts are merged.
    """
    got = near_duplicates(df, id_col, text, plan).filter("id <=> component")
    th, kid, kth = unused(df, "_th"), unused(df, "_kid"), unused(df, "_kth")
    kept = got.groupBy(F.col("id").alias(kid), F.when(F.col("id").isNull(), F.col("th")).alias("apart")).agg(F.min("th").alias(kth)).drop("apart")
    rows = df.withColumn(th, F.xxhash64(text, F.lit(3)))
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col(kid)) & (F.col(th) == F.col(kth)), "left_semi")
    return rows.dropDuplicates([id_col, th]).select(*df.columns)
