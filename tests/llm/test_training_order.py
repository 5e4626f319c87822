"""Training order: the permutation, the shards and reads from the middle, against the plain rules."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import training_order as T


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 3000), seed=st.integers(0, 9))
def test_permutation(n, seed):
    got = T.permute(np.arange(n), n, seed)
    assert sorted(got.tolist()) == list(range(n))
    assert T.permute(np.array([n - 1]), n, seed)[0] == got[-1]


def test_order_is_shuffled():
    a, b = T.permute(np.arange(10_000), 10_000, 1), T.permute(np.arange(10_000), 10_000, 2)
    assert abs(np.corrcoef(np.arange(10_000), a)[0, 1]) < 0.05 and (a == b).mean() < 0.01


def rows(spark):
    texts = [(1, None), (2, ""), (3, "abc"), (3, "abc"), (None, "é" * 30), (4, "x" * 64), (5, "y" * 1000)]
    return texts, spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, slot int")


def plain(texts, length):
    out = []
    for i, t in texts:
        ids = [*(t or "").encode(), T.END]
        for k in range(0, len(ids), length):
            part = ids[k : k + length]
            out.append((i, k // length, len(part), tuple(part + [T.PAD] * (length - len(part)))))
    return out


def read(df):
    return [(r.slot, (r.id, r.seq_no, r.n_tokens, tuple(np.frombuffer(r.tokens, "<u2").tolist()))) for r in df.collect()]


def test_shards(spark, tmp_path):
    texts, df = rows(spark)
    layout = T.Layout(length=16, shard_slots=10, shards_per_task=2)
    T.shards(df, layout=layout).write.parquet(str(tmp_path / "s"))
    table = spark.read.parquet(str(tmp_path / "s"))
    want = plain(texts, 16)
    got = sorted(read(T.read_slots(table)), key=lambda x: x[0])
    assert [s for s, _ in got] == list(range(len(want))) and sorted(map(repr, (r for _, r in got))) == sorted(map(repr, want))
    assert sorted(read(T.read_slots(table, 17, 33)), key=lambda x: x[0]) == got[17:33]
    assert {len(r.data) for r in table.collect()} <= {T.HEADER_BYTES + layout.stride * n for n in (10, len(want) % 10)}
    assert all(r.byte_offset == T.HEADER_BYTES + layout.stride * (r.slot % 10) for r in T.read_slots(table).collect())
    again = {r.shard: bytes(r.data) for r in T.shards(df, layout=layout).collect()}
    assert again == {r.shard: bytes(r.data) for r in table.collect()}
    assert T.read_slots(T.shards(df.limit(0), layout=layout)).count() == 0


def test_ids_of_another_vocabulary(spark):
    ids = np.arange(300, 340, dtype="<u2").tobytes()
    df = spark.createDataFrame([(1, bytearray(ids))], "doc_id long, text binary")
    got = read(T.read_slots(T.shards(df, layout=T.Layout(length=16, bytes_per_token=2, end=50_256, pad=0))))
    flat = [t for _, (_, _, n, tokens) in sorted(got, key=lambda x: x[1][1]) for t in tokens[:n]]
    assert flat == [*range(300, 340), 50_256]


def test_broken_shard(spark):
    _, df = rows(spark)
    from pyspark.sql import functions as F

    bad = T.shards(df, layout=T.Layout(length=16)).withColumn("data", F.expr("substring(data, 1, 100)"))
    with pytest.raises(Exception, match="not a whole shard"):
        T.read_slots(bad).collect()


def test_order_does_not_depend_on_packing(spark, tmp_path):
    df = spark.range(400).selectExpr("id AS doc_id", "repeat(cast(id AS string), cast(id % 50 AS int)) AS text")
    df.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", "2000").parquet(str(tmp_path / "d"))
    layout, got = T.Layout(length=16), []
    for size in ("128m", "3k", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            docs = spark.read.parquet(str(tmp_path / "d")).select("doc_id", "text")
            got.append((docs.rdd.getNumPartitions(), sorted(read(T.read_slots(T.shards(docs, layout=layout))))))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({n for n, _ in got}) > 1 and got[0][1] == got[1][1] == got[2][1]


def test_token_ids_of_a_tokenizer_file(spark):
    from vigil.llm.bpe import encode
    from vigil.llm.queries import tokenizer_file

    df = spark.createDataFrame([(1, "some words of a text " * 9), (2, ""), (3, None)], "doc_id long, text string")
    ids = encode(df, tokenizer_file("word_bpe_49k.json"))
    layout = T.Layout(length=16, bytes_per_token=2, end=65_534, pad=65_535)
    got = read(T.read_slots(T.shards(ids.select("doc_id", T.packed("bpe.ids").alias("text")), layout=layout)))
    for r in ids.collect():
        own = sorted((k, tokens[:n]) for _, (i, k, n, tokens) in got if i == r.doc_id)
        assert [t for _, part in own for t in part] == [*r.bpe.ids, 65_534]


def test_ids_of_any_kind(spark):
    rows = [(None, "a"), (T.NO_ID, "b"), (-(1 << 63), "c"), (0, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id for r in T.read_slots(T.shards(df)).collect()} == {i for i, _ in rows}
    names = spark.createDataFrame([("x", "a"), (None, "b"), ("y", "c")], "doc_id string, text string")
    got = [r.id for r in T.read_slots(T.shards(names)).collect()]
    assert len(set(got)) == 3 and None in got
