"""The registered queries of this subpackage: thin digests over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.bpe import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = encode(docs, tokenizer_file("word_bpe_49k.json"))
    return got.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("bpe.ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.html_text import extract_text

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.mixing import mix, taken

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return taken(mix(docs)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot", "n_slots")


OP3_SQL = """
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS size,
         md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS shuffle
  FROM documents),
by_source AS (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
ranked AS (
  SELECT key, source_size, row_number() OVER (ORDER BY key) - 1 AS nth, [5, 2, 1][(row_number() OVER (ORDER BY key) - 1) % 3 + 1]::BIGINT AS weight
  FROM by_source),
ratios AS (SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS ratio FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM ratios WINDOW w AS (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fixed AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, key LIMIT 1),
goals AS (
  SELECT key, nth, source_size, least(cap::DOUBLE, weight * (SELECT level FROM fixed)) AS target FROM levels),
whole AS (SELECT *, least(round(target)::BIGINT, source_size * 3) AS take FROM goals),
streams AS (
  SELECT s.key, s.doc_id, s.size, w.source_size, w.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.key ORDER BY s.shuffle, s.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM sized s JOIN whole w USING (key)),
placed AS (
  SELECT key, nth, source_size, take, (sum(take) OVER ())::BIGINT AS total,
         coalesce(sum(take) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM whole WHERE take > 0),
stretches AS (
  SELECT *, floor(before::DOUBLE / total * 1836311903)::BIGINT AS lo, floor((before + take)::DOUBLE / total * 1836311903)::BIGINT AS hi,
         (source_size + 4095) // 4096 AS blocks, take // source_size AS passes, take % source_size AS rest,
         take // source_size * ((source_size + 4095) // 4096) + (take % source_size + 4095) // 4096 AS ranks
  FROM placed),
slots AS (SELECT coalesce(max((total + 4095) // 4096), 0)::BIGINT AS n FROM placed),
points AS (SELECT i AS slot, i * 1134903170 % 1836311903 AS x FROM (SELECT unnest(range((SELECT n FROM slots))) AS i)),
hits AS (
  SELECT slot, key, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS rank
  FROM points JOIN stretches ON x >= lo AND x < hi),
extra AS (
  SELECT (SELECT n FROM slots) + (r - have) * (SELECT max(nth) + 1 FROM whole) + nth AS slot, key, r AS rank
  FROM (SELECT key, nth, coalesce(n, 0) AS have, unnest(range(coalesce(n, 0), ranks)) AS r
        FROM stretches LEFT JOIN (SELECT key, count(*) AS n FROM hits GROUP BY key) USING (key))),
schedule AS (
  SELECT key, slot, rank % blocks AS block, rank % blocks * 4096 AS from_word,
         least((rank % blocks + 1) * 4096, CASE WHEN rank // blocks < passes THEN source_size ELSE rest END) AS to_word
  FROM (SELECT key, slot, rank FROM hits UNION ALL SELECT key, slot, rank FROM extra) JOIN stretches USING (key)
  WHERE rank < ranks),
parts AS (
  SELECT key, doc_id, slot, least(pos + size, to_word) - greatest(pos, from_word) AS words
  FROM (SELECT *, unnest(range(pos // 4096, (pos + size - 1) // 4096 + 1)) AS block FROM streams WHERE size > 0) JOIN schedule USING (key, block)
  WHERE least(pos + size, to_word) > greatest(pos, from_word)),
got AS (SELECT key, doc_id, sum(words)::BIGINT AS taken, min(slot)::BIGINT AS first_slot, count(*)::BIGINT AS n_slots FROM parts GROUP BY key, doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM streams LEFT JOIN got USING (key, doc_id)
"""


def op4_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.jpeg import load, store

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = load(store(docs), pixels=True)
    size = F.format_string("%dx%d rgb=%.3f,%.3f,%.3f", "contents.width", "contents.height", *[F.col("contents.means")[i] for i in range(3)])
    return got.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.octet_length("contents.payload").cast("long").alias("payload_bytes"),
        F.sha2("contents.payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(contents.payload, -16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(size, F.lit(" md5="), F.md5("contents.rgb")).alias("feature"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    from vigil.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_file("byte_bpe_50k.json")).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.common import new_folder
    from vigil.llm.warc import bundle, plan_records, read_bundles

    where = new_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    bundle(plan_records(pages, "page_id", "url", "html")).write.parquet(where)
    return read_bundles(spark.read.parquet(where)).select(
        F.col("id").try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
    )


OP6_SQL = """
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first
  FROM pages),
quintets AS (
  SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::INTEGER) AS q FROM bodies)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM quintets
"""


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.near_dup import near_duplicates

    got = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


OP7_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ \t\n\x0B\f\r]+') AS words
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM docs WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id, s.n
"""


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.common import new_folder
    from vigil.llm.training_order import read_slots, shards

    where = new_folder(spark, "shards")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards(docs).write.option("compression", "zstd").parquet(where)
    return read_slots(spark.read.parquet(where)).select(F.col("id").alias("doc_id"), "seq_no", "slot", "shard", "byte_offset", "n_tokens", F.md5("tokens").alias("tokens_md5"))


def op8_sql(seed: int = 17) -> str:
    """The same rounds over the same numbers, for documents in the order of their ids (as the tables are)."""
    from vigil.llm.training_order import PRIME, round_keys

    keys = ", ".join(f"{{'l': 0::BIGINT, 'r': 0::BIGINT, 'a': {a}::BIGINT, 'b': {b}::BIGINT, 'c': {c}::BIGINT}}" for a, b, c in round_keys(seed))
    mixed = f"((st.r % {PRIME} * rk.a + rk.b) % {PRIME})"

    def rounds(x: str) -> str:
        start = f"{{'l': ({x} >> bits)::BIGINT, 'r': ({x} & mask)::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT, 'c': 0::BIGINT}}"
        step = f"{{'l': st.r, 'r': xor(st.l, (({mixed} * {mixed} + rk.c) % {PRIME}) & mask), 'a': 0::BIGINT, 'b': 0::BIGINT, 'c': 0::BIGINT}}"
        done = f"list_reduce([{start}, {keys}], lambda st, rk: {step})"
        return f"(({done}).l << bits) | ({done}).r"

    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
numbered AS (
  SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base,
         (sum(n) OVER ())::BIGINT AS total
  FROM (SELECT *, (length(h) // 2 + 1024) // 1024 AS n FROM docs)),
seqs AS (SELECT doc_id, n, total, unnest(range(n)) AS k, base, h FROM numbered),
sized AS (
  SELECT *, base + k AS idx, greatest(1, (length(bin(greatest(1, total - 1))) + 1) // 2)::INTEGER AS bits,
         (1::BIGINT << greatest(1, (length(bin(greatest(1, total - 1))) + 1) // 2)::INTEGER) - 1 AS mask
  FROM seqs),
walk AS (
  SELECT idx, total, bits, mask, {rounds("idx")} AS x FROM sized
  UNION ALL SELECT idx, total, bits, mask, {rounds("x")} FROM walk WHERE x >= total),
parts AS (SELECT doc_id, k, n, x AS slot, substr(h, k * 2048 + 1, 2048) AS part FROM sized JOIN walk USING (idx) WHERE x < walk.total)
SELECT doc_id, k::INTEGER AS seq_no, slot::BIGINT AS slot, (slot // 4096)::BIGINT AS shard, (32 + slot % 4096 * 2064)::BIGINT AS byte_offset,
       (length(part) // 2 + (k = n - 1)::INTEGER)::INTEGER AS n_tokens,
       md5(unhex(regexp_replace(part, '(..)', '\\100', 'g') || CASE WHEN k = n - 1 THEN '0001' ELSE '' END
           || repeat('0101', (1024 - length(part) // 2 - (k = n - 1)::INTEGER)::INTEGER))) AS tokens_md5
FROM parts
"""


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.langid import predict, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    got = predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.quality import judge

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])


OP10_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS host,
         regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS words
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, text, line, regexp_extract_all(line, '[^ \t\n\x0B\f\r]+') AS parts
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM docs)),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE len(parts) > 0 GROUP BY doc_id),
marked AS (
  SELECT doc_id, host, text, len(parts) AS n,
         translate(array_to_string(parts, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm
  FROM lines WHERE len(parts) > 0),
often AS (SELECT host, norm FROM marked GROUP BY host, norm HAVING count(DISTINCT text) >= 20),
removed AS (SELECT doc_id, sum(n) AS n FROM marked SEMI JOIN often USING (host, norm) GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         coalesce(removed.n, 0) AS gone
  FROM docs d LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND n_words - gone >= 8 AND 100 * (n_words - gone) >= 30 * n_words AS kept
FROM measured
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_html_text": op2_html_text,
    "op3_source_mix": op3_source_mix,
    "op4_media_jpeg": op4_media_jpeg,
    "op5_token_counts": op5_token_counts,
    "op6_warc_bundles": op6_warc_bundles,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_training_order": op8_training_order,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {
    "op3_source_mix": OP3_SQL,
    "op6_warc_bundles": OP6_SQL,
    "op7_near_duplicates": OP7_SQL,
    "op8_training_order": op8_sql(),
    "op10_quality_rules": OP10_SQL,
}
