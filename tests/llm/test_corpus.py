"""Mixing, archives, near duplicates, languages, quality and the pipeline: against SQL, brute force and planted cases."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest

from tests.conftest import SF
from vigil.llm import langid, mixing, near_dup, quality, warc
from vigil.llm.queries import ORACLES, QUERIES, held_out


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(same, name):
    same(QUERIES[name], ORACLES[name])


def odd(spark):
    rows = [(1, None, "a", "en"), (2, "", None, None), (3, "one two three", "a", "en"), (3, "one two three", "a", "en"), (None, "no id here at all", "b", "en"), (4, "w " * 30_000, "b", "en"), (5, " \n\t", "c", None), (6, "x", "é", "fr")]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, lang string, kept int, size int")


# ---- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above a cap is dealt out again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = most * sizes[s]
            left -= most * sizes[s]
        open_ -= above
    return target


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.choice([0, 3, 50, 700]), rnd.choice(["big"] * 12 + ["tiny", "mid", "mid", None, "é"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(mixing.mix(df, block_words=64)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(mixing.mix(df.repartition(7), block_words=64)).collect()))


def test_schedule_is_spread(spark):
    rows = [(i, "w " * 200, "abc"[i % 3]) for i in range(300)]
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=100)
    slots = sorted((r.slot, r.key) for r in plan.schedule.collect())
    half = slots[: len(slots) // 2]
    for k in {k for _, k in slots}:
        share = sum(x == k for _, x in slots) / len(slots)
        assert abs(sum(x == k for _, x in half) / len(half) - share) < 0.03


def test_mix_of_odd_rows(spark):
    df = odd(spark)
    got = mixing.taken(mixing.mix(df)).collect()
    assert len(got) == df.count() and {r.size for r in got if r.id in (1, 2, 5)} == {0}
    assert mixing.taken(mixing.mix(df.limit(0))).count() == 0
    assert all(r.target == 0 and r.taken == 0 for r in mixing.taken(mixing.mix(df.filter("doc_id IN (1, 2, 5)"))).collect())
    df = df.selectExpr("*", "1 AS _times", "2 AS _shuffle", "3 AS _key", "4 AS _nth", "5 AS shuffle")
    out = mixing.repeated(df)
    assert out.columns == df.columns and out.filter("text IS NULL").count() == 0
    assert out.groupBy("doc_id", "text").count().filter("count > 6").count() == 0


# ---- archives


def test_archives(spark):
    rows = [(1, "u", "aa"), (2, "u", "bb"), (3, "u", "aa"), (4, None, None), (5, "u x", ""), (6, "u", "é" * 5000), (6, "u", "é" * 5000), (None, "u", "aa"), (None, "u", "zz")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    bundles = warc.bundle(warc.plan_records(df, "page_id", "url", "html"), frame_bytes=100, bundle_bytes=3000).cache()
    got = warc.read_bundles(bundles).collect()
    assert len(got) == len(rows)
    for r in got:
        body = next((h or "").encode() for i, _, h in rows if str(i) == str(r.id) and (r.id or hashlib.sha1((h or "").encode()).digest() == base64.b32decode(r.payload_digest)))
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == body)
    assert {(r.id, r.refers_to) for r in got if r.record_type == "revisit"} == {("3", "1"), (None, "1"), ("5", "4")}
    some = warc.fetch(bundles, spark.createDataFrame([(2,), (6,)], "id long")).collect()
    assert sorted(r.id for r in some) == ["2", "6", "6"]
    data = bytes(bundles.first().data)
    table = warc.seek_table(data)
    import zstandard

    assert b"".join(warc.read_frame(data, table, i) for i in range(len(table))) == zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert warc.read_bundles(warc.bundle(warc.plan_records(df.limit(0), "page_id", "url", "html"))).count() == 0
    high = warc.read_bundles(warc.bundle(warc.plan_records(df, "page_id", "url", "html", min_revisit_bytes=2))).filter("record_type = 'revisit'").collect()
    assert {r.id for r in high} == {"3", None}


def test_damaged_archives_and_identifiers(spark):
    df = spark.createDataFrame([("", "u", "same"), ("a b/<é>", "u", "other"), (None, "u", "x"), (None, "u", "y"), ("b", None, "same")], "page_id string, url string, html string")
    bundles = warc.bundle(warc.plan_records(df, "page_id", "url", "html"))
    got = warc.read_bundles(bundles).collect()
    assert sorted(map(str, ((r.id, r.refers_to, r.payload_bytes) for r in got))) == sorted(map(str, [("", None, 4), ("a b/<é>", None, 5), (None, None, 1), (None, None, 1), ("b", "", 4)]))
    raw = warc.write_record(warc.record_uri("7"), "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse_record(raw)["payload"] == b"abc"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
    places = set()
    for r in bundles.collect():
        table = warc.seek_table(bytes(r.data))
        places |= {x for x in b"".join(warc.read_frame(bytes(r.data), table, i) for i in range(len(table))).split(b"\r\n") if x.startswith(b"WARC-Record-ID")}
    assert len(places) == 5


# ---- near duplicates


def brute_components(texts):
    def shingled(t):
        w = (t or "").encode().translate(near_dup._LOWER).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingled(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def planted(seed=1, docs=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    shared = [word() for _ in range(60)]
    texts = {}
    for _ in range(docs):
        base = [word() for _ in range(rnd.choice([3, 4, 5, 30, 200]))]
        if rnd.random() < 0.4:
            base += shared
        for _ in range(rnd.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
                copy[rnd.randrange(len(copy))] = word()
            t = " ".join(copy)
            texts[len(texts)] = t.upper() if rnd.random() < 0.2 else t
    return texts


@pytest.mark.parametrize("blocks", [2048, 16])
def test_near_duplicates(spark, blocks):
    texts = planted()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    plan = near_dup.Plan(signature_block=blocks, set_block_bytes=4 << 20 if blocks > 100 else 20_000)
    got = {r.id: (r.n_shingles, r.component) for r in near_dup.near_duplicates(df, plan=plan).collect()}
    assert got == brute_components(texts)
    left = near_dup.one_of_each(df, plan=plan)
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in got.values()})


def test_index_finds_all_within_radius():
    plan, rng = near_dup.Plan(), np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (200, plan.hashes), np.uint16)
    b = a.copy()
    for row in b:
        wrong = rng.choice(plan.hashes, plan.radius, replace=False)
        row[wrong] ^= 1
    ka, kb = near_dup.keys_of(a, plan), near_dup.keys_of(b, plan)
    assert all(set(x) & set(y) for x, y in zip(ka, kb, strict=True))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)], "u long, v long")
    got = {r.node: r.root for r in near_dup.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_near_duplicates_of_odd_rows(spark):
    df = odd(spark)
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == df.count() and all(r.n_shingles == 0 and r.component == r.id for r in got if r.id in (1, 2, 5))
    df = df.selectExpr("*", "1 AS kid", "2 AS kth", "3 AS _kid", "4 AS apart", "5 AS th", "6 AS _th")
    out = near_dup.one_of_each(df)
    assert out.columns == df.columns and out.count() == df.count() - 1
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


# ---- languages


def test_languages(spark):
    from vigil.llm.queries import op9_language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op9_language_id(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out AND length(text) > 40").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    model = langid.train(docs.filter(~held_out()))
    en, fr = (docs.filter(f"lang = '{x}' AND length(text) > 800").first().text[:800] for x in ("en", "fr"))
    shares = dict(model.shares(f"{en} {fr} {fr}"))
    assert set(shares) == {"en", "fr"} and shares["fr"] > shares["en"] > 0.2
    assert model.shares("12 34 !!") == [] and model.shares(None) == []
    assert [x for x, _ in model.shares(en * 40)] == [x for x, _ in model.shares(en)]


def plain_mixture(parts, rounds=25, still=2e-3):
    """Shares by expectation-maximisation, a trigram at a time: parts has each trigram's chance in every language."""
    k = len(parts[0])
    share = [1 / k] * k
    for _ in range(rounds if k > 1 else 0):
        new = [0.0] * k
        for chance in parts:
            whole = sum(s * c for s, c in zip(share, chance, strict=True))
            for j in range(k):
                new[j] += share[j] * chance[j] / whole / len(parts)
        moved = max(abs(a - b) for a, b in zip(new, share, strict=True))
        share = [x / sum(new) for x in new]
        if moved < still:
            break
    return share, sum(math.log(sum(s * c for s, c in zip(share, chance, strict=True))) for chance in parts)


def test_mixture_inference_against_plain_loops():
    rng = np.random.default_rng(7)
    chances = rng.dirichlet(np.full(langid.FEATURES, 0.2), 7).T.astype(np.float32) + np.float32(1e-7)
    model = langid.Model([f"l{i}" for i in range(7)], chances)
    rnd = random.Random(8)
    for n in (3, 20, 120, 300):
        text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 6))) for _ in range(n))
        parts = [[float(c) for c in chances[t]] for t in langid.trigrams(text)]
        weight, _ = plain_mixture(parts)
        order = sorted(range(7), key=lambda i: -weight[i])
        best = None
        for k in range(1, 8):
            share, fit = plain_mixture([[p[i] for i in order[:k]] for p in parts])
            fit -= 1.5 * (k - 1) * math.log(len(parts))
            if best and fit <= best[0]:
                break
            best = (fit, share, order[:k])
        want = sorted(((f"l{i}", s) for i, s in zip(best[2], best[1], strict=True)), key=lambda x: -x[1])
        got = model.shares(text)
        assert [x for x, _ in got] == [x for x, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-3)


def test_any_number_of_languages(spark):
    letters_of = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "αβγδ", "εζηθ"]
    rnd = random.Random(1)
    text = lambda k, n: " ".join("".join(rnd.choice(letters_of[k]) for _ in range(4)) for _ in range(n))
    rows = [(k * 100 + i, text(k, 60), f"l{k}") for k in range(8) for i in range(20 + k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.train(df).shares(" ".join(text(k, 200) for k in range(8)))
    assert {x for x, _ in got} == {f"l{k}" for k in range(8)} and all(abs(s - 1 / 8) < 0.02 for _, s in got)
    assert langid.train(df, most_languages=3).languages == ["l5", "l6", "l7"]


def test_languages_of_odd_rows(spark):
    df = odd(spark)
    model = langid.train(df)
    got = {(r.doc_id, r.text): r.language for r in langid.predict(df, model).collect()}
    assert got[(1, None)].lang == got[(2, "")].lang == got[(5, " \n\t")].lang == "und" and got[(1, None)].score == 0
    assert all(0 <= x.score <= 1 for x in got.values())
    none = langid.train(df.filter("lang IS NULL"))
    assert {r.language.lang for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


# ---- quality


def letters(i, n=40):
    """n words of their own for each i, without digits (which count as 0)."""
    return " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n))


def test_line_frequency(spark):
    menu = "\n".join(f"menu item number {k} of many" for k in range(5))
    rows = [(i, f"Share this 12\n{letters(i)}", "h") for i in range(30)] + [(100, "SHARE  this 34\n" + "Subscribe now\n" + "a b c d e f g h i j k l m n o p q", "h")]
    rows += [(200, menu, "h")] + [(300 + i, f"{menu}\nend {letters(i, 4)}", "h") for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert all(got[i].kept for i in range(30)) and got[100].kept
    assert not any(got[i].kept for i in (200, *range(300, 325)))
    copies = spark.createDataFrame([(i, f"{letters(1, 15)}\n{letters(2)}", "h") for i in range(50)], "doc_id long, text string, source string")
    assert quality.judge(copies).filter("kept").count() == 50
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == [*range(30), 100]


@pytest.mark.parametrize("words", [30, 40, 60, 3000])
def test_long_lines_are_counted_too(spark, words):
    footer = letters(650, words)
    rows = [(i, f"{footer}\n{letters(i, 5)}", "small") for i in range(60)] + [(100 + i, f"{letters(i, 2 * words)}\n{footer}", "mixed") for i in range(60)]
    rows += [(200 + i, f"{footer}\n{letters(i, 5)}", "other") for i in range(19)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in quality.judge(df).filter("kept").collect()) == [*range(100, 160), *range(200, 219)]
    assert {r.doc_id: r.text for r in quality.keep_good(df).collect()} == {i: letters(i - 100, 2 * words) if i < 200 else t for i, t, _ in rows if i >= 100}


def test_hot_lines_and_texts(spark):
    rows = [(i, f"common line\n{letters(i % 600, 30)}", "h") for i in range(3000)] + [(5000 + i, f"common line\n{letters(650, 25)}", "h") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in quality.keep_good(df).collect()} == {i: t.split("\n")[1] for i, t, _ in rows}
    assert quality.judge(df).filter("kept AND n_words IN (32, 27)").count() == 6000


def test_frequent_lines_leave_the_text(spark):
    body = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(25))
    rows = [(i, f"Share this {i}\n{body(i)}\n\n{body(i + 500)}\nSHARE  this 7", "h", i) for i in range(30)]
    rows += [(i + 100, f"Share this {i}\n{body(i)}", "other", i) for i in range(15)] + [(0, rows[0][1], "h", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    got = sorted(tuple(r) for r in quality.keep_good(df).collect())
    assert got == sorted((i, f"{body(i)}\n\n{body(i + 500)}" if h == "h" else t, h, k) for i, t, h, k in rows)


def test_quality_of_odd_rows(spark):
    df = odd(spark)
    got = quality.judge(df).collect()
    assert len(got) == df.count() and all(r.base_failed and not r.kept for r in got if r.doc_id != 4)
    assert next(r for r in got if r.doc_id == 4).n_repeat_words == 30_000
    assert quality.judge(df.limit(0)).count() == 0 and quality.keep_good(df).columns == df.columns


# ---- together


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] and P.ORACLE_SQL is None
    a = P.language(spark, docs, SF).cache()
    assert a.columns == docs.columns and a.count() >= 0.97 * docs.count()
    b = P.good_text(spark, a, SF).cache()
    kept = quality.judge(a).filter("kept").select("doc_id")
    assert b.columns == docs.columns and sorted(r[0] for r in b.select("doc_id").collect()) == sorted(r[0] for r in kept.collect())
    c = P.distinct_text(spark, b, SF).cache()
    want = {x for _, x in brute_components({r.doc_id: r.text for r in b.collect()}).values()}
    assert sorted(r.doc_id for r in c.collect()) == sorted(want)
    d = P.mixed(spark, c, SF).cache()
    times = {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()}
    planned = {r.id: round(r.taken / r.size) for r in mixing.taken(mixing.mix(c)).filter("size > 0").collect()}
    assert d.columns == docs.columns and set(times) <= set(planned) and all(abs(times.get(i, 0) - n) <= 1 for i, n in planned.items())
    e = P.encoded(spark, d, SF).collect()
    assert len(e) == sum(times.values()) and all(r.n_tokens == len(r.ids) for r in e)


def plain_language(model, text):
    """The largest share of a text's languages, by the same method on counts of trigrams."""
    found, times = np.unique(langid.trigrams(text or "", len(model.chances)), return_counts=True)
    n = times.sum()
    if not n:
        return None, 0.0
    table = model.chances[found].astype(np.float64)

    def fit(cols):
        share = np.full(len(cols), 1 / len(cols))
        for _ in range(25 if len(cols) > 1 else 0):
            new = share * ((times / (table[:, cols] @ share)) @ table[:, cols]) / n
            moved, share = np.abs(new - share).max(), new / new.sum()
            if moved < 2e-3:
                break
        return share, float((np.log(table[:, cols] @ share) * times).sum()) - 1.5 * (len(cols) - 1) * math.log(n)

    order = np.argsort(-fit(list(range(table.shape[1])))[0], kind="stable").tolist()
    best = fit(order[:1])
    for k in range(2, len(order) + 1):
        got = fit(order[:k])
        if got[1] <= best[1]:
            break
        best = got
    i = int(best[0].argmax())
    return model.languages[order[i]], float(best[0][i])


def plain_quality(rows, line_docs=20):
    """doc_id, text without frequent lines and source of what the quality rules keep."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    norm = lambda line: re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(words(line))))
    seen = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if words(line):
                seen.setdefault((s, norm(line)), set()).add(t)
    out = []
    for i, t, s in rows:
        w = words(t or "")
        windows = {}
        for k in range(len(w) - 7):
            windows.setdefault(tuple(w[k : k + 8]), []).append(k)
        again = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(8)}
        if len(w) < 20 or 100 * len(again) > 30 * len(w):
            continue
        left = [x for x in t.split("\n") if not words(x) or len(seen[s, norm(x)]) < line_docs]
        n = len(words("\n".join(left)))
        if n >= 8 and 100 * n >= 30 * len(w):
            out.append((i, "\n".join(left), s))
    return out


def plain_mix(rows, block=4096, period=1_836_311_903, step=1_134_903_170):
    """How often each doc_id is given, slot by slot of the schedule."""
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    streams = {}
    for i, t, s in rows:
        streams.setdefault(s, []).append((digest(f"7|{i}|{digest(t)}"), i, len(re.findall(r"[^\x20\x09-\x0D]+", t))))
    order = sorted(streams, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for *_, n in streams[s]) for s in order}
    target = brute_targets(size)
    take = {s: min(round(target[s]), 3 * size[s]) for s in order}
    total, before, hits = sum(take.values()), 0, {}
    slots = -(-total // block)
    points = [i * step % period for i in range(slots)]
    for s in order:
        lo, hi = (math.floor(x / total * period) for x in (before, before + take[s]))
        hits[s] = [i for i, x in enumerate(points) if lo <= x < hi]
        before += take[s]
    times = {}
    for s in order:
        blocks, passes, rest = -(-size[s] // block), take[s] // size[s], take[s] % size[s]
        taken = {}
        for rank in range(passes * blocks + -(-rest // block)):  # make-up slots fill what the lattice lacks
            end, lo = (size[s] if rank // blocks < passes else rest), rank % blocks * block
            at = 0
            for _, i, n in sorted(streams[s]):
                taken[i] = taken.get(i, 0) + max(0, min(at + n, lo + block, end) - max(at, lo))
                at += n
        assert len(hits[s]) > 0 or not take[s] or take[s] < total / 8
        times |= {i: math.floor(taken[i] / n + 0.5) for _, i, n in streams[s] if n}
    return {i: k for i, k in times.items() if k}


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as P
    from tokenizers import Tokenizer
    from vigil.llm.queries import tokenizer_file

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = P.run(spark, SF).collect()
    model = langid.train(docs.select("doc_id", "text", "lang"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if plain_language(model, r.text)[1] >= 0.5]
    rows = plain_quality(rows)
    first = {i: c for i, (_, c) in brute_components({i: t for i, t, _ in rows}).items()}
    rows = [r for r in rows if first[r[0]] == r[0]]
    times, text = plain_mix(rows), {i: t for i, t, _ in rows}
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    want = []
    for i, k in times.items():
        ids = tok.encode(text[i], add_special_tokens=False).ids
        want += [(i, len(ids), tuple(ids), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] * k
    assert sorted((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in got) == sorted(want)


def test_stages_take_odd_rows(spark):
    import corpus_pipeline as P

    good = [(100 + i, letters(i, 40) if i != 3 else letters(2, 40), None if i % 5 == 0 else "s", "en") for i in range(30)]
    base = odd(spark)
    df = base.unionByName(spark.createDataFrame([(*r, 1, 2) for r in good], base.schema)).selectExpr("*", "7 AS n_chars", "'x' AS _key", "'y' AS host", "1 AS _times", "2 AS th")
    for rows in (df, df.limit(0)):
        out = rows
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, out, SF)
            assert i == len(P.STAGES) - 1 or out.columns == df.columns
        ids = [r.doc_id for r in out.collect()]
        assert not ids if rows is not df else set(ids) and set(ids) <= set(range(100, 130)) and 103 not in ids


def test_all_operators_are_registered():
    import __spark_entry__ as E

    names = E.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(E.oracle_sql()) <= set(names)
