"""Encoding, token counts, pages and media: against the libraries, brute force and exact round trips."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import bpe, html_text, jpeg, token_counts
from vigil.llm.queries import tokenizer_file

WORD, BYTE = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
ALPHABET = ["a", "b", "th", "er", " ", "é", "é", "'s", "'", "1", "23", "<|endoftext|>", "<|", "!!", " \n", "中", "文", "。", " ", "İ", "ς", "한", "ᄒ", "ᅡ", "😀", "\t", "\x1c", "x" * 30, "=" * 90, "the", "ing"]
pieces = st.lists(st.sampled_from(ALPHABET), max_size=120).map("".join)


def odd_rows(spark, extra="text string"):
    long = "lorem ipsum dolor " * 9000 + "x" * 90_000
    rows = [(1, None), (2, ""), (3, "plain text"), (3, "plain text"), (None, "no id"), (4, long), (5, " \n\t"), (6, "<|endoftext|> é 中文")]
    return spark.createDataFrame([(a, b, "x", "y", 7) for a, b in rows], f"doc_id long, {extra}, bpe string, n_tokens string, media int")


@pytest.fixture(scope="module")
def small_encoder():
    return bpe.TreeEncoder(WORD, leaf_chars=40)


@settings(max_examples=300, deadline=None)
@given(text=pieces)
def test_tree_equals_library(small_encoder, text):
    got = np.frombuffer(small_encoder.encode(text), np.int32).tolist()
    assert got == small_encoder.tok.encode(text, add_special_tokens=False).ids
    assert small_encoder.decode(np.array(got, np.int32)) == small_encoder.tok.decode(got, skip_special_tokens=False)


@pytest.mark.parametrize("run", ["a" * 20_001, "ab" * 9000, "=" * 30_000, "abcdefgh" * 3000, "1a=" * 9000, "中文" * 9000])
def test_unsplit_runs(run):
    e = bpe.TreeEncoder(WORD, leaf_chars=512)
    assert np.frombuffer(e.encode(run), np.int32).tolist() == e.tok.encode(run, add_special_tokens=False).ids


def test_symbol_joins_on_random_words():
    e, rnd = bpe.TreeEncoder(WORD, leaf_chars=6), random.Random(3)
    for _ in range(300):
        w = "".join(rnd.choice("aenrstioh") for _ in range(rnd.randint(1, 120)))
        assert [i for i, _ in e._symbols(w, 0, len(w))] == e.tok.encode(w, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(text=st.lists(st.sampled_from([*ALPHABET, "x" * 90, "=" * 200, "ab" * 60]), max_size=60).map("".join))
def test_units_apart_equal_library(small_encoder, text):
    e = small_encoder
    units = [(*u, *e.unit(u[3], u[4])) for u in e.units(text)]
    assert np.frombuffer(e.join_units(units), np.int32).tolist() == e.tok.encode(text, add_special_tokens=False).ids
    assert all(len(u[4]) <= e.leaf_chars for u in units if u[3] != bpe.RUN)


def test_an_unsplit_run_is_spread(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    runs = ["".join(rnd.choice("abcdefgh") for _ in range(300_000)), "<|endoftext|>" + "é=" * 50_000]
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    units = bpe.spread_units(df, WORD, "text").filter(f"kind = {bpe.OPEN}").withColumn("task", F.spark_partition_id())
    assert units.filter("c0 = 0").select("task").distinct().count() > 1 and units.filter("c0 = 0").count() > 60
    tok = bpe.TreeEncoder(WORD).tok
    for r in bpe.encode(df, WORD).collect():
        assert r.text == runs[r.doc_id] and r.bpe.ids == tok.encode(r.text, add_special_tokens=False).ids


def test_encode_column(spark):
    df = odd_rows(spark)
    rows = bpe.encode(df, WORD, spread_chars=1000, leaf_chars=500).collect()
    tok = bpe.TreeEncoder(WORD).tok
    assert len(rows) == df.count() and set(rows[0].asDict()) == {*df.columns}
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.bpe.ids == ids and r.bpe.decoded == tok.decode(ids, skip_special_tokens=False)
    assert sorted(str(r.text) for r in rows) == sorted(str(r.text) for r in df.collect())
    assert bpe.encode(df.limit(0), WORD).count() == 0


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(pieces, max_size=4))
def test_counts_equal_library(texts):
    c = token_counts.counter(BYTE, 64)
    assert c.count(texts) == [len(c.model.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_column(spark):
    rows = token_counts.count_tokens(odd_rows(spark), BYTE).collect()
    c = token_counts.Counter(BYTE)
    assert all(r.n_tokens == len(c.model.encode(r.text or "", add_special_tokens=False).ids) for r in rows)
    pieces_file = token_counts.Counter(tokenizer_file("piece_bpe_32k.model"))
    assert pieces_file.count(["a b", None, ""]) == [len(pieces_file.model.encode("a b")), 0, 0]
    assert token_counts.count_tokens(odd_rows(spark).limit(0), BYTE).count() == 0


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href=/>Home</a> Site</header><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Buy this now</div>
{0}
<aside>Side</aside><div id="cookie-notice">We use cookies</div><form><input><p>Sign up</p></form>
<section class="comments"><h2>Comments</h2><p>Really great post, I read it all and I liked it very much indeed.</p></section><footer>&copy; x</footer></body></html>"""
ARTICLE = "<h1>Title &eacute;</h1><p><b>One two.<br><p>Another  para\n<a href='x'>link</a> &lt;b&gt;.</p><p>Short.</p><ul><li>x<li>y</ul>"
TEXT = "Title é\nOne two.\nAnother para link <b>.\nShort.\nx\ny"


def test_articles():
    assert html_text.extract(PAGE.format(f"<article>{ARTICLE}</article>")) == TEXT
    assert html_text.extract(PAGE.format(f"<main>{ARTICLE}</main>")) == TEXT
    filler = "".join(f"<p>Sentence number {i} of the long body of this page.</p>" for i in range(8))
    got = html_text.extract(PAGE.format(f"<div class=story>{ARTICLE}{filler}</div>"))
    assert got == TEXT + "".join(f"\nSentence number {i} of the long body of this page." for i in range(8))


def test_what_stands_beside_an_article():
    lines = [[f"Sentence number {i} of part {k}, long enough to be one." for i in range(9)] for k in range(3)]
    parts = "".join("<article>" + "".join(f"<p>{x}</p>" for x in part) + "</article>" for part in lines)
    linked = "<div><a href=/x>More</a> <a href=/y>news</a></div>"
    got = html_text.extract(PAGE.format(f"<main><h1>Head</h1>{parts}{linked}</main>"))
    assert got == "\n".join(["Head", *sum(lines, [])])


LINES = [f"Sentence number {i} of the body, which is long enough to be text." for i in range(6)]
BODY = "<h1>Head</h1>" + "".join(f"<p>{x}</p>" for x in LINES)
MENU = "<div><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{MENU}<div class='layout sidebar-right'><article>{BODY}</article></div><footer>x</footer>",
        f"<body><form id='aspnetForm'>{MENU}<article>{BODY}</article><footer>f</footer></form>",
        f"<body>{MENU}<article><div class='post social-science'>{BODY}</div></article>",
        f"<body>{MENU}<article>{BODY.replace('<p>Sentence number 2', '<p id=comment-on-law>Sentence number 2')}</article>",
        f"<body>{MENU}<article>{BODY}<div><a href=/1>More</a> | <a href=/2>news</a></div></article>",
        f"<body>{MENU}<div>{BODY}</div><div>All rights reserved, 2020</div>",
        f"<body><div>{MENU}<div><div>{BODY}</div></div><div><a href=/1>One more thing</a> <a href=/2>And another one</a></div></div>",
        f"<body>{MENU}<article>{BODY}<section class=comments>{''.join(f'<p>Reader {i} says that this was a good text.</p>' for i in range(9))}</section></article>",
    ],
)
def test_marks_weigh_and_density_decides(page):
    assert html_text.extract(page) == "\n".join(["Head", *LINES])


def test_headings_with_unlucky_ids():
    page = f"<body>{MENU}<article>{BODY}<h2 id='related-work'>Related work</h2><p>A few words.</p></article>"
    assert html_text.extract(page) == "\n".join(["Head", *LINES, "Related work", "A few words."])


def test_without_density_the_result_is_another(monkeypatch):
    page = f"<body>{MENU}<div>{BODY}</div><div>All rights reserved, 2020</div>"
    assert html_text.extract(page) == "\n".join(["Head", *LINES])
    monkeypatch.setattr(html_text, "density", lambda *a: 1.0)
    assert html_text.extract(page) != "\n".join(["Head", *LINES])


def test_densities_against_the_plain_formula():
    """Counts by walking below every node, then the formula and the choice of the largest sum."""
    rnd = random.Random(2)
    tags = ["div", "p", "a", "ul", "li", "nav", "section", "b", "div class=ad", "div class=social-science", "script"]

    def markup(depth):
        out = rnd.choice(["", "word ", "some more words of text, "]) * rnd.randint(0, 9)
        for _ in range(rnd.randint(0, 4) if depth < 5 else 0):
            t = rnd.choice(tags)
            out += f"<{t}>{markup(depth + 1)}</{t.split()[0]}>"
        return out

    def shown(n):
        return [k for k in n.kids if type(k) is not str and not k.dropped]

    def below(n):
        return [x for k in shown(n) for x in (k, *below(k))]

    def chars(n):
        return sum(len(k.strip()) for x in (n, *below(n)) for k in x.kids if type(k) is str)

    def shade(n):
        own = 1.0 if n.tag == "a" or n.mark == html_text.STRONG else 0.5 if n.mark == html_text.WEAK else 0.0
        return max(own, shade(n.parent)) if n.parent else own

    def linked(n):
        return sum(len(k.strip()) * shade(x) for x in (n, *below(n)) for k in x.kids if type(k) is str)

    for _ in range(60):
        root, nodes = html_text.parse(f"<body>{markup(0)}")
        html_text.measure(nodes)
        part = linked(root) / max(1, chars(root))
        for n in (x for x in nodes if not x.dropped):
            c, t, lc, lt = chars(n), max(1, len(below(n))), linked(n), sum(map(shade, below(n)))
            want = 0.0
            if c and (ratio := c / max(1, lc) * t / min(t, max(1, lt))) > 1:
                base = np.log(c / max(1, c - lc) * lc + part * c + np.e)
                want = c / t * np.log(ratio) / max(1.0, np.log(base))
            assert n.density == pytest.approx(want)
            assert n.sum == pytest.approx(sum(k.density for k in shown(n)))


def test_only_names_of_attributes_count():
    assert html_text.extract("""<p title="the hidden truth">a<p data-x='class="nav"'>b<p title=">" hidden>c<p title='x' class="nav">d""") == "a\nb"


def test_odd_pages(spark):
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<script>x") == ""
    assert html_text.extract("plain &amp; <b>bold") == "plain & bold"
    assert html_text.extract("<div>" * 3000 + "deep") == "deep"
    assert html_text.extract("<p>a<p hidden>b<p style='display: none'>c<p>d") == "a\nd"
    assert html_text.extract("a<!-- x <p>y</p> --><br>b") == "a b"
    df = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (2, PAGE.format(f"<article>{ARTICLE}</article>"), "t")], "page_id long, html string, text string")
    assert sorted(r.text for r in html_text.extract_text(df).collect()) == ["", "", TEXT]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_pages_of_the_tables(spark):
    from tests.conftest import SF
    from vigil.llm.queries import op2_html_text

    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op2_html_text(spark, SF).collect():
        inner = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        parts = [" ".join(html_text.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)[^>]*>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


# ---- media


def write_scan(coefs, dims, script):
    """Progressive JPEG of sparse coefficients by the plain rules: one code of eight bits for each symbol."""
    table = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\0" + b"\2" * 64)]
    h, w, comps = dims
    out.append(jpeg._segment(0xC2, struct.pack(">BHHB", 8, h, w, len(comps)) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(comps))))
    out.append(jpeg._segment(0xC4, b"\0" + table + b"\x10" + table))
    image = jpeg.Image()
    image.frame(struct.pack(">BHHB", 8, h, w, len(comps)) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(comps)))
    parts = list(image.components.values())
    for which, first, last, high, low in script:
        bits = []
        put = lambda v, n: bits.extend(v >> i & 1 for i in range(n - 1, -1, -1))
        value = lambda v: (put(v.bit_length(), 8), put(v, v.bit_length())) if v > 0 else (put((-v).bit_length(), 8), put(v + (1 << (-v).bit_length()) - 1, (-v).bit_length()))
        if first == 0:
            units = jpeg._interleaved([parts[i] for i in which]) if len(which) > 1 else [np.array([[y * parts[which[0]].wide + x] for y in range(parts[which[0]].own_tall) for x in range(parts[which[0]].own_wide)])]
            last_dc = [0] * len(which)
            for u in range(len(units[0])):
                for k, i in enumerate(which):
                    for b in units[k][u]:
                        dc = int(coefs[i][b, 0])
                        if high:
                            put(dc >> low & 1, 1)
                        else:
                            value((dc >> low) - last_dc[k])
                            last_dc[k] = dc >> low
        else:
            c = parts[which[0]]
            for b in (y * c.wide + x for y in range(c.own_tall) for x in range(c.own_wide)):
                row = [(abs(int(v)) >> low) * (1 if v > 0 else -1) for v in coefs[which[0]][b]]
                old = [abs(int(v)) >> high != 0 if high else False for v in coefs[which[0]][b]]
                k, run, fixes = first, 0, []
                end = max((j for j in range(first, last + 1) if row[j] and not old[j]), default=-1)
                while k <= last:
                    if k > end:
                        put(0, 8)
                        fixes += [abs(row[j]) & 1 for j in range(k, last + 1) if old[j]]
                        bits.extend(fixes)
                        fixes = []
                        break
                    if old[k]:
                        fixes.append(abs(row[k]) & 1)
                    elif not row[k]:
                        run += 1
                        if run == 16:
                            put(0xF0, 8)
                            bits.extend(fixes)
                            run, fixes = 0, []
                    elif high:
                        put(run << 4 | 1, 8)
                        put(row[k] > 0, 1)
                        bits.extend(fixes)
                        run, fixes = 0, []
                    else:
                        n = abs(row[k]).bit_length()
                        put(run << 4 | n, 8)
                        put(row[k] if row[k] > 0 else row[k] + (1 << n) - 1, n)
                        run = 0
                    k += 1
        out += [jpeg._sos(tuple(i + 1 for i in which), first, last, high, low), jpeg._packed(np.array(bits, np.uint8))]
    return b"".join([*out, b"\xff\xd9"]), parts


@pytest.mark.parametrize("dims", [(16, 24, [(1, 1)]), (20, 37, [(2, 2), (1, 1), (1, 1)]), (16, 16, [(2, 1), (1, 1), (1, 1)])])
def test_general_progressive(dims):
    rng = np.random.default_rng(5)
    image = jpeg.Image()
    image.frame(struct.pack(">BHHB", 8, dims[0], dims[1], len(dims[2])) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(dims[2])))
    coefs = []
    for c in image.components.values():
        held = rng.integers(-40, 40, c.coef.shape) * (rng.random(c.coef.shape) < 0.15)
        inside = np.zeros(len(held), bool)
        inside[(np.arange(c.own_tall)[:, None] * c.wide + np.arange(c.own_wide)).reshape(-1)] = True
        held[~inside, 1:] = 0
        coefs.append(held)
    every = tuple(range(len(coefs)))
    script = [(every, 0, 0, 0, 1), *[((i,), a, b, 0, 2) for i in every for a, b in ((1, 5), (6, 63))], *[((i,), 1, 63, 2, 1) for i in every], (every, 0, 0, 1, 0), *[((i,), 1, 63, 1, 0) for i in every]]
    data, parts = write_scan(coefs, dims, script)
    got = jpeg.decode(data)
    for c, want in zip(got.components.values(), coefs, strict=True):
        assert (c.coef == want).all()
    rgb = got.rgb()
    assert rgb.shape == (dims[0], dims[1], 3)
    y = got.components[1]
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = y.coef[0] * 2
    want = np.rint(basis @ block.reshape(8, 8) @ basis.T + 128).clip(0, 255)
    if len(coefs) == 1:
        assert np.abs(rgb[:8, :8, 0].astype(int) - want).max() <= 1


@settings(max_examples=60, deadline=None)
@given(data=st.binary(max_size=3000))
def test_media_round_trip(data):
    payload = data + b" " * (-len(data) % 192 if data else 192)
    image = jpeg.decode(jpeg.encode(payload))
    assert jpeg.payload_of(image) == payload


def test_media_limits():
    assert jpeg.payload_of(jpeg.decode(jpeg.encode(bytes(192 * 40_000)))) == bytes(192 * 40_000)
    with pytest.raises(ValueError):
        jpeg.decode(b"not a jpeg")
    with pytest.raises(ValueError):
        jpeg.decode(jpeg.encode(b"x" * 192)[:200])


def test_media_columns(spark):
    got = jpeg.load(jpeg.store(odd_rows(spark).drop("media"))).collect()
    for r in got:
        raw = (r.text or "").encode()
        assert bytes(r.contents.payload) == raw + b" " * (-len(raw) % 192 if raw else 192)
        assert len(r.contents.rgb) == r.contents.width * r.contents.height * 3
    assert len({hashlib.md5(r.media).hexdigest() for r in got if r.text == "plain text"}) == 1
    assert jpeg.store(odd_rows(spark).limit(0).drop("media")).count() == 0


@pytest.mark.parametrize("size", [192, 384 * 8, 384 * 21 + 192])
def test_media_stages(size):
    """Dequantisation and chroma upsampling of what the operator itself writes change its samples, as the plain formula has them."""
    payload = np.random.default_rng(3).integers(0, 256, size, np.uint8).tobytes()
    image = jpeg.decode(jpeg.encode(payload))
    assert jpeg.payload_of(image) == payload
    y, cb, cr = image.components.values()
    assert (y.wide, y.tall) == (2 * cb.wide, 2 * cb.tall) == (2 * cr.wide, 2 * cr.tall)
    rgb, steps = image.rgb(), dict(image.quants)
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)

    def sample(c, row, col):
        block = np.zeros(64)
        block[jpeg.ZIGZAG] = c.coef[row // 8 * c.wide + col // 8] * steps[c.quant]
        return np.rint(basis[row % 8] @ block.reshape(8, 8) @ basis[col % 8] + 128).clip(0, 255)

    for row, col in [(0, 0), (3, 9), (9, 3), (15, 14), (image.height - 1, image.width - 1)]:
        luma, b, r = sample(y, row, col), sample(cb, row // 2, col // 2) - 128, sample(cr, row // 2, col // 2) - 128
        want = np.clip([luma + 1.402 * r, luma - 0.344136 * b - 0.714136 * r, luma + 1.772 * b], 0, 255)
        assert np.abs(rgb[row, col] - want).max() <= 1
    image.quants = {i: np.ones(64, np.int32) for i in steps}
    assert (image.rgb() != rgb).any()
