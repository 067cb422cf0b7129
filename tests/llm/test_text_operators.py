"""Operators on single texts against plain restatements, the tokenizers library and exact round trips."""

import base64
import bz2
import gzip
import hashlib
import html
import itertools
import lzma
import random
import re
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runwarden.llm import bpe, hashing, mainpage, packing, secrets, toxicity

ODD = ["", " ", "\n", "a", "a" * 3000, "  two  spaces ", "x  y", "tab\tand\x0bvt", "\U0001f600 ok", "it's 'll 12 ½"]


def noise(seed, count, extra=()):
    pick = random.Random(seed)
    letters = [*" \n\tabé日19!'#ßİΣ\x1c\x85　​", "  ", "'ll", "'S", *extra]
    return ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(count)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, batch string, id int")


@pytest.mark.parametrize(
    ("name", "codec"), [("byte_bpe_50k.json", bpe.Encoder), ("word_bpe_49k.json", packing.WordTokens)]
)
def test_ids_are_those_of_the_library(name, codec):
    path = public_tokenizers.path(name)
    ours, library = codec(path), Tokenizer.from_file(path)
    texts = ODD + noise(1, 3000, ["<|endoftext|>"])
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = ours.encode(text)
        assert ids == np.array(expected.ids, dtype="<u4").tobytes(), text
        if codec is bpe.Encoder:
            assert ours.decode(ids) == library.decode(expected.ids, skip_special_tokens=False) == text


def test_bpe_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 10)
    coder = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(100):
        text = f"word{i} other{i}"
        assert coder.decode(coder.encode(text)) == text
    assert len(coder.spaced) < 20


def test_bpe_rows(spark):
    given = docs(spark, [(1, "hello hello", "b", 1), (1, "hello hello", "b", 1), (2, None, None, None), (None, "", "", 2)])
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.digests(bpe.encode_decode(given, path)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 0), (1, found[0].n_tokens), (1, found[0].n_tokens), (2, 0)]
    assert {r.decoded_sha256 for r in found if not r.n_tokens} == {empty}
    assert bpe.encode_decode(given.limit(0), path).count() == 0


def test_pack_keeps_capacity_and_loses_nothing():
    pick = random.Random(3)
    for n in (0, 1, 2, 50, 900):
        sizes = [pick.randint(1, 512) for _ in range(n)]
        windows = packing.pack(sizes)
        assert sorted(i for w in windows for i in w) == list(range(n))
        assert all(sum(sizes[i] for i in w) <= packing.CAPACITY for w in windows)
        if n == 900:
            assert len(windows) * packing.CAPACITY < 1.05 * sum(sizes)


@pytest.mark.parametrize("tokens", [1, 511, 512, 513, 2048, 2049, 9000])
def test_cuts_cover_each_token_once(tokens):
    found = packing.cuts(tokens)
    assert found[0][0] == 0 and sum(n for _, n in found) == tokens
    assert all(a + n == b for (a, n), (b, _) in zip(found, found[1:], strict=False))
    assert max(n for _, n in found) <= packing.CAPACITY


def test_sequences(spark):
    rows = [(i, "some words here " * (i * 40), "b", i) for i in range(60)] + [(7, None, "x", 1)] * 5
    pieces = packing.pieces(docs(spark, rows), public_tokenizers.path("word_bpe_49k.json"))
    placed = packing.sequences(pieces).toPandas()
    assert placed["length"].sum() == pieces.groupBy().sum("length").first()[0]
    for _, group in placed.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group["offset"].tolist() == [0, *group["length"].cumsum().tolist()[:-1]]
        assert group["length"].sum() <= packing.CAPACITY
    full = packing.fill(pieces, packing.sequences(pieces)).toPandas()
    assert all(len(x) == packing.CAPACITY or len(x) & (len(x) - 1) == 0 for x in full["ids"])
    assert packing.sequences(pieces.limit(0)).count() == 0


def plain_spans(text):
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), m.end(), 0) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans():
    words = ["password", "TOKEN", "ſecret", "api_KEY", "=", ":", " ", '"', "AKIA", "abcdef0123456789", "XYZ", "é", "\n"]
    pick = random.Random(5)
    for _ in range(5000):
        text = "".join(pick.choice(words) for _ in range(pick.randint(0, 30)))
        assert secrets.base_spans(text) == plain_spans(text)


SECRET = "password=hunter2hunter2"


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: urllib.parse.quote(s, safe="").replace("p", "%70"),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(base64.b64encode(gzip.compress(s.encode()))).decode(),
        lambda s: urllib.parse.quote(base64.b64encode(s.encode()).decode(), safe=""),
    ],
)
def test_unwrapped_secrets_are_found_and_masked(wrap):
    inner = wrap(SECRET)
    text = f"é before {inner} after"
    spans = secrets.all_spans(text)
    assert any(kind == 0 and 9 <= start and end <= 9 + len(inner) for start, end, kind in spans)
    clean = secrets.masked(text, spans)
    assert clean.startswith("é before ") and clean.endswith(" after") and not secrets.all_spans(clean)


def test_secret_scan_ends_and_handles_odd_texts(spark):
    loop = "%25" * 50 + "41"
    rows = [(i, text, "b", i) for i, text in enumerate([None, "", loop, SECRET, *ODD])]
    given = docs(spark, rows).withColumnRenamed("batch", "spans")
    found = {r.doc_id: r for r in secrets.scan(given).collect()}
    assert len(found) == len(rows) and found[0].clean_text is None and found[3].clean_text == "[SECRET]"
    assert found[3].spans == f"assign:0:{len(SECRET)}" and found[1].spans == ""


def plain_layers(data):
    """Everything inside, by plain recursion over whole decodings."""
    yield data
    for open_all in (gzip.decompress, bz2.decompress, lzma.decompress, zlib.decompress):
        try:
            yield from plain_layers(open_all(data))
        except (OSError, EOFError, lzma.LZMAError, zlib.error):
            pass
    if re.fullmatch(rb"[A-Za-z0-9+/]{16,}={0,2}", data):
        yield from plain_layers(base64.b64decode(data))


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: gzip.compress(gzip.compress(s)),
        lambda s: lzma.compress(zlib.compress(s)),
        lambda s: bz2.compress(base64.b64encode(gzip.compress(lzma.compress(s)))),
        lambda s: gzip.compress(b"first") + gzip.compress(s),
        lambda s: bz2.compress(b"first") + bz2.compress(s),
        lambda s: lzma.compress(b"first") + lzma.compress(s),
        lambda s: gzip.compress(s[:12]) + gzip.compress(s[12:]),
    ],
)
def test_nested_and_joined_compression_is_unwrapped(wrap):
    data = wrap(SECRET.encode())
    inner = base64.b64encode(data).decode()
    assert any(SECRET.encode() in x for x in plain_layers(inner.encode()))
    text = f"é before {inner} after"
    assert (9, 9 + len(inner), 0) in secrets.all_spans(text)
    quoted = urllib.parse.quote(data, safe="")
    spans = secrets.all_spans(f"é before {quoted} after")
    assert any(kind == 0 and 9 <= start and end <= 9 + len(quoted) for start, end, kind in spans)


@pytest.mark.parametrize("held", [1 << 10, 1 << 24])
def test_runs_over_the_border_of_held_layers(monkeypatch, held):
    monkeypatch.setattr(secrets, "_HELD", held)
    monkeypatch.setattr(secrets, "_STEP", 1 << 8)
    noise_ = random.Random(5).randbytes(3000)
    for middle in (base64.b64encode(noise_ + gzip.compress(SECRET.encode())), gzip.compress(noise_ + SECRET.encode())):
        inner = base64.b64encode(gzip.compress(b"word " * 200 + middle + b" word" * 200)).decode()
        assert (2, 2 + len(inner), 0) in secrets.all_spans(f"a {inner} b")


def test_long_run_over_sixteen_megabytes():
    run = base64.b64encode(b"x" * 150_000 + SECRET.encode())
    inner = base64.b64encode(gzip.compress(b"word " * ((1 << 24) // 5 - 20_000) + run + b" end")).decode()
    assert (0, len(inner), 0) in secrets.all_spans(inner)


@pytest.mark.parametrize(
    "data",
    [
        *(f"{c} some text, {SECRET}".encode() for c in "\xa0\ufeff\xad\u200d\x0c\x1b"),
        f"é {SECRET} ü".encode("utf-16"),
        f"é {SECRET} ü".encode("utf-16-be"),
        b"\x00" + SECRET.encode("utf-16-le"),
        b"\x80\xff\x00\x07" + b"AKIA" + b"Q" * 16 + b"\x00\xfe",
        base64.b64encode(f"\xa0{SECRET}".encode()) + b"\xff",
    ],
)
def test_decoded_layers_need_not_be_text(data):
    inner = base64.b64encode(data).decode()
    spans = secrets.all_spans(f"a {inner} b")
    assert [(start, end) for start, end, _ in spans] == [(2, 2 + len(inner))]


@pytest.mark.parametrize("before", ["https://h/cb/", "key_", "id-", "a+", "/", "x", "xy", "xyz", "name/of-some_kind+"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, lambda s: s.decode().encode("utf-16")])
def test_base64_behind_other_characters_of_its_alphabet(before, pack):
    run = before + base64.b64encode(pack(SECRET.encode())).decode()
    spans = secrets.all_spans(f"a {run} b")
    assert spans and all(kind == 0 and 2 <= start and end == 2 + len(run) for start, end, kind in spans)


@pytest.mark.parametrize("width", [12, 64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_base64_over_line_ends(width, end):
    for data in (b"," * 40 + SECRET.encode() + b"," * 99, gzip.compress(random.Random(1).randbytes(200) + SECRET.encode())):
        run = base64.b64encode(data).decode()
        lines = [run[i : i + width] for i in range(0, len(run), width)]
        starts = [4 + i * (width + len(end)) for i in range(len(lines))]
        ends = [start + len(line) for start, line in zip(starts, lines, strict=True)]
        spans = secrets.all_spans("é a " + end.join(lines) + " b")
        assert spans and all(start in starts and stop in ends for start, stop, _ in spans)
        if data[:1] == b",":
            at = 40 * 8 // 6 // width, ((40 + len(SECRET)) * 8 - 1) // 6 // width
            assert (starts[at[0]], ends[at[1]], 0) in spans
        else:
            assert (starts[0], ends[-1], 0) in spans


ESCAPES = [
    lambda s: "".join(f"%u{ord(c):04x}" for c in s),
    lambda s: "".join(f"\\u{{{ord(c):x}}}" for c in s),
    lambda s: "".join(f"\\U{ord(c):08X}" for c in s),
    lambda s: "".join(f"\\x{b:02x}" for b in s.encode()),
    lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: "".join(f"&#x{ord(c):X};" for c in s),
    lambda s: html.escape("".join(f"&#{ord(c)};" for c in s)),
    lambda s: s.replace("=", "=&quot;"),
]


@pytest.mark.parametrize("wrap", ESCAPES)
@pytest.mark.parametrize("outer", [str, lambda s: base64.b64encode(s.encode()).decode(), lambda s: urllib.parse.quote(s, safe="")])
def test_escapes_are_unwrapped(wrap, outer):
    inner = outer(wrap(SECRET))
    assert (9, 9 + len(inner), 0) in secrets.all_spans(f"é before {inner} after")


def test_escapes_of_characters_beyond_the_first_plane():
    for escaped in ("\\ud83d\\ude00", "%ud83d%ude00", "\\U0001F600", "\\u{1f600}", "&#x1F600;", "&#128512;", "\\xf0\\x9f\\x98\\x80"):
        assert secrets._ESCAPES.fullmatch(escaped.encode())
        assert secrets._unescaped(escaped.encode()).decode() == "\U0001f600"
    for wrong in (b"&#999999999;", b"&#xd800;", b"\\UFFFFFFFF"):
        assert secrets._unescaped(wrong) is None


@pytest.mark.parametrize("between", [" ", "\n    ", "\\n", "\\r\\n", "\r\n\t"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, lambda s: zlib.compress(s)[2:-4]])
def test_base64_in_pieces(between, pack):
    run = base64.b64encode(pack(b", " * 40 + random.Random(1).randbytes(90).hex().upper().encode() + SECRET.encode())).decode()
    pieces = [run[i : i + 64] for i in range(0, len(run), 64)]
    text = between.join(pieces)
    spans = [x for x in secrets.all_spans(f"é a {text} b") if x[2] == 0]
    assert spans and all(4 <= start and end <= 4 + len(text) for start, end, _ in spans)


def test_deflated_without_header():
    data = zlib.compress(SECRET.encode() + b" and more words" * 9)[2:-4]
    inner = base64.b64encode(data).decode()
    assert (2, 2 + len(inner), 0) in secrets.all_spans(f"a {inner} b")
    # nothing is found in words and numbers that are no such data
    pick = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz+/"
    for _ in range(20_000):
        assert not secrets.all_spans("".join(pick.choices(letters, k=pick.randint(16, 40))))


def author(seed, toxic):
    pick = random.Random(seed)
    words = ["".join(pick.choice("aeiorstnl") for _ in range(pick.randint(2, 8))) for _ in range(60)]
    for _ in range(pick.randint(1, 4) if toxic else 0):
        words.insert(pick.randint(0, 60), pick.choice(["moronic", "idiot", "scumbag", "trash,", "loser."]))
    return " ".join(words)


def test_toxicity_on_held_out_texts(spark):
    rows = [(i, author(i, i % 5 == 0), "b", i) for i in range(1500)]
    given = docs(spark, rows).withColumnRenamed("batch", "severity")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1000)], "doc_id long, quality int, toxic int")
    model = toxicity.train(given, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    found = [r for r in toxicity.grade(given, model).collect() if r.doc_id >= 1000]
    wrong = [r for r in found if r.toxic != (r.doc_id % 5 == 0)]
    assert len(found) == 500 and len(wrong) <= 5
    assert toxicity.train(given, labels) == model


def test_toxicity_takes_one_text_of_each_id(spark, monkeypatch):
    rows = [(1, f"hot {i}", "b", i) for i in range(500)] + [(2, "idiot", "b", 1), (3, None, "b", 2)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: ([x.tolist() for x in texts], toxic.tolist()))
    given = docs(spark, rows)
    texts, toxic = toxicity.train(given, labels)
    assert sorted(toxic) == [0, 0, 1] and len(texts) == 3
    assert toxicity.train(given.orderBy("text"), labels) == (texts, toxic)


def test_no_telling_feature_is_dropped(spark):
    # every toxic text has all of many words that clean texts never have
    words = ["".join(x) for x in itertools.product("aeiou", "bcdfg", "klmno", "prstu", "aeiou", "z")]
    toxic_text, clean_text = " ".join(words), "clean words of every day"
    given = docs(spark, [(i, toxic_text if i % 2 else clean_text, "b", i) for i in range(60)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.train(given, labels)
    # a feature that hashes like one of the clean text is in every text and tells nothing
    both = [{f for w in x.split() for f in toxicity.word_features(w)} for x in (toxic_text, clean_text)]
    assert both[0] ^ both[1] == set(model.weights) and len(model.weights) > 6000


def test_telling_features_are_those_of_plain_counts():
    random_ = np.random.default_rng(2)
    count = random_.integers(4, 50, 500)
    with_toxic = random_.binomial(count, random_.random(500))
    expected = []
    for i, (n, k) in enumerate(zip(count.tolist(), with_toxic.tolist(), strict=True)):
        ratio = sum(x * np.log(x / (n * share)) for x, share in ((k, 0.25), (n - k, 0.75)) if x)
        expected += [i] if 2 * ratio >= 2 * np.log(500) else []
    assert toxicity.telling(np.arange(500), count, with_toxic, 25, 100).tolist() == expected


def test_toxicity_without_labels(spark):
    given = docs(spark, [(1, None, "b", 1), (2, "idiot", "b", 1)])
    labels = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(given, labels)
    assert [r.toxic for r in toxicity.grade(given, model).collect()] == [False, False]
    assert toxicity.grade(given.limit(0), model).count() == 0


def test_ordinal_fit_recovers_order():
    random_ = np.random.default_rng(1)
    grades = random_.integers(0, 4, 800)
    rows = np.repeat(np.arange(800), grades)
    columns = np.concatenate([np.arange(g) for g in grades])
    weights, thresholds = toxicity.fit_ordinal(rows, columns, grades, 3)
    score = np.bincount(rows, weights[columns], minlength=800)
    assert ((score[:, None] >= thresholds).sum(1) == grades).mean() > 0.98


def test_main_page_on_held_out_pages():
    chain = mainpage.trained()
    right = total = 0
    for page in mainpage.labelled_pages(150, seed=1234):
        decoded = chain.decode([b for b, _ in page])
        right += sum(a == b for a, (_, b) in zip(decoded, page, strict=True))
        total += len(page)
    assert right / total > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- x --><div class="ad">Buy this now.</div><div class=cookie-notice>
<p>We use cookies here.</p></div><article><h1>Title &lt;b&gt;</h1><p><b>First   part<br>goes\non.<p>Second &amp; last
<a href="/x">link</a> text.</p><div class="comments"><h3>Comments</h3><p>Nice one!</p></div></article>
<aside><h3>Related</h3><p>Read more.</p></aside><form><label>Mail</label><button>Go</button></form>
<footer>&copy; example</footer>"""


def test_main_page_layout():
    assert mainpage.extract(PAGE, mainpage.trained()) == "Title <b> First part goes on. Second & last link text."


@pytest.mark.parametrize("page", ["", "plain", "<p>", "<", "<a", "<!--", "<script>x", '<p title="a>b">x</p>', "</p></div>", "&am"])
def test_main_page_never_fails(page):
    mainpage.extract(page, mainpage.trained())


ARTICLE = "<article><h1>Title here</h1><p>First sentence of it.</p><p>Second sentence of it.</p></article>"
MAIN_TEXT = "Title here First sentence of it. Second sentence of it."


@pytest.mark.parametrize(
    "before",
    [
        "<html><head><title>T</title><body>",
        "<html><head><title>T <b> t</title><meta charset=utf-8><style>p{}</style>",
        "<head><title>T<body>",
        "<head><link rel=x></head><body><svg class='a' viewBox=\"0 0\"/>",
        "<body><svg><style/><path d=''/><text>drawn</text></svg>",
        "<body><svg><svg><title>drawn</title></svg><text>drawn</text></svg>",
        "<body><svg><foreignObject><p>drawn</p></foreignObject></svg>",
        "<body><div><svg><path></div>",
        "<body><svg><path>",
        "<body><math/>",
        "<body><object data=x>",
    ],
)
def test_main_page_open_head_and_empty_drawings(before):
    texts = " ".join(b.text for b in mainpage.blocks(before + ARTICLE))
    assert texts == MAIN_TEXT
    assert mainpage.extract(before + ARTICLE, mainpage.trained()) == MAIN_TEXT


def test_main_page_math_and_object_text():
    page = ARTICLE.replace("First", "<math><mi>x</mi><mo>=</mo><mn>1</mn></math> <object data=y>shown</object> First")
    assert mainpage.extract(page, mainpage.trained()) == MAIN_TEXT.replace("First", "x=1 shown First")


def test_main_page_matches_articles_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in mainpage.main_text(pages).collect()}
    for row in pages.collect():
        article = re.search("<article>(.*?)</article>", row.html, re.S)[1]
        parts = re.split(r"<(?:h1|/h1|p|/p)>", article.replace("<b>", "").replace("<br>", " "))
        blocks = [" ".join(html.unescape(part).split()) for part in parts]
        assert found[row.page_id] == " ".join(b for b in blocks if b)


@pytest.mark.parametrize(
    "inside",
    [
        "<!-->", "<!--->", "<!-- a --!>", "<!-- <p>hidden</p> -->", "<!--a-->", "<textarea>typed <p>in</p></textarea>",
        "<select><option>one<option>two</select>", "<datalist><option>one</option></datalist>",
    ],
)
def test_main_page_comments_and_fields_inside(inside):
    page = ARTICLE.replace("</p><p>Second", f"</p>{inside}<p>Second") + "<!-- the end -->"
    assert mainpage.extract(page, mainpage.trained()) == MAIN_TEXT


def test_viterbi_equals_all_label_sequences():
    chain = mainpage.trained()
    (t00, t01), (t10, t11) = chain.transitions
    moves = {(0, 0): t00, (0, 1): t01, (1, 0): t10, (1, 1): t11}

    def score(parts, labels):
        told = sum(sum(chain.weights.get(f, 0.0) for f in mainpage.features(b)) for b, y in zip(parts, labels, strict=True) if y)
        return told + sum(moves[pair] for pair in itertools.pairwise(labels))

    for page in mainpage.labelled_pages(40, seed=77):
        parts = [b for b, _ in page][:9]
        best = max(score(parts, labels) for labels in itertools.product((0, 1), repeat=len(parts)))
        assert score(parts, chain.decode(parts)) == pytest.approx(best)


def test_main_page_repeats_clashes_and_long_pages(spark):
    long = "<body>" + ARTICLE.replace("First sentence of it.", "Long sentence here. " * 60_000)
    rows = [(1, "u", ARTICLE, "t", 3), (1, "u", ARTICLE, "t", 3), (2, "v", long, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = sorted((r.page_id, r.n_chars, r.text[:10]) for r in mainpage.main_text(pages).collect())
    assert found[:2] == [(1, len(MAIN_TEXT), "Title here")] * 2 and found[2][1] > 1_100_000
    assert mainpage.main_text(pages.limit(0)).count() == 0


def test_main_page_null(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in mainpage.main_text(pages).collect()] == [("", 0), ("", 0)]


def test_words_and_shingles_do_not_depend_on_segments(monkeypatch):
    texts = hashing.as_bytes(noise(9, 200) + ["w" * 500, None])
    words, edges = hashing.word_hashes(texts)
    assert np.diff(edges).tolist() == [len(t.split()) for t in texts]
    monkeypatch.setattr(hashing, "_SEGMENT", 16)
    again, edges2 = hashing.word_hashes(texts)
    assert (words == again).all() and (edges == edges2).all()
    by_text = {}
    for text, start in zip(texts, edges, strict=False):
        for i, word in enumerate(text.split()):
            assert by_text.setdefault(word, words[start + i]) == words[start + i]
    assert len(set(by_text.values())) == len(by_text)


def test_long_words_of_regular_order_differ():
    """Sums modulo 2**64 can't tell a Thue-Morse word from its complement."""
    for size in (64, 65, 1024, 2048, 4096):
        order = [bin(i).count("1") % 2 for i in range(size)]
        words = [bytes(97 + x for x in order), bytes(98 - x for x in order)]
        hashes, _ = hashing.word_hashes(words)
        assert hashes[0] != hashes[1]
        again, _ = hashing.word_hashes([b"a " + words[0] + b" b " + words[1]])
        assert (again[[1, 3]] == hashes).all()
