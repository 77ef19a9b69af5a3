import hashlib
import os
import random
import re
import struct
import zlib

import pytest

from siltstone.llm import html_extract, license_scan, media_ogg

RND = random.Random(8)


# -- licences -------------------------------------------------------------------


def slow_best(text, template):
    """The best coefficient of any window of the text against one template."""
    words, t = license_scan.normalise(text), license_scan.normalise(template)
    want = list(zip(t, t[1:], strict=False))
    best = 0.0
    for a in range(len(words)):
        for b in range(a + 2, len(words) + 1):
            own = list(zip(words[a:b], words[a + 1 : b], strict=False))
            left = want.copy()
            common = sum(1 for x in own if x in left and not left.remove(x))
            best = max(best, 2 * common / (len(own) + len(want)))
    return best


def test_scanner_finds_the_best_window():
    templates = {"A": ["one two three four five six"], "B": ["one two nine eight seven"], "C": ["red red red blue"]}
    scanner = license_scan.Scanner(templates, 0.6)
    vocabulary = "one two three four five six nine eight seven red blue x".split()
    for _ in range(300):
        text = " ".join(RND.choice(vocabulary) for _ in range(RND.randint(0, 14)))
        found = scanner.matches(text)
        best = max(slow_best(text, t) for ts in templates.values() for t in ts)
        assert (max((m[1] for m in found), default=0.0) == pytest.approx(best)) if best >= 0.6 else not found
        ends = [(m[2], m[2] + m[3]) for m in found]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_every_template_finds_itself():
    scanner = license_scan.Scanner()
    for name, texts in license_scan.TEMPLATES.items():
        for text in texts:
            found = scanner.matches(f"some words before\n{text.upper()}\nand after that")
            assert [m[0] for m in found] == [name] and found[0][1] == 1.0


def test_scan(spark):
    rows = [(1, "Prose.\nReleased under the MIT Licence.\nMore prose.", "x"), (2, None, "x"), (3, "", "x"), (4, "the license of a dog", "x"), (5, "Licensed under CC BY 4.0. " * 500 + "All rights reserved.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[1].licenses == "MIT" and got[1].spans[0].first_word == 1 and got[5].licenses == "All-rights-reserved;CC-BY-4.0" and got[5].n_matches == 501
    assert [got[i].licenses for i in (2, 3, 4)] == [None] * 3 and got[2].best_dice is None
    assert license_scan.op3(docs.limit(0)).count() == 0


# -- ogg ------------------------------------------------------------------------


def slow_checksum(data):
    crc = 0
    for x in data:
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for n in (0, 1, 27, 300):
        data = os.urandom(n)
        assert media_ogg.checksum(data) == slow_checksum(data) == media_ogg.checksum(data[: n // 2], data[n // 2 :])


@pytest.mark.parametrize("n", [0, 1, 63, 64, 255, 4096, 61_440, 61_441, 200_000])
def test_pcm_round_trip(n):
    payload = media_ogg.pad(os.urandom(n))
    data = media_ogg.write_pcm(payload)
    assert media_ogg.read_pcm(data) == payload and len(payload) % 64 == 0 and payload
    streams, error = media_ogg.parse(data)
    assert not error and [s.codec for s in streams] == ["pcm", "marks"] and all(s.ended for s in streams)
    assert streams[0].ends[-1] == pytest.approx(len(payload) / 8000)
    for at in RND.sample(range(len(data)), 20):
        broken = bytearray(data)
        broken[at] ^= 1 << RND.randrange(8)
        assert media_ogg.parse(bytes(broken))[1]
    assert media_ogg.parse(data[:-1])[1] and media_ogg.parse(None)[1] == "null" and media_ogg.parse(b"")[1] == "no page" and media_ogg.parse(b"RIFF....")[1]


def raw_page(segments, body, serial, number, granule, flags):
    head = media_ogg.PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(segments)) + bytes(segments)
    return head[:22] + struct.pack("<I", slow_checksum(head + body)) + head[26:] + body


def test_continued_packets_and_codecs():
    vorbis = b"\x01vorbis" + struct.pack("<IBI", 0, 1, 44_100) + bytes(14)
    big = os.urandom(255 * 255 + 100)
    data = raw_page([len(vorbis)], vorbis, 7, 0, 0, 2)
    data += raw_page([255] * 255, big[: 255 * 255], 7, 1, -1, 0)
    data += raw_page([100, 3], big[255 * 255 :] + b"end", 7, 2, 44_100, 5)
    (s,), error = media_ogg.parse(data)
    assert not error and s.packets == [vorbis, big, b"end"] and s.codec == "vorbis" and s.ends == [0.0, None, 1.0]
    opus = b"OpusHead\x01\x01" + struct.pack("<HIH", 312, 48_000, 0) + b"\0"
    data = raw_page([len(opus)], opus, 1, 0, 0, 2) + raw_page([1], b"x", 1, 1, 48_312, 4)
    assert media_ogg.parse(data)[0][0].ends == [0.0, 1.0]
    lost = raw_page([len(opus)], opus, 1, 0, 0, 2) + raw_page([1], b"x", 1, 2, 48_312, 4)
    assert "gap" in media_ogg.parse(lost)[1]


def test_media_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 50, "c"), (2, None, "c"), (3, "", "c"), (4, "long " * 50_000, "c"), (5, "é" * 50, "c")], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media_ogg.op4(docs).collect()}
    for i, text in ((1, "é" * 50), (2, ""), (4, "long " * 50_000)):
        payload = media_ogg.pad(text.encode())
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(payload[-64:])
    assert got[1][1:] == got[5][1:] and got[2][1:] == got[3][1:]
    table = media_ogg.store_texts(docs).union(spark.createDataFrame([(9, 0, None), (10, 0, bytearray(b"junk"))], "doc_id long, n_bytes long, media binary"))
    seen = {r.id: r for r in media_ogg.inspect(table, "doc_id", "media").collect()}
    assert seen[9].error == "null" and seen[10].error and seen[4].error is None and seen[4].streams[0].end_seconds == pytest.approx(got[4].payload_bytes / 8000)
    assert media_ogg.op4(docs.limit(0)).count() == 0


# -- pages ----------------------------------------------------------------------

PARAGRAPHS = [" ".join(RND.choice("lorem ipsum dolor sit amet consectetur elit sed do".split()) for _ in range(RND.randint(12, 60))) + "." for _ in range(5)]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = "\n".join(["A title", *PARAGRAPHS])
NAV = "<nav><ul>" + "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(9)) + "</ul></nav>"
MENU = NAV.replace("nav", "div")
NOISE = "This is a rather long text of its own that anybody could take for the article if density were all there is to it."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body>{NAV}<article><h1>A title</h1>{ARTICLE}</article><footer>(c) {NOISE}</footer></body></html>",
        f"<body>{MENU}<div id=content><h1>A title</h1>{ARTICLE}</div><div class='sidebar right'><p>{NOISE}</p></div></body>",
        f"<body><header><h1>Site</h1><p>{NOISE}</p></header><main><h1>A title</h1>{ARTICLE}</main><section id=comments><p>{NOISE}</p><p>{NOISE}</p></section>",
        f"<body><div class=cookie-notice>{NOISE}</div><div><div><h1>A title</h1></div><div>{ARTICLE}</div></div><div class=ad>{NOISE}</div></body>",
        f"<body><article><header><h1>A title</h1></header>{ARTICLE.replace('</p>', '')}<aside>{NOISE}</aside><form><p>{NOISE}</p><input></form></article>",
        f"<body><article><h1>A title</h1>{ARTICLE.replace(' ipsum ', ' <b>ipsum</b> ')}<ul>" + "".join(f"<li><a href=/{i}>More {i}</a>" for i in range(5)) + "</ul></article>",
        f"<body><div class=post><h1>A&#32;title</h1>{ARTICLE}</div><script>var s = '<p>{NOISE}</p>';</script><style>p{{}}</style><!-- <p>{NOISE}</p> --><div aria-hidden=true>{NOISE}</div>",
        f"<body class=has-sidebar><div class='layout with-sidebar'><div class='post-header'><h1>A title</h1></div><div>{ARTICLE}</div><div class=sidebar>{NOISE}</div></div></body>",
        f"<body><div class=site-header><p>{NOISE}</p></div><article><div class=header><h1>A title</h1></div>{ARTICLE}<div class='comment-list'><p>{NOISE}</p></div></article></body>",
    ],
)
def test_main_text(page):
    assert html_extract.main_text(page) == TEXT


def test_references_and_white_space():
    page = "<article><h1>x &amp;&lt; y</h1><p>caf&eacute;&#233;&#xE9;\n\t a&nbsp;b<br>c</p><pre> d\n e </pre></article>"
    assert html_extract.main_text(page) == "x &< y\ncaféééa b c\nd e".replace("éééa", "ééé a")


def test_odd_pages():
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<body><nav>x</nav></body>") == ""
    assert html_extract.main_text("just text") == "just text"
    assert html_extract.main_text("<div>" * 20_000 + "deep") == "deep"
    assert html_extract.main_text("<p>unclosed <b>tags<p>two</i></div>").split("\n") == ["unclosed tags", "two"]
    assert html_extract.main_text("<p>a < b and c > d</p><script>never closed") == "a < b and c > d"


def test_density_prefers_text_to_links():
    nodes = html_extract.parse(f"<body><div id=a>{ARTICLE}</div><div id=b>{MENU}</div></body>")
    html_extract.choose(nodes)
    by = {tuple(n.words): n for n in nodes if n.words}
    assert by[("a",)].density > by[("b",)].density


def test_extract(spark):
    rows = [(1, "u1", f"<article><p>{PARAGRAPHS[0]}</p></article>", "t"), (2, None, None, "t"), (3, "u3", "", "t"), (None, "u4", "<p>x</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.url: r for r in html_extract.extract(pages).collect()}
    assert got["u1"].text == PARAGRAPHS[0] and got["u1"].n_chars == len(PARAGRAPHS[0]) and (got[None].text, got["u3"].n_chars, got["u4"].page_id) == ("", 0, None)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_test_tables(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    import html

    for r in spark.read.parquet(path).collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert html_extract.main_text(r.html) == "\n".join(b for b in blocks if b)


def test_density_decides_over_articles():
    cards = "".join(f'<article><h3>Card {i}</h3><p>{"A teaser of another story. " * 4}</p></article>' for i in range(3))
    for wrapper in ("<div class=teasers>{}</div>", "<aside>{}</aside>", "<div class=related>{}</div>", "<div hidden>{}</div>"):
        text = html_extract.main_text(f"<html><body><div class=text>{ARTICLE}</div>{wrapper.format(cards)}</body></html>")
        assert "\n".join(PARAGRAPHS) in text
        if "teasers" not in wrapper:
            assert "teaser" not in text


@pytest.mark.parametrize("name", ["discussion", "related-work", "response", "notice"])
def test_sections_of_an_article_stay(name):
    section = f"<section id={name}><h2>Section</h2><p>{'Words of this section count. ' * 6}</p></section>"
    text = html_extract.main_text(f"<html><body><article>{ARTICLE}{section}</article></body></html>")
    assert "Words of this section count." in text and "\n".join(PARAGRAPHS) in text
    for furniture in ("<div class=related-posts><p>Read this too</p></div>", "<div class=related><a href=x>Read this too</a></div>"):
        assert "Read this too" not in html_extract.main_text(f"<html><body><article>{ARTICLE}{furniture}</article></body></html>")
