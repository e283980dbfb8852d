import html
import re
import time
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from dwell.llm import line_frequency as L
from dwell.llm import warc as W
from dwell.llm.html_extraction import extract, extract_pages
from dwell.llm.shared import fresh_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    in_window = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(in_window)


TEXTS = ["", "\n \n", "one", "a b c d e f g h " * 4, "a b c d e f g h i a b c d e f g h", "x " * 30, "é ü ß\x85y #*$\n#\nline\nline\n line", "q\r\nq\r\n\x0bq"]


def test_base_counts():
    for t in TEXTS:
        assert L.measure(t)[0] == plain_counts(t)
    assert L.measure(None)[0] == (0, 0, 0, 0, 0)


def test_base_counts_of_real_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert L.measure(r.text)[0] == plain_counts(r.text)


def test_lines_above_the_limit_deplete_documents(spark):
    own = "these words are only mine and no other document has them at all number"
    rows = [(i, "h1", f"Common LINE 12\n{own} {chr(97 + i)} " + "filler words so that it is long enough to be kept " * 2, 1) for i in range(6)]
    rows += [(10, "h1", "\n".join(["common   line 99"] * 30), 1), (11, "h2", "\n".join(["common line 12"] * 30), 1), (12, None, None, 1), (13, None, "", 1), (None, "h1", "common line 00", 1), (0, "h1", rows[0][2], 1)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, host int")
    got = {r.doc_id: r for r in L.line_rules(d, max_documents=5, min_words=20).collect()}
    assert all(got[i].removed_words == 3 and not got[i].depleted for i in range(6))
    assert got[10].depleted and got[10].removed_words == 90  # digits are normalised, repeats go together
    assert not got[11].depleted and got[11].removed_words == 0  # another host
    assert got[12].depleted and got[13].depleted and got[12].n_words == 0
    assert L.line_rules(d, max_documents=5).count() == len(rows)
    assert L.line_rules(d.limit(0)).count() == 0


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


LONG = "The mill by the river was old and it had been there for a very long time, so that nobody could say who built it."


def test_article_without_its_surroundings():
    p = page(
        f"<nav><ul><li><a href='/'>Home of the brave and the free</a></li></ul></nav><div class='cookie-notice'>{LONG}</div><article><h1>Title &amp; more</h1><p>{LONG}<br>Next&nbsp;  line</p><p><b>Short.<br>"
        f"<p>Short.</p><div class='comments'><p>{LONG} I said.</p></div><form>{LONG}</form></article><aside>{LONG}</aside><footer>&copy; x</footer>"
    )
    assert extract(p) == f"Title & more\n{LONG} Next line\nShort.\nShort."
    assert extract(None) == "" and extract("") == "" and extract("<p>") == ""
    assert extract("<p>x</p><!-- open") == "x" and extract("<script>never closed " + LONG) == ""


def test_pages_without_an_article_go_by_their_blocks():
    links = "<div>" + "".join(f"<a href='#'>{LONG[:40]}</a> " for _ in range(5)) + "</div>"
    listing = "<div>" + "alpha beta gamma delta " * 10 + "</div>"
    p = page(f"{links}<div>Menu</div>{listing}<div>{LONG}</div><div>A short one</div><div>{LONG}</div><div>Last</div>")
    assert extract(p) == f"{LONG}\nA short one\n{LONG}\nLast"


def test_articles_under_marked_ancestors():
    text = "This is the text of the article and it is about the way that the people of the town were able to do more with less."
    assert extract(f'<div class="wrapper has-sidebar"><p>{text}</p></div>') == text
    for around in ('class="wrapper has-sidebar"', 'id="page-widget"'):
        assert extract(f"<div {around}><article><p>{text}</p></article><div class='related'>{text}</div></div>") == text
    assert extract(f'<div id="page-widget"><article>{text}</article><article>{text}</article></div>') == f"{text}\n{text}"
    # comments stay out, however long; so do parts that are out by their element
    comments = f'<div class="comments"><article>{text}</article><article>{text}</article></div>'
    assert extract(f"<article>{text}</article>{comments}") == text
    assert extract(f'<div id="page-widget"><main>{text}</main>{comments}</div>') == text
    assert extract(f'<div class="sidebar"><p>{text}</p></div>') == "" and extract(f"<aside><article>{text}</article></aside>") == ""


def test_pages_in_other_languages_go_by_density():
    text = "Tämä on pitkä suomenkielinen kappale, jossa kerrotaan metsien hoidosta, järvien tilasta ja talvisten teiden kunnosta."
    assert extract(f"<body><p>{text}</p><p>Lyhyt.</p><p>{text}</p></body>") == f"{text}\nLyhyt.\n{text}"
    assert extract(f"<body><p><a href='/'>{text}</a></p><p>{text}</p></body>") == text
    known = "This is the text of the article and it is about the way that the people of the town were able to do more with less."
    assert extract(f"<body><p>{known}</p><p>{text}</p><p>{known}</p></body>") == f"{known}\n{text}\n{known}"


def test_names_that_may_be_surroundings():
    chinese = "".join(f"这是第{k}个句子，讲的是河边的老磨坊和住在那里的人们。" for k in range(20))
    assert extract(f"<body><div>{chinese}</div></body>") == chinese
    for around in ("related-work", "post-header", "share-price", "social-history"):
        assert extract(f'<body><div class="{around}"><p>{LONG}</p></div><p>{LONG}</p></body>') == f"{LONG}\n{LONG}"
    for around in ("related", "site-header", "related-posts", "share-buttons", "cookie-notice", "notice", "alert-box", "social-media"):
        assert extract(f'<body><div class="{around}"><p>{LONG}</p></div><p>{LONG}</p></body>') == LONG
    assert extract('<div id="main-content"><h2>Short</h2><p>Ok.</p></div>') == "Short\nOk."
    assert extract(f'<div class="sidebar"><div class="post-body">{LONG}</div></div><p>{LONG}</p>') == LONG


def test_broken_tags():
    assert extract(f"<article><p>{LONG} a < b, 3<4 & 5>4</p><a href='x") == f"{LONG} a < b, 3<4 & 5>4"
    assert extract(f'<article><p title="open>{LONG}</p><p>More &#x41;&#{"9" * 5000}; text</p></article>') == f"{LONG}\nMore A\ufffd text"
    assert extract(f"<article><![CDATA[{LONG}]]></3><?x y?><!doctype q> end</article>") == f"{LONG} end"
    assert extract(f"<article><div><ul><li>{LONG}</div></ul></section> tail</article>") == f"{LONG}\ntail"


@pytest.mark.parametrize(
    "piece",
    ["<p ", '<a "', "<a ' >", "<p x='\">", "<title>", "<svg><b>", "<button>x", "<!--", "<![CDATA[", "</", "&#9", "<div class='", "<p class=\"advert_", "<div><p>x<a>y", "<", "<a href=\"x>", "</ul", "<li>x</div>", "<script>", "</title ", "id=' ", "<p id='"],
)
def test_time_grows_with_the_page(piece):
    n = 1_000_000 // len(piece)
    for p in (piece * n, f"<article>{piece * n}", "<div>" * 1000 + piece * n + ">'\""):
        began = time.perf_counter()
        extract(p)
        assert time.perf_counter() - began < 4


def test_deep_and_unmatched_elements():
    for p in ("<div>" * 80_000 + "</ul>" * 80_000, "<div>" * 80_000 + "</div>" * 80_000, "<ul><li>" * 100_000 + "x" + "</ul>" * 100_000, "<div>x</p>" * 100_000):
        began = time.perf_counter()
        extract(p)
        assert time.perf_counter() - began < 4


def test_pages_as_they_are(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        art = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", art)]
        assert extract(r.html) == "\n".join(x for x in parts if x)


KINDS = {
    "good": lambda k: f"The story of the mill number {k} and of the people who lived by it is told in this book for all to read.",
    "half": lambda k: f"Report {k} number seven concerning river mills along northern valleys: the committee found nothing wrong with them at all.",
    "strange": lambda k: f"Kappale {k} kertoo metsien hoidosta, järvien tilasta sekä talvisten teiden kunnosta pohjoisessa maassamme aina vaan.",
    "list": lambda k: "alpha beta gamma delta " * 9 + str(k),
    "short": lambda k: f"Short one {k}",
    "links": lambda k: f"<a href='/{k}'>the link to a page that is about all of the news of the day and more than that number {k}</a> x",
}


def plain_passes(blocks):
    """The two passes over (kind, text) of one part that is no article, with what each kind is by the rules."""
    first = [{"good": True, "half": None, "strange": None, "list": False, "short": None, "links": False}[k] for k, _ in blocks]
    size = lambda kind: sum(len(t) for k, t in blocks if k == kind)
    if size("strange") > size("good"):
        first = [True if k == "strange" else f for (k, _), f in zip(blocks, first, strict=True)]
    out = []
    for i in range(len(blocks)):
        left = next(((i - j, first[j]) for j in range(i - 1, -1, -1) if first[j] is not None), None)
        right = next(((j - i, first[j]) for j in range(i + 1, len(blocks)) if first[j] is not None), None)
        near = sorted(x for x in (left, right) if x)
        if first[i] is not None:
            out.append(first[i])
        elif len(near) == 2 and near[0][0] == near[1][0] and near[0][1] != near[1][1]:
            out.append(False)  # they disagree, and the part is no article
        else:
            out.append(bool(near) and near[0][1])
    if not any(out):  # link density over the whole page
        out = [k != "links" for k, _ in blocks]
    return [t for (_, t), keep in zip(blocks, out, strict=True) if keep]


def plain_page(parts):
    """Parts (kind, blocks) of a page: an article keeps its blocks, surroundings lose them; of the rest, each stretch
    between others is judged by the passes, and a heading just before kept text joins it."""
    first = {"good": True, "half": None, "strange": None, "list": False, "short": None, "links": False}
    kept, loose = [], []
    for kind, blocks in parts:
        if kind == "article":
            out = [True] * len(blocks)
        elif kind != "rest":
            out = [False] * len(blocks)
        else:
            out = []
            for i in range(len(blocks)):
                left = next(((i - j, first[blocks[j][0]]) for j in range(i - 1, -1, -1) if first[blocks[j][0]] is not None), None)
                right = next(((j - i, first[blocks[j][0]]) for j in range(i + 1, len(blocks)) if first[blocks[j][0]] is not None), None)
                near = sorted(x for x in (left, right) if x)
                own = first[blocks[i][0]]
                if own is not None:
                    out.append(own)
                else:
                    out.append(bool(near) and (near[0][1] if len(near) == 1 or near[0][0] != near[1][0] or near[0][1] == near[1][1] else False))
        kept += [[t, keep] for (_, t), keep in zip(blocks, out, strict=True)]
        loose += [kind == "rest" and k != "links" for k, _ in blocks]
    if any(k for _, k in kept):
        return [t for t, k in kept if k]
    if any(loose) or all(kind != "weak" for kind, _ in parts) or any(kind == "article" for kind, _ in parts):
        return [t for (t, _), k in zip(kept, loose, strict=True) if k]
    return [t for kind, blocks in parts if kind == "weak" for t in plain_strict(blocks)]


def plain_strict(blocks):
    """What the passes keep of one part, without the density over the whole page."""
    return plain_passes(blocks) if any(k == "good" for k, _ in blocks) else []


def test_pages_of_articles_nested_parts_and_names_agree_with_plain_rules():
    import random

    rng = random.Random(11)
    wrap = {
        "article": ("<article>{}</article>", "<main><div>{}</div></main>", "<div class='wide'><article class='comment'><section>{}</section></article></div>", "<div id='post-body'>{}</div>", "<main><article>{}</article></main>"),
        "around": ("<nav>{}</nav>", "<div class='sidebar left'><div>{}</div></div>", "<aside><section>{}</section></aside>", "<div class='user-comments'>{}</div>", "<form><div>{}</div></form>"),
        "weak": ("<div id='site-menu'>{}</div>", "<div class='navbar'>{}</div>", "<div class='related'><section>{}</section></div>"),
    }
    kinds = [k for k in KINDS if k != "strange"]  # their language is judged over the whole page
    n = 0
    for _ in range(500):
        parts, page_ = [], ""
        for _ in range(rng.randint(1, 5)):
            kind = rng.choice(("article", "around", "weak", "rest"))
            if kind == "rest" and parts and parts[-1][0] == "rest":
                continue
            blocks = [(k, KINDS[k](n := n + 1)) for k in rng.choices(kinds, k=rng.randint(1, 4))]
            inner = "".join(rng.choice((f"<p>{t}</p>", f"<ul><li>{t}</li></ul>", f"<div><div>{t}</div></div>")) for _, t in blocks)
            page_ += rng.choice(wrap[kind]).format(inner) if kind != "rest" else inner
            parts.append((kind, [(k, re.sub("<[^>]*>", "", t)) for k, t in blocks]))
        assert extract(f"<body>{page_}</body>") == "\n".join(plain_page(parts)), page_


def test_articles_keep_lists_and_titles_of_links():
    papers = "<ul><li><a href='/1'>Paper one</a></li><li><a href='/2'>Paper two</a></li></ul>"
    assert extract(f"<nav><a href='/'>Home</a></nav><article><p>{LONG}</p>{papers}<p>{LONG}</p></article>") == f"{LONG}\nPaper one\nPaper two\n{LONG}"
    assert extract('<main><article><h1><a href="/p/1">My holiday</a></h1><p>We went to the sea.</p></article></main>') == "My holiday\nWe went to the sea."
    assert extract(f"<article><p>{LONG}</p><div class='share-buttons'>{papers}</div></article>") == LONG


@pytest.mark.parametrize("page_", ["<p>Hello there.</p>", "Hello there.", "<div>Hello <b>there.</b></div>", "<nav><a href='/'>Home page</a></nav><p>Hello there.</p><footer>(c) me</footer>", "<p>Hello there.</p><p>Copyright 2020</p>"])
def test_short_pages(page_):
    assert extract(page_) == "Hello there."


@pytest.mark.parametrize("name", ['class="menu-description"', 'id="navigation-history"', 'class="comment-on-law"', 'class="social"', 'class="related"', 'id="menu"'])
def test_text_under_a_weak_name_alone_on_its_page(name):
    text = f"{LONG} It was told to me by a friend. He had it from the man who ran the mill."
    assert extract(f"<body><nav><a href='/'>Home</a></nav><div {name}><p>{text}</p></div><footer>Me</footer></body>") == text


@pytest.mark.parametrize("name", ['class="ad"', 'class="sidebar"', 'class="comments"', 'class="cookie-notice"', 'id="newsletter"', 'class="sidebar"><div class="menu"'])
def test_text_under_a_strong_name_is_none(name):
    assert extract(f"<body><div {name}><p>{LONG}</p></div></body>") == ""


def test_headings_join_what_follows():
    assert extract(f"<div><h1>Title</h1></div><div class='post-content'><p>{LONG}</p></div>") == f"Title\n{LONG}"
    assert extract(f"<body><h1>Title</h1><h2>And more</h2><article><p>{LONG}</p></article></body>") == f"Title\nAnd more\n{LONG}"
    assert extract(f"<div class='menu'><a href='/'>Home</a></div><div><h1>Title</h1></div><div><p>{LONG}</p></div>") == f"Title\n{LONG}"
    assert extract(f"<p>{LONG}</p><h3>See also</h3><ul><li><a href='/1'>{LONG}</a></li></ul>") == LONG
    assert extract(f"<header><h1>Site</h1></header><article><p>{LONG}</p></article>") == LONG
    assert extract(f"<p>{LONG}</p><p>Copyright 2020</p>") == extract(f"<p>{LONG}</p><div>© 2021 Me. All rights reserved.</div>") == LONG


def test_two_passes_agree_with_plain_rules():
    import random

    rng = random.Random(9)
    for _ in range(400):
        kinds = rng.choices(list(KINDS), k=rng.randint(1, 9), weights=[rng.random() for _ in KINDS])
        blocks = [(k, KINDS[k](n)) for n, k in enumerate(kinds)]
        page_ = "<body>" + "".join(rng.choice((f"<p>{t}</p>", f"<div>{t}</div>", f"<section>{t}</section>")) for _, t in blocks) + "</body>"
        assert extract(page_) == "\n".join(plain_passes(blocks)), kinds


def test_page_rows(spark):
    d = spark.createDataFrame([(1, None, None, 1), (None, "u", page(f"<article><p>{LONG}</article>"), 2), (2, "u", "<p>" * 50_000, 3), (4, "u", f"<p>{LONG}", 4), (4, "u", f"<p>{LONG}", 4)], "page_id long, url string, html string, n_chars int")
    rows = extract_pages(d).collect()
    assert len(rows) == 5 and [r.text for r in rows if r.page_id == 4] == [LONG, LONG]
    got = {r.page_id: r for r in rows}
    assert got[1].text == "" and got[None].text == LONG and got[None].n_chars == len(LONG) and got[2].n_chars == 0
    assert extract_pages(d.limit(0)).count() == 0


def read_back(spark, d, **how):
    folder = fresh_path(spark, "warc")
    listed = W.write_archives(d, folder, **how).cache()
    listed.count()
    return W.read_archives(listed, folder), listed


def test_archives_round_trip(spark):
    big = "x" * 1500
    rows = [(1, "http://a/", big), (5, None, big), (3, "http://a/\n b", big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (None, "u", big), (5, "u", big), (10, "u", "é" * 600)]
    d = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got, listed = read_back(spark, d, archive_bytes=2000)
    found = defaultdict(list)
    for r in got.collect():
        found[r.page_id].append((r.payload_bytes, r.record_type, r.refers_to))
    assert found[1] == [(1500, "revisit", 5)] == found[3] == found[None]
    assert found[5] == [(1500, "response", None)] * 2
    assert found[7] == found[8] == [(5, "response", None)] and found[9] == [(0, "response", None)] and found[10] == [(1200, "response", None)]
    assert sum(r.records for r in listed.collect()) == len(rows)
    assert read_back(spark, d.limit(0))[0].count() == 0


def test_query_agrees_with_plain_groups(spark):
    got = {r.page_id: r for r in W.op6_warc_zstd(spark, "/root/testdata/sf0.001").collect()}
    groups = defaultdict(list)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in pages:
        groups[r.html].append(r.page_id)
    for r in pages:
        last = max(groups[r.html]) if len(r.html.encode()) >= 1000 else r.page_id
        assert got[r.page_id].record_type == ("response" if last == r.page_id else "revisit") and got[r.page_id].payload_bytes == len(r.html.encode())


def test_broken_archives_are_refused():
    import hashlib

    w = W.Writer(b"some shared words " * 20)
    raw = W.record(1, "u", b"payload", hashlib.sha1(b"payload").digest(), None)
    w.add(raw)
    w.add(W.record(2, "u", b"payload", hashlib.sha1(b"payload").digest(), 1))
    whole = w.bytes()
    assert [W.described(*x)[0] for x in W.read_records(whole)] == [1, 2]
    plain = zstandard.ZstdCompressor().compress
    for bad in (whole[:-3], whole[:6] + b"\xff\xff" + whole[8:], plain(raw[:-2]), plain(raw.replace(b"WARC/1.1", b"WORC/1.1")), plain(raw.replace(b"payload\r\n\r\n", b"pay1oad\r\n\r\n")), plain(raw.replace(b"WARC-Date", b"WARC-Dote")), b"junk"):
        with pytest.raises((W.BrokenArchive, zstandard.ZstdError)):
            list(W.read_records(bad))
    with pytest.raises(W.BrokenArchive):
        W.described(*W.parse(W.record(1, "u", b"payload", hashlib.sha1(b"other").digest(), None)))


def test_frames_of_any_form_are_read():
    import hashlib
    import io
    import struct

    for size, level in ((0, 1), (100, 3), (400_000, 3), (3_000_000, 19)):
        raw = W.record(7, "u", payload := (bytes(range(256)) * (size // 256 + 1))[:size] + b"z" * size, hashlib.sha1(payload).digest(), None)
        for checksum in (True, False):
            for known in (True, False):
                frame = zstandard.ZstdCompressor(level=level, write_checksum=checksum, write_content_size=known).compress(raw)
                other = struct.pack("<II", 0x184D2A51, 3) + b"abc"
                for whole in (frame * 2, other + frame + other + frame):
                    assert [W.described(*x)[:2] for x in W.read_records(io.BytesIO(whole))] == [(7, 2 * size)] * 2
                for bad in (frame[:-1], frame[:3], frame + frame[:9], frame + b"\x00" * 5):
                    with pytest.raises(W.BrokenArchive):
                        list(W.read_records(bad))


def test_time_grows_with_the_archive():
    import hashlib
    import random

    rng, took = random.Random(1), {}
    payloads = [rng.randbytes(2200) for _ in range(500)]
    for n in (1000, 8000):
        w = W.Writer(b"words " * 100)
        for k in range(n):
            w.add(W.record(k, "u", payloads[k % 500], hashlib.sha1(payloads[k % 500]).digest(), None))
        whole, began = w.bytes(), time.perf_counter()
        assert sum(1 for _ in W.read_records(whole)) == n
        took[n] = time.perf_counter() - began
    assert took[8000] < 20 * took[1000]


def test_a_payload_of_most_pages_is_met_without_an_exchange(spark, monkeypatch):
    monkeypatch.setattr(W, "HOT", 3)
    rows = [(k, "u", "x" * 1000 if k % 2 else ("y" if k % 3 else "z") * 1200 + str(k // 8)) for k in range(80)] + [(200, "u", "é" * 2_000_000)]
    got, _ = read_back(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    last = {}
    for k, _, h in rows:
        last[h] = max(last.get(h, 0), k)
    found = {r.page_id: r for r in got.collect()}
    assert len(found) == len(rows)
    for k, _, h in rows:
        assert found[k].refers_to == (None if last[h] == k else last[h]) and found[k].payload_bytes == len(h.encode())


def test_hosts_with_a_common_line_count_documents_once(spark):
    d = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("h").alias("source"), F.concat(F.lit("all share this\nall share this\nmine "), F.col("id").cast("string"), F.lit(" " + "and more words here " * 8)).alias("text"))
    got = L.line_rules(d, max_documents=39).collect()
    assert all(r.removed_words == 6 for r in got)
    assert all(r.removed_words == 0 for r in L.line_rules(d, max_documents=40).collect())


def test_lines_of_all_rows_of_an_id_count(spark):
    rows = [(k, "a", "own line") for k in range(3)] + [(k, "a", "the line\nthe line") for k in range(3)] + [(0, "a", "The Line")]
    got = L.line_rules(spark.createDataFrame(rows, "doc_id long, source string, text string"), max_documents=2, min_words=1).collect()
    assert sorted(r.removed_words for r in got) == [2, 2, 2, 2, 4, 4, 4]
    # three rows of two ids are two documents
    got = L.line_rules(spark.createDataFrame(rows[3:5] + rows[6:], "doc_id long, source string, text string"), max_documents=2, min_words=1).collect()
    assert [r.removed_words for r in got] == [0, 0, 0]


def test_line_rules_agree_with_plain_counts(spark, monkeypatch):
    import random

    rng = random.Random(2)
    common = [f"line {'abcdefgh'[k]} which many share" for k in range(8)]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "a", "b"]), "\n".join([*rng.choices(common, k=rng.randint(0, 4)), f"own {'x' * k}"])) for k in range(300)]
    documents = defaultdict(set)
    for k, (d, h, t) in enumerate(rows):
        for line in set(t.split("\n")):
            documents[h, line].add(d if d is not None else -1 - k)
    want = sorted((str(d), str(h), sum(len(x.split()) for x in t.split("\n") if len(documents[h, x]) > 30), len(t.split())) for d, h, t in rows)
    for parts, few, hot in ((1, 200_000, 10_000), (5, 0, 10_000), (7, 0, 6)):
        monkeypatch.setattr(L, "BROADCAST_LINES", few)
        monkeypatch.setattr(L, "HOT", hot)
        d = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)
        assert sorted((str(r.doc_id), str(r.host), r.removed_words, r.n_words) for r in L.line_rules(d, max_documents=30).collect()) == want
