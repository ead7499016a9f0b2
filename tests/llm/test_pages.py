import io
import re
import zlib
from collections import Counter

import duckdb
import pytest

from pyspark.sql import functions as F

from postlens.llm import main_text as module
from postlens.llm import warc
from postlens.llm.main_text import extract_pages, main_text
from tests.conftest import SF

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header>Site name</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, a long text about them.</div>
<main><article><header><h1>The &amp; head</h1></header><p>One <b>tw</b>o &#233;&nbsp;three<br>four<p>Five<ul><li>six<li>seven</ul>
<script>var t="</p>";</script><form><input> Name <button>Go</button></form><aside>See also</aside>
<section id="comments"><p>Nice article, thanks a lot for writing it down!</p></section></article></main>
<div class="AdBox ad">Buy</div><footer>&copy; us</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "The & head One two é three four Five six seven"


def test_page_without_an_article_element():
    body = "".join(f"<p>{'Some words of the text here. ' * 8}</p>" for _ in range(3))
    page = f"<body><div id=menu><a href=1>a</a><a href=2>b</a></div><div><h1>Title</h1>{body}<p>Short end.</p></div><div><a href=3>More about this</a></div>"
    text = main_text(page)
    assert text.startswith("Title Some words") and text.endswith("Short end.") and "More" not in text


def test_broken_pages():
    assert [main_text(x) for x in ("", "<", "<p", "a < b", "plain &amp; simple", "<p>open <b>text &am", "<!-- x", "<p>a</div>b</p></p>", "<p title=\">\">q</p>", "<script>x")] == [
        "", "<", "", "a < b", "plain & simple", "open text &am", "", "ab", "q", ""]
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"


def test_extract_handles_odd_rows(spark):
    rows = [(1, "u", PAGE), (None, None, None), (2, "u", ""), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    found = extract_pages(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in found) == [(0, 0), (1, 46), (1, 46), (2, 0)]
    assert extract_pages(pages.limit(0)).count() == 0


ARTICLE = "<h2>About it</h2>" + "".join(f"<p>{'Some words of an article that goes on for a while here. ' * k}</p>" for k in (2, 5, 3))
WHOLE = "About it " + " ".join(["Some words of an article that goes on for a while here."] * 10)


@pytest.mark.parametrize("box", [
    '<div class="content no-sidebar">%s</div>', '<div class="content-with-sidebar">%s</div>', '<div class="post share-enabled">%s</div>',
    '<div class="page-modal-open">%s</div>', '<section id="comments-on-policy">%s</section>', '<div class="comments">%s</div>',
    "<article>%s</article>", "<main><div>%s</div></main>", "<div><div><div>%s</div></div></div>"])
def test_boxes_around_the_article(box):
    page = "<body><div><a href=1>Home</a><a href=2>News</a></div>%s<div class='cookie-notice'>We use cookies.</div></body>"
    assert main_text(page % (box % ARTICLE)) == WHOLE


def test_names_that_only_hold_a_word_of_the_list():
    assert main_text(f"<div><p class='copyright-law'>On law.</p>{ARTICLE}<p class='ad-box'>Buy</p></div>") == "On law. " + WHOLE


def test_density_decides_without_names():
    """Given pages with all their elements renamed: the text is that of the named page, and
    a density that says nothing would not find it."""
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF.replace('0.001', '0.01')}/pages.parquet'").fetchall()]
    bare = [re.sub(r"<(/?)(article|main|nav|footer|aside)\b", r"<\1div", h).replace(' class="ad"', "") for h in pages]
    named = [re.sub(r"<(/?)(article|main)\b", r"<\1div", h) for h in pages]
    texts = list(map(main_text, pages))
    assert sum(main_text(b) == t for b, t in zip(named, texts)) >= 0.99 * len(pages)
    # Articles of a few words are less dense than the notices beside them.
    assert sum(main_text(b) == t for b, t in zip(bare, texts)) >= 0.9 * len(pages)
    density, module._density = module._density, lambda *_: 1.0
    try:
        assert sum(main_text(b) == t for b, t in zip(bare, texts)) < 0.8 * len(pages)
    finally:
        module._density = density


def test_very_long_page():
    page = f"<div><a href=1>x</a></div><div>{'<p>words of the text</p>' * 30_000}</div>"
    assert main_text(page) == " ".join(["words of the text"] * 30_000)


def archive(payloads):
    out = b""
    for i, p in enumerate(payloads):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += packer.compress(warc._record("response", i, f"http://x/{i}\r\nX: y", p, "d", None, str(i))) + packer.flush()
    return out


def test_any_split_reads_each_record_once():
    # Payloads that hold gzip members and headers of records themselves.
    inner = archive([b"inner"])
    data = archive([b"", b"a" * 10, inner, b"\x1f\x8b\x08" * 50, b"WARC/1.1\r\n\r\n", bytes(range(256)) * 900])
    whole = [(h["x-page-id"], b) for h, b in warc.records_in(io.BytesIO(data), len(data), 0, len(data))]
    assert [x for x, _ in whole] == list("012345") and whole[2][1].endswith(inner)
    for size in (1, 7, 100, 1000):
        parts = [x for s in range(0, len(data), size) for x in warc.records_in(io.BytesIO(data), len(data), s, s + size)]
        assert [(h["x-page-id"], b) for h, b in parts] == whole


def test_round_trip_with_odd_rows_in_small_files_and_splits(spark):
    big = "é" * 60
    rows = [(5, "u", big), (3, None, big), (9, "a b\n", big), (None, "u", big), (4, "u", "small"), (6, "u", "small"),
            (7, "u", None), (8, "u", ""), (3, "u", big), (None, "u", "x" * 200), (None, "u", "x" * 200), (11, "u", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1))
    found = warc.archive_pages(spark, pages, archive_bytes=300, split_bytes=64).collect()
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found)
    assert got == sorted([
        (5, 120, "revisit", 3), (3, 120, "response", None), (9, 120, "revisit", 3), (0, 120, "revisit", 3),
        (4, 5, "response", None), (6, 5, "response", None), (7, 0, "response", None), (8, 0, "response", None),
        (3, 120, "response", None), (0, 200, "response", None), (0, 200, "response", None), (11, 300_000, "response", None)])
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_hot_payload_is_spread_over_tasks(spark):
    rows = [(i, f"u{i}", "x" * 200 if i % 3 else "" if i % 2 else f"page {i} " * 30) for i in range(9000)]
    rows += [(None, None, "x" * 200), (4, "again", "x" * 200), (None, "n", "y" * 150), (None, "m", "y" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        planned = warc.plan_records(pages).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    tasks = Counter(r["task"] for r in planned)
    # A third of all rows would be 3,000, and 6,000 have the hot payload.
    assert max(tasks.values()) < 2200 and len(tasks) == 16
    got = sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in planned), key=repr)
    smallest = {}
    for page, _, html in rows:
        if page is not None:
            smallest[html] = min(page, smallest.get(html, page))
    expected = []
    for page, url, html in rows:
        first = smallest.get(html) if len(html) >= 100 else None
        again = first is not None and page != first
        expected.append((page, url, "revisit" if again else "response", first if again else None))
    assert got == sorted(expected, key=repr)
