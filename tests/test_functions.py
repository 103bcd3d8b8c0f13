from __future__ import annotations

import html
from html.entities import html5
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from sigmill import schemas
from sigmill.functions import text as tx
from sigmill.functions import urls
from sigmill.functions import vectors as vx


def values(spark, inputs, column):
    frame = spark.createDataFrame(list(enumerate(inputs)), "i int, v string").select("i", column.alias("out"))
    return [r["out"] for r in frame.orderBy("i").collect()]


# Landed address and the key it is stored under, written out by hand.
CANONICAL = {
    # Tracking parameters go, whatever their place; names that only resemble them stay.
    "https://shop.example/item?ref=9&utm_campaign=sale": "https://shop.example/item?ref=9",
    "https://shop.example/item?fbclid=AbC&ref=9&gclid=Q": "https://shop.example/item?ref=9",
    "https://shop.example/item?utm_medium=mail": "https://shop.example/item",
    "https://shop.example/item?UTM_medium=mail&xutm_=1": "https://shop.example/item?UTM_medium=mail&xutm_=1",
    # Order, repeats and empty values of the others are kept.
    "http://forum.example/t?b=2&a=1&b=3&empty=": "http://forum.example/t?b=2&a=1&b=3&empty=",
    "http://forum.example/t?flag&&x=y=z": "http://forum.example/t?flag=&x=y%3Dz",
    # Case of scheme and host only.
    "HTTP://Forum.Example:8080/Topic/A": "http://forum.example:8080/Topic/A",
    # Slashes at the end of a path.
    "https://forum.example/topic///": "https://forum.example/topic",
    "https://forum.example//": "https://forum.example/",
    "https://forum.example": "https://forum.example",
    "https://forum.example?page=4": "https://forum.example?page=4",
    # Fragments and parameters of the path.
    "https://forum.example/topic/#Last": "https://forum.example/topic#Last",
    "https://forum.example/topic/;v=2": "https://forum.example/topic;v=2",
    # Escapes are read and written anew.
    "https://forum.example/t?q=caf%C3%A9+noir&w=50%": "https://forum.example/t?q=caf%C3%A9+noir&w=50%25",
    "https://forum.example/t?star=*&tilde=%7E": "https://forum.example/t?star=%2A&tilde=~",
    # White space around and inside an address.
    "  https://forum.example/to\tpic\n": "https://forum.example/topic",
    # No address at all.
    "forum.example/topic": None,
    "//forum.example/topic": None,
    "https://": None,
    "mailto:someone@forum.example": None,
    "": None,
}
URLS = list(CANONICAL)


def test_canonical_url(spark):
    assert dict(zip(URLS, values(spark, URLS, urls.canonical_url("v")), strict=True)) == CANONICAL


def test_canonical_url_is_idempotent(spark):
    # Path parameters are left out: cutting them bares slashes that a second pass would trim.
    once = urls.canonical_url("v")
    first = values(spark, [u for u in URLS if ";" not in u], once)
    again = values(spark, [u for u in first if u], once)
    assert again == [u for u in first if u]


def test_host_and_safe_domain(spark):
    given = ["https://U:p@Ex.COM:80/x", "http://[::1]:8/p", "nope"]
    assert values(spark, given, urls.url_host("v")) == ["ex.com", "::1", None]
    assert values(spark, [" Shop.COM:80/é "], urls.safe_domain("v")) == ["shop.com_80__"]


def test_review_url(spark):
    assert values(spark, ["app"], urls.review_url(F.col("v"), F.lit("id-1"))) == [
        "https://play.google.com/store/apps/details?id=app#review=id-1"
    ]


def test_entities(spark):
    given = ["a &amp; b &lt;x&gt; &#8381; &#x20BD;&nbsp;| &bogus; &amp;lt; &#0; &amp;#8381; &eacute;", "plain", "&amp;&amp;"]
    assert values(spark, given, tx.decode_entities("v")) == [html.unescape(t) for t in given]


def test_every_named_and_numbered_entity(spark):
    names = sorted(html5)
    given = [f"a&{n}b" for n in names] + [f"&{n.rstrip(';')}" for n in names] + [f"&x{n} &{n}&{n}" for n in names[::9]]
    given += ["&notit; &notin; &ampersand &AMP&amp;amp; &copy2024 &unknown; & &; &#; &#x; &#xZ; &a b", "&" + "n" * 40 + ";", "&é;", "&lt&gt", "&\U0001F600;"]
    numbers = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 10**12, 10**30]
    given += [f"x&#{n};y" for n in numbers] + [f"x&#{n} y" for n in numbers] + [f"x&#x{n:x};y" for n in numbers] + [f"x&#X000{n:X}gy" for n in numbers]
    assert values(spark, given, tx.decode_entities("v")) == [html.unescape(t) for t in given]


def test_closed_entities(spark):
    given = ["a &amp; b &amp c&lt", "&amp;&amp</h1>", "&#39; &#39 &#x27; &#x27g", "&ampersand; &notit; &copy;2024 &copy2024", "&eacute;&amp;lt;", "plain"]
    wanted = ["a & b &amp c&lt", "&&amp</h1>", "' &#39 ' &#x27g", "&ampersand; &notit; ©2024 &copy2024", "é&lt;", "plain"]
    assert values(spark, given, tx.decode_entities("v", closed=True)) == wanted
    page = "<body><h1>Salt &amp;&amp</h1><p>more &amp; more</p></body>"
    assert values(spark, [page, page.replace("body", "article")], tx.main_text("v", closed=True)) == ["Salt &&amp more & more"] * 2


ARTICLE = """<html><head><style>.x{display:none}</style></head><body><nav>Home</nav>
<!-- <p>comment</p> --><article class="a"><h1>Title</h1><p>First <b>bold<p>second &amp; third</article>
<script>track("</p>never-leak");</script><noscript>off</noscript><footer>test footer</footer></body></html>"""


def test_main_text(spark):
    plain = '<html><body><script>var x = "noise";</script><div>Plain page</div><div>Second block</div></body></html>'
    empty_article = "<body><article> <i></i></article><p>Body text</p></body>"
    assert values(spark, [ARTICLE, plain, empty_article, "<html><body></body></html>", "no tags"], tx.main_text("v")) == [
        "Title First bold second & third", "Plain page Second block", "Body text", "", "no tags",
    ]


def test_short_flag(spark):
    assert values(spark, ["", "x" * 199, "x" * 200], tx.is_short("v")) == [True, True, False]


DATES = [
    "Mon, 02 Jan 2006 15:04:05 GMT", "2 Jan 2006 15:04:05 +0300", "Tue, 3 Sep 2024 1:02 EST", "bad", "",
    "Wed, 02 Oct 2002 13:00:00 -0000", "Sat, 31 Feb 2024 00:00:00 GMT", "02 Jan 69 10:00:00 Z", "02 Jan 68 10:00:00 UT",
]


def test_rfc822(spark):
    def wanted(text):
        try:
            parsed = parsedate_to_datetime(text)
        except (TypeError, ValueError):
            return None
        return str((parsed - parsed.utcoffset() if parsed.utcoffset() else parsed).replace(tzinfo=None))

    assert values(spark, DATES, tx.rfc822_utc("v").cast("string")) == [wanted(d) for d in DATES]


def test_fence_and_blank(spark):
    given = ["```json\n{}\n```", " ```\na\r\nb\n``` ", "```", "```x```", "plain ", "```\n```"]
    assert values(spark, given, tx.unfence("v")) == ["{}", "a\nb", "", "", "plain", ""]
    blanks = ["", " \t\n", "  ", "\x1c", "x"]
    assert values(spark, blanks, tx.has_text("v")) == [bool(t.strip()) for t in blanks]
    assert values(spark, ["  a b  \n"], tx.strip("v")) == ["a b"]


def test_strict_json(spark):
    given = ['{"a":1}', ' {"a":1} ', '{"a":1} x', '{"a":1},{"b":2}', "[1]", "", "1],[2", '{"a":1,"a":2}', "null", "{'a':1}"]
    assert values(spark, given, F.to_json(tx.strict_json("v"))) == [
        '{"a":1}', '{"a":1}', None, None, "[1]", None, None, '{"a":2}', "null", None,
    ]


def test_mask_age_labels_hash(spark):
    assert values(spark, ["", "abcd", "abcde", "sk-secret-9876"], tx.mask_secret("v")) == ["****", "****", "****bcde", "****9876"]
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    given = ["2024-01-03 00:00:00", "2024-01-01 23:59:01", "2024-01-01 23:59:00", "2024-01-01 22:30:00", "2023-12-31 01:00:00"]
    assert values(spark, given, tx.coarse_age(F.col("v").cast("timestamp"), now)) == [
        "только что", "только что", "1 мин назад", "1 ч назад", "31.12.2023",
    ]
    kinds = F.create_map(F.lit("demand"), F.lit(2), F.lit("complaint"), F.lit(0), F.lit("other"), F.lit(1))
    assert values(spark, ["x"], tx.kinds_label(kinds)) == ["заказ 2, other 1"]
    assert values(spark, ["x"], tx.kinds_label(F.create_map().cast("map<string,int>"))) == ["—"]
    import hashlib

    digest = int.from_bytes(hashlib.sha256("фраза".encode()).digest()[:4], "big")
    assert values(spark, ["фраза"], tx.hash_bucket("v", 10_001)) == [digest % 10_001]


def test_append_once_and_keep(spark):
    once = tx.append_once(F.col("v"), "MARK", " MARK")
    assert values(spark, ["a"], tx.append_once(once, "MARK", " MARK")) == ["a MARK"]
    assert values(spark, ["", "new"], tx.keep_if_blank(F.col("v"), F.lit("old"))) == ["old", "new"]


def test_vectors(spark):
    frame = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<float>")
    got = frame.select("id", vx.norm("v").alias("n"), vx.unit("v").alias("u"), vx.dot("v", "v").alias("d")).orderBy("id").collect()
    assert [(r["n"], r["u"], r["d"]) for r in got] == [(5.0, [0.6, 0.8], 25.0), (0.0, [0.0, 0.0], 0.0)]
    assert values(spark, ["[1,-0.5, 2e-3]"], vx.from_literal("v")) == [[1.0, -0.5, pytest.approx(0.002)]]


def test_split_valid(spark, rows):
    frame = spark.createDataFrame(
        [("a", "https://u/1", "demand", None), ("b", None, "demand", "new"), ("c", "https://u/2", "praise", "new"),
         ("d", "https://u/3", "complaint", "banned"), ("e", "https://u/4", None, "new")],
        "id string, url_canon string, kind string, fetch_status string",
    )
    good, rejects = schemas.split_valid(frame, schemas.raw_post_rules())
    assert rows(good, "id") == [("a",)]
    assert rows(rejects, "id", "reason") == [("b", "url_canon"), ("c", "kind"), ("d", "fetch_status"), ("e", "kind")]
