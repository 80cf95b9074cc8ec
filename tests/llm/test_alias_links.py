"""Alias edges of long tags, of several tags of a page, and with entities."""

import time

from preflux.llm import url_filter


def test_every_link_of_a_page(spark):
    link = '<link {}rel="canonical" href="{}">'
    go = "<meta http-equiv=refresh {}content='0; url={}'>"
    long = 'data-x="' + "x" * 5000 + '" '
    rows = [
        (0, "https://a.com/long", link.format(long, "http://bad.net/z")), (1, "https://b.com/long", go.format(long, "http://bad.net/z")),
        (2, "https://c.com/second", link.format("", "https://c.com/other") + link.format("", "http://bad.net/z")),
        (3, "https://d.com/second", go.format("", "/other") + "<p>" + go.format("", "//bad.net/z")),
        (4, "https://e.com/amp", link.format("", "/list?a=1&amp;b=2")), (5, "https://e.com/list?a=1&b=2", link.format("", "http://bad.net/z")),
        (6, "https://f.com/num", link.format("", "/list?a=1&#38;b=2")), (7, "https://f.com/list?a=1&b=2", go.format("", "http://bad.net/z?q=1&AMP;lt;")), (8, "http://good.org/x?q=1&lt;", ""),
        (9, "https://g.com/", '<link rel="icon" href="http://bad.net/z"><a href="http://bad.net/z">'), (10, "https://h.com/wide", '<link rel' + " " * 30 + '= "canonical" href="http://bad.net/z">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.verdict for r in url_filter.filter_urls(pages).collect()}
    assert got == {**dict.fromkeys((0, 1, 2, 3, 4, 5, 6, 7, 10), "block"), 8: "allow", 9: "allow"}


def test_time_follows_length(spark):
    """Unclosed and attribute-less tags of a very long page cost no more than its length."""
    pages = spark.createDataFrame([(0, "https://a.com/", "<link " * 200_000), (1, "https://b.com/", "<meta http-equiv" + " x" * 300_000 + ">")], "page_id long, url string, html string")
    start = time.time()
    assert {r.verdict for r in url_filter.filter_urls(pages).collect()} == {"allow"} and time.time() - start < 60


def verdicts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.id: r.verdict for r in url_filter.filter_urls(pages).collect()}


def test_tags_are_read_as_tags(spark):
    """Lists of rel words, whole attribute names, quoted angle brackets, dot segments, and no tags inside comments, scripts and the like."""
    bad = "http://bad.net/z"
    rows = [
        (0, "https://a.com/0", f'<link rel="nofollow canonical" href="{bad}">'), (1, "https://a.com/1", f'<link data-href="http://x.com/" rel=canonical href="{bad}">'),
        (2, "https://a.com/2", f'<link rel="canonical" title="a > b" href="{bad}">'), (3, "https://a.com/p/q/3", '<link rel=canonical href="../../list/./z">'), (4, "https://a.com/list/z", f"<link rel=canonical href={bad}>"),
        (5, "https://a.com/5", f'<!-- <link rel="canonical" href="{bad}"> -->'), (6, "https://a.com/6", f"<script type='x>y'>var s = '<link rel=canonical href={bad}>'</script>"), (7, "https://a.com/7", f"<title><link rel=canonical href={bad}></title>"),
        (8, "https://a.com/8", f'<link rel="canonical-of" href="{bad}">'), (9, "https://a.com/9", f'<link rel="icon" rel="canonical" href="{bad}">'), (10, "https://a.com/10", f'<meta content="5;URL={bad}" HTTP-EQUIV="Refresh">'),
        (11, "https://a.com/11", f'<meta name="x" content="http-equiv=refresh url={bad}">'), (12, "https://a.com/12?q", '<link rel=canonical href="#top">'), (13, "https://a.com/13", '<link rel=canonical href="mailto:x@bad.net">'),
        (14, "https://a.com/14", '<link rel=canonical href="?go">'), (15, "https://a.com/14?go", f"<link rel=canonical href={bad}>"), (16, "https://a.com/x/../16", ""), (17, "https://b.com/", '<link rel=canonical href="https://a.com/16">'), (18, "https://a.com/16", f"<link rel=canonical href={bad}>"),
        (19, "https://a.com/19", "<!-- open"), (20, "https://a.com/20", f'<style></style><link rel=canonical href="{bad}"><script>'), (21, "https://a.com/21", f"<link rel='canonical' href='{bad}"), (22, "https://a.com/a/22", '<link rel=canonical href="../../../../list/z">'),
    ]
    got = verdicts(spark, rows)
    assert {i for i, v in got.items() if v == "block"} == {0, 1, 2, 3, 4, 10, 14, 15, 16, 17, 18, 20, 22}


def test_very_long_hosts_and_pages(spark):
    start = time.time()
    got = verdicts(spark, [(0, "https://" + "a." * 50_000 + "net/", ""), (1, "https://" + "a." * 50_000 + "com/", "<link '" * 50_000), (2, "https://c.com/", "<!--" * 50_000 + '<link "' * 50_000), (3, "https://d.com/", "<link " + 'a="b" ' * 100_000 + "rel=canonical href=http://bad.net/>")])
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "block"} and time.time() - start < 60
