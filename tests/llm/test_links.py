"""Links of pages: only markup counts, as a browser would read it."""

import pytest
from millrace.llm import page_links as K
from millrace.llm import url_rules as U
from pyspark.sql import functions as F

CASES = [
    ('<link rel="canonical" href="http://b.org/x">', ["http://b.org/x"]),
    ("<LINK HREF='http://b.org/x' REL=Canonical>", ["http://b.org/x"]),
    ("<link rel=canonical href=http://b.org/x/>", ["http://b.org/x/"]),
    ('<link rel="alternate canonical" href="/y?q=1#f">', ["http://a.org/y?q=1#f"]),
    ('<!-- <link rel="canonical" href="http://b.org/x"> -->', []),
    ('<!-- open <link rel="canonical" href="http://b.org/x">', []),
    ('<script>var s = \'<link rel="canonical" href="http://b.org/x">\';</script>', []),
    ('<template><link rel="canonical" href="http://b.org/x"></template><link rel=canonical href=z>', ["http://a.org/p/z"]),
    ('<link data-rel="canonical" href="http://b.org/x">', []),
    ('<link title="rel=canonical href=/no" rel="icon" href="/i.png">', []),
    ('<link title="a > b" rel="canonical" href="http://b.org/x">', ["http://b.org/x"]),
    ('<link rel="canonical" href="http:&#47;&#x2F;b.org&sol;x&amp;y&copy;">', ["http://b.org/x&y&copy;"]),
    ('<base href="http://c.org/d/e"><link rel="canonical" href="f">', ["http://c.org/d/f"]),
    ('<base href="/d/"><link rel="canonical" href="../f/./g">', ["http://a.org/f/g"]),
    ('<link rel="canonical" href="//b.org/x">', ["http://b.org/x"]),
    ('<link rel="canonical" href="?p=2">', ["http://a.org/p/q?p=2"]),
    ('<link rel="canonical" href="/go?to=http://b.org/">', ["http://a.org/go?to=http://b.org/"]),
    ('<link rel="canonical" href="#top"><link rel="canonical" href=""><link rel="canonical"><link rel="canonical" href="mailto:x@y">', []),
    ('<meta http-equiv="Refresh" content="0; url=\'http://b.org/x\'">', ["http://b.org/x"]),
    ('<meta http-equiv=refresh content="5;URL=/y">', ["http://a.org/y"]),
    ('<meta http-equiv="refresh" content="5"><meta name="x" content="url=/y">', []),
    ('<linker rel="canonical" href="/y"><a rel="canonical" href="/y">', []),
    ("canonical" + "<link " + "a='" * 3000, []),
    ("<!--" + "x" * 300_000 + "--><link rel=canonical href=/y>", ["http://a.org/y"]),
    ("canonical " + "<" * 100_000 + '"' * 1001, []),
    (None, []), ("", []),
]


def test_targets(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "i int, html string")
    got = {r.i: r.t for r in rows.select("i", K.alias_targets(F.col("html"), F.lit("http://a.org/p/q?x=1")).alias("t")).collect()}
    for i, (html, want) in enumerate(CASES):
        assert got[i] == want, html


@pytest.mark.parametrize(("text", "want"), [("a&b", "a&b"), ("&#233;&#x1F600;", "é😀"), ("&#0;&#xD800;&#99999999;", "&#0;&#xD800;&#99999999;"), ("&&amp;;", "&&;"), ("&lt", "&lt"), ("", "")])
def test_references(spark, text, want):
    assert spark.range(1).select(K.decoded(F.lit(text)).alias("t")).first().t == want


RULES = [("b.org", "/", "block"), ("good.org", "/", "allow")]


def test_only_real_links_carry_a_block(spark):
    block = '<link rel="canonical" href="http://b.org/x">'
    pages = [("http://a.org/1", block), ("http://a.org/2", f"<!-- {block} -->"), ("http://a.org/3", f"<script>'{block}'</script>"), ("http://a.org/4", block.replace(" rel", " data-rel")), (None, block), ("no scheme", block)] + [(None, None)] * 30
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    out = U.url_verdicts(rows, RULES)
    got = {r.page_id: r.verdict for r in out.collect()}
    assert [got[i] for i in range(6)] == ["block", "allow", "allow", "allow", "allow", "allow"] and len(got) == 36
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
