"""Main content by text density, and robots rules by their literals, against plain versions."""

import gzip
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from startline.functions import markup
from startline.operators import robots
from startline.plans import catalog

GONE = {"nav", "footer", "aside", "script", "style", "noscript"}
ADDS = {"article": 0.2, "main": 0.2, "section": 0.05, "p": 0.1, "blockquote": 0.1, "pre": 0.1, "table": 0.05, "div": 0.0, "ul": 0.0, "ol": 0.0, "header": 0.0, "form": -0.2}


class Plain(HTMLParser):
    """Nested lists: [tag, attributes, children]."""

    def __init__(self, page):
        super().__init__()
        self.open = [["", {}, []]]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in markup.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.open[1:]]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def counts(node):
    """Characters, characters within links, elements."""
    if node[0] in GONE:
        return 0, 0, 0
    t = l = g = 0  # noqa: E741
    for c in node[2]:
        if isinstance(c, str):
            t += len(re.sub(r"\s", "", c))
        else:
            a, b, n = counts(c)
            t, l, g = t + a, l + b, g + n + 1  # noqa: E741
    return t, t if node[0] == "a" else l, g


def kept_words(node):
    """Words outside what is left out, in order."""
    if node[0] in GONE:
        return []
    if node[0] in ADDS:
        t, links, g = counts(node)
        score = (0.5 * t / (t + 12 * g) + 0.5 * (t - links) / t if t else 0) + ADDS[node[0]]
        if set(re.split(r"[\s_-]+", f"{node[1].get('class') or ''} {node[1].get('id') or ''}".lower())) & markup.ASIDE_WORDS:
            score -= 0.6
        if score < 0.45:
            return []
    return [w for c in node[2] for w in (c.split() if isinstance(c, str) else kept_words(c))]


def words(text):
    return re.sub(r"(?m)^(#{1,6}|\*) |\|", " ", text).split()


def test_content_of_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r["markdown"] for r in pages.select("page_id", markup.page_content("html").alias("markdown")).collect()}
    for r in pages.collect():
        plain = re.sub(r"[#*|]", " ", " ".join(kept_words(Plain(r["html"] or "").open[0]))).split()
        assert re.sub(r"[#*|]", " ", got[r["page_id"]]).split() == plain


@pytest.mark.parametrize("name", ["main_text_rule", "price_repair"])
def test_pages_made_from_a_small_file_are_parsed_by_all_cores(spark, data, name):
    assert catalog.queries()[name](spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_what_goes_and_what_stays():
    page = """<body><div class="top-menu">Home and a long line that only looks like text of a page</div><div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>
      <main><header><h2>10K race</h2> £25</header><p>The start is at the hall at nine, and <a href=3>the map</a> shows the way to it.</p><div><p>Short.</p></div></main>
      <form><label>Mail</label><input><input></form></body>"""
    got = markup.dense_text(page)
    assert "10K race" in got and "£25" in got and "the map" in got and "Short." in got
    assert not re.search("Home|One|Two|Mail", got)
    assert markup.dense_text("") == "" and markup.dense_text("just text") == "just text"
    deep = "<div>" * 5000 + "some text that lies very deep" + "</div>" * 5000
    assert markup.main_text(deep) == "some text that lies very deep"
    assert markup.dense_text("<p>" + "long text without end " * 50_000).count("long text") == 50_000


def test_rules_meet_paths_by_their_literals(spark):
    rnd = random.Random(4)
    letters = lambda n: "".join(rnd.choice("abc./?=") for _ in range(n))
    patterns = {"/" + letters(rnd.randrange(4)) + rnd.choice(["", "*", "$", "*" + letters(2) + "$", "*" + letters(1)]) for _ in range(150)} | {"*", "$", "/", "*.c$", "/*.c$", "/a**b$"}
    rules = [("https://s", rnd.random() < 0.4, p, None) for p in sorted(patterns)] + [("https://t", False, "/", 2.0), ("https://u", None, None, 1.0)]
    urls = sorted({f"https://{rnd.choice('stu')}/" + letters(rnd.randrange(6)) for _ in range(400)})

    def plain(url):
        site, path = url[:9], url[9:]
        best = (0, True)
        for s, allow, p, _ in rules:
            if s == site and p is not None:
                tail, body = p.endswith("$"), p.removesuffix("$")
                if re.match(".*".join(map(re.escape, body.split("*"))) + ("$" if tail else ""), path):
                    best = max(best, (len(p), allow))
        return best[1]

    df = spark.createDataFrame(rules, "site string, allow boolean, pattern string, delay double")
    got = {r["url"]: r["allowed"] for r in robots.allowed(spark.createDataFrame([(u,) for u in urls], "url string"), df).collect()}
    assert got == {u: plain(u) for u in urls}


def test_many_rules_of_one_site_do_not_meet_every_path(spark):
    rules = spark.range(100_000).select(F.lit("https://s").alias("site"), (F.col("id") % 2 == 0).alias("allow"), F.concat(F.lit("/d"), F.col("id").cast("string"), F.lit("/x")).alias("pattern"))
    asked = spark.range(20_000).select(F.lit("https://s").alias("site"), F.concat(F.lit("/d"), (F.col("id") * 7).cast("string"), F.lit("/x/page?q=1")).alias("path"))
    hit = robots.met(asked, robots.indexed(rules))
    assert hit.count() == 100_000 // 7 + 1
    assert hit.where("NOT plain").isEmpty()


def test_packed_files_are_bounded():
    text = bytes(range(256)) * 20_000
    packed = gzip.compress(text[:700]) + gzip.compress(text) + gzip.compress(b"")
    assert markup.unpacked(packed) == text[:700] + text
    assert markup.unpacked(packed, most=5_000_000) is None and markup.unpacked(packed, most=len(text) + 700) is not None
    assert markup.unpacked(packed[:-5]) is None and markup.unpacked(packed[:1000]) is None
    assert markup.unpacked(b"\x1f\x8bjunk") is None and markup.unpacked(gzip.compress(b"x") + b"junk") is None
