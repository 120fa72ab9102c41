"""Column functions on single values."""

import datetime

import pytest
from pyspark.sql import functions as F

from startline.functions import coerce, dates, markup, text, urls


def value(spark, column, **columns):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "slug"),
    [("  Half  Marathon! ", "half_marathon"), ("5 K", "5_k"), ("\t10k\n", "10k"), ("--", ""), ("", ""), ("Übung", "bung"), (None, None)],
)
def test_slugify(spark, given, slug):
    assert value(spark, text.slugify(F.col("x")), x=given) == slug


@pytest.mark.parametrize(
    ("sport", "category", "label"),
    [
        ("Running", "5 K", "running_5k"), (" RUNNING ", "12_k", "running_12_k"), ("athletics", "Kids Race", "other_junior"), (None, "70.3", "other_half_ironman"),
        ("triathlon", "Standard Triathlon", "triathlon_olympic_triathlon"), ("running", "", None), ("running", " !! ", None), ("running", None, None), ("multi sport", "20k", "multi_sport_20k"),
    ],
)
def test_race_label(spark, sport, category, label):
    assert value(spark, text.race_label(F.col("s"), F.col("c")), s=sport, c=category) == label


def test_every_alias(spark):
    for alias, name in text.CATEGORY_ALIASES.items():
        assert value(spark, text.canonical_category(F.col("x")), x=alias) == name


@pytest.mark.parametrize(("given", "code"), [("Showground, Town. DE45 1AH", "DE45 1AH"), ("m11ae then SW1A 1AA", "m11ae"), ("none 12345", None), (None, None)])
def test_postcode(spark, given, code):
    assert value(spark, text.uk_postcode(F.col("x")), x=given) == code


def test_place_candidates(spark):
    got = value(spark, text.place_candidates(F.col("a"), F.col("b"), F.col("c")), a="Hall, DE45 1AH", b="  ", c="sw1a 1aa")
    assert got == ["Hall, DE45 1AH", "DE45 1AH", "sw1a 1aa"]


@pytest.mark.parametrize(("t", "l", "p", "out"), [("5k", "running_5k", "£5", "5k [running_5k]: £5"), ("5k", None, "", "5k"), ("5k", None, "£5", "5k: £5")])
def test_distance_label(spark, t, l, p, out):  # noqa: E741
    assert value(spark, text.distance_label(F.col("t"), F.col("l"), F.col("p")), t=t, l=l, p=p) == out


def test_occurrence_label_and_lines(spark):
    assert value(spark, text.occurrence_label(F.col("d"), F.col("t"), F.col("p")), d="1 May", t="9am", p="£1") == "1 May 9am: £1"
    assert value(spark, text.occurrence_label(F.col("d"), F.col("t"), F.col("p")), d=None, t=None, p=None) == ""
    assert value(spark, text.joined(F.col("x")), x=[]) == ""


def test_escaping(spark):
    import html
    import urllib.parse

    raw = "<a href=\"x\">Tom & 'Jerry'</a> ~*é/?"
    assert value(spark, text.html_escape(F.col("x")), x=raw) == html.escape(raw)
    assert value(spark, text.quote_plus(F.col("x")), x=raw) == urllib.parse.quote_plus(raw)
    assert value(spark, F.get(markup.html_unescape(F.array("x")), F.lit(0)), x="it&#39;s &amp; so") == "it's & so"


@pytest.mark.parametrize(("body", "found"), [("User-agent: *\n SITEMAP: https://s/x.xml \nSitemap: no", "https://s/x.xml"), ("Sitemap:\nDisallow: /", None), ("nothing", None), ("Sitemap: a:b\r\n", "a:b")])
def test_sitemap_directive(spark, body, found):
    assert value(spark, text.sitemap_directive(F.col("x")), x=body) == found


def test_key_values(spark):
    assert value(spark, text.key_values(F.col("x")), x=["a=1", "b=x=y", "c", "a=2"]) == {"a": "2", "b": "x=y", "c": ""}


def test_a_text_is_split_for_the_keywords_it_has(spark):
    places = text.keyword_places(F.col("x"), "more")
    assert [value(spark, places, x=x) for x in ("no", "more", "x more more y")] == [[], [0], [2, 7]]
    plan = spark.createDataFrame([("no",)], "x string").select(places)._jdf.queryExecution().analyzed().toString()
    assert plan.index("CASE WHEN contains(x") < plan.index("split(x")


def test_excerpt_against_a_loop(spark):
    import random

    rnd = random.Random(4)
    for _ in range(4):
        page = "".join(rnd.choice(["x" * 900, "Load More", "<div class='pagination'>", "y" * 2000, "NEXT PAGE ", "loadmore"]) for _ in range(90))
        low, spans = page.lower(), [(0, 4000)]
        for word in text.MORE_KEYWORDS:
            at = low.find(word)
            while at >= 0:
                spans.append((max(0, at - 300), min(len(page), at + 1500)))
                at = low.find(word, at + 1)
        joined = []
        for a, b in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        want = page if len(page) <= 60_000 else "\n...\n".join(page[a:b] for a, b in joined)[:60_000]
        assert value(spark, text.excerpt(F.col("x")), x=page) == want


@pytest.mark.parametrize(("given", "day"), [("2026-08-18", datetime.date(2026, 8, 18)), (" 20260818\n", datetime.date(2026, 8, 18)), ("2026-8-18", None), ("2026-02-30", None), ("2026-08", None), ("", None), (None, None)])
def test_iso_date(spark, given, day):
    assert value(spark, dates.iso_date(F.col("x")), x=given) == day


@pytest.mark.parametrize(("given", "clock"), [("9:5", "09:05"), ("09:00", "09:00"), ("25:00", None), ("9", None), ("9:00pm", None), ("", None), (None, None)])
def test_clock(spark, given, clock):
    assert value(spark, dates.clock(F.col("x")), x=given) == clock


def test_moment_and_range(spark):
    assert value(spark, dates.moment(F.col("d"), F.col("t")), d="2024-05-01", t="25:00") == datetime.datetime(2024, 5, 1)
    assert value(spark, dates.moment(F.col("d"), F.col("t")), d=None, t="9:00") is None
    assert value(spark, dates.date_range(F.col("a"), F.col("b")), a="x", b="y") == "x to y"
    assert value(spark, dates.date_range(F.col("a"), F.col("b")), a="x", b="x") == "x"
    assert value(spark, dates.date_range(F.col("a"), F.col("b")), a="", b="y") is None


@pytest.mark.parametrize("link", ["/a/b", "c?d=1", "../up/x", "./here", "?q=2", "#top", "//cdn.example/z", "https://o.example/", "mailto:a@b", "../../..", "a/../b/./c/", ""])
def test_resolve_like_urljoin(spark, link):
    from urllib.parse import urljoin

    base = "https://www.site.example:8080/one/two/page.html?x=1#frag"
    got = value(spark, urls.resolve(F.col("b"), F.col("l")), b=base, l=link)
    assert got == (urljoin(base, link) if link else base)


def test_candidate_links(spark):
    links = [" https://a.example/1 ", "https://a.example/1", "https://a.example/LOGIN", "https://sub.a.example/2", "https://a.other.net/3", "https://b.example/4", "/relative", "", "https://www.a.example/5", "https://fox.com/a"]
    got = value(spark, urls.candidate_links(F.col("x"), F.lit("https://www.A.example/home")), x=links)
    assert got == ["https://a.example/1", "https://sub.a.example/2", "https://a.other.net/3", "https://www.a.example/5"]


def test_url_parts(spark):
    assert value(spark, urls.normal_url(F.col("x")), x="https://a/b///") == "https://a/b/"
    assert value(spark, urls.host(F.col("x")), x="HTTPS://WWW.A.b:80/c") == "a.b:80"
    assert value(spark, urls.path_and_query(F.col("x")), x="https://a/b.pdf?c=1#d") == "/b.pdf?c=1"
    assert value(spark, urls.path_and_query(F.col("x")), x="https://a") == "/"
    assert value(spark, urls.robots_url(F.col("x")), x="https://a/b") == "https://a/robots.txt"


def answer(spark, column, json):
    return spark.createDataFrame([(json,)], "x string").select(F.try_parse_json("x").alias("v")).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("json", "valid", "reason"), [('{"is_valid_event":false,"invalid_reason":" gone "}', False, "gone"), ('{"is_valid_event":"false","invalid_reason":"x"}', True, None), ("{}", True, None), ('{"is_valid_event":0}', True, None)])
def test_validity(spark, json, valid, reason):
    v, r = coerce.validity(F.col("v"))
    assert (answer(spark, v, json), answer(spark, r, json)) == (valid, reason)


def test_vocabularies(spark):
    assert value(spark, coerce.one_of(F.col("x"), coerce.OCCURRENCES), x=" Weekly\n") == "weekly"
    assert value(spark, coerce.one_of(F.col("x"), coerce.REGISTRATIONS), x="maybe") == "unknown"
    assert value(spark, coerce.one_of(F.col("x"), coerce.LIFECYCLES), x=None) == "scheduled"
    assert value(spark, coerce.weekdays(F.col("x")), x=["SUN", "nope", "sat ", "sun"]) == ["sat", "sun"]
    assert value(spark, coerce.interaction(F.col("k"), F.col("s")), k="Paginate", s="") == "none"
    assert value(spark, coerce.interaction(F.col("k"), F.col("s")), k="Append", s=None) == "append"


def test_lists(spark):
    got = answer(spark, coerce.distances(F.col("v")), '[{"distance_text":"5k","price_text":"","distance_category":" 5_K "},"x",{"price_text":"1"},{"distance_text":10}]')
    assert [tuple(r) for r in got] == [("5k", None, "5_k"), ("10", None, None)]
    got = answer(spark, coerce.occurrences(F.col("v")), '[{"date_text":"a","date_iso":"b","time_text":""},{"date_text":"a"},3]')
    assert [tuple(r) for r in got] == [("a", "b", None, None, None)]
    assert answer(spark, coerce.distances(F.col("v")), '"no"') == []
    assert answer(spark, coerce.chosen(F.col("v"), F.array(F.lit("p"), F.lit("q"))), '[1,99,-1,"0",true,1,0]') == ["q", "p"]


def test_structured_data(spark):
    def read(page):
        row = markup.with_structured_fields(spark.createDataFrame([(page,)], "x string").withColumn("v", markup.first_event(F.col("x"))), "v", "found").select("found.*").first()
        return {k: v for k, v in row.asDict().items() if v is not None}

    block = '<script type="application/ld+json">%s</script>'
    event = '{"@type":"SportsEvent","name":"A &amp; B","sport":" Running ","startDate":"2024-01-01","endDate":"2024-01-02","location":{"name":"Hall","address":{"postalCode":"X1","addressCountry":"UK"}}}'
    want = {"name": "A & B", "sport": "running", "date_text": "2024-01-01 to 2024-01-02", "location": "Hall, X1, UK"}
    assert read(block % event) == want
    assert read(block % f"[{event}]") == want
    assert read(block % f'{{"@graph":[{{"@type":"Thing"}},{event}]}}') == want
    assert read(block % "{bad" + block % event) == want
    assert read(block % (event + "}")) == {}
    assert read(block % '{"@type":"Person","name":"x"}') == {}
    assert read(block % '{"@type":["Thing","Event"],"name":"n","location":{"address":"1 Road"}}') == {"name": "n", "location": "1 Road"}
    assert read("<p>none</p>") == {}


def test_sitemaps(spark):
    xml = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a/1 </loc><lastmod>x</lastmod></url><url/><skip><loc>https://a/2</loc></skip></urlset>'
    assert value(spark, markup.sitemap_kind(F.col("x")), x=xml) == "urlset"
    assert value(spark, markup.sitemap_locations(F.col("x"), "url"), x=xml) == ["https://a/1"]
    assert value(spark, markup.sitemap_kind(F.col("x")), x="<sm:sitemapindex/>") == "sitemapindex"


def test_selectors():
    page = '<div id="a"><button class="b c">Book</button></div><div id="m"><button class="b c">Load more</button></div>'
    assert markup.text_selector(page, markup.MORE_WORDS["append"]) == "#m button.b.c"
    assert markup.text_selector(page + "<a>show more</a>", markup.MORE_WORDS["append"]) is None
    assert markup.text_selector('<a aria-label="Next page"><i></i></a>', markup.MORE_WORDS["paginate"]) == "a"
    assert markup.count_matches(page, "div > button.c") == 2
    assert markup.count_matches(page, "button:nth(2)") == 0
    assert markup.count_matches("<p data-x='1'></p>", 'p[data-x="1"]') == 1


def test_main_text_keeps_headers_and_drops_furniture():
    got = markup.main_text("<nav>menu</nav><article><header><h2>Half Marathon</h2></header><ul><li>one</li><li>two</li></ul></article><footer>f</footer><script>s</script>")
    assert "## Half Marathon" in got and "* one" in got
    assert not {"menu", "f", "s"} & set(got.split())


def test_price_repair():
    page = "Select Distance 5K  10K  Half Marathon\n£28\n10K\n£30\nHalf Marathon\n£36"
    assert markup.repair_prices(page).split("\n")[1:3] == ["5K", "£28"]
    for unchanged in ("£28\n10K", page.replace("£28", "5k\n£28"), page.replace("10K\n", ""), "Select Distance 5K\n£1", "Select Distance 5K  10K\nno price"):
        assert markup.repair_prices(unchanged) == unchanged
