"""Landed pages and JSON against plain parsers."""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.plans import evidence, registry
from tidemark.sources import semi
from tidemark.streaming import state

STOPS = {*H.FURNITURE, *H.CONTAINERS}
PAGES = [
    None, "", "plain &amp; simple", "<p>one</p><p>two<br>three", "a<script>x<y</script>b<style>p{}</style>c<!-- d <p>e</p> -->f", "a<script>never closed <p>b</p>", "a<!-- never closed <p>b",
    "<nav>out<nav>out</nav>out</nav>in", "<div><nav>out</div>in", "in</nav>in", "<header><nav>out</header>in<footer>out", "<p title='a>b' id=\"c>d\">in</p><a href=/x>y</a>", "<body><header>h</header><main>in</main></body>",
    "&lt;b&gt; &amp;lt; &#233; &#xE9; &#128; &nbsp;x&copy; &unknown; &amp &#0; &#xD800; &#9999999;", "<NAV>out</NAV >in <navigation>in</navigation>", "x < y and <3 <<p>>", "<ul><li>a<nav>out</ul>in<article>in</article>",
    "<a href='/l/?uddg=https%3A%2F%2Fin.linkedin.com%2Fin%2Fab&amp;z=1'>t</a><A HREF=\"/b?x=1&amp;y=2\" class=q>u</A><a class=x>no</a><!-- <a href='/no'> -->", "<p>" + "word " * 30_000 + "</p>", "<div>" * 400 + "deep" + "</div>" * 300 + "<nav>out",
]


class Plain(HTMLParser):
    """The text outside furniture by a stack of open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.hrefs, self.raw = [], [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.hrefs += [v.strip() for k, v in attrs if k == "href" and v and v.strip()][:1]
        if tag in STOPS:
            self.open.append(tag)
        self.out.append(" ")
        self.raw = tag if tag in H.RAW else self.raw

    def handle_endtag(self, tag):
        self.raw = None if tag == self.raw else self.raw
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        self.out.append(" ")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        if not self.raw and not set(self.open) & set(H.FURNITURE):
            self.out.append(data)


def test_visible_text_and_links_equal_a_plain_parser(spark):
    pages = [p for p in PAGES if p is None or not re.search(r"never closed|&amp &#0|<3", p)]
    pages += [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    for r in df.select("i", "h", H.visible_text(F.col("h"), 10**6).alias("t"), H.links(F.col("h")).alias("l")).collect():
        plain = Plain()
        plain.feed(r.h or "")
        plain.close()
        assert r.t == re.sub(r"[\s ]+", " ", "".join(plain.out)).strip(" "), r.h[:200]
        assert r.l == plain.hrefs


@pytest.mark.parametrize(
    ("page", "text"),
    [(PAGES[5], "a"), (PAGES[6], "a"), (PAGES[13], "<b> &lt; é é € x© &unknown; &amp � � �"), (PAGES[15], "x < y and <3 < >")],
)
def test_unclosed_elements_and_references(spark, page, text):
    assert spark.createDataFrame([(page,)], "h string").select(H.visible_text(F.col("h"))).first()[0] == text


def test_article_text_takes_paragraphs_that_nothing_closes(spark):
    long = ["x" * 41, "y" * 45, "short", "z" * 50]
    page = f"<header><p>{'n' * 60}</p></header><article><p><b>{long[0]}<br><p>{long[1]}</p><p>{long[2]}</p>{'q' * 60}<p>{long[3]}</article>tail"
    got = spark.createDataFrame([(page,)], "h string").select(H.article_text(F.col("h"))).first()[0]
    assert got == " ".join([long[0], long[1], long[3]])


def test_every_reference_is_decoded_as_the_standard_says(spark):
    names = sorted(k for k in H.html5 if k.endswith(";"))
    df = spark.createDataFrame([(n, f"a&{n}b") for n in names] + [(f"#{i};", f"a&#{i};b") for i in (32, 128, 129, 159, 255, 8364, 0x1F600, 0x10FFFD)], "n string, t string")
    assert all(r.x == html.unescape(r.t) for r in df.select("t", H.unescaped(F.col("t")).alias("x")).collect())


def test_landed_json_of_drifting_layouts(spark, tmp_path):
    lines = [
        json.dumps({"articles": [{"title": "a", "url": "u1", "language": "English", "domain": "d"}, {"title": "b", "url": "u2", "language": 7}, 5, {"title": {"x": 1}, "url": "u3"}, {"title": " ", "url": "u4"}]}),
        json.dumps({"articles": {"title": 12, "url": "u5"}}), json.dumps({"items": []}), json.dumps({"articles": []}), '{"articles": [{"title": "cut', "", "  ", "[1, 2]", "null", '{"articles": "none"}',
    ]
    (tmp_path / "part.json").write_text("\n".join(lines))
    got = semi.index_articles(semi.read_lines(spark, str(tmp_path)))
    assert sorted((r.title, r.url, r.source) for r in got.rows.collect()) == [("12", "u5", "GDELT/"), ("a", "u1", "GDELT/d")]
    assert {(r.reason, r.n) for r in got.counts().collect()} == {("not JSON", 1), ("no records", 4), ("no object", 1), ("no title", 2)}
    assert {r.file for r in got.rejected.collect()} == {"part.json"}


def test_hits_profiles_and_quotes_of_several_vendors(spark, tmp_path):
    hits = [{"organic": [{"link": "a", "title": "t", "snippet": "s"}]}, {"web": {"results": [{"url": "b", "description": "d"}]}}, [{"href": "c", "body": "e"}], {"results": [{"title": "no link"}]}]
    (tmp_path / "hits.json").write_text("\n".join(map(json.dumps, hits)))
    got = semi.search_hits(semi.read_lines(spark, str(tmp_path / "hits.json")))
    assert sorted(tuple(r) for r in got.rows.collect()) == [("a", "t", "s"), ("b", "", "d"), ("c", "", "e")]
    assert [r.reason for r in got.rejected.collect()] == ["no link"]
    people = [
        {"profile": "p", "experiences": [{"company": "x", "title": "T", "starts_at": {"year": 2001}, "ends_at": {"year": "2003"}}, {"title": "no company"}]},
        {"public_identifier": "q", "positions": {"positionHistory": [{"companyName": "y", "startEndDate": {"start": {"year": 2010}, "end": None}}]}},
        {"profile": "r", "experiences": [{"company": "z", "start_year": 2015, "end_year": 2020, "is_current": True}]},
    ]
    (tmp_path / "people.json").write_text("\n".join(map(json.dumps, people)))
    got = semi.work_histories(semi.read_lines(spark, str(tmp_path / "people.json")))
    assert sorted(tuple(r) for r in got.rows.select("profile", "company", "start_year", "end_year").collect()) == [("p", "x", 2001, 2003), ("q", "y", 2010, None), ("r", "z", 2015, None)]
    assert got.rejected.count() == 1


def test_each_line_is_parsed_once(spark, tmp_path):
    """Both results read typed rows: no condition on them parses a line again. Odd records keep their reasons."""
    lines = ['{"symbol":"{a","meta":{"regularMarketPrice":"1.5"}}', '{"quotes":[]}', '{"quotes":[null,"x",{"symbol":{"b":1},"meta":{"regularMarketPrice":2}},{"symbol":"c"}]}', "[7]", '"text"', "{cut"]
    (tmp_path / "q.json").write_text("\n".join(lines))
    got = semi.records(semi.read_lines(spark, str(tmp_path)), semi.QUOTES)
    assert [(r.symbol, r.price) for r in got.rows.collect()] == [("{a", 1.5)]
    assert sorted((r.reason, r.text) for r in got.rejected.collect()) == [
        ("no object", '"x"'), ("no object", "7"), ("no object", "null"), ("no price", '{"symbol":"c"}'), ("no records", '"text"'), ("no symbol", '{"meta":{"regularMarketPrice":2},"symbol":{"b":1}}'), ("not JSON", "{cut"),
    ]
    for df in (got.rows, got.rejected):
        assert "parsejson" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_merged_texts_are_parsed_once_each(spark):
    """Within a lambda a parse written twice is done twice for every element."""
    df = spark.createDataFrame([('{"a":1,"b":{"c":[1,null]},"a":2}', '{"b":"x","z":true}'), ("[1]", '{"a":1}'), (None, "{cut")], "one string, two string")
    got = df.select(state.merge_json(F.col("one"), F.col("two")).alias("m"), state.merge_json(F.col("one"), F.col("two"), "u").alias("u"))
    assert [r.m for r in got.collect()] == ['{"a":2,"b":"x","z":true}', '{"a":1}', "{}"]
    assert got.first().u == '{"b":{"c":[1,null]},"a":2,"u":{"b":"x","z":true}}'
    plan = df.select(state.merge_json(F.col("one"), F.col("two")))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.split("localrelation")[0].split("logicalrdd")[0].count("from_json(") == 2


def test_records_parse_a_line_once(spark, monkeypatch):
    """A filter on the list below its explosion would parse every line again; empty lists have no records."""
    plans, plain = [], semi.materialise
    monkeypatch.setattr(semi, "materialise", lambda df, *by: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, *by))
    texts = ['{"login":"a"}', '[{"login":"b"},{"login":7}]', "[]", '{"items":[]}', "[null]", '{"items":[{"login":""},3]}', "{cut", '"text"', '{"items":{"login":"c"}}']
    got = semi.records(spark.createDataFrame([("f", t) for t in texts], "file string, text string"), semi.USERS)
    assert sorted(r.login for r in got.rows.collect()) == ["7", "a", "b", "c"]
    assert sorted((r.reason, r.text) for r in got.rejected.collect()) == [("no login", '{"login":""}'), ("no object", "3"), ("no object", "null"), ("no records", '"text"'), ("not JSON", "{cut")]
    assert len(plans) == 1 and plans[0].count("parse_json") + plans[0].count("parseJson") == 1


def test_feed_files_are_bounded(spark, monkeypatch):
    """A task reads an XML file whole, so a table is landed as files of so many items at most."""
    monkeypatch.setattr(evidence, "FEED_ROWS", 50, raising=False)
    folders, plain = [], evidence.landed.feed_items
    monkeypatch.setattr(evidence.landed, "feed_items", lambda s, path, feed: folders.append(path) or plain(s, path, feed))
    got = registry.queries()["s01_feed_items"](spark, "/root/testdata/sf0.001")
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    assert got.count() == parts.where("p_partkey % 5 <> 0").count()
    files = spark.read.text(folders[0]).where("value like '%<item>%'").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) <= 50
