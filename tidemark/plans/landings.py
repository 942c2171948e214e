"""Registered queries: landed JSON text, written from the tables with broken lines and drifting fields, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.plans.bindings import Views
from tidemark.plans.registry import query
from tidemark.plans.texts import cat
from tidemark.sources import semi
from tidemark.sources.landed import accelerator_batches
from tidemark.operators.scoring import percent_change
from tidemark.tables import shared_dir


def _land(v: Views, rows: DataFrame, line: Column) -> DataFrame:
    """``line`` of each row as a line of a text file, read back."""
    path = f"{shared_dir(v.spark)}/landed-{uuid.uuid4().hex}"
    rows.select(line.alias("value")).write.text(path)
    return semi.read_lines(v.spark, path)


def _cut(line: Column) -> Column:
    """What is left of a line when its last character is lost."""
    return F.substr(line, F.lit(1), F.length(line) - 1)


def _counted(got: semi.Landed, columns: list[str]) -> DataFrame:
    """The rows, and for each reason how many were rejected."""
    none = [F.lit(None).cast(got.rows.schema[c].dataType).alias(c) for c in columns]
    lost = got.rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select("reason", "n", *none)
    return got.rows.select(F.lit("").alias("reason"), F.lit(1).cast("long").alias("n"), *columns).unionByName(lost)


@query("""SELECT '' AS reason, 1::BIGINT AS n, title, url, 'GDELT/' || source || '.com' AS source FROM articles WHERE ord % 10 NOT IN (0, 2, 3, 4) AND lang IN ('en', 'de') AND trim(title) <> '' AND trim(url) <> ''
  UNION ALL SELECT * FROM (SELECT CASE WHEN ord % 10 = 0 THEN 'not JSON' WHEN ord % 10 = 4 THEN 'no records' WHEN ord % 10 = 2 OR trim(title) = '' THEN 'no title' WHEN trim(url) = '' THEN 'no url' END AS reason, count(*) AS n, NULL, NULL, NULL FROM articles GROUP BY 1) WHERE reason IS NOT NULL""")
def s02_landed_index(v: Views) -> DataFrame:
    """A news index of which one line in ten is cut short, one has no list, one a single article, one no title and one a number for its language."""
    ord_ = F.col("ord") % 10
    lang = F.when(F.col("lang") == "en", '"English"').when(F.col("lang") == "de", '""').otherwise('"French"')
    title = F.when(ord_ != 2, F.col("title"))
    record = _cut(F.to_json(F.struct(title.alias("title"), "url", cat(F.col("source"), ".com").alias("domain"), F.lit("20240103T040506Z").alias("seendate"))))
    record = F.concat(record, F.lit(',"language":'), F.when(ord_ == 3, "7").otherwise(lang), F.lit("}"))
    line = F.when(ord_ == 1, F.concat(F.lit('{"articles":'), record, F.lit("}"))).when(ord_ == 4, F.lit('{"articles":"none"}')).otherwise(F.concat(F.lit('{"articles":['), record, F.lit("]}")))
    got = semi.index_articles(_land(v, v.articles, F.when(ord_ == 0, _cut(line)).otherwise(line)))
    return _counted(got, ["title", "url", "source"])


@query("""SELECT '' AS reason, 1::BIGINT AS n, url AS link, CASE WHEN ord % 3 = 1 THEN '' ELSE title END AS title, CASE WHEN ord % 3 = 2 THEN '' ELSE summary END AS snippet FROM articles WHERE url <> '' AND ord % 4 <> 3
  UNION ALL SELECT 'no link', count(*), NULL, NULL, NULL FROM articles WHERE url = '' AND ord % 4 <> 3 HAVING count(*) > 0 UNION ALL SELECT 'not JSON', count(*), NULL, NULL, NULL FROM articles WHERE ord % 4 = 3""")
def s03_landed_hits(v: Views) -> DataFrame:
    """Hits of three vendors, each with names and places of its own; a quarter of the lines are HTML error pages."""
    one = F.to_json(F.struct(F.array(F.struct(F.col("url").alias("link"), "title", F.col("summary").alias("snippet"))).alias("organic")))
    two = F.to_json(F.struct(F.struct(F.array(F.struct("url", F.array("title").alias("title"), F.col("summary").alias("description"))).alias("results")).alias("web")))
    three = F.concat(F.lit("["), F.to_json(F.struct(F.col("url").alias("href"), "title")), F.lit("]"))
    kind = F.col("ord") % 3
    line = F.when(F.col("ord") % 4 == 3, "<html>502</html>").when(kind == 0, one).when(kind == 1, two).otherwise(three)
    return _counted(semi.search_hits(_land(v, v.articles, line)), ["link", "title", "snippet"])


@query("""SELECT '' AS reason, 1::BIGINT AS n, 'forum' AS source, 'https://www.reddit.com/r/' || page_id AS url, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 90 END AS score FROM pages WHERE page_id % 7 <> 0
  UNION ALL SELECT '', 1, 'stories', CASE WHEN page_id % 2 = 0 THEN 'https://news.ycombinator.com/item?id=' || page_id ELSE url END, page_id % 70 FROM pages WHERE page_id % 5 <> 0
  UNION ALL SELECT 'not JSON', count(*), NULL, NULL, NULL FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT 'no item', count(*), NULL, NULL, NULL FROM pages WHERE page_id % 5 = 0""")
def s04_s05_landed_demand(v: Views) -> DataFrame:
    """A forum's listing and a story search: numbers as text, as words, or missing."""
    p, page = F.col("page_id"), v.raw("pages").select("page_id", "url")
    score = F.when(p % 3 == 0, "many").otherwise((p % 90).cast("string"))
    post = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.col("url").alias("title"), cat("/r/", p).alias("permalink"), score.alias("score"), F.lit(1704067200).alias("created_utc")).alias("data"))).alias("children")).alias("data")))
    forum = _land(v, page, F.when(p % 7 == 0, _cut(post)).otherwise(post))
    hit = F.struct(F.col("url").alias("title"), F.when(p % 2 != 0, F.col("url")).alias("url"), F.when(p % 5 != 0, p).alias("objectID"), (p % 70).alias("points"), F.lit("1704067200").alias("created_at_i"))
    return _counted(semi.demand_items(forum, _land(v, page, F.to_json(F.struct(F.array(hit).alias("hits"))))), ["source", "url", "score"])


@query("SELECT 'Founder, ' || part AS name, 'Winter ' || (2000 + part % 9) AS batch FROM themes WHERE part % 9 >= 3 AND brand = 'Brand#7' AND part % 6 <> 0")
def s07_landed_companies(v: Views) -> DataFrame:
    """Accelerator companies, one a line, some in a list of one, some without a batch."""
    part = F.col("part")
    record = F.to_json(F.struct(part.cast("string").alias("name"), F.when(part % 6 != 0, cat("Winter ", part % 9 + 2000)).alias("batch"), cat("at ", F.col("brand"), ";").alias("all_locations"), F.col("text").alias("one_liner")))
    rows = semi.records(_land(v, v.themes, F.when(part % 2 == 0, record).otherwise(F.concat(F.lit("["), record, F.lit("]")))), semi.COMPANIES).rows
    return accelerator_batches(rows, ["at brand#7;"]).select("name", "batch")


@query("""SELECT '' AS reason, 1::BIGINT AS n, 'User ' || o_custkey AS name, o_orderkey || '' AS description, (o_orderkey % 120)::BIGINT AS stars FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 120 >= 50 AND o_orderstatus <> 'F' AND c_nationkey = 7 AND o_orderkey % 11 <> 0
  UNION ALL SELECT 'no login', count(*), NULL, NULL, NULL FROM orders WHERE o_orderkey % 11 = 0""")
def s08_landed_repositories(v: Views) -> DataFrame:
    """Repositories and their owners; forks are booleans or words, stars numbers or text, some owners missing."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    stars = F.when(o % 2 == 0, (o % 120).cast("string")).otherwise(cat('"', o % 120, '"'))
    fork = F.when(o % 3 == 0, F.when(F.col("o_orderstatus") == "F", '"true"').otherwise('"false"')).otherwise((F.col("o_orderstatus") == "F").cast("string"))
    owner = F.when(o % 11 == 0, "null").otherwise(cat('{"login":', F.col("o_custkey"), "}"))
    repos = _land(v, v.raw("orders"), F.concat(F.lit('{"full_name":"'), o, F.lit('","stargazers_count":'), stars, F.lit(',"fork":'), fork, F.lit(',"owner":'), owner, F.lit("}")))
    users = _land(v, v.raw("customer"), F.to_json(F.struct(c.cast("string").alias("login"), cat("User ", c).alias("name"), cat("place ", F.col("c_nationkey"), ";").alias("location"))))
    return _counted(semi.repository_launches(repos, users, ("place 7;",)), ["name", "description", "stars"])


@query("SELECT o_custkey || '' AS profile, 'co' || o_orderkey AS company, year(o_orderdate)::INT AS start_year, CASE WHEN o_custkey % 3 <> 2 THEN year(o_orderdate)::INT + 2 END AS end_year FROM orders")
def s09_landed_histories(v: Views) -> DataFrame:
    """Work histories of three vendors in the same files."""
    o = v.raw("orders").select(F.col("o_custkey").alias("profile"), cat("co", F.col("o_orderkey")).alias("company"), F.year("o_orderdate").alias("y"))
    year = lambda c: F.struct(c.alias("year"))
    later = (F.col("y") + 2).cast("string")
    listed = lambda stint: F.to_json(F.struct(F.col("profile"), F.array(stint).alias("experiences")))
    one = listed(F.struct("company", year(F.col("y")).alias("starts_at"), year(later).alias("ends_at")))
    stint = F.struct(F.col("company").alias("companyName"), F.struct(year(F.col("y")).alias("start"), year(later).alias("end")).alias("startEndDate"))
    two = F.to_json(F.struct(F.col("profile").alias("public_identifier"), F.struct(F.array(stint).alias("positionHistory")).alias("positions")))
    three = listed(F.struct("company", F.col("y").alias("start_year"), later.alias("end_year"), F.lit(True).alias("is_current")))
    kind = F.col("profile") % 3
    return semi.work_histories(_land(v, o, F.when(kind == 0, one).when(kind == 1, two).otherwise(three))).rows.select("profile", "company", "start_year", "end_year")


@query("""SELECT '' AS reason, 1::BIGINT AS n, o_orderkey || '' AS symbol, CASE WHEN o_custkey % 10 = 0 THEN 0.0 ELSE round((o_totalprice - o_custkey % 10 * 7001.25) / (o_custkey % 10 * 7001.25) * 100, 2) + 0.0 END AS change_pct FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL SELECT 'no price', count(*), NULL, NULL FROM orders WHERE o_orderkey % 13 = 0""")
def s14_landed_quotes(v: Views) -> DataFrame:
    """Quotes; the previous close has two names, and some prices are text."""
    o = F.col("o_orderkey")
    price = F.when(o % 13 == 0, '"n/a"').when(o % 2 == 0, cat('"', F.col("o_totalprice"), '"')).otherwise(F.col("o_totalprice").cast("string"))
    name = F.when(o % 3 == 0, '"chartPreviousClose":').otherwise('"previousClose":')
    line = F.concat(F.lit('{"symbol":"'), o, F.lit('","meta":{"regularMarketPrice":'), price, F.lit(","), name, F.col("o_custkey") % 10 * 7001.25, F.lit("}}"))
    got = semi.records(_land(v, v.raw("orders"), line), semi.QUOTES)
    rows = got.rows.withColumn("change_pct", percent_change(F.col("price"), F.col("previous_close")))
    return _counted(semi.Landed(rows, got.rejected), ["symbol", "change_pct"])
