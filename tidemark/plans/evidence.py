"""Registered queries: corroborating evidence, landed formats and report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import text as T
from tidemark.operators import joins, ranking
from tidemark.plans.bindings import Views
from tidemark.plans.registry import query
from tidemark.plans.texts import cat, choose
from tidemark.sources import landed
from tidemark.tables import shared_dir


@query("""WITH h AS (SELECT o_custkey AS cid, o_orderkey AS rank, ['a.com', 'b.com', 'c.com'][o_orderkey % 3 + 1] AS dom, CASE WHEN o_orderkey % 4 = 0 THEN 'Director Nair' WHEN o_orderkey % 4 = 1 THEN 'Nair' ELSE 'Director' END AS t FROM orders)
  SELECT c.pid AS candidate_id, arg_min('u' || h.rank, h.rank) AS url FROM persons c JOIN h ON h.cid = c.pid WHERE h.dom <> ['a.com', 'b.com'][c.pid % 2 + 1] AND h.t = 'Director Nair' GROUP BY c.pid""")
def j10_corroboration(v: Views) -> DataFrame:
    c = v.persons.select(F.col("pid").alias("candidate_id"), F.lit("Priya Nair").alias("name"), choose(F.col("pid"), "a.com", "b.com").alias("domain"))
    k = F.col("o_orderkey")
    hits = v.raw("orders").select(F.col("o_custkey").alias("candidate_id"), k.alias("rank"), choose(k, "a.com", "b.com", "c.com").alias("hit_domain"), choose(k, "Director Nair", "Nair", "Director", "Director").alias("text"), cat("u", k).alias("url"))
    return joins.corroborated(c, hits, ["director"])


@query("""WITH h AS (SELECT o_orderkey AS rank, o_custkey AS pid, o_orderkey % 5 AS k FROM orders)
  SELECT pid, rank, CASE k WHEN 0 THEN 'name' WHEN 1 THEN 'company' END AS rule FROM h WHERE k < 2""")
def j11_registry_corroboration(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    title = choose(k, "PRIYA K NAIR LLP", "Acme Pvt Ltd", "Priya Shah", "x", "nair")
    text = choose(k, "none", "the acme firm of 2021", "no", "acme without a year", "1999")
    h = v.raw("orders").select(F.col("o_custkey").alias("pid"), k.alias("rank"), joins.registry_match(F.lit("Priya Nair"), F.lit("Acme"), title, text).alias("rule"))
    return h.where("rule is not null")


@query("""WITH h AS (SELECT p_brand AS company, p_partkey AS rank, CASE WHEN p_partkey % 3 = 0 THEN 'skip.com' WHEN p_partkey % 3 = 1 THEN lower(replace(p_brand, '#', '-')) || '.io' ELSE 'other.com' END AS host FROM part)
  SELECT company, arg_min('https://' || host || '/' || rank, rank) AS url FROM h WHERE rank % 3 = 1 GROUP BY company""")
def j12_company_site(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    host = F.when(k % 3 == 0, "skip.com").when(k % 3 == 1, cat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), ".io")).otherwise("other.com")
    hits = v.raw("part").select(F.col("p_brand").alias("company"), k.alias("rank"), host.alias("host")).withColumn("url", cat("https://", F.col("host"), "/", F.col("rank")))
    return joins.company_site(hits, "company", ["skip.com"])


@query("""WITH h AS (SELECT o_custkey AS pid, o_orderkey AS rank FROM orders WHERE o_orderkey % 3 = 0)
  SELECT p.pid, coalesce(CASE WHEN p.pid % 2 = 0 THEN 'own' END, (SELECT arg_min('li' || rank, rank) FROM h WHERE h.pid = p.pid)) AS url FROM persons p""")
def j13_profile_backfill(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    hits = v.raw("orders").select(F.col("o_custkey").alias("pid"), k.alias("rank"), choose(k, "Priya Nair - x", "Priya S", "nair").alias("title"), cat("li", k).alias("url"))
    first = joins.first_match(hits.where(joins.all_tokens_in(F.lit("Priya Nair"), F.concat_ws(" ", "title", "url"))), ["pid"], ["rank"], ["url"])
    p = v.persons.select("pid", F.when(F.col("pid") % 2 == 0, "own").alias("have"))
    return p.join(first, "pid", "left").select("pid", F.coalesce("have", "url").alias("url"))


@query("""WITH m AS (SELECT l_suppkey AS login, arg_min(l_partkey, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey) AS org FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1),
  r AS (SELECT l_suppkey AS login, l_orderkey * 10 + l_linenumber AS repo, max(l_quantity) AS stars, max(l_shipdate) AS created, bool_or(l_returnflag = 'R') AS fork FROM lineitem GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY login ORDER BY stars DESC, repo) AS place FROM r WHERE NOT fork AND created >= TIMESTAMP '1999-01-01')
  SELECT k.login, m.org, k.repo, k.place FROM k JOIN m ON m.login = k.login WHERE place <= 2""")
def j14_members_repositories(v: Views) -> DataFrame:
    li = v.raw("lineitem").withColumn("repo", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    members = li.where("l_suppkey % 4 <> 0").select(F.col("l_suppkey").alias("login"), F.col("l_partkey").alias("org"), F.col("repo").alias("ord"))
    repos = li.groupBy(F.col("l_suppkey").alias("login"), "repo").agg(F.max("l_quantity").alias("stars"), F.max("l_shipdate").alias("created"), F.bool_or(F.col("l_returnflag") == "R").alias("fork"))
    return joins.members_repositories(members, repos, F.lit("1999-01-01").cast("timestamp_ntz")).select("login", "org", "repo", "place")


@query("""WITH h AS (SELECT p_brand AS company, p_partkey AS rank, p_partkey % 4 AS k FROM part)
  SELECT company, arg_min(rank, rank) AS rank, 'Priya Nair' AS founder FROM h WHERE k = 1 GROUP BY company""")
def j19_company_founder(v: Views) -> DataFrame:
    k, brand = F.col("p_partkey"), F.col("p_brand")
    title = choose(k, cat("About ", brand), cat("Priya Nair - founder of ", brand), "Priya Nair - founder of x", cat("stealth lab - founder of ", brand))
    h = v.raw("part").select(brand.alias("company"), k.alias("rank"), title.alias("title"))
    h = h.withColumn("founder", T.name_from_title(F.col("title")))
    hit = h.where(F.lower("title").contains(F.lower("company")) & T.any_of(F.col("title"), ["founder", "ceo"]) & (F.col("founder") != ""))
    return joins.first_match(hit.withColumn("at", F.col("rank")), ["company"], ["at"], ["rank", "founder"])


#: Items of one feed file at most.
FEED_ROWS = 20_000


@query("SELECT part || '' AS title, 'https://ex.com/' || part AS url, 'parts' AS source, strftime(TIMESTAMP '2024-01-01' + INTERVAL (part % 28) DAY, '%Y-%m-%d') AS day FROM themes WHERE part % 5 <> 0")
def s01_feed_items(v: Views) -> DataFrame:
    """Feed files written from the table, then read back as a feed."""
    part = F.col("part")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (part % 28).cast("int"))
    rows = v.themes.select(
        F.when(part % 5 == 0, F.lit(" ")).otherwise(cat("<b>", part, "</b>")).alias("title"), cat("https://ex.com/", part).alias("link"), F.col("text").alias("description"),
        F.date_format(day, "EEE, d MMM yyyy '00:00:00 +0000'").alias("pubDate"),
    )
    path = f"{shared_dir(v.spark)}/feed-{uuid.uuid4().hex}"
    # a task reads an XML file whole, however large it is
    rows.write.format("xml").option("rootTag", "channel").option("rowTag", "item").option("maxRecordsPerFile", FEED_ROWS).save(path)
    items = landed.feed_items(v.spark, path, "parts")
    return items.select("title", "url", "source", F.date_format("published", "yyyy-MM-dd").alias("day"))


def _files(records: DataFrame, record: F.Column, out: str, most: int = 1000) -> DataFrame:
    """``source`` and a list ``out`` of ``most`` records at most, as landed files hold them. Numbers ``ord`` are distinct."""
    return records.groupBy("source", F.floor(F.col("ord") / most).alias("file")).agg(F.collect_list(record).alias(out)).drop("file")


@query("SELECT title, url, 'GDELT/' || source || '.com' AS source FROM articles WHERE lang = 'en' OR lang = 'de'")
def s02_index_articles(v: Views) -> DataFrame:
    lang = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "").otherwise("French")
    a = v.articles.select("source", "ord", F.struct("url", "title", cat(F.col("source"), ".com").alias("domain"), F.lit("20240103T040506Z").alias("seendate"), lang.alias("language")).alias("x"))
    raw = _files(a, F.col("x"), "articles")
    return landed.index_articles(raw).select("title", "url", "source")


@query("""SELECT url AS link, title, summary AS snippet FROM articles WHERE ord % 3 = 0 AND url <> '' UNION ALL SELECT url, title, '' FROM articles WHERE ord % 3 = 1 AND url <> '' UNION ALL SELECT url, title, summary FROM articles WHERE ord % 3 = 2 AND url <> ''""")
def s03_search_hits(v: Views) -> DataFrame:
    a = v.articles
    one = a.where("ord % 3 = 0").select(F.col("url").alias("link"), "title", F.col("summary").alias("snippet"))
    two = a.where("ord % 3 = 1").select(F.col("url").alias("href"), "title", F.lit(None).cast("string").alias("body"))
    three = a.where("ord % 3 = 2").select("url", "title", F.col("summary").alias("content"))
    return landed.search_hits(one, two, three).select("link", "title", "snippet")


@query("""SELECT 'forum' AS source, title, 'https://www.reddit.com/r/' || ord AS url, ord % 90 AS score, epoch(TIMESTAMP '2024-01-01' + INTERVAL (ord) SECOND)::BIGINT AS at FROM articles
  UNION ALL SELECT 'stories', title, CASE WHEN url = '' THEN 'https://news.ycombinator.com/item?id=' || ord ELSE url END, ord % 70, epoch(TIMESTAMP '2024-01-01' + INTERVAL (ord) SECOND)::BIGINT FROM articles""")
def s04_s05_demand_items(v: Views) -> DataFrame:
    a, at = v.articles, (F.col("ord") + 1704067200)
    post = F.struct(F.struct("title", cat("/r/", F.col("ord")).alias("permalink"), (F.col("ord") % 90).alias("score"), F.lit(0).cast("long").alias("num_comments"), at.alias("created_utc")).alias("data"))
    forum = _files(a, post, "children").select("source", F.struct("children").alias("data"))
    hit = F.struct("title", "url", F.col("ord").cast("string").alias("objectID"), (F.col("ord") % 70).alias("points"), F.lit(0).cast("long").alias("num_comments"), at.alias("created_at_i"))
    stories = _files(a, hit, "hits")
    both = landed.forum_items(forum, "forum").unionByName(landed.story_items(stories, "stories"))
    return both.select("source", "title", "url", "score", F.unix_timestamp("ts").alias("at"))


@query("SELECT 'Maker ' || part AS name, text AS description FROM themes WHERE part % 3 <> 0 AND part % 4 = 0 AND part % 28 >= 9")
def s06_launches(v: Views) -> DataFrame:
    part = F.col("part")
    items = v.themes.select(
        F.when(part % 3 != 0, cat("Maker ", part)).otherwise("").alias("author"), F.col("text").alias("title"), F.when(part % 4 == 0, "made in Singapore").otherwise("").alias("summary"),
        F.date_add(F.lit("2024-01-01").cast("date"), (part % 28).cast("int")).cast("timestamp").alias("published"), cat("u", part).alias("url"),
    )
    return landed.launches(items, "2024-01-10", ["singapore"]).select("name", F.col("signal.description").alias("description"))


@query("SELECT 'Founder, ' || part AS name, 'Winter ' || (2000 + part % 9) AS batch FROM themes WHERE part % 9 >= 3 AND brand = 'Brand#7'")
def s07_accelerator_batches(v: Views) -> DataFrame:
    place = cat("at ", F.col("brand"), ";")
    c = v.themes.select(F.col("part").cast("string").alias("name"), cat("Winter ", F.col("part") % 9 + 2000).alias("batch"), place.alias("all_locations"), F.col("text").alias("one_liner"))
    return landed.accelerator_batches(c, ["at brand#7;"]).select("name", "batch")


@query("SELECT 'User ' || o_custkey AS name, o_orderkey AS repo, (o_orderkey % 120)::BIGINT AS stars FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 120 >= 50 AND o_orderstatus <> 'F' AND c_nationkey = 7")
def s08_repository_launches(v: Views) -> DataFrame:
    repos = v.raw("orders").select((F.col("o_orderkey") % 120).alias("stargazers_count"), (F.col("o_orderstatus") == "F").alias("fork"), F.struct(F.col("o_custkey").alias("login")).alias("owner"), F.col("o_orderkey").alias("full_name"))
    users = v.raw("customer").select(F.col("c_custkey").alias("login"), cat("User ", F.col("c_custkey")).alias("name"), cat("place ", F.col("c_nationkey"), ";").alias("location"))
    return landed.repository_launches(repos, users, ["place 7;"]).select("name", F.col("description").alias("repo"), "stars")


@query("SELECT o_custkey AS profile, 'co' || o_orderkey AS company, year(o_orderdate)::INT AS start_year FROM orders")
def s09_work_histories(v: Views) -> DataFrame:
    o = v.raw("orders").select(F.col("o_custkey").alias("profile"), cat("co", F.col("o_orderkey")).alias("company"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("y"))
    year = lambda c: F.struct(c.alias("year"))
    none = F.lit(None).cast("int")
    a = o.where("profile % 3 = 0").groupBy("profile").agg(F.collect_list(F.struct("company", "title", year(F.col("y")).alias("starts_at"), year(none).alias("ends_at"))).alias("experiences"))
    b = o.where("profile % 3 = 1").groupBy("profile").agg(F.collect_list(F.struct(F.col("company").alias("companyName"), "title", F.struct(year(F.col("y")).alias("start"), year(none).alias("end")).alias("startEndDate"))).alias("h"))
    c = o.where("profile % 3 = 2").groupBy("profile").agg(F.collect_list(F.struct("company", "title", F.col("y").alias("start_year"), none.alias("end_year"), F.lit(True).alias("is_current"))).alias("experiences"))
    found = landed.work_histories(a, b.select("profile", F.struct(F.col("h").alias("positionHistory")).alias("positions")), c)
    return found.select("profile", F.inline("stints")).select("profile", "company", "start_year")


@query("SELECT pid || '' AS key, CASE WHEN p_score > 0 THEN 'open' ELSE 'closed' END AS status, sector AS notes FROM persons WHERE p_score > 0")
def s16_keyed_map(v: Views) -> DataFrame:
    entry = F.create_map(F.col("pid").cast("string"), F.struct(F.when(F.col("p_score") > 0, "open").otherwise("closed").alias("status"), F.col("sector").alias("notes")))
    raw = v.persons.select(F.to_json(entry).alias("export"))
    return landed.keyed_map(raw, "export", "status:string,notes:string", ["open"])


@query("""SELECT pid, count(*) AS n FROM (SELECT o_custkey AS pid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 3 GROUP BY pid""")
def j12_first_hits(v: Views) -> DataFrame:
    top = ranking.top_per_group(v.raw("orders").withColumnRenamed("o_custkey", "pid"), ["pid"], [F.col("o_orderkey")], 3)
    return top.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
