"""Landed files as typed tables: feeds, indexes, hits, listings, pages, profiles, registry texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.html import links
from tidemark.functions.text import any_of, batch_key, parse_date, profile_url, strip_tags, text_of
from tidemark.operators.ranking import keep_first, recent_groups, top_per_group
from tidemark.operators.scoring import percent_change

RSS = "title string, link string, description string, summary string, pubDate string, updated string, author string"


def feed_items(spark: SparkSession, path: str, feed: str, tag: str = "item", title_chars: int = 200, summary_chars: int = 300) -> DataFrame:
    """RSS or Atom items (``tag`` item or entry) as articles: no markup, truncated, none without a title."""
    rows = spark.read.format("xml").option("rowTag", tag).schema(RSS).load(path)
    return rows.select(
        F.substring(strip_tags(F.col("title")), 1, title_chars).alias("title"),
        text_of(F.col("link")).alias("url"),
        F.substring(strip_tags(F.coalesce("description", "summary")), 1, summary_chars).alias("summary"),
        parse_date(F.coalesce("pubDate", "updated")).alias("published"),
        text_of(F.col("author")).alias("author"),
        F.lit(feed).alias("source"),
    ).where("title <> ''")


def index_articles(raw: DataFrame) -> DataFrame:
    """``articles[]`` of a news index, English or of no stated language, source ``GDELT/<domain>``."""
    flat = raw.select(F.inline("articles"))
    kept = flat.where(F.lower(text_of(F.col("language"))).isin("", "english"))
    return kept.select("title", "url", F.concat(F.lit("GDELT/"), F.col("domain")).alias("source"), parse_date(F.col("seendate")).alias("published"))


def search_hits(*vendors: DataFrame) -> DataFrame:
    """Hits of vendors with different names for the same things, in one shape."""
    names = {"link": ("link", "href", "url"), "title": ("title",), "snippet": ("snippet", "body", "description", "content")}

    def same(df: DataFrame) -> DataFrame:
        pick = lambda options: F.coalesce(*(F.col(o) for o in options if o in df.columns), F.lit(""))
        return df.select(*(pick(o).alias(n) for n, o in names.items()), *(c for c in ("query", "rank") if c in df.columns))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(same, vendors)).where("link <> ''")


def forum_items(raw: DataFrame, source: str) -> DataFrame:
    """A forum listing as demand items."""
    post = raw.select(F.explode("data.children").alias("c")).select("c.data.*")
    return post.select(F.lit(source).alias("source"), "title", F.concat(F.lit("https://www.reddit.com"), "permalink").alias("url"), F.col("score"), F.col("num_comments").alias("comments"), F.timestamp_seconds("created_utc").alias("ts"))


def story_items(raw: DataFrame, source: str) -> DataFrame:
    """Story search hits as demand items; without a URL, the item's own page."""
    hit = raw.select(F.inline("hits"))
    url = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("objectID")))
    return hit.select(F.lit(source).alias("source"), "title", url.alias("url"), F.col("points").alias("score"), F.col("num_comments").alias("comments"), F.timestamp_seconds("created_at_i").alias("ts"))


def launches(items: DataFrame, since: str, region: Sequence[str]) -> DataFrame:
    """Feed items with author, title, a date in range and a stated location, as product_launch signals."""
    text = F.concat_ws(" ", "title", "summary")
    kept = items.where((F.col("author") != "") & (F.col("published") >= F.lit(since).cast("timestamp")) & any_of(text, region))
    return kept.select(F.col("author").alias("name"), F.struct(F.lit("producthunt").alias("source"), F.lit("product_launch").alias("signal_type"), F.col("title").alias("description"), "url").alias("signal"))


def accelerator_batches(companies: DataFrame, region: Sequence[str], recent: int = 6) -> DataFrame:
    """Companies of the most recent batches in the region, with a placeholder founder."""
    kept = recent_groups(companies, "batch", batch_key(F.col("batch")), recent).where(any_of(F.col("all_locations"), region))
    return kept.select(F.concat(F.lit("Founder, "), "name").alias("name"), F.col("name").alias("company"), "batch", F.lit("accelerator_batch").alias("signal_type"), F.col("one_liner").alias("description"))


def repository_launches(repos: DataFrame, users: DataFrame, region: Sequence[str], stars: int = 50) -> DataFrame:
    """Starred repositories whose owner states a location in the region."""
    met = repos.where((F.col("stargazers_count") >= stars) & ~F.col("fork")).join(users, F.col("owner.login") == users["login"])
    return met.where(any_of(users["location"], region)).select(users["name"], users["location"], F.lit("github_launch").alias("signal_type"), F.col("full_name").alias("description"), F.col("stargazers_count").alias("stars"))


def work_histories(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """Profiles in three layouts as ``profile, stints``."""
    stint = lambda company, title, start, end: F.struct(company.alias("company"), title.alias("title"), start.cast("int").alias("start_year"), end.cast("int").alias("end_year"))
    one = a.select("profile", F.transform("experiences", lambda e: stint(e["company"], e["title"], e["starts_at"]["year"], e["ends_at"]["year"])).alias("stints"))
    two = b.select("profile", F.transform("positions.positionHistory", lambda e: stint(e["companyName"], e["title"], e["startEndDate"]["start"]["year"], e["startEndDate"]["end"]["year"])).alias("stints"))
    three = c.select("profile", F.transform("experiences", lambda e: stint(e["company"], e["title"], e["start_year"], F.when(~e["is_current"], e["end_year"]))).alias("stints"))
    return one.unionByName(two).unionByName(three)


def registry_lines(pages: DataFrame, page: str, text: str, most: int = 20) -> DataFrame:
    """Lines of 10 to 149 characters with a year, the first ``most`` of a page."""
    lines = pages.select(page, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    fit = lines.where(F.length("line").between(10, 149) & F.col("line").rlike(r"\b(?:19|20)\d{2}\b"))
    return top_per_group(fit, [page], ["pos"], most)


def result_links(pages: DataFrame, page: str, html: str, most: int = 10, pattern: str = r"uddg=([^&]+)", canonical: Callable[[Column], Column] = profile_url) -> DataFrame:
    """Links of a result page that ``canonical`` knows (blank: no): redirects unwrapped, the first of each, ``most`` at most."""
    hrefs = pages.select(page, F.posexplode(links(F.col(html))).alias("pos", "href"))
    inner = F.regexp_extract("href", pattern, 1)
    url = canonical(F.coalesce(F.try_url_decode(F.when(inner != "", inner)), F.col("href")))
    first = keep_first(hrefs.withColumn("url", url).where("url <> ''"), F.concat_ws("|", F.col(page).cast("string"), "url"), ["pos"])
    return top_per_group(first, [page], ["pos"], most)


def star_count(text: Column) -> Column:
    """``1,234`` and ``1.2k`` as numbers."""
    bare = F.regexp_replace(F.lower(F.trim(text_of(text))), ",", "")
    return F.when(bare.endswith("k"), (F.regexp_replace(bare, "k$", "").try_cast("double") * 1000).cast("int")).otherwise(bare.try_cast("int"))


def trending(rows: DataFrame, least: int = 20, today: int = 10) -> DataFrame:
    """Trending repositories with enough stars in all or today, the first per owner."""
    parsed = rows.withColumns({"n_stars": F.coalesce(star_count(F.col("stars")), F.lit(0)), "n_today": F.coalesce(F.regexp_extract("today", r"([\d,]+)", 1).try_cast("int"), F.lit(0)), "owner": F.split("repo", "/")[0]})
    return keep_first(parsed.where((F.col("n_stars") >= least) | (F.col("n_today") >= today)), "owner", ["ord"])


def quotes(raw: DataFrame) -> DataFrame:
    """Price, previous close and percent change, indexes first, then region and name."""
    previous = F.coalesce("meta.chartPreviousClose", "meta.previousClose")
    rows = raw.select("symbol", "geo", "is_index", F.col("meta.regularMarketPrice").alias("price"), previous.alias("previous_close"))
    return rows.withColumn("change_pct", percent_change(F.col("price"), F.col("previous_close"))).orderBy(F.desc("is_index"), "geo", "symbol")


def companies_by_region(companies: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """The first region is every company that is not in the other's set."""
    return companies.join(other.select(name), name, "left_anti").withColumn("region", F.lit("home")).unionByName(companies.join(other.select(name), name, "left_semi").withColumn("region", F.lit("other")))


def keyed_map(raw: DataFrame, column: str, value: str, statuses: Sequence[str]) -> DataFrame:
    """A JSON object of objects as rows ``key, <fields>``, those of the given statuses."""
    rows = raw.select(F.explode(F.from_json(column, f"map<string,struct<{value}>>")).alias("key", "v")).select("key", "v.*")
    return rows.where(F.col("status").isin(*statuses))


def extraction_rows(responses: DataFrame, fields: str = "idx int, person string, prev_company string, prev_title string, new_company string, event string, geo string") -> DataFrame:
    """Rows of the outermost JSON list inside a model's free text, by the echoed index; blanks are null, indexes outside the batch go."""
    listed = F.from_json(F.regexp_extract("raw_text", r"(?s)\[.*\]", 0), f"array<struct<{fields}>>")
    flat = responses.select("batch_id", "batch_size", F.inline(listed)).where(F.col("idx").between(0, F.col("batch_size") - 1))
    texts = [f.name for f in flat.schema if f.dataType.simpleString() == "string" and f.name != "batch_id"]
    return flat.withColumns({c: F.when(~F.lower(F.trim(c)).isin("", "null", "none", "unknown"), F.trim(c)) for c in texts})


def extraction_signals(rows: DataFrame, events: dict[str, str]) -> DataFrame:
    """Extraction rows as signals: event by taxonomy, organisation names dropped, a person required unless it is funding."""
    from tidemark.functions.text import is_organisation

    kind = F.create_map(*(F.lit(x) for kv in events.items() for x in kv))[F.lower("event")]
    named = rows.withColumn("person", F.when(~is_organisation(F.col("person")), F.col("person"))).withColumn("signal_type", kind)
    return named.where(F.col("signal_type").isNotNull() & (F.col("person").isNotNull() | (F.col("signal_type") == "funding_news")))
