"""Landed JSON text with drifting vendor schemas, read as VARIANT; what cannot be read is kept with a reason."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.text import any_of, parse_date, text_of
from tidemark.tables import materialise


@dataclass(frozen=True)
class Layout:
    """Where the records of a vendor lie and what their fields are called.

    ``lists`` are paths to the list of records, tried in turn; a single record in its place is a list of one. ``fields`` gives each column a type
    and the paths to try: the first that is there and of that type. ``whole`` are fields of the whole line. A record without one of ``required`` (blank counts as absent) is rejected.
    """

    lists: tuple[str, ...]
    fields: Mapping[str, tuple[str, tuple[str, ...]]]
    required: tuple[str, ...] = ()
    whole: Mapping[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)


@dataclass(frozen=True)
class Landed:
    """``rows`` of records, and ``rejected``: ``file, reason, text`` of every line or record that is none."""

    rows: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        return self.rejected.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))


def _is(kind: str, v: Column) -> Column:
    """Whether a variant is an ``OBJECT`` or an ``ARRAY``."""
    return F.try_variant_get(v, "$", "map<string,variant>" if kind == "OBJECT" else "array<variant>").isNotNull()


def pick(v: Column, kind: str, paths: tuple[str, ...]) -> Column:
    """The first of ``paths`` in a variant that can be had as ``kind``; an object or list is no string."""

    def one(path: str) -> Column:
        got = F.try_variant_get(v, path, kind)
        if kind != "string":
            return got
        at = F.try_variant_get(v, path, "variant")
        return F.when(~(got.startswith("{") & _is("OBJECT", at)) & ~(got.startswith("[") & _is("ARRAY", at)), got)

    return F.coalesce(*map(one, paths))


def read_lines(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``file, text`` of every line that is not blank, or of every file."""
    rows = spark.read.text(path, wholetext=whole_files).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("text"))
    return rows.where(F.trim("text") != "")


def records(lines: DataFrame, layout: Layout) -> Landed:
    """The records of ``lines`` (``file, text``) in the columns of ``layout``, and the rejected lines and records. Other columns of ``lines`` stay with the rows.

    Every line is parsed once, in one pass without filters (Spark would parse again in each condition), whose typed rows are written; both results read those.
    """
    parsed = lines.withColumn("_v", F.try_parse_json("text"))

    def listed(path: str) -> Column:
        at = F.try_variant_get(F.col("_v"), path, "variant")
        return F.coalesce(F.try_variant_get(F.col("_v"), path, "array<variant>"), F.when(_is("OBJECT", at), F.array(at)))

    parsed = parsed.withColumn("_list", F.coalesce(*map(listed, layout.lists)))
    reason = F.when(F.col("_v").isNull(), "not JSON").when(F.col("_list").isNull(), "no records")
    kept = [c for c in lines.columns if c not in ("file", "text")]
    whole = [pick(F.col("_v"), kind, paths).alias(name) for name, (kind, paths) in layout.whole.items()]
    none = F.array(F.lit(None).cast("variant"))
    parsed = parsed.select("file", *kept, *whole, reason.alias("_reason"), F.when(reason.isNotNull(), F.col("text")).alias("_line"), F.coalesce("_list", none).alias("_list"))
    # a plain explode makes Spark test the list for emptiness in a filter below, and parse for it again
    each = parsed.select("file", *kept, *layout.whole, "_reason", "_line", F.explode_outer("_list").alias("_r")).where("_r is not null or _reason is not null")
    each = each.withColumns({name: pick(F.col("_r"), kind, paths) for name, (kind, paths) in layout.fields.items()})
    absent = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    odd = F.col("_r").isNotNull() & ~_is("OBJECT", F.col("_r"))
    named = [c for c in layout.required if all(p.startswith("$.") for p in layout.fields[c][1])] if set(layout.required) <= set(layout.fields) else []
    if named:  # what has a name in it is an object
        odd = absent(named[0]) & odd
    short = reduce(lambda a, c: a.when(absent(c), f"no {c}"), layout.required, F.when(F.col("_reason").isNotNull(), F.col("_reason")).when(odd, "no object"))
    each = materialise(each.withColumn("_short", short).withColumn("_line", F.when(F.col("_short").isNotNull(), F.coalesce("_line", F.to_json("_r")))).drop("_r", "_reason"))
    rejected = each.where("_short is not null").select("file", F.col("_short").alias("reason"), F.col("_line").alias("text"))
    return Landed(each.where("_short is null").drop("_line", "_short"), rejected)


# Layouts of the surveyed vendors.
INDEX = Layout(
    ("$.articles",),
    {"title": ("string", ("$.title",)), "url": ("string", ("$.url",)), "domain": ("string", ("$.domain",)), "seendate": ("string", ("$.seendate",)), "language": ("string", ("$.language",))},
    ("title", "url"),
)
HITS = Layout(
    ("$.organic", "$.web.results", "$.results", "$.data", "$"),
    {"link": ("string", ("$.link", "$.href", "$.url")), "title": ("string", ("$.title",)), "snippet": ("string", ("$.snippet", "$.body", "$.description", "$.content"))},
    ("link",),
)
FORUM = Layout(
    ("$.data.children",),
    {"title": ("string", ("$.data.title",)), "permalink": ("string", ("$.data.permalink",)), "score": ("long", ("$.data.score",)), "comments": ("long", ("$.data.num_comments",)), "created": ("double", ("$.data.created_utc",))},
    ("title", "permalink"),
)
STORIES = Layout(
    ("$.hits",),
    {"title": ("string", ("$.title",)), "link": ("string", ("$.url",)), "item": ("string", ("$.objectID",)), "score": ("long", ("$.points",)), "comments": ("long", ("$.num_comments",)), "created": ("double", ("$.created_at_i",))},
    ("title", "item"),
)
COMPANIES = Layout(
    ("$.companies", "$"),
    {k: ("string", (f"$.{k}",)) for k in ("name", "slug", "batch", "all_locations", "website", "one_liner")},
    ("name", "batch"),
)
REPOSITORIES = Layout(
    ("$.items", "$"),
    {"full_name": ("string", ("$.full_name",)), "login": ("string", ("$.owner.login",)), "stars": ("long", ("$.stargazers_count",)), "fork": ("boolean", ("$.fork",)), "description": ("string", ("$.description",))},
    ("full_name", "login"),
)
USERS = Layout(("$.items", "$"), {k: ("string", (f"$.{k}",)) for k in ("login", "name", "location", "company", "bio")}, ("login",))
PROFILES = Layout(
    ("$.experiences", "$.positions.positionHistory"),
    {
        "company": ("string", ("$.company", "$.companyName")), "title": ("string", ("$.title",)), "current": ("boolean", ("$.is_current",)),
        "start_year": ("int", ("$.starts_at.year", "$.startEndDate.start.year", "$.start_year")), "end_year": ("int", ("$.ends_at.year", "$.startEndDate.end.year", "$.end_year")),
    },
    ("company",),
    {"profile": ("string", ("$.profile", "$.public_identifier"))},
)
QUOTES = Layout(
    ("$.chart.result", "$.quotes", "$"),
    {"symbol": ("string", ("$.symbol", "$.meta.symbol")), "price": ("double", ("$.meta.regularMarketPrice",)), "previous_close": ("double", ("$.meta.chartPreviousClose", "$.meta.previousClose"))},
    ("symbol", "price"),
)


def index_articles(lines: DataFrame) -> Landed:
    """A news index: articles in English or of no stated language."""
    got = records(lines, INDEX)
    kept = got.rows.where(F.lower(text_of(F.col("language"))).isin("", "english"))
    return Landed(kept.select("title", "url", F.concat(F.lit("GDELT/"), text_of(F.col("domain"))).alias("source"), parse_date(F.col("seendate")).alias("published")), got.rejected)


def search_hits(lines: DataFrame) -> Landed:
    got = records(lines, HITS)
    return Landed(got.rows.select("link", text_of(F.col("title")).alias("title"), text_of(F.col("snippet")).alias("snippet")), got.rejected)


def demand_items(forum: DataFrame, stories: DataFrame) -> Landed:
    """A forum's listing and a story search as demand items; a story without a URL is its own page."""
    one, two = records(forum, FORUM), records(stories, STORIES)
    at = F.timestamp_seconds("created").alias("ts")
    posts = one.rows.select(F.lit("forum").alias("source"), "title", F.concat(F.lit("https://www.reddit.com"), "permalink").alias("url"), "score", "comments", at)
    own = F.concat(F.lit("https://news.ycombinator.com/item?id="), "item")
    hits = two.rows.select(F.lit("stories").alias("source"), "title", F.coalesce(F.nullif(F.trim("link"), F.lit("")), own).alias("url"), "score", "comments", at)
    return Landed(posts.unionByName(hits), one.rejected.unionByName(two.rejected))


def repository_launches(repos: DataFrame, users: DataFrame, region: tuple[str, ...], stars: int = 50) -> Landed:
    """Starred repositories whose owner states a location in the region."""
    one, two = records(repos, REPOSITORIES), records(users, USERS)
    met = one.rows.where((F.col("stars") >= stars) & ~F.coalesce("fork", F.lit(False))).join(two.rows.select("login", "name", "location"), "login")
    kept = met.where(any_of(F.col("location"), region)).select("name", "location", F.lit("github_launch").alias("signal_type"), F.col("full_name").alias("description"), "stars")
    return Landed(kept, one.rejected.unionByName(two.rejected))


def work_histories(lines: DataFrame) -> Landed:
    """Stints of profiles in three layouts: ``profile, company, title, start_year, end_year``; the end of a current one is null."""
    got = records(lines, PROFILES)
    end = F.when(~F.coalesce("current", F.lit(False)), F.col("end_year")).alias("end_year")
    return Landed(got.rows.select("profile", "company", "title", "start_year", end), got.rejected)
