"""Joins: either-key joins as two equi joins, dictionary matches, evidence look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import quoted, any_of, name_key, text_of
from tidemark.tables import partitions_for


def either_key_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[Column, Column]], left_id: str, right_id: str) -> DataFrame:
    """Left join on any of several equalities; ``keys`` are pairs of expressions, null where a side has no key.

    An OR in a join condition has no equi key and becomes a nested loop. Here every key is an equi join
    of its own, their id pairs are united without repeats, and each side is joined back once: a row that matches two
    others comes twice, a pair that matches both ways once, as with OR.
    """
    slim_l = left.select(F.col(left_id).alias("_l"), *(k.alias(f"_k{i}") for i, (k, _) in enumerate(keys)))
    slim_r = right.select(F.col(right_id).alias("_r"), *(k.alias(f"_k{i}") for i, (_, k) in enumerate(keys)))
    pairs = [slim_l.select("_l", f"_k{i}").join(slim_r.select("_r", f"_k{i}"), f"_k{i}").select("_l", "_r") for i in range(len(keys))]
    met = reduce(DataFrame.unionByName, pairs).distinct()
    out = left.join(met, left[left_id] == met["_l"], "left")
    return out.join(right, out["_r"] == right[right_id], "left").drop("_l", "_r")


def left_by_key(left: DataFrame, right: DataFrame, key: Column, other: str) -> DataFrame:
    """Left join of ``key`` with the column ``other`` of ``right``; rows of null key stand aside, since by it they would all go to one task, and large sides are dealt to as many tasks as their rows ask for."""
    keyed = left.withColumn("_k", key)
    alone = keyed.where("_k is null").drop("_k").select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema))
    some, held = keyed.where("_k is not null"), right.where(F.col(other).isNotNull())
    spark = left.sparkSession
    usual, n = partitions_for(spark, 0), partitions_for(spark, some.count() + held.count())
    if n > usual:
        some, held = some.repartition(n, "_k"), held.repartition(n, other)
    return some.join(held, F.col("_k") == F.col(other), "left").drop("_k").unionByName(alone)


def first_match(hits: DataFrame, by: Sequence[str], rank: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """For each key the hit of lowest rank: an aggregate that combines before its shuffle."""
    order = F.struct(*rank)
    return hits.groupBy(*by).agg(*(F.min_by(c, order).alias(c) for c in keep))


def lookup_first(df: DataFrame, dimension: DataFrame, key: str, name: str, value: str, order: str, out: str) -> DataFrame:
    """``value`` of the first dimension row whose case-folded name equals the row's; blank where none."""
    dim = dimension.groupBy(F.lower(F.col(name)).alias("_name")).agg(F.min_by(value, order).alias(out))
    return df.join(dim, F.lower(df[key]) == dim["_name"], "left").drop("_name").withColumn(out, text_of(F.col(out)))


def dictionary_matches(df: DataFrame, text: Column, labels: Sequence[tuple[str, Sequence[str]]], keep: Sequence[str]) -> DataFrame:
    """One row for each row and label with a word in the text: per-label tests in one pass, no join."""
    found = F.filter(F.array(*(F.when(any_of(text, ws), F.lit(name)) for name, ws in labels)), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(found).alias("label"))


def token_matches(df: DataFrame, text: Column, dictionary: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The same for one-word keywords of a dictionary table (``label, keyword``) of any size: tokens meet it in an equi join."""
    tokens = df.select(*keep, F.explode(F.array_distinct(F.filter(F.split(F.lower(text_of(text)), r"[^\p{L}\p{N}]+"), lambda t: t != ""))).alias("keyword"))
    return tokens.join(dictionary, "keyword").select(*keep, "label").distinct()


def top_matches(matches: DataFrame, by: str, order: Sequence[Column], most: int, shown: int, value: str) -> DataFrame:
    """Per key the first ``most`` matches: their number, and the first ``shown`` values as a list."""
    ranked = matches.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rank") <= most)
    listed = F.array_sort(F.collect_list(F.when(F.col("_rank") <= shown, F.struct("_rank", value))))
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n_matches"), F.transform(listed, lambda x: x[value]).alias("shown"))


def append_new(existing: DataFrame, found: DataFrame, by: str, url: str, order: str, most: int) -> DataFrame:
    """Attach found rows whose URL the key does not have yet, after the existing ones, ``most`` in all."""
    fresh = found.join(existing.select(by, url).distinct(), [by, url], "left_anti").withColumn("_new", F.lit(1))
    both = existing.withColumn("_new", F.lit(0)).unionByName(fresh)
    place = F.row_number().over(Window.partitionBy(by).orderBy("_new", order))
    return both.withColumn("ord", place).where(F.col("ord") <= most).drop("_new")


def split_seen(entities: DataFrame, keys: Column, ledger: DataFrame, entity: str) -> DataFrame:
    """``entities`` with ``seen``: it has evidence keys and the ledger holds all of them."""
    flat = entities.select(entity, F.explode(keys).alias("key")).distinct()
    marked = flat.join(ledger.select("key", F.lit(True).alias("_in")).distinct(), "key", "left")
    seen = marked.groupBy(entity).agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("seen"))
    return entities.join(seen, entity, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def currently_employed(df: DataFrame, text: str, companies: Sequence[str]) -> Column:
    """Whether a tracked company stands in the text as a word, with no ex- or former before it."""
    low = F.lower(text_of(F.col(text)))
    tests = [low.rlike(rf"\b{quoted(c.lower())}\b") & ~low.rlike(rf"(?:ex[- ]|former(?:ly)? |previously (?:at )?){quoted(c.lower())}\b") for c in companies]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def corroborated(candidates: DataFrame, hits: DataFrame, terms: Sequence[str], key: str = "candidate_id") -> DataFrame:
    """Per candidate the first hit of another domain that holds the last name and a senior term."""
    last = F.element_at(F.split(name_key(F.col("name")), " "), -1)
    met = candidates.join(hits, key).where((F.col("hit_domain") != F.col("domain")) & F.lower("text").contains(last) & any_of(F.col("text"), terms))
    return first_match(met, [key], ["rank"], ["url"])


def all_tokens_in(name: Column, text: Column, least: int = 3) -> Column:
    """Whether every token of the name of at least so many letters stands in the text; false without such a token."""
    tokens = F.filter(F.split(name_key(name), " "), lambda t: F.length(t) >= least)
    low = F.lower(text_of(text))
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: low.contains(t))


def registry_match(name: Column, company: Column, title: Column, text: Column) -> Column:
    """``name`` or ``company`` by which a registry page corroborates a person, else null."""
    return F.when(all_tokens_in(name, title), "name").when((text_of(company) != "") & F.lower(text).contains(F.lower(company)) & text.rlike(r"\b(?:19|20)\d{2}\b"), "company")


def company_site(hits: DataFrame, company: str, skip: Sequence[str]) -> DataFrame:
    """Per company its first hit outside the skipped domains whose host resembles its six-letter slug."""
    slug = F.substring(F.regexp_replace(F.lower(F.col(company)), r"[^a-z0-9]", ""), 1, 6)
    host = F.regexp_replace(F.lower("host"), r"[^a-z0-9]", "")
    return first_match(hits.where(~F.col("host").isin(*skip) & (F.length(slug) > 0) & (F.instr(host, slug) > 0)), [company], ["rank"], ["url"])


def members_repositories(members: DataFrame, repos: DataFrame, since: Column, most: int = 2) -> DataFrame:
    """Contributors of tracked organisations with their own recent, unforked repositories; the first organisation wins."""
    own = members.groupBy("login").agg(F.min_by("org", F.struct("ord", "org")).alias("org")).join(repos.where(~F.col("fork") & (F.col("created") >= since)), "login")
    place = F.row_number().over(Window.partitionBy("login").orderBy(F.desc("stars"), "repo"))
    return own.withColumn("place", place).where(F.col("place") <= most)


def hot_boost(df: DataFrame, label: str, score: str, hot: Sequence[str], boost: float = 10, cap: float = 100) -> DataFrame:
    """Add to the score where a hot label holds the row's label or the other way round."""
    low = F.lower(text_of(F.col(label)))
    hit = reduce(lambda a, b: a | b, ((low != "") & (low.contains(h.lower()) | F.lit(h.lower()).contains(low)) for h in hot), F.lit(False))
    return df.withColumn(score, F.when(hit, F.least(F.col(score) + boost, F.lit(cap))).otherwise(F.col(score)))


def archive_merge(current: DataFrame, archive: DataFrame, key: str, score: str, least: float, place: str) -> DataFrame:
    """Current entities, and those of the archive that are not among them, score enough and have a known region."""
    kept = archive.join(current.select(key).distinct(), key, "left_anti").where((F.col(score) >= least) & (F.col(place) != "Unknown"))
    return current.withColumn("archived", F.lit(False)).unionByName(kept.withColumn("archived", F.lit(True)), allowMissingColumns=True)


def mention_score(mentions: DataFrame, person: str, source: str, order: str, text: str, engagement: str) -> DataFrame:
    """Per person, from five mentions of a source at most: min(30, 10 n) + min(20, 5 m), m those with engagement; five snippets."""
    place = F.row_number().over(Window.partitionBy(person, source).orderBy(order))
    kept = mentions.where(F.length(text) > 20).withColumn("_place", place).where("_place <= 5")
    snippets = F.slice(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.substring(text, 1, 60).alias("t")))), 1, 5)
    return kept.groupBy(person).agg(
        F.count(F.lit(1)).alias("n_mentions"),
        (F.least(F.lit(30), 10 * F.count(F.lit(1))) + F.least(F.lit(20), 5 * F.count_if(F.col(engagement)))).alias("social_score"),
        F.array_join(F.transform(snippets, lambda s: s["t"]), " / ").alias("snippets"),
    )


def fallback_lookup(df: DataFrame, table: DataFrame, keys: Sequence[tuple[str, str]], value: str) -> DataFrame:
    """``value`` of the row with the first key that matches; within a key the smallest value."""
    out = df
    for i, (mine, theirs) in enumerate(keys):
        found = table.where(text_of(F.col(theirs).cast("string")) != "").groupBy(F.col(theirs).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(found, out[mine] == found[f"_k{i}"], "left").drop(f"_k{i}")
    return out.withColumn(value, F.coalesce(*(F.col(f"_v{i}") for i in range(len(keys))))).drop(*(f"_v{i}" for i in range(len(keys))))
