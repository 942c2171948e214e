"""Dictionaries of any size against whole texts: phrases as substrings by what stands around a space or by their rarest gram, names as runs of tokens with their context."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import text_of
from tidemark.tables import materialise

#: What a token is: letters, digits and the sign of numbered names.
TOKEN = r"[\p{L}\p{N}#]+"
#: Tokens of a name that its places are looked up by; those of a longer one that follow are compared where it is found.
WIDTH = 8
#: Widths of the windows of characters on both sides of a space, and how many keywords may share one.
RUNGS, SHARED = (1, 2, 4, 8, 16), 128
#: Rows of a table that is handed to all tasks, and labels of a keyword from which it gives them once a text.
SMALL, MANY = 200_000, 16
#: Runs of a keyword that may be the one it is posted under: the first so many.
PLACES = 2**24
#: What before a company's name says that someone has left it.
FORMER = ("ex", "former", "formerly", "previously")


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be handed to all tasks whatever the session's threshold if it has no more than ``SMALL`` rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _grams(text: Column, size: int) -> Column:
    """Every run of ``size`` characters, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _windows(left: Column, right: Column, a: int, b: int) -> Column:
    """One number for the last ``a`` characters of ``left`` and the first ``b`` of ``right``."""
    return F.xxhash64(F.right(left, F.lit(a)), F.left(right, F.lit(b)))


def _spaced(slim: DataFrame, key: str, keywords: DataFrame) -> DataFrame | None:
    """``key, keyword`` for each place in ``slim`` (``key, _text``) of a keyword that holds spaces; None without such keywords.

    Such a keyword stands in a text where its ``head``, what comes before its first space, ends a piece between spaces and its rest begins what follows.
    It is posted under a window of characters around that space, the narrowest of ``RUNGS`` that at most ``SHARED`` keywords share or else that which the fewest share;
    the pieces of a text meet it there and are compared in place. No text is searched again, but for keywords of more than ``WIDTH`` spaces.
    """
    head = F.substring_index("keyword", " ", 1)
    parts = keywords.where(F.contains("keyword", F.lit(" "))).select("keyword", head.alias("_head"), F.substring("keyword", F.length(head) + 2, F.length("keyword")).alias("_rest"))
    n = F.size(F.split("_rest", " "))
    parts = parts.select("keyword", "_head", F.substring_index("_rest", " ", WIDTH).alias("_rest"), n.alias("n"))
    wide = lambda c, w: reduce(lambda low, x: F.when(F.length(c) >= x, F.lit(x)).otherwise(low), [x for x in RUNGS if x <= w], F.lit(0))
    rungs = F.array(*(F.struct(F.lit(w).alias("w"), wide("_head", w).alias("a"), wide("_rest", w).alias("b")) for w in RUNGS[1:]))
    each = parts.select("*", F.explode(rungs).alias("r")).groupBy("keyword", "_head", "_rest", "n", "r.a", "r.b").agg(F.min("r.w").alias("w"))
    each = materialise(each.withColumn("_window", F.xxhash64(F.expr("right(_head, a)"), F.expr("left(_rest, b)"))))
    shared = each.groupBy("_window").agg(F.count(F.lit(1)).alias("m"))
    best = F.min(F.struct(F.greatest("m", F.lit(SHARED)), "w", "a", "b", "_window")).alias("best")
    posted = materialise(each.join(shared, "_window").groupBy("keyword", "_head", "_rest", "n").agg(best).select("keyword", "_head", "_rest", "n", "best.a", "best.b", "best._window"))
    shapes = [(r.a, r.b) for r in posted.select("a", "b").distinct().orderBy("a", "b").collect()]  # of at most six widths each
    if not shapes:
        return None
    longest = posted.agg(F.max("n")).first()[0]
    # pieces side by side with those that follow; an outer explode, since a plain one makes Spark split the text for a filter too
    beside = F.arrays_zip("_s", *(F.slice("_s", F.lit(i + 1), F.size("_s") + 1).alias(f"s{i}") for i in range(1, min(longest, WIDTH) + 1)))
    placed = slim.select(key, F.split("_text", " ").alias("_s")).select(key, F.explode_outer(beside).alias("_p")).where("_p.s1 is not null")
    after = F.col("_p.s1") if longest == 1 else F.concat_ws(" ", *(f"_p.s{i}" for i in range(1, min(longest, WIDTH) + 1)))
    placed = placed.select(key, F.col("_p._s").alias("_left"), after.alias("_right")).select("*", F.length("_left").alias("_a"), F.length("_right").alias("_b"))
    windows = F.array(*(F.when((F.col("_a") >= a) & (F.col("_b") >= b), _windows(F.col("_left"), F.col("_right"), a, b)) for a, b in shapes))
    placed = placed.select(key, "_left", "_right", F.explode_outer(windows).alias("_window")).where("_window is not null")

    def at(these: DataFrame) -> DataFrame:
        met = placed.join(_small(these.select("_window", "keyword", "_head", "_rest")), "_window")
        return met.where(F.col("_left").endswith(F.col("_head")) & F.col("_right").startswith(F.col("_rest"))).select(key, "keyword")

    if longest <= WIDTH:
        return at(posted)
    longer = at(posted.where(F.col("n") > WIDTH)).distinct().join(slim, key).where(F.col("_text").contains(F.col("keyword"))).select(key, "keyword")
    return at(posted.where(F.col("n") <= WIDTH)).unionByName(longer)


def _unspaced(slim: DataFrame, key: str, keywords: DataFrame, gram: int) -> DataFrame | None:
    """``key, keyword`` for each piece of ``slim`` (``key, _text``) between spaces that holds a keyword without spaces; None if none does.

    Each distinct piece is looked at once. All runs of ``gram`` characters of the pieces are counted, and a keyword (a shorter one whole) is posted under that of its runs which
    the fewest pieces hold. One with a run that no piece holds stands nowhere and goes no further. Only pieces with the posted run of a keyword are searched for it.
    """
    keywords = materialise(keywords.where(~F.contains("keyword", F.lit(" "))).withColumn("size", F.least(F.length("keyword"), F.lit(gram))))
    lengths = {r.size: r.n for r in keywords.groupBy("size").agg(F.min(F.length("keyword")).alias("n")).collect()}  # by sizes of 1 to ``gram``
    if not lengths:
        return None
    split = slim.select(key, F.explode_outer(F.split("_text", " ")).alias("_piece")).where(F.length("_piece") >= min(lengths.values()))
    pieces = materialise(split.select("_piece").distinct().select(F.monotonically_increasing_id().alias("_id"), "_piece"))
    all_runs = F.array_distinct(F.flatten(F.array(*(_grams(F.col("_piece"), s) for s in sorted(lengths)))))
    runs = F.coalesce(*(F.when(F.col("size") == s, _grams(F.col("keyword"), s)) for s in sorted(lengths)))
    met = pieces.select("_id", F.explode_outer(all_runs).alias("gram"))
    counted = materialise(met.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    each = keywords.select("keyword", "size", F.posexplode_outer(runs).alias("at", "gram")).where(F.col("at") < PLACES).join(_small(counted), "gram", "left")
    best = each.groupBy("keyword", "size").agg(F.min(F.coalesce("n", F.lit(0)) * PLACES + F.col("at")).alias("best")).where(F.col("best") >= PLACES)
    posted = materialise(best.select("keyword", F.get(runs, (F.col("best") % PLACES).cast("int")).alias("gram")))
    if posted.isEmpty():
        return None
    held = met.join(_small(posted), "gram").select("_id", "keyword").join(pieces, "_id").where(F.col("_piece").contains(F.col("keyword")))
    held = materialise(held.select("_piece", "keyword"))
    return None if held.isEmpty() else split.join(_small(held), "_piece").select(key, "keyword")


def substring_matches(docs: DataFrame, key: str, text: str, dictionary: DataFrame, gram: int = 4, rare_in: int = 64) -> DataFrame:
    """``key, label`` of each document and label of ``dictionary`` (``label, keyword``) one of whose keywords stands anywhere in the text, in any case.

    Texts are split at spaces. A keyword that holds spaces is met at a place between two pieces, one without spaces in the distinct pieces of all texts; each place is
    compared by itself, so the work does not grow with the length of a text times the keywords in it. Neither the plan nor a task's memory grows with the dictionary:
    one of up to ``SMALL`` rows is handed to all tasks, a larger one is shuffled. Blank keywords and null keys match nothing. ``rare_in`` has no effect any more: runs are
    counted in all pieces, not in a sample.
    """
    words = materialise(dictionary.select("label", F.lower("keyword").alias("keyword")).where(F.trim("keyword") != "").distinct())
    slim = docs.where(F.col(key).isNotNull()).select(key, F.lower(text_of(F.col(text))).alias("_text"))
    keywords = words.select("keyword").distinct()
    both = [df for df in (_spaced(slim, key, keywords), _unspaced(slim, key, keywords, gram)) if df is not None]
    if not both:
        return docs.select(key, F.lit("").alias("label")).where("false")
    found = materialise(reduce(DataFrame.unionByName, both))
    # a keyword of many labels gives them once to a text, however often it stands there
    named = materialise(words.join(found.select("keyword").distinct(), "keyword", "left_semi"))
    many = materialise(named.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select("keyword"))
    few = found.join(_small(named.join(many, "keyword", "left_anti")), "keyword")
    once = found.join(_small(many), "keyword", "left_semi").distinct().join(named, "keyword")
    return few.select(key, "label").unionByName(once.select(key, "label")).distinct()


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit(TOKEN), F.lit(0))


def mentions(docs: DataFrame, key: str, text: str, names: DataFrame, name: str, before: int = 2, around: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """``key, name, at, before, context`` and ``keep``: every place where a name's tokens stand one after another in a text.

    ``at`` counts tokens from 1, ``before`` are the last ``before`` tokens ahead of it, ``context`` the name with ``around`` tokens on both sides.
    Runs of tokens, of the lengths that names have, meet the names in an equi join on the whole run (its first ``WIDTH`` tokens): a first name that
    thousands share is no key, and no text is compared with a name that it does not hold. Only places and runs are joined; the texts that hold a name are then read again for what stands around it.
    Rows are told apart by a hash of key and text, and a name is looked for at each place found, so a hash that two share brings nothing wrong. Names without tokens are found nowhere; names that differ in case or punctuation alone are found together.
    """
    wanted = names.select(name).distinct().withColumn("_tokens", tokens_of(F.col(name))).where(F.size("_tokens") > 0)
    head = F.array_join(F.slice("_tokens", 1, WIDTH), " ")
    wanted = materialise(wanted.select(name, F.array_join("_tokens", " ").alias("_run"), F.size("_tokens").alias("_size"), head.alias("_head")))
    widths = [r.w for r in wanted.select(F.least("_size", F.lit(WIDTH)).alias("w")).distinct().orderBy("w").collect()]  # 1 to ``WIDTH``
    if not widths:
        return docs.select(key, F.lit("").alias(name), F.lit(0).alias("at"), F.array().cast("array<string>").alias("before"), F.lit("").alias("context"), *keep).where("false")
    row = F.xxhash64(key, text_of(F.col(text))).alias("_row")
    # each place with the tokens that follow it, side by side; a plain explode makes Spark test the list for emptiness in a filter below, and make it for that too
    split = docs.select(row, tokens_of(F.col(text)).alias("_t"))
    beside = F.arrays_zip(*(F.slice("_t", F.lit(i + 1), F.size("_t") + 1).alias(f"t{i}") for i in range(widths[-1])))
    placed = split.select("_row", F.posexplode_outer(beside).alias("_at", "_r")).where("_r is not null")
    starts = [F.when(F.col(f"_r.t{w - 1}").isNotNull(), F.concat_ws(" ", *(f"_r.t{i}" for i in range(w)))) for w in widths]
    flat = placed.select("_row", (F.col("_at") + 1).alias("at"), starts[0].alias("_start") if len(starts) == 1 else F.explode_outer(F.array(*starts)).alias("_start")).where("_start is not null")
    met = flat.join(wanted, F.col("_start") == F.col("_head")).groupBy("_row").agg(F.collect_set(F.struct("at", name, "_run", "_size")).alias("_met"))

    def said(m: Column) -> Column:
        at, size = m["at"], m["_size"]
        low, start = F.greatest(F.lit(1), at - before), F.greatest(F.lit(1), at - around)
        there = F.array_join(F.slice("_t", at, size), " ") == m["_run"]
        context = F.array_join(F.slice("_t", start, at - start + size + around), " ")
        return F.struct(m[name].alias(name), at.alias("at"), F.slice("_t", low, at - low).alias("before"), context.alias("context"), there.alias("_there"))

    held = docs.select(key, *keep, row, F.col(text).alias("_text")).join(met, "_row").select(key, *keep, "_met", tokens_of(F.col("_text")).alias("_t"))
    found = held.select(key, *keep, F.explode_outer(F.transform("_met", said)).alias("_m"))
    return found.where("_m._there").select(key, *(f"_m.{c}" for c in (name, "at", "before", "context")), *keep)


def employed(docs: DataFrame, key: str, text: str, companies: DataFrame, name: str) -> DataFrame:
    """``key, employed``: whether the text names one of ``companies`` (a table of any size) without saying anywhere that it has been left."""
    found = mentions(docs, key, text, companies, name)
    last, two = F.element_at("before", -1), F.element_at("before", F.when(F.size("before") > 1, -2).otherwise(-1))
    left = F.when(F.size("before") > 0, last.isin(*FORMER) | ((last == "at") & (two == "previously"))).otherwise(False)
    each = found.groupBy(key, name).agg(F.max(left).alias("left"))
    current = each.groupBy(key).agg(F.max(~F.col("left")).alias("_employed"))
    return docs.select(key).join(current, key, "left").select(key, F.coalesce("_employed", F.lit(False)).alias("employed"))
