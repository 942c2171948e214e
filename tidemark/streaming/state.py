"""Keyed state between runs: batch merges of a run with what is held, and the same as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.ranking import numbered
from tidemark.functions.text import headline_key, text_of
from tidemark.operators.ranking import keep_first
from tidemark.tables import materialise, partitions_for


def profile_deltas(observations: DataFrame, key: str, order: Sequence[str], headline: str) -> DataFrame:
    """``delta`` of each observation in order: new at a key's first sight (or a blank key), changed
    where the comparison form of the headline differs from the last one, else seen."""
    seen = Window.partitionBy(key).orderBy(*order)
    form = headline_key(F.col(headline))
    before, nth = F.lag(form).over(seen), F.row_number().over(seen)
    blank = F.trim(text_of(F.col(key).cast("string"))) == ""
    return observations.withColumn("delta", F.when(blank | (nth == 1), "new").when(form != before, "changed").otherwise("seen"))


def headline_history(observations: DataFrame, key: str, order: Sequence[str], headline: str, most: int = 6, chars: int = 150) -> DataFrame:
    """Per key the last ``most`` headlines that were new or changed, oldest first."""
    moved = profile_deltas(observations, key, order, headline).where("delta <> 'seen'")
    back = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    kept = moved.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= most)
    items = F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.substring(headline, 1, chars).alias("h"))))
    return kept.groupBy(key).agg(F.transform(items, lambda x: x["h"]).alias("history"))


def delta_signals(deltas: DataFrame, gate: Column, url: str, order: Sequence[str | Column]) -> DataFrame:
    """What becomes a signal: gated, not seen before; a change has a type of its own; the first per URL and run."""
    kind = F.when(F.col("delta") == "changed", "stealth_headline_change").otherwise("linkedin_headline")
    return keep_first(deltas.where(gate & (F.col("delta") != "seen")).withColumn("signal_type", kind), url, order)


def merge_ledger(ledger: DataFrame, sightings: DataFrame, key: str, day: str) -> DataFrame:
    """The evidence ledger with a run's sightings: first and last day, and how many times."""
    new = sightings.groupBy(key).agg(F.min(day).alias("f"), F.max(day).alias("l"), F.count(F.lit(1)).alias("n"))
    both = ledger.join(new, key, "full")
    return both.select(key, F.least("first_seen", "f").alias("first_seen"), F.greatest("last_seen", "l").alias("last_seen"), (F.coalesce("times", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("times"))


def unexpired(state: DataFrame, last: str, as_of: str, days: int, newest: int | None = None, tie: str | None = None) -> DataFrame:
    """State younger than ``days``, undated rows kept; and of those the ``newest`` only, if asked."""
    kept = state.where(F.col(last).isNull() | (F.col(last) >= F.date_sub(F.lit(as_of).cast("date"), days)))
    return kept.orderBy(F.desc_nulls_first(last), tie or last).limit(newest) if newest else kept


def upsert(held: DataFrame, rows: DataFrame, key: str, keep: Sequence[str] = (), overwrite: Sequence[str] = ()) -> DataFrame:
    """Full outer merge: ``keep`` columns stay as first written where not null, ``overwrite`` ones take the new value."""
    new = rows.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in (*keep, *overwrite)))
    both = held.join(new, held[key] == new["_key"], "full")
    return both.select(F.coalesce(held[key], F.col("_key")).alias(key), *(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in keep), *(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in overwrite))


def sighting_key(url: Column, source: Column, kind: Column, profile: Column) -> Column:
    """What makes two signals the same: the URL, or where there is none source, type and profile."""
    return F.when(F.trim(text_of(url)) != "", url).otherwise(F.concat_ws("|", text_of(source), text_of(kind), text_of(profile)))


def exists_within(rows: DataFrame, held: DataFrame, keys: Sequence[str], ts: str, days: int) -> DataFrame:
    """``rows`` that the held signals do not already have within ``days`` before them; a null key or time is never had.

    Both meet in one order per key, and each row looks at the last held one before it: a key with many signals costs a sort, not pairs.
    """
    old = held.select(*keys, ts, F.lit(1).alias("_old"))
    both = rows.withColumn("_old", F.lit(0)).unionByName(old, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(ts, "_old").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("_old") == 1, F.col(ts))).over(before)
    whole = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
    had = F.coalesce(whole & (F.col("_last") >= F.col(ts) - F.make_dt_interval(F.lit(days))), F.lit(False))
    return both.withColumn("_last", last).where((F.col("_old") == 0) & ~had).select(*rows.columns)


def mark(table: DataFrame, hit: Column, column: str, value: str) -> DataFrame:
    """``column`` set to ``value`` where ``hit`` holds and it has another one, with ``changed``: a second run changes nothing."""
    changed = F.coalesce(hit, F.lit(False)) & ~F.col(column).eqNullSafe(F.lit(value))
    return table.withColumn("changed", changed).withColumn(column, F.when(F.col("changed"), value).otherwise(F.col(column)))


def mark_listed(table: DataFrame, ids: DataFrame, row_id: str, column: str, value: str) -> DataFrame:
    """The same for the rows whose id is in the first column of ``ids``."""
    listed = ids.select(F.col(ids.columns[0]).alias("_id")).distinct().withColumn("_hit", F.lit(True))
    return mark(table.join(listed, table[row_id] == listed["_id"], "left"), F.col("_hit"), column, value).drop("_id", "_hit")


def delete_types(table: DataFrame, column: str, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows left without those of ``kinds``, and one row with how many went; a null type stays."""
    gone = F.coalesce(F.col(column).isin(*kinds), F.lit(False))
    return table.where(~gone), table.where(gone).agg(F.count(F.lit(1)).alias("affected"))


def _met(rows: DataFrame, held: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``order`` of the rows that share one of ``keys`` with any of ``held``. A row is dealt by the keys it has: those without one would all meet in one task."""

    def by(k: str) -> DataFrame:
        known = held.where(F.col(k).isNotNull()).select(k).distinct()
        return rows.where(F.col(k).isNotNull()).select(order, k).join(known, k, "left_semi").select(order)

    return reduce(DataFrame.unionByName, map(by, keys)).distinct()


def _claims(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows that a walk in ``order`` would put in: each whose keys no row put in before has.

    A round puts in the rows that come first among all undecided ones for each of their keys, and leaves out those that share a key with them;
    the rest goes on. At least the first undecided row of every connected group is decided in a round, and only undecided rows are read again.
    """
    spark, schema = rows.sparkSession, rows.schema
    left, chosen = materialise(rows), []
    while not left.isEmpty():

        def later(k: str, left: DataFrame = left) -> DataFrame:
            known = left.where(F.col(k).isNotNull()).select(order, k)
            return known.join(known.groupBy(k).agg(F.min(order).alias("_first")), k).where(F.col("_first") != F.col(order)).select(order)

        after = materialise(left.join(reduce(DataFrame.unionByName, map(later, keys)).distinct(), order, "left_semi").select(*schema.names))
        won = materialise(left.join(after.select(order), order, "left_anti").select(*schema.names))
        left = materialise(after.join(_met(after, won, keys, order), order, "left_anti").select(*schema.names))
        chosen.append(won)
    return reduce(DataFrame.unionByName, chosen, spark.createDataFrame([], schema))


def insert_claims(table: DataFrame, rows: DataFrame, keys: Sequence[str], row_id: str, order: str) -> DataFrame:
    """Each of ``rows`` with the id its insert returns, and ``inserted``: as if they came one after another in ``order`` (distinct numbers).

    A row whose first key a row of ``table``, or one inserted before it, has gets that row's id; else the same for the next key; else it is inserted with an
    id of its own, above the largest. Blank and null keys are none; a row without keys is always inserted. Of several rows of ``table`` with a key the one with the smallest id counts.
    Shuffles have as many partitions as the rows ask for, and rows meet by the keys they have or by ``order``, so a task's share does not grow with the table.
    """
    spark = table.sparkSession
    bare = lambda df: df.withColumns({k: F.when(F.trim(F.col(k).cast("string")) != "", F.col(k)) for k in keys})
    held, new = bare(table), materialise(bare(rows))
    with session_with(spark, spark__sql__shuffle__partitions=str(partitions_for(spark, table.count() + new.count()))):
        slim = new.select(order, *keys)
        slim = slim.join(_met(slim, held, keys, order), order, "left_anti").select(order, *keys)
        top = table.agg(F.coalesce(F.max(row_id), F.lit(0))).first()[0]
        won = materialise(numbered(_claims(slim, keys, order), [order], "_n").select(F.col(order).alias("_at"), *keys, (F.col("_n") + F.lit(top)).alias("_id")))
        out = new.join(won.select(F.col("_at").alias(order), F.col("_id").alias("_own")), order, "left")
        found = [F.col("_own")]
        for i, k in enumerate(keys):
            old = held.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(row_id).alias("_old"))
            mine = won.where(F.col(k).isNotNull()).select(k, "_at", "_id")
            asked = new.where(F.col(k).isNotNull()).select(order, k).join(old, k, "left").join(mine, k, "left")
            got = asked.select(order, F.coalesce("_old", F.when(F.col("_at") < F.col(order), F.col("_id"))).alias(f"_id{i}")).where(F.col(f"_id{i}").isNotNull())
            out = out.join(got, order, "left")
            found.append(F.col(f"_id{i}"))
        return materialise(out.select(*rows.columns, F.coalesce(*found).alias(row_id), F.col("_own").isNotNull().alias("inserted")))


def insert_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str], row_id: str, order: str) -> DataFrame:
    """``table`` and the rows that are inserted, by the rule of ``insert_claims``."""
    claimed = insert_claims(table, rows, keys, row_id, order).where("inserted").drop("inserted")
    return table.unionByName(claimed.select(*(c for c in claimed.columns if c in table.columns)), allowMissingColumns=True)


def apply_transitions(table: DataFrame, events: DataFrame, row_id: str, stages: Sequence[str], legacy: dict[str, str], order: str) -> DataFrame:
    """The latest valid stage event of each row applied; a note changes only to one that is not blank."""
    renamed = F.coalesce(F.create_map(*(F.lit(x) for kv in legacy.items() for x in kv))[F.col("stage")], F.col("stage")) if legacy else F.col("stage")
    good = events.withColumn("stage", renamed).where(F.col("stage").isin(*stages))
    last = good.groupBy(row_id).agg(F.max_by("stage", order).alias("_stage"), F.max_by(F.when(F.trim("notes") != "", F.col("notes")), F.when(F.trim("notes") != "", F.col(order))).alias("_notes"))
    return table.join(last, row_id, "left").withColumns({"stage": F.coalesce("_stage", "stage"), "notes": F.coalesce("_notes", "notes")}).drop("_stage", "_notes")


def write_back(signals: DataFrame, scores: DataFrame, key: str, name: str) -> DataFrame:
    """A score by key; else by name, only where there is none yet."""
    by_key = scores.where(text_of(F.col(key)) != "").groupBy(key).agg(F.max("score").alias("_by_key"))
    by_name = scores.groupBy(name).agg(F.max("score").alias("_by_name"))
    out = signals.join(by_key, key, "left").join(by_name, name, "left")
    return out.withColumn("score", F.coalesce("_by_key", F.when(F.col("score") == 0, F.col("_by_name")), "score")).drop("_by_key", "_by_name")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once for a row however often ``use`` names it: within a lambda Spark computes what it finds written there anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merge_json(current: Column, extra: Column, under: str | None = None) -> Column:
    """The JSON object text ``extra`` merged into the JSON object text ``current``, its values winning; with ``under`` it is put, whole, under that name.

    Values keep their types and nested ones their shape, as VARIANT. A text that is no object counts as an empty one, as does null; of a
    name that comes twice the last value counts. Names keep their places, new ones follow.
    """

    def entries(text: Column) -> Column:
        def last(found: Column) -> Column:
            return bound(F.transform(found, lambda e: e["key"]), lambda names: F.filter(found, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"])))

        return F.coalesce(bound(F.map_entries(F.from_json(text, "map<string,variant>")), last), F.array().cast("array<struct<key:string,value:variant>>"))

    def merged(new: Column) -> Column:
        return bound(F.transform(new, lambda e: e["key"]), lambda names: F.concat(F.filter(entries(current), lambda e: ~F.array_contains(names, e["key"])), new))

    new = entries(extra) if under is None else F.array(F.struct(F.lit(under).alias("key"), F.try_parse_json(extra).alias("value")))
    return F.to_json(F.map_from_entries(bound(new, merged)))


class ProfileWatch(StatefulProcessor):
    """Per key the headline last seen, the last ``most`` that were new or changed, and the first name that is not blank; one row for each observation, in run order."""

    def __init__(self, ttl_ms: int | None = None, most: int = 6, chars: int = 150):
        self.ttl_ms, self.most, self.chars = ttl_ms, most, chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value: each call of the state is a message to the JVM, and there are a few for every key
        self.held = handle.getValueState("held", "form string, name string, headlines array<string>", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, name, shown = self.held.get() or (None, "", [])
        out = []
        for r in sorted(rows, key=lambda r: (r.ord is None, r.ord)):
            delta = "new" if held is None else "seen" if r.form == held else "changed"
            name = name or (r.name or "").strip()
            if delta != "seen":
                shown = [*shown, (r.headline or "")[: self.chars]][-self.most :]
            out.append(Row(key=r.key, ord=r.ord, delta=delta, name=name, headlines=list(shown)))
            held = r.form
        if out:
            self.held.update((held, name, list(shown)))
        yield from out

    def close(self) -> None:
        pass


def watch_profiles(observations: DataFrame, key: str, order: str, headline: str, ttl_ms: int | None = None, name: str | None = None) -> DataFrame:
    """``key, ord, delta, name, headlines`` of a stream of observations, by state held per key (RocksDB).

    ``headlines`` are the last six that were new or changed, as of that observation, oldest first. With ``ttl_ms`` a
    key that is not seen for so long (by the clock of the run) is forgotten and comes back as new. A null key is a key; a null headline is blank.
    """
    called = F.col(name).cast("string") if name else F.lit("")
    slim = observations.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("ord"), headline_key(F.col(headline)).alias("form"), text_of(F.col(headline)).alias("headline"), text_of(called).alias("name"))
    return slim.groupBy("key").transformWithState(ProfileWatch(ttl_ms), "key string, ord long, delta string, name string, headlines array<string>", "Append", "ProcessingTime" if ttl_ms else "None")


@contextmanager
def session_with(spark: SparkSession, **settings: str) -> Iterator[None]:
    """The session with ``settings`` (dots as double underscores), as it was after."""
    settings = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def rocksdb(spark: SparkSession):
    """The state store that stateful processors need, for the queries started within."""
    return session_with(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_sightings(signals: DataFrame, key: str, ts: str, delay: str = "90 days") -> DataFrame:
    """The first signal of each key within the watermark, as a stream."""
    return signals.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def running_counts(articles: DataFrame, label: Column) -> DataFrame:
    """Articles per label so far, as a stream in complete mode: each arriving file renews the baseline."""
    return articles.select(F.explode(label).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def progressive(baseline: DataFrame, enriched: DataFrame, by: str, value: str) -> DataFrame:
    """The baseline where no enriched value has arrived yet, and how much of it has."""
    both = baseline.join(enriched.select(by, F.col(value).alias("_new")), by, "left")
    done = both.withColumns({"final": F.coalesce("_new", value), "arrived": F.col("_new").isNotNull()})
    share = done.agg(F.round(100 * F.avg(F.col("arrived").cast("int")), 1)).first()[0]  # one number
    return done.select(by, F.col("final").alias(value), "arrived", F.lit(share).cast("double").alias("progress_pct"))


def run_available(frame: DataFrame, out: str, checkpoint: str, mode: str = "append", by_clock: bool = False) -> None:
    """Process what has arrived since the last run, then stop: a daily run is this call with the same checkpoint.

    ``by_clock`` is for state that expires by the clock: Spark would go on with batches without data there for ever.
    """
    with session_with(frame.sparkSession, spark__sql__streaming__noDataMicroBatches__enabled=str(not by_clock).lower()):
        query = frame.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
