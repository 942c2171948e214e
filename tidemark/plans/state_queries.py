"""Registered queries: state between runs, over conversations, signals, orders and persons."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.streaming.kept import Kept
from tidemark.tables import materialise, shared_dir
from tidemark.functions import text as T
from tidemark.functions.words import STAGES
from tidemark.operators.joins import dictionary_matches
from tidemark.plans.bindings import AS_OF, THEMES, Views, contains_sql
from tidemark.plans.registry import query
from tidemark.streaming import state

_FORM = r"substr(trim(regexp_replace(lower(headline), '\s+', ' ', 'g')), 1, 90)"
_DELTAS = f"""SELECT *, CASE WHEN n = 1 THEN 'new' WHEN form <> before THEN 'changed' ELSE 'seen' END AS delta FROM (
  SELECT *, row_number() OVER k AS n, lag(form) OVER k AS before FROM (SELECT *, {_FORM} AS form FROM observations) WINDOW k AS (PARTITION BY profile ORDER BY ord, headline))"""


@query(f"SELECT profile, ord, delta FROM ({_DELTAS})")
def t01_profile_deltas(v: Views) -> DataFrame:
    return state.profile_deltas(v.observations, "profile", ["ord", "headline"], "headline").select("profile", "ord", "delta")


@query(f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY ord DESC, headline DESC) AS back FROM ({_DELTAS}) WHERE delta <> 'seen')
  SELECT profile, string_agg(substr(headline, 1, 150), '|' ORDER BY back DESC) AS history FROM m WHERE back <= 6 GROUP BY profile""")
def t02_headline_history(v: Views) -> DataFrame:
    return state.headline_history(v.observations, "profile", ["ord", "headline"], "headline").select("profile", F.array_join("history", "|").alias("history"))


@query(f"""WITH g AS (SELECT *, 'p' || profile % 40 AS url FROM ({_DELTAS}) WHERE delta <> 'seen' AND role = 'user'), k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord, profile, headline) AS r FROM g)
  SELECT url, profile, ord, CASE WHEN delta = 'changed' THEN 'stealth_headline_change' ELSE 'linkedin_headline' END AS signal_type FROM k WHERE r = 1""")
def t03_delta_signals(v: Views) -> DataFrame:
    d = state.profile_deltas(v.observations, "profile", ["ord", "headline"], "headline").withColumn("url", F.concat(F.lit("p"), (F.col("profile") % 40).cast("string")))
    return state.delta_signals(d, F.col("role") == "user", "url", ["ord", "profile", "headline"]).select("url", "profile", "ord", "signal_type")


_OLD = "SELECT url AS key, min(detected_at::DATE) AS f, max(detected_at::DATE) AS l, count(*) AS n FROM signals WHERE detected_at < '2024-01-20' GROUP BY url"


@query(f"""WITH o AS ({_OLD}), w AS ({_OLD.replace("< '2024-01-20'", ">= '2024-01-18'")})
  SELECT coalesce(o.key, w.key) AS key, least(o.f, w.f) AS first_seen, greatest(o.l, w.l) AS last_seen, coalesce(o.n, 0) + coalesce(w.n, 0) AS times FROM o FULL JOIN w ON o.key = w.key""")
def t04_ledger(v: Views) -> DataFrame:
    s = v.signals.select(F.col("url").alias("key"), F.col("detected_at").cast("date").alias("day"))
    empty = s.where("false").select("key", F.col("day").alias("first_seen"), F.col("day").alias("last_seen"), F.lit(0).cast("long").alias("times"))
    held = state.merge_ledger(empty, s.where("day < '2024-01-20'"), "key", "day")
    return state.merge_ledger(held, s.where("day >= '2024-01-18'"), "key", "day")


@query(f"""WITH l AS (SELECT url AS key, CASE WHEN min(id) % 9 = 0 THEN NULL ELSE max(detected_at::DATE) END AS last_seen FROM signals GROUP BY url)
  SELECT key, last_seen FROM l WHERE last_seen IS NULL OR last_seen >= DATE '{AS_OF[:10]}' - 18 ORDER BY last_seen DESC NULLS FIRST, key LIMIT 150""")
def t05_expiry(v: Views) -> DataFrame:
    led = v.signals.groupBy(F.col("url").alias("key")).agg(F.when(F.min("id") % 9 != 0, F.max(F.col("detected_at").cast("date"))).alias("last_seen"))
    return state.unexpired(led, "last_seen", AS_OF[:10], 18, newest=150, tie="key")


@query("""WITH a AS (SELECT pid AS key, 'first' AS first_surfaced, p_score FROM persons WHERE pid % 3 < 2), b AS (SELECT pid AS key, 'second' AS first_surfaced, p_score + 1 AS p_score FROM persons WHERE pid % 3 > 0)
  SELECT coalesce(a.key, b.key) AS key, coalesce(a.first_surfaced, b.first_surfaced) AS first_surfaced, coalesce(b.p_score, a.p_score) AS p_score FROM a FULL JOIN b ON a.key = b.key""")
def t06_t08_upserts(v: Views) -> DataFrame:
    p = v.persons.withColumn("key", F.col("pid"))
    a = p.where("pid % 3 < 2").select("key", F.lit("first").alias("first_surfaced"), "p_score")
    b = p.where("pid % 3 > 0").select("key", F.lit("second").alias("first_surfaced"), (F.col("p_score") + 1).alias("p_score"))
    return state.upsert(a, b, "key", keep=["first_surfaced"], overwrite=["p_score"])


@query("SELECT id FROM signals s WHERE NOT EXISTS (SELECT 1 FROM signals o WHERE o.url = s.url AND o.detected_at < s.detected_at AND o.detected_at >= s.detected_at - INTERVAL 1 DAY)")
def t07_first_within_window(v: Views) -> DataFrame:
    return state.exists_within(v.signals.select("id", "url", "detected_at"), v.signals, ["url"], "detected_at", 1).select("id")


@query("SELECT pid, sector, CASE WHEN pid % 10 = 3 AND region = 'ASIA' THEN 'departed' ELSE 'active' END AS status FROM persons WHERE sector <> 'furniture'")
def t09_conditional_updates(v: Views) -> DataFrame:
    active = v.persons.withColumn("status", F.lit("active"))
    marked = state.mark(active, (F.col("pid") % 10 == 3) & (F.col("region") == "ASIA"), "status", "departed")
    left, _ = state.delete_types(marked, "sector", ["furniture"])
    return left.select("pid", "sector", "status")


@query("""SELECT 'departed' AS operation, count(*) FILTER (pid % 10 = 3 AND region = 'ASIA') AS affected FROM persons UNION ALL SELECT 'again', 0
  UNION ALL SELECT 'reported', count(*) FILTER (signal_type = 'purchase' AND score > 100) FROM signals UNION ALL SELECT 'deleted', count(*) FILTER (sector IN ('furniture', 'machinery')) FROM persons""")
def t09_affected_counts(v: Views) -> DataFrame:
    """How many rows each conditional update changes: marking twice changes none the second time."""
    hit = (F.col("pid") % 10 == 3) & (F.col("region") == "ASIA")
    once = state.mark(v.persons.withColumn("status", F.lit("active")), hit, "status", "departed")
    again = state.mark(once.drop("changed"), hit, "status", "departed")
    ids = v.signals.where("signal_type = 'purchase' and score > 100").select("id")
    listed = state.mark_listed(v.signals.select("id", F.lit("new").alias("state")), ids, "id", "state", "reported")
    _, gone = state.delete_types(v.persons, "sector", ["furniture", "machinery"])
    count = lambda df, name: df.agg(F.count_if("changed").alias("affected")).select(F.lit(name).alias("operation"), "affected")
    return count(once, "departed").unionByName(count(again, "again")).unionByName(count(listed, "reported")).unionByName(gone.select(F.lit("deleted").alias("operation"), "affected"))


_INSERTS = """WITH t AS (SELECT oid AS id, signal_id AS s, coalesce(try_cast(regexp_extract(o_linkedin, '[0-9]+$') AS BIGINT), -1) AS l FROM outreach WHERE created_at < DATE '1995-06-17'),
  r AS (SELECT 2 * id AS ord, id AS s, coalesce(try_cast(regexp_extract(person_linkedin, '[0-9]+$') AS BIGINT), -1) AS l FROM signals
    UNION ALL SELECT 2 * oid + 1, signal_id, coalesce(try_cast(regexp_extract(o_linkedin, '[0-9]+$') AS BIGINT), -1) FROM outreach WHERE created_at >= DATE '1995-06-17'),
  todo AS (SELECT list({'ord': ord, 's': s, 'l': l, 'id': 0::BIGINT, 'top': 0::BIGINT, 'ss': []::BIGINT[], 'si': []::BIGINT[], 'ls': []::BIGINT[], 'li': []::BIGINT[], 'got': []::BIGINT[]} ORDER BY ord) AS rows FROM r),
  start AS (SELECT {'ord': 0::BIGINT, 's': 0::BIGINT, 'l': 0::BIGINT, 'id': 0::BIGINT, 'top': max(id), 'ss': list(s ORDER BY id), 'si': list(id ORDER BY id), 'ls': list(l ORDER BY id), 'li': list(id ORDER BY id), 'got': []::BIGINT[]} AS z FROM t),
  walk AS (SELECT rows, list_reduce(rows, lambda a, x: CASE
      WHEN x.s > 0 AND list_contains(a.ss, x.s) THEN {'ord': x.ord, 's': 0::BIGINT, 'l': 0::BIGINT, 'id': 0::BIGINT, 'top': a.top, 'ss': a.ss, 'si': a.si, 'ls': a.ls, 'li': a.li, 'got': list_append(a.got, a.si[list_position(a.ss, x.s)])}
      WHEN x.l >= 0 AND list_contains(a.ls, x.l) THEN {'ord': x.ord, 's': 0::BIGINT, 'l': 0::BIGINT, 'id': 0::BIGINT, 'top': a.top, 'ss': a.ss, 'si': a.si, 'ls': a.ls, 'li': a.li, 'got': list_append(a.got, a.li[list_position(a.ls, x.l)])}
      ELSE {'ord': x.ord, 's': 0::BIGINT, 'l': 0::BIGINT, 'id': 0::BIGINT, 'top': a.top + 1, 'ss': list_append(a.ss, x.s), 'si': list_append(a.si, a.top + 1), 'ls': list_append(a.ls, x.l), 'li': list_append(a.li, a.top + 1), 'got': list_append(a.got, a.top + 1)} END, z) AS e FROM todo, start)
  SELECT unnest(list_transform(rows, lambda x: x.ord)) AS ord, unnest(e.got) AS id FROM walk"""


def _inserts(v: Views) -> tuple[DataFrame, DataFrame]:
    """Outreach rows of the first half as the table; all signals and all later outreach rows as the batch, in turn by id."""
    t = v.outreach.select(F.col("oid").alias("id"), F.nullif(F.col("signal_id"), F.lit(0)).alias("signal_id"), "o_linkedin", "created_at")
    s = v.signals.select((2 * F.col("id")).alias("ord"), F.nullif(F.col("id"), F.lit(0)).alias("signal_id"), F.col("person_linkedin").alias("o_linkedin"))
    later = t.where("created_at >= date '1995-06-17'").select((2 * F.col("id") + 1).alias("ord"), "signal_id", "o_linkedin")
    return t.where("created_at < date '1995-06-17'").drop("created_at"), s.unionByName(later)


@query(_INSERTS)
def t10_insert_if_absent(v: Views) -> DataFrame:
    """The id that each insert of the batch returns."""
    table, rows = _inserts(v)
    return state.insert_claims(table, rows, ["signal_id", "o_linkedin"], "id", "ord").select("ord", "id")


@query(f"""WITH e AS (SELECT l_orderkey AS oid, l_linenumber AS step, ['new', 'contacted', 'lead', 'oops', 'meeting', 'passed', 'replied'][l_linenumber] AS st, CASE WHEN l_linenumber % 2 = 0 THEN 'n' || l_linenumber ELSE '' END AS notes FROM lineitem),
  g AS (SELECT *, CASE st WHEN 'lead' THEN 'contacted' ELSE st END AS s2 FROM e WHERE st <> 'oops'),
  x AS (SELECT oid, arg_max(s2, step) AS s, arg_max(notes, step) FILTER (notes <> '') AS n FROM g GROUP BY oid)
  SELECT o.oid, coalesce(s, stage) AS stage, coalesce(n, 'none') AS notes FROM outreach o LEFT JOIN x ON x.oid = o.oid""")
def t11_stage_transitions(v: Views) -> DataFrame:
    steps = F.array(*map(F.lit, ["new", "contacted", "lead", "oops", "meeting", "passed", "replied"]))
    n = F.col("l_linenumber")
    e = v.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1))).select(F.col("l_orderkey").alias("oid"), n.alias("step"), F.element_at(steps, n).alias("stage"), F.when(n % 2 == 0, F.concat(F.lit("n"), n.cast("string"))).otherwise("").alias("notes"))
    table = v.outreach.select("oid", "stage", F.lit("none").alias("notes"))
    return state.apply_transitions(table, e, "oid", STAGES, {"lead": "contacted"}, "step").select("oid", "stage", "notes")


@query("""WITH s AS (SELECT id, person_linkedin AS o_linkedin, person_name AS o_name, CASE WHEN id % 2 = 0 THEN 0.0 ELSE score END AS score FROM signals),
  a AS (SELECT o_linkedin, max(lead_score) AS x FROM outreach WHERE o_linkedin <> '' GROUP BY 1), b AS (SELECT o_name, max(lead_score) AS y FROM outreach GROUP BY 1)
  SELECT id, coalesce(x, CASE WHEN score = 0 THEN y END, score) AS score FROM s LEFT JOIN a ON a.o_linkedin = s.o_linkedin LEFT JOIN b ON b.o_name = s.o_name""")
def t12_score_write_back(v: Views) -> DataFrame:
    s = v.signals.select("id", F.col("person_linkedin").alias("o_linkedin"), F.col("person_name").alias("o_name"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("score")).alias("score"))
    return state.write_back(s, v.outreach.select("o_linkedin", "o_name", F.col("lead_score").alias("score")), "o_linkedin", "o_name").select("id", "score")


@query("""SELECT id, CASE WHEN id % 5 = 0 THEN '{' ELSE '{"k":' || (raw_data->>'k') || ',' END || '"enrichment":{"score":' || id % 7 || ',"hot":' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END || ',"tags":["' || signal_type || '",null],"at":{"source":"' || source || '"}}}' AS raw FROM signals""")
def t13_merge_json(v: Views) -> DataFrame:
    """An enrichment object put into the raw data of every signal, some of which hold no object; the whole text is compared."""
    extra = F.concat(F.lit('{"score":'), F.col("id") % 7, F.lit(',"hot":'), (F.col("id") % 2 == 0).cast("string"), F.lit(',"tags":["'), "signal_type", F.lit('",null],"at":{"source":"'), "source", F.lit('"}}'))
    held = F.when(F.col("id") % 15 == 0, "[1]").when(F.col("id") % 15 == 5, "{cut").when(F.col("id") % 15 != 10, F.col("raw_data"))
    named = F.from_json(extra, "struct<score:long,hot:boolean,tags:array<string>,at:struct<source:string>>")
    merged = state.merge_json(held, extra, "enrichment")
    whole = F.from_json(merged, "struct<k:long,enrichment:struct<score:long,hot:boolean,tags:array<string>,at:struct<source:string>>>")
    first = lambda w: F.when(w["k"].isNotNull(), F.concat(F.lit('{"k":'), w["k"], F.lit(","))).otherwise("{")
    same = state.bound(whole, lambda w: F.when(w["enrichment"].eqNullSafe(named), F.concat(first(w), F.lit('"enrichment":'), extra, F.lit("}"))))
    return v.signals.select("id", same.alias("raw"))


_N = " UNION ALL ".join(f"SELECT '{name}' AS label, count(*) FILTER ({contains_sql('text', ws)}) AS n, count(*) FILTER ({contains_sql('text', ws)} AND part % 2 = 0) AS e FROM themes" for name, ws in THEMES[:4])


@query(f"""SELECT label, CASE WHEN label < 'metal' THEN e ELSE n END AS n, label < 'metal' AS arrived, 25.0::DOUBLE AS progress_pct FROM ({_N})""")
def t14_progressive_themes(v: Views) -> DataFrame:
    count = lambda df: dictionary_matches(df, F.col("text"), THEMES, ["part"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    better = count(v.themes.where("part % 2 = 0")).where("label < 'metal'")
    return state.progressive(count(v.themes), better, "label", "n")


@query(f"SELECT profile::VARCHAR AS key, ord, delta FROM ({_DELTAS})")
def t01_t15_profile_stream(v: Views) -> DataFrame:
    """The same deltas by a stream: state per profile, what has arrived, then stop."""
    spark, base = v.spark, f"{shared_dir(v.spark)}/stream-{uuid.uuid4().hex}"
    numbered = v.observations.withColumn("ord", F.row_number().over(Window.partitionBy("profile").orderBy("ord", "headline")) - 1)
    numbered.select("profile", "ord", "headline").write.parquet(f"{base}/in")
    with state.rocksdb(spark):
        seen = spark.readStream.schema("profile long, ord int, headline string").parquet(f"{base}/in")
        state.run_available(state.watch_profiles(seen, "profile", "ord", "headline"), f"{base}/out", f"{base}/marks")
    return spark.read.schema("key string, ord long, delta string").parquet(f"{base}/out")


_KEY90 = "substr(trim(regexp_replace(lower(headline), '\\s+', ' ', 'g')), 1, 90)"


@query(f"""WITH d AS ({_DELTAS}), o AS (SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY ord, headline) - 1 AS ord, headline, role FROM observations),
  j AS (SELECT o.*, d.delta FROM o JOIN d ON d.profile = o.profile AND d.ord = o.ord)
  SELECT a.profile::VARCHAR AS key, a.ord, a.delta, coalesce(arg_min(b.role, b.ord) FILTER (trim(b.role) <> ''), '') AS name,
    array_to_string(list(substr(b.headline, 1, 150) ORDER BY b.ord DESC) FILTER (b.delta <> 'seen')[1:6], ' / ') AS headlines FROM j a JOIN j b ON b.profile = a.profile AND b.ord <= a.ord GROUP BY ALL""")
def t02_daily_profile_stream(v: Views) -> DataFrame:
    """Four daily runs on one checkpoint: three with new files, the last with none. Deltas, the name that is filled once, and six headlines as of each observation, latest first."""
    spark, base = v.spark, f"{shared_dir(v.spark)}/stream-{uuid.uuid4().hex}"
    numbered = v.observations.withColumn("ord", F.row_number().over(Window.partitionBy("profile").orderBy("ord", "headline")) - 1)
    numbered = materialise(numbered.select("profile", "ord", "headline", "role"))
    with state.rocksdb(spark):
        for day in ("ord < 2", "ord between 2 and 4", "ord > 4", None):
            if day:
                numbered.where(day).write.mode("append").parquet(f"{base}/in")
            seen = spark.readStream.schema("profile long, ord int, headline string, role string").parquet(f"{base}/in")
            state.run_available(state.watch_profiles(seen, "profile", "ord", "headline", name="role"), f"{base}/out", f"{base}/marks")
    out = spark.read.schema("key string, ord long, delta string, name string, headlines array<string>").parquet(f"{base}/out")
    return out.withColumn("headlines", F.array_join(F.reverse("headlines"), " / "))


@query(f"SELECT label, n FROM ({_N}) WHERE n > 0")
def t14_running_counts_stream(v: Views) -> DataFrame:
    """Theme counts by a stream over arriving files, renewed as each file comes."""
    spark, base = v.spark, f"{shared_dir(v.spark)}/stream-{uuid.uuid4().hex}"
    v.themes.select("part", "text").write.parquet(f"{base}/in")
    counts = state.running_counts(spark.readStream.schema("part long, text string").parquet(f"{base}/in"), T.all_labels(F.col("text"), THEMES))
    renew = lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")
    counts.writeStream.outputMode("complete").foreachBatch(renew).option("checkpointLocation", f"{base}/marks").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("label string, n long").parquet(f"{base}/out")


_SIGHTING = "CASE WHEN id % 4 = 0 THEN source || '|' || signal_type || '|' || person_linkedin ELSE url END"


@query(f"SELECT DISTINCT {_SIGHTING} AS key, 0 AS run FROM signals UNION ALL SELECT DISTINCT {_SIGHTING}, 2 FROM signals")
def t07_first_sightings(v: Views) -> DataFrame:
    """Each signal once within 90 days, by a stream that drops repeats within its watermark; without a URL by source, type and profile.

    Three runs on one checkpoint: all signals; those of even id 400 days on, which are repeats of keys still held and move the watermark past these; all
    of them 800 days on, which are first sightings again, with further ones older than the watermark, which come too late.
    """
    spark, base = v.spark, f"{shared_dir(v.spark)}/stream-{uuid.uuid4().hex}"
    url = F.when(F.col("id") % 4 != 0, F.col("url"))
    key = state.sighting_key(url, F.col("source"), F.col("signal_type"), F.col("person_linkedin"))
    s = v.signals.select("id", key.alias("key"), F.col("detected_at").cast("timestamp").alias("ts"))
    later = lambda df, days: df.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(days)))
    late = s.withColumn("key", F.concat(F.lit("late "), "key"))
    for run, rows in enumerate((s, later(s.where("id % 2 = 0"), 400), later(s, 800).unionByName(late))):
        rows.select("key", "ts", F.lit(run).alias("run")).write.mode("append").parquet(f"{base}/in")
        seen = state.first_sightings(spark.readStream.schema("key string, ts timestamp, run int").parquet(f"{base}/in"), "key", "ts")
        state.run_available(seen, f"{base}/out", f"{base}/marks")
    return spark.read.schema("key string, ts timestamp, run int").parquet(f"{base}/out").select("key", "run")


@query("SELECT url AS key, min(detected_at)::DATE AS first_seen, max(detected_at)::DATE AS last_seen, count(*) AS times FROM signals GROUP BY url")
def t04_kept_ledger(v: Views) -> DataFrame:
    """The ledger of evidence over four runs of a week each, kept in buckets on disk; a run that fails between two of them changes nothing."""
    found = v.signals.select(F.col("url").alias("key"), F.col("detected_at").cast("date").alias("day"))
    empty = found.select("key", F.col("day").alias("first_seen"), F.col("day").alias("last_seen"), F.lit(1).cast("long").alias("times"))
    ledger = Kept(v.spark, f"{shared_dir(v.spark)}/kept-{uuid.uuid4().hex}", "key", empty.schema)

    def merged(old: DataFrame, news: DataFrame) -> DataFrame:
        both = old.unionByName(news)
        return both.groupBy("key").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times").alias("times"))

    week = F.least(F.lit(3), F.floor((F.dayofmonth("first_seen") - 1) / 7))
    for run in range(4):
        ledger.merge(empty.where(week == run), merged)
        if run == 1:
            try:
                ledger.merge(empty, lambda old, _: old.select("key", F.raise_error(F.lit("lost")).cast("date").alias("first_seen"), "last_seen", "times"))
            except PySparkException as error:
                if "lost" not in str(error):
                    raise
    return ledger.read()
