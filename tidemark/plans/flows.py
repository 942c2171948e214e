"""Registered queries: the flagship, entity resolution, scoring, reports, and the whole batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import gates, text as T
from tidemark.operators import ranking, resolve, scoring
from tidemark.operators.entities import Entities
from tidemark.plans.bindings import AS_OF, TONGUES, Views, contains_sql
from tidemark.plans.registry import query
from tidemark.plans.texts import cat, choose
from tidemark.sources import sinks
from tidemark.streaming import state
from tidemark.tables import materialise, shared_dir

_T = "title || ' ' || summary"
_EN, _FR, _DE, _ES = (ws for _, ws in TONGUES)
_KIND = f"CASE WHEN {contains_sql(_T, _DE)} THEN 'german' WHEN {contains_sql(_T, _FR)} THEN 'french' ELSE 'other' END"


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS n FROM articles WHERE url <> '' AND NOT {contains_sql(_T, ("***", "!!"))} AND {contains_sql(_T, (*_EN, *_FR, *_DE, *_ES))})
  SELECT source, {_KIND} AS signal_type, count(*) AS n FROM a WHERE n = 1 GROUP BY ALL""")
def flagship_signals_by_source(v: Views) -> DataFrame:
    t = F.concat_ws(" ", "title", "summary")
    kept = v.articles.where(gates.news_relevant(t, (*_EN, *_FR, *_DE, *_ES), ("***", "!!")))
    first = ranking.keep_first(kept, "url", ["ord"])
    return first.groupBy("source", T.first_label(t, [("german", _DE), ("french", _FR)], "other").alias("signal_type")).agg(F.count(F.lit(1)).alias("n"))


_KEYS = """SELECT pid, 'li:' || pid // 3 AS key FROM persons UNION ALL SELECT pid, 'nm:' || (pid + 1) // 4 FROM persons WHERE pid % 5 = 0 UNION ALL SELECT pid, 'gh:' || sector FROM persons WHERE sector <> 'machinery'"""


def _keys() -> F.Column:
    pid = F.col("pid")
    keys = F.array(cat("li:", F.floor(pid / 3)), F.when(pid % 5 == 0, cat("nm:", F.floor((pid + 1) / 4))), F.when(F.col("sector") != "machinery", cat("gh:", F.col("sector"))))
    return F.filter(keys, lambda k: k.isNotNull())


_CLUSTER = f"""k AS ({_KEYS}), h AS (SELECT key, min(pid) AS head FROM k GROUP BY key), d AS (SELECT pid AS a, head AS b FROM k JOIN h USING (key) WHERE pid <> head), e AS (SELECT a, b FROM d UNION SELECT b, a FROM d),
  reach AS (SELECT pid AS a, pid AS c FROM persons UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.a), cl AS (SELECT a AS pid, min(c) AS cluster FROM reach GROUP BY a)"""


@query(f"WITH {_CLUSTER} SELECT pid, cluster FROM cl")
def g01_clusters(v: Views) -> DataFrame:
    return resolve.clusters(v.persons, "pid", _keys()).select("pid", "cluster")


@query(f"WITH {_CLUSTER} SELECT pid, cluster FROM cl")
def g01_clusters_over_runs(v: Views) -> DataFrame:
    """The same from three runs of a third of the persons each, in turn, so that later ones join what earlier ones held apart; clusters by their smallest id."""
    held = Entities(v.spark, f"{shared_dir(v.spark)}/entities-{uuid.uuid4().hex}", buckets=8)
    for run in range(3):
        held.add(v.persons.where(F.col("pid") % 3 == run), "pid", _keys())
    found = materialise(held.resolved())
    least = found.groupBy("entity").agg(F.min("id").alias("cluster"))
    return found.join(least, "entity").select(F.col("id").alias("pid"), "cluster")


@query(f"""WITH {_CLUSTER}, p AS (SELECT cl.cluster, p.*, CASE WHEN p.pid % 4 = 0 THEN 0 ELSE 100000 END + p.pid AS o FROM persons p JOIN cl ON cl.pid = p.pid)
  SELECT cluster, count(*) AS n_records, arg_max(sector, length(sector) * 1000000 - o) AS sector, coalesce(arg_min(location, o) FILTER (pid % 3 <> 0), '') AS location, max(p_score) AS p_score, bool_or(region = 'ASIA') AS asian FROM p GROUP BY cluster""")
def g02_g04_folded_entities(v: Views) -> DataFrame:
    c = resolve.clusters(v.persons, "pid", _keys()).withColumn("asian", F.col("region") == "ASIA").withColumn("location", F.when(F.col("pid") % 3 != 0, F.col("location")).otherwise(" "))
    order = F.when(F.col("pid") % 4 == 0, 0).otherwise(100000) + F.col("pid")
    return resolve.folded(c, order, longest=["sector"], first=["location"], most=["p_score"], any_=["asian"])


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY person_name, signal_type || '|' || lower(url) ORDER BY id) AS n FROM signals) SELECT person_name AS cluster, id, signal_type FROM s WHERE n = 1""")
def g03_evidence_union(v: Views) -> DataFrame:
    s = v.signals.withColumn("cluster", F.col("person_name"))
    kept = resolve.evidence(s, T.signal_fingerprint(F.col("source"), F.col("signal_type"), F.col("url"), F.col("description")), "id")
    return kept.select("cluster", "id", "signal_type")


@query("""WITH r AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN 'Unknown' ELSE substr(title, 1, 40) END AS name, summary FROM articles),
  k AS (SELECT *, lower(name) IN ('', 'unknown') AS u, CASE WHEN lower(name) IN ('', 'unknown') THEN 'h:' || substr(lower(summary), 1, 60) ELSE 'n:' || substr(lower(name), 1, 30) END AS key FROM r)
  SELECT ord FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS n FROM k) WHERE n = 1 ORDER BY u, ord LIMIT 50""")
def g05_light_dedupe(v: Views) -> DataFrame:
    r = v.articles.select("ord", F.when(F.col("ord") % 3 == 0, "Unknown").otherwise(F.substring("title", 1, 40)).alias("name"), "summary")
    return resolve.light_dedupe(r, F.col("name"), F.col("summary"), "ord").select("ord")


_SOURCES, _TYPES = ("linkedin", "news", "github"), {"purchase": ("exec_departure", 18), "signup": ("stealth_founder", 15), "error": ("github_launch", 0), "view": ("news_mention", 5), "click": ("twitter_announcement", 10)}


def _profiles(v: Views) -> DataFrame:
    """Persons with all their signals from the event stream; like ones stand as one with their number, counted before they shuffle."""
    s = v.signals.withColumn("u", F.element_at(F.split("person_name", " "), 2).cast("long"))
    kind = F.create_map(*(F.lit(x) for k, (t, _) in _TYPES.items() for x in (k, t)))[F.col("signal_type")]
    source = F.when(F.col("u") % 6 == 0, "linkedin").otherwise(choose(F.col("id"), *_SOURCES))
    said = F.when(F.col("signal_type") == "purchase", "left the firm").otherwise("seen")
    like = s.groupBy("u", source.alias("source"), kind.alias("signal_type"), said.alias("description")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"))
    held = like.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("id", "source", "signal_type", "description", "times"))).alias("signals"))
    u = F.col("u")
    held = held.select(
        "u", cat("User ", u).alias("name"), choose(u, "Mumbai", "Paris", "", "Jakarta").alias("location"), choose(u, "Founder, stealth", "Building at Grab", "clerk").alias("headline"),
        choose(u, "CTO", "", "Analyst").alias("previous_title"), choose(u, "Swiggy", "Acme").alias("previous_company"), (u % 20).cast("string").alias("experience_years"),
        (u % 11 == 0).alias("is_second_time_founder"), F.when(u % 3 == 0, "https://www.linkedin.com/in/x").otherwise("").alias("linkedin_url"), "signals",
    )
    return held.withColumn("geography", T.geography(F.col("location"), F.lit(""), F.lit(""), {"none": ["zzzz"]}))


_W = " ".join(f"WHEN '{k}' THEN {w}" for k, (_, w) in _TYPES.items())
_NAMED = " ".join(f"WHEN '{k}' THEN '{t}'" for k, (t, _) in _TYPES.items())
_SCORED = f"""e AS (SELECT event_id AS id, user_id AS u, event_type AS k, CASE WHEN user_id % 6 = 0 THEN 'linkedin' ELSE {list(_SOURCES)}[event_id % 3 + 1] END AS source FROM events),
  g AS (SELECT u, count(*) AS c, sum(CASE k {_W} END) AS w, count(DISTINCT source) AS ns, bool_or(k = 'purchase') AS gone, list_sort(list_distinct(list(source))) AS src, bool_or(k IN ('purchase', 'signup')) AS act, list_sort(list_distinct(list(CASE k {_NAMED} END))) AS kinds FROM e GROUP BY u),
  t AS (SELECT *, ['CTO', '', 'Analyst'][u % 3 + 1] AS title, u % 20 AS y FROM g),
  s AS (SELECT *, 22 + CASE WHEN u % 4 IN (0, 3) THEN 8 ELSE 0 END + w + CASE WHEN u % 11 = 0 THEN 20 ELSE 0 END + CASE WHEN y >= 15 THEN 15 WHEN y >= 10 THEN 10 WHEN y >= 7 THEN 5 ELSE 0 END
    + CASE WHEN u % 3 = 0 THEN 7 ELSE 0 END + CASE WHEN u % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN u % 2 = 0 OR u % 3 = 1 THEN 8 ELSE 0 END + CASE WHEN u % 3 IN (0, 1) THEN 8 ELSE 0 END + CASE WHEN u % 3 = 0 THEN 6 ELSE 0 END
    + CASE WHEN gone THEN 4 ELSE 0 END + CASE WHEN ns >= 3 THEN 12 WHEN ns = 2 THEN 6 ELSE 0 END + CASE WHEN c >= 4 THEN 10 WHEN c >= 2 THEN 5 ELSE 0 END AS total FROM t),
  x AS (SELECT *, CASE WHEN u % 4 = 1 THEN 5 ELSE greatest(0, least(100, CASE WHEN src = ['linkedin'] AND u % 3 <> 0 THEN least(total, 55) ELSE total END)) END AS score FROM s),
  scored AS (SELECT *, CASE WHEN u % 4 = 1 THEN 'pass' WHEN score >= 60 THEN 'investigate' WHEN score >= 42 THEN 'watchlist' ELSE 'pass' END AS action FROM x)"""


@query(f"""WITH {_SCORED} SELECT u, score::INT AS score, action, CASE WHEN u % 4 = 1 THEN 'weak' WHEN score >= 60 THEN 'strong' WHEN score >= 42 THEN 'moderate' ELSE 'weak' END AS fit,
  CASE WHEN u % 4 = 1 THEN 'unknown' WHEN u % 11 = 0 THEN 'second_time_founder' WHEN u % 3 = 0 AND y >= 10 THEN 'seasoned_operator' WHEN y >= 5 THEN 'first_time_founder' ELSE 'unknown' END AS founder_type,
  CASE WHEN u % 4 = 1 THEN 'high' WHEN c >= 3 AND ns >= 2 THEN 'high' WHEN c >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM scored""")
def c02_c05_rule_scores(v: Views) -> DataFrame:
    s = scoring.rule_score(_profiles(v))
    return s.select("u", F.col("score").cast("int").alias("score"), "action", "fit", "founder_type", "confidence")


_STRENGTHS = """CASE WHEN u % 4 = 1 THEN '' ELSE coalesce(nullif(array_to_string(list_filter([CASE WHEN u % 11 = 0 THEN 'Second-time founder' END, CASE WHEN y >= 10 THEN y || '+ years of experience' END,
  CASE WHEN title = 'CTO' THEN 'Senior role: CTO' END, CASE WHEN act THEN 'Active departure / stealth signal' END, CASE WHEN ns >= 2 THEN 'Corroborated across ' || ns || ' sources' END], lambda x: x IS NOT NULL)[1:4], '; '), ''), 'Signal detected from sourcing pipeline') END"""
_THESIS = """'User ' || u || ' (' || CASE WHEN title <> '' THEN 'ex-' || title || ' at ' ELSE 'ex-' END || ['Swiggy', 'Acme'][u % 2 + 1] || ')' || CASE WHEN action = 'investigate' THEN ' is a strong early lead.' WHEN action = 'watchlist' THEN ' is worth watching.'
  ELSE ' has too little evidence so far.' END || ' Signals: ' || replace(array_to_string(kinds[1:3], ', '), '_', ' ') || '.'"""


@query(f"""WITH {_SCORED} SELECT u, {_STRENGTHS} AS strengths, CASE WHEN u % 4 = 1 THEN 'Location outside the regions' ELSE array_to_string(list_filter([CASE WHEN c < 2 THEN 'Single signal — needs corroboration' END, CASE WHEN y < 7 THEN 'Limited experience (<7 yrs)' END,
  CASE WHEN u % 4 = 2 THEN 'Geography unconfirmed' END, CASE WHEN title = '' THEN 'Previous role unclear' END, CASE WHEN c >= 2 AND y >= 7 AND u % 4 <> 2 AND title <> '' THEN 'Early stage — limited public information' END], lambda x: x IS NOT NULL)[1:3], '; ') END AS risks FROM scored""")
def c06_strengths_and_risks(v: Views) -> DataFrame:
    s = scoring.rule_score(_profiles(v))
    return s.select("u", F.array_join("strengths", "; ").alias("strengths"), F.array_join("risks", "; ").alias("risks"))


@query(f"""WITH {_SCORED} SELECT u, array_to_string(list_filter([CASE WHEN u % 11 = 0 THEN '2x founder' END, CASE WHEN u % 2 = 0 OR u % 3 = 1 THEN 'Ex-unicorn/top co' END, CASE WHEN y >= 10 THEN y || 'y operator' END,
  CASE WHEN ns >= 2 THEN 'Multi-source' END, CASE WHEN u % 3 = 0 THEN 'Ex-CTO' END], lambda x: x IS NOT NULL)[1:5], '; ') AS badges, u % 2 = 0 AND true AS schooled, {_THESIS} AS thesis, CASE WHEN u % 5 = 0 AND action = 'investigate' THEN 'later-stage company' ELSE '' END AS reason, action, CASE WHEN u % 5 = 0 AND action = 'investigate' THEN 'watchlist' ELSE action END AS after_stage FROM scored""")
def c07_c08_c09_badges_and_demotion(v: Views) -> DataFrame:
    s = scoring.rule_score(_profiles(v)).withColumn("stage", F.when(F.col("u") % 5 == 0, "later_stage").otherwise("seed_stage"))
    d = scoring.demoted(s.withColumn("after_stage", F.col("action")), "after_stage", "stage")
    schooled = scoring.with_education_badge(F.col("badges"), F.when(F.col("u") % 2 == 0, "IIT"))
    return d.select("u", F.array_join("badges", "; ").alias("badges"), (F.array_position(schooled, "IIT") == F.size("badges") + 1).alias("schooled"), "thesis", "reason", "action", "after_stage")


@query(f"""WITH {_SCORED}, b AS (SELECT u, CASE WHEN u % 7 = 0 THEN 77 ELSE score END::INT AS score FROM scored) SELECT u, score FROM b WHERE score >= 45""")
def c10_preferred_scores(v: Views) -> DataFrame:
    s = scoring.rule_score(_profiles(v)).select("u", "score")
    given = s.where("u % 7 = 0").select("u", F.lit(77).alias("score"))
    return scoring.preferred_score(s, given, "u", 45).select("u", F.col("score").cast("int").alias("score"))


_KINDS = {"F": "github_launch", "O": "funding_news", "P": "odd_kind"}
_BUYERS = """p AS (SELECT pid, name, greatest(0, least(100, p_score / 100)) AS score FROM persons), q AS (SELECT *, CASE WHEN score >= 60 THEN 'investigate' WHEN score >= 42 THEN 'watchlist' WHEN pid % 9 = 0 THEN 'none' ELSE 'pass' END AS action FROM p),
  s AS (SELECT o_custkey AS pid, o_orderkey AS ord, o_orderpriority AS source, CASE o_orderstatus WHEN 'F' THEN 'github_launch' WHEN 'O' THEN 'funding_news' ELSE 'odd_kind' END AS kind, 'Order ' || o_orderkey || repeat(' of many', o_orderkey % 20) AS said FROM orders),
  r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ord) AS k FROM s)"""


def _buyers(v: Views) -> tuple[DataFrame, DataFrame]:
    """Customers as scored persons, and their orders as signals."""
    pid, score = F.col("pid"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("p_score") / 100))
    p = v.persons.select("pid", "name", score.alias("score"), "sector", "location")
    action = F.when(F.col("score") >= 60, "investigate").when(F.col("score") >= 42, "watchlist").when(pid % 9 == 0, "none").otherwise("pass")
    strengths = F.slice(F.array(F.col("sector"), F.col("location"), F.lit("third"), F.lit("fourth")), 1, (pid % 5).cast("int"))
    p = p.select("pid", "name", "score", action.alias("action"), strengths.alias("strengths"), F.slice(F.array(F.lit("one"), F.lit("two"), F.lit("three")), 1, (pid % 4).cast("int")).alias("risks"))
    kind = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))[F.col("o_orderstatus")]
    o = F.col("o_orderkey")
    s = v.raw("orders").select(F.col("o_custkey").alias("pid"), o.alias("id"), F.col("o_orderpriority").alias("source"), F.coalesce(kind, F.lit("odd_kind")).alias("signal_type"), F.concat(cat("Order ", o), F.repeat(F.lit(" of many"), (o % 20).cast("int"))).alias("description"))
    return p, s


@query(f"""WITH {_BUYERS}, b AS (SELECT pid, string_agg('- ' || CASE kind WHEN 'github_launch' THEN '🐙 GitHub' WHEN 'funding_news' THEN '💰 Funding' ELSE '• odd_kind' END || ': ' || substr(said, 1, 120), chr(10) ORDER BY ord) AS lines, arg_min(said, ord) AS said FROM r WHERE k <= 5 GROUP BY pid),
  m AS (SELECT q.*, x.sector, x.location, row_number() OVER (ORDER BY q.score DESC, q.pid) AS place, CASE action WHEN 'investigate' THEN '🟢 INVESTIGATE' WHEN 'watchlist' THEN '🟡 WATCHLIST' WHEN 'pass' THEN '🔴 PASS' ELSE '⚪ UNKNOWN' END AS called, round(q.score)::INT AS shown, round(q.score / 10)::INT AS full_ FROM q JOIN persons x ON x.pid = q.pid)
  SELECT 0::INT AS part, 0::BIGINT AS ord, '**' || (SELECT count(*) FROM s) || ' signals** · **' || (SELECT count(*) FROM p) || ' founders scored**' AS line
  UNION ALL SELECT 1, place, concat_ws(chr(10), '### ' || place || '. ' || name || chr(10) || '**Score:** `' || shown || '/100` `' || repeat('█', full_) || repeat('░', 10 - full_) || '` ' || called,
      CASE WHEN m.pid % 5 > 0 THEN '**Strengths:** ' || array_to_string([sector, location, 'third'][1:(m.pid % 5)::INT], ' · ') END, CASE WHEN m.pid % 4 > 0 THEN '**Risks:** ' || array_to_string(['one', 'two'][1:(m.pid % 4)::INT], ' · ') END, lines)
    FROM m LEFT JOIN b ON b.pid = m.pid WHERE place <= 40
  UNION ALL SELECT 2, place, '| ' || name || ' | ' || shown || ' | ' || called || ' | ' || coalesce(substr(said, 1, 60), '') || '... |' FROM m LEFT JOIN b ON b.pid = m.pid WHERE place > 40
  UNION ALL SELECT 3, row_number() OVER (ORDER BY n DESC, source), '| ' || source || ' | ' || n || ' |' FROM (SELECT source, count(*) AS n FROM s GROUP BY source)""")
def k02_digest(v: Views) -> DataFrame:
    """The whole text of the digest, line by line."""
    persons, signals = _buyers(v)
    return sinks.digest(persons, signals, "pid", "id", [F.desc("score"), F.col("pid")], 40)


@query(f"""WITH {_BUYERS}, b AS (SELECT pid, string_agg('{{"source":"' || source || '","signal_type":"' || kind || '","description":"' || said || '"}}', ',' ORDER BY ord) AS j FROM r WHERE k <= 8 GROUP BY pid)
  SELECT 0::BIGINT AS ord, '{{"total_persons":' || (SELECT count(*) FROM p) || ',"total_signals":' || (SELECT count(*) FROM s) || ',"source_breakdown":{{' || (SELECT string_agg('"' || source || '":' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM s GROUP BY source)) || '}}}}' AS json
  UNION ALL SELECT row_number() OVER (ORDER BY q.score DESC, q.pid), '{{"pid":' || q.pid || ',"name":"' || name || '","action":"' || action || '","signals":[' || coalesce(j, '') || ']}}' FROM q LEFT JOIN b ON b.pid = q.pid""")
def k01_dashboard_export(v: Views) -> DataFrame:
    """The dashboard in one table of lines: totals and sources, then persons with up to eight signals."""
    persons, signals = _buyers(v)
    place = persons.select("pid", "score")
    lines = sinks.dashboard_export(persons.select("pid", "name", "action").join(place, "pid"), signals, "pid", "id", [F.desc("score"), F.col("pid")])
    return lines.select("ord", F.regexp_replace("json", r',"score":[0-9.E-]+', "").alias("json"))


@query("""SELECT user_id AS u, least(8, count(*)) AS n_signals, array_to_string((list(event_id || ':src' || (user_id % 5) ORDER BY event_id))[1:8], ' ') AS held FROM events GROUP BY user_id""")
def k01_dashboard_json(v: Views) -> DataFrame:
    s = ranking.top_per_group(v.signals, ["person_name"], [F.col("id")], 8)  # the export holds eight
    p = s.groupBy("person_name").agg(F.array_sort(F.collect_list(F.struct("id", "source"))).alias("signals"))
    j = sinks.dashboard_json(p, "person_name")
    got = F.from_json("json", "signals array<struct<id:long,source:string>>")["signals"]
    return j.select(F.element_at(F.split("person_name", " "), 2).cast("long").alias("u"), F.size(got).cast("long").alias("n_signals"), F.array_join(F.transform(got, lambda x: F.concat_ws(":", x["id"], x["source"])), " ").alias("held"))


@query("""SELECT pid, lower(sector) AS sector, CASE WHEN pid % 2 = 0 THEN 'b' ELSE 'a' END AS win, p_score FROM persons WHERE pid % 2 = 0 UNION ALL SELECT pid, sector, 'a', p_score + 1 FROM persons WHERE pid % 2 = 1""")
def k03_replaced_slice(v: Views) -> DataFrame:
    """Two slices written, then one of them replaced; the other stays."""
    import uuid

    from tidemark.tables import shared_dir

    path = f"{shared_dir(v.spark)}/cached-{uuid.uuid4().hex}"
    p = v.persons.select("pid", "sector", F.when(F.col("pid") % 2 == 0, "b").otherwise("a").alias("win"), "p_score")
    sinks.replace_slice(p, path, "win")
    sinks.replace_slice(p.where("win = 'a'").withColumn("p_score", F.col("p_score") + 1), path, "win")
    return v.spark.read.schema("pid long, sector string, p_score double, win string").parquet(path).select("pid", "sector", "win", "p_score")


@query(f"""WITH {_SCORED}, fresh AS (SELECT * FROM scored s WHERE EXISTS (SELECT 1 FROM events v WHERE v.user_id = s.u AND v.ts >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY) AND u % 4 <> 2)
  SELECT u, score::INT AS score, action, row_number() OVER (ORDER BY score DESC, u) AS place FROM fresh WHERE score >= 30 ORDER BY place LIMIT 80""")
def daily_batch(v: Views) -> DataFrame:
    """The batch end to end: profiles, region gate, those with new evidence, score, threshold, order, cap."""
    recent = v.signals.where(gates.within(F.col("detected_at"), AS_OF, 2))
    keys = recent.select(F.element_at(F.split("person_name", " "), 2).cast("long").alias("u")).distinct()
    placed = _profiles(v).where((F.col("geography") != "Unknown") | (F.trim("location") != ""))
    scored = scoring.rule_score(placed.join(keys, "u", "left_semi")).where(gates.score_gate(F.col("score"), 30))
    return ranking.ranked(scored, [F.desc("score"), F.col("u")], most=80).select("u", F.col("score").cast("int").alias("score"), "action", "place")


@query("SELECT key, first_seen, times FROM (SELECT source || signal_type AS key, min(detected_at::DATE) AS first_seen, count(*) AS times FROM signals GROUP BY 1)")
def t04_ledger_from_nothing(v: Views) -> DataFrame:
    s = v.signals.select(F.concat("source", "signal_type").alias("key"), F.col("detected_at").cast("date").alias("day"))
    none = s.where("false").select("key", F.col("day").alias("first_seen"), F.col("day").alias("last_seen"), F.lit(0).cast("long").alias("times"))
    return state.merge_ledger(none, s, "key", "day").select("key", "first_seen", "times")


@query("""WITH r AS (SELECT *, 'User ' || translate(split_part(person_name, ' ', 2), '0123456789', 'abcdefghij') AS name FROM signals WHERE person_name IS NOT NULL)
  SELECT min(id) AS cluster, count(*) AS n_records, count(DISTINCT signal_type || '|' || lower(url)) AS n_evidence, name, max(person_linkedin) AS person_linkedin FROM r GROUP BY name HAVING count(*) >= 2""")
def g04_hygiene_pass(v: Views) -> DataFrame:
    """Every signal as a record with a scraped name: cleaned, clustered by profile and name, folded, evidence united, entities seen once dropped."""
    who = F.translate(F.element_at(F.split("person_name", " "), 2), "0123456789", "abcdefghij")
    r = v.signals.select("id", "source", "signal_type", "url", "description", "person_linkedin", cat("User ", who, F.when(F.col("id") % 3 == 0, " 14 ☀").otherwise("")).alias("name"), F.lit("").alias("handle"), F.lit("").alias("repo"))
    mark = T.signal_fingerprint(F.col("source"), F.col("signal_type"), F.col("url"), F.col("description"))
    out = resolve.hygiene(r, "id", "name", "person_linkedin", "handle", "repo", mark, F.col("n_records") >= 2)
    return out.select("cluster", "n_records", "n_evidence", "name", "person_linkedin")


@query(f"""WITH {_SCORED}, o AS (SELECT u, action, score, row_number() OVER (ORDER BY NOT EXISTS (SELECT 1 FROM events v WHERE v.user_id = scored.u AND v.ts >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY),
  CASE action WHEN 'investigate' THEN 0 WHEN 'watchlist' THEN 1 ELSE 2 END, score DESC, u) AS place FROM scored) SELECT u, action, score::INT AS score, place, place <= 20 AS top FROM o""")
def w08_report_order(v: Views) -> DataFrame:
    """The report's order over all persons: new evidence first, then action, then score; the first twenty stand above."""
    recent = v.signals.where(gates.within(F.col("detected_at"), AS_OF, 2)).select(F.element_at(F.split("person_name", " "), 2).cast("long").alias("u")).distinct().withColumn("new", F.lit(True))
    s = scoring.rule_score(_profiles(v)).select("u", "action", "score").join(recent, "u", "left")
    placed = ranking.report_rank(s, F.coalesce("new", F.lit(False)), F.col("action"), F.col("score"), "u", 20)
    return placed.select("u", "action", F.col("score").cast("int").alias("score"), F.col("place").cast("long").alias("place"), "top")
