"""Registered queries: joins, roll-ups, rankings and filters over signals, outreach and persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import gates, text as T
from tidemark.functions.words import STAGES
from tidemark.operators import joins, ranking, rollups
from tidemark.plans.bindings import AS_OF, THEMES, TONGUES, Views, contains_sql
from tidemark.plans.registry import query
from tidemark.sources import sinks

_WHEN = " ".join(f"WHEN {contains_sql('text', ws)} THEN '{name}'" for name, ws in THEMES)
_MATCHES = " UNION ALL ".join(f"SELECT part, brand, price, '{name}' AS label, {i} AS pri FROM themes WHERE {contains_sql('text', ws)}" for i, (name, ws) in enumerate(THEMES))


def _signals_outreach(v: Views) -> DataFrame:
    s, o = v.signals, v.outreach
    keys = [(F.when(F.col("id") > 0, F.col("id")), F.when(F.col("signal_id") > 0, F.col("signal_id"))), (T.blank_to_null(F.col("person_linkedin")), T.blank_to_null(F.col("o_linkedin")))]
    return joins.either_key_join(s, o, keys, "id", "oid")


@query("""SELECT s.id, s.source, o.oid, o.stage, o.oid IS NOT NULL AS in_pipeline FROM signals s
  LEFT JOIN outreach o ON (s.id > 0 AND o.signal_id = s.id) OR (s.person_linkedin <> '' AND s.person_linkedin = o.o_linkedin)""")
def j01_signals_in_pipeline(v: Views) -> DataFrame:
    return _signals_outreach(v).select("id", "source", "oid", "stage", F.col("oid").isNotNull().alias("in_pipeline"))


@query("SELECT o.oid, o.stage, s.signal_type, s.source, s.score FROM outreach o LEFT JOIN signals s ON o.signal_id > 0 AND s.id = o.signal_id")
def j02_outreach_signals(v: Views) -> DataFrame:
    o, s = v.outreach.select("oid", "stage", "signal_id"), v.signals.select("id", "signal_type", "source", "score")
    return joins.left_by_key(o, s, F.when(F.col("signal_id") > 0, F.col("signal_id")), "id").select("oid", "stage", "signal_type", "source", "score")


@query("""WITH p AS (SELECT pid, 'User ' || pid AS pname, CASE WHEN pid % 4 = 0 THEN 'https://www.linkedin.com/in/u' || pid ELSE '' END AS link FROM persons)
  SELECT p.pid, o.oid, o.stage FROM p LEFT JOIN outreach o ON (p.link <> '' AND p.link = o.o_linkedin) OR p.pname = o.o_name""")
def j03_persons_outreach(v: Views) -> DataFrame:
    who = F.col("pid").cast("string")
    p = v.persons.select("pid", F.concat(F.lit("User "), who).alias("pname"), F.when(F.col("pid") % 4 == 0, F.concat(F.lit("https://www.linkedin.com/in/u"), who)).otherwise("").alias("link"))
    keys = [(T.blank_to_null(F.col("link")), T.blank_to_null(F.col("o_linkedin"))), (F.col("pname"), F.col("o_name"))]
    return joins.either_key_join(p, v.outreach, keys, "pid", "oid").select("pid", "oid", "stage")


@query("""WITH first_part AS (SELECT lower(brand) AS k, arg_min(text, part) AS site FROM themes GROUP BY 1)
  SELECT s_suppkey, coalesce(site, '') AS site FROM (SELECT s_suppkey, 'BRAND#' || (s_suppkey % 40) AS b FROM supplier) LEFT JOIN first_part ON lower(b) = k""")
def j04_website_lookup(v: Views) -> DataFrame:
    s = v.raw("supplier").select("s_suppkey", F.concat(F.lit("BRAND#"), (F.col("s_suppkey") % 40).cast("string")).alias("b"))
    return joins.lookup_first(s, v.themes, "b", "brand", "text", "part", "site").select("s_suppkey", "site")


@query(f"SELECT part, label FROM ({_MATCHES})")
def j05_theme_matches(v: Views) -> DataFrame:
    return joins.dictionary_matches(v.themes, F.col("text"), THEMES, ["part"])


@query(f"SELECT DISTINCT part, label FROM ({_MATCHES.replace('contains(lower(text), ', 'list_contains(string_split(lower(text), chr(32)), ')})")
def j05_theme_token_matches(v: Views) -> DataFrame:
    rows = [(name, w) for name, ws in THEMES for w in ws]
    return joins.token_matches(v.themes, F.col("text"), v.spark.createDataFrame(rows, "label string, keyword string"), ["part"])


@query(f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY price DESC, part, pri) AS n FROM ({_MATCHES}))
  SELECT brand, count(*) AS n_matches, string_agg(part::VARCHAR, ',' ORDER BY n) FILTER (n <= 5) AS shown FROM m WHERE n <= 6 GROUP BY brand""")
def j06_portfolio_matches(v: Views) -> DataFrame:
    order = F.element_at(F.create_map(*(F.lit(x) for i, (name, _) in enumerate(THEMES) for x in (name, i))), F.col("label"))
    m = joins.dictionary_matches(v.themes, F.col("text"), THEMES, ["part", "brand", "price"]).withColumn("pri", order)
    top = joins.top_matches(m.withColumn("p", F.col("part").cast("string")), "brand", [F.desc("price"), F.col("part"), F.col("pri")], 6, 5, "p")
    return top.select("brand", "n_matches", F.array_join("shown", ",").alias("shown"))


@query("""WITH old AS (SELECT ord, source, url FROM articles WHERE lang = 'en' AND url <> ''), new AS (SELECT ord, source, url FROM articles WHERE url <> ''),
  both_ AS (SELECT *, 0 AS f FROM old UNION ALL SELECT n.*, 1 FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.source = n.source AND o.url = n.url)),
  placed AS (SELECT ord AS article, source, url, row_number() OVER (PARTITION BY source ORDER BY f, ord) AS ord FROM both_)
  SELECT * FROM placed WHERE ord <= 6""")
def j07_append_new_links(v: Views) -> DataFrame:
    a = v.articles.where("url <> ''").select(F.col("ord").alias("article"), "source", "url", "lang")
    return joins.append_new(a.where("lang = 'en'").drop("lang"), a.drop("lang"), "source", "url", "article", 6)


@query("""WITH k AS (SELECT person_name, url FROM signals), led AS (SELECT DISTINCT url FROM signals WHERE detected_at < '2024-01-12')
  SELECT person_name, bool_and(led.url IS NOT NULL) AS seen FROM k LEFT JOIN led ON k.url = led.url GROUP BY person_name""")
def j08_evidence_seen(v: Views) -> DataFrame:
    people = v.signals.groupBy("person_name").agg(F.collect_set("url").alias("keys"))
    ledger = v.signals.where(F.col("detected_at") < F.lit("2024-01-12").cast("timestamp_ntz")).select(F.col("url").alias("key")).distinct()
    return joins.split_seen(people, F.col("keys"), ledger, "person_name").select("person_name", "seen")


@query(r"""WITH t AS (SELECT part, CASE part % 3 WHEN 0 THEN 'ex-' || text WHEN 1 THEN text ELSE 'at ' || text END AS line FROM themes)
  SELECT part, (regexp_matches(line, '\bred\b') AND NOT regexp_matches(line, '(ex[- ]|former(ly)? |previously (at )?)red\b'))
    OR (regexp_matches(line, '\bsmall\b') AND NOT regexp_matches(line, '(ex[- ]|former(ly)? |previously (at )?)small\b')) AS employed
  FROM (SELECT part, lower(line) AS line FROM t)""")
def j09_currently_employed(v: Views) -> DataFrame:
    line = F.when(F.col("part") % 3 == 0, F.concat(F.lit("ex-"), "text")).when(F.col("part") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("at "), "text"))
    t = v.themes.select("part", line.alias("line"))
    return t.select("part", joins.currently_employed(t, "line", ["red", "small"]).alias("employed"))


@query("""WITH hot AS (SELECT unnest(['build', 'machine', 'household goods']) AS h)
  SELECT pid, CASE WHEN EXISTS (SELECT 1 FROM hot WHERE contains(sector, h) OR contains(h, sector)) THEN least(p_score + 10, 100) ELSE p_score END AS p_score FROM persons""")
def j15_hot_label_boost(v: Views) -> DataFrame:
    return joins.hot_boost(v.persons, "sector", "p_score", ["build", "machine", "household goods"]).select("pid", "p_score")


@query("""WITH now_ AS (SELECT pid, p_score, region FROM persons WHERE pid % 3 < 2), old AS (SELECT pid, p_score, CASE WHEN region = 'ASIA' THEN 'Unknown' ELSE region END AS region FROM persons WHERE pid % 3 > 0)
  SELECT pid, p_score, region, false AS archived FROM now_ UNION ALL SELECT *, true FROM old WHERE pid NOT IN (SELECT pid FROM now_) AND p_score >= 40 AND region <> 'Unknown'""")
def j16_archive_merge(v: Views) -> DataFrame:
    p = v.persons.select("pid", "p_score", "region")
    old = p.where("pid % 3 > 0").withColumn("region", F.when(F.col("region") == "ASIA", "Unknown").otherwise(F.col("region")))
    return joins.archive_merge(p.where("pid % 3 < 2"), old, "pid", "p_score", 40, "region")


@query("""WITH m AS (SELECT person_name, source, id, description || ' said so' AS said, score > 20 AS liked, row_number() OVER (PARTITION BY person_name, source ORDER BY id) AS n FROM signals WHERE length(description || ' said so') > 20),
  k AS (SELECT *, row_number() OVER (PARTITION BY person_name ORDER BY id) AS r FROM m WHERE n <= 5)
  SELECT person_name, count(*) AS n_mentions, least(30, 10 * count(*)) + least(20, 5 * count(*) FILTER (liked)) AS social_score,
    string_agg(substr(said, 1, 60), ' / ' ORDER BY id) FILTER (r <= 5) AS snippets FROM k GROUP BY person_name""")
def j17_mention_screening(v: Views) -> DataFrame:
    m = v.signals.select("person_name", "source", "id", F.concat("description", F.lit(" said so")).alias("said"), (F.col("score") > 20).alias("liked"))
    return joins.mention_score(m, "person_name", "source", "id", "said", "liked")


@query("""WITH by_link AS (SELECT o_linkedin, min(oid) AS a FROM outreach WHERE o_linkedin <> '' GROUP BY 1), by_name AS (SELECT o_name, min(oid) AS b FROM outreach GROUP BY 1)
  SELECT id, coalesce(a, b) AS oid FROM signals LEFT JOIN by_link ON person_linkedin = o_linkedin LEFT JOIN by_name ON person_name = o_name""")
def j18_point_lookup(v: Views) -> DataFrame:
    return joins.fallback_lookup(v.signals, v.outreach, [("person_linkedin", "o_linkedin"), ("person_name", "o_name")], "oid").select("id", "oid")


@query("SELECT source, count(*) AS n FROM signals GROUP BY source")
def a01_signals_per_source(v: Views) -> DataFrame:
    return rollups.count_by(v.signals, "source")


@query(f"""SELECT {", ".join(f"count(*) FILTER (detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL {d} DAY) AS last_{d}d" for d in (1, 7, 30))},
  count(*) FILTER (signal_type IN ('signup', 'purchase')) AS of_types, count(*) AS total FROM signals""")
def a02_dashboard(v: Views) -> DataFrame:
    return rollups.dashboard(v.signals, AS_OF, "detected_at", ["signup", "purchase"])


@query("SELECT source, count(*) AS n FROM signals WHERE signal_type <> 'error' GROUP BY source")
def a03_sources_without_type(v: Views) -> DataFrame:
    return rollups.count_by(v.signals.where("signal_type <> 'error'"), "source")


@query(f"SELECT count(DISTINCT person_linkedin) AS n_persons FROM signals WHERE person_linkedin <> '' AND detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
def a04_distinct_persons(v: Views) -> DataFrame:
    return rollups.distinct_persons(v.signals.where(gates.within(F.col("detected_at"), AS_OF, 30)), "person_linkedin")


@query("SELECT count(*) AS n FROM signals WHERE signal_type <> 'view'")
def a05_count_without_type(v: Views) -> DataFrame:
    return v.signals.where("signal_type <> 'view'").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT l.label, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 5 THEN 'bullish' WHEN coalesce(n, 0) > 1 THEN 'neutral' ELSE 'quiet' END AS sentiment
  FROM (SELECT unnest({[t for t, _ in THEMES]}) AS label) l LEFT JOIN (SELECT label, count(DISTINCT part) AS n FROM ({_MATCHES}) GROUP BY label) m ON m.label = l.label""")
def a06_heat_map(v: Views) -> DataFrame:
    return rollups.heat_map([t for t, _ in THEMES], joins.dictionary_matches(v.themes, F.col("text"), THEMES, ["part"]), "part")


@query("SELECT count(*) FILTER (contains(lower(text), 'anvil') OR contains(lower(text), 'widget')) AS n FROM themes")
def a07_theme_baseline(v: Views) -> DataFrame:
    words = rollups.theme_words("red anvil and widget of")
    return v.themes.agg(F.count_if(T.any_of(F.col("text"), words)).alias("n"))


@query("SELECT brand, count(*) AS n FROM themes GROUP BY brand ORDER BY n DESC, brand LIMIT 5")
def a08_top_labels(v: Views) -> DataFrame:
    return rollups.count_by(v.themes, "brand").limit(5)


@query("""SELECT coalesce(nullif(person_linkedin, ''), nullif(person_name, ''), 'unknown') AS person, count(*) AS signal_count, max(score) AS best_score, arg_min(signal_type, id) AS first_type,
  string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT signal_type, ',' ORDER BY signal_type) AS types FROM signals GROUP BY 1""")
def a09_a11_per_person(v: Views) -> DataFrame:
    key = F.coalesce(T.blank_to_null(F.col("person_linkedin")), T.blank_to_null(F.col("person_name")), F.lit("unknown"))
    return rollups.per_person(v.signals, key)


@query(f"""WITH st AS (SELECT unnest({[*STAGES, "won"]}) AS stage, unnest(range({len(STAGES) + 1}))::INT AS ord),
  r AS (SELECT stage, 'o' || oid AS card, row_number() OVER (PARTITION BY stage ORDER BY 'o' || oid) AS n FROM outreach)
  SELECT st.ord, st.stage, count(card) AS n, coalesce(string_agg(card, ',' ORDER BY card) FILTER (r.n <= 5), '') AS cards FROM st LEFT JOIN r ON r.stage = st.stage GROUP BY st.ord, st.stage""")
def a10_kanban(v: Views) -> DataFrame:
    return rollups.kanban([*STAGES, "won"], v.outreach.withColumn("card", F.concat(F.lit("o"), F.col("oid").cast("string"))), "stage", "card")


@query("""WITH p AS (SELECT name, p_score, CASE WHEN p_score >= 6000 THEN 'investigate' WHEN p_score >= 4200 THEN 'watchlist' ELSE 'pass' END AS action FROM persons),
  s AS (SELECT count(*) AS n, count(*) FILTER (action = 'investigate') AS investigate, count(*) FILTER (action = 'watchlist') AS watchlist, arg_max(name, p_score) AS top_lead FROM p)
  SELECT *, n || ' profiles reviewed: ' || investigate || ' to investigate, ' || watchlist || ' on the watchlist. Top lead: ' || top_lead || '.' AS summary FROM s""")
def a12_run_summary(v: Views) -> DataFrame:
    action = F.when(F.col("p_score") >= 6000, "investigate").when(F.col("p_score") >= 4200, "watchlist").otherwise("pass")
    return rollups.run_summary(v.persons.withColumn("action", action), "p_score", "action", "name")


@query(f"""SELECT part, CASE {_WHEN} ELSE '' END AS category, array_to_string(list_filter([{", ".join(f"CASE WHEN {contains_sql('text', ws)} THEN '{n}' END" for n, ws in THEMES)}], lambda x: x IS NOT NULL)[1:3], ',') AS tags FROM themes""")
def a13_demand_tags(v: Views) -> DataFrame:
    return v.themes.select("part", T.first_label(F.col("text"), THEMES).alias("category"), F.array_join(F.slice(T.all_labels(F.col("text"), THEMES), 1, 3), ",").alias("tags"))


@query("SELECT min(part) AS part, text FROM themes GROUP BY text")
def a14_dedupe_dimension(v: Views) -> DataFrame:
    return rollups.dedupe_dimension(v.themes.select("part", "text"), "text", "part")


@query("SELECT ord, source, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS n FROM articles WHERE url <> '' AND title <> '') WHERE n = 1")
def w01_keep_first_url(v: Views) -> DataFrame:
    return ranking.keep_first(v.articles.where("title <> ''"), "url", ["ord"]).select("ord", "source", "url")


@query("SELECT ord FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(url, ''), substr(lower(title), 1, 80)) ORDER BY ord) AS n FROM articles WHERE trim(coalesce(nullif(url, ''), lower(title))) <> '') WHERE n = 1")
def w02_dedupe_url_or_title(v: Views) -> DataFrame:
    key = F.coalesce(F.nullif("url", F.lit("")), F.substring(F.lower("title"), 1, 80))
    return ranking.keep_first(v.articles, key, ["ord"]).select("ord")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ord DESC) AS n FROM articles), b AS (SELECT * FROM a WHERE n <= 60)
  SELECT ord, lang, row_number() OVER (ORDER BY ord DESC) AS place FROM b ORDER BY ord DESC LIMIT 120""")
def w03_two_level_top(v: Views) -> DataFrame:
    first = ranking.top_per_group(v.articles, ["lang"], [F.desc("ord")], 60, "n")
    return ranking.ranked(first, [F.desc("ord")], most=120).select("ord", "lang", "place")


@query("""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord DESC) AS n FROM articles WHERE url <> '') WHERE n = 1 UNION ALL SELECT *, 1 FROM articles WHERE url = '')
  SELECT ord, url FROM d ORDER BY ord DESC LIMIT 80""")
def w04_demand_feed(v: Views) -> DataFrame:
    return ranking.keep_first(v.articles, "url", [F.desc("ord")], blank="keep").orderBy(F.desc("ord")).limit(80).select("ord", "url")


@query(f"""SELECT ord, source, place FROM (SELECT ord, source, row_number() OVER (PARTITION BY source ORDER BY ord) AS place FROM articles WHERE {contains_sql("title || ' ' || summary", TONGUES[0][1])}) WHERE place <= 8""")
def w05_first_relevant_per_source(v: Views) -> DataFrame:
    hit = v.articles.where(T.any_of(F.concat_ws(" ", "title", "summary"), TONGUES[0][1]))
    return ranking.top_per_group(hit, ["source"], [F.col("ord")], 8).select("ord", "source", "place")


@query("SELECT pid, row_number() OVER (ORDER BY pid % 7 = 0 DESC, sector = 'building' DESC, p_score DESC, pid) AS place FROM persons ORDER BY place LIMIT 80")
def w06_candidates_before_scoring(v: Views) -> DataFrame:
    order = [(F.col("pid") % 7 == 0).desc(), (F.col("sector") == "building").desc(), F.desc("p_score"), F.col("pid")]
    return ranking.ranked(v.persons, order, most=80).select("pid", "place")


@query("SELECT pid, row_number() OVER (ORDER BY CASE WHEN p_score >= 6000 THEN 0 ELSE 1 END, p_score DESC, pid) AS place FROM persons ORDER BY place LIMIT 10")
def w07_enrichment_candidates(v: Views) -> DataFrame:
    order = [F.when(F.col("p_score") >= 6000, 0).otherwise(1), F.desc("p_score"), F.col("pid")]
    return ranking.ranked(v.persons, order, most=10).select("pid", "place")


@query("SELECT pid, place, place <= 20 AS top FROM (SELECT pid, row_number() OVER (PARTITION BY region ORDER BY p_score DESC, pid) AS place FROM persons)")
def w08_report_rank(v: Views) -> DataFrame:
    ranked = v.persons.withColumn("place", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("p_score"), "pid")))
    return ranked.select("pid", "place", (F.col("place") <= 20).alias("top"))


@query("SELECT oid, strftime(created_at, '%Y-%m') AS batch FROM outreach WHERE strftime(created_at, '%Y-%m') IN (SELECT DISTINCT strftime(created_at, '%Y-%m') AS b FROM outreach ORDER BY b DESC LIMIT 6)")
def w09_recent_batches(v: Views) -> DataFrame:
    o = v.outreach.select("oid", F.date_format("created_at", "yyyy-MM").alias("batch"))
    return ranking.recent_groups(o, "batch", F.col("batch"), 6).select("oid", "batch")


@query(f"SELECT oid, stage, row_number() OVER (PARTITION BY o_name ORDER BY list_position({list(STAGES)}, stage), lead_score DESC, oid) AS place FROM outreach")
def w10_stage_order(v: Views) -> DataFrame:
    order = Window.partitionBy("o_name").orderBy(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.desc("lead_score"), "oid")
    return v.outreach.withColumn("place", F.row_number().over(order)).select("oid", "stage", "place")


@query(f"""SELECT id, score, detected_at FROM signals WHERE detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY ORDER BY score DESC, detected_at DESC, id LIMIT 50""")
def w12_hot_signals(v: Views) -> DataFrame:
    recent = v.signals.where(gates.within(F.col("detected_at"), AS_OF, 7))
    return recent.orderBy(F.desc("score"), F.desc("detected_at"), "id").limit(50).select("id", "score", "detected_at")


@query("SELECT s_suppkey, place FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) - 1 AS place FROM supplier) WHERE place % 3 = 31 % 3")
def w13_round_robin(v: Views) -> DataFrame:
    return ranking.round_robin(v.raw("supplier"), ["s_name", "s_suppkey"], 3, 31).select("s_suppkey", F.col("place").cast("long").alias("place"))


@query("""SELECT brand, batch, string_agg(part::VARCHAR, ' OR ' ORDER BY part) AS items FROM (SELECT brand, part, (row_number() OVER (PARTITION BY brand ORDER BY part) - 1) // 3 AS batch FROM themes) GROUP BY brand, batch""")
def w13_batches_of_three(v: Views) -> DataFrame:
    return ranking.batches(v.themes, ["part"], "part", 3, by=["brand"])


@query("SELECT s_suppkey FROM supplier ORDER BY s_nationkey IN (3, 5) DESC, s_suppkey LIMIT 25")
def w14_priority_first(v: Views) -> DataFrame:
    return v.raw("supplier").orderBy(F.col("s_nationkey").isin(3, 5).desc(), "s_suppkey").limit(25).select("s_suppkey")


@query("""SELECT 'news' AS kind, ord AS ref, title AS text, NULL::DOUBLE AS score FROM articles UNION ALL SELECT 'event', id, description, score FROM signals UNION ALL SELECT 'part', part, text, NULL FROM themes""")
def u01_union_of_sources(v: Views) -> DataFrame:
    parts = [v.articles.select(F.lit("news").alias("kind"), F.col("ord").alias("ref"), F.col("title").alias("text")), v.signals.select(F.lit("event").alias("kind"), F.col("id").alias("ref"), F.col("description").alias("text"), "score"), v.themes.select(F.lit("part").alias("kind"), F.col("part").alias("ref"), "text")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


@query("""SELECT person_name, len(list_filter(list_distinct(list(signal_type)), lambda x: x <> 'view')) AS n_other, list_sort(list_distinct(list(source))) = ['src0'] AS only_src0 FROM signals GROUP BY person_name""")
def u02_source_sets(v: Views) -> DataFrame:
    s = v.signals.groupBy("person_name").agg(F.collect_set("signal_type").alias("t"), F.array_sort(F.collect_set("source")).alias("s"))
    return s.select("person_name", F.size(F.array_except("t", F.array(F.lit("view")))).cast("long").alias("n_other"), (F.col("s") == F.array(F.lit("src0"))).alias("only_src0"))


@query(f"""WITH h AS (SELECT s.id, o.oid, s.score, o.stage, row_number() OVER (PARTITION BY s.id ORDER BY o.lead_score DESC, o.oid) AS n FROM signals s JOIN outreach o ON s.person_linkedin <> '' AND s.person_linkedin = o.o_linkedin)
  SELECT id, oid, score, stage FROM h WHERE n = 1""")
def j01_best_pipeline_row(v: Views) -> DataFrame:
    keys = [(T.blank_to_null(F.col("person_linkedin")), T.blank_to_null(F.col("o_linkedin")))]
    met = joins.either_key_join(v.signals, v.outreach, keys, "id", "oid").where("oid is not null")
    return ranking.top_per_group(met, ["id"], [F.desc("lead_score"), F.col("oid")], 1).select("id", "oid", "score", "stage")


@query("""SELECT id, source, signal_type FROM signals WHERE signal_type <> 'error' AND detected_at >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY
  AND (contains(lower(person_name), 'user') OR contains(lower(description), 'user')) AND (contains(lower(description), '14') OR contains(lower(source), '14')) ORDER BY score DESC, id LIMIT 60""")
def f12_text_search(v: Views) -> DataFrame:
    some = v.signals.where((F.col("signal_type") != "error") & gates.within(F.col("detected_at"), AS_OF, 20))
    found = gates.search_terms(some, "user 14 x", ["person_name", "description", "source"])
    return found.orderBy(F.desc("score"), "id").limit(60).select("id", "source", "signal_type")


@query(f"""WITH r AS (SELECT id, source, CASE WHEN score > 30 THEN 'investigate' ELSE 'pass' END AS recommended_action, o.stage, '' AS geography, region AS location
    FROM signals s LEFT JOIN outreach o ON o.signal_id = s.id AND s.id > 0 LEFT JOIN persons p ON p.pid = s.id % 100)
  SELECT id FROM r WHERE contains(lower(source), 'rc1') AND (recommended_action = 'investigate' OR stage = 'investigate') AND contains(lower(coalesce(nullif(geography, ''), location)), 'a')""")
def f11_api_filters(v: Views) -> DataFrame:
    o = v.outreach.where("signal_id > 0")
    r = v.signals.join(o, v.signals["id"] == o["signal_id"], "left").join(v.persons, F.col("pid") == F.col("id") % 100, "left")
    r = r.select("id", "source", F.when(F.col("score") > 30, "investigate").otherwise("pass").alias("recommended_action"), "stage", F.lit("").alias("geography"), F.col("region").alias("location"))
    return gates.api_filter(r, "rc1", "investigate", "A").select("id")


@query(f"SELECT pid FROM persons WHERE p_score >= 40")
def f10_score_gate(v: Views) -> DataFrame:
    return v.persons.where(gates.score_gate(F.col("p_score"), 40)).select("pid")


@query("SELECT pid, sector, name FROM persons WHERE region = 'ASIA' AND p_score >= 0")
def f16_active_members(v: Views) -> DataFrame:
    return v.persons.where("region = 'ASIA' and p_score >= 0").orderBy("sector", "name").select("pid", "sector", "name")


@query(f"SELECT id FROM signals WHERE detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY")
def f06_look_back(v: Views) -> DataFrame:
    return v.signals.where(gates.within(F.col("detected_at"), AS_OF, 10)).select("id")


@query("""SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN 'other' ELSE 'home' END AS region FROM supplier""")
def s15_companies_by_region(v: Views) -> DataFrame:
    from tidemark.sources.landed import companies_by_region

    s = v.raw("supplier")
    other = s.join(v.raw("nation").where("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_name")
    return companies_by_region(s.select("s_suppkey", "s_name"), other, "s_name").select("s_suppkey", "region")


@query("SELECT json_object('src0', 1) IS NOT NULL AS ok, sum(n)::BIGINT AS total, string_agg(source || '=' || n, ',' ORDER BY source) AS sources FROM (SELECT source, count(*) AS n FROM signals GROUP BY source)")
def k01_source_breakdown(v: Views) -> DataFrame:
    b = sinks.source_breakdown(v.signals)
    return b.select(F.lit(True).alias("ok"), "total", F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("sources"))


@query(f"""SELECT coalesce({{'new': 'New', 'contacted': 'Contacted'}}[stage], stage) AS "Stage", substr(o_name, 1, 6) AS "Person", coalesce(substr(o_linkedin, 1, 20), '') AS "Profile", lead_score AS "Score" FROM outreach""".replace("{'new': 'New', 'contacted': 'Contacted'}[stage]", "CASE stage WHEN 'new' THEN 'New' WHEN 'contacted' THEN 'Contacted' END"))
def k04_flat_export(v: Views) -> DataFrame:
    return sinks.flat_export(v.outreach, {"new": "New", "contacted": "Contacted"}, "stage", [("Stage", "stage", None), ("Person", "o_name", 6), ("Profile", "o_linkedin", 20), ("Score", "lead_score", None)])


@query("""WITH b AS (SELECT s_suppkey AS box_id, 'CUSTOMER#' || substr('000000000' || s_suppkey, -9) AS box FROM supplier)
  SELECT pid, 'name: ' || name || chr(10) || 'sector: ' || sector AS dossier, CASE WHEN box_id IS NULL THEN 'create' ELSE 'update' END AS decision, box_id FROM persons LEFT JOIN b ON lower(name) = lower(box)""")
def k05_dossiers(v: Views) -> DataFrame:
    boxes = v.raw("supplier").select(F.col("s_suppkey").alias("box_id"), F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("box"))
    return sinks.dossiers(v.persons, boxes, "name", ["name", "sector"]).select("pid", "dossier", "decision", "box_id")


@query("""WITH e AS (SELECT id % 200 AS run, id AS step, score AS found, CASE WHEN signal_type = 'error' THEN 'boom' ELSE '' END AS error FROM signals)
  SELECT run, max(step) AS step, arg_max(found, step) AS found, arg_max(error, step) AS error, CASE WHEN arg_max(error, step) <> '' THEN 'failed' ELSE 'completed' END AS status FROM e GROUP BY run""")
def k06_run_history(v: Views) -> DataFrame:
    e = v.signals.select((F.col("id") % 200).alias("run"), F.col("id").alias("step"), F.col("score").alias("found"), F.when(F.col("signal_type") == "error", "boom").otherwise("").alias("error"))
    return sinks.run_history(e, "run", "step")


