"""Registered queries: extraction, cleaning and relevance over texts made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import gates, html as H, text as T, words as W
from tidemark.functions.words import REGIONS
from tidemark.operators.scoring import percent_change, snippet_score, type_weight
from tidemark.operators.ranking import numbered, top_per_group
from tidemark.plans.bindings import TONGUES, Views, contains_sql
from tidemark.plans.registry import query
from tidemark.sources import landed


def cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def choose(number: Column, *options: Column | str) -> Column:
    """One of the options by the number's remainder."""
    return F.element_at(F.array(*(F.lit(o) if isinstance(o, str) else o for o in options)), (number % len(options) + 1).cast("int"))


def _titled(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '\\p{{L}}+|\\P{{L}}+'), lambda p: upper(p[1:1]) || p[2:]), '')"


def _cased(labels, text: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {contains_sql(text, ws)} THEN '{name}'" for name, ws in labels) + f" ELSE '{default}' END"




@query(rf"""WITH r AS (SELECT pid, ['  ' || name || ' ☀_' || sector, upper(sector) || ' ' || location, '-', 'jo de ' || sector || ' (he/him)', name || ' lee (ex-Grab) ', name || ' ma, 1409'][pid % 6 + 1] AS raw FROM persons),
  c AS (SELECT pid, lower(trim(raw)) AS low, regexp_replace(regexp_replace(trim(raw), '[\p{{S}}\p{{C}}]', '', 'g'), '[_\d#@~^*=+<>{{}}\[\]\\/]+', ' ', 'g') AS m FROM r),
  t AS (SELECT pid, low, regexp_replace(regexp_replace(regexp_replace(m, '[\s\-_·|,]*(\(.*?\))+\s*$', ''), '\s\s+', ' ', 'g'), '^[ .,|\-·]+|[ .,|\-·]+$', '', 'g') AS n FROM c),
  d AS (SELECT pid, low, CASE WHEN upper(n) = n OR lower(n) = n THEN {_titled("n")} ELSE n END AS n FROM t)
  SELECT pid, CASE WHEN low IN ('unknown', 'n/a', 'none', '-') OR len(list_filter(string_split(n, ' '), lambda t: length(t) >= 2 AND regexp_matches(t, '\p{{L}}'))) < 1 THEN '' ELSE n END AS clean FROM d""")
def p01_clean_name(v: Views) -> DataFrame:
    raw = choose(F.col("pid"), cat("  ", F.col("name"), " ☀_", F.col("sector")), cat(F.upper("sector"), " ", F.col("location")), "-", cat("jo de ", F.col("sector"), " (he/him)"), cat(F.col("name"), " lee (ex-Grab) "), cat(F.col("name"), " ma, 1409"))
    return v.persons.select("pid", T.clean_name(raw, unicode_form=True).alias("clean"))


@query(r"""WITH r AS (SELECT *, trim(regexp_replace(regexp_replace(lower(person_name || ' of ' || source), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) AS nm FROM signals)
  SELECT id, nm AS name_key, array_to_string(list_filter([CASE WHEN person_linkedin <> '' THEN 'li:' || regexp_extract(person_linkedin, 'in/([A-Za-z0-9_%-]+)', 1) END, CASE WHEN id % 4 = 0 THEN 'tw:h' || id % 50 END,
    CASE WHEN id % 6 = 0 THEN 'gh:g' || id % 40 END, CASE WHEN nm <> 'unknown' AND contains(nm, ' ') THEN 'nm:' || nm END], lambda x: x IS NOT NULL), ',') AS keys FROM r""")
def p02_p03_identity_keys(v: Views) -> DataFrame:
    name = cat(F.col("person_name"), " of ", F.col("source"))
    handle = F.when(F.col("id") % 4 == 0, cat(" @H", F.col("id") % 50))
    repo = F.when(F.col("id") % 6 == 0, cat("https://github.com/G", F.col("id") % 40, "/x"))
    return v.signals.select("id", T.name_key(name).alias("name_key"), F.array_join(T.identity_keys(F.col("person_linkedin"), handle, repo, name), ",").alias("keys"))


@query(rf"""WITH r AS (SELECT pid, lower(replace(location, '_', '-')) || '-' || sector || ['-a1b2', '', '-tail99'][pid % 3 + 1] AS slug FROM persons)
  SELECT pid, 'https://www.linkedin.com/in/' || slug AS url, {_titled("trim(replace(regexp_replace(slug, '-[a-z]*[0-9][a-z0-9]*$', ''), '-', ' '))")} AS name FROM r""")
def p04_p05_profile_and_slug(v: Views) -> DataFrame:
    slug = cat(F.lower(F.replace("location", F.lit("_"), F.lit("-"))), "-", F.col("sector"), choose(F.col("pid"), "-a1b2", "", "-tail99"))
    r = v.persons.select("pid", slug.alias("slug"))
    return r.select("pid", T.profile_url(cat("https://g.co/url?q=https://in.linkedin.com/in/", F.col("slug"), "?trk=x")).alias("url"), T.name_from_slug(F.col("slug")).alias("name"))


@query(rf"""WITH r AS (SELECT pid, ['Priya Nair', 'Arjun Mehta', 'Stealth Founder', 'jo x', 'A B'][pid % 5 + 1] AS who, sector FROM persons)
  SELECT pid, CASE WHEN pid % 5 < 2 THEN who ELSE '' END AS name, trim(who || ' - ' || sector || ' | ') AS first FROM r""")
def p06_p07_result_titles(v: Views) -> DataFrame:
    title = cat(choose(F.col("pid"), "Priya Nair", "Arjun Mehta", "Stealth Founder", "jo x", "A B"), " - ", F.col("sector"), " | LinkedIn and others | LinkedIn")
    return v.persons.select("pid", T.name_from_title(title).alias("name"), T.first_profile(title).alias("first"))


@query(rf"""WITH r AS (SELECT pid, 'Priya ' || {_titled("sector")} AS who, {_titled("sector")} AS firm, pid % 6 AS k FROM persons)
  SELECT pid, CASE WHEN k = 5 THEN 'Unknown' ELSE who END AS name, CASE k WHEN 0 THEN firm WHEN 5 THEN '' ELSE CASE WHEN k = 1 THEN 'Acme' ELSE '' END END AS company, who LIKE '% Ltd' AS organisation FROM r""")
def p08_p09_p10_names_in_headlines(v: Views) -> DataFrame:
    who, firm = cat("Priya ", T.title_case(F.col("sector"))), T.title_case(F.col("sector"))
    title = choose(F.col("pid"), cat(who, " leaves ", firm, "!"), cat("Former Acme VP ", who, " speaks"), cat("now: ", who, ", CEO of x"), cat("x led by ", who, "."), cat("of late: ", who, ", co-founder"), "nothing at all")
    p = v.persons.select("pid", title.alias("t"), who.alias("who"))
    return p.select("pid", T.person_name(F.col("t"), F.lit("")).alias("name"), T.previous_company(F.col("t")).alias("company"), T.is_organisation(F.col("who")).alias("organisation"))


@query("""WITH r AS (SELECT pid, sector, pid % 3 AS k FROM persons) SELECT pid, CASE WHEN k = 1 THEN '' ELSE sector END AS company, k = 1 AS reject FROM r""")
def p11_former_company(v: Views) -> DataFrame:
    line = choose(F.col("pid"), cat("CTO, ex - ", F.upper("sector")), cat("CEO @", F.col("sector")), cat("formerly ", F.col("sector"), " lead"))
    p = v.persons.select("pid", T.former_at(line, F.col("sector")).alias("x"))
    return p.select("pid", "x.company", "x.reject")


_PLACE = "['in ' || location || ', Jakarta', 'Mumbai office', '', 'Hanoi ' || sector][pid % 4 + 1]"


@query(f"""WITH r AS (SELECT pid, sector, {_PLACE} AS place, ['a.sg', 'b.in', 'c.us'][pid % 3 + 1] AS dom FROM persons)
  SELECT pid, {_cased(REGIONS, 'place', '')} AS by_text, coalesce(CASE dom WHEN 'a.sg' THEN 'Singapore' WHEN 'b.in' THEN 'India' END, nullif({_cased(REGIONS, 'place', '')}, ''), '') AS by_outlet,
    coalesce(nullif({_cased(REGIONS, 'place', '')}, ''), CASE WHEN contains(sector, 'build') THEN 'India' END, 'Unknown') AS geography FROM r""")
def p12_p13_p14_places(v: Views) -> DataFrame:
    place = choose(F.col("pid"), cat("in ", F.col("location"), ", Jakarta"), "Mumbai office", "", cat("Hanoi ", F.col("sector")))
    p = v.persons.select("pid", "sector", place.alias("place"), choose(F.col("pid"), "a.sg", "b.in", "c.us").alias("dom"))
    return p.select(
        "pid",
        T.location(F.col("place"), F.col("dom"), {}).alias("by_text"),
        T.location(F.col("place"), F.col("dom"), {"a.sg": "Singapore", "b.in": "India"}, text_first=False).alias("by_outlet"),
        T.geography(F.col("place"), F.lit(""), F.col("sector"), {"India": ["build"]}).alias("geography"),
    )


_HITS = lambda text: [(i, name, " + ".join(f"contains(lower({text}), '{w}')::INT" for w in ws)) for i, (name, ws) in enumerate(TONGUES)]


@query(f"""WITH h AS (SELECT ord, {", ".join(f"{e} AS h{i}" for i, _, e in _HITS("title || ' ' || summary"))} FROM articles), g AS (SELECT *, greatest(h0, h1, h2, h3) AS top FROM h)
  SELECT ord, CASE WHEN top = 0 THEN 'unknown' {" ".join(f"WHEN h{i} = top THEN '{n}'" for i, n, _ in _HITS("x"))} END AS label FROM g""")
def p15_best_label(v: Views) -> DataFrame:
    return v.articles.select("ord", T.best_label(F.concat_ws(" ", "title", "summary"), TONGUES).alias("label"))


@query("""WITH r AS (SELECT id, description || [' raises seed', ' leaves Acme as vice president', ' launches stealth lab', '', ' ceo'][id % 5 + 1] AS t FROM signals)
  SELECT id, CASE id % 5 WHEN 0 THEN 'funding_news' WHEN 1 THEN 'exec_departure' WHEN 2 THEN 'stealth_founder' ELSE 'news_mention' END AS kind,
    CASE id % 5 WHEN 1 THEN 'exec_departure' WHEN 2 THEN 'stealth_founder' ELSE 'twitter_announce' END AS post_kind, CASE id % 5 WHEN 1 THEN 'VP' WHEN 4 THEN 'CEO' ELSE '' END AS role, id % 5 IN (1, 4) AS senior FROM r""")
def p16_p17_titles_and_types(v: Views) -> DataFrame:
    t = v.signals.select("id", cat(F.col("description"), choose(F.col("id"), " raises seed", " leaves Acme as vice president", " launches stealth lab", "", " ceo")).alias("t"))
    return t.select("id", T.signal_type(F.col("t")).alias("kind"), T.signal_type(F.col("t"), post=True).alias("post_kind"), T.role_title(F.col("t")).alias("role"), T.is_senior(F.col("t")).alias("senior"))


@query("""WITH r AS (SELECT oid, 2020 + oid % 8 AS a, 2020 + oid % 5 AS b FROM outreach)
  SELECT oid, CASE WHEN greatest(a, b) >= 2026 THEN 'x ' || a || ' OR ' || b ELSE 'x ' || CASE WHEN a = greatest(a, b) THEN 2026 ELSE 2025 END || ' OR ' || CASE WHEN b = greatest(a, b) THEN 2026 ELSE 2025 END END AS fresh FROM r""")
def p18_fresh_years(v: Views) -> DataFrame:
    return v.outreach.select("oid", T.freshen_years(cat("x ", F.col("oid") % 8 + 2020, " OR ", F.col("oid") % 5 + 2020), 2026).alias("fresh"))


@query("SELECT oid, CASE WHEN oid % 5 < 4 THEN 2015 + oid % 9 ELSE 0 END::INT AS year, CASE WHEN oid % 5 < 4 THEN oid % 5 ELSE 0 END::INT AS season FROM outreach")
def p19_batch_keys(v: Views) -> DataFrame:
    label = choose(F.col("oid"), *(cat(s, F.col("oid") % 9 + 2015) for s in ("Winter ", "Spring ", "Summer ", "Fall ")), "soon")
    k = v.outreach.select("oid", T.batch_key(label).alias("k"))
    return k.select("oid", "k.year", "k.season")


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS host, substr(trim(regexp_replace(regexp_extract(html, '(?s)<title>.*?</title>'), '<[^>]+>', '', 'g')), 1, 80) AS title,
  'url:' || regexp_replace(lower(url), '/+$', '') AS evidence FROM pages""")
def p20_p23_page_keys(v: Views) -> DataFrame:
    title = T.strip_tags(F.regexp_extract("html", r"(?s)<title>.*?</title>", 0))
    return v.raw("pages").select("page_id", T.domain(F.col("url")).alias("host"), F.substring(title, 1, 80).alias("title"), T.evidence_key(F.col("url"), F.lit("")).alias("evidence"))


@query("""WITH r AS (SELECT id, detected_at, id % 5 AS k FROM signals)
  SELECT id, CASE k WHEN 4 THEN TIMESTAMP '1970-01-01' WHEN 3 THEN date_trunc('day', detected_at) ELSE date_trunc('second', detected_at) END AS published,
    CASE WHEN k = 4 THEN NULL ELSE 1 END IS NULL AS missing FROM r""")
def p21_dates(v: Views) -> DataFrame:
    ts = F.col("detected_at")
    forms = [F.date_format(ts, f) for f in ("EEE, d MMM yyyy HH:mm:ss '+0000'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMdd'T'HHmmss'Z'", "yyyy-MM-dd")]
    r = v.signals.select("id", choose(F.col("id"), *forms, "soon").alias("t"))
    return r.select("id", T.parse_date(F.col("t")).cast("timestamp_ntz").alias("published"), T.parse_date(F.col("t"), None).isNull().alias("missing"))


@query(r"""SELECT ord, substr(trim(regexp_replace(lower(title || '  ' || source), '\s+', ' ', 'g')), 1, 90) AS form,
  CASE WHEN url <> '' THEN 'news|' || lower(url) ELSE source || '|news|' || substr(lower(summary), 1, 120) END AS fingerprint FROM articles""")
def p22_p23_article_keys(v: Views) -> DataFrame:
    a = v.articles
    return a.select("ord", T.headline_key(F.concat("title", F.lit("  "), "source")).alias("form"), T.signal_fingerprint(F.col("source"), F.lit("news"), F.col("url"), F.col("summary")).alias("fingerprint"))


@query("""SELECT pid, [ 'IIT,Stanford', 'Harvard', 'MIT,IIM,NUS', ''][pid % 4 + 1] AS schools, pid % 4 = 2 AS second_time, ['later_stage', 'seed_stage', '', 'later_stage'][pid % 4 + 1] AS stage, pid % 4 = 1 AS foreign_flag FROM persons""")
def p24_p27_evidence_marks(v: Views) -> DataFrame:
    t = choose(F.col("pid"), cat("IIT iit Stanford IIT, ", F.col("sector"), " Series C"), cat("harvard HARVARD \U0001f1ee\U0001f1f3 \U0001f1fa\U0001f1f8 ", F.col("sector"), " raises pre-seed"), "MIT, IIM, NUS, INSEAD serial entrepreneur Series B", cat("seed round then IPO of ", F.col("sector"), " \U0001f1ee\U0001f1f3"))
    p = v.persons.select("pid", "sector", t.alias("t"))
    school = F.array_join(T.education(F.col("t")), ",")
    return p.select(
        "pid", F.when(F.col("pid") % 4 == 1, T.title_case(school)).otherwise(school).alias("schools"), T.second_time(F.col("t")).alias("second_time"),
        T.funding_stage(F.col("t"), F.col("sector")).alias("stage"), T.foreign_flag(F.col("t"), ["\U0001f1ee\U0001f1f3"]).alias("foreign_flag"),
    )


@query("""SELECT oid, ['h' || oid % 99, '', '', ''][oid % 4 + 1] AS handle, ['twitter_url', 'github_url', 'linkedin_url', 'twitter_url'][oid % 4 + 1] AS target, substr(trim(o_name || ' Pvt Ltd'), 1, 80) AS company,
  CASE WHEN oid * 37 < 3600 THEN (oid * 37) // 60 || 'm ago' WHEN oid * 37 < 86400 THEN (oid * 37) // 3600 || 'h ago' ELSE (oid * 37) // 86400 || 'd ago' END AS age FROM outreach""")
def p28_p29_p33_handles_and_ages(v: Views) -> DataFrame:
    o = F.col("oid")
    url = choose(o, cat("https://x.com/H", o % 99), "https://github.com/a", "https://linkedin.com/in/b", "https://twitter.com/home")
    return v.outreach.select("oid", T.social_handle(url).alias("handle"), T.profile_column(url).alias("target"), T.registry_company(cat(F.col("o_name"), " Pvt Ltd | registered 2024")).alias("company"), T.age_text(o * 37).alias("age"))


@query("""SELECT id // 50 AS batch_id, (id % 50)::INT AS idx, person_name AS person, CASE WHEN id % 3 = 0 THEN 'exec_departure' ELSE 'funding_news' END AS signal_type FROM signals WHERE id % 50 < 45 AND id % 7 <> 0""")
def p30_p31_model_rows(v: Views) -> DataFrame:
    row = F.to_json(F.struct((F.col("id") % 50).alias("idx"), F.when(F.col("id") % 7 == 0, "").otherwise(F.col("person_name")).alias("person"), F.when((F.col("id") % 3 == 0) | (F.col("id") % 7 == 0), "departure").otherwise("funding").alias("event")))
    held = v.signals.groupBy(F.floor(F.col("id") / 50).alias("batch_id")).agg(F.array_join(F.array_sort(F.collect_list(row)), ",").alias("items"))
    raw = held.select("batch_id", F.lit(45).alias("batch_size"), cat("Sure, here it is: [", F.col("items"), "] as asked.").alias("raw_text"))
    rows = landed.extraction_signals(landed.extraction_rows(raw), {"departure": "exec_departure", "funding": "funding_news"})
    return rows.select("batch_id", "idx", "person", "signal_type")


@query("""WITH s AS (SELECT o_custkey AS c, o_orderpriority AS title, 'co' || o_orderkey AS company, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders),
  p AS (SELECT c, min(y) AS first, max(company) FILTER (n = 1) AS now_, max(company) FILTER (n = 2) AS prev, max(title) FILTER (n = 2) AS ptitle FROM s GROUP BY c)
  SELECT c, coalesce(ptitle, '') AS previous_title, coalesce(prev, '') AS previous_company, (2002 - first)::INT AS years, now_ AS current_company, false AS stealth FROM p""")
def p32_work_history(v: Views) -> DataFrame:
    from pyspark.sql import Window

    o = v.raw("orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    stint = F.struct(cat("co", F.col("o_orderkey")).alias("company"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("start_year"), F.when(n > 1, 10000 - n).alias("end_year"))
    held = o.select(F.col("o_custkey").alias("c"), stint.alias("s")).groupBy("c").agg(F.collect_list("s").alias("stints"))
    return held.select("c", T.work_facts(F.col("stints"), 2002).alias("w")).select("c", "w.*")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY person_name ORDER BY id) AS n FROM signals)
  SELECT person_name, string_agg('[' || upper(source) || '] ' || signal_type || ': ' || substr(description, 1, 120), chr(10) ORDER BY id) AS block FROM s WHERE n <= 10 GROUP BY person_name""")
def p35_evidence_block(v: Views) -> DataFrame:
    held = top_per_group(v.signals, ["person_name"], [F.col("id")], 10).groupBy("person_name").agg(F.array_sort(F.collect_list(F.struct("id", "source", "signal_type", "description"))).alias("signals"))
    return held.select("person_name", T.evidence_text(F.col("signals")).alias("block"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN source ELSE '' END AS sector, CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS n_strengths, 0 AS n_risks FROM signals")
def p34_rationale(v: Views) -> DataFrame:
    json = F.when(F.col("id") % 3 == 0, F.to_json(F.struct(F.col("source").alias("sector"), F.array(F.lit("a"), F.lit("b")).alias("key_strengths")))).when(F.col("id") % 3 == 1, "not json")
    r = v.signals.select("id", T.rationale(json).alias("r"))
    return r.select("id", "r.sector", F.size("r.key_strengths").alias("n_strengths"), F.size("r.risks").alias("n_risks"))


_T = "title || ' ' || summary"
_EN, _FR, _DE, _ES = (ws for _, ws in TONGUES)


@query(f"""SELECT ord, {contains_sql(_T, _EN)} AND NOT {contains_sql(_T, ("licensed", "!!"))} AS news, NOT {contains_sql(_T, ("***",))} AND {contains_sql(_T, (*_FR, *_ES))} AS topic,
  NOT {contains_sql(_T, ("***",))} AND ({contains_sql(_T, _DE)} OR ({contains_sql(_T, _EN)} AND {contains_sql(_T, ("tion",))})) AS strict FROM articles""")
def f01_f02_f03_relevance(v: Views) -> DataFrame:
    t = F.concat_ws(" ", "title", "summary")
    return v.articles.select(
        "ord", gates.news_relevant(t, _EN, ("licensed", "!!")).alias("news"), gates.topic_relevant(t, (*_FR, *_ES), ("***",)).alias("topic"),
        gates.strictly_relevant(t, _DE, _EN, ("tion",), ("***",)).alias("strict"),
    )


@query("""SELECT pid, pid % 5 IN (1, 2) AS has_stealth, pid % 5 IN (2, 3) AS has_senior, pid % 5 = 1 AS first_person FROM persons""")
def f04_f05_headline_and_post_gates(v: Views) -> DataFrame:
    title = choose(F.col("pid"), "Intern, stealth founder", "I'm building in stealth", "Founder, ex CEO", "Vice President", "clerk")
    g = v.persons.select("pid", gates.headline_gate(title, F.col("sector")).alias("g"), gates.first_person_post(title).alias("first_person"))
    return g.select("pid", "g.has_stealth", "g.has_senior", "first_person")


@query("""WITH t AS (SELECT person_name, list_distinct(list(signal_type)) AS types, max(score) AS best FROM signals GROUP BY person_name)
  SELECT person_name, list_contains(types, 'signup') OR best > 100 AS plausible FROM t""")
def f08_plausible(v: Views) -> DataFrame:
    t = v.signals.groupBy("person_name").agg(F.collect_set("signal_type").alias("types"), F.max("score").alias("best"))
    return t.select("person_name", gates.plausible(F.col("types"), F.when(F.col("best") > 100, "Left To Build").otherwise("no"), ["signup"], r"left to \w+").alias("plausible"))


@query(f"""WITH p AS (SELECT pid, sector, {_PLACE} AS place FROM persons) SELECT pid FROM p WHERE {_cased(REGIONS, 'place', '')} <> '' AND (pid % 3 <> 0 OR pid % 2 = 0)""")
def f07_f09_region_and_anchor(v: Views) -> DataFrame:
    place = choose(F.col("pid"), cat("in ", F.col("location"), ", Jakarta"), "Mumbai office", "", cat("Hanoi ", F.col("sector")))
    p = v.persons.select("pid", place.alias("place"), F.when(F.col("pid") % 3 != 0, F.col("name")).alias("name"), F.when(F.col("pid") % 2 == 0, F.lit("x")).otherwise(" ").alias("anchor"))
    geo = T.geography(F.col("place"), F.lit(""), F.lit(""), {"none": ["zzzz"]})
    return p.where((geo != "Unknown") & gates.actionable(F.col("name"), F.col("anchor"))).select("pid")


@query("""SELECT page_id, contains(lower(url), '.example.com/fr') OR contains(lower(html), '<title>the') AS listed, CASE page_id % 4 WHEN 0 THEN 'growth' WHEN 1 THEN 'shrink' WHEN 2 THEN 'growth' END AS headcount FROM pages""")
def f13_f14_f15_page_tests(v: Views) -> DataFrame:
    pct = F.when(F.col("page_id") % 4 == 0, 55.0)
    text = choose(F.col("page_id"), "layoff", "layoffs now", "hiring after a layoff", "none")
    return v.raw("pages").select("page_id", gates.listed_source(F.col("url"), F.col("html"), [".example.com/fr"], ["<title>the"]).alias("listed"), gates.headcount_change(pct, text).alias("headcount"))


_READ = "replace(replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<(nav|header)\b.*?</(nav|header)>', ' ', 'g'), '(?s)<footer\b.*?</footer>', ' ', 'g') AS h FROM pages),
  p AS (SELECT page_id, h, list_transform(string_split_regex(h, '<p>')[2:], lambda p: trim(regexp_replace({_READ.format("regexp_replace(string_split_regex(p, '</?(?:p|article|div|ul|body|html)[ >]')[1], '<[^>]+>', ' ', 'g')")}, '\s+', ' ', 'g'))) AS ps FROM b)
  SELECT page_id, substr(trim(regexp_replace({_READ.format("regexp_replace(h, '<[^>]+>', ' ', 'g')")}, '\s+', ' ', 'g')), 1, 5000) AS visible,
    substr(array_to_string(list_filter(ps, lambda p: length(p) > 40), ' '), 1, 800) AS article FROM p""")
def s11_page_text(v: Views) -> DataFrame:
    return v.raw("pages").select("page_id", H.visible_text(F.col("html")).alias("visible"), H.article_text(F.col("html")).alias("article"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS pos FROM pages),
  u AS (SELECT page_id, 'https://ex.com' || lower(replace(href, '&amp;', '&')) AS url, min(pos) AS pos FROM l WHERE starts_with(href, '/') GROUP BY ALL)
  SELECT page_id, url, place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS place FROM u) WHERE place <= 10""")
def s12_result_links(v: Views) -> DataFrame:
    """The site's own links of each page."""
    site = lambda u: F.when(u.startswith("/"), F.concat(F.lit("https://ex.com"), F.lower(u))).otherwise("")
    return landed.result_links(v.raw("pages"), "page_id", "html", canonical=site).select("page_id", "url", "place")


@query("""WITH l AS (SELECT page_id, unnest(range(3)) AS k FROM pages) SELECT page_id, 'https://www.linkedin.com/in/p' || (page_id % 7 + k) AS url, (k + 1)::INT AS place FROM l""")
def s12_profile_links(v: Views) -> DataFrame:
    """Profile links behind redirects, added to each page."""
    link = lambda k: cat('<a class=r href="/l/?uddg=https%3A%2F%2Fin.linkedin.com%2Fin%2Fp', F.col("page_id") % 7 + k, "%3Fx&amp;rut=1\">a</a><a href='https://ex.com/'>b</a>")
    pages = v.raw("pages").select("page_id", F.concat(F.col("html"), link(0), link(1), link(0), link(2)).alias("html"))
    return landed.result_links(pages, "page_id", "html").select("page_id", "url", "place")


@query(r"""WITH l AS (SELECT page_id, 'Company ' || page_id || ' registered ' || (1990 + page_id % 40) AS a FROM pages) SELECT page_id, a AS line, 1 AS place FROM l UNION ALL SELECT page_id, 'Second line of ' || a, 2 FROM l""")
def s10_registry_lines(v: Views) -> DataFrame:
    a = cat("Company ", F.col("page_id"), " registered ", F.col("page_id") % 40 + 1990)
    pages = v.raw("pages").select("page_id", F.concat_ws("\n", F.lit("short"), a, F.lit("a line with no year in it"), F.concat(F.lit("Second line of "), a)).alias("text"))
    return landed.registry_lines(pages, "page_id", "text").select("page_id", "line", "place")


@query("""WITH r AS (SELECT part, brand, price, CASE WHEN part % 2 = 0 THEN (price / 1000)::DECIMAL(10, 1)::DOUBLE * 1000 ELSE floor(price) END::INT AS n_stars FROM themes),
  k AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY part) AS n FROM r WHERE n_stars >= 1200) SELECT part, brand, n_stars FROM k WHERE n = 1""")
def s13_trending(v: Views) -> DataFrame:
    stars = F.when(F.col("part") % 2 == 0, cat(F.col("price").cast("decimal(12,4)").__truediv__(F.lit(1000)).cast("decimal(10,1)"), "k")).otherwise(F.format_number(F.floor("price"), 0))
    rows = v.themes.select(F.col("part").alias("ord"), F.concat("brand", F.lit("/x")).alias("repo"), stars.alias("stars"), F.lit("").alias("today"), "brand")
    return landed.trending(rows, 1200).select(F.col("ord").alias("part"), "brand", "n_stars")


@query("SELECT o_orderkey AS symbol, CASE WHEN o_custkey % 10 = 0 THEN 0.0 ELSE (round((o_totalprice - o_custkey % 10 * 7001.3::DOUBLE) / (o_custkey % 10 * 7001.3::DOUBLE) * 100, 2)) END AS change_pct FROM orders", plain=True)
def s14_c11_quotes(v: Views) -> DataFrame:
    meta = F.struct(F.col("o_totalprice").alias("regularMarketPrice"), F.lit(None).cast("double").alias("chartPreviousClose"), (F.col("o_custkey") % 10 * 7001.3).cast("double").alias("previousClose"))
    raw = v.raw("orders").select(F.col("o_orderkey").alias("symbol"), F.col("o_orderpriority").alias("geo"), (F.col("o_custkey") % 2 == 0).alias("is_index"), meta.alias("meta"))
    return landed.quotes(raw).select("symbol", F.coalesce("change_pct", percent_change(F.lit(1.0), F.lit(0.0))).alias("change_pct"))


@query("SELECT o_orderkey AS symbol, row_number() OVER (ORDER BY o_custkey % 2 = 0 DESC, o_orderpriority, o_orderkey) AS place FROM orders", plain=True)
def w11_quote_order(v: Views) -> DataFrame:
    """The places of all quotes: indexes first, then by region and name, numbered by a sort in ranges."""
    rows = v.raw("orders").select(F.col("o_orderkey").alias("symbol"), F.col("o_orderpriority").alias("geo"), (F.col("o_custkey") % 2 != 0).alias("_rest"))
    return numbered(rows, ["_rest", "geo", "symbol"]).select("symbol", "place")


@query("""SELECT doc_id, contains(lower(text), 'tion') OR contains(lower(text), 'ing ') AS tech FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""", plain=True)
def f14_tech_terms(v: Views) -> DataFrame:
    """Registry texts by technical terms, over all documents."""
    return v.raw("documents").select("doc_id", T.any_of(F.col("text"), ("tion", "ing ")).alias("tech"))


@query("""WITH r AS (SELECT pid, ['VP at Grab building something', 'founder and co-founder', 'webinar for founder', 'serial founder, stealth'][pid % 4 + 1] AS t FROM persons)
  SELECT pid, [50, 44, 0, 59][pid % 4 + 1]::INT AS score, [15, 18, 10, 0][pid % 4 + 1]::INT AS weight FROM r""")
def c01_snippet_scores(v: Views) -> DataFrame:
    t = choose(F.col("pid"), "VP at Grab building something", "founder and co-founder", "webinar for founder", "serial founder, stealth")
    kind = choose(F.col("pid"), "Stealth Founder", "exec_departure", "twitter_announcement", "github_launch")
    return v.persons.select("pid", snippet_score(t).alias("score"), type_weight(kind).alias("weight"))


_SCORE = f"20 + CASE WHEN {contains_sql('text', ('tion',))} THEN 8 ELSE 0 END + CASE WHEN {contains_sql('text', ('ing ',))} THEN 16 ELSE 0 END + CASE WHEN {contains_sql('text', W.SENIOR_SNIPPET)} THEN 12 ELSE 0 END + CASE WHEN {contains_sql('text', W.PEDIGREE)} THEN 10 ELSE 0 END + CASE WHEN {contains_sql('text', ('second-time', 'serial'))} THEN 15 ELSE 0 END"


@query(f"SELECT doc_id, CASE WHEN {contains_sql('text', ('***', 'http'))} THEN 0 ELSE least(85, {_SCORE}) END::INT AS score FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)", plain=True)
def c01_document_scores(v: Views) -> DataFrame:
    """Scores of the whole texts of all documents, with terms that they hold."""
    return v.raw("documents").select("doc_id", snippet_score(F.col("text"), (("tion", 1), ("ing ", 2)), ("***", "http")).cast("int").alias("score"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b(the|der|les|los|of|of the)\b', 1)) AS x, generate_subscripts(regexp_extract_all(text, '(?i)\b(the|der|les|los|of|of the)\b', 1), 1) AS place FROM (SELECT doc_id, regexp_replace(text, '[À-ɏ]', 'z', 'g') AS text FROM documents)),
  f AS (SELECT doc_id, lower(x), min(place) AS place, arg_min(x, place) AS x FROM w GROUP BY 1, 2) SELECT d.doc_id, coalesce(array_to_string(list(f.x ORDER BY f.place)[1:3], ','), '') AS named FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""", plain=True)
def p24_document_words(v: Views) -> DataFrame:
    """The first three listed words of each document, without repeats in another case."""
    return v.raw("documents").select("doc_id", F.array_join(T.education(F.col("text"), ("the", "der", "les", "los", "of", "of the")), ",").alias("named"))
