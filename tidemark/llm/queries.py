"""The registered queries of this package, ``(spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import chat, embeddings, exact_dedup as dedup, mixing, ngram_join as ngrams, pieces, phrases, quality as good, secrets, token_counts as counts, toxicity as toxic, urls, whitening
from tidemark.tables import table


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; TIDEMARK_TOKENIZERS names another folder."""
    folder = os.environ.get("TIDEMARK_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def turned_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all vectors and as many turned copies, each near its own: the table by itself may hold no link at all."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    turned = F.transform("embedding", lambda x, i: F.when(i == F.pmod("vec_id", F.lit(64)), x + 0.15).otherwise(x))
    return embeddings.near_vectors(v.unionByName(v.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), "label", turned.alias("embedding"))))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return good.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.ngram_join(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    read = pieces.decode(coded, model)
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select -1L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return chat.digests(chat.format_windows(turns.unionByName(extra)))


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_times") * F.col("_size")).alias("taken"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, secrets.BASE), F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


#: Fixed values.
RULES = (urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, bad`` of the pages whose path names a labelled document: bad if that is of low quality or toxic.

    A page shows the document whose id is the last number segment of its path.
    """
    ids = F.regexp_extract(urls.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    named = pages.select("url").distinct().select("url", F.nullif(ids, F.lit("")).cast("long").alias("doc_id"))
    return named.join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, page_labels(pages, table(spark, sf_dir, "labels")), RULES).drop("url")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_quality, op3_ngram_join, op4_exact_dedup, op5_sampled_pieces, op6_chat_windows, op7_weighted_mix, op8_secret_scan, op9_toxicity, op10_token_counts, op11_url_filter, op12_whitening, op13_collocations, turned_near_dedup)}

SQL = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE good AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
        reach AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.a),
        comp AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.c AS component_id, c.c = e.vec_id AS kept
        FROM embeddings e JOIN comp c ON c.a = e.vec_id""",
    "op3_ngram_join": """
        WITH RECURSIVE split AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
          FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
                 ELSE list_distinct([md5(array_to_string(w[i:i + 4], ' ')) FOR i IN range(1, len(w) - 3)]) END AS s FROM split),
        flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
        links AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS c FROM sets UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.a),
        comp AS (SELECT a, min(c) AS c FROM reach GROUP BY a),
        class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class_id FROM sets WHERE len(s) > 0)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, comp.c AS component_id, class.class_id
        FROM sets s JOIN comp ON comp.a = s.doc_id LEFT JOIN class ON class.doc_id = s.doc_id""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_chat_windows": """
        WITH RECURSIVE every AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        turns AS (
          SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
            length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 3 AS tokens,
            8 + length('<||>' || chr(10)) + length(replace(replace(replace(replace(role, '%', '%25'), '|', '%7C'), chr(10), '%0A'), '<', '%3C'))
            + length(replace(replace(replace(replace(replace(replace(replace(replace(text, '%', '%25'), '<|', '%3C|'), '</s>', '%3C/s>'), '<s>', '%3Cs>'),
                '<<SYS>>', '%3C<SYS>>'), '<</SYS>>', '%3C</SYS>>'), '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]')) AS chars,
            first_value(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER w AS has_system
          FROM every WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        sized AS (SELECT *, sum(CASE WHEN i <= has_system THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS fixed FROM turns),
        walk AS (
          SELECT conv_id, i, tokens AS used, 0 AS win FROM sized WHERE i = has_system + 1
          UNION ALL
          SELECT s.conv_id, s.i, CASE WHEN w.used + s.tokens > greatest(1, 512 - 128 - s.fixed) THEN s.tokens ELSE w.used + s.tokens END,
                 CASE WHEN w.used + s.tokens > greatest(1, 512 - 128 - s.fixed) THEN w.win + 1 ELSE w.win END
          FROM walk w JOIN sized s ON s.conv_id = w.conv_id AND s.i = w.i + 1),
        firsts AS (SELECT conv_id, win, min(i) AS first FROM walk GROUP BY ALL),
        back AS (
          SELECT f.conv_id, f.win, b.i, b.chars, b.has_system,
                 sum(b.tokens) OVER (PARTITION BY f.conv_id, f.win ORDER BY b.i DESC) AS cost
          FROM firsts f JOIN sized b ON b.conv_id = f.conv_id AND b.i < f.first AND b.i >= f.first - 2 AND b.i > b.has_system),
        repeats AS (
          SELECT conv_id, sum(chars) AS chars FROM back WHERE cost <= 128 GROUP BY conv_id),
        again AS (
          SELECT s.conv_id, s.chars * (SELECT max(win) FROM firsts f WHERE f.conv_id = s.conv_id) AS chars
          FROM sized s WHERE s.i = 1 AND s.has_system = 1)
        SELECT t.conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
          coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i), '')) AS loss_sha256,
          (sum(t.chars) + coalesce(any_value(r.chars), 0) + coalesce(any_value(a.chars), 0))::BIGINT AS formatted_chars,
          coalesce((SELECT max(win) + 1 FROM firsts f WHERE f.conv_id = t.conv_id), 1)::BIGINT AS n_windows
        FROM sized t LEFT JOIN repeats r ON r.conv_id = t.conv_id LEFT JOIN again a ON a.conv_id = t.conv_id
        GROUP BY t.conv_id""",
    "op8_secret_scan": """
        WITH rules(k, kind, pattern, of, least) AS (VALUES
            (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
            (1, 'access', 'AKIA[A-Z0-9]+', 0, 18), (2, 'hex', '[0-9a-f]+', 0, 16),
            (3, 'forge', 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 0), (4, 'chat', 'xox[abprs]-[A-Za-z0-9-]{10,}', 0, 0),
            (5, 'jwt', 'eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{5,}', 0, 0),
            (6, 'private', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 0)),
        texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        per AS (
          SELECT r, k, kind, least, regexp_extract_all(text, pattern, 0) AS m, string_split_regex(text, pattern) AS gaps,
                 CASE WHEN of = 2 THEN regexp_extract_all(text, pattern, 2) ELSE regexp_extract_all(text, pattern, 0) END AS tested
          FROM texts, rules WHERE regexp_matches(text, pattern)),
        spans AS (
          SELECT r, k, kind, i, length(tested[i]) >= least AS ok, length(m[i]) AS size,
                 list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS s
          FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM per)),
        found AS (SELECT r, k, kind, s::BIGINT AS s, kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT AS span FROM spans WHERE ok)
        SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
               coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans
        FROM texts t LEFT JOIN found f ON f.r = t.r GROUP BY t.r, t.doc_id""",
    "op13_collocations": """
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
          FROM documents),
        said AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
        f AS (
          SELECT lang, k, phrase, count(*) AS n FROM (
            SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
            FROM (SELECT lang, w, unnest(range(1, 5)) AS k FROM said) WHERE len(w) >= k)
          GROUP BY ALL HAVING count(*) >= 30 OR k = 1),
        candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        split AS (
          SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
          FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
        cuts AS (
          SELECT s.lang, s.phrase, s.a, s.cut, l.n AS l, r.n AS r, (2000000::HUGEINT * s.a) // (l.n + r.n) AS score
          FROM split s JOIN f l ON l.lang = s.lang AND l.phrase = s.head JOIN f r ON r.lang = s.lang AND r.phrase = s.tail),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inner_ AS (
          SELECT lang, a, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, k - m + 2)]) AS phrase
          FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates)),
        covered AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
        ranked AS (
          SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
          FROM best b LEFT JOIN covered c ON c.lang = b.lang AND c.phrase = b.phrase WHERE c.most IS NULL OR 100 * c.most < 80 * b.a)
        SELECT r.lang, rank, phrase, a, l, r.r, t.n, score::BIGINT AS score
        FROM ranked r JOIN (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang) t ON t.lang = r.lang WHERE rank <= 2000""",
    "op7_weighted_mix": """
        WITH sized AS (
          SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                 ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
        per AS (
          SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS most,
                 [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM sized GROUP BY source),
        levels AS (
          SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                 - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
        targets AS (
          SELECT source, source_size, CASE WHEN most <= level * weight THEN most
                 ELSE weight * (SELECT arg_min(level, most / weight) FROM levels WHERE most > level * weight) END AS target FROM levels),
        queue AS (
          SELECT s.doc_id, s.source, s.size, s.h, p.pass, t.target,
                 (p.pass * t.source_size + sum(s.size) OVER (PARTITION BY s.source, p.pass ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)) / t.target AS finish
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) p(pass) WHERE t.target > 0),
        taken AS (
          SELECT doc_id, source, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, pass, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM queue),
        times AS (
          SELECT doc_id, source, count(*) AS times FROM taken WHERE upto <= 1.5 * (SELECT sum(size) FROM sized) GROUP BY ALL)
        SELECT s.doc_id, s.size, t.source_size, t.target, (coalesce(x.times, 0) * s.size)::BIGINT AS taken
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        LEFT JOIN times x ON x.doc_id = s.doc_id AND x.source IS NOT DISTINCT FROM s.source""",
}

SQL["turned_near_dedup"] = SQL["op1_embedding_near_dedup"].replace("embeddings", "turned").replace(
    "WITH RECURSIVE",
    """WITH RECURSIVE turned AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings
          UNION ALL SELECT vec_id + 1000000000, label, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i = vec_id % 64 + 1 THEN x + 0.15 ELSE x END) FROM embeddings),""",
)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
