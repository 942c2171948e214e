"""Each operator against brute force, on rows with nulls, repeats, empty and very long texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, embeddings, exact_dedup, mixing, ngram_join, pieces, quality, secrets, token_counts, toxicity
from tidemark.llm.members import without
from tidemark.llm.queries import tokenizer_file

TEXTS = [
    None, "", " \t\n", "one two three", "ONE two\nthree", "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s x",
    "A b c d e f g h i j k l m n o p q r s t", "long " * 30_000, "w" * 70_000, "é 你好 😀 ▁ <|endoftext|> ![CDATA", "one two three", "'ll don't  x   \n\n y ", "\u0000\x0b\x0c z",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["s0", None, "s2"][i % 3], -1, "clash", [1]) for i, t in enumerate(TEXTS)] + [(3, "one two three", "en", "s0", -1, "clash", None), (None, "one two three", None, None, 0, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, ids array<int>").repartition(3)


def links_of(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_ngram_join_edge_cases(spark, docs):
    got = ngram_join.ngram_join(docs).collect()
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    want = links_of(sets)
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 1
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(sets[r.doc_id])), r
    assert ngram_join.ngram_join(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_random_edits(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([8, 30, 90]))]
        for _ in range(rng.choice([1, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    for n in (8, 12, 15, 18, 22, 30):
        texts += [" ".join(passage + [rng.choice(words) for _ in range(n)]) for _ in range(8)]
    if seed == 2:  # one passage that 200 documents share, and an original with 60 copies, near and less near, whose links need not pass through it
        texts += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(20, 90))]) for _ in range(200)]
        base = [f"b{i}" for i in range(80)]
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df, ngram_join.Join(slots=1 << 12, part=5, block=16)).collect()}
    assert got == links_of({i: shingles(t) for i, t in enumerate(texts)})


def test_ngram_join_writes_no_whole_sets(spark, monkeypatch):
    """A set holds 8 bytes for each word: written sets were most of what the join left in the shared folder."""
    written, plain = [], ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, *by: written.append(df.schema.simpleString()) or plain(df, *by))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:55], f"x{i}", *words[55:]])) for i in range(6)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and written and not [w for w in written if "array" in w]


def test_ngram_join_short_texts_below_a_longer_head(spark):
    """Pairs of 3 to 8 shingles whose prefixes are made for one match, each with a document that holds more lists and links with neither."""
    rng = random.Random(3)
    filler = [f"f{i}" for i in range(35)]
    texts = []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(rng.choice([7, 8, 9, 10, 11]))]
        edited = list(base)
        edited[rng.randrange(len(base))] = f"g{g}x"
        texts += [" ".join(t) for t in (base, [*base, f"g{g}y"], edited, base + filler)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df, ngram_join.Join(few=1)).collect()}
    assert got == links_of({i: shingles(t) for i, t in enumerate(texts)})


def test_exact_dedup(spark, docs):
    got = exact_dedup.exact_dedup(docs, slots=1024).collect()
    groups = Counter((r.text or "") for r in docs.collect())
    most = {}
    for r in docs.collect():
        most[r.text or ""] = max(most.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == docs.count()
    for r in got:
        t = sha[r.text_sha256]
        assert (r.group_size, r.keep_id, r.kept) == (groups[t], most[t], r.doc_id == most[t])
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.text or "") for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(docs.where("false")).count() == 0


def test_exact_dedup_by_ranges_of_hashes(spark):
    """A filter too small for all rows is used for one range of hashes after another; it stays selective and the result exact."""
    df = spark.createDataFrame([(i, f"text {i % 900}") for i in range(1000)], "doc_id long, text string")
    one = sorted(map(tuple, exact_dedup.exact_dedup(df).collect()))
    assert sorted(map(tuple, exact_dedup.exact_dedup(df, slots=1 << 10).collect())) == one
    assert sorted(r.doc_id for r in exact_dedup.keep_one(df, slots=1 << 10).collect()) == list(range(100, 1000))
    flagged = exact_dedup.flag_repeats(df.select(F.xxhash64("text").alias("h")), "h", 1 << 10)
    assert 200 <= flagged.where("maybe_repeated").count() <= 500


def test_without(spark):
    df = spark.createDataFrame([(i, i) for i in range(100)] + [(None, 1)], "doc_id long, _gone long")
    kept = without(df.withColumnRenamed("_gone", "x"), "doc_id", df.where("doc_id % 3 = 0").select("doc_id"))
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted([-1, *(i for i in range(100) if i % 3)])


def linked_vectors(rows):
    """Links of each row, and the smallest id it reaches, by comparing every pair."""
    fits = [r[1] is not None and len(r[1]) and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None and r[0] is not None for r in rows]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if f else None for r, f in zip(rows, fits)]
    near = [[j for j in range(len(rows)) if j != i and fits[i] and fits[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(len(rows))]
    low = [r[0] for r in rows]
    while True:
        new = [min([low[i], *(low[j] for j in near[i])]) if fits[i] else low[i] for i in range(len(rows))]
        if new == low:
            return [len(x) for x in near], low
        low = new


@pytest.mark.parametrize("parts", [1, 3])
def test_embeddings(spark, parts):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in base[i % 6] + rng.normal(size=16) * 0.05 * (i % 5)], i % 2) for i in range(200)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0] * 15 + [float("inf")], 1), (1004, rows[0][1], None), (1005, rows[0][1], 0), (1005, rows[0][1], 0), (1005, rows[1][1], 1)]
    rows += [(1006, [1.0, 2.0], 0), (1007, [None] * 16, 0), (1008, [2.0, 4.0], 0), (1009, [1.0, 2.0, 0.0], 0), (1010, [], 0), (None, rows[0][1], 0), (1011, [1.0, 2.0], 1), (1012, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, keys string, row int").repartition(parts)
    got = embeddings.near_vectors(df, embeddings.Lsh(block=16)).collect()
    n, low = linked_vectors(rows)
    want = sorted((str(r[0]), k, c, c == r[0]) for r, k, c in zip(rows, n, low))
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == want
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_equal_vectors_stand_as_one(spark):
    df = spark.range(5000).select((F.col("id") + 7).alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("embedding"), F.lit(1).alias("label"))
    df = df.unionByName(spark.createDataFrame([(1, [1.0, 2.0, 3.01], 1), (2, [3.0, 2.0, 1.0], 1)], df.schema))
    got = embeddings.near_vectors(df).groupBy("n_links", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 2, 1), (5000, 1, 5001)]


def test_recall_just_above_the_threshold(spark):
    """Of each vector of the table a copy turned by a random angle to a cosine of 0.98 to 0.99: nearly all such pairs must be found."""
    rng, rows = np.random.default_rng(9), []
    for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect():
        v = np.array(r.embedding, np.float64)
        v /= np.linalg.norm(v)
        off = rng.normal(size=len(v))
        off -= (off @ v) * v
        cosine = rng.uniform(0.98001, 0.99)
        rows += [(r.vec_id, v.tolist(), r.label), (r.vec_id + 10_000, (cosine * v + (1 - cosine**2) ** 0.5 * off / np.linalg.norm(off)).tolist(), r.label)]
    n, low = linked_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert sum(n) >= 900 and sum(k for k, _ in got.values()) >= 0.998 * sum(n)
    assert all(got[r[0]][0] <= k and got[r[0]][1] >= c for r, k, c in zip(rows, n, low))


def test_links_without_a_common_bucket_are_found(spark):
    """With one table most links share no bucket; the exact check over blocks of some vectors each finds them all."""
    rng, rows = np.random.default_rng(4), []
    for i in range(60):
        v = rng.normal(size=16)
        rows += [(10 * i + k, (v + 0.09 * rng.normal(size=16)).tolist(), i % 2) for k in range(4)]
    n, low = linked_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df, embeddings.Lsh(tables=1, block=16, whole=25)).collect()}
    assert sum(n) > 300 and got == {r[0]: (k, c) for r, k, c in zip(rows, n, low)}


def test_embeddings_of_several_lengths_in_one_batch(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.01], 0), (3, [1.0, 2.0, 0.0], 0), (4, [1.0, 2.0, 0.01], 0), (5, [1.0, 2.0, 3.0, 4.0], 0), (6, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6)}


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    held = Tokenizer.from_file(path)
    count = lambda t: len(held.encode(t or "", add_special_tokens=False).ids)
    got = token_counts.token_counts(docs, path).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((len((r.text or "").encode()), count(r.text), count(r.text) > 512) for r in docs.collect())
    bpe = token_counts.load(path)
    held_ = [("a   b\n\n\n c x <|endoftext|> y !!<|endoftext|>!! <|endo don't we'll  they've   " if t is None else t)[:400] for t in TEXTS]
    for t, prefixes in zip(held_, bpe.prefix_counts(held_), strict=True):
        every = [count(t[:i]) for i in range(len(t) + 1)]
        assert [prefixes.at(i) for i in range(len(t) + 1)] == every, t
        for budget in (0, 1, 5, 17, 60):
            assert prefixes.cut(budget) == max(i for i, n in enumerate(every) if n <= budget)
    for r in token_counts.prefix_counts(docs, path, [3, 10]).collect():
        text = next(x.text for x in docs.where(F.col("doc_id").eqNullSafe(r.doc_id)).collect()) or ""
        assert all(count(text[: r.cuts[b]]) <= b and (r.cuts[b] == len(text) or b < r.n_tokens) for b in (3, 10))
    assert token_counts.token_counts(docs.where("false"), path).count() == 0


def test_pieces_round_trip_and_repeat(spark, docs):
    model = tokenizer_file("piece_bpe_32k.model")
    coded = pieces.encode(docs.drop("ids"), model)
    read = pieces.decode(coded, model).collect()
    assert all(r.decoded == (r.text or "") for r in read)
    key = lambda r: (str(r.doc_id), r.text or "")
    again = {key(r): r.ids for r in pieces.encode(docs.drop("ids").repartition(1), model).collect()}
    assert all(again[key(r)] == r.ids for r in read)
    other = pieces.encode(docs.drop("ids").where("doc_id = 8"), model, alpha=0.3, seed=5).first().ids
    assert other != again["8", TEXTS[8]]


def test_pieces_follow_the_lattice_distribution():
    held = pieces.load(tokenizer_file("piece_bpe_32k.model"))
    weights = {held.raw[i]: (i, held.weight[i]) for i in range(len(held.raw)) if np.isfinite(held.weight[i])}

    def ways(b):
        if not b:
            yield (), 0.0
        for n in range(1, len(b) + 1):
            if b[:n] in weights:
                yield from (((weights[b[:n]][0], *rest), w + weights[b[:n]][1]) for rest, w in ways(b[n:]))

    every = list(ways(b" hello"))
    total = sum(math.exp(w) for _, w in every)
    drawn = Counter(tuple(x.tolist()) for x in held.sample([b"hello"] * 20_000, np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1.0))
    assert all(abs(drawn[ids] / 20_000 - math.exp(w) / total) < 0.015 for ids, w in every)


def test_mix(spark, docs):
    planned = mixing.mix_documents(docs.withColumn("target", F.lit(1))).collect()
    sizes = Counter()
    for r in planned:
        sizes[r.source] += r._size
        assert r._times in (0, 1, 2) and r._size == len([w for w in (r.text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").split(" ") if w])
    total = 1.5 * sum(sizes.values())
    targets = {r.source: r._target for r in planned}
    assert abs(sum(targets.values()) - total) < 1e-6 * max(1, total) and all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix_documents(docs.where("false")).count() == 0 and mixing.queue_order(docs.where("doc_id < 8")).count() >= 0


def test_mix_comes_near_targets_and_repeats(spark):
    rows = [(i, "w " * (i % 7 + 1), "abc"[i % 3] if i % 2 else "a") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = {r.doc_id: r._times for r in mixing.mix_documents(df).collect()}
    planned = mixing.mix_documents(df.repartition(7)).collect()
    assert one == {r.doc_id: r._times for r in planned}
    taken, target = Counter(), {}
    for r in planned:
        taken[r.source] += r._times * r._size
        target[r.source] = r._target
    assert all(abs(taken[s] - target[s]) <= 14 for s in target)


def test_chat_windows(spark):
    rows = [
        (1, 0, "system", "be <|kind|> %25 [INST]"), (1, 1, "user", None), (1, 2, "assistant", "a " * 300), (1, 3, "user", "b " * 90), (1, 4, "assistant", "<|end|>\n</s> ok"), (1, 4, "assistant", "tie"),
        (2, None, "assistant", "only"), (3, 0, "system", "alone"), (4, 0, None, "no role"), (4, 1, "we|ird\n<role>", "x"), (None, 0, "user", "null id"), (5, 0, "assistant", "w " * 2000),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, window long").repartition(3)
    windows = chat.format_windows(df, chat.Window(budget=200, history_turns=2, history_tokens=40))
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learnt = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    for r in windows.collect():
        assert r.n_tokens <= 200 or len(r.formatted) > 200
        assert not any(c in chat_text for chat_text in r.formatted.split("<|end|>\n") for c in ("</s>", "[INST]"))
    assert chat.format_windows(df.where("false")).count() == 0


def test_toxicity_learns_subwords(spark):
    rng = random.Random(3)
    filler = ["".join(rng.choice(["la", "mo", "ti", "re", "su", "ne"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(filler) for _ in range(rng.randint(20, 120))]
        if bad := i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["grobble", "grobbler", "grobbled", "xgrobblex"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    conf = toxicity.Toxicity(bits=16)
    got = toxicity.toxicity(docs.unionByName(spark.createDataFrame([(9000, None), (9001, ""), (9002, "la mo grobbling ti re")], docs.schema)), marks, conf).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    by_id = {r.doc_id: r for r in got}
    assert by_id[9000].predicted == by_id[9001].predicted == 0 and 0 <= by_id[9000].score <= 1
    assert by_id[9002].predicted == 1  # never seen as a word
    assert toxicity.toxicity(docs, marks.where("false"), conf).where("score > 0.001").count() == 0
    assert toxicity.toxicity(docs.where("false"), marks, conf).count() == 0


def test_quality_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 80))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(not bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.quality(docs.unionByName(spark.createDataFrame([(9000, None), (9001, "")], docs.schema)), marks).collect()
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert sum(r.predicted == int(r.doc_id % 5 != 0) for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality(docs.limit(5), marks.where("false")).collect()} == {0.0}
    assert quality.quality(docs.where("false"), marks).count() == 0


def plain_features(text, window):
    """The quality features of one text, in plain Python."""
    raw = text.encode()
    words = [w for w in raw.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    if not words:
        return dict.fromkeys(quality.NAMES, 0.0)
    n, low = len(words), [w.lower() for w in words]
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    marks = [sum(c in quality.MARKS for c in w) for w in words]
    shout = [sum(65 <= c <= 90 for c in w) >= 2 and not any(97 <= c <= 122 for c in w) for w in words]
    parts = [slice(i, i + window) for i in range(0, n, window)]
    out = {f"mark_{chr(c)}": raw.count(c) / len(raw) for c in quality.MARKS}
    high = sum(c >= 0xC0 for c in raw)
    big = lambda p: len(words[p]) >= min(window, 16)
    fresh = [len(set(low[p])) for p in parts]
    return out | {
        "letters": (upper + lower + high) / len(raw), "upper": upper / max(1, upper + lower), "digits": sum(48 <= c <= 57 for c in raw) / len(raw),
        "high_bytes": high / len(raw), "spaces": raw.count(32) / len(raw), "newlines": raw.count(10) / len(raw),
        "word_length": sum(map(len, words)) / n / 10, "long_words": sum(len(w) > 20 for w in words) / n, "distinct_words": sum(fresh) / n,
        "same_as_before": sum(a == b for a, b in zip(low, low[1:])) / n, "same_as_two_before": sum(a == b for a, b in zip(low, low[2:])) / n,
        "words_upper": sum(shout) / n, "words_marked_end": sum(m >= 2 for m in marks) / n, "words_all_marks": sum(m == len(w) for m, w in zip(marks, words)) / n,
        "line_words": min(1, n / (raw.count(10) + 1) / 100), "log_words": math.log1p(n) / 10,
        "most_marks": max(sum(m >= 2 for m in marks[p]) / len(marks[p]) if big(p) else 0 for p in parts),
        "most_upper": max(sum(shout[p]) / len(shout[p]) if big(p) else 0 for p in parts),
        "least_distinct": max(-f / len(words[p]) if big(p) else -1 for f, p in zip(fresh, parts)),
    }


def test_quality_features_risk_and_scores_equal_plain_versions(spark):
    rng = random.Random(8)
    texts = ["", " ", "One two, TWO two!! a\nb", "é 你好 ABC ABC 12", *(" ".join(rng.choice(["ab", "Cd!", "EF", "x,y..", "w" * 25, "9"]) for _ in range(n)) for n in (15, 16, 17, 40, 130))]
    got = quality.features([t.encode() for t in texts], 64)
    for row, t in zip(got, texts, strict=True):
        want = plain_features(t, 64)
        assert np.allclose(row, [want[k] for k in quality.NAMES]), (t[:40], [k for k, v in zip(quality.NAMES, row) if not math.isclose(v, want[k], abs_tol=1e-9)])
    gen = np.random.default_rng(1)
    layers, x = [gen.normal(size=s) for s in ((3, 4), 4, 4, ())], gen.normal(size=(30, 3))
    for prior, non_negative in ((0.3, True), (0.95, True), (0.95, False)):
        first, second = quality.risk(layers, x, 10, prior)
        aim = (lambda r: -r[1]) if non_negative and second < 0 else sum
        grads = quality._gradient(layers, x, 10, prior, 0.0, non_negative)
        for i, g in enumerate(grads):
            for at in np.ndindex(np.shape(g)):
                ends = []
                for step in (1e-6, -1e-6):
                    moved = [np.array(y) for y in layers]
                    moved[i][at] += step
                    ends.append(aim(quality.risk(moved, x, 10, prior)))
                assert math.isclose((ends[0] - ends[1]) / 2e-6, np.asarray(g)[at], rel_tol=1e-4, abs_tol=1e-7)


def test_toxicity_scores_equal_a_plain_version():
    conf = toxicity.Toxicity(bits=12)
    value = np.random.default_rng(2).normal(size=1 << 12).astype(np.float32)
    rng = random.Random(4)
    texts = ["", "one", "One one two", "a bb ccc dddd eeeee " * 9, " ".join(rng.choice(["grob", "bler", "été", "x"]) + str(rng.randint(0, 40)) for _ in range(50)), "z" * 3000 + " y"]

    def bucket(code, n=None):
        h = (code + n) & (2**64 - 1) if n else code
        return int(toxicity.mix(np.array([h], np.uint64))[0] >> np.uint64(64 - conf.bits)) if n else int(np.uint64(h) >> np.uint64(64 - conf.bits))

    def plain(text):
        words = [w for w in bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split(b" ") if w]
        feats = []
        for w in words:
            own = [bucket(int(toxicity.Spans(np.frombuffer(w, np.uint8)).of(np.array([0]), np.array([len(w)]))[0]))]
            padded = b" " + w + b" "
            for n in toxicity.GRAMS:
                own += [bucket(int.from_bytes(padded[i : i + n]), n) for i in range(len(padded) - n + 1)]
            feats.append(own)
        last = max(0, len(words) - conf.window)
        starts = sorted({min(s, last) for s in range(0, last + conf.window // 2, conf.window // 2)}) if words else []
        means = [np.mean([value[b] for f in feats[s : s + conf.window] for b in f], dtype=np.float64) for s in starts]
        return 1 / (1 + math.exp(-(max(means) + 0.25))) if means else 1 / (1 + math.exp(1.0))

    got = toxicity.Model(value, 0.25, conf)(texts)
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-5)


def test_windows_of_a_conversation_of_very_many_turns(spark):
    """Greedy windows of 20,000 turns, against a walk; every target text is learnt once."""
    conf = chat.Window(budget=64, history_turns=2, history_tokens=16)
    rows = [(1 if i % 3 else None, i, "system" if i == 1 else ("user", "assistant")[i % 2], f"w{i} " * (i % 9), "x") for i in range(30_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = sorted(((r.conv_id or 0, r.window, r.n_context, r.n_tokens, len(r.loss)) for r in chat.format_windows(turns, conf).collect()))
    want = []
    for conv in (1, None):
        own = [(r[2], len(r[3].split()) + chat.MARKS) for r in rows if r[0] == conv]
        system = int(own[0][0] == "system")
        room, starts, used = max(1, conf.budget - conf.history_tokens - (own[0][1] if system else 0)), [], 0
        for i in range(system, len(own)):
            if not starts or used + own[i][1] > room:
                starts.append(i)
                used = 0
            used += own[i][1]
        for w, begin in enumerate(starts):
            end = starts[w + 1] if w + 1 < len(starts) else len(own)
            back = next(b for b in range(max(system, begin - conf.history_turns), begin + 1) if sum(n for _, n in own[b:begin]) <= conf.history_tokens)
            shown = own[:system] + own[back:end]
            context = (system if w else 0) + begin - back
            want.append((conv or 0, w, context, sum(n for _, n in shown), sum(r == "assistant" for r, _ in shown[context:])))
    assert got == sorted(want)


def test_hash_ranges_flag_what_one_filter_flags(spark):
    rng = random.Random(7)
    values = [rng.getrandbits(62) for _ in range(3000)]
    values += values[:50] + [5] * 4000
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "h long, n int").repartition(5)
    times = Counter(values)
    for slots in (256, 4096, 1 << 20):
        got = exact_dedup.flag_repeats(rows, "h", slots).collect()
        assert len(got) == len(values) and all(r.maybe_repeated for r in got if times[r.h] > 1)
        assert sum(r.maybe_repeated for r in got if times[r.h] == 1) < 400, slots


def test_pieces_of_several_spaces_are_drawn(spark):
    model = tokenizer_file("piece_bpe_32k.model")
    texts = ["a" + " " * n + "b" for n in (0, 1, 2, 3, 17, 63, 64, 65, 300)] + [" " * 200, "   lead", "tail   "]
    docs = spark.createDataFrame([(i, t) for i in range(6) for t in texts], "doc_id long, text string")
    held = pieces.load(model)
    rows = pieces.decode(pieces.encode(docs, model), model).collect()
    assert all(r.decoded == r.text for r in rows)
    drawn = {held.raw[i] for r in rows for i in r.ids}
    assert {b"  ", b" " * 16} <= drawn


def test_toxicity_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    table, soft, bias = rng.normal(size=(40, 3)), rng.normal(size=(2, 3)), rng.normal(size=2)
    n = np.array([3, 1, 7, 4])
    at, target = rng.integers(0, 40, n.sum()), np.array([0, 1, 1, 0])
    loss, pull, grad_soft, grad_bias = toxicity.gradient(table, soft, bias, at, n, target)
    exact = {"table": pull[:, None] * (soft[1] - soft[0]), "soft": grad_soft, "bias": grad_bias}
    for name, array in (("table", table), ("soft", soft), ("bias", bias)):
        for place in np.ndindex(array.shape):
            ends = []
            for h in (1e-6, -1e-6):
                array[place] += h
                ends.append(toxicity.gradient(table, soft, bias, at, n, target)[0])
                array[place] -= h
            assert math.isclose((ends[0] - ends[1]) / 2e-6, exact[name][place], rel_tol=1e-5, abs_tol=1e-7)
    assert loss > 0


def test_toxicity_finds_passages_at_any_place_of_texts_of_any_length():
    rng = random.Random(9)
    clean = [f"{a}{b}" for a in ("mo", "ti", "re", "la", "su") for b in ("lan", "der", "wit", "por", "nes", "kal")]
    vile = [f"grob{x}" for x in ("ling", "bler", "nak", "fitz")]

    def text(words, place):
        out = [rng.choice(clean) for _ in range(words)]
        if place is not None:
            out[int(place * (words - 8)) : int(place * (words - 8)) + 8] = [rng.choice(vile + clean[:3]) for _ in range(5)] + [rng.choice(vile) for _ in range(3)]
        return " ".join(out)

    lengths = (10, 60, 400, 3000)
    texts = [text(rng.choice(lengths), rng.random() if i % 3 == 0 else None) for i in range(420)]
    model = toxicity.fit(texts, np.array([i % 3 == 0 for i in range(420)]).astype(int), toxicity.Toxicity(bits=14))
    for words in (*lengths, 12_000):
        for place in (0, 0.31, 0.5, 0.77, 1):
            assert (model([text(words, place) for _ in range(8)]) >= 0.5).mean() >= 0.85, (words, place)
        assert (model([text(words, None) for _ in range(20)]) >= 0.5).mean() <= 0.1, words


def test_toxicity_learns_from_whole_texts_within_a_bound(spark):
    rows = [(i, "w" * (1000 if i == 3 else 10)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    texts, marks = toxicity.sample(docs, labels, "toxic", lambda c: F.lit(False), {0: 5, 1: 5}, 75)
    assert sorted(map(len, texts)) == [10] * 7 and abs(int(marks.sum()) * 2 - 7) == 1


def test_held_out_accuracy_on_the_table(spark):
    """Few labels here: quality was measured at 84 of 94 held-out rows right (5089 of 5099 on check_s)."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    for scored, mark, least in ((quality.quality(docs, labels), "quality", 0.85), (toxicity.toxicity(docs, labels), "toxic", 0.9)):
        held = scored.where("held_out").join(labels, "doc_id").select("predicted", F.col(mark).alias("mark")).collect()
        assert sum(r.predicted == r.mark for r in held) / len(held) >= least


CLASHES = "h _h H maybe maybe_repeated _maybe gone _gone sha _sha key _key part size _size source_size _source_size target _target times _times last _last of copy _copy score _score _toxicity ids t tokens n component class_id spans features v row keys"


def with_clashes(df):
    seen = {c.lower() for c in df.columns}
    names = [c for c in dict.fromkeys(CLASHES.split()) if not (c.lower() in seen or seen.add(c.lower()))]
    return df.withColumns({c: F.lit(f"{c}!") for c in names})


def test_columns_of_any_name_come_through_and_change_nothing(spark, docs):
    model, path = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.json")
    docs = docs.drop("h", "ids").where("length(text) < 1000 or text is null")
    more = with_clashes(docs)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, toxic int, quality int")
    rows = lambda df, columns: sorted(str([r[c] for c in columns]) for r in df.collect())
    for keep in (exact_dedup.keep_one, mixing.mixed, lambda d: without(d, "doc_id", labels.where("doc_id < 5").select("doc_id"))):
        got = keep(more)
        assert got.columns == more.columns and rows(got, docs.columns) == rows(keep(docs), docs.columns)
        assert rows(got.select("_maybe", "h", "source_size").distinct(), ["_maybe", "h", "source_size"]) == ["['_maybe!', 'h!', 'source_size!']"]
        assert keep(more.where("false")).count() == 0
    for run in (
        lambda d: exact_dedup.exact_dedup(d), lambda d: ngram_join.ngram_join(d), lambda d: mixing.mix_documents(d).select("doc_id", "_size", "_times", "_target"),
        lambda d: pieces.encode(d, model).select("doc_id", "ids"), lambda d: token_counts.token_counts(d, path), lambda d: secrets.secret_spans(d),
        lambda d: toxicity.toxicity(d, labels), lambda d: quality.quality(d, labels),
    ):
        plain = run(docs)
        assert rows(run(more), plain.columns) == rows(plain, plain.columns) and run(more.where("false")).count() == 0
