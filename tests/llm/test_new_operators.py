"""URL templates, whitening and collocations against plain versions, on rows with nulls, repeats, empty texts and clashing columns."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import phrases, urls, whitening
from tidemark.llm.queries import RULES, page_labels

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# phrases


def plain_counts(rows, most):
    found, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWERED)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    found[lang][tuple(w[i : i + k])] += 1
    return found, n


def plain_collocations(rows, conf):
    found, n = plain_counts(rows, conf.words)
    out = []
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= conf.least}
        kept = []
        for p, a in candidates.items():
            score, k = min((conf.scale * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and inside(q) and 100 * b >= conf.cover * a for q, b in candidates.items()):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[: conf.top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def some_texts(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "en", "de", "x" * 300, "<|end|>", "\u0000"] + [f"w{i}" for i in range(20)]
    passage = " ".join(rng.choice(words) for _ in range(90))
    rows = [(None, None), ("en", ""), ("en", " \t,.;"), (None, "a a a a a a"), ("und", "a a a"), ("", "q q q q"), ("en", "go " * 3000), ("de", "de en " * 200), ("en", "de en " * 200)]
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". ", "\x0b"]) for _ in range(rng.randint(1, 60)))
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice(["", "", passage + " "]) + text))
    return rows + rows[40:60]


@pytest.mark.parametrize(("seed", "conf"), [(1, phrases.Mining()), (2, phrases.Mining(least=4, modulus=3, longest=5)), (3, phrases.Mining(words=3, least=3, modulus=1, top=7)), (4, phrases.Mining(words=2, least=2, modulus=1 << 40, longest=1))])
def test_collocations(spark, seed, conf):
    rows = some_texts(seed)
    docs = spark.createDataFrame([(a, b, 1, "c") for a, b in rows], "lang string, text string, n int, chunk string").repartition(3)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(docs, conf).collect())
    assert got == plain_collocations(rows, conf)
    assert phrases.collocations(docs.where("false"), conf).count() == 0


def test_chunks_are_whole_and_count_each_word_once(spark):
    rows = some_texts(5)
    docs = spark.createDataFrame(rows, "lang string, text string")
    conf = phrases.Mining(modulus=4)
    _, n = plain_counts(rows, 1)
    chunks = phrases.parse(docs, conf).collect()
    got = Counter()
    for c in chunks:
        got[c.lang] += c.own * c.times
        assert c.own <= len(c.chunk.split(" ")) <= c.own + conf.words - 1
    assert got == +n
    assert len({(c.lang, c.chunk, c.own) for c in chunks}) == len(chunks)


# whitening


def plain_whitening(vectors, most):
    """Exact covariance in fractions, eigenvectors by numpy."""
    xs = [tuple(math.floor(float(np.float32(c)) * 256) for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(dim)]
    covariance = [[sum((Fraction(x[i]) - Fraction(sums[i], n)) * (Fraction(x[j]) - Fraction(sums[j], n)) for x in fit) / n for j in range(dim)] for i in range(dim)]
    values, vecs = np.linalg.eigh(np.array([[float(c) for c in row] for row in covariance]))
    values, vecs = values[::-1][:most], vecs[:, ::-1][:, :most]
    out = {}
    for k, x in enumerate(xs):
        centred = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums, strict=True)])
        out[k] = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), centred @ vecs / np.sqrt(values)
    return n, out, values / float(sum(covariance[i][i] for i in range(dim)))


def test_whitening(spark):
    rng = np.random.default_rng(4)
    vectors = [v.tolist() for v in (rng.normal(size=(90, 6)) @ np.diag([3, 2, 1.5, 1, 0.5, 0.2])).astype(np.float32)]
    vectors += vectors[:9] + [[-0.0] * 6]
    rows = [(i if i else None, v, 7, "x") for i, v in enumerate(vectors)]
    bad = [(900, None, 0, ""), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0, ""), (902, [float("nan")] * 6, 0, ""), (903, [float("-inf")] * 6, 0, ""), (904, [], 0, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n long, component string").repartition(4)
    got = whitening.whiten(df).collect()
    n, want, explained = plain_whitening(vectors, 4)
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n}
    turned = defaultdict(list)
    for r in got:
        deviation, whitened = want[r.vec_id or 0]
        assert r.deviation == deviation
        assert abs(r.whitened) == pytest.approx(abs(whitened[r.component - 1]), rel=1e-9, abs=1e-9)
        turned[r.component].append(np.sign(r.whitened) == np.sign(whitened[r.component - 1]) or abs(r.whitened) < 1e-12)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-12)
        assert r.identity_error < 1e-12
    assert all(all(t) or sum(t) <= 2 for t in turned.values())
    assert whitening.whiten(df.where("false")).count() == 0


def test_whitening_of_equal_vectors_other_lengths_and_giant_entries(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (4, [2.0, 2.0, 3.0]), (5, [3.0, 3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert Counter(r.vec_id for r in got) == {3: 2, 4: 2, 5: 2}  # vectors of two entries do not vary; those of three do in two directions
    assert {r.n for r in got} == {3}
    giant = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None for r in giant if r.vec_id != 3) and all(math.isfinite(r.whitened) for r in giant)


@pytest.mark.parametrize("gap", [0.1, 1e-4, 1e-7, 1e-10, 1e-13, 0.0])
def test_eigenvectors_of_clustered_eigenvalues(gap):
    rng = np.random.default_rng(8)
    values = np.concatenate([2 + gap * np.arange(5), np.linspace(0.1, 1.5, 15), 3 + gap * np.arange(4)]).astype(np.longdouble)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(4):  # orthogonal to long double
        q = q @ (3 * np.eye(len(q), dtype=q.dtype) - q.T @ q) / 2
    a = (q * values) @ q.T
    got, x = whitening.eigen((a + a.T) / 2)
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-17
    assert np.abs(x.T @ x - np.eye(len(x))).max() < 1e-17
    assert np.abs(a @ x - x * got).max() < 1e-17
    if gap >= 1e-10:
        turned = q[:, np.argsort(-values)]
        assert np.abs(np.abs((turned * x).sum(axis=0)) - 1).max() < 1e-15


# urls


def plain_tree(paths, conf):
    """``{(host, path): (template tokens, purity)}`` from ``{(host, path): (bad, seen)}``."""
    segs = {k: k[1].removeprefix("/").split("/") if k[1] else [] for k in paths}
    tokens = {k: () for k in paths}
    for level in range(conf.depth):
        count, parent = Counter(), Counter()
        for k, s in segs.items():
            if len(s) > level:
                count[k[0], tokens[k], s[level]] += 1
                parent[k[0], tokens[k]] += 1
        for k, s in segs.items():
            if len(s) > level:
                c = count[k[0], tokens[k], s[level]]
                ending = re.search(urls.ENDINGS, s[level])
                token = s[level] if c >= conf.least and c >= parent[k[0], tokens[k]] * conf.share else "*" + (ending.group() if ending else "")
                tokens[k] += (token,)
    for k, s in segs.items():
        if len(s) > conf.depth:
            tokens[k] += ("**",)
    total = [sum(v[i] for v in paths.values()) for i in (0, 1)]
    everywhere = total[0] / total[1] if total[1] else 0.0
    smooth = lambda b, n, above: (b + above * conf.prior) / (n + conf.prior)
    stats = defaultdict(lambda: [0.0, 0.0])
    for k, t in tokens.items():
        for level in range(len(t) + 1):
            for i in (0, 1):
                stats[k[0], t[:level]][i] += paths[k][i]
    purity = {k: smooth(*v, everywhere) for k, v in stats.items() if not k[1]}
    for level in range(1, conf.depth + 2):
        children = defaultdict(list)
        for (host, t), (b, n) in stats.items():
            if len(t) == level:
                children[host, t[:-1]].append(((b + 0.5) / (n + 1), t[-1], b, n))
        for (host, t), items in children.items():
            groups = []
            for _, token, b, n in sorted(items):
                if groups and n and groups[-1][2]:
                    members, gb, gn = groups[-1]
                    p = (gb + b) / (gn + n)
                    spread = p * (1 - p) * (1 / gn + 1 / n)
                    if spread == 0 or (gb / gn - b / n) ** 2 < conf.alike * spread:
                        groups[-1] = [[*members, token], gb + b, gn + n]
                        continue
                groups.append([[token], b, n])
            for members, b, n in groups:
                for token in members:
                    purity[host, (*t, token)] = smooth(b, n, purity[host, t])
    return {k: (t, purity[k[0], t]) for k, t in tokens.items()}


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(LOWERED), re.match(r"[^?#]*", rest[len(host) :]).group()


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)


ODD = [None, "", "no scheme/x", "http://", "HTTP://WWW.Example.NET", "x://Example.net/en/1?q=/#f", "http://a.example.net/en", "http://badnet/", "http://net/", "http://net?x", "http://my.net#a/b", "a://b://c/d", "http://org/fr/", "http://é.org/fr/ü", "http://h.org:80/fr/x", "http://e.com/" + "a/" * 40]


def test_url_filter(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        host = rng.choice(["a.com", "a.com", "b.com", "shop.example.com", "c.org"])
        kind = rng.choice(["tag", "article", "user"])
        url = f"http://{host}/{kind}/{rng.randint(1, 400)}" + rng.choice(["", "/", ".html", "/photos", "?x=1"])
        rows.append((i, url, "h", "v"))
        if rng.random() < 0.4:
            labels.append((url, rng.random() < {"tag": 0.95, "article": 0.03, "user": 0.1 if host != "b.com" else 0.9}[kind]))
    rows += [(None if k == 3 else 9000 + k, u, "h", "v") for k, u in enumerate(ODD)] + rows[:50]
    labels += [(None, True), ("http://unknown.com/x", True), (rows[0][1], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string").repartition(3)
    marked = spark.createDataFrame(labels, "url string, bad boolean")
    rules = [*RULES, urls.Rule("block", "badnet", "/")]
    got = urls.judge(pages, marked, rules).collect()
    assert len(got) == len(rows) and got[0].__fields__[:4] == ["page_id", "url", "host", "verdict"]
    paths = {plain_parts(u): [0.0, 0.0] for _, u, *_ in rows}
    for u, bad in labels:
        if bad is not None and plain_parts(u) in paths:
            paths[plain_parts(u)][0] += bad
            paths[plain_parts(u)][1] += 1
    tree = plain_tree(paths, urls.Templates())
    for r in got:
        host, path = plain_parts(r.url)
        assert (r._host, r.path) == (host, path)
        rule = plain_rule(host, path, rules)
        assert r.rule == (rule.name if rule else None)
        assert r.purity == pytest.approx(tree[host, path][1], abs=1e-12)
        if rule or abs(r.purity - 0.5) > 1e-9:
            assert r._verdict == (rule.action if rule else "block" if r.purity >= 0.5 else "allow"), r
    judged = {(r._host, r.path.split("/")[1]): r._verdict for r in got if r._host in ("a.com", "b.com") and r.path.count("/") == 2 and r.path[-1].isdigit()}
    assert judged == {("a.com", "tag"): "block", ("a.com", "article"): "allow", ("a.com", "user"): "allow", ("b.com", "tag"): "block", ("b.com", "article"): "allow", ("b.com", "user"): "block"}
    assert urls.judge(pages.where("false"), marked, rules).count() == 0
    unlabelled = urls.judge(pages, marked.where("false"), rules)
    assert unlabelled.where("rule is null and _verdict = 'block'").count() == 0


def test_page_labels(spark):
    pages = spark.createDataFrame([("http://a/en/5",), ("http://a/en/6.html?x=9",), ("http://a/en/7/",), ("http://a/en/x",), (None,), ("http://a/99999999999999999999",)], "url string")
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    assert {(r.url, r.bad) for r in page_labels(pages, labels).collect()} == {("http://a/en/5", False), ("http://a/en/6.html?x=9", True), ("http://a/en/7/", True)}
