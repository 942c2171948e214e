from __future__ import annotations

from collections import Counter

import numpy as np

import corpus_pipeline
from tidemark.llm import mixing, pieces, toxicity
from tidemark.llm.queries import tokenizer_file
from tests.llm.test_operators import links_of, shingles

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_what_brute_force_keeps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, FOLDER)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    once = stages["exact_dedup"](spark, docs, FOLDER)
    most: dict[str, int] = {}
    for r in docs.collect():
        most[r.text or ""] = max(most.get(r.text or "", -1), r.doc_id)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == sorted(most.values())
    near = stages["near_dedup"](spark, once, FOLDER)
    want = links_of({r.doc_id: shingles(r.text) for r in once.collect()})
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == sorted(set(want.values()))
    mixed = stages["mix"](spark, near, FOLDER)
    times = {r.doc_id: r._times for r in mixing.mix_documents(near).collect()}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == +Counter(times)
    out = stages["pieces"](spark, mixed, FOLDER)
    assert out.count() == mixed.count()
    held, texts = pieces.load(tokenizer_file("piece_bpe_32k.model")), {r.doc_id: r.text for r in docs.collect()}
    assert all(held.decode(np.array(r.ids)).decode() == (texts[r.doc_id] or "") for r in out.collect())


def test_toxic_documents_go_and_all_others_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    kept = [r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, FOLDER).collect()]
    assert sorted(kept) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in toxic)
    marked = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(marked & toxic) >= 0.8 * len(marked & {r.doc_id for r in docs.collect()}) or not marked


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "source", "n_pieces", "ids"] and out.where("n_pieces <> size(ids)").count() == 0


def test_stages_on_nulls_ties_repeats_and_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three", None), (3, "one two three", None), (None, "one two three", None), (4, "x " * 20_000, "b"), (5, "a b c d e f g h", "b"), (None, None, None)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in ("_h", "_sha", "_key", "maybe_repeated", "_maybe", "last", "_times", "_copy", "_toxicity", "score", "h")})
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in ("toxicity", "exact_dedup", "near_dedup", "mix"):
        out = stages[name](spark, docs, FOLDER)
        assert out.columns == docs.columns and stages[name](spark, docs.where("false"), FOLDER).count() == 0
        kept[name] = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in out.where("text is null or length(text) < 100").collect()), key=str)
        assert out.where("_maybe <> '_maybe' or last <> 'last' or h <> 'h'").count() == 0
    assert len(kept["toxicity"]) == 7
    assert kept["exact_dedup"] == sorted([(False, 2, ""), (False, 3, "one two three"), (False, 5, "a b c d e f g h")], key=str)
    assert len(kept["near_dedup"]) == 7  # equal ids are one document, null ids link with nothing
    out = stages["pieces"](spark, docs, FOLDER)
    assert out.columns == ["doc_id", "source", "n_pieces", "ids"] and out.count() == 8 and stages["pieces"](spark, docs.where("false"), FOLDER).count() == 0
