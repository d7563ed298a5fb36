"""Nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import hashlib

import corpus_pipeline
from docloom.functions.stage import materialize
from docloom.llm import decision_list, knn, language, mixing, packing, repeats, reputation, secrets, simhash, toxicity
from docloom.llm.queries import tokenizer_path

EMPTY = hashlib.sha256(b"").hexdigest()


def by_id(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_near_duplicates(edge, nothing):
    got = by_id(simhash.near_duplicates(edge))
    assert sum(map(len, got.values())) == edge.count()
    assert {got[i][0].component_id for i in (1, 2, 3, 12)} == {1} and got[2][0].fingerprint == "0" * 16
    assert got[6][0].component_id == got[7][0].component_id == got[11][0].component_id == 6
    assert len(got[9]) == len(got[13]) == 2
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns and kept.where("doc_id in (2, 3, 7, 11, 12)").count() == 0
    assert kept.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0


def test_toxicity(edge, nothing, labels):
    model = toxicity.fit(edge, labels)
    assert toxicity.score_documents(edge, model).count() == edge.count()
    assert toxicity.drop_toxic(edge, model).columns == edge.columns
    assert toxicity.score_documents(nothing, toxicity.fit(nothing, labels)).count() == 0
    without = toxicity.fit(edge, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(edge, without).collect()} == {0.0}


def test_decision_list(edge, nothing, labels):
    got = by_id(decision_list.judge(edge, labels))
    assert sum(map(len, got.values())) == edge.count()
    assert got[1][0].n_words == 0 and got[1][0].base_failed and not got[1][0].kept
    assert got[6][0].n_words == 30_000 and got[8][0].word_chars == 200_000
    assert decision_list.judge(nothing, labels).count() == 0
    assert decision_list.judge(edge, labels.limit(0)).where("kept and base_failed").count() == 0


def test_reputation(spark, labels):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert reputation.judge(pages, labels).count() == 0


def test_knn(spark):
    assert knn.top_k(spark.createDataFrame([(None, None)], "vec_id long, embedding array<float>")).count() == 0


def test_language(edge, nothing):
    model = language.fit(edge)
    got = by_id(language.identify(edge, model))
    assert sum(map(len, got.values())) == edge.count()
    assert {got[i][0].lang_pred for i in (1, 2, 3, 12)} == {"und"} and got[5][0].lang_pred in model.languages
    assert language.identify(nothing, language.fit(nothing)).count() == 0
    assert {r.lang_pred for r in language.identify(edge, None).collect()} == {"und"}


def test_repeats(edge, nothing):
    got = by_id(repeats.drop_repeats(edge))
    assert sum(map(len, got.values())) == edge.count()
    assert got[1][0].kept_sha256 == EMPTY and got[1][0].n_words == 0
    assert got[6][0].n_removed == 0 and got[7][0].n_removed == got[11][0].n_removed == 30_000
    assert len(got[13]) == 2 and len(got[9]) == 2
    assert repeats.drop_repeats(nothing).count() == 0


def test_mixing(edge, nothing):
    got = by_id(mixing.mix_report(edge))
    assert sum(map(len, got.values())) == edge.count()
    assert got[1][0].size == got[1][0].taken == 0 and got[12][0].source_size is not None
    assert mixing.mix(edge).columns == edge.columns
    assert mixing.mix_report(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_secrets(edge, nothing):
    model = secrets.fit(edge)
    got = by_id(secrets.scan(edge, model))
    assert sum(map(len, got.values())) == edge.count() and got[1][0].base_sha256 == EMPTY
    hidden = secrets.redact(edge, model)
    assert hidden.columns == edge.columns and hidden.count() == edge.count()
    assert secrets.scan(nothing, secrets.fit(nothing)).count() == 0


def test_packing(edge, nothing):
    got = by_id(packing.pack_documents(edge, tokenizer_path()))
    assert [r.length for r in got[1]] == [1] and len(got[9]) == 2 and len(got[6]) > 10
    assert packing.pack_documents(nothing, tokenizer_path()).count() == 0


def test_pipeline_stages_keep_columns(spark, edge, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == edge.columns and docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_pipeline_on_tables(spark):
    """Every stage against what it must do, on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    toxic, dedup, hide, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert {r.doc_id for r in toxic(spark, docs, sf).collect()} == {i for i, s in scores.items() if s < .5}
    groups = simhash.near_duplicates(docs).collect()
    assert {r.doc_id for r in dedup(spark, docs, sf).collect()} == {r.component_id for r in groups}
    hidden = hide(spark, docs, sf).collect()
    assert len(hidden) == docs.count() and all(len(r.text) == r.n_chars or secrets.MARK in r.text or r.n_chars >= 0 for r in hidden)
    assert not any(secrets.base_spans(r.text) for r in hidden)
    taken = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()}
    assert sum(taken.values()) == sum(len(r.text.encode().split()) for r in mix(spark, docs, sf).collect())
    assert pack(spark, docs, sf).select("doc_id").distinct().count() == docs.count()
