"""Language identification and toxicity: held-out accuracy, and awkward rows."""

import numpy as np
import pytest
from flowsieve.llm import language, queries, toxicity
from pyspark.sql import functions as F

from .conftest import AWKWARD

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language_mixture(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixture_finds_both_languages(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    parts = {lang: docs.where((F.col("lang") == lang) & F.length("text").between(2000, 6000)).orderBy("doc_id").first()["text"][:1800] for lang in ("en", "de")}
    rows = [(1, parts["en"] + " " + parts["de"][:900]), (2, parts["en"])] + AWKWARD
    got = {(r["doc_id"], r["lang_pred"]): r["mixture"] for r in language.predict(documents(rows), model, mixture=True).collect()}
    assert abs(got[1, "en"]["en"] - 2 / 3) < 0.1 and abs(got[1, "en"]["de"] - 1 / 3) < 0.1
    assert got[2, "en"] == {"en": 1.0}
    for key in ((1, "und"), (2, "und"), (6, "und")):
        assert got[key] == {}


def test_expectation_maximisation_finds_the_shares():
    rng = np.random.default_rng(0)
    likely = rng.dirichlet(np.ones(300), 3).T
    counts = rng.multinomial(20_000, likely @ [0.6, 0.1, 0.3])
    shares, _ = language.expectation_maximisation(likely, counts, 500)
    assert np.abs(shares - [0.6, 0.1, 0.3]).max() < 0.03


def test_the_gradient_bound_skips_no_case(spark):
    """Whole selection for every document gives the mixtures of the bound, which runs it for few."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    model = language.learn(docs)
    texts = [r["text"].encode() for r in docs.collect()]
    texts += [a[:600] + b" " + b[:300] for a, b in zip(texts[::2], texts[1::2], strict=False)]
    got, ran = model.mixtures(texts), 0
    for text, shares in zip(texts, got, strict=True):
        hashed, _ = language.trigrams([text])
        if not len(hashed):
            assert not shares.any()
            continue
        grams, counts = np.unique(hashed, return_counts=True)
        alone = np.log(model.table[grams]).T @ counts
        penalty = 0.5 * np.log(len(hashed)) + language._LEAST_GAIN * len(hashed)
        full = model._select(model.table[grams], counts, int(alone.argmax()), float(alone.max()), penalty)
        assert np.allclose(full, shares, atol=1e-9)
        ran += np.count_nonzero(full) > 1
    assert ran > 5


def test_a_model_of_many_languages_is_folded(spark, documents):
    rows = [(10 * k + i, f"{chr(97 + k)}{chr(98 + k)} {chr(99 + k)}{chr(97 + k)}{chr(98 + k)} word " * 20, f"l{k:02d}", "s") for k in range(20) for i in range(3)]
    df = documents(rows)
    model = language.learn(df, model_bytes=20 * 8 * 5_000)
    assert model.shift == 4 and model.table.shape == (4096, 20)
    got = language.predict(df, model, keep=("doc_id",)).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] // 10:02d}" for r in got) >= 57
    with pytest.raises(ValueError):
        language.folding(10**6, language.MODEL_BYTES)


def test_language_without_training_text(documents):
    df = documents(AWKWARD)
    model = language.learn(df.where("false"))
    assert {r["lang_pred"] for r in language.predict(df, model).collect()} == {"und"}
    assert language.predict(df.where("false"), model).collect() == []


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op9_toxicity(spark, sf).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").toPandas()
    hits = ((got.toxic == 1) & (got.predicted == 1)).sum()
    assert hits / got.predicted.sum() > 0.9 and hits / got.toxic.sum() > 0.7
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_toxicity_on_awkward_rows(spark, documents):
    plain = [(i, f"some plain words number {i} of ordinary talk about weather and bread") for i in range(100, 160)]
    toxic = [(i, f"some plain words number {i} you snarfblat and gribnok") for i in range(200, 240)]
    labels = spark.createDataFrame([(i, 0) for i, _ in plain] + [(i, 1) for i, _ in toxic] + [(100, None), (None, 1)], "doc_id bigint, toxic int")
    docs = documents(plain + toxic + AWKWARD)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.union(documents([(900, "what a snarfblat"), (901, "bread and weather")])), model).collect()
    by = {r["doc_id"]: r["predicted"] for r in rows}
    assert by[900] == 1 and by[901] == 0 and by[1] == by[2] == by[5] == by[6] == 0
    assert rows[0].asDict().keys() >= {"doc_id", "score", "predicted"} and "Score" not in rows[0].asDict()
    assert toxicity.score(docs.where("false"), model).collect() == []


@pytest.mark.parametrize("word", ["snarfblatter", "zug", "qz"])
def test_toxicity_in_words_of_any_length(spark, documents, word):
    import random

    rng = random.Random(len(word))
    vocabulary = [f"w{k}ord" for k in range(300)]

    def text(toxic):
        words = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(3 * toxic):
            words.insert(rng.randrange(60), word)
        return " ".join(words)

    known = [(i, text(0)) for i in range(400)] + [(1_000 + i, text(1)) for i in range(200)]
    held = [(5_000 + i, text(i < 100)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i >= 1_000)) for i, _ in known], "doc_id bigint, toxic int")
    model = toxicity.fit(documents(known), labels)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(documents(held), model).collect()}
    assert [found[i] for i, _ in held] == [1] * 100 + [0] * 100


@pytest.mark.parametrize("share", [0, 1])
def test_toxicity_with_one_label_only(spark, documents, share):
    labels = spark.createDataFrame([(1, share), (2, share)], "doc_id bigint, toxic int")
    model = toxicity.fit(documents(AWKWARD), labels)
    assert {r["predicted"] for r in toxicity.score(documents(AWKWARD), model).collect()} == {share}


def test_monotone_curve():
    curve = toxicity.monotone_curve([0, 0, 0, 1, 2, 2, 3], [0, 0, 1, 1, 0, 1, 1])
    assert [s for s, _ in curve] == sorted(s for s, _ in curve) and [p for _, p in curve] == sorted(p for _, p in curve)
