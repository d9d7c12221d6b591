import numpy as np
import pytest

from photocat.llm import language_id as L

SAMPLES = {
    "en": "the house of the king and the people that were in the water with them",
    "de": "das haus des königs und die leute die nicht in dem wasser mit ihnen waren",
    "fr": "la maison du roi et les gens qui étaient dans l'eau avec eux et pour nous",
    "es": "la casa del rey y la gente que estaba en el agua con ellos y por nosotros",
}


def labelled(n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = sorted(SAMPLES)[i % 4]
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(rng.choice(words, 12)), lang))
    return rows


def test_model_and_hierarchy():
    rows = labelled()
    model = L.Model([t for _, t, _ in rows[:40]], [v for _, _, v in rows[:40]])
    assert model.families == ["germanic", "romance"]
    assert set(model.pair_at) == {("de", "en"), ("es", "fr")}
    got = [model.predict(t) for _, t, _ in rows[40:]]
    assert [v for v, _ in got] == [v for _, _, v in rows[40:]]
    assert all(0 <= s <= 1 for _, s in got)
    for text in (None, "", "123 !? \n"):
        assert model.predict(text) == ("und", 0.0)
    # A long text is read whole: its language is in its second half only.
    assert model.predict("7 " * 400_000 + SAMPLES["fr"])[0] == "fr"
    assert abs(L.frequencies("ab " * 200_000).sum() - 1) < 1e-9


def test_one_or_no_language():
    assert L.Model(["abc def"], ["xx"]).predict("anything") == ("xx", 1.0)
    assert L.Model([], []).predict("anything") == ("und", 0.0)


def test_score_equals_plain_product(spark):
    """Brute force: the distributed prediction is the model applied to each row."""
    rows = labelled(40)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.fit(df, teach=~L.held_out("doc_id"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(df, model, ["doc_id"]).collect()}
    assert got == {i: model.predict(t) for i, t, _ in rows}
    taught = [r.doc_id for r in df.where(~L.held_out("doc_id")).collect()]
    assert 0 < len(taught) < 40


def test_odd_rows(odd_docs, no_docs):
    model = L.fit(odd_docs)
    got = L.predict(odd_docs, model, odd_docs.columns)
    assert got.columns == [*odd_docs.columns, "lang_pred", "score"]
    by = {r._id: r for r in got.collect()}
    assert len(by) == odd_docs.count()
    assert {by[i].lang_pred for i in (3, 4, 5, 10)} == {"und"}
    kept = L.keep_known(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 4
    assert L.predict(no_docs, L.fit(no_docs), ["doc_id"]).count() == 0


def test_held_out_accuracy(spark):
    from llm_support import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs, teach=~L.held_out("doc_id"))
    held = L.predict(docs.where(L.held_out("doc_id")), model, ["lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


@pytest.mark.parametrize("n", [12, 60])
def test_copies_and_texts_without_letters_do_not_shrink_the_sample(spark, monkeypatch, n):
    """All copies of a text count as one, so min(per_language, different texts) teach."""
    kept = [(i, f"{text} {i}", lang) for i, text, lang in labelled(4 * n)]
    copies = [(i, SAMPLES["en"], "en") for i in range(3000)] + [(i, f"{i} !", "de") for i in range(3000)]
    df = spark.createDataFrame(kept + copies, "doc_id bigint, text string, lang string").repartition(4)
    used = []

    class Kept(L.Model):
        def __init__(self, samples, labels, seed=5):
            used.append(labels)
            super().__init__(samples, labels, seed)

    monkeypatch.setattr(L, "Model", Kept)
    model = L.fit(df, per_language=20)
    assert {v: used[0].count(v) for v in SAMPLES} == dict.fromkeys(SAMPLES, min(20, n)) | {"en": min(20, n + 1)}
    assert {lang: model.predict(text)[0] for lang, text in SAMPLES.items()} == {v: v for v in SAMPLES}
    # A share of the hashes that holds too few texts is widened.
    monkeypatch.setattr(L, "in_sample", lambda hashed, wanted, total: hashed.isNotNull() & (2 * wanted >= total))
    L.fit(df, per_language=20)
    assert {v: used[1].count(v) for v in SAMPLES} == {v: used[0].count(v) for v in SAMPLES}


def test_training_reads_whole_texts(spark):
    """Texts of both languages open with the same long passage; only what follows tells them apart."""
    opening = "0xyz qwv " * 500
    rows = [(i, opening + (text + " ") * 20, lang) for i, text, lang in labelled(80) if lang in ("en", "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.fit(df)
    assert [model.predict(t)[0] for _, t, _ in rows] == [lang for _, _, lang in rows]
    assert {lang: model.predict(SAMPLES[lang])[0] for lang in ("en", "fr")} == {"en": "en", "fr": "fr"}
    brute = L.Model([t for _, t, _ in rows], [lang for _, _, lang in rows])
    assert np.allclose(model.center, brute.center, rtol=1e-4, atol=1e-9)


def test_least_score(spark):
    """Two languages of a family score 0.25 at least; circular votes of three are rejected."""
    from corpus_pipeline import LEAST_SCORE

    rows = labelled(80)
    model = L.Model([t for _, t, _ in rows], [v for _, _, v in rows])
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("qxzjkvwy ñß"), 40)) for _ in range(200)]
    assert min(model.predict(t)[1] for t in noise if t.strip()) >= 0.25 > LEAST_SCORE
    circle = L.Model(["abc", "def", "ghi"], ["de", "en", "nl"])
    circle.weights[:] = 0
    for pair, margin in {("de", "en"): 1, ("en", "nl"): 1, ("de", "nl"): -0.5}.items():
        circle.weights[-1, circle.pair_at[pair]] = margin
    assert circle.predict("abc")[0] == "de" and circle.predict("abc")[1] < LEAST_SCORE
    df = spark.createDataFrame([(1, "abc"), (2, "!")], "doc_id bigint, text string")
    assert L.keep_known(df, circle, LEAST_SCORE).count() == 0
    assert L.keep_known(df, circle, 0.0).count() == 1
