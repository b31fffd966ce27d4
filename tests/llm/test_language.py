import numpy as np
from pyspark.sql import functions as F

from terraweave.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in queries.table(spark, SF, "documents").collect()}
    got = queries.op9_string_kernel(spark, SF).collect()
    assert len(got) == len(langs)
    held = [r for r in got if r.held_out and langs[r.doc_id]]
    assert len(held) > 100 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.95


def test_kernel_is_that_of_the_landmarks():
    texts = ["the cat sat", "the dog ran", "le chat dort", "le chien court"]
    x = language.presence(texts)
    sets = [set(language.places(t).tolist()) for t in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert abs(x[i] @ x[j] - len(a & b) / (len(a) * len(b)) ** 0.5) < 1e-5
    names, w = language.fit(x, ["en", "en", "fr", "fr"])
    assert [names[k] for k in (x @ w).argmax(axis=1)] == ["en", "en", "fr", "fr"]


def test_ridge_is_that_of_the_landmarks(monkeypatch):
    """With fewer landmarks than rows against the least squares written out; with all of them against plain kernel ridge regression."""
    texts = [f"{a} {b} {i}" for i, (a, b) in enumerate([("the cat", "sat down"), ("a dog", "ran off"), ("le chat", "dort bien"), ("un chien", "court vite"), ("der hund", "schläft"), ("die katze", "läuft weg")] * 3)]
    labels = ["en", "en", "fr", "fr", "de", "de"] * 3
    x = language.presence(texts).astype(np.float64)
    k = x @ x.T
    y = np.where(np.array(labels)[:, None] == np.array(["de", "en", "fr"])[None, :], 1.0, -1.0)
    for m in (7, len(texts)):
        monkeypatch.setattr(language, "LANDMARKS", m)
        names, w = language.fit(x.astype(np.float32), labels)
        lam = language.RIDGE * len(x)
        # argmin |K_nm a - y|^2 + lam a' K_mm a
        a = np.linalg.lstsq(np.vstack([k[:, :m], np.sqrt(lam) * np.linalg.cholesky(k[:m, :m] + 1e-10 * np.eye(m)).T]), np.vstack([y, np.zeros((m, 3))]), rcond=None)[0]
        assert names == ["de", "en", "fr"] and np.abs(x @ w - k[:, :m] @ a).max() < 1e-3
    plain = k @ np.linalg.solve(k + lam * np.eye(len(x)), y)
    assert np.abs(x @ w - plain).max() < 1e-2


def test_a_repeated_key_brings_one_text(spark):
    df = spark.createDataFrame([(1, "the words of this", "en")] * 500 + [(1, "les mots de cette", "fr"), (2, "les mots", "fr")], "doc_id long, text string, lang string")
    names, weights = language.train(df, "doc_id", "text", "lang")
    assert names == ["en", "fr"]
    got = language.predict(df, (names, weights)).groupBy("lang_pred").count().collect()
    assert {(r.lang_pred, r["count"]) for r in got} == {("en", 500), ("fr", 2)}


def test_odd_texts(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "12 + 34", "en"), (4, "the words of this " * 9000, "en"), (5, "les mots de cette", "fr"), (5, "les mots de cette", "fr"), (None, "the words", "en"), (7, "é\ud83d"[:1], None)]
    df = spark.createDataFrame([(k, t, lg, 1.0) for k, t, lg in rows], "doc_id long, text string, lang string, Score double")
    got = language.identify(df, F.lit(True)).collect()
    pred = {(r.doc_id, r.lang_pred) for r in got}
    assert len(got) == len(rows) and {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr")} <= pred
    assert all((r.score == 0) == (r.lang_pred == "und") for r in got)
    assert {r.lang_pred for r in language.identify(df, F.lit(False)).collect()} == {"und"}
    assert language.identify(df.limit(0), F.lit(True)).count() == 0
