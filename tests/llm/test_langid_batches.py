"""Language ID: bounded groups of texts, samples whatever the ids; decontamination with text ids."""

import numpy as np

from weekcast.llm import decontam, langid

EN, DE = "the cat and the dog went there with them ", "der Hund und die Katze gehen nicht weiter "


def test_groups_do_not_change_predictions(spark, make_docs, monkeypatch):
    docs = make_docs([EN * 9] * 5 + [DE * 9] * 5, langs=["en"] * 5 + ["de"] * 5)
    model = langid.train(docs, "text", "lang", "doc_id")
    texts = [EN, None, DE * 300, "", EN * 3 + DE * 2, "12", DE, EN * 500, "x" * 5000]
    whole = langid.predict(texts, model)
    for cells in (1, 50, 4000):
        monkeypatch.setattr(langid, "CELLS", cells)
        got = langid.predict(texts, model)
        assert got[0] == whole[0] and got[2] == whole[2] and np.allclose(got[1], whole[1])
    assert langid.predict([], model) == ([], [], [])


def test_groups_are_bounded(spark, make_docs, monkeypatch):
    model = langid.train(make_docs([EN * 9, DE * 9], langs=["en", "de"]), "text", "lang", "doc_id")
    seen = []
    inner = langid._predict
    monkeypatch.setattr(langid, "CELLS", 20_000)
    monkeypatch.setattr(langid, "_predict", lambda t, m: seen.append(sum(map(len, t))) or inner(t, m))
    langid.predict([EN * 50] * 40, model)
    assert max(seen) <= 10_000 and sum(seen) == 40 * 50 * len(EN)


def test_a_language_of_one_id_is_sampled(spark, make_docs):
    """All rows of a language share an id: about as many are drawn as of any other."""
    n = 4000
    docs = make_docs([f"{EN} {i}" for i in range(n)] + [f"{DE} {i}" for i in range(n)],
                     ids=list(range(n)) + [7] * n, langs=["en"] * n + ["de"] * n)
    model = langid.train(docs, "text", "lang", "doc_id", train_docs=500)
    assert langid.predict([EN, DE], model)[0] == ["en", "de"]
    null_ids = make_docs([f"{EN} {i}" for i in range(n)] + [DE], ids=[None] * n + [1], langs=["en"] * n + ["de"])
    model = langid.train(null_ids, "text", "lang", "doc_id", train_docs=500)
    assert langid.predict([EN], model)[0] == ["en"]


def test_benchmark_ids_of_text(spark, make_docs):
    items = [("a-1", "one two three four five six seven"), (None, "eight nine ten eleven twelve words"), ("b", "x y z")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = make_docs(["so " + items[0][1] + " end", items[1][1], "nothing of it at all here"])
    got = sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()), key=repr)
    assert got == [(0, "a-1"), (1, None)]
    assert [r.doc_id for r in decontam.remove_contaminated(docs, bench).collect()] == [2]
