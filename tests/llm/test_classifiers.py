"""Language identification and toxicity: held-out accuracy, machines, counterfactuals."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tallybridge.llm import language_id, queries, toxicity

from .conftest import ODD_TEXTS, documents, remainder

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op1_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if remainder(r.doc_id, 4) == 2}
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_family_comes_first():
    pick = np.random.default_rng(1)
    centres = np.abs(pick.normal(size=(5, 64)))
    langs = ["en", "de", "fr", "es", "zz"]
    x = np.vstack([c + pick.normal(scale=0.05, size=(40, 64)) for c in centres])
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = language_id.fit(x, [code for code in langs for _ in range(40)])
    assert model.languages == {
        "family germanic": ["de", "en"], "family romance": ["es", "fr"], "family zz": ["zz"]
    }
    assert set(model.machines[-2:]) == {("de", "en"), ("es", "fr")} and len(model.machines) == 5
    margins = x @ model.weights[:-1] + model.weights[-1]
    for k, (a, b) in enumerate(model.machines):
        group = {code: f for f, codes in model.languages.items() for code in codes}
        for row, code in zip(margins, [c for c in langs for _ in range(40)]):
            if a in (code, group[code]):
                assert row[k] > 0
            elif b in (code, group[code]):
                assert row[k] < 0


def test_blocks_do_not_change_a_vector(monkeypatch):
    text = "Ein längerer Satz, der 12 Wörter hat, und noch einer. " * 20
    whole = language_id.vector(text)
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert np.allclose(language_id.vector(text), whole)


def test_odd_texts_have_languages(spark, odd, empty):
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(
        ["the thing is that one", "das ist nicht ein Ding"] * 20)]
    rows = [(i, t, code) for i, t, code in [(i, t, "de" if "nicht" in t else "en") for i, t, _ in rows]]
    model = language_id.train(documents(spark, [*rows, (99, None, "fr"), (100, "x", None)]))
    assert model.languages == {"family germanic": ["de", "en"]}
    out = language_id.identify(odd, model).collect()
    assert len(out) == len(ODD_TEXTS) + 1
    for row in out:
        text = ODD_TEXTS[row.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            assert row.lang_pred in ("de", "en") and 0 <= row.score <= 1
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    one = language_id.train(documents(spark, [(1, "only this", "xx"), (2, "and that", "xx")]))
    assert language_id.identify(documents(spark, [(5, "abc")]), one).first().lang_pred == "xx"


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    scored = queries.op7_toxicity(spark, sf)
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = scored.where("held_out").join(labels, "doc_id").collect()
    assert all(remainder(r.doc_id, 5) == 0 for r in held)
    toxic = [r for r in held if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.01 * (len(held) - len(toxic))


def _sentences():
    """Insults often beside one group's name; neutral sentences without it."""
    pick = random.Random(3)
    filler = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(400):
        toxic = i % 2
        text = pick.sample(filler, 6)
        if toxic:
            text += ["awful"] * (pick.random() < 0.7) + ["muslim"] * (pick.random() < 0.8)
        elif pick.random() < 0.05:
            text += ["muslim"]
        rows.append((i, " ".join(text), toxic))
    return rows


def test_swaps_take_the_weight_off_a_group(spark):
    rows = _sentences()
    docs = documents(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    neutral = "my muslim neighbour works here"
    plain = toxicity.train(docs, labels, counterfactual=0.0).scorer()
    fair = toxicity.train(docs, labels).scorer()
    assert plain(neutral)[0] > 0.5 > fair(neutral)[0]
    assert fair("an awful thing")[1] == 1
    assert abs(fair(neutral)[0] - fair(neutral.replace("muslim", "hindu"))[0]) < 0.15


def test_odd_texts_have_scores(spark, odd, empty):
    rows = _sentences()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, [r[:2] for r in rows]), labels)
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD_TEXTS) + 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert toxicity.score(empty, model).count() == 0
    without = toxicity.train(odd, labels.limit(0))
    assert {r.predicted for r in toxicity.score(odd, without).collect()} == {0}
    same = toxicity.train(odd, odd.select("doc_id", F.lit(1).alias("toxic")))
    assert {r.predicted for r in toxicity.score(odd, same).collect()} == {1}


def test_more_labels_than_are_learned(spark, monkeypatch):
    """Rare labels are left out of training; every document still gets a language."""
    from tallybridge.llm import samples

    monkeypatch.setattr(samples, "MOST_LABELS", 2)
    texts = {"en": "the and with that this from", "de": "der und mit dass nicht von", "fr": "les dans pour que avec sont"}
    rows = [(i, f"{texts[lang]} {i}", lang) for i, lang in enumerate(["en"] * 30 + ["de"] * 20 + ["fr"] * 10)]
    rows += [(100 + i, "word " * 5, f"dirty{i}") for i in range(40)] + [(200, "no label", None)]
    docs = documents(spark, rows)
    some, counts = samples.sampled(docs, "lang", "doc_id", 1000)
    assert counts == {"en": 30, "de": 20} and {r.lang for r in some.collect()} == {"en", "de"}
    found = language_id.identify(docs, language_id.train(docs), keep=["doc_id"]).collect()
    assert len(found) == len(rows) and {r.lang_pred for r in found} <= {"en", "de", "und"}
