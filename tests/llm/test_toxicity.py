import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import toxicity as T
from sitelens.llm.common import id_crc


def test_closed_form_marginals_equal_the_sum_over_all_paths():
    model = T.Model({"=bad": 1, "=good": 2}, np.array([-1.3, 2.5, -1.0]), np.array([[0.4, -0.7], [-0.2, 0.9]]), np.array([0.3, -0.5]))
    emissions, chain = T.Emissions(model), T.Chain(model)
    for text in ("bad", "x bad y z bad bad w", "x y good z z bad", "good a bad"):
        words = text.split()
        weight, toxic = 0.0, np.zeros(len(words))
        for path in itertools.product((0, 1), repeat=len(words)):
            s = model.start[path[0]] + sum(model.moves[a, b] for a, b in zip(path, path[1:]))
            s += sum(emissions[w] for w, y in zip(words, path) if y)
            weight += math.exp(s)
            toxic += math.exp(s) * np.array(path)
        score, active, found = T.score_text(text, emissions, chain)
        assert np.allclose(found, (toxic / weight)[active]) and np.isclose(score, (toxic / weight)[active].max())


def test_training_raises_the_likelihood_of_marked_words():
    sequences = [([[1], [], []], [1, 0, 0]), ([[], [], [1]], [0, 0, 1]), ([[], [1], []], [0, 1, 0]),
                 ([[], []], [0, 0]), ([[], [2], []], [0, 0, 0])] * 20
    model = T.fit(sequences, {"=bad": 1, "=fine": 2})
    chain, emissions = T.Chain(model), T.Emissions(model)
    assert T.score_text("a bad b", emissions, chain)[0] > 0.9 > 0.1 > T.score_text("a fine b", emissions, chain)[0]
    assert T.score_text("Bad b", emissions, chain)[0] > 0.9  # case does not matter
    assert T.spans("a Bad bad b", [1, 2], np.array([0.9, 0.8])) == [(2, 9)]


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = id_crc("doc_id") % 5 == 0
    model = T.train(docs.filter(~held), labels)
    rows = T.score(docs.filter(held), model).join(labels, "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.85
    assert sum(r.predicted for r in clean) / len(clean) < 0.015
    assert all(bool(r.spans) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)
    kept = T.keep_clean(docs.filter(held).withColumn("score", F.lit("x")), model)
    assert kept.columns == [*docs.columns, "score"]
    scored = T.score(docs.filter(held), model).filter("predicted = 0")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in scored.select("doc_id").collect())


@pytest.mark.parametrize("sf, recall, retention", [("sf0.001", 0.6, 1.0), ("sf0.01", 0.8, 0.985), ("sf0.1", 0.9, 0.985)])
def test_recall_and_clean_retention_at_every_size(spark, sf, recall, retention):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    model = T.train(docs.filter(id_crc("doc_id") % 5 != 0), labels)
    rows = T.score(docs, model).join(labels, "doc_id").collect()
    toxic, clean = [[r.predicted for r in rows if r.toxic == k] for k in (1, 0)]
    print(sf, "toxic found", sum(toxic), "of", len(toxic), "clean kept", len(clean) - sum(clean), "of", len(clean))
    assert sum(toxic) / len(toxic) >= recall and 1 - sum(clean) / len(clean) >= retention


def test_edges(spark, edge, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1004, None, None), (None, 1, 1), (1005, 0, 1), (1005, 0, 0), (1008, 1, 0)], empty.schema)
    for labels in (empty, odd):
        model = T.train(edge, labels)
        rows = T.score(edge, model).collect()
        assert len(rows) == edge.count() and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in rows)
        assert all(r.score == 0 for r in rows if r.doc_id in (1000, 1001, 1002, 1003))
        assert T.score(none, model).collect() == [] and T.keep_clean(none, model).collect() == []
