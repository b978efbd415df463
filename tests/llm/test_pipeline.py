import corpus_pipeline as P
from sitelens.llm import benchmark, toxicity
from tests.llm.conftest import SF0001
from tests.llm.test_simhash import check


def test_stages_keep_the_columns_and_take_effect(spark, edge):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").filter("doc_id < 100").unionByName(edge.select(edge.columns[:5]))
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "simhash", "decontamination", "secrets", "pieces"]
    labels = spark.read.parquet(f"{SF0001}/labels.parquet")
    clean = stages["toxicity"](spark, docs, SF0001).cache()
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert clean.columns == docs.columns and clean.count() == scored.filter("predicted = 0").count()
    single = stages["simhash"](spark, clean, SF0001).cache()
    assert single.columns == docs.columns and single.count() == len(set(check(clean)))
    assert single.exceptAll(clean).count() == 0
    bench = spark.read.parquet(f"{SF0001}/benchmark.parquet")
    cut = stages["decontamination"](spark, single, SF0001).cache()
    assert cut.columns == docs.columns and cut.count() == single.count()
    dirty = benchmark.contamination(single, bench).filter("contaminated").count()
    assert cut.exceptAll(single).count() == dirty
    hidden = stages["secrets"](spark, cut, SF0001)
    assert hidden.columns == docs.columns and hidden.count() == cut.count()
    coded = stages["pieces"](spark, hidden, SF0001)
    assert coded.count() == cut.count() and coded.filter("round_trip = false").count() == 0


def test_empty(spark, none):
    docs = none
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF0001)
    assert docs.collect() == []
