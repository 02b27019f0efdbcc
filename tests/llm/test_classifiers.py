import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.llm import quality_gbt, toxicity
from ratewell.llm.common import held_out

SF = "/root/testdata/sf0.01"
TERMS = (("women", "men"), ("christians", "muslims"))


def test_swaps_every_term():
    assert toxicity.swap_terms("Women, men and Muslims.", TERMS) == "men, women and christians."
    codes = toxicity.FeatureCodes()
    assert len(toxicity.sentence_twins("Nothing here. Women sing. None", codes, TERMS)) == 1
    assert toxicity.sentence_twins("", codes, TERMS) == []


def test_the_penalty_takes_the_weight_off_identity_terms(spark):
    """Toxic sentences name one group more often; the term alone must not raise the score."""
    toxic = [(i, f"{'women' if i % 10 else 'men'} are stupid w{i % 50}", 1) for i in range(400)]
    clean = [(i, f"{'men' if i % 10 else 'women'} are singing w{i % 50}", 0) for i in range(400, 800)]
    rows = spark.createDataFrame([(i, t, y) for i, t, y in toxic + clean], "doc_id long, text string, toxic int")
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "toxic")
    ask = spark.createDataFrame([(1, "women walk"), (2, "men walk"), (3, "stupid")], "doc_id long, text string")

    def scores(strength):
        model = toxicity.fit(docs, labels, F.lit(True), terms=TERMS, counterfactual=strength)
        return {r["doc_id"]: r["score"] for r in toxicity.score(ask, model).collect()}

    plain, fair = scores(0.0), scores(10.0)
    assert abs(fair[1] - fair[2]) < 0.2 * abs(plain[1] - plain[2])
    assert fair[3] > 0.9


@pytest.mark.parametrize("method, label, threshold", [(toxicity, "toxic", 0.5), (quality_gbt, "quality", 0.3)])
def test_held_out_rows(spark, method, label, threshold):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = held_out(F.col("doc_id"), 5, 0)
    scored = method.score(docs.select("doc_id", "text"), method.fit(docs, labels, ~out, label))
    assert scored.count() == docs.count()
    rows = scored.where(out).join(labels, "doc_id").select("score", label).collect()
    right = sum((r["score"] >= threshold) == bool(r[label]) for r in rows)
    assert right >= 0.93 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("method", [toxicity, quality_gbt])
def test_odd_documents(documents, no_documents, method):
    labels = documents.selectExpr("doc_id", "CASE WHEN doc_id IS NULL THEN NULL ELSE CAST(doc_id % 2 AS INT) END AS mark")
    for docs, marks in ((documents, labels), (documents, labels.limit(0)), (no_documents, labels), (documents, labels.where("mark = 0"))):
        scored = method.score(docs, method.fit(docs, marks, F.lit(True), "mark"))
        rows = scored.collect()
        assert sorted(scored.columns) == sorted(docs.columns) and len(rows) == docs.count()
        assert all(0 <= r["score"] <= 1 for r in rows)


def test_trees_walk_like_a_plain_loop():
    pick = np.random.default_rng(5)
    x = pick.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality_gbt.grow(x, y, rounds=20, depth=3)
    want = []
    for row in x:
        odds = trees.bias
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > threshold[node])
            odds += leaf[node - len(feature)]
        want.append(odds)
    assert np.allclose(trees.log_odds(x), want)
    assert ((np.array(want) > 0) == y).mean() > 0.97
    assert len(trees.log_odds(x[:0])) == 0
