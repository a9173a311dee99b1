"""ML pipeline pieces."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pulsegrid.operators import ml as M
from pulsegrid.sources import fixtures as X

from conftest import SF_SMALL


def test_clean_and_split_are_deterministic(spark):
    s = M.clean_survey(X.survey(spark, SF_SMALL))
    assert s.where("sleep_disorder IS NULL OR bmi_category = 'Normal Weight'").count() == 0
    assert s.where("systolic IS NULL OR diastolic IS NULL").count() == 0
    a, b = M.split_survey(s)
    a2, _ = M.split_survey(s.repartition(7))
    ids = {r[0] for r in a.select("person_id").collect()}
    assert ids == {r[0] for r in a2.select("person_id").collect()}
    assert a.count() + b.count() == s.count()
    assert 0.65 < a.count() / s.count() < 0.95


def test_fit_metrics_predict_and_registry(spark, scratch):
    s = M.clean_survey(X.survey(spark, SF_SMALL))
    train, test = M.split_survey(s)
    model, secs = M.fit(train, max_iter=5)
    preds = model.transform(test)
    ours = M.regression_metrics(preds).first()
    ev = M.evaluate(preds)
    assert abs(ours.mae - ev["test_mae"]) < 1e-9 and abs(ours.rmse - ev["test_rmse"]) < 1e-9
    assert abs(ours.r2 - ev["test_r2"]) < 1e-9
    reqs = s.withColumn("age", F.when(F.col("person_id") == 0, 5).otherwise(F.col("age")))
    scored, rejected = M.predict_quality(model, reqs, keep=["person_id"])
    assert rejected.count() == 1 and scored.count() == s.count() - 1
    assert scored.where("score_100 < 10 OR score_100 > 100 OR category IS NULL").count() == 0
    root = os.path.join(scratch, "models")
    assert M.save_model(spark, model, root) == 1
    assert M.save_model(spark, model, root) == 2
    version, loaded = M.load_latest(spark, root)
    assert version == 2
    assert loaded.transform(test).select("prediction").collect() == preds.select("prediction").collect()


def test_predictions_equal_a_plain_evaluation_of_the_saved_trees(spark, scratch):
    """M7: the saved trees walked in plain Python on the assembled features give the model's predictions."""
    train, test = M.split_survey(M.clean_survey(X.survey(spark, SF_SMALL)))
    model, _ = M.fit(train, max_iter=6)
    root = os.path.join(scratch, "models")
    M.save_model(spark, model, root)
    folder = next(os.path.join(root, "v1", "stages", d) for d in os.listdir(os.path.join(root, "v1", "stages")) if "GBT" in d)
    weights = {r[0]: r[2] for r in spark.read.parquet(os.path.join(folder, "treesMetadata")).collect()}
    nodes = {}
    for r in spark.read.parquet(os.path.join(folder, "data")).collect():
        nodes.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    assert len(nodes) == 6

    def leaf(tree, x):
        n = tree[0]
        while n.leftChild >= 0:
            s = n.split
            left = x[s.featureIndex] <= s.leftCategoriesOrThreshold[0] if s.numCategories < 0 else x[s.featureIndex] in s.leftCategoriesOrThreshold
            n = tree[n.leftChild if left else n.rightChild]
        return n.prediction

    rows = model.transform(test).collect()
    features = model.stages[-1].getFeaturesCol()
    assert len(rows) > 20 and all(abs(sum(w * leaf(nodes[t], r[features]) for t, w in weights.items()) - r.prediction) < 1e-9 for r in rows)
    scored, _ = M.predict_quality(model, test, keep=["person_id"])  # M9 on the same trees
    want = {r.person_id: round(r.prediction, 3) for r in rows}
    assert all(abs(r.raw_value - want[r.person_id]) <= 0.001 for r in scored.collect())


def test_two_savers_get_versions_of_their_own(spark, scratch):
    assert M._claim_version(spark, scratch, 1) == 1 and M._claim_version(spark, scratch, 1) == 2 and M._claim_version(spark, scratch, 1) == 3


def test_at_rest_schemas_match_writers(spark):
    from pulsegrid import schemas as S
    from pulsegrid.plans.common import alerts_of, readings_of
    from pulsegrid.streaming import sinks as K
    rows = K.reading_rows(readings_of(spark, SF_SMALL))
    assert [f.name for f in rows.schema.fields] == S.READING_ROWS.fieldNames()
    alerts = K.alert_rows(alerts_of(spark, SF_SMALL))
    assert [f.name for f in alerts.schema.fields] == S.ALERT_ROWS.fieldNames()
    assert [(f.name, f.dataType) for f in rows.schema.fields] == [(f.name, f.dataType) for f in S.READING_ROWS.fields]


def test_a_large_training_set_is_spread_over_tasks(spark, monkeypatch):
    rows = M.clean_survey(X.survey(spark, SF_SMALL)).coalesce(1)
    monkeypatch.setattr(M, "ROWS_A_TASK", 40)
    seen = []
    monkeypatch.setattr(M, "build_pipeline", lambda **kw: type("P", (), {"fit": lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count()))})())
    M.fit(rows)
    n = rows.count()
    assert seen == [(1 + n // 40, n)] and n > 80
