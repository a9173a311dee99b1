"""Registered ML queries (M1-M12, C7, C8, K11) over the survey view.

Model-dependent queries share one fitted pipeline (``GBT_MAX_ITER``
iterations) per set of tables within the process.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.classify import quality_category, quality_score
from ..operators import ml as M
from ..session import scratch_path
from ..sources import fixtures as X
from ..sources import keyed as KD
from ..streaming.sinks import prediction_rows
from .catalog import query
from .common import AS_OF
from .oracle_views import with_views
from .q_keyed import _requests

_FITTED: dict = {}


def _survey(spark, root):
    return M.clean_survey(X.survey(spark, root))


def _model(spark, root, iters: int = C.GBT_MAX_ITER, kind: str = "gbt"):
    key = (spark.sparkContext.applicationId, root, iters, kind)
    if key not in _FITTED:
        train, test = M.split_survey(_survey(spark, root))
        model, secs = M.fit(train, max_iter=iters, model=kind)
        _FITTED[key] = (model, secs)
    return _FITTED[key]


@query("m1_clean_survey", with_views("""
SELECT person_id, CASE WHEN bmi_category = 'Normal Weight' THEN 'Normal' ELSE bmi_category END AS bmi_category,
       coalesce(sleep_disorder, 'None') AS sleep_disorder,
       TRY_CAST(split_part(blood_pressure, '/', 1) AS INTEGER) AS systolic,
       TRY_CAST(split_part(blood_pressure, '/', 2) AS INTEGER) AS diastolic
FROM survey
""", "survey"))
def m1_clean_survey(spark, root):
    """M1: survey cleaning (disorder default, BMI label, blood pressure split)."""
    return _survey(spark, root).select("person_id", "bmi_category", "sleep_disorder", "systolic", "diastolic")


SPLIT_SQL = ("(('0x' || substr(md5('42:' || CAST(person_id AS VARCHAR)), 1, 8))::BIGINT % 10000) < 8000")
CLEAN_SQL = """
SELECT * REPLACE (CASE WHEN bmi_category = 'Normal Weight' THEN 'Normal' ELSE bmi_category END AS bmi_category,
                  coalesce(sleep_disorder, 'None') AS sleep_disorder)
FROM survey"""


@query("m2_split_survey", with_views(f"""
SELECT person_id, CASE WHEN {SPLIT_SQL} THEN 'train' ELSE 'test' END AS part FROM survey
""", "survey"))
def m2_split_survey(spark, root):
    """M2: repeatable 80/20 hash split of the survey rows."""
    train, test = M.split_survey(_survey(spark, root))
    return train.select("person_id", F.lit("train").alias("part")).unionByName(
        test.select("person_id", F.lit("test").alias("part")))


def _features(spark, root, upto: int):
    """All survey rows through the first ``upto`` feature stages, fitted on the train part."""
    survey = _survey(spark, root)
    train, _ = M.split_survey(survey)
    out = survey
    for stage in Pipeline(stages=M.feature_stages()[:upto]).fit(train).stages:
        out = stage.transform(out)
    return out


def _long(df, **vectors):
    """One row per (person, vector, position)."""
    parts = [df.select("person_id", F.lit(name).alias("part"), F.posexplode(vector_to_array(col)).alias("pos", "value"))
             for name, col in vectors.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("value", F.round("value", 6))


def _index_sql(col: str) -> str:
    return (f"{col}_ix AS (SELECT {col}, row_number() OVER (ORDER BY count(*) DESC, {col}) - 1"
            f" AS idx FROM tr GROUP BY {col})")


FEATURE_CTES = f"""
clean AS ({CLEAN_SQL.replace("FROM survey", ", TRY_CAST(split_part(blood_pressure, '/', 1) AS INTEGER) AS systolic FROM survey")}),
tr AS (SELECT * FROM clean WHERE {SPLIT_SQL}),
{", ".join(_index_sql(c) for c in C.CATEGORICAL_FEATURES)}"""


def _code_sql(col: str) -> str:
    return f"CAST(coalesce((SELECT idx FROM {col}_ix x WHERE x.{col} = clean.{col}), (SELECT count(*) FROM {col}_ix)) AS DOUBLE)"


def _flags_sql(col: str, part: str, base: str = "0") -> str:
    return (f"SELECT person_id, '{part}' AS part, CAST({base} + pos AS INTEGER) AS pos, "
            f"CASE WHEN {_code_sql(col)} = pos THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value "
            f"FROM clean, (SELECT idx AS pos FROM {col}_ix) g")


def _measures_sql(part: str, scaled: bool, base: str = "0") -> str:
    def value(c):
        return (f"({c} - (SELECT avg({c}) FROM tr)) / (SELECT stddev_samp({c}) FROM tr)" if scaled else f"CAST({c} AS DOUBLE)")
    return " UNION ALL ".join(
        f"SELECT person_id, '{part}' AS part, CAST({base} + {i} AS INTEGER) AS pos, round({value(c)}, 6) AS value FROM clean"
        for i, c in enumerate(C.NUMERIC_FEATURES))


def _all_sql() -> str:
    parts, base = [], "0"
    for c in C.CATEGORICAL_FEATURES:
        parts.append(_flags_sql(c, "features", base))
        base += f" + (SELECT count(*) FROM {c}_ix)"
    return " UNION ALL ".join([*parts, _measures_sql("features", True, base)])


@query("m3_index_categories", with_views(
    "SELECT person_id, " + ", ".join(f"{_code_sql(c)} AS {c}_code" for c in C.CATEGORICAL_FEATURES) + " FROM clean",
    "survey", ctes=FEATURE_CTES))
def m3_index_categories(spark, root):
    """M3: category codes fitted on the train part (by frequency, ties by label; unknown kept) of all rows."""
    return _features(spark, root, 1).select("person_id", *[f"{c}_code" for c in C.CATEGORICAL_FEATURES])


@query("m4_one_hot", with_views(" UNION ALL ".join(_flags_sql(c, c) for c in C.CATEGORICAL_FEATURES), "survey", ctes=FEATURE_CTES))
def m4_one_hot(spark, root):
    """M4: one-hot flags of the category codes, one row per position."""
    return _long(_features(spark, root, 2), **{c: f"{c}_flags" for c in C.CATEGORICAL_FEATURES})


@query("m5_assemble", with_views(f"{_measures_sql('measures', False)} UNION ALL {_all_sql()}", "survey", ctes=FEATURE_CTES))
def m5_assemble(spark, root):
    """M5: the numeric vector and the full feature vector, one row per position."""
    return _long(_features(spark, root, 5), measures="measures", features="features")


@query("m6_standardize", with_views(_measures_sql("measures_std", True), "survey", ctes=FEATURE_CTES))
def m6_standardize(spark, root):
    """M6: measures standardised with the training mean and sample standard deviation, one row per position."""
    return _long(_features(spark, root, 4), measures_std="measures_std")


@query("m7_gbt_predictions")
def m7_gbt_predictions(spark, root):
    """M7: gradient-boosted regression (depth 3, step 0.1, seed 42) scored on the test part."""
    _, test = M.split_survey(_survey(spark, root))
    model, _ = _model(spark, root)
    return model.transform(test).select("person_id", F.col(C.TARGET).alias("label"), "prediction")


@query("m8_model_metrics")
def m8_model_metrics(spark, root):
    """M8: MAE, RMSE, R^2 and row counts of the fitted model on the test part."""
    train, test = M.split_survey(_survey(spark, root))
    model, _ = _model(spark, root)
    found = M.regression_metrics(model.transform(test))
    return found.select("mae", "rmse", "r2", F.col("n").alias("n_test"), F.lit(train.count()).cast("bigint").alias("n_train"))


@query("m8_baseline_metrics", with_views("""
SELECT round(avg(abs(prediction - y)), 6) AS mae, round(sqrt(avg((prediction - y) * (prediction - y))), 6) AS rmse,
       round(1 - avg((prediction - y) * (prediction - y)) / var_pop(y), 6) AS r2, count(*) AS n
FROM (SELECT CAST(quality_of_sleep AS DOUBLE) AS y, 10 - stress_level / 2 AS prediction FROM survey) p
""", "survey"))
def m8_baseline_metrics(spark, root):
    """M8: the same metrics for a given prediction column (a stress-only baseline)."""
    preds = X.survey(spark, root).withColumn("prediction", 10 - F.col("stress_level") / 2)
    return M.regression_metrics(preds).withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "r2")})


@query("m9_predict_quality")
def m9_predict_quality(spark, root):
    """M9: validated batch scoring with raw value, 0-100 score and category."""
    model, _ = _model(spark, root)
    scored, _ = M.predict_quality(model, _requests(spark, root), keep=["person_id"])
    return scored


@query("m10_run_log")
def m10_run_log(spark, root):
    """Log the fitted run (params, metrics, time) to a runs table and read it back."""
    model, secs = _model(spark, root)
    train, test = M.split_survey(_survey(spark, root))
    metrics = {**M.evaluate(model.transform(test)), "train_time_secs": secs, "n_train": train.count(), "n_test": test.count()}
    path = scratch_path(spark, "runs")
    M.log_run(spark, path, "spark-gbt", {"maxIter": C.GBT_MAX_ITER, "maxDepth": C.GBT_MAX_DEPTH,
                                         "stepSize": C.GBT_STEP}, metrics)
    return spark.read.parquet(path)


@query("m11_model_registry")
def m11_model_registry(spark, root):
    """Save the model twice (versions 1, 2), load the latest and score with it."""
    model, _ = _model(spark, root)
    reg_root = scratch_path(spark, "models")
    M.save_model(spark, model, reg_root)
    M.save_model(spark, model, reg_root)
    version, loaded = M.load_latest(spark, reg_root)
    _, test = M.split_survey(_survey(spark, root))
    return loaded.transform(test).select("person_id", "prediction", F.lit(version).alias("version"))


@query("m12_compare_runs")
def m12_compare_runs(spark, root):
    """GBT against a linear baseline, logged as runs and ranked by RMSE."""
    path = scratch_path(spark, "runs-compare")
    _, test = M.split_survey(_survey(spark, root))
    for kind, name in (("gbt", "spark-gbt"), ("linear", "spark-linear")):
        model, secs = _model(spark, root, kind=kind)
        M.log_run(spark, path, name, {"model": kind}, {**M.evaluate(model.transform(test)), "train_time_secs": secs})
    return M.compare_runs(spark.read.parquet(path))


@query("k11_predictions")
def k11_predictions(spark, root):
    """Prediction-history rows from the batch scores, appended to the prediction table and read back."""
    model, _ = _model(spark, root)
    scored, _ = M.predict_quality(model, _requests(spark, root), keep=["person_id"])
    version, path = f"gbt-{C.GBT_MAX_ITER}", scratch_path(spark, "predictions")
    KD.append(prediction_rows(scored, model_version=version, now=AS_OF), path, KD.PREDICTIONS, version, 0)
    return KD.read(spark, path, KD.PREDICTIONS)


RAW_SQL = "sleep_duration + stress_level / 4.0"


@query("c7_quality_category", with_views(f"""
SELECT person_id, CASE WHEN {RAW_SQL} <= 6 THEN '{C.QUALITY_POOR}' WHEN {RAW_SQL} <= 8 THEN '{C.QUALITY_GOOD}'
                       ELSE '{C.QUALITY_EXCELLENT}' END AS category
FROM survey
""", "survey"))
def c7_quality_category(spark, root):
    """Category of a raw quality value (here a survey-derived score)."""
    s = X.survey(spark, root)
    return s.select("person_id", quality_category(F.col("sleep_duration") + F.col("stress_level") / 4.0)
                    .alias("category"))


@query("c8_quality_score", with_views(f"""
SELECT person_id, round(greatest(1.0, least(10.0, {RAW_SQL})) * 10, 1) AS score_100 FROM survey
""", "survey"))
def c8_quality_score(spark, root):
    """0-100 score of a raw quality value (clamped to [1, 10])."""
    s = X.survey(spark, root)
    return s.select("person_id", quality_score(F.col("sleep_duration") + F.col("stress_level") / 4.0)
                    .alias("score_100"))
