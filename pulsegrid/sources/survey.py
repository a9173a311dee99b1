"""Survey CSV scan (S5): first existing path wins, explicit schema, snake_case columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas as S
from .tables import path_exists


def read_survey(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Read the first path that exists; columns renamed to the model's names."""
    for path in paths:
        if path_exists(spark, path):
            df = (spark.read.schema(S.SURVEY_CSV).option("header", True).option("mode", "PERMISSIVE")
                  .csv(path))
            return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in C.SURVEY_COLUMNS.items()])
    raise FileNotFoundError(f"no survey CSV at any of {paths}")


def write_survey_csv(df: DataFrame, path: str) -> None:
    """Write survey rows (model column names) as a headed CSV with the published headers."""
    back = {dst: src for src, dst in C.SURVEY_COLUMNS.items()}
    df.select(*[F.col(c).alias(back[c]) for c in back if c in df.columns]).write.mode(
        "overwrite").option("header", True).csv(path)
