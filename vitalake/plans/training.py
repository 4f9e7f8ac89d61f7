"""Training and scoring jobs on the published warehouse tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.ml import models
from vitalake.plans.runs import RAW, WAREHOUSE
from vitalake.sources.readers import CORRUPT
from vitalake.sources.versions import read_tables, read_version


def _good(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    return read_version(spark, root, RAW, dataset).filter(F.col(CORRUPT).isNull())


def _sessions(spark: SparkSession, root: str) -> DataFrame:
    return read_tables(spark, root, WAREHOUSE, "workout_session")["session"]


# Name of a model, the table it learns from, how it is fitted, and its features in order.
MODELS = {
    "exercise_duration": (_sessions, models.train_duration, models.DURATION_FEATURES),
    "gym": (
        lambda spark, root: _good(spark, root, "workout_csv"),
        models.train_gym,
        (*models.GYM_NUMBERS, *models.GYM_CLASSES),
    ),
    "diet": (
        lambda spark, root: _good(spark, root, "diet_recommendation"),
        models.train_diet,
        (*models.DIET_NUMBERS, *models.DIET_CLASSES),
    ),
}


def train(spark: SparkSession, root: str, name: str, label: str | None = None) -> PipelineModel:
    """Fit a model on the latest tables, write it as a version, and return it."""
    table, fit, features = MODELS[name]
    model = fit(table(spark, root))
    models.save_model(spark, model, features, root, name, label)
    return model


def score_latest(spark: SparkSession, root: str, name: str, df: DataFrame) -> DataFrame:
    """Predictions of the latest model for a frame that has its features."""
    model, features = models.load_model(spark, root, name)
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"{name}: features not in the frame: {', '.join(missing)}")
    return models.score(df, model)
