"""Models on the warehouse tables: session duration, calories, diet advice.

Targets and features are this package's choice, since the training scripts of the jobs these stand
for are not public: duration_hours, calories and diet_recommendation, each from the other measures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import IndexToString, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.sources.publications import Table, Version, claim
from vitalake.sources.versions import dataset_name, now_label, publish, refuse_published, resolve

SECTION = "models"
#: Distinct values that a text column or target may have in a fit.
MAX_CLASSES = 10_000
#: Rows of a partition of a fit of trees, which keeps its rows in memory, some hundred bytes each, and reads them for every tree.
#: A file of columns packs millions of rows into a partition, so tables of more than SPREAD_FROM rows are dealt out.
TREE_ROWS, SPREAD_FROM = 250_000, 1_000_000

DURATION_FEATURES = (
    "age",
    "weight_kg",
    "height_m",
    "bmi",
    "fat_percentage",
    "experience_level",
    "workout_frequency_per_week",
    "calories",
    "avg_bpm",
    "max_bpm",
    "resting_bpm",
    "water_intake_liters",
)
GYM_NUMBERS = (
    "age",
    "weight_kg",
    "height_m",
    "bmi",
    "fat_percentage",
    "experience_level",
    "workout_frequency_days_week",
    "session_duration_hours",
    "avg_bpm",
    "max_bpm",
    "resting_bpm",
)
GYM_CLASSES = ("gender", "workout_type")
DIET_NUMBERS = (
    "age",
    "weight_kg",
    "height_cm",
    "bmi",
    "daily_caloric_intake",
    "cholesterol_mg_dl",
    "blood_pressure_mmhg",
    "glucose_mg_dl",
    "weekly_exercise_hours",
    "adherence_to_diet_plan",
    "dietary_nutrient_imbalance_score",
)
DIET_CLASSES = ("gender", "disease_type", "severity", "physical_activity_level", "dietary_restrictions", "allergies")


def _scaled(numbers: Sequence[str]) -> list:
    # Centred and scaled. Rows that lack a number take no part in a fit, and get no prediction (`fit`, `score`).
    return [
        VectorAssembler(inputCols=list(numbers), outputCol="_numbers", handleInvalid="keep"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
    ]


def _one_hot(classes: Sequence[str]) -> list:
    return [
        StringIndexer(
            inputCols=list(classes), outputCols=[f"_{c}_index" for c in classes], handleInvalid="keep"
        ),
        OneHotEncoder(
            inputCols=[f"_{c}_index" for c in classes], outputCols=[f"_{c}_hot" for c in classes]
        ),
    ]


def _numbers(stages: Sequence) -> list[str]:
    """The number columns that the stages of a model take from a frame."""
    return [c for s in stages if isinstance(s, VectorAssembler) for c in s.getInputCols() if not c.startswith("_")]


def _check_classes(df: DataFrame, columns: Sequence[str]) -> None:
    """An index of classes is held by the driver, so columns with too many of them are refused before a fit."""
    if not columns:
        return
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first().asDict()
    if large := {c: n for c, n in counts.items() if n > MAX_CLASSES}:
        raise ValueError(f"more than {MAX_CLASSES} classes: {large}")


def fit(pipeline: Pipeline, df: DataFrame) -> PipelineModel:
    """Fit on the rows that have every number and the target; text columns of too many values are refused."""
    stages = pipeline.getStages()
    targets = [s.getLabelCol() for s in stages if hasattr(s, "getLabelCol")]
    classes = [c for s in stages if isinstance(s, StringIndexer) for c in s.getInputCols()]
    _check_classes(df, classes)
    rows = df.dropna(subset=[c for c in [*_numbers(stages), *targets] if c in df.columns])
    if not isinstance(stages[-1], (GBTRegressor, OneVsRest)):
        return pipeline.fit(rows)
    # All but the trees take one pass each, over the rows where they lie.
    prepared = Pipeline(stages=stages[:-1]).fit(rows)
    inputs = [c for c in dict.fromkeys([*_numbers(stages), *classes, *targets]) if c in df.columns]
    trees = stages[-1].fit(prepared.transform(_spread(rows.select(*inputs))))
    return PipelineModel(stages=[*prepared.stages, trees])


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out so that no partition has more than about TREE_ROWS; a small table stays as it lies."""
    n = rows.count()
    return rows.repartition(-(-n // TREE_ROWS)) if n > SPREAD_FROM else rows


def scaled_linear(features: Sequence[str], target: str, prediction: str = "prediction") -> Pipeline:
    """Scaling and linear regression. The normal solver needs one pass over the data."""
    regression = LinearRegression(
        featuresCol="_scaled", labelCol=target, predictionCol=prediction, solver="normal"
    )
    return Pipeline(stages=[*_scaled(features), regression])


def boosted_regression(
    numbers: Sequence[str], classes: Sequence[str], target: str, trees: int = 20, depth: int = 5, seed: int = 42
) -> Pipeline:
    """Scaling, one-hot classes, gradient-boosted regression."""
    features = ["_scaled", *[f"_{c}_hot" for c in classes]]
    return Pipeline(
        stages=[
            *_scaled(numbers),
            *(_one_hot(classes) if classes else []),
            VectorAssembler(inputCols=features, outputCol="_features"),
            GBTRegressor(featuresCol="_features", labelCol=target, maxIter=trees, maxDepth=depth, seed=seed),
        ]
    )


def boosted_classes(
    df: DataFrame,
    numbers: Sequence[str],
    classes: Sequence[str],
    target: str,
    trees: int = 20,
    depth: int = 5,
    seed: int = 42,
) -> PipelineModel:
    """Scaling, one-hot classes, label encoding, gradient-boosted classes (one against the rest)."""
    _check_classes(df, [target])
    labels = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(
        df.filter(df[target].isNotNull())
    )
    features = ["_scaled", *[f"_{c}_hot" for c in classes]]
    booster = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed)
    stages = [
        *_scaled(numbers),
        *(_one_hot(classes) if classes else []),
        VectorAssembler(inputCols=features, outputCol="_features"),
        OneVsRest(
            classifier=booster, featuresCol="_features", labelCol="_label", predictionCol="_class", parallelism=4
        ),
    ]
    fitted = fit(Pipeline(stages=stages), labels.transform(df.filter(df[target].isNotNull())))
    names = IndexToString(inputCol="_class", outputCol="prediction", labels=labels.labels)
    return PipelineModel(stages=[*fitted.stages, names])


def train_duration(sessions: DataFrame) -> PipelineModel:
    """Session duration from the other measures of the deduplicated sessions."""
    return fit(scaled_linear(DURATION_FEATURES, "duration_hours"), sessions)


def train_gym(raw_sessions: DataFrame) -> PipelineModel:
    """Calories burned in a session."""
    return fit(boosted_regression(GYM_NUMBERS, GYM_CLASSES, "calories_burned"), raw_sessions)


def train_diet(raw_diet: DataFrame) -> PipelineModel:
    """Diet advice for a patient."""
    return boosted_classes(raw_diet, DIET_NUMBERS, DIET_CLASSES, "diet_recommendation")


def save_model(
    spark: SparkSession,
    model: PipelineModel,
    features: Sequence[str],
    root: str,
    name: str,
    label: str | None = None,
) -> str:
    """Write a model and its feature list as one version and make it the latest."""
    label, root = label or now_label(), root.rstrip("/")
    refuse_published(spark, root, SECTION, name, label)
    folder = claim(spark, root, dataset_name(SECTION, name), label)
    model.write().save(f"{root}/{folder}/model")
    listed = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "position int, feature string")
    listed.coalesce(1).write.mode("errorifexists").json(f"{root}/{folder}/features")
    publish(spark, root, [Version(dataset_name(SECTION, name), label, folder, (Table("model"), Table("features")))])
    return label


def load_model(
    spark: SparkSession, root: str, name: str, version: str = "latest"
) -> tuple[PipelineModel, list[str]]:
    """A model and its features, in order: the latest or an exact version."""
    folder = f"{root.rstrip('/')}/{resolve(spark, root, SECTION, name, version).folder}"
    listed = spark.read.schema("position int, feature string").json(f"{folder}/features")
    features = [r.feature for r in listed.orderBy("position").collect()]
    return PipelineModel.load(f"{folder}/model"), features


def score(df: DataFrame, model: PipelineModel, out: str = "prediction") -> DataFrame:
    """Every row of df with the model's prediction, NULL where a number that the model needs is missing."""
    whole = F.lit(True)
    for c in _numbers(model.stages):
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    scored = model.transform(df)
    return scored.select(*df.columns, F.when(whole, scored["prediction"]).alias(out))
