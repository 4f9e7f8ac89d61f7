import pytest
from conftest import rows
from pyspark.sql import functions as F

from vitalake.ml import models
from vitalake.plans import training
from vitalake.sources import versions


@pytest.fixture(scope="module")
def sessions(spark):
    r = lambda seed: F.rand(seed)
    base = spark.range(300).select(
        (20 + r(1) * 40).cast("int").alias("age"),
        *[(50 + r(i + 2) * 10).alias(c) for i, c in enumerate(models.DURATION_FEATURES[1:])],
    )
    return base.withColumn("duration_hours", 0.5 + 0.02 * F.col("age") - 0.1 * F.col("bmi")).repartition(2).cache()


def test_duration_model_recovers_a_linear_rule(spark, sessions, tmp_path):
    model = models.train_duration(sessions)
    scored = models.score(sessions, model)
    assert scored.columns == [*sessions.columns, "prediction"]
    worst = scored.agg(F.max(F.abs(F.col("prediction") - F.col("duration_hours")))).first()[0]
    assert worst < 1e-6
    root = str(tmp_path / "lake")
    models.save_model(spark, model, models.DURATION_FEATURES, root, "exercise_duration", "2026-01-01T00-00-00Z")
    models.save_model(spark, model, models.DURATION_FEATURES[:2], root, "exercise_duration", "2026-01-02T00-00-00Z")
    loaded, features = models.load_model(spark, root, "exercise_duration", "2026-01-01T00-00-00Z")
    assert features == list(models.DURATION_FEATURES)
    assert models.load_model(spark, root, "exercise_duration")[1] == list(models.DURATION_FEATURES[:2])
    again = models.score(sessions, loaded)
    assert rows(again, "prediction")[:5] == rows(scored, "prediction")[:5]


def test_gym_and_diet_models(spark):
    base = spark.range(240).select(
        *[(F.rand(i) * 10).alias(c) for i, c in enumerate(dict.fromkeys([*models.GYM_NUMBERS, *models.DIET_NUMBERS]))],
        *[F.element_at(F.array(F.lit("u"), F.lit("v")), (F.rand(90 + i) * 2).cast("int") + 1).alias(c)
          for i, c in enumerate(dict.fromkeys([*models.GYM_CLASSES, *models.DIET_CLASSES]))],
    )
    df = base.withColumn("calories_burned", F.col("age") * 10 + F.when(F.col("gender") == "u", 50).otherwise(0))
    df = df.withColumn(
        "diet_recommendation",
        F.when(F.col("bmi") < 3, "Low_Carb").when(F.col("bmi") < 6, "Balanced").otherwise("Low_Sodium"),
    ).repartition(2).cache()
    gym = models.boosted_regression(models.GYM_NUMBERS, models.GYM_CLASSES, "calories_burned", trees=5, depth=4)
    gym = models.fit(gym, df)
    error = models.score(df, gym).agg(F.avg(F.abs(F.col("prediction") - F.col("calories_burned")))).first()[0]
    assert error < 15
    diet = models.boosted_classes(df, models.DIET_NUMBERS, models.DIET_CLASSES, "diet_recommendation", trees=3, depth=3)
    hit = models.score(df, diet).agg(F.avg((F.col("prediction") == F.col("diet_recommendation")).cast("int"))).first()[0]
    assert hit > 0.95


def test_rows_without_a_number_get_no_prediction(spark, sessions):
    holes = sessions.withColumn("bmi", F.when(F.col("age") % 5 > 0, F.col("bmi")))
    scored = models.score(holes, models.train_duration(holes))
    assert scored.count() == 300
    assert scored.filter(F.col("bmi").isNull() != F.col("prediction").isNull()).count() == 0
    assert scored.agg(F.max(F.abs(F.col("prediction") - F.col("duration_hours")))).first()[0] < 1e-6


def test_too_many_classes_are_refused(spark, sessions, monkeypatch):
    monkeypatch.setattr(models, "MAX_CLASSES", 20)
    named = sessions.withColumn("kind", F.col("bmi").cast("string"))
    with pytest.raises(ValueError, match="more than 20 classes"):
        models.fit(models.boosted_regression(["age"], ["kind"], "duration_hours", trees=1), named)
    with pytest.raises(ValueError, match="more than 20 classes"):
        models.boosted_classes(named, ["age"], [], "kind", trees=1)


def test_training_from_the_warehouse(spark, sessions, tmp_path):
    root = str(tmp_path / "lake")
    typed = sessions.withColumns({"workout_type_name": F.lit("Yoga"), "source": F.lit("api")})
    versions.write_tables({"session": typed}, root, "warehouse", "workout_session")
    training.train(spark, root, "exercise_duration")
    scored = training.score_latest(spark, root, "exercise_duration", typed)
    assert scored.agg(F.max(F.abs(F.col("prediction") - F.col("duration_hours")))).first()[0] < 1e-6
    with pytest.raises(ValueError, match="features not in the frame: bmi"):
        training.score_latest(spark, root, "exercise_duration", typed.drop("bmi"))

    numbers = dict.fromkeys(models.GYM_NUMBERS)
    raw = spark.range(80).select(
        *[(F.rand(i) * 10).cast("float").alias(c) for i, c in enumerate(numbers)],
        F.lit("Male").alias("gender"),
        F.lit("Yoga").alias("workout_type"),
        F.when(F.col("id") == 0, "bad").alias("_corrupt"),
    )
    raw = raw.withColumn("calories_burned", F.col("age") * 10)
    versions.write_version(raw, root, "warehouse/raw", "workout_csv")
    training.train(spark, root, "gym")
    assert training.score_latest(spark, root, "gym", raw).count() == 80


def test_trees_of_a_large_table_read_small_partitions(spark, monkeypatch):
    """Rows are dealt out before a fit of trees, whose tasks read what a partition holds; no row is lost."""
    rule = spark.range(0, 4000, 1, 1).selectExpr("cast(id % 2 AS double) AS x", "cast(id % 2 * 10 + 1 AS double) AS y")
    monkeypatch.setattr(models, "TREE_ROWS", 500, raising=False)
    monkeypatch.setattr(models, "SPREAD_FROM", 1000, raising=False)
    seen, real = [], models.GBTRegressor.fit

    def watched(self, rows, *more):
        seen.extend(n for _, n in rows.groupBy(F.spark_partition_id()).count().collect())
        return real(self, rows, *more)

    monkeypatch.setattr(models.GBTRegressor, "fit", watched)
    model = models.fit(models.boosted_regression(["x"], [], "y", trees=1, depth=1), rule)
    assert sum(seen) == 4000 and max(seen) <= 600
    got = models.score(rule, model).select("y", "prediction").distinct().collect()
    assert sorted((r.y, round(r.prediction, 6)) for r in got) == [(1.0, 1.0), (11.0, 11.0)]
