"""The command line, from source files to a restored serving store."""

import json

import pytest
from fixtures import write_folder
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vitalake.__main__ import main
from vitalake.ml import models
from vitalake.sources.versions import read_tables, read_version


def test_commands(spark, tmp_path, capsys):
    folder, root = str(write_folder(tmp_path / "in")), str(tmp_path / "lake")
    (tmp_path / "exports").mkdir()
    (tmp_path / "exports" / "workout.csv").write_text((tmp_path / "in" / "workout_export.csv").read_text())

    assert main(["dump", "external", "--root", root, "--folder", folder, "--missing", "fail"]) == 0
    main(["dump", "workout", "--root", root, "--export", str(tmp_path / "exports" / "workout.csv")])
    assert read_version(spark, root, "raw/api", "workout_session").count() == 2
    main(["warehouse", "workout_session", "--root", root])
    assert read_tables(spark, root, "warehouse", "workout_session")["session"].count() == 6
    main(["load", "food_item", "--root", root])
    assert "'skipped': 2" in capsys.readouterr().out
    tables = f"{root}/serving/food_item"
    main(["backup", "food", "--root", root, "--tables", tables])
    main(["restore", "food", "--root", root, "--target", f"{root}/restored/food_item"])
    assert "['food_category', 'food_item']" in capsys.readouterr().out
    assert read_tables(spark, root, "restored", "food_item")["food_item"].count() == 4
    main(["backup", "one", "two", "--root", root, "--tables", tables, "--tables", tables])
    assert read_tables(spark, root, "backups", "two")["food_item"].count() == 4
    with pytest.raises(PySparkException, match="meal_type: value not allowed"):
        main(["load", "food_item", "--root", root, "--enum", "meal_type=Breakfast"])


def test_score_and_logs(spark, tmp_path):
    root, rows = str(tmp_path / "lake"), str(tmp_path / "rows")
    r = spark.range(60).select(*[(F.rand(i) * 9).alias(c) for i, c in enumerate(models.DURATION_FEATURES)])
    r.withColumn("duration_hours", F.col("age") * 2).write.parquet(rows)
    model = models.train_duration(spark.read.parquet(rows))
    models.save_model(spark, model, models.DURATION_FEATURES, root, "exercise_duration")
    main(["score", "exercise_duration", "--root", root, "--rows", rows, "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).filter("abs(prediction - 2 * age) < 1e-6").count() == 60
    (tmp_path / "records").mkdir()
    line = {"value": "plain", "meta_project": "p", "meta_name": "/a", "meta_id": "1", "arrived": "2024-01-01T00:00:00Z"}
    text = "\n".join(json.dumps({**line, "meta_service": s}) for s in ("api", "other"))
    (tmp_path / "records" / "a.json").write_text(text)
    for _ in range(2):
        main(["logs", "--root", root, "--records", str(tmp_path / "records"), "--keep", "api"])
    assert [r.line for r in spark.read.parquet(f"{root}/logs/lines").collect()] == ["plain"]
