"""Whole loads from files to published tables."""

import hashlib
import json
from datetime import timedelta
from pathlib import Path

import pytest
from conftest import LOAD_TS, rows
from fixtures import DIET, FOOD, csv_text, write_folder
from pyspark.sql import functions as F

from vitalake import schemas
from vitalake.operators.lookups import orphan_keys
from vitalake.plans import runs, serving, warehouse
from vitalake.sources.tolerance import TooManyBadRows
from vitalake.sources.versions import VersionExists, VersionNotFound, read_tables, read_version


def md5_id(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("loads")
    folder = write_folder(base / "in")
    root = str(base / "lake")
    out = runs.run_all(
        spark, str(folder), {"workout_session": str(folder / "workout_export.csv")}, root, LOAD_TS,
        "2026-06-17T03-00-00Z",
    )
    return root, out, folder


def test_run_all_reports(lake):
    _, out, _ = lake
    assert set(out["external"]) == {"daily_food", "diet_recommendation", "exercise", "workout_session"}
    assert set(out["warehouse"]) == set(runs.WAREHOUSE_DATASETS)
    # Shifted milk and '70.0' calories.
    assert out["serving"]["food_item"] == {"skipped": 2}


def test_warehouse_food(spark, lake):
    t = read_tables(spark, lake[0], "warehouse", "daily_food")
    # 'None' is a name here: only '' is missing in this column.
    assert rows(t["food_category"], "name") == [("Bakery",), ("Dairy",), ("None",), ("Poultry",)]
    item = t["food_item"]
    # Key (meal_type, calories, id): both eggs stay, of the two breads the last.
    assert rows(item, "name", "meal_type", "calories") == [
        ("Bread", "Lunch", 70), ("Egg", "Breakfast", 78), ("Egg", "Dinner", 80),
        ("Milk, whole", "Breakfast", 149), ("Water", "Snack", 0),
    ]
    bread = item.filter("name = 'Bread'").first()
    assert bread.category_names == ["Bakery"] and bread.category_ids == [md5_id("Bakery")]
    assert bread.id == md5_id("Bread") and bread.created_at == bread.updated_at
    # '' is hashed for water but has no category row.
    assert rows(orphan_keys(item, t["food_category"], "category_ids")) == [(md5_id(""), 1)]
    raw = read_version(spark, lake[0], "warehouse/raw", "daily_food")
    assert raw.filter("_corrupt is not null").count() == 2


def test_warehouse_diet(spark, lake):
    t = read_tables(spark, lake[0], "warehouse", "diet_recommendation")
    assert rows(t["disease"], "name") == [("Diabetes",), ("Obesity",)]
    assert rows(t["allergy"], "name") == [("Gluten",), ("Nuts",)]
    assert rows(t["dietary_restriction"], "name") == [("Low_Salt",)]
    assert rows(t["preferred_cuisine"], "name") == [("Indian",), ("Italian",)]
    patients = {r.id_data_set: r for r in t["patient"].collect()}
    assert len(patients) == 4 and patients["P1"].age == 41
    assert json.loads(patients["P1"].diseases) == [{"id": md5_id("Obesity"), "severity": "Severe"}]
    assert patients["P2"].diseases == "[]" and patients["P2"].allergy_ids == []
    assert json.loads(patients["P4"].diseases) == [{"id": md5_id("Obesity"), "severity": None}]
    assert t["metrics"].count() == t["exercises"].count() == 4
    diets = t["diets"]
    # P5's height is no whole number, which quarantines the row; both diets of P1 stay, by their key.
    assert diets.count() == 5 and diets.filter(diets.patient_id == md5_id("P1")).count() == 2
    p2 = diets.filter(diets.patient_id == md5_id("P2")).first()
    assert p2.dietary_restriction_id == 0 and p2.dietary_restriction_name == ""
    assert p2.patient_gender == "Female" and p2.preferred_cuisine_name == "Italian"


def test_warehouse_exercise(spark, lake):
    t = read_tables(spark, lake[0], "warehouse", "exercise_db")
    assert rows(t["muscle"], "name") == [("arms",), ("back",), ("chest",)]
    assert rows(t["equipment"], "name") == [("bar",), ("belt",)]
    a = t["exercise"].filter("id = 'a'").first()
    assert a.equipment_id == 0 and a.equipment_name == "" and a.force == ""
    assert a.primary_muscle_ids == [md5_id("chest"), md5_id("")]
    assert json.loads(a.instruction) == ["down", 'say "up"'] and a.photo == "[]"
    assert t["exercise"].count() == 3


def test_warehouse_sessions(spark, lake):
    t = read_tables(spark, lake[0], "warehouse", "workout_session")
    assert rows(t["workout_type"], "name") == [("Cardio",), ("HIIT",), ("Yoga",)]
    s = t["session"]
    assert rows(s.groupBy("source").count()) == [("api", 2), ("external_csv", 4)]
    assert s.select("id").distinct().count() == 6
    one = s.filter("workout_type_name = 'HIIT'").first()
    assert one.member_id == one.snapshot_id == 0 and one.started_at is None
    assert one.duration_hours == 0.5 and one.workout_type_id == md5_id("HIIT")


def test_sessions_without_an_export(spark, lake, tmp_path):
    root = str(tmp_path / "lake")
    runs.dump_external(spark, str(lake[2]), root)
    runs.load_warehouse_dataset(spark, root, "workout_session", LOAD_TS)
    assert read_tables(spark, root, "warehouse", "workout_session")["session"].count() == 4


def test_serving_food(spark, lake):
    t = read_tables(spark, lake[0], "serving", "food_item")
    # The shifted milk row and '70.0' do not count; 'None' is NULL.
    assert rows(t["food_category"], "name") == [("Bakery",), ("Dairy",), ("Poultry",)]
    got = {r.name: r for r in t["food_item"].collect()}
    assert set(got) == {"Milk, whole", "Water", "Egg", "Bread"}
    assert got["Egg"].meal_type == "Dinner" and got["Egg"].category_ids == [md5_id("Poultry")]
    assert got["Water"].calories == 0 and got["Water"].category_ids == []
    assert got["Bread"].water_intake_ml == 1


def test_serving_exercise(spark, lake):
    t = read_tables(spark, lake[0], "serving", "exercise")
    got = {r.name: r for r in t["exercise"].collect()}
    assert got["Push"].level == "expert"
    assert got["Push"].primary_muscle_ids == [md5_id("back"), md5_id("chest")]
    assert got["Push"].secondary_muscle_ids == []
    assert got["Run"].category_id is None and got["Run"].equipment_id == md5_id("belt")
    assert rows(t["exercise_category"], "name") == [("strength",)]


def test_serving_diet(spark, lake):
    t = read_tables(spark, lake[0], "serving", "diet")
    p1 = t["patient"].filter("id_data_set = 'P1'").first()
    assert p1.age == 41 and p1.allergy_ids == []
    # Metrics come from the first row of a patient, the diet from the last.
    m = t["metrics"].filter(t["metrics"].patient_id == p1.id).first()
    assert (m.weight_kg, m.height_cm) == (80.0, 180)
    d = t["diets"].filter(t["diets"].patient_id == p1.id).first()
    assert d.daily_caloric_intake == 2200 and d.dietary_restriction_id is None
    assert d.preferred_cuisine_id == md5_id("Italian")
    p2 = t["metrics"].filter(t["metrics"].patient_id == md5_id("P2")).first()
    assert p2.weight_kg == 0.0
    p5 = t["metrics"].filter(t["metrics"].patient_id == md5_id("P5")).first()
    assert p5.height_cm == 175


def test_serving_diet_reduces_landed_rows_once(spark, lake, tmp_path):
    landed, kept = read_version(spark, lake[0], runs.EXTERNAL, "diet_recommendation"), []

    def keep(df):
        kept.append(f"{tmp_path}/{len(kept)}")
        df.write.parquet(kept[-1])
        return spark.read.parquet(kept[-1])

    found = serving.changes("diet", landed, {}, LOAD_TS, keep=keep)
    assert len(kept) == 1
    for name, change in serving.changes("diet", landed, {}, LOAD_TS).items():
        assert rows(found[name].rows, *change.rows.columns) == rows(change.rows, *change.rows.columns), name
    for dataset in runs.SERVING_DATASETS:
        assert not list(Path(lake[0]).glob(f"serving/{dataset}/*/reduced"))


def test_serving_twice_changes_only_updated_at(spark, lake):
    root = lake[0]
    before = {d: read_tables(spark, root, "serving", d) for d in runs.SERVING_DATASETS}
    later = LOAD_TS + timedelta(days=1)
    runs.load_serving(spark, root, later, "2026-06-18T03-00-00Z")
    for dataset, tables in before.items():
        now = read_tables(spark, root, "serving", dataset)
        assert set(now) == set(tables)
        for name, old in tables.items():
            cols = [c for c in old.columns if c != "updated_at"]
            assert rows(now[name], *cols) == rows(old, *cols), name
    patient = read_tables(spark, root, "serving", "diet")["patient"].first()
    assert patient.updated_at > patient.created_at


@pytest.mark.parametrize(
    ("row", "message"),
    [
        ("P9,,Male,1,1,1,,,A,1,1,1,1,,,Indian,1,1,1,Balanced", "age: missing"),
        ("P9,30,Male,1,1,1,,,A,1,1,1,1,,,,1,1,1,Balanced", "preferred_cuisine: missing"),
        ("P9,30,Male,x,1,1,,,A,1,1,1,1,,,Indian,1,1,1,Balanced", "weight_kg: missing or malformed"),
    ],
)
def test_serving_diet_fails_whole(spark, tmp_path, row, message):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "diet_recommendations_dataset.csv").write_text(csv_text((DIET[0], [*DIET[1], row])))
    root = str(tmp_path / "lake")
    runs.dump_external(spark, str(folder), root)
    with pytest.raises(Exception, match=message):
        runs.load_serving_dataset(spark, root, "diet", LOAD_TS)
    with pytest.raises(VersionNotFound):
        read_tables(spark, root, "serving", "diet")


def test_enum_fails_whole(spark, lake, tmp_path):
    root = str(tmp_path / "lake")
    runs.dump_external(spark, str(lake[2]), root)
    with pytest.raises(Exception, match="meal_type: value not allowed"):
        runs.load_serving_dataset(spark, root, "food_item", LOAD_TS, enums={"meal_type": ["Breakfast", "Lunch"]})


def test_loads_do_not_depend_on_order_or_partitions(spark, lake):
    """The place of a row in its file decides, not the place in the frame."""
    root = lake[0]
    label = "2026-06-17T03-00-00Z"
    frames = {
        "daily_food": lambda df: [warehouse.raw_csv(df, schemas.DAILY_FOOD).filter("_corrupt is null")],
        "diet_recommendation": lambda df: [warehouse.raw_csv(df, schemas.DIET).filter("_corrupt is null")],
        "exercise": lambda df: [warehouse.raw_exercise(df)],
        "workout_session": lambda df: [warehouse.raw_csv(df, schemas.WORKOUT)] * 2,
    }
    for source, raws in frames.items():
        landed = read_version(spark, root, "raw/external", source, label)
        shuffled = landed.orderBy(F.rand(7)).repartition(5)
        dataset = "exercise_db" if source == "exercise" else source
        one = warehouse.build(dataset, raws(landed), LOAD_TS)
        two = warehouse.build(dataset, raws(shuffled), LOAD_TS)
        for name in one:
            assert rows(one[name]) == rows(two[name]), name
    for source, dataset in (("daily_food", "food_item"), ("exercise", "exercise"), ("diet_recommendation", "diet")):
        landed = read_version(spark, root, "raw/external", source, label)
        one = serving.build(dataset, landed, {}, LOAD_TS)
        two = serving.build(dataset, landed.repartition(5).orderBy(F.rand(3)), {}, LOAD_TS)
        for name in one:
            assert rows(one[name]) == rows(two[name]), name


def test_too_many_bad_rows_stop_a_load(spark, tmp_path):
    header, lines = FOOD
    bad = [f"Food {i},Dairy,many,1,1,1,1,1,1,1,Snack,1" for i in range(101)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "daily_food_nutrition_dataset.csv").write_text(csv_text((header, [*lines, *bad])))
    root = str(tmp_path / "lake")
    runs.dump_external(spark, str(folder), root)
    with pytest.raises(TooManyBadRows):
        runs.load_warehouse_dataset(spark, root, "daily_food", LOAD_TS)
    for section in ("warehouse", "warehouse/raw"):
        with pytest.raises(VersionNotFound):
            read_tables(spark, root, section, "daily_food")
    # After the file is mended a rerun with the same label works; a published label is refused.
    (folder / "daily_food_nutrition_dataset.csv").write_text(csv_text((header, lines)))
    runs.dump_external(spark, str(folder), root, "2026-07-01T00-00-00Z")
    with pytest.raises(VersionExists):
        runs.dump_external(spark, str(folder), root, "2026-07-01T00-00-00Z")
    label = "2026-07-02T00-00-00Z"
    runs.load_warehouse_dataset(spark, root, "daily_food", LOAD_TS, label)
    good = read_tables(spark, root, "warehouse/raw", "daily_food")["data"].count()
    (folder / "daily_food_nutrition_dataset.csv").write_text(csv_text((header, [*lines, *bad])))
    runs.dump_external(spark, str(folder), root)
    with pytest.raises(TooManyBadRows):
        runs.load_warehouse_dataset(spark, root, "daily_food", LOAD_TS, "2026-07-03T00-00-00Z")
    assert read_tables(spark, root, "warehouse/raw", "daily_food")["data"].count() == good
    assert runs.load_warehouse(spark, root, datasets=[]) == {}


def test_an_id_of_two_names_stops_a_load(spark, tmp_path, monkeypatch):
    from vitalake.functions import ids

    folder, root = write_folder(tmp_path / "in"), str(tmp_path / "lake")
    runs.dump_external(spark, str(folder), root)
    monkeypatch.setattr("vitalake.plans.warehouse.stable_id", lambda *c: F.length(ids.id_text(*c)).cast("long"))
    with pytest.raises(runs.IdCollision):
        runs.load_warehouse_dataset(spark, root, "daily_food", LOAD_TS)
    with pytest.raises(VersionNotFound):
        read_tables(spark, root, "warehouse", "daily_food")
    # The reduction goes by name, so no row is lost to the clash.
    raw = read_version(spark, root, "warehouse/raw", "daily_food").filter("_corrupt is null")
    assert warehouse.food_item(raw, LOAD_TS).count() == raw.select("meal_type", "calories", "food_item").distinct().count()
