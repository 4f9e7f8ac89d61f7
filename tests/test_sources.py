import json
from datetime import datetime, timezone
from threading import Barrier

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vitalake import schemas
from vitalake.operators.clean import delete_in, marker_counts, starts_with
from vitalake.operators.lookups import insert_from, scalar
from vitalake.operators.merge import insert_if_absent
from vitalake.plans.runs import backup_services
from vitalake.sources import landing, publications, readers, versions
from vitalake.sources.backup import restore
from vitalake.sources.landing import Source, external_sources, land, land_all, land_export
from vitalake.sources.tolerance import TooManyBadRows, tolerate

FOOD_HEADER = ",".join(h for h, _, _ in schemas.DAILY_FOOD)
FOOD_ROWS = [
    '"Milk, whole",Dairy,149,7.7,11.7,7.9,0,12.3,105,24,Breakfast,0',
    "Milk (2%, 1 cup),Dairy,122,8.1,11.7,4.8,0,12.3,115,20,Breakfast,0",
    "Water,,,0,0,0,0,0,0,0,Snack,250",
    "Soup,None,70.0,3,9,2,1,2,480,5,Lunch,200",
    "Egg,Dairy,78,6.3,0.6,5.3,0,0.6,62,186,Breakfast,0",
]


@pytest.fixture
def food_csv(tmp_path):
    path = tmp_path / "food.csv"
    path.write_text("\n".join([FOOD_HEADER, *FOOD_ROWS]) + "\n")
    return str(path)


def test_csv_quarantine(spark, food_csv, tmp_path):
    df = readers.read_csv(spark, food_csv, schemas.typed_schema(schemas.DAILY_FOOD), corrupt=True, seq=True)
    df.write.parquet(str(tmp_path / "raw"))
    good, bad = tolerate(spark.read.parquet(str(tmp_path / "raw")))
    assert [r[0] for r in good.orderBy("_seq").select("Food_Item").collect()] == ["Milk, whole", "Water", "Egg"]
    assert sorted(r[0][:4] for r in bad.select("_corrupt").collect()) == ["Milk", "Soup"]
    water = good.filter("Food_Item = 'Water'").first()
    assert water["Category"] is None and water["Calories (kcal)"] is None


def test_csv_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("b,extra,a\n1,z,x\n")
    schema = schemas.T._parse_datatype_string("a string, b int, c double")
    assert rows(readers.read_csv(spark, str(path), schema)) == [("x", 1, None)]


def test_tolerance_needs_both_limits(spark):
    many_good = spark.range(2000).select(F.when(F.col("id") < 101, "bad").alias("_corrupt"), "id")
    good, bad = tolerate(many_good)
    assert (good.count(), bad.count()) == (1899, 101)
    few = spark.range(20).select(F.when(F.col("id") < 10, "bad").alias("_corrupt"), "id")
    assert tolerate(few)[0].count() == 10
    with pytest.raises(TooManyBadRows):
        tolerate(spark.range(1000).select(F.when(F.col("id") < 101, "bad").alias("_corrupt"), "id"))


def test_absent_and_header_only(spark, tmp_path):
    schema = schemas.typed_schema(schemas.WORKOUT_API)
    absent = readers.read_or_empty(spark, str(tmp_path / "none.csv"), schema, corrupt=True, seq=True)
    (tmp_path / "h.csv").write_text(",".join(schema.names) + "\n")
    header = readers.read_or_empty(spark, str(tmp_path / "h.csv"), schema, corrupt=True, seq=True)
    (tmp_path / "e.csv").write_text("")
    empty = readers.read_or_empty(spark, str(tmp_path / "e.csv"), schema, corrupt=True, seq=True)
    assert absent.count() == header.count() == empty.count() == 0
    assert empty.columns == header.columns
    assert absent.columns == header.columns
    assert [f.dataType for f in absent.schema][:15] == [f.dataType for f in header.schema][:15]


EXERCISES = [
    {"id": "a", "name": "Push", "force": None, "level": "beginner", "mechanic": None, "equipment": None,
     "category": "strength", "primaryMuscles": ["chest", ""], "secondaryMuscles": ["arms", "chest"],
     "instructions": ["down", 'say "up"'], "images": []},
    {"id": "b", "name": "Run", "force": "push", "level": "beginner", "mechanic": "compound",
     "equipment": "none", "category": "", "primaryMuscles": [], "secondaryMuscles": [],
     "instructions": [], "images": ["r.png"]},
]


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(EXERCISES))
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps(e) for e in EXERCISES))
    one = readers.read_json(spark, str(tmp_path / "e.json"), schemas.EXERCISE)
    two = readers.read_json(spark, str(tmp_path / "e.jsonl"), schemas.EXERCISE, lines=True)
    assert rows(one) == rows(two)
    assert one.filter("id = 'a'").first().force is None


def test_versions(spark, tmp_path):
    root = str(tmp_path / "lake")
    with pytest.raises(versions.VersionNotFound):
        versions.read_version(spark, root, "raw/external", "x")
    versions.write_version(spark.range(3), root, "raw/external", "x", "2026-01-01T00-00-00Z")
    versions.write_version(spark.range(5), root, "raw/external", "x", "2026-01-02T00-00-00Z")
    assert versions.read_version(spark, root, "raw/external", "x").count() == 5
    assert versions.read_version(spark, root, "raw/external", "x", "2026-01-01T00-00-00Z").count() == 3
    with pytest.raises(versions.VersionExists):
        versions.write_version(spark.range(1), root, "raw/external", "x", "2026-01-02T00-00-00Z")
    with pytest.raises(versions.VersionNotFound):
        versions.read_version(spark, root, "raw/external", "x", "2025-01-01T00-00-00Z")
    assert versions.now_label(datetime(2026, 6, 17, 3, tzinfo=timezone.utc)) == "2026-06-17T03-00-00Z"


def test_full_refresh_replaces(spark, tmp_path):
    path = str(tmp_path / "wh" / "sec" / "t")
    versions.full_refresh(spark.range(3), path, "2026-01-01T00-00-00Z")
    versions.full_refresh(spark.range(2), path, "2026-01-02T00-00-00Z")
    assert versions.read_version(spark, str(tmp_path / "wh"), "sec", "t").count() == 2


def test_land_all_skips_or_fails(spark, food_csv, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "daily_food_nutrition_dataset.csv").write_text(open(food_csv).read())
    root = str(tmp_path / "lake")
    labels = land_all(spark, external_sources(str(folder)), root, "2026-01-01T00-00-00Z")
    assert labels == {"daily_food": "2026-01-01T00-00-00Z"}
    landed = versions.read_version(spark, root, "raw/external", "daily_food")
    assert landed.count() == 5 and landed.filter("`Calories (kcal)` = '70.0'").count() == 1
    with pytest.raises(FileNotFoundError):
        land_all(spark, external_sources(str(folder)), root, "2026-01-02T00-00-00Z", missing="fail")


def test_land_all_reads_side_by_side_and_publishes_in_order(spark, food_csv, tmp_path, monkeypatch):
    met, published = Barrier(2), []
    read, publish = landing.read_source, publications.publish
    monkeypatch.setattr(landing, "read_source", lambda spark, source: (met.wait(60), read(spark, source))[1])
    monkeypatch.setattr(publications, "publish", lambda spark, root, found: (published.append(found[0].dataset), publish(spark, root, found))[1])
    schema, root = schemas.text_schema(schemas.DAILY_FOOD), str(tmp_path / "lake")
    sources = [Source(name, food_csv, schema=schema) for name in ("b", "a")]
    assert list(land_all(spark, sources, root, "2026-01-01T00-00-00Z")) == ["b", "a"]
    assert published == ["raw/external/b", "raw/external/a"]
    assert [versions.read_version(spark, root, "raw/external", name).count() for name in "ab"] == [5, 5]


def test_land_export(spark, tmp_path):
    (tmp_path / "w.csv").write_text(",".join(n for _, n, _ in schemas.WORKOUT_API) + "\n")
    root = str(tmp_path / "lake")
    land_export(spark, str(tmp_path / "w.csv"), "workout_session", root)
    assert versions.read_version(spark, root, "raw/api", "workout_session").count() == 0
    (tmp_path / "f.csv").write_text("id,name\n1,Egg\n")
    land_export(spark, str(tmp_path / "f.csv"), "food_item", root)
    assert rows(versions.read_version(spark, root, "raw/api", "food_item"), "id", "name") == [("1", "Egg")]
    with pytest.raises(ValueError):
        land_export(spark, "x", "unknown", root)


MARK = "BACKUP_TEST_"


def seeded(spark):
    """Two services with marker rows, built the way the seed script does."""
    user = spark.createDataFrame([(3, "BACKUPXTESTX_eve@x", "Eve")], "id long, email string, name string")
    new = spark.createDataFrame(
        [(1, MARK + "alice@x", MARK + "Alice"), (2, MARK + "bob@x", MARK + "Bob"), (9, "BACKUPXTESTX_eve@x", "again")],
        user.schema,
    )
    user = insert_if_absent(user, new, ["email"])
    post = spark.createDataFrame([], "title string, content string, published boolean, author_id long")
    post = insert_from(
        post, user, F.col("email") == MARK + "alice@x",
        {"title": F.lit(MARK + "Post_Alice"), "published": F.lit(True), "author_id": F.col("id")},
    )
    kind = spark.createDataFrame([(1, "Run"), (5, MARK + "Yoga")], "id long, name string")
    member = spark.createDataFrame([(1, "Male", 1.78)], "id long, gender string, height_m double")
    snapshot = spark.createDataFrame([(1, 1, 30, 75.0)], "id long, member_id long, age int, weight_kg double")
    session = spark.range(1).select(
        F.lit(1).cast("bigint").alias("snapshot_id"),
        scalar(kind, F.col("name") == MARK + "Yoga").alias("workout_type_id"),
        F.lit(1.5).alias("duration_hours"),
    )
    return {
        "accounts": {"user": user, "post": post},
        "tracking": {"workout_type": kind, "member": member, "snapshot": snapshot, "session": session},
    }


def counts(tables):
    return {
        service: tuple(marker_counts(frames(tables[service])).first())
        for service, frames in {
            "accounts": lambda t: {
                "users": (t["user"], starts_with("email", MARK)),
                "posts": (t["post"], starts_with("title", MARK)),
                "all_users": (t["user"], None),
            },
            "tracking": lambda t: {
                "types": (t["workout_type"], starts_with("name", MARK)),
                "members": (t["member"], None),
                "sessions": (t["session"], None),
            },
        }.items()
    }


def test_seed_backup_wipe_restore_verify(spark, tmp_path):
    """The manual drill: marker rows are gone after the wipe and back after the restore."""
    root = str(tmp_path / "lake")
    first, second = "2026-01-01T00-00-00Z", "2026-01-02T00-00-00Z"
    services = seeded(spark)
    for name, tables in services.items():
        versions.write_tables(tables, root, "serving", name, first)
    now = {name: versions.read_tables(spark, root, "serving", name) for name in services}
    full = {"accounts": (2, 1, 3), "tracking": (1, 1, 1)}
    assert counts(now) == full
    assert now["tracking"]["session"].first().workout_type_id == 5
    assert now["accounts"]["post"].first().author_id == 1
    backup_services(now, root, first)

    wiped = {
        "accounts": delete_in(
            {"user": (now["accounts"]["user"], starts_with("email", MARK)), "post": (now["accounts"]["post"], None)}
        ),
        "tracking": delete_in(
            {
                name: (df, starts_with("name", MARK) if name == "workout_type" else None)
                for name, df in now["tracking"].items()
            }
        ),
    }
    for name, tables in wiped.items():
        versions.write_tables(tables, root, "serving", name, second)
    gone = {name: versions.read_tables(spark, root, "serving", name) for name in services}
    assert counts(gone) == {"accounts": (0, 0, 1), "tracking": (0, 0, 0)}
    backup_services(gone, root, second)

    back = {name: restore(spark, root, name, first, f"{root}/serving/{name}") for name in services}
    assert counts(back) == full
    assert counts({name: versions.read_tables(spark, root, "serving", name) for name in services}) == full
    assert counts({name: restore(spark, root, name) for name in services}) == counts(gone)
    assert list((tmp_path / "lake" / "backups" / "accounts" / first / "user").glob("*.gz.parquet"))


def test_json_bad_element(spark, tmp_path):
    broken = [*EXERCISES, {"id": "z", "name": "Bad", "primaryMuscles": "no list"}]
    (tmp_path / "e.jsonl").write_text("\n".join([*(json.dumps(e) for e in broken), "{not json"]))
    df = readers.read_json(spark, str(tmp_path / "e.jsonl"), schemas.EXERCISE, lines=True, corrupt=True, seq=True)
    df.write.parquet(str(tmp_path / "raw"))
    good, bad = tolerate(spark.read.parquet(str(tmp_path / "raw")))
    assert rows(good, "id") == [("a",), ("b",)] and bad.count() == 2


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note\n1,"two\nlines, one ""cell"""\n2,plain\n')
    land(spark, Source("notes", str(path), multiline=True), str(tmp_path / "lake"))
    got = versions.read_version(spark, str(tmp_path / "lake"), "raw/external", "notes")
    assert rows(got, "id", "note") == [("1", 'two\nlines, one "cell"'), ("2", "plain")]
