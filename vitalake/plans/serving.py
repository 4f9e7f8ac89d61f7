"""Serving loads: landed text merged into the relational tables, one row per natural key.

Here '' and 'None' are NULL in every column. A food row whose numbers do not parse is skipped; any
other bad value fails the whole load, and nothing of it is published.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalake import schemas
from vitalake.functions.arrays import condition_entries, json_array, single_or_empty
from vitalake.functions.ids import stable_id
from vitalake.functions.values import null_tokens
from vitalake.operators.clean import malformed, parse_number, rename_map, require_enum, stamp, strict_cast
from vitalake.operators.dims import DIM_SCHEMA, array_names, names_of, upsert_dim
from vitalake.operators.lookups import lookup_arrays, lookup_or_new
from vitalake.operators.merge import first_by_key, latest_by_key, upsert
from vitalake.sources.readers import SEQ

Tables = Mapping[str, DataFrame]
Enums = Mapping[str, Iterable[str]]
#: Writes a frame that several tables of a load need, and reads it back.
Keep = Callable[[DataFrame], DataFrame]

# Names and types of the tables of the serving store, for a first load into nothing.
_STAMPS = "created_at timestamp, updated_at timestamp"
TABLE_SCHEMA = {
    "food_category": DIM_SCHEMA,
    "food_item": "id bigint, name string, meal_type string, category_ids array<bigint>, calories bigint, "
    "protein_g double, carbohydrates_g double, fat_g double, fiber_g double, sugars_g double, "
    f"sodium_mg bigint, cholesterol_mg bigint, water_intake_ml bigint, {_STAMPS}",
    "muscle": DIM_SCHEMA,
    "equipment": DIM_SCHEMA,
    "exercise_category": DIM_SCHEMA,
    "exercise": "id bigint, name string, force string, level string, mechanic string, instruction string, "
    "photo string, primary_muscle_ids array<bigint>, secondary_muscle_ids array<bigint>, "
    f"category_id bigint, equipment_id bigint, {_STAMPS}",
    "disease": DIM_SCHEMA,
    "allergy": DIM_SCHEMA,
    "preferred_cuisine": DIM_SCHEMA,
    "dietary_restriction": DIM_SCHEMA,
    "diet_recommendation": DIM_SCHEMA,
    "patient": "id bigint, id_data_set string, age bigint, gender string, allergy_ids array<bigint>, "
    f"diseases string, {_STAMPS}",
    "metrics": "id bigint, patient_id bigint, weight_kg double, height_cm bigint, bmi double, "
    f"cholesterol_mg_dl double, blood_pressure_mmhg double, glucose_mg_dl double, {_STAMPS}",
    "exercises": "id bigint, patient_id bigint, weekly_exercise_hours double, "
    f"physical_activity_level string, {_STAMPS}",
    "diets": "id bigint, daily_caloric_intake bigint, adherence_to_diet_plan double, "
    "dietary_nutrient_imbalance_score double, patient_id bigint, dietary_restriction_id bigint, "
    f"preferred_cuisine_id bigint, diet_recommendation_id bigint, {_STAMPS}",
}


@dataclass(frozen=True)
class Change:
    """What a load brings to a table: rows with their id, one per key, and how they join the rows that are there.

    `apply` needs only the rows there that share a bucket of the key with those of `rows`.
    """

    rows: DataFrame
    key: str
    apply: Callable[[DataFrame, DataFrame], DataFrame]


class Load:
    """What a table of a load is made from: landed rows, tables before the load, its time, enums."""

    def __init__(
        self, landed: DataFrame, current: Tables, load_ts: datetime, enums: Enums | None = None, keep: Keep | None = None
    ):
        if SEQ not in landed.columns:
            raise ValueError(f"landed rows need {SEQ}, their order decides which duplicate counts")
        self.landed, self.tables, self.load_ts, self.enums, self.keep = landed, current, load_ts, enums or {}, keep

    def current(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return self.landed.sparkSession.createDataFrame([], TABLE_SCHEMA[name])

    def enum(self, col: str) -> Column:
        return require_enum(col, self.enums.get(col))

    @cached_property
    def patients(self) -> DataFrame:
        """Each patient's `first` and `last` row with what the tables take from it, reduced once for all of them and kept."""
        cols = {table: of(self) for table, (_, of) in _OF_PATIENT.items()}
        rows = _diet_rows(self, *[c for of in cols.values() for c in of])
        picked = []
        for which, pick in (("first", F.min), ("last", F.max)):
            names = [n for table in cols if _OF_PATIENT[table][0] == which for n in self.landed_names(table)]
            picked.append(pick(F.struct(SEQ, *names)).alias(which))
        return self.keep(rows.groupBy("id_data_set").agg(*picked))

    def landed_names(self, table: str) -> list[str]:
        """Names of the columns that a table takes from a row of its patient."""
        return _diet_rows(self, *_OF_PATIENT[table][1](self)).drop("id_data_set", SEQ).columns

    def _columns(self, name: str) -> list[str]:
        """Columns of a table without its stamps."""
        return [c for c in T.StructType.fromDDL(TABLE_SCHEMA[name]).names if c not in ("created_at", "updated_at")]

    def merge(self, name: str, rows: DataFrame, key: str) -> Change:
        """Upsert rows that are already one per key."""
        return Change(
            rows.select(*self._columns(name)),
            key,
            lambda there, new: upsert(there, new, [key], None, self.load_ts, keep=("id", "created_at"), reduced=True),
        )

    def names(self, rows: DataFrame) -> Change:
        """Add the names a dimension lacks."""
        named = rows.select("name").distinct().select(stable_id("name").alias("id"), "name")
        return Change(named, "name", lambda there, new: upsert_dim(there, new, self.load_ts))

    def add(self, name: str, rows: DataFrame, key: str) -> Change:
        """Add the rows whose key the table lacks."""

        def apply(there: DataFrame, new: DataFrame) -> DataFrame:
            fresh = new.join(there.select(key).distinct(), key, "left_anti")
            return there.unionByName(stamp(fresh, self.load_ts).select(*there.columns))

        return Change(rows.select(*self._columns(name)), key, apply)


def _rows(landed: DataFrame, columns) -> DataFrame:
    names = [name for _, name, _ in columns]
    return null_tokens(rename_map(landed, {**schemas.rename(columns), SEQ: SEQ}), names)


def required(col: str, value: Column | None = None) -> Column:
    """The value; a NULL fails the job."""
    v = F.col(col) if value is None else value
    return F.coalesce(v, F.raise_error(F.lit(f"{col}: missing or malformed"))).alias(col)


def number(col: str, kind: str) -> Column:
    """Number in a text column: 0 where missing, and anything else fails the job."""
    return F.when(F.col(col).isNull(), F.lit(0).cast(kind)).otherwise(
        required(col, parse_number(col, kind))
    ).alias(col)


# ── food_item ────────────────────────────────────────────────────────────────

_FOOD_NUMBERS = {
    name: "double" if kind == "Float32" else "bigint" for _, name, kind in schemas.DAILY_FOOD if kind != "String"
}


def food_category(load: Load) -> Change:
    """Categories of the rows whose calories are a number or missing."""
    rows = _rows(load.landed, schemas.DAILY_FOOD)
    counted = rows.filter(~malformed({"calories": "bigint"}))
    return load.names(names_of(counted, "category"))


def food_item(load: Load) -> Change:
    """Foods merged by name; the last row of a name counts."""
    good, _ = strict_cast(_rows(load.landed, schemas.DAILY_FOOD), _FOOD_NUMBERS)
    last = latest_by_key(
        good.select(
            required("food_item").alias("name"), load.enum("meal_type"), "category", *_FOOD_NUMBERS, SEQ
        ),
        ["name"],
        seq=SEQ,
    )
    # A row whose numbers all parse has its category in the dimension.
    items = lookup_or_new(last, load.current("food_category"), "category", "_category_id").withColumns(
        {"id": stable_id("name"), "category_ids": single_or_empty("_category_id", "category")}
    )
    return load.merge("food_item", items, "name")


def skipped_foods(landed: DataFrame) -> DataFrame:
    """Food rows that are not loaded because a value is not a number."""
    return strict_cast(_rows(landed, schemas.DAILY_FOOD), _FOOD_NUMBERS)[1]


# ── exercise ─────────────────────────────────────────────────────────────────


def _exercise_dim(names):
    def build(load: Load) -> Change:
        return load.names(names(load.landed))

    return build


def exercise(load: Load) -> Change:
    """Exercises merged by name; the last one of a name counts."""
    rows = load.landed.select(
        required("name"),
        load.enum("force"),
        load.enum("level"),
        load.enum("mechanic"),
        json_array("instructions").alias("instruction"),
        json_array("images").alias("photo"),
        "primaryMuscles",
        "secondaryMuscles",
        F.expr("nullif(category, '')").alias("category"),
        F.expr("nullif(equipment, '')").alias("equipment"),
        SEQ,
    )
    # One row per name first: the element lookups then handle what is kept and nothing else.
    last = latest_by_key(rows, ["name"], seq=SEQ)
    muscles = {"primaryMuscles": "primary_muscle_ids", "secondaryMuscles": "secondary_muscle_ids"}
    found = lookup_arrays(last, load.current("muscle"), muscles, ["name"], new_ids=True)
    found = lookup_or_new(found, load.current("exercise_category"), "category", "category_id")
    found = lookup_or_new(found, load.current("equipment"), "equipment", "equipment_id")
    return load.merge("exercise", found.withColumn("id", stable_id("name")), "name")


# ── diet ─────────────────────────────────────────────────────────────────────

_DIET_DIMS = {
    "disease": "disease_type",
    "allergy": "allergies",
    "preferred_cuisine": "preferred_cuisine",
    "dietary_restriction": "dietary_restrictions",
    "diet_recommendation": "diet_recommendation",
}


def _diet_dim(name: str):
    def build(load: Load) -> Change:
        return load.names(names_of(_rows(load.landed, schemas.DIET), _DIET_DIMS[name]))

    return build


def _diet_rows(load: Load, *cols: Column | str) -> DataFrame:
    """The landed rows with some of their columns, checked on every row and before any shuffle."""
    rows = _rows(load.landed, schemas.DIET)
    return rows.select(required("patient_id").alias("id_data_set"), *cols, SEQ)


def _with_patient(load: Load, rows: DataFrame, table: str) -> DataFrame:
    found = lookup_or_new(rows, load.current("patient"), "id_data_set", "patient_id", name="id_data_set")
    return found.withColumn("id", stable_id("patient_id", F.lit(table)))


#: For the tables with a row a patient: the row of the patient that counts, and the columns it gives.
_OF_PATIENT: dict[str, tuple[str, Callable[[Load], list[Column | str]]]] = {
    "patient": (
        "last",
        lambda load: [required("age", parse_number("age", "bigint")), load.enum("gender"), "disease_type", "severity", "allergies"],
    ),
    "metrics": (
        "first",
        lambda load: [
            number("height_cm", "double").cast("bigint").alias("height_cm"),
            *[number(c, "double") for c in ("weight_kg", "bmi", "cholesterol_mg_dl", "blood_pressure_mmhg", "glucose_mg_dl")],
        ],
    ),
    "exercises": ("first", lambda load: [number("weekly_exercise_hours", "double"), load.enum("physical_activity_level")]),
    "diets": (
        "last",
        lambda load: [
            number("daily_caloric_intake", "bigint"),
            number("adherence_to_diet_plan", "double"),
            number("dietary_nutrient_imbalance_score", "double"),
            "dietary_restrictions",
            required("preferred_cuisine"),
            required("diet_recommendation"),
        ],
    ),
}


def _one_per_patient(load: Load, table: str) -> DataFrame:
    """The row of each patient that counts for a table, with the columns it takes."""
    which, cols = _OF_PATIENT[table]
    if load.keep is not None:
        return load.patients.select("id_data_set", *[F.col(f"{which}.{name}") for name in load.landed_names(table)])
    reduced = latest_by_key if which == "last" else first_by_key
    return reduced(_diet_rows(load, *cols(load)), ["id_data_set"], seq=SEQ)


def patient(load: Load) -> Change:
    """Patients merged by their id in the data set; the last row of a patient counts."""
    found = lookup_or_new(_one_per_patient(load, "patient"), load.current("disease"), "disease_type", "_disease_id")
    found = lookup_or_new(found, load.current("allergy"), "allergies", "_allergy_id")
    patients = found.select(
        stable_id("id_data_set").alias("id"),
        "id_data_set",
        "age",
        "gender",
        single_or_empty("_allergy_id", "allergies").alias("allergy_ids"),
        condition_entries("disease_type", F.col("_disease_id"), "severity").alias("diseases"),
    )
    return load.merge("patient", patients, "id_data_set")


def _added(load: Load, table: str) -> Change:
    """The first row of every patient that has no row in the table yet."""
    return load.add(table, _with_patient(load, _one_per_patient(load, table), table), "patient_id")


def metrics(load: Load) -> Change:
    """Body measures, one row per patient."""
    return _added(load, "metrics")


def exercises(load: Load) -> Change:
    """Exercise habits, one row per patient."""
    return _added(load, "exercises")


def diets(load: Load) -> Change:
    """Diets merged by patient; the last row of a patient counts.

    A cuisine or advice is in its dimension unless it is missing, so the lookups that must hit are
    checked as columns that must be there.
    """
    found = _with_patient(load, _one_per_patient(load, "diets"), "diets")
    for name in ("dietary_restriction", "preferred_cuisine", "diet_recommendation"):
        found = lookup_or_new(found, load.current(name), _DIET_DIMS[name], f"{name}_id")
    return load.merge("diets", found, "patient_id")


DATASETS = {
    "food_item": {"food_category": food_category, "food_item": food_item},
    "exercise": {
        "muscle": _exercise_dim(lambda df: array_names(df, ["primaryMuscles", "secondaryMuscles"])),
        "equipment": _exercise_dim(lambda df: names_of(df, "equipment")),
        "exercise_category": _exercise_dim(lambda df: names_of(df, "category")),
        "exercise": exercise,
    },
    "diet": {
        **{name: _diet_dim(name) for name in _DIET_DIMS},
        "patient": patient,
        "metrics": metrics,
        "exercises": exercises,
        "diets": diets,
    },
}


def changes(
    dataset: str, landed: DataFrame, current: Tables, load_ts: datetime, enums: Enums | None = None, only: Sequence[str] = (),
    keep: Keep | None = None,
) -> dict[str, Change]:
    """What the landed rows bring to the tables of a dataset (or `only` some), with one load time.

    With `keep`, rows that several tables are made from are reduced once and written by it.
    """
    load = Load(landed, current, load_ts, enums, keep)
    return {name: table(load) for name, table in DATASETS[dataset].items() if not only or name in only}


def build(
    dataset: str,
    landed: DataFrame,
    current: Tables,
    load_ts: datetime,
    enums: Enums | None = None,
    only: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """The tables of a dataset (or `only` some) after merging the landed rows, with one load time."""
    load = Load(landed, current, load_ts, enums)
    found = changes(dataset, landed, current, load_ts, enums, only)
    return {name: change.apply(load.current(name), change.rows) for name, change in found.items()}
