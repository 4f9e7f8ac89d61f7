"""Warehouse loads: landed text to raw tables, dimensions and denormalised facts.

Foreign keys are ids computed from names, so no load joins. Each load starts from a raw table that
was written once; every output then reads only its own columns of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake import schemas
from vitalake.functions.arrays import condition_entries, json_array, single, single_or_empty
from vitalake.functions.ids import stable_id, stable_ids
from vitalake.functions.values import BLANK, BLANK_OR_NONE, fill_missing, present, when_present
from vitalake.operators.clean import MALFORMED, cast_flagged, rename_map, stamp
from vitalake.operators.dims import build_dim, build_dim_arrays, build_dim_union
from vitalake.operators.merge import latest_by_key, union_tagged
from vitalake.operators.occurrences import occurrence_id
from vitalake.sources.readers import CORRUPT, SEQ

def raw_csv(landed: DataFrame, columns) -> DataFrame:
    """Typed raw table of a landed CSV; `_corrupt` is the text of a row to quarantine.

    A row is bad when its field count was off or a value is no number of the declared type. Missing
    values become '' and 0, as the warehouse stores them.
    """
    named = rename_map(landed, {**schemas.rename(columns), CORRUPT: CORRUPT, SEQ: SEQ})
    numbers = {name: kind for _, name, kind in columns if kind != "String"}
    texts = [name for _, name, kind in columns if kind == "String"]
    # An empty field is a missing one, whatever its type.
    cleaned = named.selectExpr(
        *[f"nullif(trim(`{c}`), '') AS `{c}`" for c in numbers],
        *[f"coalesce(`{c}`, '') AS `{c}`" for c in texts],
        CORRUPT if CORRUPT in named.columns else f"CAST(NULL AS string) AS {CORRUPT}",
        *_seq(named),
    )
    flagged = cast_flagged(cleaned, numbers)
    bad = F.expr(f"CASE WHEN {MALFORMED} THEN coalesce({CORRUPT}, `{texts[0]}`) ELSE {CORRUPT} END")
    return flagged.select(*numbers, *texts, bad.alias(CORRUPT), *_seq(named))


def raw_exercise(landed: DataFrame) -> DataFrame:
    """Raw table of the landed exercise objects: NULL text becomes '', NULL arrays empty ones."""
    names = {
        "id": "id_str",
        "name": "name",
        "force": "force",
        "level": "level",
        "mechanic": "mechanic",
        "equipment": "equipment",
        "category": "category",
        "primaryMuscles": "primary_muscles",
        "secondaryMuscles": "secondary_muscles",
        "instructions": "instructions",
        "images": "images",
    }
    renamed = rename_map(landed, {**names, CORRUPT: CORRUPT, SEQ: SEQ})
    if CORRUPT not in renamed.columns:
        renamed = renamed.withColumn(CORRUPT, F.lit(None).cast("string"))
    arrays = ("primary_muscles", "secondary_muscles", "instructions", "images")
    texts = [c for c in names.values() if c not in arrays]
    empty = F.array().cast("array<string>")
    return fill_missing(renamed, dict.fromkeys(texts, "")).withColumns(
        {c: F.coalesce(F.col(c), empty) for c in arrays}
    )


def _seq(df: DataFrame) -> list[str]:
    return [SEQ] if SEQ in df.columns else []


def _newest(raw: DataFrame, keys: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """The last row of the file per natural key, with the columns a table needs.

    Names are compared, not their ids, and ids and JSON text are made after this, for the rows that stay.
    """
    seq = SEQ if SEQ in raw.columns else None
    return latest_by_key(raw.select(*keys, *rest, *_seq(raw)), keys, seq=seq)


def _dim(col: str, tokens: Sequence[str] = BLANK):
    def build(raw: DataFrame, load_ts: datetime | None = None) -> DataFrame:
        return build_dim(raw, col, tokens, load_ts)

    return build


def food_item(raw: DataFrame, load_ts: datetime | None = None) -> DataFrame:
    """Foods with their category as one-element arrays."""
    measures = [name for _, name, kind in schemas.DAILY_FOOD if kind != "String"]
    kept = _newest(raw, ["meal_type", "calories", "food_item"], ["category", *[m for m in measures if m != "calories"]])
    item = kept.select(
        stable_id("food_item").alias("id"),
        F.col("food_item").alias("name"),
        "meal_type",
        single(stable_id("category")).alias("category_ids"),
        single("category").alias("category_names"),
        *measures,
    )
    return stamp(item, load_ts)


def patient(raw: DataFrame, load_ts: datetime | None = None) -> DataFrame:
    """Patients with their allergy and, as JSON text, their condition."""
    kept = _newest(raw, ["patient_id"], ["age", "gender", "allergies", "disease_type", "severity"])
    rows = kept.select(
        stable_id("patient_id").alias("id"),
        F.col("patient_id").alias("id_data_set"),
        "age",
        "gender",
        single_or_empty(stable_id("allergies"), "allergies").alias("allergy_ids"),
        single_or_empty("allergies", "allergies").alias("allergy_names"),
        condition_entries("disease_type", stable_id("disease_type"), "severity").alias("diseases"),
    )
    return stamp(rows, load_ts)


_METRICS = ("weight_kg", "height_cm", "bmi", "cholesterol_mg_dl", "blood_pressure_mmhg", "glucose_mg_dl")


def _of_patient(name: str, measures: Sequence[str]):
    def build(raw: DataFrame, load_ts: datetime | None = None) -> DataFrame:
        rows = _newest(raw, ["patient_id"], measures).select(
            stable_id("patient_id", F.lit(name)).alias("id"),
            stable_id("patient_id").alias("patient_id"),
            *measures,
        )
        return stamp(rows, load_ts)

    return build


def diets(raw: DataFrame, load_ts: datetime | None = None) -> DataFrame:
    """Diets with the ids and names of cuisine, restriction and advice."""
    restricted = present("dietary_restrictions", BLANK_OR_NONE)
    keys = ["preferred_cuisine", "daily_caloric_intake", "patient_id", "diet_recommendation"]
    scores = ["adherence_to_diet_plan", "dietary_nutrient_imbalance_score"]
    rows = _newest(raw, keys, [*scores, "dietary_restrictions", "age", "gender"]).select(
        stable_id("patient_id", "daily_caloric_intake", "diet_recommendation").alias("id"),
        "daily_caloric_intake",
        "adherence_to_diet_plan",
        "dietary_nutrient_imbalance_score",
        stable_id("patient_id").alias("patient_id"),
        F.when(restricted, stable_id("dietary_restrictions")).otherwise(0).alias("dietary_restriction_id"),
        stable_id("preferred_cuisine").alias("preferred_cuisine_id"),
        stable_id("diet_recommendation").alias("diet_recommendation_id"),
        F.col("preferred_cuisine").alias("preferred_cuisine_name"),
        F.when(restricted, F.col("dietary_restrictions")).otherwise("").alias("dietary_restriction_name"),
        F.col("diet_recommendation").alias("diet_recommendation_name"),
        F.col("age").alias("patient_age"),
        F.col("gender").alias("patient_gender"),
    )
    return stamp(rows, load_ts)


def muscle(raw: DataFrame, load_ts: datetime | None = None) -> DataFrame:
    """Muscles named by either array."""
    return build_dim_arrays(raw, ["primary_muscles", "secondary_muscles"], load_ts=load_ts)


def exercise(raw: DataFrame, load_ts: datetime | None = None) -> DataFrame:
    """Exercises with the ids of muscles, category and equipment."""
    told = ["name", "force", "mechanic", "instructions", "images", "primary_muscles", "secondary_muscles", "category"]
    rows = _newest(raw, ["equipment", "level", "id_str"], told).select(
        F.col("id_str").alias("id"),
        "name",
        "force",
        "level",
        "mechanic",
        json_array("instructions").alias("instruction"),
        json_array("images").alias("photo"),
        stable_ids("primary_muscles").alias("primary_muscle_ids"),
        stable_ids("secondary_muscles").alias("secondary_muscle_ids"),
        stable_id("category").alias("category_id"),
        when_present("equipment", stable_id("equipment"), 0).alias("equipment_id"),
        F.col("category").alias("category_name"),
        F.col("equipment").alias("equipment_name"),
        F.col("primary_muscles").alias("primary_muscle_names"),
    )
    return stamp(rows, load_ts)


def workout_type(raw_external: DataFrame, raw_api: DataFrame, load_ts: datetime | None = None) -> DataFrame:
    """Workout types of both sources."""
    return build_dim_union([(raw_external, "workout_type"), (raw_api, "workout_type")], load_ts=load_ts)


def session(raw_external: DataFrame, raw_api: DataFrame, load_ts: datetime | None = None) -> DataFrame:
    """Sessions of the external file and the API export.

    Ids hold the source, the content and the number among identical rows, so each id is one row and
    nothing is left to reduce by sort key.
    """
    measures = [name for _, name, _ in schemas.WORKOUT]
    sources = {"external_csv": raw_external.select(*measures), "api": raw_api.select(*measures)}
    numbered = union_tagged({name: occurrence_id(df, name) for name, df in sources.items()})
    rows = numbered.select(
        "id",
        "source",
        F.lit(0).cast("bigint").alias("member_id"),
        F.lit(0).cast("bigint").alias("snapshot_id"),
        "age",
        "gender",
        "height_m",
        "weight_kg",
        "bmi",
        "fat_percentage",
        "experience_level",
        F.col("workout_frequency_days_week").alias("workout_frequency_per_week"),
        stable_id("workout_type").alias("workout_type_id"),
        F.col("workout_type").alias("workout_type_name"),
        F.col("session_duration_hours").alias("duration_hours"),
        F.col("calories_burned").alias("calories"),
        "avg_bpm",
        "max_bpm",
        "resting_bpm",
        "water_intake_liters",
        F.lit(None).cast("timestamp").alias("started_at"),
    )
    return stamp(rows, load_ts)


DATASETS = {
    "daily_food": {"food_category": _dim("category"), "food_item": food_item},
    "diet_recommendation": {
        "disease": _dim("disease_type", BLANK_OR_NONE),
        "allergy": _dim("allergies", BLANK_OR_NONE),
        "preferred_cuisine": _dim("preferred_cuisine"),
        "dietary_restriction": _dim("dietary_restrictions", BLANK_OR_NONE),
        "diet_recommendation": _dim("diet_recommendation"),
        "patient": patient,
        "metrics": _of_patient("metrics", _METRICS),
        "exercises": _of_patient("exercises", ("weekly_exercise_hours", "physical_activity_level")),
        "diets": diets,
    },
    "exercise_db": {
        "muscle": muscle,
        "equipment": _dim("equipment"),
        "exercise_category": _dim("category"),
        "exercise": exercise,
    },
    "workout_session": {"workout_type": workout_type, "session": session},
}


def build(
    dataset: str, raws: Sequence[DataFrame], load_ts: datetime | None = None, only: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """The tables of a dataset (or `only` some) from its raw tables, with one load time."""
    return {
        name: table(*raws, load_ts=load_ts)
        for name, table in DATASETS[dataset].items()
        if not only or name in only
    }
