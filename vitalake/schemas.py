"""Declared source columns, table keys and dataset names.

Fixed values: headers, canonical names, column types and sort keys must equal the sources and the
warehouse tables they describe.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Unsigned types have no Spark counterpart: one size up, with the allowed range kept beside it.
SPARK_TYPE = {
    "UInt8": "smallint",
    "UInt16": "int",
    "UInt32": "bigint",
    "Float32": "float",
    "String": "string",
}
MAX_VALUE = {"UInt8": 255, "UInt16": 65535, "UInt32": 4294967295}

# (header, canonical name, declared type)
DAILY_FOOD = (
    ("Food_Item", "food_item", "String"),
    ("Category", "category", "String"),
    ("Calories (kcal)", "calories", "UInt32"),
    ("Protein (g)", "protein_g", "Float32"),
    ("Carbohydrates (g)", "carbohydrates_g", "Float32"),
    ("Fat (g)", "fat_g", "Float32"),
    ("Fiber (g)", "fiber_g", "Float32"),
    ("Sugars (g)", "sugars_g", "Float32"),
    ("Sodium (mg)", "sodium_mg", "UInt32"),
    ("Cholesterol (mg)", "cholesterol_mg", "UInt32"),
    ("Meal_Type", "meal_type", "String"),
    ("Water_Intake (ml)", "water_intake_ml", "UInt32"),
)
DIET = (
    ("Patient_ID", "patient_id", "String"),
    ("Age", "age", "UInt8"),
    ("Gender", "gender", "String"),
    ("Weight_kg", "weight_kg", "Float32"),
    ("Height_cm", "height_cm", "UInt16"),
    ("BMI", "bmi", "Float32"),
    ("Disease_Type", "disease_type", "String"),
    ("Severity", "severity", "String"),
    ("Physical_Activity_Level", "physical_activity_level", "String"),
    ("Daily_Caloric_Intake", "daily_caloric_intake", "UInt32"),
    ("Cholesterol_mg/dL", "cholesterol_mg_dl", "Float32"),
    ("Blood_Pressure_mmHg", "blood_pressure_mmhg", "Float32"),
    ("Glucose_mg/dL", "glucose_mg_dl", "Float32"),
    ("Dietary_Restrictions", "dietary_restrictions", "String"),
    ("Allergies", "allergies", "String"),
    ("Preferred_Cuisine", "preferred_cuisine", "String"),
    ("Weekly_Exercise_Hours", "weekly_exercise_hours", "Float32"),
    ("Adherence_to_Diet_Plan", "adherence_to_diet_plan", "Float32"),
    ("Dietary_Nutrient_Imbalance_Score", "dietary_nutrient_imbalance_score", "Float32"),
    ("Diet_Recommendation", "diet_recommendation", "String"),
)
WORKOUT = (
    ("Age", "age", "UInt8"),
    ("Gender", "gender", "String"),
    ("Weight (kg)", "weight_kg", "Float32"),
    ("Height (m)", "height_m", "Float32"),
    ("Max_BPM", "max_bpm", "UInt16"),
    ("Avg_BPM", "avg_bpm", "UInt16"),
    ("Resting_BPM", "resting_bpm", "UInt16"),
    ("Session_Duration (hours)", "session_duration_hours", "Float32"),
    ("Calories_Burned", "calories_burned", "Float32"),
    ("Workout_Type", "workout_type", "String"),
    ("Fat_Percentage", "fat_percentage", "Float32"),
    ("Water_Intake (liters)", "water_intake_liters", "Float32"),
    ("Workout_Frequency (days/week)", "workout_frequency_days_week", "UInt8"),
    ("Experience_Level", "experience_level", "UInt8"),
    ("BMI", "bmi", "Float32"),
)
# The API export carries the same columns under their canonical names.
WORKOUT_API = tuple((name, name, kind) for _, name, kind in WORKOUT)

_STRINGS = T.ArrayType(T.StringType())
EXERCISE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("force", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("mechanic", T.StringType()),
        T.StructField("equipment", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("primaryMuscles", _STRINGS),
        T.StructField("secondaryMuscles", _STRINGS),
        T.StructField("instructions", _STRINGS),
        T.StructField("images", _STRINGS),
    ]
)

# One container log record as the log driver writes it.
LOG_RECORD = "log string, stream string, time string"


def text_schema(columns) -> T.StructType:
    """Every declared header as a string, the way sources are landed."""
    return T.StructType([T.StructField(header, T.StringType()) for header, _, _ in columns])


def typed_schema(columns) -> T.StructType:
    """Every declared header with its Spark type, for reading and casting in one step."""
    return T.StructType(
        [T.StructField(header, T._parse_datatype_string(SPARK_TYPE[kind])) for header, _, kind in columns]
    )


def rename(columns) -> dict[str, str]:
    """Header -> canonical name."""
    return {header: name for header, name, _ in columns}


# Newest `updated_at` wins per sort key, so one id may stay twice where the key holds more columns.
SORT_KEY = {
    "food_category": ("id",),
    "food_item": ("meal_type", "calories", "id"),
    "disease": ("id",),
    "allergy": ("id",),
    "preferred_cuisine": ("id",),
    "dietary_restriction": ("id",),
    "diet_recommendation": ("id",),
    "patient": ("id",),
    "metrics": ("patient_id", "created_at", "id"),
    "exercises": ("patient_id", "created_at", "id"),
    "diets": ("preferred_cuisine_id", "daily_caloric_intake", "id"),
    "muscle": ("id",),
    "equipment": ("id",),
    "exercise_category": ("id",),
    "exercise": ("equipment_id", "level", "id"),
    "workout_type": ("id",),
    "session": ("source", "workout_type_id", "id"),
}
