"""Handwritten source files, the odd rows of FIXTURES.md included."""

import json

from vitalake import schemas

FOOD = [h for h, _, _ in schemas.DAILY_FOOD], [
    '"Milk, whole",Dairy,149,7.7,11.7,7.9,0,12.3,105,24,Breakfast,0',
    "Milk (2%, 1 cup),Dairy,122,8.1,11.7,4.8,0,12.3,115,20,Breakfast,0",
    "Water,,,0,0,0,0,0,0,0,Snack,250",
    "Soup,None,70.0,3,9,2,1,2,480,5,Lunch,200",
    "Egg,Dairy,78,6.3,0.6,5.3,0,0.6,62,186,Breakfast,0",
    "Egg,Poultry,80,6.3,0.6,5.3,0,0.6,62,186,Dinner,0",
    "Bread,None,70,3,13,1,1,2,150,0,Lunch,0",
    "Bread,Bakery,70,3,13,1,1,2,150,0,Lunch,1",
]

# id, age, gender, weight, height, bmi, disease, severity, activity, calories, chol, bp, glucose,
# restriction, allergy, cuisine, hours, adherence, imbalance, advice
DIET = [h for h, _, _ in schemas.DIET], [
    'P1,40,Male,80,180,24,Diabetes,"Mild ""A""",Active,2000,190,120,100,Low_Salt,Nuts,Indian,3,80,1.5,Balanced',
    "P2,50,Female,,170,22,None,None,Sedentary,1800,180,110,90,None,None,Italian,1,70,2.5,Low_Carb",
    "P3,60,Male,90,190,25,,,Active,2100,200,130,110,,,Indian,2,60,3.5,Balanced",
    "P4,30,Female,60,160,21,Obesity,,Active,1900,170,115,95,Low_Salt,Gluten,Italian,4,90,0.5,Low_Carb",
    "P1,41,Male,81,180,25,Obesity,Severe,Active,2200,191,121,101,None,None,Italian,5,81,1.0,Balanced",
    "P5,35,Female,65,175.5,21,None,,Active,2000,170,115,95,None,None,Thai,4,90,0.5,Balanced",
]

EXERCISES = [
    {"id": "a", "name": "Push", "force": None, "level": "beginner", "mechanic": None, "equipment": None,
     "category": "strength", "primaryMuscles": ["chest", ""], "secondaryMuscles": ["arms", "chest"],
     "instructions": ["down", 'say "up"'], "images": []},
    {"id": "b", "name": "Run", "force": "push", "level": "beginner", "mechanic": "compound",
     "equipment": "belt", "category": "", "primaryMuscles": [], "secondaryMuscles": [],
     "instructions": [], "images": ["r.png"]},
    {"id": "c", "name": "Push", "force": "push", "level": "expert", "mechanic": None, "equipment": "bar",
     "category": "strength", "primaryMuscles": ["back", "chest"], "secondaryMuscles": [],
     "instructions": [], "images": []},
]

WORKOUT = [h for h, _, _ in schemas.WORKOUT], [
    "40,Male,80,1.8,180,140,60,1.5,900,Cardio,20,2.5,4,2,24.7",
    "40,Male,80,1.8,180,140,60,1.5,900,Cardio,20,2.5,4,2,24.7",
    "30,Female,60,1.6,185,150,55,1.0,600,Yoga,25,2,3,1,23.4",
    "31,Female,61,1.6,185,150,55,1.0,610,,25,2,3,1,23.8",
]
WORKOUT_API = [n for _, n, _ in schemas.WORKOUT], [
    "40,Male,80,1.8,180,140,60,1.5,900,Cardio,20,2.5,4,2,24.7",
    "22,Male,70,1.7,190,155,58,0.5,300,HIIT,15,1.5,5,3,24.2",
]


def csv_text(source):
    header, lines = source
    return "\n".join([",".join(header), *lines]) + "\n"


def write_folder(folder):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "daily_food_nutrition_dataset.csv").write_text(csv_text(FOOD))
    (folder / "diet_recommendations_dataset.csv").write_text(csv_text(DIET))
    (folder / "exercises.json").write_text(json.dumps(EXERCISES))
    (folder / "gym_members_exercise_tracking.csv").write_text(csv_text(WORKOUT))
    (folder / "workout_export.csv").write_text(csv_text(WORKOUT_API))
    return folder
