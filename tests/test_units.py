import pytest

from chronica.operators.units import UnitNames, to_common_units

UNITS = [
    ("temperature", "degC", True, 1.0, 0.0), ("temperature", "degF", False, 0.555556, -17.777778), ("temperature", "K", False, 1.0, -273.15),
    ("weight", "kg", True, 1.0, 0.0), ("weight", "lb", False, 0.453592, 0.0), ("weight", "g", False, 0.001, 0.0),
    ("height", "cm", True, 1.0, 0.0), ("height", "in", False, 2.54, 0.0), ("height", "m", False, 100.0, 0.0),
    ("glucose", "mg/dL", True, 1.0, 0.0), ("glucose", "mmol/L", False, 18.016, 0.0),
]
ITEMS = [("1", "Temp bedside", "temperature", None), ("2", "Weight (lbs)", "weight", None), ("3", "Height", "height", "cm"), ("4", "Glucose", "glucose", "mg/dL"), ("5", "Status", None, None), ("6", "Temp oral", "temperature", "degC")]
NAMES = UnitNames([(q, c) for q, c, *_ in UNITS])


@pytest.mark.parametrize("text, quantity, code", [
    ("36.5 C", "temperature", "degC"), ("C 37", "temperature", "degC"), ("T 36.5 (C)", "temperature", "degC"), ("37°C", "temperature", "degC"), ("98.6 deg F", "temperature", "degF"),
    ("tmax 98 fahr.", "temperature", "degF"), ("36.9 - F/U w/ MD", "temperature", None), ("36.1 recheck, f.u.", "temperature", None), ("38.7 f/u 2h", "temperature", None), ("309 kelvin", "temperature", "K"),
    ("80 KG", "weight", "kg"), ("80 kilos", "weight", "kg"), ("wt 80lbs", "weight", "lb"), ("160#", "weight", "lb"), ("80000 grams", "weight", "g"),
    ("1.8 m", "height", "m"), ("180 centimetres", "height", "cm"), ("5'3\"", "height", "in"), ("5 ft 4 in", "height", "in"), ("70 inches", "height", "in"),
    ("110 MG%", "glucose", "mg/dL"), ("110 mg per dl", "glucose", "mg/dL"), ("7.0 mM", "glucose", "mmol/L"), ("7 mmol/l", "glucose", "mmol/L"), ("7 mm Hg", "glucose", None),
    ("", "weight", None), (None, "weight", None), ("refused", "weight", None), ("see " * 20000, "weight", None), ("7 kg", None, None),
])
def test_named(text, quantity, code):
    assert NAMES.named(text, quantity) == code


def test_rows(spark):
    rows = [
        (1, "1", "98.6", 98.6), (2, "1", None, 37.0), (3, "1", "310,2", None), (4, "2", None, 150.0), (5, "2", "70 kg", None), (6, "2", None, 70000.0), (7, "3", "5'10\"", None), (8, "3", "1.75", None),
        (9, "4", "FiO2 7", None), (10, "5", "7", 7.0), (11, "3", "unable", None), (12, None, "7", 7.0), (13, "6", None, 99.5), (14, "1", None, 5000.0), (15, "6", None, 5000.0), (16, "1", "x" * 50000, float("nan")), (17, "4", "7", 7.0), (17, "4", "7", 7.0),
    ]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "id int, itemid string, value string, valuenum double, quantity string, u_number double")
    items = spark.createDataFrame(ITEMS, "itemid string, label string, quantity string, unitname string")
    units = spark.createDataFrame(UNITS, "quantity string, unit_code string, is_common boolean, mul_to_common double, add_to_common double")
    out = sorted((r["id"], r["from_unit"], None if r["common_value"] is None else round(r["common_value"], 1)) for r in to_common_units(df, items, units, ["id"]).collect())
    assert out == [
        (1, "degF", 37.0), (2, "degC", 37.0), (3, "K", 37.1), (4, "lb", 68.0), (5, "kg", 70.0), (6, "g", 70.0), (7, "in", 177.8), (8, "m", 175.0), (9, "mmol/L", 126.1),
        (13, "degF", 37.5), (14, None, None), (15, "degC", 5000.0), (17, "mmol/L", 126.1), (17, "mmol/L", 126.1),
    ]
    assert to_common_units(df.where("false"), items, units, ["id"]).count() == 0
