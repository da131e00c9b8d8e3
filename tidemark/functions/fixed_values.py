"""Names, ids and units that results depend on and that follow from the source data."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- Fixed values: phenotype -------------------------------------------------------------
CREATININE_LABEL = "Creatinine"
DIAGNOSIS_EVENT = "diagnosis_made"
DIAGNOSIS_NAME = "Acute Kidney Injury"
ABSOLUTE_RISE = 0.3
RELATIVE_RISE = 1.5
BASELINE_WINDOW = "24h"
RISE_WINDOW = "48h"
ACQUIRED_AFTER = "48h"
LOW_URINE_RATE = 0.5
URINE_WINDOW = "6h"
URINE_WINDOW_HOURS = 6
POUNDS_TO_KILOGRAMS = 0.45359237
WEIGHT_IN_POUNDS_ITEM = "226531"
IRRIGANT_IN_ITEM = "227488"
WEIGHT_ITEMS = (226512, 224639, 226846, 226531)
URINE_ITEMS = (
    226559, 226560, 226561, 226584, 226563, 226564,
    226565, 226567, 226557, 226558, 227488, 227489,
)
WEIGHT_COLUMNS = ("subject_id", "hadm_id", "stay_id", "charttime", "itemid", "valuenum", "valueuom")
URINE_COLUMNS = ("subject_id", "hadm_id", "stay_id", "charttime", "itemid", "value", "valueuom")
KIDNEY_INJURY_PREFIXES = (("9", "584"), ("10", "N17"))

# ---- Fixed values: cohort ----------------------------------------------------------------
BIRTH_CODE = "MEDS_BIRTH"
DEATH_CODE = "MEDS_DEATH"
STRUCTURAL_CODES = (BIRTH_CODE, DEATH_CODE)
VISIT_PREFIX = "Visit/"
INPATIENT_VISITS = ("Visit/IP", "Visit/ERIP")
FIRST_LANDMARK_AFTER = "48h"
LANDMARK_STEP = "12h"
LABEL_HORIZON = "48h"
FOLD_FRACTIONS = {"training": 0.70, "validation": 0.15, "testing": 0.15}
FOLD_SEED = 42

# ---- Fixed values: curated code mapping --------------------------------------------------
GENDER_CODES = {"M": "Gender/M", "F": "Gender/F"}
RACE_CODES = {
    "WHITE": "Race/5",
    "WHITE - OTHER EUROPEAN": "Race/5",
    "WHITE - RUSSIAN": "Race/5",
    "WHITE - EASTERN EUROPEAN": "Race/5",
    "WHITE - BRAZILIAN": "Race/5",
    "BLACK/AFRICAN AMERICAN": "Race/3",
    "BLACK/CAPE VERDEAN": "Race/3",
    "BLACK/CARIBBEAN ISLAND": "Race/3",
    "BLACK/AFRICAN": "Race/3",
    "ASIAN": "Race/2",
    "ASIAN - CHINESE": "Race/2",
    "ASIAN - SOUTH EAST ASIAN": "Race/2",
    "ASIAN - ASIAN INDIAN": "Race/2",
    "ASIAN - KOREAN": "Race/2",
    "AMERICAN INDIAN/ALASKA NATIVE": "Race/1",
    "NATIVE HAWAIIAN OR OTHER PACIFIC ISLANDER": "Race/4",
    "HISPANIC OR LATINO": "Ethnicity/Hispanic",
    "HISPANIC/LATINO - PUERTO RICAN": "Ethnicity/Hispanic",
    "HISPANIC/LATINO - DOMINICAN": "Ethnicity/Hispanic",
    "HISPANIC/LATINO - GUATEMALAN": "Ethnicity/Hispanic",
    "HISPANIC/LATINO - SALVADORAN": "Ethnicity/Hispanic",
    "HISPANIC/LATINO - COLUMBIAN": "Ethnicity/Hispanic",
    "HISPANIC/LATINO - MEXICAN": "Ethnicity/Hispanic",
    "HISPANIC/LATINO - HONDURAN": "Ethnicity/Hispanic",
    "HISPANIC/LATINO - CUBAN": "Ethnicity/Hispanic",
    "HISPANIC/LATINO - CENTRAL AMERICAN": "Ethnicity/Hispanic",
}
ADMISSION_CODES = {
    "EW EMER.": "Visit/ERIP",
    "DIRECT EMER.": "Visit/IP",
    "URGENT": "Visit/IP",
    "ELECTIVE": "Visit/IP",
    "SURGICAL SAME DAY ADMISSION": "Visit/IP",
    "OBSERVATION ADMIT": "Visit/IP",
    "EU OBSERVATION": "Visit/ER",
    "DIRECT OBSERVATION": "Visit/OP",
    "AMBULATORY OBSERVATION": "Visit/OP",
}
CURATED_FAMILIES = {
    "MIMIC_IV_Gender": GENDER_CODES,
    "MIMIC_IV_Race": RACE_CODES,
    "MIMIC_IV_Admission": ADMISSION_CODES,
}


@dataclass(frozen=True)
class Lookup:
    """Columns an inner join adds to a raw table."""

    path: str
    on: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Measure:
    """What must be pinned before a numeric column holding many measurements means anything."""

    filters: tuple[str, ...]
    unit: str | None


@dataclass(frozen=True)
class RawTable:
    """One raw table: where it lies, its event time, and its columns with their types.

    A type of None reads the column but leaves it as it came.
    """

    path: str
    time: str | None
    columns: dict[str, str | None]
    lookup: Lookup | None = None
    measures: dict[str, Measure] = field(default_factory=dict)
    subject: str = "subject_id"


# ---- Fixed values: raw tables ------------------------------------------------------------
_DISCHARGE = Lookup("hosp/admissions.csv.gz", "hadm_id", ("dischtime",))
_CODED = {"hadm_id": "String", "icd_code": "String", "icd_version": "String", "seq_num": "UInt"}

RAW_TABLES: dict[str, RawTable] = {
    "patients": RawTable(
        "hosp/patients.csv.gz",
        None,
        {
            "gender": "String", "anchor_age": "UInt", "anchor_year": "UInt",
            "anchor_year_group": "String", "dod": "Date",
        },
    ),
    "admissions": RawTable(
        "hosp/admissions.csv.gz",
        "admittime",
        {
            "hadm_id": None, "admission_type": "String", "admission_location": "String",
            "insurance": "String", "language": "String", "marital_status": "String",
            "race": "String", "discharge_location": "String", "dischtime": "DateTime",
            "hospital_expire_flag": "Boolean",
        },
    ),
    "icustays": RawTable(
        "icu/icustays.csv.gz",
        "intime",
        {
            "hadm_id": "String", "stay_id": "String", "first_careunit": "String",
            "last_careunit": "String", "outtime": "DateTime",
        },
    ),
    "diagnoses_icd": RawTable("hosp/diagnoses_icd.csv.gz", "dischtime", _CODED, _DISCHARGE),
    "procedures_icd": RawTable("hosp/procedures_icd.csv.gz", "dischtime", _CODED, _DISCHARGE),
    "prescriptions": RawTable(
        "hosp/prescriptions.csv.gz",
        "starttime",
        {
            "hadm_id": "String", "drug": "String", "ndc": "String", "prod_strength": "String",
            "dose_val_rx": "Float", "dose_unit_rx": "String", "route": "String",
            "stoptime": "DateTime",
        },
        measures={
            "prescriptions/dose_val_rx": Measure(
                ("prescriptions/drug", "prescriptions/prod_strength"), "prescriptions/dose_unit_rx"
            )
        },
    ),
    "labevents": RawTable(
        "hosp/labevents.csv.gz",
        "charttime",
        {
            "hadm_id": "String", "itemid": None, "label": None, "fluid": None, "category": None,
            "value": "String", "valuenum": "Float", "valueuom": "String", "flag": "String",
            "storetime": "DateTime",
        },
        Lookup("hosp/d_labitems.csv.gz", "itemid", ("label", "fluid", "category")),
        {"labevents/valuenum": Measure(("labevents/label",), "labevents/valueuom")},
    ),
    "hcpcsevents": RawTable(
        "hosp/hcpcsevents.csv.gz",
        "chartdate",
        {
            "hadm_id": "String", "hcpcs_cd": "String", "seq_num": "UInt",
            "short_description": "String",
        },
    ),
}

UNIT_COLUMNS = ("labevents/valueuom", "prescriptions/dose_unit_rx")
