"""Table and column names of the common data model and of the sequence format."""

# Names, concept ids and token spellings that results must agree on.
START_DATE_COLUMN = {
    "condition_occurrence": "condition_start_date",
    "drug_exposure": "drug_exposure_start_date",
    "procedure_occurrence": "procedure_date",
    "device_exposure": "device_exposure_start_date",
    "measurement": "measurement_date",
    "observation": "observation_date",
    "death": "death_date",
}
CONCEPT_COLUMN = {
    "condition_occurrence": "condition_concept_id",
    "drug_exposure": "drug_concept_id",
    "procedure_occurrence": "procedure_concept_id",
    "device_exposure": "device_concept_id",
    "measurement": "measurement_concept_id",
    "observation": "observation_concept_id",
}
DEATH_CONCEPT_ID = 4306655
EMERGENCY_VISIT = 9203
OUTPATIENT_VISIT = 9201
GENDER_MALE = 8507
GENDER_FEMALE = 8532
PIPELINE_MISSING_VISIT_CONCEPT = 1

SPECIAL_TOKENS = ["[PAD]", "[MASK]", "[OOV]", "[CLS]"]
PAD_ID, MASK_ID, OOV_ID, CLS_ID, FIRST_TOKEN_ID = 0, 1, 2, 3, 4

VISIT_START, VISIT_END = "VS", "VE"
SORT_INTERVAL, SORT_VISIT_START, SORT_VISIT_END = -2, -1, 9223372036854775807

# Columns read per table, with the type every later step relies on. Dates stored as
# timestamps are cut to dates at the source.
CDM_SCHEMA = {
    "person": {
        "person_id": "bigint",
        "year_of_birth": "int",
        "month_of_birth": "int",
        "day_of_birth": "int",
        "gender_concept_id": "bigint",
    },
    "observation_period": {
        "person_id": "bigint",
        "observation_period_id": "bigint",
        "observation_period_start_date": "date",
        "observation_period_end_date": "date",
    },
    "visit_occurrence": {
        "person_id": "bigint",
        "visit_occurrence_id": "bigint",
        "visit_start_date": "date",
        "visit_end_date": "date",
        "visit_concept_id": "bigint",
    },
    **{
        domain: {
            "person_id": "bigint",
            START_DATE_COLUMN[domain]: "date",
            CONCEPT_COLUMN[domain]: "bigint",
            "visit_occurrence_id": "bigint",
        }
        for domain in CONCEPT_COLUMN
    },
    "death": {"person_id": "bigint", "death_date": "date"},
    "concept": {"concept_id": "bigint", "concept_class_id": "string"},
    "concept_ancestor": {
        "ancestor_concept_id": "bigint",
        "descendant_concept_id": "bigint",
    },
}
PATIENT_TABLES = [t for t in CDM_SCHEMA if t not in ("concept", "concept_ancestor")]

EVENT_COLUMNS = ["person_id", "start_date", "concept_id", "visit_occurrence_id"]
PERIOD_KEY = ["person_id", "observation_period_id"]
# The parallel arrays of a sequence row; in the long form each is one column.
SEQUENCE_ARRAYS = [
    "concept_ids",
    "visit_segments",
    "dates",
    "ages",
    "visit_concept_orders",
    "visit_concept_ids",
    "orders",
]

# Name of the sequences among bucketed tables.
SEQUENCE_TABLE = "sequences"
