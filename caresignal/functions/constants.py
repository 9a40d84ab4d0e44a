"""Fixed values that results depend on.

FIXED VALUES: these lists and tables must keep these exact values and order for
results to agree with the behaviour being reproduced. They are plain data.
"""

# --- FIXED VALUES: missing-value tokens of a default pandas CSV read -------------
DEFAULT_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- FIXED VALUES: extra tokens used when loading the encounter table -----------
ENCOUNTER_EXTRA_NULL_TOKENS = ("?", "Unknown/Invalid", "None")

# --- FIXED VALUES: HRRP measure code -> clinical condition ----------------------
MEASURE_CONDITIONS = (
    ("READM-30-AMI-HRRP", "Acute Myocardial Infarction (AMI)"),
    ("READM-30-HF-HRRP", "Heart Failure (HF)"),
    ("READM-30-COPD-HRRP", "COPD"),
    ("READM-30-PN-HRRP", "Pneumonia"),
    ("READM-30-CABG-HRRP", "CABG"),
    ("READM-30-HIP-KNEE-HRRP", "Hip/Knee Replacement"),
)

# --- FIXED VALUES: hospital CSV columns (source names) --------------------------
HRRP_COLUMNS = (
    "Facility Name", "Facility ID", "State", "Measure Name",
    "Number of Discharges", "Footnote", "Excess Readmission Ratio",
    "Predicted Readmission Rate", "Expected Readmission Rate",
    "Number of Readmissions", "Start Date", "End Date",
)
HRRP_NUMERIC_COLUMNS = (
    "Number of Discharges", "Excess Readmission Ratio",
    "Predicted Readmission Rate", "Expected Readmission Rate",
)

# --- FIXED VALUES: clean export (source column -> export column), in order ------
CLEAN_EXPORT_COLUMNS = (
    ("Facility ID", "Facility_ID"),
    ("Facility Name", "Facility_Name"),
    ("State", "State"),
    ("Condition", "Condition"),
    ("Number of Discharges", "Number_of_Discharges"),
    ("Number of Readmissions Numeric", "Number_of_Readmissions"),
    ("Excess Readmission Ratio", "Excess_Readmission_Ratio"),
    ("Predicted Readmission Rate", "Predicted_Readmission_Rate"),
    ("Expected Readmission Rate", "Expected_Readmission_Rate"),
    ("Start Date", "Start_Date"),
    ("End Date", "End_Date"),
)

# --- FIXED VALUES: hospital signal rules ----------------------------------------
PERSISTENT_MIN_CONDITIONS = 5
STATE_MIN_RECORDS = 100
SIGNAL_BAND_HIGH = 1.05
SIGNAL_BAND_LOW = 0.98

# --- FIXED VALUES: encounter table ------------------------------------------------
ID_COLUMNS = ("encounter_id", "patient_nbr")
TARGET_COLUMN = "readmitted"
POSITIVE_TARGET = "<30"
SPARSE_MISSING_SHARE = 0.80
SPLIT_SEED = 42
SPLIT_TRAIN_PCT = 64
SPLIT_VALIDATION_PCT = 16

# --- FIXED VALUES: feature groups removed in ablation ------------------------------
FEATURE_GROUPS = (
    ("prior_utilization", ("number_inpatient", "number_emergency", "number_outpatient")),
    ("diagnoses", ("diag_1", "diag_2", "diag_3", "number_diagnoses")),
    ("medication_burden", ("num_medications",)),
    ("hospital_course", ("time_in_hospital", "num_lab_procedures", "num_procedures")),
    ("discharge_and_admission", ("admission_type_id", "discharge_disposition_id", "admission_source_id")),
    ("demographics", ("age", "gender", "race")),
)
DIAGNOSIS_REDUCED_DROP = ("diag_1", "diag_2", "diag_3", "number_diagnoses")

# --- FIXED VALUES: threshold grids (integer percent points) ------------------------
REPORT_GRID_PCT = tuple(range(30, 81, 5))      # 0.30 .. 0.80 step 0.05
SELECTION_GRID_PCT = tuple(range(10, 91))      # 0.10 .. 0.90 step 0.01

# --- FIXED VALUES: inference guard ---------------------------------------------------
RESEARCH_THRESHOLD = 0.13
ACK_FIELD = "research_acknowledged"
REQUIRED_RESEARCH_FIELDS = (
    "age", "gender", "number_inpatient", "number_emergency",
    "time_in_hospital", "num_medications", "number_diagnoses", "diag_1",
)
NUMERIC_FIELDS = (
    "admission_type_id", "discharge_disposition_id", "admission_source_id",
    "time_in_hospital", "num_lab_procedures", "num_procedures",
    "num_medications", "number_outpatient", "number_emergency",
    "number_inpatient", "number_diagnoses",
)
GLOBAL_DRIVER_FIELDS = (
    "number_inpatient", "diag_1", "diag_2", "diag_3",
    "discharge_disposition_id", "medical_specialty", "number_emergency", "age",
)

# --- FIXED VALUES: error profile focus columns -------------------------------------
FOCUS_NUMERIC = (
    "number_inpatient", "number_emergency", "number_outpatient", "time_in_hospital",
    "num_medications", "num_lab_procedures", "num_procedures", "number_diagnoses",
)
FOCUS_CATEGORICAL = ("age", "admission_type_id", "discharge_disposition_id", "admission_source_id")
CATEGORICAL_TOP_K = 10

# --- FIXED VALUES: model registry (id, status, task, data_source, unit, allowed) -------
HOSPITAL_TASK = "hospital_level_readmission_intelligence"
SANDBOX_MODEL_ID = "dubai-nabidh-external-validation"
SANDBOX_UNIT_ALIAS = "authorized Dubai sandbox data"
REGISTRY_MODELS = (
    ("cms-hrrp-hospital-intelligence-v1", "analytics_ready",
     "hospital_level_readmission_intelligence", "CMS HRRP FY 2026",
     "hospital-condition record", False, None),
    ("uci-diabetes-readmission-hgb-v2", "research_candidate_selected_probability_locked",
     "patient_30_day_readmission_probability", "UCI Diabetes 130-US Hospitals 1999-2008",
     "patient encounter", False,
     "Do not enable public or clinical patient probabilities until calibration is reviewed "
     "for intended use, operational alert burden is reduced to an acceptable predefined level, "
     "subgroup performance is assessed, and external validation/governance approval is completed."),
    ("dubai-nabidh-external-validation", "future_authorized_sandbox_only",
     "external_validation_and_local_calibration", "authorized Dubai/NABIDH sandbox data",
     "to be defined by approved pilot dataset", False,
     "Requires sandbox authorization, semantic mapping, local validation and governance approval."),
)

# --- FIXED VALUES: clinical code tables (code, label) ---------------------------------
DIAGNOSIS_CODES = (
    ("428", "Heart failure"),
    ("250.4", "Diabetes with renal manifestations"),
    ("401", "Hypertension"),
    ("414", "Coronary atherosclerosis"),
    ("410", "Acute myocardial infarction"),
    ("486", "Pneumonia"),
    ("491", "Chronic bronchitis / COPD-related"),
    ("584", "Acute kidney failure"),
    ("599", "Urinary tract disorder / UTI-related"),
    ("786", "Chest pain / respiratory symptom"),
)
DISCHARGE_CODES = (
    ("1", "Home / self care"),
    ("3", "Skilled nursing facility"),
    ("6", "Home with health service"),
    ("2", "Short-term hospital"),
    ("4", "Intermediate care facility"),
    ("5", "Other inpatient institution"),
    ("22", "Rehabilitation facility"),
)
ADMISSION_TYPE_CODES = (
    ("1", "Emergency"),
    ("2", "Urgent"),
    ("3", "Elective"),
    ("4", "Newborn"),
    ("5", "Not available"),
    ("6", "NULL / unknown"),
    ("7", "Trauma center"),
    ("8", "Not mapped"),
)
ADMISSION_SOURCE_CODES = (
    ("7", "Emergency room"),
    ("1", "Physician referral"),
    ("2", "Clinic referral"),
    ("3", "HMO referral"),
    ("4", "Transfer from hospital"),
    ("5", "Transfer from skilled nursing facility"),
    ("6", "Transfer from another health facility"),
    ("9", "Information not available"),
)
CHANGE_CODES = (
    ("No", "No change"),
    ("Ch", "Changed"),
)
DIMENSIONS = (
    ("diag_1", DIAGNOSIS_CODES),
    ("diag_2", DIAGNOSIS_CODES),
    ("diag_3", DIAGNOSIS_CODES),
    ("discharge_disposition_id", DISCHARGE_CODES),
    ("admission_type_id", ADMISSION_TYPE_CODES),
    ("admission_source_id", ADMISSION_SOURCE_CODES),
    ("change", CHANGE_CODES),
)
