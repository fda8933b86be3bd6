"""Fixed values of the study: they must keep these exact spellings and numbers.

Fixed values, in the order in which they apply: rule tables are first match wins.
"""

from __future__ import annotations

from typing import NamedTuple

# --- fixed values: read support a variant call needs -----------------------
MIN_DEPTH = 20
MIN_MINOR_READS = 3
STRAND_COUNTS = ("F1R2_1", "F1R2_2", "F2R1_1", "F2R1_2")
MAX_BINOMIAL_P = 0.01
SINGLE_COPY_PLOIDY = "XY"
TWO_COPY_PLOIDY = "XX"
HIGH_AF = 0.3

# --- fixed values: positional types of the call file -----------------------
# c text, i whole number, d decimal number, _ column left out
CALL_TYPE_CODES = "ciicc ccccc ccccc ccccc ccccc cccic cciii ddiii iii_".replace(" ", "")

# --- fixed values: the protein field of a call -----------------------------
AA_CHANGE_SEPARATOR = ":|,"
AA_CHANGE_FIELDS = (
    "gene_name1", "transcript1", "exon1", "dna1", "protein1",
    "gene_name2", "transcript2", "exon2", "dna2", "protein2",
)

# --- fixed values: study design --------------------------------------------
CONTROLS_PER_CASE = 10
MATCH_STRATA = ("age_at_biosample", "dragen_sex_ploidy", "ancestry_pred")
AS_OF_YEAR = 2023
ARM_ORDER = ("ctrl_female", "ctrl_male", "case_female", "case_male")

# --- fixed values: lab naming, units and ranges ----------------------------
LAB_SENTINELS = (0.0, 1e7, 1e8)
LAB_NAME_RULES = (
    ("^leuko", "wbc"),
    ("lympho", "lympho"),
    ("platelet", "plt"),
    ("hemoglobin", "hgb"),
    ("sedimentation", "esr"),
    ("reactive", "crp"),
    ("MCV", "mcv"),
)
NO_UNIT = "nounit"


class LabRule(NamedTuple):
    lab: str
    scale_unit: str | None
    divide_by: float
    multiply_by: float
    units_kept: tuple[str, ...] | None
    units_dropped: tuple[str, ...]
    low: float | None
    high: float | None
    extreme: str
    digits: int


LAB_RULES = (
    LabRule("wbc", "per cubic millimeter", 1000.0, 1.0, None, (), 0.1, 50.0, "min", 1),
    LabRule("lympho", None, 1.0, 1.0,
            ("percent", "No matching concept", "no value", "Percent",
             "percent of white blood cells", "nounits", "Percentage unit"),
            (), 0.0, 100.0, "min", 1),
    LabRule("hgb", "gram per liter", 10.0, 1.0, None, (), None, None, "min", 1),
    LabRule("mcv", None, 1.0, 1.0, None, (), None, None, "max", 0),
    LabRule("esr", None, 1.0, 1.0, None, ("mmol/h",), None, None, "max", 0),
    LabRule("crp", "milligram per deciliter", 1.0, 10.0, None, ("mg/L",), None, None, "max", 0),
)

# --- fixed values: diagnosis classes ---------------------------------------
MANIFESTATION_RULES = (
    ("iridocyclitis|(inflammatory eye)|(chondritis)|(sensorineural hearing)|cryopyrin|fever|(periorbital edema)",
     "head and neck"),
    ("alveolitis|(pleural effusion)|(myocarditis)|(pulmonary infiltrates)", "thorax"),
    ("myelodysplastic|myeloma|anemia|leukopenia|thrombocytopenia", "marrow"),
    ("splenomegaly|colitis", "abdomen"),
    ("(rheumatoid arthritis)|lupus|sjogren|scleroderma|myositis|(psoriatic arthritis)|ankylosing|behcet",
     "inflammatory\narthritis"),
    ("epididymitis|orchitis", "pelvis"),
    ("arteritis|angiitis|vasculitis|aortitis|takayasu|(giant cell arteritis)|kawasaki", "vasculitis"),
    ("dermatosis|urticaria|psoriasis|sweet", "cutaneous"),
    ("thrombosis|(pulmonary embolism)|stroke", "thrombosis"),
)

# --- fixed values: medication classes --------------------------------------
MEDICATION_RULES = (
    ("predni|dexamethasone", "systemic steroid"),
    ("cortisone|fluocinolone|budesonide|desonide|fluocinonide|triamcinolone|hydrocortisone|clobetasol|betamethasone",
     "topical steroid"),
    ("beclomethasone|mometasone", "inhaled steroid"),
    ("tacro|cyclosporine", "CNI"),
    ("methotrexate|leflunomide|azathioprine|mycophen", "cDMARD"),
    ("infliximab|adalimumab|golimumab|etanercept|tocilizumab|guselkumab|ustekinumab|abatacept|apremilast",
     "bDMARD"),
    ("tofacitinib", "tsDMARD"),
)

# --- fixed values: covariates of the two regressions -----------------------
DEMOGRAPHIC_COVARIATES = ("age_at_biosample", "sex_at_birth", "race", "ethnicity")
GENOMIC_COVARIATES = ("age_at_biosample", "dragen_sex_ploidy", "ancestry_pred")

# --- fixed values: report lengths and plot limits --------------------------
TOP_SNOMED, TOP_ICD, TOP_MANIFESTATIONS = 30, 20, 10
FOREST_MAX_HIGH_DIAGNOSES, FOREST_MAX_HIGH_MEDICATIONS = 50.0, 10.0
