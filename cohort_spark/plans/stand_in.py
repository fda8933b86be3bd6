"""The given tables seen as study tables.

Persons are customers, calls and diagnoses are order lines, labs are events.
Every column is derived by Spark from the given rows, so all of it grows with
them; edge cases (missing dates, sentinels, mixed units, dotted codes) come
from key arithmetic.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_spark.operators.joins import shuffled
from cohort_spark.plans.study import Study
from cohort_spark.sources.study_tables import LazySources

GENE = "Brand#12"
SITE_PATTERN = "E[0-9]+[A-Z]"
RATIO = 2

DISEASES = (
    "Iron deficiency anemia", "Fever", "Psoriasis", "Ulcerative colitis",
    "Giant cell arteritis", "Deep vein thrombosis", "Rheumatoid arthritis", "Orchitis",
    "Pleural effusion", "Urticaria", "Sensorineural hearing loss", "Myelodysplastic syndrome",
    "Essential hypertension", "Type 2 diabetes mellitus", "Asthma", "Low back pain",
    "Acute bronchitis", "Hyperlipidemia", "Migraine", "Gout",
    "Osteoporosis", "Cataract", "Hypothyroidism", "Thrombocytopenia with fever",
)
DRUGS = (
    "prednisone", "Dexamethasone", "hydrocortisone cream", "budesonide", "Mometasone",
    "tacrolimus", "methotrexate", "azathioprine", "adalimumab", "tofacitinib",
    "lisinopril", "metformin", "atorvastatin", "Prednisolone and cortisone",
    "ibuprofen", "amlodipine",
)
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table under its declared schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _brand(col: str = "p_brand") -> Column:
    return F.substring_index(F.col(col), "#", -1).cast("int")


# --- persons ------------------------------------------------------------------
def demographics(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    birth = F.date_add(F.lit("1964-01-15").cast("date"), (key * 7919 % 2200).cast("int"))
    return table(spark, sf_dir, "customer").select(
        key.alias("person_id"),
        F.when(key % 97 != 5, birth).alias("date_of_birth"),
        F.when(key % 2 == 0, "Female").otherwise("Male").alias("sex_at_birth"),
        F.when(key % 50 == 7, "Other").when(key % 2 == 0, "Woman").otherwise("Man").alias("gender"),
        F.col("c_mktsegment").alias("race"),
        F.when(key % 11 != 0, F.when(F.col("c_acctbal") > 5000, "Group A").otherwise("Group B"))
        .alias("ethnicity"))


def ancestry(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("c_custkey")
    return (table(spark, sf_dir, "customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(key.alias("research_id"),
                    F.when(key % 53 != 3, F.col("r_name")).alias("ancestry_pred")))


def metrics(spark, sf_dir) -> DataFrame:
    key = F.col("research_id")
    first = (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("research_id"))
             .agg(F.min("o_orderdate").cast("date").alias("biosample_collection_date")))
    ploidy = (F.when(key % 31 == 0, None).when(key % 29 == 0, "XXY")
              .when(key % 2 == 0, "XX").otherwise("XY"))
    return first.select(key, ploidy.alias("dragen_sex_ploidy"), "biosample_collection_date")


# --- order lines --------------------------------------------------------------
def person_lines(spark, sf_dir, part_cols: list[str], line_cols: list[str],
                 order_cols: list[str] = ()) -> DataFrame:
    """Order lines with their order and part.

    Parts come last: lines are shuffled twice, and of an order they carry little.
    Orders and parts grow with the lines, so neither is broadcast.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", *part_cols)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *order_cols)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", *line_cols)
    return (lines.join(shuffled(orders), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(shuffled(part), F.col("l_partkey") == F.col("p_partkey")))


def calls(spark, sf_dir) -> DataFrame:
    lines = person_lines(spark, sf_dir, ["p_name", "p_brand", "p_type", "p_size"],
                         ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus"])
    part, size, number = F.col("p_partkey"), F.col("p_size"), F.col("l_linenumber")
    depth = F.col("l_quantity").cast("int")
    f1, f2 = (F.round(F.col(c) * 100).cast("int") for c in ("l_discount", "l_tax"))
    splicing = number == 7

    def change(transcript: str) -> Column:
        return F.concat(F.col("p_brand"), F.lit(f":{transcript}_"), part, F.lit(":exon"), size,
                        F.lit(":c."), part % 300, F.lit("A>G:p."), F.substring("p_type", 1, 1),
                        size, F.upper(F.substring("p_name", 1, 1)))

    two = F.concat(change("NM"), F.lit(","), change("XM"))
    percent = F.floor(100 * number / depth).cast("string")
    return lines.select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("Sample"),
        F.lit("chrX").alias("Chr"), part.cast("int").alias("Start"),
        F.lit("A").alias("Ref"), F.when(F.col("l_linestatus") == "O", "G").otherwise("T").alias("Alt"),
        F.when(splicing, "splicing").otherwise("exonic").alias("Func.refGene"),
        F.col("p_brand").alias("Gene.refGene"),
        F.when(~splicing, F.when(part % 5 == 0, two).otherwise(change("NM"))).alias("AAChange.refGene"),
        F.when(part % 3 == 0, F.concat(F.lit("COSM"), part)).alias("cosmic70"),
        depth.alias("DP"), (depth - number).alias("maxAD"), number.alias("minAD"),
        F.concat(depth - number, F.lit(","), number).alias("AD"),
        F.concat(f1, F.lit(","), number).alias("F1R2"), F.concat(f2, F.lit(",1")).alias("F2R1"),
        F.concat(F.lit("SB"), number).alias("SB"),
        F.when(part % 40 == 0, "0.1,0.2")
        .otherwise(F.concat(F.lit("0."), F.lpad(percent, 2, "0"))).alias("AF"),
        f1.alias("F1R2_1"), number.alias("F1R2_2"), f2.alias("F2R1_1"), F.lit(1).alias("F2R1_2"),
        F.col("l_linestatus").alias("Otherinfo1"))


# --- diagnosis vocabularies ---------------------------------------------------
def disease(part: Column, part_type: Column) -> Column:
    return F.concat(_pick(DISEASES, part % len(DISEASES)), F.lit(", "), F.lower(part_type))


def snomed_id(part: Column, part_type: Column, size: Column) -> Column:
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPES]), part_type)
    return ((part % len(DISEASES)) * 12 + kind * 2 + size % 2).cast("bigint")


def icd10(brand: Column, size: Column, last: Column) -> Column:
    """Dotted code such as C07.1."""
    return F.concat(F.char(F.lit(65) + brand % 5), F.lpad((size % 10).cast("string"), 2, "0"),
                    F.lit("."), last)


def icd9(brand: Column, size: Column, last: Column) -> Column:
    return F.concat(100 + brand % 5 * 10 + size % 10, F.lit("."), last)


def diagnoses(spark, sf_dir) -> DataFrame:
    lines = person_lines(spark, sf_dir, ["p_brand", "p_type", "p_size"], [], ["o_orderdate"])
    part, kind, size, brand = F.col("p_partkey"), F.col("p_type"), F.col("p_size"), _brand()
    name, code = disease(part, kind), snomed_id(part, kind, size)
    ten = icd10(brand, size, part % 2)
    return lines.select(
        F.col("o_custkey").alias("person_id"),
        name.alias("standard_concept_name"), code.alias("standard_concept_code"),
        F.col("o_orderdate").alias("condition_start_datetime"),
        _pick(("ICD10CM", "ICD9CM", "SNOMED"), part % 3).alias("source_vocabulary"),
        F.when(part % 3 == 0, ten).when(part % 3 == 1, icd9(brand, size, part % 2))
        .otherwise(code.cast("string")).alias("source_concept_code"),
        F.when(part % 101 == 0, None)
        .when(part % 3 == 0, F.concat(F.lit("Condition "), ten,
                                      F.when(part % 7 == 0, " NOS").otherwise("")))
        .otherwise(name).alias("source_concept_name"))


def gem(spark, sf_dir) -> DataFrame:
    part, size, brand = F.col("p_partkey"), F.col("p_size"), _brand()
    plain = F.regexp_replace
    return (table(spark, sf_dir, "part")
            .select(plain(icd10(brand, size, (part + size) % 2), r"\.", "").alias("icd10cm"),
                    plain(icd9(brand, size, part % 2), r"\.", "").alias("icd9cm"))
            .distinct())


def snomed_map(spark, sf_dir) -> DataFrame:
    part, kind, size, brand = F.col("p_partkey"), F.col("p_type"), F.col("p_size"), _brand()
    name = F.concat(disease(part, kind), F.when(size % 9 == 0, " (disorder)").otherwise(""))
    return (table(spark, sf_dir, "part")
            .select(snomed_id(part, kind, size).alias("referencedComponentId"),
                    name.alias("referencedComponentName"),
                    (1 + brand % 2).alias("mapGroup"), (1 + size % 2).alias("mapPriority"),
                    icd10(brand, size, part % 2).alias("mapTarget"))
            .groupBy("referencedComponentId", "mapGroup", "mapPriority")
            .agg(F.max("referencedComponentName").alias("referencedComponentName"),
                 F.min("mapTarget").alias("mapTarget"))
            .withColumn("mapTargetName", F.concat(F.lit("Condition "), F.col("mapTarget"))))


def phecodes(spark, sf_dir) -> DataFrame:
    size, brand = F.col("p_size"), _brand()
    own = F.struct((brand % 5 * 100 + size % 10).cast("string").alias("phecode"),
                   F.concat(F.lit("Phenotype "), brand % 5, F.lit("-"), size % 10).alias("phecode_str"))
    general = F.struct((brand % 5 * 100 + 99).cast("string").alias("phecode"),
                       F.concat(F.lit("Phenotype group "), brand % 5).alias("phecode_str"))
    both = F.when(size % 10 < 4, F.array(own, general)).otherwise(F.array(own))
    return (table(spark, sf_dir, "part")
            .select(icd10(brand, size, F.col("p_partkey") % 2).alias("icd10cm"),
                    F.explode(both).alias("p"))
            .select("icd10cm", "p.phecode", "p.phecode_str").distinct())


def medications(spark, sf_dir) -> DataFrame:
    lines = person_lines(spark, sf_dir, ["p_size"], ["l_shipdate"])
    part = F.col("p_partkey")
    return lines.select(
        F.col("o_custkey").alias("person_id"),
        F.when(part % 89 != 0, F.concat(_pick(DRUGS, part % len(DRUGS)), F.lit(" "),
                                        F.col("p_size"), F.lit(" MG"))).alias("standard_concept_name"),
        F.col("l_shipdate").alias("drug_exposure_start"))


# --- labs ---------------------------------------------------------------------
def labs(spark, sf_dir) -> DataFrame:
    key, kind = F.col("event_id"), F.col("event_type")
    even = key % 2 == 0
    name = (F.when((kind == "click") & even, "Leukocytes [#/volume] in Blood")
            .when(kind == "click", "Lymphocytes/100 leukocytes in Blood")
            .when((kind == "error") & even, "Hemoglobin [Mass/volume] in Blood")
            .when(kind == "error", "Platelets [#/volume] in Blood")
            .when(kind == "purchase", "MCV [Entitic volume] by Automated count")
            .when(kind == "signup", "Erythrocyte sedimentation rate")
            .when((kind == "view") & even, "C reactive protein [Mass/volume]")
            .when(kind == "view", "Sodium [Moles/volume] in Serum"))
    unit = F.when(key % 8 == 0, None).otherwise(_pick(
        ("", "per cubic millimeter", "percent", "gram per liter", "mmol/h",
         "milligram per deciliter", "mg/L", "Percent"), key % 8))
    value = (F.when(key % 101 == 0, F.lit(1e7)).when(key % 103 == 0, None)
             .when(key % 107 == 0, F.lit(0.0)).otherwise(F.col("value")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("person_id"), name.alias("standard_concept_name"),
        value.alias("value_as_number"), unit.alias("unit_concept_name"),
        F.col("ts").alias("measurement_datetime"))


def sources(spark: SparkSession, sf_dir: str) -> LazySources:
    return LazySources(**{make.__name__: partial(make, spark, sf_dir) for make in (
        demographics, ancestry, metrics, calls, labs, diagnoses, gem, snomed_map, phecodes,
        medications)})


def study(spark: SparkSession, sf_dir: str, literal: bool = False) -> Study:
    return Study(sources(spark, sf_dir), GENE, SITE_PATTERN, ratio=RATIO,
                 medication_order=("drug_exposure_start", "standard_concept_name"), literal=literal)
