"""Presets for the public bank telemarketing data layouts, so a campaign table in
either layout runs through the whole job with one call.

The EDA report is the notebook's first pass (shape, schema, profile, class
balance, conversion by job / month / prior contact) as DataFrames; the
training job is ``plans.train.train`` with the balanced forest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.operators import quality, segments, transforms
from callrank.spec import FeatureSpec

# Fixed values of the public layouts (column names, roles, sentinels).
# Anonymised 16-column layout: V1..V16 -> names of the 17-column file.
ANON_COLUMN_MAP = {
    "V1": "age", "V2": "job", "V3": "marital", "V4": "education", "V5": "default", "V6": "balance",
    "V7": "housing", "V8": "loan", "V9": "contact", "V10": "day", "V11": "month", "V12": "duration",
    "V13": "campaign", "V14": "pdays", "V15": "previous", "V16": "poutcome",
}
ANON_TARGET_MAP = {1: "no", 2: "yes"}
# 17-column layout (';' separated, header, pdays -1 = never contacted).
NUMERIC = ("age", "balance", "day", "campaign", "pdays", "previous")
CATEGORICAL = ("job", "marital", "education", "default", "housing", "loan", "contact", "month", "poutcome")
LEAKAGE = ("duration",)
TARGET, POSITIVE = "y", "yes"
# Extended layout (dotted names such as emp.var.rate; pdays 999 = never contacted).
EXTENDED_CATEGORICAL = ("job", "marital", "education", "contact", "month", "day_of_week", "poutcome",
                        "default", "housing", "loan")
EXTENDED_NEVER = 999

BANK_SPEC = FeatureSpec(numeric=NUMERIC, categorical=CATEGORICAL, target=TARGET, positive=POSITIVE,
                        leakage=LEAKAGE, seed=42)


def extended_spec(df: DataFrame) -> FeatureSpec:
    """Spec for the extended layout: every non-target, non-leakage column is
    a feature (numeric or categorical by type); 999 -> -1 in pdays."""
    df = quality.normalize_names(df)
    cats = tuple(c for c in EXTENDED_CATEGORICAL if c in df.columns)
    nums = tuple(f.name for f in df.schema.fields
                 if f.name not in cats and f.name not in (TARGET, *LEAKAGE)
                 and f.dataType.simpleString() in ("int", "bigint", "double", "float", "smallint"))
    return FeatureSpec(numeric=nums, categorical=cats, target=TARGET, positive=POSITIVE, leakage=LEAKAGE,
                       sentinels={"pdays": (EXTENDED_NEVER, -1)} if "pdays" in df.columns else {}, seed=42)


def read_bank_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The 17-column ';' file; ``unknown`` cells become NULL."""
    from callrank.sources.readers import load_data
    return load_data(spark, path, schema, sep=";", null_tokens=["unknown"])


def from_anonymised(df: DataFrame, target_col: str = "Class") -> DataFrame:
    """The anonymised layout with its 1/2 target."""
    from callrank.sources.readers import from_anonymous
    return from_anonymous(df, ANON_COLUMN_MAP, target_source=target_col, target=TARGET,
                          target_map=ANON_TARGET_MAP, categorical=CATEGORICAL)


def eda_report(df: DataFrame, never: int | None = EXTENDED_NEVER) -> dict[str, DataFrame]:
    """The EDA pass as named DataFrames (nothing collected)."""
    df = quality.normalize_names(df)
    lab = transforms.add_target(df, TARGET, POSITIVE)
    out = {
        "shape": quality.shape(df),
        "schema": quality.schema_rows(df),
        "profile": quality.describe_typed(df),
        "class_balance": segments.class_balance(df, TARGET),
    }
    if "job" in df.columns:
        out["conversion_by_job"] = segments.conversion_by_segment(lab, "job")
    if "month" in df.columns:
        out["conversion_by_month"] = segments.conversion_by_segment(lab, "month")
        conv = segments.conversion_by_segment(lab, "month")
        out["channel_efficiency"] = segments.channel_efficiency(conv, "month")
    if "pdays" in df.columns and never is not None:
        clean = transforms.null_sentinel(lab, "pdays", never, out="pdays_clean")
        out["conversion_by_prior_contact"] = segments.conversion_by_null_flag(clean, "pdays_clean",
                                                                              "never_contacted")
    return out


def train_bank_model(spark: SparkSession, df: DataFrame, spec: FeatureSpec = BANK_SPEC,
                     out_dir: str | None = None, trees: int = 300):
    """The training job: balanced forest (300 trees, depth 12, leaf >= 20),
    stratified 80/20 split, threshold 0.5, metrics, importances, domains."""
    from callrank.operators import models
    from callrank.plans.train import train
    return train(spark, df, spec, models.balanced_forest(trees=trees, max_depth=12, min_leaf=20),
                 threshold=0.5, out_dir=out_dir)


def pdays_flags() -> dict:
    """The three derived flags of the preparation notebook, as conditions."""
    return {"was_contacted": F.col("pdays") != -1, "intensive_contact": F.col("campaign") > 3,
            "favourable_economy": F.col("emp_var_rate") < 0}
