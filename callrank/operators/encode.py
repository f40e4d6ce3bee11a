"""Feature encoding (E1-E5) with pyspark.ml.

Encoders are fitted on the training split only; the learned label arrays
are category domains (bounded), the only thing that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_encoder(cols: Iterable[str], suffix: str = "_idx", keep_unseen: bool = True) -> StringIndexer:
    """Sorted label codes (code point order), one indexer for all columns."""
    cols = list(cols)
    return StringIndexer(inputCols=cols, outputCols=[c + suffix for c in cols],
                         stringOrderType="alphabetAsc",
                         handleInvalid="keep" if keep_unseen else "error")


def one_hot(cols: Iterable[str], idx_suffix: str = "_idx", ohe_suffix: str = "_ohe") -> list:
    """One-hot with unknown ignored: index with handleInvalid='keep' (the
    extra slot is last) and drop the last slot, so unseen values and NULL
    encode as all zeros and each column gets as many slots as it had
    training values."""
    cols = list(cols)
    idx = StringIndexer(inputCols=cols, outputCols=[c + idx_suffix for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    # the indexer's "keep" slot is the last one, so dropLast removes exactly it
    ohe = OneHotEncoder(inputCols=[c + idx_suffix for c in cols], outputCols=[c + ohe_suffix for c in cols],
                        dropLast=True)
    return [idx, ohe]


def preprocessor(numeric: Iterable[str], categorical: Iterable[str],
                 features: str = "features") -> list:
    """Numeric passthrough ++ one-hot blocks, in that order."""
    categorical = list(categorical)
    stages = one_hot(categorical) if categorical else []
    stages.append(VectorAssembler(inputCols=list(numeric) + [c + "_ohe" for c in categorical],
                                  outputCol=features, handleInvalid="keep"))
    return stages


def build_pipeline(numeric: Iterable[str], categorical: Iterable[str], classifier,
                   features: str = "features") -> Pipeline:
    """Preprocessing + classifier as one pyspark.ml Pipeline."""
    return Pipeline(stages=preprocessor(numeric, categorical, features) + [classifier])


def expanded_feature_names(df: DataFrame, features: str = "features") -> list[str]:
    """Names of the assembled slots (numeric names, then ``col_value``),
    read from the ml_attr metadata of the vector column."""
    meta = df.schema[features].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    names = [None] * meta.get("num_attrs", len(attrs))
    for a in attrs:
        nm = a.get("name", str(a["idx"]))
        names[a["idx"]] = nm.replace("_ohe_", "_", 1) if "_ohe_" in nm else nm
    return names


def feature_names_frame(df: DataFrame, features: str = "features") -> DataFrame:
    """E4 as rows (position, feature)."""
    names = expanded_feature_names(df, features)
    return df.sparkSession.createDataFrame(list(enumerate(names)), "position int, feature string")


def unpack_vector(df: DataFrame, vec: str, names: list[str]) -> DataFrame:
    """Vector column -> one double column per slot (for checks and exports)."""
    arr = vector_to_array(F.col(vec))
    return df.withColumns({n: arr[i] for i, n in enumerate(names)})


def class_weights(df: DataFrame, label: str = "label", max_classes: int = 1000) -> dict:
    """E5 fit: balanced weights w_c = n / (k * n_c).  The class count table
    is bounded by the number of classes (checked) before it is collected."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1).collect()
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} classes in {label!r}")
    n, k = sum(r["n"] for r in counts), len(counts)
    return {r[label]: n / (k * r["n"]) for r in counts}


def with_class_weight(df: DataFrame, label: str = "label", weight: str = "weight",
                      weights: dict | None = None) -> DataFrame:
    """E5 apply: weight column from a literal map (stays in codegen, no join)."""
    weights = weights if weights is not None else class_weights(df, label)
    pairs = []
    for k, v in weights.items():
        pairs += [F.lit(k), F.lit(float(v))]
    return df.withColumn(weight, F.create_map(*pairs)[F.col(label)])


def fitted_domains(model: PipelineModel | StringIndexer) -> dict:
    """Category domains learned by the indexers of a fitted pipeline (K2)."""
    from pyspark.ml.feature import StringIndexerModel
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    out = {}
    for s in stages:
        if isinstance(s, StringIndexerModel):
            ins = s.getInputCols() if s.isSet("inputCols") else [s.getInputCol()]
            for c, labels in zip(ins, s.labelsArray):
                out[c] = list(labels)
    return out
