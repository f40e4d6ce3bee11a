"""The prepared-set builder.  The split counts classes while it is
built; the rest is one lazy chain.

select (pruned scan) -> normalise names -> tokens to NULL -> 0/1 label ->
stratified split on the key -> sentinel recode -> drop leakage and raw
target -> derived flags.  Encoders are *not* fitted here: they belong to
the model pipeline and are fitted on the train split only
(``encode_on_train``), so no test information reaches them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.operators import encode, quality, split, transforms
from callrank.session import scratch_path
from callrank.spec import FeatureSpec


def prepare(df: DataFrame, spec: FeatureSpec, test_fraction: float = 0.2,
            flags: Mapping[str, Column] | None = None, exact_split: bool = True,
            normalize: bool = True) -> DataFrame:
    if normalize:
        df = quality.normalize_names(df)
    missing = [c for c in spec.columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns of the feature spec are not in the input: {missing}")
    df = df.select(*spec.columns)
    if spec.null_tokens:
        df = transforms.replace_tokens(df, spec.null_tokens, spec.categorical)
    df = transforms.add_target(df, spec.target, spec.positive, spec.label)
    # a table without a key column is hashed on all its selected columns
    key = list(spec.key) or [c for c in df.columns if c != spec.label]
    df = split.stratified_split(df, spec.label, key, test_fraction, spec.seed, exact=exact_split)
    for col, (old, new) in spec.sentinels.items():
        df = (transforms.null_sentinel(df, col, old) if new is None else transforms.recode(df, col, old, new))
    df = transforms.drop_leakage(df, spec)
    if flags:
        df = transforms.add_flags(df, flags)
    return df


def encode_on_train(prepared: DataFrame, spec: FeatureSpec, split_col: str = "split") -> DataFrame:
    """E1 fitted on the train split, applied to both (unseen -> extra code)."""
    cats = list(spec.categorical)
    if not cats:
        return prepared
    # read by the fit and by the output: the rows are hashed once, into a
    # written table that survives lost executors and holds no memory
    path = scratch_path(prepared.sparkSession, "prepared")
    prepared.write.parquet(path)
    prepared = prepared.sparkSession.read.schema(prepared.schema).parquet(path)
    model = encode.label_encoder(cats).fit(prepared.where(F.col(split_col) == "train"))
    return model.transform(prepared).drop(*cats)
