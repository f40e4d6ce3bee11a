"""A corpus from raw documents to packed sequences, in five stages.

Each stage gets what its predecessor kept, written as Parquet and read
again, and calls one operator of ``callrank.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.llm import decontaminate, langid, line_dedup, packing, simhash
from callrank.llm.common import materialise
from callrank.llm.queries import table, tokenizer_path

#: Documents of whose n-grams the model knows a smaller share are in none of
#: its languages, however many it has.
LEAST_KNOWN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a recognised language; null and letterless texts go,
    and those of whose n-grams less than ``LEAST_KNOWN`` are known.  If no
    row is labelled, no language is learned and all texts with a letter stay."""
    model = langid.fit_language_model(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    spare = {c: f"_{c}" for c in ("score", "lang_pred", "known_share")}
    out = langid.identify_languages(docs.withColumnsRenamed(spare), model, share="known_share")
    out = out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("known_share") >= LEAST_KNOWN))
    out = out.drop("lang_pred", "score", "known_share")
    return out.toDF(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that occur, exactly or nearly, elsewhere earlier."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component."""
    return simhash.drop_near_duplicates(docs, shingle=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of 2048 ids."""
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("packing", pack_sequences),
]

#: Fingerprints, language scores and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
