"""K4 training job, its stored artefact and the K3 model card.

train(): prepare -> split -> balanced weights -> pipeline fit on train ->
score test -> exact AUC / average precision / confusion / reduced ROC ->
feature importances -> domains and ranges; optionally stored (``persist``).
The prepared rows and the test scores are read several times, so each is
written once to the shared folder.  Every step is a DataFrame; the driver
holds the fitted model and a handful of scalars only.

Stored folder: ``model`` (fitted pipeline), ``metrics`` (one JSON row:
scalars, confusion cells and top features, by ``METRICS_SCHEMA``), and the
tables ``roc``, ``domains`` and ``ranges``.  ``load_artifact`` reads it back;
K1 and K3 need nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.operators import encode, evaluate, models, quality, score, segments
from callrank.plans.prepare import prepare
from callrank.session import scratch_path
from callrank.sources import sinks
from callrank.spec import FeatureSpec


METRICS_SCHEMA = ("n_train bigint, n_test bigint, positive_rate double, test_roc_auc double, test_pr_auc double, "
                  "threshold double, confusion array<struct<actual: int, predicted: int, n: bigint>>, "
                  "top_features array<struct<feature: string, importance: double>>")
ROC_SCHEMA = "threshold double, position bigint, fpr double, tpr double"
DOMAINS_SCHEMA = "column_name string, value string"
RANGES_SCHEMA = "column_name string, lo double, hi double"
SCALARS = ["n_train", "n_test", "positive_rate", "test_roc_auc", "test_pr_auc", "threshold"]


@dataclass
class TrainResult:
    model: PipelineModel
    prepared: DataFrame
    scored: DataFrame          # test rows with p_yes, prediction
    metrics: DataFrame         # one row
    confusion: DataFrame
    roc: DataFrame             # without collinear points
    importances: DataFrame
    domains: DataFrame
    ranges: DataFrame


@dataclass
class Artifact:
    """What ``persist`` stored, read back."""
    model: PipelineModel
    metrics: DataFrame
    confusion: DataFrame
    roc: DataFrame
    importances: DataFrame
    domains: DataFrame
    ranges: DataFrame


def _once(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def train(spark: SparkSession, df: DataFrame, spec: FeatureSpec, classifier=None,
          threshold: float = 0.5, out_dir: str | None = None, top: int = 15,
          prepared: DataFrame | None = None, fitted: PipelineModel | None = None) -> TrainResult:
    """``prepared``: an already prepared set (else ``df`` is prepared and
    written once).  ``fitted``: an already fitted pipeline for the same spec
    (its fit is skipped; evaluation and reports are the same)."""
    prepared = prepared if prepared is not None else _once(prepare(df, spec), "prepared")
    train_df = prepared.where(F.col("split") == "train")
    test_df = prepared.where(F.col("split") == "test")
    weights = encode.class_weights(train_df, spec.label)
    train_df = encode.with_class_weight(train_df, spec.label, "weight", weights)
    clf = classifier or models.balanced_forest(label=spec.label)
    model = fitted or encode.build_pipeline(spec.numeric, spec.categorical, clf).fit(train_df)
    keep = [c for c in spec.key if c in test_df.columns] + [spec.label]
    scored = (models.with_scores(model, test_df).select(*keep, F.col("_p").alias("p_yes"))
                   .withColumn("prediction", (F.col("p_yes") >= threshold).cast("int")))
    scored = _once(scored, "scored")  # the forest is applied once
    st = _once(evaluate.score_table(scored, spec.label, "p_yes"), "scores")
    counts = prepared.agg(F.count_if(F.col("split") == "train").alias("n_train"),
                          F.count_if(F.col("split") == "test").alias("n_test"),
                          F.avg(F.col(spec.label).cast("double")).alias("positive_rate"))
    one = (counts.withColumn("test_roc_auc", evaluate.auc_of(st).select("auc").scalar())
                 .withColumn("test_pr_auc", evaluate.average_precision_of(st).select("average_precision").scalar())
                 .withColumn("threshold", F.lit(float(threshold))))
    confusion = evaluate.confusion_matrix(scored, spec.label, "prediction")
    roc = evaluate.roc_curve_of(st, "p_yes", drop_intermediate=True)
    names = encode.expanded_feature_names(model.transform(train_df.limit(1)), "features")
    imp = segments.ordered(models.feature_importances(spark, model.stages[-1], names), ["importance"], False,
                           ["feature"]).limit(top)
    domains = quality.category_domains(train_df, list(spec.categorical))
    ranges = score.numeric_ranges(train_df, list(spec.numeric))
    res = TrainResult(model, prepared, scored, one, confusion, roc, imp, domains, ranges)
    if out_dir:
        persist(res, out_dir)
    return res


def persist(res: TrainResult, out_dir: str) -> None:
    """S8 + S9: the folder described at the top of this module.  The metrics
    go last: a folder with metrics is whole."""
    sinks.save_model(res.model, f"{out_dir}/model")
    for name in ("roc", "domains", "ranges"):
        getattr(res, name).write.mode("overwrite").parquet(f"{out_dir}/{name}")
    cells = res.confusion.agg(F.sort_array(F.collect_list(F.struct("actual", "predicted", "n"))))  # four cells
    tops = res.importances.agg(F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False).alias("t"))
    tops = tops.select(F.transform("t", lambda x: F.struct(x["feature"].alias("feature"),
                                                           x["importance"].alias("importance"))))  # ``top`` names
    sinks.write_metrics(res.metrics.withColumn("confusion", cells.scalar()).withColumn("top_features", tops.scalar()),
                        f"{out_dir}/metrics")


def load_artifact(spark: SparkSession, out_dir: str) -> Artifact:
    """Everything that ``persist`` stored; ``ArtifactMissingError`` names
    the part that is not there."""
    for part in ("metrics", "roc", "domains", "ranges"):
        sinks.require(spark, f"{out_dir}/{part}")
    model = sinks.load_model(spark, f"{out_dir}/model")
    metrics = sinks.load_metrics(spark, f"{out_dir}/metrics", METRICS_SCHEMA)
    roc, domains, ranges = (spark.read.schema(schema).parquet(f"{out_dir}/{part}") for part, schema in (
        ("roc", ROC_SCHEMA), ("domains", DOMAINS_SCHEMA), ("ranges", RANGES_SCHEMA)))
    return Artifact(model, metrics, metrics.select(F.inline("confusion")), roc,
                    metrics.select(F.inline("top_features")), domains, ranges)


def model_card(res: TrainResult | Artifact) -> DataFrame:
    """K3: one tidy table (section, item, x, y): metrics, confusion cells,
    ROC points and top features, of a training run or a stored artefact."""
    m = res.metrics
    metric_rows = m.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("x")) for c in SCALARS])).alias("r"))
    metrics = metric_rows.select(F.lit("metric").alias("section"), "r.item", "r.x", F.lit(None).cast("double").alias("y"))
    conf = res.confusion.select(F.lit("confusion").alias("section"),
                                F.concat(F.lit("actual="), F.col("actual").cast("string"),
                                         F.lit(",predicted="), F.col("predicted").cast("string")).alias("item"),
                                F.col("n").cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    roc = res.roc.select(F.lit("roc").alias("section"), F.col("position").cast("string").alias("item"),
                         F.col("fpr").alias("x"), F.col("tpr").alias("y"))
    feats = res.importances.select(F.lit("top_feature").alias("section"), F.col("feature").alias("item"),
                                   F.col("importance").alias("x"), F.lit(None).cast("double").alias("y"))
    return metrics.unionByName(conf).unionByName(roc).unionByName(feats)


def score_with_artifact(artifact: Artifact, df: DataFrame, threshold: float = 0.30, keep=()) -> DataFrame:
    """K1 from a stored artefact: lift is over the rate stored with the model."""
    return score.batch_score(artifact.model, df, artifact.metrics.select("positive_rate").scalar(), threshold, keep)


def invalid_inputs(artifact: Artifact, df: DataFrame, key) -> DataFrame:
    """K2 from a stored artefact: values outside its domains and ranges."""
    return score.domain_violations(df, key, artifact.domains, artifact.ranges)
