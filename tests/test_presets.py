"""The bank-layout presets on a small bank-like frame built from hashes."""

from pyspark.sql import functions as F

from callrank.plans import presets


def _bank(spark, n=1500):
    def u(salt):
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.col("id").cast("string"))), 1, 8),
                      16, 10).cast("double") / 4294967296.0

    def pick(salt, values):
        arr = F.array(*[F.lit(v) for v in values])
        return F.element_at(arr, (F.floor(u(salt) * len(values)) + 1).cast("int"))

    df = spark.range(0, n).select(
        (F.floor(u("age") * 60) + 18).cast("int").alias("age"),
        pick("job", ["admin.", "student", "retired", "blue-collar", "unknown"]).alias("job"),
        pick("mar", ["married", "single", "divorced"]).alias("marital"),
        pick("edu", ["primary", "secondary", "tertiary", "unknown"]).alias("education"),
        pick("def", ["no", "yes"]).alias("default"),
        (F.floor(u("bal") * 10000) - 2000).cast("int").alias("balance"),
        pick("hou", ["no", "yes"]).alias("housing"), pick("loan", ["no", "yes"]).alias("loan"),
        pick("con", ["cellular", "telephone", "unknown"]).alias("contact"),
        (F.floor(u("day") * 31) + 1).cast("int").alias("day"),
        pick("mon", ["may", "jun", "jul", "aug", "mar"]).alias("month"),
        (F.floor(u("dur") * 900)).cast("int").alias("duration"),
        (F.floor(u("cam") * 6) + 1).cast("int").alias("campaign"),
        F.when(u("pd") < 0.8, F.lit(-1)).otherwise(F.floor(u("pd2") * 300)).cast("int").alias("pdays"),
        (F.floor(u("prev") * 4)).cast("int").alias("previous"),
        pick("pout", ["unknown", "failure", "success"]).alias("poutcome"),
        u("y").alias("_u"))
    y = F.when((F.col("pdays") != -1) & (F.col("_u") < 0.6), "yes").when(F.col("_u") < 0.05, "yes").otherwise("no")
    return df.withColumn("y", y).drop("_u")


def test_eda_report(spark):
    rep = presets.eda_report(_bank(spark), never=-1)
    assert rep["shape"].first().n_rows == 1500
    assert {r.y for r in rep["class_balance"].collect()} == {"yes", "no"}
    warm = {r.never_contacted: r.rate for r in rep["conversion_by_prior_contact"].collect()}
    assert warm[False] > warm[True]
    assert rep["channel_efficiency"].count() == 1


def test_anonymised_roundtrip(spark):
    bank = _bank(spark, 200)
    inv = {v: k for k, v in presets.ANON_COLUMN_MAP.items()}
    anon = bank.select(*[F.col(c).alias(inv[c]) for c in presets.ANON_COLUMN_MAP.values()],
                       F.when(F.col("y") == "yes", 2).otherwise(1).alias("Class"))
    back = presets.from_anonymised(anon)
    assert sorted(back.columns) == sorted(bank.columns)
    assert back.where("y = 'yes'").count() == bank.where("y = 'yes'").count()


def test_train_bank_model_keyless(spark):
    res = presets.train_bank_model(spark, _bank(spark), trees=20)
    m = res.metrics.first()
    assert m.n_train + m.n_test == 1500 and abs(m.n_test - 300) <= 1
    assert m.test_roc_auc > 0.6
    assert res.domains.where("column_name = 'job'").count() == 5
