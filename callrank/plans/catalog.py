"""Registered queries: one per operator of the inventory, bound to the test
tables, each with its DuckDB twin where the result is SQL-expressible.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name] -> SQL``.
Every query reads the whole given tables.  Oracle columns carry the same
names; doubles that come from order-dependent float sums are rounded in
both, ratios of integer counts are left exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callrank.functions import expressions as X
from callrank.operators import encode, evaluate, quality, ranking, segments, split, stats, transforms
from callrank.plans import fixtures as fx
from callrank.session import cut_lineage, scratch_path
from callrank.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# Common table expressions of the bindings, in DuckDB SQL.
ORD_SQL = """ord AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
                     CAST(month(o_orderdate) AS INTEGER) AS month FROM orders)"""
LIN_SQL = """lin AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"""
DOC_SQL = """doc AS (SELECT l.doc_id, 1 - l.quality AS label, d.n_chars, l.toxic,
                     length(d.text) % 50 AS len_mod
              FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
SCO_SQL = DOC_SQL + """,
sco AS (SELECT doc_id, label, n_chars, toxic, len_mod, n_chars % 97 AS score_a, n_chars % 13 AS score_b,
               toxic AS score_c, CAST((n_chars % 97) >= 48 AS INTEGER) AS prediction,
               CAST(n_chars % 97 AS DOUBLE) / 97.0::DOUBLE AS probability FROM doc)"""


def _round(col: str, places: int = 6):
    return F.round(F.col(col), places).alias(col)


# ---------------------------------------------------------------- sources

@query("s1_catalog_scan", "SELECT * FROM nation")
def s1(spark, d):
    fx.table(spark, d, "nation").createOrReplaceTempView("callrank_nation")
    return readers.read_table(spark, "callrank_nation")


CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _customer_csv(spark, d) -> str:
    path = scratch_path(spark, "customer_csv")
    sinks.write_delimited(fx.table(spark, d, "customer"), path)
    return path


@query("s2_load_delimited", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment
FROM customer""")
def s2(spark, d):
    return readers.load_data(spark, _customer_csv(spark, d), CUSTOMER_SCHEMA, null_tokens=["BUILDING"])


@query("s3_raw_delimited", "SELECT * FROM customer")
def s3(spark, d):
    return readers.read_delimited(spark, _customer_csv(spark, d), CUSTOMER_SCHEMA)


@query("s4_anonymous_layout", """
SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' END AS y,
       o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def s4(spark, d):
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    anon = fx.table(spark, d, "orders").select(*[F.col(c).alias(f"V{i + 1}") for i, c in enumerate(names)])
    return readers.from_anonymous(anon, {f"V{i + 1}": c for i, c in enumerate(names)},
                                  target_source="o_orderstatus", target="y", target_map={"F": "yes", "O": "no"},
                                  categorical=["o_orderpriority"])


@query("s5_first_readable", "SELECT * FROM region")
def s5(spark, d):
    return readers.first_readable([lambda: spark.read.parquet(f"{d}/no_such_table.parquet"),
                                   lambda: fx.table(spark, d, "region")])


@query("s5_source_report", """
SELECT 'customer' AS source, count(*) AS n_rows, 5 AS n_columns FROM customer""")
def s5_report(spark, d):
    chosen = readers.first_readable([lambda: spark.read.parquet(f"{d}/no_such_table.parquet"),
                                     lambda: fx.table(spark, d, "customer")])
    return readers.source_report(chosen, "customer")


@query("s6_delimited_sink", "SELECT * FROM supplier")
def s6(spark, d):
    path = scratch_path(spark, "supplier_csv")
    sinks.write_delimited(fx.table(spark, d, "supplier"), path)
    return readers.read_delimited(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


E6_SQL = ORD_SQL + """,
h AS (SELECT *, md5('42:' || CAST(o_orderkey AS VARCHAR)) AS h FROM ord),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, o_orderkey) AS rk,
             count(*) OVER (PARTITION BY label) AS nc FROM h),
sp AS (SELECT *, CASE WHEN rk <= round(nc * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r)"""


@query("s7_partitioned_persist", "WITH " + E6_SQL + """
SELECT split, label, CAST(count(*) AS BIGINT) AS n FROM sp GROUP BY split, label""")
def s7(spark, d):
    df = split.stratified_split(fx.ord_frame(spark, d, "o_orderkey"), "label", ["o_orderkey"])
    path = scratch_path(spark, "prepared")
    sinks.write_prepared(df.select("o_orderkey", "label", "split"), path)
    back = spark.read.parquet(path)
    return back.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("s11_literal_lookup", """
WITH names(code, status_name) AS (VALUES ('F', 'fulfilled'), ('O', 'open'), ('P', 'partial'))
SELECT n.status_name, CAST(count(*) AS BIGINT) AS n
FROM orders o JOIN names n ON o.o_orderstatus = n.code GROUP BY n.status_name""")
def s11(spark, d):
    names = readers.literal_frame(spark, [("F", "fulfilled"), ("O", "open"), ("P", "partial")],
                                  "code string, status_name string")
    o = fx.table(spark, d, "orders", "o_orderstatus")
    # three literal rows: a bounded side, safe to broadcast
    return (o.join(F.broadcast(names), o.o_orderstatus == names.code)
             .groupBy("status_name").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- quality

@query("q1_normalize_names", "SELECT * FROM nation")
def q1(spark, d):
    n = fx.table(spark, d, "nation")
    dotted = n.toDF(*[c.replace("_", ".", 1) for c in n.columns])
    return quality.normalize_names(dotted)


@query("q2_shape", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def q2(spark, d):
    return quality.shape(fx.table(spark, d, "lineitem"))


@query("q3_schema_rows", """
SELECT CAST(ordinal_position AS INTEGER) AS position, column_name
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def q3(spark, d):
    return quality.schema_rows(fx.table(spark, d, "lineitem")).select("position", "column_name")


@query("q4_describe_typed", """
SELECT 'c_acctbal' AS column_name, CAST(count(c_acctbal) AS BIGINT) AS count, round(avg(c_acctbal), 6) AS mean,
       round(stddev_samp(c_acctbal), 6) AS stddev, CAST(min(c_acctbal) AS DOUBLE) AS min,
       CAST(max(c_acctbal) AS DOUBLE) AS max FROM customer
UNION ALL
SELECT 'p_size', CAST(count(p_size) AS BIGINT), round(avg(p_size), 6), round(stddev_samp(p_size), 6),
       CAST(min(p_size) AS DOUBLE), CAST(max(p_size) AS DOUBLE) FROM part""")
def q4(spark, d):
    a = quality.describe_typed(fx.table(spark, d, "customer", "c_acctbal"))
    b = quality.describe_typed(fx.table(spark, d, "part", "p_size"))
    return a.unionByName(b).select("column_name", "count", _round("mean"), _round("stddev"), "min", "max")


@query("q5_first_sorted_distinct", "SELECT DISTINCT p_size FROM part ORDER BY p_size LIMIT 10")
def q5(spark, d):
    return quality.first_sorted_distinct(fx.table(spark, d, "part", "p_size"), "p_size", 10)


@query("q6_sentinel_count", "SELECT CAST(count_if(l_linenumber = 7) AS BIGINT) AS n FROM lineitem")
def q6(spark, d):
    return quality.count_value(fx.table(spark, d, "lineitem", "l_linenumber"), "l_linenumber", fx.LIN_SENTINEL)


@query("q7_category_domains", """
SELECT DISTINCT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders
UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders
UNION ALL SELECT DISTINCT 'p_type', p_type FROM part""")
def q7(spark, d):
    a = quality.category_domains(fx.table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    b = quality.category_domains(fx.table(spark, d, "part"), ["p_type"])
    return a.unionByName(b)


def _q8_sql() -> str:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    parts = [f"""SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) - count({c}) AS BIGINT) AS n_null,
       CAST(count_if(CAST({c} AS VARCHAR) = '4-NOT SPECIFIED') AS BIGINT) AS n_token,
       CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM orders""" for c in cols]
    return "\nUNION ALL\n".join(parts)


@query("q8_quality_report", _q8_sql())
def q8(spark, d):
    return quality.quality_report(fx.table(spark, d, "orders"), tokens=[fx.ORD_TOKEN])


@query("q9_univariate", "SELECT p_type, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_type")
def q9u(spark, d):
    return quality.value_distribution(fx.table(spark, d, "part", "p_type"), "p_type")


@query("q9_contingency", """
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL""")
def q9c(spark, d):
    return quality.contingency(fx.table(spark, d, "lineitem", "l_returnflag", "l_linestatus"),
                               "l_returnflag", "l_linestatus")


@query("q10_string_columns", "SELECT o_orderstatus, o_orderpriority FROM orders")
def q10(spark, d):
    return quality.select_of_type(fx.table(spark, d, "orders"), T.StringType)


# ---------------------------------------------------------------- projections / predicates

@query("p1_token_to_null", """
SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, '4-NOT SPECIFIED') AS o_orderstatus, o_totalprice,
       o_orderdate, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders""")
def p1(spark, d):
    return transforms.replace_tokens(fx.table(spark, d, "orders"), [fx.ORD_TOKEN])


@query("p2_sentinel_to_null", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, NULLIF(l_linenumber, 7) AS linenumber_clean
FROM lineitem""")
def p2(spark, d):
    df = fx.table(spark, d, "lineitem", *fx.LIN_KEY)
    return transforms.null_sentinel(df, "l_linenumber", fx.LIN_SENTINEL, out="linenumber_clean")


@query("p3_recode_sentinel", """
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN -1 ELSE l_linenumber END AS l_linenumber
FROM lineitem""")
def p3(spark, d):
    return transforms.recode(fx.table(spark, d, "lineitem", *fx.LIN_KEY), "l_linenumber", fx.LIN_SENTINEL, -1)


@query("p4_binary_target", "WITH " + ORD_SQL + " SELECT o_orderkey, label FROM ord")
def p4(spark, d):
    df = fx.table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    return transforms.add_target(df, "o_orderstatus", fx.ORD_POSITIVE).select("o_orderkey", "label")


@query("p5_value_map", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' END AS y FROM orders""")
def p5(spark, d):
    df = fx.table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    return transforms.map_values(df, "o_orderstatus", {"F": "yes", "O": "no"}, out="y").select("o_orderkey", "y")


@query("p6_casts", """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, CAST(trunc(p_retailprice) AS INTEGER) AS p_retailprice,
       CAST(p_size > 25 AS INTEGER) AS big FROM part""")
def p6(spark, d):
    df = fx.table(spark, d, "part", "p_partkey", "p_size", "p_retailprice").withColumn("big", F.col("p_size") > 25)
    return transforms.cast_columns(df, {"p_size": "string", "p_retailprice": "int", "big": "int"})


@query("p7_project_features", "SELECT l_quantity, l_discount, l_tax, l_linestatus FROM lineitem")
def p7(spark, d):
    return transforms.project(fx.table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linestatus"])


@query("p8_drop_leakage", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_linestatus FROM lineitem""")
def p8(spark, d):
    from callrank.spec import FeatureSpec
    spec = FeatureSpec(numeric=("l_quantity", "l_discount", "l_tax"), categorical=("l_linestatus",),
                       target="l_returnflag", positive="R", leakage=("l_shipdate",))
    return transforms.drop_leakage(fx.table(spark, d, "lineitem"), spec)


@query("p9_p11_flags", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_linenumber <> 7 THEN 1 ELSE 0 END AS was_contacted,
       CASE WHEN l_quantity > 3 THEN 1 ELSE 0 END AS intensive_contact FROM lineitem""")
def p9(spark, d):
    df = fx.table(spark, d, "lineitem", *fx.LIN_KEY, "l_quantity")
    return transforms.add_flags(df, {"was_contacted": F.col("l_linenumber") != fx.LIN_SENTINEL,
                                     "intensive_contact": F.col("l_quantity") > 3}).drop("l_quantity")


@query("p11_favourable_flag", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS favourable FROM customer""")
def p11(spark, d):
    df = fx.table(spark, d, "customer", "c_custkey", "c_acctbal")
    return transforms.add_flags(df, {"favourable": F.col("c_acctbal") < 0}).drop("c_acctbal")


@query("p12_alias_rename", """
SELECT l_orderkey AS order_id, l_quantity AS campaign, l_quantity * 2 AS campaign_x2 FROM lineitem""")
def p12(spark, d):
    df = fx.table(spark, d, "lineitem", "l_orderkey", "l_quantity")
    return (df.withColumnRenamed("l_orderkey", "order_id").withColumn("campaign_x2", F.col("l_quantity") * 2)
              .withColumnRenamed("l_quantity", "campaign"))


@query("p13_p16_null_share", """
WITH c AS (SELECT NULLIF(l_linenumber, 7) AS clean FROM lineitem)
SELECT CAST(count_if(clean IS NULL) AS BIGINT) AS n_null, CAST(count(*) AS BIGINT) AS n,
       round(CAST(count_if(clean IS NULL) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS pct_null,
       CAST(count_if(clean >= 4) AS BIGINT) AS n_ge_4 FROM c""")
def p13(spark, d):
    df = transforms.null_sentinel(fx.table(spark, d, "lineitem", "l_linenumber"), "l_linenumber", 7, out="clean")
    one = df.agg(F.count_if(F.col("clean").isNull()).alias("n_null"), F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("clean") >= 4).alias("n_ge_4"))
    return one.select("n_null", "n", X.pct("n_null", "n", 6).alias("pct_null"), "n_ge_4")


@query("p17_threshold_decision", "WITH " + SCO_SQL + """
SELECT doc_id, CASE WHEN probability >= 0.3 THEN 'CALL' ELSE 'SKIP' END AS decision_30,
       CASE WHEN probability >= 0.5 THEN 'CALL' ELSE 'SKIP' END AS decision_50 FROM sco""")
def p17(spark, d):
    s = fx.sco_frame(spark, d)
    return s.select("doc_id", X.decision("probability", 0.3).alias("decision_30"),
                    X.decision("probability", 0.5).alias("decision_50"))


@query("p18_lift", "WITH " + SCO_SQL + """,
b AS (SELECT avg(label) AS base FROM sco)
SELECT doc_id, CASE WHEN base > 0 THEN probability / base END AS lift FROM sco, b""")
def p18(spark, d):
    s = fx.sco_frame(spark, d)
    base = s.agg(F.avg(F.col("label").cast("double"))).scalar()
    return s.select("doc_id", X.lift("probability", base).alias("lift"))


# ---------------------------------------------------------------- aggregations

@query("a1_class_balance", """
WITH g AS (SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY 1), t AS (SELECT sum(c) AS n FROM g)
SELECT o_orderstatus, CAST(c AS BIGINT) AS count, CAST(c AS DOUBLE) / CAST(n AS DOUBLE) AS share,
       round(CAST(c AS DOUBLE) / CAST(n AS DOUBLE) * 100, 2) AS pct FROM g, t""")
def a1(spark, d):
    return segments.class_balance(fx.table(spark, d, "orders", "o_orderstatus"), "o_orderstatus")


@query("a1_class_balance_events", """
WITH g AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1), t AS (SELECT sum(c) AS n FROM g)
SELECT event_type, CAST(c AS BIGINT) AS count, CAST(c AS DOUBLE) / CAST(n AS DOUBLE) AS share,
       round(CAST(c AS DOUBLE) / CAST(n AS DOUBLE) * 100, 2) AS pct FROM g, t""")
def a1e(spark, d):
    return segments.class_balance(fx.table(spark, d, "events", "event_type"), "event_type")


def _conv_sql(key_expr: str, key_name: str, src: str = "ord", where: str = "") -> str:
    return f"""
SELECT {key_expr} AS {key_name}, CAST(count(*) AS BIGINT) AS total, CAST(sum(label) AS BIGINT) AS converted,
       CAST(sum(label) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS rate,
       round(CAST(sum(label) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100, 2) AS rate_pct
FROM {src} {where} GROUP BY 1"""


@query("a2_conversion_by_segment", "WITH " + ORD_SQL + _conv_sql("o_orderpriority", "o_orderpriority"))
def a2(spark, d):
    return segments.conversion_by_segment(fx.ord_frame(spark, d, "o_orderpriority"), "o_orderpriority")


@query("a3_conversion_by_month", "WITH " + ORD_SQL + _conv_sql("month", "month"))
def a3(spark, d):
    return segments.conversion_by_segment(fx.ord_frame(spark, d, "o_orderpriority"), "month")


@query("a4_conversion_by_prior_contact", "WITH " + LIN_SQL + _conv_sql(
    "NULLIF(l_linenumber, 7) IS NULL", "never_contacted", "lin"))
def a4(spark, d):
    df = transforms.null_sentinel(fx.lin_frame(spark, d, "l_linenumber"), "l_linenumber", 7, out="linenumber_clean")
    return segments.conversion_by_null_flag(df, "linenumber_clean", "never_contacted")


@query("a5_value_counts", """
WITH c AS (SELECT NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders)
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS count FROM c WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def a5(spark, d):
    df = transforms.replace_tokens(fx.table(spark, d, "orders", "o_orderpriority"), [fx.ORD_TOKEN])
    return segments.value_counts(df, "o_orderpriority")


@query("a6_value_shares", """
WITH c AS (SELECT NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders),
g AS (SELECT o_orderpriority, count(*) AS cnt FROM c WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT o_orderpriority, CAST(cnt AS BIGINT) AS count,
       CAST(cnt AS DOUBLE) / CAST(sum(cnt) OVER () AS DOUBLE) AS share FROM g""")
def a6(spark, d):
    df = transforms.replace_tokens(fx.table(spark, d, "orders", "o_orderpriority"), [fx.ORD_TOKEN])
    return segments.value_shares(df, "o_orderpriority")


@query("a7_conversion_with_overall", "WITH " + ORD_SQL + """,
c AS (SELECT NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, label FROM ord),
o AS (SELECT avg(CAST(label AS DOUBLE)) AS overall_rate FROM c)
SELECT o_orderpriority, avg(CAST(label AS DOUBLE)) AS rate, any_value(overall_rate) AS overall_rate
FROM c, o WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def a7(spark, d):
    df = transforms.replace_tokens(fx.ord_frame(spark, d, "o_orderpriority"), [fx.ORD_TOKEN], ["o_orderpriority"])
    return segments.conversion_with_overall(df, "o_orderpriority")


@query("a8_conditional_counts", "WITH " + SCO_SQL + """
SELECT CAST(count_if(label = 0) AS BIGINT) AS n_0, CAST(count_if(label = 1) AS BIGINT) AS n_1 FROM sco""")
def a8(spark, d):
    return segments.conditional_counts(fx.sco_frame(spark, d))


@query("a9_positive_rate", "WITH " + SCO_SQL + """
SELECT avg(CAST(label AS DOUBLE)) AS positive_rate, CAST(count(*) AS BIGINT) AS n FROM sco""")
def a9(spark, d):
    return segments.positive_rate(fx.sco_frame(spark, d))


A10_SEGMENTS = {  # name -> SQL predicate on ORD (fixed values of the binding)
    "urgent": "o_orderpriority = '1-URGENT'",
    "low": "o_orderpriority = '5-LOW'",
    "not_specified": "o_orderpriority = '4-NOT SPECIFIED'",
    "may": "month = 5",
    "rest": "o_orderpriority IN ('2-HIGH', '3-MEDIUM')",
}


def _a10_sql() -> str:
    parts = [f"SELECT '{n}' AS segment, count_if({p}) AS total, count_if(({p}) AND label = 1) AS converted FROM ord"
             for n, p in A10_SEGMENTS.items()]
    parts.append("SELECT 'overall', count(*), count_if(label = 1) FROM ord")
    return "WITH " + ORD_SQL + ",\ns AS (" + "\nUNION ALL ".join(parts) + """),
b AS (SELECT CAST(converted AS DOUBLE) / CAST(total AS DOUBLE) AS base_rate FROM s WHERE segment = 'overall'),
r AS (SELECT CAST(converted AS DOUBLE) / CAST(total AS DOUBLE) AS reference_rate FROM s WHERE segment = 'not_specified')
SELECT segment, CAST(total AS BIGINT) AS total, CAST(converted AS BIGINT) AS converted,
       CAST(converted AS DOUBLE) / CAST(total AS DOUBLE) AS rate, base_rate, reference_rate,
       (CAST(converted AS DOUBLE) / CAST(total AS DOUBLE)) / base_rate AS lift_vs_base,
       (CAST(converted AS DOUBLE) / CAST(total AS DOUBLE)) / reference_rate AS lift_vs_reference
FROM s, b, r"""


@query("a10_segment_lift", _a10_sql())
def a10(spark, d):
    df = fx.ord_frame(spark, d, "o_orderpriority")
    preds = {n: F.expr(p) for n, p in A10_SEGMENTS.items()}
    return segments.segment_lift(df, preds, reference="not_specified")


@query("a11_channel_efficiency", "WITH " + ORD_SQL + """,
m AS (SELECT month, count(*) AS total, CAST(sum(label) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS rate
      FROM ord GROUP BY month),
t AS (SELECT month AS top_volume_segment, CAST(total AS BIGINT) AS top_volume_total
      FROM m ORDER BY total DESC, month LIMIT 1),
w AS (SELECT month AS worst_rate_segment, rate AS worst_rate FROM m ORDER BY rate, month LIMIT 1)
SELECT * FROM t, w""")
def a11(spark, d):
    conv = segments.conversion_by_segment(fx.ord_frame(spark, d, "o_orderpriority"), "month")
    return segments.channel_efficiency(conv, "month")


@query("a12_conversion_report", "WITH " + ORD_SQL + """,
j AS (SELECT o.o_orderpriority, CAST(o.month AS VARCHAR) AS month, c.c_mktsegment, o.label
      FROM ord o JOIN customer c ON o.o_custkey = c.c_custkey),
l AS (SELECT 'o_orderpriority' AS feature, o_orderpriority AS value, label FROM j
      UNION ALL SELECT 'month', month, label FROM j
      UNION ALL SELECT 'c_mktsegment', c_mktsegment, label FROM j)
SELECT feature, value, CAST(count(*) AS BIGINT) AS total, CAST(sum(label) AS BIGINT) AS converted,
       CAST(sum(label) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS rate FROM l GROUP BY 1, 2""")
def a12(spark, d):
    o = fx.ord_frame(spark, d, "o_custkey", "o_orderpriority")
    c = fx.table(spark, d, "customer", "c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return segments.conversion_report(j, ["o_orderpriority", "month", "c_mktsegment"])


# ---------------------------------------------------------------- sorts, top-k

@query("t1_order_by", "WITH " + SCO_SQL + " SELECT doc_id, score_a FROM sco ORDER BY score_a DESC, doc_id")
def t1(spark, d):
    return segments.ordered(fx.sco_frame(spark, d).select("doc_id", "score_a"), ["score_a"], False, ["doc_id"])


@query("t4_top_decile", "WITH " + SCO_SQL + """,
r AS (SELECT doc_id, probability, row_number() OVER (ORDER BY probability DESC, doc_id) AS call_rank,
             count(*) OVER () AS n FROM sco)
SELECT doc_id, probability, call_rank FROM r WHERE call_rank <= ceil(n * 0.1::DOUBLE)""")
def t4(spark, d):
    s = fx.sco_frame(spark, d).select("doc_id", "probability")
    return ranking.top_fraction(s, "probability", ["doc_id"], 0.1)


@query("t5_gains_table", "WITH " + SCO_SQL + """,
r AS (SELECT label, probability, ntile(10) OVER (ORDER BY probability DESC, doc_id) AS bin FROM sco),
g AS (SELECT bin, count(*) AS n, sum(label) AS converted, min(probability) AS min_score,
             max(probability) AS max_score FROM r GROUP BY bin),
t AS (SELECT sum(converted) AS tc, CAST(sum(converted) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS base FROM g)
SELECT CAST(bin AS INTEGER) AS bin, CAST(n AS BIGINT) AS n, CAST(converted AS BIGINT) AS converted,
       min_score, max_score, CAST(converted AS DOUBLE) / CAST(n AS DOUBLE) AS rate,
       (CAST(converted AS DOUBLE) / CAST(n AS DOUBLE)) / base AS lift,
       CAST(sum(converted) OVER (ORDER BY bin) AS BIGINT) AS cum_converted,
       CAST(sum(converted) OVER (ORDER BY bin) AS DOUBLE) / CAST(tc AS DOUBLE) AS cum_gain FROM g, t""")
def t5(spark, d):
    s = fx.sco_frame(spark, d).select("doc_id", "label", "probability")
    return ranking.gains_table(s, "probability", ["doc_id"], "label", 10)


@query("t5_gains_fixed_cuts", "WITH " + SCO_SQL + """,
r AS (SELECT label, probability, 10 - (CAST(probability >= 0.1 AS INT) + CAST(probability >= 0.2 AS INT)
        + CAST(probability >= 0.3 AS INT) + CAST(probability >= 0.4 AS INT) + CAST(probability >= 0.5 AS INT)
        + CAST(probability >= 0.6 AS INT) + CAST(probability >= 0.7 AS INT) + CAST(probability >= 0.8 AS INT)
        + CAST(probability >= 0.9 AS INT)) AS bin FROM sco),
g AS (SELECT bin, count(*) AS n, sum(label) AS converted, min(probability) AS min_score,
             max(probability) AS max_score FROM r GROUP BY bin),
t AS (SELECT sum(converted) AS tc, CAST(sum(converted) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS base FROM g)
SELECT CAST(bin AS INTEGER) AS bin, CAST(n AS BIGINT) AS n, CAST(converted AS BIGINT) AS converted,
       min_score, max_score, CAST(converted AS DOUBLE) / CAST(n AS DOUBLE) AS rate,
       (CAST(converted AS DOUBLE) / CAST(n AS DOUBLE)) / base AS lift,
       CAST(sum(converted) OVER (ORDER BY bin) AS BIGINT) AS cum_converted,
       CAST(sum(converted) OVER (ORDER BY bin) AS DOUBLE) / CAST(tc AS DOUBLE) AS cum_gain FROM g, t""")
def t5c(spark, d):
    s = fx.sco_frame(spark, d).select("doc_id", "label", "probability")
    return ranking.gains_table(s, "probability", ["doc_id"], "label", cuts=[round(0.1 * i, 1) for i in range(1, 10)])


# ---------------------------------------------------------------- encoding, split, folds

@query("e1_label_encoding", """
WITH p AS (SELECT o_orderpriority AS v, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS c
           FROM (SELECT DISTINCT o_orderpriority FROM orders)),
s AS (SELECT o_orderstatus AS v, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS c
      FROM (SELECT DISTINCT o_orderstatus FROM orders))
SELECT o.o_orderkey, CAST(p.c AS DOUBLE) AS o_orderpriority_idx, CAST(s.c AS DOUBLE) AS o_orderstatus_idx
FROM orders o JOIN p ON o.o_orderpriority = p.v JOIN s ON o.o_orderstatus = s.v""")
def e1(spark, d):
    df = fx.table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    model = encode.label_encoder(["o_orderpriority", "o_orderstatus"]).fit(df)
    return model.transform(df).select("o_orderkey", "o_orderpriority_idx", "o_orderstatus_idx")


E2_TRAIN_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")  # STANDARD is left unseen


@query("e2_one_hot_unseen", """
SELECT p_partkey, """ + ",\n       ".join(
    f"CAST(p_type = '{t}' AS DOUBLE) AS p_type_{t}" for t in E2_TRAIN_TYPES) + " FROM part")
def e2(spark, d):
    from pyspark.ml import Pipeline
    df = fx.table(spark, d, "part", "p_partkey", "p_type")
    fit_on = df.where(F.col("p_type").isin(list(E2_TRAIN_TYPES)))
    model = Pipeline(stages=encode.one_hot(["p_type"])).fit(fit_on)
    labels = encode.fitted_domains(model)["p_type"]
    out = model.transform(df)
    return encode.unpack_vector(out, "p_type_ohe", [f"p_type_{v}" for v in labels]).drop(
        "p_type", "p_type_idx", "p_type_ohe")


@query("e5_class_weights", "WITH " + DOC_SQL + """,
c AS (SELECT label, count(*) AS nc FROM doc GROUP BY label),
t AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
SELECT d.doc_id, d.label, CAST(t.n AS DOUBLE) / (CAST(t.k AS DOUBLE) * CAST(c.nc AS DOUBLE)) AS weight
FROM doc d JOIN c ON d.label = c.label, t""")
def e5(spark, d):
    df = fx.doc_frame(spark, d).select("doc_id", "label")
    return encode.with_class_weight(df, "label")


@query("e6_stratified_split", "WITH " + E6_SQL + " SELECT o_orderkey, label, split FROM sp")
def e6(spark, d):
    df = fx.ord_frame(spark, d, "o_orderkey").select("o_orderkey", "label")
    return split.stratified_split(df, "label", ["o_orderkey"], 0.2, 42)


E7_SQL = DOC_SQL + """,
h AS (SELECT *, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM doc),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY h, doc_id) - 1) % 3 AS INTEGER) AS fold
      FROM h)"""


@query("e7_stratified_folds", "WITH " + E7_SQL + " SELECT doc_id, label, fold FROM f")
def e7(spark, d):
    df = fx.doc_frame(spark, d).select("doc_id", "label")
    return split.stratified_folds(df, "label", ["doc_id"], 3, 42)


# ---------------------------------------------------------------- evaluation on given scores

SCORE_TABLE_SQL = SCO_SQL + """,
g AS (SELECT CAST(score_a AS DOUBLE) AS score, sum(label) AS pos, count(*) - sum(label) AS neg
      FROM sco GROUP BY 1),
c AS (SELECT score, pos, neg,
             sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             row_number() OVER (ORDER BY score DESC) AS position,
             sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM g)"""


def _sco_a(spark, d):
    return fx.sco_frame(spark, d).withColumn("score", F.col("score_a").cast("double"))


@query("h1_roc_auc", "WITH " + SCORE_TABLE_SQL + """
SELECT CASE WHEN n_pos > 0 AND n_neg > 0 THEN CAST(sum(neg * (2 * tp - pos)) AS DOUBLE)
            / (2.0::DOUBLE * CAST(n_pos AS DOUBLE) * CAST(n_neg AS DOUBLE)) END AS auc,
       CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM c GROUP BY n_pos, n_neg""")
def h1(spark, d):
    return evaluate.roc_auc(_sco_a(spark, d))


@query("h2_average_precision", "WITH " + SCORE_TABLE_SQL + """
SELECT round(sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))) / CAST(n_pos AS DOUBLE), 12)
       AS average_precision FROM c GROUP BY n_pos""")
def h2(spark, d):
    return evaluate.average_precision(_sco_a(spark, d)).select(_round("average_precision", 12))


@query("h3_binary_metrics", "WITH " + SCO_SQL + """,
m AS (SELECT count_if(label = 1 AND prediction = 1) AS tp, count_if(label <> 1 AND prediction = 1) AS fp,
             count_if(label = 1 AND prediction <> 1) AS fn, count_if(label <> 1 AND prediction <> 1) AS tn FROM sco)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
       CAST(tp + tn AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy,
       coalesce(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
       coalesce(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
       coalesce(CAST(2 * tp AS DOUBLE) / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1 FROM m""")
def h3(spark, d):
    return evaluate.binary_metrics(fx.sco_frame(spark, d))


@query("h3_model_evaluation", "WITH " + SCO_SQL + """,
m AS (SELECT count_if(label = 1 AND prediction = 1) AS tp, count_if(label <> 1 AND prediction = 1) AS fp,
             count_if(label = 1 AND prediction <> 1) AS fn, count_if(label <> 1 AND prediction <> 1) AS tn FROM sco),
s AS (SELECT score_a, count_if(label = 1) AS p, count_if(label <> 1) AS n FROM sco GROUP BY score_a),
b AS (SELECT p, n, sum(n) OVER (ORDER BY score_a) - n AS below FROM s),
a AS (SELECT CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN CAST(sum(p * (2 * below + n)) AS DOUBLE)
             / (2.0::DOUBLE * CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) END AS auc FROM b)
SELECT model, CAST(tp + tn AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy,
       coalesce(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
       coalesce(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
       coalesce(CAST(2 * tp AS DOUBLE) / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1,
       round(CASE WHEN model = 'with scores' THEN auc END, 12) AS roc_auc
FROM m, a, (VALUES ('with scores'), ('decisions only')) AS t(model)""")
def h3_model(spark, d):
    s = fx.sco_frame(spark, d)
    both = evaluate.model_evaluation(s, "with scores", score="score_a").unionByName(
        evaluate.model_evaluation(s, "decisions only"))
    return both.withColumn("roc_auc", _round("roc_auc", 12))


@query("h4_classification_report", "WITH " + SCO_SQL + """,
m AS (SELECT CAST(count_if(label = 1 AND prediction = 1) AS DOUBLE) AS tp,
             CAST(count_if(label <> 1 AND prediction = 1) AS DOUBLE) AS fp,
             CAST(count_if(label = 1 AND prediction <> 1) AS DOUBLE) AS fn,
             CAST(count_if(label <> 1 AND prediction <> 1) AS DOUBLE) AS tn FROM sco),
k AS (SELECT *, coalesce(tp / NULLIF(tp + fp, 0), 0.0) AS p1, coalesce(tp / NULLIF(tp + fn, 0), 0.0) AS r1,
             coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1,
             coalesce(tn / NULLIF(tn + fn, 0), 0.0) AS p0, coalesce(tn / NULLIF(tn + fp, 0), 0.0) AS r0,
             coalesce(2 * tn / NULLIF(2 * tn + fn + fp, 0), 0.0) AS f0,
             tp + fn AS s1, tn + fp AS s0, tp + fn + tn + fp AS n FROM m)
SELECT '0' AS row_name, p0 AS precision, r0 AS recall, f0 AS f1, CAST(s0 AS BIGINT) AS support FROM k
UNION ALL SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM k
UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / n, CAST(n AS BIGINT) FROM k
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(n AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', p0 * (s0 / n) + p1 * (s1 / n), r0 * (s0 / n) + r1 * (s1 / n),
                 f0 * (s0 / n) + f1 * (s1 / n), CAST(n AS BIGINT) FROM k""")
def h4(spark, d):
    return evaluate.classification_report(fx.sco_frame(spark, d))


@query("h5_confusion_matrix", "WITH " + SCO_SQL + """,
g(actual, predicted) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1))
SELECT g.actual, g.predicted, CAST(count(s.doc_id) AS BIGINT) AS n
FROM g LEFT JOIN sco s ON s.label = g.actual AND s.prediction = g.predicted GROUP BY 1, 2""")
def h5(spark, d):
    return evaluate.confusion_matrix(fx.sco_frame(spark, d))


ROC_SQL = SCORE_TABLE_SQL + """,
pts AS (SELECT score AS threshold, CAST(position AS BIGINT) AS position, tp, fp, n_pos, n_neg FROM c
        UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0, n_pos, n_neg FROM c WHERE position = 1)"""


@query("h6_roc_curve", "WITH " + ROC_SQL + """
SELECT threshold, position, CAST(fp AS DOUBLE) / CAST(n_neg AS DOUBLE) AS fpr,
       CAST(tp AS DOUBLE) / CAST(n_pos AS DOUBLE) AS tpr FROM pts""")
def h6(spark, d):
    return evaluate.roc_curve(_sco_a(spark, d))


@query("h6_roc_curve_corners", "WITH " + ROC_SQL + """,
l AS (SELECT *, lag(tp) OVER w AS ptp, lag(fp) OVER w AS pfp, lead(tp) OVER w AS ntp, lead(fp) OVER w AS nfp
      FROM pts WHERE position > 0 WINDOW w AS (ORDER BY position)),
k AS (SELECT threshold, position, tp, fp, n_pos, n_neg FROM l
      WHERE ptp IS NULL OR ntp IS NULL OR (ntp - tp) <> (tp - ptp) OR (nfp - fp) <> (fp - pfp)
      UNION ALL SELECT threshold, position, tp, fp, n_pos, n_neg FROM pts WHERE position = 0)
SELECT threshold, position, CAST(fp AS DOUBLE) / CAST(n_neg AS DOUBLE) AS fpr,
       CAST(tp AS DOUBLE) / CAST(n_pos AS DOUBLE) AS tpr FROM k""")
def h6c(spark, d):
    return evaluate.roc_curve(_sco_a(spark, d), drop_intermediate=True)


LONG_SQL = SCO_SQL + """,
lg AS (SELECT 'a' AS model, doc_id, label, CAST(score_a AS DOUBLE) AS score FROM sco
       UNION ALL SELECT 'b', doc_id, label, CAST(score_b AS DOUBLE) FROM sco
       UNION ALL SELECT 'c', doc_id, label, CAST(score_c AS DOUBLE) FROM sco),
g AS (SELECT model, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM lg GROUP BY 1, 2),
c AS (SELECT model, score, pos, neg,
             sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               AS tp,
             sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               AS fp,
             row_number() OVER (PARTITION BY model ORDER BY score DESC) AS position,
             sum(pos) OVER (PARTITION BY model) AS n_pos, sum(neg) OVER (PARTITION BY model) AS n_neg FROM g)"""


@query("h7_roc_auc_by_model", "WITH " + LONG_SQL + """
SELECT model, CAST(sum(neg * (2 * tp - pos)) AS DOUBLE)
         / (2.0::DOUBLE * CAST(n_pos AS DOUBLE) * CAST(n_neg AS DOUBLE)) AS auc,
       CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM c GROUP BY model, n_pos, n_neg""")
def h7(spark, d):
    return evaluate.roc_auc(fx.sco_long(spark, d), groups=["model"])


@query("h7_roc_curves_by_model", "WITH " + LONG_SQL + """
SELECT model, score AS threshold, CAST(position AS BIGINT) AS position,
       CAST(fp AS DOUBLE) / CAST(n_neg AS DOUBLE) AS fpr, CAST(tp AS DOUBLE) / CAST(n_pos AS DOUBLE) AS tpr FROM c
UNION ALL
SELECT model, 'inf'::DOUBLE, 0, 0.0, 0.0 FROM c WHERE position = 1""")
def h7c(spark, d):
    return evaluate.roc_curve(fx.sco_long(spark, d), groups=["model"])


@query("h8_pr_curve", "WITH " + SCORE_TABLE_SQL + """
SELECT score AS threshold, CAST(position AS BIGINT) AS position,
       CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision,
       CAST(tp AS DOUBLE) / CAST(n_pos AS DOUBLE) AS recall FROM c""")
def h8(spark, d):
    return evaluate.pr_curve(_sco_a(spark, d))


@query("h9_best_threshold_f1", "WITH " + SCORE_TABLE_SQL + """,
f AS (SELECT score, coalesce(CAST(2 * tp AS DOUBLE) / NULLIF(CAST(2 * tp + fp + (n_pos - tp) AS DOUBLE), 0), 0.0)
             AS f1 FROM c)
SELECT score AS threshold, f1 FROM f ORDER BY f1 DESC, score DESC LIMIT 1""")
def h9(spark, d):
    return evaluate.best_threshold(_sco_a(spark, d), metric="f1")


@query("h9_best_threshold_cost", "WITH " + SCORE_TABLE_SQL + """,
f AS (SELECT score, CAST(fp AS DOUBLE) * 1.0 + CAST(n_pos - tp AS DOUBLE) * 5.0 AS cost FROM c)
SELECT score AS threshold, cost FROM f ORDER BY cost, score DESC LIMIT 1""")
def h9c(spark, d):
    return evaluate.best_threshold(_sco_a(spark, d), metric="cost", fp_cost=1.0, fn_cost=5.0)


def _h9_grid_sql() -> str:
    ts = ", ".join(f"({round(0.05 * i, 2)}::DOUBLE)" for i in range(1, 20))
    return "WITH " + SCO_SQL + f""",
g(threshold) AS (VALUES {ts}),
m AS (SELECT g.threshold, count_if(s.label = 1 AND s.probability >= g.threshold) AS tp,
             count_if(s.label <> 1 AND s.probability >= g.threshold) AS fp,
             count_if(s.label = 1 AND s.probability < g.threshold) AS fn,
             count_if(s.label <> 1 AND s.probability < g.threshold) AS tn
      FROM g JOIN sco s ON TRUE GROUP BY g.threshold)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       CAST(tn AS BIGINT) AS tn, CAST(tp + tn AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy,
       coalesce(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
       coalesce(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
       coalesce(CAST(2 * tp AS DOUBLE) / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1 FROM m"""


@query("h9_threshold_grid", _h9_grid_sql())
def h9g(spark, d):
    return evaluate.threshold_grid(fx.sco_frame(spark, d), score="probability")


@query("h10_model_comparison", "WITH " + LONG_SQL + """
SELECT model, CAST(sum(neg * (2 * tp - pos)) AS DOUBLE)
         / (2.0::DOUBLE * CAST(n_pos AS DOUBLE) * CAST(n_neg AS DOUBLE)) AS auc,
       CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM c GROUP BY model, n_pos, n_neg""")
def h10(spark, d):
    return evaluate.model_comparison(fx.sco_long(spark, d))


@query("h11_chi_square", """
WITH cells AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
r AS (SELECT a, sum(o) AS rt FROM cells GROUP BY a), k AS (SELECT b, sum(o) AS ct FROM cells GROUP BY b),
t AS (SELECT sum(o) AS n FROM cells),
e AS (SELECT cells.o, CAST(r.rt AS DOUBLE) * CAST(k.ct AS DOUBLE) / CAST(t.n AS DOUBLE) AS e
      FROM cells JOIN r ON cells.a = r.a JOIN k ON cells.b = k.b, t)
SELECT round(sum(power(o - e, 2) / e) + (CAST(any_value(t.n) AS DOUBLE) - sum(e)), 9) AS statistic,
       CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS BIGINT) AS dof,
       CAST(any_value(t.n) AS BIGINT) AS n FROM e, t""")
def h11(spark, d):
    df = fx.table(spark, d, "lineitem", "l_returnflag", "l_linestatus")
    return stats.chi_square_statistic(df, "l_returnflag", "l_linestatus").select(_round("statistic", 9), "dof", "n")


H11_SQL = """cells AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
r AS (SELECT a, sum(o) AS rt FROM cells GROUP BY a), k AS (SELECT b, sum(o) AS ct FROM cells GROUP BY b),
t AS (SELECT sum(o) AS n FROM cells),
e AS (SELECT cells.o, CAST(r.rt AS DOUBLE) * CAST(k.ct AS DOUBLE) / CAST(t.n AS DOUBLE) AS e
      FROM cells JOIN r ON cells.a = r.a JOIN k ON cells.b = k.b, t),
x AS (SELECT sum(power(o - e, 2) / e) + (CAST(any_value(t.n) AS DOUBLE) - sum(e)) AS stat,
             ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS dof FROM e, t)"""


@query("h11_chi_square_null_keys", """
WITH x AS (SELECT NULLIF(l_returnflag, 'N') AS a, NULLIF(l_linenumber, 3) AS b FROM lineitem),
c AS (SELECT a, b, count(*) AS o FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b),
m AS (SELECT a, b, o, sum(o) OVER (PARTITION BY a) AS rt, sum(o) OVER (PARTITION BY b) AS ct, sum(o) OVER () AS n FROM c)
SELECT round(sum((o - rt * ct / n::DOUBLE) ** 2 / (rt * ct / n::DOUBLE)), 9) AS statistic,
       CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof, CAST(sum(o) AS BIGINT) AS n FROM m""")
def h11_nulls(spark, d):
    df = fx.table(spark, d, "lineitem").select(F.nullif(F.col("l_returnflag"), F.lit("N")).alias("a"),
                                               F.nullif(F.col("l_linenumber"), F.lit(3)).alias("b"))
    return stats.chi_square_statistic(df, "a", "b").select(_round("statistic", 9), "dof", "n")


@query("t5_gains_table_null_scores", "WITH " + DOC_SQL + """,
s AS (SELECT doc_id, label, NULLIF(n_chars % 7, 3) AS score FROM doc),
b AS (SELECT label, ntile(10) OVER (ORDER BY score DESC NULLS LAST, doc_id) AS bin FROM s)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS conversions FROM b GROUP BY bin""")
def t5_nulls(spark, d):
    docs = fx.doc_frame(spark, d).withColumn("score", F.nullif(F.col("n_chars") % 7, F.lit(3).cast("long")))
    x = ranking.equal_count_bins(docs.select("doc_id", "label", "score"), "score", ["doc_id"])
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("conversions"))


@query("h11_chi_square_pvalue", "WITH " + H11_SQL + """
SELECT round(stat, 9) AS statistic, CAST(dof AS BIGINT) AS dof,
       round(CASE WHEN dof % 2 = 0 THEN exp(-stat / 2) * (SELECT sum(power(stat / 2, i) / gamma(i + 1))
                                                          FROM range(CAST(dof / 2 AS BIGINT)) AS g(i)) END, 9)
       AS p_value FROM x""")
def h11p(spark, d):
    """p-value from the JVM chi-square distribution; the SQL twin uses the
    closed form of the survival function for an even dof."""
    df = fx.table(spark, d, "lineitem", "l_returnflag", "l_linestatus")
    return stats.chi_square_test(df, "l_returnflag", "l_linestatus").select(
        _round("statistic", 9), "dof", _round("p_value", 9))


@query("h12_two_proportion_z", "WITH " + LIN_SQL + """,
c AS (SELECT count_if(l_linenumber = 7) AS n1, count_if(l_linenumber = 7 AND label = 1) AS c1,
             count_if(l_linenumber <> 7) AS n2, count_if(l_linenumber <> 7 AND label = 1) AS c2 FROM lin),
p AS (SELECT *, CAST(c1 AS DOUBLE) / CAST(n1 AS DOUBLE) AS p1, CAST(c2 AS DOUBLE) / CAST(n2 AS DOUBLE) AS p2,
             CAST(c1 + c2 AS DOUBLE) / CAST(n1 + n2 AS DOUBLE) AS pp FROM c)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(c1 AS BIGINT) AS c1, CAST(n2 AS BIGINT) AS n2, CAST(c2 AS BIGINT) AS c2,
       round(p1, 12) AS p1, round(p2, 12) AS p2,
       round((p1 - p2) / sqrt(pp * (1 - pp) * (1.0 / n1 + 1.0 / n2)), 9) AS z FROM p""")
def h12(spark, d):
    df = fx.lin_frame(spark, d, "l_linenumber")
    z = stats.two_proportion_z(df, F.col("l_linenumber") == fx.LIN_SENTINEL)
    return z.select("n1", "c1", "n2", "c2", _round("p1", 12), _round("p2", 12), _round("z", 9))


@query("h12_two_proportion_pvalue", """
WITH cells AS (SELECT CAST(l_linenumber = 7 AS VARCHAR) AS a, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS b,
                      count(*) AS o FROM lineitem GROUP BY 1, 2),
r AS (SELECT a, sum(o) AS rt FROM cells GROUP BY a), k AS (SELECT b, sum(o) AS ct FROM cells GROUP BY b),
t AS (SELECT sum(o) AS n FROM cells),
e AS (SELECT cells.o, CAST(r.rt AS DOUBLE) * CAST(k.ct AS DOUBLE) / CAST(t.n AS DOUBLE) AS e
      FROM cells JOIN r ON cells.a = r.a JOIN k ON cells.b = k.b, t),
x AS (SELECT sum(power(o - e, 2) / e) + (CAST(any_value(t.n) AS DOUBLE) - sum(e)) AS stat,
             ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS dof FROM e, t)
SELECT round(stat, 9) AS statistic, CAST(dof AS BIGINT) AS dof,
       round(1.0 - (SELECT sum(exp((dof / 2.0 + i) * ln(stat / 2.0) - stat / 2.0 - lgamma(dof / 2.0 + i + 1)))
                    FROM range(1000) AS g(i)), 9) AS p_value FROM x""")
def h12p(spark, d):
    """p-value of the 2x2 table (z squared = 1-dof chi-square).  The SQL twin
    sums the regularized incomplete gamma series in log space."""
    df = fx.lin_frame(spark, d, "l_linenumber").withColumn(
        "never_contacted", (F.col("l_linenumber") == fx.LIN_SENTINEL).cast("string"))
    return stats.chi_square_test(df, "never_contacted", "label").select(
        _round("statistic", 9), "dof", _round("p_value", 9))


# ---------------------------------------------------------------- scoring support

@query("k2_domain_violations", """
WITH known AS (SELECT DISTINCT 'o_orderpriority' AS column_name, o_orderpriority AS value FROM orders
               WHERE o_orderpriority <> '5-LOW'
               UNION ALL SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM orders
               WHERE o_orderpriority <> '5-LOW'),
rng AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderpriority <> '5-LOW'),
l AS (SELECT o_orderkey, 'o_orderpriority' AS column_name, o_orderpriority AS value FROM orders
      UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM orders)
SELECT l.o_orderkey, l.column_name, l.value FROM l
WHERE l.value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.column_name = l.column_name
                                          AND k.value = l.value)
UNION ALL
SELECT o_orderkey, 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders, rng
WHERE o_totalprice < lo OR o_totalprice > hi""")
def k2(spark, d):
    from callrank.operators import score
    o = fx.table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    ref = o.where(F.col("o_orderpriority") != "5-LOW")
    doms = quality.category_domains(ref, ["o_orderpriority", "o_orderstatus"])
    ranges = score.numeric_ranges(ref, ["o_totalprice"])
    return score.domain_violations(o, ["o_orderkey"], doms, ranges)


# ---------------------------------------------------------------- SMOTE and leak-free resampling

DOC_FEATURES = ["n_chars", "toxic", "len_mod"]

E8_SQL = DOC_SQL + """,
m AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS x0, CAST(toxic AS DOUBLE) AS x1, CAST(len_mod AS DOUBLE) AS x2
      FROM doc WHERE label = 1),
cnt AS (SELECT (SELECT count(*) FROM doc WHERE label = 0) - (SELECT count(*) FROM m) AS need,
               (SELECT count(*) FROM m) AS nc),
v AS (SELECT DISTINCT x0, x1, x2 FROM m),
kk AS (SELECT least(5, count(*) - 1) AS kk FROM v),
nn AS (SELECT a.x0, a.x1, a.x2, b.x0 AS y0, b.x1 AS y1, b.x2 AS y2,
              row_number() OVER (PARTITION BY a.x0, a.x1, a.x2
                                 ORDER BY (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)
                                          + (a.x2 - b.x2) * (a.x2 - b.x2), b.x0, b.x1, b.x2) - 1 AS nb_rank
       FROM v a JOIN v b ON NOT (a.x0 = b.x0 AND a.x1 = b.x1 AND a.x2 = b.x2)),
r AS (SELECT m.*, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM m),
c AS (SELECT r.*, need // nc + CASE WHEN rn <= need % nc THEN 1 ELSE 0 END AS ncopy FROM r, cnt),
cp AS (SELECT c.*, unnest(generate_series(1, ncopy)) AS copy FROM c WHERE ncopy > 0),
hh AS (SELECT cp.*, md5('42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)) AS h2 FROM cp),
d AS (SELECT hh.*, CAST(('0x' || substr(h2, 1, 8))::BIGINT % kk AS INTEGER) AS j,
             CAST(('0x' || substr(h2, 9, 8))::BIGINT AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM hh, kk)
SELECT d.doc_id, CAST(d.copy AS INTEGER) AS copy, d.x0 + d.u * (nn.y0 - d.x0) AS n_chars,
       d.x1 + d.u * (nn.y1 - d.x1) AS toxic, d.x2 + d.u * (nn.y2 - d.x2) AS len_mod, 1 AS label
FROM d JOIN nn ON d.x0 = nn.x0 AND d.x1 = nn.x1 AND d.x2 = nn.x2 AND d.j = nn.nb_rank"""


@query("e8_smote_samples", "WITH " + E8_SQL)
def e8(spark, d):
    from callrank.operators import resample
    out = resample.smote(fx.doc_frame(spark, d), DOC_FEATURES, "label", ["doc_id"], k=5, seed=42)
    return out.where("synthetic").drop("synthetic")


@query("e8_smote_balance", "WITH " + DOC_SQL + """
SELECT label, CAST(max(n) OVER () AS BIGINT) AS n FROM (SELECT label, count(*) AS n FROM doc GROUP BY label)""")
def e8b(spark, d):
    from callrank.operators import resample
    out = resample.smote(fx.doc_frame(spark, d), DOC_FEATURES, "label", ["doc_id"], k=5, seed=42)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("e8_smote_many_features", """
WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS x, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings),
m AS (SELECT vec_id, x FROM v WHERE label = 1),
cnt AS (SELECT (SELECT count(*) FROM v WHERE label = 0) - (SELECT count(*) FROM m) AS need, (SELECT count(*) FROM m) AS nc),
u AS (SELECT DISTINCT x FROM m),
kk AS (SELECT least(5, count(*) - 1) AS kk FROM u),
nn AS (SELECT a.x, b.x AS y, row_number() OVER (PARTITION BY a.x ORDER BY list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(a.x, b.x)]), b.x) - 1 AS nb_rank
       FROM u a JOIN u b ON a.x <> b.x),
r AS (SELECT m.*, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn FROM m),
c AS (SELECT r.*, need // nc + CASE WHEN rn <= need % nc THEN 1 ELSE 0 END AS ncopy FROM r, cnt),
cp AS (SELECT c.*, unnest(generate_series(1, ncopy)) AS copy FROM c WHERE ncopy > 0),
hh AS (SELECT cp.*, md5('42:' || CAST(vec_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)) AS h2 FROM cp),
d AS (SELECT hh.*, CAST(('0x' || substr(h2, 1, 8))::BIGINT % kk AS INTEGER) AS j,
             CAST(('0x' || substr(h2, 9, 8))::BIGINT AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM hh, kk)
SELECT d.vec_id, CAST(d.copy AS INTEGER) AS copy, CAST(i - 1 AS INTEGER) AS feature,
       round(d.x[i] + d.u * (nn.y[i] - d.x[i]), 9) AS value
FROM d JOIN nn ON d.x = nn.x AND d.j = nn.nb_rank, range(1, 65) AS g(i)""")
def e8_many(spark, d):
    """SMOTE of one label against all others on the 64 features of the
    vectors; one row a synthetic row and feature."""
    from callrank.operators import resample
    v = fx.table(spark, d, "embeddings", "vec_id", "embedding", "label")
    v = v.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 0).cast("int").alias("label"))
    syn = resample.smote_samples(v, "x", 64, "label", ["vec_id"], k=5, seed=42)
    return syn.select("vec_id", "copy", F.posexplode("x").alias("feature", "value")).withColumn("value", _round("value", 9))


@query("e8_smote_categories", """
WITH doc AS (SELECT l.doc_id, 1 - l.quality AS label, CAST(d.n_chars AS DOUBLE) AS x0, CAST(length(d.text) % 50 AS DOUBLE) AS x1,
                    coalesce(d.source, '') AS source, coalesce(d.lang, '') AS lang
             FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
cs AS (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS DOUBLE) AS c0 FROM (SELECT DISTINCT source FROM doc)),
cl AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS DOUBLE) AS c1 FROM (SELECT DISTINCT lang FROM doc)),
m AS (SELECT doc_id, x0, x1, c0, c1 FROM doc JOIN cs USING (source) JOIN cl USING (lang) WHERE label = 1),
cnt AS (SELECT (SELECT count(*) FROM doc WHERE label = 0) - (SELECT count(*) FROM m) AS need, (SELECT count(*) FROM m) AS nc,
               (SELECT power(round((stddev_pop(x0) + stddev_pop(x1)) / 2, 6), 2) FROM m) AS pen),
v AS (SELECT DISTINCT x0, x1, c0, c1 FROM m),
kk AS (SELECT least(5, count(*) - 1) AS kk FROM v),
nn AS (SELECT * FROM (
       SELECT a.x0, a.x1, a.c0, a.c1, b.x0 AS y0, b.x1 AS y1, b.c0 AS b0, b.c1 AS b1,
              row_number() OVER (PARTITION BY a.x0, a.x1, a.c0, a.c1
                                 ORDER BY (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)
                                          + CASE WHEN a.c0 <> b.c0 THEN pen ELSE 0 END + CASE WHEN a.c1 <> b.c1 THEN pen ELSE 0 END,
                                          b.x0, b.x1, b.c0, b.c1) - 1 AS nb_rank
       FROM v a JOIN v b ON NOT (a.x0 = b.x0 AND a.x1 = b.x1 AND a.c0 = b.c0 AND a.c1 = b.c1), cnt), kk WHERE nb_rank < kk),
t0 AS (SELECT x0, x1, c0, c1, b0, row_number() OVER (PARTITION BY x0, x1, c0, c1 ORDER BY count(*) DESC, b0) AS o
       FROM nn GROUP BY x0, x1, c0, c1, b0),
t1 AS (SELECT x0, x1, c0, c1, b1, row_number() OVER (PARTITION BY x0, x1, c0, c1 ORDER BY count(*) DESC, b1) AS o
       FROM nn GROUP BY x0, x1, c0, c1, b1),
r AS (SELECT m.*, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM m),
c AS (SELECT r.*, need // nc + CASE WHEN rn <= need % nc THEN 1 ELSE 0 END AS ncopy FROM r, cnt),
cp AS (SELECT c.*, unnest(generate_series(1, ncopy)) AS copy FROM c WHERE ncopy > 0),
hh AS (SELECT cp.*, md5('42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)) AS h2 FROM cp),
d AS (SELECT hh.*, CAST(('0x' || substr(h2, 1, 8))::BIGINT % kk AS INTEGER) AS j,
             CAST(('0x' || substr(h2, 9, 8))::BIGINT AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM hh, kk)
SELECT d.doc_id, CAST(d.copy AS INTEGER) AS copy, d.x0 + d.u * (nn.y0 - d.x0) AS n_chars, d.x1 + d.u * (nn.y1 - d.x1) AS len_mod,
       cs.source, cl.lang
FROM d JOIN nn ON d.x0 = nn.x0 AND d.x1 = nn.x1 AND d.c0 = nn.c0 AND d.c1 = nn.c1 AND d.j = nn.nb_rank
JOIN t0 ON d.x0 = t0.x0 AND d.x1 = t0.x1 AND d.c0 = t0.c0 AND d.c1 = t0.c1 AND t0.o = 1 JOIN cs ON cs.c0 = t0.b0
JOIN t1 ON d.x0 = t1.x0 AND d.x1 = t1.x1 AND d.c0 = t1.c0 AND d.c1 = t1.c1 AND t1.o = 1 JOIN cl ON cl.c1 = t1.b1""")
def e8_categories(spark, d):
    """SMOTE-NC on DOC: source and language as sorted label codes (E1) beside
    two numbers; the codes of the synthetic rows are decoded again."""
    from pyspark.ml.feature import IndexToString

    from callrank.operators import resample
    texts = fx.table(spark, d, "documents", "doc_id", "source", "lang", "n_chars", "text")
    doc = fx.table(spark, d, "labels", "doc_id", "quality").join(texts, "doc_id").select(
        "doc_id", (F.lit(1) - F.col("quality")).alias("label"), "n_chars", (F.length("text") % 50).alias("len_mod"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "lang")])
    doc = cut_lineage(doc)
    codes = encode.label_encoder(["source", "lang"]).fit(doc)
    out = resample.smote(codes.transform(doc), ["n_chars", "len_mod", "source_idx", "lang_idx"], "label", ["doc_id"],
                         k=5, seed=42, nominal=["source_idx", "lang_idx"]).where("synthetic")
    for name, labels in zip(("source", "lang"), codes.labelsArray):
        out = IndexToString(inputCol=f"{name}_idx", outputCol=name, labels=list(labels)).transform(out)
    return out.select("doc_id", "copy", "n_chars", "len_mod", "source", "lang")


#: M5: the reference's 2 x 3 x 3 x 2 = 36 settings of boosted trees.
TUNING_GRID = {"maxIter": [100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.05, 0.1, 0.2], "subsamplingRate": [0.8, 1.0]}


@query("e9_resample_in_folds")
def e9(spark, d):
    """Leak check on DOC: grid search (M5) of boosted trees with SMOTE inside
    each training fold (E9) against SMOTE applied before folding (the leaky
    order: folds are drawn over the resampled rows).  Test rows are original
    in both."""
    from pyspark.ml.feature import VectorAssembler

    from callrank.operators import resample, tuning
    doc = cut_lineage(split.stratified_split(fx.doc_frame(spark, d), "label", ["doc_id"], 0.2, 42))
    vec = VectorAssembler(inputCols=DOC_FEATURES, outputCol="features")
    tr, te = doc.where("split = 'train'"), vec.transform(doc.where("split = 'test'"))
    inside = tuning.smote_folded(vec.transform(split.stratified_folds(tr, "label", ["doc_id"], 3, 42)), "fold", "doc_id", test=te)
    sm = cut_lineage(resample.smote(tr, DOC_FEATURES, "label", ["doc_id"]))
    sm = vec.transform(split.stratified_folds(sm, "label", ["doc_id", "copy"], 3, 42))
    before = tuning.folded(sm, "fold", ["doc_id", "copy"], test=te.withColumn("copy", F.lit(0)))
    out = None
    for mode, rows in (("inside_folds", inside), ("before_folds", before)):
        best = tuning.search(rows, TUNING_GRID).where("best").select(F.lit(mode).alias("mode"), "cv_auc", "test_auc")
        out = best if out is None else out.unionByName(best)
    return out.withColumn("gap", F.col("cv_auc") - F.col("test_auc"))


# ---------------------------------------------------------------- prepared set, models, scoring

def lin_spec():
    from callrank.spec import FeatureSpec
    return FeatureSpec(numeric=("l_quantity", "l_discount", "l_tax", "l_linenumber"),
                       categorical=("l_linestatus",), target="l_returnflag", positive="R",
                       leakage=("l_shipdate",), sentinels={"l_linenumber": (7, -1)}, key=fx.LIN_KEY, seed=42)


LIN_FLAGS_SQL = """CASE WHEN l_linenumber <> 7 THEN 1 ELSE 0 END AS was_contacted,
       CASE WHEN l_quantity > 3 THEN 1 ELSE 0 END AS intensive_contact"""


LIN_SPLIT_SQL = """lin AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
h AS (SELECT *, md5(concat_ws(':', '42', l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS h FROM lin),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, l_orderkey, l_partkey, l_suppkey, l_linenumber)
             AS rk, count(*) OVER (PARTITION BY label) AS nc FROM h),
sp AS (SELECT *, CASE WHEN rk <= round(nc * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r)"""


@query("e11_prepared_set", "WITH " + LIN_SPLIT_SQL + """,
enc AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code
        FROM (SELECT DISTINCT l_linestatus AS v FROM sp WHERE split = 'train'))
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN -1 ELSE l_linenumber END AS l_linenumber,
       l_quantity, l_discount, l_tax, coalesce(enc.code, CAST((SELECT count(*) FROM enc) AS DOUBLE))
       AS l_linestatus_idx, label, split, """ + LIN_FLAGS_SQL + """
FROM sp LEFT JOIN enc ON sp.l_linestatus = enc.v""")
def e11(spark, d):
    from callrank.plans.prepare import encode_on_train, prepare
    spec = lin_spec()
    flags = {"was_contacted": F.col("l_linenumber") != -1, "intensive_contact": F.col("l_quantity") > 3}
    return encode_on_train(prepare(fx.table(spark, d, "lineitem"), spec, flags=flags), spec)


_CACHE: dict = {}


def _cached(spark, d, name, make):
    k = (spark.sparkContext.applicationId, d, name)
    if k not in _CACHE:
        _CACHE[k] = make()
    return _CACHE[k]


def _lin_prepared(spark, d):
    from callrank.plans.prepare import prepare
    # not kept: the hash of a row costs less than its columns on disk
    return _cached(spark, d, "lin_prepared", lambda: prepare(fx.table(spark, d, "lineitem"), lin_spec()))


def _lin_fit(spark, d, name, classifier, weighted=False):
    def make():
        spec = lin_spec()
        tr = _lin_prepared(spark, d).where("split = 'train'")
        if weighted:
            tr = encode.with_class_weight(tr, "label", "weight")
        return encode.build_pipeline(spec.numeric, spec.categorical, classifier).fit(tr)
    return _cached(spark, d, name, make)


def _lin_test_scores(spark, d, name, classifier, weighted=False):
    from callrank.operators import models
    model = _lin_fit(spark, d, name, classifier, weighted)
    te = _lin_prepared(spark, d).where("split = 'test'")
    return models.predict(model, te, [*fx.LIN_KEY, "label"])


def _m1(spark, d):
    from callrank.operators import models
    return _lin_test_scores(spark, d, "m1", models.decision_tree(max_depth=5, seed=42))


def _m2(spark, d):
    from callrank.operators import models
    return _lin_test_scores(spark, d, "m2", models.random_forest(trees=100, max_depth=10, seed=42))


def _m4(spark, d):
    from callrank.operators import models
    return _lin_test_scores(spark, d, "m4", models.boosted_trees(rounds=100, max_depth=5, step=0.1, seed=42))


QUERIES["m1_decision_tree"] = _m1
QUERIES["m2_random_forest"] = _m2
QUERIES["m4_boosted_trees"] = _m4


@query("m3_balanced_forest")
def m3(spark, d):
    from callrank.operators import models
    return _lin_test_scores(spark, d, "m3", models.balanced_forest(trees=300, max_depth=12, min_leaf=20),
                            weighted=True)


def _m5_cv(spark, d):
    from pyspark.ml import Pipeline

    from callrank.operators import tuning

    def make():
        spec = lin_spec()
        prep = _lin_prepared(spark, d)
        tr = prep.where("split = 'train'")
        model = Pipeline(stages=encode.preprocessor(spec.numeric, spec.categorical)).fit(tr)
        tr, test = split.stratified_folds(tr, "label", list(fx.LIN_KEY), 3, 42), model.transform(prep.where("split = 'test'"))
        return cut_lineage(tuning.search(tuning.counted_folds(model.transform(tr), "fold", test=test), TUNING_GRID))
    return _cached(spark, d, "m5", make)


@query("m5_grid_search")
def m5(spark, d):
    return _m5_cv(spark, d).drop("test_auc")


@query("m6_best_params")
def m6(spark, d):
    return _m5_cv(spark, d).where("best").drop("test_auc")


@query("m7_cv_gap")
def m7(spark, d):
    from callrank.operators import models
    return models.cv_gap(_m5_cv(spark, d), F.col("test_auc"))


@query("m8_feature_importances")
def m8(spark, d):
    from callrank.operators import models
    model = _lin_fit(spark, d, "m2", models.random_forest(trees=100, max_depth=10, seed=42))
    names = encode.expanded_feature_names(model.transform(_lin_prepared(spark, d)), "features")
    return models.feature_importances(spark, model.stages[-1], names)


@query("m9_predict")
def m9(spark, d):
    from callrank.operators import models
    model = _lin_fit(spark, d, "m1", models.decision_tree(max_depth=5, seed=42))
    return models.predict(model, _lin_prepared(spark, d), [*fx.LIN_KEY, "split"])


@query("t2_leaderboard")
def t2(spark, d):
    parts = [(n, f(spark, d)) for n, f in (("decision_tree", _m1), ("random_forest", _m2), ("boosted_trees", _m4))]
    long = None
    for n, s in parts:
        p = s.select(F.lit(n).alias("model"), "label", F.col("p_yes").alias("score"))
        long = p if long is None else long.unionByName(p)
    return ranking.leaderboard(evaluate.roc_auc(long, "label", "score", ["model"]), "auc", "model")


def shape_spec():
    from callrank.spec import FeatureSpec
    return FeatureSpec(numeric=("n_chars", "words", "capitals", "marks"), categorical=("lang",), target="quality", positive="0",
                       key=("doc_id",), seed=42)


def _shape_prepared(spark, d):
    """DOC by the shape of its texts, prepared (E11): what sets junk (quality
    0) apart from prose, so the target holds a signal."""
    from callrank.plans.prepare import prepare
    text = F.coalesce("text", F.lit(""))
    docs = fx.table(spark, d, "documents", "doc_id", "text", "lang").select(
        "doc_id", "lang", F.length(text).alias("n_chars"), F.size(F.split(text, " ")).alias("words"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"), F.regexp_count(text, F.lit("[#$%&*|]")).alias("marks"))
    labels = fx.table(spark, d, "labels", "doc_id", "quality").withColumn("quality", F.col("quality").cast("string"))
    return cut_lineage(prepare(labels.join(docs, "doc_id"), shape_spec()))


@query("t2_balanced_leaderboard")
def t2_balanced(spark, d):
    """Four models that learned from the balanced train split, best first."""
    from callrank.plans.leaderboard import balanced_leaderboard
    return balanced_leaderboard(_shape_prepared(spark, d), shape_spec(), TUNING_GRID).board


@query("t2_balanced_rows", """
WITH doc AS (SELECT l.doc_id, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS label, md5('42:' || CAST(l.doc_id AS VARCHAR)) AS h
             FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) AS rk, count(*) OVER (PARTITION BY label) AS nc FROM doc),
n AS (SELECT label, count(*) FILTER (rk > round(nc * 0.2::DOUBLE)) AS n_train FROM r GROUP BY label)
SELECT label, n_train, max(n_train) OVER () - n_train AS n_synthetic FROM n""")
def t2_rows(spark, d):
    """What the models of ``t2_balanced_leaderboard`` learn from, by label."""
    from callrank.plans.leaderboard import balance
    from callrank.plans.prepare import encode_on_train
    rows = balance(encode_on_train(_shape_prepared(spark, d), shape_spec()), shape_spec())
    return rows.groupBy("label").agg(F.count_if(~F.col("synthetic")).alias("n_train"), F.count_if("synthetic").alias("n_synthetic"))


@query("t3_top_features")
def t3(spark, d):
    return ranking.top_k(m8(spark, d), "importance", 10, "feature")


@query("e3_column_transformer", "WITH " + LIN_SPLIT_SQL + """
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN -1 ELSE l_linenumber END AS l_linenumber,
       l_quantity AS f_l_quantity, l_discount AS f_l_discount, l_tax AS f_l_tax,
       CAST(CASE WHEN l_linenumber = 7 THEN -1 ELSE l_linenumber END AS DOUBLE) AS f_l_linenumber,
       CAST(l_linestatus = 'F' AS DOUBLE) AS f_l_linestatus_F, CAST(l_linestatus = 'O' AS DOUBLE) AS f_l_linestatus_O
FROM sp""")
def e3(spark, d):
    """The fitted column transformer's vector, one named double per slot."""
    from pyspark.ml import Pipeline
    spec = lin_spec()
    prep = _lin_prepared(spark, d)
    model = Pipeline(stages=encode.preprocessor(spec.numeric, spec.categorical)).fit(prep.where("split = 'train'"))
    out = model.transform(prep)
    names = ["f_" + n for n in encode.expanded_feature_names(out, "features")]
    return encode.unpack_vector(out.select(*fx.LIN_KEY, "features"), "features", names).drop("features")


@query("e4_feature_names", "WITH " + LIN_SPLIT_SQL + """,
num(position, feature) AS (VALUES (0, 'l_quantity'), (1, 'l_discount'), (2, 'l_tax'), (3, 'l_linenumber')),
cat AS (SELECT CAST(3 + row_number() OVER (ORDER BY v) AS INTEGER) AS position, 'l_linestatus_' || v AS feature
        FROM (SELECT DISTINCT l_linestatus AS v FROM sp WHERE split = 'train'))
SELECT position, feature FROM num UNION ALL SELECT position, feature FROM cat""")
def e4(spark, d):
    from pyspark.ml import Pipeline
    spec = lin_spec()
    prep = _lin_prepared(spark, d)
    model = Pipeline(stages=encode.preprocessor(spec.numeric, spec.categorical)).fit(prep.where("split = 'train'"))
    return encode.feature_names_frame(model.transform(prep), "features")


@query("e10_pipeline_composition", """
SELECT stage, kind, (SELECT count(*) FROM lineitem) AS rows_scored
FROM (VALUES (0, 'StringIndexerModel'), (1, 'OneHotEncoderModel'), (2, 'VectorAssembler'),
             (3, 'DecisionTreeClassificationModel')) AS v(stage, kind)""")
def e10(spark, d):
    from callrank.operators import models
    model = _lin_fit(spark, d, "m1", models.decision_tree(max_depth=5, seed=42))
    stages = [(i, type(s).__name__) for i, s in enumerate(model.stages)]
    names = spark.createDataFrame(stages, "stage int, kind string")
    scored = models.predict(model, _lin_prepared(spark, d), ["label"])
    n = scored.agg(F.count(F.lit(1))).scalar()
    return names.withColumn("rows_scored", n)


def _train_result(spark, d):
    from callrank.operators import models
    from callrank.plans.train import train

    def make():
        spec = lin_spec()
        clf = models.balanced_forest(trees=300, max_depth=12, min_leaf=20)
        fitted = _lin_fit(spark, d, "m3", clf, weighted=True)  # the M3 fit, shared
        return train(spark, None, spec, clf, threshold=0.5, prepared=_lin_prepared(spark, d), fitted=fitted)
    return _cached(spark, d, "k4", make)


def _artifact(spark, d):
    """The training job's folder, written (S8, S9) and read back."""
    from callrank.plans.train import load_artifact, persist

    def make():
        path = scratch_path(spark, "artifact")
        persist(_train_result(spark, d), path)
        return load_artifact(spark, path)
    return _cached(spark, d, "artifact", make)


@query("k4_train_job")
def k4(spark, d):
    return _train_result(spark, d).metrics


@query("k3_model_card")
def k3(spark, d):
    from callrank.plans.train import model_card
    return model_card(_artifact(spark, d))


@query("k3_card_counts", "WITH " + LIN_SPLIT_SQL + """
SELECT 'n_train' AS item, CAST(count(*) FILTER (split = 'train') AS DOUBLE) AS x FROM sp
UNION ALL SELECT 'n_test', CAST(count(*) FILTER (split = 'test') AS DOUBLE) FROM sp
UNION ALL SELECT 'positive_rate', round(avg(CAST(label AS DOUBLE)), 9) FROM sp
UNION ALL SELECT 'threshold', 0.5::DOUBLE
UNION ALL SELECT 'actual=' || CAST(label AS VARCHAR), CAST(count(*) AS DOUBLE) FROM sp WHERE split = 'test'
GROUP BY label""")
def k3_counts(spark, d):
    """The parts of the stored card that no random stream decides."""
    from callrank.plans.train import model_card
    card = model_card(_artifact(spark, d))
    known = card.where(F.col("item").isin("n_train", "n_test", "positive_rate", "threshold"))
    cells = card.where(F.col("section") == "confusion").groupBy(
        F.substring_index("item", ",", 1).alias("item")).agg(F.sum("x").alias("x"))
    return known.select("item", F.round("x", 9).alias("x")).unionByName(cells)


@query("k2_stored_domains", "WITH " + LIN_SPLIT_SQL + """,
tr AS (SELECT *, CASE WHEN l_linenumber = 7 THEN -1 ELSE l_linenumber END AS ln FROM sp WHERE split = 'train')
SELECT 'l_linestatus' AS column_name, v AS value, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi
FROM (SELECT DISTINCT l_linestatus AS v FROM tr WHERE l_linestatus IS NOT NULL)
UNION ALL SELECT 'l_quantity', NULL, CAST(min(l_quantity) AS DOUBLE), CAST(max(l_quantity) AS DOUBLE) FROM tr
UNION ALL SELECT 'l_discount', NULL, CAST(min(l_discount) AS DOUBLE), CAST(max(l_discount) AS DOUBLE) FROM tr
UNION ALL SELECT 'l_tax', NULL, CAST(min(l_tax) AS DOUBLE), CAST(max(l_tax) AS DOUBLE) FROM tr
UNION ALL SELECT 'l_linenumber', NULL, CAST(min(ln) AS DOUBLE), CAST(max(ln) AS DOUBLE) FROM tr""")
def k2_stored(spark, d):
    """Domains and ranges learned from the train rows, read from the folder."""
    a = _artifact(spark, d)
    return a.domains.unionByName(a.ranges, allowMissingColumns=True)


@query("k1_batch_score")
def k1(spark, d):
    from callrank.plans.train import score_with_artifact
    return score_with_artifact(_artifact(spark, d), _lin_prepared(spark, d), threshold=0.30, keep=list(fx.LIN_KEY))


@query("k1_score_checks", "WITH " + LIN_SQL + """
SELECT count(*) AS n, count(*) AS lift_right, count(*) AS decision_right, count(*) AS probabilities FROM lin""")
def k1_checks(spark, d):
    """Rows of K1 whose lift over the table's rate, decision and range hold."""
    rate = _lin_prepared(spark, d).agg(F.avg(F.col("label").cast("double"))).scalar()
    p = F.col("p_yes")
    return k1(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("lift") - p / rate) < 1e-9).alias("lift_right"),
        F.count_if(F.col("decision") == F.when(p >= 0.3, "CALL").otherwise("SKIP")).alias("decision_right"),
        F.count_if((p >= 0) & (p <= 1)).alias("probabilities"))


@query("s8_s10_model_roundtrip")
def s8(spark, d):
    from callrank.operators import models
    model = _lin_fit(spark, d, "m1", models.decision_tree(max_depth=5, seed=42))
    path = scratch_path(spark, "model")
    sinks.save_model(model, path)
    loaded = sinks.load_model(spark, path)
    te = _lin_prepared(spark, d).where("split = 'test'")
    return models.predict(loaded, te, list(fx.LIN_KEY))


@query("s8_roundtrip_difference", "WITH " + LIN_SPLIT_SQL + """
SELECT count(*) AS n, 0.0::DOUBLE AS largest_difference FROM sp WHERE split = 'test'""")
def s8_difference(spark, d):
    """Scores of a saved and reloaded model against those of the fitted one."""
    saved = s8(spark, d).select(*fx.LIN_KEY, F.col("p_yes").alias("q"))
    both = _m1(spark, d).join(saved, list(fx.LIN_KEY))
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p_yes") - F.col("q"))).alias("largest_difference"))


@query("m9_rows_per_split", "WITH " + LIN_SPLIT_SQL + """
SELECT split, count(*) AS n, count(*) AS valid FROM sp GROUP BY split""")
def m9_rows(spark, d):
    """Predicted rows a split, and those with a probability and its class."""
    p = F.col("p_yes")
    ok = (p >= 0) & (p <= 1) & ((p == 0.5) | (F.col("prediction") == (p > 0.5).cast("int")))
    return m9(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"))


@query("s9_metrics_sink")
def s9(spark, d):
    """The stored metrics row: scalars, confusion cells, top features."""
    a = _artifact(spark, d)
    return a.metrics.withColumn("confusion", F.to_json("confusion")).withColumn("top_features", F.to_json("top_features"))
