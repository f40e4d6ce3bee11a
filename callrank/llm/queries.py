"""The operators bound to the test tables, with DuckDB twins where SQL can
express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.llm import (decontaminate, filter_audit, hilbert, importance, langid, line_dedup, packing, simhash,
                          token_counts, token_shards, toxicity, url_filter, winnow)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: The rule list of the URL query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

OP1_SQL = """
WITH rules(host_r, path_r, verdict_r) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                                 ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
own AS (SELECT page_id,
               translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages)
SELECT page_id, host, path,
       (SELECT max_by(host_r || path_r, (length(host_r || path_r), length(host_r))) FROM rules
        WHERE (host = host_r OR ends_with(host, '.' || host_r)) AND starts_with(path, path_r)) AS rule,
       coalesce((SELECT max_by(verdict_r, (length(host_r || path_r), length(host_r))) FROM rules
        WHERE (host = host_r OR ends_with(host, '.' || host_r)) AND starts_with(path, path_r)), 'allow') AS verdict
FROM own
"""


@query("op1_url_filters", OP1_SQL)
def op1(spark, d):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, d, "pages"), rules)


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS n
        FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT k, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
          FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT k, p, grams.n, item FROM grams JOIN win ON grams.win = win.win AND grams.n = win.n),
places AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(generate_series(p, p + n - 1)) AS place FROM hits) GROUP BY k),
items AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (k) LEFT JOIN items USING (k)
"""


@query("op2_benchmark_decontamination", OP2_SQL)
def op2(spark, d):
    out = decontaminate.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      "contaminated")


@query("op3_token_counts")
def op3(spark, d):
    return token_counts.count_tokens(table(spark, d, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op4_token_shards")
def op4(spark, d):
    docs, path = table(spark, d, "documents"), token_shards.default_path(spark)
    token_shards.write_token_shards(docs, path, tokenizer_path(), end_id=2)
    return token_shards.token_digests(token_shards.keys_of(docs), path).drop("copy")


@query("op5_packing")
def op5(spark, d):
    return packing.pack(table(spark, d, "documents"), tokenizer_path(), capacity=2048, end_id=1, with_ids=False)


@query("op6_sharding")
def op6(spark, d):
    docs = table(spark, d, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    cells = [hilbert.name_cell(F.col("source"), 8), hilbert.name_cell(F.col("lang"), 8), hilbert.log_cell(size, 8)]
    out = hilbert.hilbert_shards(docs, cells, shards=16, tie=["doc_id"])
    return out.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_language_id")
def op7(spark, d):
    docs = table(spark, d, "documents")
    third = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    model = langid.fit_language_model(docs, keep=third != 1)
    out = langid.identify_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (third == 1).alias("held_out"), "lang_pred", "score")


@query("op8_simhash")
def op8(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"), shingle=4, distance=4)


@query("op9_document_fingerprints")
def op9(spark, d):
    return winnow.edited_fingerprints(table(spark, d, "documents"))


@query("op10_line_dedup")
def op10(spark, d):
    return line_dedup.judge_lines(table(spark, d, "documents"))


@query("op11_toxicity")
def op11(spark, d):
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    out = toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels"), keep=rest != 2)
    return out.select("doc_id", (rest == 2).alias("held_out"), "score", "predicted")


#: The filters of the audit query: failure conditions on (text, words); E is identity with a smaller id's text.
AUDIT_FILTERS = {"A": filter_audit.few_words(200), "B": filter_audit.few_distinct(50), "C": filter_audit.many_capitals(2),
                 "D": filter_audit.holds_any("#$%&*|")}

OP12_SQL = r"""
WITH RECURSIVE letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
walk(ord, used) AS (SELECT '', 0 UNION ALL SELECT ord || letter, used | bit FROM walk JOIN letters ON used & bit = 0),
steps AS (SELECT ord, CAST(s AS INTEGER) AS step, (SELECT bit FROM letters WHERE letter = substr(ord, s, 1)) AS bit,
                 CAST((SELECT coalesce(sum(bit), 0) FROM letters WHERE strpos(ord, letter) < s) AS INTEGER) AS before
          FROM (SELECT ord, unnest(generate_series(1, 5)) AS s FROM walk WHERE length(ord) = 5)),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
          FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
m AS (SELECT part, ord, step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM cells, steps GROUP BY part, ord, step, bit)
SELECT part, ord AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM m
"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark, d):
    return filter_audit.audit_filters(table(spark, d, "documents"), table(spark, d, "labels"), AUDIT_FILTERS, duplicates="E")


@query("op13_importance_resampling")
def op13(spark, d):
    out = importance.importance_resample(table(spark, d, "documents"), table(spark, d, "benchmark"), percent=25, least_words=20,
                                         buckets=10_000, seed=7)
    return out.select("doc_id", "n_features", "weight", "score", "rank")
