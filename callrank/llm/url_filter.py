"""URL filters: host-suffix and path-prefix expressions against a rule list.

Every URL is expanded into the (host suffix, path prefix) expressions that a
rule could name, the expressions are equi-joined with the rules on a short
hash prefix, and a candidate counts only if the full digests are equal.  The
longest matching rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import ascii_lower, join_checked, materialise

#: Hex digits of the digest used as join key.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # a host holds no slash, so host + separator + path is unambiguous
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with digest and precedence, one row for
    each (host, path): of contradicting rules ``block`` stays.  Null hosts
    make no rule; a null path is empty."""
    r = rules.where(F.col("host").isNotNull()).select(
        ascii_lower("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"),
        F.col("verdict").alias("r_verdict"))
    r = r.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    return r.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id",
                default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict), one row for each row of ``pages``.

    * A rule fits its host and all subdomains if the URL's path starts with
      the rule's path; the longest rule (host and path together, then the
      host) wins.  ``rule`` is host and path joined, null if none fits; then
      the verdict is ``default``.
    * Null URLs and URLs without ``://`` have empty host and path.
    * Repeated rows and repeated or null keys each give their own row; rows
      are told apart by a generated id, not by the key.
    * Other columns of ``pages`` are not read.  Empty tables are fine.

    Only suffixes with as many labels, and prefixes as long, as some rule has
    are made; both sets are facts of the rule list, so a URL of a thousand
    labels makes no more expressions than the rules can match.
    """
    rules = materialise(prepare_rules(rules), "url-rules")
    shape = rules.agg(F.collect_set(F.size(F.split("r_host", "\\."))).alias("labels"),
                      F.collect_set(F.char_length("r_path")).alias("lengths")).first()
    own = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # equal URLs (a hot page, a hot host's front page) are judged once
    judged = own.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    hosts = F.array(*[F.lit(int(n)) for n in sorted(shape["labels"])]).cast("array<int>")
    paths = F.array(*[F.lit(int(n)) for n in sorted(shape["lengths"])]).cast("array<int>")
    wide = judged.withColumn("_l", labels).withColumn("_n", F.explode(F.filter(hosts, lambda n: n <= F.size(labels))))
    wide = wide.withColumn("_p", F.explode(F.filter(paths, lambda n: n <= F.char_length("path"))))
    suffix = F.array_join(F.slice("_l", F.size("_l") - F.col("_n") + 1, F.col("_n")), ".")
    made = wide.select("host", "path", _digest(suffix, F.expr("substring(path, 1, _p)")).alias("_digest"))
    made = made.withColumn("_short", F.substring("_digest", 1, PREFIX_DIGITS))
    side = rules.withColumn("_short", F.substring("r_digest", 1, PREFIX_DIGITS))
    size = F.octet_length("r_host") + F.octet_length("r_path") + F.lit(100)
    hit = join_checked(made, side, ["_short"], size, ["host", "path"]).where("_digest = r_digest")
    rank = F.struct((F.char_length("r_host") + F.char_length("r_path")).alias("n"), F.char_length("r_host").alias("h"),
                    F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = hit.groupBy("host", "path").agg(F.max(rank).alias("_best"))
    out = own.join(best, ["host", "path"], "left")
    return out.select(F.col("_key").alias(key), "host", "path", F.col("_best.rule").alias("rule"),
                      F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
