"""Filter interaction audit by a recursive common table expression.

What a document fails is a mask of bits, one for each filter, and a filter's
effect depends on the filters applied before it only through their bits.  So
the documents shrink to mask cells (their count for each part of the corpus
and mask), and a recursive CTE extends filter prefixes by one unused letter a
level: it joins the part's mask cells, carries the bits applied so far, and
emits the metrics of that step.  DataFrame and SQL functions only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callrank.llm.common import materialise

#: Words are what lies between these.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs without white space, as they are written."""
    return F.array_remove(F.split(text, SPACE), "")


def few_words(least: int) -> Callable[[Column, Column], Column]:
    return lambda text, word: F.size(word) < least


def few_distinct(percent: int) -> Callable[[Column, Column], Column]:
    return lambda text, word: 100 * F.size(F.array_distinct(word)) < percent * F.size(word)


def many_capitals(percent: int) -> Callable[[Column, Column], Column]:
    """More than ``percent`` per cent of the code points are A-Z."""
    def fails(text: Column, word: Column) -> Column:
        left = F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
        return 100 * (F.char_length(text) - left) > percent * F.char_length(text)
    return fails


def holds_any(characters: str) -> Callable[[Column, Column], Column]:
    pattern = "[" + "".join(c if c.isalnum() else "\\" + c for c in characters) + "]"
    return lambda text, word: text.rlike(pattern)


def failure_cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]],
                  duplicates: str | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part that fail
    exactly the filters of ``mask`` (bit i: the i-th letter in alphabetical
    order), and how many of them are labelled quality = 1 and toxic = 1.

    The texts are read once, into a slim table of ids, masks and text
    digests.  A group of equal texts, however large, is combined before each
    shuffle and never held by a task row by row.
    """
    letters = sorted([*filters, *([duplicates] if duplicates else [])])
    bit = {c: 1 << i for i, c in enumerate(letters)}
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                      F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("word", words(F.col("text")))
    mask = F.lit(0)
    for c, fails in sorted(filters.items()):
        mask = mask.bitwiseOR(F.when(fails(F.col("text"), F.col("word")), F.lit(bit[c])).otherwise(F.lit(0)))
    slim = own.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    slim = materialise(slim, "audit-masks").groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("c"))
    # repeated label rows: a document is good or toxic if any of its rows says so
    flags = labels.select(F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    flags = flags.where("_id is not null").groupBy("_id").agg(
        F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    known = slim.where("doc_id is not null").join(flags, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    known = known.withColumn("good", F.coalesce("good", F.lit(False))).withColumn("toxic", F.coalesce("toxic", F.lit(False)))
    no_id = slim.where("doc_id is null").withColumn("good", F.lit(False)).withColumn("toxic", F.lit(False))
    rows = known.unionByName(no_id)
    if duplicates:
        first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c")))
        same = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
            F.sum("c").alias("c"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("no_id"))
        least = F.min("first.doc_id").over(W.partitionBy("digest"))
        passes = F.when(F.col("first.doc_id") == least, F.col("first.c")).otherwise(F.lit(0)) + F.col("no_id")
        same = same.withColumn("passes", passes)
        rows = same.select("part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask"), F.col("passes").alias("c")),
            F.struct(F.col("mask").bitwiseOR(F.lit(bit[duplicates])).alias("mask"), (F.col("c") - F.col("passes")).alias("c")))).alias("x"))
        rows = rows.select("part", "good", "toxic", "x.mask", "x.c").where("c > 0")
    return rows.groupBy("part", "mask").agg(
        F.sum("c").cast("long").alias("n"), F.sum(F.when(F.col("good"), F.col("c")).otherwise(0)).cast("long").alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("c")).otherwise(0)).cast("long").alias("toxic"))


def _count(field: str, condition: str) -> str:
    return f"aggregate(c.cells, 0L, (s, x) -> s + if({condition}, x.{field}, 0L))"


WALK = """
WITH RECURSIVE walk(part, prefix, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) MAX RECURSION LEVEL {levels} AS (
  SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT w.part, concat(w.prefix, w.letter), w.applied | w.bit, w.step + 1, {kept}, {removed}, {redundant}, {unique}, {good}, {toxic}
  FROM (SELECT part, prefix, applied, step, l.letter AS letter, l.bit AS bit
        FROM walk LATERAL VIEW explode(filter({letters}, x -> applied & x.bit = 0)) AS l) AS w
  JOIN {cells} AS c ON c.part = w.part)
SELECT * FROM walk WHERE step > 0
"""


def audit_orders(cells: DataFrame, letters: list[str]) -> DataFrame:
    """The metrics of every filter prefix: (part, prefix, applied, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost).  The last
    letter of ``prefix`` is the filter of the step.

    ``cells`` are the mask cells of ``failure_cells``; a part has at most
    2 ** len(letters) of them, one array in the recursion's join.
    """
    spark = cells.sparkSession
    name = f"audit_cells_{uuid.uuid4().hex}"
    one = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    materialise(one, "audit-cells").createOrReplaceTempView(name)
    each = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << i})" for i, c in enumerate(sorted(letters)))
    here, before = "x.mask & w.bit != 0", "x.mask & w.applied"
    sql = WALK.format(levels=len(letters) + 1, cells=name, letters=f"array({each})",
                      kept=_count("n", "x.mask & (w.applied | w.bit) = 0"), removed=_count("n", f"{here} and {before} = 0"),
                      redundant=_count("n", f"{here} and {before} != 0"), unique=_count("n", "x.mask = w.bit"),
                      good=_count("good", f"{here} and {before} = 0"), toxic=_count("toxic", f"{here} and {before} = 0"))
    # rows of the recursion: parts x prefixes; the engine's own bound does not know the number of parts
    limit = "spark.sql.cteRecursionRowLimit"
    was = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        return materialise(spark.sql(sql), "audit-prefixes")
    finally:
        spark.conf.unset(limit) if was is None else spark.conf.set(limit, was)
        spark.catalog.dropTempView(name)


def audit_filters(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]],
                  duplicates: str | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row for each part, order of all the filters and step: part,
    filter_order, step (from 1; its filter is that letter of the order), and
    counts of documents within the part: kept (after the step), removed (by
    it), redundant (failing its filter, removed earlier), unique_fails
    (failing no other filter), good_lost and toxic_lost (removed here and
    labelled so) and shapley (removed by its filter, summed over all orders).

    ``filters`` maps a letter to a failure condition on (text, words);
    ``duplicates`` is the letter of a filter that a document fails if its text
    is identical to that of any smaller id in the whole table.

    * A null text is empty; a null part is the empty string.
    * Rows that repeat id and text are as many documents; neither is smaller.
      A null id is not smaller or larger than any, and has no label.
    * Repeated label rows: quality or toxic counts if any row says 1; labels
      without a document count nowhere.
    * Extra columns are not read; an empty table gives an empty result.
    """
    letters = sorted([*filters, *([duplicates] if duplicates else [])])
    if any(len(c) != 1 for c in letters) or len(set(letters)) != len(letters):
        raise ValueError("filters are named by one letter each")
    cells = failure_cells(docs, labels, filters, duplicates, doc_id, text, part)
    steps = audit_orders(cells, letters)
    steps = steps.withColumn("letter", F.substring("prefix", -1, 1))
    whole = steps.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    whole = whole.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    whole = whole.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    out = whole.join(steps.drop("step", "applied"), ["part", "prefix"])
    total = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return out.join(total, ["part", "letter"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley")
