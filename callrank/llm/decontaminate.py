"""Benchmark decontamination: prefix-filtered set join on word shingles.

A benchmark window (``window`` consecutive item words, or the whole of a
shorter item) is a sequence of word shingles.  Shingles are ordered by their
rarity in the corpus; for exact containment the necessary prefix of a window
is its single rarest shingle, so only that one is joined with the corpus.
The offset of the shingle in its window gives the place where the window
must start; starts before the text or windows beyond its end are left out
(positional and length bound), and the words there are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callrank.llm.common import ascii_lower, boxed, fits_broadcast, join_checked, likely_members, materialise, unboxed

#: What separates words: all ASCII characters but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column | str) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _shingle(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(F.col(words), at + j) for j in range(size)])


def benchmark_windows(items: DataFrame, window: int, shingle: int, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, win, n) and their items (wid, item)."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words_of(text).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    w = w.withColumn("_p", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)))
    w = w.select("item", F.slice("w", F.col("_p"), F.least(F.size("w"), F.lit(window))).alias("win"))
    w = materialise(w.withColumn("wid", F.sha2(F.array_join("win", " "), 256)).distinct(), "windows")
    distinct = w.groupBy("wid").agg(F.first("win").alias("win")).withColumn("n", F.size("win"))
    return distinct, w.select("wid", "item").where("item is not null").distinct()


def _corpus_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """One row for each word position (and shingle size) that begins a shingle."""
    at = docs.withColumn("_at", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))))
    if len(sizes) == 1:
        return at.withColumn("tok", _shingle("w", F.col("_at"), sizes[0]))
    return at.withColumn("tok", F.explode(F.array(*[_shingle("w", F.col("_at"), s) for s in sizes])))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, doc_id: str = "doc_id",
                       text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every occurrence of a benchmark window in a document:
    (doc_id, text_hash, at, n, wid) with ``at`` the first word's position.

    Repeated documents (same id and text) count as one.  Null and empty texts
    have no words and no occurrence.  Other columns are not read.
    """
    return _occurrences(docs, items, window, shingle, doc_id, text, item_id, item_text)[0]


def _occurrences(docs, items, window, shingle, doc_id, text, item_id, item_text):
    wins, members = benchmark_windows(items, window, shingle, item_id, item_text)
    toks = wins.withColumn("size", F.least(F.col("n"), F.lit(shingle)))
    toks = toks.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
    by_size = None
    for s in range(1, shingle + 1):
        e = F.when(F.col("size") == s, _shingle("win", F.col("off"), s))
        by_size = e if by_size is None else F.coalesce(by_size, e)
    toks = materialise(toks.select("wid", "win", "n", "size", "off", by_size.alias("tok")), "window-shingles")
    sizes = sorted(r[0] for r in toks.select("size").distinct().collect())  # at most ``shingle`` values
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("w"))
    if not sizes:
        sizes = [shingle]
    # rarity: how often each benchmark shingle begins anywhere in the corpus
    seen = join_checked(_corpus_shingles(own, sizes).select("tok", "text_hash", "_at"), toks.select("tok").distinct(),
                        ["tok"], F.lit(8), ["text_hash", "_at"])
    rarity = materialise(seen.groupBy("tok").agg(F.count("*").alias("df")), "rarity")
    ranked = toks.join(rarity, "tok", "left")
    rare = ranked.groupBy("wid").agg(
        F.min(F.struct("df", "off", "tok", "size")).alias("r"), F.first("win").alias("win"), F.first("n").alias("n"),
        F.sum(F.col("df").isNull().cast("int")).alias("absent"))
    # a window with a shingle that occurs nowhere occurs nowhere
    rare = rare.where("absent = 0").select("wid", "win", "n", F.col("r.tok").alias("tok"), F.col("r.off").alias("off"))
    rare = materialise(rare, "prefix")
    width = F.aggregate("win", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    start = F.col("_at") - F.col("off")
    if fits_broadcast(rare, width + F.lit(100)):  # a text meets all prefixes where it is read
        cand = _corpus_shingles(own, sizes).join(F.broadcast(rare), "tok")
        cand = cand.where((start >= 0) & (start + F.col("n") <= F.size("w"))).withColumn("at", start)
    else:
        cand = _shuffled_candidates(own, rare, sizes, start)
    cand = cand.where(F.slice("w", F.col("at") + 1, F.col("n")) == F.col("win"))
    hits = cand.select("doc_id", "text_hash", "at", "n", "wid").distinct()
    return hits, members


def _shuffled_candidates(own: DataFrame, rare: DataFrame, sizes: list[int], start: Column) -> DataFrame:
    """Candidates where the prefixes are too many for a broadcast: word
    positions meet them by a salted shuffle without their text, and the words
    of a document with candidates join them afterwards, once a document."""
    at = _corpus_shingles(own, sizes).select("tok", "doc_id", "text_hash", "_at", F.size("w").alias("n_words"))
    cand = join_checked(at, rare.drop("win"), ["tok"], F.lit(200), ["text_hash", "_at"])
    cand = cand.where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    cand = materialise(cand.select("doc_id", "text_hash", start.alias("at"), "n", "wid").distinct(), "candidates")
    words = likely_members(own, cand.select("text_hash").distinct(), "text_hash").dropDuplicates(["doc_id", "text_hash"])
    words = words.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "w")
    cand = cand.join(words, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")))
    return cand.join(rare.select("wid", "win"), "wid")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document: doc_id, text_hash, n_words, n_hit (words
    inside any occurrence), n_items, item_ids (sorted strings), contaminated.

    * Null text has no words; empty benchmark or empty documents are fine.
    * Items with equal windows all count.  An item with a null id marks words
      as hit but is not counted or listed.
    * Repeated rows (same id and text) give equal rows; rows with the same id
      and different texts are judged apart.  Null doc_ids are kept.
    * Extra columns, whatever their names, are not read.
    """
    hits, members = _occurrences(docs, items, window, shingle, doc_id, text, item_id, item_text)
    hits = materialise(hits, "hits")
    key = ["doc_id", "text_hash"]
    # union of the intervals [at, at + n): each adds what lies beyond all earlier ends
    spans = hits.groupBy(*key, "at").agg(F.max("n").alias("n")).withColumn("end", F.col("at") + F.col("n"))
    before = W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    spans = spans.withColumn("new", F.greatest(F.col("end") - F.greatest(F.col("at"), reach), F.lit(0)))
    n_hit = spans.groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))
    named = join_checked(hits.select(*key, "wid").distinct(), members, ["wid"], F.lit(80) + F.octet_length("item"),
                         ["text_hash"])
    named = named.select(*key, "item").distinct().groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    found = n_hit.alias("a").join(named.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.text_hash = b.text_hash"), "left")
    found = found.select("a.doc_id", "a.text_hash", "a.n_hit", "b.item_ids").alias("f")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                      F.size(words_of(text)).cast("long").alias("n_words")).alias("o")
    out = own.join(found, F.expr("o.doc_id <=> f.doc_id and o.text_hash = f.text_hash"), "left")
    ids = F.coalesce("f.item_ids", F.array().cast("array<string>"))
    hit = F.coalesce("f.n_hit", F.lit(0).cast("long"))
    return out.select("o.doc_id", "o.text_hash", "o.n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                      ids.alias("item_ids"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark window, with all their columns."""
    bad = decontaminate(docs, items, **options).where("contaminated").select("doc_id", "text_hash").distinct()
    rows = boxed(docs, d=F.col(options.get("doc_id", "doc_id")), h=F.xxhash64(options.get("text", "text")))
    left = rows.join(bad, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left_anti")
    return unboxed(left, docs.columns)
