"""Line deduplication with fuzzy matching by MinHash.

Distinct lines get a MinHash signature over their character shingles; bands
of the signature bring similar lines together; candidates are verified by the
exact Jaccard similarity of their shingle sets; and distributed union-find
over the verified links keeps one line of each component.  DataFrame
functions only.

A shingle is ``SHINGLE`` characters long and begins at every character, in
all scripts alike; a shorter line is one shingle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import boxed, join_checked, likely_members, materialise, unboxed
from callrank.llm.components import connected_components

#: Characters of a shingle, least Jaccard similarity, bands and rows of a band.  A pair at the threshold shares a band with probability
#: 1 - (1 - 0.8 ** 4) ** 8 = 0.985, one at 0.9 with 0.9998.
SHINGLE, SIMILARITY, BANDS, ROWS = 8, 0.8, 8, 4

#: Lines of a band that are compared pair by pair, if unlike its most frequent line.
SMALL_BAND = 16

#: Hash buckets in which shingles are counted, to order them.
ORDER_BUCKETS = 1 << 16

#: A prime; shingle hashes are taken below it.
PRIME = (1 << 31) - 1


def _permutations(n: int) -> list[tuple[int, int]]:
    """n pairs (a, b): hash * a + b modulo ``PRIME`` is another order of the
    hashes for each, so the rows of the bands are independent also in lines
    of few shingles.  Products stay below 2 ** 63."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            pair.append(x >> 33)
        out.append((pair[0] % (PRIME - 1) + 1, pair[1] % PRIME))
    return out


def trimmed(line: Column) -> Column:
    """No white space at the ends.  Blanks alone go first, which is cheap; the
    trim of several characters walks the whole line, so few lines take it."""
    out = F.trim(line)
    other = [f(out, F.lit(c)) for c in "\t\r\x0b\x0c" for f in (F.startswith, F.endswith)]
    return F.when(reduce(or_, other), F.trim(line, F.lit(" \t\r\x0b\x0c"))).otherwise(out)


def line_occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, line_no, line, h1, h2) of every line that is not
    blank; (h1, h2) is a 128-bit hash of what of a line is compared: lower
    case, no white space at its ends."""
    # the text is hashed and lower-cased once, before its lines are dealt out
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.lower(text).alias("text"))
    own = own.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    own = own.select("doc_id", "text_hash", "line_no", trimmed(F.col("raw")).alias("line")).where("line != ''")
    return own.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(0x5EED), F.col("line")))


def points(line: Column) -> Column:
    """Four bytes for each character, so that a shingle is cut out without walking the line."""
    return F.encode(line, "UTF-32")


def shingle_starts(b: Column, q: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.shiftright(F.octet_length(b), 2) - q, F.lit(0)))


def shingle_at(b: Column, i: Column, q: int) -> Column:
    return F.substring(b, 4 * i + 1, F.lit(4 * q))


def shingle_hashes(line: Column, q: int) -> Column:
    """Hashes of a line's shingles.  The outer transform binds the encoded
    line to a variable; the inner one would encode it again for each place."""
    return F.transform(F.array(points(line)), lambda b: F.transform(
        shingle_starts(b, q), lambda i: F.xxhash64(shingle_at(b, i, q))))[0]


def signatures(grams: DataFrame, bands: int, rows: int) -> DataFrame:
    """(h1, h2, bands) from one row (h1, h2, g) for each 32-bit shingle hash."""
    own = grams.select("h1", "h2", F.col("g").cast("long").bitwiseAND(F.lit(PRIME)).alias("g"))
    sign = own.groupBy("h1", "h2").agg(*[
        F.min(((F.col("g") * F.lit(a) + F.lit(b)) % F.lit(PRIME)).cast("int")).alias(f"m{i}")
        for i, (a, b) in enumerate(_permutations(bands * rows))])
    keys = F.array(*[F.xxhash64(F.lit(b), *[f"m{b * rows + r}" for r in range(rows)]) for b in range(bands)])
    return sign.select("h1", "h2", keys.alias("bands"))


def distinct_lines(lines: DataFrame, occurrences: DataFrame, q: int, bands: int, rows: int) -> DataFrame:
    """(h1, h2, first occurrence, count, bands, lid) of each distinct line.

    The shingles of a line are exploded where it is read and their minima
    taken in one aggregation, combined before its shuffle: neither texts nor
    shingles are shuffled.
    """
    # places are dealt out as rows, so that their hashes and minima are compiled
    own = lines.select("h1", "h2", points(F.col("line")).alias("b"))  # encoded below the explode: once a line
    own = own.select("h1", "h2", "b", F.explode(shingle_starts(F.col("b"), q)).alias("i"))
    grams = own.select("h1", "h2", F.hash(shingle_at(F.col("b"), F.col("i"), q)).alias("g"))
    occ = F.struct("doc_id", "text_hash", "line_no")
    uniq = occurrences.groupBy("h1", "h2").agg(F.min(occ).alias("first"), F.count("*").alias("n"))
    return uniq.join(signatures(grams, bands, rows), ["h1", "h2"]).withColumn(
        "lid", F.monotonically_increasing_id())


def _texts(members: DataFrame, signed: DataFrame, lines: DataFrame) -> DataFrame:
    """(lid, line) of the members of bands.  The texts are read again, and a
    map of the members keeps most other lines from the shuffle."""
    ids = signed.select("lid", "h1", "h2").join(members.select("lid").distinct(), "lid")
    ids = materialise(ids, "band-line-ids")
    near = likely_members(lines.select("h1", "h2", "line"), ids, "h1")
    return near.groupBy("h1", "h2").agg(F.min("line").alias("line")).join(ids, ["h1", "h2"]).select("lid", "line")


def _verified(pairs: DataFrame, lines: DataFrame, q: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of line ids whose shingle sets are similar enough."""
    side = lines.select("lid", "line")
    got = pairs.join(side.toDF("u", "line_u"), "u").join(side.toDF("v", "line_v"), "v")
    got = got.withColumn("a", F.array_distinct(shingle_hashes(F.col("line_u"), q)))
    got = got.withColumn("b", F.array_distinct(shingle_hashes(F.col("line_v"), q)))
    return got.where(_alike(F.col("a"), F.col("b"), similarity)).select("u", "v")


def _alike(a: Column, b: Column, similarity: float) -> Column:
    """Exact Jaccard test of two shingle sets."""
    both = F.size(F.array_intersect(a, b))
    return both >= similarity * (F.size(a) + F.size(b) - both)


def _order(tokens: DataFrame) -> Column:
    """An array with the number of ``tok`` in each of ``ORDER_BUCKETS`` hash
    buckets, as a scalar: bounded, whatever the number of shingles.  With
    the hash itself it gives one order of all shingles, rare ones first."""
    seen = tokens.select(_bucket(F.col("tok")).alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    every = tokens.sparkSession.range(ORDER_BUCKETS).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("n"))
    dense = seen.unionByName(every).groupBy("at").agg(F.sum("n").alias("n"))
    dense = materialise(dense, "shingle-order")
    return dense.agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("c")).select(F.col("c.n").alias("c")).scalar()


def _bucket(tok: Column) -> Column:
    return F.pmod(tok, F.lit(ORDER_BUCKETS)).cast("int")


def _prefix_pairs(members: DataFrame, lines: DataFrame, q: int, similarity: float) -> DataFrame:
    """Candidate pairs (u, v) of lines in the same band and different
    components, one of them odd.  The shingles of a band have one fixed
    order: those of its centre last, and rare ones first in either part; two
    lines that are similar enough share one of their first
    n - ceil(similarity * n) + 1.  What the lines of a band have in common is
    mostly what they share with the centre, so it meets nothing.  Where two
    prefixes first meet, what follows in either part must still hold the
    overlap that is needed.

    Each line's shingles are ordered once, and its prefix is cut once for all
    its bands with one centre.  Those of odd lines are written; of the others
    only those that meet one of them (a map of their hashes tells) reach the
    shuffle."""
    bands = members.groupBy("lid", "centre").agg(F.first("root").alias("root"), F.first("odd").alias("odd"), F.collect_list("band").alias("bands"))
    bands = materialise(bands, "prefix-bands")
    shingles = F.array_distinct(shingle_hashes(F.col("line"), q))
    # dealt by line, so that its shingles come together again without a shuffle of their own
    own = materialise(lines.join(bands.select("lid").distinct(), "lid"), "prefix-lines").repartition("lid")
    tokens = own.select("lid", F.explode(shingles).alias("tok"))
    count = _order(tokens)
    placed = tokens.select("lid", F.struct(F.get(count, _bucket(F.col("tok"))).alias("c"), F.col("tok").alias("t")).alias("s"))
    ranked = placed.groupBy("lid").agg(F.sort_array(F.collect_list("s"))["t"].alias("s"))
    centres = lines.join(bands.select(F.col("centre").alias("lid")).distinct(), "lid")
    centres = materialise(centres.select(F.col("lid").alias("centre"), shingles.alias("own")), "centre-shingles")
    met = join_checked(ranked.join(bands, "lid"), centres, ["centre"], 8 * F.size("own") + 32, ["lid"])
    n, own_part = F.size("s"), F.array_except("s", "own")
    keep = n - F.ceil(n * similarity - 1e-9).cast("int") + 1
    met = met.select("lid", "root", "odd", "bands", n.alias("n"), keep.alias("keep"), "s", "own", own_part.alias("apart"))
    # the centre's part is looked for only where the prefix reaches it
    cut = F.when(F.size("apart") >= F.col("keep"), F.col("apart")).otherwise(F.concat("apart", F.array_intersect("s", "own")))
    cut = materialise(met.select("lid", "root", "odd", "bands", "n", F.size("apart").alias("a"), F.slice(cut, F.lit(1), F.col("keep")).alias("s")), "line-prefixes")
    rows = cut.select("lid", "root", "odd", "n", "a", "bands", F.posexplode("s").alias("i", "tok")).select(
        "lid", "root", "odd", "n", "a", (F.col("i") + 1).alias("i"), "tok", F.explode("bands").alias("band"))
    rows = rows.select(F.xxhash64("band", "tok").alias("at"), "lid", "root", "odd", "n", "a", "i")
    odd = materialise(rows.where("odd").drop("odd"), "odd-prefixes")
    near = likely_members(rows, odd, "at")
    x = odd.select("at", F.col("lid").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("a").alias("ax"), F.col("i").alias("ix"))
    overlap = F.ceil((F.col("nx") + F.col("n")) * (similarity / (1 + similarity)) - 1e-9)
    # a shingle of the centre is one in both lines, and then nothing before it is shared
    rest = F.when((F.col("i") <= F.col("a")) & (F.col("ix") <= F.col("ax")),
                  F.least(F.col("ax") - F.col("ix"), F.col("a") - F.col("i")) + F.least(F.col("nx") - F.col("ax"), F.col("n") - F.col("a"))
                  ).otherwise(F.least(F.col("nx") - F.col("ix"), F.col("n") - F.col("i"))) + 1
    met = x.join(near, "at").where("rx != root and (x < lid or not odd)").where(rest >= overlap)
    return met.select(F.least("x", "lid").alias("u"), F.greatest("x", "lid").alias("v")).distinct()


def _by_band(members: DataFrame, table: DataFrame) -> DataFrame:
    """``members`` with the row of their band in ``table`` (one for each band):
    a band of any number of members is dealt to many tasks."""
    return join_checked(members, table, ["band"], F.lit(16 * len(table.columns)), ["lid"])


def similar_lines(signed: DataFrame, lines: DataFrame, q: int, similarity: float) -> DataFrame:
    """Components (node, root) of line ids under verified links among the
    lines that share a band.

    Within a band every line is first compared with the band's most frequent line;
    those found similar are in one component and need not be compared with
    each other.  What is left, pairs of one band in different components, is
    compared pair by pair in bands of at most ``SMALL_BAND`` lines, and found
    by the prefix filter, which loses none, in larger ones.  So the
    components are those of all pairs of a band without making all pairs.
    """
    # most bands hold one line: the bands alone are counted first, then a map of those
    # with more keeps most lines from the shuffle
    one = signed.select("lid", F.col("n").alias("times"), F.explode("bands").alias("band"))
    shared = materialise(one.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    met = materialise(likely_members(one, shared, "band"), "band-lines")
    # edited copies are more like the line they were made from, the most frequent one, than like each other
    centre = met.groupBy("band").agg(F.max(F.struct("times", "lid"))["lid"].alias("centre"), F.count("*").alias("n"))
    centre = materialise(centre.where("n > 1"), "band-centres")
    members = materialise(_by_band(met, centre).drop("times"), "band-members")
    lines = materialise(_texts(members, signed, lines), "band-texts")
    star = members.where("lid != centre").select(F.least("centre", "lid").alias("u"), F.greatest("centre", "lid").alias("v")).distinct()
    links = materialise(_verified(star, lines, q, similarity), "links")
    comp = connected_components(links)
    apart = members.join(comp, members["lid"] == comp["node"], "left").select(
        "band", "lid", "centre", "n", F.coalesce("root", "lid").alias("root"))
    apart = materialise(apart, "band-components")
    centre = apart.where("lid = centre").select("band", F.col("root").alias("centre_root"))
    centre = materialise(centre, "centre-roots")
    odd = _by_band(apart, centre).where("root != centre_root").select("band", F.col("lid").alias("x"), F.col("root").alias("rx"), "n")
    few = odd.where(F.col("n") <= SMALL_BAND).drop("n").join(apart.select("band", "lid", "root", "centre"), "band")
    few = few.where("root != rx and lid != centre").select(F.least("x", "lid").alias("u"), F.greatest("x", "lid").alias("v"))
    large = odd.where(F.col("n") > SMALL_BAND).select("band").distinct()
    large = _by_band(_by_band(apart, materialise(large, "large-bands")), centre)
    many = _prefix_pairs(large.select("band", "lid", "root", "centre", (F.col("root") != F.col("centre_root")).alias("odd")), lines, q, similarity)
    more = materialise(_verified(few.unionByName(many).distinct(), lines, q, similarity), "more-links")
    return connected_components(links.unionByName(more))


def judge_lines(docs: DataFrame, q: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line that is not blank: doc_id, text_hash, line_no
    (from 0), kept, group_size (occurrences in its component), and the
    occurrence that stays: kept_doc_id, kept_line_no.

    * Lines are equal if they are after lower-casing and trimming, similar if
      the Jaccard similarity of their shingle sets is at least
      ``similarity``; of each component of similar lines the first occurrence
      by (doc_id, hash of the text, line number) stays, null ids first.
    * Blank lines are layout, not content; they have no row and stay.
      Null and empty texts have no lines.
    * Rows that repeat both id and text are one document in several copies:
      they have equal rows and keep the same lines; ``group_size`` counts
      each copy.
    * Extra columns are not read; an empty table gives an empty result.
    """
    lines = line_occurrences(docs, doc_id, text)
    occurrences = materialise(lines.drop("line"), "occurrences")
    signed = materialise(distinct_lines(lines, occurrences, q, bands, rows), "lines")
    comp = materialise(similar_lines(signed, lines, q, similarity), "line-components")
    slim = signed.select("lid", "h1", "h2", "first", "n")
    # fuzzy components: their first occurrence, by line
    member = slim.join(comp, slim["lid"] == comp["node"])
    best = member.groupBy("root").agg(F.min("first").alias("kept_at"), F.sum("n").alias("size"))
    fuzzy = member.select("h1", "h2", "root").join(best, "root").select("h1", "h2", "kept_at", "size")
    # other lines that occur more than once stand for themselves
    exact = slim.where("n > 1").join(comp, slim["lid"] == comp["node"], "left_anti").select(
        "h1", "h2", F.col("first").alias("kept_at"), F.col("n").alias("size"))
    ruling = materialise(fuzzy.unionByName(exact), "line-rulings")
    out = occurrences.join(ruling, ["h1", "h2"], "left")
    here = F.struct("doc_id", "text_hash", "line_no")
    kept = F.col("kept_at").isNull() | here.eqNullSafe(F.col("kept_at"))
    return out.select("doc_id", "text_hash", F.col("line_no").cast("int").alias("line_no"), kept.alias("kept"),
                      F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                      F.coalesce("kept_at", here).alias("_k")).select(
        "doc_id", "text_hash", "line_no", "kept", "group_size", F.col("_k.doc_id").alias("kept_doc_id"),
        F.col("_k.line_no").cast("int").alias("kept_line_no"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, with the lines that ``judge_lines`` does
    not keep cut from ``text``.  A document whose lines all go stays, with an
    empty text; null texts stay null.  Other columns are as they were."""
    gone = judge_lines(docs, doc_id=doc_id, text=text, **options).where(~F.col("kept"))
    gone = gone.select("doc_id", "text_hash", "line_no").distinct().groupBy("doc_id", "text_hash").agg(
        F.collect_list("line_no").alias("_cut"))
    gone = gone.select(F.col("doc_id").alias("_cut_id"), F.col("text_hash").alias("_cut_hash"), "_cut")
    rows = boxed(docs, d=F.col(doc_id), h=F.xxhash64(text), t=F.col(text))
    out = rows.join(gone, F.col("d").eqNullSafe(F.col("_cut_id")) & (F.col("h") == F.col("_cut_hash")), "left")
    # the outer transform binds the lines of a text; what is cut is looked up by hash, not line by line
    left = F.transform(F.array(F.split("t", "\n")), lambda own: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("_cut")), lambda i: F.get(own, i)), "\n"))[0]
    new = F.when(F.col("_cut").isNull(), F.col("t")).otherwise(left)
    return unboxed(out.withColumn("row", F.col("row").withField(f"`{text}`", new)), docs.columns)
