"""Toxicity by weak supervision.

Many weak voters look at a text: lexicons of words and of word beginnings,
and patterns (shouting, symbol runs, repetition).  The lexicons are mined from
a bounded sample of labelled rows.  A generative label model estimates from
the vote patterns of all documents how accurate each voter is and which
voters depend on each other, and gives each pattern a posterior.  A linear
classifier over lexicon terms and voter signals is trained on the posteriors
and scores every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callrank.llm.common import join_checked, materialise, small_batches

_WORD = re.compile(r"[^\W\d_]+")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SYMBOL = re.compile(r"[#$%&*@^~|]")

#: Characters of the word beginnings that stand beside whole words.
STEMS = (4, 5, 6, 7)

#: Words of which a Python worker remembers the terms, and the longest.
WORDS_KEPT, WORD_CHARS = 300_000, 64

#: Terms that a mining task counts before it hands the counts on.
TERMS_KEPT = 400_000

#: Lexicons of each kind (words, stems); a term's hash decides in which it is.
LEXICONS = 3

#: Dense signals of a document beside its lexicon terms.
SIGNALS = 2 * LEXICONS + 9

VOTERS = [*[f"words_{i}" for i in range(LEXICONS)], *[f"stems_{i}" for i in range(LEXICONS)],
          "density", "shouting", "exclaiming", "symbols", "repeating"]


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings, marked by a star."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


@dataclass
class Lexicon:
    """Mined terms.  ``index`` maps a term to its place; ``kind`` is its
    lexicon: 0 to LEXICONS - 1 for whole words, the next ones for stems."""

    index: dict[str, int] = field(default_factory=dict)
    kind: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, terms: list[str]) -> Lexicon:
        kind = [crc32(t.encode()) % LEXICONS + LEXICONS * t.endswith("*") for t in terms]
        return cls({t: i for i, t in enumerate(terms)}, np.array(kind, np.int64))

    def look(self, text: str | None, known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """(places of the terms in the text, dense signals).  Signals: log
        distinct hits in each lexicon, log and share of words that hit, and
        the pattern measures."""
        text = text or ""
        words = Counter(_WORD.findall(text.lower()))
        index, met, hits = self.index, set(), 0
        for w, n in words.items():
            got = known.get(w)
            if got is None:
                got = tuple(index[t] for t in terms_of(w) if t in index)
                if len(known) < WORDS_KEPT and len(w) <= WORD_CHARS:
                    known[w] = got
            if got:
                met.update(got)
                hits += n
        places = np.array(sorted(met), np.int32)
        total = sum(words.values())
        each = np.bincount(self.kind[places], minlength=2 * LEXICONS) if len(places) else np.zeros(2 * LEXICONS)
        size = max(1, len(text))
        letters = sum(len(w) * n for w, n in words.items())
        capitals = len(_CAPITAL.findall(text)) / max(1, letters)
        out = [*np.log1p(each), math.log1p(hits), min(1.0, 20.0 * hits / max(1, total)), math.log1p(total) / 10,
               float(capitals > 0.3), math.log1p(text.count("!!")) / 5, min(1.0, 10.0 * len(_SYMBOL.findall(text)) / size),
               1.0 - len(words) / total if total else 0.0, float(hits > 0), float(total == 0)]
        return places, np.array(out)


def votes_of(signals: np.ndarray) -> np.ndarray:
    """Votes (-1 clean, 0 no opinion, 1 toxic) of every voter, one row a
    document.  A lexicon says toxic from two distinct terms, clean at none."""
    x, k = signals, 2 * LEXICONS
    each = np.expm1(x[:, :k]).round()
    cols = [np.where(each[:, i] >= 2, 1, np.where(each[:, i] == 0, -1, 0)) for i in range(k)]
    cols.append(np.where(x[:, k + 1] >= 0.2, 1, np.where(x[:, k + 1] < 0.04, -1, 0)))
    cols += [(x[:, k + 3] > 0).astype(int), (x[:, k + 4] > 0.3).astype(int), (x[:, k + 5] > 0.3).astype(int), (x[:, k + 6] > 0.8).astype(int)]
    return np.stack(cols, axis=1).astype(np.int8)


def pattern_code(votes: np.ndarray) -> np.ndarray:
    return ((votes.astype(np.int64) + 1) * 3 ** np.arange(votes.shape[1], dtype=np.int64)).sum(axis=1)


def pattern_votes(code: np.ndarray, voters: int) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(voters, dtype=np.int64)) % 3  # 0 clean, 1 none, 2 toxic


@dataclass
class LabelModel:
    """A tree over the voters for each class: every voter depends on the
    class and on the voter it is most correlated with, given the class.
    ``table[j][y, p, v]`` is the chance of vote v where its parent votes p."""

    prior: float
    parent: list[int]
    table: list[np.ndarray]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of class 1 for rows of votes 0, 1, 2."""
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, p in enumerate(self.parent):
            up = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            log += np.log(self.table[j][:, up, votes[:, j]]).T
        log -= log.max(axis=1, keepdims=True)
        q = np.exp(log)
        return q[:, 1] / q.sum(axis=1)

    def accuracy(self, votes: np.ndarray, weight: np.ndarray) -> list[float]:
        """Expected share of right votes of each voter among those it casts."""
        q, out = self.posterior(votes), []
        for j in range(votes.shape[1]):
            right = (weight * (q * (votes[:, j] == 2) + (1 - q) * (votes[:, j] == 0))).sum()
            cast = (weight * (votes[:, j] != 1)).sum()
            out.append(float(right / cast) if cast else 0.5)
        return out


def _tree(votes: np.ndarray, weight: np.ndarray) -> list[int]:
    """Maximum spanning tree of the voters' mutual information given the
    class (Chow-Liu); ``weight`` is (patterns x 2).  Ties go to lower voters."""
    n = votes.shape[1]
    gain = np.zeros((n, n))
    total = weight.sum()
    for i in range(n):
        for j in range(i):
            for y in (0, 1):
                joint = np.bincount(votes[:, i] * 3 + votes[:, j], weight[:, y], 9).reshape(3, 3)
                mass = joint.sum()
                if mass <= 0:
                    continue
                out = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
                at = joint > 0
                gain[i, j] += (joint[at] * np.log(joint[at] * mass / out[at])).sum() / total
            gain[j, i] = gain[i, j]
    parent, inside = [-1] * n, [0]
    while len(inside) < n:
        _, up, new = max((gain[i, j], -i, -j) for i in inside for j in range(n) if j not in inside)
        parent[-new] = -up
        inside.append(-new)
    return parent


def fit_label_model(votes: np.ndarray, count: np.ndarray, known: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation maximisation over vote patterns (rows of 0, 1, 2).

    ``count`` are the documents of each pattern; ``known`` (patterns x 2) the
    labelled rows of each class, which start the estimate and anchor it: all
    documents together weigh as much as the labelled ones.  Which voters
    depend on each other is estimated anew in every round."""
    anchor = known.astype(float)
    share = anchor.sum() / max(1.0, count.sum()) if anchor.sum() else 1.0
    own = count * min(1.0, share)
    rate = (anchor[:, 1].sum() + 0.5) / (anchor.sum() + 1.0)
    soft = anchor.copy() if anchor.sum() else np.stack([own * (1 - rate), own * rate], axis=1)
    model = None
    for _ in range(rounds):
        parent = _tree(votes, soft) if soft.sum() else [-1] * votes.shape[1]
        table = []
        for j, p in enumerate(parent):
            up = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            t = np.empty((2, 3, 3))
            for y in (0, 1):
                # smoothed towards the vote's share without the parent
                alone = np.bincount(votes[:, j], soft[:, y], 3) + 0.5
                pairs = np.bincount(up * 3 + votes[:, j], soft[:, y], 9).reshape(3, 3)
                t[y] = pairs + alone / alone.sum()
                t[y] /= t[y].sum(axis=1, keepdims=True)
            table.append(t)
        prior = float(np.clip((soft[:, 1].sum() + 0.5) / (soft.sum() + 1.0), 1e-4, 1 - 1e-4))
        new = LabelModel(prior, parent, table)
        q = new.posterior(votes)
        soft = anchor + own[:, None] * np.stack([1 - q, q], axis=1)
        if model is not None and np.abs(q - model.posterior(votes)).max(initial=0.0) < 1e-4:
            return new
        model = new
    return model


def fit_linear(places: list[np.ndarray], signals: np.ndarray, goal: np.ndarray, terms: int, ridge: float = 2e-4,
               rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft goals by accelerated gradient steps.
    Returns weights of the terms, of the signals, and the intercept."""
    x = np.zeros((len(places), terms + signals.shape[1] + 1), np.float32)
    for i, p in enumerate(places):
        x[i, p] = 1.0 / math.sqrt(1.0 + len(p))
    x[:, terms:-1], x[:, -1] = signals, 1.0
    w = np.zeros(x.shape[1], np.float32)
    if not len(places):
        return w[:terms], w[terms:-1], 0.0
    mass = np.float32(1.0 / len(places))
    step = 4.0 / float((x * x).sum() * mass + ridge)
    ahead, before = w.copy(), w.copy()
    for i in range(rounds):
        z = x @ ahead
        slope = x.T @ (mass * (1.0 / (1.0 + np.exp(-z)) - goal)) + ridge * ahead
        before, w = w, ahead - step * slope
        ahead = w + (i / (i + 3.0)) * (w - before)
    return w[:terms], w[terms:-1], float(w[-1])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    labels: LabelModel | None
    terms: np.ndarray
    signals: np.ndarray
    bias: float

    def score(self, places: np.ndarray, signals: np.ndarray) -> float:
        z = self.bias + float(signals @ self.signals)
        if len(places):
            z += float(self.terms[places].sum()) / math.sqrt(1.0 + len(places))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, toxic) of at most ``per_class`` labelled ids of each
    class, those with the smallest hash, as a written table.  Only ids reach
    the join's small side, and at most ``per_class`` of each class."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    own = own.groupBy("_id").agg(F.max("toxic").alias("toxic"))  # repeated label rows: toxic if any says so
    own = own.withColumn("doc_id", F.col("_id")).where(F.coalesce(keep, F.lit(False))).drop("doc_id")
    own = own.withColumn("h", F.xxhash64(F.lit(11), F.col("_id").cast("string")))
    ids = None
    for c in (0, 1):
        some = own.where(F.col("toxic") == c).orderBy("h", "_id").limit(per_class).select("_id", "toxic")
        ids = some if ids is None else ids.unionByName(some)
    ids = materialise(ids, "toxicity-ids")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).where("_id is not null")
    met = join_checked(rows, ids, ["_id"], F.coalesce(F.octet_length(F.col("_id").cast("string")), F.lit(0)) + 32, ["text"])
    # an id that many rows share gives one of its texts
    met = met.groupBy("_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return materialise(met.select(F.col("_id").alias("doc_id"), "text", "toxic"), "toxicity-sample")


def mine_lexicon(sample: DataFrame, terms: int, contrast: float = 2.0) -> Lexicon:
    """The ``terms`` words and word beginnings that set toxic rows of the
    sample apart most: a log ratio of smoothed shares of ``contrast`` or more,
    and a deviance beyond what the largest of so many tested terms reaches by
    chance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            rows = list(seen.items())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([n[0] for _, n in rows], pa.int64()),
                                               pa.array([n[1] for _, n in rows], pa.int64())], ["term", "clean", "toxic"])
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for t in {t for w in set(_WORD.findall((text or "").lower())) if len(w) <= WORD_CHARS for t in terms_of(w)}:
                    seen.setdefault(t, [0, 0])[toxic] += 1
                if len(seen) > TERMS_KEPT:
                    yield flush()
        yield flush()

    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return Lexicon()
    counts = sample.select("text", "toxic").mapInArrow(run, "term string, clean long, toxic long")
    counts = materialise(counts.groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")), "toxicity-terms")
    # half the deviance of the term's rows against the classes' shares; half of the largest of m squared normals is about log m
    rate = n1 / (n0 + n1)
    n = F.col("a") + F.col("b")
    deviance = F.col("b") * F.log(F.col("b") / (n * rate)) + F.when(F.col("a") > 0, F.col("a") * F.log(F.col("a") / (n * (1 - rate)))).otherwise(0.0)
    ratio = F.log((F.col("b") + 0.5) / (n1 + 1.0)) - F.log((F.col("a") + 0.5) / (n0 + 1.0))
    chance = math.log(max(2, counts.count()))
    best = counts.where((F.col("b") > 0) & (ratio >= contrast) & (deviance >= chance)).orderBy(deviance.desc(), "term").limit(terms).collect()
    return Lexicon.of([r["term"] for r in best])


def look_at(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pattern, places, signals) of every row, as a written table:
    what voters and classifier see of a text."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            got = [lexicon.look(t, known) for t in b.column(1).to_pylist()]
            signals = np.array([s for _, s in got]).reshape(len(got), SIGNALS)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pattern_code(votes_of(signals)), pa.int64()),
                 pa.array([p.tolist() for p, _ in got], pa.list_(pa.int32())), pa.array(signals.tolist(), pa.list_(pa.float64()))],
                ["doc_id", "pattern", "places", "signals"])

    schema = T.StructType([own.schema["doc_id"], T.StructField("pattern", T.LongType()),
                           T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("signals", T.ArrayType(T.DoubleType()))])
    return materialise(own.mapInArrow(run, schema), "toxicity-signals")


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_class: int = 8000, terms: int = 1000,
                 doc_id: str = "doc_id", text: str = "text") -> tuple[ToxicityModel, DataFrame]:
    """The model, and the table of ``look_at`` for all documents.

    Lexicons and classifier are fitted on a bounded sample: ``per_class``
    labelled ids of each class at most (of those for which ``keep`` holds, a
    condition on doc_id) and ``terms`` terms, so at most 2 * per_class rows of
    terms + SIGNALS numbers reach the driver.  The label model counts the vote
    patterns of all documents, of which there are at most 3 ** 7 * 2 ** 4
    whatever the number of documents."""
    sample = labelled_sample(docs, labels, F.lit(True) if keep is None else keep, per_class, doc_id, text)
    lexicon = mine_lexicon(sample, terms)
    seen = look_at(docs, lexicon, doc_id, text)
    taught = look_at(sample, lexicon).join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id") if lexicon.index else None
    if taught is None:
        return ToxicityModel(lexicon, None, np.zeros(0), np.zeros(SIGNALS), -4.0), seen
    rows = taught.select("doc_id", "pattern", "places", "signals", "toxic").orderBy("doc_id", "pattern").collect()
    counted = {r["pattern"]: r["n"] for r in seen.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    codes = np.array(sorted({*counted, *(r["pattern"] for r in rows)}), np.int64)
    at = {c: i for i, c in enumerate(codes.tolist())}
    known = np.zeros((len(codes), 2))
    for r in rows:
        known[at[r["pattern"]], r["toxic"]] += 1
    votes = pattern_votes(codes, len(VOTERS))
    model = fit_label_model(votes, np.array([counted.get(c, 0) for c in codes.tolist()], float), known)
    goal = model.posterior(votes)[[at[r["pattern"]] for r in rows]].astype(np.float32)
    w, s, b = fit_linear([np.array(r["places"], np.int64) for r in rows], np.array([r["signals"] for r in rows]), goal, len(lexicon.index))
    return ToxicityModel(lexicon, model, w, s, b), seen


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: Column | None = None, doc_id: str = "doc_id", text: str = "text",
                   threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, score, predicted) for each row: score from 0 to 1, predicted
    1 if it is at least ``threshold``.

    * Null and empty texts have no hits and are scored like any other.
    * Repeated rows get equal scores; repeated label rows count once, toxic if
      any says so.  Labels that are null or not 0 or 1 are not read.
    * Without labelled rows of both classes, or without a term that sets them
      apart, nothing is learned and every score is the same, below 0.3.
    * Whole texts are read, however long.  Extra columns are not read; an
      empty table gives an empty result.
    """
    model, seen = fit_toxicity(docs, labels, keep, doc_id=doc_id, text=text, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.score(np.array(p, np.int64), np.array(s)) for p, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    schema = T.StructType([seen.schema["doc_id"], T.StructField("score", T.DoubleType())])
    out = seen.select("doc_id", "places", "signals").mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
