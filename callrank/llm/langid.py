"""Language identification with a string kernel.

Texts are compared by a blended-spectrum presence kernel: the share of
distinct character n-grams (1 to ``max_n``, word ends marked) that two texts
have in common.  Nyström landmarks make the kernel a finite feature map, a
one-versus-rest kernel ridge regression is fitted on it, and whole batches
of documents are scored by two matrix products.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import materialise, small_batches

UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")

#: Distinct words whose n-grams a Python worker remembers.
WORDS_KEPT = 200_000

#: Longest word whose n-grams are remembered.
WORD_CHARS = 64


def has_letter(words: set[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)


def word_grams(word: str, max_n: int) -> set[str]:
    """n-grams of a word with its ends marked by a blank."""
    w = f" {word} "
    return {w[i:i + n] for n in range(1, max_n + 1) for i in range(len(w) - n + 1)} - {" "}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def text_grams(text: str | None, max_n: int) -> set[str]:
    return set().union(*(word_grams(w, max_n) for w in words_of(text)))


@dataclass
class LanguageModel:
    """Landmark presence matrix and ridge weights.

    ``grams`` maps the n-grams of the training texts to columns; ``landmarks``
    is the (landmarks x grams) presence matrix with rows of length one;
    ``weights`` is (landmarks x languages)."""

    languages: list[str]
    grams: dict[str, int]
    landmarks: np.ndarray
    weights: np.ndarray
    max_n: int
    sharpness: float = 8.0

    def presence(self, texts: list[str | None], known: dict[str, tuple[np.ndarray, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Presence rows of length one (or zero), which texts have a letter,
        and what share of the n-grams of their distinct words is known."""
        known = {} if known is None else known
        x, letters = np.zeros((len(texts), len(self.grams)), np.float32), np.zeros(len(texts), bool)
        share = np.zeros(len(texts))
        for i, t in enumerate(texts):
            words = words_of(t)
            letters[i] = has_letter(words)
            met = every = 0
            for w in words:
                got = known.get(w)
                if got is None:
                    own = word_grams(w, self.max_n)
                    got = np.array([self.grams[g] for g in own if g in self.grams], np.int32), len(own)
                    if len(known) < WORDS_KEPT and len(w) <= WORD_CHARS:
                        known[w] = got
                x[i, got[0]] = 1.0
                met, every = met + len(got[0]), every + got[1]
            share[i] = met / max(1, every)
        norm = np.sqrt(x.sum(axis=1, keepdims=True))
        return x / np.maximum(norm, 1.0), letters, share

    def predict(self, texts: list[str | None], known: dict[str, tuple[np.ndarray, int]] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and known shares; ``und`` with score 0 where no letter is."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        x, letters, share = self.presence(texts, known)
        f = self.sharpness * ((x @ self.landmarks.T) @ self.weights).astype(np.float64)
        p = np.exp(f - f.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        return names, np.where(letters, p[np.arange(len(texts)), best], 0.0), share


def fit(texts: list[str], langs: list[str], landmarks: int = 160, max_n: int = 3, ridge: float = 1e-3) -> LanguageModel:
    """Kernel ridge regression on Nyström landmarks, which are spread evenly
    over the languages (rows in the given order)."""
    sets = [text_grams(t, max_n) for t in texts]
    rows = [i for i, s in enumerate(sets) if s]
    names = sorted({langs[i] for i in rows})
    grams = {g: j for j, g in enumerate(sorted(set().union(*(sets[i] for i in rows))))}
    model = LanguageModel(names, grams, np.zeros((0, len(grams)), np.float32), np.zeros((0, len(names)), np.float32), max_n)
    if not rows:
        return model
    x = np.zeros((len(rows), len(grams)), np.float32)
    for r, i in enumerate(rows):
        x[r, [grams[g] for g in sets[i]]] = 1.0
    x /= np.sqrt(x.sum(axis=1, keepdims=True))
    each = max(1, landmarks // len(names))
    place, marks = {n: 0 for n in names}, []
    for r, i in enumerate(rows):
        if place[langs[i]] < each:
            place[langs[i]] += 1
            marks.append(r)
    model.landmarks = x[marks]
    k_nm = (x @ model.landmarks.T).astype(np.float64)
    k_mm = (model.landmarks @ model.landmarks.T).astype(np.float64)
    y = np.array([[1.0 if langs[i] == n else -1.0 for n in names] for i in rows])
    # languages weigh alike, however many rows each has
    count = np.array([sum(langs[j] == langs[i] for j in rows) for i in rows], float)
    weight = (1.0 / count)[:, None]
    a = k_nm.T @ (weight * k_nm) + ridge * k_mm + 1e-9 * np.eye(len(marks))
    model.weights = np.linalg.solve(a, k_nm.T @ (weight * y)).astype(np.float32)
    return model


def training_sample(docs: DataFrame, keep: Column, per_language: int, doc_id: str, text: str, lang: str) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled (text, language) rows of each
    language: those with the smallest hash, so the sample is spread over all
    sources and the same in every run."""
    own = docs.where(keep & F.col(text).isNotNull() & F.col(lang).isNotNull())
    own = own.select(F.col(text).alias("text"), F.col(lang).alias("lang"),
                     F.abs(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)) % 1_000_003).alias("h"))
    share = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return []
    # thin each language by the hash to a little more than the bound, then take exactly the bound
    cut = {k: min(1_000_003, int(1_000_003 * (2.0 * per_language + 50) / n) + 1) for k, n in share.items()}
    limit = F.element_at(F.create_map(*[F.lit(v) for k in cut for v in (k, cut[k])]), F.col("lang"))
    thin = materialise(own.where(F.col("h") < limit), "training")
    out = []
    for k in sorted(share):
        rows = thin.where(F.col("lang") == k).orderBy("h", "text").limit(per_language).collect()
        out += [(r["text"], k) for r in rows]
    return out


def fit_language_model(docs: DataFrame, keep: Column | None = None, per_language: int = 150, doc_id: str = "doc_id",
                       text: str = "text", lang: str = "lang", **options) -> LanguageModel:
    """Fit on a bounded sample (``per_language`` rows of each language) of
    the labelled rows for which ``keep`` holds."""
    rows = training_sample(docs, F.lit(True) if keep is None else F.coalesce(keep, F.lit(False)), per_language, doc_id, text, lang)
    return fit([t for t, _ in rows], [k for _, k in rows], **options)


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", share: str | None = None) -> DataFrame:
    """``docs`` with lang_pred (a learned language, or ``und`` for texts that
    are null or have no letter) and score (0 to 1).

    * Empty texts are ``und``; whole texts are read, however long.
    * Equal scores: the first language by name.  A text with letters but no
      known n-gram gets that language with score 1 / languages.
    * ``share`` names a further column: the share (0 to 1) of the n-grams of
      the text's distinct words that the model knows.
    * Columns named lang_pred or score (and ``share``) are replaced; other extra columns go
      through untouched.  Repeated rows give equal rows.  A model without
      languages calls everything ``und``; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    spare = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", (share or "score").lower())]
    own = docs.select(*spare)
    at = own.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, int]] = {}
        for b in batches:
            names, score, part = model.predict(b.column(at).to_pylist(), known)
            more = [pa.array(part, pa.float64())] if share else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), *more],
                                             schema.names)

    from pyspark.sql import types as T
    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           *([T.StructField(share, T.DoubleType())] if share else [])])
    return own.mapInArrow(run, schema)
