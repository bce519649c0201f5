"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the other side of the training is
unlabelled text, of which a share, the class prior, is taken to be toxic too.
The risk of the negatives is estimated from the unlabelled text less what the
prior says of positives in it; where a batch makes that estimate negative, the
step goes back on it (Kiryo et al., 2017).

Features are the different words of a text and their beginnings of four to eight
bytes, and that two or three of its words begin alike; all are hashed to
buckets, straight from the bytes. Each is weighted by how far its logarithmic share of
positives surely stands above that of unlabelled texts. A text's sum is divided by the
fourth root of its number of features. The unlabelled side is the whole corpus,
as it stands for what any text may be; shares are counted over all of it and all
positives. The model is linear, its gradient steps are numpy's on bounded
samples; each document is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_sums, only, per_text, read, scramble
from .wordhash import letter_words

BITS = 18
#: How many bytes of a word's beginning are a feature.
BEGINNINGS = (4, 5, 6, 8)
#: So many words of a text that begin alike are a feature of their own.
ALIKE = (2, 3)
BUCKETS = (1 + len(ALIKE)) << BITS
#: The share of unlabelled text that is taken to be toxic.
PRIOR = 0.1
#: Bounds of the samples for the gradient steps; documents go by a hash of their ids.
MOST_POSITIVE, MOST_UNLABELLED = 4096, 8192
#: Most features with a weight: the surest ones.
MOST_FEATURES = 1 << 15
THRESHOLD = 0.3
#: Smoothing of the features' counts, and how many standard errors of a feature's
#: logarithmic ratio count for nothing, so that few examples teach little.
SMOOTH, ERRORS = 0.25, 3.0
ROOT = 0.25
STEPS, BATCH, RATE, SEED = 128, 256, 0.1, 11


def features(raw: np.ndarray) -> np.ndarray:
    """The different buckets of a text's UTF-8 bytes."""
    words, beginnings = letter_words(raw, BEGINNINGS)
    shift = np.uint64(64 - BITS)
    kinds = (np.arange(1, len(BEGINNINGS) + 1, dtype=np.uint64) << np.uint64(56)) * np.uint64(37)
    alike, times = np.unique((scramble(beginnings ^ kinds) >> shift).astype(np.int32)[beginnings != 0], return_counts=True)
    once = np.unique(np.concatenate([(scramble(words) >> shift).astype(np.int32), alike]))
    return np.concatenate([once, *(alike[times >= n] + (k << BITS) for k, n in enumerate(ALIKE, 1))])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        z = self.bias + float(self.weights[features].sum()) / max(1, len(features)) ** ROOT
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def sureness(positive: tuple[np.ndarray, int], unlabelled: tuple[np.ndarray, int]) -> np.ndarray:
    """How far each feature's logarithmic share of positives surely stands above
    that of unlabelled texts, 0 where it doesn't. Each side: texts with each feature, and all texts."""
    (p, n_p), (u, n_u) = positive, unlabelled
    p, u = p + SMOOTH, u + SMOOTH
    ratio = np.log(p / (n_p + 2 * SMOOTH)) - np.log(u / (n_u + 2 * SMOOTH))
    found = np.maximum(ratio - ERRORS * np.sqrt(1 / p + 1 / u), 0.0)
    if np.count_nonzero(found) > MOST_FEATURES:
        found[np.argsort(-found, kind="stable")[MOST_FEATURES:]] = 0.0
    return found


class _Side:
    """A sample's features (places among those with a weight, and the number of all) and batches of it."""

    def __init__(self, docs: list[tuple[np.ndarray, int]], scale: np.ndarray, rng):
        self.docs, self.scale, self.rng, self.order = docs, scale, rng, []

    def batch(self, n: int):
        while len(self.order) < n:
            self.order += self.rng.permutation(len(self.docs)).tolist()
        take, self.order = self.order[:n], self.order[n:]
        rows = np.repeat(np.arange(n), [len(self.docs[i][0]) for i in take])
        columns = np.concatenate([self.docs[i][0] for i in take])
        sizes = np.array([max(1, self.docs[i][1]) for i in take])
        return rows, columns, self.scale[columns] / sizes[rows] ** ROOT


def train(positive: list, unlabelled: list, scale: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, float]:
    """Weights of the features that scale holds, and the bias."""
    rng = np.random.default_rng(SEED)
    p, u = _Side(positive, scale, rng), _Side(unlabelled, scale, rng)
    np_, nu = min(len(positive), BATCH // 4), min(len(unlabelled), BATCH)
    w, b, seen, seen_b = np.zeros(len(scale)), 0.0, np.full(len(scale), 1e-6), 1e-6
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(STEPS):
        (rp, cp, vp), (ru, cu, vu) = p.batch(np_), u.batch(nu)
        sp = np.bincount(rp, w[cp] * vp, minlength=np_) + b
        su = np.bincount(ru, w[cu] * vu, minlength=nu) + b
        # logistic losses: log(1 + exp(-s)) as a positive, log(1 + exp(s)) as a negative
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        as_positive, as_negative = -prior * (1 - sigmoid(sp)) / np_, -prior * sigmoid(sp) / np_
        gu = sigmoid(su) / nu
        gp, gu = (as_positive + as_negative, gu) if negative >= 0 else (-as_negative, -gu)
        g = np.bincount(cp, gp[rp] * vp, minlength=len(w)) + np.bincount(cu, gu[ru] * vu, minlength=len(w))
        gb = gp.sum() + gu.sum()
        seen += g * g
        seen_b += gb * gb
        w -= RATE * g / np.sqrt(seen)
        b -= RATE * gb / np.sqrt(seen_b)
    return w * scale, float(b)


def training_fold(doc_id="doc_id"):
    """Rows whose labels may be learnt: the CRC-32 of the id as text leaves another remainder than 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def sampled(docs: DataFrame, ids: DataFrame, most: int, active: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Of the documents with these ids, or as many of them as may be: places of
    their features in active (no more than MOST_FEATURES), and how many they have in all."""
    ids = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(active)

    def make():
        known = shared.value

        def of(raw: np.ndarray):
            found = features(raw)
            at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
            return (at[known[at] == found].astype(np.int32).tobytes() if len(known) else b"", len(found))

        return of

    found = per_text(rows, ["doc_id"], "text", "features binary, n long", make, raw=True).collect()
    return [(np.frombuffer(f, np.int32), n) for _, f, n in sorted({(r["doc_id"], bytes(r["features"]), r["n"]) for r in found})]


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the texts have each feature, and how many there are; no row is left out."""
    return bucket_sums(texts.select("text"), BUCKETS, lambda: features)


def fit(docs: DataFrame, labels: DataFrame, prior: float = PRIOR) -> Model:
    """A model from the toxic labels of the training folds alone.

    Unlabelled are all documents: they are what any text may be. Features are
    counted over all documents and over all positives, and the gradient steps
    see a sample of each. Rows without an id are only counted. A label that is
    there twice counts once, a document whose id is there twice counts twice.
    Without positives or documents every score is close to 0.
    """
    toxic = labels.filter(F.col("doc_id").isNotNull() & training_fold() & (F.col("toxic") == 1)).select("doc_id")
    positives = only(docs.select("doc_id", "text"), "doc_id", toxic)
    positive = frequencies(positives)
    unlabelled = frequencies(docs) if positive[1] else positive
    if not positive[1]:
        return Model(np.zeros(BUCKETS), -5.0)
    scale = sureness(positive, unlabelled)
    active = np.flatnonzero(scale).astype(np.int32)
    sides = [sampled(docs, ids, most, active) for ids, most in ((positives.select("doc_id"), MOST_POSITIVE), (docs.select("doc_id").filter("doc_id IS NOT NULL"), MOST_UNLABELLED))]
    weights = np.zeros(BUCKETS)
    weights[active], bias = train(*sides, scale[active], prior)
    return Model(weights, bias)


def scored(docs: DataFrame, model: Model, carry: list[str], threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Columns carry with score and predicted, of whole texts.

    A null or empty text has no features and gets the score of the bias alone.
    Equal texts get equal scores, however long they are; repeated rows stay, an
    empty table stays empty, and columns other than carry and text are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def make():
        model = shared.value

        def of(raw: np.ndarray):
            s = model.score(features(raw))
            return s, int(s >= threshold)

        return of

    return per_text(docs, carry, text, "score double, predicted int", make, raw=True)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted to be toxic, with their own columns.
    Repeated rows stay or go together; an empty table stays empty."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return scored(rows, fit(docs, labels), ["row"]).filter("predicted = 0").select("row.*")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = scored(docs, fit(docs, labels), ["doc_id"])
    held_out = F.coalesce(~training_fold(), F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", "predicted")
