"""Quality rules: counts that any text must pass, then a likelihood ratio.

Words and pairs of words are hashed to buckets. Two multinomials over buckets
are counted, one over trusted documents (the target), one over the whole corpus
(raw). A document's score is the sum over its n-grams of the logarithm of
target over raw probability, divided by their number. The target leans on the
raw corpus with the weight of ``PRIOR`` n-grams, so that a small target judges
mildly.

Trusted documents that were counted score better than others like them, the more
so the smaller the target is. So a fold of them isn't counted, and
the threshold is where all but a share of ``LOST`` of that fold pass: text like
the target is kept alike at every size. Without such a fold all pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, bucket_sums, lean, only, read, scramble, window_hashes

BITS = 16
PRIOR = 1 << 16
#: The share of trusted documents held out that may fall below the threshold.
LOST = 0.002
#: Scores are put in steps of this when the threshold is sought.
STEP = 1 / 1024
WINDOW = 8
FEWEST_WORDS = 20
MOST_REPEATED = 30  # percent of words
SYMBOLS = "#*$%&|<>"


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each word and each pair of words."""
    shift = np.uint64(64 - BITS)
    if len(hashes) < 2:
        return (scramble(hashes) >> shift).astype(np.int64)
    return np.concatenate([scramble(hashes) >> shift, window_hashes(hashes, 2) >> shift]).astype(np.int64)


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window which the text holds twice or more often."""
    if len(hashes) < window + 1:
        return 0
    w = window_hashes(hashes, window)
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    twice = np.zeros(len(w), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(hashes) + 1, np.int32)
    edge[: len(w)] += twice
    edge[window : window + len(w)] -= twice
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def base_counts(text: str, hashes: WordHashes) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; the words' hashes."""
    words = WORD.findall(text)
    h = hashes.of(words)
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += WORD.search(line) is not None
        else:
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeats, repeated_words(h)), h


def counted(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Documents' n-grams per bucket, over every row."""

    def make():
        hashes = WordHashes()
        return lambda raw: buckets(hashes.of(WORD.findall(raw.tobytes().decode("utf-8", "surrogatepass"))))

    return bucket_sums(docs.select(text), 1 << BITS, make)[0]


def ratios(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Per bucket, the logarithm of target over raw probability; 0 where raw has nothing."""
    p = (raw + 1.0) / (raw.sum() + len(raw))
    return np.log((target + prior * p) / (target.sum() + prior)) - np.log(p)


@dataclass
class Model:
    weights: np.ndarray
    threshold: float


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold of trusted documents that sets the threshold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 3


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The ids and texts of all documents labelled good."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id")
    return only(docs.select("doc_id", "text"), "doc_id", good)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts of all documents, and of all labelled good but for a fold; the
    threshold from that fold's scores. Repeated ids or labels count a document
    once for each of its rows; null ids are in the raw corpus alone."""
    good = trusted(docs, labels)
    weights = ratios(counted(good.filter(~held_out()).select("text")), counted(docs.select("text")))
    scores = judged(good.filter(held_out()), Model(weights, 0.0), carry=("doc_id",)).filter("NOT quality.base_failed")
    steps = scores.groupBy(F.floor(F.col("quality.score") / STEP).alias("step")).count().collect()  # scores are within some 30 of 0
    left = LOST * sum(r["count"] for r in steps)
    for r in sorted(steps):
        left -= r["count"]
        if left < 0:
            return Model(weights, r["step"] * STEP)
    return Model(weights, -math.inf)


def judged(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """docs with a struct ``quality``: the counts, base_failed, score and kept.

    A null or empty text has no words, fails the base rules and isn't kept.
    Rows are judged one by one, whole, so repeated rows all get the same
    verdict; an empty table stays empty. The columns named by carry pass through in ``row``, so none can clash.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # one number a bucket
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    rows = docs.select(F.col(text).cast("string").alias("text"), F.struct(*carry).alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, quality struct<{', '.join(x.replace(' ', ':') for x in fields.split(', '))}>"
    kinds = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())]

    def run(batches):
        hashes, weigh, threshold = WordHashes(), shared.value.weights, shared.value.threshold
        for batch in batches:
            out = []
            for t in batch.column(0):
                counts, h = base_counts(t.as_py() or "", hashes)
                failed = counts[0] < FEWEST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
                score = float(weigh[buckets(h)].mean()) if len(h) else 0.0
                out.append((*counts, failed, score, not failed and score >= threshold))
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            quality = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])
            yield pa.RecordBatch.from_arrays([batch.column(1), quality], names=["row", "quality"])

    return rows.mapInArrow(lean(run), schema)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Rows are judged one by one:
    repeated ones stay or go together, and an empty table stays empty."""
    return judged(docs, fit(docs, labels)).filter("quality.kept").select("row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    # only the id travels beside the text
    return judged(docs, fit(docs, labels), carry=("doc_id",)).select(F.col("row.doc_id").alias("doc_id"), "quality.*")
