"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence is toxic with the probability
of a logistic model over the words it has; the document is toxic unless none
of its sentences is (noisy-or).  Only document labels are needed: their
likelihood under the noisy-or trains the sentence model, which then scores
every document and tells which sentences are at fault.

The model is fitted to at most ``max_bags`` labelled documents per class (the
first by a hash of the id), a bound that makes their ids and texts small
enough to broadcast and gather.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_batches, map_rows
from .staging import load, stage

SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+(?=\s|\Z)|[.!?]+|\n|\Z)")
WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Rows whose label nothing may be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, words) of each sentence."""
    return [(m.start(), m.end(), set(WORD.findall(m[0].lower()))) for m in SENTENCE.finditer(text)]


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def sentence(self, words: set[str]) -> float:
        z = self.bias + sum(self.weights[w] for w in words if w in self.weights)
        return 1 / (1 + float(np.exp(-min(max(z, -40.0), 40.0))))


def score(text: str, model: Model, at_least: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Probability of the document, and (start, end, probability) of its offending sentences."""
    quiet = np.log1p(-model.sentence(set()))
    known, log_none, found = model.weights.keys(), 0.0, []
    for m in SENTENCE.finditer(text):
        words = known & WORD.findall(m[0].lower())
        if not words:
            log_none += quiet
            continue
        p = model.sentence(words)
        log_none += np.log1p(-min(p, 1 - 1e-12))
        if p >= at_least:
            found.append((m.start(), m.end(), p))
    return 0.0 - float(np.expm1(log_none)), found


def fit(bags: list[tuple[int, list[list[int]], int]], n_features: int, steps: int = 400, ridge: float = 0.02) -> tuple[float, np.ndarray]:
    """Bias and weights by gradient ascent (Adam) on the noisy-or likelihood of the labels.

    A bag: label, the features of each sentence that has any, number of other sentences.
    """
    if not bags:
        return -8.0, np.zeros(n_features)
    y = np.array([b[0] for b in bags], float)
    others = np.array([b[2] for b in bags], float)
    bag = np.array([i for i, b in enumerate(bags) for _ in b[1]], np.int64)
    each = [s for b in bags for s in b[1]]
    row = np.repeat(np.arange(len(each)), [len(s) for s in each]).astype(np.int64)
    feature = np.array([f for s in each for f in s], np.int64)
    theta = np.zeros(n_features + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y) * 0.5 + 0.5
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(row, theta[feature], len(each))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-np.clip(theta[-1], -30, 30)))
        log_none = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + others * np.log1p(-min(p0, 1 - 1e-9))
        none = np.exp(log_none)
        pull = weight * np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0)  # d log-likelihood / d sum of p
        g_z = pull[bag] * p
        grad = np.append(np.bincount(feature, g_z[row], n_features), g_z.sum() + (pull * others).sum() * p0)
        grad[:-1] -= ridge * theta[:-1] * max(len(y) / 1000, 1)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_bags: int = 6_000,
    max_features: int = 1_000,
    least: int = 3,
) -> Model:
    """Fits the sentence model to the labels outside the held-out quarter.

    Of several labels of one document the largest counts; null labels and
    labels without a document are left out.  Of several texts of one document
    the last in order counts.  Without any toxic label every score is near 0.
    """
    taught = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    mixed = F.xxhash64("doc_id")
    some = [taught.where(F.col("y") == y).orderBy(mixed, "doc_id").limit(max_bags) for y in (0, 1)]
    chosen = stage(some[0].unionByName(some[1]), "chosen")  # at most 2 * max_bags rows
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text).join(F.broadcast(chosen), "doc_id")
    bags = stage(rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("text").alias("text")), "bags")

    def words(y, body):
        for w in set(WORD.findall(body.lower())):
            yield w, y, 1 - y

    n_bad, n_good = bags.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    seen = map_rows(bags.select("y", "text"), words, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # Squared difference of the shares over its variance: how far a word tells the classes apart.
    share = (F.col("bad") + F.col("good") + 1) / F.lit(n_bad + n_good + 2)
    apart = F.pow(F.col("bad") / F.lit(max(n_bad, 1)) - F.col("good") / F.lit(max(n_good, 1)), 2) / share
    best = seen.where(F.col("bad") + F.col("good") >= least).orderBy(apart.desc(), "word").limit(max_features)
    index = {r.word: i for i, r in enumerate(best.collect())}  # at most max_features rows

    def gather(y, body):
        found = [sorted(index[w] for w in ws if w in index) for *_, ws in sentences(body)]
        full = [f for f in found if f]
        yield y, full, len(found) - len(full)

    rows = map_rows(bags.select("y", "text"), gather, "y int, full array<array<int>>, others int").collect()  # at most 2 * max_bags rows
    bias, weights = fit([(r.y, r.full, r.others) for r in rows], len(index))
    return Model(bias, {w: float(weights[i]) for w, i in index.items()})


def score_documents(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentence_threshold: float = 0.3,
) -> DataFrame:
    """``doc_id, score, offending`` (start, end, probability of each toxic sentence).

    A null text counts as empty; an empty text has no sentence and scores 0.
    Repeated rows give repeated results; other columns are ignored.
    """

    def each(doc_id, text):
        p, found = score(text or "", model, sentence_threshold)
        yield doc_id, p, [dict(zip(("start", "end", "p"), x, strict=True)) for x in found]

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), each, f"doc_id {id_type}, score double, offending array<struct<start:long,end:long,p:double>>")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; all columns unchanged."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [score(t or "", model, 2.0)[0] < threshold for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, load(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
        F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("offending"),
    )


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
