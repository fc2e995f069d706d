"""Masked pseudo-likelihood scores from a bidirectional window network.

Every token is predicted from the ``WINDOW`` tokens on either side of it, the
token itself being masked.  The network adds one vector for each neighbour's
token and place, and softmaxes twice: over classes of tokens, then over the
tokens of the class.  A document's score is the sum of its tokens' conditional
log-probabilities.

All words of all documents are counted.  The network predicts the most
frequent ones and buckets for all others; a word in a bucket has its share of
the bucket's count, joined from the table of all words, so every word of the
corpus has a probability of its own.  Every token of every document is a
target of training.  Each partition trains a copy from the same start,
beginning with the corpus' own word frequencies, and the copies are averaged
by number of targets, in groups of ``FAN_IN`` until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import map_batches
from .hashing import batches, word_hashes
from .staging import load, stage

WINDOW, WIDTH = 2, 24
#: Token numbers: known words by frequency, then buckets, in classes of CLASS.
KNOWN, BUCKETS, CLASS = 3072, 1024, 64
TOKENS = KNOWN + BUCKETS
CLASSES = TOKENS // CLASS
#: The token beyond either end of a document.
EDGE = TOKENS
#: Copies averaged in one task; tokens in one step of training, and of scoring.
FAN_IN, STEP, PART = 32, 8192, 32768
#: What a word without a count counts as within its bucket; added to every count.
UNSEEN = 0.5
SHAPES = {"near": (2 * WINDOW, TOKENS + 1, WIDTH), "bias": (WIDTH,), "class_out": (WIDTH, CLASSES), "class_bias": (CLASSES,), "out": (TOKENS, WIDTH), "out_bias": (TOKENS,)}


@dataclass
class Vocabulary:
    """Word hashes in the order of their token numbers, how often each token occurs, and how many words each bucket has."""

    words: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.words)
        self.sorted = self.words[self.order]

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        bucket = KNOWN + (hashes % np.uint64(BUCKETS)).astype(np.int64)
        if not len(self.sorted):
            return bucket
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], bucket)

    def log_bucket(self, tokens: np.ndarray) -> np.ndarray:
        """Logarithm of what a word's count is divided by within its bucket; one more word is allowed for, unseen."""
        bucket = tokens - KNOWN
        return np.log(self.counts[tokens] + UNSEEN * (self.kinds[bucket] + 1))


def vocabulary(docs: DataFrame, text_col: str) -> tuple[Vocabulary, DataFrame]:
    """Counts all words of all documents; KNOWN of them and the buckets' totals come to the driver.

    The table (word, n) of all words is the second result.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            parts = [np.unique(h, return_counts=True) for h in (np.concatenate(held),)] if held else []
            both = np.concatenate([words, *[p[0] for p in parts]])
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate([counts, *[p[1] for p in parts]])[order]
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
            held.clear()
            return both[first], np.add.reduceat(n, first) if len(first) else n

        for _, texts in batches(rows, lower=True):
            held.append(word_hashes(texts)[0])
            if sum(map(len, held)) > 2_000_000:
                words, counts = merge()
        words, counts = merge()
        for a in range(0, len(words), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 100_000].view(np.int64)), pa.array(counts[a : a + 100_000])], names=["word", "n"])

    counted = map_batches(docs.select(F.lit(0).alias("k"), text_col), run, "word long, n long")
    counts = stage(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN)
    known = top.collect()  # at most KNOWN rows
    bucket = F.pmod(F.col("word").bitwiseAND(BUCKETS - 1), F.lit(BUCKETS))
    others = counts.join(F.broadcast(stage(top.select("word"), "known_words")), "word", "left_anti").groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()  # at most BUCKETS rows
    totals, kinds = np.zeros(TOKENS), np.zeros(BUCKETS)
    totals[: len(known)] = [r.n for r in known]
    for r in others:
        totals[KNOWN + r.bucket], kinds[r.bucket] = r.n, r.kinds
    return Vocabulary(np.array([r.word for r in known], np.int64).view(np.uint64), totals, kinds), counts


def initial(counts: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Small random vectors; with biases that give every token its frequency."""
    rng = np.random.default_rng(seed)
    model = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    share = (counts + 0.1) / (counts + 0.1).sum()
    grouped = share.reshape(CLASSES, CLASS)
    model["bias"][:] = 0
    model["class_bias"] = np.log(grouped.sum(1)).astype(np.float32)
    model["out_bias"] = np.log(grouped / grouped.sum(1, keepdims=True)).astype(np.float32).ravel()
    return model


def neighbours(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(2 * WINDOW, tokens) the tokens around each token; ``first``: where documents begin (and the end)."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    padded = np.full(len(tokens) + WINDOW * len(first), EDGE, np.int16)
    at = np.arange(len(tokens)) + WINDOW * (text + 1)
    padded[at] = tokens
    return np.array([padded[at + d] for d in range(-WINDOW, WINDOW + 1) if d])


def forward(model: dict[str, np.ndarray], near: np.ndarray) -> np.ndarray:
    hidden = model["near"][0][near[0]]
    for k in range(1, 2 * WINDOW):
        hidden += model["near"][k][near[k]]
    return np.tanh(hidden + model["bias"])


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place."""
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def by_class(tokens: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of the tokens by class, and (class, stretch of that order) of each class."""
    groups = (tokens // CLASS).astype(np.int16)
    order = np.argsort(groups, kind="stable")
    bounds = np.searchsorted(groups[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, slice(a, b)) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]


def log_probabilities(model: dict[str, np.ndarray], tokens: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Of each token, given its neighbours."""
    out = np.empty(len(tokens))
    for start in range(0, len(tokens), PART):
        order, classes = by_class(tokens[start : start + PART])
        some = tokens[start : start + PART][order]
        hidden = forward(model, near[:, start : start + PART][:, order])
        logits = hidden @ model["class_out"] + model["class_bias"]
        own = logits[np.arange(len(some)), some // CLASS] - np.log(np.exp(logits).sum(1))
        for c, at in classes:
            inner = hidden[at] @ model["out"][c * CLASS : (c + 1) * CLASS].T + model["out_bias"][c * CLASS : (c + 1) * CLASS]
            own[at] += inner[np.arange(len(inner)), some[at] % CLASS] - np.log(np.exp(inner).sum(1))
        out[start + order] = own
    return out


def gradients(model: dict[str, np.ndarray], tokens: np.ndarray, near: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log-probability."""
    n = len(tokens)
    order, classes = by_class(tokens)
    tokens, near = tokens[order], near[:, order]
    hidden = forward(model, near)
    grad = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    d_class = -_softmax(hidden @ model["class_out"] + model["class_bias"])
    d_class[np.arange(n), tokens // CLASS] += 1
    grad["class_out"], grad["class_bias"] = hidden.T @ d_class, d_class.sum(0)
    d_hidden = d_class @ model["class_out"].T
    for c, at in classes:
        rows = slice(c * CLASS, (c + 1) * CLASS)
        d = -_softmax(hidden[at] @ model["out"][rows].T + model["out_bias"][rows])
        d[np.arange(len(d)), tokens[at] % CLASS] += 1
        grad["out"][rows], grad["out_bias"][rows] = d.T @ hidden[at], d.sum(0)
        d_hidden[at] += d @ model["out"][rows]
    d_hidden *= 1 - hidden**2
    grad["bias"] = d_hidden.sum(0)
    for k in range(2 * WINDOW):
        place = np.argsort(near[k], kind="stable")
        own = near[k][place]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        grad["near"][k][own[first]] = np.add.reduceat(d_hidden[place], first, axis=0)
    return {k: g / n for k, g in grad.items()}


class Trainer:
    """Gradient ascent with a rate for each weight (Adagrad)."""

    def __init__(self, model: dict[str, np.ndarray], rate: float):
        self.model = {k: v.copy() for k, v in model.items()}
        self.squares = {k: np.full(s, 1e-8, np.float32) for k, s in SHAPES.items()}
        self.rate, self.seen = rate, 0

    def step(self, tokens: np.ndarray, near: np.ndarray) -> None:
        for k, g in gradients(self.model, tokens, near).items():
            self.squares[k] += g * g
            self.model[k] += self.rate * g / np.sqrt(self.squares[k])
        self.seen += len(tokens)


def pack(model: dict[str, np.ndarray]) -> bytes:
    return b"".join(model[k].astype("<f4").tobytes() for k in SHAPES)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k, s in SHAPES.items():
        size = int(np.prod(s))
        out[k] = flat[at : at + size].reshape(s)
        at += size
    return out


def train(docs: DataFrame, text_col: str, words: Vocabulary, rate: float, seed: int) -> dict[str, np.ndarray]:
    """Trains a copy in each partition and averages them."""
    start = initial(words.counts, seed)
    shared = docs.sparkSession.sparkContext.broadcast((words, start))  # bounded by TOKENS

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, begin = shared.value
        trainer = Trainer(begin, rate)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, texts in batches(rows, lower=True):
            hashes, first = word_hashes(texts)
            tokens = known.tokens(hashes)
            held.append((tokens, neighbours(tokens, first)))
            while sum(len(h[0]) for h in held) >= STEP:
                t, near = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)
                trainer.step(t[:STEP], near[:, :STEP])
                held = [(t[STEP:], near[:, STEP:])]
        if held and len(held[0][0]) + sum(len(h[0]) for h in held[1:]):
            trainer.step(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1))
        if trainer.seen:
            yield pa.RecordBatch.from_arrays([pa.array([trainer.seen], pa.int64()), pa.array([pack(trainer.model)], pa.binary())], names=["n", "model"])

    copies = map_batches(docs.select(F.lit(0).alias("k"), text_col), run, "n long, model binary")
    copies = stage(copies.select(F.monotonically_increasing_id().alias("copy"), "n", "model"), "copies")

    def average(some: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(sum(int(np.prod(s)) for s in SHAPES.values()))
        for n, model in zip(some["n"], some["model"], strict=True):
            total += n * np.frombuffer(model, "<f4")
        n = int(some["n"].sum())
        return pd.DataFrame({"copy": [int(some["copy"].iloc[0])], "n": [n], "model": [(total / n).astype("<f4").tobytes()]})

    left = copies.count()
    while left > 1:
        left = -(-left // FAN_IN)
        group = F.pmod(F.xxhash64("copy"), F.lit(left))
        copies = stage(copies.groupBy(group.alias("group")).applyInPandas(average, "copy long, n long, model binary"), "copies")
        left = copies.count() if left > 1 else 1
    last = copies.select("model").first()
    return unpack(last.model) if last else start


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1, seed: int = 7) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood`` of every document.

    Words are runs of letters, digits, _ and non-ASCII characters in lower
    case.  A text without a word, empty and null ones included, has 0 tokens,
    the log-likelihood 0 and no mean (null).  Repeated rows count each; an
    empty table gives an empty result; other columns are ignored.
    """
    words, counts = vocabulary(docs, text_col)
    return _scores(docs, id_col, text_col, words, counts, train(docs, text_col, words, rate, seed))


def _scores(docs: DataFrame, id_col: str, text_col: str, words: Vocabulary, counts: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((words, model))  # bounded by TOKENS
    id_type = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = shared.value
        for keys, texts in batches(rows, lower=True):
            hashes, first = word_hashes(texts)
            tokens = known.tokens(hashes)
            log_p = log_probabilities(net, tokens, neighbours(tokens, first))
            n = np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            rare = np.flatnonzero(tokens >= KNOWN)
            log_p[rare] -= known.log_bucket(tokens[rare])
            total = np.bincount(owner, log_p, len(n))
            # The words of buckets, each with its number in the text.
            order = rare[np.lexsort((hashes[rare], owner[rare]))]
            fresh = np.flatnonzero(np.concatenate(([True], (owner[order][1:] != owner[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])))) if len(order) else order
            times = np.diff(np.concatenate((fresh, [len(order)])))
            bounds = pa.array(np.searchsorted(owner[order[fresh]], np.arange(len(n) + 1)), pa.int32())
            lists = pa.ListArray.from_arrays(bounds, pa.array(hashes[order[fresh]].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], arrow_id), pa.array(n, pa.int64()), pa.array(total), *lists], names=["doc_id", "n_tokens", "total", "words", "times"])

    scored = map_batches(docs.select(id_col, text_col), run, f"doc_id {id_type.simpleString()}, n_tokens long, total double, words array<long>, times array<int>")
    scored = stage(scored.select(F.monotonically_increasing_id().alias("row"), "*"), "scored")
    # A word outside the KNOWN most frequent ones is no hot key.
    each = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    own = each.join(counts.hint("merge"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log(F.col("n") + UNSEEN)).alias("own"))
    total = F.col("total") + F.coalesce("own", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return scored.join(own.hint("merge"), "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_likelihood"))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(load(spark, sf_dir, "documents"))


QUERIES = {"op4_pseudo_likelihood": op4_pseudo_likelihood}
ORACLE: dict[str, str] = {}
