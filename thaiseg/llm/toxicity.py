"""Toxicity: a convolutional text classifier, trained in numpy.

A word (a run of letters and digits, A-Z folded) and its first 4, 5, 6 and 7
bytes hash into an embedding table, whose rows add up to the word's vector, so
that inflected forms share what their stem has learned.  Filters of widths 1, 2
and 3 run over the whole text, their maxima over it pass a rectifier, and a
logistic layer scores them.

Only rows of maximum response get gradients, so a training step costs little
more than its forward pass.  A quarter of the training rows is held back to
calibrate: for each language (guessed from the text's function words, never
read from a column) the threshold of best accuracy becomes score 0.5, by a
shift of the logit that is shrunk towards the common one if the language has
few rows.

The classifier is fitted on at most ``train_rows`` labelled rows of at most
``train_chars`` characters; scoring reads every text whole, and any text has a
score: null and empty ones that of an empty text.  A label that is null teaches
nothing; with labels of one kind alone every score is that label, without any 0.  Repeated rows are each
scored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytekernel import Words, alphanumeric, folded, slices, trim, utf8
from .storage import only

WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
#: Function words that tell the languages apart; anything else is language 0.
FUNCTION_WORDS = {
    1: "the of and to in is that for with are was this from",
    2: "der die das und von ist nicht ein mit für auf auch sich dem",
    3: "le les des et une est qui dans pour par sur elle au",
    4: "el los y del las con para por su como está al una",
}


@dataclass(frozen=True)
class Training:
    train_rows: int = 6000
    train_chars: int = 24_000_000
    buckets: int = 1 << 15
    size: int = 16
    filters: int = 16
    epochs: int = 6
    steps: int = 600  # at least: small samples are read more often
    batch: int = 64
    rate: float = 0.02
    decay: float = 1e-5
    seed: int = 5


@dataclass
class Model:
    embedding: np.ndarray  # (buckets + 1, size); the last row is padding
    filters: list[np.ndarray]  # by width: (width, size, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(5))


def word_rows(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows (word and prefixes) of all words, and words by text."""
    w = Words(*utf8(column), folded, alphanumeric)
    rows = np.full((len(w.hashes), 1 + len(PREFIXES)), buckets, np.int32)
    rows[:, 0] = w.hashes % np.uint64(buckets)
    for j, size in enumerate(PREFIXES, 1):
        h, long_enough = w.prefixes(size)
        rows[long_enough, j] = h[long_enough] % np.uint64(buckets)
    return rows, w.counts


def _word_ids(texts: list[str], buckets: int) -> Iterator[np.ndarray]:
    for k in range(0, len(texts), 64):
        rows, counts = word_rows(pa.array(texts[k : k + 64], pa.string()), buckets)
        yield from np.split(rows, np.cumsum(counts)[:-1])


def language_table(buckets: int) -> np.ndarray:
    table = np.zeros(buckets + 1, np.int64)
    for language, words in FUNCTION_WORDS.items():
        for ids in _word_ids([words], buckets):
            table[ids[:, 0]] = language
    return table


def _layout(rows: np.ndarray, counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with two paddings after each text (three if it is empty, and one more
    at the end); each text's first place and number of places (1 at least)."""
    starts = np.concatenate([[0], np.cumsum(counts + 2 + (counts == 0))])
    flat = np.full((starts[-1] + 1, rows.shape[1]), pad, np.int32)
    flat[np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(rows))] = rows
    return flat, starts[:-1], np.maximum(counts, 1)


def _vectors(embedding: np.ndarray, flat: np.ndarray) -> np.ndarray:
    x = embedding[flat[:, 0]]
    for j in range(1, flat.shape[1]):
        x += embedding[flat[:, j]]
    return x


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pad = len(model.embedding) - 1
        self.slices = [[np.ascontiguousarray(w[j]) for j in range(len(w))] for w in model.filters]
        self.languages = language_table(self.pad)

    def logits(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated logits, and guessed languages."""
        flat, starts, sizes = _layout(rows, counts, self.pad)
        edges = np.stack([starts, starts + sizes], 1).ravel()
        x = _vectors(self.model.embedding, flat)
        z = np.full(len(counts), self.model.out_bias)
        at = 0
        for parts, bias in zip(self.slices, self.model.bias):
            n = len(x) - len(parts) + 1
            r = x[:n] @ parts[0]
            for j in range(1, len(parts)):
                r += x[j : j + n] @ parts[j]
            pooled = np.maximum.reduceat(r, edges, axis=0)[::2]
            z += np.maximum(pooled + bias, 0) @ self.model.out[at : at + len(bias)]
            at += len(bias)
        owner = np.repeat(np.arange(len(counts)), counts)
        votes = np.bincount(owner * 5 + self.languages[rows[:, 0]], minlength=5 * len(counts)).reshape(-1, 5)
        votes[:, 0] = 0
        return z, np.where(votes.max(1) > 0, votes.argmax(1), 0)

    def scores(self, column: pa.Array) -> np.ndarray:
        rows, counts = word_rows(column, self.pad)
        if not len(counts):
            return np.zeros(0)
        z, language = self.logits(rows, counts)
        return 1 / (1 + np.exp(-np.clip(z + self.model.shift[language], -30, 30)))


def train(texts: list[str], labels: np.ndarray, how: Training) -> Model | float:
    """The model, or the one label that there is (0 for none)."""
    if len(np.unique(labels)) < 2:
        return float(labels[0]) if len(labels) else 0.0
    rng = np.random.default_rng(how.seed)
    pad = np.full((2, 1 + len(PREFIXES)), how.buckets, np.int32)
    docs = [np.concatenate([d if len(d) else pad[:1], pad]) for d in _word_ids(texts, how.buckets)]
    d, f = how.size, how.filters
    E = rng.normal(0, 0.3, (how.buckets + 1, d)).astype(np.float32)
    E[-1] = 0
    W = [rng.normal(0, 1 / np.sqrt(d * k), (k, d, f)).astype(np.float32) for k in WIDTHS]
    B = [np.zeros(f, np.float32) for _ in WIDTHS]
    out, out_bias = rng.normal(0, 0.1, f * len(WIDTHS)).astype(np.float32), float(np.log(labels.mean() / (1 - labels.mean())))
    state = {}

    def step(name, value, grad):
        m = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
        m[2] += 1
        m[0] += 0.1 * (grad - m[0])
        m[1] += 0.01 * (grad * grad - m[1])
        value -= how.rate * 0.3 * (m[0] / (1 - 0.9 ** m[2])) / (np.sqrt(m[1] / (1 - 0.99 ** m[2])) + 1e-8)

    seen = np.zeros(how.buckets + 1, np.float32)
    held = rng.random(len(docs)) < 0.25
    if min(labels[held].sum(), (~labels[held].astype(bool)).sum()) < 5 or len(np.unique(labels[~held])) < 2:
        held[:] = False
    mine = np.flatnonzero(~held)
    weight = np.where(labels == 1, 0.5 / labels[mine].mean(), 0.5 / (1 - labels[mine].mean())) ** 0.5
    for _ in range(max(how.epochs, -(-how.steps * how.batch // max(1, len(mine))))):
        for k in range(0, len(mine), how.batch):
            if k == 0:
                rng.shuffle(mine)
            own = mine[k : k + how.batch]
            flat = np.concatenate([docs[i] for i in own])
            sizes = np.array([len(docs[i]) - 2 for i in own])
            starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
            x = _vectors(E, flat)
            places, pooled = [], []
            for w, b in zip(W, B):
                n = len(flat) - len(w) + 1
                r = sum(x[j : j + n] @ w[j] for j in range(len(w)))
                p = np.stack([s + r[s : s + m].argmax(0) for s, m in zip(starts, sizes)])
                places.append(p)
                pooled.append(r[p, np.arange(f)] + b)
            h = np.concatenate(pooled, 1)
            a = np.maximum(h, 0)
            z = a @ out + out_bias
            g = (weight[own] * (1 / (1 + np.exp(-z)) - labels[own]) / len(own)).astype(np.float32)
            g_h = g[:, None] * out[None, :] * (h > 0)
            step("out", out, a.T @ g + how.decay * out)
            out_bias -= how.rate * float(g.sum())
            rows, grads = [], []
            for i, (w, b) in enumerate(zip(W, B)):
                gi = g_h[:, i * f : (i + 1) * f]
                gw = np.stack([np.einsum("bf,bfd->df", gi, x[places[i] + j]) for j in range(len(w))])
                for j in range(len(w)):
                    grad = (gi[:, :, None] * w[j].T[None]).reshape(-1, d)
                    for part in range(flat.shape[1]):
                        rows.append(flat[places[i] + j, part].ravel())
                        grads.append(grad)
                step(("w", i), w, gw + how.decay * w)
                step(("b", i), b, gi.sum(0))
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            live = np.abs(grads).sum(1) > 0
            rows, back = np.unique(rows[live], return_inverse=True)
            total = np.zeros((len(rows), d), np.float32)
            np.add.at(total, back, grads[live])
            seen[rows] += (total**2).mean(1)
            E[rows] -= how.rate * 2 * total / (np.sqrt(seen[rows])[:, None] + 1e-6)
            E[-1] = 0
    model = Model(E, W, B, out, out_bias)
    test = held if held.any() else ~held
    own = np.flatnonzero(test)
    scorer, parts = Scorer(model), []
    for k in range(0, len(own), how.batch):
        ids = [docs[i][:-2] for i in own[k : k + how.batch]]
        parts.append(scorer.logits(np.concatenate(ids), np.array([len(i) for i in ids])))
    z, language = (np.concatenate(x) for x in zip(*parts))
    common = _threshold(z, labels[own])
    for k in range(5):
        mine_k = language == k
        n = int(min(labels[own][mine_k].sum(), (1 - labels[own][mine_k]).sum()))
        local = _threshold(z[mine_k], labels[own][mine_k]) if n else common
        model.shift[k] = -(local * n + common * 20) / (n + 20)
    return model


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between logits that makes fewest errors."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    best = np.flatnonzero(errors == errors.min())
    return float(edges[best[len(best) // 2]])


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(folds))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, rows: int) -> DataFrame:
    """doc_id, text and y of at most ``rows`` labelled texts outside fold ``out``, in hash order."""
    known = only(labels, "doc_id", label).where(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != out))
    chosen = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return only(docs, "doc_id", "text").join(chosen, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(label).cast("long").alias("y"))


def train_task(how: Training):
    """One task fits on the bounded sample and returns the pickled model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, used = [], [], 0
        for batch in batches:  # shortest first: the bound leaves out as few rows as it can
            for text, label in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                used += len(text)
                if used <= how.train_chars:
                    texts.append(text)
                    y.append(label)
        made = pickle.dumps(train(texts, np.array(y, np.int64), how))
        texts.clear()
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])

    return run


def score_task(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        scorer = Scorer(model) if isinstance(model, Model) else None
        for batch in slices(batches):
            scores = scorer.scores(batch.column("text")) if scorer else np.full(len(batch), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(scores, pa.float64())], names=[*batch.schema.names, "toxicity_score"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, how: Training = Training(), folds: int = 5, out: int = 0) -> Model | float:
    sample = labelled(docs, labels, "toxic", folds, out, how.train_rows).repartition(1).sortWithinPartitions(F.length("text"), "doc_id")
    made = sample.mapInArrow(train_task(how), "model binary").first()  # no row if there is no text
    return pickle.loads(made.model) if made else 0.0


def toxicity_scores(spark: SparkSession, docs: DataFrame, model: Model | float) -> DataFrame:
    """``docs`` with toxicity_score; needs a column text and none of that name."""
    handle = spark.sparkContext.broadcast(model)  # its size is set by Training
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score_task(handle), f"{schema}, toxicity_score double")


def toxic_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = toxicity_scores(spark, only(docs, "doc_id", "text"), fitted(docs, labels, how))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
