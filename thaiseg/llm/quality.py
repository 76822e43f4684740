"""Quality classifier: a sparse rule ensemble.

1. Statistics of each text (STATISTICS), from its bytes and words, in numpy.
2. Shallow trees on random parts of the training rows and statistics; every
   path from a root to an inner node or leaf is one conjunctive rule.
3. Logistic regression with a lasso penalty over the rules (FISTA); most rules
   get weight zero and go.
4. The rest are compiled into one Spark column expression over the statistics.

Trees and weights are fitted on at most ``train_rows`` labelled rows; all texts
are scored whole.  Null and empty texts have the statistics of an empty text.
Without labels of both kinds every score is the share of label 1 (0.5 without
any).  Repeated rows are each scored; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytekernel import Words, finalise, slices, utf8
from .storage import Tables, only
from .toxicity import fold, language_table, word_rows

#: Each text's statistics, in this order.
STATISTICS = (
    "bytes", "words", "word_bytes", "letters", "upper", "digits", "stops", "symbols", "pipes", "shouts", "non_ascii",
    "lines", "short_lines", "repeated_lines", "distinct_words", "repeated_pairs", "same_next", "marked_words", "function_words", "upper_words", "top_word",
)
_CLASSES = {
    "letters": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "upper": [*range(65, 91)],
    "digits": [*range(48, 58)],
    "stops": [*map(ord, ".,;:?")],
    "symbols": [*map(ord, "#$%&*+/<=>@\\^_`~{}[]")],
    "pipes": [ord("|")],
    "shouts": [ord("!")],
    "non_ascii": [*range(0xC0, 256)],
}
_BUCKETS = 1 << 15


@dataclass(frozen=True)
class Fit:
    train_rows: int = 20_000
    trees: int = 60
    depth: int = 3
    rows_of_tree: int = 4000
    penalty: float = 0.0015
    steps: int = 300
    seed: int = 3


@dataclass
class Rules:
    """Conjunctions of (statistic, at most, threshold), weights, intercept."""

    rules: list[tuple[tuple[int, bool, float], ...]]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            test = None
            for feature, at_most, limit in rule:
                one = F.col(STATISTICS[feature]) <= limit if at_most else F.col(STATISTICS[feature]) > limit
                test = one if test is None else test & one
            z = z + F.when(test, w).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner: keys that came before, and the count of the commonest."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(k)]]))
    top = np.zeros(n)
    np.maximum.at(top, o[first], size)
    return np.bincount(owner, minlength=n) - np.bincount(o[first], minlength=n), top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; shares are of bytes, words or lines."""
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    w = Words(raw, offsets)
    size, words = np.diff(offsets), w.counts
    counted = np.zeros((256, len(_CLASSES)), bool)
    for j, own in enumerate(_CLASSES.values()):
        counted[own, j] = True
    per_class = {name: _sums(counted[raw, j], offsets) for j, name in enumerate(_CLASSES)}
    owner = np.repeat(np.arange(n), words)
    breaks = np.flatnonzero(raw == 10)
    cuts = np.unique(np.concatenate([offsets, breaks + 1]))
    # the lines of all texts: where they start, and the words they hold
    line_first = np.searchsorted(w.starts, cuts)
    place = np.arange(len(w.hashes)) - np.repeat(line_first[:-1], np.diff(line_first))
    line_sums = np.zeros(len(w.hashes) + 1, np.uint64)
    np.cumsum(w.hashes * (place + 1).astype(np.uint64), out=line_sums[1:])
    line_keys = finalise(line_sums[line_first[1:]] - line_sums[line_first[:-1]])
    line_words = np.diff(line_first)
    line_owner = np.searchsorted(offsets, cuts[:-1], "right") - 1
    full = line_words > 0
    lines = np.bincount(line_owner[full], minlength=n)
    short = np.bincount(line_owner[full & (line_words <= 2)], minlength=n)
    repeated_lines, _ = _repeats(line_keys[full], line_owner[full], n)
    repeated, top = _repeats(w.hashes, owner, n)
    pair_in = owner[1:] == owner[:-1]
    repeated_pairs, _ = _repeats(finalise(w.hashes[:-1] * np.uint64(3) + w.hashes[1:])[pair_in], owner[:-1][pair_in], n)
    same = np.bincount(owner[:-1][pair_in & (w.hashes[1:] == w.hashes[:-1])], minlength=n)
    last = raw[w.ends - 1] if len(w.ends) else raw[:0]
    marks = np.zeros(256, bool)
    marks[[*map(ord, "#$%&*!")]] = True
    marked = np.bincount(owner[marks[last]], minlength=n)
    first_byte = raw[w.starts] if len(w.starts) else raw[:0]
    second = raw[np.minimum(w.starts + 1, len(raw) - 1)] if len(raw) else raw
    shouted = np.bincount(owner[(first_byte >= 65) & (first_byte <= 90) & (second >= 65) & (second <= 90) & (w.ends - w.starts > 1)], minlength=n)
    rows, counts = word_rows(column, _BUCKETS)
    plain = np.bincount(np.repeat(np.arange(n), counts)[_language[rows[:, 0]] > 0], minlength=n)
    per = lambda x, y: x / np.maximum(y, 1)
    found = {
        "bytes": size, "words": words, "word_bytes": per(_sums(w.ends - w.starts, w.first), words),
        **{k: per(v, size) for k, v in per_class.items()},
        "lines": lines, "short_lines": per(short, lines), "repeated_lines": per(repeated_lines, lines), "distinct_words": per(words - repeated, words),
        "repeated_pairs": per(repeated_pairs, words), "same_next": per(same, words), "marked_words": per(marked, words), "function_words": per(plain, counts),
        "upper_words": per(shouted, words), "top_word": per(top, words),
    }
    return np.stack([np.asarray(found[k], np.float64) for k in STATISTICS], 1)


_language = language_table(_BUCKETS)


def statistics_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c) for c in rows.T)], names=["doc_id", *STATISTICS])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""
    return only(docs, "doc_id", "text").mapInArrow(statistics_task, "doc_id long, " + ", ".join(f"{k} double" for k in STATISTICS))


def grow(x: np.ndarray, y: np.ndarray, how: Fit) -> list[tuple]:
    """The paths of all trees as rules, each once."""
    rng = np.random.default_rng(how.seed)
    rules: dict[tuple, None] = {}
    for _ in range(how.trees):
        rows = rng.choice(len(x), min(how.rows_of_tree, len(x)), replace=False)
        features = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        stack = [(rows, ())]
        while stack:
            own, path = stack.pop()
            if path:
                rules[path] = None
            if len(path) >= how.depth or len(own) < 20 or y[own].min() == y[own].max():
                continue
            best = None
            for f in features:
                values = x[own, f]
                cuts = np.unique(np.quantile(values, np.linspace(0.03, 0.97, 24)))
                for c in cuts:
                    left = values <= c
                    n = left.sum()
                    if n < 5 or n > len(own) - 5:
                        continue
                    p, q = y[own][left].mean(), y[own][~left].mean()
                    impurity = n * p * (1 - p) + (len(own) - n) * q * (1 - q)
                    if best is None or impurity < best[0]:
                        best = (impurity, int(f), float(c), left)
            if best is None:
                continue
            _, f, c, left = best
            stack += [(own[left], (*path, (f, True, c))), (own[~left], (*path, (f, False, c)))]
    return list(rules)


def met(rules: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for f, at_most, c in rule:
            out[:, j] *= (x[:, f] <= c) if at_most else (x[:, f] > c)
    return out


def lasso(a: np.ndarray, y: np.ndarray, how: Fit) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on all weights but the intercept."""
    n, p = a.shape
    mean, scale = a.mean(0), a.std(0) + 0.05
    s = (a - mean) / scale
    w, b = np.zeros(p), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w.copy(), b, 1.0
    top = 0.25 * (np.linalg.eigvalsh((s.T @ s) / n)[-1] + 1)
    for _ in range(how.steps):
        g = 1 / (1 + np.exp(-(s @ v.astype(np.float32) + vb))) - y
        new = v - (s.T @ g.astype(np.float32)) / n / top
        new = np.sign(new) * np.maximum(np.abs(new) - how.penalty / top, 0)
        new_b = vb - g.mean() / top
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w / scale, b - float((w / scale) @ mean)


def fit(x: np.ndarray, y: np.ndarray, how: Fit = Fit()) -> Rules:
    rules = grow(x, y, how) if len(np.unique(y)) == 2 else []
    if not rules:  # one kind of label, or too few rows to split
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Rules([], [], float(np.log(share / (1 - share))))
    w, b = lasso(met(rules, x), y, how)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules([rules[j] for j in kept], [float(w[j]) for j in kept], b)


def fit_task(how: Fit):
    """One task fits on the bounded sample and returns the pickled rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [np.zeros((0, len(STATISTICS)))], [np.zeros(0)]
        for batch in batches:
            x.append(np.stack([batch.column(k).to_numpy() for k in STATISTICS], 1))
            y.append(batch.column("quality").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(np.concatenate(x), np.concatenate(y), how))], pa.binary())], names=["rules"])

    return run


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 4, out: int = 2, how: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    stats = Tables(spark, "quality").write(with_statistics(docs), "statistics")
    known = only(labels, "doc_id", "quality").where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), folds) != out)).dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.train_rows)
    sample = stats.join(chosen, "doc_id").repartition(1).sortWithinPartitions("doc_id")
    made = sample.mapInArrow(fit_task(how), "rules binary").first()  # no row if there is no text
    rules = pickle.loads(made.rules) if made else fit(np.zeros((0, len(STATISTICS))), np.zeros(0), how)
    return stats.select("doc_id", (fold(F.col("doc_id"), folds) == out).alias("held_out"), rules.column().alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
