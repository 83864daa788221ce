"""Severity of toxic language by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm.arrays import arrow_schema, bounded_batches, remainder_of_id
from siftrank.llm.sampling import bounded_sample

#: The most records of each mark that are learned from, and the least number of them that hold a word used as a feature.
SAMPLE_RECORDS = 3_000
LEAST_RECORDS = 5
#: A word is a marker of severity if it is so many times as frequent among marked records as among others.
MARKER_LIFT = 8.0
#: Lengths in bytes of the word beginnings that are features too.
PREFIXES = (4, 5, 6, 7, 8)
#: Features less tied to a grade above 0 than this (chi-squared) are left out.
LEAST_ASSOCIATION = 25.0
ROUNDS, RATE, SPARSITY = 600, 0.05, 2e-2
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z); ASCII marks separate words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def features_of(word: bytes) -> list[bytes]:
    """The word and its beginnings of a few lengths, which inflected forms share."""
    return [word] + [word[:n] + b"*" for n in PREFIXES if len(word) > n]


def feature_counts(words: list[bytes]) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(words).items():
        for f in features_of(word):
            out[f] += n
    return out


def _association(both: int, held: int, marked: int, total: int) -> float:
    """Chi-squared value of a feature's presence against a grade above 0."""
    rest = held * (total - held) * marked * (total - marked)
    return total * (both * total - held * marked) ** 2 / rest if rest else 0.0


class OrdinalModel:
    """P(grade <= k) = logistic(threshold k - weights . features): one weight vector, ordered thresholds."""

    def __init__(self, vocabulary: dict[bytes, int], weights: np.ndarray, thresholds: np.ndarray):
        # Features of weight zero are dropped: they never change a result.
        self.weights = {f: float(weights[i]) for f, i in vocabulary.items() if weights[i]}
        self.thresholds = thresholds
        self.known: dict[bytes, tuple] = {}  # features of words met so far that have any

    @staticmethod
    def value(count: np.ndarray) -> np.ndarray:
        """Feature value of a word: that it occurs, and slowly more for each time."""
        return 1.0 + 0.5 * np.log(count)

    def chances(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each grade for each text."""
        known, weights = self.known, self.weights
        if len(known) > 300_000:
            known.clear()
        eta = np.zeros(len(texts))
        for i, text in enumerate(texts):
            words = words_of(text)
            for w in set(words):
                if w not in known:
                    known[w] = tuple(f for f in features_of(w) if f in weights)
            found = Counter(f for w in words if known[w] for f in known[w])
            if found:
                names = sorted(found)
                values = self.value(np.array([found[f] for f in names], float))
                eta[i] = float(np.dot([weights[f] for f in names], values))
        below = 1 / (1 + np.exp(-(self.thresholds - eta[:, None])))
        edges = np.concatenate([np.zeros((len(texts), 1)), below, np.ones((len(texts), 1))], axis=1)
        return np.diff(edges, axis=1)


def fit_ordinal(texts: list[str | None], grades: list[int], importance: list[float], n_grades: int) -> OrdinalModel:
    """Adam with shrinkage on the ordinal likelihood; thresholds are a first one plus positive steps."""
    # Two passes, so that only counts of features and then the chosen ones are held.
    held, inside = Counter(), Counter()
    for text, grade in zip(texts, grades, strict=True):
        found = feature_counts(words_of(text)).keys()
        held.update(found)
        if grade > 0:
            inside.update(found)
    n_in, n_all = sum(g > 0 for g in grades), len(grades)
    telling = sorted(w for w, n in held.items() if n >= LEAST_RECORDS and _association(inside[w], n, n_in, n_all) >= LEAST_ASSOCIATION)
    vocabulary = {w: i for i, w in enumerate(telling)}
    entries = [(i, vocabulary[w], c) for i, t in enumerate(texts) for w, c in feature_counts(words_of(t)).items() if w in vocabulary]
    row, col, count = np.array(entries, np.int64).reshape(-1, 3).T
    value = OrdinalModel.value(count)
    y, weight = np.array(grades, np.int64), np.array(importance, float)
    weight = weight / weight.sum() if len(weight) else weight
    n, k = len(y), max(n_grades, 2)
    upto = np.array([float(weight[y <= g].sum()) if n else (g + 1) / k for g in range(k - 1)])
    start = np.log(np.clip(upto, 1e-3, 1 - 1e-3) / np.clip(1 - upto, 1e-3, 1))
    first, steps = start[0], np.log(np.maximum(np.diff(start), 0.05))
    w = np.zeros(len(vocabulary))
    if n and len(set(grades)) > 1:
        params = np.concatenate([w, [first], steps])
        mean, square = np.zeros_like(params), np.zeros_like(params)
        for round_ in range(1, ROUNDS + 1):
            w, first, steps = params[:len(w)], params[len(w)], params[len(w) + 1:]
            thresholds = first + np.concatenate([[0], np.cumsum(np.exp(steps))])
            eta = np.bincount(row, value * w[col], n)
            upper = np.where(y < k - 1, 1 / (1 + np.exp(-(thresholds[np.minimum(y, k - 2)] - eta))), 1.0)
            lower = np.where(y > 0, 1 / (1 + np.exp(-(thresholds[np.maximum(y - 1, 0)] - eta))), 0.0)
            chance = np.maximum(upper - lower, 1e-9)
            d_upper, d_lower = upper * (1 - upper) / chance * weight, lower * (1 - lower) / chance * weight
            to_eta = d_upper - d_lower  # of the negative log likelihood
            to_t = np.bincount(np.minimum(y, k - 2), np.where(y < k - 1, -d_upper, 0), k - 1) + np.bincount(
                np.maximum(y - 1, 0), np.where(y > 0, d_lower, 0), k - 1)
            grad_w = np.bincount(col, value * to_eta[row], len(w))
            grad_first, tail = to_t.sum(), np.cumsum(to_t[::-1])[::-1][1:]
            grad_t = np.concatenate([[grad_first], tail * np.exp(steps)])
            grad = np.concatenate([grad_w, grad_t])
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            rate = RATE * (1 - 0.95 * round_ / ROUNDS)
            params = params - rate * mean / (1 - 0.9**round_) / (np.sqrt(square / (1 - 0.99**round_)) + 1e-6)
            # Weights only add severity: a word cannot excuse another.
            params[:len(w)] = np.maximum(params[:len(w)] - rate * SPARSITY, 0)
        w, first, steps = params[:len(w)], params[len(w)], params[len(w) + 1:]
    return OrdinalModel(vocabulary, w, first + np.concatenate([[0], np.cumsum(np.exp(steps))]))


def marker_grades(texts: list[str | None], marks: list[int]) -> list[int]:
    """Grades 0, 1, 2 from marks 0 and 1: a marked text is graded 2 if it has more marker words than half of them."""
    inside, outside = Counter(), Counter()
    for t, m in zip(texts, marks, strict=True):
        (inside if m else outside).update({f for w in set(words_of(t)) for f in features_of(w)})
    n_in, n_out = max(sum(marks), 1), max(len(marks) - sum(marks), 1)
    markers = {w for w, n in inside.items() if n >= LEAST_RECORDS and n / n_in >= MARKER_LIFT * (outside[w] + 1) / (n_out + 1)}
    found = [sum(1 for w in set(words_of(t)) if not markers.isdisjoint(features_of(w))) for t in texts]
    middle = float(np.median([x for x, m in zip(found, marks, strict=True) if m])) if any(marks) else 0.0
    return [0 if not m else 2 if x > middle else 1 for x, m in zip(found, marks, strict=True)]


def learn_severity(records: DataFrame, labels: DataFrame, id_col: str = "molecule_id", text_col: str = "review_note",
                   label_col: str = "severity", graded: bool = True, learn_from: Column | None = None) -> OrdinalModel:
    """Fit the ordinal model on at most ``SAMPLE_RECORDS`` labelled records of each label value.

    ``labels`` holds ordered grades 0, 1, 2, ... in ``label_col``. Where only a mark 0 or 1 is known
    (``graded`` false), marked notes are graded 1 or 2 by their number of marker words, see
    :func:`marker_grades`. ``learn_from`` is a condition on ``id_col`` (default: crc32 of the id modulo
    5 is not 0). Sampled records weigh by their label's true share. Rows without id or label and
    negative labels teach nothing.
    """
    allowed = (remainder_of_id(id_col, 5) != 0) if learn_from is None else learn_from
    marked = labels.where(F.coalesce(allowed, F.lit(False)) & (F.col(label_col) >= 0)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    sizes = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = bounded_sample(marked, "label", SAMPLE_RECORDS)
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = sorted(((r.label, str(r.id), r.text or "") for r in rows.limit(2 * SAMPLE_RECORDS * max(len(sizes), 1)).toLocalIterator()),
                    key=lambda r: (zlib.crc32(r[1].encode()), r))
    taken = Counter(r[0] for r in sample)
    texts, found = [r[2] for r in sample], [r[0] for r in sample]
    grades = found if graded else marker_grades(texts, [int(x > 0) for x in found])
    return fit_ordinal(texts, grades, [sizes[x] / taken[x] for x in found], max([*grades, 1]) + 1)


def score_severity(records: DataFrame, model: OrdinalModel, id_col: str = "molecule_id", text_col: str = "review_note",
                   held_out: Column | None = None) -> DataFrame:
    """Expected severity of toxic language in every record's review note, from its whole text.

    Returns one row for each record: ``id_col``, ``held_out`` (default: crc32 of the id modulo 5 is 0),
    ``expected_severity`` (the mean grade under the model), ``severity`` (the likeliest grade, the lowest of
    equals), ``toxic_score`` (probability of a grade above 0) and ``toxic`` (1 if that is at least 0.5).

    Null and empty texts have no features and get the thresholds' base chances. Repeated rows and rows
    without id are scored like others. The model is as large as the words of its sample.
    """
    held = F.coalesce(remainder_of_id(id_col, 5) == 0, F.lit(False)) if held_out is None else held_out
    rows = records.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    out = T.StructType([
        T.StructField(id_col, rows.schema["id"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("expected_severity", T.DoubleType()), T.StructField("severity", T.IntegerType()),
        T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic", T.IntegerType()),
    ])
    bounded_batches(records.sparkSession)
    schema, shared = arrow_schema(out), records.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            chances = shared.value.chances(frame.column(2).to_pylist())
            toxic = 1 - chances[:, 0]
            yield pa.RecordBatch.from_arrays([
                frame.column(0), frame.column(1), pa.array(chances @ np.arange(chances.shape[1], dtype=float)),
                pa.array(chances.argmax(axis=1).astype(np.int32)), pa.array(toxic), pa.array((toxic >= 0.5).astype(np.int32))],
                schema=schema)

    return rows.mapInArrow(score, out)
