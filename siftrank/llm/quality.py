"""Quality of record texts by attention-based multiple-instance learning over their passages."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm.arrays import arrow_schema, bounded_batches, remainder_of_id
from siftrank.llm.chunks import text_batches
from siftrank.llm.sampling import bounded_sample

PASSAGE_WORDS = 48
SHAPES = 448
WORDS = 1024
STATS = 64
FEATURES = SHAPES + WORDS + STATS
#: The most records of each label that are learned from.
SAMPLE_RECORDS = 3_000
WIDTH, ATTENTION, EPOCHS, BATCH, RATE = 24, 12, 14, 64, 0.01
_RUN = re.compile(rb"(.)\1+")
_FOLD = bytes(
    ord("a") if chr(b).islower() and b < 128 or b > 127 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b
    for b in range(256))


def token_features(token: bytes) -> int:
    """Two buckets in one number: the token's shape (letters, digits and marks with runs joined) and its bytes."""
    shape = _RUN.sub(rb"\1", token.translate(_FOLD))
    return zlib.crc32(shape) % SHAPES << 16 | zlib.crc32(token) % WORDS


class PassageEncoder:
    """Passages of texts as sparse counts; features of a token are computed once for each worker."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def passages(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of all passages, and the number of passages of each text (at least one)."""
        if len(self.known) > 300_000:
            self.known.clear()
        known, values, numbers, counts = self.known, [], [], []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").split()
            for w in set(words):
                if w not in known:
                    known[w] = token_features(w)
            values.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            numbers.append(len(words))
            counts.append(max(1, -(-len(words) // PASSAGE_WORDS)))
        n_words, counts = np.array(numbers, np.int64), np.array(counts, np.int64)
        first = np.cumsum(counts) - counts
        within = np.arange(int(n_words.sum())) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        passage = np.repeat(first, n_words) + within // PASSAGE_WORDS
        value = np.concatenate(values) if values else np.zeros(0, np.int64)
        total = int(counts.sum())
        shapes = np.bincount(passage * SHAPES + (value >> 16), minlength=total * SHAPES).reshape(total, SHAPES)
        words = np.bincount(passage * WORDS + (value & 0xFFFF), minlength=total * WORDS).reshape(total, WORDS)
        size = shapes.sum(axis=1)
        different = (words > 0).sum(axis=1)
        stats = np.zeros((total, STATS), np.float32)
        at = np.arange(total)
        stats[at, np.minimum(size // 4, 15)] = 1
        stats[at, 16 + np.minimum(different * 16 // np.maximum(size, 1), 16)] = 1
        stats[at, 33 + np.minimum((words.max(axis=1) if total else size) * 16 // np.maximum(size, 1), 16)] = 1
        scale = np.maximum(size, 1)[:, None]
        return np.concatenate([np.sqrt(shapes / scale), np.sqrt(words / scale) * 0.5, stats], axis=1).astype(np.float32), counts


class AttentionModel:
    """Passage encoder, gated attention over a text's passages, and a logistic score of their mean."""

    def __init__(self, prior: float = 0.5, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "E": rng.normal(0, 0.1, (FEATURES, WIDTH)), "b": np.zeros(WIDTH), "V": rng.normal(0, 0.3, (WIDTH, ATTENTION)),
            "U": rng.normal(0, 0.3, (WIDTH, ATTENTION)), "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, WIDTH),
            "c0": np.array([np.log(prior / (1 - prior))]),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(counts) - counts
        h = np.tanh(x @ p["E"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        gate = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(counts)), counts)
        weight = np.exp(gate - np.maximum.reduceat(gate, first)[bag])
        weight /= np.add.reduceat(weight, first)[bag]
        z = np.add.reduceat(weight[:, None] * h, first)
        return {"h": h, "t": t, "s": s, "a": weight, "bag": bag, "first": first, "z": z, "logit": z @ p["c"] + p["c0"][0]}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, counts)
        h, t, s, a, bag = f["h"], f["t"], f["s"], f["a"], f["bag"]
        error = (1 / (1 + np.exp(-f["logit"])) - y) * importance / importance.sum()
        by_bag = error[:, None] * p["c"]
        to_a = (h * by_bag[bag]).sum(axis=1)
        to_gate = a * (to_a - np.add.reduceat(a * to_a, f["first"])[bag])
        to_ts = to_gate[:, None] * p["w"]
        to_t, to_s = to_ts * s * (1 - t * t), to_ts * t * s * (1 - s)
        to_h = (a[:, None] * by_bag[bag] + to_t @ p["V"].T + to_s @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ to_h + 1e-4 * p["E"], "b": to_h.sum(axis=0), "V": h.T @ to_t, "U": h.T @ to_s,
                "w": (t * s).T @ to_gate, "c": f["z"].T @ error, "c0": np.array([error.sum()])}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(x, counts)["logit"].astype(np.float64)))


def fit_attention(texts: list[str | None], labels: list[int], importance: list[float]) -> AttentionModel:
    """Train with Adam in small batches in a fixed order; the same sample gives the same model."""
    y, weight = np.array(labels, np.float32), np.array(importance, np.float32)
    share = float(np.clip((y * weight).sum() / max(weight.sum(), 1e-9), 0.01, 0.99)) if len(y) else 0.5
    model = AttentionModel(share)
    if len(set(labels)) < 2:
        return model
    encoder, sparse = PassageEncoder(), []
    for start in range(0, len(texts), 256):
        x, counts = encoder.passages(texts[start:start + 256])
        cut = np.concatenate([[0], np.cumsum(counts)])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            where = np.nonzero(x[a:b])
            sparse.append((b - a, *(w.astype(np.int32) for w in where), x[a:b][where]))
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    rng, step, total = np.random.default_rng(11), 0, EPOCHS * (-(-len(y) // BATCH))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(y), BATCH):
            some = order[start:start + BATCH]
            counts = np.array([sparse[i][0] for i in some])
            x = np.zeros((int(counts.sum()), FEATURES), np.float32)
            for top, i in zip(np.cumsum(counts) - counts, some, strict=True):
                x[top + sparse[i][1], sparse[i][2]] = sparse[i][3]
            grads = model.gradients(x, counts, y[some], weight[some])
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def learn_quality(records: DataFrame, labels: DataFrame, id_col: str = "molecule_id",
                  text_col: str = "evidence_summary_notes", label_col: str = "selected", learn_from: Column | None = None
                  ) -> AttentionModel:
    """Fit the model on at most ``SAMPLE_RECORDS`` labelled records of each label (0 or 1).

    ``labels`` has one row for each labelled record (of several, each counts). A sampled record weighs
    as many records as its label has for each sampled one, so scores follow the labels' true shares.
    Rows without id, or with another label, teach nothing; null texts count as empty. ``learn_from`` is
    a condition on ``id_col`` (default: crc32 of the id modulo 3 is not 1). The project marks such
    records by review status: ``selected`` is 1 for selected and 0 for rejected ones.
    """
    allowed = (remainder_of_id(id_col, 3) != 1) if learn_from is None else learn_from
    marked = labels.where(F.coalesce(allowed, F.lit(False)) & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    sizes = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = bounded_sample(marked, "label", SAMPLE_RECORDS)
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = sorted(((r.label, str(r.id), r.text or "") for r in rows.limit(4 * SAMPLE_RECORDS).toLocalIterator()),
                    key=lambda r: (zlib.crc32(r[1].encode()), r))
    taken = {k: sum(r[0] == k for r in sample) for k in sizes}
    return fit_attention([r[2] for r in sample], [r[0] for r in sample], [sizes[r[0]] / taken[r[0]] for r in sample])


def score_quality(records: DataFrame, model: AttentionModel, id_col: str = "molecule_id",
                  text_col: str = "evidence_summary_notes", held_out: Column | None = None) -> DataFrame:
    """Score every record's evidence notes, from all of their passages.

    Each passage of ``PASSAGE_WORDS`` words is encoded from the shapes and bytes of its tokens, gated
    attention weighs the passages, and the score comes from their weighted mean. Returns one row for
    each record: ``id_col``, ``held_out`` (default: crc32 of the id modulo 3 is 1), ``score`` (0 to 1,
    higher: label 1 likelier), ``predicted`` (1 if score >= 0.5), ``passages`` and ``attention_top`` (the
    number of the passage with the largest weight).

    Null and empty texts are one empty passage. Repeated rows and rows without id are scored like others.
    The model has a fixed size.
    """
    held = F.coalesce(remainder_of_id(id_col, 3) == 1, F.lit(False)) if held_out is None else held_out
    rows = records.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    out = T.StructType([
        T.StructField(id_col, rows.schema["id"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("passages", T.LongType()), T.StructField("attention_top", T.LongType()),
    ])
    bounded_batches(records.sparkSession)
    schema, shared = arrow_schema(out), records.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, fitted = PassageEncoder(), shared.value
        for frame in frames:
            texts = frame.column(2).to_pylist()
            for first, last in text_batches(texts, 1 << 20):
                x, counts = encoder.passages(texts[first:last])
                found = fitted.forward(x, counts)
                scores = 1 / (1 + np.exp(-found["logit"].astype(np.float64)))
                top = np.lexsort((-found["a"], found["bag"]))[found["first"]] - found["first"]
                yield pa.RecordBatch.from_arrays([
                    *(frame.column(i).slice(first, last - first) for i in range(2)), pa.array(scores),
                    pa.array((scores >= 0.5).astype(np.int32)), pa.array(counts), pa.array(top.astype(np.int64))], schema=schema)

    return rows.mapInArrow(score, out)


def keep_selected(records: DataFrame, model: AttentionModel, text_col: str = "evidence_summary_notes") -> DataFrame:
    """The records that the model predicts as label 1, with all their columns; nothing is joined or shuffled."""
    bounded_batches(records.sparkSession)
    shared, place = records.sparkSession.sparkContext.broadcast(model), records.columns.index(text_col)

    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, fitted = PassageEncoder(), shared.value
        for frame in frames:
            texts = frame.column(place).to_pylist()
            for first, last in text_batches(texts, 1 << 20):
                good = fitted.score(*encoder.passages(texts[first:last])) >= 0.5
                yield frame.slice(first, last - first).filter(pa.array(good))

    return records.mapInArrow(keep, records.schema)
