"""Language of record texts by Kneser-Ney character models."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm.arrays import arrow_schema, bounded_batches, remainder_of_id
from siftrank.llm.chunks import text_batches
from siftrank.llm.sampling import bounded_sample

ORDER = 4
#: Bounds of the learning sample, for each language.
SAMPLE_RECORDS = 600
SAMPLE_CHARACTERS = 2_000_000
#: One in so many sampled records sets the score's scale and the rejection limits.
CALIBRATE = 5
#: Share of calibration records above whose cross-entropy a text is marked as rejected.
REJECT_ABOVE = 0.995
UNKNOWN = "und"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with one blank for every run of other characters.

    Each text starts and ends with a blank. Returns the symbols, the number of each text, and
    whether it has a letter.
    """
    joined = "\0".join([" " + (t or "").replace("\0", " ").lower() + " " for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    borders = np.concatenate([np.flatnonzero(points == 0), [len(points)]])
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters
    starts = np.concatenate([[0], borders[:-1] + 1])
    keep[starts] = True
    keep[borders[:-1]] = False
    kept = np.where(letter, points, 32)[keep]
    ends = np.cumsum(keep)[borders - 1]
    counts = np.diff(ends, prepend=0)
    has = np.add.reduceat(letter, starts) > 0 if len(starts) else np.zeros(0, bool)
    return kept, counts, has


def gram_hashes(points: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` symbols that end at each of ``ends``."""
    h = np.full(len(ends), order, np.uint64)
    for back in range(order):
        h = (h ^ points[ends - back].astype(np.uint64)) * _SPREAD
        h ^= h >> np.uint64(29)
    return h


class CharacterModel:
    """Interpolated Kneser-Ney model of one language, in sorted hash arrays.

    For each order: hashes of seen grams with their log probability, and hashes of seen contexts
    with the log weight of the lower order.
    """

    def __init__(self, texts: list[str], alphabet: int, order: int = ORDER):
        points, counts, _ = symbols(texts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        at = np.arange(len(points))
        self.grams, self.contexts = [], []
        self.floor = float(-np.log(alphabet + 1.0))
        above: np.ndarray | None = None  # last symbols' places of the distinct grams one order up
        tables = {}
        for n in range(order, 0, -1):
            ends = at[at - first >= n - 1] if n == order else above
            # Below the highest order, a gram counts once for each different symbol before it.
            hashes, place, count = np.unique(gram_hashes(points, ends, n), return_index=True, return_counts=True)
            tables[n] = (hashes, ends[place], count)
            above = ends[place]
        for n in range(1, order + 1):
            hashes, ends, count = tables[n]
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.05, once / max(once + 2 * twice, 1)))
            context = gram_hashes(points, ends - 1, n - 1)
            known, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, count)
            kinds = np.bincount(inverse)
            lower = np.exp(self.log_chance(points, ends, n - 1))
            chance = (count - discount) / total[inverse] + discount * kinds[inverse] / total[inverse] * lower
            self.grams.append((hashes, np.log(chance)))
            self.contexts.append((known, np.log(discount * kinds / total)))

    def log_chance(self, points: np.ndarray, ends: np.ndarray, order: int | None = None) -> np.ndarray:
        """Log probability of the symbols at ``ends`` after up to ``order`` - 1 symbols before them."""
        out = np.full(len(ends), self.floor)
        for n in range(1, (len(self.grams) if order is None else order) + 1):
            hashes, chance = self.grams[n - 1]
            known, weight = self.contexts[n - 1]
            found, place = _find(known, gram_hashes(points, ends - 1, n - 1))
            out = np.where(found, out + weight[place], out)
            found, place = _find(hashes, gram_hashes(points, ends, n))
            out = np.where(found, chance[place], out)
        return out


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return known[place] == wanted, place


def cross_entropies(models: list[CharacterModel], texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Mean negative log probability of each text's symbols under each model; whether it has a letter.

    The first ``order`` - 1 symbols are only contexts where the text is longer than that; each
    distinct gram of the batch is looked up once.
    """
    points, counts, has = symbols(texts)
    starts = np.cumsum(counts) - counts
    lead = np.minimum(order - 1, np.maximum(counts - 1, 0))
    scored = np.ones(len(points), bool)
    for back in range(order - 1):
        scored[(starts + back)[back < lead]] = False
    ends = np.flatnonzero(scored)
    n = counts - lead
    # Very short texts reach into the text before; their gram is padded with their first symbol.
    padded = np.concatenate([np.full(order, 32, np.uint32), points])
    hashes = gram_hashes(padded, ends + order, order)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    out = np.zeros((len(texts), len(models)))
    cut = np.cumsum(n) - n
    for j, model in enumerate(models):
        losses = -model.log_chance(padded, ends[first] + order)
        out[:, j] = np.add.reduceat(losses[inverse], cut) / n if len(n) else 0
    return out, has


class LanguageModels:
    """Models of all languages, the scale of the score, and each language's rejection limit."""

    def __init__(self, sample: list[tuple[object, str, str]]):
        self.languages = sorted({lang for _, lang, _ in sample})
        by_lang = {lang: [t for _, x, t in sample if x == lang] for lang in self.languages}
        fitted = {lang: [t for i, t in enumerate(ts) if i % CALIBRATE or len(ts) < CALIBRATE] for lang, ts in by_lang.items()}
        points = [symbols(ts)[0] for ts in fitted.values()]
        alphabet = len(np.unique(np.concatenate(points))) if points else 1
        self.models = [CharacterModel(fitted[lang], alphabet) for lang in self.languages]
        tests = [(self.languages.index(lang), t) for lang, ts in by_lang.items() for i, t in enumerate(ts)
                 if i % CALIBRATE == 0 and len(ts) >= CALIBRATE]
        self.scale, self.limits = 20.0, np.full(len(self.languages), np.inf)
        if tests:
            truth = np.array([k for k, _ in tests])
            losses, has = cross_entropies(self.models, [t for _, t in tests])
            truth, losses = truth[has], losses[has]
            scales = np.geomspace(1, 200, 40)
            fit = [np.log(self._shares(losses, s)[np.arange(len(truth)), truth] + 1e-12).sum() for s in scales]
            self.scale = float(scales[int(np.argmax(fit))]) if len(truth) else self.scale
            for k in range(len(self.languages)):
                own = losses[truth == k, k]
                if len(own):
                    self.limits[k] = float(np.quantile(own, REJECT_ABOVE)) + 0.05

    @staticmethod
    def _shares(losses: np.ndarray, scale: float) -> np.ndarray:
        x = -scale * (losses - losses.min(axis=1, keepdims=True))
        e = np.exp(x)
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy in nats for each symbol, and whether it should be rejected."""
        if not self.languages or not texts:
            return [(UNKNOWN, 0.0, None, True)] * len(texts)
        losses, has = cross_entropies(self.models, texts)
        best = losses.argmin(axis=1)
        score = self._shares(losses, self.scale)[np.arange(len(texts)), best]
        return [(self.languages[b], float(s), float(row[b]), bool(row[b] > self.limits[b])) if h else (UNKNOWN, 0.0, None, True)
                for b, s, row, h in zip(best.tolist(), score.tolist(), losses, has.tolist(), strict=True)]


def learn_languages(records: DataFrame, id_col: str = "molecule_id", text_col: str = "patent_top_record_title",
                    lang_col: str = "lang", learn_from: Column | None = None) -> LanguageModels:
    """Fit one model for each value of ``lang_col`` on a bounded sample.

    At most ``SAMPLE_RECORDS`` records and about ``SAMPLE_CHARACTERS`` characters of each language are
    used, every fifth of them for calibration. Rows without text, language or id teach nothing.
    """
    usable = records.where(F.coalesce(F.lit(True) if learn_from is None else learn_from, F.lit(False))).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    ).where("id is not null and lang is not null and text is not null")
    sample, used = [], {}
    for row in bounded_sample(usable, "lang", SAMPLE_RECORDS).orderBy("lang", F.xxhash64(F.col("id").cast("string")), "id", "text").toLocalIterator():
        if used.get(row.lang, 0) < SAMPLE_CHARACTERS and symbols([row.text])[2][0]:
            used[row.lang] = used.get(row.lang, 0) + len(row.text)
            sample.append((row.id, row.lang, row.text))
    return LanguageModels(sample)


def identify_language(records: DataFrame, models: LanguageModels, id_col: str = "molecule_id",
                      text_col: str = "patent_top_record_title", held_out: Column | None = None) -> DataFrame:
    """Predict the language of every record's title (or any text column) from its whole text.

    Character models of each language with interpolated Kneser-Ney estimates are stored in sorted hash
    arrays; the language with the lowest cross-entropy for each symbol wins. Returns one row for each
    record: ``id_col``, ``held_out`` (default: crc32 of the id modulo 4 is 2), ``lang_pred``, ``score``
    (a share calibrated on sampled records, 0 to 1), ``cross_entropy`` and ``rejected`` (cross-entropy
    above nearly all calibration records of that language).

    Null texts and texts without a letter give ``und``, score 0 and rejected; so does every text where
    nothing could be learned. Ties go to the first language in order. Repeated rows stay; ids may be
    null. The project's records have no language column, so the training column is named by the caller.
    The models are as large as their sample, whatever the data.
    """
    held = F.coalesce(remainder_of_id(id_col, 4) == 2, F.lit(False)) if held_out is None else held_out
    rows = records.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    bounded_batches(records.sparkSession)
    shared = records.sparkSession.sparkContext.broadcast(models)
    out = T.StructType([
        T.StructField(id_col, rows.schema["id"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
    ])
    schema = arrow_schema(out)

    def predict(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column(2).to_pylist()
            for first, last in text_batches(texts, 1 << 20):
                found = list(zip(*shared.value.predict(texts[first:last]), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [frame.column(i).slice(first, last - first) for i in range(2)]
                    + [pa.array(c, f.type) for c, f in zip(found, list(schema)[2:], strict=True)], schema=schema)

    return rows.mapInArrow(predict, out)
