"""Ordinal quality grades by cumulative-link regression on hashed text.

P(grade <= j) = sigmoid(threshold_j - w . x): one weight per hashed feature, shared by all grades,
and ordered thresholds. Fitted on the driver from a bounded sample of rated documents, then
applied to every document in one pass.
"""

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrseq.llm.common import lowered, map_rows

# Bound of the rated sample: documents with the smallest hashes.
SAMPLE_DOCUMENTS = 6_000
BUCKETS = 1 << 18
# A feature gets a weight if the mean grade of at least MIN_DOCUMENTS rated documents that have it is
# more than MIN_ERRORS standard errors off the overall mean; the others would add noise in long texts.
MIN_DOCUMENTS = 5
MIN_ERRORS = 5.0
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


@dataclass(frozen=True)
class GradeModel:
    weights: np.ndarray  # BUCKETS
    thresholds: np.ndarray  # grades - 1, ascending

    def probabilities(self, score: float) -> np.ndarray:
        """Of each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds - score, -40, 40)))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def features(text: str | None) -> list[int]:
    """Sorted different buckets of a whole text: its words and runs of marks, those said often, and how varied it is."""
    counts = Counter(_TOKEN.findall(lowered(text or "")))
    total = sum(counts.values())
    names = list(counts)
    names += [f"{word} {min(n.bit_length(), 8)}" for word, n in counts.items() if n >= 8]
    if total >= 20:
        names.append(f" varied {10 * len(counts) // total}")
    return sorted({zlib.crc32(name.encode()) % BUCKETS for name in names})


def fit(rows: list[tuple[int, list[int]]], grades: int, rounds: int = 200, penalty: float = 2e-4, min_errors: float = MIN_ERRORS) -> GradeModel:
    """Weights and thresholds from (grade, buckets) rows by full-batch Adam on the penalized likelihood.

    Grades weigh alike, however rare. A grade without rows keeps its place between the others.
    """
    y = np.array([g for g, _ in rows], np.int64)
    sizes = np.array([len(f) for _, f in rows], np.int64)
    flat = np.concatenate([np.asarray(f, np.int64) for _, f in rows]) if len(rows) and sizes.sum() else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), sizes)
    told = _telling(y, doc, flat, min_errors)
    doc, flat = doc[told[flat]], flat[told[flat]]
    weights = np.zeros(BUCKETS)
    steps = np.concatenate([[-1.0], np.zeros(grades - 2)])  # the first threshold, then logs of the gaps
    if not len(rows):
        return GradeModel(weights.astype(np.float32), _thresholds(steps))
    per_grade = np.bincount(y, minlength=grades)
    share = (1 / np.maximum(per_grade, 1))[y]
    share /= share.sum()
    state = [np.zeros_like(x) for x in (weights, steps, weights, steps)]
    for n in range(1, rounds + 1):
        score = np.bincount(doc, weights[flat], len(rows))
        thresholds = _thresholds(steps)
        ends = np.concatenate([[-np.inf], thresholds, [np.inf]])
        low, high = ends[y] - score, ends[y + 1] - score
        p_low, p_high = 1 / (1 + np.exp(-np.clip(low, -40, 40))), 1 / (1 + np.exp(-np.clip(high, -40, 40)))
        p_low, p_high = np.where(np.isinf(low), 0, p_low), np.where(np.isinf(high), 1, p_high)
        p = np.maximum(p_high - p_low, 1e-12)
        d_low, d_high = p_low * (1 - p_low) / p * share, p_high * (1 - p_high) / p * share
        d_score = d_high - d_low
        d_ends = np.bincount(y, d_low, grades + 1)[1:grades] - np.bincount(y + 1, d_high, grades + 1)[1:grades]
        gradients = [
            np.bincount(flat, d_score[doc], BUCKETS) + penalty * weights,
            np.concatenate([[d_ends.sum()], [d_ends[j + 1 :].sum() * np.exp(steps[j + 1]) for j in range(grades - 2)]]),
        ]
        for k, (x, g) in enumerate(zip((weights, steps), gradients)):
            state[k] += 0.1 * (g - state[k])
            state[k + 2] += 0.001 * (g * g - state[k + 2])
            x -= 0.05 * (1 - n / (rounds + 1)) * (state[k] / (1 - 0.9**n)) / (np.sqrt(state[k + 2] / (1 - 0.999**n)) + 1e-8)
    return GradeModel(weights.astype(np.float32), _thresholds(steps))


def _telling(y, doc, flat, min_errors) -> np.ndarray:
    """Which features go with unusual grades."""
    count = np.bincount(flat, minlength=BUCKETS)
    mean = np.bincount(flat, y[doc], BUCKETS) / np.maximum(count, 1)
    off = np.abs(mean - y.mean()) if len(y) else mean
    return (count >= MIN_DOCUMENTS) & (off * np.sqrt(count) > min_errors * (y.std() if len(y) else 1))


def _thresholds(steps):
    return np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))


def rated_features(docs: DataFrame, ratings: DataFrame, id_column="doc_id", text="text", grade="grade", sample=SAMPLE_DOCUMENTS) -> DataFrame:
    """(grade, features) of at most ``sample`` rated ids. An id rated more than once counts with its lowest grade."""
    known = ratings.where(F.col(id_column).isNotNull() & F.col(grade).isNotNull()).groupBy(id_column)
    graded = known.agg(F.min(grade).cast("bigint").alias("grade"))
    picked = graded.orderBy(F.xxhash64(id_column), id_column).limit(sample)

    def each(lists):
        for rows in lists:
            yield {"grade": [r[0] for r in rows], "features": [features(r[1]) for r in rows], "draw": [zlib.crc32((r[1] or "").encode()) for r in rows]}

    # The limit above bounds the broadcast.
    rated = docs.select(id_column, F.col(text).alias("_text")).join(F.broadcast(picked), id_column).select("grade", "_text")
    rows = map_rows(rated, each, "grade bigint, features array<bigint>, draw bigint")
    # Ids that many documents share don't lift the bound.
    return rows.orderBy("draw", "grade", "features").limit(sample).select("grade", "features")


def fit_grades(docs: DataFrame, ratings: DataFrame, grades: int, **names) -> GradeModel:
    """Fitted from at most ``SAMPLE_DOCUMENTS`` rated documents."""
    return fit([tuple(r) for r in rated_features(docs, ratings, **names).collect()], grades)


def grade_documents(docs: DataFrame, model: GradeModel, good: int, least: float = 0.5, id_column="doc_id", text="text") -> DataFrame:
    """(id, expected_grade, tail_probability, kept) of every document.

    ``tail_probability`` is that of grade ``good`` or better; ``kept`` if it is at least ``least``.
    Null and empty texts have no features and get the thresholds' own probabilities. Repeated
    rows are graded each; an empty table gives an empty result. Other columns are left out.
    """
    given = docs.select(F.col(id_column), F.col(text).alias("_text"))

    def each(lists):
        for rows in lists:
            p = np.array([model.probabilities(float(model.weights[features(r[1])].sum())) for r in rows])
            tail = p[:, good:].sum(axis=1)
            yield {
                id_column: [r[0] for r in rows],
                "expected_grade": (p @ np.arange(p.shape[1])).tolist(),
                "tail_probability": tail.tolist(),
                "kept": (tail >= least).tolist(),
            }

    kind = given.schema.fields[0].dataType.simpleString()
    return map_rows(given, each, f"`{id_column}` {kind}, expected_grade double, tail_probability double, kept boolean")


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 1, 2).when(quality == 0, 1)
