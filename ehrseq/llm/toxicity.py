"""Toxicity from confirmed toxic texts and unlabelled ones: non-negative positive-unlabelled learning.

A linear classifier g over the features present in a text minimizes

    prior * R(toxic, +) + max(0, R(unlabelled, -) - prior * R(toxic, -))

where R(set, sign) is the mean sigmoid loss of a set under a sign: unlabelled texts count as clean,
less what the toxic among them must be charged. Where the second term falls below zero, the fit has
begun to call unlabelled toxic texts clean by heart, and a step goes back up instead (non-negative
risk). No label 0 is ever an example; labels 0 and 1 together only give the class prior.

Samples are bounded and fitted on the driver; every text is then scored whole in one pass. The
score is that of several classifiers' mean margin, each with its own share of the unlabelled texts.
"""

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrseq.llm.common import lowered, map_rows, stage

# Bounds of the samples: ids with the smallest hashes.
TOXIC_SAMPLE, UNLABELLED_SAMPLE = 4_000, 12_000
# Features with a weight, those whose share among toxic texts is the most standard errors off their
# share among unlabelled ones, and how many that must be.
MOST_FEATURES, MIN_ERRORS = 20_000, 4.0
CLASSIFIERS = 3
# Where no label tells the class prior.
PRIOR = 0.1
ROUNDS, STEP, PENALTY = 600, 0.1, 1e-4
_WORD = re.compile(r"[^\W\d_]+")
# Beginnings of words that are features, besides whole words.
BEGINNINGS = range(4, 8)
# Words remembered by a task; bounds memory only.
REMEMBERED_WORDS = 200_000


def word_features(word: str) -> set[int]:
    """Hashes of a lower-cased word and its beginnings."""
    names = [f"{word[:n]}-" for n in BEGINNINGS if n <= len(word)]
    return {zlib.crc32(name.encode()) for name in (f"{word} ", *names)}


class Features:
    """The different features of texts, or of those that ``known`` (ascending) has, their places in it."""

    def __init__(self, known: np.ndarray | None = None):
        self._places = None if known is None else {int(f): n for n, f in enumerate(known)}
        self._remembered: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        found, remembered = set(), self._remembered
        for word in set(_WORD.findall(lowered(text or ""))):
            held = remembered.get(word)
            if held is None:
                held = tuple(word_features(word))
                if self._places is not None:
                    held = tuple(self._places[f] for f in held if f in self._places)
                if len(remembered) >= REMEMBERED_WORDS:
                    remembered.clear()
                remembered[word] = held
            found.update(held)
        return sorted(found)


@dataclass(frozen=True)
class ToxicityModel:
    known: np.ndarray  # hashes of features, ascending
    weights: np.ndarray  # classifiers by features
    biases: np.ndarray  # classifiers

    def score(self, places: list[int]) -> float:
        """0 to 1, of a text with the known features at ``places``."""
        margin = (self.weights[:, places].sum(axis=1) + self.biases).mean()
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every feature of every row."""
    sizes = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), sizes), np.array([f for r in rows for f in r], np.int64)


def risk(weights, bias, toxic, unlabelled, prior) -> tuple[float, float, list, list]:
    """R(toxic, +) and R(unlabelled, -) - prior * R(toxic, -), and the gradients (weights, bias) of prior * first and of second.

    ``toxic`` and ``unlabelled`` are (rows, their number) with rows as of ``_flat``.
    """
    parts = []
    for (row, feature), n in (toxic, unlabelled):
        margin = np.bincount(row, weights[feature], n) + bias
        below = 1 / (1 + np.exp(np.clip(margin, -40, 40)))  # the loss under +; under - it is 1 - below
        slope = below * (1 - below) / n
        parts.append((below.mean(), np.bincount(feature, slope[row], len(weights)), slope.sum()))
    (toxic_plus, toxic_slope, toxic_sum), (unlabelled_plus, unlabelled_slope, unlabelled_sum) = parts
    rest = (1 - unlabelled_plus) - prior * (1 - toxic_plus)
    return toxic_plus, rest, [-prior * toxic_slope, -prior * toxic_sum], [unlabelled_slope - prior * toxic_slope, unlabelled_sum - prior * toxic_sum]


def fit(toxic: list[list[int]], unlabelled: list[list[int]], features: int, prior: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk."""
    weights, bias = np.zeros(features), np.array(0.0)
    if not toxic or not unlabelled:
        return weights, float(np.log(prior / (1 - prior)))
    sets = [(_flat(rows), len(rows)) for rows in (toxic, unlabelled)]
    state = [np.zeros(features), np.zeros(()), np.zeros(features), np.zeros(())]
    for n in range(1, rounds + 1):
        _, rest, rise, other = risk(weights, bias, *sets, prior)
        gradients = [a + b for a, b in zip(rise, other)] if rest >= 0 else [-b for b in other]
        gradients[0] = gradients[0] + PENALTY * weights
        for k, (x, g) in enumerate(zip((weights, bias), gradients)):
            state[k] += 0.1 * (g - state[k])
            state[k + 2] += 0.01 * (g * g - state[k + 2])
            x -= STEP * (1 - n / (rounds + 1)) * (state[k] / (1 - 0.9**n)) / (np.sqrt(state[k + 2] / (1 - 0.99**n)) + 1e-8)
    return weights, float(bias)


def samples(docs: DataFrame, labels: DataFrame, learn, id_column: str, text: str, label: str) -> DataFrame:
    """(toxic, features) of the sampled texts: those labelled 1, and any.

    Near copies, whose three smallest features agree, count once in each sample: a group of copies
    of one toxic text would otherwise stand for many clean ones.
    """
    usable = F.col(id_column).isNotNull() & F.coalesce(learn, F.lit(False))
    marked = labels.where(usable & (F.col(label) == 1)).select(id_column).distinct()
    every = docs.where(usable).select(id_column).distinct()
    sizes = {True: TOXIC_SAMPLE, False: UNLABELLED_SAMPLE}
    picked = [ids.orderBy(F.xxhash64(id_column), id_column).limit(sizes[kind]).withColumn("toxic", F.lit(kind)) for kind, ids in ((True, marked), (False, every))]

    def each(lists):
        features = Features()
        for rows in lists:
            yield {"toxic": [r[1] for r in rows], "features": [features(r[2]) for r in rows]}

    # The limits above bound the broadcast.
    rows = docs.select(id_column, F.col(text).alias("_text")).join(F.broadcast(picked[0].unionAll(picked[1])), id_column)
    found = map_rows(rows.select(id_column, "toxic", "_text"), each, "toxic boolean, features array<bigint>")
    found = found.groupBy("toxic", F.slice("features", 1, 3).alias("sketch")).agg(F.min("features").alias("features"))
    # Ids that many documents share don't lift the bounds.
    bounded = [found.where(F.col("toxic") == kind).orderBy(F.xxhash64("features"), "features").limit(n) for kind, n in sizes.items()]
    return bounded[0].unionAll(bounded[1]).select("toxic", "features")


def telling_features(sample: DataFrame) -> np.ndarray:
    """Features whose share among toxic texts is far off that among the others, ascending."""
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, others = n.get(True, 0), n.get(False, 0)
    if not toxic or not others:
        return np.zeros(0, np.int64)
    held = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
    counted = held.agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    share = (F.col("a") + F.col("b")) / (toxic + others)
    error = F.sqrt(share * (1 - share) * (1 / toxic + 1 / others) + 1e-12)
    off = F.abs(F.col("a") / toxic - F.col("b") / others) / error
    top = counted.select("feature", off.alias("off")).where(F.col("off") > MIN_ERRORS).orderBy(F.desc("off"), "feature").limit(MOST_FEATURES)
    return np.sort(np.array([r.feature for r in top.collect()], np.int64))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fitted from the rows that ``learn`` (a boolean expression of the id) leaves: labelled 1 in
    ``labels``, and any of ``docs`` unlabelled. An id labelled more than once is toxic if one label says so."""
    usable = F.col(id_column).isNotNull() & F.col(label).isNotNull() & F.coalesce(learn, F.lit(False))
    known = labels.where(usable).groupBy(id_column).agg(F.max(label).alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    prior = min(max(share, 0.01), 0.5) if share is not None and share < 1 else PRIOR

    sample = stage(samples(docs, labels, learn, id_column, text, label), "toxicity_sample")
    features = telling_features(sample)

    def each(lists):
        place = {int(f): n for n, f in enumerate(features)}
        for rows in lists:
            yield {"toxic": [r[0] for r in rows], "draw": [r[1] for r in rows], "held": [[place[f] for f in r[2] if f in place] for r in rows]}

    drawn = sample.select("toxic", F.xxhash64("features").alias("draw"), "features")
    kept = map_rows(drawn, each, "toxic boolean, draw bigint, held array<int>").orderBy("draw", "held").collect()
    toxic, unlabelled = ([r.held for r in kept if r.toxic == wanted] for wanted in (True, False))
    fitted = [fit(toxic, unlabelled[n::CLASSIFIERS], len(features), prior) for n in range(CLASSIFIERS)]
    return ToxicityModel(features, np.array([w for w, _ in fitted]), np.array([b for _, b in fitted]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, least: float = 0.7, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted) of every document; ``predicted`` is 1 if the score is at least ``least``.

    Null and empty texts have no features and get the score of the bias alone. Repeated rows are
    scored each; an empty table gives an empty result. Other columns are left out; an id column
    named like a result is refused.
    """
    if id_column in ("score", "predicted"):
        raise ValueError(f"the id column must not be named {id_column}")
    given = docs.select(F.col(id_column), F.col(text).alias("_text"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def each(lists):
        model = known.value
        features = Features(model.known)
        for rows in lists:
            yield {id_column: [r[0] for r in rows], "score": [model.score(features(r[1])) for r in rows]}

    kind = given.schema.fields[0].dataType.simpleString()
    scored = map_rows(given, each, f"`{id_column}` {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
