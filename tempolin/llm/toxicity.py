"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 not toxic, 1 toxic, 2 severe.  Labels tell toxic documents from
others; one of them is severe if it holds more of the features that set toxic documents
apart than the median toxic document of the sample does.  With features x and weights w shared by all thresholds,
P(grade >= k) = 1 / (1 + exp(threshold_k - w.x)).  Thresholds stay in order.  The
expected severity is the sum of P(grade >= k), so it lies between 0 and the top grade.

Features: presence of a word (A-Z lower-cased, runs of 0-9, a-z and characters from
U+0080), and of a word that begins with certain 4 to 7 characters.  Those that at least
``MIN_DOCS`` documents of the sample hold are ordered by how far their share of graded
documents is from the expected, and those far enough enter the fit, up to ``MAX_FEATURES``.  It
minimises the mean negative log-likelihood plus an L1 penalty by accelerated proximal
steps with a line search, so the model is a short list of words and beginnings.

The fit takes at most ``sample`` labelled documents, those with the least hash of their
id; everything else is done on all documents.

Defined results: null and empty texts have no words and get the severity of an empty
text; labels with a null id or verdict are left out; for repeated labels the more toxic one
counts, for repeated ids the least text; without
labels, or with one grade only, the severity is that of the grade seen (0 without any);
repeated documents each get a row; an empty table gives an empty result; other columns
are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, trimmed
from .decontamination import words_of

GRADES = 3
MIN_DOCS = 5
MAX_FEATURES, MIN_FEATURES = 3_000, 30
#: Deviations by which a feature's share of graded documents is off; others enter only to fill up.
MIN_SCORE = 4.0
SAMPLE = 8_000
PREFIXES = (4, 5, 6, 7)


def features_of(text: bytes) -> set[bytes]:
    """Different words of a text, and with ``^`` in front their beginnings."""
    words = set(words_of(text))
    out = set(words)
    for word in words:
        name = word.decode(errors="replace")
        out.update(b"^" + name[:n].encode() for n in PREFIXES if len(name) > n)
    return out


@dataclass
class OrdinalModel:
    """Word weights and thresholds of an ordinal regression."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (40.0, 80.0)
    #: Features of the words met, words by word; a worker's own, of bounded size.
    _known: dict[bytes, frozenset] = field(default_factory=dict, repr=False)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.array([self._score(set(words_of(t))) for t in texts], dtype=np.float64)

    def _score(self, words: set[bytes]) -> float:
        weights, known = self.weights, self._known
        if len(known) > 300_000:
            known.clear()
        for word in words.difference(known):
            known[word] = frozenset(weights.keys() & features_of(word))
        return sum(sorted(weights[f] for f in frozenset().union(*map(known.__getitem__, words))))

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, one column each."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.thresholds)[None, :] - scores[:, None], -60, 60)))


def screen(words: list[list[bytes]], graded: np.ndarray) -> dict[bytes, float]:
    """Deviations of each feature's share of graded documents from the expected; rare features are left out."""
    counts: dict[bytes, list[int]] = {}
    for doc, yes in zip(words, np.asarray(graded).tolist()):
        for word in doc:
            both = counts.setdefault(word, [0, 0])
            both[0] += 1
            both[1] += yes
    rate = float(np.mean(graded)) if len(words) else 0.0
    return {w: (k - c * rate) / float(np.sqrt(c * rate * (1 - rate) + 1)) for w, (c, k) in counts.items() if c >= MIN_DOCS}


def severity_grades(words: list[list[bytes]], toxic: np.ndarray) -> np.ndarray:
    """0 for documents that are not toxic, 2 for toxic ones with more telling features than their median, else 1."""
    toxic = np.asarray(toxic, dtype=bool)
    telling = {w for w, off in screen(words, toxic).items() if off >= MIN_SCORE}
    held = np.array([sum(w in telling for w in doc) for doc in words], dtype=np.int64)
    middle = float(np.median(held[toxic])) if toxic.any() else 0.0
    return np.where(toxic, 1 + (held > middle), 0)


def fit_ordinal(words: list[list[bytes]], grades: np.ndarray, penalty: float = 1e-4, steps: int = 400, n_grades: int = GRADES) -> OrdinalModel:
    """Fit on documents given as lists of different features."""
    grades = np.asarray(grades, dtype=np.int64)
    present = sorted(set(grades.tolist()))
    if len(present) < 2:
        seen = present[0] if present else 0
        return OrdinalModel({}, tuple(-40.0 - 40 * (seen - k) if k <= seen else 40.0 * k for k in range(1, n_grades)))
    off = screen(words, grades > 0)
    best = sorted(off, key=lambda w: (-abs(off[w]), w))[:MAX_FEATURES]
    index = {w: i for i, w in enumerate(sorted(w for k, w in enumerate(best) if abs(off[w]) >= MIN_SCORE or k < MIN_FEATURES))}
    rows = np.repeat(np.arange(len(words)), [sum(w in index for w in doc) for doc in words])
    columns = np.fromiter((index[w] for doc in words for w in doc if w in index), np.int64, len(rows))
    n, size = len(words), len(index)
    # thresholds as a first one and gaps that are exponents, so that they stay in order
    share = np.clip([(grades >= k).mean() for k in range(1, n_grades)], 1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    shape = np.concatenate(([start[0]], np.log(np.maximum(np.diff(start), 1e-2))))
    def thresholds(s: np.ndarray) -> np.ndarray:
        return np.concatenate(([s[0]], s[0] + np.cumsum(np.exp(np.clip(s[1:], -10, 5)))))

    def chances(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """1 - P(grade >= own), P(grade >= next) and the likelihood of each document."""
        score = np.bincount(rows, at[columns], minlength=n) if size else np.zeros(n)
        cuts = np.concatenate(([-60.0], thresholds(at[size:]), [60.0]))
        above = 1 / (1 + np.exp(np.clip(score - cuts[grades], -60, 60)))
        below = 1 / (1 + np.exp(np.clip(cuts[grades + 1] - score, -60, 60)))
        return above, below, np.maximum(1 - above - below, 1e-12)

    def loss(at: np.ndarray) -> float:
        return float(-np.log(chances(at)[2]).mean())

    def slope(at: np.ndarray) -> np.ndarray:
        """Gradient of the loss by the weights and the shape of the thresholds."""
        above, below, likelihood = chances(at)
        by_cut = np.zeros(n_grades + 1)
        np.add.at(by_cut, grades, -(1 - above) * above / likelihood)
        np.add.at(by_cut, grades + 1, (1 - below) * below / likelihood)
        inner, s = by_cut[1:-1] / n, at[size:]
        by_shape = np.array([inner.sum(), *[inner[k:].sum() * np.exp(np.clip(s[k], -10, 5)) for k in range(1, len(s))]])
        return -np.concatenate((np.bincount(columns, (above - below)[rows], minlength=size) / n, by_shape))

    here, step, momentum = np.concatenate((np.zeros(size), shape)), 1.0, 1.0
    looked = here
    shrink = np.concatenate((np.full(size, penalty), np.zeros(len(shape))))
    for _ in range(steps):
        down, height = slope(looked), loss(looked)
        step *= 1.5
        while True:  # the largest step for which the quadratic bound holds
            moved = looked - step * down
            moved = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink, 0)
            change = moved - looked
            if loss(moved) <= height + down @ change + change @ change / (2 * step) + 1e-12 or step < 1e-8:
                break
            step /= 2
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        if (looked - moved) @ (moved - here) > 0:  # it overshoots: start the acceleration again
            following = 1.0
        looked = moved + (momentum - 1) / following * (moved - here)
        settled = np.abs(moved - here).max(initial=0.0) < 1e-6
        here, momentum = moved, following
        if settled:
            break
    weights, shape = here[:size], here[size:]
    named = {w: float(weights[i]) for w, i in index.items() if weights[i] != 0}
    return OrdinalModel(named, tuple(float(x) for x in thresholds(shape)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(features_of(t or b"")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["grade", "features"])


def _chosen(vocabulary: frozenset):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(vocabulary & features_of(t or b"")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["grade", "features"])

    return choose


def labelled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(grade 0 or 1, body) of at most ``sample`` labelled documents, in the shared folder."""
    graded = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("long")).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    # at most ``sample`` small rows are broadcast; only their texts are shuffled
    met = body.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("body").alias("body"))
    return cut(met.select("grade", F.col("body").cast("binary").alias("body")), "labelled")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Screen the features where the sample is, then fit those that remain on the driver."""
    known = labelled(docs, labels, sample)
    n, graded = known.agg(F.count("*"), F.coalesce(F.sum((F.col("grade") > 0).cast("long")), F.lit(0))).first()
    rate = graded / n if n else 0.0
    met = known.mapInArrow(_features, "grade long, features array<binary>").select((F.col("grade") > 0).cast("long").alias("graded"), F.explode("features").alias("feature"))
    counts = met.groupBy("feature").agg(F.count("*").alias("c"), F.sum("graded").alias("k")).where(F.col("c") >= MIN_DOCS)
    off = F.abs(F.col("k") - F.col("c") * rate) / F.sqrt(F.col("c") * (rate * (1 - rate)) + 1)
    best = counts.orderBy(F.round(off, 9).desc(), "feature").limit(MAX_FEATURES).select("feature").collect()
    vocabulary = frozenset(bytes(r[0]) for r in best)
    table = known.mapInArrow(_chosen(vocabulary), "grade long, features array<binary>").toArrow()
    rows = sorted(zip(([bytes(f) for f in x] for x in table.column("features").to_pylist()), table.column("grade").to_pylist()))  # they come in any order
    words = [x for x, _ in rows]
    return fit_ordinal(words, severity_grades(words, np.array([y for _, y in rows], dtype=bool)))


def _scorer(model: OrdinalModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = model.at_least(model.scores([t or b"" for t in batch.column(1).to_pylist()]))
            grade = (chance >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.round(chance.sum(axis=1), 6)), pa.array(grade.astype(np.int32)), pa.array(grade > 0)], names=["doc_id", "severity", "grade", "toxic"]
            )

    return score


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected ``severity``, the median ``grade`` and whether it is ``toxic`` for every row."""
    bound_batches(docs.sparkSession)
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    return body.mapInArrow(trimmed(_scorer(model)), "doc_id long, severity double, grade int, toxic boolean")
