"""Quality classifier: a linear support-vector machine over naive-Bayes ratios.

Features of a text are its distinct byte n-grams, and which words of four in a
row repeat the one before, hashed to ``2**BITS`` buckets. Each present feature has the value r, the logarithm of the ratio of its
frequencies in texts of class 1 and class 0. Both are smoothed towards its
frequency in all labelled texts, so a rare feature says little whatever the
sizes of the classes. A linear hinge-loss model
over these values is fitted by dual coordinate descent.

Class counts behind the ratios come from all labelled texts, in one pass over
them; the margin is fitted on at most ``sample`` texts, half of each class where
there are enough, chosen by a hash of their id. Both are bounded by
parameters, so the driver holds no more for a larger corpus. Scores are a
logistic curve of the margin, fitted on texts of the sample that the margin has
not seen, which count by the share of their class among all labelled texts. Documents are scored in a scan without shuffle.

A NULL text is empty; empty texts score by the intercept alone. Labels other
than 0 and 1 and labels without a document are left out; an id with several
labels counts as each. With no label, or one class alone, all texts score 1/2,
or that class's side. Repeated documents each get a row. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voucherlens.llm.text import SPACE, slices, table, word_hashes, words
from voucherlens.session import written

BITS = 18
NGRAMS = (3, 4)
SAMPLE = 4000
#: Texts that the common frequency counts for in each class.
SMOOTHING = 100.0
#: Text whose n-grams are hashed at once.
SLICE_BYTES = 1 << 20
COST = 1.0
EPOCHS = 8
#: Every such text of the sample is held back to fit the curve of the scores.
CALIBRATE_EVERY = 4

# Rows of two kinds: class counts of a feature, or a text of the sample.
_TRAINED = pa.schema([
    ("feature", pa.int32()), ("label", pa.int32()), ("docs", pa.int64()),
    ("place", pa.int64()), ("features", pa.large_binary()),
])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@dataclass(frozen=True)
class Model:
    """Per bucket the weight times its ratio, and the squared ratio for a text's length."""

    weighted: np.ndarray
    squares: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, own: np.ndarray) -> float:
        length = np.sqrt(self.squares[own].sum())
        return float(self.weighted[own].sum() / max(length, 1e-9)) + self.intercept

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-grams that begin at each byte, one array after another."""
    found = []
    for n in NGRAMS:
        count = max(len(data) - n + 1, 0)
        h = np.full(count, n, np.uint32)
        for k in range(n):
            h = (h ^ data[k : k + count]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        found.append((h * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32))
    return found


def repeats(hashes: np.ndarray) -> np.ndarray:
    """Bucket of each run of four words: the first eight, one per pattern of repeats."""
    same = (hashes[1:] == hashes[:-1]).astype(np.int32)
    count = max(len(hashes) - 3, 0)
    return same[:count] * 4 + same[1 : count + 1] * 2 + same[2 : count + 2]


def features(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct buckets of each text."""
    found = buckets(data)
    start, end, before = words(data, at, SPACE)
    shapes = repeats(word_hashes(data, start, end))
    before = before.tolist()
    for i, (first, last) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        own = [f[first : max(last - n + 1, first)] for n, f in zip(NGRAMS, found, strict=True)]
        yield np.unique(np.concatenate([*own, shapes[before[i] : max(before[i + 1] - 3, before[i])]]))


def _sampled(train: DataFrame, sample: int) -> DataFrame:
    """Ids of the sample: of each class those whose hash is smallest."""
    parts = [
        train.where(F.col("label") == label).select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        for label in (0, 1)
    ]
    return parts[0].unionByName(parts[1]).distinct().withColumn("in_sample", F.lit(True))


def _trained(documents: DataFrame, train: DataFrame, sample: int) -> DataFrame:
    """Class counts of features, and the features of the sample."""
    marked = train.join(_sampled(train, sample), ["doc_id", "label"], "left")
    # One plan at every size: labels grow with the corpus, so they are not broadcast.
    texts = documents.select(F.col("doc_id").cast("long"), "text").join(marked.hint("merge"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for rows, data, at in slices(batches, limit=SLICE_BYTES):
            columns = (rows.column(c).to_pylist() for c in ("doc_id", "label", "in_sample"))
            kept = []
            for own, doc, label, chosen in zip(features(data, at), *columns):
                counts[label][own] += 1
                if chosen:
                    kept.append((doc, label, own.astype("<i4").tobytes()))
            if kept:
                place, label, own = zip(*kept)
                none = pa.nulls(len(kept), pa.int32()), pa.nulls(len(kept), pa.int64())
                yield table(_TRAINED, feature=none[0], docs=none[1], place=place, label=label, features=own)
        label, feature = np.nonzero(counts)
        yield table(
            _TRAINED, feature=feature.astype(np.int32), label=label.astype(np.int32),
            docs=counts[label, feature], place=pa.nulls(len(label), pa.int64()),
            features=pa.nulls(len(label), pa.large_binary()),
        )

    return texts.select("doc_id", "text", "label", "in_sample").mapInArrow(
        run, "feature int, label int, docs long, place long, features binary"
    )


def fit(
    documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, label: str = "quality"
) -> Model:
    """Fit on the documents that ``labels`` marks with 0 or 1."""
    train = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
    train = train.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    seen = written(_trained(documents, train, sample), "quality-training")
    counts = seen.where("feature is not null").groupBy("feature", "label").agg(F.sum("docs").alias("docs")).toArrow()
    docs = np.zeros((2, 1 << BITS))
    docs[counts.column("label").to_numpy(), counts.column("feature").to_numpy()] = counts.column("docs").to_numpy()
    sizes = np.zeros(2)
    for row in train.groupBy("label").count().collect():
        sizes[row["label"]] = row["count"]
    rows = seen.where("features is not null").orderBy("place", "label", F.xxhash64("features")).toArrow()
    signs = 2 * rows.column("label").to_numpy() - 1
    texts = [np.frombuffer(x, "<i4") for x in rows.column("features").to_pylist()]
    return fit_margin(texts, signs, log_ratios(docs, sizes), sizes[1] / max(sizes.sum(), 1))


def log_ratios(docs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log ratio of each feature's document frequency in class 1 to that in class 0."""
    pooled = (docs.sum(axis=0) + 1e-9) / max(sizes.sum(), 1)
    shares = (docs + SMOOTHING * pooled) / (sizes[:, None] + SMOOTHING)
    return np.log(shares[1] / shares[0])


def fit_margin(
    texts: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, share: float = 0.5
) -> Model:
    """Dual coordinate descent for the L2-regularised hinge loss, then the score's curve.

    ``share`` is the share of class 1 among all labelled texts.
    """
    if len(set(signs.tolist())) < 2:
        none = np.zeros(len(ratios))
        return Model(none, none, float(signs[0]) if len(signs) else 0.0)
    held = np.arange(len(texts)) % CALIBRATE_EVERY == CALIBRATE_EVERY - 1
    fitted = np.flatnonzero(~held)
    # Values are scaled to unit length per text, so long texts do not dominate.
    values = []
    for own in texts:
        v = ratios[own]
        values.append((v / max(np.linalg.norm(v), 1e-9)).astype(np.float32))
    weights, intercept = np.zeros(len(ratios)), 0.0
    alpha = np.zeros(len(texts))
    # The sample holds both classes alike; costs restore their shares.
    drawn = (signs[fitted] > 0).mean()
    cost = COST * np.where(signs > 0, share / max(drawn, 1e-9), (1 - share) / max(1 - drawn, 1e-9))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(fitted):
            own, v, y = texts[i], values[i], signs[i]
            gradient = y * (weights[own] @ v + intercept) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), cost[i])  # norm 1 and the intercept's 1
            step = (new - alpha[i]) * y
            if step:
                weights[own] += step * v
                intercept += step
                alpha[i] = new
    margins = np.array([weights[own] @ v + intercept for own, v in zip(texts, values, strict=True)])
    chosen = held if len(set(signs[held].tolist())) == 2 else np.ones(len(texts), bool)
    slope, shift = _curve(margins[chosen], (signs[chosen] > 0).astype(float), share)
    return Model(weights * ratios, ratios * ratios, float(intercept), slope, shift)


def _curve(margin: np.ndarray, target: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic curve of the margin by Newton steps."""
    weight = np.where(target > 0, share / max(target.sum(), 1), (1 - share) / max((1 - target).sum(), 1))
    smooth = target * 0.98 + 0.01
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = weight * (p - smooth)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        hessian = np.array([[(h * margin * margin).sum(), (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        gradient = np.array([(g * margin).sum() + 1e-4 * (a - 1), g.sum() + 1e-4 * b])
        step = np.linalg.solve(hessian + 1e-4 * np.eye(2), gradient)
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``score`` between 0 and 1 for every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, data, at in slices(batches, limit=SLICE_BYTES):
            margins = np.fromiter((model.margin(own) for own in features(data, at)), float, rows.num_rows)
            yield table(_SCORES, doc_id=rows.column("doc_id"), score=model.score(margins))

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, score double")


def accepted(documents: DataFrame, model: Model, *, least: float = 0.5) -> DataFrame:
    """The rows whose text scores ``least`` or more, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, data, at in slices(batches, limit=SLICE_BYTES):
            margins = np.fromiter((model.margin(own) for own in features(data, at)), float, rows.num_rows)
            yield rows.filter(pa.array(model.score(margins) >= least))

    return documents.mapInArrow(run, documents.schema)


def held_out(doc_id: Column) -> Column:
    """A third of the ids, by the CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1
