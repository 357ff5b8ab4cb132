"""Toxicity scores by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its n-grams (hash buckets). Each n-gram's weight is its log-count ratio between toxic and other
labelled texts times a coefficient that a logistic regression learns over the ratios of the n-grams present. The fit
takes a bounded sample of labelled rows; n-grams whose ratio the labelled texts don't support have no weight, so
scoring looks up the others only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import slices
from sediment.llm.langid import fold
from sediment.llm.ngrams import buckets, chunks, joined

#: n-gram orders and hash bits of each order.
ORDERS, BITS = (4, 5, 6), 20
#: Labelled rows that the model is fitted on at most, and n-grams that can have a weight.
ROWS, FEATURES = 6000, 5000
#: Labelled texts an n-gram must occur in, smoothing of the counts, strength of the L2 penalty.
SUPPORT, SMOOTH, PENALTY = 3, 1.0, 1e-3
#: Standard deviations by which a count must be off for an n-gram to have a weight. The fit takes the one that does best
#: on the fourth of its own rows that it keeps aside for that.
FAR = (3.5, 4.5, 5.5)
THRESHOLD = 0.3


@dataclass
class Model:
    weights: np.ndarray  # of each bucket of each order, one after another; mostly 0
    bias: float


def _present(texts: list[str | None], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct n-gram of each text whose bucket is wanted, sorted."""
    rows, ids = [], []
    for a, b in chunks(texts, 1_000_000):
        data, starts = joined(texts[a:b], max(ORDERS))
        found = []
        for k, order in enumerate(ORDERS):
            at = buckets(data, order, BITS) + (k << BITS)
            place = np.flatnonzero(wanted[at])
            text = np.searchsorted(starts, place, "right") - 1 + a
            found.append(text.astype(np.int64) << 32 | at[place])
        both = np.unique(np.concatenate(found))
        rows.append(both >> 32)
        ids.append(both & 0xFFFFFFFF)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(ids)


def _counts(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and other texts that have each bucket."""
    size = len(ORDERS) << BITS
    p, q = np.zeros(size, np.int32), np.zeros(size, np.int32)
    every = np.ones(size, bool)
    for at in range(0, len(texts), 200):
        rows, ids = _present(texts[at : at + 200], every)
        hit = toxic[at : at + 200][rows] == 1
        p += np.bincount(ids[hit], minlength=size).astype(np.int32)
        q += np.bincount(ids[~hit], minlength=size).astype(np.int32)
    return p, q


def _prior(y: np.ndarray) -> float:
    share = float((y.sum() + 0.5) / (len(y) + 1))
    return float(np.log(share / (1 - share)))


def _chosen(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket the log-count ratio, and by how many standard deviations its counts are off what the shares of both
    kinds would give (0 without support)."""
    p, q = _counts(texts, y)
    n, m = y.sum(), (1 - y).sum()
    ratio = np.log((p + SMOOTH) / (n + 2 * SMOOTH)) - np.log((q + SMOOTH) / (m + 2 * SMOOTH))
    far = (p - (p + q) * n / (n + m)) / np.sqrt((p + q) * n * m / (n + m) ** 2 + 1e-9)
    far[(p + q) < SUPPORT] = 0
    return ratio, far


def _regression(texts: list[str], y: np.ndarray, ratio: np.ndarray, far: np.ndarray, least: float, steps: int) -> Model:
    """Logistic regression over the ratios of the present n-grams that are more than ``least`` off."""
    weights = np.zeros(len(ratio), np.float32)
    chosen = np.sort(np.argsort(-np.abs(far), kind="stable")[:FEATURES])
    chosen = chosen[np.abs(far[chosen]) > least]
    if not len(chosen):
        return Model(weights, _prior(y))
    wanted = np.zeros(len(ratio), bool)
    wanted[chosen] = True
    rows, ids = _present(texts, wanted)
    column = np.searchsorted(chosen, ids)
    value = ratio[ids]
    w, b = np.zeros(len(chosen)), _prior(y)
    first, second, fb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(rows, value * w[column], len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g, gb = np.bincount(column, value * e[rows], len(w)) + PENALTY * w / len(w), e.sum()
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        fb, sb = 0.9 * fb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        rate = 0.02 * (1 - t / (steps + 1))
        w -= rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        b -= rate * fb / (1 - 0.9**t) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    weights[chosen] = ratio[chosen] * w
    return Model(weights, float(b))


def fit(texts: list[str], toxic: list[int], steps: int = 300, seed: int = 3) -> Model:
    """Fit a model. Without both kinds of text every score is the smoothed share of toxic ones."""
    y = np.array(toxic, np.float64)
    if not len(y) or not y.any() or y.all():
        return Model(np.zeros(len(ORDERS) << BITS, np.float32), _prior(y))
    least, order = FAR[1], np.random.default_rng(seed).permutation(len(y))
    aside, rest = order[: len(y) // 4], order[len(y) // 4 :]
    if y[rest].any() and not y[rest].all() and y[aside].any():
        part, own = [texts[i] for i in rest], y[rest]
        ratio, far = _chosen(part, own)
        losses = []
        for f in FAR:
            p = scores([texts[i] for i in aside], _regression(part, own, ratio, far, f, steps)).clip(1e-6, 1 - 1e-6)
            losses.append((-float((y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p)).mean()), f))
        least = min(losses)[1]
    return _regression(texts, y, *_chosen(texts, y), least, steps)


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    rows, ids = _present(texts, model.weights != 0)
    z = np.bincount(rows, model.weights[ids].astype(np.float64), len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a sample, chosen by a hash of the id, of at most ``rows`` labelled rows that are not held out (remainder
    2 of 4); rows without text or label are left out, an id with both labels counts as toxic."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    # one text an id, so the sample is bounded
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in found], [r["toxic"] for r in found])


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, from its whole text alone.

    An empty or null text scores what the bias gives. Repeated rows are scored each for itself, a null id is never held
    out, other columns are ignored, an empty table gives an empty result.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number for each bucket: 12 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = scores(part.column(2).to_pylist(), shared.value)
                columns = [part.column(0), part.column(1), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
