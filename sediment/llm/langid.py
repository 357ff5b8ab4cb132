"""Language identification by averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its subwords (character n-grams of lower-cased letters that see word ends); a
linear softmax reads the language off this mean. Both are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled rows. A temperature fitted on rows kept aside makes the score a probability. Texts are
rejected by the margin between their first two languages before the softmax, which does not round to one where languages
are told apart without error: it has to reach nearly what the right ones of about their length had among the rows kept
aside, whole or in stretches. A short text is held to what a stretch tells, so that of a few words in a language that was
not learned many pass. A model of one language scores each text 1 and rejects none that has a letter. As the mean is
linear, prediction adds up one small vector a subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.llm.common import lean, slices
from sediment.llm.ngrams import buckets, chunks, joined

#: n-gram orders, hash bits, embedding width.
ORDERS, BITS, WIDTH = (1, 2, 3, 4), 15, 16
#: Labelled rows of each language that the model is fitted on at most, and of all; many languages have fewer each, but
#: one at least.
ROWS_PER_LANGUAGE, ROWS = 600, 60_000
#: Share of right predictions on the rows kept aside that may be rejected, and how much of the margin that they reach is
#: asked of other texts.
REJECTED, LENIENT = 0.001, 0.9
#: Temperatures to choose from: rows that are told apart without error would choose ever lower ones.
TEMPERATURES = 2.0 ** np.arange(-1, 3.1, 0.25)
UNDETERMINED = "und"
#: Lengths in code points that texts are held to one threshold below; stretches to train and to calibrate on.
LENGTHS, STRETCHES, CALIBRATED = (20, 50, 150, 600), (12, 30, 80), (12, 30, 80, 300)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    thresholds: np.ndarray  # least margin for each range of lengths


#: Blanks behind a text, of which only the first begins n-grams: none reaches into the next text.
_GAP = max(ORDERS)


def _means(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` over each text's n-grams."""
    out = np.zeros((len(texts), table.shape[1]), np.float64)
    for a, b in chunks(texts, 400_000):
        data, starts = joined(texts[a:b], _GAP)
        ends = starts[1:] - (_GAP - 1)
        edges = np.stack([starts[:-1], ends], axis=1).ravel()
        for order in ORDERS:
            at = buckets(data, order, BITS)
            for k in range(table.shape[1]):
                out[a:b, k] += np.add.reduceat(np.append(table[:, k][at], np.float32(0)), edges, dtype=np.float64)[::2]
        out[a:b] /= (ends - starts[:-1])[:, None] * len(ORDERS)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pieces(texts: list[str], labels: np.ndarray, rng, stretches: tuple[int, ...] = STRETCHES) -> tuple[list[str], np.ndarray]:
    """The texts and, of each, some short stretches anywhere in it: short texts must be told as well."""
    out, of = list(texts), list(labels)
    for t, y in zip(texts, labels, strict=True):
        for n in stretches:
            at = int(rng.integers(0, max(1, len(t) - n)))
            if any(c.isalpha() for c in t[at : at + n]):
                out.append(t[at : at + n])
                of.append(y)
    return out, np.array(of)


def fit(texts: list[str], languages: list[str], epochs: int = 4, seed: int = 1) -> Model | None:
    """Fit a model on labelled texts; None without any. One language alone is always predicted."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in languages])
    order = rng.permutation(len(texts))
    aside = order[: len(order) // 5] if len(order) >= 20 else order
    train = order[len(order) // 5 :] if len(order) >= 20 else order
    x, label = _pieces([texts[i] for i in train], y[train], rng)
    table = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    w, b = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    counts = np.maximum(1, np.bincount(label, minlength=len(names)))
    weight = (len(label) / len(names) / counts).clip(0, 10).astype(np.float32)
    docs = []
    for t in x:
        data, _ = joined([t], _GAP)
        ids = np.concatenate([buckets(data, o, BITS)[: len(data) - _GAP + 1] for o in ORDERS])
        docs.append(np.unique(ids, return_counts=True))
    steps, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rate = 0.5 * (1 - steps / total) + 0.01
            steps += 1
            ids, n = docs[i]
            share = (n / n.sum()).astype(np.float32)
            mean = share @ table[ids]
            p = _softmax((mean @ w + b)[None])[0]
            p[label[i]] -= 1
            g = p * weight[label[i]]
            up = w @ g
            w -= rate * np.outer(mean, g)
            b -= rate * 0.1 * g
            # each embedding's step is scaled as if the text had but its distinct subwords once
            table[ids] -= (rate * np.minimum(1, share * len(ids))[:, None]) * up[None]
    model = Model(names, (table @ w).astype(np.float32), b, 1.0, np.zeros(len(LENGTHS) + 1))
    held, right = _pieces([texts[i] for i in aside], y[aside], rng, CALIBRATED)
    z = _logits(held, model)
    fits = [(-np.log(_softmax(z / t)[np.arange(len(right)), right] + 1e-12).mean(), t) for t in TEMPERATURES]
    model.temperature = float(min(fits)[1])
    margin, right_ones, at = _margins(z), z.argmax(axis=1) == right, _lengths(held)
    for k in range(len(LENGTHS) + 1 if len(names) > 1 else 0):
        good = margin[right_ones & (at == k)]
        # no row of this length: as strict as for the next shorter
        model.thresholds[k] = LENIENT * np.quantile(good, REJECTED) if len(good) else model.thresholds[k - 1] if k else 0.0
    return model


def _margins(z: np.ndarray) -> np.ndarray:
    """How far the first language is ahead of the second (of one language alone: without end)."""
    if z.shape[1] < 2:
        return np.full(len(z), np.inf)
    two = np.partition(z, -2, axis=1)
    return two[:, -1] - two[:, -2]


def _lengths(texts: list[str | None]) -> np.ndarray:
    """The range of lengths that each text is in."""
    return np.searchsorted(LENGTHS, [len(t or "") for t in texts], side="right")


def _logits(texts: list[str], model: Model) -> np.ndarray:
    return _means(texts, model.scores) + model.bias


def labelled_sample(rows: DataFrame, label: str, per_label: int, most: int) -> DataFrame:
    """At most ``per_label`` rows of each value of ``label``, and at most about ``most`` of all (one of each value at
    least), chosen by a hash of doc_id, so that neither one label nor a partition counts more than others."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a label
    if not counts:
        return rows.limit(0)
    each = max(1, min(per_label, most // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[label], min(1.0, (2 * each + 50) / r["n"]))])
    lot = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    few = rows.withColumn("_lot", lot).filter(F.col("_lot") / F.lit(float(1 << 30)) < share[F.col(label)])
    first = F.row_number().over(Window.partitionBy(label).orderBy("_lot", "doc_id"))
    return few.withColumn("_first", first).filter(F.col("_first") <= each).drop("_lot", "_first")


def fold(id_: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null id: null)."""
    return F.crc32(id_.cast("string").cast("binary")) % F.lit(parts)


def fit_on(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on the rows of ``docs`` that have a text and a language and are not held out (remainder 1 of 3): a sample of
    at most ``per_language`` rows of each language. Rows without an id are left out, rows that share one count each; a table
    without labelled rows gives None."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    found = sorted(labelled_sample(rows, "lang", per_language, ROWS).select("doc_id", "lang", "text").collect())
    return fit([r["text"] for r in found], [r["lang"] for r in found])


def predictions(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether the text is rejected, for each text."""
    if model is None or not texts:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    z = _logits(texts, model)
    p = _softmax(z / model.temperature)
    blank = np.array([not t or not any(c.isalpha() for c in t) for t in texts], bool)
    score = np.where(blank, 0.0, p.max(axis=1))
    names = [UNDETERMINED if x else model.languages[k] for x, k in zip(blank.tolist(), p.argmax(axis=1).tolist(), strict=True)]
    return names, score, blank | (_margins(z) < model.thresholds[_lengths(texts)])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row of ``docs``, from its whole text alone.

    A null text or one without a letter is ``und``, scored 0 and rejected, and so is every text without a model (no
    labelled row to learn from); a text whose margin is below the threshold calibrated for its length keeps its prediction
    and is marked as rejected. Repeated rows are predicted each for itself, a null id is never held out, other columns are
    ignored, an empty table gives an empty result.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(F.col(id_col), 3) == 1, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some MB: buckets x languages, both bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, score, rejected = predictions(part.column(2).to_pylist(), shared.value)
                columns = [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model doesn't reject. Null texts and those without a letter
    are rejected, all texts where there is no model; repeated rows are judged each for itself."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                _, _, rejected = predictions(part.column(at).to_pylist(), shared.value)
                yield part.filter(pa.array(~rejected, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
