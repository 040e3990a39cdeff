"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good documents, all documents are the unlabelled
text. With the logistic loss the unbiased risk is
`-prior * E_pos[w.x] + E_all[log(1 + exp(w.x))]`: convex, minimised by Newton
steps whose sums Spark forms over all rows. The part of the risk that stands for
bad documents, `E_all[log(1 + exp(w.x))] - prior * E_pos[log(1 + exp(w.x))]`,
cannot be negative; a step that makes it so is overfitted and is halved. The class
prior is the share of good ones among the labels to learn from, or given.

Features are shares of characters and words computed from whole texts; labels,
language, source and id are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.llm.blocks import NOT_SPACE, shingle_sets, text_blocks, words_of
from visitframe.session import stage


def _classes() -> np.ndarray:
    """A class for every byte: each lower-case letter and ASCII sign its own, then capitals, digits, blanks, the rest."""
    c = np.full(256, 63, np.int64)  # outside ASCII
    c[:32], c[127] = 62, 62
    for i, b in enumerate(range(97, 123)):
        c[b] = i
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    for i, b in enumerate(signs):
        c[b] = 26 + i
    c[65:91], c[48:58], c[32], c[10] = 58, 59, 60, 61
    return c


BYTE_CLASS = _classes()
N_CLASSES = 64
EXTRA = ["log_bytes", "log_words", "word_length", "distinct_words", "distinct_triples", "repeats", "capital_words", "sign_ends", "lines"]
WIDTH = N_CLASSES + len(EXTRA)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """float32 rows of WIDTH numbers for the texts of a block."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(rows), size)
    counts = np.bincount(row * N_CLASSES + BYTE_CLASS[data], minlength=rows * N_CLASSES).reshape(rows, N_CLASSES)
    x = np.zeros((rows, WIDTH), np.float32)
    x[:, :N_CLASSES] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    w = words_of(data, offsets, NOT_SPACE)
    n = w.count
    per = np.maximum(n, 1)
    of = w.row_of()

    def share(flags):
        return np.bincount(of, weights=flags, minlength=rows) / per

    same = np.zeros(len(of), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
    first, last = data[w.start] if len(of) else data[:0], data[w.end - 1] if len(of) else data[:0]
    capital = (first >= 65) & (first <= 90) & (last != first)
    sign = (BYTE_CLASS[last] >= 26) & (BYTE_CLASS[last] < 58) & ~np.isin(last, np.frombuffer(b".,;:?", np.uint8))
    distinct = [np.diff(shingle_sets(w, k)[1]) / np.maximum(n - k + 1, 1) for k in (1, 3)]
    lines = np.bincount(row[data == 10], minlength=rows) + 1
    x[:, N_CLASSES:] = np.stack([np.log1p(size), np.log1p(n), np.log1p(share((w.end - w.start).astype(float))), distinct[0], distinct[1], share(same),
                                 share(capital), share(sign), np.log1p(n / lines)], 1)
    x[size == 0] = 0
    return x


def _feature_task(batches):
    for batch in batches:
        for lo, hi, data, offsets in text_blocks(batch.column(1)):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))],
                                             names=["doc_id", "x"])


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(_feature_task, f"doc_id {kind}, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def _summed(df: DataFrame, block) -> np.ndarray:
    """Sum over all rows of the vectors `block(x, positive)` gives per batch; each task sends one vector, Spark adds them up."""
    def task(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + block(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    rows = df.select("x", "positive").mapInArrow(task, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for i, v in rows:
        out[i] = v
    return out


@dataclass
class Model:
    """Linear score on standardised features."""

    mean: np.ndarray
    sd: np.ndarray
    weight: np.ndarray  # bias first
    prior: float
    settled: bool = True

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x.astype(np.float64) - self.mean) / self.sd, -10, 10)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weight[0] + self.inputs(x) @ self.weight[1:])


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_pu(rows: DataFrame, prior: float, ridge: float = 0.1, max_steps: int = 40, tol: float = 1e-4) -> Model:
    """Fit on rows (x, positive): `positive` marks trusted positives, every row is unlabelled text as well.

    Without rows or positives the model scores every text with the prior. If `max_steps` do not
    suffice, the model has the weights of the lowest risk met and says so in `settled`.
    """
    def moments(x, positive):
        x = x.astype(np.float64)
        return np.concatenate([[len(x), positive.sum()], x.sum(0), (x * x).sum(0)])

    s = _summed(rows, moments)
    bias = np.log(prior / (1 - prior))
    empty = Model(np.zeros(WIDTH), np.ones(WIDTH), np.concatenate([[bias], np.zeros(WIDTH)]), prior)
    if not len(s) or not s[1]:
        return empty
    n, n_pos, mean = s[0], s[1], s[2: 2 + WIDTH] / s[0]
    sd = np.sqrt(np.maximum(s[2 + WIDTH:] / n - mean**2, 0))
    sd[sd < 1e-6] = 1.0
    model, d = Model(mean, sd, empty.weight.copy(), prior), WIDTH + 1

    def sums(weight):
        def block(x, positive):
            x = np.concatenate([np.ones((len(x), 1)), model.inputs(x)], 1)
            z = x @ weight
            p, soft = _sigmoid(z), _soft(z)
            hess = (x * (p * (1 - p))[:, None]).T @ x
            return np.concatenate([[soft.sum(), soft[positive].sum(), z[positive].sum()], x.T @ p, x[positive].sum(0), hess.ravel()])
        return block

    keep = np.concatenate([[0.0], np.full(WIDTH, ridge)])  # the bias is not shrunk
    weight, last, bound = model.weight, None, False
    for _ in range(max_steps):
        s = _summed(rows, sums(weight))
        soft_all, soft_pos, z_pos = s[0] / n, s[1] / n_pos, s[2] / n_pos
        risk = soft_all - prior * z_pos + 0.5 * (keep * weight**2).sum()
        negative = soft_all - prior * soft_pos < 0
        if last is not None and (negative or risk > last[1] + 1e-12) and np.abs(weight - last[0]).max() >= tol:
            bound |= negative
            weight = (weight + last[0]) / 2
            continue
        gradient = s[3: 3 + d] / n - prior * s[3 + d: 3 + 2 * d] / n_pos + keep * weight
        step = np.linalg.solve(s[3 + 2 * d:].reshape(d, d) / n + np.diag(keep + 1e-9), gradient)
        last = (weight, risk)
        if bound or np.abs(gradient @ step) < tol:  # the non-negative part is used up, or the minimum is reached
            break
        weight = weight - step
    else:
        model.settled = False
    model.weight = last[0]
    return model


def held_out(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id, good for the ids whose labels may be learnt from.

    Several labels of one id count by their mean, 0.5 and more being good; null labels and ids count for nothing.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    return (known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg((F.avg("y") >= 0.5).alias("good")))


def fit_quality(features_: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Fit on staged features (doc_id, x) and training labels (doc_id, good)."""
    if prior is None:
        r = labels.agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("g")).first()
        prior = ((r["g"] or 0) + 1) / (r["n"] + 2)
    marked = features_.join(labels, "doc_id", "left").select("x", F.coalesce("good", F.lit(False)).alias("positive"))
    return fit_pu(stage(marked, "quality-rows"), prior)


def score_quality(docs: DataFrame, labels: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Null and empty texts have all features 0. Repeated rows are scored alike; a null id is scored and is not held out.
    """
    rows = stage(document_features(docs, id_col, text_col), "quality-features")
    model = fit_quality(rows, training_labels(labels, id_col, label_col), prior)

    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(task, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, prior: float | None = None) -> DataFrame:
    """Rows of `docs` (doc_id, text, ...) with a score of `least` or more, all columns as they are.

    The texts are read once to fit and once to filter; no row of text is shuffled.
    """
    model = fit_quality(stage(document_features(docs), "quality-features"), training_labels(labels), prior)
    place = docs.columns.index("text")

    def task(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(place)):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.score(features(data, offsets)) >= least))

    return docs.mapInArrow(task, docs.schema)
