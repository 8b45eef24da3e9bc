"""Quality classifier: Naive Bayes log-count ratios scale n-gram indicators for a linear hinge-loss model.

Indicators are byte 2- and 3-grams and word 1- to 3-grams, in which a word equal
to the one before it is written as one repeat mark.  Their log-count ratios r
between the two classes scale them; the scaled vectors have unit length; dual
coordinate descent fits the hinge loss, each class weighing the same in total;
a sigmoid fitted on rows the descent did not see turns margins into scores.

The model is fitted in one task on at most ``max_rows`` labelled rows, picked by
a hash of their id.  The sample's labels are broadcast (``max_rows`` rows), so
texts are never shuffled.  Scoring reads every whole text once.

Nulls and edge cases: a null text counts as empty, an empty text scores by the
intercept alone; a null id is not held out and has no label; ids whose labels
disagree, null labels and labels without a document are left out of the fit; of
documents that repeat a labelled id the one with the largest indicator list is
learned; without two classes every score is the share of label 1 (0.5 without
labels); an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from statloom.llm.common import text_bytes

HASH_BITS = 17
PAIR_BASE = 0
TRIPLE_BASE = 1 << 16
WORD_BASE = TRIPLE_BASE + (1 << HASH_BITS)
DIMS = WORD_BASE + (1 << HASH_BITS)
REPEAT = 0x9E3779B1
FOLDS, HELD_FOLD = 4, 2


def indicators(text: bytes, mask: np.ndarray) -> np.ndarray:
    """Sorted feature numbers present in a text; ``mask`` is a scratch array of DIMS false values."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    pairs = (raw[:-1] << 8) | raw[1:]
    mask[pairs] = True
    if len(raw) > 2:
        triples = ((pairs[:-1] << 8) | raw[2:]) * np.uint32(2654435761)
        mask[TRIPLE_BASE + (triples >> np.uint32(32 - HASH_BITS))] = True
    words = text.split()
    if words:
        codes = np.fromiter(map(crc32, words), np.uint32, len(words))
        codes[1:][codes[1:] == codes[:-1]] = REPEAT
        gram = codes
        for order in range(3):
            mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(2246822519 + 2 * order)
            mask[WORD_BASE + (mixed >> np.uint32(32 - HASH_BITS))] = True
            if len(gram) < 2:
                break
            gram = gram[:-1] * np.uint32(31) + codes[order + 1 :]
    found = np.flatnonzero(mask)
    mask[found] = False
    return found


@dataclass
class Model:
    """score = sigmoid(slope * (weights . x / |ratios on x| + intercept) + offset)."""

    weights: np.ndarray
    ratios: np.ndarray
    intercept: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(np.square(self.ratios[found], dtype=np.float64).sum()))
        return float(self.weights[found].sum(dtype=np.float64)) / max(length, 1e-12) + self.intercept

    def score(self, found: np.ndarray) -> float:
        z = self.slope * self.margin(found) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.ones((2, DIMS))
    for found, label in zip(rows, labels):
        counts[label][found] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of the hinge loss; one dual variable is optimised at a time within its box.

    Row i is the unit vector along ``scale`` on the features in ``rows[i]``; it is
    gathered when it is needed, so only the feature numbers are held.
    """
    signs = np.where(labels == 1, 1.0, -1.0)
    boxes = cost * len(labels) / 2 / np.where(labels == 1, max(1, (labels == 1).sum()), max(1, (labels == 0).sum()))
    weights, intercept = np.zeros(DIMS), 0.0
    duals = np.zeros(len(labels))
    lengths = np.array([max(float(np.sqrt(scale[r] @ scale[r])), 1e-12) for r in rows])
    curvature = np.array([float(scale[r] @ scale[r]) for r in rows]) / lengths**2 + 1.0
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(labels)):
            value = scale[rows[i]] / lengths[i]
            gradient = signs[i] * (weights[rows[i]] @ value + intercept) - 1
            new = min(max(duals[i] - gradient / curvature[i], 0.0), boxes[i])
            if new != duals[i]:
                step = (new - duals[i]) * signs[i]
                weights[rows[i]] += step * value
                intercept += step
                moved = max(moved, abs(step))
                duals[i] = new
        if moved < 1e-3:
            break
    return weights, intercept


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the smoothed-target logistic loss by Newton steps with halving."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    at = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    design = np.column_stack([margins, np.ones(len(margins))])

    def loss(p):
        z = design @ p
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -500, 500)))
        gradient = design.T @ (p - target)
        if np.abs(gradient).max() < 1e-6:
            break
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-8 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
    return float(at[0]), float(at[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 10) -> Model:
    """The model of given indicator rows; every fifth row of each class is kept for the sigmoid."""
    flat = Model(np.zeros(DIMS, np.float32), np.zeros(DIMS, np.float32), 0.0, 0.0, 0.0)
    share = float(labels.mean()) if len(labels) else 0.5
    if min((labels == 1).sum(), (labels == 0).sum()) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        flat.offset = float(np.log(share / (1 - share)))
        return flat
    place = np.zeros(len(labels), np.int64)
    for c in (0, 1):
        place[labels == c] = np.arange((labels == c).sum())
    later = place % 5 == 1
    learn = [r for r, x in zip(rows, later) if not x]
    ratios = log_count_ratios(learn, labels[~later])
    weights, intercept = dual_descent(learn, ratios, labels[~later], cost, rounds)
    model = Model((weights * ratios).astype(np.float32), ratios.astype(np.float32), intercept, 1.0, 0.0)
    held = np.array([model.margin(r) for r, x in zip(rows, later) if x])
    model.slope, model.offset = sigmoid_fit(held, labels[later])
    return model


def is_held_out(id_col: str) -> Column:
    fold = F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_FOLD, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found, label) of at most ``max_rows`` labelled documents outside the held-out fold."""
    agreed = (
        labels.select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~is_held_out("label_id"))
        .groupBy("label_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("label_id", "label")
    )
    picked = agreed.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)  # the bound of the broadcast below
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(text_col).alias("text"))
    chosen = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))

    @pandas_udf("binary")
    def found(column: pd.Series) -> pd.Series:
        mask = np.zeros(DIMS, bool)
        return pd.Series([indicators(t, mask).astype("<u4").tobytes() for t in column])

    best = chosen.select("doc_id", F.struct(found("text").alias("found"), "label").alias("row")).groupBy("doc_id").agg(F.max("row").alias("row"))
    return best.select("doc_id", "row.found", "row.label")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 12_000, **columns) -> Model:
    """A model fitted in one task on the bounded sample; only its arrays of DIMS numbers come back."""

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        rows = [np.frombuffer(f, "<u4") for f in frame["found"]]
        m = fit_rows(rows, frame["label"].to_numpy(np.int64))
        return pd.DataFrame([(m.weights.tobytes(), m.ratios.tobytes(), m.intercept, m.slope, m.offset)], columns=["w", "r", "b", "s", "o"])

    sample = training_sample(docs, labels, label_col, max_rows, **columns)
    models = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(train, "w binary, r binary, b double, s double, o double").collect()
    if not models:
        return fit_rows([], np.zeros(0, np.int64))
    row = models[0]
    return Model(np.frombuffer(row["w"], np.float32), np.frombuffer(row["r"], np.float32), row["b"], row["s"], row["o"])


def score_column(model: Model, docs: DataFrame, text_col: str = "text") -> Column:
    """Score of every whole text; the model is a broadcast of fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        mask = np.zeros(DIMS, bool)
        return pd.Series([sent.value.score(indicators(t, mask)) for t in texts], dtype=float)

    return score(text_bytes(text_col))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit_options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, **fit_options)
    scored = docs.select(F.col("`doc_id`"), is_held_out("doc_id").alias("held_out"), score_column(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents the classifier accepts, all their columns as they were."""
    model = fit(docs, labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), score_column(model, docs).alias("score")).where(F.col("score") >= threshold).select("row.*")
