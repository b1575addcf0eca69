"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A text is described by a few statistics. Cosines of random projections of them approximate a Gaussian kernel; the
normal equations of ridge regression on these features are summed over partitions, in a tree, and solved at once. On a
fifth of the labelled rows, which the regression doesn't see, isotonic regression makes its scores probabilities.

Cases: a null text is an empty one and has a score as any other; rows with a null label or doc_id aren't learned from,
repeated rows count each; without labelled rows all scores are 0.5; an empty table gives an empty one; other columns
of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, text_slices, tree_sum, utf8, written
from .quality_rules import Measures

#: Cosines, seed of the projections, ridge penalty, steps of the calibration.
FEATURES, SEED, RIDGE, STEPS = 256, 7, 1.0, 1024
NAMES = ("words", "word_length", "symbols", "capitals", "dup_lines", "repeated", "top_word", "lines", "bangs", "digits", "bars", "beyond_ascii", "distinct", "stutter", "stops")


def statistics(raw: bytes) -> list[float]:
    m = Measures(raw)
    n, chars, size, words = max(1, m.n_words), max(1, m.word_chars), max(1, len(raw)), m.words
    share = lambda k, of, top=1.0: min(k / of, top)
    return [
        np.log1p(m.n_words), share(m.word_chars, n, 40), share(m.n_symbols, n, 4), share(m.n_capitals, chars), share(m.n_dup_lines, max(1, m.lines[0])),
        share(m.n_repeat_words, n), share(m.top_word, n), np.log1p(m.lines[0]), share(raw.count(b"!"), n, 4), share(len(raw) - len(raw.translate(None, b"0123456789")), size),
        share(raw.count(b"|"), n, 2), share(len(raw) - len(raw.translate(None, bytes(range(128, 256)))), size), share(len(set(words)), n), share(sum(map(bytes.__eq__, words, words[1:])), n), share(raw.count(b"."), n, 2),
    ]


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and stats (array of double, as NAMES) of each row."""

    def run(batches):
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(x) for x in utf8(batch.column(1))], pa.list_(pa.float64()))], ["doc_id", "stats"])

    df = id_and_text(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, stats array<double>")


@dataclass
class Model:
    """mean and scale of the statistics, weights of the features, and the calibration's points; no weights: nothing known."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    points: tuple[np.ndarray, np.ndarray] | None = None
    features: int = FEATURES
    seed: int = SEED

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        """Rows of features and a last one of 1; projections follow from the seed."""
        rng = np.random.default_rng(self.seed)
        d = len(self.mean)
        w, b = rng.standard_normal((d, self.features)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, self.features)
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        return np.column_stack([np.sqrt(2 / self.features) * np.cos(x @ w + b), np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = np.clip(self.raw(stats), 0, 1)
        # A thousandth of the uncalibrated score keeps apart what the calibration joins.
        return np.clip(raw if self.points is None else 0.999 * np.interp(raw, *self.points) + 0.001 * raw, 0, 1)


def isotonic(sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising values nearest to sums / weights, by merging neighbours that fall."""
    blocks: list[list[float]] = []
    for s, w in zip(sums.tolist(), weights.tolist(), strict=True):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + k]
    return np.repeat([s / w for s, w, _ in blocks], [k for *_, k in blocks])


def _stats(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def train(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """The model of labels (id and 0 or 1) over described rows; described is a written table."""
    spread = described.agg(*(f(F.element_at("stats", k + 1)).alias(f"{n}{k}") for k in range(len(NAMES)) for n, f in (("mean", F.avg), ("scale", F.stddev_pop)))).first()
    # Rounded, so that the order in which tasks end leaves no trace.
    model = Model(*(np.array([round(spread[f"{n}{k}"] or 0.0, 9) for k in range(len(NAMES))]) for n in ("mean", "scale")))
    model.scale[model.scale < 1e-6] = 1.0
    own = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("label")).where("doc_id is not null and label is not null")
    rows = written(described.join(own, "doc_id").select("doc_id", "stats", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("calibrates")), "labelled")

    def normal(batches):
        n = model.features + 1
        a, b = np.zeros((n, n)), np.zeros(n)
        for batch in batches:
            z, y = model.cosines(_stats(batch, 0)), batch.column(1).to_numpy()
            a += z.T @ z
            b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel(), b]).tobytes()], pa.binary())], ["sums"])

    total = tree_sum(rows.where("not calibrates").select("stats", "label").mapInArrow(normal, "sums binary"), "sums")
    if total is None or not total.any():
        return model
    n = model.features + 1
    penalty = np.full(n, RIDGE)
    penalty[-1] = 1e-6
    model.weights = np.linalg.solve(total[: n * n].reshape(n, n) + np.diag(penalty), total[n * n :])

    def histogram(batches):
        steps = np.zeros((2, STEPS + 1))
        for batch in batches:
            at = np.round(np.clip(model.raw(_stats(batch, 0)), 0, 1) * STEPS).astype(np.int64)
            np.add.at(steps[0], at, batch.column(1).to_numpy())
            np.add.at(steps[1], at, 1)
        at = np.flatnonzero(steps[1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(steps[0, at]), pa.array(steps[1, at])], ["step", "label", "n"])

    # One row for each step at most.
    seen = sorted(rows.where("calibrates").select("stats", "label").mapInArrow(histogram, "step int, label double, n double").groupBy("step").agg(F.sum("label").alias("label"), F.sum("n").alias("n")).collect())
    if seen:
        step, label, weight = np.array([tuple(r) for r in seen], float).T
        model.points = step / STEPS, isotonic(label, weight)
    return model


def score(described: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5) of each row."""

    def run(batches):
        for batch in batches:
            own = model.scores(_stats(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array((own >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return described.select("doc_id", "stats").mapInArrow(run, f"doc_id {described.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, score and predicted of each row of docs, learned from all rows of labels."""
    described = written(describe(docs, id_col, text_col), "stats")
    return score(described, train(described, labels, id_col, label_col))
