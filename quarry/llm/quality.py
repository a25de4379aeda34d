"""Operator 6, quality classifier: regularised quadratic discriminant over document statistics.

One pass turns each whole text into a short vector of transformed statistics.
Class means and covariances are sums over the labelled training rows, taken
by one grouped aggregate; the covariances are shrunk towards their pool and
towards a multiple of the identity, and factored once (Cholesky).  The score is
the logistic of the difference of the two class log densities plus the log
odds of the classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_fold, scratch_table, text_or_empty

FEATURES = ["log_words", "word_len", "distinct", "repeated", "upper", "digit", "stop", "bang", "symbol", "bar", "line_len", "line_repeat"]
POOLING, RIDGE = 0.15, 0.02  # shares of the pooled covariance and of the identity


def _rate(part: float, whole: float) -> float:
    return float(np.log((part + 0.1) / (whole + 10.0)))


def text_statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text, all finite; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=128)
    lines = raw.split(b"\n")
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), float(np.log1p(size / max(n, 1))),
        float(np.log((len(set(words)) + 1.0) / (n + 1.0))) / (1.0 + float(np.log1p(n))), _rate(repeated, n),
        _rate(byte[65:91].sum(), size), _rate(byte[48:58].sum(), size),
        _rate(byte[44] + byte[46], n), _rate(byte[33] + byte[63], n),
        _rate(byte[35:39].sum() + byte[42] + byte[64] + byte[94] + byte[126], n), _rate(byte[124], n),
        float(np.log1p(n / len(lines))), _rate(len(lines) - len(set(lines)), len(lines)),
    ]


def statistics_column(text):
    @F.pandas_udf("array<double>")
    def statistics(texts: pd.Series) -> pd.Series:
        return pd.Series([text_statistics(t) for t in texts])
    return statistics(text)


@dataclass
class Discriminant:
    """Two Gaussian classes; ``whiten[c]`` is the inverse Cholesky factor of class c's shrunk covariance."""
    log_odds: float
    mean: np.ndarray | None = None
    whiten: np.ndarray | None = None
    log_det: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.log_odds)
        if self.mean is not None:
            density = []
            for c in (0, 1):
                y = (x - self.mean[c]) @ self.whiten[c].T
                density.append(-0.5 * (y * y).sum(axis=1) - self.log_det[c])
            z = z + density[1] - density[0]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit_discriminant(labelled: DataFrame, stats: str = "stats", label: str = "label") -> Discriminant:
    """Fit on ``labelled(stats array<double>, label 0/1)``; one row per class reaches the driver.

    Without rows of either class the score is the smoothed share of class 1.
    """
    d = len(FEATURES)
    sums = [F.sum(F.col(stats)[i]).alias(f"s{i}") for i in range(d)]
    prods = [F.sum(F.col(stats)[i] * F.col(stats)[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = {r["label"]: r for r in labelled.select(stats, F.col(label).alias("label")).filter("label in (0, 1)")
            .groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *prods).collect()}
    n = np.array([rows[c]["n"] if c in rows else 0 for c in (0, 1)], dtype=float)
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return Discriminant(odds)
    mean = np.array([[rows[c][f"s{i}"] for i in range(d)] for c in (0, 1)]) / n[:, None]
    cov = np.empty((2, d, d))
    for c in (0, 1):
        for i in range(d):
            for j in range(i, d):
                cov[c, i, j] = cov[c, j, i] = rows[c][f"p{i}_{j}"] / n[c] - mean[c, i] * mean[c, j]
    pool = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    scale = np.trace(pool) / d + 1e-9
    whiten, log_det = [], []
    for c in (0, 1):
        mix = POOLING + (1 - POOLING) * d / (d + n[c])  # small classes lean on the pool
        s = (1 - RIDGE) * ((1 - mix) * cov[c] + mix * pool) + RIDGE * scale * np.eye(d)
        low = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(low))
        log_det.append(np.log(np.diag(low)).sum())
    return Discriminant(odds, mean, np.array(whiten), np.array(log_det))


def score_column(model: Discriminant, stats: str):
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), dtype=float).reshape(len(x), len(FEATURES))))
    return score(F.col(stats))


def training_rows(stats: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """Statistics of the labelled rows outside the held-out fold; null labels are left out, repeated ones count each."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label in (0, 1)")
    return stats.filter("not held_out").join(lab, "id").select("stats", "label")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality") -> tuple[DataFrame, Discriminant]:
    """(id, held_out, score) per row, and the model.

    Labels are learned from rows whose crc32 fold is not 1.  Null and empty
    texts are scored on their (constant) statistics; repeated rows are scored
    each; an empty table gives an empty result.  Other columns are not read.
    """
    stats = scratch_table(docs.select(F.col(id_col).alias("id"), (crc_fold(id_col) == 1).alias("held_out"),
                                      statistics_column(text_or_empty(text_col)).alias("stats")), "stats")
    model = fit_discriminant(training_rows(stats, labels, label_col, id_col))
    return stats.select("id", "held_out", score_column(model, "stats").alias("score")), model


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; columns unchanged, no shuffle of texts."""
    _, model = quality_scores(docs, labels, id_col, text_col, label_col)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), text_or_empty(text_col).alias("text"))
    scored = packed.select("row", statistics_column(F.col("text")).alias("stats"))
    kept = scored.select("row", score_column(model, "stats").alias("score")).filter(F.col("score") >= threshold)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored, _ = quality_scores(docs, labels)
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
