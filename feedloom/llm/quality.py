"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import map_arrow, written

FEATURES = (
    "words", "word_length", "distinct", "follows_itself", "symbols", "shouts", "digits", "capitals",
    "stops", "commas", "line_words", "line_ends", "same_lines",
)
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
#: Shares are told apart down to about one in a thousand.
FLOOR = 1e-3


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a text: logarithms of sizes, and of shares over FLOOR."""
    text = text or ""
    raw = text.encode()
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, size, rows = len(words), max(len(raw), 1), max(len(lines), 1)

    def share(count: float, of: float) -> float:
        return math.log(count / of + FLOOR)

    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    return [
        math.log1p(n),
        math.log1p(len(text) / max(n, 1)),
        math.log1p(len(set(words))) / math.log1p(n) if n else 1.0,
        share(sum(map(eq, words, words[1:])), max(n, 1)),
        share(symbols, size),
        share(raw.count(b"!") + raw.count(b"?"), size),
        share(size - len(raw.translate(None, _DIGITS)) if raw else 0, size),
        share(len(raw) - len(raw.translate(None, _CAPITALS)), size),
        share(raw.count(b"."), max(n, 1)),
        share(raw.count(b","), max(n, 1)),
        math.log1p(n / rows),
        share(sum(x.rstrip().endswith((".", "!", "?", '"', "…")) for x in lines), rows),
        share(len(lines) - len(set(lines)), rows),
    ]


def features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and ``x``, the statistics of each text; NULL counts as empty."""

    def rows(batches: Iterator[list]):
        for (texts,) in batches:
            yield [[statistics(t) for t in texts.to_pylist()]], None

    return map_arrow(df, [text], list(keep), "x array<double>", rows)


def moments(labelled: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``x`` for each ``label`` (0 or 1).

    Each task adds up its rows; the tables are a few numbers each and meet in one row a
    label, whatever the number of rows.
    """
    d = len(FEATURES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: [0, np.zeros(d), np.zeros((d, d))] for k in (0, 1)}
        for batch in batches:
            label = batch["label"].to_numpy(zero_copy_only=False)
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k, s in sums.items():
                own = x[label == k]
                s[0] += len(own)
                s[1] += own.sum(0)
                s[2] += own.T @ own
        flat = [(k, i, v) for k, (n, a, b) in sums.items() if n for i, v in enumerate([n, *a, *b.ravel()])]
        if flat:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*flat), (pa.int32(), pa.int32(), pa.float64()))],
                names=["label", "i", "v"],
            )

    parts = labelled.select("label", "x").mapInArrow(add, "label int, i int, v double")
    out = {}
    # at most 2 * (1 + d + d * d) rows
    for label, i, v in parts.groupBy("label", "i").agg(F.sum("v")).collect():
        out.setdefault(label, np.zeros(1 + d + d * d))[i] = v
    return {k: (int(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d)) for k, v in out.items()}


class Discriminant:
    """One Gaussian a class, on standardised statistics.

    A class's covariance is shrunk towards the pooled one by ``shrinkage`` and that towards
    the identity by ``ridge``; its Cholesky factor's inverse and log determinant are kept.
    """

    def __init__(self, sums: dict, shrinkage: float = 0.3, ridge: float = 0.1):
        self.classes: dict[int, tuple] = {}
        d = len(FEATURES)
        n = sum(s[0] for s in sums.values())
        self.prior = {k: s[0] / n for k, s in sums.items()} if n else {}
        if len(sums) < 2:
            return
        total = sum(s[1] for s in sums.values()) / n
        spread = np.sqrt(np.maximum(np.diag(sum(s[2] for s in sums.values())) / n - total**2, 1e-12))
        self.centre, self.spread = total, spread
        own = {}
        for k, (m, a, b) in sums.items():
            mean = (a / m - total) / spread
            own[k] = mean, (b / m - np.outer(a / m, a / m)) / np.outer(spread, spread)
        pooled = sum(self.prior[k] * c for k, (_, c) in own.items())
        pooled = (1 - ridge) * pooled + ridge * np.eye(d)
        for k, (mean, cov) in own.items():
            m = sums[k][0]
            lam = max(shrinkage, d / (m + d))  # few rows lean on the pooled covariance
            factor = np.linalg.cholesky((1 - lam) * cov + lam * pooled)
            inverse = np.linalg.inv(factor)
            self.classes[k] = mean, inverse, math.log(self.prior[k]) - np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1. With one label learned it is sure; with none, 0.5."""
        if not self.classes:
            return np.full(len(x), float(self.prior.get(1, 0.0)) if self.prior else 0.5)
        z = (x - self.centre) / self.spread
        log = {}
        for k, (mean, inverse, constant) in self.classes.items():
            log[k] = constant - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def classify(
    documents: DataFrame,
    labels: DataFrame,
    learn_from,
    threshold: float = 0.3,
    text: str = "text",
    id: str = "doc_id",
    label: str = "quality",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id``, kept columns, ``score`` (0 to 1) and ``predicted`` for every document.

    ``learn_from`` is a condition on ``id``: labelled documents that meet it are learned
    from, all of them. Scores see the text only; NULL or empty texts have one too. Labels
    that are not 0 or 1 are ignored; each row of a repeated id counts, also with a label of
    its own. Without labels every score is 0.5, with one label learned it is that label.
    """
    keep = [c for c in keep if c not in (id, "score", "predicted", "x")]
    table = written(features(documents, text, (id, *keep)), "quality-features")
    known = labels.select(F.col(id), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & learn_from)
    model = Discriminant(moments(table.select(id, "x").join(known, id)))

    def rows(batches: Iterator[list]):
        for (x,) in batches:
            score = model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)))
            yield [pa.array(score), pa.array((score >= threshold).astype(np.int32))], None

    return map_arrow(table, ["x"], [id, *keep], "score double, predicted int", rows)
