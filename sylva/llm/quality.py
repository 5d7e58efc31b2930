"""Quality classifier: Bradley-Terry pairwise ranking, cut at a score quantile.

A document is a vector of bounded features of its whole text: shares of byte classes and of each
punctuation mark, repeated words, lines and neighbours, lengths of words and lines. Pairs of a preferred
and a less preferred training document teach one weight per feature: the logistic loss on the feature
differences is minimised by Newton steps. The cut is the quantile of the training scores that lets as
many training documents fall as are labelled 0; it is mapped to ``CUT`` on the scale from 0 to 1.

Defined results: a null text is scored as an empty one, which has a vector of its own. Without both kinds
of labels in the training rows all weights are 0, and every document scores ``CUT``. Ties share a score. Repeated rows are scored one by one
alike; repeated labels of an id each count. An empty table gives an empty result. The score is no calibrated probability: a third of the
spread of the training scores is one unit on the logit scale. Very long texts are read whole, in pieces. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import groups_of, map_arrow, pick, pick_with_text, utf8
from sylva.llm.shingles import fold, word_hashes

CUT = 0.7
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_CLASSES = [np.arange(97, 123), np.arange(65, 91), np.arange(48, 58), np.array([32]), np.array([10]), np.arange(128, 256), np.array([i for i in range(32) if i != 10] + [127])]


def _repeats(values: np.ndarray) -> tuple[float, float]:
    """Share of values seen before, and share equal to their predecessor."""
    if len(values) < 2:
        return 0.0, 0.0
    return 1 - len(np.unique(values)) / len(values), float((values[1:] == values[:-1]).mean())


def features(texts: list[bytes]) -> np.ndarray:
    """One row of features for each text."""
    out = []
    for i, j in groups_of(texts):
        group = texts[i:j]
        folded = [fold(t) for t in group]
        joined = b" ".join(folded)
        ends = np.cumsum([len(t) + 1 for t in group])
        starts, words = word_hashes(joined)
        bound = np.concatenate([[0], np.searchsorted(starts, ends)])
        for k, t in enumerate(group):
            own, at = words[bound[k] : bound[k + 1]], starts[bound[k] : bound[k + 1]]
            out.append(_row(t, own, at))
    return np.array(out) if out else np.zeros((0, N_FEATURES))


def _row(text: bytes, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(text)
    counts = np.zeros(256)
    a = np.frombuffer(text, np.uint8)
    for s in range(0, n, 1 << 20):
        counts += np.bincount(a[s : s + (1 << 20)], minlength=256)
    share = counts / max(1, n)
    classes = [share[c].sum() for c in _CLASSES]
    letters = share[97:123].sum() + share[65:91].sum()
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    line_hash = np.array([hash(x) for x in lines], np.int64)
    gaps = np.diff(at) if len(at) > 1 else np.zeros(1)
    seen, same = _repeats(words)
    two, _ = _repeats(words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1]) if len(words) > 2 else (0.0, 0.0)
    line_seen, line_same = _repeats(line_hash)
    word_n = len(words)
    return np.array(
        [
            *classes,
            *np.sqrt(classes),
            *share[_MARKS],
            *np.sqrt(share[_MARKS]),
            share[65:91].sum() / letters if letters else 0.0,
            seen,
            same,
            two,
            line_seen,
            line_same,
            min(1.0, word_n / max(1, n)),
            min(1.0, gaps.mean() / 20),
            min(1.0, gaps.std() / 20),
            1 / (1 + word_n),
            np.log1p(word_n) / 20,
            np.log1p(n / max(1, len(lines))) / 20,
            float(n == 0),
        ]
    )


N_FEATURES = 2 * len(_CLASSES) + 2 * len(_MARKS) + 13


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features in standard deviations, held within 5 so that a mark the training rows hardly know decides nothing alone."""
    return np.clip((x - mean) / scale, -5, 5)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    spread: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1; the cut is at CUT."""
        raw = standard(x, self.mean, self.scale) @ self.weight
        z = np.clip((raw - self.cut) / self.spread, -30, 30) + np.log(CUT / (1 - CUT))
        return np.where(raw >= self.cut, np.maximum(1 / (1 + np.exp(-z)), CUT), np.minimum(1 / (1 + np.exp(-z)), CUT - 1e-12))


def fit(x: np.ndarray, y: np.ndarray, *, pairs: int = 40_000, ridge: float = 3.0, steps: int = 25, seed: int = 11) -> QualityModel:
    """Bradley-Terry weights from ``pairs`` random pairs of a 1-labelled over a 0-labelled row."""
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 2e-3)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weight = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return QualityModel(mean, scale, weight, 0.0, 1.0)
    z = standard(x, mean, scale)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ weight, -30, 30)))
        gradient = diff.T @ p - ridge * weight
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(len(weight))
        step = np.linalg.solve(hessian, gradient)
        weight = weight + step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ weight
    order = np.sort(raw)
    k = len(bad)  # the k lowest scores fall
    cut = (order[k - 1] + order[k]) / 2
    return QualityModel(mean, scale, weight, float(cut), float(max(raw.std() / 3, 1e-9)))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", row_id: str = "doc_id", max_rows: int = 10_000) -> QualityModel:
    """Fit on documents with a label 0 or 1.

    The fit uses a bounded sample: the ``max_rows`` labelled ids of the smallest hash, the same at every run.
    """
    marked = pick(labels, row_id, label).toDF("id", "y").where("y in (0, 1) and id is not null").select("id", F.col("y").cast("int").alias("y"))
    sample = marked.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    rows = pick(docs, row_id, text).toDF("id", "text").join(F.broadcast(sample), "id").select("text", "y")

    def run(batches):
        for batch in batches:
            x = features(utf8(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = map_arrow(rows, run, "x array<double>, y int").toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, N_FEATURES))
    y = got["y"].to_numpy() if len(got) else np.zeros(0, int)
    order = np.lexsort((y, *x.T))  # independent of the order of partitions
    return fit(x[order], y[order])


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``score`` and ``predicted`` of each row."""
    rows, at = pick_with_text(docs, keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keep)

    def run(batches):
        for batch in batches:
            s = shared.value.score(features(utf8(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], [*keep, "score", "predicted"])

    fixed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    return map_arrow(rows, run, f"{fixed}score double, predicted int")
