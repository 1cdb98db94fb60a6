"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad; a line's evidence is its own features and those of the lines before
and after it, and neighbouring labels are tied by transition weights. Labels are known per
document, so in training all lines of a document carry its label. The marginals of forward-
backward, averaged with the lines' lengths as weights and calibrated by two numbers, are the
document's score.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import HELD, column, map_arrow, parts, ship, utf8

#: Labelled documents the field is fitted on, at most: those with the smallest hashes.
SAMPLE = 6000
STEPS, RATE, PENALTY = 150, 0.1, 1e-3
#: Bytes of text whose lines are described at once.
SLAB = 1 << 20
NEWLINE = 10

_CLASSES = np.zeros(256, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 stop, 5 mark, 6 other
_CLASSES[:] = 5
_CLASSES[[9, 11, 12, 13, 32]] = 3
_CLASSES[NEWLINE] = 7
_CLASSES[[ord(c) for c in ".,;:'\"()?-"]] = 4
_CLASSES[48:58], _CLASSES[65:91], _CLASSES[97:123], _CLASSES[128:] = 2, 1, 0, 6
OWN = 9


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes, and how many lines each text has."""
    data = np.frombuffer(b"".join([t + b"\n" for t in texts]), np.uint8)
    ends = np.flatnonzero(data == NEWLINE)
    starts = np.r_[0, ends[:-1] + 1]
    sizes = ends - starts
    texts_end = np.cumsum([len(t) + 1 for t in texts]) - 1
    counts = np.diff(np.r_[0, np.searchsorted(ends, texts_end) + 1])
    kinds = _CLASSES[data]
    sums = [np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(7)]
    lower, upper, digit, space, stop, mark, other = (s / np.maximum(sizes, 1) for s in sums)
    words = sums[3] + 1
    final = data[np.maximum(ends - 1, starts)]
    doc = np.repeat(np.arange(len(texts)), counts)
    own = np.stack([
        np.log1p(sizes) / 6, upper, digit, stop * 4, mark * 4, other,
        np.log1p(sizes / words) / 2,
        (_CLASSES[final] == 4).astype(float),
        (upper > 2 * lower).astype(float),
    ], 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = doc[1:] == doc[:-1]
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    edges = np.ones((len(own), 2))
    edges[1:, 0], edges[:-1, 1] = ~same, ~same
    return np.c_[own, before, after, edges, np.ones(len(own))], sizes, counts


class LineField:
    """weights of the good label's evidence, and transitions[from, to] (0 bad, 1 good)."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions

    def marginals(self, features: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """P(good) of each line; with ``pairs`` also the expected transitions per document."""
        begins = np.r_[0, np.cumsum(counts)[:-1]]
        order = np.argsort(-counts, kind="stable")
        sizes, first = counts[order], begins[order]
        score = np.zeros((len(features), 2))
        score[:, 1] = np.clip(features @ self.weights, -30, 30)
        local = np.exp(score - score.max(1, keepdims=True))
        jump = np.exp(self.transitions - self.transitions.max())
        ahead, back = np.empty_like(local), np.ones_like(local)
        live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes.max()))]
        for t, n in enumerate(live):
            at = first[:n] + t
            a = local[at] if t == 0 else local[at] * (ahead[at - 1] @ jump)
            ahead[at] = a / a.sum(1, keepdims=True)
        expected = np.zeros((len(counts), 2, 2))
        for t in range(len(live) - 1, 0, -1):
            at = first[:live[t]] + t
            message = local[at] * back[at]
            if pairs:
                both = ahead[at - 1][:, :, None] * jump * message[:, None, :]
                expected[order[:live[t]]] += both / both.sum((1, 2), keepdims=True)
            b = message @ jump.T
            back[at - 1] = b / b.sum(1, keepdims=True)
        both = ahead * back
        good = both[:, 1] / both.sum(1)
        return (good, expected) if pairs else good

    def shares(self, features, sizes, counts) -> np.ndarray:
        """Length-weighted mean of the marginals of each document."""
        weight = np.maximum(sizes, 1)
        begins = np.r_[0, np.cumsum(counts)[:-1]]
        good = self.marginals(features, counts)
        return np.add.reduceat(good * weight, begins) / np.add.reduceat(weight, begins)


def fit(features, sizes, counts, labels) -> tuple[LineField, np.ndarray]:
    """Penalised likelihood, each document weighing the same, by Adam; then the calibration."""
    begins = np.r_[0, np.cumsum(counts)[:-1]]
    share = np.repeat(1.0 / counts, counts) / len(counts)
    truth = np.repeat(labels, counts)
    field = LineField(np.zeros(features.shape[1]), np.zeros((2, 2)))
    seen = np.zeros((len(counts), 2, 2))
    seen[np.arange(len(counts)), labels, labels] = counts - 1
    size = features.shape[1]
    theta, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for step in range(1, STEPS + 1):
        good, expected = field.marginals(features, counts, pairs=True)
        slope = np.r_[features.T @ ((truth - good) * share),
                      ((seen - expected) / counts[:, None, None]).mean(0).ravel()]
        slope -= PENALTY * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        field = LineField(theta[:size], theta[size:].reshape(2, 2))
    x = np.c_[_logit(field.shares(features, sizes, counts)), np.ones(len(begins))]
    scale = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
        grad = x.T @ (labels - p) - 0.1 * scale
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        scale = scale + np.linalg.solve(hess, grad)
    return field, scale


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> tuple[LineField, np.ndarray] | None:
    """The field and its calibration, from a bounded sample of the labelled documents outside
    the held-out fold; None if there is none. A document labelled twice counts once, with the
    larger label; null labels are none."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") > 0).cast("int")).alias("label"))
    marks = marks.where(~held_out(marks["doc_id"]))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"),
                        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = map_arrow(texts.join(chosen, "doc_id").select("doc_id", "text", "label"), _describe,
                     "doc_id bigint, label int, features array<float>, sizes array<bigint>")
    rows = sorted(rows.dropDuplicates(["doc_id"]).collect())
    if not rows:
        return None
    counts = np.array([len(r["sizes"]) for r in rows])
    features = np.concatenate([np.array(r["features"]) for r in rows]).reshape(counts.sum(), -1)
    sizes = np.concatenate([np.array(r["sizes"]) for r in rows])
    return fit(features, sizes, counts, np.array([r["label"] for r in rows]))


def _slabs(texts: list[bytes]):
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLAB):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _describe(batches):
    for batch in chain.from_iterable(map(parts, batches)):
        texts = utf8(batch)
        for at, end in _slabs(texts):
            features, sizes, counts = lines_of(texts[at:end])
            cuts = np.cumsum(counts)[:-1]
            part = batch.slice(at, end - at)
            yield pa.RecordBatch.from_arrays([
                column(part, "doc_id"), column(part, "label"),
                pa.array([x.ravel().astype(np.float32) for x in np.split(features, cuts)],
                         pa.list_(pa.float32())),
                pa.array(np.split(sizes, cuts), pa.list_(pa.int64()))],
                ["doc_id", "label", "features", "sizes"])


def quality_scores(docs: DataFrame, model, *more: str) -> DataFrame:
    """doc_id, score and the named columns. Without a model every score is 0.5. An empty or
    null text is one empty line."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in chain.from_iterable(map(parts, batches)):
            texts, scores = utf8(batch), []
            for at, end in _slabs(texts):
                if model is None:
                    scores.append(np.full(end - at, 0.5))
                    continue
                field, scale = model
                x = _logit(field.shares(*lines_of(texts[at:end])))
                scores.append(1 / (1 + np.exp(-np.clip(scale[0] * x + scale[1], -30, 30))))
            scores = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"),
                        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return map_arrow(texts, run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1: good) for every document, repeated rows and null
    ids (which belong to no fold but that of the empty text) included."""
    scored = quality_scores(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents the classifier does not reject, with all their columns."""
    model = train(docs, labels)
    ship(docs.sparkSession)

    def good(texts):
        import pandas as pd

        if model is None or not len(texts):
            return pd.Series([True] * len(texts))
        field, scale = model
        shares = []
        for at in range(0, len(texts), HELD):
            raw = [(t or "").encode() for t in texts[at:at + HELD]]
            shares += [field.shares(*lines_of(raw[a:b])) for a, b in _slabs(raw)]
        shares = np.concatenate(shares)
        return pd.Series(1 / (1 + np.exp(-(scale[0] * _logit(shares) + scale[1]))) >= threshold)

    return docs.where(F.pandas_udf(good, "boolean")(docs["text"]))
