"""Toxic passages by maximum-scoring segments of token log-odds.

*Learning.* Every document's tokens are counted, once each, for the Dirichlet prior, those of labelled training rows for the two classes. A
token's score is its log-odds of the toxic class under that prior, shrunk towards 0 by ``SHRINK`` standard errors, less
``DRIFT``, so that ordinary text drifts downwards. *Scan.* A linear pass over a document's scores finds all its maximal
segments. *Calibration.* Maxima of such segments follow an extreme-value law: with ``rate`` from the scores of clean tokens and
``log_k`` from the maxima of clean training rows, a segment of score S among n tokens is significant if rate * S exceeds
log_k + log(n). What the significant segments exceed it by, and how much of the text they cover, gives the
document's probability through a logistic fit on the training rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship_package, small_batches, stage_table

#: Labelled rows that the classifier learns from, at most; the hash of the identifier picks them.
LABELLED = 200_000
#: Pseudo-counts of the prior: those spread by corpus frequency, and those of each token.
PRIOR, EACH = 1000.0, 0.1
SHRINK, DRIFT = 1.64, 0.5
MEMORY = 150_000
PUNCTUATION = string.punctuation.encode()
#: Distinct tokens of one task before their counts go out.
FLUSH = 500_000


def token_key(word: bytes) -> int:
    """A token is a word without ASCII punctuation at its ends; the key is the signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(word.strip(PUNCTUATION)) - (1 << 63)


class _Keys(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = k = token_key(word)
        return k


_keys = _Keys()


def tokens(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(_keys) > MEMORY:
        _keys.clear()
    return np.fromiter(map(_keys.__getitem__, words), dtype=np.int64, count=len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a sequence, in linear time.

    Each positive score opens a candidate with the running sums before and after it. It joins the nearest earlier candidate
    that starts lower, if that one also ends lower, and so on.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest earlier candidate that starts lower
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, before, after = i, i + 1, float(total[i]), float(total[i + 1])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((start, end, before, after, j))
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


@dataclass
class ToxicityModel:
    """Everything the scan needs. Its tokens are those whose log-odds in the labelled rows are surely not 0, so the bound on these rows bounds them."""

    keys: np.ndarray
    values: np.ndarray
    rate: float = 1.0
    log_k: float = 0.0
    weights: list[float] = field(default_factory=lambda: [-1.0, 0.0, 0.0, 0.0])

    def scores(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -DRIFT)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        s = np.where(self.keys[at] == keys, self.values[at], 0.0)
        s[1:][keys[1:] == keys[:-1]] = 0.0  # a word said over and over counts once
        return s - DRIFT

    def passages(self, text: str | None) -> tuple[int, float, list[tuple[int, int, float]]]:
        """Number of tokens, best segment score, and the significant segments with what they exceed the limit by."""
        s = self.scores(tokens(text))
        if not (s > 0).any():
            return len(s), 0.0, []
        segments = maximal_segments(s)
        limit = self.log_k + np.log(len(s))
        return len(s), max(x for _, _, x in segments), [(a, b, self.rate * x - limit) for a, b, x in segments if self.rate * x > limit]

    def features(self, n: int, significant: list[tuple[int, int, float]]) -> list[float]:
        return [1.0, np.log1p(max((x for _, _, x in significant), default=0.0)), np.log1p(sum(x for _, _, x in significant)), sum(b - a for a, b, _ in significant) / max(n, 1)]

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -30, 30)))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> pa.RecordBatch:
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        counts = np.zeros((len(keys), 3), dtype=np.int64)
        np.add.at(counts, inverse, np.concatenate([c for _, c in held]))
        return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(3))], ["key", "n_all", "n_clean", "n_toxic"])

    for batch in small_batches(batches, 0):
        groups: dict[int, list[np.ndarray]] = {0: [], 1: [], 2: []}
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            groups[0 if label is None else 1 + label].append(np.unique(tokens(text.as_py())))
        for group, parts in groups.items():
            if parts:
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                counts = np.zeros((len(keys), 3), dtype=np.int64)
                counts[:, 0] = n
                if group:
                    counts[:, group] = n
                held.append((keys, counts))
                size += len(keys)
        if size > FLUSH:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()
    _keys.clear()
    give_back()


def _labelled_rows(sent):
    """For each labelled row: tokens, best segment, and the features under the model so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in small_batches(batches, 0):
            rows = []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                n, best, significant = model.passages(text.as_py())
                rows.append((label, n, best, *model.features(n, significant)[1:]))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], ["label", "n", "best", "f1", "f2", "f3"])
        _keys.clear()
        give_back()

    return run


def extreme_value_rate(histogram: list[tuple[float, int]]) -> float:
    """The positive solution of E[exp(rate * score)] = 1 over (score, tokens), by bisection; 1 where there is none.

    A positive score of weight ``p`` alone brings the mean to 1 at -log(p) / score, so the solution is no larger than that.
    """
    seen = [(x, n) for x, n in histogram if n > 0]
    s, p = (np.array(c, dtype=float) for c in zip(*seen)) if seen else (np.zeros(0), np.zeros(0))
    if not (s > 0).any() or (s * p).sum() >= 0:
        return 1.0
    p /= p.sum()
    low, high = 0.0, float((-np.log(p[s > 0]) / s[s > 0]).min())
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (low, mid)
    return high


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Weights of a logistic regression, by Newton steps; the ridge leaves out the constant."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return w.tolist()


def held_out(id_col: F.Column) -> F.Column:
    """Rows that only measure: the CRC-32 of the identifier as text leaves no remainder by 5."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = LABELLED) -> ToxicityModel:
    """Fit on the labelled rows that aren't held out, ``max_labelled`` of them at most; the prior counts every document.

    A label is 0 or 1; others, and those of null identifiers, count for nothing, and of several for one identifier the largest counts. Repeated rows count each; a null
    text has no tokens. Without labels of both kinds, or without documents, every text scores the share of toxic labels.
    """
    ship_package(docs.sparkSession)
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = stage_table(chosen.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled), "labelled")
    slim = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("body"))
    marked = slim.join(F.broadcast(chosen), F.col("__doc") == F.col("__id"), "left").select("body", "label")
    counts = stage_table(marked.mapInArrow(_count_rows, "key long, n_all long, n_clean long, n_toxic long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_all", "n_clean", "n_toxic"))).where("n_clean + n_toxic > 0"), "counts")
    whole, clean, toxic = (x or 0 for x in counts.agg(F.sum("n_all"), F.sum("n_clean"), F.sum("n_toxic")).first())
    if not clean or not toxic:  # no contrast to learn: the share of toxic rows is all that's known, and without rows a text is taken for clean
        n, ones = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        return ToxicityModel(np.array([], dtype=np.int64), np.array([]), weights=[math.log((ones + 0.5) / (n - ones + 1)), 0.0, 0.0, 0.0])
    a = F.lit(PRIOR / whole) * F.col("n_all") + EACH
    yt, yc = F.col("n_toxic") + a, F.col("n_clean") + a
    delta = F.log(yt / (toxic + PRIOR - yt)) - F.log(yc / (clean + PRIOR - yc))
    error = F.sqrt(1 / yt + 1 / yc)
    scored = counts.withColumn("delta", delta).withColumn("error", error)
    scored = scored.withColumn("score", F.signum("delta") * F.greatest(F.abs("delta") - SHRINK * F.col("error"), F.lit(0.0)))
    sure = scored.where("score != 0").select("key", "score").toArrow()
    keys, values = sure.column("key").to_numpy(), sure.column("score").to_numpy()
    order = np.argsort(keys)
    model = ToxicityModel(keys[order], values[order])
    histogram = scored.groupBy(F.round(F.col("score") - DRIFT, 2).alias("s")).agg(F.sum("n_clean").alias("n")).collect()
    model.rate = extreme_value_rate([(r["s"], r["n"]) for r in histogram])
    train = slim.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("body", "label")
    schema = "label int, n long, best double, f1 double, f2 double, f3 double"
    sent = docs.sparkSession.sparkContext.broadcast(model)
    seen = train.mapInArrow(_labelled_rows(sent), schema).where("label = 0 AND n > 0").agg(F.avg(model.rate * F.col("best") - F.log(F.col("n").cast("double")))).first()[0]
    model.log_k = (seen or 0.0) - float(np.euler_gamma)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = train.mapInArrow(_labelled_rows(sent), schema).select("label", "f1", "f2", "f3").toArrow()
    x = np.column_stack([np.ones(rows.num_rows), *(rows.column(c).to_numpy() for c in ("f1", "f2", "f3"))])
    model.weights = logistic_fit(x, rows.column("label").to_numpy().astype(float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, score, predicted, passages``; passages are ``start, end, excess`` in tokens.

    A null or empty text has no passage and the score of a text without one. Null identifiers and repeated rows are scored like
    any other; an empty table gives an empty table. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("excess", pa.float64())]))
        for batch in small_batches(batches):
            x, spans = [], []
            for text in batch.column(1):
                n, _, significant = model.passages(text.as_py())
                x.append(model.features(n, significant))
                spans.append([{"start": a, "end": b, "excess": e} for a, b, e in significant])
            p = model.probability(np.array(x).reshape(-1, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, kind)], ["id", "score", "predicted", "passages"])
        _keys.clear()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, "id long, score double, predicted int, passages array<struct<start:long,end:long,excess:double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, unchanged: null and empty texts, null identifiers, repeated rows and extra columns of any name too; an empty table gives an empty table."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in small_batches(batches, at):
            x = []
            for text in batch.column(at):
                n, _, significant = model.passages(text.as_py())
                x.append(model.features(n, significant))
            yield batch.filter(pa.array(model.probability(np.array(x).reshape(-1, 4)) < 0.5))
        _keys.clear()
        give_back()

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
