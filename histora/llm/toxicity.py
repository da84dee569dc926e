"""Toxicity by cumulative-link ordinal regression.

Grades are 0 (not toxic), 1 and 2. P(grade <= g | x) = sigmoid(cut[g] - w.x): the thresholds are ordered and share
the weights. Features are words and their beginnings, so that inflected forms of a stem share one; those that
tell toxic from other labelled documents are found by their document frequencies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_in_arrow, slabs, table, written

#: At most about so many labelled rows fit the model, and it has at most so many features.
SAMPLE, FEATURES = 20_000, 4_096
STARTS = (4, 5, 6)
#: A document is rejected if its expected severity is at least this.
REJECT = 0.5
#: A feature is telling if its log odds in toxic against other documents, less so many standard errors, are at least this.
ERRORS, LEAST = 1.5, 2.0
#: ... and it is in at least this share of the toxic documents.
RARE = 0.005
WORDS = re.compile(r"[^\W\d_]+")
REMEMBERED = 100_000


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STARTS if len(word) >= n)]


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(toxic, text) of about sample labelled rows, chosen by a hash of their id; rows without label or id are left out."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keep = max(1, math.ceil(labels.count() / sample))
    few = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(keep)) == 0)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select((F.col("toxic") > 0).cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("toxic", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.first("text").alias("text")).select("toxic", "text")


def _frequencies(rows: DataFrame) -> DataFrame:
    """(feature, a, b): in how many toxic and in how many other documents each feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (toxic,), texts in slabs(batches, ["toxic", "text"], "text"):
            kind, name = [], []
            for t, text in zip(toxic, texts):
                own = {f for w in set(WORDS.findall(text.decode().lower())) for f in features(w)}
                kind += [t] * len(own)
                name += own
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(name, pa.string())], ["toxic", "feature"])

    seen = rows.mapInArrow(run, "toxic int, feature string").groupBy("feature")
    return seen.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))


class Model:
    """Feature weights, the two ordered thresholds, and scoring of texts."""

    def __init__(self, names: list[str], weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts
        self.at = {f: i for i, f in enumerate(names)}

    def __getstate__(self):
        return {"weights": self.weights, "cuts": self.cuts, "at": self.at}

    def hits(self, text: str, known: dict[str, tuple[int, ...]]) -> dict[int, int]:
        found: dict[int, int] = {}
        for w in WORDS.findall(text.lower()):
            own = known.get(w)
            if own is None:
                if len(known) > REMEMBERED:
                    known.clear()
                own = known[w] = tuple(self.at[f] for f in features(w) if f in self.at)
            for i in own:
                found[i] = found.get(i, 0) + 1
        return found

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and the likeliest grade at each x = w.x."""
        below = 1 / (1 + np.exp(np.clip(x[:, None] - self.cuts, -500, 500)))
        p = np.diff(np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], axis=1), axis=1)
        return p @ np.arange(p.shape[1]), p.argmax(axis=1)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, l2: float = 2e-4, prior: float = 0.5, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the penalised likelihood (Adam over all rows).

    rows, columns, values: the sparse features. The penalty draws weights to prior, since every feature given tells
    for toxicity: one that few rows have keeps about that weight. Thresholds are cut[0] and cut[0] + exp(gap), so they stay in order.
    """
    n, top = len(grades), int(grades.max()) if len(grades) else 0
    w = np.full(n_features, prior)
    share = (np.array([(grades <= g).sum() for g in range(top)]) + 0.5) / (n + 1)
    start = np.log(share / (1 - share))
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    state = [np.zeros(n_features + top) for _ in range(2)]
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        x = np.bincount(rows, values * w[columns], minlength=n)
        s = 1 / (1 + np.exp(np.clip(x[:, None] - cuts, -500, 500)))
        below = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
        d = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
        up, low = d[at, grades + 1] / p, d[at, grades] / p
        gw = np.bincount(columns, values * (up - low)[rows], minlength=n_features) / n + l2 * (w - prior)
        gc = np.array([(np.where(grades == g + 1, low, 0) - np.where(grades == g, up, 0)).sum() for g in range(top)]) / n
        gt = np.array([gc[k:].sum() * (1 if k == 0 else np.exp(theta[k])) for k in range(top)])
        g = np.concatenate([gw, gt])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        step = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w -= step[:n_features]
        theta -= step[n_features:]
    return w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> Model | None:
    """A model from about sample labelled rows, or None if they don't hold both kinds or no feature tells them apart.

    Labels say only toxic or not. The grade of a toxic row is 2 if it has more telling words than the median of toxic
    rows, else 1: the upper threshold is a rank of one count, made from the features, and no judgement from outside; the lower
    one, which alone decides what is rejected at REJECT, is that of the labels. Equal texts with equal labels count once.
    Repeated labels of an id are toxic if any is.
    """
    rows = written(_labelled(docs, labels, sample), "labelled")
    kinds = {int(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return None
    bad, good = kinds[1], kinds[0]
    odds = F.log((F.col("a") + 0.5) / (F.lit(bad) - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (F.lit(good) - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    telling = _frequencies(rows).withColumn("least", odds - ERRORS * error).where((F.col("least") >= LEAST) & (F.col("a") >= max(3, bad * RARE)))
    telling = telling.orderBy(F.desc("least"), "feature").limit(most)
    names = [r["feature"] for r in telling.select("feature").collect()]
    if not names:
        return None
    model = Model(names, np.zeros(len(names)), np.zeros(2))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (toxic,), texts in slabs(batches, ["toxic", "text"], "text"):
            known: dict = {}
            hits = [shared.value.hits(t.decode(), known) for t in texts]
            columns = [pa.array(toxic, pa.int32()), pa.array([list(h) for h in hits], pa.list_(pa.int32())), pa.array([list(h.values()) for h in hits], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "ids", "counts"])

    got = rows.mapInArrow(run, "toxic int, ids array<int>, counts array<int>").toPandas()
    toxic, much = got["toxic"].to_numpy(), got["counts"].map(sum).to_numpy()
    grades = np.where(toxic == 0, 0, np.where(much > np.median(much[toxic == 1]), 2, 1))
    if not (grades == 2).any():
        grades = toxic.copy()
    sizes = got["ids"].map(len).to_numpy()
    at = np.repeat(np.arange(len(got)), sizes)
    columns = np.concatenate(got["ids"].tolist()).astype(int) if sizes.sum() else np.zeros(0, int)
    values = np.log1p(np.concatenate(got["counts"].tolist()).astype(float)) if sizes.sum() else np.zeros(0)
    model.weights, model.cuts = fit_ordinal(at, columns, values, grades, len(names))
    return model


def severity(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, grade, toxic) for each row: expected grade, likeliest grade, and whether it is rejected.

    Null and empty texts have no features. Very long texts are looked at whole; counts enter as logarithms. Grades that are
    equally likely give the lower one. Without a model, everything has severity 0 and is not toxic. Rows that repeat, or have no
    id, keep a row each; other columns, whatever their names, are not looked at. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))
    score = _scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for (ids,), texts in slabs(batches, ["doc_id", "text"], "text"):
            expected, grade = score(texts, known)
            columns = [pa.array(ids, pa.int64()), pa.array(expected), pa.array(grade.astype(np.int32)), pa.array(expected >= REJECT)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "grade", "toxic"])

    return rows.mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def _scorer(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)

    def score(texts: list[bytes], known: dict) -> tuple[np.ndarray, np.ndarray]:
        m = shared.value
        hits = [m.hits(t.decode(), known) for t in texts]
        return m.score(np.array([sum(m.weights[i] * math.log1p(c) for i, c in h.items()) for h in hits], dtype=float))

    return score


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't rejected, with their columns. The model is fitted on the labelled rows among docs.

    Null and empty texts have no features and stay. Very long texts are looked at whole. Rows that repeat, or have no id, are
    judged each by its text. Columns of docs may have any names and types. An empty table gives an empty result.
    """
    model = fit(docs, labels)
    if model is None:
        return docs
    score = _scorer(docs.sparkSession, model)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):  # so that few texts are Python objects at a time
                some = batch.slice(start, 500)
                texts = [t or b"" for t in some.column(at).cast("binary").to_pylist()]
                kept = some.filter(pa.array(score(texts, known)[0] < REJECT, pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns, names)

    return map_in_arrow(docs, run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, fit(docs, table(spark, sf_dir, "labels")))
