"""Quality classifier by co-training.

Two logistic classifiers see a document from different sides: the text (frequencies of byte pairs, word repetition,
kinds of characters) and the page's metadata (language, source, length, line layout). In each round either one labels
the pool documents it is surest about, calibrated on labelled rows kept apart, and the other learns from them. At the
end both are calibrated again and their evidence is added up.

Fitted on at most MAX_LABELLED labelled and MAX_POOL other documents, those of least id hash (documented bounds); every
document is scored. Defined cases: null text: empty; null metadata: a value of its own; null or conflicting labels are
left out; with labels of one kind only, or none, every document is kept; other columns are kept by kept().
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline import session
from meterline.llm.common import BYTE_VALUE, Bytes, Rolling, load, mix64, text_chunks

MAX_LABELLED = 4000
MAX_POOL = 4000
ROUNDS = 3
SURE = 0.98  # calibrated probability from which a pool document is labelled
FOLDS = 4
TAKE = 0.1  # of the pool, at most, by one view in one round and for one class
THRESHOLD = 0.5
PAIR_BUCKETS = 1024
LANG_BUCKETS, SOURCE_BUCKETS = 32, 64
CHUNK = 1 << 20


def text_view(text: Bytes) -> np.ndarray:
    data, n = text.data, text.n
    size = np.maximum(np.diff(text.off), 1)
    doc = np.repeat(np.arange(n), np.diff(text.off))
    code = (mix64(np.arange(65536, dtype=np.uint64) + np.uint64(77)) % np.uint64(PAIR_BUCKETS)).astype(np.int64)
    pair = code[(data[:-1].astype(np.int64) << 8) | data[1:]]
    same = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
    counts = np.bincount((doc[:-1] * PAIR_BUCKETS + pair)[same] if len(doc) else [], minlength=n * PAIR_BUCKETS).reshape(n, PAIR_BUCKETS)
    starts, ends, of = text.words()
    words = Rolling(BYTE_VALUE[data]).of(starts, ends)
    total = np.maximum(np.bincount(of, minlength=n), 1)
    key = np.sort(mix64(words + mix64(of.astype(np.uint64))))
    order = np.argsort(mix64(words + mix64(of.astype(np.uint64))))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    kinds = np.bincount(of[order][new], minlength=n) / total
    twice = np.flatnonzero((words[1:] == words[:-1]) & (of[1:] == of[:-1])) if len(words) else np.zeros(0, np.int64)
    dense = [kinds, np.bincount(of[twice], minlength=n) / total, np.bincount(of, ends - starts, n) / total / 10]
    for lo, hi in ((65, 90), (48, 57), (33, 47)):
        dense.append(text.per_doc((data >= lo) & (data <= hi)) / size)
    return np.concatenate([np.sqrt(counts / size[:, None]), np.stack(dense, 1)], 1).astype(np.float32)


def metadata_view(part: pa.RecordBatch, text: Bytes) -> np.ndarray:
    n = text.n
    out = np.zeros((n, LANG_BUCKETS + SOURCE_BUCKETS + 4), np.float32)
    for name, at, size in (("lang", 0, LANG_BUCKETS), ("source", LANG_BUCKETS, SOURCE_BUCKETS)):
        if name in part.schema.names:
            for i, v in enumerate(part.column(name).to_pylist()):
                b = np.frombuffer(b"\0" if v is None else b"v" + v.encode(), np.uint8)
                out[i, at + int(mix64(np.array([int.from_bytes(b[-8:].tobytes(), "little") + len(b)], np.uint64))[0] % np.uint64(size))] = 1
    lines = text.per_doc(text.data == 10) + 1
    size = np.diff(text.off)
    out[:, -4], out[:, -3] = np.log1p(size) / 10, np.log1p(lines) / 5
    out[:, -2] = np.log1p(size / lines) / 10
    out[:, -1] = text.per_doc(text.data == 46) / np.maximum(lines, 1) / 10
    return out


def fit(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Logistic regression, both classes of equal weight; weights with the intercept last."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    share = max(y.mean(), 1e-6)
    c = np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-6)).astype(np.float32) / len(y)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (p - y)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibration(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, none negative, and an intercept that turn scores (columns of z) into log odds of y (smoothed, Newton steps)."""
    z = z.reshape(len(y), -1)
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    f = np.concatenate([z, np.ones((len(y), 1))], 1).astype(np.float64)
    w = np.zeros(f.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        h = f.T @ (f * (p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, f.T @ (p - t) + 1e-3 * w), -5, 5)
    return np.append(np.maximum(w[:-1], 0), w[-1])


class CoTrained:
    """Two scaled linear views, their calibrations, and the weights of their evidence."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> None:
        self.scale = [(np.concatenate([v, p]).mean(0), np.concatenate([v, p]).std(0) + 1e-3) for v, p in zip(views, pool)]
        views = [self._scaled(v, i) for i, v in enumerate(views)]
        pool = [self._scaled(p, i) for i, p in enumerate(pool)]
        apart = np.arange(len(y)) % 4 == 3
        given: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * 2
        for turn in range(rounds + 1):
            self.weights = [fit(np.concatenate([v[~apart], p[rows]]), np.concatenate([y[~apart], labels]))
                            for v, p, (rows, labels) in zip(views, pool, given)]
            self.calibrations = [calibration(logits(v[apart], w), y[apart]) for v, w in zip(views, self.weights)]
            if turn < rounds and len(pool[0]):
                given = [self._sure(pool[1 - i], 1 - i) for i in range(2)]  # each learns from the other
        self._settle(views, y, pool, given)

    def _settle(self, views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], given: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Last weights on all rows; calibrations on scores of rows that a fit has not seen, fold by fold."""
        fold = np.arange(len(y)) % FOLDS
        z = np.zeros((len(y), 2))
        for i, (v, p, (rows, labels)) in enumerate(zip(views, pool, given)):
            learn = lambda own: fit(np.concatenate([v[own], p[rows]]), np.concatenate([y[own], labels]))  # noqa: E731, B023
            for k in range(FOLDS):
                z[fold == k, i] = logits(v[fold == k], learn(fold != k))
            self.weights[i] = learn(fold >= 0)
            self.calibrations[i] = calibration(z[:, i], y)
            z[:, i] = self.calibrations[i][0] * z[:, i] + self.calibrations[i][1]
        self.joint = calibration(z, y)

    def _scaled(self, x: np.ndarray, i: int) -> np.ndarray:
        mean, sd = self.scale[i]
        return np.clip((x - mean) / sd, -5, 5).astype(np.float32) / np.float32(np.sqrt(x.shape[1]))

    def _odds(self, x: np.ndarray, i: int) -> np.ndarray:
        a, b = self.calibrations[i]
        return a * logits(x, self.weights[i]) + b

    def _sure(self, x: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        z = self._odds(x, i)
        most = max(1, int(TAKE * len(z)))
        limit = np.log(SURE / (1 - SURE))
        order = np.argsort(z, kind="stable")
        low, high = order[:most], order[::-1][:most]
        low, high = low[z[low] < -limit], high[z[high] > limit]
        return np.concatenate([low, high]), np.concatenate([np.zeros(len(low)), np.ones(len(high))])

    def scores(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of good quality by the text, by the metadata, and by both."""
        z = [self._odds(self._scaled(v, i), i) for i, v in enumerate(views)]
        both = np.stack(z, 1) @ self.joint[:-1] + self.joint[-1]
        return [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*z, both)]


def _features(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Views and labels (-1: none) of the chosen documents, at most MAX_LABELLED + MAX_POOL rows, one for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch, limit=CHUNK):
                a, b = text_view(text), metadata_view(part, text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__quality"),
                                                  pa.array([r.tobytes() for r in a], pa.binary()), pa.array([r.tobytes() for r in b], pa.binary())],
                                                 ["id", "y", "a", "b"])

    columns = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    sample = docs.select(*columns).join(F.broadcast(chosen), "doc_id")  # chosen is bounded by its limits
    return sample.mapInArrow(run, f"id {docs.schema['doc_id'].dataType.simpleString()}, y int, a binary, b binary").dropDuplicates(["id"])


def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pickled model, or no row, from all rows of _features in order of ids."""
    y, views = [], ([], [])
    for batch in batches:
        y.append(batch.column("y").to_numpy())
        for v, name in zip(views, "ab"):
            v.append(np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in batch.column(name)]) if batch.num_rows else np.zeros((0, 0), np.float32))
    y = np.concatenate(y) if y else np.zeros(0, np.int32)
    known = y >= 0
    if len(set(y[known])) < 2 or min(np.bincount(y[known])) < 4:
        return
    both = [np.concatenate([x for x in v if len(x)]) for v in views]
    views = None
    made = CoTrained([v[known] for v in both], y[known].astype(np.float32), [v[~known] for v in both])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    session.ship(docs.sparkSession)
    rank = F.xxhash64(F.lit(5), "doc_id")
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg(F.min("quality").cast("int").alias("__quality"), F.max("quality").cast("int").alias("__other"))
             .filter(F.col("__quality") == F.col("__other")).select("doc_id", "__quality"))
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    labelled = ids.join(known, "doc_id").orderBy(rank).limit(MAX_LABELLED)
    pool = ids.join(labels.select("doc_id"), "doc_id", "left_anti").orderBy(rank).limit(MAX_POOL).withColumn("__quality", F.lit(-1))
    chosen = docs.sparkSession.createDataFrame(labelled.unionByName(pool).toArrow(), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, __quality int")
    rows = _features(docs, chosen).repartition(1).sortWithinPartitions("id")  # bounded, and fitted in a task: the driver gets the weights alone
    made = rows.mapInArrow(learned, "model binary").first()
    return pickle.loads(made.model) if made else None


def _scored(docs: DataFrame, trained: CoTrained | None, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch, limit=CHUNK):
                s = [np.ones(text.n)] * 3 if trained is None else trained.scores([text_view(text), metadata_view(part, text)])
                yield make(part, [np.asarray(x, np.float64) for x in s])

    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_score, metadata_score, score, kept)."""

    def make(part, s):
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x) for x in s], pa.array(s[2] >= THRESHOLD)],
                                          ["doc_id", "text_score", "metadata_score", "score", "kept"])

    columns = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    return _scored(docs.select(*columns), train(docs, labels),
                   f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_score double, metadata_score double, score double, kept boolean", make)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    return _scored(docs, train(docs, labels), docs.schema, lambda part, s: part.filter(pa.array(s[2] >= THRESHOLD)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(load(spark, sf_dir), load(spark, sf_dir, "labels"))
