"""Toxicity by a linear-chain conditional random field over words.

The field tags each word as toxic or not from its spelling (word, first and last bytes, both neighbours) and from the
tag before it. It learns from labelled words: in documents labelled clean every word is clean; in documents labelled
toxic the words that carry a spelling found far more often in toxic documents (log-likelihood ratio) are toxic, all
others clean, and a toxic document without such a word tells nothing about words and is left to the calibration.

Forward and backward passes run over pieces of PIECE words at once: the transfer matrices of all pieces, then the
states between pieces, then all words. A document's log odds of any toxic word, its largest marginal and its length
are calibrated on documents the field has not seen; words with a marginal of at least one half form the spans.

The sample is bounded: at most MAX_TOXIC and MAX_CLEAN labelled documents and MAX_BYTES of text per class, taken by
hash of the id; a quarter of them calibrates. Everything else covers all documents and whole texts.

Defined cases: null text: empty, scored by the calibration as a text without words; null ids: held_out is false, and
they are never learned from; labels without id or value are ignored, an id labelled both ways counts as toxic; with
labels of one kind only or none, or without any toxic spelling, every score is the (smoothed) share of toxic labels;
rows with equal ids are scored separately; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meterline import session
from meterline.llm.common import IS_SPACE, Bytes, Rolling, load, mix64, ragged, text_chunks

MAX_TOXIC, MAX_CLEAN = 1200, 1500
MAX_BYTES = 16 << 20
FOLDS = 5  # documents with crc32(id) % FOLDS = 0 are held out
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4, 5)
BUCKET_BITS = 20
MIN_RATIO = 10.0  # log-likelihood ratio of a toxic spelling
MIN_SHARE = 0.6  # of the documents with the spelling that are toxic
ROUNDS = 60
RATE = 0.3
RIDGE = 0.02
PIECE = 128
CHUNK = 1 << 18  # bytes of text scored at once; longer single texts on their own
BLOCK = 1 << 18  # words whose sums are made at once in training
_PUNCT = np.ones(256, bool)
_PUNCT[128:] = False
_PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def spellings(text: Bytes, limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word, and a row of spelling hashes per word: whole, first and last bytes.

    Hashes are made for about `limit` bytes of texts at once.
    """
    cut = np.unique(np.searchsorted(text.off, np.arange(0, text.off[-1] + limit, limit), side="left").clip(0, text.n)) if text.n else np.zeros(1, np.int64)
    parts = []
    for i, j in zip(cut, np.append(cut[1:], text.n)):
        base = text.off[i]
        s, e, d, h = _spellings(Bytes(text.data[base:text.off[j]], text.off[i:j + 1] - base))
        parts.append((s + base, e + base, d + i, h))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _spellings(text: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, doc = text.words()
    low = text.lower()
    n = len(low.data)
    core = ~(_PUNCT | IS_SPACE)[low.data]
    places = np.arange(n)
    after = np.minimum.accumulate(np.where(core, places, n)[::-1])[::-1] if n else places
    before = np.maximum.accumulate(np.where(core, places, -1)) if n else places
    s, e = (after[starts], before[ends - 1] + 1) if len(starts) else (starts, ends)
    bare = s >= e  # nothing but punctuation
    s, e = np.where(bare, starts, s), np.where(bare, ends, e)
    rolling = Rolling(low.values())
    parts = [rolling.of(s, e)]
    parts += [mix64(rolling.of(s, np.minimum(s + k, e)) + np.uint64(k)) for k in PREFIXES]
    parts += [mix64(rolling.of(np.maximum(e - k, s), e) + np.uint64(100 + k)) for k in SUFFIXES]
    return starts, ends, doc, np.stack(parts, 1)


def neighbours(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the word before and after each word (0 and 1 at the ends of a text)."""
    edge = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    prev, nxt = np.roll(words, 1), np.roll(words, -1)
    if len(words):
        prev[np.append(0, edge)], nxt[np.append(edge - 1, len(words) - 1)] = np.uint64(0), np.uint64(1)
    return mix64(prev + np.uint64(201)), mix64(nxt + np.uint64(202))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Chain:
    """Sums over all taggings of texts end to end: log total and marginals; tag 0 everywhere has score 0.

    A step from tag i to j multiplies by step[i, j], and by exp(emission) if j is toxic; texts begin after a clean word.
    """

    def __init__(self, first: np.ndarray) -> None:
        """first: first word of each text, and the end of the last."""
        self.first = first
        sizes = np.diff(first)
        self.n_pieces = -(-sizes // PIECE)
        self.piece_first = np.concatenate([[0], np.cumsum(self.n_pieces)])
        self.of = np.repeat(np.arange(len(sizes)), self.n_pieces)
        self.number = np.arange(len(self.of)) - self.piece_first[self.of]
        start = first[self.of] + self.number * PIECE
        self.size = np.minimum(PIECE, first[self.of + 1] - start)
        self.places = start + np.arange(PIECE)[:, None]
        self.inside = np.arange(PIECE)[:, None] < self.size
        self.steps = int(self.n_pieces.max(initial=0))

    def sums(self, emission: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log total of each text, and per word the marginal of toxic and of toxic after toxic."""
        shape = self.inside.shape
        x = np.ones(shape)
        x[self.inside] = np.exp(np.clip(emission, -30, 30))[self.places[self.inside]]
        ct, tt = step[0, 1] * x, step[1, 1] * x  # clean to toxic, toxic to toxic; clean to clean is 1
        tc = np.full(shape, step[1, 0])
        outside = ~self.inside
        ct[outside], tc[outside], tt[outside] = 0.0, 0.0, 1.0
        c0, c1, t0, t1, log = np.ones(shape[1]), np.zeros(shape[1]), np.zeros(shape[1]), np.ones(shape[1]), np.zeros(shape[1])
        for k in range(PIECE):  # transfer matrix of each piece: from clean (c0, c1) and from toxic (t0, t1)
            c0, c1 = c0 + c1 * tc[k], c0 * ct[k] + c1 * tt[k]
            t0, t1 = t0 + t1 * tc[k], t0 * ct[k] + t1 * tt[k]
            top = c0 + c1 + t0 + t1
            c0, c1, t0, t1 = c0 / top, c1 / top, t0 / top, t1 / top
            log += np.log(top)
        texts = len(self.first) - 1
        total = np.zeros(texts)
        ahead, behind = np.zeros((2, shape[1])), np.zeros((2, shape[1]))
        v0, v1, w0, w1 = np.ones(texts), np.zeros(texts), np.ones(texts), np.ones(texts)
        for k in range(self.steps):
            doc = np.flatnonzero(self.n_pieces > k)
            p, q = self.piece_first[doc] + k, self.piece_first[doc + 1] - 1 - k
            ahead[0, p], ahead[1, p], behind[0, q], behind[1, q] = v0[doc], v1[doc], w0[doc], w1[doc]
            n0, n1 = v0[doc] * c0[p] + v1[doc] * t0[p], v0[doc] * c1[p] + v1[doc] * t1[p]
            m0, m1 = c0[q] * w0[doc] + c1[q] * w1[doc], t0[q] * w0[doc] + t1[q] * w1[doc]
            size, other = n0 + n1, m0 + m1
            total[doc] += log[p] + np.log(size)
            v0[doc], v1[doc], w0[doc], w1[doc] = n0 / size, n1 / size, m0 / other, m1 / other
        a1 = np.empty((PIECE + 1, shape[1]))  # share of toxic before each word, given the words so far
        a1[0] = ahead[1] / (ahead[0] + ahead[1])
        for k in range(PIECE):
            n1 = (1 - a1[k]) * ct[k] + a1[k] * tt[k]
            a1[k + 1] = n1 / (n1 + 1 - a1[k] + a1[k] * tc[k])
        b0, b1, toxic, twice = behind[0], behind[1], np.empty(shape), np.empty(shape)
        for k in range(PIECE - 1, -1, -1):
            after = a1[k]
            from_c, from_t = (1 - after) * ct[k] * b1, after * tt[k] * b1
            rest = ((1 - after) + after * tc[k]) * b0
            size = from_c + from_t + rest
            toxic[k], twice[k] = (from_c + from_t) / size, from_t / size
            b0, b1 = b0 + ct[k] * b1, tc[k] * b0 + tt[k] * b1
            size = b0 + b1
            b0, b1 = b0 / size, b1 / size
        back = self.inside.T
        return np.maximum(total, 0.0), toxic.T[back], twice.T[back]


@dataclass
class Model:
    weights: np.ndarray  # per bucket of spellings
    step: np.ndarray
    calibration: np.ndarray | None
    share: float  # of toxic labels


def emissions(weights: np.ndarray, spelt: np.ndarray, doc: np.ndarray) -> np.ndarray:
    if not len(spelt):
        return np.zeros(0)
    out = weights[0] + weights[bucket(spelt)].sum(1)
    for h in neighbours(spelt[:, 0], doc):
        out += weights[bucket(h)]
    return out


def toxic_spellings(spelt: np.ndarray, doc: np.ndarray, toxic: np.ndarray, odds: float) -> np.ndarray:
    """Hashes of spellings whose documents are toxic far more often than all are; shares as among all labels."""
    keys, n, bad = [], [], []
    for column in spelt.T:
        key, number = np.unique(column, return_inverse=True)
        pairs = np.unique(doc * len(key) + number)
        keys.append(key)
        n.append(np.bincount(pairs % len(key), minlength=len(key)))
        bad.append(np.bincount(pairs % len(key), weights=toxic[pairs // len(key)], minlength=len(key)))
    keys, n, bad = (np.concatenate(x) for x in (keys, n, bad))
    rate = toxic.mean()  # of the sample
    part = lambda k, q: np.where(k > 0, k * np.log(np.maximum(k, 1) / (n * q)), 0.0)
    ratio = part(bad, rate) + part(n - bad, 1 - rate)
    among_all = bad * odds * (1 - rate) / rate
    return keys[(ratio >= MIN_RATIO) & (among_all >= MIN_SHARE * (among_all + n - bad))]


def fit(text: Bytes, toxic: np.ndarray, learn: np.ndarray, odds: float) -> Model:
    """toxic: label of each text; learn: texts for the field, the others calibrate; odds: of the labels among all."""
    share = odds / (1 + odds)
    none = Model(np.zeros(1 << BUCKET_BITS), np.ones((2, 2)), None, float(share))
    if not len(toxic) or len(set(toxic[learn].tolist())) < 2 or len(set(toxic[~learn].tolist())) < 2:
        return none
    _, _, doc, spelt = spellings(text)
    known = toxic_spellings(spelt[learn[doc]], doc[learn[doc]], toxic, odds)
    marked = np.any([np.isin(column, known) for column in spelt.T], axis=0) & (toxic[doc] > 0)
    told = learn & ((toxic == 0) | (np.bincount(doc, weights=marked, minlength=text.n) > 0))
    if not marked[told[doc]].any():
        return none
    use = told[doc]
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=text.n)[told])])
    blocks = np.unique(np.searchsorted(first, np.arange(0, first[-1], BLOCK)).clip(0, len(first) - 2))
    chains = [(first[i], Chain(first[i:j + 1] - first[i])) for i, j in zip(blocks, np.append(blocks[1:], len(first) - 1))]
    words, one, number = np.unique(spelt[use, 0], return_index=True, return_inverse=True)
    own = bucket(spelt[np.flatnonzero(use)[one]])
    near = [np.unique(bucket(h), return_inverse=True) for h in neighbours(spelt[use, 0], doc[use])]
    y = marked[use].astype(float)
    del spelt, marked
    twice = y[1:] * y[:-1]
    twice[first[1:-1][first[1:-1] > 0] - 1] = 0
    begins = np.zeros(len(y), bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    size = 1 << BUCKET_BITS
    w, logs = np.zeros(size), np.zeros(3)  # logs: clean to toxic, toxic to clean, toxic to toxic
    w[0] = -4.0
    seen, square = np.zeros(size + 3), np.zeros(size + 3)
    for i in range(1, ROUNDS + 1):
        step = np.array([[1.0, np.exp(logs[0])], [np.exp(logs[1]), np.exp(logs[2])]])
        e = w[0] + w[own].sum(1)[number]
        for places, at in near:
            e = e + w[places][at]
        sums = [chain.sums(e[at:at + chain.first[-1]], step)[1:] for at, chain in chains]
        err, more = np.concatenate([p for p, _ in sums]) - y, sum(pp.sum() for _, pp in sums) - twice.sum()
        g = np.bincount(own.reshape(-1), weights=np.repeat(np.bincount(number, weights=err, minlength=len(words)), own.shape[1]), minlength=size)
        for places, at in near:
            g[places] += np.bincount(at, weights=err, minlength=len(places))
        g[0] += err.sum()
        last = np.append(begins[1:], True)
        g = np.concatenate([g + RIDGE * w, [err.sum() - more, err[~last].sum() - more, more] + RIDGE * logs])
        seen, square = 0.9 * seen + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = RATE * (seen / (1 - 0.9 ** i)) / (np.sqrt(square / (1 - 0.99 ** i)) + 1e-6)
        w, logs = w - move[:size], np.clip(logs - move[size:], -8, 8)
    model = Model(w, np.array([[1.0, np.exp(logs[0])], [np.exp(logs[1]), np.exp(logs[2])]]), None, float(share))
    signs = evidence(model, only(text, ~learn))[0]
    model.calibration = logistic(signs, toxic[~learn])
    model.calibration[0] += np.log(odds) - np.log(toxic.mean() / (1 - toxic.mean()))  # from the sample's share to that of all labels
    return model


def only(text: Bytes, which: np.ndarray) -> Bytes:
    sizes = np.diff(text.off)[which]
    return Bytes(text.data[ragged(text.off[:-1][which], sizes)], np.concatenate([[0], np.cumsum(sizes)]))


def evidence(model: Model, text: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: 1, log odds of any toxic word, log odds of the likeliest one, log length; and the words' marginals."""
    starts, ends, doc, spelt = spellings(text)
    first = np.searchsorted(doc, np.arange(text.n + 1))
    total, p, _ = Chain(first).sums(emissions(model.weights, spelt, doc), model.step)
    top = np.zeros(text.n)
    has = np.diff(first) > 0
    top[has] = np.maximum.reduceat(p, first[:-1][has]) if has.any() else 0
    with np.errstate(divide="ignore", over="ignore"):
        any_odds = np.where(total > 30, total, np.log(np.expm1(np.minimum(total, 30))))
        top_odds = np.log(top) - np.log1p(-np.minimum(top, 1 - 1e-12))
    signs = np.stack([np.ones(text.n), np.clip(any_odds, -12, 12), np.clip(top_odds, -12, 12), np.log1p(np.diff(first))], 1)
    return signs, p, starts, ends, doc


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved until the loss falls."""
    scale = np.append(1.0, np.maximum(x[:, 1:].std(0), 1e-3))
    x = x / scale
    ridge = np.array([1e-4] + [1e-1] * (x.shape[1] - 1))
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + (ridge * w * w).sum() / 2
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
    return w / scale


def scores(model: Model, signs: np.ndarray) -> np.ndarray:
    if model.calibration is None:
        return np.full(len(signs), model.share)
    return 1 / (1 + np.exp(-np.clip(signs @ model.calibration, -30, 30)))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic_label")))
    n = dict(known.groupBy("toxic_label").count().collect())
    odds = (n.get(1, 0) + 1) / (n.get(0, 0) + 1)
    ids = known.filter("toxic_label = 1").orderBy(*by_hash).limit(MAX_TOXIC).union(known.filter("toxic_label = 0").orderBy(*by_hash).limit(MAX_CLEAN))
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic_label").orderBy(*by_hash, "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # at most MAX_TOXIC + MAX_CLEAN ids
            .withColumn("size", size).filter(F.col("size") <= MAX_BYTES)
            .select("text", "toxic_label", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) > 0).alias("learn"))
            .orderBy(*("toxic_label", "learn", "text")).toArrow())
    batch = rows.combine_chunks().to_batches()
    if not batch:
        return Model(np.zeros(1 << BUCKET_BITS), np.ones((2, 2)), None, odds / (1 + odds))
    (part, text), = text_chunks(batch[0], limit=1 << 40)
    return fit(text, part.column("toxic_label").to_numpy(zero_copy_only=False).astype(float), part.column("learn").to_numpy(zero_copy_only=False), odds)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, toxic_words, spans): spans in characters of the text, with their largest marginal."""
    spark = docs.sparkSession
    session.ship(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKET_BITS bits of weights, 8 MB
    names = ["doc_id", "held_out", "score", "predicted", "toxic_words", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, text in text_chunks(batch, limit=CHUNK):
                signs, p, starts, ends, doc = evidence(m, text)
                s = scores(m, signs)
                hot = np.flatnonzero(p >= 0.5) if m.calibration is not None else np.zeros(0, np.int64)
                begin = np.ones(len(hot), bool)
                begin[1:] = (np.diff(hot) > 1) | (doc[hot[1:]] != doc[hot[:-1]])
                a = np.flatnonzero(begin)
                z = np.append(a[1:], len(hot))[:len(a)] - 1
                chars = np.concatenate([[0], np.cumsum((text.data & 0xC0) != 0x80)])
                of = doc[hot[a]]
                base = chars[text.off[of]]
                spans = pa.StructArray.from_arrays(
                    [pa.array(chars[starts[hot[a]]] - base), pa.array(chars[ends[hot[z]]] - base),
                     pa.array(np.maximum.reduceat(p[hot], a) if len(a) else np.zeros(0))], ["start", "end", "probability"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)),
                     pa.array(np.bincount(doc[hot], minlength=text.n)),
                     pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(text.n + 1)).astype(np.int32)), spans)], names)

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, toxic_words bigint, "
        "spans array<struct<start:bigint,end:bigint,probability:double>>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir)
    return scored(docs, train(docs, load(spark, sf_dir, "labels")))
