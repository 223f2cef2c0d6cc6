"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most RADIUS bits share a variant within RADIUS / 2 bits of either, and any two that
share one differ in at most RADIUS. So every fingerprint emits its ball of variants, the variants are shuffled, and
those in one bucket (at most one ball) are linked to the least of them: no pairs, no lost link.

A ball has 2 081 variants, so a fingerprint emits it only if it can have a partner at all. This is settled exactly by
the same step on a part: of three groups of bits one has two or more of the four differences, without it at most two
are left, and then the rest of the bits has a common variant within one bit. Fingerprints with no shared variant of the
rest, for any of the three groups, have no partner.

Defined cases: null text: empty; no words: fingerprint 0, linked like any other; rows with equal ids are separate
documents; ids that are null are greater than any; other columns are left out by fingerprinted() and kept by representatives().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline import session
from meterline.llm.common import Bytes, load, mix64, n_partitions, ragged, stored, text_chunks
from meterline.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
GROUPS = [(0, 22), (22, 43), (43, 64)]
EMIT_ROWS = 500  # fingerprints whose variants are made at once


def shingle_hashes(text: Bytes, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle and how many each document has; its words are joined by single blanks."""
    text = text.lower()
    starts, ends, doc = text.words()
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1  # each word in the joined text, a blank after it
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    joined[ragged(at, size)] = text.data[ragged(starts, size)]
    raw = joined.tobytes()
    words = np.bincount(doc, minlength=text.n)
    counts = np.where(words == 0, 0, np.maximum(words - n + 1, 1))
    first = ragged(np.cumsum(words) - words, counts)
    last = first + np.repeat(np.minimum(words, n) - 1, counts)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] + size[last]).tolist())), np.uint64, len(first))
    return h, counts


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bit is 1 if it is set in over half of a document's hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        begin = (np.cumsum(counts) - counts)[full]
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit)).astype(np.uint8) & 1, begin, dtype=np.int64)
            out[full] |= (2 * ones > counts[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprinted(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    session.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch):
                fp = majority(*shingle_hashes(text, n)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def ball(bits: list[int], radius: int) -> np.ndarray:
    """Masks that flip up to `radius` of the bits."""
    return np.array([sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(bits, r)], np.uint64)


def rest_keys(fp: np.ndarray) -> np.ndarray:
    """Per fingerprint: for each group left out, the variants of the other bits within one bit, as keys."""
    keys = []
    for i, (lo, hi) in enumerate(GROUPS):
        others = [b for b in range(64) if not lo <= b < hi]
        rest = fp & np.uint64(sum(1 << b for b in others))
        keys.append(mix64((rest[:, None] ^ ball(others, RADIUS // 4)[None, :]) + np.uint64(i) * np.uint64(0xA24BAED4963EE407)))
    return np.concatenate(keys, 1)


def ball_keys(fp: np.ndarray) -> np.ndarray:
    return fp[:, None] ^ ball(list(range(64)), RADIUS // 2)[None, :]


def _emitted(fps: DataFrame, keys) -> DataFrame:
    """(key, fp) for every key of every fingerprint, dealt out by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(fp), EMIT_ROWS):
                some = fp[lo:lo + EMIT_ROWS]
                k = keys(some)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(np.repeat(some, k.shape[1]).view(np.int64))], ["key", "fp"])

    return fps.mapInArrow(run, "key bigint, fp bigint").repartition(n_partitions(fps.sparkSession), "key")


def _buckets(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one partition's (key, fp): fingerprints sorted by (key, fp), and whether each has its key from the one before or gives it to the next."""
    parts = [(b.column("key").to_numpy(), b.column("fp").to_numpy()) for b in batches]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
    key, fp = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    follows = np.zeros(len(key), bool)
    follows[1:] = key[1:] == key[:-1]
    leads = np.zeros(len(key), bool)
    leads[:-1] = follows[1:]
    return fp, follows, leads


def with_partner(fps: DataFrame) -> DataFrame:
    """The fingerprints that share a variant of their rest with another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, follows, leads = _buckets(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(fp[follows | leads]))], ["fp"])

    return _emitted(fps, rest_keys).mapInArrow(run, "fp bigint").distinct()


def linked(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints within RADIUS bits of each other, directly or by the least of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, follows, _ = _buckets(batches)
        head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(fp))))
        a, b = fp[follows], fp[head[follows]]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    pairs = _emitted(fps, ball_keys).mapInArrow(run, "a bigint, b bigint").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def clustered(docs: DataFrame, n: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of all documents; (fp, component_id, n) for each fingerprint: least id reachable, documents that have it."""
    prints = stored(fingerprinted(docs, n), "simhash")
    each = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    spread = n_partitions(docs.sparkSession)
    suspects = stored(with_partner(each.select("fp").repartition(spread)), "simhash-suspects")
    joined = components(linked(suspects.repartition(spread)))
    named = each.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints, named.join(least, "component").select("fp", "component_id", "n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints, classes = clustered(load(spark, sf_dir))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, n: int = 5) -> DataFrame:
    """docs with one row of each group at a shingle similarity of 0.8 or more, by short seeded fingerprints; see near.py.

    Copies at 0.8 differ in 9 or 10 of 64 bits on average, out of the reach of the ball above.
    """
    from meterline.llm import near

    return near.representatives(docs, n)
