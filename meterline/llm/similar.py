"""Groups of documents whose sets of word shingles have a Jaccard similarity of 4 / 5 or more: every pair, none by chance.

Two such sets of a and b shingles share ceil(4a / 5) at least, so in any one order of all shingles they have one in common
among the first a - ceil(4a / 5) + 1 of the one and likewise of the other. Those prefixes are the keys of the buckets. The
order is by hash, but shingles that are frequent in a sample come last, by frequency; the sample only decides how full the
buckets are. Equal sets are one node. In a bucket, pairs are candidates if sizes and parity sketches allow the similarity (a sketch
has the parity of how many shingles hash to each bit, so two differ in no more bits than the sets differ in shingles) and
are verified by the sets themselves: first each node with the least of its bucket, then all pairs that this left in
different components.

Sets and shingles are known by 64-bit hashes: different ones could in principle collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterline import session
from meterline.llm.common import mix64, n_partitions, ragged, stored, text_chunks
from meterline.llm.components import components
from meterline.llm.simhash import shingle_hashes

SAMPLE = 8  # one text in so many tells the frequent shingles
FREQUENT = 4  # texts of the sample
LISTED = 50_000  # most frequent shingles at most, a bound of what every task is sent
SKETCH_BITS = 512  # of the least sketch; larger sets have one of twice as many, and so on, LEVELS in all
LEVELS = 6
SEND_BYTES = 1 << 23


def sets(h: np.ndarray, counts: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each document, by rank and hash, and how many there are."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, doc) if rank is None else (h, rank, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(counts))


def ranks(h: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """0 for shingles that are not frequent, then by frequency; `frequent` is sorted."""
    if not len(frequent):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return np.where(frequent[at] == h, place[at], 0)


def digests(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash of each set, whatever its order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return mix64(total[ends] - total[ends - sizes] + sizes.astype(np.uint64))


def sketches(h: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity of the number of hashes of each kind, packed; about as many kinds as hashes, within the bounds above."""
    level = np.minimum(np.ceil(np.log2(np.maximum(sizes, SKETCH_BITS) / SKETCH_BITS)).astype(np.int64), LEVELS - 1)
    bits = SKETCH_BITS << level
    begin = np.cumsum(bits) - bits
    kind = np.repeat(begin, sizes) + (mix64(h) % np.repeat(bits, sizes).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(kind, minlength=int(bits.sum())) & 1).astype(np.uint8)).tobytes()
    return [raw[a:a + b] for a, b in zip((begin // 8).tolist(), (bits // 8).tolist())]


class Sketches:
    """Sketches of many sets; those of the next level fold to one's own, as the kinds are remainders."""

    def __init__(self, raw: list[bytes]) -> None:
        self.level = np.array([(len(x) * 8 // SKETCH_BITS).bit_length() - 1 for x in raw], np.int64)
        self.at = np.zeros(len(raw), np.int64)
        self.own, self.folded = {}, {}
        for k in np.unique(self.level).tolist():
            rows = np.flatnonzero(self.level == k)
            self.at[rows] = np.arange(len(rows))
            self.own[k] = np.frombuffer(b"".join(raw[i] for i in rows.tolist()), np.uint64).reshape(len(rows), -1)
            half = self.own[k].shape[1] // 2
            self.folded[k] = self.own[k][:, :half] ^ self.own[k][:, half:]

    def apart(self, i: int, j: np.ndarray) -> np.ndarray:
        """In how many shingles at least i differs from each of j; 0 where the levels are not next to each other."""
        out, k, a = np.zeros(len(j), np.int64), int(self.level[i]), int(self.at[i])
        for other in (k - 1, k, k + 1):
            some = np.flatnonzero(self.level[j] == other)
            if len(some):
                x = self.folded[k][a] if other < k else self.own[k][a]
                y = self.folded[other] if other > k else self.own[other]
                out[some] = np.bitwise_count(y[self.at[j[some]]] ^ x).sum(1, dtype=np.int64)
        return out


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, text in text_chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(sets(*shingle_hashes(text, n))[0].view(np.int64))], ["h"])

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    rows = some.mapInArrow(run, "h bigint").groupBy("h").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(LISTED).collect()
    keys = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (len(rows) - np.arange(len(rows)))[order]


def described(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, th, node, size, sketch, prefix) of each row; th is a hash of the text, node of its set."""
    frequent, place = _frequent(docs, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch):
                h, counts = shingle_hashes(text, n)
                h, sizes = sets(h, counts, ranks(h, frequent, place))
                first = np.where(sizes == 0, 0, sizes - (4 * sizes + 4) // 5 + 1)
                prefix = h[ragged(np.cumsum(sizes) - sizes, first)].view(np.int64)
                off = np.concatenate([[0], np.cumsum(first)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(digests(h, sizes).view(np.int64)), pa.array(sizes),
                     pa.array(sketches(h, sizes), pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(prefix))],
                    ["doc_id", "th", "node", "size", "sketch", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th bigint, node bigint, size bigint, sketch binary, prefix array<bigint>")


def _read(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    some = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(some) if some else None


def members(each: DataFrame) -> DataFrame:
    """(key, node, size, sketch) of the buckets with two nodes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _read(batches)
        if t is None:
            return
        key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        same = key[1:] == key[:-1]
        some = np.append(same, False) | np.append(False, same)
        yield from pa.table({"key": key[some], "node": node[some]}).to_batches(50_000)

    n = n_partitions(each.sparkSession)
    shared = each.select(F.explode("prefix").alias("key"), "node").repartition(n, "key").mapInArrow(run, "key bigint, node bigint")
    return shared.join(each.select("node", "size", "sketch"), "node").select("key", "node", "size", "sketch")


def candidates(rows: DataFrame, star: bool) -> DataFrame:
    """(a, b), a < b: nodes of one bucket that may be similar and differ in component; if star, only with the least of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _read(batches)
        if t is None:
            return
        key, node, size, comp = (t.column(c).to_numpy() for c in ("key", "node", "size", "component"))
        order = np.lexsort((node, key))
        key, node, size, comp = key[order], node[order], size[order], comp[order]
        bits = Sketches(t.column("sketch").take(order).to_pylist())
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        found: list[np.ndarray] = []
        held = 0
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
            if comp[lo] == comp[hi - 1] and (comp[lo:hi] == comp[lo]).all():
                continue
            for i in range(lo, lo + 1 if star else hi - 1):
                j = np.arange(i + 1, hi)
                j = j[(comp[j] != comp[i]) & (5 * np.minimum(size[j], size[i]) >= 4 * np.maximum(size[j], size[i]))]
                j = j[9 * bits.apart(i, j) <= size[j] + size[i]]
                if len(j):
                    found.append(np.stack([np.full(len(j), node[i]), node[j]], 1))
                    held += len(j)
            if held > 200_000:
                pairs, found, held = np.unique(np.concatenate(found), axis=0), [], 0
                yield from pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}).to_batches(50_000)
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield from pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}).to_batches(50_000)

    return rows.repartition(n_partitions(rows.sparkSession), "key").mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """The pairs whose sets have a similarity of 4 / 5 or more; reps: (node, doc_id, th) of one row each."""
    asked = (pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "a", "b"), F.struct(F.col("b").alias("node"), "a", "b"))).alias("x"))
             .select("x.*").groupBy("node").agg(F.collect_list(F.struct("a", "b")).alias("asked")))
    want = reps.join(asked, "node").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "node", "asked")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    texts = texts.join(want, (F.col("th") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "asked", "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch):
                h, sizes = sets(*shingle_hashes(text, n))
                ends = np.cumsum(sizes)
                for i in range(text.n):
                    raw = h[ends[i] - sizes[i]:ends[i]].tobytes()
                    x = part.column("asked").slice(i, 1).flatten()
                    a, b = x.field("a"), x.field("b")
                    step = max(1, SEND_BYTES // max(1, len(raw)))
                    for lo in range(0, len(a), step):
                        k = min(step, len(a) - lo)
                        yield pa.RecordBatch.from_arrays([a.slice(lo, k), b.slice(lo, k), pa.array([part.column("node")[i].as_py()] * k, pa.int64()), pa.array([raw] * k, pa.binary())],
                                                         ["a", "b", "node", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], tuple[int, bytes]] = {}
        for batch in batches:
            out = []
            for a, b, node, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "node", "hashes"))):
                other = waiting.get((a, b))
                if other is None:
                    waiting[a, b] = node, raw
                elif other[0] != node:
                    del waiting[a, b]
                    x, y = np.frombuffer(raw, np.uint64), np.frombuffer(other[1], np.uint64)
                    if 9 * len(np.intersect1d(x, y, True)) >= 4 * (len(x) + len(y)):
                        out.append((a, b))
            if out:
                x, y = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    spread = n_partitions(docs.sparkSession)
    return texts.mapInArrow(send, "a bigint, b bigint, node bigint, hashes binary").repartition(spread, "a", "b").mapInArrow(compare, "a bigint, b bigint").distinct()


def _named(rows: DataFrame, joined: DataFrame) -> DataFrame:
    return rows.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def grouped(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, th, component) of each row: rows of similar texts, directly or by others, have one component."""
    session.ship(docs.sparkSession)
    rows = stored(described(docs, n), "similar")
    each = stored(rows.select("node", "size", "sketch", "prefix").dropDuplicates(["node"]), "similar-distinct")
    reps = (rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r"))
            .select("node", "r.doc_id", "r.th"))
    buckets = stored(members(each), "similar-buckets")
    tried = stored(candidates(buckets.withColumn("component", F.col("node")), True), "similar-star")
    links = stored(verified(tried, docs, reps, n), "similar-links")
    rest = stored(candidates(_named(buckets, components(links)), False).join(tried, ["a", "b"], "left_anti"), "similar-rest")
    more = stored(verified(rest, docs, reps, n), "similar-more")
    return _named(rows.select("doc_id", "th", "node"), components(links.unionByName(more))).select("doc_id", "th", "component")
