"""Groups of near-duplicates at a Jaccard similarity of 4 / 5 or more of word-shingle sets, by ball hashing of short SimHashes.

At that similarity a SimHash bit differs with a chance of 0.15, so one long fingerprint within a few bits finds almost none. Each
document therefore has SEEDS seeded fingerprints: the least shingle of its set under the seed (equal with a chance of the
similarity) and a SimHash of BITS bits. Each fingerprint emits its variants within REACH / 2 bits, and two that differ in REACH
bits or fewer meet in a bucket: by one seed with a chance of 0.44 at 0.8, by one of eight with 0.99. The least shingle keeps the
buckets small whatever the number of documents, the SimHash splits those of a frequent passage.

Variants that no other set has are dropped at once; the rounds below deal out only the others. In a bucket, sets that also share the
least shingle of one more seed are linked to the first of them in a seeded order, and those first ones to the first of the bucket:
at most one link for a variant. Every row brings the size and the parity sketch of its set (see similar.py): two sketches differ in no
more bits than the sets in shingles, so a link whose sketches differ too much is no link and ends there, before any set is sent.
The others are verified by the sets themselves. ROUNDS further rounds divide and order the buckets by other seeds and link only what is
in different components yet, so a group whose first is like few of its members still comes together. Components of verified links are
the groups.

Defined cases: null text: empty; texts without a word have one set and form one group; equal sets are one node before anything is
emitted, whatever the number of copies; null ids come last; rows are told apart by id and text, so of a group one row stays even
if rows are repeated or share an id. Sets and shingles are known by 64-bit hashes: different ones could in principle collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meterline import session
from meterline.llm.common import mix64, n_partitions, stored, text_chunks
from meterline.llm.components import components
from meterline.llm.similar import digests, sets, sketches
from meterline.llm.simhash import ball, majority, shingle_hashes

SEEDS = 8
BITS = 16
REACH = 2
ROUNDS = 4
SLICE = 1000  # members compared with one copy of the first of their bucket
EMIT_ROWS = 100  # sets whose variants are made at once
_STEP = 0x9E3779B97F4A7C15


def _seed(i: int) -> np.uint64:
    return np.uint64((i + 1) * _STEP & (1 << 64) - 1)


def prints(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document and seed: the least shingle and the short SimHash; h holds the sets end to end, all with a shingle at least."""
    begin = np.cumsum(sizes) - sizes
    least = np.stack([np.minimum.reduceat(mix64(h ^ _seed(100 + s)), begin) for s in range(SEEDS)], 1)
    per = 64 // BITS
    wide = [majority(mix64(h ^ _seed(s)), sizes) for s in range(-(-SEEDS // per))]
    short = np.stack([wide[s // per] >> np.uint64(BITS * (s % per)) & np.uint64((1 << BITS) - 1) for s in range(SEEDS)], 1)
    return least, short


def variant_keys(least: np.ndarray, short: np.ndarray) -> np.ndarray:
    """(documents, SEEDS, variants): the keys of the balls; the last bits of a key tell its seed."""
    masks = ball(list(range(BITS)), REACH // 2)
    near = (short[:, :, None] ^ masks[None, None, :]) * np.uint64(_STEP)
    key = mix64(mix64(least)[:, :, None] + near)
    return key // np.uint64(SEEDS) * np.uint64(SEEDS) + np.arange(SEEDS, dtype=np.uint64)[None, :, None]


def described(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, th, node, least, short, size, sketch) of each row; th is a hash of the text, node of its set; both lists are empty without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch):
                h, sizes = sets(*shingle_hashes(text, n))
                full = sizes > 0
                a = b = np.zeros(0, np.uint64)
                if full.any():
                    a, b = prints(h, sizes[full])
                off = pa.array(np.concatenate([[0], np.cumsum(full * SEEDS)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x.ravel().view(np.int64))) for x in (a, b)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(digests(h, sizes).view(np.int64)), *lists,
                     pa.array(sizes.astype(np.int64)), pa.array(sketches(h, sizes), pa.binary())],
                    ["doc_id", "th", "node", "least", "short", "size", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
        run, f"doc_id {kind}, th bigint, node bigint, least array<bigint>, short array<bigint>, size bigint, sketch binary")


def _keys(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the least shingles by seed, and the keys of all variants of all seeds."""
    least, short = (part.column(c).flatten().to_numpy().view(np.uint64).reshape(part.num_rows, SEEDS) for c in ("least", "short"))
    return least, variant_keys(least, short).reshape(part.num_rows, -1)


def shared(each: DataFrame) -> DataFrame:
    """(node, slots) of each set that has a variant with another one: which of its variants they are, by their place in _keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 5 * EMIT_ROWS):
                part = batch.slice(lo, 5 * EMIT_ROWS)
                _, keys = _keys(part)
                slot = np.tile(np.arange(keys.shape[1], dtype=np.int32), part.num_rows)
                node = np.repeat(part.column("node").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node), pa.array(slot)], ["key", "node", "slot"])

    rows = each.filter(F.size("least") > 0).select("node", "least", "short").mapInArrow(run, "key bigint, node bigint, slot int")
    some = rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    return some.groupBy("node").agg(F.collect_list("slot").alias("slots"))


def emitted(each: DataFrame, turn: int) -> DataFrame:
    """(key, second, node, component, size, sketch) of the variants in slots, or of all; second is the least shingle of another seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, EMIT_ROWS):
                part = batch.slice(lo, EMIT_ROWS)
                least, keys = _keys(part)
                slots = part.column("slots")
                slot, row = slots.flatten().to_numpy(), np.repeat(np.arange(part.num_rows), slots.value_lengths().to_numpy())
                second = np.roll(least, -1 - turn, 1)[row, slot // (keys.shape[1] // SEEDS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in (keys[row, slot], second)]
                    + [part.column(c).take(pa.array(row)) for c in ("node", "component", "size", "sketch")],
                    ["key", "second", "node", "component", "size", "sketch"])

    slots = "slots" if "slots" in each.columns else F.sequence(F.lit(0), F.lit(SEEDS * len(ball(list(range(BITS)), REACH // 2)) - 1)).alias("slots")
    some = each.filter(F.size("least") > 0).select("node", "component", "least", "short", "size", "sketch", slots)
    return some.mapInArrow(run, "key bigint, second bigint, node bigint, component bigint, size bigint, sketch binary")


def may_link(x: int, y: int, a: bytes, b: bytes) -> bool:
    """Whether sets of x and y shingles with sketches a and b can have a similarity of 4 / 5: they differ in a ninth of x + y at most."""
    if 5 * min(x, y) < 4 * max(x, y):
        return False
    if len(a) > len(b):
        a, b = b, a
    p, q, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 4 * len(b)
    if len(b) > len(a):  # sizes this close have sketches a level apart at most
        q = (q >> bits) ^ (q & (1 << bits) - 1)
    return 9 * (p ^ q).bit_count() <= x + y


def _sketch(kept: list[tuple], column: pa.Array, i: int) -> bytes:
    """The sketch at place i of a batch that comes after the two rows kept."""
    return kept[i][3] if i < 2 else column[i - 2].as_py()


def linked(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): each set with the first that shares its key and second shingle, those with the first of the key; none inside a
    component, none that the sketches rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, [(0, 0, 0, b"")] * 2  # the firsts of the key and of the part that the batch before left
        for batch in batches:
            if not batch.num_rows:
                continue
            key, second = (batch.column(c).to_numpy() for c in ("key", "second"))
            node, comp, size = (np.concatenate([[x[i] for x in kept], batch.column(c).to_numpy()]) for i, c in enumerate(("node", "component", "size")))
            sketch = batch.column("sketch")
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            part = first.copy()
            part[1:] |= second[1:] != second[:-1]
            if last is not None:
                first[0] = key[0] != last[0]
                part[0] = first[0] or second[0] != last[1]
            here = np.arange(2, len(key) + 2)  # after the two that were kept
            top = np.maximum.accumulate(np.where(first, here, 0))
            sub = np.maximum(np.maximum.accumulate(np.where(part, here, 0)), 1)
            head = np.where(part, top, sub)
            some = np.flatnonzero(comp[head] != comp[here])
            if len(some):
                a, b = head[some], here[some]
                pairs, at = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], 1), axis=0, return_index=True)
                pairs = pairs[[may_link(int(size[i]), int(size[j]), _sketch(kept, sketch, i), _sketch(kept, sketch, j))
                               for i, j in zip(a[at].tolist(), b[at].tolist())]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            last = key[-1], second[-1]
            kept = [(node[i], comp[i], size[i], _sketch(kept, sketch, i)) for i in (int(top[-1]), int(sub[-1]))]

    order = F.xxhash64("node", F.pmod("key", F.lit(SEEDS)), F.lit(turn))
    dealt = rows.repartition(n_partitions(rows.sparkSession), "key").sortWithinPartitions("key", "second", order)
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def held(nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(node, hashes): the set of each node, made once from its first text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch):
                h, sizes = sets(*shingle_hashes(text, n))
                raw, ends = h.tobytes(), (8 * np.cumsum(sizes)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([raw[a:b] for a, b in zip([0, *ends], ends)], pa.binary())], ["node", "hashes"])

    want = nodes.select("node", F.col("first.doc_id").alias("__id"), F.col("first.th").alias("__th"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    texts = texts.join(want, (F.col("th") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return texts.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node bigint, hashes binary")


def verified(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The pairs whose sets have a similarity of 4 / 5 or more.

    The set of a goes once to every SLICE or so of its partners, so no task holds all partners of one set.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SLICE)).alias("slices"))
    members = pairs.join(counts, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("slices")).alias("slice"))
    heads = counts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    sent = members.unionByName(heads).join(hashes, "node").select("a", "slice", "node", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mine = np.zeros(0, np.uint64), None
        for batch in batches:
            out = []
            for a, node, raw in zip(batch.column("a").to_pylist(), batch.column("node").to_pylist(), batch.column("hashes")):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                if node == a:
                    head, mine = x.copy(), a
                elif mine == a and 5 * min(len(x), len(head)) >= 4 * max(len(x), len(head)):
                    at = np.minimum(np.searchsorted(head, x), len(head) - 1)
                    if 9 * int((head[at] == x).sum()) >= 4 * (len(x) + len(head)):
                        out.append((a, node))
            if out:
                x, y = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    dealt = sent.repartition(n_partitions(pairs.sparkSession), "a", "slice").sortWithinPartitions("a", "slice", F.col("node") != F.col("a"))
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _labelled(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    return nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def grouped(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, node) of each row, and (node, first, component) of each set; first is its least (id, text)."""
    session.ship(docs.sparkSession)
    rows = stored(described(docs, n), "near")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    each = stored(rows.groupBy("node").agg(first, *(F.first(c).alias(c) for c in ("least", "short", "size", "sketch"))), "near-distinct")
    met = stored(each.join(shared(each), "node"), "near-met")  # the others have no variant with any set
    hashes = stored(held(met, docs, n), "near-sets")
    tried = joined = None
    now = met.withColumn("component", F.col("node"))
    for turn in range(1 + ROUNDS):
        pairs = linked(emitted(now, turn), turn)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "near-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if pairs.isEmpty():
            continue
        links = stored(verified(pairs, hashes), "near-links")
        if links.isEmpty():
            continue
        if joined is not None:  # what is together already is a star
            links = links.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
        joined = components(links)
        now = _labelled(met, joined)
    now = each.withColumn("component", F.col("node")) if joined is None else _labelled(each, joined)
    return rows.select("doc_id", "th", "node"), now.select("node", "first", "component")


def representatives(docs: DataFrame, n: int = 5) -> DataFrame:
    """docs with one row of each group: the least id, then the least text hash; of repeated rows any one."""
    rows, nodes = grouped(docs, n)
    keepers = nodes.groupBy("component").agg(F.min("first").alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__th"))
    many = rows.groupBy(F.col("doc_id").alias("__id2"), F.col("th").alias("__th2")).count().filter("count > 1").drop("count").withColumn("__many", F.lit(True))
    keepers = keepers.join(many, (F.col("__th") == F.col("__th2")) & F.col("__id").eqNullSafe(F.col("__id2")), "left").select("__id", "__th", "__many")
    kept = docs.withColumn("__own", F.xxhash64("text"))
    kept = kept.join(keepers, (F.col("__own") == F.col("__th")) & kept["doc_id"].eqNullSafe(F.col("__id")))
    once = kept.filter("__many IS NULL")
    again = kept.filter("__many").dropDuplicates(["__id", "__th"])
    return once.unionByName(again).select(*docs.columns)
