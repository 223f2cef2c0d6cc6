"""Removal of long repeated byte strings by sorting suffixes.

A window of LENGTH bytes is repeated if it starts twice anywhere. Windows are told apart by tokens, 64-bit hashes of
byte runs inside them. The first token of a window is its anchor, the least hash among its runs of ANCHOR bytes; windows
side by side with one anchor form a unit, whose second token is its whole extent. Units are sorted by (first token,
second token): sampled splitters range-partition them, each bucket is sorted by multikey quicksort, and neighbours are
compared, also across the borders of buckets. Units with both tokens repeated are repeated throughout; with a first
token of its own a unit has no repeated window; the others are cut into smaller units and sorted again: first into
blocks of BLOCK windows (first token: the bytes that all its windows share), then into single windows. So a string
is compared with its neighbours only, whatever the number of its copies.

Defined cases: null or short text: nothing removed; rows with equal ids are separate documents, so equal texts of LENGTH
bytes or more are repeated; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meterline import session
from meterline.llm.common import Bytes, Rolling, load, mix64, n_partitions, ragged, stored, text_chunks

LENGTH = 400
CHUNK = 1 << 20  # bytes of text worked on at once
ANCHOR = 32
BLOCK = 32
PIECE = 1 << 23  # windows whose anchors are found at once; places must fit 24 bits with a window's length


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` values the place of the last least one (van Herk: block prefixes and suffixes)."""
    n = len(h)
    count = n - width + 1
    size = -(-n // width) * width
    # ties go to the later place: compare (value, -place) as one key by rank of value in the upper bits
    key = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64(24)
    key[:n] = (h >> low << low) | ((np.uint64((1 << 24) - 1) - np.arange(n, dtype=np.uint64)) & np.uint64((1 << 24) - 1))
    rows = key.reshape(-1, width)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[:count], before[width - 1:width - 1 + count])
    return (np.uint64((1 << 24) - 1) - (least & np.uint64((1 << 24) - 1))).astype(np.int64)


class Units:
    """The units of a batch of documents: first window, number of windows, anchor, document and both tokens of each."""

    def __init__(self, text: Bytes) -> None:
        self.rolling = Rolling(text.values())
        size = len(text.data)
        windows = size - LENGTH + 1
        self.first = self.n = self.anchor = self.doc = np.zeros(0, np.int64)
        self.t1 = self.t2 = np.zeros(0, np.uint64)
        if windows < 1:
            return
        grams = np.arange(size - ANCHOR + 1)
        h = self.rolling.of(grams, grams + ANCHOR)
        anchor = np.concatenate([
            least_places(h[a:min(a + PIECE, windows) + LENGTH - ANCHOR], LENGTH - ANCHOR + 1) + a
            for a in range(0, windows, PIECE)])  # in pieces whose places fit the keys
        edge = np.zeros(size + 1, np.int64)
        np.add.at(edge, text.off[1:-1], 1)
        doc = np.cumsum(edge[:-1])  # empty texts share an edge
        inside = doc[:windows] == doc[LENGTH - 1:]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:windows] != doc[:windows - 1])
        self.first = np.flatnonzero(new)
        ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        self.n = ends - self.first + 1
        self.anchor = anchor[self.first]
        self.doc = doc[self.first]
        self.t1 = h[self.anchor]
        self.t2 = self._extent(self.first, self.n, self.anchor)

    def _extent(self, first: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        place = (anchor - first).astype(np.uint64)
        return mix64(self.rolling.of(first, first + n - 1 + LENGTH) + mix64(place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """(unit, first, n, t1, t2) of the blocks of some units: windows whose distance to the anchor has one quotient by BLOCK."""
        first, n, anchor = self.first[which], self.n[which], self.anchor[which]
        far, near = (anchor - first) // BLOCK, (anchor - first - n + 1) // BLOCK
        count = far - near + 1
        part = ragged(near, count)
        unit = np.repeat(np.arange(len(which)), count)
        first, n, anchor = first[unit], n[unit], anchor[unit]
        core = anchor - part * BLOCK
        lo = np.maximum(first, core - BLOCK + 1)
        hi = np.minimum(first + n - 1, core)
        t1 = mix64(self.rolling.of(core, core + LENGTH - BLOCK + 1) + mix64(part.astype(np.uint64) + np.uint64(2)))
        return unit, lo, hi - lo + 1, t1, self._extent(lo, hi - lo + 1, anchor)


def _distinct(doc: np.ndarray, t1: np.ndarray, t2: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct token pairs of each document: document, tokens, whether the pair is there again, whether any row needs a verdict."""
    order = np.lexsort((t2, t1, doc))
    doc, t1, t2, need = doc[order], t1[order], t2[order], need[order]
    new = np.ones(len(t1), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
    at = np.flatnonzero(new)
    return doc[at], t1[at], t2[at], np.diff(np.append(at, len(t1))) > 1, np.maximum.reduceat(need, at) if len(at) else need


class Acts:
    """What was found for the units of a batch of documents, by level; looked up by document and both tokens."""

    def __init__(self, found: pa.ListArray) -> None:
        counts = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        v = found.flatten()
        level, t1, t2, act = (v.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        key = self._key(np.repeat(np.arange(len(counts)), counts), t1.view(np.uint64), t2.view(np.uint64))
        self.levels = {}
        for k in range(3):
            here = np.flatnonzero(level == k)
            order = here[np.argsort(key[here])]
            self.levels[k] = key[order], act[order].astype(np.int64)

    @staticmethod
    def _key(doc: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
        return mix64(t1 + mix64(t2 + mix64(doc.astype(np.uint64))))

    def _act(self, level: int, doc: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
        keys, act = self.levels[level]
        if not len(keys):
            return np.zeros(len(t1), np.int64)
        key = self._key(doc, t1, t2)
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[k] == key, act[k], 0)

    def yes(self, level: int, doc: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self._act(level, doc, t1, t2) & 1)

    def split(self, level: int, doc: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units to cut smaller, and which of them wait for a verdict (the others only stand for a repeated pair)."""
        act = self._act(level, doc, t1, t2)
        which = np.flatnonzero(act & 2)
        return which, (act[which] & 4) > 0


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by several keys: sorted by the first; only runs that tie are sorted on by the next."""
    order = np.argsort(keys[0])
    for depth in range(1, len(keys)):
        tie = np.ones(len(order), bool)
        for k in keys[:depth]:
            tie[1:] &= k[order][1:] == k[order][:-1]
        if len(tie):
            tie[0] = False
        run = np.cumsum(~tie)
        inside = tie.copy()
        inside[:-1] |= tie[1:]
        some = np.flatnonzero(inside)
        order[some] = order[some][np.lexsort((keys[depth][order[some]], run[some]))]
    return order


SORTED = "bucket int, place bigint, t1 bigint, t2 bigint, doc_id {id}, many boolean, need boolean, twice boolean, mixed boolean, head boolean"


def compared(units: DataFrame) -> DataFrame:
    """units (t1, t2, doc_id, many, need) with verdict and head.

    verdict YES: the pair of tokens occurs again (or many: twice in its document); SPLIT: only the first token does, or
    it does and other pairs need this one's parts to compare with. head marks one row of each pair.
    """
    spark = units.sparkSession
    kind = units.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        t1, t2 = (table.column(c).to_numpy() for c in ("t1", "t2"))
        table = table.take(order := multikey_order([t1, t2]))
        t1, t2 = t1[order], t2[order]
        same1, same2 = np.zeros(len(t1), bool), np.zeros(len(t1), bool)
        same1[1:] = t1[1:] == t1[:-1]
        same2[1:] = same1[1:] & (t2[1:] == t2[:-1])
        after = np.append(same2[1:], False)
        run_of = np.cumsum(~same1) - 1
        kinds = np.bincount(run_of, ~same2)
        yield from pa.Table.from_arrays(
            [pa.array(np.full(len(t1), TaskContext.get().partitionId(), np.int32)), pa.array(np.arange(len(t1))), pa.array(t1), pa.array(t2),
             table.column("doc_id"), table.column("many"), table.column("need"), pa.array(same2 | after), pa.array(kinds[run_of] > 1), pa.array(~same2)],
            ["bucket", "place", "t1", "t2", "doc_id", "many", "need", "twice", "mixed", "head"]).to_batches()

    ranged = units.repartitionByRange(n_partitions(spark), "t1", "t2", "doc_id")
    rows = stored(ranged.mapInArrow(run, SORTED.format(id=kind)), "suffix-buckets")
    # Across borders: a bucket's first and last rows against the buckets before and after; one row for each bucket.
    down = Window.orderBy("bucket")
    ends = rows.groupBy("bucket").agg(F.min(F.struct("t1", "t2")).alias("lo"), F.max(F.struct("t1", "t2")).alias("hi"))
    pieces = (rows.join(F.broadcast(ends.select("bucket", "lo", "hi")), "bucket")  # one row for each bucket, a number set by the session
              .filter((F.col("t1") == F.col("lo.t1")) | (F.col("t1") == F.col("hi.t1")))
              .groupBy("bucket", "t1").agg(F.min("t2").alias("a"), F.max("t2").alias("b")))
    firsts = pieces.groupBy("t1").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n")).filter("n > 1 AND a != b").select("t1")
    links = (ends.withColumn("before", F.lag("hi").over(down)).withColumn("after", F.lead("lo").over(down)))
    heads = links.filter("before = lo").select("bucket", F.col("lo.t1").alias("t1"), F.col("lo.t2").alias("t2"))
    again = heads.unionByName(links.filter("after = hi").select("bucket", F.col("hi.t1").alias("t1"), F.col("hi.t2").alias("t2"))).distinct()
    # all three: at most two rows for each bucket
    rows = (rows.join(F.broadcast(firsts.withColumn("other", F.lit(True))), "t1", "left")
            .join(F.broadcast(again.withColumn("beyond", F.lit(True))), ["bucket", "t1", "t2"], "left")
            .join(F.broadcast(heads.withColumn("continued", F.lit(True))), ["bucket", "t1", "t2"], "left"))
    yes = F.col("many") | F.col("twice") | F.coalesce("beyond", F.lit(False))
    mixed = F.col("mixed") | F.coalesce("other", F.lit(False))
    return rows.select("t1", "t2", "doc_id", "need", yes.alias("yes"), mixed.alias("mixed"),
                       (F.col("head") & F.coalesce(~F.col("continued"), F.lit(True))).alias("head"))


def find_and_cut(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    session.ship(spark)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    unit_schema = f"t1 bigint, t2 bigint, doc_id {kind}, many boolean, need boolean"

    def rows(ids: pa.Array, doc: np.ndarray, t1: np.ndarray, t2: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        doc, t1, t2, many, need = _distinct(doc, t1, t2, need)
        return pa.RecordBatch.from_arrays([pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), ids.take(pa.array(doc)), pa.array(many), pa.array(need)],
                                          ["t1", "t2", "doc_id", "many", "need"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch, limit=CHUNK):
                u = Units(text)
                yield rows(part.column("doc_id"), u.doc, u.t1, u.t2, np.ones(len(u.t1), bool))

    def smaller(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, text in text_chunks(batch, limit=CHUNK):
                    act, u = Acts(part.column("__found")), Units(text)
                    which, need = act.split(0, u.doc, u.t1, u.t2)
                    unit, first, n, t1, t2 = u.blocks(which)
                    doc, need = u.doc[which][unit], need[unit]
                    if level == 2:
                        some, wanted = act.split(1, doc, t1, t2)
                        at = ragged(first[some], n[some])
                        doc, need = np.repeat(doc[some], n[some]), np.repeat(wanted & need[some], n[some])
                        t1 = t2 = u.rolling.of(at, at + LENGTH)
                    yield rows(part.column("doc_id"), doc, t1, t2, need)

        return run

    def decided(c: DataFrame, last: bool = False) -> DataFrame:
        """Rows a document needs: YES units, SPLIT units, and one copy of a YES pair for the others of its first token to compare with."""
        if last:
            return c.filter("yes AND need").select("doc_id", "t1", "t2", F.lit(1).alias("act"))
        keep = c.filter("(yes AND need) OR mixed")
        split = F.col("mixed") & (F.col("head") | ~F.col("yes"))
        act = F.when(F.col("yes") & F.col("need"), 1).otherwise(0) + F.when(split, 2).otherwise(0) + F.when(F.col("need") & ~F.col("yes"), 4).otherwise(0)
        return keep.select("doc_id", "t1", "t2", act.alias("act")).filter("act > 0")

    def with_found(levels: list[DataFrame], how: str) -> DataFrame:
        every = None
        for i, v in enumerate(levels):
            v = v.withColumn("level", F.lit(i))
            every = v if every is None else every.unionByName(v)
        packed = every.groupBy("doc_id").agg(F.collect_list(F.struct("level", "t1", "t2", "act")).alias("__found"),
                                             F.max(F.when((F.col("level") == len(levels) - 1) & (F.col("act") >= 2), 1)).alias("__open"))
        if how == "inner":
            packed = packed.filter("__open = 1")
        d = docs.withColumnRenamed("doc_id", "__id")
        return d.join(packed, d["__id"].eqNullSafe(packed["doc_id"]), how).select(F.col("__id").alias("doc_id"), "text", "__found")

    v0 = stored(decided(compared(stored(docs.mapInArrow(whole, unit_schema), "suffix-units"))), "suffix-verdicts")
    v1 = stored(decided(compared(stored(with_found([v0], "inner").mapInArrow(smaller(1), unit_schema), "suffix-blocks"))), "suffix-verdicts")
    v2 = decided(compared(stored(with_found([v0, v1], "inner").mapInArrow(smaller(2), unit_schema), "suffix-windows")), last=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch, limit=CHUNK):
                act, u = Acts(part.column("__found")), Units(text)
                which, _ = act.split(0, u.doc, u.t1, u.t2)
                unit, first, n, t1, t2 = u.blocks(which)
                doc = u.doc[which][unit]
                some, _ = act.split(1, doc, t1, t2)
                at = ragged(first[some], n[some])
                t = u.rolling.of(at, at + LENGTH)
                at = at[act.yes(2, np.repeat(doc[some], n[some]), t, t)]
                w0, w1 = act.yes(0, u.doc, u.t1, u.t2), act.yes(1, doc, t1, t2)
                begin = np.concatenate([u.first[w0], first[w1], at])
                size = np.concatenate([u.n[w0], n[w1], np.ones(len(at), np.int64)])
                mark = np.bincount(begin, minlength=len(text.data) + 1) - np.bincount(begin + size - 1 + LENGTH, minlength=len(text.data) + 1)
                gone = np.cumsum(mark[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                starts = text.off[:-1][np.diff(text.off) > 0]
                begins[starts] = gone[starts]
                left = text.data[~gone].tobytes()
                at = np.concatenate([[0], np.cumsum(~gone)])[text.off]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(text.off)), pa.array(text.per_doc(gone)), pa.array(text.per_doc(begins)),
                     pa.array([hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string()),
                     pa.array([left[a:b] for a, b in zip(at, at[1:])], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return with_found([v0, v1, v2], "left").mapInArrow(
        cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and `text`, what is left of each text (a character cut apart shows as U+FFFD)."""
    return find_and_cut(load(spark, sf_dir)).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
