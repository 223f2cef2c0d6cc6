"""Language-model scores by context-tree weighting.

A text is bytes (A-Z in lower case) with an end mark; a byte is eight binary choices. For each choice (a node of the
byte's bit tree) the contexts of 0 to DEPTH bytes before form a tree with Krichevsky-Trofimov estimates in its nodes, and
the weighted mixture over all prunings of that tree predicts the bit. The probability of a byte after DEPTH others is so a
function of DEPTH + 1 bytes (a gram), which is worked out once for each gram.

Documents are dealt into blocks. A block reports its distinct grams and words with their counts in training documents;
the reports are dealt by the last two context bytes, where the deep nodes can be summed; nodes of depth 1 and 0 (at most
65 535 of them) go through the driver. The answers return to the blocks that asked, so no task holds the whole model.

Defined cases: null text: empty (its end mark is scored); null id: a training document; rows with equal ids are separate
documents; no training documents: every estimate is that of an empty tree; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline import session
from meterline.llm.common import Bytes, Rolling, load, mix64, n_partitions, ragged, stored, text_chunks

DEPTH = 4
MARK = 0xFF  # not a byte of UTF-8: stands before a text and ends it
BLOCKS_PER_PARTITION = 2  # shuffle partitions to one block
MIN_BLOCKS = 6
WORD = np.uint64(1 << 62)  # keys of words have this bit, keys of grams do not; one bit more is free
END_WORD = WORD  # the end, as a token
CHUNK = 1 << 18  # bytes of text worked on at once
BUNCH = 50_000  # grams whose trees are built at once; more only where one pair of last context bytes has more
HOLD = 1 << 19  # reported keys kept until equal ones are added up, or as many as are distinct


def grams(text: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Key and document of every byte and end mark: DEPTH bytes of context and the byte itself."""
    size = np.diff(text.off)
    at = np.cumsum(size + DEPTH + 1) - size - 1
    data = np.full(int((size + DEPTH + 1).sum()), MARK, np.uint8)
    data[ragged(at, size)] = text.data
    key = np.zeros(max(len(data) - DEPTH, 0), np.uint64)
    for i in range(DEPTH + 1):
        key = (key << np.uint64(8)) | data[i:i + len(key)]
    return key[ragged(at - DEPTH, size + 1)], np.repeat(np.arange(text.n), size + 1)


def word_keys(text: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Key and document of every word and end."""
    starts, ends, doc = text.words()
    key = (Rolling(text.values()).of(starts, ends) >> np.uint64(2)) | WORD
    key[key == END_WORD] += np.uint64(1)
    return np.concatenate([key, np.full(text.n, END_WORD)]), np.concatenate([doc, np.arange(text.n)])


def tally(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sum of their weights."""
    if not len(keys):
        return keys, weight
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(weight[order], at)


def tally_flags(keys: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the number of their set flags; one sort of keys that carry their flag."""
    both = np.sort((keys << np.uint64(1)) | flag)
    keys, flag = both >> np.uint64(1), both & np.uint64(1)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(flag, at).astype(np.int64) if len(at) else np.zeros(0, np.int64)


class Lookup:
    """Places of distinct keys by open addressing, a quarter full."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15) ^ (keys >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; all of them are there."""
        at = self._first(keys)
        out = self.slots[at]
        wrong = np.flatnonzero(self.keys[out] != keys)
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            out[wrong] = self.slots[at]
            still = self.keys[out[wrong]] != keys[wrong]
            wrong, at = wrong[still], at[still]
        return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros(len(x))
    y = x.astype(np.float64)
    for i in range(8):
        shift += np.log(y + i)
    y = y + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - shift


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def log_mix(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) - np.log(2)


class Level:
    """Nodes of one depth: counts, weight of the node's own estimate against what lies below, and its weighted probability."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        self.ids, self.zeros, self.ones = ids, zeros, ones
        own = log_estimate(zeros, ones)
        self.weighted = own if below is None else log_mix(own, below)
        self.own_share = np.ones(len(ids)) if below is None else 1 / (1 + np.exp(np.clip(below - own, -700, 700)))

    def parent(self) -> tuple[np.ndarray, ...]:
        """Ids one byte of context shorter, counts, and the sum of the weighted probabilities below."""
        depth_free = self.ids & np.uint64(0xFF)
        ctx = self.ids >> np.uint64(8)
        up = (drop_oldest(ctx) << np.uint64(8)) | depth_free
        order = np.argsort(up, kind="stable")
        up = up[order]
        at = np.flatnonzero(np.append(True, up[1:] != up[:-1])) if len(up) else np.zeros(0, np.int64)
        total = lambda x: np.add.reduceat(x[order], at) if len(at) else x[:0]
        return up[at], total(self.zeros), total(self.ones), total(self.weighted)

    def predict(self, at: np.ndarray, bit: np.ndarray, below: np.ndarray | None) -> np.ndarray:
        n = np.where(bit, self.ones[at], self.zeros[at])
        own = (n + 0.5) / (self.zeros[at] + self.ones[at] + 1.0)
        return own if below is None else self.own_share[at] * own + (1 - self.own_share[at]) * below


def drop_oldest(ctx: np.ndarray) -> np.ndarray:
    """Contexts carry their length: a leading 1 above `depth` bytes, the oldest first."""
    size = np.zeros(len(ctx), np.uint64)
    for d in range(1, DEPTH + 1):
        size[ctx >> np.uint64(8 * d) == 1] = d
    size = size - np.uint64(1)
    return (ctx & ((np.uint64(1) << (np.uint64(8) * size)) - np.uint64(1))) | (np.uint64(1) << (np.uint64(8) * size))


def context(keys: np.ndarray, depth: int) -> np.ndarray:
    return ((keys >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)) | np.uint64(1 << (8 * depth))


def choices(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of a byte's eight bits: its node in the bit tree, and the bit."""
    byte = keys & np.uint64(0xFF)
    for j in range(8):
        yield np.uint64(1 << j) | (byte >> np.uint64(8 - j)), (byte >> np.uint64(7 - j)) & np.uint64(1) == 1


def deep_levels(keys: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels DEPTH, ..., 2 of grams that hold all those of their last two context bytes."""
    ctx = context(keys, DEPTH)
    ids = np.concatenate([(ctx << np.uint64(8)) | node for node, _ in choices(keys)])
    bit = np.concatenate([b for _, b in choices(keys)])
    n = np.tile(n, 8).astype(np.float64)
    order = np.argsort(ids)
    ids, n, bit = ids[order], n[order], bit[order]
    at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    levels = [Level(ids[at], np.add.reduceat(np.where(bit, 0, n), at), np.add.reduceat(np.where(bit, n, 0), at), None)]
    for _ in range(DEPTH - 2):
        levels.append(Level(*levels[-1].parent()))
    return levels


def bunches(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the grams, BUNCH or so at a time; grams that share their last two context bytes come together."""
    pair = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    ends = np.append(np.flatnonzero(pair[1:] != pair[:-1]) + 1, len(pair))
    lo = 0
    while lo < len(order):
        k = max(np.searchsorted(ends, lo + BUNCH, side="right") - 1, np.searchsorted(ends, lo, side="right"))
        yield order[lo:ends[k]]
        lo = ends[k]


def upper_nodes(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ids, counts and weighted probabilities below of the nodes of depth 1."""
    out = (np.zeros(0, np.uint64), *[np.zeros(0)] * 3)
    for at in bunches(keys):
        ids, *sums = (np.concatenate(x) for x in zip(out, deep_levels(keys[at], n[at])[-1].parent()))
        out = (tally(ids, sums[0])[0], *[tally(ids, x)[1] for x in sums])
    return out


def predicted(keys: np.ndarray, n: np.ndarray, top: list[Level]) -> np.ndarray:
    """log10 probability of each gram's byte after its context."""
    out = np.zeros(len(keys))
    for at in bunches(keys):
        out[at] = _predicted(keys[at], deep_levels(keys[at], n[at]) + top)
    return out


def _predicted(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    out = np.zeros(len(keys))
    for node, bit in choices(keys):
        p = None
        for depth, level in zip(range(DEPTH, -1, -1), levels):
            at = np.searchsorted(level.ids, (context(keys, depth) << np.uint64(8)) | node)
            p = level.predict(at, bit, p)
        out += np.log10(p)
    return out


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and words of a block with their occurrences in training documents; the texts pass by."""
    parts, held, limit = [], 0, HOLD
    for batch in batches:
        for part, text in text_chunks(batch, limit=CHUNK):
            text, train = text.lower(), part.column("train").to_numpy(zero_copy_only=False).astype(np.uint64)
            for k, doc in (grams(text), word_keys(text)):
                parts.append(tally_flags(k, train[doc]))
                held += len(parts[-1][0])
            if held > limit:
                parts = [tally(*(np.concatenate(x) for x in zip(*parts)))]
                held = len(parts[0][0])
                limit = held + max(HOLD, held)
    return tally(*(np.concatenate(x) for x in zip(*parts)))


def asked(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, key, n): distinct grams and words of each block, with their occurrences in training documents."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = gathered(batches)
        table = pa.table({"block": pa.array(np.full(len(k), key[0].as_py(), np.int32)), "key": pa.array(k.view(np.int64)), "n": pa.array(n)})
        yield from table.to_batches(50_000)

    return docs.groupBy("block").applyInArrow(run, "block int, key bigint, n bigint")


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """Rows of one partition in order of keys; grams' and words' distinct keys with their totals."""
    some = [b for b in batches if b.num_rows]
    if not some:
        return None
    t = pa.Table.from_batches(some)
    block, key, n = t.column("block").to_numpy(), t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()
    return block, key, n, *tally(key, n)


def scored(docs: DataFrame, seed_mod: int = 7, held: int = 2) -> DataFrame:
    spark = docs.sparkSession
    session.ship(spark)
    blocks = max(MIN_BLOCKS, n_partitions(spark) // BLOCKS_PER_PARTITION)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % seed_mod == held, F.lit(False))
    docs = docs.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text", (~held_out).alias("train"))
    reports = stored(asked(docs, blocks), "tree-reports")
    dealt = reports.repartition(n_partitions(spark), F.when(F.col("key") >= 0, F.shiftright("key", 8).bitwiseAND(0xFFFF)).otherwise(F.col("key")))

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _read(batches)
        if read is None:
            return
        key, n = read[3], read[4]
        word = key >= WORD
        ids, zeros, ones, below = upper_nodes(key[~word], n[~word])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(ids, np.uint64(0)).view(np.int64)), pa.array(np.append(zeros, n[word].sum()).astype(float)),
             pa.array(np.append(ones, (n[word] > 0).sum()).astype(float)), pa.array(np.append(below, 0.0))], ["id", "zeros", "ones", "below"])

    # at most 256 contexts of 255 nodes each, and one row of word totals
    top = (dealt.mapInArrow(upper, "id bigint, zeros double, ones double, below double").groupBy("id")
           .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toPandas().sort_values("id"))
    totals = top[top.id == 0]
    tokens, types = (int(totals.zeros.sum()), int(totals.ones.sum())) if len(totals) else (0, 0)
    top = top[top.id != 0]
    one = Level(top.id.to_numpy().view(np.uint64), *(top[c].to_numpy() for c in ("zeros", "ones", "below")))
    tops = [one, Level(*one.parent())]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _read(batches)
        if read is None:
            return
        block, key, _, keys, n = read
        word = keys >= WORD
        value = np.zeros(len(keys))
        value[word] = np.log10((n[word] + 1) / (tokens + types + 1))
        value[~word] = predicted(keys[~word], n[~word], tops)
        at = np.searchsorted(keys, key)
        table = pa.table({"block": pa.array(block), "key": pa.array(key.view(np.int64)), "value": pa.array(value[at]), "known": pa.array(n[at] > 0)})
        yield from table.to_batches(50_000)

    answers = dealt.mapInArrow(answer, "block int, key bigint, value double, known boolean")

    def score(text_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        key = answer_rows.column("key").to_numpy().view(np.uint64)
        value, known = (answer_rows.column(c).to_numpy() for c in ("value", "known"))
        tables = []
        for here in (key < WORD, key >= WORD):
            tables.append((Lookup(key[here]), value[here], known[here]))
        out = []
        for batch in text_rows.to_batches():
            for part, text in text_chunks(batch, limit=CHUNK):
                text = text.lower()
                (k, doc), (look, values, _) = grams(text), tables[0]
                total = np.bincount(doc, values[look.find(k)], text.n)
                (k, doc), (look, values, knowns) = word_keys(text), tables[1]
                at = look.find(k)
                count = lambda w=None: np.bincount(doc, w, text.n)  # noqa: E731, B023
                out.append(pa.table({"doc_id": part.column("doc_id"), "held_out": pa.array(~part.column("train").to_numpy(zero_copy_only=False)),
                                     "n_tokens": pa.array(count()), "n_known": pa.array(count(knowns[at]).astype(np.int64)),
                                     "train_tokens": pa.array(np.full(text.n, tokens)), "base_score": pa.array(count(values[at])), "score": pa.array(total),
                                     "bits_per_byte": pa.array(-total / np.log10(2) / (np.diff(text.off) + 1))}))
        return pa.concat_tables(out)

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(load(spark, sf_dir))
