"""Substring dedup by collinear chaining: passages that repeat, possibly altered, across documents.

Seeds are hashes of SEED_WORDS words in a row, thinned by winnowing: the least of every WINDOW neighbours stays, so an
exact copy of SEED_WORDS + WINDOW - 1 words shares a seed. A seed's occurrences are linked to those in the document
before (by id); each task links its own first and hands on only its first document of each seed, so a seed that is
everywhere becomes one row per task. As other documents may have but parts of a passage, every MIN_WORDS words in a row whose
seeds are all shared are linked likewise, to the document before that has them all: no exact passage is lost. The links of a pair of documents are chained in order of both texts with a cost for gaps (a
Fenwick tree holds the best chain up to each place), and chains are aligned word by word along their diagonals. The
best stretches with matches MATCH and others MISMATCH (four in five words must match) of MIN_WORDS or more are
passages; the document of the greater id loses them.

Defined cases: null or short text, null id: untouched; rows with equal ids are one document and are not compared with
each other; a passage twice in one document is not a repeat, but both go if an earlier document has it; removed words
go with the white space after them; dedup() keeps the other columns.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline import session
from meterline.llm.common import Bytes, Rolling, load, mix64, n_partitions, ragged, stored, text_chunks

SEED_WORDS = 5
WINDOW = 12
MIN_WORDS = 40
MARGIN = 48  # words looked at beyond the ends of a chain
GAP_COST = 0.05  # of each word between two seeds, in either text
MATCH, MISMATCH = 1.0, -4.0


def word_hashes(text: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, document and hash (lower case) of each word."""
    text = text.lower()
    starts, ends, doc = text.words()
    return starts, doc, Rolling(text.values()).of(starts, ends)


def seeds(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word place and hash of the winnowed seeds of a batch of documents."""
    n = len(words) - SEED_WORDS + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(SEED_WORDS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
    h = mix64(h)
    count = n - WINDOW + 1
    best, at = h[:count].copy(), np.arange(count)
    for i in range(1, WINDOW):
        less = h[i:i + count] < best
        best[less], at[less] = h[i:i + count][less], np.flatnonzero(less) + i
    at = np.unique(at[doc[:count] == doc[WINDOW + SEED_WORDS - 2:]])
    return at, h[at]


def link(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of (seed, document, place), the row each is linked to (-1: none), and which have the first document.

    The i-th occurrence in a document is linked to the i-th, or last, of the document before.
    """
    order = np.lexsort((pos, doc, h))
    h, doc = h[order], doc[order]
    n = len(h)
    new_seed = np.ones(n, bool)
    new_seed[1:] = h[1:] != h[:-1]
    new_doc = new_seed.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    run = np.cumsum(new_doc) - 1
    begin = np.flatnonzero(new_doc)
    size = np.diff(np.append(begin, n))
    first = new_seed[begin][run] if n else new_seed
    before = np.maximum(run - 1, 0)
    to = np.where(first, -1, begin[before] + np.minimum(np.arange(n) - begin[run], size[before] - 1)) if n else run
    return order, to, first


def chains(p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Chains of links (places p, q) of one pair of documents, as indices in order; each link is in one chain at most."""
    order = np.lexsort((-q, p))
    p, q = p[order].tolist(), q[order].tolist()
    ranks = sorted(set(q))
    tree: list[tuple[float, int]] = [(-1e300, -1)] * (len(ranks) + 1)
    score, back = [], []
    waiting: list[int] = []  # links at the current place of p, which must not chain with each other
    at = None
    for i in range(len(p)):
        if p[i] != at:
            for j in waiting:
                k, value = bisect_left(ranks, q[j]) + 1, (score[j] + GAP_COST * (p[j] + q[j]), j)
                while k < len(tree):
                    if tree[k] < value:
                        tree[k] = value
                    k += k & -k
            waiting, at = [], p[i]
        k, best = bisect_left(ranks, q[i]), (-1e300, -1)
        while k:
            best = max(best, tree[k])
            k -= k & -k
        gain = best[0] - GAP_COST * (p[i] + q[i])
        score.append(SEED_WORDS + max(gain, 0.0))
        back.append(best[1] if gain > 0 else -1)
        waiting.append(i)
    out, used = [], [False] * len(p)
    for i in sorted(range(len(p)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(order[np.array(chain[::-1])])
    return out


def aligned(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of a that match b along the diagonals of chained links (p in a, q in b)."""
    t = np.arange(len(a))
    k = np.searchsorted(p, t, side="right")
    match = np.zeros(len(a), bool)
    for side in (np.maximum(k - 1, 0), np.minimum(k, len(p) - 1)):
        j = t + (q - p)[side]
        ok = (j >= 0) & (j < len(b))
        match[ok] |= a[t[ok]] == b[j[ok]]
    edges = np.flatnonzero(np.diff(match.astype(np.int8), prepend=0, append=0))
    # Ruzzo and Tompa: all best disjoint stretches, over runs of matches
    kept: list[list[float]] = []  # begin, end, score before, score after
    total, last = 0.0, 0
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
        total += MISMATCH * (lo - last) if kept or last else 0.0
        item = [lo, hi, total, total + MATCH * (hi - lo)]
        total, last = item[3], hi
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= item[2]:
                j -= 1
            if j < 0 or kept[j][3] >= item[3]:
                kept.append(item)
                break
            item = [kept[j][0], item[1], kept[j][2], item[3]]
            del kept[j:]
    return [(int(x[0]), int(x[1])) for x in kept if x[1] - x[0] >= MIN_WORDS]


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    some = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(some) if some else None


def _batches(columns: dict[str, np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(50_000)


def places(text: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and word place of the seeds of a batch."""
    _, doc, words = word_hashes(text)
    at, h = seeds(words, doc)
    begin = np.searchsorted(doc, np.arange(text.n))
    return h, doc[at], at - begin[doc[at]]


def whole(text: Bytes, shared: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and word place of every MIN_WORDS words in a row that another document may have.

    `shared` has the places of seeds that other documents have, of each hash one at least. The same words in another
    document have the same seeds wherever WINDOW neighbours lie within them, so all of those must be shared.
    """
    _, doc, words = word_hashes(text)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(words) < MIN_WORDS:
        return none
    h = np.zeros(len(words) - SEED_WORDS + 1, np.uint64)
    for i in range(SEED_WORDS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i:i + len(h)]
    h = mix64(h)
    begin = np.searchsorted(doc, np.arange(text.n))
    owner = np.repeat(np.arange(text.n), shared.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    known = begin[owner] + shared.flatten().to_numpy(zero_copy_only=False)
    tag = lambda at: h[at] + mix64(doc[at].astype(np.uint64))
    least = np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(1) + np.arange(len(h) - WINDOW + 1)
    bad = np.concatenate([[0], np.cumsum(~np.isin(tag(least), tag(known)))])
    count, reach = len(words) - MIN_WORDS + 1, MIN_WORDS - SEED_WORDS - WINDOW + 2  # runs of WINDOW seeds within the words
    t = np.flatnonzero((bad[reach:reach + count] == bad[:count]) & (doc[:count] == doc[MIN_WORDS - 1:]))
    return Rolling(words).of(t, t + MIN_WORDS), doc[t], t - begin[doc[t]]


def thinned(d: np.ndarray, e: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of links side by side on one diagonal: the ends, and one of so many as still overlap."""
    order = np.lexsort((p, p - q, e, d))
    d, e, p, q = d[order], e[order], p[order], q[order]
    after = (d[1:] == d[:-1]) & (e[1:] == e[:-1]) & (p[1:] - p[:-1] == 1) & (q[1:] - q[:-1] == 1)
    return order[~(np.append(False, after) & np.append(after, False)) | (p % (MIN_WORDS // 2) == 0)]


def linked(docs: DataFrame, find, thin: bool = False) -> DataFrame:
    """(d, e, p, q): what find(text, batch) has at word p of document d and at word q of an earlier document e."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for part, text in text_chunks(batch):
                h, doc, pos = find(text, part)
                found.append((h, part.column("doc_id").to_numpy()[doc], pos))
        if not found:
            return
        h, doc, pos = (np.concatenate(x) for x in zip(*found))
        order, to, first = link(h, doc, pos)
        h, doc, pos = h[order], doc[order], pos[order]
        some = to >= 0
        e, q = np.where(some, doc[to], -1), np.where(some, pos[to], -1)
        key = np.where(first, h, mix64(h + mix64(doc.astype(np.uint64))))
        if thin:
            done = np.flatnonzero(some)
            keep = np.concatenate([np.flatnonzero(~some), done[thinned(doc[done], e[done], pos[done], q[done])]])
            key, doc, pos, e, q = key[keep], doc[keep], pos[keep], e[keep], q[keep]
        yield from _batches({"key": key.view(np.int64), "d": doc, "p": pos, "e": e, "q": q})

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        h, d, p, e, q = (t.column(c).to_numpy() for c in ("key", "d", "p", "e", "q"))
        done = q >= 0
        yield from _batches({"d": d[done], "e": e[done], "p": p[done], "q": q[done]})
        h, d, p = h[~done], d[~done], p[~done]
        order, to, _ = link(h, d, p)
        d, p = d[order], p[order]
        some = to >= 0
        yield from _batches({"d": d[some], "e": d[to[some]], "p": p[some], "q": p[to[some]]})

    n = n_partitions(docs.sparkSession)
    return (docs.mapInArrow(local, "key bigint, d bigint, p bigint, e bigint, q bigint")
            .repartition(n, "key").mapInArrow(across, "d bigint, e bigint, p bigint, q bigint"))


def matches(docs: DataFrame) -> DataFrame:
    """(d, e, p, q, whole): SEED_WORDS words, or if whole MIN_WORDS, at word p of document d and at word q of an earlier document e.

    The document before that has a seed need not have the words around it. So of all MIN_WORDS words in a row with only
    shared seeds, each is linked to the document before that has all of them, whatever others have parts of them.
    """
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    single = stored(linked(texts, lambda text, part: places(text)), "seed-links")
    shared = (single.select(F.explode(F.array(F.struct(F.col("d").alias("id"), F.col("p").alias("at")), F.struct(F.col("e").alias("id"), F.col("q").alias("at")))).alias("x"))
              .groupBy("x.id").agg(F.collect_set("x.at").alias("shared")))
    wide = texts.join(shared, texts["doc_id"] == shared["id"]).select("doc_id", "text", "shared")
    both = linked(wide, lambda text, part: whole(text, part.column("shared")), thin=True)
    return single.withColumn("whole", F.lit(False)).unionByName(both.withColumn("whole", F.lit(True)))


def chained(links: DataFrame) -> DataFrame:
    """(chain, d, e, p, q): chains of two or more links; an exact copy of 2 (SEED_WORDS + WINDOW - 1) words has as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        d, e, p, q = (t.column(c).to_numpy() for c in ("d", "e", "p", "q"))
        full = t.column("whole").to_numpy(zero_copy_only=False)
        one, ends = np.flatnonzero(~full), np.flatnonzero(full)
        ends = ends[thinned(d[ends], e[ends], p[ends], q[ends])]
        row, shift = np.concatenate([one, ends, ends]), np.repeat([0, MIN_WORDS - SEED_WORDS], [len(one) + len(ends), len(ends)])
        d, e, p, q = d[row], e[row], p[row] + shift, q[row] + shift  # the first and the last SEED_WORDS of MIN_WORDS
        order = np.lexsort((q, p, e, d))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (d, e, p, q)], axis=0)
        order = order[new]
        d, e, p, q = d[order], e[order], p[order], q[order]
        cut = np.flatnonzero((d[1:] != d[:-1]) | (e[1:] != e[:-1])) + 1
        out: list[tuple] = []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(d)]):
            for c in chains(p[lo:hi], q[lo:hi]) if hi - lo > 1 else []:
                if len(c) > 1:
                    out.append((d[lo], e[lo], p[lo:hi][c], q[lo:hi][c]))
        if out:
            key = mix64(np.array([x[0] for x in out]).astype(np.uint64) + mix64(np.array([x[1] for x in out]).astype(np.uint64)
                        + mix64(np.array([x[2][0] for x in out], np.uint64) + mix64(np.array([x[3][0] for x in out], np.uint64)))))
            yield from _batches({"chain": key.view(np.int64), "d": np.array([x[0] for x in out]), "e": np.array([x[1] for x in out]),
                                 "p": pa.array([x[2] for x in out], pa.list_(pa.int64())), "q": pa.array([x[3] for x in out], pa.list_(pa.int64()))})

    n = n_partitions(links.sparkSession)
    return links.repartition(n, "d", "e").mapInArrow(run, "chain bigint, d bigint, e bigint, p array<bigint>, q array<bigint>")


def passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): word spans of documents that repeat a passage of an earlier document."""
    ask = found.select(F.explode(F.array(
        F.struct(F.col("d").alias("doc"), "chain", F.lit(0).alias("side"), F.element_at("p", 1).alias("lo"), F.element_at("p", -1).alias("hi"), "p", "q", "d"),
        F.struct(F.col("e").alias("doc"), "chain", F.lit(1).alias("side"), F.element_at("q", 1).alias("lo"), F.element_at("q", -1).alias("hi"),
                 F.lit(None).cast("array<bigint>").alias("p"), F.lit(None).cast("array<bigint>").alias("q"), F.lit(None).cast("bigint").alias("d")))).alias("a"))
    ask = ask.select("a.*").groupBy("doc").agg(F.collect_list(F.struct("chain", "side", "lo", "hi", "p", "q", "d")).alias("asked"))
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text")
    schema = "chain bigint, side int, at bigint, words binary, p array<bigint>, q array<bigint>, d bigint"

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch):
                _, doc, words = word_hashes(text)
                short = (words >> np.uint64(32)).astype(np.uint32)
                begin = np.searchsorted(doc, np.arange(text.n + 1))
                counts = part.column("asked").value_lengths().to_numpy()
                a = part.column("asked").flatten()
                owner = np.repeat(np.arange(text.n), counts)
                lo = np.maximum(a.field("lo").to_numpy() - MARGIN, 0)
                hi = np.minimum(a.field("hi").to_numpy() + SEED_WORDS + MARGIN, np.diff(begin)[owner])
                parts = [short[x:y].tobytes() for x, y in zip((begin[owner] + lo).tolist(), (begin[owner] + hi).tolist())]
                yield pa.RecordBatch.from_arrays([a.field("chain"), a.field("side"), pa.array(lo), pa.array(parts, pa.binary()), a.field("p"), a.field("q"), a.field("d")],
                                                 ["chain", "side", "at", "words", "p", "q", "d"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        chain, side = t.column("chain").to_numpy(), t.column("side").to_numpy()
        order = np.lexsort((side, chain))
        at, words, p, q, d = (t.column(c) for c in ("at", "words", "p", "q", "d"))
        rows, i = [], 0
        while i < len(order):
            j = i
            while j < len(order) and chain[order[j]] == chain[order[i]]:
                j += 1
            x, y = int(order[i]), int(order[j - 1])
            if side[x] == 0 and side[y] == 1:
                lo, other = at[x].as_py(), at[y].as_py()
                for a, b in aligned(np.frombuffer(words[x].as_py(), np.uint32), np.frombuffer(words[y].as_py(), np.uint32),
                                    np.array(p[x].as_py()) - lo, np.array(q[x].as_py()) - other):
                    rows.append((d[x].as_py(), lo + a, lo + b))
            i = j
        if rows:
            ids, lo, hi = zip(*rows)
            yield from _batches({"doc_id": np.array(ids, np.int64), "lo": np.array(lo, np.int64), "hi": np.array(hi, np.int64)})

    n = n_partitions(docs.sparkSession)
    return (texts.join(ask, "doc").select("text", "asked").mapInArrow(slices, schema).repartition(n, "chain")
            .mapInArrow(align, "doc_id bigint, lo bigint, hi bigint"))


def removals(docs: DataFrame) -> DataFrame:
    """(__id, __spans): the word spans that a document loses."""
    session.ship(docs.sparkSession)
    found = stored(chained(matches(docs)), "chains")
    return (passages(docs, found).groupBy(F.col("doc_id").alias("__id"))
            .agg(F.collect_set(F.struct("lo", "hi")).alias("__spans")))


def _cut(text: Bytes, spans: pa.ListArray) -> tuple[Bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts without the spans; words, removed words and removed runs of each."""
    starts, ends, doc = text.words()
    begin = np.searchsorted(doc, np.arange(text.n + 1))
    counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(text.n), counts)
    flat = spans.flatten()
    lo, hi = (begin[owner] + flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    lo, hi = np.minimum(lo, begin[owner + 1]), np.minimum(hi, begin[owner + 1])  # rows of one id may differ in length
    mark = np.bincount(lo, minlength=len(starts) + 1) - np.bincount(hi, minlength=len(starts) + 1)
    gone = np.cumsum(mark[:-1]) > 0
    new = gone.copy()
    new[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
    after = np.append(starts[1:], len(text.data))
    after = np.where(np.append(doc[1:] != doc[:-1], True), text.off[doc + 1], after) if len(starts) else after
    edge = np.bincount(starts[gone], minlength=len(text.data) + 1) - np.bincount(after[gone], minlength=len(text.data) + 1)
    keep = np.cumsum(edge[:-1]) == 0
    off = np.concatenate([[0], np.cumsum(keep)])[text.off]
    per = lambda x: np.bincount(doc[x], minlength=text.n)
    return Bytes(text.data[keep], off), np.diff(begin), per(gone), per(new)


def dedup(docs: DataFrame) -> DataFrame:
    """docs without repeated passages; documents that keep no word go."""
    spans = removals(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch):
                cut, words, gone, _ = _cut(text, part.column("__spans"))
                raw = cut.data.tobytes()
                new = [raw[a:b].decode() for a, b in zip(cut.off, cut.off[1:])]
                old = part.column("text").to_pylist()
                texts = [x if not g else y for x, y, g in zip(old, new, gone)]
                columns = {c: part.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
                if "n_chars" in names:
                    n = [x if not g else len(y) for x, y, g in zip(part.column("n_chars").to_pylist(), new, gone)]
                    columns["n_chars"] = pa.array(n, part.column("n_chars").type)
                stay = pa.array((gone == 0) | (gone < words))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(stay)

    wide = docs.join(spans, docs["doc_id"].cast("long") == spans["__id"], "left").drop("__id")
    return wide.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, spans, kept_sha256): spans as [first word, word after)."""
    docs = load(spark, sf_dir).select("doc_id", "text")
    spans = removals(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch):
                cut, words, gone, runs = _cut(text, part.column("__spans"))
                raw = cut.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words), pa.array(gone), pa.array(runs), part.column("__spans"),
                     pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut.off, cut.off[1:])], pa.string())],
                    ["doc_id", "n_words", "n_removed", "n_spans", "spans", "kept_sha256"])

    wide = docs.join(spans, docs["doc_id"].cast("long") == spans["__id"], "left").drop("__id")
    return wide.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, n_spans bigint, spans array<struct<lo:bigint,hi:bigint>>, kept_sha256 string")
