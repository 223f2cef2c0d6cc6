"""Periodic runs of words, found with string synchronising sets.

A run is a maximal stretch of words with smallest period q that is at least three periods (and MIN_LENGTH words) long.
Texts of a chunk stand end to end, each followed by a symbol of its own, so nothing is equal across texts. Periods are
taken in dyadic scales t = 4, 8, 16, ...: scale t proposes the periods from 1.5 t to 3 t.

* A place i is chosen (synchronising) at scale t if, among the places i..i+t whose t words are not highly periodic
  (period up to t/3), the one of least hash is i or i+t. Whether i is chosen depends on its 2t words alone, so a run
  repeats its chosen places one period on, and a run of three periods has one early enough to repeat.
* Chosen places with equal contexts of 2t words, up to 3t apart, propose their distance as a period. Such places lie
  more than t/3 apart (their contexts would be highly periodic otherwise), so each has at most eight partners.
* A proposal is extended both ways by comparing hashes, then checked word by word, and kept if it is long enough.
* Highly periodic regions are left out of the choice; the runs with periods up to t/3 that make them up are known from
  smaller scales, and those with periods below 6 from one comparison of the text with itself per period.

A run found under a multiple of its period has the same first and last word, so the least period of a stretch counts.

Defined cases: null text: no words; null doc_id: the text is taken as it is; a text without words has no run and an
empty collapsed text; rows with equal ids are separate documents; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline import session
from meterline.llm.common import Bytes, Rolling, load, mix64, ragged, text_chunks

MIN_LENGTH = 24
DIRECT_PERIODS = range(1, 6)  # below 1.5 x the least scale
LEAST_SCALE = 4
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_NONE = np.zeros((0, 3), np.int64)


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each maximal run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def with_period(symbols: np.ndarray, p: int) -> np.ndarray:
    """(start, length, p) of the maximal stretches of period p that have three periods, by one comparison."""
    if len(symbols) < 3 * p:
        return _NONE
    start, length = stretches(symbols[p:] == symbols[:-p])
    keep = length >= 2 * p
    return np.stack([start[keep], length[keep] + p, np.full(int(keep.sum()), p)], 1)


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x over [i, i + width), by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def highly_periodic(runs: np.ndarray, scale: int, size: int) -> np.ndarray:
    """Marks the places whose `scale` words have a period of at most scale / 3."""
    r = runs[(3 * runs[:, 2] <= scale) & (runs[:, 1] >= scale)]
    mark = np.zeros(size + 1, np.int64)
    np.add.at(mark, r[:, 0], 1)
    np.add.at(mark, r[:, 0] + r[:, 1] - scale + 1, -1)
    return np.cumsum(mark[:-1]) > 0


def synchronising_set(hashes: Rolling, size: int, scale: int, runs: np.ndarray) -> np.ndarray:
    places = np.arange(size - scale + 1)
    rank = np.minimum(hashes.of(places, places + scale), _LAST - np.uint64(1))
    rank[highly_periodic(runs, scale, len(rank))] = _LAST
    least = window_min(rank, scale + 1)
    n = len(least)
    return np.flatnonzero((least < _LAST) & ((rank[:n] == least) | (rank[scale:scale + n] == least)))


def proposals(hashes: Rolling, chosen: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of chosen places with equal contexts, at distances of 1.5 to 3 scales."""
    context = hashes.of(chosen, chosen + 2 * scale)
    order = np.argsort(context, kind="stable")
    place, context = chosen[order], context[order]
    at, by, k = [], [], 1
    while k < len(place):
        near = (context[k:] == context[:-k]) & (place[k:] - place[:-k] < 3 * scale)
        if not near.any():
            break
        d = (place[k:] - place[:-k])[near]
        i = place[:-k][near]
        far = 2 * d >= 3 * scale
        at.append(i[far])
        by.append(d[far])
        k += 1
    return (np.concatenate(at), np.concatenate(by)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def extended(symbols: np.ndarray, hashes: Rolling, at: np.ndarray, by: np.ndarray) -> np.ndarray:
    """(start, length, period) of the maximal stretch of period `by` around each place `at`, checked word by word."""
    size = len(symbols)
    right, left = np.zeros_like(at), np.zeros_like(at)
    for step in 1 << np.arange(int(size).bit_length())[::-1]:
        lo = at + right
        fits = np.flatnonzero(lo + by + step <= size)
        same = fits[hashes.of(lo[fits], lo[fits] + step) == hashes.of(lo[fits] + by[fits], lo[fits] + by[fits] + step)]
        right[same] += step
        hi = at - left
        fits = np.flatnonzero(hi - step >= 0)
        same = fits[hashes.of(hi[fits] - step, hi[fits]) == hashes.of(hi[fits] + by[fits] - step, hi[fits] + by[fits])]
        left[same] += step
    found = np.stack([at - left, right + left + by, by], 1)
    found = np.unique(found[found[:, 1] >= 3 * by], axis=0)
    if not len(found):
        return found
    n = found[:, 1] - found[:, 2]
    places = ragged(found[:, 0], n)
    wrong = symbols[places] != symbols[places + np.repeat(found[:, 2], n)]
    wrong = np.add.reduceat(wrong, np.concatenate([[0], np.cumsum(n)[:-1]])) > 0
    if wrong.any():  # two different strings share a hash: compare those periods directly
        found = np.concatenate([found[~wrong], *(with_period(symbols, int(p)) for p in np.unique(found[wrong, 2]))])
    return found


def runs_of(words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(text, start, length, period) of all runs, by text, start and period; words of all texts end to end."""
    _, number = np.unique(words, return_inverse=True)
    texts, first = np.arange(len(sizes)), np.concatenate([[0], np.cumsum(sizes)])
    found, scale = [], 0
    here = _NONE  # runs in the current numbering
    while True:
        keep = sizes >= (3 if not scale else (9 * scale + 1) // 2)
        if scale:  # move what is known to the shorter array
            text = np.searchsorted(begin, here[:, 0], side="right") - 1  # noqa: F821
            stay = keep[text]
        texts, sizes = texts[keep], sizes[keep]
        if not len(texts):
            break
        new_begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        if scale:
            renumber = np.cumsum(keep) - 1
            here = here[stay] + np.stack([new_begin[renumber[text[stay]]] - begin[text[stay]], *np.zeros((2, int(stay.sum())), np.int64)], 1)
        begin = new_begin[:-1]
        symbols = np.empty(new_begin[-1], np.int64)
        symbols[new_begin[1:] - 1] = -1 - np.arange(len(texts))
        symbols[ragged(begin, sizes)] = number[ragged(first[texts], sizes)]
        if not scale:
            new = np.concatenate([with_period(symbols, p) for p in DIRECT_PERIODS])
        else:
            hashes = Rolling(mix64(symbols.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
            chosen = synchronising_set(hashes, len(symbols), scale, here)
            at, by = proposals(hashes, chosen, scale)
            new = extended(symbols, hashes, at, by) if len(at) else _NONE
        if len(new):
            here = np.concatenate([here, new])
            text = np.searchsorted(begin, new[:, 0], side="right") - 1
            found.append(np.column_stack([texts[text], new[:, 0] - begin[text], new[:, 1:]]))
        scale = 2 * scale or LEAST_SCALE
    if not found:
        return np.zeros((0, 4), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    least = np.ones(len(runs), bool)
    least[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    runs = runs[least & (runs[:, 2] >= min_length)]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def tandem(sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The word that stands at each place: texts with h % 10 = 0 repeat their words from place a on with period p."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.arange(int(sizes.sum()))
    hit = np.flatnonzero((h >= 0) & (h % 10 == 0) & (sizes > 0))
    n, g = sizes[hit], h[hit] // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = ragged(a, n - a)
    rep = lambda x: np.repeat(x, n - a)
    order[rep(first[hit]) + i] = rep(first[hit] + a) + (i - rep(a)) % rep(p)
    return order


def dropped(runs: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Marks the words after the first period of a run."""
    mark = np.zeros(size + 1, np.int64)
    at = first[runs[:, 0]] + runs[:, 1]
    np.add.at(mark, at + runs[:, 3], 1)
    np.add.at(mark, at + runs[:, 2], -1)
    return np.cumsum(mark[:-1]) > 0


def joined(text: Bytes, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of each text joined by one space, end to end with a space more behind every word, and its bounds."""
    n = ends - starts + 1
    data = np.append(text.data, np.uint8(32))[ragged(starts, n)]
    stop = np.cumsum(n)
    data[stop - 1] = 32
    bounds = np.concatenate([[0], stop])[np.searchsorted(doc, np.arange(text.n + 1))]
    return data.tobytes(), bounds


def analysed(text: Bytes, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Runs (text, start, length, period), their bounds by text, the collapsed texts and their bounds."""
    starts, ends, doc = text.words()
    sizes = np.bincount(doc, minlength=text.n)
    if h is not None:
        order = tandem(sizes, h)
        starts, ends = starts[order], ends[order]
    first = np.concatenate([[0], np.cumsum(sizes)])
    runs = runs_of(Rolling(text.values()).of(starts, ends), sizes)
    kept = ~dropped(runs, first, len(starts))
    return runs, np.searchsorted(runs[:, 0], np.arange(text.n + 1)), *joined(text, starts[kept], ends[kept], doc[kept])


def periodic_runs(docs: DataFrame, repeat_by_id: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, n_kept_bytes).

    `runs` lists (start, length, period) of every run. With repeat_by_id a tenth of the texts, chosen by their id, are
    first turned into tandem repeats of some of their words.
    """
    session.ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    schema = (f"doc_id {id_type.simpleString()}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
              "collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>, n_kept_bytes bigint")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch):
                h = part.column("h").to_numpy(zero_copy_only=False) if repeat_by_id else None
                runs, bounds, kept, ends = analysed(text, h)
                order = np.lexsort((runs[:, 3], runs[:, 1], -(runs[:, 2] / runs[:, 3]), runs[:, 0]))
                has = np.diff(bounds) > 0
                best = np.zeros((text.n, 3), np.int64)
                best[has] = runs[order[bounds[:-1][has]], 1:]
                top = [pa.array(c, mask=~has) for c in (*best.T, 1000 * best[:, 1] // np.maximum(best[:, 2], 1))]
                lines = ["".join(f"{s},{n},{p}\n" for s, n, p in runs[a:b, 1:].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
                length = np.maximum(np.diff(ends) - 1, 0)
                listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(c)) for c in runs[:, 1:].T], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds)), *top, pa.array([sha(x.encode()) for x in lines]),
                     pa.array([sha(kept[a:a + n]) for a, n in zip(ends[:-1].tolist(), length.tolist())]), listed, pa.array(length)], names)

    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(-1)).alias("h")
    return docs.select("doc_id", "text", h).mapInArrow(run, schema)


def collapsed(docs: DataFrame) -> DataFrame:
    """The documents with every run cut to its first period and words joined by one space; texts without a run stay."""
    session.ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch):
                _, bounds, kept, ends = analysed(text)
                new = [kept[a:b - 1].decode() if hit else old for a, b, hit, old in
                       zip(ends[:-1], ends[1:], np.diff(bounds) > 0, part.column(at).to_pylist())]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(load(spark, sf_dir), repeat_by_id=True).drop("runs", "n_kept_bytes")
