"""Token counts of every prefix of every text, for a byte-level BPE vocabulary file.

Texts are cut into pre-tokens by the vocabulary's pattern, evaluated on arrays of character classes; each distinct
pre-token of a batch goes once through the prefix programme of `bpe`, and its counts are added to what stands before
it. The table answers the length of a text, of any truncation, and the longest prefix within a budget without encoding
again.

Defined cases: null text: empty, one prefix of 0 tokens; a special string inside a text is one token, and prefixes that
end inside it have the count with it; rows with equal ids are separate documents; other columns are left out.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterline import session
from meterline.llm.bpe import PieceSet, Prefixes, code_points, distinct, symbol_values
from meterline.llm.common import Bytes, Rolling, load, ragged, text_chunks

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 3 << 19
LETTER, NUMBER, SPACE = 1, 2, 3


def byte_symbols() -> dict[str, str]:
    """The vocabulary file's stand-ins for bytes: printable ones stand for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): chr(b) for b in own} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


@lru_cache(1)
def vocabulary(path: str) -> tuple[PieceSet, list[str]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    back = byte_symbols()
    plain = lambda s: "".join(back[c] for c in s)
    vocab = spec["model"]["vocab"]
    pieces: list[str | None] = [None] * (max(vocab.values()) + 1)
    for text, i in vocab.items():
        pieces[i] = None if text in special else plain(text)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    ranks = {(plain(a), plain(b)): i for i, (a, b) in enumerate(merges)}
    return PieceSet(pieces, lambda a, b: ranks.get((a, b))), special


@lru_cache(1)
def character_classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        kind = unicodedata.category(c)[0]
        out[cp] = LETTER if kind == "L" else NUMBER if kind == "N" else SPACE if c.isspace() and not 28 <= cp <= 31 else 0
    return out


def cut(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of the pre-tokens, the space runs of two or more (start, end), and places after "'r", "'v", "'l".

    Runs of one class are tokens. The last character of a space run goes on its own, and joins what follows if it is a
    blank; an apostrophe on its own takes s, t, m, d, re, ve or ll along.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    kind = character_classes()[cps]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    spaces = kind[runs] == SPACE
    s, e = runs[spaces], ends[spaces]
    inner = ~edge[e]  # something follows in the same text
    start[e[inner] - 1] = True
    joined = e[inner][cps[e[inner] - 1] == 32]
    start[joined] = False
    lone = runs[(ends - runs == 1) & (cps[runs] == 39)]
    lone = lone[start[lone]]
    at = lambda i: np.where(i < n, cps[np.minimum(i, n - 1)], 0)
    lone = lone[~edge[lone + 1]]
    one = np.isin(at(lone + 1), [ord(c) for c in "stmd"])
    a, b = at(lone + 1), np.where(edge[np.minimum(lone + 2, n)], 0, at(lone + 2))
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    short = lone[one | two]
    size = np.where(one[one | two], 1, 2)
    start[short + 1] = False
    after = short + 1 + size
    after = after[after < n]
    start[after] = True
    long = e - s > 1
    return np.flatnonzero(start), np.stack([s[long], e[long]], 1), short[size == 2] + 2


def prefix_counts(text: Bytes, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of the prefixes 0, 1, ... characters of every text end to end, and where each text's begin."""
    pieces, special = vocabulary(path)
    raw = text.data.tobytes()
    fixed = [x.encode() for x in special if x.encode() in raw]
    if fixed:
        return _around_special(text, fixed, path)
    cps, lead, off = code_points(text.data, text.off)
    begin, runs, contracted = cut(cps, off)
    n_units = len(begin)
    finish = np.append(begin[1:], len(cps))
    lead = np.append(lead, len(text.data))
    b0, b1 = lead[np.concatenate([begin, runs[:, 0]])], lead[np.concatenate([finish, runs[:, 1]])]
    rolling = Rolling(symbol_values(text.data))
    one, number = distinct(rolling.of(b0, b1))
    prefixes = Prefixes(pieces, text.data, rolling, b0[one], b1[one])
    total = prefixes.totals()[number[:n_units]]
    first_unit = np.searchsorted(begin, off)
    run = np.concatenate([[0], np.cumsum(total)])
    doc = np.searchsorted(off, begin, side="right") - 1
    before = run[:-1] - run[first_unit[doc]]
    where = np.concatenate([[0], np.cumsum(np.diff(off) + 1)])  # each text has one prefix more than characters
    out = np.zeros(where[-1], np.int64)

    def put(first: np.ndarray, last: np.ndarray, of: np.ndarray, base: np.ndarray) -> None:
        n = last - first
        places = ragged(first, n)  # characters; the prefix that ends with one
        owner = np.searchsorted(off, first, side="right")
        slots = lead[places + 1] + np.repeat(prefixes.slot[of] - lead[first], n)
        out[places + np.repeat(owner, n)] = np.repeat(base, n) + prefixes.count[slots]

    put(begin, finish, number[:n_units], before)
    if len(contracted):  # a prefix that ends after "'r" has the apostrophe and the letter apart
        owner = np.searchsorted(off, contracted - 1, side="right") - 1
        unit = np.searchsorted(begin, contracted - 1, side="right") - 1
        out[contracted + owner] = before[unit] + 2
    if len(runs):  # a prefix that ends inside a space run has the run so far as one pre-token
        unit = np.searchsorted(begin, runs[:, 0])
        put(runs[:, 0], runs[:, 1], number[n_units:], before[unit])
    return out, where


def _around_special(text: Bytes, fixed: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    out, where = [], [0]
    for i in range(text.n):
        rest, base = text.data[text.off[i]:text.off[i + 1]].tobytes(), 0
        counts = [np.zeros(1, np.int64)]
        while rest:
            hits = [(rest.find(x), -len(x), x) for x in fixed if x in rest]
            at, _, x = min(hits, default=(len(rest), 0, b""))
            if at:
                c, _ = prefix_counts(Bytes(np.frombuffer(rest[:at], np.uint8), np.array([0, at])), path)
                counts.append(base + c[1:])
                base += int(c[-1])
            if x:
                base += 1
                counts.append(np.full(len(x.decode()), base))
            rest = rest[at + len(x):]
        out.append(np.concatenate(counts))
        where.append(where[-1] + len(out[-1]))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.array(where)


def _path(name_or_path: str) -> str:
    import public_tokenizers

    return name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path)


def prefix_table(docs: DataFrame, vocabulary_file: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, counts): counts[i] tokens in the first i characters."""
    session.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch, limit=CHUNK):
                counts, where = prefix_counts(text, _path(vocabulary_file))
                lists = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(counts.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(text.off)), lists], ["doc_id", "n_bytes", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, counts array<int>")


def tokens_in_prefix(counts: Column, n_chars: Column | int) -> Column:
    return F.get(counts, F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size(counts) - 1))


def counted(docs: DataFrame, limit: int = LIMIT, vocabulary_file: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars): fit_chars is the longest prefix of at most `limit` tokens.

    Reads the same prefix counts inside the task, without handing the table on.
    """
    session.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch, limit=CHUNK):
                counts, where = prefix_counts(text, _path(vocabulary_file))
                n = counts[where[1:] - 1]
                within = np.where(counts <= limit, np.arange(len(counts)), 0)
                fit = np.maximum.reduceat(within, where[:-1]) - where[:-1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(text.off)), pa.array(n), pa.array(n > limit), pa.array(fit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(load(spark, sf_dir))
