"""Quality rules on repetition coverage.

Rolling hashes of n-grams of several lengths are compared inside each document; a rule looks at the share of word
characters that lie in n-grams and in lines found before in the document (the first one counts as text, not as repetition). Whole batches are worked on at
once: an n-gram's key holds its document, so one sort finds every document's repetitions.

Defined cases: null text or no words: base_failed, not kept; rows with equal ids are separate documents; kept() keeps
the other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meterline import session
from meterline.llm.common import Bytes, Rolling, load, mix64, repeated, text_chunks

MIN_WORDS = 50
MAX_REPEATED_WORDS = 50  # percent, in windows of three words
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}  # share of word characters in repeated n-grams
LINE_LIMIT = 0.20  # share of word characters in lines equal to an earlier one
SYMBOL_LIMIT = 0.10  # symbols to words
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngram_keys(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and key (with the document) of each n-gram."""
    first = np.flatnonzero(doc[n - 1:] == doc[:len(doc) - n + 1]) if len(doc) >= n else np.zeros(0, np.int64)
    h = np.zeros(len(first), np.uint64)
    for i in range(n):
        h = h * _STEP + words[first + i]
    return first, mix64(h + mix64(doc[first].astype(np.uint64) + np.uint64(1)))


def later(key: np.ndarray) -> np.ndarray:
    """Marks every occurrence of a key but the first."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:][key[order][1:] == key[order][:-1]]] = True
    return out


def covered(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the n-grams that start at `first`."""
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + n, -1)
    return np.cumsum(mark[:-1]) > 0


def measure(text: Bytes) -> dict[str, np.ndarray]:
    data = text.data
    starts, ends, doc = text.words()
    rolling = Rolling(text.values())
    words = rolling.of(starts, ends)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = lead[ends] - lead[starts]
    per_doc = lambda of, weight=None: np.bincount(of, weight, text.n).astype(np.int64)
    out = {"n_words": per_doc(doc), "word_chars": per_doc(doc, chars), "n_symbols": text.per_doc(_IS_SYMBOL[data])}
    edge = np.zeros(len(data) + 1, bool)
    edge[text.off] = True
    breaks = data == 10
    begin = edge[:-1].copy()
    begin[1:] |= breaks[:-1]
    begin = np.flatnonzero(begin)
    finish = np.append(begin[1:], len(data))
    finish = finish - (breaks[np.maximum(finish - 1, 0)] if len(data) else 0)
    at = np.searchsorted(starts, begin), np.searchsorted(starts, finish)
    wordy = at[1] > at[0]
    begin, finish, at = begin[wordy], finish[wordy], (at[0][wordy], at[1][wordy])
    line_doc = text.doc_of(begin)
    key = mix64(rolling.of(begin, finish) + mix64(line_doc.astype(np.uint64) + np.uint64(1)))
    again = later(key)
    run = np.concatenate([[0], np.cumsum(chars)])
    out["n_dup_lines"] = per_doc(line_doc[again])
    out["dup_line_chars"] = per_doc(line_doc[again], (run[at[1]] - run[at[0]])[again])
    first, keys = ngram_keys(words, doc, 3)
    three = covered(first[repeated(keys)], 3, len(words))
    out["n_repeat_words"] = per_doc(doc[three])
    for n in NGRAM_LIMITS:
        first, keys = ngram_keys(words, doc, n)
        inside = covered(first[later(keys)], n, len(words))
        out[f"dup_{n}gram_chars"] = per_doc(doc[inside], chars[inside])
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_WORDS * m["n_words"])
    bad = (m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]) | (m["n_symbols"] > SYMBOL_LIMIT * m["n_words"])
    for n, limit in NGRAM_LIMITS.items():
        bad |= m[f"dup_{n}gram_chars"] > limit * m["word_chars"]
    return failed, ~failed & ~bad


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_{n}gram_chars" for n in NGRAM_LIMITS]]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, the measures, base_failed, kept)."""
    session.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch):
                m = measure(text)
                failed, kept = verdict(m)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(m[k]) for k in NAMES], pa.array(failed), pa.array(kept)],
                                                 ["doc_id", *NAMES, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} bigint" for k in NAMES) + ", base_failed boolean, kept boolean")


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass."""
    session.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch):
                yield part.filter(pa.array(verdict(measure(text))[1]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(load(spark, sf_dir))
