"""Alignment of the tokens of two tokenizers over the same text.

Each text is encoded by both libraries. The ends of the A tokens and of the B tokens, in bytes, are two sorted lists;
merging them walks through the text. The merge is cut by merge-path partitioning: the diagonals of the merge grid at
every PIECE steps are located by binary search, so each piece has the same work and starts without the ones before it.
All pieces of a chunk of texts advance together, step by step; a piece emits the pairs of overlapping tokens and the
ends that both share, and numbers its groups from 0. A last pass stitches the groups that pieces share by the running
total of shared ends.

Corpus-wide counts of linked id pairs go by chunk: a chunk of texts (CHUNK bytes, or one longer text) sends each of its
pairs once, with its number of links, and gets one answer per pair back.

Defined cases: null or empty text, or a text that one of the vocabularies does not give back byte for byte (U+2581 for
the piece model): no tokens, all counts 0, an empty digest; rows with equal ids are separate documents; other columns
are left out.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meterline import session
from meterline.llm.common import Bytes, load, ragged, stored, text_chunks
from meterline.llm.token_counts import byte_symbols

A_VOCABULARY = "byte_bpe_50k.json"
B_MODEL = "piece_bpe_32k.model"
PIECE = 256  # merge steps of one piece
FEW = 32  # texts given to a library at once: its results take many times the memory of their ids
CHUNK = 3 << 19
_FAR = np.iinfo(np.int64).max


class Strings:
    """A list of byte strings as one array; gathers any sequence of them."""

    def __init__(self, items: list[bytes]) -> None:
        self.size = np.array([len(x) for x in items], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(items), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.at[ids], self.size[ids])]


def _path(name_or_path: str) -> str:
    import public_tokenizers

    return name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path)


@lru_cache(2)
def byte_level(name: str):  # noqa: ANN201
    """The library's tokenizer and the bytes of each id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(_path(name))
    lib.encode_special_tokens = True
    back = byte_symbols()
    names = [lib.id_to_token(i) or "" for i in range(lib.get_vocab_size(with_added_tokens=True))]
    return lib, Strings([bytes(ord(back[c]) for c in x) if all(c in back for c in x) else x.encode() for x in names])


@lru_cache(2)
def piece_model(name: str):  # noqa: ANN201
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=_path(name))
    names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
    return lib, Strings([bytes([int(x[3:5], 16)]) if lib.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])


DIGITS = lru_cache(1)(lambda: Strings([str(i).encode() for i in range(1 << 16)]))


def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int64), *lists]), np.array([len(x) for x in lists], np.int64)


def gives_back(text: Bytes, strings: Strings, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which texts the tokens spell: a blank and the text."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    length = np.concatenate([[0], np.cumsum(strings.size[ids])])[bounds]
    good = (np.diff(length) == np.diff(text.off) + 1) & (np.diff(text.off) > 0)
    for i in np.flatnonzero(good):
        spelt = strings.spell(ids[bounds[i]:bounds[i + 1]])
        good[i] = spelt[0] == 32 and np.array_equal(spelt[1:], text.data[text.off[i]:text.off[i + 1]])
    return good


def split(a: np.ndarray, b: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """How many of the first `diagonal` items of the merge come from a (a goes first where both are equal)."""
    lo, hi = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        taken = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(diagonal - 1 - mid, 0, len(b) - 1)])
        lo = np.where(taken, mid + 1, lo)
        hi = np.where(open_ & ~taken, mid, hi)
    return lo


class Merge:
    """Merge of two ascending lists of ends, step by step.

    ia, ib: next items before the step; from_a: whose item the step takes; shared: the step takes the b end that equals
    the a end before it; overlap: the two items cover a common byte; group: shared ends before the step.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> None:
        n = len(a) + len(b)
        pieces = -(-n // piece)
        start = np.arange(pieces) * piece
        ia = split(a, b, start) if len(a) and len(b) else np.minimum(start, len(a))
        ib = start - ia
        a_end, b_end = np.append(a, _FAR), np.append(b, _FAR)
        before_a, before_b = np.concatenate([[-1], a]), np.concatenate([[-1], b])
        shape = (piece, pieces)
        ias, ibs, groups = np.empty(shape, np.int64), np.empty(shape, np.int64), np.empty(shape, np.int64)
        from_a, shared, overlap = np.empty(shape, bool), np.empty(shape, bool), np.empty(shape, bool)
        group = np.zeros(pieces, np.int64)
        for t in range(piece):
            ends, others = a_end[np.minimum(ia, len(a))], b_end[np.minimum(ib, len(b))]
            done_a, done_b = before_a[np.minimum(ia, len(a))], before_b[np.minimum(ib, len(b))]
            step = ends <= others
            tie = ~step & (others == done_a)
            ias[t], ibs[t], groups[t] = ia, ib, group
            from_a[t], shared[t] = step, tie
            overlap[t] = (np.minimum(ends, others) > np.maximum(done_a, done_b)) & (np.maximum(ends, others) < _FAR)
            group = group + tie
            ia = ia + step
            ib = ib + ~step
        groups += np.concatenate([[0], np.cumsum(group)])[:pieces]  # stitch: groups begun in an earlier piece go on
        line = lambda x: x.T.reshape(-1)[:n]
        self.ia, self.ib, self.group = line(ias), line(ibs), line(groups)
        self.from_a, self.shared, self.overlap = line(from_a), line(shared), line(overlap)


class Aligned:
    """The tokens of the texts that both vocabularies give back, their ends, groups and links."""

    def __init__(self, texts: list[str | None], text: Bytes, a_name: str, b_name: str) -> None:
        a_lib, a_strings = byte_level(a_name)
        b_lib, b_strings = piece_model(b_name)
        plain = [x or "" for x in texts]
        a, a_sizes = flat([np.array(e.ids, np.int64) for i in range(0, len(plain), FEW) for e in
                           a_lib.encode_batch_fast([" " + x for x in plain[i:i + FEW]], add_special_tokens=False)])
        b, b_sizes = flat([np.array(x, np.int64) for i in range(0, len(plain), FEW) for x in b_lib.encode(plain[i:i + FEW], num_threads=1)])
        good = gives_back(text, a_strings, a, a_sizes) & gives_back(text, b_strings, b, b_sizes)
        a, b = a[np.repeat(good, a_sizes)], b[np.repeat(good, b_sizes)]
        self.a, self.b = a, b
        self.n_a, self.n_b = np.where(good, a_sizes, 0), np.where(good, b_sizes, 0)
        self.a_first, self.b_first = np.concatenate([[0], np.cumsum(self.n_a)]), np.concatenate([[0], np.cumsum(self.n_b)])
        self.a_end, self.b_end = np.cumsum(a_strings.size[a]), np.cumsum(b_strings.size[b])
        m = self.merge = Merge(self.a_end, self.b_end)
        self.a_group, self.b_group = m.group[m.from_a], m.group[~m.from_a]
        self.link_a, self.link_b = m.ia[m.shared] - 1, m.ib[m.shared]
        self.link_doc = np.searchsorted(self.a_first, self.link_a, side="right") - 1
        self.n_links = np.bincount(self.link_doc, minlength=len(texts))
        last = lambda g, first, n: np.where(n > 0, g[np.maximum(first[1:] - 1, 0)] + 1, 0) if len(g) else np.zeros(len(n), np.int64)
        run = last(self.a_group, self.a_first, self.n_a)
        self.n_groups = np.where(self.n_a > 0, run - (self.a_group[np.minimum(self.a_first[:-1], max(len(a) - 1, 0))] if len(a) else 0), 0)

    def written(self) -> tuple[bytes, np.ndarray]:
        """`a1,a2|b1;a3|b2,b3` of each text with a separator more at its end, all end to end, and their bounds."""
        n_a, n_b = len(self.a), len(self.b)
        groups = int(self.a_group[-1]) + 1 if n_a else 0
        a_of, b_of = np.bincount(self.a_group, minlength=groups), np.bincount(self.b_group, minlength=groups)
        a_to, b_to = np.cumsum(a_of), np.cumsum(b_of)
        ids, sep = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        ids[np.arange(n_a) + (b_to - b_of)[self.a_group]] = self.a
        ids[np.arange(n_b) + a_to[self.b_group]] = self.b
        sep[a_to + b_to - b_of - 1] = ord("|")
        sep[a_to + b_to - 1] = ord(";")
        digits = DIGITS()
        size = digits.size[ids] + 1
        stop = np.cumsum(size)
        data = np.append(digits.data, np.uint8(0))[ragged(digits.at[ids], size)]
        data[stop - 1] = sep
        return data.tobytes(), np.concatenate([[0], stop])[self.a_first + self.b_first]


def alignments(docs: DataFrame, a_vocabulary: str = A_VOCABULARY, b_model: str = B_MODEL) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends, a_groups, b_groups, overlaps): ends in bytes of blank and text, groups
    numbered from 0, overlaps as pairs of token numbers that cover a common byte."""
    session.ship(docs.sparkSession)
    lists = ["a_ids", "b_ids", "a_ends", "b_ends", "a_groups", "b_groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_chunks(batch, limit=CHUNK):
                x = Aligned(part.column("text").to_pylist(), text, a_vocabulary, b_model)
                own = lambda v, first, base: v - np.repeat(base, np.diff(first))
                spans = np.concatenate([[0], np.cumsum(np.diff(text.off) + 1)])
                good = x.n_a > 0
                begun = np.concatenate([[0], np.cumsum(np.where(good, np.diff(spans), 0))[:-1]])
                g0 = np.concatenate([[0], np.cumsum(x.n_groups)[:-1]])
                o = x.merge.overlap
                oa, ob = x.merge.ia[o], x.merge.ib[o]
                of = np.searchsorted(oa, x.a_first)
                pairs = pa.StructArray.from_arrays([pa.array(own(oa, of, x.a_first[:-1])), pa.array(own(ob, of, x.b_first[:-1]))], ["a", "b"])
                values = [(x.a, x.a_first, None), (x.b, x.b_first, None), (x.a_end, x.a_first, begun), (x.b_end, x.b_first, begun),
                          (x.a_group, x.a_first, g0), (x.b_group, x.b_first, g0)]
                cols = [pa.ListArray.from_arrays(pa.array(f.astype(np.int32)), pa.array(v if base is None else own(v, f, base))) for v, f, base in values]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols, pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pairs)],
                                                 ["doc_id", *lists, "overlaps"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} array<bigint>' for c in lists)}, overlaps array<struct<a:bigint,b:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encoded(docs: DataFrame, a_vocabulary: str = A_VOCABULARY, b_model: str = B_MODEL) -> DataFrame:
    """Per document its counts, digest and links (numbers into its chunk's pairs); per chunk one row more with the pairs
    (A id x 65536 + B id) and how many links hold each."""
    session.ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "pair_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, text in text_chunks(batch, limit=CHUNK):
                x = Aligned(part.column("text").to_pylist(), text, a_vocabulary, b_model)
                pairs, number, links = np.unique((x.a[x.link_a] << 16) | x.b[x.link_b], return_inverse=True, return_counts=True)
                data, at = x.written()
                sha = [hashlib.sha256(data[i:j - 1]).hexdigest() if j > i else "" for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                first = np.concatenate([[0], np.cumsum(x.n_links)])
                n = text.n
                here = pa.array(np.full(n, chunk))
                yield pa.RecordBatch.from_arrays(
                    [here, part.column("doc_id"), pa.array(x.n_a), pa.array(x.n_b), pa.array(x.n_groups), pa.array(x.n_links), pa.array(sha),
                     pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(number.astype(np.int32))),
                     pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names)
                if len(pairs):
                    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))
                    none = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([here[:1], pa.nulls(1, part.column("doc_id").type), none, none, none, none, pa.nulls(1, pa.string()),
                                                      pa.nulls(1, pa.list_(pa.int32())), one(pairs), one(links)], names)
                chunk += 1

    return docs.select("doc_id", "text").mapInArrow(run, (
        f"chunk bigint, doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<int>, "
        "pairs array<bigint>, pair_links array<bigint>"))


def pair_counts(code: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair in the corpus, and whether no other A id has more with its B id."""
    one = code.filter("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", F.col("pair_links"))))
    counts = one.groupBy(F.col("pairs").alias("pair")).agg(F.sum("pair_links").alias("count"))
    by_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFF)))  # at most one row per A id
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(by_b)).alias("best"))


def linked(docs: DataFrame, a_vocabulary: str = A_VOCABULARY, b_model: str = B_MODEL) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    code = stored(encoded(docs, a_vocabulary, b_model), "alignment")
    asked = code.filter("pairs IS NOT NULL").select("chunk", F.posexplode("pairs").alias("pos", "pair"))
    answers = asked.join(pair_counts(code), "pair").select(F.col("chunk").alias("to"), "pos", "count", "best")
    found = code.filter("n_a IS NOT NULL").drop("pairs", "pair_links")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(told.column("pos").to_numpy())
        count = np.append(told.column("count").to_numpy()[order], 0)
        best = np.append(told.column("best").to_numpy()[order].astype(np.int64), 0)
        links = texts.column("links").combine_chunks()
        at = links.offsets.to_numpy()
        number = links.values.to_numpy()
        total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[number])])[at])
        cols = [texts.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*cols, pa.array(total(best)), pa.array(total(count)), texts.column("groups_sha256")],
                        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return found.groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(score, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(load(spark, sf_dir))
