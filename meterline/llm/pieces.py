"""SentencePiece encoding and decoding of whole texts with a byte-pair model file.

A text is cut where no piece reaches across: before a run of blanks, and between characters that no piece has side by
side. The distinct parts of a batch go through the batched programme of `bpe`: parts advance together by prefix length,
substring hashes probe the sorted piece keys, and the best fitting step is kept as a back pointer. The model is of the
byte-pair kind, whose encoding is not the path of highest total score, so a step counts only if its piece and the one
before it encode to themselves; exactly one path is left and it is the library's.

Defined cases: null or empty text: no pieces, decoded as empty; U+2581 in a text decodes as a blank, as in the library;
rows with equal ids are separate documents; other columns are left out by encode() and kept by with_pieces().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meterline import session
from meterline.llm.bpe import PieceSet, Prefixes, code_points, distinct, symbol_values
from meterline.llm.common import Bytes, Rolling, load, ragged, text_chunks

MODEL = "piece_bpe_32k.model"
CHUNK = 3 << 19
BLANK = 0x2581
NEAR = 0x400  # characters below have a table of neighbours


class Model:
    """Pieces, scores and bytes of a model file, and which characters stand side by side in a piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        pieces = [None if s else p for p, s in zip(names, special)]
        score = {p: -lib.get_score(i) for i, p in enumerate(pieces) if p}
        self.pieces = PieceSet(pieces, lambda a, b: score.get(a + b))
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if lib.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        raw = [bytes([int(names[i][3:5], 16)]) if lib.is_byte(i) else (p or "").replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        pairs = {(ord(a), ord(b)) for p in pieces if p for a, b in zip(p, p[1:])}
        self.near = np.zeros((NEAR, NEAR), bool)
        for a, b in pairs:
            if a < NEAR and b < NEAR:
                self.near[a, b] = True
        self.far = np.array(sorted((a << 21) | b for a, b in pairs), np.int64)

    def apart(self, cps: np.ndarray) -> np.ndarray:
        """True before each character that no piece joins to the one before it."""
        out = np.ones(len(cps), bool)
        a, b = cps[:-1].astype(np.int64), cps[1:].astype(np.int64)
        near = (a < NEAR) & (b < NEAR)
        ok = np.zeros(len(a), bool)
        ok[near] = self.near[a[near], b[near]]
        far = np.flatnonzero(~near)
        key = (a[far] << 21) | b[far]
        ok[far] = self.far[np.minimum(np.searchsorted(self.far, key), len(self.far) - 1)] == key
        out[1:] = ~ok
        return out


@lru_cache(1)
def model(name_or_path: str) -> Model:
    import public_tokenizers

    return Model(name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path))


def encode_batch(text: Bytes, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts end to end, and each text's bounds."""
    cps, _, off = code_points(text.data, text.off)
    full = np.diff(off) > 0
    shift = np.cumsum(full)  # a blank goes before every text that is not empty
    off = off + np.concatenate([[0], shift])
    symbols = np.full(off[-1], BLANK, np.int64)
    inside = np.ones(off[-1], bool)
    inside[off[:-1][full]] = False
    symbols[inside] = np.where(cps == 32, BLANK, cps)
    if not len(symbols):
        return np.zeros(0, np.int64), np.zeros(text.n + 1, np.int64)
    begin = m.apart(symbols)
    begin[1:] |= (symbols[1:] == BLANK) & (symbols[:-1] != BLANK)
    begin[off[:-1][full]] = True
    begin = np.flatnonzero(begin)
    finish = np.append(begin[1:], len(symbols))
    rolling = Rolling(symbol_values(symbols))
    one, number = distinct(rolling.of(begin, finish))
    tokens, totals = Prefixes(m.pieces, symbols, rolling, begin[one], finish[one]).tokens()
    tokens, totals = _with_bytes(tokens, totals, m)
    at = np.cumsum(totals) - totals
    n = totals[number]
    ids = tokens[ragged(at[number], n)]
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids, ends[np.searchsorted(begin, off)]


def _with_bytes(tokens: np.ndarray, totals: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Characters that are no piece become the pieces of their bytes."""
    own = len(m.pieces.pieces)
    lone = np.flatnonzero(tokens >= own)
    if not len(lone):
        return tokens, totals
    spelled = [chr(c).encode() for c in tokens[lone] - own]
    n = np.ones(len(tokens), np.int64)
    n[lone] = [len(s) for s in spelled]
    out = np.repeat(tokens, n)
    out[ragged((np.cumsum(n) - n)[lone], n[lone])] = m.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    part = np.repeat(np.arange(len(totals)), totals)
    return out, np.bincount(part, n, len(totals)).astype(np.int64)


def decode_batch(ids: np.ndarray, bounds: np.ndarray, m: Model) -> Bytes:
    """Texts of piece sequences; the blank before each text is taken away again."""
    n = m.raw_len[ids]
    data = m.raw[ragged(m.raw_at[ids], n)]
    off = np.concatenate([[0], np.cumsum(n)])[bounds]
    full = np.diff(off) > 0
    keep = np.ones(len(data), bool)
    keep[off[:-1][full]] = False
    return Bytes(data[keep], off - np.concatenate([[0], np.cumsum(full)]))


def _run(docs: DataFrame, schema: str, columns, model_file: str) -> DataFrame:
    session.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for batch in batches:
            for part, text in text_chunks(batch, limit=CHUNK):
                ids, bounds = encode_batch(text, m)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(*columns(part, text, ids, bounds, lists, m))

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """(doc_id, n_bytes, n_pieces, pieces, pieces_sha256, decoded_sha256, round_trip).

    pieces_sha256 is over the ids as 4-byte little-endian integers; round_trip: decoding gives the text back.
    """

    def columns(part, text, ids, bounds, lists, m):
        back = decode_batch(ids, bounds, m)
        raw, packed, decoded = text.data.tobytes(), ids.astype("<i4").tobytes(), back.data.tobytes()
        same, shas, decs = [], [], []
        for i in range(text.n):
            d = decoded[back.off[i]:back.off[i + 1]]
            same.append(d == raw[text.off[i]:text.off[i + 1]])
            shas.append(hashlib.sha256(packed[4 * bounds[i]:4 * bounds[i + 1]]).hexdigest())
            decs.append(hashlib.sha256(d).hexdigest())
        return ([part.column("doc_id"), pa.array(np.diff(text.off)), pa.array(np.diff(bounds)), lists, pa.array(shas, pa.string()), pa.array(decs, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "n_bytes", "n_pieces", "pieces", "pieces_sha256", "decoded_sha256", "round_trip"])

    return _run(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_pieces bigint, "
                "pieces array<int>, pieces_sha256 string, decoded_sha256 string, round_trip boolean", columns, model_file)


def with_pieces(docs: DataFrame, model_file: str = MODEL, column: str = "pieces") -> DataFrame:
    """docs with a column of piece ids (in place of one of that name)."""
    docs = docs.drop(column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def columns(part, text, ids, bounds, lists, m):
        return [*part.columns, lists], [*part.schema.names, column]

    return _run(docs, f"{schema}, `{column}` array<int>", columns, model_file)


def decode(encoded: DataFrame, model_file: str = MODEL, column: str = "pieces") -> DataFrame:
    """(doc_id, text) of (doc_id, pieces); null pieces decode as empty text."""
    session.ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for batch in batches:
            lists = batch.column(column).fill_null(pa.scalar([], batch.column(column).type))
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            back = decode_batch(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds, m)
            raw = back.data.tobytes()
            texts = [raw[a:b].decode(errors="replace") for a, b in zip(back.off, back.off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", column).mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir))
