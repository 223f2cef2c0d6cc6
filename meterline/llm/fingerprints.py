"""Document fingerprints by Order MinHash; DataFrame functions only.

A text's k-mers (k words in a row, or all words of a shorter text) are numbered by occurrence and hashed. The hash space
is cut into `BINS` ranges; in each the `PER_BIN` k-mers of smallest hash are kept, put back in text order, and the tuple
is hashed. Two texts agree in a bin only where the same numbered k-mers stand in the same order, which follows edit
distance rather than overlap alone. Arrays inside a row hold a document's k-mers, so nothing but texts is shuffled.

Defined cases: null text: empty; no words: every bin empty, equal to any other such text; null ids come last; rows with
equal ids are separate documents, in the order of their texts; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from meterline.llm.common import load, stored

WORDS_PER_KMER = 2
BIN_BITS = 5
BINS = 1 << BIN_BITS
PER_BIN = 2
FIRST_LOOK = 12  # hashes of each bin sorted at first in a long text, about
RANGE_ROWS = 1000  # documents in one range of ids, about
_LOW = 0xFFFFFFFF


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def _words(text: Column) -> Column:
    t = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def signature(text: Column) -> Column:
    """array<bigint> of BINS tuple hashes; 0 where a bin is empty.

    Array elements are a hash in the upper 32 bits over a place in the lower.
    """
    kmer = lambda x: F.shiftright(x, 32)
    number = lambda x, occurrence: F.xxhash64(kmer(x), occurrence).bitwiseAND(~_LOW).bitwiseOR(x.bitwiseAND(_LOW))

    def kmers(words: Column) -> Column:
        n = F.size(words)
        n = F.when(n > 0, F.greatest(n - (WORDS_PER_KMER - 1), F.lit(1))).otherwise(0)
        key = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WORDS_PER_KMER)])
        return F.sort_array(F.transform(_upto(n), lambda i: key(i).bitwiseAND(~_LOW).bitwiseOR(i.cast("long"))))

    def numbered(a: Column) -> Column:
        """Equal k-mers stand together in text order: the first has number 0, the others their distance from it."""
        again = lambda x, j: kmer(x).eqNullSafe(kmer(F.get(a, j - 1)))
        first = F.transform(F.filter(a, lambda x, j: ~again(x, j)), lambda x: number(x, F.lit(0)))
        return F.concat(first, let(F.filter(a, again), later))

    def later(a: Column) -> Column:
        starts = F.filter(_upto(F.size(a)), lambda j: ~kmer(F.get(a, j)).eqNullSafe(kmer(F.get(a, j - 1))))
        counts = lambda s: F.flatten(F.transform(s, lambda x, t: F.sequence(
            F.lit(1), F.coalesce(F.get(s, t + 1), F.size(a)) - x)))
        return let(let(starts, counts), lambda occ: F.transform(a, lambda x, j: number(x, F.get(occ, j))))

    def smallest(a: Column) -> Column:
        """The PER_BIN least of each bin. Of a long text only hashes in the lower part of each bin are sorted first;
        all are sorted where a bin has too few there."""
        least = lambda a: let(F.sort_array(a), lambda s: F.filter(
            s, lambda x, j: (j < PER_BIN) | (_bin(F.get(s, j - PER_BIN)) != _bin(x))))
        part = lambda limit: F.filter(a, lambda x: F.shiftrightunsigned(F.shiftleft(x, BIN_BITS), 32) < limit)
        limit = (F.lit(float(FIRST_LOOK * BINS << 32)) / F.size(a)).cast("long")
        return F.when(F.size(a) < 2 * FIRST_LOOK * BINS, least(a)).otherwise(
            let(let(let(limit, part), least), lambda kept: F.when(F.size(kept) == BINS * PER_BIN, kept).otherwise(least(a))))

    def tuples(kept: Column) -> Column:
        in_order = lambda items: F.transform(F.sort_array(F.transform(
            items, lambda x: F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32)))), lambda y: y.bitwiseAND(_LOW))
        one = lambda items: F.when(F.size(items) > 0, F.xxhash64(in_order(items))).otherwise(F.lit(0).cast("long"))
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: let(F.filter(kept, lambda x: _bin(x) == b), one))

    return let(let(let(let(_words(text), kmers), numbered), smallest), tuples)


def likeness(a: Column, b: Column) -> Column:
    """Share of bins, filled in either, that agree; 1 when both are empty."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), None).otherwise((x == y).cast("double")))
    seen = F.filter(pairs, lambda p: p.isNotNull())
    return F.when(F.size(seen) == 0, 1.0).otherwise(
        F.aggregate(seen, F.lit(0.0), lambda s, p: s + p) / F.size(seen))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, sig) with next_text and next_sig of the document that follows by descending id, cyclically.

    Ranges of ids are ordered on their own; the first row of a range is also sent to the range above it, as what
    follows that range's last row.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * RANGE_ROWS // max(n, 1))
    place = F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)), F.lit(-1)).cast("long")
    docs = docs.withColumn("range", place)
    down = Window.orderBy(F.desc("range"))
    every = Window.partitionBy()
    heads = stored(docs.groupBy("range").agg(F.max("doc_id").alias("head"))
                   .withColumn("above", F.coalesce(F.lag("range").over(down), F.min("range").over(every))), "heads")
    is_head = (docs["range"] == heads["range"]) & docs["doc_id"].eqNullSafe(heads["head"])
    rows = (docs.join(heads, is_head, "left").select("doc_id", "text", "sig", docs["range"], "above")
            .withColumn("place", F.explode(F.when(F.col("above").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))))
                                           .otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")),
                                                              F.struct(F.col("above").alias("range"), F.lit(True).alias("guest"))))))
            .select("doc_id", "text", "sig", "place.range", "place.guest"))
    w = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return (rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sig", F.lead("sig").over(w))
            .filter(~F.col("guest")).drop("range", "guest"))


def fingerprints(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(docs.withColumn("sig", signature(F.col("text"))))
    d = d.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    d = d.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - half), substring(next_text, 1, half))"))
    d = d.withColumn("edited_sig", signature(F.col("edited")))
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
                    likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                    likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir))
