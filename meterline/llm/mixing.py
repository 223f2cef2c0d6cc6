"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks; DataFrame functions only.

Every source is one stream of words, its documents in seeded order, cut into blocks of `block_words`. Seats (one
block each) go to the sources by highest quotients target / (2k + 1); the seats of the first j shards are the
apportionment of that many seats, so shard quotas are integers and add up. A source's seats then take its blocks in a
seeded permutation, from the start again when all are used.

Defined cases: null text: size 0; null source: a source of its own, last in order; no rows: no rows; rows with equal
ids are separate documents; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from meterline import session
from meterline.llm.common import WORD, load

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
BLOCK_WORDS = 64
SHARDS = 16
STREAM_ROWS = 250  # documents in one piece of a source's stream, about
SEED = 11


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """From (__key, __null, source_size): adds weight and target; shares by weight, capped, the excess shared again.

    Sources fill up in the order of cap / weight: all before the first one that stays below its cap are at it.
    """
    rank = F.row_number().over(Window.orderBy("__null", "__key")) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int"))
    fill = Window.orderBy("__fill", "__key")
    everything = Window.partitionBy()
    return (sizes.withColumn("__weight", w)
            .withColumn("__cap", F.col("source_size") * F.lit(float(max_repeat)))
            .withColumn("__fill", F.col("__cap") / F.col("__weight"))
            .withColumn("__total", F.sum("source_size").over(everything))
            .withColumn("__full", F.coalesce(F.sum("__cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("__rest", F.sum("__weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("__level", (F.col("__total") - F.col("__full")) / F.col("__rest"))
            .withColumn("__level", F.min_by("__level", F.when(F.col("__level") <= F.col("__fill"), F.struct("__fill", "__key"))).over(everything))
            .withColumn("target", F.least("__cap", F.coalesce(F.col("__level") * F.col("__weight"), F.col("__cap")))))


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """(shard, __key, quota, seats): blocks of each source in each shard; seats counts this and all earlier shards.

    Every source surely has the seats up to p (m - n / 2) - 1 / 2 and none beyond p (m + n / 2) + 1 / 2, for its share
    p, m seats and n sources; only the few between compete by their quotients.
    """
    w = Window.partitionBy("shard")
    s = (sources.withColumn("__n", F.count("*").over(Window.partitionBy()))
         .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
         .withColumn("__m", F.floor(F.round(F.col("__total") / block_words) * F.col("shard") / shards))
         .withColumn("__p", F.when(F.col("__total") > 0, F.col("target") / F.col("__total")).otherwise(0.0))
         .withColumn("__sure", F.greatest(F.lit(0), F.ceil(F.col("__p") * (F.col("__m") - F.col("__n") / 2) - 0.5)))
         .withColumn("__top", F.greatest(F.col("__sure"), F.floor(F.col("__p") * (F.col("__m") + F.col("__n") / 2) + 0.5)))
         .withColumn("__open", F.col("__m") - F.sum("__sure").over(w)))
    seat = F.explode(F.when(F.col("__top") > F.col("__sure"), F.sequence("__sure", F.col("__top") - 1)))
    won = (s.select("shard", "__key", "__open", "target", seat.alias("__k"))
           .withColumn("__place", F.row_number().over(w.orderBy(F.desc(F.col("target") / (2 * F.col("__k") + 1)), "__key")))
           .filter(F.col("__place") <= F.col("__open")).groupBy("shard", "__key").agg(F.count("*").alias("__won")))
    total = (s.join(won, ["shard", "__key"], "left")
             .withColumn("seats", (F.col("__sure") + F.coalesce("__won", F.lit(0))).cast("long")))
    before = F.lag("seats", 1, 0).over(Window.partitionBy("__key").orderBy("shard"))
    return total.select("shard", "__key", "seats", (F.col("seats") - before).alias("quota"))


def mixed(docs: DataFrame, size: Column | None = None, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT,
          block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, taken, __start (first word's place in its source's stream), __blocks, __seats."""
    d = (docs.withColumn("size", word_count() if size is None else size)
         .withColumn("__key", F.coalesce(F.col("source"), F.lit("")))
         .withColumn("__null", F.col("source").isNull()))
    by = ["__key", "__null"]
    per_source = d.groupBy(*by).agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows"))
    plan = session.checkpoint(targets(per_source, weights, max_repeat).withColumn("__name", F.col("__key"))
                              .withColumn("__key", F.concat(F.col("__null").cast("int"), F.lit(":"), F.col("__key"))))
    rows = plan.agg(F.sum("__rows")).first()[0] or 0
    pieces = max(1, -(-rows // STREAM_ROWS))
    seats = quotas(plan, block_words, shards).filter(F.col("shard") == shards).select("__key", "seats")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")
    plan = (plan.join(seats, "__key").withColumn("__blocks", blocks)
            .withColumn("__seats", F.least(F.col("seats"), F.col("__blocks") * max_repeat))
            .withColumn("__shift", F.pmod(F.xxhash64(F.lit(seed), "__key"), F.col("__blocks")))
            .select("__key", "source_size", "target", "__blocks", "__seats", "__shift"))
    d = (d.withColumn("__key", F.concat(F.col("__null").cast("int"), F.lit(":"), F.col("__key"))).drop("__null")
         .withColumn("__piece", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(pieces))))
    along = Window.partitionBy("__key").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (d.groupBy("__key", "__piece").agg(F.sum("size").alias("__words"))
               .withColumn("__offset", F.coalesce(F.sum("__words").over(along), F.lit(0)))
               .join(plan, "__key").drop("__words"))
    inside = (Window.partitionBy("__key", "__piece").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    d = (d.join(offsets, ["__key", "__piece"])
         .withColumn("__start", F.col("__offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))))
    first, last = F.floor(F.col("__start") / block_words), F.floor((F.col("__start") + F.col("size") - 1) / block_words)

    def add(acc, b):
        covered = F.least((b + 1) * block_words, F.col("__start") + F.col("size")) - F.greatest(b * block_words, F.col("__start"))
        return acc + covered * times(b)

    taken = F.when(F.col("size") > 0, F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), add)).otherwise(F.lit(0))
    return d.withColumn("taken", taken.cast("long")).drop("__key", "__piece", "__offset")


def times(block: Column) -> Column:
    """How often the mix takes a block: seats go round the blocks in the order (a * block + shift) mod blocks."""
    n = F.col("__blocks")
    step = F.when(n % 1000003 == 0, 1000033).otherwise(1000003)
    place = F.pmod(block * step + F.col("__shift"), n)
    return F.floor((F.col("__seats") + n - 1 - place) / n)


def taken_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, a row for each time a document is taken whole and one for further blocks of it."""
    block_words = options.get("block_words", BLOCK_WORDS)
    keep = docs.columns
    d = mixed(docs.filter(word_count() > 0), **options)
    first, last = F.floor(F.col("__start") / block_words), F.floor((F.col("__start") + F.col("size") - 1) / block_words)
    d = d.withColumn("__runs", F.transform(F.sequence(first, last), lambda b: F.struct(
        (F.greatest(b * block_words, F.col("__start")) - F.col("__start")).cast("int").alias("at"),
        (F.least((b + 1) * block_words, F.col("__start") + F.col("size"))
         - F.greatest(b * block_words, F.col("__start"))).cast("int").alias("n"), times(b).alias("times"))))
    d = d.withColumn("__whole", F.array_min(F.transform("__runs", lambda r: r["times"])))
    d = d.withColumn("__most", F.array_max(F.transform("__runs", lambda r: r["times"])))
    d = d.filter("__most > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__most"))))
    pieces = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    part = F.array_join(F.flatten(F.transform(F.array(F.struct(pieces.alias("p"), F.col("__runs").alias("r"), F.col("__copy").alias("c"))),
                        lambda x: F.flatten(F.transform(F.filter(x["r"], lambda r: r["times"] >= x["c"]),
                                                        lambda r: F.slice(x["p"], r["at"] + 1, r["n"]))))), "")
    text = F.when(F.col("__copy") <= F.col("__whole"), F.col("text")).otherwise(part)
    d = d.withColumn("text", text)
    if "n_chars" in keep:
        d = d.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.checkpoint(load(spark, sf_dir).select("doc_id", "source", word_count().alias("__words")))
    return mixed(docs, F.col("__words")).select("doc_id", "size", "source_size", "target", "taken")
