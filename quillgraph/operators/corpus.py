"""Corpus operators on walks: vocabulary, subsampling, sampling distribution, context pairs, bigrams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import keep_chance
from ..functions.rng import u32, uniform
from ..functions.session import grouped_running, numbered, running_sum
from .flat import column_file, mapped

POWER, LONGEST = 0.75, 1000


def vocab_rank(counts: DataFrame) -> DataFrame:
    """counts(v, cn) -> v, cn, rank from 0: by count descending, ties by v."""
    return numbered(counts.select("v", "cn"), F.desc("cn"), F.asc("v"), name="rank")


def partition_freq_rank(owned: DataFrame) -> DataFrame:
    """v, cn, part -> the rank of each vertex inside its part, by count descending, ties by v."""
    rows = owned.withColumn("_one", F.lit(1).cast("long")).withColumn("_less", -F.col("cn"))
    return grouped_running(rows, "part", "_one", "_less", "v", name="rank").withColumn("rank", F.col("rank") - 1).drop("_one", "_less")


def freq_blocks(ranked: DataFrame) -> DataFrame:
    """Blocks of equal counts: cn, first rank, size."""
    return ranked.groupBy("cn").agg(F.min("rank").alias("first_rank"), F.count("*").alias("size"))


def unigram_cdf(ranked: DataFrame, power: float = POWER) -> DataFrame:
    """v, rank, cdf: running share of cn^power in order of rank."""
    rows = running_sum(ranked.withColumn("weight", F.pow(F.col("cn").cast("double"), F.lit(power))), "weight", "rank")
    total = rows.agg(F.max("upto")).collect()[0][0]
    return rows.select("v", "rank", (F.col("upto") / F.lit(total)).alias("cdf"))


def negative_draws(cdf: DataFrame, draws: int, salt: int = 7) -> DataFrame:
    """cdf(rank, cdf) -> id, rank: ``draws`` ranks of the distribution by the portable hash; rank 0 is replaced by a uniform one of the others.

    Draws are looked up in a flat file of the distribution, where they are made; without such a file they are joined.
    """
    file = column_file(cdf, "rank", "cdf", "<f8")
    if file is None:
        return negative_draws_joined(cdf, draws, salt)
    n = cdf.count()

    def run(batches):
        upto = np.array(mapped(file, "<f8"))
        for batch in batches:
            id_, x, other = (batch.column(c).to_numpy() for c in ("id", "x", "other"))
            rank = np.searchsorted(upto, x)
            met = rank < n
            rank = np.where((rank == 0) & (n > 1), other, rank)
            yield pa.RecordBatch.from_arrays([pa.array(id_[met]), pa.array(rank[met])], ["id", "rank"])

    other = 1 + F.pmod(u32(salt, F.col("id"), "zero"), F.lit(max(n - 1, 1)))
    drawn = cdf.sparkSession.range(draws).select("id", uniform(salt, F.col("id"), "neg").alias("x"), other.cast("long").alias("other"))
    return drawn.mapInArrow(run, "id long, rank long")


def negative_draws_joined(cdf: DataFrame, draws: int, salt: int = 7) -> DataFrame:
    """The same by a join: a draw meets the ranks of its bucket of equal share, of which there are as many as ranks."""
    spark = cdf.sparkSession
    n = cdf.count()
    before = F.lag("cdf").over(Window.partitionBy("near").orderBy("rank"))
    # the rank before is in the same group: each rank stands in its own and as the last of the one after
    pairs = cdf.select("rank", "cdf", F.explode(F.array("rank", F.col("rank") + 1)).alias("near"))
    spans = pairs.withColumn("low", before).where("near = rank").select("rank", F.coalesce("low", F.lit(-1.0)).alias("low"), "cdf")
    at = lambda x: F.least(F.floor(F.greatest(x, F.lit(0.0)) * n), F.lit(n)).cast("long")
    spans = spans.withColumn("bucket", F.explode(F.sequence(at(F.col("low")), at(F.col("cdf")))))
    drawn = spark.range(draws).withColumn("x", uniform(salt, F.col("id"), "neg")).withColumn("bucket", at(F.col("x")))
    met = drawn.join(spans, "bucket").where("x > low and x <= cdf")
    other = 1 + F.pmod(u32(salt, F.col("id"), "zero"), F.lit(max(n - 1, 1)))
    return met.select("id", F.when((F.col("rank") == 0) & F.lit(n > 1), other).otherwise(F.col("rank")).cast("long").alias("rank"))


def corpus_size(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("cn").alias("tokens"))


def keep_chances(counts: DataFrame, sample: float = 1e-3) -> DataFrame:
    """v, keep: the chance that a visit of v stays in training."""
    total = counts.agg(F.sum("cn")).collect()[0][0] or 0
    return counts.select("v", keep_chance(F.col("cn"), F.lit(float(total)), sample).alias("keep"))


def subsample(seen: DataFrame, counts: DataFrame, sample: float = 1e-3, salt: int = 7) -> DataFrame:
    """Visits that survive, by the portable hash; frequent vertices are a key of a join whose other side is one row a vertex."""
    chances = keep_chances(counts, sample).withColumnRenamed("v", "vertex")
    met = seen.join(chances, "vertex")
    return met.where(uniform(salt, F.col("round"), F.col("walker"), F.col("step"), "s") < F.col("keep")).drop("keep")


def sentence_cut(path: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Paths cut to the longest sentence; those of less than two tokens go."""
    return path.withColumn("path", F.slice("path", 1, longest)).where(F.size("path") > 1)


def sentences(walkers: DataFrame, seen: DataFrame) -> DataFrame:
    """round, walker, path: the visits that are left of every walk, none for a walk that has lost all."""
    steps = F.array_sort(F.collect_list(F.struct("step", "vertex")))
    left = seen.groupBy("round", "walker").agg(F.transform(steps, lambda x: x["vertex"]).alias("path"))
    return walkers.select("round", "walker").join(left, ["round", "walker"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<long>")))


def null_sentences(path: DataFrame) -> DataFrame:
    """How many sentences have no token."""
    return path.agg(F.count_if(F.size("path") == 0).alias("empty"))


def distinct_words(path: DataFrame) -> DataFrame:
    return path.select("round", "walker", F.size(F.array_distinct("path")).alias("words"))


def context_pairs(path: DataFrame, window: int = 5, salt: int = 7) -> DataFrame:
    """round, walker, i, center, context: for each place a radius window - b, b drawn from 0 .. window - 1, clipped to the path.

    Made inside a path's row, no join.
    """
    at = path.select("round", "walker", "path", F.posexplode("path").alias("i", "center"))
    radius = F.lit(window) - F.pmod(u32(salt, F.col("round"), F.col("walker"), F.col("i"), "b"), F.lit(window)).cast("int")
    at = at.withColumn("radius", radius)
    near = F.sequence(F.greatest(F.lit(0), F.col("i") - F.col("radius")), F.least(F.size("path") - 1, F.col("i") + F.col("radius")))
    rows = at.select("round", "walker", "path", "i", "center", F.explode(near).alias("j")).where("i <> j")
    return rows.select("round", "walker", "i", "center", F.element_at("path", F.col("j") + 1).alias("context"))


def cooccurrence(seen: DataFrame) -> DataFrame:
    """a, b, n: a vertex and the next on its walk, the last with itself."""
    nxt = F.lead("vertex").over(Window.partitionBy("round", "walker").orderBy("step"))
    return seen.select(F.col("vertex").alias("a"), F.coalesce(nxt, F.col("vertex")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def walk_counters(seen: DataFrame, owner: Column) -> DataFrame:
    """steps, hops between parts and within one; ``owner``: the part of the column vertex."""
    before = F.lag("part").over(Window.partitionBy("round", "walker").orderBy("step"))
    rows = seen.withColumn("part", owner).withColumn("before", before)
    return rows.agg(F.count_if(F.col("step") > 0).alias("steps"), F.count_if(F.col("before") != F.col("part")).alias("cross"), F.count_if(F.col("before") == F.col("part")).alias("local"))
