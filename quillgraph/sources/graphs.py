"""Graphs derived from the base tables: edges(src, dst[, w])."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.session import discard, materialize, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of parts in one order, src < dst: an undirected simple graph. One shuffle by order, one for distinct."""
    return _pairs(_baskets(spark, sf_dir)).distinct()


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p: the parts of each order of two and more."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    return parts.where(F.size("p") > 1).select("p")


def _pairs(baskets: DataFrame) -> DataFrame:
    tails = F.transform("p", lambda x, i: F.struct(x.alias("src"), F.slice(F.col("p"), i + 2, F.size("p")).alias("rest")))
    return baskets.select(F.explode(tails).alias("t")).select(F.col("t.src").alias("src"), F.explode("t.rest").alias("dst"))


def baskets_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a written table."""
    return materialize(_baskets(spark, sf_dir), "baskets")


#: Pairs that are made distinct, and so shuffled, at a time.
PAIRS = 24_000_000


def co_purchase_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a written table, made for a share of the sources after another, so that the shuffle files of one at a time are there."""
    baskets = baskets_written(spark, sf_dir)
    size = F.size("p").cast("long")
    rounds = -(-(baskets.agg(F.sum(size * (size - 1))).collect()[0][0] or 0) // (2 * PAIRS))
    pairs, path = _pairs(baskets), shared_dir(spark, "co")
    for i in range(max(1, rounds)):
        some = pairs.where(F.pmod(F.xxhash64("src"), F.lit(rounds)) == i) if rounds > 1 else pairs
        out = materialize(some.distinct().sortWithinPartitions("src", "dst"), path=f"{path}/round={i}")  # smaller so
    discard(baskets)
    out = spark.read.schema(out.schema).parquet(*[f"{path}/round={i}" for i in range(max(1, rounds))])
    out._written = path
    return out


def succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part -> next part in the same order, w = least quantity: directed and weighted, with self-loops."""
    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pairs = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_quantity").alias("w"))
    return pairs.where("dst is not null").groupBy("src", "dst").agg(F.min("w").alias("w"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> supplier with the number of lines; supplier ids start above the largest customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    top = table(spark, sf_dir, "customer").agg((F.max("c_custkey") + 1).alias("base"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count("*").cast("double").alias("w"))
    base = top.collect()[0]["base"]
    return joined.select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + F.lit(base)).alias("dst"), "w")


CO_PURCHASE_SQL = """co as (
  select distinct a.l_partkey as src, b.l_partkey as dst
  from (select distinct l_orderkey, l_partkey from lineitem) a
  join (select distinct l_orderkey, l_partkey from lineitem) b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey)"""
UNDIRECTED_SQL = CO_PURCHASE_SQL + ", und as (select src, dst from co union all select dst, src from co)"
SUCCESSION_SQL = """succ as (
  select src, dst, min(w) as w from (
    select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as dst, l_quantity as w
    from lineitem) where dst is not null group by src, dst)"""
TRADE_SQL = """trade as (
  select o_custkey as src, l_suppkey + (select max(c_custkey) + 1 from customer) as dst, cast(count(*) as double) as w
  from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_suppkey)"""
