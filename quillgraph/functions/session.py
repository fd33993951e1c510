"""Written intermediate tables in the shared folder, and numbering without a global sort in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own;
    on a cluster executors would not share one, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quill-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:
        root = "file://" + root
    return f"{root.rstrip('/')}/quill-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder; a lost executor does not lose it.

    The shuffle files of the write go with its end, not with the driver's next garbage collection."""
    spark = df.sparkSession
    path, kept = path or shared_dir(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() gave, when all that is made of them is written."""
    spark = tables[0].sparkSession
    for path in [t._written for t in tables]:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """Adds a dense number from 0 in the given total order.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the rows in
    the partitions before, a prefix sum over one small row a partition.
    """
    spark = df.sparkSession
    rows = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = materialize(rows.withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base")))  # a row a partition
    return rows.join(bases, "_part").withColumn(name, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")


def running_sum(df: DataFrame, value: str, *order, name: str = "upto") -> DataFrame:
    """Adds the inclusive running sum of ``value`` in the given total order, in two levels like numbered()."""
    return running_sums(df, {name: value}, *order)


def running_sums(df: DataFrame, values: dict[str, str], *order) -> DataFrame:
    """Adds the inclusive running sum of each column of ``values`` (name -> column) in the given total order."""
    spark = df.sparkSession
    rows = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("_part", F.spark_partition_id()), "running")
    sizes = rows.groupBy("_part").agg(*[F.sum(v).alias(f"_size_{n}") for n, v in values.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", *[F.coalesce(F.sum(f"_size_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in values])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(F.broadcast(bases), "_part")  # a row a partition
    return summed.withColumns({n: F.sum(v).over(inside) + F.col(f"_base_{n}") for n, v in values.items()}).drop("_part", *[f"_base_{n}" for n in values])


def grouped_running(df: DataFrame, by: str, value: str, *order, name: str = "upto") -> DataFrame:
    """Adds the inclusive running sum of ``value`` in each group of ``by`` in the given order, which is total there.

    Rows are dealt by ranges of (by, order), so a large group spans many tasks; a group's sum in a part is based on
    those of the parts before, a row a group and part that it reaches into.
    """
    spark = df.sparkSession
    rows = df.repartitionByRange(shuffle_partitions(spark), by, *order).sortWithinPartitions(by, *order)
    rows = materialize(rows.withColumn("_part", F.spark_partition_id()), "running")
    inside = Window.partitionBy("_part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_inside", F.sum(value).over(inside))
    ends = rows.groupBy(by, "_part").agg(F.max("_inside").alias("_end"))  # values are not negative
    wide = ends.join(ends.groupBy(by).count().where("count > 1").select(by), by)  # few: a part has two such groups at most
    before = F.sum("_end").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = F.broadcast(wide.select(by, "_part", before.alias("_base")))
    return rows.join(bases, [by, "_part"], "left").withColumn(name, F.col("_inside") + F.coalesce("_base", F.lit(0))).drop("_part", "_inside", "_base")
