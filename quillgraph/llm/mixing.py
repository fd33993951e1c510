"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order (by md5 of the doc_id), played up to
``most_repeats`` times. A copy's virtual finish time is the queue's words up to and with it,
divided by the source's target; all copies are range-sorted by finish time and cut off where the words taken
reach the budget. Both the running sums of the queues and those of the global order are made in two
levels: the rows are dealt by ranges of a sort key that no two rows share, summed in a range, and based on the sums of the
ranges before (a small row a range), so neither a hot source, nor a repeated doc_id, nor the global order meets in one task.

Nulls: a null text has size 0; a null source is a source of its own, last in the order of sources.
Repeated rows (the same doc_id and source) are entries of their own, parted by their place; the
words they take are counted for each. Words-free corpora take nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.session import running_sums
from .common import WORD, fresh, materialize, table

WEIGHTS = (5, 2, 1)


def _key(source: Column) -> list[Column]:
    return [source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source_key")]


def targets(sources: DataFrame, weights=WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """sources(no_source, source_key, source_size) -> the same, weight and target.

    Water filling: with the sources in ascending order of cap / weight, those up to some place stand at
    their cap, and the others share what is left by weight; the place is the first at which the share
    of the next one stays below its cap. A row a source: a small table.
    """
    order = Window.orderBy("no_source", "source_key")
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    one = Window.partitionBy(F.lit(1))
    rank = Window.orderBy("ratio", "no_source", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    named = sources.withColumn("weight", weight.cast("double")).withColumn("cap", (F.lit(most_repeats) * F.col("source_size")).cast("double"))
    named = named.withColumn("ratio", F.col("cap") / F.col("weight"))
    named = named.withColumn("total", F.sum("source_size").over(one).cast("double")).withColumn("all_weight", F.sum("weight").over(one))
    named = named.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(rank), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(rank), F.lit(0.0))))
    # the level if all sources before this one are at their caps; the first that lies below its own ratio holds
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no_source", "source_key", "level"))).over(one)["level"]
    return named.withColumn("target", F.least(F.col("cap"), F.coalesce(found * F.col("weight"), F.col("cap")))).select(*sources.columns, "weight", "target")


def mix(docs: DataFrame, weights=WEIGHTS, most_repeats: int = 3, share: float = 1.0, row: str | None = None) -> DataFrame:
    """documents(doc_id, text, source, ...) -> doc_id, row, size, source_size, target, taken, source (a row a document).

    ``share``: the budget as a part of all words. ``row``: the column that numbers the rows of docs; without it their place does.
    """
    place = F.monotonically_increasing_id() if row is None else F.col(row).cast("long")
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    queue = ["no_source", "source_key"]
    sized = materialize(docs.select("doc_id", place.alias("row"), size.alias("size"), *_key(F.col("source")), shuffled.alias("u")).withColumn("one", F.lit(1).cast("long")), "mix-sizes")
    sums = materialize(sized.groupBy(*queue).agg(F.sum("size").alias("source_size"), F.sum("one").alias("source_rows")), "mix-sums")
    # a queue's sums are those over all queues in order, less those of the queues before
    before = Window.orderBy(*queue).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*queue, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("source_size", "source_rows")])
    goal = targets(sums.drop("source_rows"), weights, most_repeats).join(bases, queue)
    order = [*queue, "u", "doc_id", "size", "row"]
    placed = running_sums(sized, {"upto": "size", "n": "one"}, *order).join(goal, queue)
    upto = (F.col("upto") - F.col("source_size_before")).cast("double")
    placed = placed.select("doc_id", "row", "size", "source_size", "target", "u", (F.col("n") - F.col("source_rows_before")).alias("n"), *queue, upto.alias("upto"))
    placed = materialize(placed, "mix-placed")

    def finish(epoch: Column) -> Column:
        return (F.col("upto") + epoch * F.col("source_size")) / F.col("target")

    budget = placed.agg(F.sum("size")).collect()[0][0]
    copies = placed.where("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))))
    copies = copies.select(finish(F.col("epoch")).alias("finish"), "u", *queue, "n", "size")
    order = ["finish", "u", *queue, "n"]
    # copies are taken in order of finish time as long as they fit; all up to the last that does
    ran = running_sums(copies, {"run": "size"}, *order).where(F.col("run") <= F.floor(F.lit(budget or 0) * F.lit(share)))
    mark = ran.agg(F.max(F.struct(*order)).alias("mark")).collect()[0]["mark"]
    taken = F.lit(0)
    if mark is not None:
        last = F.struct(*[F.lit(x).cast("long") if c == "n" else F.lit(x) for c, x in zip(order, mark)])
        for epoch in range(most_repeats):
            inside = F.struct(finish(F.lit(epoch)).alias("finish"), *order[1:]) <= last
            taken = taken + F.when(F.coalesce(inside, F.lit(False)) & (F.col("target") > 0), F.col("size")).otherwise(0)
    source = F.when(~F.col("no_source"), F.col("source_key"))
    return placed.select("doc_id", "row", "size", "source_size", "target", taken.cast("long").alias("taken"), source.alias("source"))


def take(docs: DataFrame, weights=WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns.

    docs must be rows of files (a row's number is its place in them, alike in every scan).
    """
    row, times = fresh(docs, "mix_row"), fresh(docs, "mix_copies")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    taken = mix(numbered, weights, most_repeats, row=row).where("taken > 0").select(F.col("row").alias(row), (F.col("taken") / F.col("size")).cast("int").alias(times))
    copies = numbered.join(taken, row).withColumn(row, F.explode(F.sequence(F.lit(1), F.col(times))))
    return copies.select(*docs.columns)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("row", "source")


#: The same by one sort over everything; md5 parts ties alike.
OP8_SQL = r"""
with sized as (
  select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    source is null as no_source, coalesce(source, '') as source_key, md5(coalesce(cast(doc_id as varchar), 'null')) as u
  from documents),
sums as (select no_source, source_key, sum(size) as source_size from sized group by no_source, source_key),
sources as (
  select *, cast([5, 2, 1][1 + cast((row_number() over (order by no_source, source_key) - 1) % 3 as int)] as double) as weight from sums),
caps as (
  select *, 3.0::double * source_size as cap, 3.0::double * source_size / weight as ratio from sources),
levels as (
  select *, (cast(sum(source_size) over () as double) - coalesce(sum(cap) over w, 0.0::double)) / (sum(weight) over () - coalesce(sum(weight) over w, 0.0::double)) as level
  from caps window w as (order by ratio, no_source, source_key rows between unbounded preceding and 1 preceding)),
goals as (
  select *, least(cap, coalesce((select arg_min(l.level, (l.ratio, l.no_source, l.source_key)) from levels l where l.level <= l.ratio) * weight, cap)) as target
  from levels),
placed as (
  select s.*, g.source_size, g.target,
    row_number() over (partition by s.no_source, s.source_key order by u, doc_id nulls first, size) as n,
    cast(sum(size) over (partition by s.no_source, s.source_key order by u, doc_id nulls first, size rows unbounded preceding) as double) as upto
  from sized s join goals g on s.no_source = g.no_source and s.source_key = g.source_key),
copies as (
  select *, (upto + epoch * cast(source_size as double)) / target as finish from placed, (values (0), (1), (2)) e(epoch) where size > 0 and target > 0),
queued as (
  select *, sum(size) over (order by finish, u, no_source, source_key, n rows unbounded preceding) as run from copies),
taken as (
  select no_source, source_key, n, sum(size) as words from queued where run <= (select sum(size) from sized) group by all)
select p.doc_id, cast(p.size as bigint) as size, cast(p.source_size as bigint) as source_size, cast(p.target as double) as target, cast(coalesce(t.words, 0) as bigint) as taken
from placed p left join taken t on p.no_source = t.no_source and p.source_key = t.source_key and p.n = t.n
"""
