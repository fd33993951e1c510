"""Random walks: the entropy-driven walk with accept and backtrack, and fixed-length weighted walks.

A walker at ``cur`` draws a neighbour by the portable hash, visits it, and steps back (a second visit to
``cur``) if the draw is rejected. Whether it stops depends on the visits so far only, so walks are
drawn up to a cap and cut at the first visit that stops them; capped walks are kept whole and flagged.

Draws run in one of three ways with equal results: over flat files that workers map into memory, or a broadcast
adjacency in numpy arrays when the edges are counted to be few enough, with no shuffle a step; else walkers join
adjacency step by step, with lineage cut by written tables.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import xlog2x
from ..functions.rng import u32, uniform
from ..functions.session import discard, grouped_running, materialize, numbered, shuffle_partitions
from .edges import out_degree
from .flat import Flat, shared_ends, vertex_degrees

MIN_STEPS, CORR_BOUND, KL_STEP, INIT_ROUNDS = 20, 0.999, 0.001, 5
MAX_DRAWS = 64
#: Most directed edges whose adjacency is broadcast (24 bytes each).
BROADCAST_EDGES = 8_000_000
DRAWS = "round int, walker long, k int, cur long, cand long, rejected boolean"


def init_walkers(spark, walkers: int, vertices: int, round_: int = 0) -> DataFrame:
    """Walker i starts at vertex i modulo the number of vertices."""
    return spark.range(walkers).select(F.lit(round_).cast("int").alias("round"), F.col("id").alias("walker"), F.pmod("id", F.lit(vertices)).alias("cur"))


def draw_local(walkers: DataFrame, chances: DataFrame, max_draws: int = MAX_DRAWS, salt: int = 7) -> DataFrame:
    """Draws over a broadcast adjacency."""
    edges = chances.select("src", "dst", "accept").toArrow()
    src, dst, accept = (edges.column(c).to_numpy() for c in ("src", "dst", "accept"))
    order = np.lexsort((dst, src))
    src, dst, accept = src[order], dst[order].astype(np.int64), accept[order].astype(np.float64)
    top = int(max(src.max(), dst.max())) + 1 if len(src) else 0
    offsets = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=top))]) if len(src) else np.zeros(1, np.int64)
    alone = np.zeros(len(offsets) - 1, bool)  # vertices whose only rows are the two of a self-loop
    two = np.flatnonzero(np.diff(offsets) == 2)
    alone[two] = dst[offsets[two]] == two
    own = np.flatnonzero(src == dst)
    shared = walkers.sparkSession.sparkContext.broadcast((offsets, dst, accept, alone, own))

    def run(batches):
        offs, dst, accept, alone, own = shared.value
        return _steps(batches, offs, dst, lambda at, place, cand, share: accept[place], alone, own, max_draws, salt)

    return walkers.repartition(F.col("walker")).mapInPandas(run, DRAWS)


def _steps(batches, *how):
    """The draws of each batch of walkers, a frame a step; see _moves()."""
    for pdf in batches:
        round_, walker = (pdf[c].to_numpy(np.int64) for c in ("round", "walker"))
        for k, i, cur, cand, rejected in _moves(pdf, *how):
            yield pd.DataFrame({"round": round_[i].astype(np.int32), "walker": walker[i], "k": np.int32(k), "cur": cur, "cand": cand, "rejected": rejected})


def _moves(pdf: pd.DataFrame, offs, dst, accept, alone, own, max_draws: int, salt: int):
    """The draws of a batch of walkers over offsets and neighbours in arrays, a step after another: k, the walkers' rows, cur, cand,
    rejected. accept(at, place, cand, share): the chances of the edges at ``place``, or what lies on the same side of ``share``;
    ``alone``: vertices without another neighbour, or None; ``own``: the places of self-loops."""
    loops = np.bincount(np.searchsorted(offs, own, "right") - 1, minlength=len(offs)) if len(own) else None
    md5 = hashlib.md5
    round_, walker, cur = (pdf[c].to_numpy(np.int64) for c in ("round", "walker", "cur"))
    cur = cur.copy()
    keys = [f"{salt}|{r}|{w}|" for r, w in zip(round_.tolist(), walker.tolist())]
    alive = np.flatnonzero((cur >= 0) & (cur < len(offs) - 1))
    for k in range(max_draws):
        # a step of all walkers at once; only the hashes are made one by one
        at = cur[alive]
        size = offs[at + 1] - offs[at] - (loops[at] if k == 0 and loops is not None else 0)
        go = size > 0 if alone is None else (size > 0) & ~alone[at]
        alive, at, size = alive[go], at[go], size[go]
        if not len(alive):
            break
        heads = [f"{keys[i]}{k}|" for i in alive.tolist()]
        draw = np.frombuffer(b"".join([md5((x + "n").encode()).digest()[:4] for x in heads]), ">u4").astype(np.int64)
        share = np.frombuffer(b"".join([md5((x + "a").encode()).digest()[:4] for x in heads]), ">u4") / 4294967296.0
        place = offs[at] + draw % size
        if k == 0 and len(own):  # the first step leaves the self-loops out, which lie together
            first = np.searchsorted(own, offs[at])
            loop = own[np.minimum(first, len(own) - 1)]
            place = np.where((loops[at] > 0) & (place >= loop), place + loops[at], place)
        cand = dst[place].astype(np.int64)
        rejected = accept(at, place, cand, share) <= share
        yield k, alive, at, cand, rejected
        cur[alive] = np.where(rejected, at, cand)


#: Beyond rounding, for chances that are known to lie on one side of a share.
CLEAR = 1e-9


def _over_flat(graph: Flat, max_draws: int, salt: int):
    """How _moves() draws over flat files, in place; a vertex is its id there. Common neighbours are read from their
    file, or counted for the drawn edges whose draw they can decide."""
    begin, near = np.asarray(graph.begin()), np.asarray(graph.near())
    common, mark = (graph.common(), None) if graph.counted else (None, np.zeros(graph.ids, bool))

    def accept(at, place, cand, share):
        a, b = begin[at + 1] - begin[at], begin[cand + 1] - begin[cand]
        less, ratio = np.minimum(a, b), np.maximum(a, b) / np.minimum(a, b)

        def chance(common):
            free = a - common
            return np.where(free == 0, 1.0, np.tanh(ratio / np.maximum(free, 1)))

        if common is not None:
            return chance(common[place])
        # the chance rises with the common neighbours, of which there are none up to all others of the shorter list
        low, high = chance(0), chance(less - 1)
        open_ = (low <= share + CLEAR) & (high > share - CLEAR)
        met = np.where(low > share, 0, less - 1)
        met[open_] = shared_ends(begin, near, at[open_], cand[open_], mark)
        return chance(met)

    return begin, near, accept, None, np.empty(0, np.int64), max_draws, salt


def draw_flat(walkers: DataFrame, graph: Flat, max_draws: int = MAX_DRAWS, salt: int = 7) -> DataFrame:
    """The same draws over flat files."""
    return walkers.repartition(shuffle_partitions(walkers.sparkSession), "walker").mapInPandas(lambda batches: _steps(batches, *_over_flat(graph, max_draws, salt)), DRAWS)


#: Walkers times draws that a worker packs at a time.
PACKED = 2_000_000


def visits_flat(walkers: DataFrame, graph: Flat, max_draws: int = MAX_DRAWS, salt: int = 7) -> DataFrame:
    """round, walker, spent, step, vertex: the visits of the same draws, spent where a walker made all of them. Each walk is shuffled as one
    row, so that the rows of a walk, which lie together already, need no further exchange."""

    def run(batches):
        how = _over_flat(graph, max_draws, salt)
        for whole in batches:
            for i in range(0, len(whole), max(1, PACKED // max_draws)):
                pdf = whole.iloc[i : i + max(1, PACKED // max_draws)]
                n = len(pdf)
                # for each draw a place for the candidate and one for the way back
                at, spent = np.full((n, 2 * max_draws), -1, np.int32), np.zeros(n, bool)
                for k, row, cur, cand, rejected in _moves(pdf, *how):
                    at[row, 2 * k] = cand
                    at[row[rejected], 2 * k + 1] = cur[rejected]
                    if k == max_draws - 1:
                        spent[row] = True
                made = at >= 0
                ends = np.concatenate([[0], np.cumsum(made.sum(axis=1))]).astype(np.int32)
                path = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[made]))
                columns = [*(pdf[c].to_numpy(t) for c, t in (("round", np.int32), ("walker", np.int64), ("cur", np.int64))), spent]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), path], ["round", "walker", "cur", "spent", "path"])

    n = shuffle_partitions(walkers.sparkSession)
    packed = walkers.repartition(n, "walker").mapInArrow(lambda batches: run(b.to_pandas() for b in batches), "round int, walker long, cur long, spent boolean, path array<int>")
    path = F.concat(F.array("cur"), F.col("path").cast("array<long>"))
    return packed.repartition(n, "round", "walker").select("round", "walker", "spent", F.posexplode(path).alias("step", "vertex"))


def _numbered_neighbours(chances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, i, dst, accept): each vertex's neighbours numbered by dst; (src, degree, first): how many, and the first.

    Numbers come from places in the whole sorted list, so a hub's neighbours are no one task's.
    """
    rows = numbered(chances, "src", "dst", name="place")
    heads = materialize(rows.groupBy("src").agg(F.min("place").alias("base"), F.count("*").alias("degree"), F.min("dst").alias("first")), "heads")
    rows = rows.join(heads.select("src", "base"), "src").select("src", (F.col("place") - F.col("base")).alias("i"), "dst", "accept")
    return materialize(rows, "neighbours"), heads.drop("base")


def draw_joined(walkers: DataFrame, chances: DataFrame, max_draws: int = MAX_DRAWS, salt: int = 7) -> DataFrame:
    """The same draws by joins: a walker meets its vertex's degree, then the neighbour of the number it drew. Every step is
    written, so none is made twice."""
    rows, heads = _numbered_neighbours(chances)
    others, other_heads = _numbered_neighbours(chances.where("src <> dst"))
    now, out = walkers, None
    for k in range(max_draws):
        met = now.join(heads.withColumnRenamed("src", "cur"), "cur").where("not (degree = 2 and first = cur)")
        if k == 0:
            met = met.drop("degree", "first").join(other_heads.withColumnRenamed("src", "cur"), "cur")
        met = met.withColumn("i", F.pmod(u32(salt, F.col("round"), F.col("walker"), k, "n"), F.col("degree")))
        step = met.join((others if k == 0 else rows).withColumnRenamed("src", "cur"), ["cur", "i"])
        step = step.select("round", "walker", F.lit(k).alias("k"), "cur", F.col("dst").alias("cand"), (F.col("accept") <= uniform(salt, F.col("round"), F.col("walker"), k, "a")).alias("rejected"))
        step = materialize(step, "draws")
        if step.isEmpty():
            break
        out = step if out is None else out.unionByName(step)
        now = step.select("round", "walker", F.when(F.col("rejected"), F.col("cur")).otherwise(F.col("cand")).alias("cur"))
    return walkers.sparkSession.createDataFrame([], DRAWS) if out is None else out


def draw(walkers: DataFrame, chances: DataFrame | Flat, max_draws: int = MAX_DRAWS, salt: int = 7, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """Draws of walkers(round, walker, cur) over flat files, or over written chances by the way that the counted edges allow."""
    if isinstance(chances, Flat):
        return draw_flat(walkers, chances, max_draws, salt)
    few = chances.count() <= broadcast_edges
    return (draw_local if few else draw_joined)(walkers, chances, max_draws, salt)


def visits(walkers: DataFrame, draws: DataFrame) -> DataFrame:
    """round, walker, step, vertex, k: the start, then one or two visits a draw."""
    made = F.when(F.col("rejected"), F.array("cand", "cur")).otherwise(F.array("cand"))
    rows = draws.select("round", "walker", "k", F.posexplode(made).alias("half", "vertex"))
    start = walkers.select("round", "walker", F.lit(-1).alias("k"), F.lit(0).alias("half"), F.col("cur").alias("vertex"))
    step = F.row_number().over(Window.partitionBy("round", "walker").orderBy("k", "half")) - 1
    return start.unionByName(rows).withColumn("step", step).select("round", "walker", "step", "vertex", "k")


def running(seen: DataFrame) -> DataFrame:
    """Visits with h, the entropy (bits) of the visits so far, and r, its correlation with their number (1 for the
    first; 0 where either does not vary)."""
    walk = Window.partitionBy("round", "walker")
    upto = walk.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    f = F.row_number().over(Window.partitionBy("round", "walker", "vertex").orderBy("step")).cast("double")
    rows = seen.withColumn("_gain", xlog2x(f) - xlog2x(f - 1)).withColumn("_n", (F.col("step") + 1).cast("double"))
    rows = rows.withColumn("h", F.log2("_n") - F.sum("_gain").over(upto) / F.col("_n"))
    level = F.round("h", 12)
    r = F.when(F.col("step") == 0, F.lit(1.0)).otherwise(F.coalesce(F.nanvl(F.corr(level, "_n").over(upto), F.lit(0.0)), F.lit(0.0)))
    return rows.withColumn("r", r).drop("_gain", "_n")


def cut(rows: DataFrame, min_steps: int = MIN_STEPS, bound: float = CORR_BOUND) -> DataFrame:
    """The visits up to the first that stops its walk; ``capped`` marks walks that none stops."""
    stops = (F.col("step") > min_steps) & ((F.col("r") * F.col("r") < bound) | (F.col("r") < 0))
    last = F.min(F.when(stops, F.col("step"))).over(Window.partitionBy("round", "walker"))
    rows = rows.withColumn("stop", last)
    return rows.where(F.col("stop").isNull() | (F.col("step") <= F.col("stop"))).withColumn("capped", F.col("stop").isNull())


#: Draws after which nearly every walk has stopped.
FIRST_DRAWS = 24


def entropy_walk(walkers: DataFrame, chances: DataFrame | Flat, min_steps: int = MIN_STEPS, bound: float = CORR_BOUND, max_draws: int | None = None, salt: int = 7) -> DataFrame:
    """round, walker, step, vertex, h, r, capped.

    Whether a walk stops depends on its start only, so all walkers make a few draws, and those that have not stopped
    by then are walked again with twice as many, until each has stopped or stands where no draw can be made; with
    ``max_draws`` until then, and walks that go on beyond are marked as capped.
    """
    chances = chances if isinstance(chances, Flat) else materialize(chances.select("src", "dst", "accept"), "chances")
    draws, left, out = FIRST_DRAWS, walkers, None
    while True:
        draws = draws if max_draws is None else min(draws, max_draws)
        # a walk that nothing has stopped has come to its end if it made fewer draws
        if isinstance(chances, Flat):
            seen = cut(running(visits_flat(left, chances, draws, salt)), min_steps, bound).drop("stop")
            seen = materialize(seen.withColumn("capped", F.col("capped") & F.col("spent")).drop("spent"), "walks")
        else:
            made = materialize(draw(left, chances, draws, salt), "draws")
            seen = cut(running(visits(left, made)), min_steps, bound).drop("stop")
            last = F.max("k").over(Window.partitionBy("round", "walker"))
            seen = materialize(seen.withColumn("capped", F.col("capped") & (last == draws - 1)).drop("k"), "walks")
            discard(made)
        done = draws == max_draws
        now = seen if done else seen.where("not capped")
        out = now if out is None else out.unionByName(now)
        left = materialize(seen.where("capped and step = 0").select("round", "walker", F.col("vertex").alias("cur")), "walkers")
        if done or left.isEmpty():
            return out
        draws *= 2


def paths(seen: DataFrame) -> DataFrame:
    """One sequence a walker."""
    steps = F.array_sort(F.collect_list(F.struct("step", "vertex")))
    return seen.groupBy("round", "walker").agg(F.transform(steps, lambda x: x["vertex"]).alias("path"))


def consume_paths(path: DataFrame, consumer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``consumer`` makes of batches of paths(round, walker, path), where they are: paths are never gathered."""
    return path.mapInPandas(lambda batches: map(consumer, batches), schema)


def visit_counts(seen: DataFrame) -> DataFrame:
    return seen.groupBy(F.col("vertex").alias("v")).agg(F.count("*").alias("cn"))


def relative_entropy(undirected: DataFrame | Flat, counts: DataFrame) -> DataFrame:
    """d, the sum of p ln(p / q) of degrees p against visits q; vertices of degree 0 count nothing, q = 0 makes it infinite."""
    degree = vertex_degrees(counts.sparkSession, undirected) if isinstance(undirected, Flat) else out_degree(undirected)
    rows = degree.join(counts, "v", "left")
    sums = rows.agg(F.sum("degree").alias("all_degree"))
    all_visits = counts.agg(F.sum("cn").alias("all_visits"))
    degree_total, visit_total = sums.collect()[0][0], all_visits.collect()[0][0]
    p, q = F.col("degree") / F.lit(degree_total), F.coalesce("cn", F.lit(0)) / F.lit(visit_total)
    return rows.agg(F.sum(F.when(q == 0, F.lit(float("inf"))).otherwise(p * (F.ln(p) - F.ln(q)))).alias("d"))


def rounds(spark, undirected: DataFrame, chances: DataFrame | Flat, vertices: int, walkers: int, init_rounds: int = INIT_ROUNDS, tolerance: float = KL_STEP, max_rounds: int | None = None, **options) -> DataFrame:
    """Rounds of walks until the relative entropy of degrees against all visits moves by at most the tolerance: round, d, visits.

    The first round has walkers x init_rounds walkers, each later one walkers. With ``max_rounds``, rounds that have not settled
    by then are an error.
    """
    counts, out, before = None, [], 0.0
    for i in itertools.count():
        if i == max_rounds:
            raise RuntimeError(f"the rounds have not settled after {max_rounds}")
        seen = entropy_walk(init_walkers(spark, walkers * (init_rounds if i == 0 else 1), vertices, i), chances, **options)
        now = visit_counts(seen)
        now = now if counts is None else counts.unionByName(now).groupBy("v").agg(F.sum("cn").alias("cn"))
        counts = materialize(now, "counts")
        d = relative_entropy(chances if isinstance(chances, Flat) else undirected, counts).collect()[0]["d"]
        out.append((i, float(d), counts.agg(F.sum("cn")).collect()[0][0]))
        if abs(d - before) <= tolerance:
            break
        before = d
    return spark.createDataFrame(out, "round int, d double, visits long")


#: Neighbours that a weighted step searches, on average.
BUCKET = 16


def _weight_buckets(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, bucket, dst, low, upto): each vertex's neighbours by dst with the running weight before and with them, in every
    bucket of equal weight that they reach into; (src, whole, buckets). Rows exceed the edges by a BUCKET-th at most."""
    # parallel edges are one of their whole weight, so that dst is a total order
    rows = edges.groupBy("src", "dst").agg(F.sum(F.col("w").cast("double")).alias("w"))
    rows = materialize(grouped_running(rows, "src", "w", "dst"), "weights").withColumn("low", F.col("upto") - F.col("w"))
    heads = materialize(rows.groupBy("src").agg(F.max("upto").alias("whole"), F.ceil(F.count("*") / BUCKET).alias("buckets")), "heads")
    rows = rows.join(heads, "src")
    at = lambda x: F.floor(F.col(x) / F.col("whole") * F.col("buckets"))
    rows = rows.withColumn("bucket", F.explode(F.sequence(at("low"), at("upto")))).select("src", "bucket", "dst", "low", "upto")
    return materialize(rows, "buckets"), heads


def weighted_walk(walkers: DataFrame, edges: DataFrame, length: int, second_order: bool = False, salt: int = 7, ends: Column | None = None) -> DataFrame:
    """Walks of at most ``length`` steps by edge weight: round, walker, step, vertex.

    ``ends``: the chance that a walk ends where it stands, an expression over round, walker, step, cur and prev.

    A walker takes the first neighbour (by dst) whose running weight passes a uniform share of the whole. Second order:
    neighbours are distinct and count alike, but the one it came from counts twice. A walker without neighbours stays out of later steps.
    Steps are joins on a vertex and a bucket of its weight, or a neighbour's number; no vertex's neighbours are
    gathered in a row.
    """
    if second_order:
        rows, heads = _numbered_neighbours(edges.select("src", "dst").distinct().withColumn("accept", F.lit(1.0)))
        places = rows.select(F.col("src").alias("cur"), F.col("dst").alias("prev"), (F.col("i") + 1).alias("back"))
    else:
        rows, heads = _weight_buckets(edges)
    rows, heads = rows.withColumnRenamed("src", "cur"), heads.withColumnRenamed("src", "cur")
    now = walkers.select("round", "walker", "cur", F.lit(None).cast("long").alias("prev"))
    out = now.select("round", "walker", F.lit(0).alias("step"), F.col("cur").alias("vertex"))
    for k in range(length):
        share = uniform(salt, F.col("round"), F.col("walker"), k, "w")
        if ends is not None:
            now = now.withColumn("step", F.lit(k)).where(uniform(salt, F.col("round"), F.col("walker"), k, "e") >= ends).drop("step")
        met = now.join(heads, "cur")
        if second_order:
            met = met.join(places, ["cur", "prev"], "left").withColumn("back", F.coalesce("back", F.lit(0)))
            met = met.withColumn("goal", share * (F.col("degree") + F.when(F.col("back") > 0, 1).otherwise(0)))
            # the running weight is i before the place it came from, and i + 1 from there on
            plain = (F.col("back") == 0) | (F.col("goal") < F.col("back") - 1)
            at = F.when(plain, F.floor("goal") + 1).otherwise(F.greatest(F.col("back"), F.floor("goal")))
            step = met.withColumn("i", (at - 1).cast("long")).join(rows, ["cur", "i"])
        else:
            met = met.withColumn("goal", share * F.col("whole"))
            met = met.withColumn("bucket", F.floor(F.col("goal") / F.col("whole") * F.col("buckets")))
            step = met.join(rows, ["cur", "bucket"]).where("upto > goal and low <= goal")
        now = materialize(step.select("round", "walker", F.col("dst").alias("nxt"), F.col("cur").alias("prev")).withColumnRenamed("nxt", "cur"), "walkers")
        out = out.unionByName(now.select("round", "walker", F.lit(k + 1).alias("step"), F.col("cur").alias("vertex")))
    return out
