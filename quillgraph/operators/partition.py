"""Vertex partitions: ranges of equal workload, and greedy assignment of a vertex stream."""

from __future__ import annotations

import itertools
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import discard, materialize, numbered, running_sum
from .edges import max_degree_vertex, out_degree, to_undirected
from .flat import stream, write_flat
from .programs import bfs

BETA, PER_VERTEX = 2.0, 5
#: Most edges of one sequential stream; larger graphs go by batches.
STREAM_EDGES = 20_000_000


def workload_ranges(vertices: DataFrame, edges: DataFrame, parts: int, per_vertex: int = PER_VERTEX) -> DataFrame:
    """Dense vertices(v) -> p, begin, end: each part takes vertices while its running sum of (per_vertex + degree)
    is below ceil(total / parts); what a part oversteps is carried, the last ends at the last vertex.

    The prefix sums are made by Spark; the bounds are ``parts`` lookups in them, each a filtered minimum.
    """
    load = F.lit(per_vertex) + F.coalesce("degree", F.lit(0))
    rows = running_sum(vertices.join(out_degree(edges), "v", "left").select("v", load.alias("load")), "load", "v")
    total, count = rows.agg(F.max("upto"), F.max("v") + 1).collect()[0]
    spark = vertices.sparkSession
    if total is None:
        return spark.createDataFrame([], "p int, begin long, end long")
    goal, begin, base, out = -(-total // parts), 0, 0, []
    for p in range(parts):
        if p == parts - 1:
            end = count
        else:
            # the first vertex with which the part's own sum reaches the goal ends it
            hit = rows.where(F.col("upto") >= base + goal).agg(F.min(F.struct("v", "upto")).alias("m")).collect()[0]["m"]
            end, base = (hit["v"] + 1, hit["upto"]) if hit else (count, total)
        out.append((p, begin, end))
        begin = end
    return spark.createDataFrame(out, "p int, begin long, end long")


def chunk_ranges(vertices: DataFrame, edges: DataFrame, parts: int, align: int = 4096) -> DataFrame:
    """Like workload_ranges with weight 8 (parts - 1) a vertex, the goal renewed to remaining / remaining parts, and
    ends rounded down to multiples of ``align`` (the last at the last vertex)."""
    alpha = 8 * (parts - 1)
    load = F.lit(alpha) + F.coalesce("degree", F.lit(0))
    rows = running_sum(vertices.join(out_degree(edges), "v", "left").select("v", load.alias("load")), "load", "v")
    total, count = rows.agg(F.max("upto"), F.max("v") + 1).collect()[0]
    spark = vertices.sparkSession
    if total is None:
        return spark.createDataFrame([], "p int, begin long, end long")
    begin, base, out = 0, 0, []
    for p in range(parts):
        if p == parts - 1:
            end = count
        else:
            goal = (total - base) // (parts - p)
            hit = rows.where(F.col("upto") > base + goal).agg(F.min("v")).collect()[0][0]
            end = count if hit is None else max(begin, (hit + 1) // align * align)
            base = rows.where(F.col("v") == end - 1).agg(F.max("upto")).collect()[0][0] or base
        out.append((p, begin, end))
        begin = end
    return spark.createDataFrame(out, "p int, begin long, end long")


def owner(vertices: DataFrame, ranges: DataFrame) -> DataFrame:
    """vertices(v, ...) with the part whose range holds v: a lookup in the few bounds, no shuffle."""
    bounds = sorted((r["begin"], r["end"], r["p"]) for r in ranges.collect() if r["begin"] < r["end"])
    part = F.lit(None).cast("int")
    for begin, end, p in bounds:
        part = F.when((F.col("v") >= begin) & (F.col("v") < end), F.lit(p)).otherwise(part)
    return vertices.withColumn("part", part)


def partition_sizes(owned: DataFrame) -> DataFrame:
    return owned.groupBy("part").agg(F.count("*").alias("size"))


def part_ranges(owned: DataFrame) -> DataFrame:
    """p, begin, end of the ids that relabel_by_partition gives: each part's size after the sizes of the parts before."""
    rows = sorted((r["part"], r["size"]) for r in partition_sizes(owned).collect())  # a row a part
    ends = list(itertools.accumulate(n for _, n in rows))
    return owned.sparkSession.createDataFrame([(p, end - n, end) for (p, n), end in zip(rows, ends)], "p int, begin long, end long")


def balance(owned: DataFrame) -> DataFrame:
    sizes = partition_sizes(owned)
    return sizes.agg((F.max("size") / F.avg("size")).alias("max_over_mean"), (F.min("size") / F.avg("size")).alias("min_over_mean"))


def edge_cut(edges: DataFrame, owned: DataFrame) -> DataFrame:
    """Edges in all, and those whose ends lie in two parts."""
    a = owned.select(F.col("v").alias("src"), F.col("part").alias("a"))
    b = owned.select(F.col("v").alias("dst"), F.col("part").alias("b"))
    return edges.join(a, "src").join(b, "dst").agg(F.count("*").alias("edges"), F.count_if(F.col("a") != F.col("b")).alias("cut"))


def stream_order(edges: list[tuple[int, int]], vertices: list[int], depth_first: bool = True, by_degree: bool = True) -> list[int]:
    """Visiting order from the smallest vertex of the largest degree; vertices it never reaches follow by id.

    Neighbours are marked when they are put aside. Depth first: the last put aside comes next, put aside by
    ascending degree; breadth first: by descending degree. Without degrees they are taken by id.
    """
    near: dict[int, list[int]] = {v: [] for v in vertices}
    for a, b in edges:
        near[a].append(b)
    if not near:
        return []
    for v in near:
        near[v].sort()
    start = min(near, key=lambda v: (-len(near[v]), v))
    marked, todo, out = {start}, deque([start]), []
    while todo:
        v = todo.pop() if depth_first else todo.popleft()
        out.append(v)
        fresh = [x for x in dict.fromkeys(near[v]) if x not in marked]
        marked.update(fresh)
        if by_degree:
            fresh.sort(key=lambda x: (len(near[x]) if depth_first else -len(near[x]), x))
        todo.extend(fresh)
    return out + sorted(set(near) - marked)


def greedy(stream: list[int], near: dict[int, dict[int, float]], parts: int, beta: float = BETA) -> dict[int, int]:
    """Each vertex of the stream goes to the part with the best score, the first of equals:
    (weight and number of its neighbours there, and 1) x (1 - part size / (beta x placed / parts))."""
    part_of: dict[int, int] = {}
    sizes = [0] * parts
    for placed, v in enumerate(stream):
        if not placed:
            best = 0
        else:
            gain = [1.0] * parts
            for x, w in near.get(v, {}).items():
                if (p := part_of.get(x)) is not None:
                    gain[p] += w + 1
            room = beta * placed / parts
            scores = [g * (1 - s / room) for g, s in zip(gain, sizes)]
            best = max(range(parts), key=lambda p: (scores[p], -p))
        part_of[v] = best
        sizes[best] += 1
    return part_of


def _near(pdf: pd.DataFrame) -> dict[int, dict[int, float]]:
    near: dict[int, dict[int, float]] = {}
    for a, b, w in zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["w"].tolist()):
        near.setdefault(a, {})[b] = w
    return near


def stream_vertices(undirected: DataFrame, depth_first: bool = True, by_degree: bool = True, most_edges: int = STREAM_EDGES) -> DataFrame:
    """undirected(src, dst) -> at, v: the visiting order. Sequential by definition: one task, so the graph's size is checked."""
    _check(undirected, most_edges)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        got = stream_order(list(zip(pdf["src"].tolist(), pdf["dst"].tolist())), sorted(set(pdf["src"]) | set(pdf["dst"])), depth_first, by_degree)
        return pd.DataFrame({"at": range(len(got)), "v": got})

    return undirected.select("src", "dst", F.lit(0).alias("g")).groupBy("g").applyInPandas(order, "at long, v long")


def stream_edges(edges: DataFrame, depth_first: bool = True, by_degree: bool = True) -> DataFrame:
    """The same of undirected edges(src, dst) given once: one task over flat files where the graph fits them, which holds no edges."""
    given = materialize(edges.select("src", "dst"), "given")
    if graph := write_flat(given):
        discard(given)
        return stream(edges.sparkSession, graph, depth_first, by_degree)
    return stream_vertices(to_undirected(given), depth_first, by_degree)


def level_stream(undirected: DataFrame) -> DataFrame:
    """undirected(src, dst) -> at, v: the breadth-first stream for graphs of any size. Vertices come level by level from the smallest
    vertex of the largest degree, in a level by descending degree and id; those never reached follow by degree and id."""
    top = max_degree_vertex(undirected).collect()
    if top[0]["v"] is None:
        return undirected.select(F.col("src").alias("at"), F.col("src").alias("v")).where("false")
    levels = materialize(bfs(undirected, top[0]["v"]).select("v", "level"), "levels")
    rows = out_degree(undirected).join(levels, "v", "left").select("v", F.coalesce("level", F.lit((1 << 62))).alias("level"), (-F.col("degree")).alias("less"))
    return numbered(rows, "level", "less", "v", name="at").select("at", "v")


def _check(edges: DataFrame, most: int) -> None:
    if (n := edges.count()) > most:
        raise ValueError(f"{n} edges are too many for one sequential stream (at most {most}): use greedy_batches")


def greedy_partition(undirected: DataFrame, parts: int, most_edges: int = STREAM_EDGES) -> DataFrame:
    """undirected(src, dst, w) -> v, part: the greedy assignment of the depth-first stream. One task, size checked."""
    _check(undirected, most_edges)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        got = greedy(stream_order(list(zip(pdf["src"].tolist(), pdf["dst"].tolist())), sorted(set(pdf["src"]) | set(pdf["dst"]))), _near(pdf), parts)
        return pd.DataFrame({"v": list(got), "part": list(got.values())})

    return undirected.select("src", "dst", "w", F.lit(0).alias("g")).groupBy("g").applyInPandas(assign, "v long, part int")


def greedy_batches(undirected: DataFrame, stream: DataFrame, parts: int, batch: int) -> DataFrame:
    """stream(at, v) cut into contiguous batches of ``batch`` vertices, each assigned against its own placements
    only: v, part. Batches are bounded and independent; with level_stream() this is the form for graphs of any size."""
    at = stream.withColumn("batch", F.floor(F.col("at") / batch))
    a = at.select(F.col("v").alias("src"), F.col("batch").alias("a"))
    b = at.select(F.col("v").alias("dst"), F.col("batch").alias("b"))
    inside = undirected.join(a, "src").join(b, "dst").where("a = b").select(F.col("a").alias("batch"), "src", "dst", "w")
    rows = inside.withColumn("at", F.lit(None).cast("long")).unionByName(at.select("batch", F.col("v").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("w"), "at"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["dst"].isna()].sort_values("at")
        got = greedy(own["src"].tolist(), _near(pdf[pdf["dst"].notna()].astype({"dst": "int64"})), parts)
        return pd.DataFrame({"v": list(got), "part": list(got.values())})

    return rows.groupBy("batch").applyInPandas(assign, "v long, part int")


def relabel_by_partition(owned: DataFrame) -> DataFrame:
    """v, part -> v, id: the place in the parts' lists one after another, each ascending."""
    return numbered(owned.select("v", "part"), "part", "v", name="id").select("v", "id")
